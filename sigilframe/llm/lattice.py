"""SentencePiece encoding by sampling distinct segmentations, and decoding.

Method.  Gumbel top-k without replacement by a perturbed A-star search over the lattice of pieces.
The log mass below every search node is known exactly from forward sums, so a node's perturbed score
is a Gumbel truncated at its parent's, and the best child has its parent's own score: the search runs
straight down to a leaf, leaving at each choice one agenda entry for all the children not taken (their
scores' maximum is again a truncated Gumbel).  Popping the best entry gives the next distinct
segmentation.  The score of the (k+1)-th, the best entry left, gives each sample's log inclusion
probability log(1 - exp(-exp(log p - kappa))).  All randomness is hashed from the row key, the
sample's number and the place, so the samples do not depend on how rows are split (scores agree to
some nine digits).

Pieces never cross a space from its left, nor white space that no longer piece holds, so the lattice
of a text falls into chunks; each distinct chunk of a block is built once, all in numpy, and the
chunks of all texts of a block are sampled together.  A piece's weight falls with its rank as in
Zipf's law; ``sharpness`` is the exponent.  Characters outside the vocabulary are written as bytes.

Scale.  One narrow pass over the rows, no shuffle; memory follows a block or the longest text.

Defined results.  Null and empty texts have one empty segmentation, certain to be included.  Where a
text has fewer segmentations than ``k``, all are given and all are certain.  Null ids count as 0 in
the key; rows that repeat an id and a text repeat their samples.  An empty table gives an empty
table.  Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .text import U, _power, _sums, blocks, digit_order, mix, ragged, stream

K, SHARPNESS, SHIFT = 2, 1.0, 10.0
K_QUERY = 4  # samples a document in the registered query
MODEL = "piece_bpe_32k.model"
BLOCK = 1 << 18  # the arrays of a block are many times its bytes; samples do not depend on it
SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_crc32 long"
_MARK = 0x2581
_GOLD, _ODD = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1) from 64-bit keys; never 1 itself."""
    return ((mix(x) >> U(12)).astype(np.float64) + 0.5) * 2.0**-52


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


class Pieces:
    """The vocabulary as hashes of code points, with log weights."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = np.zeros(256, np.int64)
        for i in range(n):
            if self.model.is_byte(i):
                self.bytes[int(names[i][3:5], 16)] = i
        own = [i for i in range(n) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        text_ids = set(own)
        # Every beginning of a piece is held too, with id -1 unless it is a piece itself.
        heads = {x[:n]: -1 for x in (names[i] for i in own) for n in range(1, len(x))} | {names[i]: i for i in own}
        text = np.frombuffer("".join(heads).encode("utf-32-le"), np.uint32)
        length = np.array([len(x) for x in heads])
        end = np.cumsum(length)
        with np.errstate(over="ignore"):
            h = self.key(_sums(text.astype(U), end - length, end - 1), length)
        order = np.argsort(h)
        self.hash, self.id, self.longest = h[order], np.array(list(heads.values()), np.int32)[order], int(length.max())
        # Slot of the hash's first 20 bits: a piece's place, -1 for none, -2 for several.
        slot, place, times = np.unique(self.hash >> U(44), return_index=True, return_counts=True)
        self.slot = np.full(1 << 20, -1, np.int32)
        self.slot[slot] = np.where(times == 1, place, -2)
        self.taken = self.slot != -1  # a quarter of the slots' memory
        # Rank in the vocabulary's order; bytes stand at its end.
        self.weight = -sharpness * np.log(np.arange(n) - own[0] + 1 + SHIFT, where=np.arange(n) >= own[0], out=np.full(n, np.log(n + SHIFT)))
        self.weight[: own[0]] = -sharpness * np.log(n + SHIFT)
        joined = {ord(c) for i in own if len(names[i]) > 1 for c in names[i]}
        # What each piece stands for; pieces without a text of their own are left to the model.
        spelled = [bytes([int(names[i][3:5], 16)]) if self.model.is_byte(i) else names[i].replace(chr(_MARK), " ").encode() if i in text_ids else b"" for i in range(n)]
        self.plain, self.high = np.array([bool(x) for x in spelled] + [False]), np.array([self.model.is_byte(i) and spelled[i] > b"\x7f" for i in range(n)] + [False])
        self.spelled = pa.array([*spelled, b""], pa.large_binary())  # the last entry stands for unknown ids
        self.isolated = np.zeros(256, bool)
        self.isolated[[c for c in (9, 10, 11, 12, 13) if c not in joined]] = True
        self.size = n

    @staticmethod
    def key(sums: np.ndarray, length) -> np.ndarray:
        return mix(sums * _ODD + np.asarray(length).astype(U))

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of runs of ids; run k ends before ``ends[k]``."""
        own = np.minimum(ids, self.size)
        # What is taken stands in one buffer, one piece behind the other.
        _, offsets, data = self.spelled.take(pa.array(own)).buffers()
        at = np.frombuffer(offsets, np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = memoryview(data if data is not None else b"")
        odd, high = np.flatnonzero(~self.plain[own]), np.flatnonzero(self.high[own])
        runs = np.concatenate([[0], ends])
        some = [np.diff(np.searchsorted(x, runs)).tolist() for x in (odd, high)]
        out, begin = [], 0
        for end, lo, hi, odd, high in zip(ends.tolist(), at[runs[:-1]].tolist(), at[runs[1:]].tolist(), *some):
            text = bytes(data[lo:hi])
            if odd or (high and not _is_utf8(text)):
                out.append(self.model.decode(ids[begin:end].tolist()).encode())
            else:  # the space that encoding puts first goes, unless it is written as a byte
                out.append(text[1:] if text[:1] == b" " and ids[begin] != self.bytes[32] else text)
            begin = end
        return out

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, piece ids) of the hashes that begin a piece."""
        slot = (h >> U(44)).view(np.int64)
        at = np.flatnonzero(self.taken[slot])
        h, k = h[at], self.slot[slot[at]].astype(np.int64)
        several = np.flatnonzero(k == -2)
        k[several] = np.minimum(np.searchsorted(self.hash, h[several]), len(self.hash) - 1)
        hit = np.flatnonzero(self.hash[k] == h)
        return at[hit], self.id[k[hit]]


@lru_cache(maxsize=2)
def _pieces(path: str, sharpness: float) -> Pieces:
    return Pieces(path, sharpness)


def _narrow(n: int) -> type:
    """What holds numbers of so many things: half the memory for all but enormous texts."""
    return np.int32 if n < 1 << 31 else np.int64


class Lattice:
    """The lattices of some distinct chunks.

    Nodes are the places after each character, numbered by (place, chunk); edges are sorted by end
    node.  ``last`` is each chunk's final node; -1 stands for every chunk's beginning.
    """

    def __init__(self, pieces: Pieces, data: bytes, count: np.ndarray):
        """data: the chunks in turn; count: characters of each."""
        cp = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        cp[cp == 32] = _MARK
        near = _narrow(len(cp))
        begin = np.cumsum(count) - count
        place = np.arange(len(cp), dtype=near) - np.repeat(begin.astype(near), count)
        order = digit_order(place)
        node = np.empty(len(cp), near)
        node[order] = np.arange(len(cp), dtype=near)
        del order
        self.last = node[begin + count - 1]
        left = np.repeat(count.astype(near), count) - place  # characters from here to the chunk's end
        start_of = np.append(near(-1), node[:-1])
        start_of[begin] = -1
        powers, wide = _power(pieces.longest)[0], cp.astype(U)
        sums = wide  # of the characters from each place on
        ends, starts, ids = [], [], []
        at = np.arange(len(cp), dtype=near)
        for n in range(1, pieces.longest + 1):
            if n > 1:
                more = np.flatnonzero(left[at] >= n)
                at = at[more]
                sums = sums[more] + wide[at + (n - 1)] * powers[n - 1]
            hit, piece = pieces.find(pieces.key(sums, n))
            if n == 1:
                known = np.zeros(len(cp), bool)
                known[at[hit[piece >= 0]]] = True
                # Other characters: one byte is its byte piece; more go by place, below the ids.
                other = np.flatnonzero(~known)
                ends.append(node[other])
                starts.append(start_of[other])
                ids.append(np.where(cp[other] < 128, pieces.bytes[np.minimum(cp[other], 127)], -1 - cp[other]).astype(np.int32))
            at, sums = at[hit], sums[hit]
            if not len(at):
                break
            whole = np.flatnonzero(piece >= 0)
            own = at[whole]
            ends.append(node[own + (n - 1)])
            starts.append(start_of[own])
            ids.append(piece[whole])
        edge = np.concatenate([[0], np.cumsum(np.bincount(place))])
        del wide, sums, at, hit, piece, node, left, place, start_of
        degree = sum(np.bincount(x, minlength=len(cp)) for x in ends) if ends else np.zeros(0, np.int64)
        self.first = np.append(0, np.cumsum(degree)).astype(_narrow(int(degree.sum()) + 1))
        self.end, self.start, self.piece = np.repeat(np.arange(len(cp), dtype=near), degree), np.empty(self.first[-1], near), np.empty(self.first[-1], np.int32)
        del degree
        # Long pieces stand first at a node: they are mostly the likely ones.  No two of a length end there.
        free = self.first[:-1].copy()
        while ends:
            end = ends.pop()
            put = free[end]
            free[end] += 1
            self.start[put], self.piece[put] = starts.pop(), ids.pop()
        del end, put, free
        weight = pieces.weight[np.maximum(self.piece, 0)]
        weight[self.piece < 0] = 4 * pieces.weight[0]
        alpha = np.zeros(len(cp) + 1)  # the last entry is the beginning's
        score = weight  # each is read once, before its score is written
        for lo, hi in zip(edge[:-1], edge[1:]):
            a, b = self.first[lo], self.first[hi]
            v = alpha[self.start[a:b]] + weight[a:b]
            at = self.first[lo:hi] - a
            top = np.maximum.reduceat(v, at)
            own = self.end[a:b] - lo
            alpha[lo:hi] = top + np.log(np.add.reduceat(np.exp(v - top[own]), at))
            score[a:b] = v - alpha[lo:hi][own]
        self.logp = np.minimum(score, 0.0, out=score)
        p = np.exp(self.logp)
        total = np.cumsum(p)
        base = total[self.first[:-1]] - p[self.first[:-1]]
        del p
        total -= base[self.end]
        self.cut = total  # probability of an edge and those before it at its node
        self.cut[self.first[1:] - 1] = 1.0

    def edges(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        e = self.first[node]
        at = np.flatnonzero(self.cut[e] <= u)
        while len(at):
            e[at] += 1
            at = at[self.cut[e[at]] <= u[at]]
        return e

    def draw(self, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample from each node back to its chunk's beginning: (edges of all paths in turn, steps of each)."""
        at, taken, steps = np.flatnonzero(node >= 0), [], np.zeros(len(node), np.int64)
        state, seed = node[at], seed[at]
        while len(at):
            e = self.edges(state, _uniform(seed))
            taken.append((at, e))
            state = self.start[e]
            go = np.flatnonzero(state >= 0)
            steps[at] = len(taken)  # those that go on are counted again
            at, state, seed = at[go], state[go], seed[go] + _GOLD
        out = np.empty(int(steps.sum()), self.first.dtype)
        base = np.cumsum(steps) - steps
        for t, (at, e) in enumerate(taken):
            out[base[at] + t] = e
        return out, steps


#: -log of the largest uniform below 1 is over e**-37, so an entry is at most REACH above its log mass.
REACH, FLOOR = 37.0, -50.0


class _Path:
    """One sample of a text: its edges in search order, and the agenda entries it left.

    Log mass falls along a path, so that the entries over FLOOR are its first ones: only those are
    worked out and held (``rest``, and ``prefix``, the log mass before each), until the agenda's best is
    so low that one of the others could come before it.
    """

    def __init__(self, r, edge, score, rest, prefix, barred):
        self.r, self.edge, self.score, self.rest, self.prefix, self.barred = r, edge, score, rest, prefix, barred


def _rest(log_mass: np.ndarray, bound, u: np.ndarray) -> np.ndarray:
    """Gumbels of the given log masses, truncated at ``bound``."""
    with np.errstate(divide="ignore"):
        return log_mass - np.log(np.exp(log_mass - bound) - np.log(u))


def _log1mexp(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(x)) of x <= 0."""
    with np.errstate(divide="ignore"):
        out = np.log1p(-np.exp(x))
        near = np.flatnonzero(x > -0.6931)
        out[near] = np.log(-np.expm1(x[near]))
        return out


def _chunks(pieces: Pieces, buf: np.ndarray, offsets: np.ndarray):
    """Every text gets a space before it; (bytes, chunk starts, chunk ends, text of each chunk)."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    some = np.flatnonzero(length)
    size = int(length.sum()) + len(some)
    out = np.full(size, 32, np.uint8)
    begin = np.cumsum(length[some] + 1) - (length[some] + 1)
    keep = np.ones(size, bool)
    keep[begin] = False
    out[keep] = buf
    alone = pieces.isolated[out]
    cut = np.zeros(size, bool)
    cut[1:] = (alone[1:] | alone[:-1]) | ((out[1:] == 32) & (out[:-1] != 32))
    cut[begin] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], size)
    text = some[np.searchsorted(begin, start, "right") - 1] if len(start) else start
    return out, start, end, text, n


@dataclass
class Samples:
    """The samples of a block's texts, best first: text number, number among the text's, ids in turn and their ends, scores."""

    text: np.ndarray
    number: np.ndarray
    ids: np.ndarray
    ends: np.ndarray
    log_prob: np.ndarray
    perturbed: np.ndarray
    log_inclusion: np.ndarray


def sample_texts(pieces: Pieces, buf: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int) -> Samples:
    data, start, end, text, n = _chunks(pieces, buf, offsets)
    if not len(start):
        zero = np.zeros(n)
        return Samples(np.arange(n), np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64), zero, zero, zero)
    with np.errstate(over="ignore"):
        h = mix(_sums(stream(23, 256)[data], start, end - 1) + (end - start).astype(U))
    _, pick, kind = np.unique(h, return_index=True, return_inverse=True)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    own = ragged(start[pick], (end - start)[pick])
    lattice = Lattice(pieces, data[own].tobytes(), (lead[end] - lead[start])[pick])
    first = np.searchsorted(text, np.arange(n + 1))
    number = np.arange(len(start)) - first[text]
    final = lattice.last[kind]

    def entries(r: int, edge: np.ndarray, step: np.ndarray, doc: np.ndarray, before: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The agenda entry each choice leaves for its other edges."""
        node = lattice.end[edge]
        at = np.flatnonzero(lattice.first[node + 1] - lattice.first[node] > 1)
        out = np.full(len(edge), -np.inf)
        u = _uniform(mix(keys[doc[at]] + U(2 * r + 1) * _ODD) + step[at].astype(U) * _GOLD)
        out[at] = _rest(before[at] + _log1mexp(lattice.logp[edge[at]]), bound[at], u)
        return out

    def heads(r: int, edge: np.ndarray, at: np.ndarray, doc: np.ndarray, base: np.ndarray, step: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each run of drawn edges the part over FLOOR: (where its entries end, all entries in turn, the log mass before each)."""
        total = np.concatenate([[0.0], np.cumsum(lattice.logp[edge])])
        begin = total[at[:-1]]
        count = np.clip(np.searchsorted(-total, base - begin - FLOOR), at[:-1], at[1:]) - at[:-1]
        own, run = ragged(at[:-1], count), np.repeat(np.arange(len(count)), count)
        before = base[run] + (total[own] - begin[run])
        return np.cumsum(count), entries(r, edge[own], own - at[run] + step[run], doc[run], before, bound[run]), before

    # A closure that named itself would keep the whole block alive until the next collection of cycles.
    def best_entry(d: int) -> tuple[float, _Path | None, int]:
        while True:
            best, path, where = -np.inf, None, 0
            for p in paths[d]:
                if len(p.rest) and p.rest[s := int(p.rest.argmax())] > best:
                    best, path, where = p.rest[s], p, s
            late = [p for p in paths[d] if len(p.rest) < len(p.edge)] if best < FLOOR + REACH else []
            if not late:
                return best, path, where
            for p in late:
                begin, n = len(p.rest), len(p.edge) - len(p.rest)
                before = np.concatenate([[0.0], np.cumsum(lattice.logp[p.edge[:-1]])])[begin:]
                p.rest = np.concatenate([p.rest, entries(p.r, p.edge[begin:], np.arange(begin, len(p.edge)), np.full(n, d), before, np.full(n, p.score))])
                p.prefix = np.concatenate([p.prefix, before])

    seeds = lambda r, doc, occ: mix(keys[doc] + U(2 * r) * _ODD) + (occ.astype(U) << U(24)) * _GOLD
    edge, steps = lattice.draw(final, seeds(0, text, number))
    at = np.concatenate([[0], np.cumsum(steps)])[first]
    root = -np.log(-np.log(_uniform(mix(keys + U(77)))))
    upto, rest, prefix = heads(0, edge, at, np.arange(n), np.zeros(n), np.zeros(n, np.int64), root)
    paths: list[list[_Path]] = [[_Path(0, edge[a:b], score, rest[c:d], prefix[c:d], {})] for a, b, c, d, score in zip(at.tolist(), at[1:].tolist(), [0, *upto.tolist()], upto.tolist(), root)]
    kappa = np.full(n, -np.inf)
    for r in range(1, k + 1):
        jobs = []
        pick, keep_ = _uniform(keys + U(101 + r)).tolist(), _uniform(keys + U(9001 + r)).tolist()
        for d in range(n):
            best, p, s = best_entry(d) if len(paths[d]) == r else (-np.inf, None, 0)
            if p is None:
                continue
            if r == k:
                kappa[d] = best
                continue
            p.rest[s] = -np.inf
            node = lattice.end[p.edge[s]]
            barred = p.barred.get(s, [p.edge[s]])
            open_ = [e for e in range(lattice.first[node], lattice.first[node + 1]) if e not in barred]
            weight = [math.exp(x) for x in lattice.logp[open_].tolist()]
            total = sum(weight)
            new = open_[min(bisect.bisect_right(list(itertools.accumulate(weight)), pick[d] * total), len(open_) - 1)]
            left = sum(w for w, e in zip(weight, open_) if e != new)
            jobs.append((d, p, s, new, left, [*barred, new], best))
        if not jobs:
            continue
        # The other chunks of all texts that branch are drawn anew, together.
        ds = np.array([j[0] for j in jobs])
        at_occ = np.array([np.count_nonzero(lattice.start[j[1].edge[: j[2]]] < 0) for j in jobs])  # chunks that end before
        count = first[ds + 1] - first[ds] - at_occ  # the branching chunk's rest, and those behind it
        where = ragged(first[ds] + at_occ, count)
        head = np.cumsum(count) - count
        nodes = final[where]
        nodes[head] = lattice.start[[j[3] for j in jobs]]
        edge, steps = lattice.draw(nodes, seeds(r, text[where], number[where]))
        at = np.concatenate([[0], np.cumsum(steps)])[np.append(head, len(where))]
        base = np.array([j[1].prefix[j[2]] + lattice.logp[j[3]] for j in jobs])
        upto, rest, prefix = heads(r, edge, at, ds, base, np.array([j[2] + 1 for j in jobs]), np.array([j[6] for j in jobs]))
        for i, (d, p, s, new, left, barred, best) in enumerate(jobs):
            own = slice(upto[i - 1] if i else 0, upto[i])
            mass = p.prefix[s] + math.log(left) if left > 0 else -math.inf
            kept = np.array([mass - math.log(math.exp(mass - best) - math.log(keep_[d])) if left > 0 else -math.inf])
            whole = np.concatenate([p.edge[:s], np.array([new], edge.dtype), edge[at[i] : at[i + 1]]])
            paths[d].append(_Path(r, whole, best, np.concatenate([np.full(s, -np.inf), kept, rest[own]]), np.concatenate([p.prefix[: s + 1], prefix[own]]), {s: barred}))
    # Texts without a chunk have one empty sample; all others' paths are turned round together.
    every = [(d, r, p) for d in range(n) for r, p in enumerate(paths[d])]
    steps = np.array([len(p.edge) for _, _, p in every])
    edge = np.concatenate([p.edge for _, _, p in every])
    # Chunks stand in order, each searched from its end: turn each one round.
    cut = np.append(0, np.flatnonzero(lattice.start[edge] < 0) + 1)
    turn = np.repeat(cut[:-1] + cut[1:] - 1, np.diff(cut)) - np.arange(len(edge))
    ids, ends = lattice.piece[edge[turn]], np.cumsum(steps)
    if len(other := np.flatnonzero(ids < 0)):
        kinds, kind = np.unique(ids[other], return_inverse=True)
        spelled = [pieces.bytes[list(chr(-1 - i).encode())] for i in kinds.tolist()]
        length = np.array([len(x) for x in spelled])
        wide = np.ones(len(ids), np.int64)
        wide[other] = length[kind]
        put = np.cumsum(wide) - wide
        ids, ends = np.repeat(ids, wide), np.append(put, len(ids) + (wide - 1).sum())[ends]
        ids[ragged(put[other], wide[other])] = np.concatenate(spelled)[ragged((np.cumsum(length) - length)[kind], length[kind])]
    some = np.flatnonzero(steps)
    log_p = np.zeros(len(every))
    log_p[some] = np.add.reduceat(lattice.logp[edge], (np.cumsum(steps) - steps)[some])
    text = np.array([d for d, _, _ in every])
    with np.errstate(divide="ignore", over="ignore"):
        above = log_p - kappa[text]
        inside = np.where(np.isposinf(above), 0.0, np.where(above > -30, np.log(-np.expm1(-np.exp(np.minimum(above, 700.0)))), above))
    return Samples(text, np.array([r for _, r, _ in every]), ids, ends, log_p, np.array([p.score for _, _, p in every]), inside)


def _sampler(path: str, k: int, sharpness: float, with_ids: bool, decoded: bool = False):
    # Decoding is part of the same pass: a pass of its own would hold a second worker with its own vocabulary.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path, sharpness)
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column(0)
                keys = mix(ids.fill_null(0).to_numpy().astype(np.int64).view(U) + U(4))
                for lo, hi, buf, offsets in blocks(batch.column(1), BLOCK):
                    x = sample_texts(pieces, buf, offsets, keys[lo:hi], k)
                    flat, begin = x.ids.astype("<u4"), [0, *x.ends[:-1].tolist()]
                    data = [flat[a:b].tobytes() for a, b in zip(begin, x.ends.tolist())]
                    made = [pa.array(x.number, pa.int32()), pa.array(np.diff(x.ends, prepend=0)), pa.array(x.log_prob), pa.array(x.perturbed), pa.array(x.log_inclusion), pa.array([zlib.crc32(d) for d in data], pa.int64())]
                    if with_ids:
                        made.append(pa.array(data, pa.binary()))
                    if decoded:
                        texts = pieces.decoded(x.ids, x.ends)
                        made += [pc.utf8_length(pa.array(texts, pa.binary()).cast(pa.string())).cast(pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                    yield pa.record_batch([ids.take(pa.array(lo + x.text)), *made], ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_crc32", "ids", "decoded_chars", "decoded_sha256"][: len(made) + 1])

    return run


def sample_encodings(docs: DataFrame, model: str | None = None, k: int = K, sharpness: float = SHARPNESS, with_ids: bool = False) -> DataFrame:
    """Up to k rows a document: doc_id, sample, n_pieces, log_prob, perturbed, log_inclusion, ids_crc32 and, if asked for, ids."""
    schema = SCHEMA + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_sampler(model or model_path(), k, sharpness, with_ids), schema)


def round_trip(docs: DataFrame, model: str | None = None, k: int = K_QUERY, sharpness: float = SHARPNESS) -> DataFrame:
    """The encodings with their ids, and decoded_chars and decoded_sha256 of the text that each gives back."""
    return docs.select("doc_id", "text").mapInArrow(_sampler(model or model_path(), k, sharpness, True, True), f"{SCHEMA}, ids binary, decoded_chars long, decoded_sha256 string")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """The rows with ``text`` in place of ``ids`` (little-endian 32-bit ids, or null)."""
    path = model or model_path()
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in batch.column(at).to_pylist()]
            texts = _pieces(path, SHARPNESS).decoded(np.concatenate([np.zeros(0, np.int64), *own]), np.cumsum([len(x) for x in own]))
            made = pc.if_else(batch.column(at).is_null(), None, pa.array(texts, pa.binary()).cast(pa.string()))
            yield batch.set_column(at, "text", made)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" if f.name != "ids" else "text string" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, fields)
