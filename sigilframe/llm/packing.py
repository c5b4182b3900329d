"""Best-fit packing of tokenized documents into sequences of bounded length.

Method.  Minimum bin slack: each bin starts from the longest length left, and a subset-sum over the
other available lengths, held as the bits of one integer, finds the combination that fills the bin
most; it is then removed.  Only how many pieces have each length matters, so the plan is made on a
histogram of at most ``capacity`` counts, and a combination is taken as often as its scarcest length
allows: every step uses up a length, so there are at most ``capacity`` steps whatever the input's size.

Scale.  Texts are tokenized in one narrow pass; no token crosses a shuffle unless asked for.  A piece
learns its number among those of its length from a sort by length and a hash of the piece, in ranges: its
number inside its range, and how many of its length stand in the ranges before.  So a length that a third
of all pieces share fills many tasks, and what reaches the driver and goes out by broadcast is one count
for each range and each length, beside the plan (slots of all combinations), which ``capacity`` bounds.

Defined results.  Null text is empty: one piece that holds the separator only.  Documents longer than
``capacity`` are cut every ``capacity`` ids.  Repeated rows are packed each.  An empty table gives an
empty table.  Null ids stay null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .stores import keep, scope
from .text import U, Words, ragged, word_blocks

CAPACITY, SEPARATOR = 4096, 1
TOKENIZER = "word_bpe_49k.json"
BLOCK = 2 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _WordIds:
    """The ids of words met so far by word hash, as flat arrays; started anew beyond ``limit`` words."""

    def __init__(self, path: str, limit: int = 1 << 19):
        self.tokenizer, self.limit = _tokenizer(path), limit
        number, token = next(iter(self.tokenizer.get_added_tokens_decoder().items()))
        self.part, self.end = token.content, np.array([number], np.uint32)
        self.clear()

    def clear(self) -> None:
        self.hash, self.begin, self.length, self.flat = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hash, hashes)
        at[at == len(self.hash)] = 0
        return at, self.hash[at] == hashes if len(self.hash) else np.zeros(len(hashes), bool)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in turn, how many each has); a special token parts the words of one call."""
        parts = []
        for k in range(0, len(words), 100):
            own = words[k : k + 100]
            if any("<|" in x for x in own):  # a word may hold the parting token itself
                for x in own:
                    parts += [np.array(self.tokenizer.encode(x.replace(self.part, ""), add_special_tokens=False).ids, np.uint32), self.end]
            else:
                parts += [np.array(self.tokenizer.encode(self.part.join(own), add_special_tokens=False).ids, np.uint32), self.end]
        ids = np.concatenate(parts)
        cut = np.flatnonzero(ids == self.end[0])
        return ids[ids != self.end[0]], np.diff(cut, prepend=-1) - 1

    def ids(self, w: Words, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, how many each has)."""
        if not len(w.hash):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        distinct, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        at, known = self.find(distinct)
        if not known.all():
            if len(self.hash) + int((~known).sum()) > self.limit:
                self.clear()
                known[:] = False
            new = first[~known]
            words = [data[s:e].decode() for s, e in zip(w.start[new].tolist(), w.end[new].tolist())]
            flat, length = self._encode(words)
            hashes = np.concatenate([self.hash, distinct[~known]])
            order = np.argsort(hashes, kind="stable")
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(length) - length])[order]
            self.length = np.concatenate([self.length, length])[order]
            self.hash, self.flat = hashes[order], np.concatenate([self.flat, flat])
            at, _ = self.find(distinct)
        length = self.length[at][inverse]
        return self.flat[ragged(self.begin[at][inverse], length)], length


@lru_cache(maxsize=2)
def _word_ids(path: str) -> _WordIds:
    return _WordIds(path)


def token_ids(texts: pa.Array, path: str, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids of the texts in turn, offsets), without separators.

    The tokenizer lower-cases, drops white space and joins neither across it nor from letters or digits
    to points, so each distinct word is encoded once while a worker remembers it.  Texts that hold one
    of its special tokens are encoded whole.
    """
    t = _tokenizer(path)
    special = [x.content.encode() for x in t.get_added_tokens_decoder().values()]
    for lo, hi, w in word_blocks(texts, size, lower=True, tails=True):
        data = w.buf.tobytes()
        ids, lengths = _word_ids(path).ids(w, data)
        ends = np.concatenate([[0], np.cumsum(lengths)])[w.first()]
        if any(x in data for x in special):
            parts = []
            for k in range(hi - lo):
                raw = data[w.offsets[k] : w.offsets[k + 1]]
                own = ids[ends[k] : ends[k + 1]]
                parts.append(np.array(t.encode(raw.decode(), add_special_tokens=False).ids, np.uint32) if any(x in raw for x in special) else own)
            ids, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        yield lo, hi, ids, ends


def _kind(path: str, separator: int) -> str:
    """How ids travel: in 16 bits where all of them fit."""
    return "<u2" if max(_tokenizer(path).get_vocab_size(with_added_tokens=True), separator + 1) <= 1 << 16 else "<u4"


def _cutter(path: str, capacity: int, separator: int, with_ids: bool):
    """Texts -> pieces."""
    kind = _kind(path, separator)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, ends in token_ids(batch.column(1), path):
                row, piece, start, length, crc, own = [], [], [], [], [], []
                for k in range(hi - lo):
                    doc = np.append(ids[ends[k] : ends[k + 1]], np.uint32(separator)).astype("<u4")
                    for n, at in enumerate(range(0, len(doc), capacity)):
                        part = doc[at : at + capacity]
                        row.append(k)
                        piece.append(n)
                        start.append(at)
                        length.append(len(part))
                        data = part.tobytes()
                        crc.append(zlib.crc32(data))
                        if with_ids:
                            own.append(part.astype(kind).tobytes())
                cols = [batch.column(0).slice(lo, hi - lo).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                cols += [pa.array(own, pa.binary())] * with_ids
                yield pa.record_batch(cols, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return cut


def _schema(with_ids: bool) -> str:
    return "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_cutter(path, capacity, separator, with_ids), _schema(with_ids))


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of a combination of available lengths with the greatest sum up to ``room``.

    Bit s of ``sums`` says that some combination adds up to s.  A length with c copies is added in
    lots of 1, 2, 4, ... copies.  The sums before each lot are kept to trace the combination back.
    """
    mask, sums, lots = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left:
            n = min(lot, left)
            lots.append((length, n, sums))
            sums |= (sums << (length * n)) & mask
            left -= n
            lot *= 2
        if sums >> room & 1:
            break
    best, taken = sums.bit_length() - 1, {}
    for length, n, before in reversed(lots):
        if not before >> best & 1:
            best -= length * n
            taken[length] = taken.get(length, 0) + n
    return sorted(taken.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Slots (length, rank, n, sequence, offset): pieces rank .. rank+n-1 of that length go to
    sequences sequence, sequence+1, ... at the same offset."""
    left = {k: v for k, v in histogram.items() if v > 0}
    used = dict.fromkeys(left, 0)
    sequence, rows = 0, []
    while left:
        head = max(left)
        left[head] -= 1
        rest = fullest({k: v for k, v in left.items() if v}, capacity - head) if capacity > head else []
        left[head] += 1
        taken = dict(rest)
        taken[head] = taken.get(head, 0) + 1
        times = min(left[k] // n for k, n in taken.items())
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            for _ in range(n):
                rows.append((length, used[length], times, sequence, offset))
                used[length] += times
                offset += length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "n", "sequence", "offset"], dtype="int64")


def _numberer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by length -> the same with their range and their number among those of their length in it."""
    part, held, n = TaskContext.get().partitionId(), -1, 0
    for batch in batches:
        length = batch["length"].to_numpy()
        first = np.flatnonzero(np.diff(length, prepend=-1))
        within = np.arange(len(length)) - np.repeat(first, np.diff(first, append=len(length)))
        if len(length):
            same = length == held  # these go on from the batch before
            within[same] += n
            held, n = length[-1], int(within[-1]) + 1
        yield batch.append_column("part", pa.array(np.full(len(length), part, np.int32))).append_column("within", pa.array(within))


def _placer(shared, kind: str):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (length, rank, sequence, offset), (parts, before) = shared.value
        for batch in batches:
            own = batch["length"].to_numpy()
            at = batch["within"].to_numpy() + before[np.searchsorted(parts, (own << 32) + batch["part"].to_numpy())]
            slot = np.searchsorted((length << 44) + rank, (own << 44) + at, "right") - 1
            put = [pa.array(sequence[slot] + at - rank[slot]), pa.array(offset[slot])]
            names = batch.schema.names[:-2]
            wide = lambda column: pa.array([np.frombuffer(x.as_buffer(), kind).astype("<u4").tobytes() for x in column], pa.binary())
            yield pa.record_batch([wide(batch[n]) if n == "ids" else batch[n] for n in names] + put, names + ["sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids (little-endian 32-bit)."""
    schema = _schema(with_ids)
    path, spark = tokenizer or tokenizer_path(), docs.sparkSession
    with scope(spark):  # the pieces go once they are numbered
        cut = keep(pieces(docs, path, capacity, separator, with_ids), "pieces")
        order = ["length", F.xxhash64("doc_id", "piece", "ids_crc32")]
        ranged = cut.repartitionByRange(*order).sortWithinPartitions(*order, "doc_id", "piece").select(cut.columns)
        numbered = keep(ranged.mapInArrow(_numberer, schema + ", part int, within long"), "numbered", outside=True)
    # A length is in one range or in neighbouring ones: as many rows as there are ranges and lengths together, at most.
    counts = pd.DataFrame([(r.length, r.part, r["count"]) for r in numbered.groupBy("length", "part").count().collect()], columns=["length", "part", "n"], dtype="int64").sort_values(["length", "part"])
    before = counts.groupby("length")["n"].cumsum() - counts["n"]
    slots = plan({int(k): int(v) for k, v in counts.groupby("length")["n"].sum().items()}, capacity).sort_values(["length", "rank"])
    shared = spark.sparkContext.broadcast((tuple(slots[c].to_numpy() for c in ("length", "rank", "sequence", "offset")), ((counts["length"].to_numpy() << 32) + counts["part"].to_numpy(), before.to_numpy())))
    return numbered.mapInArrow(_placer(shared, _kind(path, separator)), schema + ", sequence_id long, offset long")
