"""Document scores from a masked language model over words.

Method.  Masked pseudo-likelihood: a small network reads the ``WINDOW`` words on both sides of a
position and predicts the word there; a document's score is the sum over all its positions of the log
probability of the word given its neighbours.  Each neighbour's place has its own embedding table,
the sum goes through tanh, and a softmax in three steps (the word's number, digit by digit) gives the
probabilities.  Everything is trained here, in numpy.

The vocabulary is the most frequent words of all documents; how many follows the root of the number of
distinct words.  The network tells of any other word only its first byte; the rest is spelled: byte by
byte, each given the three before, up to the word's end, by the counts of all such words in the corpus.  So
every word has a probability of its own, and those of all byte strings together are one (what spelling
gives to words of the vocabulary is not taken back).  As neighbours, rare words share hashed embeddings.
Training starts with the ``WARM_ROWS`` documents of least hash on the driver and then goes over all
documents: every task trains a copy of the network on every position of its texts, each masked once (a
block's positions come in ``MASK`` interleaved turns, so that a batch mixes many texts), and the copies are
averaged with the number of positions as weights.  The same pass counts the spellings.

Scale.  Word counts are summed per task, then by shuffle.  A copy is trained on as much text as keeps all
copies together below ``COPY_SHARE`` of the input, however large the network is.  Copies are averaged in
rounds that each join ``FAN_IN`` partial sums of one slice of the network, so no task holds more than that;
what reaches the driver is the network and the vocabulary, which grow as the root of the distinct words.
Scoring is one narrow pass over the whole texts.

Defined results.  Null and wordless texts score 0 with no tokens and a null mean.  Null ids and
repeated rows are scored each.  An empty table gives an empty table.  Columns other than ``doc_id``
and ``text`` are not read.  Sums of floats depend on how the input is split in their last digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .stores import keep
from .text import U, Words, digit_order, ragged, word_blocks

WINDOW, HIDDEN, CUT = 2, 32, 60.0
LEAST_IDS, ROOT, HASHED_SHARE = 4608, 8, 9  # ids at least; ids per root of the distinct words; one hashed embedding for so many
BYTES, END, CONTEXTS = 256, 256, 8192  # contexts of three bytes share so many rows
SMOOTH, COPY_SHARE = 0.01, 0.5
MASK, BATCH, RATE = 8, 16384, 0.3
WARM_ROWS, WARM_EPOCHS, SEED = 512, 3, 11
FAN_IN, SLICES = 8, 16
FLUSH = 1 << 20


@dataclass
class Vocabulary:
    """Word hashes of the known words, sorted, and their ids; ids go by falling frequency."""

    hash: np.ndarray
    id: np.ndarray
    size: int
    hashed: int

    @cached_property
    def slots(self) -> tuple[int, np.ndarray]:
        """(bits to drop, where the hashes with the bits left begin): some eight slots for each word, 2**20 at most."""
        bits = min(20, 3 + max(1, len(self.hash)).bit_length())
        return 64 - bits, np.searchsorted(self.hash >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U)).astype(np.int32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "slots"}  # each worker finds them itself

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Ids from 1; 0 is the edge of a text."""
        out = (self.size + 1 + ((h >> U(20)) % U(self.hashed)).view(np.int64)).astype(np.int32)
        drop, first = self.slots
        slot = (h >> U(drop)).view(np.int64)
        at, end = first[slot], first[slot + 1]
        own = np.flatnonzero(at < end)
        at, end = at[own], end[own]
        while len(own):  # the words of a slot in turn
            hit = self.hash[at] == h[own]
            out[own[hit]] = self.id[at[hit]] + 1
            at += 1
            more = np.flatnonzero(~hit & (at < end))
            own, at, end = own[more], at[more], end[more]
        return out

    def targets(self, ids: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(what the network predicts: the word, or the first byte of another one; where those others are)."""
        others, y = np.flatnonzero(ids > self.size), ids.copy()
        y[others] = self.size + 1 + _FOLD[w.buf[w.start[others]]]
        return y, others


_FOLD = np.arange(BYTES)
_FOLD[65:91] += 32


def transitions(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the last three bytes, byte or end behind them, as one number, for all bytes of the words ``at``; where each word begins)."""
    length = w.end[at] - w.start[at]
    first = np.cumsum(length) - length
    byte = _FOLD[w.buf[ragged(w.start[at], length)]]
    before, context = byte + 1, byte + 1
    for k in (1, 2):  # bytes before the word count as 0
        before = np.append(0, before[:-1])
        before[first] = 0
        context = context + before * (BYTES + 1) ** k
    row = ((context * 2654435761) & 0xFFFFFFFF) * CONTEXTS >> 32
    behind = np.append(byte[1:], END)
    behind[first[1:] - 1] = END
    return row * (BYTES + 1) + behind, first


def spelling(counts: np.ndarray) -> np.ndarray:
    """log P(byte or end | context) of every transition."""
    c = counts.reshape(CONTEXTS, BYTES + 1) + SMOOTH
    return np.log(c / c.sum(1, keepdims=True)).reshape(-1)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, counts, n = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h, inverse = np.unique(np.concatenate(held), return_inverse=True)
        return h, np.bincount(inverse, np.concatenate(counts), len(h)).astype(np.int64)

    for batch in batches:
        for _, _, w in word_blocks(batch.column(0), lower=True):
            h, c = np.unique(w.hash, return_counts=True)
            held.append(h)
            counts.append(c)
            n += len(h)
            if n >= FLUSH:
                h, c = merged()
                if len(h) >= FLUSH // 2:
                    yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(c)], ["word", "n"])
                    h, c = h[:0], c[:0]
                held, counts, n = [h], [c], len(h)
    if n:
        h, c = merged()
        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(c)], ["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n of all words."""
    return keep(docs.select("text").mapInArrow(_counter, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def vocabulary(counts: DataFrame, size: int, hashed: int) -> Vocabulary:
    """The ``size`` most frequent words."""
    top = counts.orderBy(F.desc("n"), "word").limit(size).toPandas()
    h = top["word"].to_numpy(np.int64).view(U)
    order = np.argsort(h)
    return Vocabulary(h[order], order.astype(np.int64), size, hashed)


class Network:
    """Places x ids embeddings, then the weights of a softmax in ``len(shape)`` steps; all arrays are float32.

    An id less one, written in the mixed base ``shape``, is the way to it: each step's weights belong to
    the digits before.  The last column of the weights meets a constant 1.  Scores are cut at +-``CUT``.
    """

    def __init__(self, ids: int, shape: tuple[int, ...], window: int = WINDOW, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.shape, self.window, self.width = tuple(shape), window, hidden
        self.places = [*range(-window, 0), *range(1, window + 1)]
        self.p = {"embed": f(2 * window, ids, hidden), "bias": np.zeros(hidden, np.float32)}
        for k, b in enumerate(self.shape):
            self.p[k] = f(int(np.prod(self.shape[:k], dtype=np.int64)), b, hidden + 1)
            self.p[k][:, :, -1] = 0
        self.sums = {k: np.full_like(v, 0.1) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def contexts(self, ids: np.ndarray, text: np.ndarray) -> np.ndarray:
        """One row of neighbour ids for every position; 0 beyond the text."""
        out = np.zeros((len(ids), len(self.places)), np.int32)
        for k, d in enumerate(self.places):
            here, there = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
            out[here, k] = np.where(text[here] == text[there], ids[there], 0)
        return out

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """One row a position, with the constant in the last column."""
        h = np.ones((len(context), self.width + 1), np.float32)
        total = np.take(self.p["embed"][0], context[:, 0], 0)
        for k in range(1, len(self.places)):
            total += np.take(self.p["embed"][k], context[:, k], 0)
        total += self.p["bias"]
        np.tanh(total, out=h[:, :-1])
        return h

    def _steps(self, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
        """For each step of sorted targets: (own digit, groups met, (group, first row, end row) of each)."""
        for k, b in enumerate(self.shape):
            node = y // int(np.prod(self.shape[k + 1 :], dtype=np.int64))
            group = node // b
            first = np.flatnonzero(np.diff(group, prepend=-1))
            own = group[first]
            yield node - group * b, own, list(zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(y)]))

    def _exp_scores(self, k: int, h: np.ndarray, parts: list[tuple[int, int, int]]) -> np.ndarray:
        x, w = np.empty((len(h), self.shape[k]), np.float32), self.p[k]
        for g, lo, hi in parts:
            np.matmul(h[lo:hi], w[g].T, out=x[lo:hi])
        np.clip(x, -CUT, CUT, out=x)
        return x

    def log_probs(self, context: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log P(y | context) of each position."""
        order = digit_order(y - 1)
        y = y[order] - 1
        h, rows, total = self.hidden(np.take(context, order, 0)), np.arange(len(y)), np.zeros(len(y))
        for k, (digit, _, parts) in enumerate(self._steps(y)):
            x = self._exp_scores(k, h, parts)
            own = x[rows, digit].astype(np.float64)
            total += own - np.log(np.einsum("nb->n", np.exp(x, out=x)))
        out = np.empty(len(y))
        out[order] = total
        return out

    def step(self, context: np.ndarray, y: np.ndarray, rate: float) -> None:
        """One adaptive gradient step on the mean negative log probability."""
        n, order = len(y), digit_order(y - 1)
        y, context = y[order] - 1, np.take(context, order, 0)
        h, rows = self.hidden(context), np.arange(n)
        back = np.zeros_like(h)
        for k, (digit, own, parts) in enumerate(self._steps(y)):
            g = self._exp_scores(k, h, parts)
            np.exp(g, out=g)
            g /= np.einsum("nb->n", g)[:, None]
            g[rows, digit] -= 1
            grad = np.empty((len(own), *self.p[k].shape[1:]), np.float32)
            for i, (group, lo, hi) in enumerate(parts):
                np.matmul(g[lo:hi].T, h[lo:hi], out=grad[i])
                back[lo:hi] += g[lo:hi] @ self.p[k][group]
            grad /= n
            self._adapt(k, grad, rate, own)
        h, back = h[:, :-1], back[:, :-1]
        slope = 1 - h * h
        slope /= np.float32(n)
        back = back * slope
        self._adapt("bias", back.sum(0), rate)
        for k in range(len(self.places)):
            order = digit_order(context[:, k])
            ids = context[order, k]
            first = np.flatnonzero(np.diff(ids, prepend=-1))
            self._adapt("embed", _run_sums(np.take(back, order, 0), first), rate, ids[first], k)

    def _adapt(self, name, grad: np.ndarray, rate: float, at=..., place=...) -> None:
        """Changes ``grad`` as well."""
        p, sums = self.p[name][place], self.sums[name][place]
        grad *= np.float32(64)  # per 1/64 of a batch, so that the sums start small beside it
        total = grad * grad
        total += sums[at] if at is ... else np.take(sums, at, 0)
        sums[at] = total
        np.sqrt(total, out=total)
        grad *= np.float32(rate)
        grad /= total
        p[at] -= grad


def _run_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of runs of float32 rows, run k from row ``first[k]``; two columns at a time, as one complex number."""
    return np.add.reduceat(x.view(np.complex64) if x.shape[1] % 2 == 0 else x, first).view(np.float32)


def _positions(texts: pa.Array, vocab: Vocabulary, net: Network, mask: int, spelled: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(contexts, targets) of all positions, those of a block in ``mask`` turns; counts transitions in ``spelled``."""
    for _, _, w in word_blocks(texts, lower=True):
        ids = vocab.ids(w.hash)
        context, (y, others) = net.contexts(ids, w.text), vocab.targets(ids, w)
        if spelled is not None and len(others):
            spelled += np.bincount(transitions(w, others)[0], minlength=len(spelled))
        for turn in range(min(mask, len(ids))):
            yield context[turn::mask], y[turn::mask]


def _learn(net: Network, parts: Iterator[tuple[np.ndarray, np.ndarray]], batch: int, rate: float) -> int:
    """Train on positions in batches; how many there were."""
    held, n, total = [], 0, 0
    for part in parts:
        held.append(part)
        n += len(part[1])
        if n >= batch:
            context, y = np.concatenate([c for c, _ in held]), np.concatenate([y for _, y in held])
            for lo in range(0, n - batch + 1, batch):
                net.step(context[lo : lo + batch], y[lo : lo + batch], rate)
            rest = n - n % batch
            held, n, total = [(context[rest:], y[rest:])], n % batch, total + rest
    if n:
        net.step(np.concatenate([c for c, _ in held]), np.concatenate([y for _, y in held]), rate)
    return total + n


def warm_texts(docs: DataFrame, rows: int) -> pa.ChunkedArray:
    """The texts of least hash over all documents; only hashes are sorted to find them."""
    order = F.xxhash64("doc_id", "text")
    some = docs.filter("text is not null")
    last = some.select(order.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return some.filter(order <= F.lit(last)).orderBy(order).limit(rows).select("text").toArrow()["text"]


def copies(docs: DataFrame, net: Network) -> int:
    """How many copies together take ``COPY_SHARE`` of the input's bytes, as the planner knows them."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, int(min(COPY_SHARE * size / (4 * sum(v.size for v in net.p.values())), 1 << 30)))


def train(docs: DataFrame, vocab: Vocabulary, shape: tuple[int, ...], mask: int = MASK, rate: float = RATE, warm_rows: int = WARM_ROWS, seed: int = SEED) -> tuple[Network, np.ndarray]:
    """The network and the spelling of words outside the vocabulary."""
    spark = docs.sparkSession
    net = Network(vocab.size + vocab.hashed + 1, shape, seed=seed)
    warm = warm_texts(docs, warm_rows)
    for _ in range(WARM_EPOCHS):
        _learn(net, _positions(warm, vocab, net, 1), BATCH // 8, rate)
    shared = spark.sparkContext.broadcast((vocab, net))
    # One more slice holds the transitions, whose counts must stay whole.
    kind = lambda k: np.float64 if k == SLICES else np.float32

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = shared.value
        copy, spelled = Network(own.size + own.hashed + 1, shape, seed=seed), np.zeros(CONTEXTS * (BYTES + 1))
        copy.load(start.flat())
        copy.sums = {k: v.copy() for k, v in start.sums.items()}
        n = _learn(copy, (x for batch in batches for x in _positions(batch.column(0), own, copy, mask, spelled)), BATCH, rate / 2)
        if n:
            parts = [*np.array_split(copy.flat() * np.float64(n), SLICES), spelled]
            yield pa.record_batch([pa.array(range(SLICES + 1), pa.int32()), pa.array([n] * (SLICES + 1), pa.int64()), pa.array([x.astype(kind(k)).tobytes() for k, x in enumerate(parts)])], ["slice", "n", "sums"])

    def summed(rows) -> dict[int, list]:
        total: dict[int, list] = {}
        for k, n, data in rows:
            x = np.frombuffer(data, kind(k)).astype(np.float64)
            total[k] = [total[k][0] + n, total[k][1] + x] if k in total else [n, x]
        return total

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, n, data.as_buffer()) for batch in batches for k, n, data in zip(batch["slice"].to_pylist(), batch["n"].to_pylist(), batch["sums"]))
        for k, (n, x) in summed(rows).items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([x.astype(kind(k)).tobytes()])], ["slice", "n", "sums"])

    schema = "slice int, n long, sums binary"
    sums = docs.select("text").coalesce(copies(docs, net)).mapInArrow(learn, schema)
    tasks = max(1, sums.rdd.getNumPartitions())
    while tasks > 1:  # partial sums of a slice meet FAN_IN at a time
        tasks = -(-tasks // FAN_IN)
        grouped = sums.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(tasks)))
        sums = grouped.repartition(tasks * (SLICES + 1), "slice", "part").drop("part").mapInArrow(add, schema)
    total = summed((r.slice, r.n, r.sums) for r in sums.collect())  # one of each slice
    if total:
        net.load(np.concatenate([x / n for n, x in (total[k] for k in range(SLICES))]))
    return net, spelling(total[SLICES][1] if total else np.zeros(CONTEXTS * (BYTES + 1)))


def score(docs: DataFrame, vocab: Vocabulary, net: Network, spelled: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob."""
    net.sums = {}
    shared = docs.sparkSession.sparkContext.broadcast((vocab, net, spelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, net, spelled = shared.value
        for batch in batches:
            for lo, hi, w in word_blocks(batch.column(1), lower=True):
                ids = vocab.ids(w.hash)
                context, logs, (y, others) = net.contexts(ids, w.text), np.zeros(len(ids)), vocab.targets(ids, w)
                for a in range(0, len(ids), 1 << 16):
                    logs[a : a + (1 << 16)] = net.log_probs(context[a : a + (1 << 16)], y[a : a + (1 << 16)])
                if len(others):
                    code, first = transitions(w, others)
                    logs[others] += np.add.reduceat(spelled[code], first)
                n, total = np.bincount(w.text, minlength=hi - lo).astype(np.int64), np.bincount(w.text, logs, hi - lo).astype(np.float64)
                mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(total), mean], ["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")


def sizes(distinct: int) -> tuple[tuple[int, int, int], int]:
    """(digits of the targets' numbers, hashed embeddings) for so many distinct words; the last digit is the widest, its groups the most."""
    ids = max(LEAST_IDS, int(np.ceil(ROOT * distinct**0.5)))
    wide = int(np.ceil((ids / 4) ** (1 / 3)))
    shape = (wide, wide, -(-ids // wide**2))
    return shape, int(np.prod(shape)) // HASHED_SHARE


def score_documents(docs: DataFrame, shape: tuple[int, ...] | None = None, hashed: int | None = None, **training) -> DataFrame:
    """Vocabulary, training and scores, all from ``docs``; sizes not given follow the corpus."""
    counts = word_counts(docs)
    own = sizes(counts.count())
    shape, hashed = shape or own[0], own[1] if hashed is None else hashed
    vocab = vocabulary(counts, int(np.prod(shape)) - BYTES, hashed)
    return score(docs, vocab, *train(docs, vocab, shape, **training))
