"""Quality rules: fixed rules, and an isolation forest on the rules' statistics.

Method.  One pass over the whole texts counts what the rules speak of.  Documents that pass the fixed
rules get an anomaly score from an isolation forest over the rates of these counts, measured from the
sample's medians in the sample's quartile distances: ``trees`` binary trees of random splits, each grown
on ``psi`` rows, in which unusual documents end on short paths.  A split's rate is drawn with the width of
the node's rows along it as weight, its cut evenly along that width, so a rate in which few rows lie far
out is soon cut.  The score above which a document is rejected is calibrated on all labelled rows: the
threshold with the best balance of low documents rejected and good ones kept among those that reject at
most ``good_loss`` of the good ones.

Scale.  Texts are read once, in one narrow pass; their statistics (some 120 bytes a document) are
written and used from there.  The forest is fitted on a bounded sample (``trees * psi`` rows at most,
the ones with the least hashes of their id, whatever the input's size) and is a table of constant size,
which is all that is broadcast.  Calibration moves two histograms of ``BINS`` counts.

Defined results.  Null and empty texts have no words and fail.  Without labelled rows of both kinds,
or with too few rows to grow a tree on, the forest rejects nothing.  Null ids are judged like others
but are never labelled; where labels repeat an id, the lowest label counts.  Rows that repeat an id
are judged each.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .stores import keep
from .text import _BYTES, U, Words, _sums, mix, word_blocks

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
TREES, PSI, GOOD_LOSS, BINS, SEED = 100, 64, 0.005, 4096, 20
#: The least distance that counts as one between a rate's quartiles; most documents have none of most things.
SPREAD = 0.05
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_punct", "n_marks", "n_distinct")


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_SYMBOL = _table("#*$%&|<>")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _table("0123456789")
_PUNCT = _table(".,;:")
_MARKS = _table("!?")


def _per_text(w: Words, flags: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[w.offsets[1:]] - c[w.offsets[:-1]]


def _again(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (text, hash); in that order: whether a value is new, and whether it occurs again."""
    order = np.lexsort((h, text))
    t, x = text[order], h[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (t[1:] != t[:-1])
    more = ~new
    more[:-1] |= ~new[1:]
    return order, new, more


def statistics(w: Words) -> dict[str, np.ndarray]:
    """The counts of each text of a block."""
    n, buf = w.n_texts, w.buf
    lead = (buf & 0xC0) != 0x80
    words = np.bincount(w.text, minlength=n)
    out = {"n_words": words}
    solid = np.zeros(len(buf) + 1, np.int8)
    np.add.at(solid, w.start, 1)
    np.add.at(solid, w.end, -1)
    inside = np.cumsum(solid[:-1], dtype=np.int8).astype(bool)
    out["word_chars"] = _per_text(w, lead & inside)
    out["n_symbols"] = _per_text(w, _SYMBOL[buf])

    # Lines: between line feeds and text ends; only those with a word count.
    cut = np.zeros(len(buf) + 1, bool)
    feed = np.flatnonzero(buf == 10)
    cut[feed] = True
    starts = np.unique(np.concatenate([w.offsets[:-1], feed + 1]))
    starts = starts[starts < len(buf)]
    ends = np.minimum(np.append(starts[1:], len(buf)), len(buf))
    ends = ends - ((ends > starts) & (buf[np.maximum(ends - 1, 0)] == 10)) if len(starts) else ends
    seen = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(inside, out=seen[1:])
    real = seen[ends] > seen[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    line_text = np.searchsorted(w.offsets, starts, "right") - 1
    line = mix(_sums(_BYTES[buf], starts, ends - 1) + (ends - starts).astype(U)) if len(starts) else np.zeros(0, U)
    order, new, _ = _again(line_text, line)
    out["n_dup_lines"] = np.bincount(line_text[order][~new], minlength=n)
    out["n_lines"] = np.bincount(line_text, minlength=n)

    grams = w.grams(REPEAT_WINDOW)
    at = np.flatnonzero(w.text[: len(grams)] == w.text[REPEAT_WINDOW - 1 :][: len(grams)]) if len(grams) else np.zeros(0, np.int64)
    order, _, more = _again(w.text[at], grams[at])
    cover = np.zeros(len(w.start) + 1, np.int64)
    hit = at[order][more]
    cover[hit] += 1
    np.subtract.at(cover, hit + REPEAT_WINDOW, 1)
    out["n_repeat_words"] = np.bincount(w.text[np.cumsum(cover)[:-1] > 0], minlength=n)

    order, new, _ = _again(w.text, w.hash)
    out["n_distinct"] = np.bincount(w.text[order][new], minlength=n)
    for name, table in (("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_punct", _PUNCT), ("n_marks", _MARKS)):
        out[name] = _per_text(w, table[buf])
    return out


def _base_failed(t: dict[str, np.ndarray]) -> np.ndarray:
    return (t["n_words"] < MIN_WORDS) | (100 * t["n_repeat_words"] > MAX_REPEAT_PERCENT * t["n_words"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = (*COUNTS, *EXTRA)
    for batch in batches:
        for lo, hi, w in word_blocks(batch.column(1)):
            got = statistics(w)
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *(pa.array(got[k].astype(np.int64)) for k in names)], ["doc_id", *names])


def count(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_count, "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, *EXTRA)))


def rates(t: dict[str, np.ndarray]) -> np.ndarray:
    """The counts a word, line or character; a few words or lines are added, so that short texts are not unusual by that alone."""
    x = {k: np.asarray(v, np.float64) for k, v in t.items()}
    words, chars, lines = x["n_words"] + 5, x["word_chars"] + 25, x["n_lines"] + 3
    return np.column_stack([
        x["word_chars"] / words, x["n_symbols"] / words, x["n_dup_lines"] / lines, x["n_repeat_words"] / words, x["n_upper"] / chars,
        x["n_digits"] / chars, x["n_punct"] / words, x["n_marks"] / words, x["n_distinct"] / words,
    ])


class Forest:
    """Isolation trees as flat arrays: feature (-1 at a leaf), cut, left child, right child, depth."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = SEED):
        rng = np.random.default_rng(seed)
        low, self.center, high = np.quantile(rows, [0.25, 0.5, 0.75], axis=0)
        self.scale = np.maximum(high - low, SPREAD)
        rows = (rows - self.center) / self.scale
        self.psi = min(psi, len(rows))
        self.limit = int(np.ceil(np.log2(max(self.psi, 2))))
        self.feature, self.cut, self.child, self.length, self.roots = [], [], [], [], []
        for _ in range(trees):
            self.roots.append(self._grow(rows[rng.permutation(len(rows))[: self.psi]], 0, rng))
        self.feature, self.cut, self.child, self.length = np.array(self.feature), np.array(self.cut), np.array(self.child), np.array(self.length)

    @staticmethod
    def _mean_path(n: float) -> float:
        """Mean path of an unsuccessful search among n rows of a random tree."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, depth: int, rng) -> int:
        node = len(self.feature)
        self.feature.append(-1)
        self.cut.append(0.0)
        self.child.append((node, node))
        self.length.append(depth + self._mean_path(len(x)))
        lo, width = x.min(0), np.ptp(x, 0)
        if depth < self.limit and width.any():
            f = int(rng.choice(len(width), p=width / width.sum()))
            cut = lo[f] + rng.uniform() * width[f]
            left = x[:, f] < cut
            if left.any() and not left.all():
                self.feature[node], self.cut[node] = f, cut
                self.child[node] = (self._grow(x[left], depth + 1, rng), self._grow(x[~left], depth + 1, rng))
        return node

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / mean path of psi rows): near 1 unusual, near 0 deep inside."""
        x = (x - self.center) / self.scale
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.limit):
                f = self.feature[at]
                right = x[rows, f] >= self.cut[at]
                at = np.where(f < 0, at, self.child[at, right.astype(np.int64)])
            total += self.length[at]
        return 2.0 ** (-total / len(self.roots) / max(self._mean_path(self.psi), 1e-9))


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {k: batch.column(k).to_numpy() for k in (*COUNTS, *EXTRA)}


def fit_forest(counted: DataFrame, trees: int = TREES, psi: int = PSI, seed: int = SEED):
    """The forest, broadcast; None where there are under two rows to grow it on."""
    n = counted.count()
    want = trees * psi
    # The least keys of all; what the filter leaves out cannot be among them, as keys spread evenly.
    salt = F.xxhash64("doc_id", "n_words", "word_chars", F.lit(seed))
    key = F.pmod(salt, F.lit(1 << 30))
    likely = counted.filter(key <= int((1 << 30) * min(1.0, 1.3 * (want + 1000) / max(n, 1))))
    rows = likely.orderBy(key, salt, "doc_id").limit(want).select(*COUNTS, *EXTRA).toPandas()
    if len(rows) < 2:
        return None
    return counted.sparkSession.sparkContext.broadcast(Forest(rates({k: rows[k].to_numpy() for k in rows}), trees, psi, seed))


def score(counted: DataFrame, forest) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("score", pa.array(forest.value.scores(rates(_columns(batch)))))

    return counted.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, *EXTRA)) + ", score double")


def calibrate(scored: DataFrame, labels: DataFrame, good_loss: float = GOOD_LOSS) -> float | None:
    """The threshold: scores above it are rejected.  None where either kind of label is missing."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    bins = scored.join(known, "doc_id").groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin"), (F.col("quality") > 0).alias("good")).count()
    good, low = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for row in bins.collect():  # 2 * BINS rows at most
        (good if row.good else low)[row.bin + 1] += row["count"]
    if not good.sum() or not low.sum():
        return None
    lost, found = (x.sum() - np.cumsum(x) for x in (good, low))  # whole counts, so that a share just allowed is
    fair = lost <= good_loss * good.sum()
    lost, found = lost / good.sum(), found / low.sum()
    best = np.flatnonzero(fair)[np.argmax((found - lost)[fair])]
    return float(best) / BINS


def _judged(docs: DataFrame, labels: DataFrame, trees: int, psi: int, good_loss: float, seed: int):
    """(statistics, scores of those that pass the fixed rules or None, threshold or None, forest or None)."""
    counted = keep(count(docs).withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")), "counts")
    passed = counted.filter("not base_failed").drop("base_failed")
    forest = fit_forest(passed, trees, psi, seed)
    if forest is None:
        return counted, None, None, None
    scored = keep(score(passed, forest), "scores")
    return counted, scored, calibrate(scored, labels, good_loss), forest


def judge(docs: DataFrame, labels: DataFrame, trees: int = TREES, psi: int = PSI, good_loss: float = GOOD_LOSS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept, and the anomaly score (null where not asked)."""
    counted, scored, threshold, _ = _judged(docs, labels, trees, psi, good_loss, seed)
    columns, failed = ["doc_id", *COUNTS], counted.filter("base_failed")
    if scored is None:
        scored = counted.filter("not base_failed").withColumn("score", F.lit(None).cast("double"))
    verdict = F.lit(True) if threshold is None else F.floor(F.col("score") * BINS) < F.lit(threshold * BINS)
    return scored.select(*columns, F.lit(False).alias("base_failed"), verdict.alias("kept"), "score").union(failed.select(*columns, F.lit(True), F.lit(False), F.lit(None).cast("double")))


def kept_rows(docs: DataFrame, labels: DataFrame, trees: int = TREES, psi: int = PSI, good_loss: float = GOOD_LOSS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with all their columns; each row is judged by its own text, without a join."""
    _, _, threshold, forest = _judged(docs, labels, trees, psi, good_loss, seed)
    at = docs.columns.index("text")

    def keep_good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for lo, hi, w in word_blocks(batch.column(at)):
                t = statistics(w)
                good[lo:hi] = ~_base_failed(t)
                if threshold is not None:
                    good[lo:hi] &= np.floor(forest.value.scores(rates(t)) * BINS) < threshold * BINS
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep_good, docs.schema)
