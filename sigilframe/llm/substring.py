"""Substring dedup: windows of words that already start in an earlier document are cut out.

Method.  A count-min sketch over all documents overestimates in how many documents each window
occurs.  Windows are counted under the least hash of the ``anchor`` -word grams inside them, which
equal windows share and which neighbouring windows mostly share too, so a document adds a few counts
per hundred words rather than one a word.  Each partition makes its own sketch (sparse cells);
partition sketches are merged by adding cells.  A second pass over the texts emits only windows whose
cells all reach two, and those are grouped exactly: a window is a repeat if it starts in a document
with a smaller ``doc_id``.  The sketch never underestimates, so no repeated window is lost.

Scale.  Sketch cells and windows are aggregated with map-side sums and minima, so a passage that a
third of all documents share is one row per task.  The merged sketch reaches the second pass as a
bitmap of ``rows`` x ``2**width_bits`` bits: it is built on the executors in slices, its size is fixed
by the width, and the width follows the input's size up to ``MAX_WIDTH_BITS`` (64 MB for two rows).
Where a denser sketch would prune too little, the hot cells stay a table and are joined with each
document's anchors instead, so nothing is broadcast.  Windows are told apart by 96 hash bits.

Defined results.  Null text: no words, the digest of the empty string.  Texts below ``window`` words:
whole.  Null ``doc_id``: kept whole, and never the earlier document.  Rows that repeat a ``doc_id``
do not remove each other's words.  An empty table gives an empty table.  Columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .stores import keep, trim, with_ids
from .text import U, Words, mix, sliding_min, stream, word_blocks

WINDOW, ANCHOR = 50, 16
ROWS, MIN_WIDTH_BITS, MAX_WIDTH_BITS, SLICE_BITS = 2, 20, 28, 18
#: Share of set bits beyond which the bitmap prunes too little and a join takes its place.
FULL = 0.25
#: Keys that a task sketches at a time; the JVM adds up the cells of all flushes before the shuffle.
FLUSH = 1 << 18

_SALTS = stream(909, 8) | U(1)


def anchors(w: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, the least gram hash in each of those windows)."""
    least = sliding_min(w.grams(anchor), window - anchor + 1)
    at = np.flatnonzero(w.text[: len(least)] == w.text[window - 1 :][: len(least)]) if len(least) else np.zeros(0, np.int64)
    return at, least[at]


def cells(keys: np.ndarray, row: int, width_bits: int) -> np.ndarray:
    """The cell of each key in a row of the sketch; rows follow each other."""
    return ((mix(keys * _SALTS[row]) >> U(64 - width_bits)) + U(row << width_bits)).astype(np.int64)


def _distinct_anchors(w: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key), each once."""
    at, key = anchors(w, window, anchor)
    text = w.text[at]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    text, key = text[new], key[new]
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return text[new], key[new]


def _sketcher(window: int, anchor: int, width_bits: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([np.zeros(0, U), *held])
            cell, count = np.unique(np.concatenate([cells(keys, r, width_bits) for r in range(ROWS)]), return_counts=True)
            return pa.record_batch([pa.array(cell), pa.array(count.astype(np.int32))], ["cell", "n"])

        with np.errstate(over="ignore"):
            for batch in batches:
                for _, _, w in word_blocks(batch.column(1)):
                    key = _distinct_anchors(w, window, anchor)[1]
                    held.append(key)
                    n += len(key)
                    if n >= FLUSH:
                        yield flush()
                        held, n = [], 0
                trim()
            if n:
                yield flush()

    return sketch


def _slicer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hot cells sorted by cell -> (slice, bitmap)."""
    held, bits = None, None
    for batch in batches:
        cell = batch.column(0).to_numpy()
        part = cell >> SLICE_BITS
        cut = np.flatnonzero(part[1:] != part[:-1]) + 1
        for lo, hi in zip([0, *cut], [*cut, len(cell)]):
            if lo == hi:
                continue
            if part[lo] != held:
                if held is not None:
                    yield pa.record_batch([pa.array([held], pa.int64()), pa.array([np.packbits(bits).tobytes()])], ["part", "bits"])
                held, bits = part[lo], np.zeros(1 << SLICE_BITS, bool)
            bits[cell[lo:hi] & ((1 << SLICE_BITS) - 1)] = True
    if held is not None:
        yield pa.record_batch([pa.array([held], pa.int64()), pa.array([np.packbits(bits).tobytes()])], ["part", "bits"])


def _bitmap(spark: SparkSession, hot: DataFrame, width_bits: int):
    """Broadcast of ROWS * 2**width_bits bits, put together slice by slice."""
    size = (ROWS << width_bits) >> 3
    whole = np.zeros(size, np.uint8)
    slices = hot.repartition(F.expr(f"shiftright(cell, {SLICE_BITS})")).sortWithinPartitions("cell").mapInArrow(_slicer, "part long, bits binary")
    for row in slices.toLocalIterator():
        lo = row.part << (SLICE_BITS - 3)
        part = whole[lo : lo + (1 << (SLICE_BITS - 3))]
        part[:] = np.frombuffer(row.bits, np.uint8)[: len(part)]
    return spark.sparkContext.broadcast(whole)


def _hot(keys: np.ndarray, bits: np.ndarray, width_bits: int) -> np.ndarray:
    hot = np.ones(len(keys), bool)
    for r in range(ROWS):
        c = cells(keys, r, width_bits)
        hot &= (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return hot


def text_mark(w: Words, first: np.ndarray) -> np.ndarray:
    """31 bits of each text's words, which tell apart the rows of a repeated doc_id."""
    n = np.diff(first)
    mark = np.zeros(w.n_texts, U)
    some = np.flatnonzero(n)
    if len(some):
        mark[some] = w.runs(first[some], first[some + 1] - 1) >> U(33)
    return mark.astype(np.int64)


def _windower(window: int, anchor: int, width_bits: int, bits, given: bool):
    """Texts -> (h1, h2, doc_id, pos) of windows with a hot anchor; pos holds the text's mark in its high half."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for lo, hi, w in word_blocks(batch.column(1)):
                    at, key = anchors(w, window, anchor)
                    if given:
                        own = batch.column(2).slice(lo, hi - lo)
                        flat, count = own.flatten().to_numpy().view(U), np.diff(own.offsets.to_numpy())
                        pair = lambda t, k: mix(k + mix(t.astype(U) + U(1)))
                        hot = np.isin(pair(w.text[at], key), pair(np.repeat(np.arange(hi - lo), count), flat))
                    else:
                        hot = _hot(key, bits.value, width_bits)
                    at = at[hot]
                    if not len(at):
                        continue
                    text = w.text[at]
                    h1 = w.grams(window)[at]
                    h2 = (w.grams(window, 77)[at] >> U(32)).astype(np.uint32).view(np.int32)
                    first = w.first()
                    pos = (text_mark(w, first)[text] << 32) | (at - first[text])
                    yield pa.record_batch([pa.array(h1.view(np.int64)), pa.array(h2), pa.array(ids[lo:hi][text]), pa.array(pos)], ["h1", "h2", "doc_id", "pos"])
                trim()

    return windows


def _anchor_rows(window: int, anchor: int, width_bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for lo, hi, w in word_blocks(batch.column(1)):
                    text, key = _distinct_anchors(w, window, anchor)
                    yield pa.record_batch([pa.array(ids[lo:hi][text]), pa.array(key.view(np.int64)), *(pa.array(cells(key, r, width_bits)) for r in range(ROWS))], ["doc_id", "key", *(f"cell{r}" for r in range(ROWS))])

    return rows


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, window starts) -> (doc_id, first and last of each run of neighbouring starts)."""
    for batch in batches:
        out = []
        for starts in batch.column(1):
            at = np.unique(starts.values.to_numpy())
            step = np.flatnonzero(np.diff(at) != 1)
            out.append(np.column_stack([at[np.concatenate([[0], step + 1])], at[np.concatenate([step, [len(at) - 1]])]]).reshape(-1))
        yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "runs"])


def _gone(w: Words, first: np.ndarray, runs: pa.Array, window: int) -> np.ndarray:
    """Which words the runs of each text cover."""
    mark = text_mark(w, first)
    gone = np.zeros(len(w.start) + 1, np.int64)
    at, text = runs.flatten().to_numpy().reshape(-1, 2), np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()) // 2)
    ours = (at[:, 0] >> 32) == mark[text]
    at = (at[ours] & 0xFFFFFFFF) + first[text[ours]][:, None]
    np.add.at(gone, at[:, 0], 1)
    np.add.at(gone, at[:, 1] + window, -1)
    return np.cumsum(gone)[:-1] > 0


def _left(w: Words, t: int, text: bytes, off: np.ndarray, i: int, j: int) -> str:
    """A text without its removed runs, each of which takes the space behind it."""
    base, parts, done = w.offsets[t], [], 0
    for a, b in np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]).astype(np.int8))).reshape(-1, 2).tolist():
        parts.append(text[done : w.start[i + a] - base])
        done = w.start[i + b] - base if i + b < j else w.end[j - 1] - base
    return b"".join([*parts, text[done:]]).decode()


def _cutter(window: int):
    """(doc_id, text, runs of removed windows) -> digest columns."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo, hi, w in word_blocks(batch.column(1)):
                    first = w.first()
                    gone = _gone(w, first, batch.column(2).slice(lo, hi - lo), window)
                    data, removed, digests = w.buf.tobytes(), [], []
                    for t in range(hi - lo):
                        off = gone[first[t] : first[t + 1]]
                        words = data[w.offsets[t] : w.offsets[t + 1]].split()
                        removed.append(int(off.sum()))
                        kept = [words[k] for k in np.flatnonzero(~off).tolist()] if removed[-1] else words
                        digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return cut


def _rewriter(at: int, window: int):
    """Rows with their runs as the last column -> the rows, their texts without the runs."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                made, runs = [], batch.column(batch.num_columns - 1)
                for lo, hi, w in word_blocks(batch.column(at)):
                    first = w.first()
                    gone = _gone(w, first, runs.slice(lo, hi - lo), window)
                    data = w.buf.tobytes()
                    for t in range(hi - lo):
                        i, j = first[t], first[t + 1]
                        made.append(_left(w, t, data[w.offsets[t] : w.offsets[t + 1]], gone[i:j], i, j) if gone[i:j].any() else batch.column(at)[lo + t].as_py())
                yield pa.record_batch([pa.array(made, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns - 1)], batch.schema.names[:-1])
                trim()

    return rewrite


def width_of(size: int) -> int:
    """Width of a sketch row for an input of ``size`` packed bytes: a cell or two for 8 bytes, within bounds.

    These hold some 4 words, which add an anchor or less; where cells meet by chance a few windows more are grouped.
    """
    return min(MAX_WIDTH_BITS, max(MIN_WIDTH_BITS, min(size, 1 << 62).bit_length() - 3))


def width_for(docs: DataFrame) -> int:
    """Width of a sketch row from the input's size as the planner knows it."""
    return width_of(int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, width_bits: int | None = None, full: float = FULL) -> DataFrame:
    """(doc_id, runs): the window starts of each document that also start in an earlier one.

    A run is its first and its last start, each with the text's mark in its high half.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    width_bits = width_bits or width_for(texts)
    sketch = texts.mapInArrow(_sketcher(window, anchor, width_bits), "cell long, n int")
    hot = keep(sketch.groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1").select("cell"), "sketch")
    schema = "h1 long, h2 int, doc_id long, pos long"
    if hot.count() <= full * (ROWS << width_bits):
        windows = texts.mapInArrow(_windower(window, anchor, width_bits, _bitmap(spark, hot, width_bits), False), schema)
    else:
        rows = texts.mapInArrow(_anchor_rows(window, anchor, width_bits), "doc_id long, key long, " + ", ".join(f"cell{r} long" for r in range(ROWS)))
        for r in range(ROWS):
            rows = rows.join(hot.withColumnRenamed("cell", f"cell{r}"), f"cell{r}", "left_semi")
        own = rows.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
        windows = texts.join(own, "doc_id").select("doc_id", "text", "keys").mapInArrow(_windower(window, anchor, width_bits, None, True), schema)
    dup = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    # As a table of its own, so that the join's partitions of a hot window can be split.
    dup = keep(dup, "repeated")
    found = windows.join(dup, ["h1", "h2"]).filter("doc_id > least")
    return found.groupBy("doc_id").agg(F.collect_list("pos").alias("starts")).mapInArrow(_runs, "doc_id long, runs array<long>")


def _with_runs(docs: DataFrame, columns: list[str], window: int, anchor: int, sketch: dict) -> tuple[DataFrame, DataFrame]:
    """The rows that lose nothing, and those that do with their ``runs``.

    Only the latter are shuffled, as long as their ids are few enough to send.
    """
    repeats = keep(repeated_windows(docs, window, anchor, **sketch), "repeats")
    ids, rows = repeats.select("doc_id"), docs.select(columns)
    # The rows may have a column named runs already.
    own = "runs"
    while own in {c.lower() for c in columns}:
        own += "_"
    hit = with_ids(rows, ids, "left_semi").join(repeats.withColumnRenamed("runs", own), "doc_id")
    return with_ids(rows, ids, "left_anti"), hit.select(*columns, own)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, **sketch) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: what is left of every text."""
    whole, hit = _with_runs(docs, ["doc_id", "text"], window, anchor, sketch)
    rows = whole.withColumn("runs", F.array().cast("array<long>")).union(hit)
    return rows.mapInArrow(_cutter(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, **sketch) -> DataFrame:
    """All columns of ``docs``; repeated words are cut out of ``text``, each run with the space behind it."""
    whole, hit = _with_runs(docs, docs.columns, window, anchor, sketch)
    return whole.union(hit.mapInArrow(_rewriter(docs.columns.index("text"), window), docs.schema))
