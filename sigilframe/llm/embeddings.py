"""Near-duplicate vectors through cells of spherical k-means.

Method.  Spherical k-means on a bounded sample gives codebooks; a vector's cell is the number of its
nearest centroid.  Vectors that share a cell meet in blocked double-precision cosine products, and
pairs at or above the threshold are links.  A pair near a border can fall into two cells, so
``tables`` independent codebooks each assign every vector.  With n cells a pair at cosine s shares one with
probability near n ** -(SLOPE * (1-s)/(1+s)), as measured at 0.9 with one, two and three codebooks a cell:
0.37 for 226 cells.  There are as many tables as it takes to miss a pair that only just reaches the
threshold once in 1 / ``MISS``, twelve at least, so their number grows with the input; nearer pairs are
missed far less.  A pair counts in the first table where it meets.

That holds where no centroid falls inside a group of neighbours.  Groups dense enough to draw several
centroids would be cut apart in every table, so they have an exact way of their own: balls of the
threshold's angle around dense places of the sample.  A vector inside a ball (its home, the nearest)
leaves the tables and meets every vector within twice the angle of the ball's centre, which by the
triangle inequality are all it can link with.  A pair counts in the lower of its two homes.

Scale.  Equal vectors (by 128 hash bits) are one numbered node with a weight, so copies never multiply.
Cells are kept near ``cell_rows`` members: a codebook has at most ``max_centroids``, and larger inputs take
the pair (or triple, ...) of two (three, ...) codebooks' numbers as the cell.  Vectors travel in the type
they come in.  Crowded cells are cut in blocks of ``BLOCK_ROWS`` that meet two by two.  Blocks emit sums and
a spanning forest, never pairs.  A ball's own vectors are compared with each other and its border in full,
so the work on a dense group of distinct vectors grows with the square of its size.  The only things on the
driver are the sample, the codebooks and the balls' centres, all bounded.

Defined results.  Vectors that are null, empty, zero or hold null or non-finite components, and null
ids, link with nothing.  Shorter vectors count as filled with zeros.  Rows that repeat a vector link with
each other, whatever their ids.  Matrices are as wide as all but one in a thousand vectors; what a longer
one has beyond that is kept beside them and meets only others of its kind, so one very wide row widens no
other.  An empty table gives an empty table.  Columns other than ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components, forest
from .stores import keep

SIMILARITY = 0.9
TABLES, MAX_CENTROIDS, CELL_ROWS, SAMPLE_ROWS, ROUNDS, SEED = 12, 1024, 256, 8192, 5, 5
BLOCK_ROWS = 2048
MISS, SLOPE, TIE = 1e-3, 3.5, 1e-13
BALLS = -1  # in place of a table's number
ROW = ["table", "cell", "node", "weight", "vec", "cells", "home"]


def rows_of(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The lists of an Arrow column as rows of doubles, filled or cut to ``width``, their whole norms, and what was cut off by row.

    Rows are scaled by powers of two, which changes no cosine, so that squares neither overflow nor vanish.
    """
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.diff(vectors.offsets.to_numpy())
    first, norm = np.cumsum(n) - n, np.zeros(len(n))
    if len(n):
        flat = np.ldexp(flat, np.repeat(-np.frexp(np.maximum.reduceat(np.abs(flat), first))[1], n))
        norm = np.sqrt(np.add.reduceat(flat * flat, first))
    if (n == width).all():
        return flat.reshape(len(n), width), norm, {}
    out, place = np.zeros((len(n), width)), np.arange(len(flat)) - np.repeat(first, n)
    inside = place < width
    out[np.repeat(np.arange(len(n)), n)[inside], place[inside]] = flat[inside]
    return out, norm, {k: flat[first[k] + width : first[k] + n[k]] for k in np.flatnonzero(n > width).tolist()}


def unit_rows(vectors: pa.Array, width: int) -> np.ndarray:
    x, norm, _ = rows_of(vectors, width)
    return x / norm[:, None]


def tables_for(cells: int, similarity: float, miss: float = MISS) -> int:
    """How many tables of so many cells miss a pair at the similarity with probability ``miss``."""
    share = min(max(cells, 2) ** -(SLOPE * (1 - similarity) / (1 + similarity)), 1 - 1e-9)
    return max(TABLES, math.ceil(math.log(miss) / math.log(1 - share)))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    """k unit centroids of unit rows; centroids without members stay."""
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = (x @ centroids.T).argmax(1)
        order = np.argsort(home, kind="stable")
        own, at = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(x[order], at)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids[own] = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centroids[own])
    return centroids


def dense_balls(x: np.ndarray, least: int, similarity: float) -> np.ndarray:
    """Unit centres of balls such that every row outside them has under ``least`` linked rows outside them."""
    hit = np.concatenate([x[lo : lo + 1024] @ x.T >= similarity for lo in range(0, len(x), 1024)])
    count, alive, centres = hit.sum(1), np.ones(len(x), bool), []
    while True:
        i = int(np.where(alive, count, 0).argmax())
        if not alive[i] or count[i] < least:
            return np.array(centres).reshape(-1, x.shape[1])
        centre = x[hit[i] & alive].sum(0)
        centre /= np.linalg.norm(centre)  # row i is within the angle: all rows summed are, seen from it
        gone = alive & (x @ centre >= similarity)
        gone[i] = True
        centres.append(centre)
        alive &= ~gone
        count -= hit[gone].sum(0)


def fit(nodes: DataFrame, width: int, tables: int | None, cell_rows: int, sample_rows: int, seed: int, similarity: float, max_centroids: int):
    """Broadcast (codebooks, tables x depth x (centroids, width), and centres of dense balls); None below two rows."""
    n = nodes.count()
    # The least keys of all; what the filter leaves out cannot be among them, as keys spread evenly.
    salt = F.xxhash64("h1", "h2", F.lit(seed))
    key = F.pmod(salt, F.lit(1 << 30))
    likely = nodes.filter(key <= int((1 << 30) * min(1.0, 1.3 * (sample_rows + 1000) / max(n, 1))))
    sample = likely.orderBy(key, salt).limit(sample_rows).select("vec").toArrow()["vec"].combine_chunks()
    if len(sample) < 2:
        return None
    x = unit_rows(sample, width)
    # A quarter of a cell, as the sample shows it.
    balls = dense_balls(x, max(4, -(-cell_rows * len(x) // (4 * n))), similarity)
    if len(balls):
        sparse = x[((x @ balls.T) < similarity).all(1)]
        n = n * len(sparse) // len(x)
        x = sparse if len(sparse) > 1 else x
    depth, k = 1, max(1, n // cell_rows)
    while k > max_centroids:
        depth += 1
        k = int(np.ceil((n / cell_rows) ** (1 / depth)))
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    books = [[spherical_kmeans(x[rng.permutation(len(x))[: max(k, len(x) // 2)]], k, ROUNDS, rng) for _ in range(depth)] for _ in range(tables or tables_for(k**depth, similarity))]
    return nodes.sparkSession.sparkContext.broadcast((np.array(books), balls))


def _assigner(shared, width: int, similarity: float):
    border = 2 * max(similarity, 0.0) ** 2 - 1 - 1e-9  # cosine of twice the angle

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            books, centres = shared.value
            x = unit_rows(batch["vec"], width)
            cells = np.zeros((len(x), len(books)), np.int64)
            for t, levels in enumerate(books):
                for book in levels:
                    cells[:, t] = cells[:, t] * len(book) + (x @ book.T).argmax(1)
            home, row, ball = np.full(len(x), -1), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(centres):
                cos = x @ centres.T
                home = np.where(cos.max(1) >= similarity, cos.argmax(1), -1)
                row, ball = np.nonzero(cos >= border)
            near = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(x) + 1)), pa.int32()), pa.array(ball, pa.int32()))
            batch = batch.append_column("cells", pa.FixedSizeListArray.from_arrays(pa.array(cells.reshape(-1), pa.int32()), cells.shape[1]).cast(pa.list_(pa.int32())))
            yield batch.append_column("home", pa.array(home, pa.int32())).append_column("near", near)

    return assign


class _Block:
    def __init__(self, batch: pa.RecordBatch, width: int):
        self.node, self.weight = batch["node"].to_numpy(), batch["weight"].to_numpy()
        self.raw, self.norm, self.tails = rows_of(batch["vec"], width)
        self.x = self.raw / self.norm[:, None]
        self.cells = batch["cells"].flatten().to_numpy().reshape(len(self.node), -1)
        home = batch["home"].to_numpy().astype(np.int64)
        self.home = np.where(home < 0, np.iinfo(np.int64).max, home)


def _dense_forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """forest() of the pairs set in ``hit``, without listing them."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j = at[: len(left)], at[len(left) :]
    label, none = np.arange(len(nodes)), len(nodes)
    while True:
        new = label.copy()
        np.minimum.at(new, i, np.where(hit, label[j], none).min(1))
        np.minimum.at(new, j, np.where(hit, label[i][:, None], none).min(0))
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def _comparer(width: int, similarity: float):
    """Rows sorted by (table, cell, left block, right block, side) -> (node, links) sums and (node, other) edges."""

    def meet(left: _Block, right: _Block, table: int, cell: int, same: bool) -> np.ndarray:
        cos = left.x @ right.x.T
        for i, u in left.tails.items():
            for j, v in right.tails.items():
                cos[i, j] += u[: len(v)] @ v[: len(u)] / (left.norm[i] * right.norm[j])
        hit = cos >= similarity - TIE
        i, j = np.nonzero(hit & (cos < similarity + TIE))
        for i, j in zip(i.tolist(), j.tolist()):  # as close as rounding: once more, with one division
            dot = left.raw[i] @ right.raw[j]
            if i in left.tails and j in right.tails:
                dot += left.tails[i][: len(right.tails[j])] @ right.tails[j][: len(left.tails[i])]
            hit[i, j] = dot / (left.norm[i] * right.norm[j]) >= similarity
        hit &= left.node[:, None] != right.node
        if same:
            hit = np.triu(hit, 1)
        if table == BALLS:
            hit &= np.minimum(left.home[:, None], right.home) == cell
        elif table and hit.any():
            i, j = np.nonzero(hit)
            seen = (left.cells[i, :table] == right.cells[j, :table]).any(1)
            hit[i[seen], j[seen]] = False
        return hit

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.column_stack([batch[c].to_numpy() for c in ("table", "cell", "bi", "bj", "side")])
            cut = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(ids)]):
                table, cell, bi, bj, side = ids[lo].tolist()
                block = _Block(batch.slice(lo, hi - lo), width)
                if held != (table, cell, bi, bj):
                    held, left = (table, cell, bi, bj), []
                if not side:
                    left.append(block)
                for part in left if side or bi == bj else []:
                    hit = meet(part, block, table, cell, part is block)
                    n_hits = int(np.count_nonzero(hit))
                    if not n_hits:
                        continue
                    sums = [(part.node, hit @ block.weight.astype(np.float64)), (block.node, part.weight.astype(np.float64) @ hit)]
                    node, n = np.concatenate([s[0] for s in sums]), np.concatenate([s[1] for s in sums]).astype(np.int64)
                    if n_hits > 16 * sum(hit.shape):
                        a, b = _dense_forest(hit, part.node, block.node)
                    else:
                        i, j = np.nonzero(hit)
                        a, b = forest(part.node[i], block.node[j])
                    some = n > 0
                    node, n = node[some], n[some]
                    yield pa.record_batch(
                        [pa.array(np.concatenate([node, a])), pa.array(np.concatenate([n, np.zeros(len(a), np.int64)])), pa.array([None] * len(node) + b.tolist(), pa.int64())],
                        ["node", "n", "other"],
                    )

    return compare


def near_duplicates(rows: DataFrame, similarity: float = SIMILARITY, tables: int | None = None, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS, seed: int = SEED, max_centroids: int = MAX_CENTROIDS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``rows``."""
    finite = F.expr("coalesce(size(embedding) > 0 and forall(embedding, x -> coalesce(not isnan(x) and abs(x) < double('Infinity'), false)) and exists(embedding, x -> x <> 0), false)")
    kind = rows.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    vectors = rows.select("vec_id", F.when(finite & F.col("vec_id").isNotNull(), F.col("embedding").cast(kind)).alias("vec"))
    named = lambda c, *salt: F.when(F.col("vec").isNotNull(), F.xxhash64("vec", *salt)).alias(c)
    vectors = vectors.select("vec_id", "vec", named("h1"), named("h2", F.lit(77)))
    # Each distinct vector is a node; its number is given as the table is written.
    nodes = vectors.filter("vec is not null").groupBy("h1", "h2").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("vec").alias("vec"))
    nodes = keep(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    width = nodes.agg(F.percentile_approx(F.size("vec"), 0.999)).first()[0] or 1
    shared = fit(nodes, width, tables, cell_rows, sample_rows, seed, similarity, max_centroids)
    own = F.greatest("weight", F.lit(1)) - 1
    if shared is None:
        found = nodes.select("h1", "h2", own.alias("n_links"), F.col("least").alias("component_id"))
    else:
        placed = nodes.select("node", "weight", "vec").mapInArrow(_assigner(shared, width, similarity), f"node long, weight long, vec {kind}, cells array<int>, home int, near array<int>")
        placed = keep(placed, "cells")
        sparse = placed.filter("home < 0")
        crowded = sparse.select(F.posexplode("cells").alias("table", "cell")).groupBy("table", "cell").count().filter(f"count > {BLOCK_ROWS}").select("table", "cell", F.expr(f"cast(ceil(count / {BLOCK_ROWS}) as int)").alias("blocks"))
        spread = sparse.select("*", F.posexplode("cells").alias("table", "cell")).join(crowded, ["table", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        spread = spread.withColumn("block", F.expr("cast(pmod(node, blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        # In a ball, blocks of its own vectors come first and meet all; blocks of its border meet only those.
        balled = placed.select("*", F.lit(BALLS).alias("table"), F.explode("near").alias("cell")).withColumn("core", F.expr("home = cell"))
        in_ball = balled.groupBy("cell").agg(*[F.expr(f"cast(ceil(count_if({c}) / {BLOCK_ROWS}) as int)").alias(n) for c, n in (("core", "cores"), ("not core", "borders"))])
        balled = balled.join(F.broadcast(in_ball.filter("cores > 0")), "cell").withColumn("block", F.expr("cast(if(core, pmod(node, cores), cores + pmod(node, borders)) as int)"))
        balled = balled.withColumn("other", F.explode(F.expr("sequence(0, if(core, cores + borders, cores) - 1)")))
        spread = spread.select(*ROW, "block", "other").unionByName(balled.select(*ROW, "block", "other"))
        spread = spread.select(*ROW, F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), F.expr("cast(block > other as int)").alias("side"))
        met = spread.repartition("table", "cell", "bi", "bj").sortWithinPartitions("table", "cell", "bi", "bj", "side").mapInArrow(_comparer(width, similarity), "node long, n long, other long")
        met = keep(met, "found")
        sums = met.groupBy("node").agg(F.sum("n").alias("n"))
        comp = components(met.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
        # Small sides of joins on hot keys are tables of their own, so that the planner can split such a key's rows.
        counted = nodes.drop("vec").join(sums, "node", "left").join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        counted = keep(counted.select("h1", "h2", "component", "least", (own + F.coalesce("n", F.lit(0))).alias("n_links")), "named")
        least = keep(counted.groupBy("component").agg(F.min("least").alias("component_id")), "least")
        found = keep(counted.join(least, "component").select("h1", "h2", "n_links", "component_id"), "linked")
    out = vectors.select("vec_id", "h1", "h2").join(found, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
