"""Substring and near-duplicate operators against all-pairs versions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigilframe.llm import components, embeddings, minhash, substring

from .texts import DOCS, corpus, groups, near, prose, removed


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5)


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"full": -1.0}, {"width_bits": 6}, {"width_bits": 6, "full": 2.0}])
def test_substring(docs, options):
    """By bitmap, by join, with a crowded sketch, and with a crowded bitmap: never a window less."""
    out = by_id(substring.remove_repeats(docs, **options), "n_words", "n_removed", "kept_sha256")
    assert out == removed(corpus())


def test_substring_text_keeps_white_space(spark):
    import random

    rng = random.Random(4)
    shared = prose(rng, 60)
    rows = [(1, f"a\n{shared} b"), (2, f"x\ty \n {shared}\n\nz  q"), (3, shared), (4, None)]
    out = by_id(substring.without_repeats(spark.createDataFrame(rows, DOCS)), "text")
    assert out == {1: (rows[0][1],), 2: ("x\ty \n z  q",), 3: ("",), 4: (None,)}


def test_substring_odd_rows(spark):
    import random

    text = prose(random.Random(5), 80)
    rows = [(None, text, "r"), (7, text, "r"), (7, text, "r"), (7, text + " more", "r"), (9, text, None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = substring.remove_repeats(df).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in out) == [(0, 0), (0, 0), (7, 0), (7, 0), (7, 0), (9, 80)]
    assert {r.runs for r in substring.without_repeats(df).collect()} == {"r", None}
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_substring_memory_follows_the_input():
    """Half a GB asks for a bitmap of 16 MB, not 64; a task sketches a bounded number of keys at a time."""
    bitmap = lambda size: (substring.ROWS << substring.width_of(size)) >> 3
    assert bitmap(1 << 10) == 1 << 18 and bitmap((1 << 29) - 1) == 1 << 24 and bitmap(30 << 30) == 1 << 26
    texts = pa.array([" ".join(f"w{k * 99991 + i}" for i in range(20_000)) for k in range(300)])
    out = list(substring._sketcher(50, 16, 28)(iter([pa.record_batch([pa.array(range(300)), texts], ["doc_id", "text"])])))
    assert len(out) > 1 and max(b.num_rows for b in out) <= substring.ROWS * (substring.FLUSH + 100_000)


def test_near_duplicates(docs):
    out = by_id(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept")
    expected = near(corpus())
    assert out == {i: (n, c, c == i) for i, (n, c) in expected.items()}


def test_near_duplicates_chain(spark, monkeypatch):
    """A large family whose members link through each other only, cut in many blocks."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    import random

    rng = random.Random(8)
    w = prose(rng, 150).split()
    rows = []
    for k in range(90):
        rows.append((k, " ".join(w)))
        for _ in range(4):
            w[rng.randrange(len(w))] = f"z{rng.randrange(1000)}"
    out = by_id(minhash.near_duplicates(spark.createDataFrame(rows, DOCS)), "component_id")
    assert out == {i: (c,) for i, (_, c) in near(rows).items()}


def test_merged_lists_connect_what_all_pairs_connect():
    """Two blocks whose lists are merged give the connections of all pairs that agree often enough and are similar."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base = [rng.integers(0, 2**63, 80).astype(np.uint64) for _ in range(12)]

    def block(first, n):
        rows = []
        for k in range(n):
            s = base[rng.integers(12)].copy()
            change = rng.choice(80, rng.integers(0, 16), replace=False)
            s[change] = rng.integers(0, 2**63, len(change)).astype(np.uint64)
            rows.append(np.unique(s))
        a, b = minhash.stream(101, 64) | np.uint64(1), minhash.stream(202, 64)
        with np.errstate(over="ignore"):
            sig = [(s[:, None] * a + b).min(0).view(np.int64).tolist() for s in rows]
        ids = np.arange(first, first + n)
        return rows, sig, minhash._Block(pa.record_batch([pa.array(ids), pa.array(ids), pa.array(sig, pa.list_(pa.int64())), pa.array([s.tobytes() for s in rows])], ["node", "comp", "sig", "set"]))

    (sets, sig, left), (other_sets, other_sig, right) = block(0, 90), block(100, 70)
    for one, many, other, base_id in ((left, sets, left, 0), (left, other_sets, right, 100)):
        sigs = sig if other is left else other_sig
        want = []
        for i, s in enumerate(sets):
            for j, t in enumerate(many):
                both = len(np.intersect1d(s, t))
                if i != base_id + j and sum(x == y for x, y in zip(sig[i], sigs[j])) >= 30 and 100 * both >= 75 * (len(s) + len(t) - both):
                    want.append((i, base_id + j))
        got = list(zip(*(x.tolist() for x in one.links(other, 30, 75))))
        ids = range(200)
        assert len(want) > 100 and groups(ids, got) == groups(ids, want) and len(got) < len(ids)


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 3), (5, "A B C D E F", 4), (6, None, 5), (7, " ", 6), (3, "quite another text here now then", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long")
    out = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(df).collect())
    assert out == [(0, 0, True), (3, 3, True), (3, 3, True), (3, 3, True), (5, 3, False), (6, 6, True), (7, 7, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert minhash.without(df, spark.createDataFrame([(3,)], "doc_id long")).count() == 4


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(k, k + 1) for k in range(400, 460)] + [(5, 5)]
    rows = [*links, links[0], (None, 3)]
    out = {r.id: r.component for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    expected = groups({i for p in links for i in p}, links)
    assert all(expected[i] == c for i, c in out.items())
    assert set(out) == {i for p in links if p[0] != p[1] for i in p}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16))
    x[100:160] = x[:60] + 0.2 * rng.standard_normal((60, 16))
    x[160:200] = x[0]
    x[200:260] = x[1] + 0.25 * rng.standard_normal((60, 16))
    return x.astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("block", [16, 2048])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block)
    x = vectors()
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [float("inf")] * 16), (1005, [None] + [1.0] * 15), (None, x[0].tolist()), (1006, (2.5 * x[0]).tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("node", F.lit("clash"))
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, cell_rows=40).collect()}
    y = np.vstack([x, 2.5 * x[0]])
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    cos = u @ u.T
    names = [*range(len(x)), 1006]
    links = [(names[i], names[j]) for i, j in zip(*np.nonzero(np.triu(cos >= 0.9, 1)))]
    comp = groups(names, links)
    for i, name in enumerate(names):
        assert out[name] == (int((cos[i] >= 0.9).sum()) - 1, comp[name], comp[name] == name)
    assert all(out[k] == (0, k, True) for k in range(1000, 1006)) and out[None] == (0, None, True)


def test_embeddings_dense_group(spark):
    """A third of 50,000 distinct vectors around one direction: every link is counted."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    x = rng.standard_normal((50_000, 64)) / 8
    hot = rng.permutation(len(x))[: len(x) // 3]
    x[hot] = x[0] / np.linalg.norm(x[0]) + rng.uniform(0.1, 0.28, (len(hot), 1)) * x[hot]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = np.concatenate([(u[lo : lo + 2000] @ u.T >= 0.9).sum(1) for lo in range(0, len(u), 2000)]) - 1
    table = pa.table({"vec_id": pa.array(range(len(x))), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 64).cast(pa.list_(pa.float64()))})
    found = embeddings.near_duplicates(spark.createDataFrame(table).repartition(6)).toPandas().set_index("vec_id")["n_links"].sort_index().to_numpy()
    assert links.sum() > 2e8
    assert (found == links).all(), (int(found.sum()), int(links.sum()))


def test_embeddings_small(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(4, [1.0, 2.0]), (2, [1.0, 2.0])], schema)
    assert sorted(map(tuple, embeddings.near_duplicates(one).collect())) == [(2, 1, 2, True), (4, 1, 2, False)]
    uneven = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 1.0])], schema)
    assert sorted((r.vec_id, r.component_id) for r in embeddings.near_duplicates(uneven).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_embeddings_ties_repeats_and_wide_rows(spark):
    """Cosines of exactly 0.9, ids on several rows, a row far wider than all others, and two wide ones that link by their ends."""
    schema = "vec_id long, embedding array<double>, weight string"
    rng = np.random.default_rng(1)
    rows = [(100 + k, rng.standard_normal(8).tolist(), "x") for k in range(1200)]
    rows += [(1, [9.0, 0.0, 0.0, 0.0], "x"), (2, [9.0, 19.0**0.5, 0.0, 0.0], "x"), (3, [0.0, 0.0, 1.0], "x"), (3, [0.0, 0.0, 1.0, 0.0], "x"), (3, [0.0, 0.0, 0.0, 5.0], "x"), (3, [0.0, 0.0, 0.0, 5.0], "x")]
    wide = np.zeros(300_000)
    wide[:8] = rows[0][1]
    rows += [(4, wide.tolist(), "x"), (5, [0.1] * 8 + [1.0] * 5000, "x"), (6, [0.1] * 8 + [1.0] * 5100, "x")]
    out = {}
    for r in embeddings.near_duplicates(spark.createDataFrame(rows, schema).repartition(3), cell_rows=300).collect():
        out.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    names, x = [r[0] for r in rows], np.zeros((len(rows), 5200))
    for k, (_, v, _) in enumerate(rows):
        x[k, : min(len(v), 5200)] = v[:5200]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    comp = groups(range(len(rows)), list(zip(*np.nonzero(np.triu(cos >= 0.9, 1)))))
    least = {}
    for k, c in comp.items():
        least[c] = min(names[k], least.get(c, names[k]))
    want = {}
    for k, name in enumerate(names):
        want.setdefault(name, []).append((int((cos[k] >= 0.9).sum()) - 1, least[comp[k]]))
    assert {k: sorted(v) for k, v in out.items()} == {k: sorted(v) for k, v in want.items()}
    assert cos[1200, 1201] >= 0.9 - 1e-15 and out[4] == [(out[100][0][0], 4)] and out[5][0][0] == out[6][0][0] == 1


@pytest.mark.parametrize("max_centroids,depth", [(40, 2), (10, 3)])
def test_embeddings_recall_with_products_of_codebooks(spark, max_centroids, depth):
    """Links just above the threshold, with cells made of two and three codebooks: what MISS promises holds."""
    rng = np.random.default_rng(3)
    n, pairs = 16_000, 4000
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.standard_normal((pairs, 64))
    other -= (other * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cos = rng.uniform(0.9005, 0.91, (pairs, 1))
    x = np.vstack([x, cos * x[:pairs] + np.sqrt(1 - cos**2) * other])
    links = sum(int((x[lo : lo + 2000] @ x.T >= 0.9).sum()) for lo in range(0, len(x), 2000)) - len(x)
    import pyarrow as pa

    table = pa.table({"vec_id": pa.array(range(len(x))), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 64).cast(pa.list_(pa.float64()))})
    df = spark.createDataFrame(table).repartition(4)
    found = embeddings.near_duplicates(df, cell_rows=32, max_centroids=max_centroids).agg(F.sum("n_links")).first()[0]
    cells = len(x) // 32
    assert int(np.ceil(np.log(cells) / np.log(max_centroids))) == depth and embeddings.tables_for(cells, 0.9) > embeddings.TABLES
    print(f"depth {depth}: {found} of {links} links")
    assert links >= 2 * pairs and found >= (1 - 2 * embeddings.MISS) * links


def test_tables_grow_with_the_cells():
    assert [embeddings.tables_for(c, 0.9) for c in (1, 226, 10**4, 4 * 10**6, 4 * 10**8)] == sorted(embeddings.tables_for(c, 0.9) for c in (1, 226, 10**4, 4 * 10**6, 4 * 10**8))
    assert embeddings.tables_for(2, 0.9) == 12 and embeddings.tables_for(226, 0.9) == 16 and embeddings.tables_for(4 * 10**6, 0.9) > 60
