"""Each stage of the pipeline against a plain version on its own input; the queries against their SQL."""

import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigilframe.llm import packing, quality
from sigilframe.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import DATA
from .texts import corpus, near, prose, removed, rule_counts, words

SF = DATA / "sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = corpus() + [(500 + k, " | ".join(prose(rng, 60, 5000).split())) for k in range(8)] + [(600, prose(rng, 40) + " password = abcdef0123456789 " + prose(rng, 40))]
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS)
    docs.repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 500), 0) for i, _ in rows[::2] if i < 60 or i >= 500], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "substring_dedup", "secret_scans", "best_fit_packing"]

    kept = stages["quality_rules"](spark, docs, sf_dir)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    verdicts = {r.doc_id: r.kept for r in quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert pairs(kept) == [(i, t) for i, t in pairs(docs) if verdicts[i]]
    for i, t in pairs(docs):
        n, _, _, _, repeats = rule_counts(t)
        assert not (verdicts[i] and (n < 10 or 100 * repeats > 20 * n))

    before = pairs(kept)
    single = stages["near_duplicates"](spark, kept, sf_dir)
    expected = near(before)
    assert pairs(single) == [(i, t) for i, t in before if expected[i][1] == i]

    before = pairs(single)
    cut = stages["substring_dedup"](spark, single, sf_dir)
    plain = removed(before)
    for (i, old), r in zip(before, sorted(cut.collect(), key=lambda r: r.doc_id)):
        assert r.doc_id == i and r.n_chars == len(r.text) and len(words(r.text)) == plain[i][0] - plain[i][1]
        assert plain[i][1] or r.text == old

    clean = stages["secret_scans"](spark, cut, sf_dir)
    assert "abcdef0123456789" in dict(pairs(cut))[600] and "[REDACTED_ASSIGN]" in dict(pairs(clean))[600]
    assert [(i, t) for i, t in pairs(clean) if i != 600] == [(i, t) for i, t in pairs(cut) if i != 600]

    packed = stages["best_fit_packing"](spark, clean, sf_dir).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in pairs(clean)}
    got = {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == ids
    assert len({r.sequence_id for r in packed}) <= math.ceil(sum(map(len, ids.values())) / packing.CAPACITY) + 1


def test_one_row_of_a_group_stays(spark, sf_dir):
    """Ids that repeat with different texts, with the same text, and as the least of two groups."""
    a, b, c, d = (prose(random.Random(k), 60, 5000) for k in range(4))
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (7, c.upper()), (9, c), (3, d), (3, a + " x"), (4, d), (6, None), (6, None), (6, d), (None, b), (None, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS).repartition(3)
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf_dir)
    assert out.schema.simpleString() == docs.schema.simpleString()
    got = sorted(((r.doc_id or 0, (r.text or "").lower()) for r in out.collect()))
    assert got == sorted([(1, a), (5, b), (7, c), (3, d), (6, ""), (6, ""), (0, b), (0, b)])


def test_run_is_the_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    ran = corpus_pipeline.run(spark, sf_dir)
    key = lambda df: sorted((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    assert key(ran) == key(docs) and ran.count() > 0


def test_rows_without_an_id_go_all_the_way(spark, tmp_path):
    """Null ids, texts and other columns: judged by their texts, never another's duplicate, packed under no id."""
    rng = random.Random(5)
    text = prose(rng, 200, 5000)
    rows = [(1, text), (None, text), (None, text), (None, prose(rng, 5000, 5000)), (None, None), (2, None), (None, "short"), (3, "secret = abcdef0123456789 " + prose(rng, 60, 5000))]
    spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 0, 0), (1, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [(r.doc_id, r.piece) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(i for i, piece in got if i is not None and piece == 0) == [1, 3]
    assert sum(i is None and piece == 0 for i, piece in got) == 3 and any(piece > 0 for _, piece in got)


def test_intermediate_tables_go(spark, sf_dir):
    from pathlib import Path

    from sigilframe.llm import stores

    shared = Path(stores.shared_dir(spark).removeprefix("file://"))
    stores.release(spark)
    before = set(shared.iterdir())
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0
    left = {p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before}
    assert left == {"quality_rules", "near_duplicates", "substring_dedup", "secret_scans", "numbered"}
    with stores.scope(spark):
        inside, kept = stores.keep(spark.range(3)), stores.keep(spark.range(4), outside=True)
        assert inside.count() == 3
    assert kept.count() == 4
    stores.release(spark)
    assert set(shared.iterdir()) == before


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"runs": F.lit("r"), "node": F.lit(1), "kept": F.lit(True)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "runs", "node", "kept"], name
    assert {r.runs for r in docs.collect()} == {"r"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, str(SF)).toPandas(), con.execute(ORACLE_SQL[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    text = lambda df: sorted(re.sub(r"\.0\b", "", "|".join("" if pd.isna(v) else str(v) for v in r)) for r in df[cols].astype(object).itertuples(index=False))
    assert text(ours) == text(theirs)


def test_every_operator_has_its_query():
    assert [re.match(r"op(\d+)_", n)[1] for n in QUERIES] == [str(k) for k in range(1, 11)]


def test_stages_keep_their_batches_small(spark, sf_dir):
    """Every stage bounds its batches itself, whatever ran before it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs, sf_dir)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
