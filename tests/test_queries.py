"""Every registered query gives the rows of its SQL, on the smallest tables."""

import duckdb
import pytest

from sigilframe.queries import ORACLE_SQL, QUERIES

from .conftest import DATA

SF = DATA / "sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df):
    cols = sorted(df.columns)
    rows = df[cols].astype(object).where(df[cols].notna(), None)
    return cols, sorted("|".join(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    ours = QUERIES[name](spark, str(SF)).toPandas()
    assert canonical(ours) == canonical(duck.execute(ORACLE_SQL[name]).df())


def test_flagship_has_rows(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0


def test_manuscripts_reach_every_step():
    """The oracle's own rows: no step of the engine is held to an empty table."""
    import sigilframe.paper_queries as steps
    from sigilframe.registry import ORACLE_SQL as sql

    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{SF}/supplier.parquet'")
    names = [n for n in sql if hasattr(steps, n)]
    assert len(names) >= 20 and all(con.execute(f"SELECT count(*) FROM ({sql[n]})").fetchone()[0] for n in names)


def test_entry_without_the_optional_part(tmp_path):
    """Without its folders, or with an empty one left behind, the other queries are there."""
    import shutil
    import subprocess
    import sys

    from .conftest import ROOT

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    for leave in (False, True):
        if leave:
            (copy / "sigilframe" / "llm").mkdir()
            (copy / "corpus_pipeline.py").write_text("from sigilframe.llm import quality\n")
        out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=copy, capture_output=True, text=True)
        assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))], out.stderr
