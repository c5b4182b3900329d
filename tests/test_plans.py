"""Plans: pruned scans, pushed filters, no nested-loop joins, no row-at-a-time Python."""

import re

import pytest

from sigilframe.adapters import Tables
from sigilframe.queries import QUERIES

from .conftest import DATA

SF = str(DATA / "sf0.001")


def plan_of(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize("name,columns", [
    ("line_split", {"doc_id", "text"}),
    ("size_label", {"doc_id", "n_chars"}),
    ("library_search", {"p_partkey", "p_name", "p_brand", "p_type"}),
    ("folder_arrays", {"l_suppkey", "l_partkey"}),
    ("spatial_overlap", {"l_orderkey", "l_linenumber", "l_discount", "l_quantity"}),
])
def test_only_needed_columns_are_read(spark, name, columns):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES[name](spark, SF)))
    read = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert read == columns


def test_filters_reach_the_scan(spark):
    assert "EqualTo(l_suppkey,1)" in plan_of(QUERIES["folder_semi"](spark, SF))
    assert "EqualTo(quality,0)" in plan_of(QUERIES["review_dismiss"](spark, SF))
    assert "LessThanOrEqual(p_size,5)" in plan_of(QUERIES["paper_delete_cascade"](spark, SF))


def test_aggregates_combine_before_the_shuffle(spark):
    assert "partial_count" in plan_of(QUERIES["paper_delete_cascade"](spark, SF))


def test_written_pages_are_read_by_column(spark):
    """Every table of the papers reads what it needs of the written pages, and no plan parses them again."""
    text = plan_of(QUERIES["page_lines"](spark, SF))
    assert "FlatMapGroupsInPandas" not in text and "candidates" not in text and "Scan parquet" in text


@pytest.mark.parametrize("name", ["formula_candidates", "surface_counts"])
def test_candidates_are_found_in_their_page(spark, name):
    """No table of lines is joined to the glyphs, so the driver holds none for a broadcast."""
    tree = plan_of(QUERIES[name](spark, SF)).split("\n\n")[0]
    assert "Join" not in tree and tree.count("Exchange") <= 1


def test_totals_are_not_broadcast(spark):
    """Parts of a size with the papers meet where they are dealt, whatever the planner thinks of packed files."""
    assert "Broadcast" not in plan_of(QUERIES["paper_totals"](spark, SF))


@pytest.mark.parametrize("name", ["gold_recall", "gold_report"])
def test_recall_broadcasts_no_glyphs(spark, name):
    """Glyphs unpacked from pages are dealt by their keys, and three times in all: near the passage, on events' lines, in events' boxes."""
    tree = plan_of(QUERIES[name](spark, SF)).split("\n\n")[0]
    assert "Broadcast" not in tree and tree.count("Scan parquet") <= 16


def test_the_first_glyphs_are_cut_before_the_shuffle(spark):
    tree = plan_of(QUERIES["glyph_inventory"](spark, SF))
    assert "WindowGroupLimit" in tree


def test_pages_are_shuffled_once_for_each_pass(spark):
    """The gutter pass moves positions only; grouping reuses the partitioning of its join."""
    from sigilframe.plans import symbol_pool as plan

    glyphs, pages = Tables(spark, SF).benchmark_glyphs()
    text = plan_of(plan.page_boundaries(plan.decoded_glyphs(glyphs, None), pages))
    assert text.count("FlatMapGroupsInPandas") >= 1
    tree = text.split("\n\n")[0]
    assert tree.count("Exchange") <= 3


def test_rows_of_pages_are_not_broadcast(spark):
    """Widths and gutters grow with the papers: they meet the glyphs by sort-merge, in the shuffle that groups them."""
    from sigilframe.plans import symbol_pool as plan

    glyphs, pages = Tables(spark, SF).benchmark_glyphs()
    decoded = plan.decoded_glyphs(glyphs, None)
    boundaries = spark.createDataFrame([("1", 1, None)], "paper_id string, page int, boundary double")
    for df, exchanges in ((plan.page_boundaries(decoded, pages), 3), (plan.parse_pages(decoded, boundaries), 4)):
        tree = plan_of(df).split("\n\n")[0]
        assert "Broadcast" not in tree and "SortMergeJoin" in tree and tree.count("Exchange") <= exchanges
