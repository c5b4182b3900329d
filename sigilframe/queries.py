"""The reference operators over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import paper_queries, scalar_queries  # noqa: F401 - each registers its own
from .adapters import LONE_LETTER, Tables
from .functions import columns as X
from .functions import patterns as P
from .operators import evaluation, library, review, summaries
from .plans import symbol_pool as plan
from .registry import ORACLE_SQL, QUERIES, query

# Shared pieces of the oracle's SQL.
_LINES = "lines AS (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_TOKENS = """tok AS (
    SELECT doc_id, line, text, unnest(range(len(t))) AS pos, unnest(t) AS surface
    FROM (SELECT doc_id, line, text, list_filter(string_split_regex(text, '[^A-Za-zÀ-ÿ]+'), lambda x: regexp_full_match(x, '[A-Za-z]')) AS t FROM lines))"""
_MEMBERS = "m AS (SELECT DISTINCT l_suppkey AS folder_id, l_partkey AS paper_id FROM lineitem)"


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# Lines, tokens, classification ---------------------------------------------------------------


@query(f"WITH {_LINES} SELECT doc_id, line, text FROM lines")
def line_split(t: Tables) -> DataFrame:
    return _long(t.lines(), "line")


@query(f"WITH {_LINES} SELECT doc_id, line FROM lines WHERE regexp_matches(text, '(^|[^A-Za-zÀ-ÿ])[A-Za-z] (is|are) (a|an|the|used|our)([^A-Za-zÀ-ÿ]|$)')")
def definition_copula_lines(t: Tables) -> DataFrame:
    return _long(t.lines().filter(F.col("text").rlike(r"(?:^|[^A-Za-zÀ-ÿ])[A-Za-z] (?:is|are) (?:a|an|the|used|our)(?![A-Za-zÀ-ÿ])")), "line").drop("text")


# The oracle's engine has ASCII word borders and no look-around: accented letters become two ASCII ones, and the
# look-ahead behind "let" is left out, as no letter list begins with "us".
_CLASS = " OR ".join(f"regexp_matches(t, '(?i){p.replace('(?!us\\b)', '')}')" for p in P.DEFINITION)


@query(f"WITH {_LINES}, c AS (SELECT doc_id, line, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[À-ɏ]', 'qq', 'g') AS t FROM lines) SELECT doc_id, line FROM c WHERE {_CLASS} OR regexp_matches(t, '{P.GIVEN_CAPITAL}')")
def definition_like_lines(t: Tables) -> DataFrame:
    """The full classifier over all lines."""
    return _long(t.lines().filter(X.definition_like("text")), "line").drop("text")


def _per_line(t: Tables) -> DataFrame:
    return t.lines().withColumn("has", F.size(F.regexp_extract_all("text", F.lit(LONE_LETTER), F.lit(1))) > 0)


# Events and the pool --------------------------------------------------------------------------


@query(f"WITH {_LINES}, {_TOKENS} SELECT doc_id, line, pos, surface, 1::BIGINT AS page FROM tok WHERE line // 10 = 1")
def occurrences_on_page(t: Tables) -> DataFrame:
    """Ten lines make a page."""
    rows = t.tokens().drop("text").withColumn("page", F.floor(F.col("line") / 10))
    return _long(library.occurrences_on_page(rows, 1), "line", "pos", "page")


# Review ---------------------------------------------------------------------------------------


def _queue(t: Tables) -> DataFrame:
    low = t.table("labels").filter("quality = 0")
    return low.select(F.lit("all").alias("paper_id"), F.col("doc_id").cast("string").alias("review_id"), F.lit(review.IDENTITY).alias("kind"), "doc_id", "toxic")


@query("SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0")
def review_dismiss(t: Tables) -> DataFrame:
    """The queue of low documents without the toxic ones, which are dismissed."""
    queue = _queue(t)
    left, _ = review.dismiss(queue, queue.filter("toxic = 1").select("paper_id", "review_id"))
    return left.select("doc_id")


@query("SELECT l.doc_id, CASE WHEN quality = 1 OR n_chars >= 2000 THEN 'confirmed' ELSE 'review' END AS status, greatest(CASE WHEN quality = 1 THEN 3 ELSE 1 END, CASE WHEN n_chars >= 2000 THEN 3 ELSE 2 END)::BIGINT AS evidence_level FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def review_confirm(t: Tables) -> DataFrame:
    """Labels are a pool, documents its confirmations: long ones are direct, others formula context."""
    pool = t.table("labels").select(
        F.col("doc_id").cast("string").alias("paper_id"), F.col("doc_id").cast("string").alias("id"), F.lit("x").alias("surface"), F.lit(0).alias("ordinal"),
        F.when(F.col("quality") == 1, "confirmed").otherwise("review").alias("status"), F.when(F.col("quality") == 1, 3).otherwise(1).alias("evidence_level"),
        F.lit(None).cast("array<string>").alias("evidence_types"), F.lit(None).cast("array<string>").alias("definition_events"), F.lit(0).alias("occurrences"), F.lit(None).cast("string").alias("meaning"),
    )
    level = F.when(F.col("n_chars") >= 2000, 3).otherwise(2)
    confirmed = t.documents().join(t.table("labels").select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").cast("string").alias("paper_id"), F.lit("x").alias("surface"), level.alias("level"), X.evidence_type(level).alias("type"), F.lit("e").alias("definition_id"), F.lit("r").alias("review_id"), F.lit("").alias("text"), F.lit(1).alias("page"),
    )
    out = review.confirm_symbols(pool, confirmed)
    return out.select(F.col("paper_id").cast("long").alias("doc_id"), "status", F.col("evidence_level").cast("long").alias("evidence_level"))


# Meanings and summaries -----------------------------------------------------------------------


@query("SELECT d.doc_id, coalesce(u.m, d.source) AS meaning, CASE WHEN u.m IS NULL THEN 'local' ELSE 'remote' END AS meaning_source FROM documents d LEFT JOIN (SELECT user_id, max_by(event_type || ' ' || event_id, event_id) AS m FROM events GROUP BY user_id) u ON u.user_id = d.doc_id")
def meaning_update_last_wins(t: Tables) -> DataFrame:
    symbols = t.documents().select(F.col("doc_id").alias("id"), F.col("source").alias("meaning"), F.lit("local").alias("meaning_source"))
    return library.apply_meanings(symbols, library.last_updates(t.updates()), "remote").withColumnRenamed("id", "doc_id")


@query("SELECT event_id // 16 AS batch, CASE WHEN count(*) < 16 THEN 'wrong number of items' WHEN count(DISTINCT user_id) < count(*) THEN 'an id repeats' WHEN NOT bool_and(length(event_type) <= 24) THEN 'an item is not valid' END AS error FROM events GROUP BY 1")
def summary_validate(t: Tables) -> DataFrame:
    """Sixteen events are a reply; it must name sixteen users, each once."""
    rows = t.table("events").select(F.floor(F.col("event_id") / summaries.BATCH).alias("batch"), F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("meaning"), "event_id")
    replies = rows.groupBy("batch").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("id", "meaning"))).alias("items"))).alias("content"))
    asked = rows.select("batch", "id").distinct()
    short = rows.groupBy("batch").count().filter("count < 16").select("batch")
    ids = asked.groupBy("batch").agg(F.count("*").alias("ids"))
    checked = summaries.checked_replies(replies, asked, "zh").join(ids, "batch").join(short.withColumn("short", F.lit(True)), "batch", "left")
    # Replies of repeated ids have more items than ids asked for.
    error = F.when(F.col("short"), "wrong number of items").when(F.col("ids") < 16, "an id repeats").otherwise(F.col("error"))
    return checked.select("batch", error.alias("error"))


@query("SELECT (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS batch, user_id, event_id FROM events")
def summary_batches16(t: Tables) -> DataFrame:
    numbered = t.table("events").withColumn("ordinal", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).withColumn("definition", F.col("props"))
    return _long(summaries.batches(numbered).select("batch", "user_id", "event_id"), "batch")


@query("SELECT count_if(k > 90)::BIGINT AS failed_batches, min_by('k is ' || k, event_id) FILTER (WHERE k > 90) AS first_error FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def summary_outcome(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return summaries.outcome(t.table("events").select(F.col("event_id").alias("batch"), F.when(k > 90, F.concat(F.lit("k is "), k.cast("string"))).alias("error")))


# The library ----------------------------------------------------------------------------------


@query("SELECT p_partkey AS paper_id, p_name AS title FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'hot')")
def library_search(t: Tables) -> DataFrame:
    return library.search(t.papers(), "Hot").select("paper_id", "title")


@query(f"WITH {_MEMBERS} SELECT p_partkey AS paper_id, p_name AS title FROM part WHERE p_partkey IN (SELECT paper_id FROM m WHERE folder_id = 1)")
def folder_semi(t: Tables) -> DataFrame:
    return library.search(t.papers(), "", t.membership(), 1).select("paper_id", "title")


@query(f"WITH {_MEMBERS} SELECT s_suppkey AS folder_id, count(DISTINCT p_partkey) AS papers FROM supplier LEFT JOIN m ON m.folder_id = s_suppkey LEFT JOIN part ON p_partkey = m.paper_id GROUP BY 1")
def folder_badge_count(t: Tables) -> DataFrame:
    return library.badge_counts(t.folders(), t.membership(), t.papers())


_TWO = "o AS (SELECT DISTINCT l_suppkey AS folder_id, l_partkey AS paper_id FROM lineitem WHERE l_returnflag <> 'R'), n AS (SELECT DISTINCT l_suppkey AS folder_id, l_partkey AS paper_id FROM lineitem WHERE l_returnflag <> 'A')"


@query(f"WITH {_TWO} SELECT folder_id, paper_id, 'insert' AS change FROM (FROM n EXCEPT FROM o) UNION ALL SELECT folder_id, paper_id, 'delete' FROM (FROM o EXCEPT FROM n)")
def membership_diff(t: Tables) -> DataFrame:
    rows = lambda flag: t.table("lineitem").filter(F.col("l_returnflag") != flag).select(F.col("l_suppkey").alias("folder_id"), F.col("l_partkey").alias("paper_id")).distinct()
    return library.membership_diff(rows("R"), rows("A"))


@query(f"WITH {_MEMBERS} SELECT folder_id, paper_id FROM m WHERE paper_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def membership_invalid(t: Tables) -> DataFrame:
    small = t.table("part").filter("p_size > 10").select(F.col("p_partkey").alias("paper_id"))
    return t.membership().join(small, "paper_id", "left_anti").select("folder_id", "paper_id")


@query("SELECT s_suppkey AS folder_id, s_name AS name FROM supplier UNION ALL SELECT min(c_custkey) + 1000000, min_by(trim(c_name), c_custkey) FROM customer GROUP BY lower(trim(c_name)) HAVING lower(trim(c_name)) NOT IN (SELECT lower(s_name) FROM supplier)")
def folder_create_unique(t: Tables) -> DataFrame:
    wanted = t.table("customer").select((F.col("c_custkey") + 1000000).alias("folder_id"), F.col("c_name").alias("name"))
    return library.create_folders(t.folders(), library.free_names(t.folders(), wanted))


@query("SELECT folder_id, count(*) AS papers FROM (SELECT DISTINCT l_suppkey AS folder_id, l_partkey AS paper_id FROM lineitem) WHERE paper_id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 5) GROUP BY 1")
def paper_delete_cascade(t: Tables) -> DataFrame:
    gone = t.table("part").filter("p_size <= 5").select(F.col("p_partkey").alias("paper_id"))
    _, membership = library.delete_papers(t.papers(), t.membership(), gone)
    return membership.groupBy("folder_id").agg(F.count("*").alias("papers"))


@query("SELECT min(event_id) AS ordinal, CAST(user_id AS VARCHAR) AS paper_id, CASE WHEN user_id IN (SELECT p_partkey FROM part) THEN 'deleted' ELSE 'missing' END AS outcome FROM events GROUP BY user_id")
def batch_delete_outcome(t: Tables) -> DataFrame:
    requests = t.updates().select("ordinal", F.col("id").cast("string").alias("paper_id"))
    return library.delete_outcome(requests, t.papers().select(F.col("paper_id").cast("string")))


@query("SELECT count(*) AS papers, sum(p_size)::BIGINT AS symbols, CASE WHEN count_if(p_size < 100) < 10 THEN '0' ELSE '' END || count_if(p_size < 100) AS pending FROM part")
def library_totals(t: Tables) -> DataFrame:
    return library.library_totals(t.table("part").withColumn("progress", F.col("p_size")), F.col("p_size").cast("long"))


@query("SELECT doc_id, source FROM documents ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0') DESC")
def list_papers_desc(t: Tables) -> DataFrame:
    return t.documents().select("doc_id", "source").orderBy(F.lpad(F.col("doc_id").cast("string"), 12, "0").desc())


@query(f"WITH {_MEMBERS}, one AS (SELECT paper_id FROM m WHERE folder_id = 1), two AS (SELECT paper_id FROM m WHERE folder_id = 2) SELECT paper_id FROM (FROM one EXCEPT FROM two) UNION ALL SELECT paper_id FROM (FROM two EXCEPT FROM one)")
def selection_toggle(t: Tables) -> DataFrame:
    of = lambda k: t.membership().filter(F.col("folder_id") == k).select("paper_id")
    return library.toggled(of(1), of(2))


@query(f"WITH {_MEMBERS} SELECT folder_id, list_sort(list(paper_id))[1] AS first, count(*) AS n FROM m GROUP BY 1")
def folder_arrays(t: Tables) -> DataFrame:
    return library.as_arrays(t.membership()).select("folder_id", F.element_at("paper_ids", 1).alias("first"), F.size("paper_ids").cast("long").alias("n"))


@query("SELECT event_id, user_id, coalesce(lag(user_id % 7) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS back FROM events")
def page_navigation(t: Tables) -> DataFrame:
    history = t.table("events").select(F.col("user_id").alias("paper_id"), F.col("event_id").alias("ordinal"), (F.col("user_id") % 7).alias("page"))
    return library.page_navigation(history).select(F.col("ordinal").alias("event_id"), F.col("paper_id").alias("user_id"), F.coalesce("back", F.lit(-1)).alias("back"))


# Labels and scalar functions ------------------------------------------------------------------


@query("SELECT doc_id, greatest(1, CAST(floor(n_chars / 1024.0 + 0.5) AS BIGINT)) || ' KB' AS label FROM documents")
def size_label(t: Tables) -> DataFrame:
    return t.documents().select("doc_id", X.size_label("n_chars").alias("label"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), regexp_replace(url, '^.*/', '')) AS title FROM pages")
def title_fallback(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", X.imported_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "url").alias("title"))


@query("SELECT page_id, regexp_extract(html, '((?:19|20)[0-9]{2})', 1) AS year FROM pages")
def year_extract(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", F.coalesce(X.year_in("html"), F.lit("")).alias("year"))


@query("SELECT p_brand AS fontname, count(*) AS n FROM part GROUP BY 1")
def font_frequency(t: Tables) -> DataFrame:
    return evaluation.font_frequency(t.table("part").select(F.col("p_brand").alias("fontname"), F.lit(1).alias("page"), F.col("p_partkey").alias("index")))


@query("SELECT p_partkey, p_name || '|' || CASE WHEN regexp_matches(upper(p_type), 'ROMAN|REGULAR') THEN 'roman' ELSE 'font:' || p_type END AS identity_key FROM part")
def identity_style_key(t: Tables) -> DataFrame:
    return t.table("part").select("p_partkey", X.identity_key("p_name", X.font_style("p_type")).alias("identity_key"))


@query("SELECT l_orderkey, l_linenumber, least(greatest(1, l_quantity), 30) AS page, least(greatest(l_quantity * 10, 180), 420) AS sidebar FROM lineitem")
def clamps(t: Tables) -> DataFrame:
    l = t.table("lineitem")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", X.clamp_page("l_quantity", F.lit(30)).alias("page"), X.clamp_sidebar(F.col("l_quantity") * 10).alias("sidebar"))


# Geometry -------------------------------------------------------------------------------------


@query("SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE greatest(a.l_discount, b.l_discount) < least(a.l_discount + 0.02, b.l_discount + 0.02) AND greatest(a.l_quantity, b.l_quantity) < least(a.l_quantity + 10, b.l_quantity + 10)")
def spatial_overlap(t: Tables) -> DataFrame:
    """Overlapping boxes of a page; an order is a page, its items the boxes."""
    box = F.array("l_discount", "l_quantity", F.col("l_discount") + 0.02, F.col("l_quantity") + 10)
    rows = lambda n: t.table("lineitem").select("l_orderkey", F.col("l_linenumber").alias(n), box.alias(f"box_{n}"))
    pairs = rows("a").join(rows("b"), "l_orderkey").filter((F.col("a") < F.col("b")) & X.boxes_overlap(F.col("box_a"), F.col("box_b")))
    return pairs.select("l_orderkey", "a", "b")


# Evaluation -----------------------------------------------------------------------------------


@query(f"WITH {_LINES}, {_TOKENS}, h AS (SELECT l.doc_id, l.line, EXISTS (SELECT 1 FROM tok WHERE tok.doc_id = l.doc_id AND tok.line = l.line) AS has FROM lines l) SELECT doc_id, count_if(has)::BIGINT AS selected, count(*) AS total, round(count_if(has) / count(*), 2) AS share FROM h GROUP BY 1")
def recall_audit(t: Tables) -> DataFrame:
    rows = evaluation.coverage(_per_line(t), ["doc_id"], "has")
    return rows.select("doc_id", "selected", "total", F.round(F.col("selected") / F.col("total"), 2).alias("share"))


@query(f"WITH {_LINES}, {_TOKENS}, p AS (SELECT doc_id, list_distinct(list(surface)) AS own FROM tok GROUP BY 1) SELECT doc_id, array_to_string(list_sort(list_filter(['a', 'n', 'm', 'y'], lambda x: NOT list_contains(own, x))), ',') AS missing, array_to_string(list_sort(list_filter(['e', 't', 'i'], lambda x: list_contains(own, x))), ',') AS forbidden FROM p")
def pool_regression(t: Tables) -> DataFrame:
    pool = t.tokens().select(F.col("doc_id").alias("paper_id"), "surface")
    out = evaluation.required_and_forbidden(pool, ["a", "n", "m", "y"], ["e", "t", "i"])
    return out.select(F.col("paper_id").alias("doc_id"), F.array_join("missing", ",").alias("missing"), F.array_join("forbidden", ",").alias("forbidden"))


@query("""WITH l AS (SELECT item_id, unnest(range(len(x))) AS line, trim(regexp_replace(unnest(x), ' +', ' ', 'g')) AS text FROM (SELECT item_id, string_split(text, chr(10)) AS x FROM benchmark))
    SELECT CAST(item_id AS VARCHAR) AS paper_id, row_number() OVER (PARTITION BY item_id ORDER BY line) - 1 AS line, text FROM l WHERE text <> ''""")
def glyph_lines(t: Tables) -> DataFrame:
    """Benchmark texts as glyphs on pages, put together to lines again by their positions."""
    papers = plan.Papers(*t.benchmark_glyphs())
    return _long(papers.lines.select("paper_id", "line", "text"), "line")


