"""Scalar rules, sources and small commands over the driver's tables, with SQL that states the same rule anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .adapters import Tables
from .functions import columns as X
from .manuscripts import LEFT, SQL, manuscripts
from .operators import evaluation, library, review
from .paper_queries import papers
from .plans import symbol_pool as plan
from .registry import query
from .sources import documents

_NAMED = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || '.pdf' ELSE '/in/ ' || p_brand || '  - ' || (1950 + p_partkey % 80) || ' - ' || p_name || ' .pdf' END AS name, * FROM part"


def _files(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    named = F.concat(F.lit("/in/ "), "p_brand", F.lit("  - "), (1950 + key % 80).cast("string"), F.lit(" - "), "p_name", F.lit(" .pdf"))
    return t.table("part").select("*", F.when(key % 5 == 0, F.concat("p_name", F.lit(".pdf"))).otherwise(named).alias("name"))


# Names, titles, labels ----------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS authors, CASE WHEN p_partkey % 5 > 0 THEN CAST(1950 + p_partkey % 80 AS VARCHAR) END AS year, CASE WHEN p_partkey % 5 > 0 THEN trim(p_name) END AS title FROM part")
def filename_parts(t: Tables) -> DataFrame:
    """Authors, year and title of file names that have all three."""
    return _files(t).select("p_partkey", X.filename_metadata("name").alias("m")).select("p_partkey", "m.authors", "m.year", "m.title")


@query(f"""WITH f AS ({_NAMED}) SELECT CAST(p_partkey AS VARCHAR) AS paper_id, CASE WHEN p_partkey % 3 = 1 THEN p_type WHEN p_partkey % 5 > 0 THEN trim(p_name) ELSE p_name END AS title,
    CASE WHEN p_partkey % 2 = 0 THEN p_container WHEN p_partkey % 5 > 0 THEN p_brand ELSE '' END AS authors, CASE WHEN p_partkey % 5 > 0 THEN CAST(1950 + p_partkey % 80 AS VARCHAR) WHEN p_partkey % 7 = 0 THEN '2011' ELSE '' END AS year FROM f""".replace("p_container", "'J. Doe'"))
def import_metadata(t: Tables) -> DataFrame:
    """Title, authors and year from the document, else its file name, else its first page."""
    key, none = F.col("p_partkey"), F.lit(None).cast("string")
    files = _files(t).select(
        key.cast("string").alias("paper_id"), "name", F.when(key % 3 == 0, " Untitled").when(key % 3 == 1, F.col("p_type")).alias("title"), none.alias("subject"), F.when(key % 2 == 0, " J. Doe ").otherwise(" ").alias("author"),
        none.alias("producer"), none.alias("creator"), F.when(key % 7 == 0, "Received 3 May 2011, revised 2012").otherwise("no date").alias("first_page"), F.lit(1).alias("pages"), F.lit(1).alias("file_size"),
    )
    return documents.metadata(files).select("paper_id", "title", "authors", "year")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'review' ELSE 'confirmed' END AS view, '第 ' || l_linenumber || ' 页' AS label, l_linenumber::INT AS page, CASE WHEN l_linenumber >= 3 THEN 'direct_definition' WHEN l_linenumber = 2 THEN 'formula_context' ELSE 'event_context' END AS evidence,
    CASE WHEN l_returnflag = 'N' THEN 'Unknown author' ELSE l_returnflag END AS authors FROM lineitem""")
def display_labels(t: Tables) -> DataFrame:
    """What a viewer shows of a status, a page, a level and an author; page labels are read back."""
    l, flag = t.table("lineitem"), F.col("l_returnflag")  # noqa: E741
    status = F.when(flag == "R", "unresolved").otherwise("confirmed")
    label = X.page_label("l_linenumber")
    shown = F.when(flag == "N", " ").otherwise(flag)
    return l.select("l_orderkey", "l_linenumber", X.view_status(status).alias("view"), label.alias("label"), X.page_of_label(label).alias("page"), X.evidence_type("l_linenumber").alias("evidence"), X.display_authors(shown).alias("authors"))


@query(r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '\alpha ' WHEN 1 THEN 'x_{i}^{2}' WHEN 2 THEN CASE p_size % 3 WHEN 0 THEN '\mathbf{N}' WHEN 1 THEN '\mathbb{N}' ELSE 'N' END ELSE '\nabla f_{k}\in \Omega ' END AS latex FROM part""".replace(r"WHEN 0 THEN '\alpha '", r"WHEN 0 THEN CASE p_size % 3 WHEN 0 THEN '\mathbf{\alpha }' WHEN 1 THEN '\mathbb{\alpha }' ELSE '\alpha ' END"))
def latex_surfaces(t: Tables) -> DataFrame:
    """Surfaces as LaTeX, with the command of a lone character's style."""
    key = F.col("p_partkey") % 4
    surface = F.when(key == 0, "α").when(key == 1, "x_i^2").when(key == 2, "N").otherwise("∇f_k∈Ω")
    style = F.when(F.col("p_size") % 3 == 0, "bold").when(F.col("p_size") % 3 == 1, "blackboard").otherwise("italic")
    return t.table("part").select("p_partkey", X.latex_surface(surface, style).alias("latex"))


@query('SELECT l_orderkey, l_linenumber, l_quantity / 600.0::DOUBLE * 100 AS "left", l_linenumber / 800.0::DOUBLE * 100 AS top, greatest(0.8, (l_quantity + l_linenumber - l_quantity) / 600.0::DOUBLE * 100) AS width, greatest(1.2, (l_linenumber + 20.0 - l_linenumber) / 800.0::DOUBLE * 100) AS height FROM lineitem')
def hotspots(t: Tables) -> DataFrame:
    """Boxes in percent of their page, with the least size a pointer can hit."""
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    box = F.array(q, n, q + n, n + 20.0)
    return t.table("lineitem").select("l_orderkey", "l_linenumber", X.hotspot(box, F.lit(600.0), F.lit(800.0)).alias("h")).select("l_orderkey", "l_linenumber", "h.left", "h.top", "h.width", "h.height")


# Policies -----------------------------------------------------------------------------------------

_IDS = "id_ AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'paper-' || c_custkey WHEN 1 THEN c_name WHEN 2 THEN '../' || c_custkey ELSE '' END AS id FROM customer)"


@query(f"WITH {_IDS} SELECT c_custkey, regexp_full_match(id, '[A-Za-z0-9-]+') AS safe, CASE WHEN regexp_full_match(id, '[A-Za-z0-9-]+') THEN '/lib/' || id || '.pdf' END AS pdf, length(id) BETWEEN 1 AND 80 AS folder, length(id) BETWEEN 1 AND 32 AS surface, length(id) BETWEEN 1 AND 240 AS title FROM id_")
def id_policies(t: Tables) -> DataFrame:
    """Which strings may be ids, folder names, surfaces and titles, and where a paper's file is."""
    key = F.col("c_custkey")
    made = F.when(key % 4 == 0, F.concat(F.lit("paper-"), key.cast("string"))).when(key % 4 == 1, F.col("c_name")).when(key % 4 == 2, F.concat(F.lit("../"), key.cast("string"))).otherwise("")
    rows = t.table("customer").select("c_custkey", made.alias("id"))
    return rows.select("c_custkey", X.safe_paper_id("id").alias("safe"), X.stored_paths("id", "/lib")["pdf"].alias("pdf"), X.valid_folder_name("id").alias("folder"), X.valid_surface("id").alias("surface"), X.valid_title("id").alias("title"))


@query("SELECT page_id, regexp_matches(u, '^https://[^/\\s]+') OR regexp_matches(u, '^http://(localhost|127\\.0\\.0\\.1)(:[0-9]+)?(/|$)') AS allowed FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https' || regexp_replace(url, '^https?', '') WHEN 1 THEN 'http' || regexp_replace(url, '^https?', '') WHEN 2 THEN 'http://localhost:80/v1' ELSE 'http://localhost.example/v1' END AS u FROM pages)")
def endpoint_policy(t: Tables) -> DataFrame:
    """Model endpoints are HTTPS, or on the loopback host."""
    rest, key = F.regexp_replace("url", "^https?", ""), F.col("page_id") % 4
    url = F.when(key == 0, F.concat(F.lit("https"), rest)).when(key == 1, F.concat(F.lit("http"), rest)).when(key == 2, "http://localhost:80/v1").otherwise("http://localhost.example/v1")
    return t.table("pages").withColumn("u", url).select("page_id", documents.allowed_endpoint("u").alias("allowed"))


@query("SELECT 'rejected' AS kind, count_if(NOT (page_id % 3 = 0 OR page_id % 5 = 0))::BIGINT AS n FROM pages UNION ALL SELECT 'accepted', count_if(page_id % 3 = 0 OR page_id % 5 = 0)::BIGINT FROM pages")
def upload_split(t: Tables) -> DataFrame:
    """Uploads told by name or MIME type, and how many there are of each kind."""
    key = F.col("page_id")
    files = t.table("pages").select(F.concat(F.lit("f"), F.when(key % 3 == 0, ".PDF").otherwise(".txt")).alias("name"), F.when(key % 5 == 0, "application/pdf").alias("mime"))
    kept, rejected = documents.split_uploads(files)
    return rejected.select(F.lit("rejected").alias("kind"), F.col("rejected").alias("n")).union(kept.agg(F.lit("accepted"), F.count("*")))


@query("SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'missing' WHEN page_id % 4 = 2 THEN 'not a PDF' WHEN page_id % 3 = 0 THEN 'no pages' WHEN page_id % 5 = 0 THEN 'page counts differ' END AS error FROM pages")
def pdf_checks(t: Tables) -> DataFrame:
    """Why a file is turned away, by its first bytes and its page counts."""
    key = F.col("page_id")
    content = F.when(key % 4 < 2, F.concat(F.lit("%PDF-1.7"), F.coalesce("url", F.lit("")))).when(key % 4 == 2, "PK  zip").cast("binary")
    return documents.validated(t.table("pages").select("page_id", content.alias("content"), F.when(key % 3 > 0, 2).otherwise(0).alias("pages"), F.when(key % 5 == 0, 3).otherwise(2).alias("pages_check"))).select("page_id", "error")


@query("SELECT page_id, md5('data:image/png;base64,' || base64(encode(coalesce(html, '')))) AS url FROM pages")
def data_urls(t: Tables) -> DataFrame:
    rows = t.table("pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    return rows.select("page_id", F.md5(documents.as_data_url("content").cast("binary")).alias("url"))


# Images, character maps, fonts --------------------------------------------------------------------

_IMAGES = "image AS (SELECT l_orderkey, l_linenumber, l_linenumber * 20.0 AS x0, (l_quantity % 3) * 40.0 AS top, l_quantity * 4.0 AS w, l_linenumber * 2.0 AS h FROM lineitem)"


def _images(t: Tables) -> DataFrame:
    x0, top, w, h = F.col("l_linenumber") * 20.0, (F.col("l_quantity") % 3) * 40.0, F.col("l_quantity") * 4.0, F.col("l_linenumber") * 2.0
    return t.table("lineitem").select(
        F.col("l_orderkey").cast("string").alias("paper_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("index"), x0.cast("double").alias("x0"), top.cast("double").alias("top"), (x0 + 8).cast("double").alias("x1"), (top + 8).cast("double").alias("bottom"),
        w.cast("double").alias("width"), h.cast("double").alias("height"),
    )


@query(f"WITH {_IMAGES} SELECT CAST(l_orderkey AS VARCHAR) AS paper_id, 'image:' || l_linenumber AS region_id, CASE WHEN w < 100 AND h < 100 THEN 'image_or_glyph_mask' ELSE 'large_image' END AS kind FROM image WHERE w > 0 AND h > 0 AND w < 20 * h AND h < 20 * w")
def kept_images(t: Tables) -> DataFrame:
    """Images that are no rules or borders."""
    return documents.image_regions(_images(t)).select("paper_id", "region_id", "kind")


@query(f"""WITH {_IMAGES}, s AS (SELECT *, NOT coalesce(abs(top - lag(top) OVER o) <= 16 AND x0 - lag(x0 + 8) OVER o <= 18, false) AS new FROM image WINDOW o AS (PARTITION BY l_orderkey ORDER BY top, x0)),
    r AS (SELECT *, sum(new::INT) OVER (PARTITION BY l_orderkey ORDER BY top, x0) AS run FROM s) SELECT CAST(l_orderkey AS VARCHAR) AS paper_id, run::BIGINT AS run, count(*) AS images, min(x0)::DOUBLE AS x0, max(x0 + 8)::DOUBLE AS x1 FROM r GROUP BY 1, 2 HAVING count(*) >= 2""")
def image_runs(t: Tables) -> DataFrame:
    """Two or more masks on one baseline."""
    runs = documents.image_runs(_images(t))
    return runs.select("paper_id", "run", "images", F.col("bbox")[0].alias("x0"), F.col("bbox")[2].alias("x1"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS paper_id, code, ch FROM supplier, (VALUES (16, 'A'), (17, 'B'), (18, 'z'), (1, 'α')) v(code, ch)")
def cmap_codes(t: Tables) -> DataFrame:
    """Codes of character maps: ranges and single ones; a later line wins, broken lines do not count."""
    data = "beginbfrange\n<0010> <0012> <0041>\n<0020> <FFFF> <0041>\nendbfrange\n<02> <0041>\nbeginbfchar\n<01> <03B1>\n<0012> <007A>\n<03> junk\nendbfchar"
    maps = t.table("supplier").select(F.col("s_suppkey").cast("string").alias("paper_id"), F.lit("F").alias("font"), F.lit(1).alias("page"), F.lit(data).cast("binary").alias("data"))
    return documents.parse_cmaps(maps).select("paper_id", F.col("code").cast("int"), "ch")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS paper_id, font, code, ch FROM supplier, (VALUES ('ABCDEF+Foo', 1, 'late'), ('Foo', 1, 'late'), ('ABCDEF+Foo', 2, 'map'), ('Foo', 2, 'map'), ('ABCDEF+Foo', 3, 'named'), ('Foo', 3, 'own')) v(font, code, ch)")
def font_code_table(t: Tables) -> DataFrame:
    """Maps win over named differences, later pages over earlier ones, a font's full name over its family's."""
    s = t.table("supplier").select(F.col("s_suppkey").cast("string").alias("paper_id"))
    row = lambda r: F.struct(*(F.lit(v).alias(n) for n, v in zip(("font", "page", "code", "ch"), r)))
    spread = lambda *rows: s.select("paper_id", F.explode(F.array(*map(row, rows))).alias("r")).select("paper_id", "r.*")
    maps = spread(("ABCDEF+Foo", 1, 1, "early"), ("ABCDEF+Foo", 2, 1, "late"), ("ABCDEF+Foo", 1, 2, "map"), ("Foo", 1, 3, "own"))
    named = spread(("ABCDEF+Foo", 3, 2, "named"), ("ABCDEF+Foo", 1, 3, "named"), ("ABCDEF+Foo", 2, 3, "later"))
    return documents.font_codes(maps, named).select("paper_id", "font", "code", "ch")


# Symbols of the manuscripts -----------------------------------------------------------------------


@query(f"WITH {SQL} SELECT t.paper_id, t.token_id, 'symbol:' || q.identity_key || ':' || q.ordinal AS symbol_id FROM token t JOIN pool q ON q.paper_id = t.paper_id AND q.surface = t.surface AND q.style = t.style")
def symbol_at_token(t: Tables) -> DataFrame:
    """The symbol that a click on a token opens."""
    p = papers(t)
    return library.first_symbol_at(p.occurrences, p.pool)


@query(f"WITH {SQL} SELECT t.paper_id, t.token_id FROM token t JOIN pool q ON q.paper_id = t.paper_id AND q.surface = t.surface AND q.style = t.style WHERE t.page = 1 AND q.evidence_level >= 3")
def visible_occurrences(t: Tables) -> DataFrame:
    """Occurrences of the first page that belong to confirmed symbols, whichever name their identity has."""
    p = papers(t)
    named = lambda df, key: df.select("*", F.lit(None).cast("string").alias("identityKey")) if key == "identity_key" else df.withColumnRenamed("identity_key", "identityKey").withColumn("identity_key", F.lit(None).cast("string"))
    seen = named(library.occurrences_on_page(p.occurrences, 1), "identityKey")
    return library.visible_occurrences(seen, named(p.pool.filter("status = 'confirmed'"), "identity_key")).select("paper_id", "token_id")


@query(f"WITH {SQL} SELECT 'symbol:' || q.identity_key || ':' || q.ordinal AS id, q.surface, count(t.k) AS occurrences FROM pool q LEFT JOIN token t ON t.paper_id = q.paper_id AND t.surface = q.surface AND t.style = q.style WHERE q.ordinal > 0 GROUP BY q.paper_id, q.identity_key, q.ordinal, q.surface")
def other_symbols(t: Tables) -> DataFrame:
    """All symbols but each paper's first, with their counts."""
    first = F.concat(F.lit("symbol:"), F.char(F.lit(ord("A")) + F.col("paper_id").cast("long") % 13), F.lit("|italic:0"))
    return library.others_with_counts(papers(t).pool, first)


@query(f"WITH {SQL} SELECT paper_id, token_id, surface FROM token")
def symbol_surfaces(t: Tables) -> DataFrame:
    """Tokens whose surface may stand for a symbol."""
    o = papers(t).occurrences
    return o.select("paper_id", "token_id", X.symbol_surface("surface", "status", "kind").alias("surface")).filter("surface is not null")


_MATH = "m AS (SELECT paper_id, page, line, sum(length(replace(raw, ' ', '')))::BIGINT AS meaningful, sum(length(regexp_replace(raw, '[^§¤£○=+]', '', 'g')))::BIGINT AS math FROM part_ GROUP BY ALL)"


def _counted_lines(t: Tables) -> DataFrame:
    glyphs = plan.decoded_glyphs(*manuscripts(t.table("supplier"))[::2])
    math = X.is_math_glyph("decoded", "fontname", F.lit(False))
    return glyphs.groupBy("paper_id", "page", ((F.col("top") - 10) / 14).cast("long").alias("line")).agg(F.count_if(X.nonspace("decoded", "upright")).alias("meaningful"), F.count_if(math).alias("math"))


@query(f"WITH {SQL}, {_MATH} SELECT paper_id, page, line, meaningful, math FROM m")
def math_glyphs(t: Tables) -> DataFrame:
    """Visible and mathematical glyphs of each line."""
    return _counted_lines(t).select("paper_id", F.col("page").cast("long"), "line", "meaningful", "math")


@query(f"WITH {SQL}, {_MATH} SELECT paper_id, page, line FROM m WHERE meaningful >= 2 AND math >= 2 AND math / meaningful >= 0.35")
def math_lines(t: Tables) -> DataFrame:
    """Lines that are mostly mathematics."""
    return evaluation.math_dominant(_counted_lines(t)).select("paper_id", F.col("page").cast("long"), "line")


@query(f"WITH {SQL} SELECT paper_id, page, line * 1000 + i - 1 AS index, line FROM part_, range(1, 60) r(i) WHERE side = 0 AND i <= length(raw) AND substr(raw, i, 1) IN ('=', '+')")
def detached_operators(t: Tables) -> DataFrame:
    """The line that each operator glyph stands on, by its height alone."""
    operators = manuscripts(t.table("supplier"))[0].filter(F.col("text").isin("=", "+"))
    found = evaluation.detached_operators(operators, papers(t).lines)
    return found.select("paper_id", F.col("page").cast("long"), F.col("index").cast("long"), F.col("line").cast("long"))


@query(f"WITH {SQL} SELECT paper_id, raw FROM part_ WHERE x0_ = {LEFT} AND false".replace("x0_ = 40.0 AND false", "page = 1 AND line = 15"))
def boxes_over_areas(t: Tables) -> DataFrame:
    """Candidates whose box overlaps an audited area: the one over the lost glyph's line, told by its text."""
    p = papers(t)
    areas = p.pages.filter("page = 1").select(F.lit(1).alias("box_id"), "paper_id", "page", F.array(F.lit(0.0), F.lit(221.0), F.lit(600.0), F.lit(229.0)).alias("area"))
    hit = evaluation.in_boxes(p.candidates, areas)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("bbox")[0].alias("x"), "surface"))), lambda x: F.when(x["surface"] == "(cid:7)", "◊").when(x["surface"] == "=", "=").otherwise("£")), " ")
    return hit.groupBy("paper_id").agg(text.alias("raw"))


# Folders, titles, positions -----------------------------------------------------------------------

_MEMBERS = "m AS (SELECT DISTINCT l_suppkey AS folder_id, l_partkey AS paper_id FROM lineitem)"


def _counts(membership: DataFrame) -> DataFrame:
    return membership.groupBy("folder_id").agg(F.count("*").alias("papers"))


@query(f"WITH {_MEMBERS} SELECT folder_id, count(*) AS papers FROM m WHERE folder_id <> 1 GROUP BY 1")
def folder_deleted(t: Tables) -> DataFrame:
    return _counts(library.delete_folder(t.folders(), t.membership(), 1)[1])


@query(f"WITH {_MEMBERS} SELECT folder_id, count(*) - count_if(folder_id = 1 AND paper_id <= (SELECT min(paper_id) FROM m WHERE folder_id = 1))::BIGINT AS papers FROM m GROUP BY 1")
def folder_removed(t: Tables) -> DataFrame:
    """One paper leaves folder 1."""
    first = t.membership().filter("folder_id = 1").agg(F.min("paper_id").alias("paper_id"))
    return _counts(library.remove_from_folder(t.membership(), 1, first))


@query(f"WITH {_MEMBERS} SELECT folder_id, count(*) AS papers FROM (SELECT folder_id, paper_id FROM m WHERE paper_id <> 3 UNION ALL SELECT s_suppkey, 3 FROM supplier WHERE s_nationkey < 5) GROUP BY 1")
def folders_of_a_paper(t: Tables) -> DataFrame:
    """Paper 3 is put into the folders of five nations, and out of all others."""
    wanted = t.table("supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").alias("folder_id"))
    return _counts(library.set_paper_folders(t.membership(), t.folders(), 3, wanted))


@query(f"WITH {_MEMBERS} SELECT folder_id, count(*) AS papers FROM (FROM m UNION SELECT s_suppkey, p_partkey FROM supplier JOIN part ON p_partkey % 50 = s_suppkey % 50 AND p_size < 5) GROUP BY 1")
def references_added(t: Tables) -> DataFrame:
    """References are added once; those of folders that are gone are passed over."""
    small = t.table("part").filter("p_size < 5").select((F.col("p_partkey") % 50).alias("k"), F.col("p_partkey").alias("paper_id"))
    new = t.table("supplier").select((F.col("s_suppkey") % 50).alias("k"), F.col("s_suppkey").alias("folder_id")).join(small, "k").select("folder_id", "paper_id")
    gone = small.select((-5 - F.col("paper_id")).alias("folder_id"), "paper_id")
    return _counts(library.add_references(t.membership(), t.folders(), new.union(new).union(gone)))


@query("SELECT p_partkey AS paper_id, CASE WHEN p_size < 5 THEN 'New ' || p_partkey ELSE p_name END AS title FROM part")
def papers_renamed(t: Tables) -> DataFrame:
    titles = t.table("part").filter("p_size < 5").select(F.col("p_partkey").alias("paper_id"), F.concat(F.lit(" New "), F.col("p_partkey").cast("string"), F.lit(" ")).alias("title"))
    return library.rename_papers(t.papers(), titles).select("paper_id", "title")


@query("SELECT user_id AS paper_id, max(event_id % 9) FILTER (WHERE event_id = last) AS page FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last FROM events) GROUP BY 1 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_partkey NOT IN (SELECT user_id FROM events)")
def reading_positions(t: Tables) -> DataFrame:
    """Every paper's page; the last event of a paper wins."""
    held = t.table("part").select(F.col("p_partkey").alias("paper_id"), F.lit(1).cast("long").alias("page"))
    new = t.table("events").groupBy(F.col("user_id").alias("paper_id")).agg(F.max_by(F.col("event_id") % 9, "event_id").alias("page"))
    return library.upsert_positions(held, new)


@query("SELECT CAST(doc_id % 7 AS VARCHAR) AS paper_id, count_if(quality = 0)::BIGINT AS visual_review_items, count_if(toxic = 1)::BIGINT AS review_symbols FROM labels GROUP BY 1")
def review_counters(t: Tables) -> DataFrame:
    """Pending items and symbols under review."""
    labels = t.table("labels").withColumn("paper_id", (F.col("doc_id") % 7).cast("string"))
    return review.counters(labels.filter("quality = 0"), labels.withColumn("status", F.when(F.col("toxic") == 1, "review").otherwise("confirmed")))


@query("SELECT CAST(doc_id AS VARCHAR) AS gold_id, quality = 1 AS before, toxic = 0 AS after FROM labels")
def versions_compared(t: Tables) -> DataFrame:
    """Two versions' results of the same gold rows."""
    rows = lambda flag: t.table("labels").select(F.col("doc_id").cast("string").alias("gold_id"), flag.alias("found"))
    return evaluation.compare(rows(F.col("quality") == 1), rows(F.col("toxic") == 0), "found")
