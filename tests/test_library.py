"""Library commands, reviews, summaries, evaluation, sources and update streams."""

import json

import pytest
from pyspark.sql import functions as F

from sigilframe import schemas as S
from sigilframe.functions import columns as X
from sigilframe.operators import evaluation, library, review, summaries
from sigilframe.sources import documents
from sigilframe.streaming import updates as streams


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns or df.columns).collect()), key=str)


@pytest.fixture
def membership(spark):
    return table(spark, [("f", "a"), ("f", "b"), ("g", "a")], S.MEMBERSHIP)


@pytest.fixture
def folders(spark):
    return table(spark, [("f", "Read"), ("g", "Later")], S.FOLDER)


def ids(spark, *xs):
    return table(spark, [(x,) for x in xs], "paper_id string")


def test_remove_is_all_or_nothing(spark, membership):
    assert got(library.remove_from_folder(membership, "f", ids(spark, "a", "b"))) == [("g", "a")]
    for bad in (["a", "z"], ["a", "a"], [str(k) for k in range(513)]):
        with pytest.raises(library.Rejected):
            library.remove_from_folder(membership, "f", ids(spark, *bad))


def test_folders(spark, folders, membership):
    wanted = table(spark, [("n1", " READ "), ("n2", "New"), ("n3", "new"), ("n4", ""), ("n5", "x" * 81)], S.FOLDER)
    assert got(library.create_folders(folders, library.free_names(folders, wanted))) == [("f", "Read"), ("g", "Later"), ("n2", "New")]
    for bad in ([("n1", " READ ")], [("n2", "New"), ("n3", "new")], [("n4", "")], [("n5", "x" * 81)], [("n6", None)]):
        with pytest.raises(library.Rejected):
            library.create_folders(folders, table(spark, bad, S.FOLDER))
    left, members = library.delete_folder(folders, membership, "f")
    assert got(left) == [("g", "Later")] and got(members) == [("g", "a")]
    assert got(library.set_paper_folders(membership, folders, "a", table(spark, [("g",)], "folder_id string"))) == [("f", "b"), ("g", "a")]
    with pytest.raises(library.Rejected):
        library.set_paper_folders(membership, folders, "a", table(spark, [("h",)], "folder_id string"))
    new = table(spark, [("f", "a"), ("f", "c"), ("gone", "c")], S.MEMBERSHIP)
    assert got(library.add_references(membership, folders, new)) == [("f", "a"), ("f", "b"), ("f", "c"), ("g", "a")]
    assert ("g", "real") in got(library.replace_id(membership, "a", "real"))
    assert got(library.as_arrays(membership)) == [("f", ["a", "b"]), ("g", ["a"])]


def test_diff_and_badges(spark, folders, membership):
    desired = table(spark, [("f", "a"), ("g", "b")], S.MEMBERSHIP)
    assert got(library.membership_diff(membership, desired)) == [("f", "b", "delete"), ("g", "a", "delete"), ("g", "b", "insert")]
    assert got(library.badge_counts(folders, membership, ids(spark, "b"))) == [("f", 1), ("g", 0)]


def test_papers(spark, membership):
    papers = table(spark, [("a", "Sparse", "Lee", None, "ready"), ("b", "Dense", None, "Journal", "parsing")], "paper_id string, title string, authors string, venue string, parseStatus string")
    assert got(library.search(papers, " LEE "), "paper_id") == [("a",)] and library.search(papers, "").count() == 2
    assert got(library.search(papers, "", membership, "g"), "paper_id") == [("a",)]
    assert got(library.rename_papers(papers, table(spark, [("a", " New ")], "paper_id string, title string")), "paper_id", "title") == [("a", "New"), ("b", "Dense")]
    with pytest.raises(library.Rejected):
        library.rename_papers(papers, table(spark, [("a", " ")], "paper_id string, title string"))
    left, members = library.delete_papers(papers, membership, ids(spark, "a"))
    assert got(left, "paper_id") == [("b",)] and got(members, "folder_id", "paper_id") == [("f", "b")]
    requests = table(spark, [(0, "a"), (1, "../x"), (2, "a"), (3, "z")], "ordinal int, paper_id string")
    assert got(library.delete_outcome(requests, papers)) == [(0, "a", "deleted"), (1, "../x", "unsafe"), (3, "z", "missing")]
    assert library.all_selected(papers, ids(spark, "a")).first()[0] and not library.all_selected(papers, ids(spark)).first()[0]
    assert got(library.toggled(ids(spark, "a"), ids(spark, "a", "b"))) == [("b",)]


def test_meanings_last_wins(spark):
    symbols = table(spark, [("s", "old", "local"), ("t", "old", "local")], "id string, meaning string, meaning_source string")
    log = table(spark, [(0, "s", "one"), (1, "s", " two "), (2, "u", "x")], "ordinal int, id string, meaning string")
    assert got(library.update_meanings(symbols, log, "other")) == [("s", "two", "remote"), ("t", "old", "local")]
    with pytest.raises(library.Rejected):
        library.update_meanings(symbols, table(spark, [(0, "s", " ")], "ordinal int, id string, meaning string"))


@pytest.fixture
def review_tables(spark):
    queue = table(spark, [("P", 1, "p1:char3:identity", review.IDENTITY, "p1:line0", [0.0] * 4), ("P", 1, "p1:char9:identity", review.IDENTITY, "p1:line5", [0.0] * 4), ("P", 1, "x", "definition_without_text_math_token", "p1:line0", [0.0] * 4)], "paper_id string, page int, review_id string, kind string, line_id string, bbox array<double>")
    lines = table(spark, [("P", 1, "p1:line0", "where x is", [0.0] * 4, True), ("P", 1, "p1:line5", "a = b", [0.0] * 4, False)], "paper_id string, page int, line_id string, text string, bbox array<double>, definition_like boolean")
    events = table(spark, [("P", 1, 0, "p1:definition0", "where x is", ["p1:line0"])], "paper_id string, page int, ordinal int, definition_id string, text string, line_ids array<string>")
    symbols = table(spark, [("P", "symbol:x:0", "x", 0, "unresolved", 1, ["event_context"], ["e"], 2, "m")], "paper_id string, id string, surface string, ordinal int, status string, evidence_level int, evidence_types array<string>, definition_events array<string>, occurrences int, meaning string")
    return queue, lines, events, symbols


def test_confirm(spark, review_tables):
    queue, lines, events, symbols = review_tables
    said = table(spark, [("P", "p1:char3:identity", "x"), ("P", "p1:char9:identity", "q")], "paper_id string, review_id string, surface string")
    attached = review.attach(queue, lines, events, said)
    assert got(attached, "surface", "level", "definition_id", "is_new") == [("q", 2, "p1:visual-definition:p1:char9", True), ("x", 3, "p1:definition0", False)]
    assert review.new_events(attached).first().trigger == "visual_confirmation"
    out = {r.surface: r for r in review.confirm_symbols(symbols, attached).collect()}
    assert (out["x"].status, out["x"].evidence_level, out["x"].occurrences) == ("confirmed", 3, 3)
    assert (out["q"].status, out["q"].evidence_level, out["q"].id) == ("review", 2, "symbol:q:1")
    assert review.event_symbol_rows(attached).count() == 2


def test_dismiss_and_errors(spark, review_tables):
    queue, lines, events, symbols = review_tables
    one = table(spark, [("P", "p1:char3:identity")], "paper_id string, review_id string")
    left, resolved = review.dismiss(queue, one)
    assert left.count() == 2 and resolved.first().ignored
    assert review.counters(left, symbols).first().visual_review_items == 2
    for bad in ("nothing", "x"):
        with pytest.raises(library.Rejected):
            review.dismiss(queue, table(spark, [("P", bad)], "paper_id string, review_id string"))
    with pytest.raises(library.Rejected):
        review.attach(queue, lines, events, table(spark, [("P", "p1:char3:identity", "a b")], "paper_id string, review_id string, surface string"))


def test_completion(spark):
    plain = json.dumps({"choices": [{"message": {"content": "{}", "reasoning_content": "why"}}]})
    stream = 'data: {"choices":[{"delta":{"content":"a"}}]}\r\ndata: broken\ndata: {"choices":[{"delta":{"content":"b"}}]}\ndata: [DONE]'
    df = table(spark, [(plain,), (stream,), ("nonsense",)], "raw string").select(summaries.completion("raw").alias("c")).select("c.*")
    assert [tuple(r) for r in df.collect()] == [("{}", "why"), ("ab", ""), ("", "")]


def test_summary_checks(spark):
    asked = table(spark, [(b, i) for b in range(5) for i in ("s", "t")], "batch int, id string")
    item = lambda i, m="fine": {"id": i, "meaning": m}
    replies = [[item("s"), item("t", " two\n words ")], [item("s")], [item("s"), item("s")], [item("s"), item("z")]]
    rows = [(k, json.dumps({"items": r})) for k, r in enumerate(replies)] + [(4, "not json")]
    checked = summaries.checked_replies(table(spark, rows, "batch int, content string"), asked)
    assert [r.error for r in checked.orderBy("batch").collect()] == [None, "wrong number of items", "an id repeats", "an item is not valid", "no items array"]
    assert tuple(summaries.outcome(checked).first()) == (4, "wrong number of items")
    assert got(summaries.accepted(checked), "id") == [("s",), ("t",)]


def test_evaluation(spark):
    gold = table(spark, [("g", "P", 1, 0, 1, ["x", "y"], {"y": ["Y"]}, {}), ("h", "P", 1, 40, 41, ["q"], {}, {"q": False})], "gold_id string, paper_id string, page int, lo int, hi int, expected array<string>, aliases map<string,array<string>>, identity map<string,boolean>")
    box = lambda x: [x, 0.0, x + 1, 1.0]
    candidates = table(spark, [("P", 1, "p1:line0", "x", "x", box(0.0)), ("P", 1, "p1:line1", "Y", "Y", box(2.0))], "paper_id string, page int, line_id string, surface string, surface_normalized string, bbox array<double>")
    events = table(spark, [("P", 1, "d", ["p1:line0", "p1:line1"], [0.0, 0.0, 9.0, 9.0])], "paper_id string, page int, definition_id string, line_ids array<string>, bbox array<double>")
    symbols = table(spark, [("P", "d", "x"), ("P", "d", "Y")], "paper_id string, definition_id string, surface string")
    pool = table(spark, [("P", "x", ["d"]), ("P", "Y", ["d"])], "paper_id string, surface string, definition_events array<string>")
    out = {r.gold_id: r for r in evaluation.recall(gold, candidates, events, symbols, pool).collect()}
    assert out["g"].candidate_position and out["g"].canonical_surface and out["g"].local_definition_event_link and out["g"].final_pool_link
    assert not out["h"].final_pool_link and out["h"].final_pool_link_eligible and out["h"].visual_pending
    counts = evaluation.corpus_counts(evaluation.recall(gold, candidates, events, symbols, pool)).first()
    assert (counts.total, counts.final_pool_link, counts.eligible) == (2, 1, 1)
    gutter = table(spark, [("P", 1, 5.0)], "paper_id string, page int, boundary double")
    assert evaluation.crossing_gutter(events, gutter).count() == 0
    assert evaluation.crossing_gutter(events.withColumn("bbox", F.expr("array(-9d, 0d, 90d, 9d)")), gutter).count() == 1
    share = evaluation.coverage(table(spark, [(1, True), (1, False), (1, False)], "page int, ok boolean"), ["page"], "ok").first()
    assert share.coverage == 0.3333


def test_columns(spark):
    df = table(spark, [("local-1", "x" * 80, "a.PDF", None, 1536)], "id string, name string, file string, mime string, size long")
    r = df.select(X.safe_paper_id("id"), X.valid_folder_name("name"), X.is_pdf_upload("file", "mime"), X.size_label("size"), X.page_of_label(X.page_label(F.lit(7))), X.latex_surface(F.lit("x_i"), F.lit("bold")), X.imported_title(F.lit("Untitled"), F.lit("/a/b c.pdf")), X.filename_metadata(F.lit("Lee - 2001 - Parts.pdf"))["year"], X.code_point(F.lit("3B1")), X.identity_key(F.lit(""), F.lit("bold")), X.hotspot(F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))), F.lit(600.0), F.lit(800.0))["width"]).first()
    assert tuple(r) == (True, True, True, "2 KB", 7, "x_{i}", "b c", "2001", "α", None, 0.8)


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"%PD")
    assert got(documents.pdf_headers(spark, str(tmp_path)), "valid_header") == [(False,), (True,)]
    ok, bad = documents.split_uploads(table(spark, [("a.pdf", None), ("b.txt", "application/pdf"), ("c.txt", None)], "name string, mime string"))
    assert ok.count() == 2 and bad.first().rejected == 1
    images = table(spark, [("P", 1, 0, 0.0, 0.0, 442.92, 0.48, 442.92, 0.48), ("P", 1, 1, 0.0, 0.0, 8.0, 8.0, 8.0, 8.0), ("P", 1, 2, 10.0, 0.0, 18.0, 8.0, 8.0, 8.0)], S.IMAGE)
    assert got(documents.image_regions(images), "region_id", "kind") == [("image:1", "image_or_glyph_mask"), ("image:2", "image_or_glyph_mask")]
    assert documents.image_runs(images.filter("index > 0")).first().images == 2
    files = table(spark, [(b"%PDF-1", 2, 2), (b"%PDF-1", 2, 3), (b"no", 1, 1), (None, 1, 1)], "content binary, pages int, pages_check int")
    assert [r.error for r in documents.validated(files).collect()] == [None, "page counts differ", "not a PDF", "missing"]
    good = '{"paper_id": "local-2", "title": "T"}'
    for k, text in enumerate((good, "{broken", '{"paper_id": "../x", "title": "U"}')):
        (tmp_path / f"{k}.json").write_text(text)
    titles = table(spark, [("local-2", "Own")], "paper_id string, title string")
    assert got(documents.list_papers(spark, f"{tmp_path}/*.json", "paper_id string, title string", titles)) == [("local-2", "Own")]
    meta = table(spark, [("P", "Lee - 1999 - Parts.pdf", "untitled", None, None, None, None, "text 2004", 3, 10)], "paper_id string, name string, title string, subject string, author string, producer string, creator string, first_page string, pages int, file_size long")
    assert got(documents.metadata(meta), "title", "authors", "year") == [("Parts", "Lee", "1999")]
    assert [r[0] for r in table(spark, [("https://a/b",), ("http://localhost:1/",), ("http://a/",)], "u string").select(documents.allowed_endpoint("u")).collect()] == [True, True, False]


def test_cmaps_and_fonts(spark):
    data = b"beginbfchar\n<01> <03B1>\nendbfchar\nbeginbfrange\n<10> <12> <0041>\n<20> <10> <0041>\n<0> <FFFF> <0041>\nendbfrange\n<05> <0042>"
    maps = documents.parse_cmaps(table(spark, [("P", "ABCDEF+F", 1, data)], "paper_id string, font string, page int, data binary"))
    assert got(maps, "code", "ch") == [(1, "α"), (16, "A"), (17, "B"), (18, "C")]
    named = table(spark, [("P", "ABCDEF+F", 1, 1, "z"), ("P", "ABCDEF+F", 1, 2, "y")], "paper_id string, font string, page int, code int, ch string")
    codes = {(r.font, r.code): r.ch for r in documents.font_codes(maps, named).collect()}
    assert codes["F", 1] == "α" and codes["F", 2] == "y" and codes["ABCDEF+F", 17] == "B"


def test_update_stream(spark, tmp_path):
    symbols = table(spark, [("s", "old", "local")], "id string, meaning string, meaning_source string")
    schema = "ordinal long, id string, meaning string"
    source = tmp_path / "in"
    for k, rows in enumerate(([(0, "s", "one")], [(2, "s", "three"), (1, "s", "two"), (3, "s", "")])):
        table(spark, rows, schema).coalesce(1).write.mode("append").json(str(source / f"batch={k}"))
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source / "*"))
    q = streams.apply_stream(log, symbols, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max((tmp_path / "out").glob("version=*"), key=lambda p: int(p.name.split("=")[1]))
    assert got(spark.read.parquet(str(last)), "id", "meaning", "meaning_source") == [("s", "three", "remote")]


def test_store_and_views(spark, tmp_path, folders):
    path = str(tmp_path / "folders")
    assert library.read_store(spark, path, S.FOLDER).count() == 0
    library.publish(folders, path)
    assert got(library.read_store(spark, path, S.FOLDER)) == got(folders)
    schema = "paper_id string, token_id string, identityKey string, identity_key string, surface string"
    seen = table(spark, [("P", "1", None, "x|b", "x"), ("P", "2", None, None, "y"), ("P", "3", "z|i", None, "z")], schema)
    pool = table(spark, [("P", "s", None, "x|b", "x"), ("P", "t", None, None, "y")], schema)
    assert got(library.visible_occurrences(seen, pool), "token_id") == [("1",), ("2",)]
    marks = table(spark, [("P", 1, "x", "(cid:3)", "F"), ("P", 1, "x", "(cid:5)", "F"), ("P", 2, "y", "y", "F")], "paper_id string, page int, surface string, text string, fontname string")
    assert got(evaluation.surface_counts(marks, ["x", "y"])) == [("P", 1, 2, 0), ("P", 2, 0, 1)]
    assert evaluation.seen_codes(marks).first().codes == [3, 5]


def test_import_counts(spark, tmp_path):
    schema = "arrived timestamp, name string, mime string"
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS arrived, 'a.pdf' AS name, cast(null AS string) AS mime UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'b.txt', null UNION ALL SELECT timestamp'2024-01-01 01:00:00', 'c', 'application/pdf'")
    rows.write.parquet(str(tmp_path / "in"))
    seen = streams.import_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = seen.select("accepted", "rejected").writeStream.outputMode("complete").format("memory").queryName("imports").trigger(availableNow=True).start()
    q.awaitTermination()
    assert got(spark.table("imports")) == [(1, 0), (1, 1)]


def test_pdf_source_registers(spark):
    from sigilframe.sources import pdf

    pdf.register(spark)
    assert spark.read.format("pdf_glyphs").option("paths", "/nowhere/a.pdf").load().columns == [c.split(" ")[0] for c in S.GLYPH.split(", ")]


def test_small_commands(spark, membership):
    places = table(spark, [("a", 3), ("b", 4)], "paper_id string, page int")
    assert got(library.upsert_positions(places, table(spark, [("b", 9)], "paper_id string, page int"))) == [("a", 3), ("b", 9)]
    occurrences = table(spark, [("P", "t1", "x|b", 1), ("P", "t2", "q|b", 2)], "paper_id string, token_id string, identity_key string, page int")
    symbols = table(spark, [("P", "x|b", 1, "late", "x", 2), ("P", "x|b", 0, "early", "x", 3)], "paper_id string, identity_key string, ordinal int, id string, surface string, occurrences int")
    assert got(library.first_symbol_at(occurrences, symbols), "token_id", "symbol_id") == [("t1", "early")]
    assert got(library.occurrences_on_page(occurrences, 2), "token_id") == [("t2",)]
    assert got(library.others_with_counts(symbols, "early")) == [("late", "x", 2)]
    numbered = summaries.batches(table(spark, [(k, "d" * 2000) for k in range(17)], "ordinal int, definition string"))
    assert got(numbered.groupBy("batch").count()) == [(0, 16), (1, 1)] and numbered.first().sent == "d" * 1200


def test_audits(spark):
    lines = table(spark, [("P", 1, 0, 5, 2), ("P", 1, 1, 9, 2), ("P", 1, 2, 0, 0)], "paper_id string, page int, line int, meaningful int, math int")
    assert got(evaluation.math_dominant(lines), "line") == [(0,)]
    bands = table(spark, [("P", 1, 0, [0.0, 10.0, 9.0, 20.0]), ("P", 1, 1, [0.0, 18.0, 9.0, 30.0])], "paper_id string, page int, line int, bbox array<double>")
    marks = table(spark, [("P", 1, 7, 20.0, 24.0), ("P", 1, 8, 90.0, 94.0)], "paper_id string, page int, index int, top double, bottom double")
    assert got(evaluation.detached_operators(marks, bands)) == [("P", 1, 7, 0)]
    runs = table(spark, [("g", True), ("h", False)], "gold_id string, final_pool_link boolean")
    assert got(evaluation.compare(runs, runs, "final_pool_link")) == [("g", True, True), ("h", False, False)]
    glyphs = table(spark, [("F", "x", 1, 0, [0.0], "l0"), ("F", "x", 2, 0, [1.0], "l1"), ("G", "y", 1, 1, [2.0], "l0")], "fontname string, text string, page int, index int, bbox array<double>, line_id string")
    top = {r.text: r for r in evaluation.glyph_inventory(glyphs).collect()}["x"]
    assert (top.n, top.pages, top.boxes, top.lines) == (2, 2, [[0.0], [1.0]], ["l0", "l1"])
    assert [r.fontname for r in evaluation.font_frequency(glyphs).collect()] == ["F", "G"]
    areas = table(spark, [("b", "P", 1, [0.0, 0.0, 5.0, 15.0])], "box_id string, paper_id string, page int, area array<double>")
    assert got(evaluation.in_boxes(bands, areas), "line") == [(0,)]


def test_confirm_is_one_command(spark, review_tables):
    queue, lines, events, symbols = review_tables
    occurrences = table(spark, [("P", 1, "p1:char0", "p1:line0", "x", "native")], "paper_id string, page int, token_id string, line_id string, surface string, status string")
    said = table(spark, [("P", "p1:char3:identity", " x "), ("P", "p1:char9:identity", "q")], "paper_id string, review_id string, surface string")
    done = review.confirm(queue, lines, events, symbols, occurrences, said)
    assert got(done.queue, "review_id") == [("x",)]
    assert got(done.events, "definition_id") == [("p1:definition0",), ("p1:visual-definition:p1:char9",)]
    assert got(done.symbols, "surface", "status", "evidence_level") == [("q", "review", 2), ("x", "confirmed", 3)]
    assert got(done.occurrences, "token_id", "status", "definition_id") == [("p1:char0", "native", None), ("p1:char3", "visual_confirmed", "p1:definition0"), ("p1:char9", "visual_confirmed", "p1:visual-definition:p1:char9")]
    assert got(done.resolutions) == [("P", "p1:char3:identity", "x", False), ("P", "p1:char9:identity", "q", False)]
    assert got(done.totals) == [("P", 1, 1)]
    for bad in ([("P", "p1:char3:identity", "x"), ("P", "p1:char3:identity", "y")], [("P", "p1:char3:identity", "a b")], [("P", "gone", "x")]):
        with pytest.raises(library.Rejected):
            review.confirm(queue, lines, events, symbols, occurrences, table(spark, bad, "paper_id string, review_id string, surface string"))


def test_versions_of_a_stored_table(spark, tmp_path):
    """A table can be published over the version it is read from; versions without their mark are not seen."""
    path, schema = f"file://{tmp_path}/t", "paper_id string"
    assert library.read_store(spark, path, schema).count() == 0
    assert library.publish(ids(spark, "a"), path) == 1
    for k in range(3):
        library.publish(library.read_store(spark, path, schema).unionByName(ids(spark, f"b{k}")), path)
    assert got(library.read_store(spark, path, schema)) == [("a",), ("b0",), ("b1",), ("b2",)]
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["version=3", "version=4"]
    (tmp_path / "t" / "version=9").mkdir()
    assert library.read_store(spark, path, schema).count() == 4 and library.publish(ids(spark, "z"), path) == 5


def test_import_is_all_or_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/lib"
    files = table(spark, [("a", b"%PDF-1", 2, 2), ("b", b"junk!", 2, 2), ("../c", b"%PDF-1", 1, 1), ("d", b"%PDF-1", 2, 3)], "paper_id string, content binary, pages int, pages_check int")
    parse = lambda good: good.select("paper_id", F.lit("T").alias("title"))
    new, turned_away = library.import_papers(files, parse, root)
    assert got(new) == [("a",)] and got(turned_away) == [("../c", "unsafe"), ("b", "not a PDF"), ("d", "page counts differ")]
    again = table(spark, [("a", b"%PDF-1", 2, 2), ("e", b"%PDF-1", 1, 1)], "paper_id string, content binary, pages int, pages_check int")
    library.import_papers(again, lambda good: good.select("paper_id", F.lit("U").alias("title")), root)
    schema = "paper_id string, title string"
    assert got(library.read_store(spark, f"{root}/papers", schema)) == [("a", "U"), ("e", "U")]

    def broken(good):
        raise ValueError("no parser")

    twice = lambda good: parse(good).union(parse(good))
    for bad in (broken, twice):
        with pytest.raises(ValueError):
            library.import_papers(again, bad, root)
    assert got(library.read_store(spark, f"{root}/papers", schema)) == [("a", "U"), ("e", "U")]
    assert not list((tmp_path / "lib").glob("_staged-*"))


def test_import_queue_settles(spark):
    pending = table(spark, [("p1", "parsing", None), ("p2", "parsing", None), ("p4", "waiting", None)], "paper_id string, state string, error string")
    members = table(spark, [("f", "p1"), ("f", "p2"), ("f", "p3"), ("f", "old"), ("g", "r3")], S.MEMBERSHIP)
    outcomes = table(spark, [("p1", "r1", None), ("p2", None, "not a PDF"), ("p3", "r3", None)], "paper_id string, real_id string, error string")
    left, out = library.settle_imports(pending, outcomes, members)
    assert got(left, "paper_id", "state", "error") == [("p2", "failed", "not a PDF"), ("p4", "waiting", None)]
    assert got(out) == [("f", "old"), ("f", "p2"), ("f", "r1")]


def test_meanings_mark_their_paper(spark):
    papers = table(spark, [("P", "T"), ("Q", "U")], "paper_id string, title string")
    symbols = table(spark, [("P", "s", "old", "local"), ("Q", "s", "old", "local")], "paper_id string, id string, meaning string, meaning_source string")
    log = table(spark, [(0, "s", "new"), (1, "zz", "x")], "ordinal int, id string, meaning string")
    marked, out = library.update_paper_meanings(papers, symbols, "P", log, "qwen")
    assert got(marked, "paper_id", "llm_used") == [("P", True), ("Q", False)]
    assert got(out, "paper_id", "meaning", "meaning_source") == [("P", "new", "qwen"), ("Q", "old", "local")]
    again, _ = library.update_paper_meanings(marked, out, "Q", log.filter("id = 'zz'"))
    assert got(again, "paper_id", "llm_used") == [("P", True), ("Q", True)]


def test_regions_and_paths(spark):
    images = table(spark, [("P", 1, 0, 0.0, 0.0, 200.0, 150.0, 200.0, 150.0)] + [("P", 1, k, 20.0 * k, 300.0, 20.0 * k + 8, 308.0, 8.0, 8.0) for k in (1, 2, 3)] + [("P", 1, 9, 500.0, 300.0, 508.0, 308.0, 8.0, 8.0)], S.IMAGE)
    assert got(documents.visual_regions(images), "kind", "bbox") == [("compact_run", [20.0, 300.0, 68.0, 308.0]), ("large_image", [0.0, 0.0, 200.0, 150.0])]
    paths = ids(spark, "a-1", "../b", None).select(X.stored_paths("paper_id", "/lib/").alias("p")).collect()
    assert [r.p and tuple(r.p) for r in paths] == [("/lib/a-1.pdf", "/lib/a-1.json"), None, None]


def test_overlaps_are_found_across_bands(spark):
    rng = __import__("random").Random(5)
    box = lambda w, h: (lambda x, y: [x, y, x + w, y + h])(rng.uniform(0, 90), rng.uniform(0, 200))
    areas = [(k, "P", 1, box(30, rng.choice([4, 40, 90]))) for k in range(25)]
    glyphs = [("P", 1, f"p1:line{k}", "x", "x", box(5, 10)) for k in range(120)]
    out = evaluation.in_boxes(table(spark, glyphs, "paper_id string, page int, line_id string, surface string, surface_normalized string, bbox array<double>"), table(spark, areas, "box_id int, paper_id string, page int, area array<double>"))
    hit = lambda a, b: max(a[0], b[0]) < min(a[2], b[2]) and max(a[1], b[1]) < min(a[3], b[3])
    assert got(out, "box_id", "line_id") == sorted([(k, g[2]) for k, _, _, a in areas for g in glyphs if hit(a, g[5])], key=str)
