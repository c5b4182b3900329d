"""Decision boundaries of lines, tokens, events and the pool, on synthetic glyphs."""

import pytest

from sigilframe import schemas as S
from sigilframe.functions import characters as C
from sigilframe.functions import gloss
from sigilframe.operators.events import EventFinder
from sigilframe.operators.layout import column_boundary, follows_boundary, sides
from sigilframe.operators.lines import Glyph, Line, box, definition_like, formula_signal, group_lines
from sigilframe.plans.symbol_pool import Papers, documents, totals

from .glyphs import rows, run


def surfaces(text, **k):
    return [(t.kind, t.surface) for t in Line(run(text, **k), 1, 0).tokens]


DEFINITIONS = [
    ("where A represents the mixing matrix", True),
    ("where we observe the data", True),
    ("Let x be a vector", True),
    ("Let λ > 0 and suppose that", False),
    ("let us consider the case", False),
    ("given e for the next step", False),
    ("given X and its rank", True),
    ("given the matrix", True),
    ("We use penalties related to sparsity", False),
    ("we use A to denote it", True),
    ("we say that x is atomic", True),
    ("x is sparse", True),
    ("the matrix A is", True),
    ("we refer to it as the loss", True),
    ("Definition 3 of the paper", True),
    ("其中 x 为向量", True),
    ("the case where nothing holds", False),
    ("", False),
]


@pytest.mark.parametrize("text,expected", DEFINITIONS)
def test_definition_like(text, expected):
    assert definition_like(text) is expected


def test_columns_agree_with_the_page_rules(spark):
    from sigilframe.functions import columns as X

    texts = [t for t, _ in DEFINITIONS] + ["where and represent the sets", "where λ is", "refer to it as"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.definition_like("t").alias("d"), X.formula_signal("t").alias("f"))
    for r in df.collect():
        assert (r.d, r.f) == (definition_like(r.t), formula_signal(r.t)), r.t


def test_plain_letter_in_an_assignment():
    assert surfaces("where m is the number", font="TimesRoman") == [("single_letter", "m")]


def test_word_letters_and_roman_text_are_no_tokens():
    assert surfaces("the", font="CMMI10") == []
    assert surfaces("e x", font="CMR9") == []
    assert surfaces("Notation", font="CMBX10") == []


def test_script_pair():
    m, j = run("m")[0], run("j", x=77.2, size=7.0, top=13.0, start=1)[0]
    assert [t.surface for t in Line([m, j], 1, 0).tokens] == ["m", "j"]


def test_composites():
    assert ("composite", "s(x)") in surfaces("s(x) =a")
    assert ("composite", "X(i)") in surfaces("X(i)=x", fonts={0: "CMBX10"})
    assert ("composite", "K_ν") in surfaces("K_ν")
    assert all(k != "composite" for k, _ in surfaces("p(x"))
    assert all(k != "composite" for k, _ in surfaces("zeros(1)", font="CMR10"))


def test_generic_bold_needs_context():
    line = Line(run("L = x", fonts={0: "Times-Bold"}), 1, 0)
    assert "L" in [t.surface for t in line.tokens]
    assert surfaces("TABLE", font="Times-Bold") == []


def test_times_sign_and_article():
    assert ("single_letter", "x") not in surfaces("n  x  m")
    assert surfaces("a  matrix", font="CMTI10") == []


def test_lines_join_and_split_at_a_gutter():
    glyphs = [g for top in (10.0, 24.0) for x in (72.0, 320.0) for g in run("ab", x=x, top=top)]
    lines = group_lines(glyphs, 1)
    assert len(lines) == 2
    assert [len(p.g) for p in sides(lines[0], 306.0)] == [2, 2]


def test_column_boundary():
    two = [g for k in range(40) for x in (60.0, 330.0) for g in run("abcdefghijabcdefghijabcdefghijabcdefghij", x=x, top=20.0 + 14 * k)]
    assert 260 < column_boundary(two, 600.0) < 330
    one = [g for k in range(40) for g in run("abcdefghij" * 9, x=62.0, top=20.0 + 14 * k)]
    assert column_boundary(one, 600.0) is None
    assert column_boundary(two[:10], 600.0) is None and column_boundary(two, None) is None
    assert follows_boundary(group_lines(two, 1), 300.0) and not follows_boundary(group_lines(one, 1), 300.0)


def test_box_rounds_half_to_even():
    g = Glyph(0, "a", "a", "native", "", 0.0625, 1.1875, 0.0, 1.0, 10.0)
    assert box([g])[0] == 0.062 and box([g])[2] == 1.188


def events_of(texts, **k):
    lines = [Line(run(t, top=10 + 14 * i, start=1000 * i, **k), 1, i) for i, t in enumerate(texts)]
    return EventFinder(lines, [x.definition for x in lines], None, None).events()[0]


def test_event_reach_and_claims():
    found = events_of(["f = x + y", "holds on the sets", "where f denotes the sum"])
    assert [e.window for e in found] == [[0, 1, 2]]


def test_evidence_stays_local():
    e = events_of(["α denotes the first rate.", "β denotes the second rate."])[0]
    texts = {s.surface: " ".join(s.texts) for s in e.symbols}
    assert "second" not in texts["α"]


def test_levels_and_trigger():
    e = events_of(["where A represents the matrix", "x = y + z"])[0]
    assert e.trigger == "where"
    levels = {s.surface: s.level for s in e.symbols}
    assert levels["A"] == 3 and levels["z"] == 2


@pytest.mark.parametrize("surface,text,expected", [
    ("A", "where A represents the mixing matrix, and", "the mixing matrix"),
    ("f", "f : X -> R is a convex function.", "a convex function"),
    ("n", "x n is the size", gloss.NO_GLOSS),
    ("k", "k is the default value", gloss.NO_GLOSS),
    ("g", "g is the ℓ1 term where h holds", "the ℓ1 term norm"),
    ("q", "nothing here", gloss.NO_GLOSS),
])
def test_gloss(spark, surface, text, expected):
    assert glossed(spark, (surface, text))[0].meaning == expected


def test_gloss_tells_a_symbol_from_its_other_case(spark):
    """B(b) is a value of B; verbs are still read in either case."""
    rows = [("b", "B(b) is the loss"), ("B", "B(b) is the loss"), ("b", "B is the loss, b IS the rate"), ("x", "X表示混合矩阵")]
    assert [r.meaning for r in glossed(spark, *rows)] == [gloss.NO_GLOSS, "the loss", "the rate", gloss.NO_GLOSS]


def test_pool_where_two_letters_differ_by_case(spark):
    """Supplier 14 defines B, O and b: each keeps its own gloss, as the SQL has it."""
    from sigilframe.manuscripts import manuscripts

    suppliers = spark.createDataFrame([(14, 1, 5.0)], "s_suppkey long, s_nationkey int, s_acctbal double")
    pool = {(r.surface, r.style): r.meaning for r in Papers(*manuscripts(suppliers)).pool.collect()}
    assert pool["B", "italic"] == "the mixing matrix" and pool["B(b)", "mixed:italic+roman"] == "the loss"
    assert pool["b", "italic"] == "B = O + b let b be a vector of weight…"


def glossed(spark, *pairs):
    return spark.createDataFrame(pairs, "s string, t string").select(gloss.gloss("s", "t").alias("g")).select("g.*").collect()


def test_gloss_is_short(spark):
    long, cut = glossed(spark, ("x", "x is " + "very " * 30 + "long"), ("x", "a" * 900))
    assert len(long.meaning) <= gloss.MAX_GLOSS and long.meaning.endswith("…")
    assert cut.definition == "a" * 700 and cut.summary == "a" * 37 + "…"


def test_gloss_of_odd_texts(spark):
    """Signs of the pattern language in a symbol, Chinese, clauses, remains of equations, and nothing at all."""
    rows = [
        ("s(x)", "Here s(x) denotes the density", "the density", "the density"), ("\\E+", "\\E+ is the sum", "the sum", "the sum"),
        ("d", "the d - dimensional real space", "real space", "real space"), ("X", "其中X表示混合矩阵，", "混合矩阵", "混合矩阵"),
        ("b", "b is the rate and c is the time", "the rate", "the rate"), ("b", "b is defined by the rule", gloss.NO_GLOSS, "b is defined by the rule"),
        ("b", "b →  c", gloss.NO_GLOSS, gloss.NO_GLOSS), ("b", " ,; ", gloss.NO_GLOSS, gloss.NO_GLOSS), ("b", "", gloss.NO_GLOSS, gloss.NO_GLOSS),
    ]
    out = glossed(spark, *[r[:2] for r in rows])
    assert [(r.meaning, r.summary) for r in out] == [r[2:] for r in rows]
    assert out[4].definition == "b: the rate" and out[5].definition == "b is defined by the rule"
    around = glossed(spark, ("q", "word " * 60 + "q" + " tail" * 200))[0].definition
    assert around.startswith(("word ", "ord ", "rd ", "d ")) and around.index("q") <= 160 and len(around) <= 160 + 1 + 540
    assert glossed(spark, (None, "x"), ("x", None)) == [(None, None, None)] * 2


def test_characters():
    assert C.text_style("𝐱") == "bold" and C.text_style("𝔸") is None or C.text_style("𝔸") == "blackboard"
    assert C.text_style("𝐱𝑦") == "mixed:bold+italic" and C.text_style("x") is None
    assert C.normal_form("𝑥ﬁ²µ") == "xfi2μ"
    assert [C.glyph_name_char(n) for n in ("alpha", "A123", "lambda", "unknown", None)] == ["α", "A", "λ", None, None]
    assert [C.glyph_name_char(n) for n in ("Gamma", "GAMMA", "Delta", "theta1", "summation", "bar", "/uni03B1", "backslash")] == ["Γ", "γ", "∆", "ϑ", "∑", "|", "α", "\\"]
    assert [C.glyph_name_char(n) for n in ("Aacute", "germandbls", "fi", "ff", "dotlessi", "quotesingle", "Scaron", "ohungarumlaut", "Lslash", "afii10017", "alphatonos")] == ["Á", "ß", "ﬁ", "ﬀ", "ı", "'", "Š", "ő", "Ł", "А", "ά"]
    assert [C.glyph_name_char(n) for n in ("f_i", "a.sc", "uni00410042", "u1D400", "uniD800", "g23", "a_?x")] == ["fi", "a", "AB", "𝐀", None, "g", None]
    assert C.font_style("ABCDEF+CMR9") == "roman" and C.font_style("MSBM10") == "blackboard" and C.font_style("Foo") == "font:Foo"


@pytest.fixture(scope="module")
def papers(spark):
    one = rows(run("where A represents the mixing matrix.", font="CMR10", fonts={6: "CMMI10"}))
    one += rows(run("B = A x", top=30.0, start=100))
    two = rows(run("Then A holds", font="CMR10", fonts={5: "CMMI10"}), page=2)
    refs = rows(run("References", font="CMR10", top=30.0, start=100), page=2)
    late = rows(run("where Q represents the set.", font="CMR10", fonts={6: "CMMI10"}), page=3)
    odd = [("P", 1, 900, "(cid:7)", "CMMI10", 200.0, 205.0, 30.0, 40.0, 10.0, True), ("P", 1, 901, "z", "CMMI10", 300.0, 305.0, 30.0, 40.0, 10.0, False)]
    glyphs = spark.createDataFrame(one + two + refs + late + odd, S.GLYPH)
    pages = spark.createDataFrame([("P", k, 600.0, 800.0) for k in (1, 2, 3)], S.PAGE)
    return Papers(glyphs, pages)


def test_pool(papers):
    pool = {r.surface: r for r in papers.pool.collect()}
    assert pool["A"].status == "confirmed" and pool["A"].meaning == "the mixing matrix" and pool["A"].occurrences == 3
    assert pool["A"].id == "symbol:A|italic:0" and pool["A"].location == "第 1 页"
    assert pool["B"].status == "review" and pool["B"].evidence_level == 2
    assert "z" not in pool  # not upright
    assert all(r.evidence_level >= 2 and (r.status == "confirmed") == (r.evidence_level >= 3) for r in pool.values())


def test_references_flag(papers):
    lines = {(r.page, r.line): r for r in papers.lines.collect()}
    assert lines[1, 0].definition_like and not lines[3, 0].definition_like and lines[3, 0].formula_like


def test_review_queue_and_totals(papers):
    queue = papers.review_queue.collect()
    assert [(r.kind, r.surface) for r in queue] == [("unresolved_glyph_identity", "(cid:7)")]
    t = totals(papers.pages, papers.pool).first()
    assert (t.pages, t.definition_lines, t.visual_review_items, t.unresolved_candidates) == (3, 1, 1, 1)
    d = documents(papers).first()
    # Q is defined behind the references: its page has no heading of its own, so events start there still.
    assert [s.surface for s in d.symbols] == ["A", "B", "x", "Q"] and d.totals.final_symbols == 4 and len(d.review_queue) == 1


def test_font_table_recovers_identities(spark):
    g = [("P", 1, 0, "(cid:7)", "ABCDEF+CMMI10", 72.0, 77.0, 10.0, 20.0, 10.0, True), *rows(run(" = x", start=1, x=80.0))]
    glyphs = spark.createDataFrame(g, S.GLYPH)
    pages = spark.createDataFrame([("P", 1, 600.0, 800.0)], S.PAGE)
    codes = spark.createDataFrame([("P", "CMMI10", 7, "λ")], S.FONT_CODE)
    found = {r.surface: r.status for r in Papers(glyphs, pages, codes).occurrences.collect()}
    assert found["λ"] == "recovered"


def test_no_pages(spark):
    papers = Papers(spark.createDataFrame([], S.GLYPH), spark.createDataFrame([], S.PAGE))
    assert papers.pool.count() == papers.review_queue.count() == 0


def test_visual_words():
    assert [w for w, _, _ in Line(run("Let x = ab  cd"), 1, 0).visual_words()] == ["let", "x", "ab", "cd"]


def test_job(spark, tmp_path):
    from sigilframe.__main__ import main

    rows_ = rows(run("where A represents the mixing matrix.", font="CMR10", fonts={6: "CMMI10"}))
    spark.createDataFrame(rows_, S.GLYPH).write.parquet(str(tmp_path / "glyphs"))
    spark.createDataFrame([("P", 1, 600.0, 800.0)], S.PAGE).write.parquet(str(tmp_path / "pages"))
    assert main([str(tmp_path / "glyphs"), str(tmp_path / "pages"), "--out", str(tmp_path / "out")]) == 0
    assert spark.read.json(str(tmp_path / "out")).select("paper_id", "symbols.surface").first() == ("P", ["A"])
    assert main([str(tmp_path / "nothing"), str(tmp_path / "pages"), "--out", str(tmp_path / "out2")]) == 2
