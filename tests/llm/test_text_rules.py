"""Quality rules, secret scans and scoring."""

import base64
import hashlib
import json
import math
import pickle
import random
import re

import numpy as np
import pytest
import pyarrow as pa

from sigilframe.llm import quality, scoring, secrets
from sigilframe.llm.text import sliding_min, word_blocks

from .texts import DOCS, corpus, prose, rule_counts, words

LABELS = "doc_id long, quality int, toxic int"


def test_words_and_blocks():
    texts = [t for _, t in corpus()]
    got = []
    for lo, hi, w in word_blocks(pa.array(texts), 300):
        data = w.buf.tobytes()
        for t in range(hi - lo):
            got.append([data[s:e].decode() for s, e, k in zip(w.start, w.end, w.text) if k == t])
    assert got == [words(t) for t in texts]
    x = np.random.default_rng(1).integers(0, 99, 50)
    for k in (1, 2, 5, 7, 35, 50, 51):
        assert sliding_min(x, k).tolist() == [min(x[i : i + k]) for i in range(len(x) - k + 1)]


def test_rule_counts(spark):
    rows = corpus() + [(900, "x | y\nx | y\n\n  \nx | y\nlast"), (901, "\n\na\n\n"), (902, None), (903, "no end\nno end")]
    out = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.count(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {i: rule_counts(t) for i, t in rows}


def judged_corpus(n=300):
    rng = random.Random(6)
    good = [(k, prose(rng, 80, 5000)) for k in range(n)]
    junk = [(1000 + k, " ".join(x.upper() + "!!" for x in prose(rng, 80, 5000).split())) for k in range(12)] + [(2000 + k, " | ".join(prose(rng, 60, 5000).split())) for k in range(12)]
    return good, junk


def test_verdicts(spark):
    good, junk = judged_corpus()
    docs = spark.createDataFrame(good + junk + [(3000, "short"), (3001, None), (3002, "same " * 40)], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[::2]] + [(i, 0, 0) for i, _ in junk[::2]] + [(None, 0, 0), (good[0][0], None, None)], LABELS)
    out = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert sum(not out[i].kept for i, _ in good) <= 0.01 * len(good)  # rows without a label count too
    assert sum(not out[i].kept for i, _ in junk) >= 0.9 * len(junk)
    assert all(out[i].base_failed and not out[i].kept for i in (3000, 3001, 3002))
    kept = {r.doc_id for r in quality.kept_rows(docs, labels).collect()}
    assert kept == {i for i, r in out.items() if r.kept}


def test_base_columns_have_sql_too(spark):
    """The base counts and the base verdict of every document of the smallest tables, by the oracle's engine."""
    import duckdb

    from sigilframe.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    word = r"[^\x20\x09-\x0D]+"
    sql = rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM '{folder}/documents.parquet'),
        g AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
        r AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
        c AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM r, range(5) AS x(k) GROUP BY 1),
        l AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{word}') GROUP BY 1, 2) GROUP BY 1),
        a AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup, coalesce(c.n, 0) AS n_rep FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
        SELECT *, n_words < 10 OR 100 * n_rep > 20 * n_words FROM a"""
    got = QUERIES["op9_quality_rules"](spark, folder).select("doc_id", *quality.COUNTS, "base_failed").collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(sql).fetchall())


def mean_path(n):
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def test_path_lengths_and_scores_by_hand():
    """Each tree grown again from its splits: a row's path is the depth of the leaf it reaches plus the mean path of the rows left there."""
    rng = np.random.default_rng(5)
    rows = np.column_stack([rng.normal(5, 1, 900), rng.exponential(0.1, 900), np.zeros(900)])
    rows[:40, 1] += 3
    forest = quality.Forest(rows, trees=12, psi=32, seed=3)
    low, center, high = (np.quantile(rows, q, axis=0) for q in (0.25, 0.5, 0.75))
    x = (rows - center) / np.maximum(high - low, 0.05)
    assert forest.limit == 5 and (forest.feature != 2).all()  # a rate without width is never cut
    draw, paths = np.random.default_rng(3), np.zeros(len(x))
    for root in forest.roots:
        sample = x[draw.permutation(len(x))[:32]]
        draws = []

        def walk(node, inside, depth):
            f = forest.feature[node]
            if f < 0:
                assert forest.length[node] == pytest.approx(depth + mean_path(len(inside)))
                assert depth == 5 or not np.ptp(inside, 0).any()
                return
            cut = forest.cut[node]
            draws.append(node)
            assert inside[:, f].min() < cut <= inside[:, f].max()
            walk(forest.child[node][0], inside[inside[:, f] < cut], depth + 1)
            walk(forest.child[node][1], inside[inside[:, f] >= cut], depth + 1)

        walk(root, sample, 0)
        for _ in draws:  # a choice of the rate and one of the cut for each split
            draw.random(), draw.random()
        for i, row in enumerate(x):
            node = root
            while forest.feature[node] >= 0:
                node = forest.child[node][int(row[forest.feature[node]] >= forest.cut[node])]
            paths[i] += forest.length[node]
    scores = 2.0 ** (-paths / 12 / mean_path(32))
    assert forest.scores(rows) == pytest.approx(scores)
    assert scores[:40].mean() > scores[40:].mean() + 0.05


def test_threshold_is_the_best_of_all(spark):
    rng = np.random.default_rng(8)
    rows = [(k, float(rng.beta(2, 5)), 1) for k in range(400)] + [(1000 + k, float(rng.beta(5, 3)), 0) for k in range(90)]
    scored = spark.createDataFrame([(i, s) for i, s, _ in rows], "doc_id long, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(5, 1, 0), (6, None, 0), (None, 0, 0), (99_999, 0, 0)], LABELS)
    for loss in (0.0, 0.005, 0.1):
        got = quality.calibrate(scored, labels, loss)
        tried = []
        for cut in range(quality.BINS + 1):
            lost, found = (np.mean([np.floor(s * quality.BINS) >= cut for _, s, q in rows if q == kind]) for kind in (1, 0))
            if lost <= loss:
                tried.append(found - lost)
        lost, found = (np.mean([np.floor(s * quality.BINS) >= got * quality.BINS for _, s, q in rows if q == kind]) for kind in (1, 0))
        assert lost <= loss and found - lost == pytest.approx(max(tried))


def test_sample_is_the_same_rows_at_every_size(spark):
    """The forest of a table does not change with its order, and rates are seldom equal."""
    docs = spark.createDataFrame(judged_corpus(400)[0], DOCS)
    a, b = (quality.fit_forest(quality.count(x), trees=4, psi=16).value for x in (docs, docs.repartition(7)))
    assert a.cut.tolist() == b.cut.tolist()


def test_rules_very_long_text_and_clashing_columns(spark):
    long = prose(random.Random(2), 120_000, 50_000)
    rows = [(1, long, 7.0, 3), (2, long, None, 4), (3, None, 1.0, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, base_failed int")
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 0, 0, "y")], LABELS + ", n_words string")
    out = {r.doc_id: r.n_words for r in quality.judge(docs, labels).collect()}
    assert out == {1: 120_000, 2: 120_000, 3: 0}
    assert quality.kept_rows(docs, labels).columns == docs.columns


def test_verdicts_without_labels(spark):
    good, _ = judged_corpus(20)
    docs = spark.createDataFrame([*good, good[0], (None, good[1][1])], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert all(r.kept for r in quality.judge(docs, none).collect())
    assert quality.judge(docs.limit(0), none).count() == quality.kept_rows(docs.limit(0), none).count() == 0
    assert quality.judge(docs.limit(1), none).count() == 1


def test_forest_finds_outliers():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 3))
    x[:5] += 9
    s = quality.Forest(x).scores(x)
    assert s[:5].min() > np.quantile(s[5:], 0.98)


def der(tag, content):
    n = len(content)
    head = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + content


RSA = der(0x30, b"".join(der(2, x) for x in (b"\0", b"\x5a" * 64, b"\x01\0\1", b"\x3b" * 64, b"\x1c" * 32, b"\x1d" * 32, b"\x1e" * 32)))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, RSA))
EC = der(0x30, der(2, b"\1") + der(4, b"\x07" * 32))
SSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"\x41" * 40


def b64(data):
    return base64.b64encode(data).decode()


def token(header, body):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return f"{part(header)}.{part(body)}.c2lnbmF0dXJl"


def test_structures():
    assert all(map(secrets.is_private_key, (RSA, PKCS8, EC, SSH)))
    broken = (RSA[:-1], RSA + b"\0", b"\x30" + RSA[1:4] + RSA, der(0x30, der(2, b"\1")), b"", b"\x30\x80\0\0", SSH[:20], der(0x30, der(4, b"x" * 40)))
    assert not any(map(secrets.is_private_key, broken))


def test_confirmed_and_dropped():
    kinds = lambda t: [secrets.KINDS[k] for _, k, _ in secrets.find(t)]
    assert kinds(f"see {b64(PKCS8)} end") == ["key"]
    assert kinds(f"see {RSA.hex().upper()} end") == ["key"]
    assert kinds(f"é {token({'alg': 'HS256'}, {'sub': 1})}.") == ["token"]
    assert kinds(token({"typ": "x"}, {"sub": 1})) == [] and kinds(b64(b"plain text " * 9)) == []
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{b64(RSA)[:64]}\n{b64(RSA)[64:]}\n-----END RSA PRIVATE KEY-----"
    assert secrets.find("a " + pem) == [(2, 3, 2 + len(pem))]


def test_keys_in_strings_wrapped_and_url_safe(spark):
    kinds = lambda t: [secrets.KINDS[k] for _, k, _ in secrets.find(t) if k >= 3]
    wrap = lambda x, n: [x[i : i + n] for i in range(0, len(x), n)]
    begin, end = "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"
    ed = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, b"\x05" * 32)))
    url = base64.urlsafe_b64encode(der(0x30, der(2, b"\1") + der(4, b"\xfb\xff" * 16))).decode()
    assert "-" in url and "_" in url
    for data in (ed, PKCS8, RSA):
        for sep in ("\\n", "\\r\\n", "\\\\n", '\\n"\n  "', '\\n" +\n  "'):
            pem = sep.join([begin, *wrap(b64(data), 64), end])
            assert secrets.find(f'{{"k": "{pem}"}}') == [(7, 3, 7 + len(pem))], sep
    for data in (PKCS8, RSA, SSH + b"\x41" * 100):
        for width in (64, 76):
            for sep in ("\n", "\r\n", "\n    ", "\n> ", "\\n"):
                body = sep.join(wrap(b64(data), width))
                assert secrets.find(f"key: {body}\n\nThen more {'words ' * 20}") == [(5, 3, 5 + len(body))], (width, sep)
    for text in (url, url.rstrip("="), "\n".join(wrap(url, 40)), "a-" + b64(PKCS8), "x\\n" + b64(ed)):
        assert kinds(f"see {text} end") == ["key"], text
    assert kinds("\n".join(wrap(b64(b"plain text " * 30), 64))) == kinds("\n".join(wrap(b64(PKCS8[:-9]), 64))) == []
    none = base64.urlsafe_b64encode(b'{"alg":"none"}').decode().rstrip("=") + ".e30."
    assert len(none) < 32 and kinds(f"a {none} b") == ["token"]
    out = secrets.scan(spark.createDataFrame([(1, f"a {none} b"), (2, "a b.c d."), (3, "\n".join(wrap(b64(RSA), 64)))], DOCS)).collect()
    assert sorted((r.doc_id, r.n_key, r.n_token) for r in out) == [(1, 0, 1), (2, 0, 0), (3, 1, 0)]


def test_encrypted_keys_and_their_look_alikes(spark):
    """Keys under a password, as they are and in every armour; digests and other schemes look alike and are none."""
    made = lambda oid, n: der(0x30, der(0x30, der(6, bytes.fromhex(oid)) + der(0x30, der(4, b"salt5678") + der(2, b"\x08\0"))) + der(4, b"\x9a\xfe" * (n // 2)))
    pbes2, pkcs12 = made("2a864886f70d01050d", 1200), made("2a864886f70d010c0103", 320)
    digest, short = made("608648016503040201", 32), made("2a864886f70d01050d", 8)
    assert all(map(secrets.is_private_key, (pbes2, pkcs12))) and not any(map(secrets.is_private_key, (digest, short, pbes2[:-1])))
    lines = [b64(pbes2)[i : i + 64] for i in range(0, len(b64(pbes2)), 64)]
    for sep in ("\n", "\r\n", "\\n"):
        pem = sep.join(["-----BEGIN ENCRYPTED PRIVATE KEY-----", *lines, "-----END ENCRYPTED PRIVATE KEY-----"])
        assert secrets.find(f"é {pem} end") == [(2, 3, 2 + len(pem))]
        assert secrets.find(f"k {sep.join(lines)}\n\nend") == [(2, 3, 2 + len(sep.join(lines)))]
    assert [k for _, k, _ in secrets.find(f"see {base64.urlsafe_b64encode(pkcs12).decode()} end")] == [3]
    assert secrets.find(f"see {b64(digest)} end") == secrets.find(f"see {b64(made('608648016503040201', 400))} end") == []
    long = "word " * 300_000 + pem + " word" * 10
    rows = spark.createDataFrame([(1, long, 5, "x")], "doc_id long, text string, n_key int, base_sha256 string")
    assert [(r.n_key, r.spans) for r in secrets.scan(rows).collect()] == [(1, f"key:1500000:{1500000 + len(pem)}")]


BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def test_base_spans(spark):
    rng = random.Random(7)
    bits = ["password", "token", "Secret", "API_KEY", "apikey", "=", ": ", '"', "'", " ", "AKIA", "AKIAABCDEFGH1234", "deadbeef" * 4, "a1" * 15, "é", "😀", "value_12345", "short", "\n", "ſecret", "toKen"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))) for k in range(400)] + [(900, None), (901, ""), (900, "again token=abcdefgh")]
    out = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan(spark.createDataFrame(rows, DOCS)).collect()))
    expected = []
    for i, t in rows:
        spans = sorted((m.start(), k, m.end(), name) for k, (name, (p, ok)) in enumerate(BASE.items()) for m in p.finditer(t or "") if ok(m))
        text = ",".join(f"{n}:{s}:{e}" for s, _, e, n in spans)
        expected.append((i, *(sum(n == name for *_, n in spans) for name in BASE), hashlib.sha256(text.encode()).hexdigest()))
    assert out == sorted(expected)


def test_redaction(spark):
    rows = [(1, f"a password = {'f0' * 16} b", "x"), (2, None, "y"), (3, "clean", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r.doc_id: (r.text, r.spans) for r in secrets.redacted(df).collect()}
    assert out == {1: ("a [REDACTED_ASSIGN] b", "x"), 2: (None, "y"), 3: ("clean", "z")}
    assert secrets.scan(df.limit(0)).count() == secrets.redacted(df.limit(0)).count() == 0


# Scoring ----------------------------------------------------------------------------------------


def chain(rng, n):
    """Text in which a word is settled by its neighbours: w, then w+1 or w+2."""
    out, w = [], rng.randrange(40)
    for _ in range(n):
        out.append(f"t{w}")
        w = (w + rng.choice((1, 2))) % 40
    return " ".join(out)


def small(docs, **k):
    return scoring.score_documents(docs, shape=(8, 8, 8), hashed=16, mask=2, **k)


def test_scores_separate_order_from_noise(spark):
    rng = random.Random(9)
    rows = [(k, chain(rng, 300)) for k in range(120)]
    held = [(1000 + k, chain(rng, 100)) for k in range(20)]
    noise = [(2000 + k, " ".join(rng.sample(chain(rng, 100).split(), 100))) for k in range(20)]
    docs = spark.createDataFrame(rows + held + noise, DOCS).repartition(12)
    out = {r.doc_id: r.mean_log_prob for r in small(docs).collect()}
    ordered = [out[i] for i, _ in held]
    mixed = [out[i] for i, _ in noise]
    assert np.mean(ordered) > np.mean(mixed) + 0.5
    assert sum(a > max(mixed) for a in ordered) >= 18
    assert np.mean(ordered) > -np.log(40) + 0.5  # better than the words' own frequencies


def test_scores_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "a b c")]
    out = sorted(((r.doc_id or 0, r.n_tokens, r.log_prob < 0, r.mean_log_prob is None) for r in small(spark.createDataFrame(rows, DOCS)).collect()))
    assert out == [(0, 3, True, False), (1, 0, False, True), (2, 0, False, True), (3, 1, True, False), (3, 1, True, False)]
    assert small(spark.createDataFrame([], DOCS)).count() == 0


def context_row(before):
    """The row of the last three bytes; bytes that are not there count as 0."""
    number = sum((b + 1) * 257**k for k, b in enumerate(reversed(before[-3:])))
    return ((number * 2654435761) % 2**32) * scoring.CONTEXTS // 2**32


def test_rare_words_are_spelled(spark):
    """Every byte string has a probability of its own: by its first byte, then byte after byte to its end."""
    docs = spark.createDataFrame([(k, "a b c d " * 20 + f"rare{k % 3} RARE junk") for k in range(12)], DOCS)
    vocab = scoring.vocabulary(scoring.word_counts(docs), 4, 1)
    _, spelled = scoring.train(docs, vocab, (4, 65))
    table = np.exp(spelled).reshape(scoring.CONTEXTS, 257)
    assert table.sum(1) == pytest.approx(np.ones(scoring.CONTEXTS))
    row = table[context_row(b"are")]
    counts = row * (24 + 257 * scoring.SMOOTH) - scoring.SMOOTH
    assert {chr(c): n for c, n in enumerate(np.round(counts).astype(int)) if n} == {"0": 4, "1": 4, "2": 4, chr(256): 12}  # 256 is the end, here of RARE
    one = {r.doc_id: r.log_prob for r in scoring.score(docs.limit(1).unionAll(spark.createDataFrame([(99, "raze")], DOCS)), vocab, scoring.Network(6, (4, 65)), spelled).collect()}
    assert np.isfinite(one[99])  # also words that were never seen


def test_every_position_trains():
    texts = pa.array(["a b c d e f g h i j k", None, "a b", "x " * 500])
    vocab, spelled = scoring.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), 32, 32), np.zeros(scoring.CONTEXTS * 257)
    parts = list(scoring._positions(texts, vocab, scoring.Network(65, (288,)), scoring.MASK, spelled))
    assert sum(len(y) for _, y in parts) == 11 + 2 + 500 == spelled.sum()


def test_warm_start_is_no_prefix(spark):
    docs = spark.createDataFrame([(k, f"{'first' if k < 500 else 'later'} {k}") for k in range(1000)], DOCS).coalesce(1)
    texts = [scoring.warm_texts(x, 100).to_pylist() for x in (docs, docs.repartition(5))]
    assert sorted(texts[0]) == sorted(texts[1]) and len(texts[0]) == 100
    assert 25 < sum(t.startswith("later") for t in texts[0]) < 75


def test_vocabulary_follows_the_corpus():
    small, large = scoring.sizes(10**7), scoring.sizes(10**9)
    assert np.prod(large[0]) > 9 * np.prod(small[0]) > 9 * 12_000
    assert all(0 < hashed < np.prod(shape) / 8 for shape, hashed in (small, large, scoring.sizes(0)))


def test_probabilities_sum_to_one():
    net = scoring.Network(64 + 1, (4, 2, 8))
    context = np.array([[3, 0, 9, 64]])
    total = sum(np.exp(net.log_probs(context, np.array([y])))[0] for y in range(1, 65))
    assert abs(total - 1) < 1e-5


def test_gradient_steps_lower_the_loss():
    rng = np.random.default_rng(4)
    net = scoring.Network(64 + 1, (4, 2, 8))
    y = rng.integers(1, 65, 2000)
    context = np.stack([y, np.zeros(2000, np.int64), np.zeros(2000, np.int64), y], 1)
    before = net.log_probs(context, y).mean()
    for _ in range(60):
        net.step(context, y, 0.2)
    assert net.log_probs(context, y).mean() > before + 2


@pytest.mark.parametrize("n", [0, 1, 500, 300_000])
def test_words_are_found_by_slots(n):
    """Also where many words share a slot; the slots stay behind when the vocabulary is sent."""
    rng = np.random.default_rng(2)
    h = np.unique(np.concatenate([rng.integers(0, 1 << 64, n, np.uint64), np.arange(min(n, 40), dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(min(n, 40), dtype=np.uint64)]))
    vocab = scoring.Vocabulary(h, rng.permutation(len(h)).astype(np.int64), len(h) + 5, 17)
    asked = np.concatenate([h, rng.integers(0, 1 << 64, 1000, np.uint64), np.arange(80, dtype=np.uint64)])
    known = dict(zip(h.tolist(), vocab.id.tolist()))
    assert vocab.ids(asked).tolist() == [known[x] + 1 if x in known else vocab.size + 1 + (x >> 20) % 17 for x in asked.tolist()]
    assert len(vocab.slots[1]) <= (1 << 20) + 1
    sent = pickle.loads(pickle.dumps(vocab))
    assert "slots" not in vars(sent) and (sent.ids(asked) == vocab.ids(asked)).all()


@pytest.mark.parametrize("hidden", [1, 7, 32])
def test_a_step_changes_what_it_met(hidden):
    """One step against the gradient of the loss: sums over equal ids, place by place, then the adaptive rate."""
    rng = np.random.default_rng(5)
    net = scoring.Network(64 + 1, (4, 2, 8), hidden=hidden)
    context, y = rng.integers(0, 65, (300, 4)).astype(np.int32), rng.integers(1, 65, 300).astype(np.int32)
    context[:200, 1] = 3
    before = {k: v.copy() for k, v in net.p.items()}
    net.step(context, y, 0.1)
    for name in ("embed", "bias"):
        for at in [(0, context[0, 0], 0), (1, 3, hidden - 1), (3, context[7, 3], 0)] if name == "embed" else [(0,), (hidden - 1,)]:
            loss = []
            for d in (1e-2, -1e-2):
                moved = scoring.Network(64 + 1, (4, 2, 8), hidden=hidden)
                moved.p = {k: v.copy() for k, v in before.items()}
                moved.p[name][at] += d
                loss.append(-moved.log_probs(context, y).mean())
            grad = 64 * (loss[0] - loss[1]) / 2e-2
            assert net.p[name][at] - before[name][at] == pytest.approx(-0.1 * grad / math.sqrt(0.1 + grad * grad), abs=2e-3)
            assert net.sums[name][at] == pytest.approx(0.1 + grad * grad, rel=0.03)
    missed = np.setdiff1d(np.arange(65), context[:, 2])
    assert len(missed) == 0 or (net.p["embed"][2, missed] == before["embed"][2, missed]).all()
    x, first = rng.standard_normal((50, hidden)).astype(np.float32), np.array([0, 1, 2, 30, 49])
    assert np.allclose(scoring._run_sums(x, first), [part.sum(0) for part in np.split(x, first[1:])], atol=1e-5)


def plain_log_probs(net, vocab, table, text):
    """Every position of a text by itself: neighbours, tanh, the softmax digit by digit, and spelling, in plain loops."""
    import math

    pairs = [(w[s:e].decode().lower(), int(h)) for _, _, x in word_blocks(pa.array([text], pa.string()), lower=True) for w, s, e, h in zip([x.buf.tobytes()] * len(x.start), x.start, x.end, x.hash)]
    ids = [int(vocab.ids(np.array([h], np.uint64))[0]) for _, h in pairs]
    out = 0.0
    for at, ((word, _), number) in enumerate(zip(pairs, ids)):
        near = [ids[at + d] if 0 <= at + d < len(ids) else 0 for d in (-2, -1, 1, 2)]
        hidden = [math.tanh(sum(float(net.p["embed"][k, i, j]) for k, i in enumerate(near)) + float(net.p["bias"][j])) for j in range(net.width)] + [1.0]
        rare = number > vocab.size
        data = [*word.encode(), 256]
        group, rest = 0, (vocab.size + data[0]) if rare else number - 1
        for k, base in enumerate(net.shape):
            below = int(np.prod(net.shape[k + 1 :], dtype=np.int64))
            digit, rest = divmod(rest, below)
            scores = [sum(float(w) * x for w, x in zip(net.p[k][group, c], hidden)) for c in range(base)]
            out += scores[digit] - math.log(sum(math.exp(s) for s in scores))
            group = group * base + digit
        out += sum(float(table[context_row(bytes(data[:k])) * 257 + data[k]]) for k in range(1, len(data))) if rare else 0.0
    return out


def test_a_document_score_is_the_sum_of_its_words_log_probabilities(spark):
    rng = random.Random(3)
    rows = [(k, chain(rng, 60)) for k in range(30)] + [(100, "of Few wörds"), (101, "a"), (102, None)]
    docs = spark.createDataFrame(rows, DOCS)
    vocab = scoring.vocabulary(scoring.word_counts(docs), 20, 7)
    net, table = scoring.train(docs, vocab, (6, 46))
    got = {r.doc_id: r for r in scoring.score(docs, vocab, net, table).collect()}
    for doc, text in rows:
        assert got[doc].n_tokens == len(words(text))
        assert got[doc].log_prob == pytest.approx(plain_log_probs(net, vocab, table, text), abs=1e-3)


def test_copies_follow_the_input_and_the_network(spark, tmp_path):
    spark.range(400_000).selectExpr("id AS doc_id", "repeat(cast(id as string), 4) AS text").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    few, many = (scoring.copies(docs, scoring.Network(n, (8, 8, 8))) for n in (2000, 200))
    assert 1 < few < many and few * 4 * 2000 * 4 * scoring.HIDDEN <= sum(f.stat().st_size for f in (tmp_path / "d").glob("*.parquet"))


def test_scores_long_text_ties_and_clashing_columns(spark):
    rows = [(1, "x y " * 60_000, 5), (2, "y x " * 3, 6), (2, "y x " * 3, 6)]
    out = small(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    assert sorted(r.n_tokens for r in out) == [6, 6, 120_000] and len({r.log_prob for r in out}) == 2
