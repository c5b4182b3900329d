"""WARC archives, sampled segmentations, chats, packing."""

import gzip
import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigilframe.llm import chat, lattice, packing, warc
from sigilframe.llm.text import U, mix

from .texts import DOCS, corpus, prose

PAGES = "page_id long, url string, html string"


def pages(n=60):
    rng = random.Random(3)
    out = [(k, f"http://h/{k}\n é", prose(rng, rng.randrange(1, 300))) for k in range(n)]
    out += [(100 + k, "http://copy", "<p>same é</p>") for k in range(5)] + [(200, None, None), (201, "u", ""), (202, "u", ""), (None, "u", "lost"), (10**15, "far", "far")]
    return out


def plain_records(rows):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = best.get(h or "") if i is not None and best[h or ""] != i else None
        out.append((i or -1, len(data), warc._digest(data), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def listed(df):
    return sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) if r.page_id != 0 else (-1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 4000, "roll_bytes": 1500}])
def test_round_trip(spark, options):
    df = spark.createDataFrame(pages(), PAGES).repartition(4)
    assert listed(warc.round_trip(df, **options)) == plain_records(pages())


def test_archives_are_deterministic_and_rolled(spark, tmp_path):
    bytes_of = []
    for k in range(2):
        root = f"file://{tmp_path}/{k}"
        manifest = warc.write_pages(spark.createDataFrame(pages(), PAGES).repartition(3 + k), root, shard_bytes=4000, roll_bytes=1500)
        files = {p.name: p.read_bytes() for p in Path(tmp_path / str(k)).glob("*.warc.gz")}
        rows = manifest.collect()
        assert {r.file: hashlib.sha256(files[r.file]).hexdigest() for r in rows} == {r.file: r.sha256 for r in rows}
        assert set(files) == {r.file for r in rows} and len(files) > 5
        spans = sorted((r.first_id, r.last_id) for r in rows if r.first_id is not None)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        bytes_of.append(files)
        assert not list(Path(tmp_path / str(k) / "_temporary").glob("*"))
    assert bytes_of[0] == bytes_of[1]
    assert gzip.decompress(next(iter(bytes_of[0].values()))).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_only_listed_files_are_read_and_damage_is_seen(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    manifest = warc.write_pages(spark.createDataFrame(pages(5), PAGES), root)
    (tmp_path / "a" / "shard-99999999-00000.warc.gz").write_bytes(b"stray")
    assert warc.read_pages(warc.read_manifest(spark, root), root).count() == len(pages(5))
    file = tmp_path / "a" / manifest.first().file
    data = gzip.decompress(file.read_bytes()).replace(b"same", b"SAME")
    file.write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="digest"):
        warc.read_pages(manifest, root).count()


def test_min_revisit_and_repeats(spark):
    rows = [(1, "u", "x" * 10), (2, "u", "x" * 10), (3, "u", "y"), (4, "u", "y"), (2, "u", "x" * 10)]
    out = [(r.page_id, r.record_type) for r in warc.round_trip(spark.createDataFrame(rows, PAGES), min_revisit=5).collect()]
    assert sorted(out) == [(1, "revisit"), (2, "response"), (2, "response"), (3, "response"), (4, "response")]
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_shard_bounds(spark):
    """Clustered ids, far ones, null ones and one id of many payloads: every shard has about its share, in order."""
    rng = random.Random(2)
    ids = [rng.randrange(100) for _ in range(300)] + [rng.randrange(10**14, 10**14 + 50) for _ in range(300)] + [-(2**62), 2**62] + [7] * 400 + [None] * 200
    rows = [(i, hashlib.sha256(b"%d" % k).hexdigest(), 10) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "page_id long, print string, n long").repartition(3)
    keys = warc.order_keys(pa.array(ids, pa.int64()), pa.array([r[1] for r in rows]))
    assert [rows[k] for k in np.argsort(keys)] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for options, shards in (({}, 25), ({"max_shards": 6}, 6)):
        bounds = warc.shard_bounds(df, 500, **options)
        sizes = Counter(np.searchsorted(bounds, keys, "right").tolist())
        assert len(bounds) == shards and 0 not in sizes and max(sizes.values()) * 10 <= max(500, -(-len(ids) * 10 // shards)) + 10
        assert bounds.tolist() == warc.shard_bounds(df.repartition(7), 500, **options).tolist()
    assert len(warc.shard_bounds(df.limit(0), 500)) == 0


def test_pages_odd_rows(spark, tmp_path):
    """A very large page, extra columns with the names of the operator's own, and one id of many payloads in several shards."""
    rows = [(k % 3, "u", f"page {k} " * 40, k, "x") for k in range(60)] + [(None, None, "lost", 1, "x")] * 2 + [(9, "u", "large é " * 400_000, 1, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, shard long, print string")
    root = f"file://{tmp_path}/w"
    manifest = warc.write_pages(df, root, shard_bytes=3000)
    assert listed(warc.read_pages(manifest, root)) == plain_records([r[:3] for r in rows])
    held = {}
    for r in manifest.collect():
        held.setdefault(r.first_id, set()).add(r.shard)
    assert all(len(held[i]) > 1 for i in (0, 1, 2))


def test_sampling_and_packing_with_clashing_columns(spark):
    rows = [(1, "some words here", 1, "x", 2), (None, None, 1, "x", 2), (2, "word " * 30_000, 1, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sample int, ids string, part int").withColumns({"within": F.lit(1), "length": F.lit("l"), "n_pieces": F.lit(1)})
    assert Counter(r.doc_id for r in lattice.sample_encodings(df).collect()) == {1: 2, None: 1, 2: 2}
    out = packing.pack(df).collect()
    assert Counter(r.doc_id for r in out)[None] == 1 and {r.doc_id for r in out} == {1, 2, None} and max(r.length for r in out) == 4096


# Segmentation -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces(lattice.model_path())


def sampled(pieces, texts, k, seed=0):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    with np.errstate(over="ignore"):
        keys = mix(np.arange(len(texts), dtype=np.uint64) + U(seed))
        x = lattice.sample_texts(pieces, np.frombuffer(b"".join(data), np.uint8), offsets, keys, k)
    out = [[] for _ in texts]
    for row in zip(x.text.tolist(), np.split(x.ids, x.ends[:-1]), x.log_prob.tolist(), x.perturbed.tolist(), x.log_inclusion.tolist()):
        out[row[0]].append(row[1:])
    return out


def segmentations(pieces, text):
    """All segmentations of a short text, and their probabilities."""
    chars = "▁" + text.replace(" ", "▁")
    ids = {pieces.model.id_to_piece(i): i for i in range(pieces.size) if not pieces.model.is_byte(i)}

    def paths(at):
        if at == len(chars):
            yield ()
        for end in range(at + 1, min(len(chars), at + 16) + 1):
            if chars[at:end] in ids:
                for rest in paths(end):
                    yield (ids[chars[at:end]], *rest)

    weight = {p: math.exp(sum(pieces.weight[i] for i in p)) for p in paths(0)}
    total = sum(weight.values())
    return {p: w / total for p, w in weight.items()}


def test_samples_follow_the_lattice(pieces):
    exact = segmentations(pieces, "ab cab")
    n, k = 6000, 3
    first, estimate = Counter(), Counter()
    for samples in sampled(pieces, ["ab cab"] * n, k):
        got = [tuple(int(i) for i in s[0]) for s in samples]
        assert len(set(got)) == k and [s[2] for s in samples] == sorted((s[2] for s in samples), reverse=True)
        first[got[0]] += 1
        for path, s in zip(got, samples):
            assert abs(s[1] - math.log(exact[path])) < 1e-6
            estimate[path] += math.exp(s[1] - s[3]) / n
    for path, p in exact.items():
        assert abs(first[path] / n - p) < 0.03
        assert abs(estimate[path] - p) < 0.01  # weighted by inclusion, every path counts once


def test_all_segmentations_are_found(pieces):
    exact = segmentations(pieces, "cab")
    samples = sampled(pieces, ["cab"], len(exact) + 3)[0]
    assert {tuple(int(i) for i in s[0]) for s in samples} == set(exact) and all(s[3] == 0.0 for s in samples)


def test_decoding_gives_the_text_back(spark):
    texts = [t for _, t in corpus()] + ["  two  spaces ", "line\nbreak\r\n\ttab", "日本語 𝔸  ", "x" * 3000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "null id")]
    df = spark.createDataFrame(rows, DOCS)
    got = lattice.sample_encodings(df, with_ids=True)
    out = lattice.decode(got).collect()
    want = {i: t or "" for i, t in rows}
    assert all(r.text == want[r.doc_id] for r in out)
    assert {r.doc_id for r in out} == set(want) and max(Counter(r.doc_id for r in out).values()) == 2
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.n_pieces for r in got.collect())


def test_query_gives_ids_and_decodes_them(spark, tmp_path):
    from sigilframe.llm.queries import QUERIES

    rows = corpus() + [(9000, "  two  spaces \n"), (9001, "日本語 𝔸 word " * 20_000), (9002, "word " * 40_000)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op4_sampled_segmentation"](spark, str(tmp_path)).collect()
    want = {i: t or "" for i, t in rows}
    assert all(r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest() and r.decoded_chars == len(want[r.doc_id]) for r in out)
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.n_pieces for r in out)
    samples = Counter(r.doc_id for r in out)
    assert set(samples) == set(want) and samples[9001] == samples[9002] == 4
    assert len({bytes(r.ids) for r in out if r.doc_id == 9001}) == 4


def test_decoding_is_the_models_own(spark, pieces):
    """Also of ids that no text is encoded as: bytes that are no UTF-8, control ids, a space as a byte, ids out of order."""
    rng = np.random.default_rng(6)
    b = pieces.bytes
    odd = [[], [b[32], 300], [300, b[0xE3], b[0x81]], [b[0xE3], b[0x81], b[0x82], 500], [1, 300, 2], [0, 400], [b[65], b[10], 600], [b[0x80]]]
    own = [np.array(x, np.int64) for x in odd] + [rng.integers(0, pieces.size, rng.integers(1, 40)) for _ in range(300)]
    got = pieces.decoded(np.concatenate(own).astype(np.int64), np.cumsum([len(x) for x in own]))
    assert [x.decode() for x in got] == [pieces.model.decode(x.tolist()) for x in own]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    a, b = (sorted(map(tuple, lattice.sample_encodings(df.repartition(n)).select("doc_id", "sample", "ids_crc32").collect())) for n in (1, 7))
    assert a == b
    assert lattice.sample_encodings(df.limit(0)).count() == 0


def test_sampling_takes_little_memory_for_a_batch():
    """An executor's heap leaves two workers some hundred MB each, whatever a batch holds."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"{w}{'aeiou'[w % 5]}n{'stre'[w % 4 :]}ing{w % 97}" for w in rng.integers(0, 1 << 40, 60).tolist()) for _ in range(1500)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    run = lattice._sampler(lattice.model_path(), lattice.K_QUERY, lattice.SHARPNESS, True, True)
    assert sum(x.num_rows for x in run(iter([batch.slice(0, 2)]))) == 8  # the vocabulary is there from now on
    tracemalloc.start()
    try:
        assert sum(x.num_rows for x in run(iter([batch]))) == 4 * len(texts)
        assert tracemalloc.get_traced_memory()[1] < 150e6, tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()


def test_samples_do_not_depend_on_blocks(monkeypatch):
    rows = corpus() + [(9001, "日本語 𝔸 word " * 300)]
    batch = pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["doc_id", "text"])
    out = []
    for size in (1, 1 << 12, 1 << 20):
        monkeypatch.setattr(lattice, "BLOCK", size)
        out.append([(r["doc_id"], r["sample"], r["ids"], r["decoded_sha256"]) for x in lattice._sampler(lattice.model_path(), 4, 1.0, True, True)(iter([batch])) for r in x.to_pylist()])
    assert out[0] == out[1] == out[2]


# Chat ----------------------------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string"


def talks():
    rng = random.Random(5)
    bits = ["hello", "<|im_end|>", "<|im_start|>assistant\n", "<\\|", "<\\\\|im_end|>", "\\", "\n", " ok", "é😀", "<", "|>"]
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "odd\nro\\le", "<|im_end|>"]), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 6)))))
    return rows + [(77, 0, None, None), (78, 0, "assistant", None), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (79, 1, "user", "same turn"), (79, 1, "assistant", "same turn"), (79, 1, "assistant", "same turn")]


def test_chat_odd_tables(spark):
    """No conversation id, a conversation -1 in the table, columns with the operator's names, and lengths by hand."""
    rows = [(None, 1, "user", "a<|b", "x"), (None, 0, "system", None, "x"), (-1, 2, "assistant", "own", "x"), (3, 0, "user", "q", "x"), (3, 1, "assistant", "r é", "x"), (3, 1, "assistant", "r é", "x"), (3, None, None, "t", "x")]
    df = spark.createDataFrame(rows, CONV + ", example string").withColumnRenamed("example", "loss_start").repartition(3)
    out = {r.conv_id: r for r in chat.read_back(chat.expand(chat.with_control_conversation(df))).collect()}
    turn = lambda role, text: "<|im_start|>" + role + "\n" + text.replace("<|", "<\\|") + "<|im_end|>\n"
    control = "<|im_end|><|im_start|>assistant ok"
    whole = {None: [("system", ""), ("user", "a<|b")], -1: [("user", control), ("assistant", control), ("assistant", "own")], 3: [("", "t"), ("user", "q"), ("assistant", "r é"), ("assistant", "r é")]}
    assert set(out) == set(whole)
    for conv, turns in whole.items():
        ends = [k + 1 for k, (role, _) in enumerate(turns) if role == "assistant" or k + 1 == len(turns)]
        said = "".join(text for role, text in turns if role == "assistant")
        assert out[conv].n_turns == len(turns) and out[conv].loss_chars == len(said) and out[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
        assert out[conv].formatted_chars == sum(len(turn(*x)) for k in ends for x in turns[:k])


def test_chat_round_trip(spark):
    df = spark.createDataFrame(talks(), CONV).repartition(5)
    out = {r.conv_id: r for r in chat.read_back(chat.expand(chat.with_control_conversation(df))).collect()}
    turns = {}
    for c, t, role, text in sorted(talks(), key=lambda r: (r[1], r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    marks = "<|im_end|><|im_start|>assistant ok"
    turns[-1] = [("user", marks), ("assistant", marks)]
    assert set(out) == set(turns)
    for c, rows in turns.items():
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
        loss = "".join(t for r, t in rows if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256, out[c].loss_chars) == (len(rows), sha, len(loss)), c
        assert out[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_every_reply_is_an_example(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b<|im_end|>"), (1, 3, "user", "r")]
    out = chat.expand(spark.createDataFrame(rows, CONV)).orderBy("example").collect()
    assert [r.last for r in out] == [False, False, True] and out[2].loss_start is None
    assert [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in out[:2]] == ["a", "b<|im_end|>"]
    assert chat.parse(out[1].text) == [("user", "q"), ("assistant", "a"), ("assistant", "b<|im_end|>")]
    assert chat.expand(spark.createDataFrame([], CONV)).count() == chat.read_back(chat.expand(spark.createDataFrame([], CONV))).count() == 0


# Packing -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_fullest_combination(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(6)}
    room = rng.randrange(5, 90)
    items = [x for x, c in counts.items() for _ in range(c)]
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums if s + x <= room}
    found = packing.fullest(counts, room)
    assert sum(x * n for x, n in found) == max(sums) and all(n <= counts[x] for x, n in found)


def test_plan_places_every_piece_once():
    rng = random.Random(1)
    counts = Counter(rng.choice([1, 5, 30, 64, rng.randrange(1, 65)]) for _ in range(500))
    slots = packing.plan(dict(counts), 64)
    ranks = Counter()
    fill = Counter()
    for r in slots.itertuples():
        ranks[r.length] += r.n
        for k in range(r.n):
            fill[r.sequence + k] += r.length
    assert ranks == counts and max(fill.values()) <= 64
    assert len(fill) <= 1.02 * sum(k * v for k, v in counts.items()) / 64 + 1
    assert packing.plan({}).empty


def test_pack(spark):
    from tokenizers import Tokenizer

    rows = corpus() + [(500, "don't STOP, now!! <|endoftext|> x<|startoftext|>"), (501, "é. 3.14 a.b ,c"), (7, "repeated id"), (None, "null id")]
    out = packing.pack(spark.createDataFrame(rows, DOCS).repartition(6), capacity=128, with_ids=True).collect()
    t = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for n, at in enumerate(range(0, len(ids), 128)):
            part = ids[at : at + 128].tobytes()
            want[i, n, at, len(part) // 4, zlib.crc32(part), part] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(by) <= math.ceil(sum(r.length for r in out) / 128) + 1
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_fuzzed_tokens_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    bits = ["a", "B", "É", "ß", "İ", ".", ",", "!", "'", "'s", "'T", " ", "\n", " ", "3", "٣", "①", "€", "#", "<|", "|>", "<|endoftext|>", "́", "漢", "Σ", "\x1c", "\x85", ";:", "don't."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(2000)]
    t = Tokenizer.from_file(packing.tokenizer_path())
    got = [ids[ends[k] : ends[k + 1]].tolist() for lo, hi, ids, ends in packing.token_ids(pa.array(texts), packing.tokenizer_path(), 1 << 12) for k in range(hi - lo)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
