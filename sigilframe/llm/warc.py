"""Deterministic sharded WARC writer and its reader.

Method.  Records are cut into shards by ranges of their id, sorted inside each shard, and written one
gzip member per record; a shard rolls to its next file once the compressed bytes reach ``roll_bytes``.
Headers, record ids and digests are made from the rows alone (the date is a parameter), so the same
rows give the same bytes.  A file is written under a temporary name and renamed when whole; readers
take only files that the manifest, written last, lists with size and digest.  A task that is run
again renames the same bytes over the same name.

Scale.  Ranges come from every record's exact place in bytes, so no sample decides them: narrow rows
are sorted by range, running sums are kept inside each range, and what reaches the driver is one sum a
range and one bound a shard, of which there are ``MAX_SHARDS`` at most (shards grow beyond that).  Bounds
are pairs of id and payload digest, so rows that share an id are parted too.  Which record of equal
payloads is the response is found on digests alone, with map-side maxima; the most common payload's rows
are joined with a written table, so that the planner can split them.  These decisions travel with the
pages through one shuffle of the payloads, in which shard k is partition k.  Writers and readers hold one
record at a time.

Defined results.  Null html is the empty payload, null url the page's URN.  Of equal payloads of at
least ``min_revisit`` bytes the largest page_id is the response; rows that repeat both are all
responses.  Null page ids are responses, in the first shards.  An empty table gives an empty archive.
Columns other than ``page_id``, ``url``, ``html`` are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .stores import discard, keep, new_dir

ROLL_BYTES, SHARD_BYTES, MIN_REVISIT = 32 << 20, 64 << 20, 0
DATE = "2024-01-01T00:00:00Z"
LEVEL = 5
MAX_SHARDS = 1 << 16
_KEY = 73  # bytes of a record's place in the order
_SPACE = uuid.UUID("6f0c1d52-5b0e-4a55-9d0f-3f4a8f2d7c11")
_MANIFEST = "file string, shard long, part long, records long, bytes long, sha256 string, first_id long, last_id long"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}/{copy}')}>"


def _record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{_digest(block)}"), ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes, refers_to, date: str, copy: int = 0) -> bytes:
    """The bytes of a response, or of a revisit where ``refers_to`` names the response's page."""
    digest = _digest(payload)
    uri = "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Record-ID", _record_id(page_id, digest, copy)), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-Id", page_id),
    ]
    if refers_to is None:
        return _record("response", fields, http + payload)
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to, digest, 0)), ("Refers-To-Page-Id", refers_to)]
    return _record("revisit", fields, http)


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Shard:
    """Writes one shard's files; ``done`` has a manifest row for each that is whole."""

    def __init__(self, root: str, shard: int, roll_bytes: int, date: str):
        self.fs, self.path = pafs.FileSystem.from_uri(root)
        self.shard, self.roll, self.date = shard, roll_bytes, date
        self.part, self.out, self.done = 0, None, []

    def _open(self) -> None:
        self.tmp = f"{self.path}/_temporary/{self.shard:08d}-{self.part:05d}-{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
        self.out, self.sha = self.fs.open_output_stream(self.tmp, compression=None), hashlib.sha256()
        self.size = self.records = 0
        self.first = self.last = None
        name = f"shard-{self.shard:08d}-{self.part:05d}.warc.gz"
        self._put(_record("warcinfo", [("WARC-Record-ID", _record_id(name, "info", 0)), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.name = name

    def _put(self, record: bytes) -> None:
        data = _gzip(record)
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def add(self, page_id, record: bytes) -> None:
        if self.out is None:
            self._open()
        self._put(record)
        self.records += 1
        self.first = page_id if self.first is None else self.first
        self.last = page_id
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.fs.move(self.tmp, f"{self.path}/{self.name}")
        self.done.append((self.name, self.shard, self.part, self.records, self.size, self.sha.hexdigest(), self.first, self.last))
        self.out, self.part = None, self.part + 1


def _writer(root: str, roll_bytes: int, date: str):
    """Rows (shard, page_id, url, html, print, refers_to, is_page) in order; decisions stand before their pages."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at, refers, copy, done = None, None, None, 0, []
        for batch in batches:
            columns = [batch.column(k) for k in range(7)]
            for i in range(batch.num_rows):
                number, page_id, url, html, mark, to, is_page = (c[i] for c in columns)
                number, page_id, mark = number.as_py(), page_id.as_py(), mark.as_py()
                if shard is None or number != shard.shard:
                    if shard:
                        shard.close()
                        done += shard.done
                    shard, at = _Shard(root, number, roll_bytes, date), None
                if at != (page_id, mark):
                    at, refers, copy = (page_id, mark), None, 0
                if not is_page.as_py():
                    refers = to.as_py()
                    continue
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                shard.add(page_id, page_record(page_id, url.as_py(), payload, refers, date, copy))
                copy += 1
        if shard:
            shard.close()
            done += shard.done
        names = [f.split(" ")[0] for f in _MANIFEST.split(", ")]
        types = [pa.string() if f.endswith("string") else pa.int64() for f in _MANIFEST.split(", ")]
        cols = list(zip(*done)) or [[]] * len(names)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names)

    return write


def order_keys(ids: pa.Array, prints: pa.Array) -> np.ndarray:
    """Byte strings in the order of (id, print), null ids first; prints are hexadecimal and end no key in a zero byte."""
    out = np.zeros((len(ids), _KEY), np.uint8)
    out[:, 0] = ids.is_valid().to_numpy(zero_copy_only=False)
    whole = ids.fill_null(np.iinfo(np.int64).min).to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    out[:, 1:9] = whole.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(ids):
        out[:, 9:] = np.frombuffer("".join(prints.to_pylist()).encode(), np.uint8).reshape(len(ids), -1)
    return out.reshape(-1).view(f"S{_KEY}")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (page_id, print, n) -> the same with their range and the bytes before them in it."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(2).to_numpy()
        ends = before + np.cumsum(n)
        if len(n):
            before = int(ends[-1])
        yield pa.record_batch([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)], ["page_id", "print", "n", "part", "before"])


def shard_bounds(sizes: DataFrame, shard_bytes: int, max_shards: int = MAX_SHARDS) -> np.ndarray:
    """The order_keys of the first record of each shard, from (page_id, print, n) of all records.

    A record is in the shard that its first byte falls in when all records stand in order.
    """
    ordered = sizes.repartitionByRange("page_id", "print").sortWithinPartitions("page_id", "print")
    placed = keep(ordered.select("page_id", "print", "n").mapInArrow(_running, "page_id long, print string, n long, part int, before long"), "placed")
    offsets, total = [], 0
    for row in placed.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n")).orderBy("part").collect():  # one row a range
        offsets.append((row.part, total))
        total += row.n
    if not total:
        return np.zeros(0, f"S{_KEY}")
    width = max(shard_bytes, -(-total // max_shards))
    starts = F.broadcast(sizes.sparkSession.createDataFrame(offsets, "part int, start long"))
    first = placed.join(starts, "part").groupBy(F.expr(f"(start + before) div {width}").alias("shard")).agg(F.min(F.struct("page_id", "print")).alias("first"))
    rows = first.select("first.*").toArrow().combine_chunks()  # max_shards rows at most
    return np.sort(order_keys(rows["page_id"].combine_chunks(), rows["print"].combine_chunks()))


def write_pages(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, min_revisit: int = MIN_REVISIT, date: str = DATE, max_shards: int = MAX_SHARDS) -> DataFrame:
    """Write ``pages`` below ``root``, an address all executors reach; returns the committed manifest."""
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(html, 256).alias("print"))
    narrow = keep(rows.select("page_id", "print", F.octet_length(html).cast("long").alias("n")), "sizes")
    # A table of its own, so that the join's partition of the most common payload can be split.
    best = keep(narrow.filter((F.col("n") >= min_revisit) & F.col("page_id").isNotNull()).groupBy("print").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).filter("c > 1").drop("c"), "best")
    revisits = narrow.join(best, "print").filter("page_id < refers_to").select("page_id", "print", "refers_to").distinct()
    bounds = shard_bounds(narrow.withColumn("n", F.col("n") + 512), shard_bytes, max_shards)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series, prints: pd.Series) -> pd.Series:
        keys = order_keys(pa.array(ids, pa.int64(), from_pandas=True), pa.array(prints, pa.string()))
        return pd.Series(np.searchsorted(bounds, keys, "right") - 1)

    none = lambda kind: F.lit(None).cast(kind)
    decisions = revisits.select("page_id", none("string").alias("url"), none("string").alias("html"), "print", "refers_to", F.lit(False).alias("is_page"))
    whole = rows.select("page_id", "url", "html", "print", none("long").alias("refers_to"), F.lit(True).alias("is_page"))
    ordered = decisions.union(whole).withColumn("shard", shard_of("page_id", "print")).repartitionById(max(1, len(bounds)), "shard")
    ordered = ordered.sortWithinPartitions("page_id", "print", "is_page", "url").select("shard", "page_id", "url", "html", "print", "refers_to", "is_page")
    ordered.mapInArrow(_writer(root, roll_bytes, date), _MANIFEST).write.parquet(f"{root}/_manifest")
    discard(spark, f"{root}/_temporary")  # what lost tasks left behind
    return read_manifest(spark, root)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{root}/_manifest")


def parse_records(stream, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a .warc.gz stream, one at a time."""
    z, held, need, fields = zlib.decompressobj(31), bytearray(), None, None
    raw = stream.read(size)
    while raw:
        while raw:
            held += z.decompress(raw)
            raw = z.unused_data if z.eof else b""
            if z.eof:
                z = zlib.decompressobj(31)
            while True:
                if need is None:
                    end = held.find(b"\r\n\r\n")
                    if end < 0:
                        break
                    lines = bytes(held[:end]).decode().split("\r\n")
                    if lines[0] != "WARC/1.1":
                        raise ValueError(f"not a record: {lines[0][:40]!r}")
                    fields = dict(x.split(": ", 1) for x in lines[1:])
                    need = int(fields["Content-Length"])
                    del held[: end + 4]
                if len(held) < need + 4:
                    break
                block = bytes(held[:need])
                if held[need : need + 4] != b"\r\n\r\n":
                    raise ValueError("a record is longer than its header says")
                del held[: need + 4]
                need = None
                yield fields, block
        raw = stream.read(size)
    if held or need is not None:
        raise ValueError("the file ends inside a record")


def _reader(root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name, records in zip(batch["file"].to_pylist(), batch["records"].to_pylist()):
                out, seen = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for fields, block in parse_records(stream):
                        if fields["WARC-Block-Digest"] != f"sha1:{_digest(block)}":
                            raise ValueError(f"{name}: a block does not have its digest")
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (digest != _digest(payload) or int(http["Content-Length"]) != len(payload)):
                            raise ValueError(f"{name}: a payload does not have its digest")
                        page, to = fields.get("Page-Id"), fields.get("Refers-To-Page-Id")
                        out.append((page and int(page), int(http["Content-Length"]), digest, fields["WARC-Type"], to and int(to)))
                        seen += 1
                        if len(out) >= 4096:
                            yield _rows(out)
                            out = []
                if seen != records:
                    raise ValueError(f"{name}: {seen} records, the manifest has {records}")
                if out:
                    yield _rows(out)

    return read


_ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ") for x in _ROWS.split(", ")))
    return pa.record_batch([pa.array(c, pa.string() if k == "string" else pa.int64()) for c, k in zip(zip(*out), kinds)], list(names))


def read_pages(manifest: DataFrame, root: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record listed; digests are verified."""
    files = manifest.select("file", "records")
    return files.repartition(max(1, min(files.count(), 10_000)), "file").mapInArrow(_reader(root), _ROWS)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the archive into the shared folder, and read it back."""
    root = new_dir(pages.sparkSession, "warc")
    return read_pages(write_pages(pages, root, **options), root)
