"""Reading and checking inputs: uploads, PDF bytes, images, character maps, font tables, stored papers.

PDF pages themselves are decoded by the optional reader in ``pdf.py``; the engine starts from glyph
tables (schemas.GLYPH).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import schemas as S
from ..functions import columns as X

#: Fixed value: the widest code range a character map may hold.
MAX_CODE_RANGE = 4096


def read_glyphs(spark: SparkSession, path: str) -> DataFrame:
    """A glyph table in Parquet; the schema is given, so nothing is inferred and only asked columns are read."""
    return spark.read.schema(S.GLYPH).parquet(path)


def pdf_headers(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, length, valid_header) of files below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", valid_header("content").alias("valid_header"))


def valid_header(content: str):
    """At least five bytes that begin with the mark of a PDF."""
    head = F.substring(F.col(content), 1, 5)
    return (F.octet_length(F.col(content)) >= 5) & (head == F.lit(b"%PDF-"))


def split_uploads(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted files, one row with the number of rejected ones), by name or MIME type."""
    ok = X.is_pdf_upload("name", "mime")
    return files.filter(ok), files.agg(F.count_if(~ok).alias("rejected"))


def validated(files: DataFrame) -> DataFrame:
    """Adds ``error``: null, or why a file is turned away; bad rows go to quarantine instead of failing a job."""
    return files.withColumn(
        "error",
        F.when(F.col("content").isNull(), "missing").when(~valid_header("content"), "not a PDF").when(F.coalesce("pages", F.lit(0)) <= 0, "no pages").when(F.col("pages") != F.col("pages_check"), "page counts differ"),
    )


def image_regions(images: DataFrame) -> DataFrame:
    """Images that can be formulas or figures; rules and table borders are left out.  The region keeps the image's own number."""
    box = F.array(*(F.bround(c, 3) for c in ("x0", "top", "x1", "bottom")))
    small = (F.col("width") < 100) & (F.col("height") < 100)
    return images.filter(X.kept_image("width", "height")).select(
        "paper_id", "page", F.concat(F.lit("image:"), F.col("index").cast("string")).alias("region_id"), box.alias("bbox"),
        F.when(small, "image_or_glyph_mask").otherwise("large_image").alias("kind"), F.lit("pdf_image_object").alias("source"),
    )


def image_runs(images: DataFrame, shift: float = 16.0, gap: float = 18.0) -> DataFrame:
    """Runs of two or more small masks on one baseline: (paper_id, page, run, images, bbox)."""
    w = Window.partitionBy("paper_id", "page").orderBy("cy", "x0")
    rows = images.withColumn("cy", (F.col("top") + F.col("bottom")) / 2)
    new = (F.abs(F.col("cy") - F.lag("cy").over(w)) > shift) | (F.col("x0") - F.lag("x1").over(w) > gap)
    run = F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w)
    out = rows.withColumn("run", run).groupBy("paper_id", "page", "run").agg(F.count("*").alias("images"), F.array(F.min("x0"), F.min("top"), F.max("x1"), F.max("bottom")).alias("bbox"))
    return out.filter("images >= 2")


def visual_regions(images: DataFrame) -> DataFrame:
    """Large images and runs of small masks on one baseline, in one table of regions."""
    large = image_regions(images).filter("kind = 'large_image'").select("paper_id", "page", "region_id", "bbox", "kind")
    small = images.filter(X.kept_image("width", "height") & (F.col("width") < 100) & (F.col("height") < 100))
    runs = image_runs(small).select("paper_id", "page", F.concat(F.lit("run:"), F.col("run").cast("string")).alias("region_id"), F.transform("bbox", lambda c: F.bround(c, 3)).alias("bbox"), F.lit("compact_run").alias("kind"))
    return large.unionByName(runs)


# Character maps ------------------------------------------------------------------------------


def cmap_lines(text: str) -> list[tuple[int, int, int]]:
    """(first code, last code, first character) of each usable line of a character map."""
    out, kind = [], None
    number = re.compile(r"<([0-9A-Fa-f]+)>")
    for line in map(str.strip, text.splitlines()):
        if m := re.fullmatch(r"(begin|end)bf(char|range)", line):
            kind = m[2] if m[1] == "begin" else None
            continue
        want = {"char": 2, "range": 3}.get(kind)
        if not want or not re.fullmatch(r"\s+".join([number.pattern] * want), line):
            continue
        codes = [int(x, 16) for x in number.findall(line)]
        lo, hi, char = codes if want == 3 else (codes[0], *codes)
        if lo <= hi <= lo + MAX_CODE_RANGE:
            out.append((lo, hi, char))
    return out


def parse_cmaps(cmaps: DataFrame) -> DataFrame:
    """cmaps: (paper_id, font, page, data binary) -> (paper_id, font, page, code, ch); a later line of a map wins.

    Lines are found once a map; their ranges are spread and turned into characters on the JVM.
    """
    keys = "paper_id string, font string, page int"

    def run(batches):
        for pdf in batches:
            rows = [(r.paper_id, r.font, r.page, k, *x) for r in pdf.itertuples() for k, x in enumerate(cmap_lines(bytes(r.data).decode("latin1")))]
            yield pd.DataFrame(rows, columns=["paper_id", "font", "page", "line", "lo", "hi", "char"])

    lines = cmaps.select("paper_id", "font", "page", "data").mapInPandas(run, f"{keys}, line int, lo long, hi long, char long")
    spread = lines.withColumn("code", F.explode(F.sequence("lo", "hi"))).withColumn("point", F.col("char") + F.col("code") - F.col("lo")).filter(f"point <= {0x10FFFF}")
    last = spread.groupBy("paper_id", "font", "page", "code").agg(F.max_by("point", "line").alias("point"))
    return last.select("paper_id", "font", "page", F.col("code").cast("int"), X.code_point(F.hex("point")).alias("ch"))


def font_codes(to_unicode: DataFrame, differences: DataFrame) -> DataFrame:
    """(paper_id, font, code, ch) from two sources of (paper_id, font, page, code, ch).

    Within a page's font the character map wins over named differences; a later page's map wins over
    earlier ones, differences only fill what is empty.  Each font also stands under its family name,
    where maps of the full name win.
    """
    both = to_unicode.withColumn("rank", F.struct(F.lit(1).alias("map"), F.col("page").alias("at"))).unionByName(differences.withColumn("rank", F.struct(F.lit(0).alias("map"), (-F.col("page")).alias("at"))))
    full = both.groupBy("paper_id", "font", "code").agg(F.max_by("ch", "rank").alias("ch"), F.max("rank").alias("rank"))
    family = full.withColumn("font", X.font_family("font"))
    named = full.withColumn("own", F.lit(1)).unionByName(family.withColumn("own", F.lit(0)))
    return named.groupBy("paper_id", "font", "code").agg(F.max_by("ch", F.struct("own", "rank")).alias("ch"))


# Metadata and stored papers --------------------------------------------------------------------


def metadata(files: DataFrame) -> DataFrame:
    """files: (paper_id, name, title, subject, author, producer, creator, first_page, pages, file_size)."""
    named = X.filename_metadata("name")
    return files.select(
        "paper_id",
        F.coalesce(X.real_title("title"), named["title"], X.file_stem("name")).alias("title"),
        F.coalesce(F.nullif(X.trim_all(F.coalesce("author", F.lit(""))), F.lit("")), named["authors"], F.lit("")).alias("authors"),
        "producer", "creator",
        X.first_year(named["year"], X.file_stem("name"), F.col("title"), F.col("subject"), first_page="first_page").alias("year"),
        "pages", "file_size",
    )


def list_papers(spark: SparkSession, path: str, schema: str, titles: DataFrame | None = None) -> DataFrame:
    """Stored documents, one JSON file each; files that do not parse are passed over, unsafe ids too; newest first."""
    rows = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.filter("_bad is null").drop("_bad").filter(X.safe_paper_id("paper_id"))
    if titles is not None:
        rows = rows.join(titles.withColumnRenamed("title", "own_title"), "paper_id", "left").withColumn("title", F.coalesce("own_title", "title")).drop("own_title")
    return rows.orderBy(F.desc("paper_id"))


def write_documents(documents: DataFrame, path: str) -> None:
    """Nested documents as JSON lines; the committer publishes whole files only."""
    documents.write.mode("overwrite").json(path)


def allowed_endpoint(url):
    """Model endpoints: HTTPS, or HTTP on the loopback host."""
    return F.coalesce(F.col(url).rlike(r"^https://[^/\s]+") | F.col(url).rlike(r"^http://(localhost|127\.0\.0\.1|\[::1\])(:\d+)?(/|$)"), F.lit(False))


def as_data_url(content, mime: str = "image/png"):
    """One line, whatever the session says of breaking base64 into lines."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.translate(F.base64(F.col(content)), "\r\n", ""))
