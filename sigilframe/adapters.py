"""The driver's tables seen as the engine's: papers, lines, tokens, memberships, updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A letter that no other letter touches; the left separator is part of the match, the right one is not.
LONE_LETTER = r"(?:^|[^A-Za-zÀ-ÿ])([A-Za-z])(?=$|[^A-Za-zÀ-ÿ])"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def documents(self) -> DataFrame:
        return self.table("documents")

    def lines(self) -> DataFrame:
        """(doc_id, line, text), lines from 0."""
        return self.documents().select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))

    def tokens(self) -> DataFrame:
        """(doc_id, line, pos, surface): lone letters by line, numbered along it."""
        return self.lines().select("doc_id", "line", "text", F.posexplode(F.regexp_extract_all("text", F.lit(LONE_LETTER), F.lit(1))).alias("pos", "surface"))

    def papers(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("authors"), F.col("p_type").alias("venue"))

    def folders(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("folder_id"), F.col("s_name").alias("name"))

    def membership(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_suppkey").alias("folder_id"), F.col("l_partkey").alias("paper_id")).distinct()

    def updates(self) -> DataFrame:
        """Event rows as an ordered log of (ordinal, id, meaning); a user's number stands for a document's."""
        return self.table("events").select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("id"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("meaning"))

    def benchmark_glyphs(self) -> tuple[DataFrame, DataFrame]:
        """(glyphs, pages) of the benchmark texts: a character is 5 wide, a line 14 high; spaces have no glyph."""
        lines = self.table("benchmark").select(F.col("item_id").cast("string").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
        chars = lines.select("paper_id", "line", F.posexplode(F.split("text", "")).alias("col", "ch")).filter("ch <> '' and ch <> ' '")
        glyphs = chars.select(
            "paper_id", F.lit(1).alias("page"), (F.col("line") * 10000 + F.col("col")).alias("index"), F.col("ch").alias("text"), F.lit("CMR10").alias("fontname"),
            (F.col("col") * 5.0).alias("x0"), (F.col("col") * 5.0 + 5.0).alias("x1"), (F.col("line") * 14.0).alias("top"), (F.col("line") * 14.0 + 10.0).alias("bottom"), F.lit(10.0).alias("size"), F.lit(True).alias("upright"),
        )
        return glyphs, lines.select("paper_id", F.lit(1).alias("page"), F.lit(0.0).alias("width"), F.lit(0.0).alias("height")).distinct()
