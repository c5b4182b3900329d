"""Optional reader of PDF files into glyph tables, as a Python data source named ``pdf_glyphs``.

It needs a PDF library that may not be installed; registering the source does not.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas as S


class _Files(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            import pdfplumber
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the package pdfplumber") from e
        path = partition.value
        paper = path.rsplit("/", 1)[-1].removesuffix(".pdf")
        with pdfplumber.open(path) as document:
            for number, page in enumerate(document.pages, 1):
                for index, c in enumerate(page.chars):
                    yield (paper, number, index, c.get("text"), c.get("fontname"), *(float(c.get(k) or 0) for k in ("x0", "x1", "top", "bottom", "size")), bool(c.get("upright", True)))


class PdfGlyphs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf_glyphs"

    def schema(self) -> str:
        return S.GLYPH

    def reader(self, schema) -> DataSourceReader:
        return _Files(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfGlyphs)
