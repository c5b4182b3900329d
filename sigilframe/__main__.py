"""Job entry point: glyph and page tables in, one nested document a paper out."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import schemas as S
from .plans.symbol_pool import Papers, documents
from .sources.documents import read_glyphs, write_documents


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="sigilframe", description=__doc__)
    parser.add_argument("glyphs")
    parser.add_argument("pages")
    parser.add_argument("--fonts", help="font code table")
    parser.add_argument("--out", required=True)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("sigilframe").getOrCreate()
    try:
        fonts = spark.read.schema(S.FONT_CODE).parquet(given.fonts) if given.fonts else None
        papers = Papers(read_glyphs(spark, given.glyphs), spark.read.schema(S.PAGE).parquet(given.pages), fonts)
        write_documents(documents(papers), given.out)
    except Exception as e:
        print(json.dumps({"status": "error", "error": str(e).splitlines()[0]}), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
