"""python -m tessera.cli INPUT -o OUTPUT: variants of a file's sentences as JSON lines, and counts of what was made."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import functions as F

from tessera.operators import variants
from tessera.session import session
from tessera.sources.readers import read_sentences, write_records


def main(argv: Sequence[str] | None = None) -> int:
    """0, or 2 if the input is missing or has no sentence."""
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("input")
    parser.add_argument("-o", "--output", required=True)
    parser.add_argument("--quiet", action="store_true")
    args = parser.parse_args(argv)
    spark = session()
    try:
        lines = read_sentences(spark, args.input)
        empty = lines.isEmpty()
    except Exception as error:  # a path that Spark can't read
        if "PATH_NOT_FOUND" not in str(error):
            raise
        empty = True
    if empty:
        print(f"no sentences in {args.input}", file=sys.stderr)
        return 2
    digest = F.substr(F.sha1(F.col("text").cast("binary")), F.lit(1), F.lit(10))
    named = lines.select(F.concat(F.lit("s"), F.lpad(F.col("ord").cast("string"), 5, "0"), F.lit("_"), digest).alias("base_id"), F.col("text").alias("sentence"))
    write_records(variants.run(named), args.output)
    if not args.quiet:
        for row in spark.read.json(args.output).groupBy("family", "operation").count().orderBy(F.desc("count"), "family").collect():
            print(f"{row['count']:8d}  {row.family} ({row.operation})")
    return 0


if __name__ == "__main__":
    sys.exit(main())
