"""Table functions in Python, for SQL with a lateral join."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class SplitAlignments:
    """The entries of an SA tag as rows; entries that lack a part or a number are left out, a null tag has none."""

    def eval(self, tag: str | None) -> Iterator[tuple]:
        for entry in (tag or "").split(";"):
            p = entry.split(",")
            if len(p) >= 6 and all(x.lstrip("+-").isdecimal() for x in (p[1], p[4], p[5])):
                yield p[0], int(p[1]), p[2], p[3], int(p[4]), int(p[5])


def register(spark: SparkSession) -> None:
    """``sa_entries(tag)`` for this session's SQL: ``select ... from records, lateral sa_entries(sa)``."""
    kind = "chrom: string, pos: bigint, strand: string, cigar: string, mapq: int, nm: int"
    spark.udtf.register("sa_entries", udtf(SplitAlignments, returnType=kind))
