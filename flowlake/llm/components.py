"""Connected components of a link table, without collecting links anywhere.

Large-star and small-star steps in turn (Kiveris et al., 2014) until the links no longer
change; then every node links to the smallest node of its component.  A step is a minimum
per node, which combines before the shuffle, and a join back, whose hot keys Spark splits;
neighbour lists are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import drop_path, written_at


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def star(links: DataFrame, large: bool) -> DataFrame:
    """links: a, b with a > b."""
    near = both_ways(links) if large else links
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("m", "a").alias("m"))
    joined = near.join(least, near["a"] == least["node"])
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """node, component (its smallest node) for every node of the links (a, b: long)."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, path = written_at(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = mark(now)
    while True:
        last = path
        now, path = written_at(star(star(now, True), False), label)
        drop_path(links.sparkSession, last)
        if (then := mark(now)) == seen:
            break
        seen = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
