"""What the corpus operators share: tables, shared scratch space, text and carried columns.

Rows are documents ``(doc_id, text)``.  A null text counts as an empty one, extra
columns are ignored unless an operator is told to carry them, and a null doc_id is
kept as it is.  A carried column may have any name: inside, it goes by a name of its own,
and where the operator returns a column of that name (case aside) the operator's is returned and
the carried one is left out.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.scratch import SCRATCH, drop_path, drop_scratch, scratch, shared_dir, written, written_at  # noqa: F401


class Carried:
    """Columns of `docs` that pass through an operator which returns the columns `own`."""

    def __init__(self, docs: DataFrame, carry: Iterable[str], own: Iterable[str]):
        taken = {c.lower() for c in own}
        self.names = {c: f"_carried_{k}" for k, c in enumerate(carry) if c.lower() not in taken}
        self.inside = tuple(self.names.values())
        self.columns = [F.col(f"`{c}`").alias(n) for c, n in self.names.items()]
        self.schema = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for c, n in self.names.items())

    def back(self, rows: DataFrame) -> DataFrame:
        """Rows with the carried columns under their own names, last."""
        return rows.select(*[c for c in rows.columns if c not in self.inside], *[F.col(n).alias(c) for c, n in self.names.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, carry: Iterable = ()) -> DataFrame:
    """Only doc_id (long), text (string, empty for null) and the columns in carry."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def measure(docs: DataFrame) -> tuple[int, int]:
    """Rows and text bytes of all documents; two numbers are all that reaches the driver."""
    r = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return int(r[0]), int(r[1] or 0)
