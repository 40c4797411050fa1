"""What the operators of this subpackage share: session settings, shared-folder tables and size checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.storage import BROADCAST_BYTES, shared_dir, small, stored

__all__ = ["BROADCAST_BYTES", "documents", "prepare", "shared_dir", "small", "stored", "with_owner"]

#: Rows and bytes of one Arrow batch; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: Rows of one key from which a join splits it, and keys that can be so at most.
HOT, MOST_HOT = 2000, 50000


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python tasks hold at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone; extra columns of the table, whatever their names, never meet those of an operator."""
    return df.select(*columns)


def with_owner(rows: DataFrame, keys: list[str], *salt: str) -> DataFrame:
    """The rows whose keys stand in two documents or more, with ``owner``, the smallest ``doc_id`` of each key.

    A key of more than HOT rows, and more than a MOST_HOT th of all repeated rows, meets its owner in many tasks: there are at
    most MOST_HOT such keys, so they can be broadcast, and each gets a copy of its owner for each part of its rows, which
    are dealt by the ``salt`` columns.
    """
    found = rows.groupBy(*keys).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    found = stored(found.where("owner < last").drop("last"), "repeated")
    most = max(HOT, (found.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    found = found.withColumn("parts", F.ceil(F.col("n") / most)).drop("n")
    hot = found.where("parts > 1").select(*keys, "parts")
    if hot.isEmpty():
        return rows.join(found.drop("parts"), keys)
    part = F.coalesce(F.pmod(F.xxhash64(*salt), F.col("parts")), F.lit(0)).cast("int").alias("part")
    rows = rows.join(F.broadcast(hot), keys, "left").select(*rows.columns, part)
    owners = found.select(*keys, "owner", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"))
    return rows.join(owners, [*keys, "part"]).drop("part")
