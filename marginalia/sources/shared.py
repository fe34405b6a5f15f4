"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a table may have, counted, and still be broadcast.
BROADCAST_ROWS = 100_000
#: Rows of a key from which a join spreads it over several tasks.
HOT_ROWS = 500
#: Rows that meet a document in one row.
TOGETHER = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local run that sets none gets one of its own; elsewhere that is an error, as no executor
    could read what another wrote."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, and survives the loss of an executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most limit rows; larger ones are joined by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread_join(big: DataFrame, asked: DataFrame, key: str, many: str, salt: Column, most: int = 64) -> DataFrame:
    """big joined with asked, which is broadcast if it has few rows. Else a key of asked, whose column many says how many rows of big
    hold it, is dealt over one task for HOT_ROWS of them, at most `most`; the list of such keys is counted before it is broadcast, and
    beyond that all keys are dealt alike. asked should be a written table."""
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(asked.drop(many)), key)
    hot = asked.filter(F.col(many) > HOT_ROWS).select(key, F.least(F.ceil(F.col(many) / HOT_ROWS), F.lit(most)).cast("int").alias("_salts")).distinct()
    if hot.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        dealt, spread = big.withColumn("_salts", F.lit(most)), asked.withColumn("_salts", F.lit(most))
    else:
        dealt, spread = big.join(F.broadcast(hot), key, "left"), asked.join(F.broadcast(hot), key, "left")
    salts = F.coalesce("_salts", F.lit(1))
    dealt = dealt.withColumn("_salt", F.pmod(salt, salts).cast("int")).drop("_salts")
    spread = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts", many)
    return dealt.join(spread, [key, "_salt"]).drop("_salt")


def grouped(pairs: DataFrame, items: DataFrame, documents: DataFrame, most: int = TOGETHER) -> DataFrame:
    """Each of documents (doc_id and others) that pairs (item_id, doc_id) name, with asked, an array of the rows of items (item_id and others)
    that are asked of it: about `most` in a row, so that a document is met once for many items, and no task holds all that are asked of
    one."""
    met = materialize(pairs.select("item_id", "doc_id").distinct().join(small(items), "item_id"), "met")
    many = met.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_of"))
    dealt = met.join(small(many), "doc_id").withColumn("_g", F.pmod(F.xxhash64("item_id"), F.col("_of")))
    rows = dealt.groupBy("doc_id", "_g").agg(F.collect_list(F.struct(*items.columns)).alias("asked")).drop("_g")
    return documents.join(small(rows, 10_000), "doc_id")
