"""Helpers shared by the training-data operators: shared storage, bounded lookups, ranks without one task per key."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows that a lookup table may have and still be broadcast; wider tables than about 200 bytes a row are not passed here.
BROADCAST_ROWS = 100_000
#: Copies of a lookup table that is too large to broadcast; its rows are joined by key and salt, so a hot key meets this many tasks.
SALTS = 32
#: ASCII white space, as the contracts of the word-based operators define it.
WORD = "[^\\x20\\x09-\\x0D]+"


#: Rows of a key from which a join spreads it over several tasks.
HOT_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). A local run that sets none gets one of its own; elsewhere that
    is an error, as no executor could read what another wrote."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, and survives the loss of an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(big: DataFrame, small: DataFrame, key: str, salt: Column, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of big with small (one row per key). small is broadcast if it was counted and has at most limit rows;
    otherwise it is repeated SALTS times and joined by key and salt, so that no key of big lands in one task."""
    rows = small.count() if rows is None else rows
    if rows <= limit:
        return big.join(F.broadcast(small), key, "left")
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"], "left").drop("_salt")


def spread_join(big: DataFrame, small: DataFrame, key: str, many: str, salt: Column, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join big with small, whose column many says how many rows of big hold the key. Keys of more than HOT_ROWS rows are dealt
    over tasks of about that many; the list of these keys is counted before it is broadcast. small should be materialized."""
    hot = small.filter(F.col(many) > HOT_ROWS).select(key, F.ceil(F.col(many) / HOT_ROWS).cast("int").alias("_salts")).distinct()
    n = hot.count()
    if not n:
        return big.join(small, key, how)
    if n > limit:  # too many to broadcast: then every key is dealt over SALTS tasks
        spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return big.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(spread, [key, "_salt"], how).drop("_salt")
    salts = F.coalesce("_salts", F.lit(1))
    dealt = big.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(salt, salts).cast("int")).drop("_salts")
    spread = small.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(spread, [key, "_salt"], how).drop("_salt")


def wrapped(df: DataFrame, **columns: Column) -> DataFrame:
    """df as one struct column _row, beside the given columns: whatever names df has, they meet no others until unwrapped."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(name) for name, c in columns.items()])


def unwrapped(df: DataFrame, *added: str) -> DataFrame:
    """The columns of _row, without those that are added anew, and the added ones."""
    fields = df.schema["_row"].dataType.fieldNames()
    return df.select(*[F.col("_row").getField(f).alias(f) for f in fields if f not in added], *added)


def widened(df: DataFrame, *added: StructField, without: Sequence[str] = ()) -> StructType:
    """The schema of df, but for some columns, with the fields added: whatever names and nested types df has."""
    return StructType([f for f in df.schema.fields if f.name not in without] + list(added))


def code_point_key(column: Column) -> Column:
    """A string that is never null, sorts by code point, and puts null after all else."""
    return F.when(column.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), column.cast("string")))


def hash60(*columns: Column) -> Column:
    """A non-negative 60-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 4)


def bucket_bits(rows: int, per_bucket: int = 512) -> int:
    """Bits of the buckets that a ranking deals a group into: enough that a bucket of the largest group stays small,
    at most 16, so that the table of bucket counts has at most 65,536 rows a group."""
    return min(16, max(2, (max(rows, 1) // per_bucket).bit_length()))


def rank_within(df: DataFrame, group: str, hashed: str, ties: list[Column], bits: int, rank: str, total: str | None = None) -> DataFrame:
    """Add the rank (from 0) of each row in its group, ordered by the 60-bit column hashed and then by ties; with total,
    also the group's rows. A group is cut into 2**bits ranges of the hash, whose counts are added up; no task holds a whole group."""
    dealt = df.withColumn("_bucket", F.shiftright(F.col(hashed), 60 - bits))
    counts = dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("_total"))
    inside = Window.partitionBy(group, "_bucket").orderBy(hashed, *ties)
    out = dealt.join(starts, [group, "_bucket"]).withColumn(rank, F.col("_before") + F.row_number().over(inside) - 1)
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_bucket", "_before", "_total")


def with_copies(rows: DataFrame, digest: str, copy: str = "_copy") -> DataFrame:
    """rows with a column copy that spreads rows which are alike: 0, but where more than HOT_ROWS rows share a digest it numbers them from 0.
    With a hash of digest and copy, rows get their places by what they hold, however they lie in files: which of equal rows has which
    number makes no difference. rows should be a written table."""
    hot = materialize(rows.groupBy(digest).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_ROWS), "copies")
    found = hot.agg(F.count(F.lit(1)), F.max("_n")).first()
    if not found[0]:
        return rows.withColumn(copy, F.lit(0).cast("long"))
    keys = hot.select(digest)
    keys = F.broadcast(keys) if found[0] <= BROADCAST_ROWS else keys
    mine = materialize(rows.join(keys, digest, "left_semi").withColumn("_spread", hash60(F.monotonically_increasing_id())), "copies")
    ranked = rank_within(mine, digest, "_spread", [], bucket_bits(found[1]), copy).drop("_spread").withColumn(copy, F.col(copy).cast("long"))
    return rows.join(keys, digest, "left_anti").withColumn(copy, F.lit(0).cast("long")).unionByName(ranked.select(*rows.columns, copy))
