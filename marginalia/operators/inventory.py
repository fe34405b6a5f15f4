"""Snapshots as inventories of (path, sha256, size): equality, and what an update has to fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = ["path", "sha256", "size"]


def plan_update(installed: DataFrame, remote: DataFrame) -> DataFrame:
    """(path, action): reuse what is there as it is, copy what is there under another path, download the rest, remove what is gone."""
    same = remote.join(installed, ENTRY, "left_semi").select("path", F.lit("reuse").alias("action"))
    rest = remote.join(installed, ENTRY, "left_anti")
    known = installed.select("sha256", "size").distinct()
    copied = rest.join(known, ["sha256", "size"], "left_semi").select("path", F.lit("copy").alias("action"))
    fetched = rest.join(known, ["sha256", "size"], "left_anti").select("path", F.lit("download").alias("action"))
    gone = installed.join(remote, "path", "left_anti").select("path", F.lit("remove").alias("action"))
    return same.unionByName(copied).unionByName(fetched).unionByName(gone)


def same_inventory(a: DataFrame, b: DataFrame) -> bool:
    """Equal as sets of entries, whatever the revision says."""
    return a.join(b, ENTRY, "left_anti").isEmpty() and b.join(a, ENTRY, "left_anti").isEmpty()


def total_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def file_inventory(files: DataFrame) -> DataFrame:
    """Of a binaryFile scan (path, content): path, SHA-256 and size."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))


def verified(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest (path, sha256, size) with state: whole where the file that was found has that size and digest, partial where it is shorter,
    so that a fetch can go on from its end, wrong where it is not, missing where there is none."""
    have = found.select("path", F.col("sha256").alias("_sha"), F.col("size").alias("_size"))
    state = F.when(F.col("_size").isNull(), "missing").when((F.col("_sha") == F.col("sha256")) & (F.col("_size") == F.col("size")), "whole").when(F.col("_size") < F.col("size"), "partial").otherwise("wrong")
    return manifest.join(have, "path", "left").withColumn("state", state).drop("_sha", "_size")


def cached_answers(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """asked (id, request_key, neutral_key, legacy_key) with answer and level: the cached answer (cache: level, key, answer) under the
    exact request's key, else under that of the request without its links, else under that of an older version."""
    keys = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(level).alias("level"), F.col(c).alias("key")) for i, (level, c) in enumerate((("exact", "request_key"), ("neutral", "neutral_key"), ("legacy", "legacy_key")))])
    met = asked.select("id", F.explode(keys).alias("k")).select("id", "k.*").filter("key is not null").join(cache, ["level", "key"])
    best = met.groupBy("id").agg(F.min(F.struct("rank", "level", "answer")).alias("_b")).select("id", F.col("_b.level").alias("level"), F.col("_b.answer").alias("answer"))
    return asked.join(best, "id", "left")
