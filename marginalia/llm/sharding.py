"""Proportional stratified interleaving: shards that all hold the sources in the corpus's own proportions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import bucket_bits, code_point_key, hash60, materialize, rank_within, with_copies


def interleave(df: DataFrame, shards: int, source: str = "source", key: str = "doc_id", seed: int = 11) -> DataFrame:
    """Every row of df with its shard (0 to shards - 1) and slot (gapless from 0 in the shard).

    The rows of a source are shuffled by a seeded hash of the key and of all that a row holds, and ranked; a row's fractional rank is
    (rank + 1/2) / rows of the source. Rows sorted by fractional rank, ties by source and hash, are cut into equal runs, so
    shards differ by one row at most and each holds nearly the same share of every source, in an order that keeps the mixture
    throughout. The places depend on the rows alone, not on how they lie in files; only rows that are equal in all (but for columns of
    maps, which have no hash) are told apart by their numbers. A null source is a source of its own and sorts last; an empty table
    gives none. Other columns pass through; a shard or slot that df has is replaced.

    Rows are numbered and written to the shared folder once. Both rankings move numbers, sources and hashes only, and deal a group
    into hash ranges (the second: ranges of the fractional rank) whose counts are added up, so a source with a third of all rows
    is spread like the rest. Texts are shuffled once, by row number, when they meet their places.
    """
    own = [c for c in df.columns if c not in ("shard", "slot")]
    numbered = materialize(df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.monotonically_increasing_id().alias("_id")), "numbered")
    rows = numbered.count()
    bits = bucket_bits(rows)
    at = F.col("_row").getField
    held = [c for c, kind in df.dtypes if c in own and "map<" not in kind]
    known = materialize(numbered.select("_id", code_point_key(at(source)).alias("_source"), F.xxhash64(F.lit(key), at(key), *map(at, held)).alias("_digest")), "digests")
    keyed = with_copies(known, "_digest").select("_id", "_source", hash60(F.lit(seed), F.col("_digest"), F.col("_copy")).alias("_hash"))
    ranked = rank_within(keyed, "_source", "_hash", [F.col("_id")], bits, "_rank", "_of")
    place = ranked.withColumn("_place", (F.col("_rank") * 2 + 1) / (F.col("_of") * 2)).withColumn("_range", F.floor(F.col("_place") * (1 << bits)))
    place = materialize(place.select("_id", "_source", "_hash", "_place", "_range"), "places")
    counts = place.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # at most 65,536 rows
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_range").orderBy("_place", "_source", "_hash", "_id")
    position = F.col("_before") + F.row_number().over(order) - 1
    out = place.join(before, "_range").select("_id", position.alias("_position"))
    out = out.withColumn("shard", F.expr(f"(_position * {shards}) div {max(rows, 1)}").cast("int"))
    slot = F.col("_position") - F.expr(f"(cast(shard as bigint) * {rows} + {shards - 1}) div {shards}")
    return numbered.join(out, "_id").select(*[at(c).alias(c) for c in own], "shard", slot.alias("slot"))
