"""Mixing sources to target weights by repetition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import WORD, code_point_key, lookup, materialize, unwrapped, wrapped

#: Seeds tried for each source; the one whose draws come nearest the target is used.
SEEDS = 16
_SPACE = 1 << 32


def _draw(seed):
    """Uniform in [0, 2**32): the document's hash turned by the seed."""
    return F.pmod(F.col("_u") + seed.cast("long") * F.lit(_SPACE // SEEDS), F.lit(_SPACE))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Per source (_source, source_size): its target. Weights repeat over the sources by code point, null last, and share the
    sum of all sizes; a target stops at most times the source's size and the excess is reshared by weight among the others.

    The fixed point of that resharing is target = min(most * size, level * weight); the level is found by sorting the sources
    by most * size / weight and adding up. One row a source passes one task here, never a document."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    by_name, up = Window.orderBy("_source"), Window.orderBy("_ratio", "_source")
    listed = sizes.withColumn("_i", F.row_number().over(by_name) - 1).withColumn("_w", w).withColumn("_cap", F.col("source_size") * most)
    filled = listed.withColumn("_ratio", F.col("_cap") / F.col("_w")).withColumns({
        "_all": F.sum("source_size").over(Window.partitionBy()),
        "_full": F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_rest": F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = filled.withColumn("_try", (F.col("_all") - F.col("_full")) / F.col("_rest"))
    level = level.withColumn("_level", F.min(F.when(F.col("_try") <= F.col("_ratio"), F.struct("_ratio", "_source", "_try"))).over(Window.partitionBy())["_try"])
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("_w"))
    return level.select("_source", "source_size", target.alias("target"))


def _draws(df: DataFrame, source: str, key: str, seed: int) -> DataFrame:
    """df as the struct _row, with _source and the document's draw _u."""
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return wrapped(df, _source=code_point_key(F.col(source)), _u=F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long"))


def _words(df: DataFrame, text: str) -> DataFrame:
    """df without its text, with size, written to the shared folder, so that words are counted once."""
    return materialize(df.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")).drop(text), "sizes")


def source_rates(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> tuple[DataFrame, int]:
    """Per source of rows (_source, size, _u): source_size, target, copies that all of its rows get (_whole), the bound under which
    a draw gives one more (_below) and the seed of its draws (_seed); and the number of sources."""
    sizes = materialize(rows.groupBy("_source").agg(F.sum("size").alias("source_size")), "source_sizes")
    n = sizes.count()
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rates = source_targets(sizes, weights, most).withColumn("_rate", rate).withColumn("_whole", F.floor("_rate"))
    rates = materialize(rates.withColumn("_below", (F.col("_rate") - F.col("_whole")) * F.lit(float(_SPACE))).drop("_rate"), "rates")
    extra = [F.sum(F.when(_draw(F.lit(i)) < F.col("_below"), F.col("size")).otherwise(0)).alias(f"_{i}") for i in range(SEEDS)]
    drawn = lookup(rows, rates, "_source", F.col("_u"), n).groupBy("_source", "_whole", "_below", "target", "source_size").agg(*extra)
    off = F.array(*[F.abs(F.col("_whole") * F.col("source_size") + F.col(f"_{i}") - F.col("target")) for i in range(SEEDS)])
    chosen = drawn.withColumn("_off", off).withColumn("_seed", F.array_position("_off", F.array_min("_off")) - 1)
    return materialize(chosen.select("_source", "source_size", "target", "_whole", "_below", "_seed"), "seeds"), n


def _copies():
    return (F.col("_whole") + F.when(_draw(F.col("_seed")) < F.col("_below"), 1).otherwise(0)).cast("int")


def mixing_plan(df: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: int = 5) -> DataFrame:
    """Every row of df, without its text, with size (words; null text: 0), source_size, target and copies, the times that the
    mixture holds it. Columns of these names that df has are replaced.

    A source's repetition rate is target / source_size, at most `most`. Each row is taken floor(rate) times, and once more if its
    hash of seed and key, turned by the source's own seed, falls below the fraction: a Bernoulli draw that every rerun repeats.
    Of SEEDS such seeds a source uses the one whose taken words come nearest its target. Null keys count as one value (they share
    a draw), as do repeated keys; a source without words is taken 0 times; an empty table gives none."""
    own = df.drop("size", "source_size", "target", "copies")
    rows = _draws(own, source, key, seed)
    others = F.struct(*[F.col("_row").getField(c).alias(c) for c in own.columns if c != text])
    narrow = _words(rows.select(others.alias("_row"), "_source", "_u", F.col("_row").getField(text).alias("_text")), "_text")
    rates, n = source_rates(narrow, weights, most)
    return unwrapped(lookup(narrow, rates, "_source", F.col("_u"), n).withColumn("copies", _copies()), "size", "source_size", "target", "copies")


def mix(df: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: int = 5) -> DataFrame:
    """The mixture itself: each row of df as often as mixing_plan takes it, with df's columns. Texts are read twice, to count
    their words and to pass them on, and shuffled never."""
    rows = _draws(df, source, key, seed)
    rates, n = source_rates(_words(rows.select("_source", "_u", F.col("_row").getField(text).alias("_text")), "_text"), weights, most)
    chosen = lookup(rows, rates, "_source", F.col("_u"), n).withColumn("_copies", _copies()).filter("_copies > 0")
    return unwrapped(chosen.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))))
