"""Text-fragment directives: links that point to words on a page, proved to point to one place."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from marginalia.functions.text import squeezed
from marginalia.sources.shared import grouped, small

#: Fixed: words of context that are tried before and behind a target, in this order; words and characters from which a target is long; words by
#: which each end of a long one is named.
WINDOWS = (0, 2, 4, 8, 12, 16, 24, 32)
LONG_WORDS, LONG_CHARS, BOUNDARY = 30, 220, 5


def encoded(column: Column) -> Column:
    """Percent-encoded for a directive: a space is %20, and dash, comma and ampersand are encoded too."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(column), "\\+", "%20"), "-", "%2D"), "\\*", "%2A")


def directive(prefix: Column, start: Column, end: Column, suffix: Column) -> Column:
    """prefix-,start,end,-suffix with the parts that are not empty."""
    some = lambda c, f: F.when(F.coalesce(c, F.lit("")) != "", f(encoded(c)))
    parts = F.array(some(prefix, lambda e: F.concat(e, F.lit("-"))), some(start, lambda e: e), some(end, lambda e: e), some(suffix, lambda e: F.concat(F.lit("-"), e)))
    return F.concat(F.lit("#:~:text="), F.array_join(F.array_compact(parts), ","))


def parsed(column: Column) -> Column:
    """The parts of a directive, decoded; empty strings for those that it lacks."""
    items = F.split(F.regexp_extract(column, ":~:text=([^&]*)", 1), ",")
    decoded = lambda c: F.coalesce(F.url_decode(F.regexp_replace(c, "^-|-$", "")), F.lit(""))
    prefix, suffix = F.filter(items, lambda x: x.endswith("-")), F.filter(items, lambda x: x.startswith("-"))
    target = F.filter(items, lambda x: ~x.endswith("-") & ~x.startswith("-"))
    at = lambda a, i: decoded(F.try_element_at(a, F.lit(i)))
    return F.struct(at(prefix, 1).alias("prefix"), at(target, 1).alias("start"), at(target, 2).alias("end"), at(suffix, 1).alias("suffix"))


def _around(line: str, target: str, n: int) -> tuple[str, str]:
    """Up to n words before the target's first place in a line, and up to n behind it."""
    at = line.find(target)
    return " ".join(line[:at].split()[-n:] if n else []), " ".join(line[at + len(target) :].split()[:n])


def least_context(lines: list[str], target: str) -> tuple[str, str, str, str] | None:
    """(prefix, start, end, suffix) of the directive of least context that names one place only, in one line; None where no window does.

    A long target is named by its first and last words, if the first ones stand once with their context and the last ones once behind them;
    otherwise by all of it. Windows grow until a search through the document finds one place."""
    whole = "\n".join(lines)
    held = [line for line in lines if target and target in line]
    words = target.split()
    if len(words) > LONG_WORDS or len(target) > LONG_CHARS:
        start, end = " ".join(words[:BOUNDARY]), " ".join(words[-BOUNDARY:])
        for n in WINDOWS:
            for line in held:
                prefix, _ = _around(line, target, n)
                if target.count(end) == 1 and len(words) > 2 * BOUNDARY and whole.count(f"{prefix} {start}".strip()) == 1:
                    return prefix, start, end, ""
    for n in WINDOWS:
        for line in held:
            prefix, suffix = _around(line, target, n)
            if whole.count(" ".join(x for x in (prefix, target, suffix) if x)) == 1:
                return prefix, target, "", suffix
    return None


_PARTS = StructType([StructField(n, StringType()) for n in ("prefix", "start", "end", "suffix")])


@F.arrow_udf(ArrayType(_PARTS))
def least_contexts(lines: pa.Array, targets: pa.Array) -> pa.Array:
    """least_context of each of several targets in the lines of one document."""
    rows = []
    for held, asked in zip(lines.to_pylist(), targets.to_pylist(), strict=True):
        found = [least_context(held, t) for t in asked]
        rows.append([None if f is None else dict(zip(_PARTS.fieldNames(), f, strict=True)) for f in found])
    return pa.array(rows, pa.list_(pa.struct([(n, pa.string()) for n in _PARTS.fieldNames()])))


def unique_fragments(targets: DataFrame, lines: DataFrame) -> DataFrame:
    """targets (id, doc_id, target) with the directive of least context that names one place only, in one line of lines (doc_id,
    block, text); null where no window does. Context is taken from the line, so a directive never reaches over its end. The lines of a
    document are met once for many targets."""
    asked = targets.select(F.col("id").alias("item_id"), "doc_id", squeezed(F.col("target")).alias("_x"))
    named = lines.join(small(asked.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", F.struct("block", squeezed(F.col("text")).alias("t")).alias("_l"))
    whole = named.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("_l")), lambda x: x["t"]).alias("_lines"))
    met = grouped(asked, asked.select("item_id", "_x"), whole)
    found = met.select("asked", least_contexts(F.col("_lines"), F.transform("asked", lambda x: x["_x"])).alias("_f"))
    best = found.select(F.inline(F.zip_with("asked", "_f", lambda x, f: F.struct(x["item_id"].alias("id"), f.alias("_p"))))).filter("_p is not null")
    return targets.join(best, "id", "left").withColumn("directive", F.when(F.col("_p").isNotNull(), directive(F.col("_p.prefix"), F.col("_p.start"), F.col("_p.end"), F.col("_p.suffix")))).drop("_p")


def verified_fragments(links: DataFrame, lines: DataFrame) -> DataFrame:
    """links (id, doc_id, directive, target) with verified: whether the directive, read back, names one place only among the lines
    (doc_id, block, text), inside one line, and what stands there is the target. A directive with an end names what begins with its
    start and ends with its end."""
    asked = links.withColumn("_d", parsed(F.col("directive"))).select("id", "doc_id", squeezed(F.col("target")).alias("_x"), "_d.*")
    needle = F.concat_ws(" ", F.nullif("prefix", F.lit("")), F.when(F.col("end") == "", F.col("start")).otherwise(F.col("_x")), F.nullif("suffix", F.lit("")))
    fits = F.when(F.col("end") == "", F.col("_x") == F.col("start")).otherwise(F.col("_x").startswith(F.col("start")) & F.col("_x").endswith(F.col("end")))
    wanted = asked.select("id", "doc_id", needle.alias("_n"), (fits & (F.col("start") != "")).alias("_fits"))
    met = lines.select("doc_id", squeezed(F.col("text")).alias("_t")).join(small(wanted), "doc_id").filter((F.length("_n") > 0) & F.contains("_t", "_n"))
    places = met.groupBy("id").agg(F.sum((F.length("_t") - F.length(F.replace(F.col("_t"), F.col("_n"), F.lit("")))) / F.length("_n")).alias("_k"), F.bool_and("_fits").alias("_ok"))
    return links.join(places, "id", "left").withColumn("verified", F.coalesce(F.col("_ok") & (F.col("_k") == 1), F.lit(False))).drop("_k", "_ok")
