"""Links of citation parts: the first source that has one, origins of references, repaired statute slugs, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.keys import citation_key
from marginalia.functions.shortforms import form_key

_SLUG = "/laws/(?:stat|regu)/([a-z0-9-]+)/"


def cascade(*sources: tuple[str, Column]) -> tuple[Column, Column]:
    """(link, method) of the first source whose link is not blank, in the order given; both null if none is."""
    have = [(name, F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c)) for name, c in sources]
    return F.coalesce(*[c for _, c in have]), F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in have])


def attach_origin(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """rows (doc_id, display_key, internal_key, origin_key) with origin_<field> of the row that origin_key names: by display key,
    else by internal key; never the row itself. Where a key names several rows, the first by internal key."""
    first = lambda key: rows.groupBy("doc_id", F.col(key).alias("origin_key")).agg(F.min_by(F.struct("internal_key", *fields), "internal_key").alias(f"_{key}"))
    joined = rows.join(first("display_key"), ["doc_id", "origin_key"], "left").join(first("internal_key"), ["doc_id", "origin_key"], "left")
    found = F.coalesce(*[F.when(F.col(f"_{k}.internal_key") != F.col("internal_key"), F.col(f"_{k}")) for k in ("display_key", "internal_key")])
    return joined.withColumn("_o", found).select(*rows.columns, *[F.col(f"_o.{f}").alias(f"origin_{f}") for f in fields])


def should_inherit(kind: Column, link: Column, method: Column) -> Column:
    """Whether a reference takes its origin's values: it is an ibid or supra, and its link is blank or was not the author's own."""
    return kind.isin("IBID", "SUPRA") & ((F.trim(F.coalesce(link, F.lit(""))) == "") | ~method.eqNullSafe(F.lit("author")))


def takes_origin(kind: Column, link: Column, disagrees: Column, form: Column, origin_form: Column, hinted: Column) -> Column:
    """Whether a row uses its chain's origin: all but supras do. A supra with a link of its own does only if that link disagrees with the
    pinpoint asked for and its short form is the origin's; one without a link, if its short form is the origin's, or, without a
    short form, if the origin fits its hint."""
    own, has_form = ~F.lower(F.trim(F.coalesce(link, F.lit("")))).isin("", "other"), form_key(form) != ""
    same = has_form & (form_key(form) == form_key(origin_form))
    decided = F.when(own, F.coalesce(disagrees, F.lit(False)) & same).when(has_form, same).otherwise(F.coalesce(hinted, F.lit(False)))
    return F.when(F.upper(F.trim(F.coalesce(kind, F.lit("")))) != "SUPRA", True).otherwise(decided)


def repair_slugs(links: DataFrame, laws: DataFrame) -> DataFrame:
    """links (id, link, citation) with repaired and reason. A link to a statute is repaired if the law of its citation is known by one
    address only (laws: citation, url), that address is a statute's too, and its slug is another one; all else stays."""
    known = laws.filter(F.col("url").rlike(_SLUG)).select(citation_key(F.col("citation")).alias("_k"), "url").groupBy("_k").agg(F.count_distinct("url").alias("_n"), F.min("url").alias("_u")).filter("_n = 1").drop("_n")
    joined = links.withColumn("_k", citation_key(F.col("citation"))).join(known, "_k", "left")
    slug = lambda c: F.regexp_extract(c, _SLUG, 1)
    wrong = F.col("_u").isNotNull() & (slug(F.col("link")) != "") & (slug(F.col("link")) != slug(F.col("_u")))
    return joined.withColumn("repaired", F.when(wrong, F.col("_u")).otherwise(F.col("link"))).withColumn("reason", F.when(wrong, F.lit("slug of the cited law"))).drop("_k", "_u")


def summary(items: Column, most: int = 2) -> Column:
    """'a, b [+3 more instances]' of an array."""
    n = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(n > 0, F.concat(F.lit(" [+"), n.cast("string"), F.lit(" more instances]"))).otherwise(""))


def target_link(status: Column, cited: Column, found: Column, source: Column) -> Column:
    """The link that a report's cell leads to: where the quotation was found if that is elsewhere than cited (ALT_), the cited place
    if it was found there or not at all, the bare source where neither is known."""
    some = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c)
    return F.when(status.startswith("ALT_"), F.coalesce(some(found), some(cited), some(source))).otherwise(F.coalesce(some(cited), some(found), some(source)))


def joined_text(parts: DataFrame, by: list[str], order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """The texts of each group in order, joined by a separator: corrected paragraphs of a note, or the steps of a path. A group is one
    note's."""
    listed = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_t"))
    return listed.select(*by, F.array_join(F.transform("_t", lambda t: t[text]), separator).alias(text))
