"""A lookup index over a bilingual corpus, and what is asked of it: exact lookup, batch prefetch, status, aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.keys import broad_citation_key, citation_key, comma_tails, name_key
from marginalia.sources.shared import small

CITATIONS = ("citation_en", "citation2_en", "citation_fr", "citation2_fr")
NAMES = ("name_en", "name_fr")


def lookup_index(corpus: DataFrame, unicode: bool = True) -> DataFrame:
    """(row_id, field_name, exact_value, lookup_type, lookup_key): one row for each citation and name that isn't blank. Columns that
    the corpus lacks are left out. corpus has row_id."""
    have = [c for c in (*CITATIONS, *NAMES) if c in corpus.columns]
    long = corpus.unpivot(["row_id"], have, "field_name", "exact_value").filter(F.trim(F.coalesce("exact_value", F.lit(""))) != "")
    named = F.col("field_name").isin(*NAMES)
    return long.withColumn("lookup_type", F.when(named, "name").otherwise("citation")).withColumn("lookup_key", F.when(named, name_key(F.col("exact_value"), unicode)).otherwise(citation_key(F.col("exact_value"), unicode)))


def matches(asked: DataFrame, index: DataFrame, kind: str = "citation") -> DataFrame:
    """(lookup_key, row_id): all different rows under the asked keys, one row each."""
    hits = index.filter(F.col("lookup_type") == kind).select("lookup_key", "row_id").distinct()
    return hits.join(asked.select("lookup_key").distinct(), "lookup_key", "left_semi")


def exact_lookup(asked: DataFrame, index: DataFrame, kind: str = "citation") -> DataFrame:
    """asked (lookup_key and more) with hits, the number of different rows under the key, status (found, ambiguous, not_found), and
    row_id where there is exactly one. Keys that are not found stay. A key's rows are counted, not gathered; matches lists them."""
    found = matches(asked, index, kind).groupBy("lookup_key").agg(F.count(F.lit(1)).alias("hits"), F.min("row_id").alias("_row"))
    joined = asked.join(found, "lookup_key", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    status = F.when(F.col("hits") == 0, "not_found").when(F.col("hits") == 1, "found").otherwise("ambiguous")
    return joined.withColumn("status", status).withColumn("row_id", F.when(F.col("hits") == 1, F.col("_row"))).drop("_row")


def names_to_citations(names: DataFrame, index: DataFrame) -> DataFrame:
    """All citation keys of the rows that carry one of the names (lookup_key), and all rows under these keys, so that an ambiguous
    citation stays ambiguous: (lookup_key, citation_key, row_id)."""
    named = index.filter("lookup_type = 'name'").join(names.select("lookup_key").distinct(), "lookup_key", "left_semi").select("lookup_key", "row_id")
    cited = index.filter("lookup_type = 'citation'").select(F.col("lookup_key").alias("citation_key"), "row_id")
    keys = named.join(cited, "row_id").select("lookup_key", "citation_key").distinct()
    return keys.join(cited, "citation_key").select("lookup_key", "citation_key", "row_id").distinct()


def prefetch_stats(asked: DataFrame, index: DataFrame, cached: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row: keys requested, those already cached, partitions and rows that the others need. datasets: (row_id, dataset)."""
    keys = asked.select("lookup_key").distinct()
    have = cached.select("lookup_key").distinct()
    rows = matches(keys.join(have, "lookup_key", "left_anti"), index).select("row_id").distinct().join(datasets, "row_id")
    counts = keys.join(have.withColumn("_c", F.lit(1)), "lookup_key", "left").agg(F.count(F.lit(1)).alias("requested"), F.count("_c").alias("cached"))
    return counts.crossJoin(rows.agg(F.count_distinct("dataset").alias("partitions"), F.count(F.lit(1)).alias("rows")))  # one row each


def with_alias(asked: DataFrame, aliases: DataFrame, unicode: bool = True) -> DataFrame:
    """asked (id, citation) with the canonical citation of its longest comma tail that aliases (citation_key, canonical_citation)
    names; null if none does."""
    tails = asked.select("id", F.posexplode(comma_tails(F.col("citation"))).alias("_at", "_tail"))
    found = tails.withColumn("citation_key", citation_key(F.col("_tail"), unicode)).join(aliases, "citation_key").groupBy("id").agg(F.min_by("canonical_citation", "_at").alias("canonical_citation"))
    return asked.join(found, "id", "left")


def in_language(corpus: DataFrame, language: str, fields: Sequence[str] = ("citation", "name", "document_date", "url", "unofficial_text")) -> DataFrame:
    """The fields of one language without its suffix. English without a text gives way to French if that has one, French without
    a text always gives way to English; `language` says which was taken."""
    text = lambda lang: F.trim(F.coalesce(F.col(f"unofficial_text_{lang}"), F.lit(""))) != ""
    use_en = (text("en") | ~text("fr")) if language == "en" else ~text("fr")
    have = [f for f in fields if {f"{f}_en", f"{f}_fr"} <= set(corpus.columns)]
    return corpus.select("row_id", *[F.when(use_en, F.col(f"{f}_en")).otherwise(F.col(f"{f}_fr")).alias(f) for f in have], F.when(use_en, "en").otherwise("fr").alias("language"))


def section(texts: DataFrame, column: str, wanted: str) -> DataFrame:
    """texts with section_text, the entry of the JSON map column under the label in column wanted; a missing one is null, and the
    row stays."""
    return texts.withColumn("section_text", F.try_element_at(F.from_json(column, "map<string,string>"), F.col(wanted)))


def unique_identity(candidates: DataFrame, literal: str = "literal_key", broad: str = "broad_key") -> DataFrame:
    """Per asked row (id, asked_literal, asked_broad) of candidates joined to it (row_id and the two keys): the only row of the best
    tier. A literal hit rules broad ones out; more than one row of a tier is ambiguous. Rows are counted, not gathered."""
    tier = F.when(F.col("asked_literal") == F.col(literal), 1).when(F.col("asked_broad") == F.col(broad), 2)
    per = candidates.withColumn("_tier", tier).groupBy("id", "_tier").agg(F.count_distinct("row_id").alias("_n"), F.min("row_id").alias("_r"))
    best = per.groupBy("id").agg(F.min(F.when(F.col("_tier").isNotNull(), F.struct("_tier", "_n", "_r"))).alias("_b"))
    n = F.coalesce("_b._n", F.lit(0))
    return best.select("id", F.when(n == 0, "not_found").when(n == 1, "found").otherwise("ambiguous").alias("status"), F.when(n == 1, F.col("_b._r")).alias("row_id"))


def rule_suffix(citation: Column) -> Column:
    """The rule, section or article that a law's citation ends with, as 'r:1dot2'; empty for none. It is part of the law's identity."""
    form = "(?i)[ ,]+(r(?:ules?)?|ss?(?:ections?)?|art(?:icles?)?)\\.?\\s*([0-9]+(?:[.\\-][0-9]+)*)\\s*$"
    label, number = F.lower(F.regexp_extract(citation, form, 1)), F.regexp_extract(citation, form, 2)
    family = F.when(label.startswith("r"), "r").when(label.startswith("s"), "s").otherwise("art")
    return F.when(number == "", "").otherwise(F.concat(family, F.lit(":"), citation_key(number, False)))


def identities(asked: DataFrame, corpus: DataFrame, laws: bool = False, unicode: bool = True) -> DataFrame:
    """asked (id, citation) with status and row_id of the one row of corpus that its citation names, in any of the corpus's citation
    fields: by the whole key, else by the key without pinpoints. With laws, a row whose citation ends in another rule or section
    than the asked one's is not meant. Two rows are ambiguous; a name never decides.

    The corpus is added up by key before citations meet it, so that a citation meets a row or two, however many rows its key has."""
    have = [c for c in CITATIONS if c in corpus.columns]
    rows = corpus.unpivot(["row_id"], have, "_field", "_cited").filter(F.trim(F.coalesce("_cited", F.lit(""))) != "")
    keyed = lambda df, c, x: df.withColumns({f"{x}literal": citation_key(F.col(c), unicode), f"{x}broad": broad_citation_key(F.col(c), unicode), f"{x}suffix": rule_suffix(F.col(c))})
    rows, wanted = keyed(rows, "_cited", "_"), keyed(asked.select("id", "citation"), "citation", "asked_")
    ends = [F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")]  # a key has one row if its least and its greatest are the same
    rows = rows.withColumns({"_lo": F.col("row_id"), "_hi": F.col("row_id")})
    literal = wanted.join(rows.filter("_literal <> ''").groupBy(F.col("_literal").alias("asked_literal")).agg(*ends), "asked_literal").select("id", F.lit(1).alias("_tier"), "_lo", "_hi")
    by = rows.filter("_broad <> ''").groupBy(F.col("_broad").alias("asked_broad"), F.col("_suffix").alias("_of") if laws else F.lit("*").alias("_of")).agg(*ends)
    if laws:  # a citation without a suffix means any row (*), others the rows of their own suffix and those without one
        by = by.unionByName(by.groupBy("asked_broad").agg(*ends).withColumn("_of", F.lit("*")))
    of = F.when(F.col("asked_suffix") == "", F.array(F.lit("*"))).otherwise(F.array(F.lit(""), F.col("asked_suffix"))) if laws else F.array(F.lit("*"))
    loose = wanted.select("id", "asked_broad", F.explode(of).alias("_of")).join(by, ["asked_broad", "_of"]).select("id", F.lit(2).alias("_tier"), "_lo", "_hi")
    per = literal.unionByName(loose).groupBy("id", "_tier").agg(*ends)
    best = per.groupBy("id").agg(F.min(F.struct("_tier", "_lo", "_hi")).alias("_b"))
    one = F.col("_b._lo") == F.col("_b._hi")
    found = best.select("id", F.when(one, "found").when(~one, "ambiguous").otherwise("not_found").alias("status"), F.when(one, F.col("_b._lo")).alias("row_id"))
    return asked.join(found, "id", "left").withColumn("status", F.coalesce("status", F.lit("not_found")))


def locked_cases(asked: DataFrame, corpus: DataFrame, aliases: DataFrame, unicode: bool = True) -> DataFrame:
    """asked (id, citation) with status, row_id and method: the case that the citation names, if its court's dataset is in the corpus;
    else the case that its alias names, if that court's is. not_covered where neither is, so that another source may be asked."""
    covered = small(corpus.select(F.col("dataset").alias("_dataset")).distinct().withColumn("_covered", F.lit(True)))
    court = lambda c: F.coalesce(F.upper(F.regexp_extract(c, "(?i)\\b[0-9]{4}\\s+([A-Z][A-Z0-9-]{1,15})\\s+[0-9]+\\b", 1)), F.lit(""))
    own = with_alias(asked.select("id", "citation"), aliases, unicode).withColumn("_dataset", court(F.col("citation"))).join(covered, "_dataset", "left").withColumnsRenamed({"_covered": "_own"}).drop("_dataset")
    both = own.withColumn("_dataset", court(F.col("canonical_citation"))).join(covered, "_dataset", "left")
    use = F.when(F.col("_own"), F.col("citation")).when(F.col("_covered"), F.col("canonical_citation"))
    method = F.when(F.col("_own"), "citation").when(F.col("_covered"), "alias").otherwise("not_covered")
    chosen = both.select("id", use.alias("citation"), method.alias("method"))
    found = identities(chosen.filter("citation is not null"), corpus, unicode=unicode).select("id", "status", "row_id")
    out = asked.join(chosen.select("id", "method"), "id", "left").join(found, "id", "left")
    return out.withColumn("status", F.coalesce("status", F.when(F.col("method") == "not_covered", "not_covered").otherwise("not_found")))


def fetch_rows(located: DataFrame, corpus: DataFrame, fields: Sequence[str]) -> DataFrame:
    """located (path, row and others) with the fields of the rows at these places of the corpus's files. A row is found by file and
    position together; fields that the corpus lacks are null."""
    have = [f for f in fields if f in corpus.columns]
    held = corpus.select("path", "row", *have)
    out = located.join(held, ["path", "row"], "left")
    return out.select("*", *[F.lit(None).cast("string").alias(f) for f in fields if f not in have])


def any_field(corpus: DataFrame, fields: Sequence[str], value: str) -> DataFrame:
    """Rows any of whose fields is the value; if there is none, those where one is it but for white space at the ends and case."""
    have = [f for f in fields if f in corpus.columns]
    exact = corpus.filter(F.lit(value).isin(*[F.col(f) for f in have]))
    if have and exact.isEmpty():
        return corpus.filter(F.lit(value.strip().lower()).isin(*[F.lower(F.trim(F.col(f))) for f in have]))
    return exact
