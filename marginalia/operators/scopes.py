"""Cited scopes, and where a quotation stands in relation to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.functions.references import range_end
from marginalia.functions.similarity import score
from marginalia.operators.quotes import asked_texts, held_texts, judged
from marginalia.sources.shared import grouped, materialize, small

_LIST = "([0-9]+(?:\\s*(?:[-–—,]|and|to)\\s*[0-9]+)*)"


def _ranges(column: Column, label: str, cap: str) -> Column:
    """[(low, high)] of the lists behind a label: '4-6, 9' is 4 to 6 and 9; abbreviated ends are filled in. cap: a suffix pattern."""
    lists = F.regexp_extract_all(column, F.lit(f"(?i){label}\\s*{_LIST}{cap}"), F.lit(1))
    items = F.flatten(F.transform(lists, lambda x: F.split(F.regexp_replace(F.regexp_replace(x, "\\s*(?:and|,)\\s*", ","), "\\s*(?:to|[–—-])\\s*", "-"), ",")))

    def one(x: Column) -> Column:
        a, b = F.split(x, "-")[0].cast("long"), F.try_element_at(F.split(x, "-"), F.lit(2)).cast("long")
        return F.struct(a.alias("low"), F.coalesce(range_end(a, b), a).alias("high"))

    return F.array_distinct(F.transform(F.filter(items, lambda x: x.rlike("^[0-9]{1,9}(-[0-9]{1,9})?$")), one))


def cited_scopes(column: Column) -> Column:
    """Paragraph ranges, page ranges and sections that a citation names, its url's #parN and #secN included."""
    par = F.array_distinct(F.concat(_ranges(column, "(?:\\bpara(?:graph)?s?\\.?|¶+)", ""), _ranges(column, "#par", "")))
    page = _ranges(column, "(?:\\bpp?\\.?|(?<=[0-9])\\s+at)", "(?![.:(0-9])")
    sec = F.array_distinct(F.concat(F.regexp_extract_all(column, F.lit("(?i)\\b(?:ss?|sections?)\\.?\\s+([0-9]+(?:[.-][0-9]+)*(?:\\([0-9a-zA-Z]+\\))*)"), F.lit(1)), F.regexp_extract_all(column, F.lit("#sec([0-9]+(?:\\.[0-9]+)*)"), F.lit(1))))
    return F.struct(par.alias("paragraphs"), page.alias("pages"), sec.alias("sections"))


def in_scope(number: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: number.between(r["low"], r["high"]))


def resolve(asked: DataFrame, blocks: DataFrame, sources: DataFrame, least_words: int = 3) -> DataFrame:
    """Per asked quotation (item_id, doc_id, quote, ranges: cited block ranges, empty for none) its location and labels.

    cited: a block of the cited ranges has it; alternate: another block; uncited: a block, and nothing was cited;
    scope_unavailable: a block, but the cited ranges hold no block of the source. The same with _document where no block alone has
    it but the whole text has (then without labels; cited becomes alternate); unmatched otherwise. A quotation of fewer than
    least_words words gets labels only if it occurs once in the source. blocks: (doc_id, number, text)."""
    q = asked.withColumn("_q", text.comparable(F.col("quote")))
    cited = F.size("ranges") > 0
    # the source first: only sources that have the quotation have their blocks searched
    whole = q.join(sources.select("doc_id", F.col("text").alias("_t")), "doc_id", "left").withColumn("_d", text.comparable(F.col("_t"))).drop("_t").withColumn("_in", F.coalesce(text.contained(F.col("_q"), F.col("_d")), F.lit(False))).withColumn("_times", text.occurrences(F.col("_q"), F.col("_d"))).drop("_d")
    hits = whole.filter("_in").join(blocks.select("doc_id", "number", text.comparable(F.col("text")).alias("_b")), "doc_id").withColumn("_hit", text.contained(F.col("_q"), F.col("_b"))).withColumn("_scope", in_scope(F.col("number"), F.col("ranges")))
    found = hits.groupBy("item_id", "doc_id").agg(
        F.bool_or("_scope").alias("_available"), F.bool_or(F.col("_hit") & F.col("_scope")).alias("_cited"), F.bool_or("_hit").alias("_any"),
        F.array_sort(F.collect_list(F.when(F.col("_hit") & F.col("_scope"), F.col("number")))).alias("_in_labels"), F.array_sort(F.collect_list(F.when(F.col("_hit"), F.col("number")))).alias("_labels"))
    joined = whole.join(found, ["item_id", "doc_id"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    place = F.when(yes("_cited"), "cited").when(~cited, "uncited").when(yes("_available"), "alternate").otherwise("scope_unavailable")
    location = F.when(yes("_any"), place).when(F.col("_in"), F.concat(place, F.lit("_document"))).otherwise("unmatched")
    short = (F.size(text.words(F.col("_q"))) < least_words) & (F.col("_times") != 1)
    none = F.array().cast(dict(blocks.dtypes)["number"].join(["array<", ">"]))
    labels = F.when(~yes("_any") | short, none).when(yes("_cited"), F.col("_in_labels")).otherwise(F.col("_labels"))
    return joined.select("item_id", "doc_id", location.alias("location"), labels.alias("labels"))


_TOKEN = "[0-9]{1,4}(?:[.-][0-9]{1,4}){0,3}(?:\\s*\\((?:[0-9]{1,3}|[A-Za-z]{1,5})\\))*"
_CHILD = "\\((?:[0-9]{1,3}|[A-Za-z]{1,5})\\)(?:\\s*\\((?:[0-9]{1,3}|[A-Za-z]{1,5})\\))*"
_TO = "\\s*(?:–|—|\\s-\\s|\\bto\\b)\\s*"


def provision_range(first: Column, last: Column, most: int = 50) -> Column:
    """The provisions from first to last that differ in their last number or letter only: 7 to 9, 7.1 to 7.3, 11(1) to 11(3), 2(a) to 2(c).
    An array of both where that is not so, or the range is longer than most."""
    head, tail = lambda c: F.regexp_extract(c, "^(.*?)(?:[0-9]{1,4}|\\([0-9]{1,4}\\)|\\([A-Za-z]\\))$", 1), lambda c: F.regexp_extract(c, "([0-9]{1,4}|[A-Za-z])\\)?$", 1)
    closed = F.when(first.endswith(")"), F.lit(")")).otherwise("")
    opened = F.when(first.endswith(")"), F.lit("(")).otherwise("")
    alike = (head(first) == head(last)) & (first.endswith(")") == last.endswith(")"))
    a, z = tail(first), tail(last)
    numbers = alike & a.rlike("^[0-9]+$") & z.rlike("^[0-9]+$") & (z.try_cast("int") >= a.try_cast("int")) & (z.try_cast("int") - a.try_cast("int") < most)
    letters = alike & a.rlike("^[A-Za-z]$") & z.rlike("^[A-Za-z]$") & (F.ascii(F.lower(z)) >= F.ascii(F.lower(a)))
    named = lambda x: F.concat(head(first), opened, x, closed)
    spread = F.transform(F.sequence(F.coalesce(F.when(numbers, a.try_cast("int")), F.lit(0)), F.coalesce(F.when(numbers, z.try_cast("int")), F.lit(0))), lambda n: named(n.cast("string")))
    lettered = F.transform(F.sequence(F.when(letters, F.ascii(F.lower(a))).otherwise(0), F.when(letters, F.ascii(F.lower(z))).otherwise(0)), lambda n: named(F.when(a == F.lower(a), F.char(n)).otherwise(F.upper(F.char(n)))))
    return F.when(numbers, spread).when(letters, lettered).otherwise(F.array(first, last))


def cited_provisions(column: Column) -> Column:
    """Sections, rules and articles that a citation names, ranges spread: 'ss 7-9' is 7, 8, 9 (a hyphen is a range behind a plural only),
    '11(1)–(3)' is 11(1), 11(2), 11(3), and '(a) to (c)' goes on from the provision before it. Each once, in order."""
    label = "(?i:\\b(ss|sections|subsections|rr|rules|arts|articles|s|section|subsection|r|rule|art|article)\\b\\.?)"
    listed = f"{label}\\s*({_TOKEN}(?:(?:{_TO}|\\s*,\\s*(?:and\\s+)?|\\s+and\\s+|\\s*&\\s*)(?:{_TOKEN}|{_CHILD}))*)"
    plural = F.transform(F.regexp_extract_all(column, F.lit(listed), F.lit(1)), lambda x: F.lower(x).isin("ss", "sections", "subsections", "rr", "rules", "arts", "articles"))
    lists = F.regexp_extract_all(column, F.lit(listed), F.lit(2))
    base = lambda c: F.regexp_replace(c, "\\s*\\([^)]+\\)$", "")

    def one(text: Column, many: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(text, _TO, "␟"), "\\s*,\\s*(?:and\\s+)?|\\s+and\\s+|\\s*&\\s*", "␞")
        compact = F.when(many, F.regexp_replace(marked, "(?<=^|␞)([0-9]{1,4}(?:\\.[0-9]{1,4}){0,3})-([0-9]{1,4}(?:\\.[0-9]{1,4}){0,3})(?=␞|$)", "$1␟$2")).otherwise(marked)

        def step(state: Column, item: Column) -> Column:
            ends = F.transform(F.split(F.regexp_replace(item, "\\s+", ""), "␟"), lambda e: e)
            last = F.coalesce(F.try_element_at(state, F.lit(-1)), F.lit(""))
            a = F.when(F.get(ends, F.lit(0)).startswith("("), F.concat(base(last), F.get(ends, F.lit(0)))).otherwise(F.get(ends, F.lit(0)))
            z = F.get(ends, F.lit(1))
            z = F.when(z.startswith("("), F.concat(base(a), z)).otherwise(z)
            return F.concat(state, F.when(z.isNull(), F.array(a)).otherwise(provision_range(a, z)))

        return F.aggregate(F.split(compact, "␞"), F.array().cast("array<string>"), step)

    return F.array_distinct(F.flatten(F.zip_with(lists, plural, one)))


def section_ancestors(label: Column) -> Column:
    """A provision and those above it, by brackets: 7(1)(a), 7(1), 7."""
    deep = F.regexp_count(label, F.lit("\\(")).cast("int")
    return F.transform(F.sequence(F.lit(0), deep), lambda n: _without_last(label, n))


def _without_last(label: Column, n: Column) -> Column:
    """label without its last n bracketed parts."""
    parts = F.split(F.regexp_replace(label, "\\(", "␟("), "␟")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - n), "")


def cited_sections(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(item_id, doc_id, label, exact) of the section blocks (doc_id, label) that asked (item_id, doc_id, sections) cite: each by its own
    label, else by the nearest one above it that the source has."""
    each = asked.select("item_id", "doc_id", F.explode("sections").alias("_cited")).withColumn("_a", section_ancestors(F.col("_cited")))
    tried = each.select("item_id", "doc_id", "_cited", F.posexplode("_a").alias("_up", "_l")).withColumn("_l", F.lower("_l"))
    met = tried.join(blocks.select("doc_id", "label", F.lower("label").alias("_l")), ["doc_id", "_l"])
    best = met.groupBy("item_id", "doc_id", "_cited").agg(F.min(F.struct("_up", "label")).alias("_b"))
    return best.groupBy("item_id", "doc_id", F.col("_b.label").alias("label")).agg(F.max(F.col("_b._up") == 0).alias("exact"))


def resolve_scored(asked: DataFrame, blocks: DataFrame, sources: DataFrame, minimum: float = 0.60, strong: float = 0.98, margin: float = 0.10, least_words: int = 3) -> DataFrame:
    """Per asked quotation (item_id, doc_id, quote, ranges: cited block ranges, empty for none): location, score and labels.

    Blocks (doc_id, number, text) are scored where exact or plausible. A cited block of at least strong decides (cited); so does a
    cited range as a whole, all of whose blocks exist, unless a block in it does as well alone. Else other blocks of at least strong
    (alternate, or uncited where nothing was cited, or scope_unavailable where the cited blocks don't exist); else a cited block
    of at least minimum; else the best other block if it is alone or ahead of the second by margin. Labels of quotations of fewer than
    least_words words are given only if the source has it once. What no block has is scored against the whole source
    (the same with _document), and is unmatched below minimum, with that score."""
    by = ["item_id", "doc_id"]
    q = materialize(asked.select(*by, "quote", "ranges"), "asked")  # read in every step below, as are the texts: each would be worked out anew
    mine = small(materialize(q.select("doc_id").distinct(), "documents"))
    blocks = materialize(blocks.select("doc_id", "number", "text").join(mine, "doc_id", "left_semi"), "blocks")
    sources = materialize(sources.select("doc_id", "text").join(mine, "doc_id", "left_semi"), "sources")
    pair = F.struct(*by).alias("item_id")  # ranges are a pair's own, so pairs are what is asked
    wanted = asked_texts(q.select(pair, "quote"), "quote")
    pairs = q.select(pair, "doc_id")
    alone = judged(grouped(pairs, wanted, held_texts(blocks, "doc_id", "number")), "number", least=minimum)
    alone = alone.select("item_id.*", "number", F.col("number").alias("_to"), "score", F.col("exact").alias("_exact"))
    ranges = q.filter(F.size("ranges") > 0).select(*by, F.explode("ranges").alias("r")).filter("r.high > r.low").select(*by, "r.low", "r.high")
    inside = blocks.join(ranges, "doc_id").filter("number between low and high")
    spans = inside.groupBy(*by, "low", "high").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("_m")).filter("size(_m) = high - low + 1")
    spans = spans.select(*by, F.col("low").alias("number"), F.col("high").alias("_to"), F.array_join(F.transform("_m", lambda m: m["text"]), "\n").alias("text")).join(q, by)
    exact = text.contained(text.comparable(F.col("quote")), text.comparable(F.col("text")))
    wide = spans.withColumn("_exact", exact).filter(F.col("_exact") | text.plausible(F.col("quote"), F.col("text"))).withColumn("score", score(F.col("text"), F.col("quote"), F.col("_exact")))
    both = alone.unionByName(wide.select(*alone.columns)).filter(F.col("score") >= minimum).join(q.select(*by, "ranges"), by)
    scored = both.select(*by, "number", "_to", "score", "_exact", (in_scope(F.col("number"), F.col("ranges")) | (F.col("_to") > F.col("number"))).alias("_cited"), (F.col("_to") > F.col("number")).alias("_wide"))
    scored = materialize(scored, "scored")
    high = scored.filter((F.col("score") >= strong) & F.col("_cited"))
    best = high.groupBy(*by).agg(F.max(F.when(F.col("_wide"), F.col("score"))).alias("_w"), F.max(F.when(~F.col("_wide"), F.col("score"))).alias("_s"), F.coalesce(F.bool_or(F.col("_exact") & ~F.col("_wide")), F.lit(False)).alias("_has"))
    narrow = F.col("_w").isNull() | F.coalesce(F.col("_has") | (F.col("_s") >= F.col("_w")), F.lit(False))
    taken = high.join(best.select(*by, narrow.alias("_narrow")), by).filter("_wide <> _narrow").withColumn("_rule", F.lit(1))
    other = scored.filter("not _cited and not _wide")
    strong_other = other.filter(F.col("score") >= strong).withColumn("_rule", F.lit(2))
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "number")
    weak_cited = scored.filter("_cited").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").withColumn("_rule", F.lit(3))
    ranked = other.withColumn("_r", F.row_number().over(w)).withColumn("_second", F.lead("score").over(w))
    clear = ranked.filter((F.col("_r") == 1) & (F.col("_second").isNull() | (F.col("score") - F.col("_second") >= margin))).drop("_r", "_second").withColumn("_rule", F.lit(4))
    every = taken.drop("_narrow").unionByName(strong_other).unionByName(weak_cited).unionByName(clear)
    rule = every.groupBy(*by).agg(F.min("_rule").alias("_rule"))
    chosen = every.join(rule, [*by, "_rule"])
    label = F.when(F.col("_wide"), F.concat_ws("–", F.col("number").cast("string"), F.col("_to").cast("string"))).otherwise(F.col("number").cast("string"))
    found = chosen.withColumn("_l", label).groupBy(*by).agg(F.min("_rule").alias("_rule"), F.max("score").alias("_score"), F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "number", "_l"))).alias("_labels"))
    available = blocks.join(q.select(*by, F.explode("ranges").alias("r")), "doc_id").filter("number between r.low and r.high").select(*by).distinct().withColumn("_available", F.lit(True))
    found = materialize(found, "found")
    lacking = q.join(found, by, "left_anti")
    in_all = judged(grouped(lacking.select(pair, "doc_id"), wanted, held_texts(sources, "doc_id")), plausible=False, least=0.0).select("item_id.*", F.coalesce("score", F.lit(0.0)).alias("_all_score"))
    # few words may stand in the source more than once: only those are counted
    few = found.filter(F.col("_rule").isin(2, 4)).join(q.filter(F.size(text.words(F.col("quote"))) < least_words), by)
    times = few.join(sources.select("doc_id", F.col("text").alias("_all")), "doc_id", "left").select(*by, text.occurrences(text.comparable(F.col("quote")), text.comparable(F.col("_all"))).alias("_times"), F.lit(True).alias("_few"))
    joined = q.join(found, by, "left").join(available, by, "left").join(in_all, by, "left").join(times, by, "left")
    missing = F.col("_rule").isNull()
    joined = joined.withColumn("_doc", F.when(missing, F.coalesce("_all_score", F.lit(0.0))))
    place = F.when(F.coalesce("_available", F.lit(False)), "alternate").when(F.size("ranges") > 0, "scope_unavailable").otherwise("uncited")
    location = F.when(F.col("_rule").isin(1, 3), "cited").when(~missing, place).when(F.col("_doc") >= minimum, F.concat(place, F.lit("_document"))).otherwise("unmatched")
    short = F.coalesce("_few", F.lit(False)) & ~F.col("_times").eqNullSafe(F.lit(1))
    none = F.array().cast("array<string>")
    labels = F.when(missing | short, none).otherwise(F.transform("_labels", lambda x: x["_l"]))
    return joined.select("item_id", "doc_id", location.alias("location"), F.round(F.coalesce("_score", "_doc"), 6).alias("score"), labels.alias("labels"))


def locators(resolved: DataFrame, kind: str) -> DataFrame:
    """resolved (labels and others) with locator, the one place that a quotation can be pointed to (par5, page 5 or sec5 by kind); null
    where there is none or more than one."""
    prefix = {"paragraph": "par", "page": "page ", "section": "sec"}[kind]
    return resolved.withColumn("locator", F.when(F.size("labels") == 1, F.concat(F.lit(prefix), F.get("labels", F.lit(0)))))


def specific_labels(matches: DataFrame) -> DataFrame:
    """matches (item_id, label, score) without those whose label is above another match's of at least the same score: 7 gives way to
    7(1) and 7.2."""
    below = matches.select("item_id", F.col("label").alias("_l"), F.col("score").alias("_s"))
    under = below.select("item_id", F.explode(_ancestors(F.col("_l"))).alias("label"), "_s").groupBy("item_id", "label").agg(F.max("_s").alias("_s"))
    return matches.join(under, ["item_id", "label"], "left").filter("_s is null or _s < score").drop("_s")


def _ancestors(label: Column) -> Column:
    """The labels above 7.2(1): 7.2 and 7."""
    cut = F.regexp_extract_all(label, F.lit("(\\(?[^.()]+\\)?\\.?)"), F.lit(1))
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(cut) - 1, F.lit(1))), lambda n: F.regexp_replace(F.array_join(F.slice(cut, 1, n), ""), "\\.$", ""))
    return F.when(F.size(cut) > 1, made).otherwise(F.array().cast("array<string>"))


def best_anchor(pairs: DataFrame, by: str) -> DataFrame:
    """The best scored of each group's pairs (score, pos), the first of equals."""
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), "pos")
    return pairs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
