"""Quotations against sources: candidates, exact and partial matches, the blocks they stand in, and verdicts."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from marginalia.functions import similarity, text
from marginalia.sources.shared import grouped, materialize, small, spread_join

MINIMUM, STRONG, MARGIN = 0.60, 0.98, 0.10  # fixed: thresholds of partial matches, of matches, and between a best and a second


def distinct_quotes(quotes: DataFrame, by: str, quote: str, order: str) -> DataFrame:
    """The first spelling of each quotation within by: quotations are equal if their comparable texts are."""
    w = Window.partitionBy(by, "_key").orderBy(order)
    return quotes.withColumn("_key", text.comparable(F.col(quote))).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_key", "_rn")


def run_hashes(words, n: int):
    """64-bit hashes of all runs of n words of an array column, which should be a column and no expression, as it is read n times;
    none for fewer words. Among 10^12 runs of sources and 10^6 of quotations two fall together with a chance of about 0.05."""
    many = F.greatest(F.size(words) - n + 1, F.lit(0))
    hashed = lambda i: F.transform(F.slice(words, F.lit(i), many), lambda w: F.xxhash64(w))
    runs = hashed(1)
    for i in range(2, n + 1):
        runs = F.zip_with(runs, hashed(i), lambda a, b: F.xxhash64(a, b))
    return F.array_distinct(runs)


def ngram_candidates(quotes: DataFrame, sources: DataFrame, n: int = 5, least: int = 1) -> DataFrame:
    """(item_id, doc_id, shared): sources that share at least `least` different n-word runs with a quotation.

    Words are found once a text; only hashes of runs are exploded, and meet those of the quotations, which are broadcast if they are
    few. So a large corpus is read once and what is shuffled are the hits."""
    hashed = lambda df, key: df.select(key, text.words(F.col("text")).alias("_w")).select(key, F.explode(run_hashes(F.col("_w"), n)).alias("run"))
    return hashed(sources, "doc_id").join(small(hashed(quotes, "item_id")), "run").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)


def overlap_candidates(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(item_id, doc_id): every pair for which text.plausible holds, and others that share a rare word.

    Of the n content words of a quotation a plausible source has at least k (1 of up to 2, 2 of up to 4, else 35 %), so it
    has one of any n - k + 1 of them: the rarest are asked for. A quotation without content words asks for all of its
    words. Sources are read once for the counts of the quotations' words and once for their places; both times only words of quotations
    leave the scan. Words are spread over tasks where the list of asked words is too large to broadcast."""
    mine = text.content_words(F.col("text"))
    q = quotes.select("item_id", F.when(F.size(mine) > 0, mine).otherwise(F.array_distinct(text.words(F.col("text")))).alias("_w"), F.size(mine).alias("_n"))
    asked = materialize(q.select("item_id", "_n", F.size("_w").alias("_all"), F.explode("_w").alias("word")), "asked")
    held = lambda: sources.select("doc_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("word"))
    counts = held().join(small(asked.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("_docs"))
    rarest = Window.partitionBy("item_id").orderBy("_docs", "word")
    # a word that no source has comes first of all, and is dropped as it can meet none
    ranked = asked.join(counts, "word", "left").withColumn("_docs", F.coalesce("_docs", F.lit(0))).withColumn("_r", F.row_number().over(rarest))
    prefix = F.when(F.col("_n") == 0, F.col("_all")).otherwise(F.col("_n") - text.enough(F.col("_n")) + 1)
    chosen = materialize(ranked.filter((F.col("_r") <= prefix) & (F.col("_docs") > 0)).select("item_id", "word", F.col("_docs").alias("_many")), "prefix")
    return spread_join(held(), chosen, "word", "_many", F.xxhash64("doc_id")).select("item_id", "doc_id").distinct()


def plausible_pairs(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(item_id, doc_id): the pairs for which text.plausible holds; of quotations without content words, the sources that share a word."""
    q = quotes.select("item_id", text.content_words(F.col("text")).alias("_w"))
    d = sources.select("doc_id", text.content_words(F.col("text")).alias("_d"))
    met = grouped(overlap_candidates(quotes, sources), q, d)
    fits = F.filter("asked", lambda x: text.shares_enough(x["_w"], F.col("_d")))
    return met.select("doc_id", F.explode(F.transform(fits, lambda x: x["item_id"])).alias("item_id")).select("item_id", "doc_id")


def exact_matches(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(item_id, doc_id): sources that contain a quotation, both in comparable form.

    A quotation is looked for where its anchor occurs: of five pieces and more the three in its middle, of three and four the
    second, of one the word itself, each of which a source that contains the quotation must have as whole pieces. Of two pieces, which
    may be cut out of longer ones, the last letters of the first and the first of the second are the anchor (up to three each).
    Hashes of anchors are joined; the texts of hits are normalised once a source and compared with all quotations that hit it."""
    q = quotes.select("item_id", text.comparable(F.col("text")).alias("_q")).filter("_q <> ''").withColumn("_p", F.split("_q", " "))
    q = materialize(q.withColumn("_n", F.size("_p")), "asked")
    ends = lambda a, b, i, j: F.xxhash64(F.right(a, F.lit(i)), F.left(b, F.lit(j)), F.lit(10 * i + j))
    ends_of = lambda i, j: lambda a, b: ends(a, b, i, j)
    reach = lambda c: F.least(F.length(c), F.lit(3))
    kind = F.when(F.col("_n") >= 5, 3).when(F.col("_n") >= 3, 1).when(F.col("_n") == 1, 0).otherwise(100 + 10 * reach(F.col("_p")[0]) + reach(F.get("_p", F.lit(1))))
    have = sorted(r[0] for r in q.select(kind).distinct().collect())  # at most 3 + 16 numbers
    pieces = sources.select("doc_id", F.split(text.comparable(F.col("text")), " ").alias("_p"))
    asked = {
        3: q.filter("_n >= 5").select("item_id", F.explode(run_hashes(F.slice("_p", (F.col("_n") / 2).cast("int"), 3), 3)).alias("run")),
        1: q.filter("_n in (3, 4)").select("item_id", F.xxhash64(F.xxhash64(F.col("_p")[1])).alias("run")),
        0: q.filter("_n = 1").select("item_id", F.xxhash64("_q").alias("run"))}
    alone = F.split(F.regexp_replace(F.array_join("_p", " "), "[^\\p{L}\\p{N}']+", " "), " ")
    held = {3: run_hashes(F.col("_p"), 3), 1: F.transform(F.array_distinct("_p"), lambda w: F.xxhash64(F.xxhash64(w))), 0: F.transform(F.array_distinct(alone), lambda w: F.xxhash64(w))}
    behind = F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0)))
    for k in (x for x in have if x >= 100):
        i, j = k // 10 % 10, k % 10
        asked[k] = q.filter((F.col("_n") == 2) & (kind == k)).select("item_id", ends(F.col("_p")[0], F.col("_p")[1], i, j).alias("run"))
        held[k] = F.array_distinct(F.zip_with(F.slice("_p", F.lit(1), F.size(behind)), behind, ends_of(i, j)))
    found = [pieces.select("doc_id", F.explode(held[k]).alias("run")).join(small(asked[k]), "run").select("item_id", "doc_id") for k in have]
    if not found:
        found = [quotes.select("item_id").limit(0).join(sources.select("doc_id").limit(0))]
    hits = materialize(functools.reduce(DataFrame.unionByName, found).distinct(), "hits")
    named = sources.join(small(hits.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", text.comparable(F.col("text")).alias("_d"))
    met = grouped(hits, q.select("item_id", "_q"), named)
    inside = F.filter("asked", lambda x: text.contained(x["_q"], F.col("_d")))
    return materialize(met.select("doc_id", F.explode(F.transform(inside, lambda x: x["item_id"])).alias("item_id")).select("item_id", "doc_id"), "matches")


def _cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            lines = pc.split_pattern(batch.column(1).cast(pa.large_string()), "\n")
            row, flat = pc.list_parent_indices(lines).to_numpy(), pc.list_flatten(lines)
            size = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
            end = np.cumsum(size + 1) - 1
            first = np.flatnonzero(np.diff(row, prepend=-1))
            block = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
            start = end - size - np.repeat((end - size)[first], np.diff(first, append=len(row)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(block, pa.int32()), pa.array(start), pa.array(start + size), flat.cast(pa.string())], ["doc_id", "block", "start", "end", "text"])


def line_blocks(sources: DataFrame) -> DataFrame:
    """(doc_id, block, start, end, text): the lines of each source with their offsets in code points (from 0; end is behind the last). A null
    text has none. Lengths are added up where the text lies, so nothing is shuffled."""
    fields = [StructField("block", IntegerType()), StructField("start", LongType()), StructField("end", LongType()), StructField("text", StringType())]
    return sources.select("doc_id", "text").mapInArrow(_cut_lines, StructType([sources.schema["doc_id"], *fields]))


def _cut_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(whole.num_rows):
            doc, text, marks = whole.column(0).slice(i, 1), whole.column(1)[i].as_py(), whole.column(2)[i].values
            for at in range(0, len(marks), 10_000):  # a string of Python is cut anywhere at the cost of the piece alone
                part = marks.slice(at, 10_000)
                fields = dict(zip(part.type.names, part.flatten(), strict=True))
                start, end = fields.pop("start"), pc.fill_null(fields.pop("end").cast(pa.int64()), pa.scalar(None if text is None else len(text), pa.int64()))
                pieces = [None if text is None or s is None else text[s:e] for s, e in zip(start.to_pylist(), end.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(np.zeros(len(part), np.int64))), start, end, *fields.values(), pa.array(pieces, pa.string())], ["doc_id", "start", "end", *fields, "text"])


def cut(marks: DataFrame, sources: DataFrame, trimmed: bool = False) -> DataFrame:
    """marks (doc_id, start, end: null for the end of the source, and others) with end filled in and text, what stands between. The
    marks of a source are gathered, so its text is met once and not once a mark, and read once: Spark's substring counts characters from the
    text's beginning for every mark."""
    others = [c for c in marks.columns if c not in ("doc_id", "start", "end")]
    listed = marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", *others)).alias("_m"))
    joined = listed.join(sources.select("doc_id", F.col("text").alias("_all")), "doc_id").select("doc_id", "_all", "_m")
    named = {f.name: f for f in marks.schema.fields}
    schema = StructType([joined.schema["doc_id"], named["start"], StructField("end", LongType()), *[named[c] for c in others], StructField("text", StringType())])
    pieces = joined.mapInArrow(_cut_marks, schema)
    return pieces.withColumn("text", F.regexp_replace("text", "\\s+$", "")) if trimmed else pieces


def markers(sources: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, label, start, end, text) of blocks that begin at a marker (pattern's first group is the label, at the start of a
    line) and end at the next marker or with the source."""
    marked = line_blocks(sources).withColumn("label", F.regexp_extract("text", pattern, 1)).filter("label <> ''").drop("text", "end")
    ended = marked.withColumn("end", F.lead("start").over(Window.partitionBy("doc_id").orderBy("start")) - 1)
    return cut(ended.select("doc_id", "label", "start", "end"), sources).select("doc_id", "label", "start", "end", "text")


def monotone_blocks(blocks: DataFrame, least: int = 5, gap: int = 8) -> DataFrame:
    """Blocks (doc_id, number, start) that belong to a run of ascending numbers: a run breaks where the number does not grow or
    grows by more than gap, and counts from least blocks on; the longest run of a source is kept, of equals the first."""
    w = Window.partitionBy("doc_id").orderBy("start")
    step = F.col("number") - F.lag("number").over(w)
    runs = blocks.withColumn("_break", F.when(step.isNull() | (step < 1) | (step > gap), 1).otherwise(0)).withColumn("_run", F.sum("_break").over(w))
    sized = runs.groupBy("doc_id", "_run").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    best = sized.groupBy("doc_id").agg(F.max(F.struct("_n", -F.col("_run"))).alias("_b")).select("doc_id", (-F.col("_b.col2")).alias("_run"))
    return runs.join(best, ["doc_id", "_run"]).drop("_break", "_run")


def locate(matches: DataFrame, quotes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(item_id, doc_id, block, span): the blocks where a matching quotation stands, alone (span 1) or over its end into the next
    block (span 2, only if neither block has it alone)."""
    q = quotes.select("item_id", text.comparable(F.col("text")).alias("_q"))
    w = Window.partitionBy("doc_id").orderBy("block")
    two = blocks.join(matches.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_next", F.lead("text").over(w))
    both = two.select("doc_id", "block", text.comparable(F.col("text")).alias("_one"), text.comparable(F.col("_next")).alias("_second"), text.comparable(F.concat_ws("\n", "text", "_next")).alias("_two"))
    hits = matches.join(q, "item_id").join(both, "doc_id")
    has = lambda c: F.coalesce(text.contained(F.col("_q"), F.col(c)), F.lit(False))
    return hits.withColumn("span", F.when(has("_one"), 1).when(has("_two") & ~has("_second"), 2)).filter("span is not null").select("item_id", "doc_id", "block", "span")


def asked_texts(quotes: DataFrame, quote: str = "text") -> DataFrame:
    """(item_id, _q, _c, _w): quotations as judged compares them: as they are, in comparable form, and their content words."""
    return quotes.select("item_id", F.col(quote).alias("_q"), text.comparable(F.col(quote)).alias("_c"), text.content_words(F.col(quote)).alias("_w"))


def held_texts(sources: DataFrame, *keep: str) -> DataFrame:
    """keep, and _t, _d, _v: texts as judged compares them, each normalised once."""
    return sources.select(*keep, F.col("text").alias("_t"), text.comparable(F.col("text")).alias("_d"), text.content_words(F.col("text")).alias("_v"))


def judged(met: DataFrame, *keep: str, plausible: bool = True, least: float = MINIMUM) -> DataFrame:
    """keep, item_id, exact and score of what grouped brought together (held_texts with asked_texts): 1 where the text contains the quotation, else
    the matched share, which may be 0 where it can't reach least. Implausible pairs are dropped unless plausible is false. Only inexact ones
    that can reach least are aligned."""
    judge = lambda x: F.struct(x["item_id"].alias("item_id"), x["_q"].alias("_q"), F.coalesce(text.contained(x["_c"], F.col("_d")), F.lit(False)).alias("exact"), text.shares_enough(x["_w"], F.col("_v")).alias("_some"))
    # written, as Spark would else work out every comparison anew for each of the columns that are made of it
    split = materialize(met.select(*keep, "_t", F.transform("asked", judge).alias("_j")), "judged")
    open_ = F.filter("_j", lambda x: ~x["exact"] & (x["_some"] | F.lit(not plausible)))
    split = split.select(*keep, "_t", F.filter("_j", lambda x: x["exact"]).alias("_exact"), open_.alias("_open"))
    some = F.size("_open") > 0
    aligned = split.withColumn("_s", similarity.match_scores(F.when(some, F.col("_t")), F.when(some, F.transform("_open", lambda x: x["_q"])), F.lit(float(least))))
    row = lambda x, exact, score: F.struct(x["item_id"].alias("item_id"), F.lit(exact).alias("exact"), score.alias("score"))
    whole = F.transform("_exact", lambda x: row(x, True, F.lit(1.0)))
    return aligned.select(*keep, F.inline(F.concat(whole, F.coalesce(F.zip_with("_open", "_s", lambda x, y: row(x, False, y)), F.slice(whole, 1, 0)))))


def scored(pairs: DataFrame, quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """pairs (item_id, doc_id) with exact and score; partial matches below MINIMUM or without enough shared content are dropped.
    Exact pairs and implausible ones never reach the alignment, which sees whole sources (long ones around anchor phrases). A source is
    normalised once, and handed over with many quotations at once."""
    pairs = materialize(pairs.select("item_id", "doc_id"), "pairs")  # read more than once
    named = sources.join(small(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    out = judged(grouped(pairs, asked_texts(quotes), held_texts(named, "doc_id")), "doc_id")
    return out.filter(F.col("score") >= MINIMUM).select("item_id", "doc_id", "exact", F.round("score", 6).alias("score"))


def corrections(matches: DataFrame, quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """matches (item_id, doc_id and others) with fragment, the stretch of the source that the quotation stands for, and corrected, the
    quotation in that stretch's words: what it leaves out as ..., its own words in brackets. Of long sources the region is found first
    that has most of the quotation's words, and its ends are trimmed to the quotation's."""
    met = grouped(matches, quotes.select("item_id", F.col("text").alias("_q")), sources.select("doc_id", F.col("text").alias("_d")))
    listed = met.select("doc_id", "asked", similarity.source_fragments(F.col("_d"), F.transform("asked", lambda x: x["_q"])).alias("_f"))
    each = listed.select("doc_id", F.inline(F.zip_with("asked", "_f", lambda x, f: F.struct(x["item_id"].alias("item_id"), x["_q"].alias("_q"), f.alias("fragment")))))
    return matches.join(each, ["item_id", "doc_id"]).withColumn("corrected", similarity.corrected_quote(F.col("fragment"), F.col("_q"))).drop("_q")


def clear_winner(scores: DataFrame, by: str = "item_id") -> DataFrame:
    """The best source of each quotation if it is ahead of the second by MARGIN or exact; otherwise none (ambiguous stays out)."""
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), "doc_id")
    ranked = scores.withColumn("_rn", F.row_number().over(w)).withColumn("_second", F.lead("score").over(w))
    return ranked.filter((F.col("_rn") == 1) & (F.col("exact") | F.col("_second").isNull() | (F.col("score") - F.col("_second") >= MARGIN))).drop("_rn", "_second")


def verdicts(checked: DataFrame, by: str) -> DataFrame:
    """One row a group of checked (score: null if not found; alternate: found outside the cited scope): quotes, accepted, perfect,
    best and status. A row is MATCH only if all its quotations are strong; ALT if all accepted ones lie outside the scope."""
    ok = F.col("score") >= MINIMUM
    agg = checked.groupBy(by).agg(
        F.count(F.lit(1)).alias("quotes"), F.count_if(ok).alias("accepted"), F.coalesce(F.bool_and(F.coalesce(F.col("score") >= STRONG, F.lit(False))), F.lit(False)).alias("perfect"),
        F.max("score").alias("best"), F.coalesce(F.bool_and(F.when(ok, F.col("alternate"))), F.lit(False)).alias("all_alternate"))
    place = F.when(F.col("all_alternate"), "ALT_PINPOINT_").otherwise("OG_PINPOINT_")
    status = F.when(F.col("accepted") == 0, "NO_MATCH").otherwise(F.concat(place, F.when(F.col("perfect"), "MATCH").otherwise("PARTIAL")))
    return agg.withColumn("status", status)
