"""Spelling variants: words one edit apart, from sorted dictionaries of beginnings and of reversed ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.blocks import by_unit, pairs_within
from marginalia.llm.common import materialize, spread_join

#: Maximal runs of letters; whether one is long enough is asked of its code points afterwards.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
#: Words that a block may hold before it is cut further.
BLOCK = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def dictionary(docs: DataFrame, least: int = 7, times: int = 2, every: int = 31, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z in lower case, of at least so many code points, that occur at least so many times.

    With every, a run whose CRC-32 with its document's key (`key:run`) it divides has lost one code point, the CRC-32 modulo its
    length: a stand-in for slips of the pen. A null text has no words, a null key counts as an empty one; empty tables give
    none. Runs are counted where they are read before the counts are shuffled, so a frequent word is a few rows."""
    run = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("k"), run.alias("r")).withColumn("r", F.translate("r", _UPPER, _LOWER))
    if every:
        h = F.crc32(F.concat("k", F.lit(":"), "r").cast("binary"))
        at = F.col("h") % F.length("r")
        lost = F.concat(F.expr("substring(r, 1, cast(h % length(r) as int))"), F.substring("r", (at + 2).cast("int"), F.length("r")))
        runs = runs.withColumn("h", h).withColumn("r", F.when(F.col("h") % every == 0, lost).otherwise(F.col("r")))
    long = runs.filter(F.length("r") >= least)
    return long.groupBy(F.col("r").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)


def _entries(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """rows (word, n, m) in the block of the window from lo to hi: m is the length of the shorter word of a pair, which agrees with
    the other outside the window, in its first lo and its last m - hi code points."""
    tail = F.col("m") - F.col("hi")
    placed = rows.withColumns({"lo": lo, "hi": hi})
    shared = placed.withColumns({"head": F.substring("word", F.lit(1), F.col("lo")), "tail": F.reverse(F.substring("word", F.length("word") - tail + 1, tail))})
    return shared.withColumn("block", F.xxhash64("m", "lo", "hi", "head", "tail"))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the blocks of both halves of its window: one edit leaves a half of the window intact."""
    middle = F.expr("cast((lo + hi) div 2 as int)")
    cut = rows.withColumn("_half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_mid", middle)
    first = F.col("_half") == 0
    return _entries(cut.select("word", "n", "m", F.when(first, F.col("lo")).otherwise(F.col("_mid")).alias("_lo"), F.when(first, F.col("_mid")).otherwise(F.col("hi")).alias("_hi")), F.col("_lo"), F.col("_hi")).drop("_lo", "_hi")


def blocks(words: DataFrame, most: int = BLOCK, levels: int = 40) -> DataFrame:
    """The blocks of words (word, n): rows (word, n, m, lo, hi, head, tail, block), a word once a block.

    A word takes part with its own length m and with m one less, as the longer of a pair. The first blocks share the first
    half of m code points (edit in the second half) or the last half (edit in the first). Blocks of more than `most` words are cut again,
    by halves of their window, until the window is one code point: then a block holds words that differ there only, at most one a
    letter, and for longer words one a pair of letters. So no word is left out and no block grows with the dictionary."""
    lengths = F.explode(F.array(F.length("word"), F.length("word") - 1))
    open_ = _halves(words.select("word", "n", lengths.alias("m")).filter("m > 0").withColumns({"lo": F.lit(0), "hi": F.col("m")}))
    done: DataFrame | None = None
    for _ in range(levels):
        open_ = materialize(open_, "blocks")
        # rows of the longer length alone make no pairs: both of such a pair meet under their own length
        sizes = open_.groupBy("block").agg(F.count(F.lit(1)).alias("_many"), F.max(F.length("word") == F.col("m")).alias("_own"), F.max(F.col("hi") - F.col("lo")).alias("_width"))
        large = materialize(sizes.filter((F.col("_many") > most) & (F.col("_width") > 1) & F.col("_own")).select("block", "_many"), "large")
        idle = materialize(sizes.filter((F.col("_many") == 1) | ~F.col("_own")).select("block", "_many"), "idle")
        some = large.count()
        kept = spread_join(open_, idle, "block", "_many", F.xxhash64("word"), "left_anti")
        rest = spread_join(kept, large, "block", "_many", F.xxhash64("word"), "left_anti") if some else kept
        done = rest if done is None else done.unionByName(rest)
        if not some:
            return done
        open_ = _halves(spread_join(open_, large, "block", "_many", F.xxhash64("word")).drop("_many"))
    raise RuntimeError(f"blocks are still too large after {levels} cuts")


def _codes(words: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), dtype=np.uint32).reshape(-1, width)


def one_edit(short: np.ndarray, long: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of code points, short of m and long of m, or m + 1 where same is false: whether they are one edit apart, and how many code
    points they share at the beginning (the edit's place)."""
    m = short.shape[1]
    begin = short == long[:, :m]
    head = np.where(begin.all(axis=1), m, begin.argmin(axis=1)) if m else np.zeros(len(short), dtype=np.int64)
    end = (short == np.where(same[:, None], long[:, :m], long[:, 1:]))[:, ::-1]
    tail = np.where(end.all(axis=1), m, end.argmin(axis=1)) if m else np.zeros(len(short), dtype=np.int64)
    return np.where(same, (head < m) & (head + tail >= m - 1), head + tail >= m), head


def _compare(t: pa.Table, cuts: np.ndarray) -> Iterator[tuple]:
    """Pairs of the blocks between the cuts that are one edit apart, each where its edit lies in the block's window, both ways."""
    words, n = t["word"].to_pylist(), t["n"].to_numpy()
    m, lo, hi = (t[c].to_numpy() for c in ("m", "lo", "hi"))
    size = np.array([len(w) for w in words])
    for a, b in pairs_within(cuts, 1 << 18):
        keep = (size[a] == m[a]) | (size[b] == m[b])
        a, b = a[keep], b[keep]
        swap = size[a] > size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        for length in np.unique(m[a]):
            mine = np.flatnonzero(m[a] == length)
            x, y = a[mine], b[mine]
            own, place = np.unique(np.concatenate([x, y]), return_inverse=True)
            codes = _codes([words[i] for i in own.tolist()], int(length) + 1)
            step = max(1, (1 << 24) // (int(length) + 1))
            for at in range(0, len(x), step):
                i, j = place[: len(x)][at : at + step], place[len(x) :][at : at + step]
                u, v = x[at : at + step], y[at : at + step]
                near, edit = one_edit(codes[i, : int(length)], codes[j], size[u] == size[v])
                near &= (edit >= lo[u]) & ((edit < hi[u]) | ((edit == length) & (hi[u] == length)))
                u, v = u[near], v[near]
                if len(u):
                    both, others = np.concatenate([u, v]), np.concatenate([v, u])
                    yield [words[i] for i in both.tolist()], [words[i] for i in others.tolist()], n[others]


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(word, near, near_n): every pair of distinct words (word, n) one inserted, deleted or replaced code point apart, both ways, each
    once. The dictionaries of beginnings and of reversed ends are sorted by ranges, and their blocks read off in order."""
    dealt = blocks(words, most).select("block", "word", "n", "m", "lo", "hi", "head", "tail")
    return by_unit(dealt, ["block"], _compare, "word string, near string, near_n long", ["word", "near", "near_n"], order=["m", "lo", "hi", "head", "tail", "block"])


def _roots(forms: DataFrame, hops: int = 20) -> DataFrame:
    """(word, root) for words with a form: the pointers of all words double their reach each round. Counts grow tenfold with each hop, so
    no chain is longer than a count has digits."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(hops.bit_length()):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        reached = materialize(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        now = reached.select("word", "root")
        if reached.filter("_moved").limit(1).count() == 0:
            return now
    return now


def variants(words: DataFrame, factor: int = 10, most: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of words (word, n; distinct): how many words are one edit away; the most frequent of
    these (ties: the first by code points), if it occurs at least factor times as often; and where the forms of forms end. words
    should be materialized, as it is read several times."""
    if factor < 2:
        raise ValueError("forms must be more frequent than words, or their chains need not end")
    best = near_words(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("w"))).alias("_best"))
    found = words.join(best, "word", "left")
    fits = -F.col("_best.k") >= F.col("n") * factor
    chosen = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("_best.w")).alias("form"), F.when(fits, -F.col("_best.k")).alias("form_n")), "forms")
    rooted = chosen.join(_roots(chosen.filter("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, **options) -> DataFrame:
    """variants over the dictionary of docs; options are those of dictionary. Extra columns of docs are not read; repeated rows count as
    often as they occur; an empty table gives none."""
    return variants(materialize(dictionary(docs, **options), "dictionary"))
