"""Reference chains: what an ibid or supra points to, and where its chain ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources.shared import materialize


def previous_part(parts: DataFrame, by: str = "doc_id", order: tuple[str, ...] = ("footnote_id", "part_index"), key: str = "part") -> DataFrame:
    """parts with previous, the part before in document order: what an ibid points to."""
    return parts.withColumn("previous", F.lag(key).over(Window.partitionBy(by).orderBy(*order)))


def run_origin(parts: DataFrame, own: str, by: str, order: tuple[str, ...], value: str) -> DataFrame:
    """parts with origin, the value of the last part so far that is no reference itself (own is true): the end of a run of ibids,
    without following it part by part. Null where a run has no beginning."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("origin", F.last(F.when(F.col(own), F.col(value)), ignorenulls=True).over(w))


def resolve_chains(parts: DataFrame, rounds: int = 40) -> DataFrame:
    """parts (part, target; null for an original citation) with origin, hops and note.

    Pointer doubling: each round joins every open pointer with the pointer it arrived at, so a chain of n references takes about
    log2(n) joins. A target that is not a part is 'missing target', a chain that comes round is 'loop'; both have no origin."""
    now = parts.select("part", F.col("target").alias("at"), F.when(F.col("target").isNull(), 0).otherwise(1).cast("long").alias("hops")).withColumn("at", F.coalesce("at", "part"))
    total = max(now.count(), 1)
    for i in range(rounds):
        step = now.select(F.col("part").alias("at"), F.col("at").alias("_to"), F.col("hops").alias("_h"))
        joined = now.join(step, "at", "left")
        now = joined.select("part", F.coalesce("_to", "at").alias("at"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"))
        now = materialize(now, "pointers")
        if 2**i > total:
            break
        moving = now.join(parts.filter("target is not null").select(F.col("part").alias("at")), "at", "left_semi")
        if moving.isEmpty():
            break
    ends = parts.select(F.col("part").alias("at"), F.col("target").isNull().alias("_end"))
    note = F.when(F.col("_end"), F.lit(None)).when(F.col("_end").isNull(), "missing target").otherwise("loop")
    ended = now.join(ends, "at", "left").select("part", F.when(F.col("_end"), F.col("at")).alias("origin"), F.when(F.col("_end"), F.col("hops")).alias("hops"), note.cast("string").alias("note"))
    return parts.join(ended, "part")


def chain_paths(resolved: DataFrame, label: str, separator: str = " → ") -> DataFrame:
    """resolved (resolve_chains' result, with a column label) with path, the labels of the references from each part to its origin,
    and first_page of the origin where the column is there. Chains that loop or break have a null path. By pointer doubling, as
    resolve_chains; a path is as long as its chain."""
    sound = resolved.filter("note is null")
    now = materialize(sound.select("part", F.coalesce("target", "part").alias("at"), F.when(F.col("target").isNotNull(), F.col(label)).alias("path")), "paths")
    longest = sound.agg(F.max("hops")).first()[0] or 0
    step = 1
    while step < longest:
        onward = now.select(F.col("part").alias("at"), F.col("at").alias("_to"), F.col("path").alias("_on"))
        joined = now.join(onward, "at")
        still = F.col("at") != F.col("_to")
        now = materialize(joined.select("part", F.col("_to").alias("at"), F.when(still, F.concat_ws(separator, "path", "_on")).otherwise(F.col("path")).alias("path")), "paths")
        step *= 2
    out = resolved.join(now.select("part", F.coalesce("path", F.lit("")).alias("path")), "part", "left")
    if "first_page" in resolved.columns:
        pages = resolved.select(F.col("part").alias("origin"), F.col("first_page").alias("_page"))
        out = out.join(pages, "origin", "left").withColumn("first_page", F.coalesce(F.nullif("_page", F.lit("")), "first_page")).drop("_page")
    return out


def chain_notes(resolved: DataFrame) -> DataFrame:
    """resolved with a sentence for each way in which a chain can fail."""
    said = F.when(F.col("note") == "loop", "Reference chain loop detected.").when(F.col("note") == "missing target", "Reference chain target not found in this document.")
    return resolved.withColumn("note", said)


def reverse_map(edges: DataFrame) -> DataFrame:
    """(target, source): which nodes point to each, every pair once."""
    return edges.select("target", "source").distinct()


def selection_union(*selections: DataFrame) -> DataFrame:
    """(doc_key, footnote_id) of all selections together, each once."""
    out = selections[0].select("doc_key", "footnote_id")
    for other in selections[1:]:
        out = out.unionByName(other.select("doc_key", "footnote_id"))
    return out.distinct()


def with_fields(rows: DataFrame, parts: DataFrame, fields: tuple[str, ...], by: tuple[str, ...] = ("doc_id", "footnote_id", "part_index")) -> DataFrame:
    """rows with the fields of the part that they belong to; null where there is none. Of parts that repeat a key the first is taken."""
    held = parts.groupBy(*by).agg(F.min(F.struct(*fields)).alias("_f")).select(*by, *[F.col(f"_f.{f}").alias(f) for f in fields])
    return rows.drop(*fields).join(held, list(by), "left")


def _jumps(edges: DataFrame) -> list[DataFrame]:
    """Tables (source, target) of where one target a source leads in 1, 2, 4, ... steps, as far as any path goes: the largest target of each."""
    now = materialize(edges.groupBy("source").agg(F.max("target").alias("target")), "jumps")
    out, most = [now], now.count()
    while 2 ** len(out) <= most:
        now = materialize(now.join(now.select(F.col("source").alias("target"), F.col("target").alias("_to")), "target").select("source", F.col("_to").alias("target")), "jumps")
        if now.isEmpty():
            break
        out.append(now)
    return out


def selection_closure(selected: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """All nodes that the selected ones (node) need, over edges (source, target): however long the chains are. With rounds, an error if
    something new is met after so many.

    Tables of jumps of 1, 2, 4, ... steps along one edge a node are made first; what is reached is marked by jumps of growing
    length, so a chain of n takes log2(n) rounds. Then one step along all other edges, from what is new, and jumps again, until nothing
    new is met: a round more for each time that a path leaves the first edges."""
    edges = materialize(edges.select("source", "target").distinct(), "edges")
    jumps = _jumps(edges)
    others = materialize(edges.join(jumps[0], ["source", "target"], "left_anti"), "others")
    branching = not others.isEmpty()
    follow = lambda nodes, table: table.join(nodes.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("target").alias("node")).distinct()
    seen = front = materialize(selected.select("node").distinct(), "seen")
    done = 0

    def grown(seen: DataFrame, reached: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        nonlocal done
        new = materialize(reached.join(seen, "node", "left_anti"), "front")
        if new.isEmpty():
            return None
        if done == rounds:
            raise RuntimeError(f"the closure is not complete after {rounds} rounds")
        done += 1
        return materialize(seen.unionByName(new), "seen"), new

    while True:
        for table in jumps:
            # front holds all that is reached from it in fewer steps than the jump has
            more = grown(seen, follow(front, table))
            if more is None:
                break
            seen, front = more[0], materialize(front.unionByName(more[1]), "front")
        if not branching or (more := grown(seen, follow(front, others))) is None:
            return seen
        seen, front = more


def inherited(parts: DataFrame, fields: tuple[str, ...], inherit: str = "inherit") -> DataFrame:
    """parts (part, origin and fields), whose blank fields are filled from their origin where inherit is true."""
    source = parts.select(F.col("part").alias("origin"), *[F.col(f).alias(f"_{f}") for f in fields])
    blank = lambda f: F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == ""
    take = lambda f: F.when(F.col(inherit) & blank(f) & (F.col("origin") != F.col("part")), F.col(f"_{f}")).otherwise(F.col(f))
    joined = parts.join(source, "origin", "left")
    return joined.select(*[take(f).alias(f) if f in fields else F.col(f) for f in parts.columns])


def registry_match(references: DataFrame, registry: DataFrame) -> DataFrame:
    """references (doc_id, seq, token, note) with the link of the earlier entry of the same document that the best tier names:
    note number, then exact short form, then the token in the citation's first 200 characters. A tier counts only if all its
    entries share one link up to its fragment; registry: (doc_id, seq, note, short_form, verbatim, link).

    Numbers and short forms are equality joins; entries of a document are met only by references that these leave open."""
    r = registry.select("doc_id", F.col("seq").alias("_seq"), F.col("note").alias("_note"), F.lower("short_form").alias("_short"), F.lower(F.substring("verbatim", 1, 200)).alias("_head"), "link", F.split_part("link", F.lit("#"), F.lit(1)).alias("_base"))
    asked = references.select("doc_id", "seq", F.col("note").alias("_note"), F.lower("token").alias("_short"))
    one = lambda met, tier: met.filter("_seq < seq").groupBy("doc_id", "seq").agg(F.count_distinct("_base").alias("_n"), F.min_by("link", "_seq").alias("link")).filter("_n = 1").select("doc_id", "seq", F.lit(tier).alias("tier"), "link")
    numbered = one(asked.drop("_short").join(r, ["doc_id", "_note"]), 1)
    named = one(asked.drop("_note").filter("_short <> ''").join(r.filter("_short <> ''"), ["doc_id", "_short"]), 2)
    known = materialize(numbered.unionByName(named), "tiers")
    left = asked.filter("_short <> ''").select("doc_id", "seq", F.col("_short").alias("_token")).join(known, ["doc_id", "seq"], "left_anti")
    held = one(left.join(r, "doc_id").filter(F.contains("_head", "_token")), 3)
    best = known.unionByName(held).groupBy("doc_id", "seq").agg(F.min(F.struct("tier", "link")).alias("_b")).select("doc_id", "seq", "_b.*")
    return references.join(best, ["doc_id", "seq"], "left")
