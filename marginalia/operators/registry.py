"""What a supra reference means among the citations before it: tiers of evidence, reasons for giving none, and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import references as refs
from marginalia.functions import shortforms
from marginalia.functions.citations import anchored_link
from marginalia.sources.shared import materialize

#: Letters by which words are looked up: shorter ones (a word has three at least) and those of WIDE letters and more.
GRAM, WIDE = 3, 6
HEAD, WINDOW, BEST = 200, 3, 8  # fixed: characters of a citation that name it, notes to either side of a wrong number, candidates shown
_DEALT = 16
#: Fixed: words that tell candidates apart least.
_STOP = (
    "supra", "note", "notes", "ibid", "at", "para", "paras", "the", "of", "and", "in", "see", "also", "v", "r", "c", "et", "al", "this", "that", "a", "an", "to", "for", "is", "was", "on", "by",
    "with", "as", "or",
)


def base(link: Column) -> Column:
    """The document of a link: without its fragment, in lower case."""
    return F.lower(F.trim(F.split_part(F.regexp_replace(F.coalesce(link, F.lit("")), "\\s+", " "), F.lit("#"), F.lit(1))))


def usable(link: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(link, F.lit("")))).isin("", "other")


def _entries(registry: DataFrame) -> DataFrame:
    """registry (doc_id, seq, note, short_form, verbatim, link) as references are matched with it."""
    named = F.concat_ws(" ", F.coalesce("short_form", F.lit("")), F.substring(F.coalesce("verbatim", F.lit("")), 1, HEAD))
    return registry.select(
        "doc_id", F.col("seq").alias("_at"), F.col("note").cast("string").alias("_note"), shortforms.bare_form(F.col("short_form")).alias("_form"), shortforms.reference_text(F.col("short_form")).alias("_short"),
        shortforms.reference_text(named).alias("_named"), shortforms.definitions(F.col("verbatim")).alias("_defined"), F.col("link").alias("_link"), base(F.col("link")).alias("_base"), usable(F.col("link")).alias("_usable"))


def _asked(references: DataFrame) -> DataFrame:
    said = shortforms.hint(F.col("verbatim"))
    return references.select("doc_id", "seq", shortforms.bare_form(said).alias("_hint"), shortforms.hint_tokens(said).alias("_tokens"), refs.supra_note(F.col("verbatim")).cast("string").alias("_note"))


def _meetings(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, seq, _at, _rule): the earlier entries of its document that a reference names, and how, by their texts alone: note (the note's
    number, and all words of the hint in the entry's name), exact_sf, token_sf, token_verb, bracket_definition.

    Numbers, short forms and definitions are equality joins. Words may stand inside longer ones, so a reference looks entries up by the rarest
    of the stretches of WIDE letters of its words (of GRAM in shorter words), by how many entries of its document have each. An entry that
    holds a word has all of its stretches, and within a run of letters and digits, as words are made of these."""
    at = ["doc_id", "seq", "_at"]
    held = lambda text: (F.size("_tokens") > 0) & F.forall("_tokens", lambda t: F.contains(F.col(text), t))
    rule = lambda met, name: met.filter("_at < seq").select(*at, F.lit(name).alias("_rule"))
    numbered = rule(asked.join(entries.drop("_tokens"), ["doc_id", "_note"]).filter(held("_named")), "note")
    hinted = asked.filter("_hint <> ''").select("doc_id", "seq", "_hint")
    exact = rule(hinted.join(entries.select("doc_id", "_at", F.col("_form").alias("_hint")), ["doc_id", "_hint"]), "exact_sf")
    defined = rule(hinted.join(entries.select("doc_id", "_at", F.explode("_defined").alias("_hint")), ["doc_id", "_hint"]), "bracket_definition")
    worded = asked.filter(F.size("_tokens") > 0).select("doc_id", "seq", "_tokens")
    wide = lambda c: F.when(F.length(c) >= WIDE, WIDE).otherwise(GRAM)
    cut = lambda c, w: F.transform(F.sequence(F.lit(1), F.length(c) - w + 1), lambda i: F.substring(c, i, w))
    grams = F.array_distinct(F.flatten(F.transform("_tokens", lambda t: cut(t, wide(t)))))
    own = materialize(worded.select("doc_id", "seq", F.explode(grams).alias("_gram")), "grams")
    widths = [r[0] for r in own.select(F.length("_gram")).distinct().collect()]  # GRAM, WIDE or both
    runs = F.array_distinct(F.regexp_extract_all("_named", F.lit("[a-z0-9]+"), F.lit(0)))
    pieces = lambda w: F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) >= w), lambda r: cut(r, F.lit(w))))
    places = F.concat(*map(pieces, widths)) if widths else F.array().cast("array<string>")
    index = entries.select("doc_id", "_at", F.explode(F.array_distinct(places)).alias("_gram"))
    index = materialize(index.join(own.select("doc_id", "_gram").distinct(), ["doc_id", "_gram"], "left_semi"), "places")
    counts = index.groupBy("doc_id", "_gram").agg(F.count(F.lit(1)).alias("_many"))
    # a reference with a stretch that no entry of its document has names none
    rarest = own.join(counts, ["doc_id", "_gram"], "left").groupBy("doc_id", "seq").agg(F.min(F.struct(F.coalesce("_many", F.lit(0)).alias("_many"), "_gram")).alias("_r")).filter("_r._many > 0").select("doc_id", "seq", "_r._gram")
    near = rarest.join(index, ["doc_id", "_gram"]).filter("_at < seq").select(*at)
    met = near.join(worded, ["doc_id", "seq"]).join(entries.select("doc_id", "_at", "_named", "_short"), ["doc_id", "_at"]).filter(held("_named"))
    named = met.select(*at, F.explode(F.array_compact(F.array(F.lit("token_verb"), F.when((F.col("_short") != "") & held("_short"), "token_sf")))).alias("_rule"))
    return numbered.unionByName(exact).unionByName(defined).unionByName(named)


def _decided(asked: DataFrame, met: DataFrame) -> DataFrame:
    """(doc_id, seq, link, method) of asked, by the entries met (doc_id, seq, _at, _rule, _link, _base, _usable) with their links."""
    usable_ = lambda name: F.col("_usable") & (F.col("_rule") == name)
    tiers = ("exact_sf", "token_sf", "token_verb")
    pools = [x for name in tiers for x in (F.min(F.when(usable_(name), F.col("_base"))).alias(f"_lo_{name}"), F.max(F.when(usable_(name), F.col("_base"))).alias(f"_hi_{name}"), F.min_by(F.when(usable_(name), F.col("_link")), F.when(usable_(name), F.col("_at"))).alias(f"_first_{name}"))]
    bracket = usable_("bracket_definition")
    found = met.groupBy("doc_id", "seq").agg(
        F.bool_or(F.col("_rule") == "note").alias("_has_note"), F.min_by(F.when(usable_("note"), F.col("_link")), F.when(usable_("note"), F.col("_at"))).alias("_noted"), *pools,
        (F.min(F.when(bracket, F.col("_base"))) == F.max(F.when(bracket, F.col("_base")))).alias("_one_defined"), F.max_by(F.when(bracket, F.col("_link")), F.when(bracket, F.col("_at"))).alias("_defined"))
    joined = asked.select("doc_id", "seq", ((F.col("_hint") == "") & (F.size("_tokens") == 0)).alias("_nothing")).join(found, ["doc_id", "seq"], "left")
    by_note, by_bracket = F.coalesce("_has_note", F.lit(False)), F.coalesce("_one_defined", F.lit(False))
    some = lambda name: F.col(f"_lo_{name}").isNotNull()
    pool = F.coalesce(*[F.when(some(name), F.lit(name)) for name in tiers])  # the first tier with any entry decides
    one = F.coalesce(*[F.when(some(name), F.col(f"_lo_{name}") == F.col(f"_hi_{name}")) for name in tiers], F.lit(False))
    first = F.coalesce(*[F.when(some(name), F.col(f"_first_{name}")) for name in tiers])
    link = F.when(by_note, F.col("_noted")).when(one, first).when(by_bracket, F.col("_defined"))
    method = (
        F.when(F.col("_nothing"), "abstain_no_hint").when(by_note & F.col("_noted").isNotNull(), "note_number").when(by_note, "abstain_unlinked_target").when(one, pool).when(by_bracket, "bracket_definition")
        .when(pool.isNotNull(), F.concat(F.lit("abstain_ambiguous_"), pool)).otherwise("abstain_no_match"))
    return joined.select("doc_id", "seq", link.alias("link"), method.alias("method"))


def resolve_supra(references: DataFrame, registry: DataFrame) -> DataFrame:
    """references (doc_id, seq, verbatim and others) with link and method; seq orders references and entries of a document, and only
    earlier entries count. Link is null where the evidence is not enough, and method says why.

    note_number: an entry of the named note whose name holds all words of the hint; if only an entry without a link does, the work
    is known and has no link: abstain_unlinked_target. Then exact_sf (the hint is an entry's short form), token_sf (all of its words
    are in one), token_verb (all are in the short form or the first 200 characters): the first of these with any entry decides, if all its
    entries lie in one document; abstain_ambiguous_<tier> otherwise. Last bracket_definition: a citation defines the hint in
    brackets. abstain_no_hint and abstain_no_match are left."""
    # dealt, as a table in few files would have its texts read by few tasks, here and in all that follows
    asked, entries = materialize(_asked(references.repartition("doc_id", "seq")), "supra"), materialize(_entries(registry.repartition("doc_id", "seq")), "registry")
    met = _meetings(asked, entries).join(entries.select("doc_id", "_at", "_link", "_base", "_usable"), ["doc_id", "_at"])
    return references.join(_decided(asked, met), ["doc_id", "seq"], "left")


def note_guard(proposed: DataFrame, registry: DataFrame) -> DataFrame:
    """proposed (doc_id, seq, verbatim, link) with allowed: false where the reference names a note, earlier entries within WINDOW notes
    of it have links, and none of them is this link's document. The window forgives wrong numbers by a few."""
    near = proposed.withColumn("_n", refs.supra_note(F.col("verbatim"))).filter("_n is not null").select("doc_id", "seq", base(F.col("link")).alias("_b"), F.explode(F.transform(F.sequence(F.col("_n") - WINDOW, F.col("_n") + WINDOW), lambda n: n.cast("string"))).alias("_note"))
    held = _entries(registry).filter("_usable").select("doc_id", "_at", "_note", "_base")
    veto = near.join(held, ["doc_id", "_note"]).filter("_at < seq").groupBy("doc_id", "seq").agg(F.bool_or(F.col("_b") == F.col("_base")).alias("_same"))
    return proposed.join(veto, ["doc_id", "seq"], "left").withColumn("allowed", F.coalesce("_same", F.lit(True))).drop("_same")


def fallback_links(references: DataFrame, registry: DataFrame) -> DataFrame:
    """references (doc_id, seq, verbatim) that the tiers gave nothing for, with link and method from two weaker rules: a bare number
    whose note holds one citation only (bare_note_unique_citation), or a name that is a short form inferred from earlier
    citations (registry has kind too), if these and the entries with that short form lie in one document (inferred_short_form:rule)."""
    asked = references.select("doc_id", "seq", F.regexp_extract("verbatim", "(?i)\\bsupra\\s+(?:note|n\\.?|nn\\.?)\\s+([0-9]+)\\b", 1).alias("_note"), shortforms.candidate_names(F.col("verbatim")).alias("_names"))
    citations = registry.filter(~F.coalesce(F.col("verbatim").rlike("(?i)\\b(?:supra|ibid)\\b"), F.lit(False))).select("doc_id", F.col("seq").alias("_at"), F.col("note").cast("string").alias("_note"), F.col("link").alias("_link"))
    bare = asked.filter((F.size("_names") == 0) & (F.col("_note") != "")).join(citations, ["doc_id", "_note"]).filter("_at < seq").groupBy("doc_id", "seq").agg(F.count(F.lit(1)).alias("_n"), F.min("_link").alias("_link"))
    bare = bare.filter((F.col("_n") == 1) & usable(F.col("_link"))).select("doc_id", "seq", F.col("_link").alias("link"), F.lit("bare_note_unique_citation").alias("method"))
    named = asked.select("doc_id", "seq", F.explode("_names").alias("_v")).select("doc_id", "seq", shortforms.form_key(F.col("_v")).alias("_key"))
    held = registry.filter(usable(F.col("link"))).select("doc_id", F.col("seq").alias("_at"), F.col("link").alias("_link"), F.regexp_replace(base(F.col("link")), "/$", "").alias("_base"), shortforms.form_key(F.col("short_form")).alias("_own"), shortforms.inferred_forms(F.col("verbatim"), F.col("kind")).alias("_forms"))
    own = held.filter("_own <> ''").select("doc_id", "_at", "_link", "_base", F.col("_own").alias("_key"), F.lit(None).cast("string").alias("_rule"))
    inferred = held.select("doc_id", "_at", "_link", "_base", F.explode("_forms").alias("_f")).select("doc_id", "_at", "_link", "_base", shortforms.form_key(F.col("_f.value")).alias("_key"), F.col("_f.rule").alias("_rule"))
    met = named.join(own.unionByName(inferred), ["doc_id", "_key"]).filter("_at < seq").groupBy("doc_id", "seq").agg(F.count_distinct("_base").alias("_n"), F.max(F.when(F.col("_rule").isNotNull(), F.struct("_at", "_rule", "_link"))).alias("_last"))
    chosen = met.filter("_n = 1 and _last is not null").select("doc_id", "seq", F.col("_last._link").alias("link"), F.concat(F.lit("inferred_short_form:"), F.col("_last._rule")).alias("method"))
    return references.join(bare.unionByName(chosen), ["doc_id", "seq"], "left")


def candidates(references: DataFrame, registry: DataFrame, proposition: str | None = None) -> DataFrame:
    """(doc_id, seq, rank, link, score): up to BEST earlier entries that a chooser is shown for a reference. Score: twice the
    words that hint (or, without one, the whole reference) and entry share, the words that proposition and entry share where the
    reference names nothing, 20 more for the exact short form; entries without a point only where none has any."""
    tokens = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(shortforms.reference_text(c), F.lit("[a-z][a-z'’-]+"), F.lit(0)), lambda t: ~t.isin(*_STOP)))
    said = shortforms.hint(F.col("verbatim"))
    own = tokens(said)
    about = tokens(F.col(proposition)) if proposition else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    asked = references.select("doc_id", "seq", shortforms.bare_form(said).alias("_hint"), F.when(F.size(own) > 0, own).otherwise(tokens(F.col("verbatim"))).alias("_q"), F.when(F.size(own) > 0, none).otherwise(about).alias("_p"))
    asked = asked.withColumn("_deal", F.pmod(F.xxhash64("seq"), F.lit(_DEALT)).cast("int"))
    held = registry.select("doc_id", F.col("seq").alias("_at"), "link", base(F.col("link")).alias("_base"), shortforms.bare_form(F.col("short_form")).alias("_form"), F.array_union(tokens(F.col("short_form")), tokens(F.substring("verbatim", 1, 160))).alias("_e"))
    spread = held.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(_DEALT - 1))))
    met = asked.join(spread, ["doc_id", "_deal"]).filter("_at < seq")
    score = 2 * F.size(F.array_intersect("_q", "_e")) + F.size(F.array_intersect("_p", "_e")) + F.when((F.col("_hint") != "") & (F.col("_hint") == F.col("_form")), 20).otherwise(0)
    once = met.withColumn("score", score).groupBy("doc_id", "seq", "_form", "_base").agg(F.min(F.struct("_at", "link", "score")).alias("_first")).select("doc_id", "seq", "_first.*")
    w = Window.partitionBy("doc_id", "seq")
    ranked = once.withColumn("_top", F.max("score").over(w)).filter("score > 0 or _top = 0").withColumn("rank", F.row_number().over(w.orderBy(F.col("score").desc(), "_at")))
    return ranked.filter(F.col("rank") <= BEST).select("doc_id", "seq", "rank", "link", "score")


def reference_links(parts: DataFrame, rounds: int = 20, choices: DataFrame | None = None) -> DataFrame:
    """parts (doc_id, seq, note, verbatim, short_form, link and others) with link and method of references filled in: supras from the
    entries before them, ibids from the part before them, each moved to the reference's own pinpoint. Citations keep their links.

    The result is that of going through a document in order, where a reference that gets a link is an entry for later ones. Which entries a
    reference names depends on their texts, and is found once. Then rounds follow, in which references are decided again if the
    link of an entry that they name is new or another than before, until none changes; references point backwards only, so
    this ends. A chain of references that only name each other takes a round a link; more than `rounds` are an error.

    choices (doc_id, seq, rank) are picks by someone else among the candidates of references without a link: they are taken (chosen) if
    note_guard allows, else noted (choice_rejected), and the rounds go on with them."""
    ibid = refs.is_ibid(F.col("verbatim")) & refs.supra_note(F.col("verbatim")).isNull()
    kinds = F.when(ibid, "ibid").when(F.col("verbatim").rlike("(?i)\\bsupra\\b"), "supra").otherwise("own")
    own = ["doc_id", "seq", "note", "verbatim", "short_form"]
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    kinded = parts.select(*own, kinds.alias("_kind"), F.when(kinds == "own", F.col("link")).alias("_given"))
    # a run of ibids has the link of what stands before it, a link that is null included
    known = materialize(kinded.withColumn("_from", F.last(F.when(F.col("_kind") != "ibid", F.col("seq")), ignorenulls=True).over(before)), "parts")
    asked = materialize(_asked(known.filter("_kind = 'supra'")), "supra")
    met = materialize(_meetings(asked, materialize(_entries(known.withColumn("link", F.lit(None).cast("string"))), "registry")), "meetings")
    texts = known.select("doc_id", "seq", "verbatim", "_from")
    now = materialize(known.select("doc_id", "seq", "_kind", F.col("_given").alias("link"), F.lit(None).cast("string").alias("method")), "links")

    def settled(now: DataFrame, new: DataFrame | None) -> DataFrame:
        """Links once no round changes any; new: (doc_id, seq) of those that changed last, none for all."""
        for done in range(rounds + 1):
            named = met if new is None else met.join(new.select("doc_id", F.col("seq").alias("_at")), ["doc_id", "_at"], "left_semi")
            due = asked if new is None else asked.join(named.select("doc_id", "seq").distinct(), ["doc_id", "seq"], "left_semi")
            entries = now.select("doc_id", F.col("seq").alias("_at"), F.col("link").alias("_link"), base(F.col("link")).alias("_base"), usable(F.col("link")).alias("_usable"))
            supra = _decided(due, met.join(entries, ["doc_id", "_at"]))
            origin = now.select("doc_id", F.col("seq").alias("_from"), F.col("link").alias("_link"))
            origin = origin if new is None else origin.join(new.select("doc_id", F.col("seq").alias("_from")), ["doc_id", "_from"], "left_semi")
            after = now.filter("_kind = 'ibid'").select("doc_id", "seq").join(texts, ["doc_id", "seq"]).join(origin, ["doc_id", "_from"])
            has = usable(F.col("_link"))  # what had a link before may have none now
            previous = after.select("doc_id", "seq", F.when(has, anchored_link(F.col("_link"), F.col("verbatim"), F.lit(True))).alias("link"), F.when(has, "previous").alias("method"))
            pinned = supra.join(texts, ["doc_id", "seq"]).select("doc_id", "seq", anchored_link(F.col("link"), F.col("verbatim"), F.lit(False)).alias("link"), "method")
            found = pinned.unionByName(previous).select("doc_id", "seq", F.col("link").alias("_l"), F.col("method").alias("_m"), F.lit(True).alias("_hit"))
            picked = F.coalesce(F.col("method").isin("chosen", "choice_rejected"), F.lit(False)) & F.col("_l").isNull()  # a pick stays where nothing better comes
            joined = now.join(found, ["doc_id", "seq"], "left").withColumn("_got", F.coalesce("_hit", F.lit(False)) & ~picked)
            after = joined.select("doc_id", "seq", "_kind", F.when(F.col("_got"), F.col("_l")).otherwise(F.col("link")).alias("link"), F.when(F.col("_got"), F.col("_m")).otherwise(F.col("method")).alias("method"), (F.col("_got") & ~F.col("_l").eqNullSafe(F.col("link"))).alias("_changed"))
            after = materialize(after, "links")
            new, now = after.filter("_changed").select("doc_id", "seq"), after.drop("_changed")
            if new.isEmpty():
                return now
        raise RuntimeError(f"links are not final after {rounds} rounds")

    now = settled(now, None)
    if choices is not None:
        entries = known.select(*own).join(now.select("doc_id", "seq", "link"), ["doc_id", "seq"])
        open_ = known.join(now.filter("_kind = 'supra' and link is null").select("doc_id", "seq"), ["doc_id", "seq"], "left_semi").join(choices.select("doc_id", "seq").distinct(), ["doc_id", "seq"], "left_semi").select("doc_id", "seq", "verbatim")
        picked = candidates(open_, entries.filter(usable(F.col("link")))).join(choices.select("doc_id", "seq", "rank"), ["doc_id", "seq", "rank"]).select("doc_id", "seq", "link")
        guarded = note_guard(open_.join(picked, ["doc_id", "seq"]), entries)
        taken = materialize(guarded.select("doc_id", "seq", F.when(F.col("allowed"), anchored_link(F.col("link"), F.col("verbatim"), F.lit(False))).alias("_l"), F.when(F.col("allowed"), "chosen").otherwise("choice_rejected").alias("_m")), "chosen")
        now = materialize(now.join(taken, ["doc_id", "seq"], "left").select("doc_id", "seq", "_kind", F.coalesce("_l", "link").alias("link"), F.coalesce("_m", "method").alias("method")), "links")
        now = settled(now, taken.filter("_l is not null").select("doc_id", "seq"))
    return parts.drop("link", "method").join(now.select("doc_id", "seq", "link", "method"), ["doc_id", "seq"])
