"""Footnotes into citation parts, with the fields of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import references
from marginalia.functions.shortforms import hint, surnames
from marginalia.functions.text import replace_all
from marginalia.operators import boundaries as b

#: Fixed: words that announce a source of its own, and what may stand in brackets at a citation's end without being its short form.
SIGNALS = ("see also", "see", "cf", "contra", "but see", "accord", "citing", "quoting", "compare")
_SIGNAL = "|".join(sorted(SIGNALS, key=len, reverse=True))
_PREFIX = "(?i)^\\s*(?:(?:but\\s+)?see(?:,?\\s+e\\.?g\\.?,?|\\s+also|\\s+generally)?|contra|compare|cf\\.?|citing|quoting|discussing|discussed\\s+in|applying|and|or)\\s*[:,.]?\\s+"
_FORM = "\\s*\\[([^\\[\\]]{2,60})\\]\\s*\\.?\\s*$"
_EDITORIAL = "(?i)^(?:sic|emphasis|citation|citations|footnote|footnotes|translated|translation|ellipsis|omitted)"
_ITEM = "[0-9]+(?:\\.[0-9]+)*(?:\\s*\\([A-Za-z0-9]+\\))*(?:\\s*[-–]\\s*[0-9]+(?:\\.[0-9]+)*(?:\\s*\\([A-Za-z0-9]+\\))*)?"
_ITEMS = f"{_ITEM}(?:\\s*(?:,\\s*(?:and|&)?\\s*|\\s+(?:and|&)\\s+)\\s*{_ITEM})*"
_EMBEDDED = "(?i:\\.\\s*(?:see(?:\\s+also|\\s+generally)?|cf\\.?|compare)|\\b(?:citing|quoted?\\s+in|quoting|discuss(?:ed|ing)\\s+in)\\b)"
LAWS = ("statute", "regulation", "legislation")


def without_signals(column: Column) -> Column:
    """A citation without up to three signals before it."""
    for _ in range(3):
        column = F.trim(F.regexp_replace(F.trim(column), _PREFIX, ""))
    return column


def kind(column: Column, anchors: Column) -> Column:
    """What a part cites, by the first rule that holds: references are other; then books and essays in them, articles, statutes, cases;
    regulations and websites by their wording."""
    quoted = column.rlike("[\"“]")
    return (
        F.when(column.rlike(b.REFERENCE), "other").when(column.rlike(b.BOOK) & column.rlike("(?s)[\"“].+?[\"”]\\s+in\\b"), "essay_collection").when(column.rlike(b.BOOK), "book")
        .when(column.rlike(b.JOURNAL) & quoted, "journal").when(F.array_contains(anchors, "statute"), "statute").when(F.array_contains(anchors, "neutral") | F.array_contains(anchors, "reporter"), "case")
        .when(F.array_contains(anchors, "journal"), "journal").when(column.rlike("\\b(?:Reg|SOR|DORS)[ /]"), "regulation").when(column.rlike("(?i)\\bGaz(?:ette)?\\b"), "gazette")
        .when(column.rlike("\\bv\\.? .*\\(unreported\\)"), "unreported").when(F.array_contains(anchors, "url"), "website").otherwise("other"))


def short_form(column: Column, kinds: Column | None = None) -> Column:
    """A bracketed name at the end of the citation, unless it is digits or an editor's note; 'Ibid'; the name before supra; the
    authors' surnames for articles, books, essays and reports; else empty."""
    bracket = F.trim(F.regexp_extract(column, _FORM, 1))
    named = (bracket != "") & ~bracket.rlike("^[0-9]+$") & ~bracket.rlike(_EDITORIAL)
    supra = replace_all(F.regexp_extract(without_signals(column), "(?is)^(.*?)\\bsupra\\b", 1), ("^[ ,;:.]+|[ ,;:.]+$", ""))
    before = F.when(column.rlike("[\"“]"), F.regexp_extract(column, "(?s)^([^\"“]*)", 1)).otherwise(F.split_part(column, F.lit(","), F.lit(1)))
    authors = F.array_join(surnames(F.regexp_replace(without_signals(F.regexp_replace(F.trim(before), "(?s)^.*:|[ ,]+$", "")), "\\s*,\\s*", " and ")), " and ")
    secondary = kinds.isin("journal", "book", "essay_collection", "report") if kinds is not None else F.lit(False)
    return F.when(named, bracket).when(references.is_ibid(column), "Ibid").when(column.rlike("(?i)\\bsupra\\b"), supra).when(secondary, authors).otherwise("")


def bare_citation(column: Column, kinds: Column | None = None) -> Column:
    """The citation proper: from the first neutral or reporter's citation of a case, a statute's series, or an article's year on, without the
    short form behind it; references and others whole."""
    kinds = F.lit("case") if kinds is None else kinds
    value = F.trim(F.regexp_replace(F.trim(F.regexp_replace(column, _FORM, "")), "\\.+$", ""))
    behind = lambda p: F.nullif(F.regexp_extract(value, f"(?s)((?:{p}).*)$", 1), F.lit(""))
    case, law, article = behind(f"{b.NEUTRAL}|{b.REPORTER}"), behind(b.STATUTE), behind(b.JOURNAL)
    found = F.when(kinds == "case", case).when(kinds == "statute", law).when(kinds == "journal", article)
    return F.when(value.rlike("(?i)\\b(?:supra|ibid)\\b"), value).otherwise(F.coalesce(found, value))


def lookup_citation(styled: Column, kinds: Column) -> Column:
    """The citation to look up, of a styled one: without signals, short forms, pinpoints, judges in parentheses, and what follows it in
    the sentence."""
    plain = bare_citation(without_signals(styled), kinds)
    return F.trim(replace_all(plain, (f"(?i)[ ,]+(?:at\\s+)?(?:paras?|paragraphs?|pp?|pages?|ss?|sections?|arts?)\\.?\\s*{_ITEMS}.*$", ""), (f"(?i)[ ,]+at\\s+{_ITEMS}.*$", ""), ("\\s*\\([^()]*\\b(?:J|JJ|JA|CJ|CJC|dissenting|concurring)\\b[^()]*\\).*$", ""), ("\\s*\\[[^\\[\\]]{2,60}\\]\\s*$", ""), ("[ ,;.]+$", "")))


def _values(column: Column, label: str) -> Column:
    """The items of the list behind the label's first occurrence; null without one."""
    listed = F.regexp_extract(column, f"(?i){label}\\s*({_ITEMS})", 1)
    return F.when(listed != "", F.split(listed, "\\s*(?:,\\s*(?:and\\s+)?|\\band\\b|&)\\s*"))


def provision_values(items: Column) -> Column:
    """Sections and rules as they are named: 11(1), 7-2 and 672.54 keep brackets, dashes and dots."""
    return F.transform(items, lambda x: F.translate(F.regexp_replace(F.regexp_extract(x, "[0-9]+(?:\\.[0-9]+)*(?:\\s*\\([A-Za-z0-9]+\\))*(?:\\s*[-–]\\s*[0-9]+(?:\\.[0-9]+)*)?", 0), "\\s+", ""), "–", "-"))


def pinpoints(column: Column, kinds: Column) -> tuple[Column, Column]:
    """(fragments, pages): paragraphs of cases, provisions of laws, of what is not known either, and pages of all but laws; the
    first of these that is there is taken."""
    case, law, unknown = kinds.isin("case", "unreported"), kinds.isin(*LAWS), kinds.isin("", "other")
    par = F.when(case | unknown, _values(column, "(?:\\bparas?(?:graphs?)?\\.?|¶)"))
    first = F.transform(par, lambda x: F.concat(F.lit("par"), F.regexp_extract(x, "[0-9]+(?:\\.[0-9]+)?", 0)))
    sec = F.when(law | unknown, provision_values(_values(F.regexp_replace(column, b.REPORTER, "·"), "\\b(?:ss?\\.?|(?:sub)?sections?|rules?|rr?\\.?|articles?|arts?\\.?)")))
    page = F.when(~law, _values(column, "\\bat\\s+(?:(?:pp?\\.?|pages?)\\s+)?"))

    def spread(x: Column) -> Column:
        n = F.regexp_extract_all(x, F.lit("([0-9]+(?:\\.[0-9]+)?)"), F.lit(1))
        a, z = F.get(n, F.lit(0)).try_cast("long"), F.get(n, F.lit(1)).try_cast("long")
        end = references.range_end(a, z)
        return F.when(a.isNull(), F.array().cast("array<bigint>")).when((end > a) & (end - a <= 100), F.sequence(a, end)).otherwise(F.array(a))

    none, no_pages = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    fragments = F.coalesce(first, F.transform(sec, lambda x: F.concat(F.lit("sec"), x)), none)
    return fragments, F.when(F.size(fragments) > 0, no_pages).otherwise(F.coalesce(F.flatten(F.transform(page, spread)), no_pages))


def embedded_source(column: Column) -> Column:
    """Whether a second source is cited within a part: a signal behind its third character, and a reference or an anchor within the 320
    characters behind that."""
    anchor = "|".join(f"(?:{p})" for k, p in b.ANCHORS.items() if k != "url")
    tails = F.regexp_extract_all(F.substring(column, F.lit(4), F.length(column)), F.lit(f"(?s){_EMBEDDED}(?=(.{{0,320}}))"), F.lit(1))
    return F.exists(tails, lambda t: t.rlike(f"(?i:\\b(?:supra|ibid)\\b)|{anchor}"))


def fields(parts: DataFrame) -> DataFrame:
    """parts (verbatim, anchors and others) with kind, link ('other' without one), fragments, pages, bare_citation, citation_with_style,
    short_form, reasons and status: complete, or partial for the reasons named."""
    c = F.col("verbatim")
    known = parts.withColumn("kind", kind(c, F.col("anchors"))).withColumn("citation_with_style", without_signals(c))
    styled, kinds = F.col("citation_with_style"), F.col("kind")
    found, pages = pinpoints(styled, kinds)
    url = F.regexp_replace(F.regexp_extract(c, f"({b.URL})", 1), "^[<>.,; ]+|[<>.,; ]+$", "")
    known = known.withColumns({"link": F.when(url != "", url).otherwise("other"), "fragments": F.array_distinct(found), "pages": pages, "bare_citation": F.when(styled != "", bare_citation(styled, kinds)).otherwise(""), "short_form": short_form(styled, kinds)})
    reasons = F.array_compact(F.array(F.when(embedded_source(styled), "embedded_second_source"), F.when(styled == "", "missing_citation_surface"), F.when(F.col("bare_citation") == "", "missing_bare_citation")))
    return known.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") > 0, "partial").otherwise("complete"))


def pure_reference(column: Column) -> Column:
    """Whether a note of up to 400 characters is nothing but up to four ibid and supra references with pinpoints."""
    clause = f"(?i)^\\s*(?:(?:{_SIGNAL})[,.]?\\s+)?(?:ibid|[\\p{{L}}'’&. -]{{0,80}},? ?supra,? ?n(?:ote|n)?\\.? ?[0-9]+)(?:[ ,]+(?:at\\s+)?(?:paras?|pp?|ss?)?\\.? ?[0-9][0-9–, -]*)?\\.?\\s*$"
    clauses = F.split(column, ";")
    return (F.length(column) <= 400) & (F.size(clauses) <= 4) & F.forall(clauses, lambda c: c.rlike(clause))


def split_notes(notes: DataFrame) -> DataFrame:
    """notes (doc_id, footnote_id, text) as parts: doc_id, footnote_id, part_index (from 1), start, end, verbatim and the fields of
    each. Notes are cut where recall_parts cuts them, so that none of their text is lost."""
    cut = b.recall_parts(notes.select("doc_id", "footnote_id", "text")).drop("text")
    c = F.col("verbatim")
    return fields(cut).withColumns({"is_ibid": references.is_ibid(c), "supra_note": references.supra_note(c)})


def targets(split: DataFrame) -> DataFrame:
    """split with part (doc/note/index) and target: the part a reference points to. Supra is asked before ibid; a supra points to the
    part of its note that fits the hint best (short form in brackets or as a field, whole words, letters), by its last word else,
    else to its first with a warning; an ibid to the part before it."""
    from pyspark.sql import Window

    key = lambda n, i: F.concat_ws("/", F.col("doc_id").cast("string"), n.cast("string"), i.cast("string"))
    named = split.withColumn("part", key(F.col("footnote_id"), F.col("part_index"))).withColumn("_hint", F.lower(hint(F.col("verbatim"))))
    asked = named.filter("supra_note is not null").select("part", "doc_id", "_hint", F.col("supra_note").alias("_n"))
    held = split.select("doc_id", F.col("footnote_id").alias("_n"), F.col("part_index").alias("_pi"), F.lower("short_form").alias("_sf"), F.lower("verbatim").alias("_v"))
    whole = lambda t: F.concat(F.lit(" "), F.regexp_replace(t, "[^\\p{L}\\p{N}_]+", " "), F.lit(" "))

    def points(token: Column) -> Column:
        text, form = F.col("_v"), F.col("_sf")
        exact = F.contains(text, F.concat(F.lit("["), token, F.lit("]"))) | (form == token)
        return F.when(token == "", 0).when(exact, 4).when(F.contains(whole(text), whole(token)), 2).when(F.contains(text, token), 1).otherwise(0)

    # the whole hint decides where any part has it, else its last word, else the first part
    ranked = F.struct(points(F.col("_hint")).alias("a"), points(F.element_at(F.split("_hint", " "), -1)).alias("b"), (-F.col("_pi")).alias("i"))
    best = asked.join(held, ["doc_id", "_n"], "left").groupBy("part", "doc_id", "_n").agg(F.max_by("_pi", ranked).alias("_pi"), F.count("_pi").alias("_many"), F.max(F.struct(points(F.col("_hint")), points(F.element_at(F.split("_hint", " "), -1)))).alias("_best"), F.first("_hint").alias("_h"))
    guessed = (F.col("_many") > 1) & (F.col("_best.col1") == 0) & (F.col("_best.col2") == 0)
    warning = F.when(F.col("_many") == 0, "supra note is not in this document").when(guessed & (F.col("_h") == ""), "supra note has several citations and the reference names none: the first is taken").when(guessed, "the name fits no citation of the supra note: the first is taken")
    supra = best.select("part", key(F.col("_n"), F.coalesce("_pi", F.lit(1))).alias("_supra"), warning.alias("warning"))
    before = F.lag("part").over(Window.partitionBy("doc_id").orderBy("footnote_id", "part_index"))
    return named.drop("_hint").join(supra, "part", "left").withColumn("target", F.coalesce("_supra", F.when(F.col("is_ibid"), before))).drop("_supra")
