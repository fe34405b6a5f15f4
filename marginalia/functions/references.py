"""Short references in citations: ibid, supra note N, pinpoints, id lists, kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import replace_all

_SUPRA = ("(?i)supra,?\\s+note\\s+([0-9]+)", "(?i)supra,?\\s+n\\.?\\s*([0-9]+)", "(?i)supra,?\\s+nn\\.?\\s*([0-9]+)")
_DASH = "[-–—]"


def is_ibid(column: Column) -> Column:
    return column.rlike("(?i)\\bibid\\b")


def supra_note(column: Column) -> Column:
    """The note that a supra reference names; the first form that occurs decides, not the leftmost."""
    found = [F.try_element_at(F.regexp_extract_all(column, F.lit(p), F.lit(1)), F.lit(1)) for p in _SUPRA]
    return F.coalesce(*found).cast("int")


def supra_notes(column: Column) -> Column:
    """All notes that supra references name, ascending."""
    found = F.flatten(F.array(*[F.regexp_extract_all(column, F.lit(p), F.lit(1)) for p in _SUPRA]))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def supra_hint(column: Column) -> Column:
    """The name before supra, without signals; empty if there is none."""
    before = F.regexp_extract(column, "(?i)^(.*?)[ ,]*\\bsupra\\b", 1)
    return F.trim(replace_all(before, ("(?i)^\\s*(?:see also|see|cf|contra|but see|accord)[,.]?\\s+", ""), ("[ ,;:]+$", "")))


def id_list(column: Column) -> Column:
    """Ids of a list such as '1,3,30-35': ranges either way round, what is neither number nor range ignored, ascending."""
    items = F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), "[,; ]+"), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]{1,9}(-[0-9]{1,9})?$"))

    def spread(x: Column) -> Column:
        a = F.regexp_extract(x, "^[0-9]+", 0).cast("int")
        b = F.regexp_extract(x, "[0-9]+$", 0).cast("int")
        return F.sequence(F.least(a, b), F.greatest(a, b))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(items, spread))))


def range_end(first: Column, last: Column) -> Column:
    """The end of an abbreviated range: 763-64 ends at 764. An end that is no smaller than the start stands for itself."""
    size = F.pow(F.lit(10), F.length(last.cast("string"))).cast("long")
    full = first - F.pmod(first, size) + last
    return F.when(last >= first, last).otherwise(F.when(full >= first, full).otherwise(full + size))


def page_pinpoints(column: Column, most: int = 100) -> Column:
    """Pages after 'at' or 'p': ranges are spread, abbreviated ends filled in, ranges of more than most pages kept as their start."""
    found = F.regexp_extract_all(column, F.lit("(?i)(?:\\bat|\\bpp?\\.?)\\s+([0-9]+(?:\\s*[-–—,]\\s*[0-9]+)*)"), F.lit(1))
    items = F.flatten(F.transform(found, lambda x: F.split(F.regexp_replace(x, "\\s", ""), ",")))

    def spread(x: Column) -> Column:
        a, b = F.split(x, _DASH)[0].cast("long"), F.try_element_at(F.split(x, _DASH), F.lit(2)).cast("long")
        end = F.coalesce(range_end(a, b), a)
        return F.when(end - a > most, F.array(a)).otherwise(F.sequence(a, end))

    return F.array_distinct(F.flatten(F.transform(items, spread)))


def fragments(column: Column) -> Column:
    """Paragraph and section pinpoints as parN and secN, in the order of their kind and place."""
    label = lambda pattern, name: F.transform(F.regexp_extract_all(column, F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit(name), x))
    par = label("(?i)\\bpara(?:graph)?s?\\.?\\s*([0-9]+)", "par")
    sec = label("(?i)\\b(?:ss?|sections?)\\.?\\s+([0-9]+(?:\\.[0-9]+)*)", "sec")
    return F.array_distinct(F.concat(par, sec))


def guarded_fragments(kind: Column, found: Column) -> Column:
    """Sections are for statutes, regulations and legislation, paragraphs for what is neither these nor a gazette."""
    law, gazette = kind.isin("statute", "regulation", "legislation"), kind == "gazette"
    return F.filter(found, lambda x: F.when(x.startswith("sec"), law).otherwise(~law & ~gazette))


def neutral_citation(column: Column) -> Column:
    return F.regexp_extract(column, "\\b((?:17|18|19|20)[0-9]{2} [A-Z][A-Z0-9-]{1,15} [0-9]+)\\b", 1)


def kind(column: Column) -> Column:
    """What a citation cites: the first rule that holds decides."""
    return (
        F.when(neutral_citation(column) != "", "case").when(column.rlike("\\[[0-9]{4}\\] [0-9]+ [A-Z]|\\b v\\.? "), "case")
        .when(column.rlike("\\b[RS]S[A-Z]{0,3} [0-9]{4}, ?c\\.? ?|\\bAct\\b"), "statute").when(column.rlike("\\b(?:Reg|SOR|DORS)[ /]"), "regulation")
        .when(column.rlike("[“\"][^”\"]+[”\"].*\\([0-9]{4}\\)"), "journal").when(column.rlike("https?://"), "website").otherwise("other"))


def url_citation(url: Column) -> Column:
    """'2023 SCC 17' of a url with /2023scc17/ in its path; empty otherwise."""
    part = lambda i: F.regexp_extract(url, "/([0-9]{4})([a-z]+)([0-9]+)(?:/|\\.html|$)", i)
    return F.when(part(1) == "", "").otherwise(F.concat_ws(" ", part(1), F.upper(part(2)), part(3)))


def page_link(url: Column, page: Column, first: Column, mapped: Column) -> Column:
    """url with #page=: the mapped page, else page - first + 1; pages before the first give the bare url."""
    n = F.coalesce(mapped, page - first + 1)
    return F.when(n >= 1, F.concat(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("#page="), n.cast("string"))).otherwise(F.split_part(url, F.lit("#"), F.lit(1)))


def repaired_sections(found: Column, text: Column) -> Column:
    """Section fragments with the decimals that the text gives them: sec672 becomes sec672.54 if that is the only decimal section of
    that number in the text; all others stay."""
    named = F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)\\b(?:ss?|sections?)\\.?\\s*([0-9]+\\.[0-9]+)"), F.lit(1)))

    def one(x: Column) -> Column:
        under = F.filter(named, lambda n: F.concat(F.lit("sec"), F.split_part(n, F.lit("."), F.lit(1))) == x)
        return F.when(x.rlike("^sec[0-9]+$") & (F.size(under) == 1), F.concat(F.lit("sec"), F.get(under, F.lit(0)))).otherwise(x)

    return F.transform(found, one)
