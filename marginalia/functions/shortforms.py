"""Names by which later notes refer to a source: hints of supra references, and short forms that follow from a citation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import replace_all

#: Fixed: words that name nothing in a hint, signals before a citation, what brackets may hold besides a short form, kinds of sources
#: that are known by their authors, and words that are no surnames.
HINT_STOP = ("see", "also", "but", "and", "the", "note", "supra", "ibid", "generally", "contra", "compare", "with", "above", "e.g", "eg")
_SIGNAL = "(?i)^\\s*(?:see(?:,?\\s+e\\.?g\\.?,?)?(?:\\s+also)?|but\\s+see|contra|compare|cf\\.?|see\\s+generally)\\s+"
_NO_FORM = "(?i)^(?:[0-9]{4}|sic|emphasis|citation|footnote|translated|translation)"
_NO_DEFINITION = "(?i)^(?:sic|emphasis (?:added|in original)|citations? omitted|footnotes? omitted|translated by.*|translation|italics.*|underline.*|ellipsis.*|[0-9]+)$"
SECONDARY = ("journal", "book", "essay_collection", "report", "article", "website", "news")
_NO_NAMES = ("et", "al", "eds", "ed", "kc", "qc")
#: Where a case's citation begins behind its style of cause, and the titles of laws.
_CASE_CITE = "(?i)(?:\\[[0-9]{4}\\]|\\b(?:18|19|20)[0-9]{2}\\s+[A-Z][A-Za-z.]{1,12}\\s+[0-9]+|\\b[0-9]+\\s+(?:SCR|DLR|US|F\\.?\\s*[0-9]*d?)\\s+[0-9]+)"
_LAW_TITLE = (
    "\\b([A-Z][A-Za-z'’\\-]*(?:\\s+(?:of|the|and|de|la|du|des|[A-Z][A-Za-z'’\\-]*)){0,12}\\s+"
    "(?:Act|Code|Regulations?|Charter|Constitution|Rules?|Loi|Règlement|Charte))\\b")
_FORM = "struct<value: string, rule: string>"


def reference_text(column: Column) -> Column:
    """A citation as references compare it: white space collapsed, marks and dashes unified, lower case."""
    flat = F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), "\\s+", " "))
    return F.lower(F.translate(flat, "‘’“”–—", "''\"\"--"))


def bare_form(column: Column) -> Column:
    """reference_text without brackets around it."""
    return F.regexp_replace(reference_text(column), "^[\\[\\]() ]+|[\\[\\]() ]+$", "")


def form_key(column: Column) -> Column:
    """A short form by its letters and digits alone."""
    return F.lower(F.regexp_replace(F.coalesce(column, F.lit("")), "[^\\p{L}\\p{N}_]", ""))


def hint(column: Column) -> Column:
    """The name that a supra reference gives: what stands before ', supra note N' at the beginning, else anywhere; else, where no
    number follows supra, the last 80 characters before it. Signals are left out; empty if there is no name."""
    plain = F.regexp_replace(F.coalesce(column, F.lit("")), "(?i)^\\s*(?:see\\s+also\\s+|see\\s+|cf\\.?\\s+|but\\s+see\\s+|contra\\s+|e\\.g\\.,\\s+|eg\\.,\\s+|i\\.e\\.,\\s+|ie\\.,\\s+)", "")
    form = "([^,;]+?)\\s*,\\s*supra\\s+(?:note|n\\.|nn\\.)\\s+[0-9]+\\b"
    clean = lambda c: F.trim(F.regexp_replace(replace_all(c, ("^[\\s(\\[{\"'“”]+", ""), ("[\\s)\\]}\"'“”]+$", "")), "\\s+", " "))
    first = clean(F.regexp_extract(plain, f"(?i)^\\s*{form}", 1))
    anywhere = clean(F.regexp_extract(F.coalesce(column, F.lit("")), f"(?i){form}", 1))
    before = replace_all(F.regexp_extract(F.coalesce(column, F.lit("")), "(?is)^(.*?)\\bsupra\\b", 1), (_SIGNAL, ""), (_SIGNAL, ""), ("^[ ,;:.]+|[ ,;:.]+$", ""))
    return F.when(first != "", first).when(anywhere.rlike("[A-Za-z]"), anywhere).otherwise(F.substring(before, -80, 80))


def hint_tokens(hinted: Column) -> Column:
    """The words of a hint, of three letters or digits and more, that name something."""
    return F.filter(F.split(bare_form(hinted), "[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~t.isin(*HINT_STOP))


def definitions(column: Column) -> Column:
    """Short forms that a citation defines in brackets, in reference form: [Brown; hereinafter Browne] defines two."""
    held = F.filter(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit("\\[([^\\[\\]]{2,60})\\]"), F.lit(1)), lambda b: ~F.trim(b).rlike(_NO_DEFINITION))
    pieces = F.flatten(F.transform(held, lambda b: F.split(b, ";")))
    return F.array_distinct(F.transform(pieces, lambda p: bare_form(F.regexp_replace(p, "(?i)^\\s*hereinafter\\s+", ""))))


def surnames(prefix: Column) -> Column:
    """The last word of each author's name, authors being joined by 'and' or '&'."""
    def last(name: Column) -> Column:
        words = F.filter(F.regexp_extract_all(name, F.lit("[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ'’.\\-]*"), F.lit(0)), lambda w: ~F.lower(F.regexp_replace(w, "\\.$", "")).isin(*_NO_NAMES))
        return F.regexp_replace(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")), "^\\.+|\\.+$", "")

    return F.filter(F.transform(F.split(prefix, "(?i)\\s*(?:&|\\band\\b)\\s*"), last), lambda n: n != "")


def author_form(names: Column) -> Column:
    """'Roe', 'Roe, Doe' or 'Roe, Doe & Poe'; empty for nobody."""
    n = F.size(names)
    return F.when(n == 0, "").when(n <= 2, F.array_join(names, ", ")).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(" & "), F.element_at(names, -1)))


def _once(forms: Column) -> Column:
    """Forms that are not empty, the first of each key."""
    some = F.filter(forms, lambda f: form_key(f["value"]) != "")
    keys = F.transform(some, lambda f: form_key(f["value"]))
    return F.filter(some, lambda f, i: F.array_position(keys, form_key(f["value"])) == i + 1)


def _form(value: Column, rule: str) -> Column:
    return F.struct(F.coalesce(value, F.lit("")).alias("value"), F.lit(rule).alias("rule"))


def inferred_forms(column: Column, kind: Column) -> Column:
    """[(value, rule)] of short forms that a citation suggests where its author defines none: a case's style and parties (not the
    Crown), a law's title and the initials of one of three words and more, or the authors' surnames. None for references."""
    text = F.coalesce(column, F.lit(""))
    clean = F.trim(F.regexp_replace(F.trim(text), _SIGNAL, ""))
    none = F.array().cast(f"array<{_FORM}>")
    explicit = F.exists(F.regexp_extract_all(text, F.lit("\\[([^\\[\\]]{2,60})\\]"), F.lit(1)), lambda b: b.rlike("[A-Za-z]") & ~F.trim(b).rlike(_NO_FORM))
    style = F.regexp_replace(F.when(clean.rlike(_CASE_CITE), F.regexp_extract(clean, f"(?s)^(.*?){_CASE_CITE}", 1)).otherwise(F.trim(F.split_part(clean, F.lit(","), F.lit(1)))), "[ ,.;]+$", "")
    side = lambda i: F.trim(F.regexp_extract(style, "(?i)^(.+?)\\s+[vc]\\.?\\s+(.+)$", i))
    crown = side(1).rlike("(?i)^(?:R\\.?|The Queen|The King)$")
    parties = F.when(crown, F.array(_form(side(2), "case_party"))).otherwise(F.array(_form(side(1), "case_party"), _form(side(2), "case_party")))
    case = F.when(side(1) != "", F.concat(F.array(_form(style, "case_style")), parties)).otherwise(none)
    title = F.trim(F.regexp_extract(clean, _LAW_TITLE, 1))
    words = F.split(title, "\\s+")
    initials = F.array_join(F.transform(F.filter(words, lambda w: w.rlike("^\\p{Lu}")), lambda w: F.substring(w, 1, 1)), "")
    law = F.concat(F.array(_form(title, "legislation_title")), F.when((F.size(words) >= 3) & (F.length(initials) >= 2), F.array(_form(initials, "legislation_acronym"))).otherwise(none))
    prefix = F.regexp_replace(F.when(clean.rlike("[\"“]"), F.regexp_extract(clean, "(?s)^([^\"“]*)", 1)).otherwise(F.split_part(clean, F.lit(","), F.lit(1))), "^[ ,]+|[ ,]+$", "")
    authors = F.array(_form(author_form(surnames(prefix)), "secondary_authors"))
    k = F.lower(F.coalesce(kind, F.lit("")))
    forms = F.when(k.isin("case", "unreported"), case).when(k.isin("statute", "legislation", "regulation"), law).when(k.isin(*SECONDARY), authors).otherwise(none)
    return F.when(text.rlike("(?i)\\b(?:supra|ibid)\\b") | explicit | (F.trim(text) == ""), none).otherwise(_once(forms))


def candidate_names(column: Column) -> Column:
    """Names that may be meant right before 'supra': the words themselves, a case's parties among them, surnames among them."""
    found = F.try_element_at(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit("(?i)([^,;()]{1,80})\\s*,\\s*supra\\b"), F.lit(1)), F.lit(-1))
    name = replace_all(F.regexp_replace(F.coalesce(found, F.lit("")), "^[ ,;:.]+|[ ,;:.]+$", ""), ("(?i)^(?:citing|quoting|in|see)\\s+", ""))
    forms = F.concat(F.array(_form(name, "words")), inferred_forms(name, F.lit("case")), F.array(_form(author_form(surnames(name)), "authors")))
    return F.transform(_once(forms), lambda f: f["value"])
