"""Text normalisation, words, quotations and overlap, as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Quotation marks that compare equal, dashes that compare equal, and words that carry no content.
SINGLE_QUOTES, DOUBLE_QUOTES, DASHES = "‘’‚‛`", "“”„‟«»", "\u00ad‐‑‒–—―−"
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "by", "for", "from", "in", "is", "it", "its", "of", "on", "or", "that", "the", "their", "to", "was", "were",
    "with",
)
_WORD = "[\\p{L}\\p{N}]+(?:['’][\\p{L}\\p{N}]+)*"


@F.udf(returnType=StringType(), useArrow=True)
def nfkc(text: str) -> str:
    """Unicode compatibility form, which Spark has no function for."""
    return None if text is None else unicodedata.normalize("NFKC", text)


def replace_all(column: Column, *rules: tuple[str, str]) -> Column:
    """The regular expressions replaced one after the other."""
    for pattern, by in rules:
        column = F.regexp_replace(column, pattern, by)
    return column


def squeezed(column: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    # single spaces are left alone, so that a match is where something changes
    return F.trim(F.regexp_replace(column, "[ \\t\\n\\x0B\\f\\r\\u00A0]{2,}|[\\t\\n\\x0B\\f\\r\\u00A0]", " "))


def source_text(column: Column) -> Column:
    """A source's text without heading marks, emphasis, dot leaders, and spaces before punctuation; line ends stay."""
    return replace_all(column, ("(?m)^[ \\t]*#{1,6}[ \\t]+", ""), ("(\\*\\*|__|\\*)(?=\\S)(.+?)(?<=\\S)\\1", "$2"), ("[ \\t]*\\.{4,}[ \\t]*", " "), ("[ \\t]+([,.;:!?)\\]])", "$1"), ("([(\\[])[ \\t]+", "$1"))


def comparable(column: Column) -> Column:
    """How quotations are compared: quotation marks and dashes unified, hyphens inside words and white space as one space, outer
    quotation marks and punctuation at the end dropped, an editor's first letter ([T]he) without its brackets, lower case."""
    marks = SINGLE_QUOTES + DOUBLE_QUOTES + DASHES
    c = F.translate(column, marks, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES))
    c = F.lower(squeezed(F.regexp_replace(c, "-(?<=[\\p{L}\\p{N}]-)(?=[\\p{L}\\p{N}])", " ")))  # the dash first: it is rare
    c = F.trim(F.rtrim(F.regexp_replace(F.btrim(c, F.lit("\"'")), '"(?=[,.;:!?])', ""), F.lit(" ,.;:!?")))
    return F.when(c.startswith("["), F.regexp_replace(c, r"^\[([a-z])\](?=[a-z])", "$1")).otherwise(c)


def words(column: Column) -> Column:
    """Words in lower case: letters and digits of any script, with apostrophes inside."""
    return F.regexp_extract_all(F.lower(column), F.lit(_WORD), F.lit(0))


def content_words(column: Column) -> Column:
    """Distinct words that are neither stop words nor single letters."""
    return F.filter(F.array_except(words(column), F.array(*map(F.lit, STOP_WORDS))), lambda w: (F.length(w) > 1) | ~w.rlike("^\\p{L}$"))


def enough(n: Column) -> Column:
    """How many of n content words a source must share: 1 of up to 2, 2 of up to 4, else 35 %."""
    return F.when(n <= 2, F.least(n, F.lit(1))).when(n <= 4, F.lit(2)).otherwise(((n * 35 + 99) / 100).cast("int"))


def shares_enough(mine: Column, theirs: Column) -> Column:
    """plausible, of content words."""
    return F.size(F.array_intersect(mine, theirs)) >= enough(F.size(mine))


def plausible(quote: Column, source: Column) -> Column:
    """Whether enough of the quotation's content words stand in the source. A quotation without content words can't be told and is
    plausible; a source without any is not."""
    return shares_enough(content_words(quote), content_words(source))


def inline_quotes(column: Column) -> Column:
    """What stands between an opening (curly or straight) and the next closing double quotation mark, blank ones left out."""
    found = F.regexp_extract_all(column, F.lit('[“"]([^”"]*)[”"]'), F.lit(1))
    return F.filter(found, lambda q: F.trim(q) != "")


def contained(needle: Column, hay: Column) -> Column:
    """Exact containment of comparable texts: a single word must stand alone, more words may stand anywhere."""
    alone = F.concat(F.lit(" "), F.regexp_replace(hay, "[^\\p{L}\\p{N}']+", " "), F.lit(" "))
    return F.when(F.length(needle) == 0, False).when(needle.contains(" "), hay.contains(needle)).otherwise(alone.contains(F.concat(F.lit(" "), needle, F.lit(" "))))


def occurrences(needle: Column, hay: Column) -> Column:
    """How often needle occurs in hay, without overlap."""
    return F.when(F.length(needle) == 0, 0).otherwise(F.try_divide(F.length(hay) - F.length(F.replace(hay, needle, F.lit(""))), F.length(needle)).cast("int"))


def clean_cell(column: Column) -> Column:
    """Without control characters that spreadsheets and XML refuse."""
    return F.regexp_replace(column, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


