"""Identity keys of citations and names. The four are different on purpose and are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import DASHES, nfkc, replace_all

#: A dot, dash or slash between digits tells citations apart (4.1 is not 41), so it becomes a word of the key.
_MARKS = (("(?<=[0-9])\\.(?=[0-9])", "dot"), ("(?<=[0-9])-(?=[0-9])", "dash"), ("(?<=[0-9])/(?=[0-9])", "slash"))
_PINPOINT = "[ ,]+(?:at )?(?:paras?|paragraphs?|pp?|ss?|sections?|arts?|cl|sch)\\.? *[0-9].*$"
_AT_PAGE = "[ ,]+at +[0-9].*$"


def _plain(column: Column, unicode: bool) -> Column:
    if unicode:  # only rows with a character beyond ASCII carry text to Python
        column = F.coalesce(nfkc(F.when(column.rlike("[^\\x00-\\x7F]"), column)), column)
    return F.lower(F.trim(F.translate(column, DASHES, "-" * len(DASHES))))


def citation_key(column: Column, unicode: bool = True) -> Column:
    """Of a citation as a whole, pinpoints included. unicode: fold compatibility characters, which costs a Python call a row."""
    return replace_all(_plain(column, unicode), *_MARKS, ("[^a-z0-9]", ""))


def broad_citation_key(column: Column, unicode: bool = True) -> Column:
    """Without pinpoints and provisions at the end, and without the marks between digits."""
    return replace_all(_plain(column, unicode), (_PINPOINT, ""), (_AT_PAGE, ""), ("[^a-z0-9]", ""))


def name_key(column: Column, unicode: bool = True) -> Column:
    """Of a style of cause: initials joined, dashes and slashes as spaces, other punctuation dropped, white space collapsed."""
    return F.trim(replace_all(_plain(column, unicode), ("(?<![a-z])([a-z])\\.(?=[a-z]\\.)", "$1"), ("\\bv\\.", "v"), ("[-/]", " "), ("[^\\p{L}\\p{N}_ ]", ""), (" +", " ")))


def comma_tails(column: Column) -> Column:
    """The citation and what is left of it after each comma, the longest first."""
    parts = F.split(column, ",")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.trim(F.array_join(F.slice(parts, i, F.size(parts)), ",")))


def cache_key(kind: Column, value: Column, version: str = "v5") -> Column:
    """SHA-256 of version, kind and value with NUL between them."""
    return F.sha2(F.concat_ws("\0", F.lit(version), kind, value), 256)
