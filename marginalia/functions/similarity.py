"""Ratcliff-Obershelp similarity over Arrow batches, and how a quotation is shown with its source's words. Alignment is quadratic,
so callers give it candidates only."""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: Fixed: what a token is, the limits beyond which a source is long, the lengths of anchor phrases, punctuation that a quotation may
#: add at its end, and marks that compare equal.
_UNIT = r"[^\W_]+(?:['’][^\W_]+)*"
LONG_CHARS, LONG_TOKENS = 80_000, 8_000
ANCHORS = (8, 6, 5, 4, 3)
_END = frozenset((".", ",", ";", ":", "!", "?", "…", "..."))
_SAME = {**dict.fromkeys('"“”«»„', '"'), **dict.fromkeys("'‘’‚", "'"), **dict.fromkeys("-\u00ad‐‑‒–—―−", "-")}
#: Words and bracketed insertions that touch are one token, as test[ing].
_TOKEN = re.compile(rf"\.\.\.|(?:\[[^\]]+\]|{_UNIT})+|[^\w\s]")
_WORDS, _PLAIN = re.compile(_UNIT), re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_ENDING = re.compile(r"([a-z]+)((?:\[[a-z]+\])+)")


@lru_cache(maxsize=4096)
def tokens(text: str) -> tuple[str, ...]:
    return tuple(_TOKEN.findall(text))


def _core(quote: str) -> tuple[str, ...]:
    """A quotation's tokens without punctuation at the end."""
    own = tokens(quote.strip())
    n = len(own)
    while n and own[n - 1] in _END:
        n -= 1
    return own[:n]


def wordlike(token: str) -> bool:
    return bool(_WORDS.search(token))


@lru_cache(maxsize=1 << 16)
def canonical(token: str) -> str:
    """A token as it is compared: marks and dashes unified, [T]he as The, plain words in lower case."""
    if token in _SAME:
        return _SAME[token]
    plain = re.sub(r"^\[([A-Za-z])\](?=[A-Za-z]+$)", r"\1", "".join(_SAME.get(c, c) for c in token))
    return plain.lower() if _PLAIN.fullmatch(plain) else plain


def endings(quote: tuple[str, ...]) -> dict[str, str]:
    """For words with bracketed endings: test and testing, both as test[ing], which either of them matches."""
    out = {}
    for token in quote:
        if m := _ENDING.fullmatch(canonical(token).lower()):
            whole = m[1] + re.sub(r"[\[\]]", "", m[2])
            out[m[1]] = out[whole] = f"{m[1]}|{whole}"
    return out


def _aligned(token: str, alias: dict[str, str]) -> str:
    c = canonical(token).lower()
    c = _ENDING.sub(lambda m: m[1], c) if _ENDING.fullmatch(c) else c
    return alias.get(c, c)


def exact_but_endings(source: str, quote: str) -> bool:
    """Whether the quotation's words stand in the source one after the other, if bracketed endings may be there or not."""
    own = _core(quote)
    alias = endings(own)
    if not alias:
        return False
    listed = lambda ts: "\0".join(["", *(_aligned(t, alias) for t in ts if wordlike(t)), ""])
    return listed(own) != "\0" and listed(own) in listed(tokens(source))


def _blocks(a, b) -> int:
    return sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def _phrases(words: list[str]) -> list[tuple[str, ...]]:
    """Runs of words that a long source is searched for: of each length at the start, a quarter, the middle and the end."""
    found: dict[tuple[str, ...], None] = {}
    for n in ANCHORS:
        if len(words) >= n:
            for at in (0, len(words) // 4, len(words) // 2, len(words) - n):
                at = min(at, len(words) - n)
                found[tuple(words[at : at + n])] = None
    return list(found)


def _long_share(source: str, quote: tuple[str, ...]) -> float:
    """The matched share in a long source: words only, in windows around the quotation's phrases; the share of words that occur at
    all where that is low, or no phrase is found."""
    mine = [t.lower() for t in quote if wordlike(t)]
    theirs = [w.lower() for w in _WORDS.findall(source)]
    if not mine or not theirs:
        return 0.0
    held = set(theirs)
    overlap = sum(w in held for w in mine) / len(mine)
    if overlap < 0.6:
        return overlap
    line, best, met = "\0".join(["", *theirs, ""]), 0.0, set()
    for phrase in _phrases(mine):
        at = line.find("\0".join(["", *phrase, ""]))
        if at < 0:
            continue
        first = line.count("\0", 0, at)
        window = (max(0, first - len(mine)), first + len(phrase) + 3 * len(mine))
        if window not in met and best < 0.98:
            met.add(window)
            best = max(best, _blocks(theirs[slice(*window)], mine) / len(mine))
    return best or min(overlap, 0.59)


def matched_share(source: str, quote: str) -> float:
    """Tokens of the quotation that lie in blocks it shares with the source, as a part of its tokens: 1 where only bracketed endings
    differ; by words around anchor phrases in sources beyond the limits, by all tokens of the whole source within them."""
    own = _core(quote)
    if not own or not source.strip():
        return 0.0
    if exact_but_endings(source, quote):
        return 1.0
    if len(source) > LONG_CHARS or len(theirs := tokens(source)) > LONG_TOKENS:
        return _long_share(source, own)
    return _blocks(theirs, own) / len(own)


def _rows(kind: pa.DataType, one: Callable, *columns: pa.Array) -> pa.Array:
    """one of each row without a null; null for the others."""
    return pa.array([None if None in row else one(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], kind)


@F.arrow_udf(DoubleType())
def match_score(source: pa.Array, quote: pa.Array) -> pa.Array:
    return _rows(pa.float64(), matched_share, source, quote)


@F.arrow_udf(DoubleType())
def title_ratio(query: pa.Array, title: pa.Array) -> pa.Array:
    return _rows(pa.float64(), lambda q, t: SequenceMatcher(None, q, t).ratio(), query, title)


def _inside(quoted: str, given: str) -> str | None:
    """test[ing] of testing and test: one insertion into a word that is otherwise the same; None for other words. What both begin with
    and what both end with must cover the given word; the insertion is what they leave of the quoted one."""
    added = len(quoted) - len(given)
    if added <= 0 or added > max(4, len(given) // 2 + 1) or set("[]") & set(quoted + given):
        return None
    head = next((i for i, (x, y) in enumerate(zip(quoted, given, strict=False)) if x != y), len(given))
    if quoted[head + added :] != given[head:]:
        return None
    return f"{given[:head]}[{quoted[head : head + added]}]{given[head:]}"


def _shown(quoted: list[str], given: list[str]) -> list[str]:
    """What the quotation has in place of given words of the source: in brackets, but for marks and what has brackets already."""
    if len(quoted) == 1 and wordlike(quoted[0]):
        for other in [t for t in given if wordlike(t)][:1]:
            if found := _inside(quoted[0], other):
                return [found]
    if not any(wordlike(t) for t in quoted) or any("[" in t for t in quoted):
        return quoted
    return [f"[{spaced(quoted)}]"]


def _kept(quoted: str, given: str) -> str:
    """A token that both have, as the source has it, unless the quotation changes its first letter's case, which stays marked."""
    if re.fullmatch(r"\[[A-Za-z]\][A-Za-z]+", quoted):
        return quoted
    if quoted != given and quoted[1:] == given[1:] and quoted[:1].lower() == given[:1].lower() and wordlike(given):
        return f"[{quoted[0]}]{quoted[1:]}"
    return given


def spaced(parts: list[str]) -> str:
    """Tokens as text: no space before closing marks and behind opening ones."""
    out, opened = "", False
    for p in parts:
        straight = p == '"'
        closing = p in tuple(",.;:!?…)”’»") or (straight and opened)
        glue = "" if not out or closing or out[-1] in "(“‘«" or (out[-1] == '"' and opened) else " "
        out += glue + p
        opened = opened != straight
    return out


def corrected(source: str, quote: str) -> str:
    """The quotation as the source has it: what it leaves out inside becomes ..., its own additions and changes go in brackets."""
    a, b = list(tokens(source.strip())), list(tokens(quote.strip()))
    if not a or not b:
        return source.strip() if not b else quote.strip()
    if _SAME.get(b[0]) != '"':
        while a and _SAME.get(a[0]) == '"':
            a.pop(0)
    if not (core := _core(quote)) or _SAME.get(core[-1]) != '"':
        while a and _SAME.get(a[-1]) == '"':
            a.pop()
    out: list[str] = []
    for kind, i1, i2, j1, j2 in SequenceMatcher(None, [canonical(t) for t in a], [canonical(t) for t in b], autojunk=False).get_opcodes():
        if kind == "equal":
            out += [_kept(q, s) for q, s in zip(b[j1:j2], a[i1:i2], strict=True)]
        elif kind != "delete":
            out += _shown(b[j1:j2], a[i1:i2])
        elif not any(wordlike(t) for t in a[i1:i2]):
            out += a[i1:i2]
        elif out and j1 < len(b) and out[-1] != "...":
            out.append("...")
    return spaced(out)


@F.arrow_udf(StringType())
def corrected_quote(source: pa.Array, quote: pa.Array) -> pa.Array:
    """corrected of each row."""
    return _rows(pa.string(), corrected, source, quote)


#: Fixed: tokens that may lie between two stretches of one fragment, words by which a replaced stretch may differ, characters of a
#: fragment, characters by which a quotation's beginning is looked for, and characters around what is found.
GAP, UNEVEN, MOST_CHARS, START, AROUND = 8, 2, 900, 40, 400


def best_region(source: list[str], quote: list[str]) -> tuple[int, int, int]:
    """(from, to, shared): the window of words as long as the quotation that shares most words with it, counted with repeats; of equals
    the first. The count is carried along as the window slides, so this takes time in proportion to the source."""
    n = min(len(quote), len(source))
    want: dict[str, int] = {}
    for w in quote:
        want[w] = want.get(w, 0) + 1
    shared, best, at = 0, -1, 0
    for i, w in enumerate(source):
        if w in want:  # want holds what the window still lacks of each word; below 0 it has more than the quotation
            want[w] -= 1
            shared += want[w] >= 0
        if i >= n and (out := source[i - n]) in want:
            want[out] += 1
            shared -= want[out] > 0
        if i >= n - 1 and shared > best:
            best, at = shared, i - n + 1
    return at, at + n, max(best, 0)


def region(source: str, quote: str) -> str:
    """The stretch of a source in which a quotation is to be looked for: around its first START characters, if the source has them; in long
    sources around the first of its phrases found, or none; else around the best region, a quotation before it and two behind."""
    said, text = quote.strip(), source.strip()
    own = [w.lower() for w in _WORDS.findall(said)]
    plain = lambda s: "".join(_SAME.get(c, c) for c in s).lower()
    low = plain(text)
    if len(low) == len(text) and said and (at := low.find(plain(said[:START]))) >= 0:
        return text[max(0, at - AROUND // 2) : at + len(said) + AROUND // 2]
    spans = [(m[0].lower(), m.start(), m.end()) for m in _WORDS.finditer(text)]
    if not spans or not own:
        return text
    words = [w for w, _, _ in spans]
    if len(text) > LONG_CHARS:
        line = "\0".join(["", *words, ""])
        for phrase in _phrases(own):
            if (at := line.find("\0".join(["", *phrase, ""]))) >= 0:
                first = line.count("\0", 0, at)
                return text[max(0, spans[first][1] - AROUND) : spans[first + len(phrase) - 1][2] + len(said) + AROUND]
        return ""
    lo, hi, _ = best_region(words, own)
    return text[spans[max(0, lo - len(own))][1] : spans[min(len(spans), hi + 2 * len(own)) - 1][2]]


def fragment(source: str, quote: str) -> str:
    """The stretch of the source that the quotation stands for, without a paragraph's number before it; empty if there is none or it is
    longer than MOST_CHARS. The quotation's region is looked at only, so the work doesn't grow with the square of the source.

    Aligned stretches are equal runs of tokens, and replaced ones with about as many words; those with at most GAP tokens between
    are one, and the one with most words is taken, of equals the shortest."""
    source = region(source, quote)
    spans = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(source)]
    own = tokens(quote)
    alias = endings(own)
    upto = [0]
    for t, _, _ in spans:
        upto.append(upto[-1] + wordlike(t))
    stretches: list[tuple[int, int]] = []
    before = (0, 0)
    for m in SequenceMatcher(None, [_aligned(t[0], alias) for t in spans], [_aligned(t, alias) for t in own], autojunk=False).get_matching_blocks():
        # between two equal runs both sides may have other words: a replacement, if about as many
        given, quoted = upto[m.a] - upto[before[0]], sum(map(wordlike, own[before[1] : m.b]))
        if given and quoted and abs(given - quoted) <= UNEVEN:
            stretches.append((before[0], m.a))
        if upto[m.a + m.size] > upto[m.a]:
            stretches.append((m.a, m.a + m.size))
        before = (m.a + m.size, m.b + m.size)
    joined: list[tuple[int, int]] = []
    for a, z in stretches:
        if joined and a - joined[-1][1] <= GAP:
            joined[-1] = (joined[-1][0], z)
        else:
            joined.append((a, z))
    if not joined:
        return ""
    lo, hi = max(joined, key=lambda r: (upto[r[1]] - upto[r[0]], r[0] - r[1]))
    found = re.sub(r"\s+", " ", source[spans[lo][1] : spans[hi - 1][2]]).strip()
    if not (first := _WORDS.findall(quote)) or not first[0].isdigit():
        found = re.sub(r"^(?:\[\s*\d{1,4}\s*\]|\d{1,4}\s*\(\d{1,4}\)|\d{1,4})\s+(?=\S)", "", found)
    return "" if len(found) > MOST_CHARS or re.fullmatch(r"\[[^\]]+\]", found) else found


def _each(kind: pa.DataType, one: Callable, source: pa.Array, quotes: pa.Array) -> pa.Array:
    """one of a source and each of a list of quotations; null where either is."""
    rows = zip(source.to_pylist(), quotes.to_pylist(), strict=True)
    return pa.array([None if s is None or qs is None else [one(s, q) for q in qs] for s, qs in rows], pa.list_(kind))


def _counted(ts: tuple[str, ...]) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in ts:
        out[t] = out.get(t, 0) + 1
    return out


def match_shares(source: str, quotes: list[str], least: float) -> list[float]:
    """matched_share of each quotation in one source; 0 for those that can't reach least, as the source has too few of their tokens,
    counted with repeats, in whatever order. These are told without alignment."""
    if len(source) > LONG_CHARS:
        return [matched_share(source, q) for q in quotes]
    held = _counted(tokens(source))
    out = []
    for q in quotes:
        own = _core(q)
        shared = sum(min(n, held.get(t, 0)) for t, n in _counted(own).items())
        out.append(matched_share(source, q) if not own or shared >= least * len(own) or endings(own) or sum(held.values()) > LONG_TOKENS else 0.0)
    return out


@F.arrow_udf(ArrayType(DoubleType()))
def match_scores(source: pa.Array, quotes: pa.Array, least: pa.Array) -> pa.Array:
    """match_shares of each row; null where a text or the list is."""
    rows = zip(source.to_pylist(), quotes.to_pylist(), least.to_pylist(), strict=True)
    return pa.array([None if s is None or qs is None else match_shares(s, qs, n) for s, qs, n in rows], pa.list_(pa.float64()))


@F.arrow_udf(ArrayType(StringType()))
def source_fragments(source: pa.Array, quotes: pa.Array) -> pa.Array:
    """fragment of each of several quotations in one source."""
    return _each(pa.string(), fragment, source, quotes)


@F.arrow_udf(StringType())
def source_fragment(source: pa.Array, quote: pa.Array) -> pa.Array:
    """fragment of each row."""
    return _rows(pa.string(), fragment, source, quote)


def score(source: Column, quote: Column, exact: Column) -> Column:
    """1 where exact holds; otherwise the matched share. Rows that are exact pass no text to Python."""
    return F.when(exact, 1.0).otherwise(match_score(F.when(~exact, source), F.when(~exact, quote)))
