"""Chat formatting with a template known only by what it renders: spans of turns and the loss mask from successive prefixes."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

Turn = tuple[str, str]
#: Strings that steer a model; none of them is left whole inside an escaped text.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: The first character of a control string; what follows is looked at but not taken, as control strings may overlap.
_STARTS = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_SPAN = StructType([StructField("role", StringType()), *(StructField(c, LongType()) for c in ("start", "end", "body_start", "body_end")), StructField("loss", BooleanType())])
_SPANS = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("body_start", pa.int64()), ("body_end", pa.int64()), ("loss", pa.bool_())]))


def escape(text: str) -> str:
    """Double each backslash, and put one behind the first character of each control string."""
    return _STARTS.sub(r"\g<0>\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _marked(role: str, text: str) -> str:
    return f"<|{escape(role)}|>\n{escape(text)}<|end|>\n"


_short = functools.lru_cache(maxsize=1 << 14)(_marked)


def marked_turns(turns: Sequence[Turn]) -> str:
    """The template of our own: every turn between marks, with its role. Prefixes render the same turns again and again, so those
    of ordinary length are kept."""
    return "".join([_short(role, text) if len(text) <= 10_000 else _marked(role, text) for role, text in turns])


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _probe(render: Callable[[Sequence[Turn]], str], before: list[Turn], role: str) -> tuple[str, str]:
    """What the template puts before and after the body of a last turn of this role: two texts that differ in one letter tell."""
    one, two = render([*before, (role, "a")]), render([*before, (role, "b")])
    head = common_prefix(one, two)
    return one[:head], one[head + 1 :]


def _appended(render: Callable[[Sequence[Turn]], str], turns: Sequence[Turn], trained: frozenset[str]) -> tuple[str, list[tuple]]:
    """What render_spans gives for a template that adds to each turn's predecessor only: prefixes of two neighbouring turns tell what a
    turn adds. The whole rendering must be what they add up to."""
    pieces = [render([])]
    spans, at = [], len(pieces[0])
    for i, (role, text) in enumerate(turns):
        before = list(turns[i - 1 : i]) if i else []
        last, now = render(before), render([*before, (role, text)])
        head, tail = _probe(render, before, role)
        if not (now.startswith(last) and head.startswith(last) and now.startswith(head) and now.endswith(tail)):
            raise ValueError("the template was declared as appending, but changes what stands before a turn")
        start = at - len(last)
        spans.append((role, at, start + len(now), start + len(head), start + len(now) - len(tail), role in trained))
        pieces.append(now[len(last) :])
        at += len(pieces[-1])
    whole = "".join(pieces)
    if render(turns) != whole:
        raise ValueError("the template was declared as appending, but renders the whole otherwise than its turns")
    return whole, spans


def render_spans(render: Callable[[Sequence[Turn]], str], turns: Sequence[Turn], trained: frozenset[str] = frozenset({"assistant"}), appending: bool = False) -> tuple[str, list[tuple], bool]:
    """Render the prefixes of 1, 2, ... turns and compare each with the one before.

    Returns the whole rendering; for each turn (role, start, end, body_start, body_end, loss), the span that the turn added and
    its body, by code points; and whether the template rewrote history, that is whether some prefix doesn't begin with the one
    before. Then the spans after the rewriting begin where the outputs part, and no turn is trained on.

    All prefixes cost the square of the turns, for conversations of any length, as a template may rewrite at any. A caller who knows
    that a template only ever adds behind the turn before declares it as appending; then prefixes of two neighbouring turns
    are rendered, which costs the length alone, and an error is raised where that doesn't add up to the whole."""
    if appending:
        return (*_appended(render, turns, trained), False)
    last, spans, rewrites = render([]), [], False
    for i, (role, _) in enumerate(turns):
        before = list(turns[:i])
        now = render(turns[: i + 1])
        start = len(last)
        if not now.startswith(last):
            rewrites, start = True, common_prefix(now, last)
        head, tail = _probe(render, before, role)
        body = (len(head), len(now) - len(tail)) if now.startswith(head) and now.endswith(tail) else (start, len(now))
        spans.append((role, start, len(now), *body, role in trained))
        last = now
    if rewrites:
        spans = [(*s[:5], False) for s in spans]
    return last, spans, rewrites


def format_conversations(turns: DataFrame, render: Callable[[Sequence[Turn]], str] = marked_turns, appending: bool = False) -> DataFrame:
    """(conv_id, formatted, spans, rewrites_history), one row a conversation of turns (conv_id, turn, role, text).

    Turns are taken by turn, ties by role and text, nulls first; a null role or text is empty; repeated rows are turns of their
    own; rows with null conv_id are one conversation; an empty table gives none. A conversation is one row and one rendering, so
    its turns meet in one task, in memory in proportion to its text. All prefixes are rendered and compared, also those of our own
    template; appending is a caller's declaration as in render_spans."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("turns"))
    listed = whole.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render_spans(render, list(zip(r, t, strict=True)), appending=appending) for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            names = [f.name for f in _SPANS.value_type]
            spans = pa.array([[dict(zip(names, s, strict=True)) for s in d[1]] for d in done], _SPANS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.string()), spans, pa.array([d[2] for d in done], pa.bool_())], ["conv_id", "formatted", "spans", "rewrites_history"])

    fields = [turns.schema["conv_id"], StructField("formatted", StringType()), StructField("spans", ArrayType(_SPAN)), StructField("rewrites_history", BooleanType())]
    return listed.mapInArrow(run, StructType(fields))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and trained text as they stand in the renderings of our own template: conv_id, n_turns, turns_sha256 (role, line end,
    text, line end of each turn), loss_chars and loss_sha256 (all text under the loss mask, unescaped), formatted_chars."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = [(unescape(re.match(r"<\|(.*?)\|>\n", text[s["start"] : s["body_start"]], re.DOTALL)[1]), unescape(text[s["body_start"] : s["body_end"]])) for s in spans]
                loss = "".join(t for (_, t), s in zip(turns, spans, strict=True) if s["loss"])
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    found = [StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())]
    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, StructType([formatted.schema["conv_id"], *found]))
