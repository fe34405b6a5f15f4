"""Byte-level BPE by replaying merges over many words at once, and decoding."""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField

from marginalia.llm.common import widened
from marginalia.llm.words import numbered, process_own, runs, slices, small_batches

#: Words whose ids a worker keeps, and the bytes a word may have to be kept; a table that is
#: full keeps what the texts at hand need.
KEPT, KEPT_BYTES = 1 << 19, 64
#: Characters of text that are handled at once, unless a single text is longer.
SLICE = 1 << 23
#: Code points by how far a text reaches: classes restricted to what it can hold are matched faster, and alike.
_LIMITS = (0x7F, 0xFFFF, 0x10FFFF)


@functools.lru_cache(maxsize=1)
def _classes() -> dict[str, list[int]]:
    r"""Code points of \p{L}, \p{N} and \s as the tiktoken library has them, asked of it: Unicode grows, and other libraries hold
    other versions of it."""
    everything = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    bare = {bytes([i]): i for i in range(256)}
    tell = lambda kind: bytes(tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=bare, special_tokens={}).encode_ordinary(everything))
    return {kind: list(map(ord, tell(kind).decode())) for kind in (r"\p{L}", r"\p{N}", r"\s")}


def _ranges(points: list[int], most: int) -> str:
    out, start = [], None
    points = [p for p in points if p <= most]
    for p, after in zip(points, [*points[1:], -1], strict=True):
        start = p if start is None else start
        if after != p + 1:
            out.append(f"\\U{start:08x}" + (f"-\\U{p:08x}" if p > start else ""))
            start = None
    return "".join(out)


def compiled(pattern: str, most: int) -> re.Pattern:
    r"""A pattern with \p{L}, \p{N} and \s, for texts whose code points are at most `most`: the classes are written out as ranges,
    in brackets of their own or inside others, and \S as what is not in \s."""
    inside = False
    out, i = [], 0
    ranges = {k: _ranges(v, most) for k, v in _classes().items()}
    while i < len(pattern):
        name = next((k for k in (*ranges, r"\S") if pattern.startswith(k, i)), None)
        if name == r"\S":
            if inside:
                raise ValueError(r"\S inside brackets is not supported")
            out.append(f"[^{ranges[chr(92) + 's']}]")
        elif name:
            out.append(ranges[name] if inside else f"[{ranges[name]}]")
        elif pattern[i] == "\\":
            name = pattern[i : i + 2]
            out.append(name)
        else:
            inside = pattern[i] == "[" or (inside and pattern[i] != "]")
            out.append(pattern[i])
        i += len(name) if name else 1
    return re.compile("".join(out))


class MergeReplay:
    """Words to ids by the ranks of a file: the bytes of all words stand in one row of tokens, an index says at which places each
    merge applies, and the merges are carried out in order of rank, each at all its places; a merge touches the two
    neighbours only. What comes out is what merging each word by itself, always the lowest rank and the leftmost place, gives."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = pattern
        self.tokens = {i: token for token, i in self.ranks.items()}
        self.size = max(self.tokens) + 2  # one more than ids, for gaps between words
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)])
        # every way to put a token together from two, as one number
        cut = ((self.ranks.get(t[:k]), self.ranks.get(t[k:]), i) for t, i in self.ranks.items() for k in range(1, len(t)))
        self.pairs = {a * self.size + b: i for a, b, i in cut if a is not None and b is not None}
        self.first = np.array([[self.pairs.get(a * self.size + b, -1) for b in self.bytes.tolist()] for a in self.bytes.tolist()])
        self.known: dict[str, bytes] = {}

    @functools.cached_property
    def patterns(self) -> list[re.Pattern]:
        return [compiled(self.pattern, most) for most in _LIMITS]

    def words(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if text.isascii():
            return self.patterns[0].findall(text)
        return self.patterns[1 if len(text.encode("utf-16-le")) == 2 * len(text) else 2].findall(text)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of the words, as 32-bit numbers in a row; a word that is a token as it stands is that token."""
        whole = {w: self.ranks[w].to_bytes(4, "little") for w in words if w in self.ranks}
        out = [whole.get(w, b"") for w in words]
        left = [i for i, ids in enumerate(out) if not ids and words[i]]
        size, get, gap = self.size, self.pairs.get, self.size - 1
        # all words in a row, with a gap before the first and behind each
        row = np.frombuffer(b"".join(words[i] for i in left), dtype=np.uint8)
        lengths = np.array([len(words[i]) for i in left], dtype=np.int64)
        starts = np.cumsum(lengths + 1) - lengths
        held = np.full(len(row) + len(left) + 1, gap, dtype=np.int64)
        word = np.repeat(np.arange(len(left)), lengths)
        held[np.arange(len(row)) + word + 1] = self.bytes[row]
        first = np.full(len(held), -1, dtype=np.int64)
        same = np.flatnonzero(word[1:] == word[:-1])
        first[same + word[same] + 1] = self.first[row[same], row[same + 1]]
        order = np.argsort(first, kind="stable")
        cuts = np.flatnonzero(np.diff(first[order], prepend=-2))
        groups = np.split(order, cuts[1:]) if len(order) else []
        #: merge -> places of its left half, in order or to be sorted
        places = {int(first[g[0]]): g.tolist() for g in groups if first[g[0]] >= 0}
        token, due = held.tolist(), first.tolist()
        before, behind = list(range(-1, len(token) - 1)), list(range(1, len(token) + 1))
        queue = list(places)
        heapq.heapify(queue)
        while queue:
            now = heapq.heappop(queue)
            done, later = -1, []
            for i in sorted(places.pop(now)):
                if due[i] != now:  # merged otherwise since it was put down
                    continue
                if i < done:  # a lower rank has come up in this word and goes first
                    later.append(i)
                    continue
                j = behind[i]
                h, k = before[i], behind[j]
                token[i], token[j], behind[i], before[k], due[j] = now, -1, k, i, -1
                due[h] = left_new = get(token[h] * size + now, -1)
                due[i] = right_new = get(now * size + token[k], -1)
                if left_new >= 0:
                    if left_new in places:
                        places[left_new].append(h)
                    else:
                        places[left_new] = [h]
                        heapq.heappush(queue, left_new)
                if right_new >= 0:
                    if right_new in places:
                        places[right_new].append(i)
                    else:
                        places[right_new] = [i]
                        heapq.heappush(queue, right_new)
                if 0 <= left_new < now or 0 <= right_new < now:
                    at = int(np.searchsorted(starts, i, side="right")) - 1
                    done = int(starts[at] + lengths[at])
            if later:
                if now not in places:
                    places[now] = []
                    heapq.heappush(queue, now)
                places[now] += later
        row = np.array(token, dtype=np.int64)
        live = (row >= 0) & (row != gap)
        ids, upto = row[live].astype("<i4").tobytes(), 4 * np.cumsum(live)
        for i, a, b in zip(left, upto[starts - 1].tolist(), upto[starts + lengths - 1].tolist(), strict=True):
            out[i] = ids[a:b]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. The distinct words of all of them that are not known yet go through one replay."""
        split = [self.words(t) for t in texts]
        here = set().union(*split) if split else set()
        if len(self.known) + len(here) > KEPT:  # the words met last stay
            self.known = {w: self.known[w] for w in here if w in self.known}
        new = list(here.difference(self.known))
        self.known.update(zip(new, self.replay([w.encode() for w in new]), strict=True))
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype="<i4") for words in split]
        for w in new:
            if len(w) > KEPT_BYTES:
                del self.known[w]
        return out


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    values = np.concatenate(rows) if rows else np.empty(0, dtype=np.int32)
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(values, pa.int32())).cast(pa.list_(pa.int32()))


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Every row of df with the ids of its whole text, an array of ints. ranks is the path of a rank file that every executor has;
    pattern cuts a text into words, each of which is encoded by itself; special tokens are none.

    A task replays the merges over the distinct words of some 8 MB of its texts at once, and knows up to KEPT words from before. Words
    that are spread over tasks are replayed in each, so that nothing is shuffled and a lost task is run again by itself.
    A null or empty text has no ids (an empty array); very long texts and very long words (a megabyte of one letter) take
    time in proportion to length and its logarithm; repeated rows and other columns pass through; a column that df has under the name of
    ids is replaced; an empty table gives none."""
    df = df.drop(ids)
    names = df.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = process_own(MergeReplay, ranks, pattern)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in runs(texts, SLICE):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, _lists(own.encode(texts[a:b]))], [*names, ids])

    return small_batches(numbered(df)).mapInArrow(run, widened(df, StructField(ids, ArrayType(IntegerType()))))


class Decoder:
    """Lists of ids to bytes. The tokens of all lists are taken from one table in a row, which is the bytes of all rows as they
    follow each other: no id becomes an object of Python."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as lines:
            tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
        self.tokens = pa.array(map(tokens.get, range(max(tokens) + 1)), pa.large_binary())

    def __call__(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list; null: none. A null or unknown id is an error."""
        found = self.tokens.take(ids.flatten())
        if found.null_count:
            raise ValueError("an id is null or not in the file")
        if not len(found):
            return pa.array([b""] * len(ids), pa.binary())
        _, ends, data = found.buffers()
        lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.frombuffer(ends, dtype=np.int64, count=len(found) + 1)[np.cumsum([0, *lengths])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(cuts.tobytes()), data]).cast(pa.binary())


def decode(df: DataFrame, ranks: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """Every row of df with the bytes that its ids stand for, which are UTF-8 where the ids are those of a whole text. Null or no ids: no
    bytes; an id that the file doesn't have is an error; other columns pass through, one of the name of data is replaced."""
    df = df.drop(data)
    names = df.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = process_own(Decoder, ranks)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, own(batch.column(at))], [*names, data])

    return small_batches(numbered(df)).mapInArrow(run, widened(df, StructField(data, BinaryType())))
