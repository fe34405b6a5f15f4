"""Packing token sequences: patterns of a few lengths whose repeat counts non-negative least squares fits to the histogram."""

from __future__ import annotations

import itertools
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from marginalia.llm.common import bucket_bits, hash60, materialize, rank_within, widened, with_copies
from marginalia.llm.words import process_own, runs, slices, small_batches

#: White space that a chunk's encoding could depend on beyond its own characters: runs, and at either end.
_LOOSE = re.compile(r"\s\s|^\s|\s$")
#: A space between two visible characters: no token reaches over it from the left, so what stands on either side is encoded
#: alone, with the same ids as in the whole text.
_SEAM = re.compile(r"(?<=\S)(?= \S)")
_RARE_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: Words whose ids a worker keeps, characters of a word that is kept, and characters of text whose words are learnt at once.
_KEPT, _LONG, _LEARNT = 400_000, 24, 1 << 22


def _loose(text: str) -> bool:
    """Whether _LOOSE is found in a text that isn't empty; searches for single stretches are faster where a text holds nothing but spaces and line ends."""
    if any(c in text for c in _RARE_SPACES):
        return bool(_LOOSE.search(text))
    return text[0] in " \n" or text[-1] in " \n" or any(two in text for two in ("  ", "\n\n", " \n", "\n "))


#: What a byte-level tokenizer merges within, in texts of printable ASCII whose only space stands first.
_PRINTED = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+"


def _merger(path: str) -> tuple[Callable[[str], list[int]], np.ndarray, Callable[[str], list[int]] | None, list[str]] | None:
    """An encoder of words of letters with the merges of the tokenizer's file, several times as fast as the tokenizer on words that
    it has not met; which of its ids begin with a space; an encoder of words of printable ASCII, which must hold none of the
    tokens that the file adds; and these. None if the file isn't a plain byte-level BPE whose ids follow the order of its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        stated = json.load(file)
    model = stated["model"]
    vocab, merges = model.get("vocab", {}), [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    plain = stated.get("normalizer") is None and not model.get("dropout") and (stated.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
    if not plain or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}
    spaced = np.zeros(256 + len(merges), dtype=bool)
    spaced[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
    encoder = lambda pattern: tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    printed = encoder(_PRINTED) if stated["pre_tokenizer"].get("use_regex", True) else None
    return encoder(r" ?\p{L}+"), spaced, printed, [a["content"] for a in stated.get("added_tokens", [])]


class TokenBytes(dict):
    """Ids of texts, as little-endian unsigned 32-bit numbers. A dictionary of the ids of chunks met before, each a word that
    a space precedes; emptied when it grows too large. Words at the start of a line have a dictionary of their own. Words of
    letters are learnt ahead, all those of some texts in one call; the others when they are met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._encode = Tokenizer.from_file(path).encode
        self._letters, self._spaced, self._printed, self._added = _merger(path) or (None, None, None, [])
        self._heads: dict[str, bytes] = {}
        self._line_end = self.chunk("\n")
        self._marks = {c: self.chunk(c) for c in ".,;:!?"}
        self._bare = bool(self._letters) and self._ids("a") == self.chunk("a")  # no space is put before a text
        self._taken: dict[str, bool] = {}

    def _ids(self, letters: str) -> bytes:
        return np.array(self._letters(letters), dtype="<u4").tobytes()

    def _odd(self, text: str) -> bytes:
        """The ids of a word that holds more than letters, with or without a space before it."""
        if self._printed and text.isascii() and text.isprintable() and " " not in text[1:] and not any(a in text for a in self._added):
            return np.array(self._printed(text), dtype="<u4").tobytes()
        return self.chunk(text)

    def _is_letter(self, c: str) -> bool:
        if c not in self._taken:
            self._taken[c] = bool(self._letters(c))
        return self._taken[c]

    def learn(self, texts: list[str]) -> None:
        """Put the words of letters of these texts into the dictionary. They are encoded in one row: each begins with the one space
        in it, so the tokens that begin with a space tell where the words do."""
        if not self._letters:
            return
        here = set()
        for t in texts:
            here.update(t.split())
        fresh = {w for x in here.difference(self) if len(w := x[:-1] if x[-1] in self._marks else x) <= _LONG and w.isalpha()}
        if len(self) + len(fresh) > _KEPT // 4 * 3:  # the words met last stay, with room for those that are met
            kept = {w: self[w] for w in here if w in self}
            self.clear()
            self.update(kept)
        new = [w for w in fresh if w not in self]
        odd = {c for c in set().union(*new) if not self._is_letter(c)}
        if odd:  # what the encoder doesn't take for letters would be passed over
            new = [w for w in new if odd.isdisjoint(w)]
        ids = np.array(self._letters("".join([f" {w}" for w in new])), dtype="<u4")
        cuts = [*(4 * np.flatnonzero(self._spaced[ids])).tolist(), 4 * len(ids)]
        data = ids.tobytes()
        self.update((w, data[a:b]) for w, (a, b) in zip(new, itertools.pairwise(cuts), strict=True))

    def chunk(self, text: str) -> bytes:
        return np.array(self._encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if word[-1] in self._marks and word[:-1].isalpha():  # letters and the mark behind them are encoded apart
            ids = self[word[:-1]] + self._marks[word[-1]]
        elif self._letters and word.isalpha():
            ids = self._ids(f" {word}")
        else:
            ids = self._odd(f" {word}")
        if len(word) <= _LONG:
            if len(self) >= _KEPT:
                self.clear()
            self[word] = ids
        return ids

    def _head(self, word: str) -> bytes:
        ids = self._heads.get(word)
        if ids is None:
            if len(self._heads) >= _KEPT // 4:
                self._heads.clear()
            if self._bare and word[-1:] in self._marks and word[:-1].isalpha():
                ids = self._head(word[:-1]) + self._marks[word[-1]]
            elif self._bare and word.isalpha():
                ids = self._ids(word)
            else:
                ids = self._odd(word) if self._bare else self.chunk(word)
            self._heads[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if _loose(text):
            first, *rest = _SEAM.split(text)
            return self.chunk(first) + b"".join([self[c[1:]] for c in rest])
        lines = []
        for line in text.split("\n"):  # a single line end between visible characters is a token of its own
            first, *rest = line.split(" ")
            lines.append(self._head(first) + b"".join(map(self.__getitem__, rest)))
        return self._line_end.join(lines)


def id_code(tokenizer: str, end: int = 2) -> str:
    """The narrowest unsigned little-endian numbers that hold every id: two bytes for vocabularies of up to 65,536."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


def cut_pieces(df: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, key: str = "doc_id", text: str = "text", code: str = "<u4") -> DataFrame:
    """Token ids of each row (null text: empty) with the id `end` behind them, cut into pieces of size tokens, of which the first
    may be shorter: (doc_id, piece, start, length, ids as numbers of the given code, row: a hash of the text). Every row has at least one piece, an empty table has none. Whole texts, however long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = process_own(TokenBytes, tokenizer)
        last = np.array([end], dtype="<u4").tobytes()
        for batch in slices(batches):
            keys, pieces, starts, lengths, data, rows = [], [], [], [], [], []
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for x, y in runs(texts, _LEARNT):
                tokens.learn(texts[x:y])
                for doc, t in zip(docs[x:y], texts[x:y], strict=True):
                    ids = np.frombuffer(tokens(t) + last, dtype="<u4").astype(code)
                    n, row = len(ids), xxhash.xxh3_64_intdigest(t) - (1 << 63)
                    cuts = [0, *range(n - (n - 1) // size * size, n, size), n]
                    for i, (a, b) in enumerate(itertools.pairwise(cuts)):
                        keys.append(doc), pieces.append(i), starts.append(a), lengths.append(b - a), data.append(ids[a:b].tobytes()), rows.append(row)
            columns = [pa.array(keys, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(data, pa.binary()), pa.array(rows, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "row"])

    return small_batches(df).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, row long")


def wide_ids(column: pa.Array, code: str) -> pa.Array:
    """Ids of the given code as little-endian 32-bit numbers."""
    if code == "<u4":
        return column
    held = column.to_pylist()
    flat = np.frombuffer(b"".join(held), dtype=code).astype("<u4")
    ends = np.cumsum([0, *map(len, held)], dtype=np.int64) * 4 // np.dtype(code).itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def patterns(lengths: list[int], size: int, most: int = 3) -> list[tuple[int, ...]]:
    """Every multiset of 1 to most of the lengths (ascending in a pattern) that fills size exactly; pairs and triples only, as
    their number stays within size squared."""
    have = set(lengths)
    found = [(size,)] if size in have else []
    found += [(a, size - a) for a in lengths if 2 * a <= size and size - a in have]
    if most > 2:
        found += [(a, b, size - a - b) for a in lengths if 3 * a <= size for b in lengths if b >= a and a + 2 * b <= size and size - a - b in have]
    return found


def fit(found: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 300) -> dict[tuple[int, ...], float]:
    """Repeat counts x >= 0 of patterns that minimise |A x - histogram|, by accelerated projected gradients with restarts: a
    column of A holds a pattern's lengths. histogram: rows of each length from 0 to size."""
    if not found:
        return {}
    nowhere = len(histogram)
    where = np.full((len(found), max(map(len, found))), nowhere)
    for i, p in enumerate(found):
        where[i, : len(p)] = p
    target = np.append(histogram.astype(float), 0.0)
    flat, width = where.ravel(), where.shape[1]

    def used(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.repeat(x, width), minlength=nowhere + 1)
        out[nowhere] = 0
        return out

    pulled = lambda gap: gap[where].sum(axis=1)
    x = np.ones(len(found))
    for _ in range(20):  # the largest eigenvalue of A'A bounds the step
        x = pulled(used(x / np.linalg.norm(x)))
    bound = np.linalg.norm(x) * 1.02
    x = np.zeros(len(found))
    y, t = x, 1.0
    for _ in range(rounds):
        gap = target - used(y)
        up = np.maximum(0.0, y + pulled(gap) / bound)
        if (up - x) @ (y - up) > 0:  # overshot
            t, y = 1.0, x
            continue
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = up, up + (last - 1) / t * (up - x)
    return {found[i]: float(x[i]) for i in np.nonzero(x > 0)[0]}


def best_fit(counts: np.ndarray, size: int) -> Counter:
    """Best-fit decreasing over a histogram: the longest lengths first, each into the fullest open sequences that have room;
    sequences of one content are handled together."""
    done: Counter = Counter()
    open_: dict[int, Counter] = {}  # room -> contents -> how many
    for length in range(size, 0, -1):
        left = int(counts[length])
        for room in sorted(r for r in open_ if r >= length):
            while left and open_[room] and room >= length:
                content, n = next(iter(open_[room].items()))
                fits = room // length
                each = min(fits, left) if left < fits else fits
                take = min(n, left // each)
                open_[room][content] -= take
                if not open_[room][content]:
                    del open_[room][content]
                rest, full = room - each * length, content + (length,) * each
                (done if not rest else open_.setdefault(rest, Counter()))[full] += take
                left -= take * each
                if rest >= length and left == 0:
                    break
            if not left:
                break
        each = size // length
        for n, width in ((left // each, each), (1, left % each)):
            if n and width:
                rest = size - width * length
                (done if not rest else open_.setdefault(rest, Counter()))[(length,) * width] += n
    for contents in open_.values():
        done.update(contents)
    return done


def plan_packing(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold exactly counts[l] pieces of each length l: fitted patterns, rounded down and to what is
    there, the largest first, then best-fit decreasing for the residual pieces. Depends on the histogram alone (size numbers)."""
    left = counts.astype(np.int64).copy()
    fitted = fit(patterns([int(x) for x in np.nonzero(left)[0]], size), left)
    plan: Counter = Counter()
    for pattern, x in sorted(fitted.items(), key=lambda p: (-p[1], p[0])):
        need = Counter(pattern)
        n = min([int(x), *(int(left[v]) // c for v, c in need.items())])
        if n > 0:
            plan[pattern] += n
            for v, c in need.items():
                left[v] -= n * c
    plan.update(best_fit(left, size))
    return sorted(plan.items())


def assign(pieces: DataFrame, size: int = 1024, seed: int = 3, code: str = "<u4") -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, row, ids of the given code, and other columns), drop row and
    make ids 32-bit numbers: pieces of one length are ranked, and the rank says which repeat of which pattern takes the piece.
    pieces should be materialized, as it is read three times.

    Only the histogram (size numbers) is packed on the driver; the table of slots it gives back is bounded by the histogram too.
    The order within a length is a hash of key, piece and text, so it doesn't depend on files, and neither null nor repeated keys fall into
    one range of it; pieces that repeat more than a few hundred times are numbered too. Repeated rows are pieces of their own; an empty
    table gives none."""
    histogram = np.zeros(size + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most size rows
        histogram[row[0]] = row[1]
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken, sequences = Counter(), 0
    for pattern, n in plan_packing(histogram, size):
        at = 0
        for length in pattern:
            slots.setdefault(length, []).append((taken[length], sequences, at))
            taken[length] += n
            at += length
        sequences += n
    table = {k: tuple(np.array(c) for c in zip(*v, strict=True)) for k, v in slots.items()}
    alike = with_copies(pieces.withColumn("_digest", F.xxhash64("doc_id", "piece", "row")), "_digest")
    hashed = alike.withColumn("_hash", hash60(F.lit(seed), F.col("_digest"), F.col("_copy"))).drop("_digest", "_copy")
    ranked = rank_within(hashed, "length", "_hash", [F.col("doc_id"), F.col("piece"), F.col("row")], bucket_bits(int(histogram.sum())), "_rank").drop("_hash", "row")
    names = [c for c in ranked.columns if c != "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            lengths, ranks = own["length"].to_numpy(), own["_rank"].to_numpy()
            sequence, offset = np.empty(len(ranks), dtype=np.int64), np.empty(len(ranks), dtype=np.int64)
            for length in np.unique(lengths):
                mine = lengths == length
                first, base, at = table[int(length)]
                slot = np.searchsorted(first, ranks[mine], side="right") - 1
                sequence[mine], offset[mine] = base[slot] + ranks[mine] - first[slot], at[slot]
            own["ids"] = wide_ids(own["ids"], code)
            yield pa.RecordBatch.from_arrays([*(own[c] for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, widened(ranked, StructField("sequence_id", LongType()), StructField("offset", LongType()), without=["_rank"]))


def with_crc32(pieces: DataFrame) -> DataFrame:
    """Replace ids by their CRC-32."""
    return pieces.select(*[F.crc32("ids").alias("ids_crc32") if c == "ids" else c for c in pieces.columns])


def pack(df: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, key: str = "doc_id", text: str = "text", digest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All rows of df, tokenized, cut and packed into sequences of at most size tokens: one row a piece, with its ids, sequence_id
    and offset (gapless from 0). digest may replace the ids of the placed pieces; they are ranked and placed with their ids.

    A null text is empty (one piece with the end id); null keys pass through, other columns don't; repeated rows are packed as
    often as they occur; an empty table gives none. Until they are placed, ids take two bytes where the vocabulary allows it."""
    code = id_code(tokenizer, end)
    placed = assign(materialize(cut_pieces(df, tokenizer, size, end, key, text, code), "pieces"), size, code=code)
    return digest(placed) if digest else placed
