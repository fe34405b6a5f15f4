"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation says how far each can be trusted."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from marginalia.llm.common import materialize, widened
from marginalia.llm.words import numbered, slices, small_batches, texts

_SPACES, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"  # fixed: white space and symbols of the contract
COUNTS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64()}
_RUNS = re.compile(rb"[#*$%&|<>]+")
_ADDED = (*COUNTS, "votes", "quality", "base_failed", "kept")
#: A rule compares a ratio with its limits: beyond the second it votes bad (b), within the first good (g), and between them it
#: abstains (-). Where low is true, small ratios are bad. A ratio that is not a number abstains.
RULES: dict[str, tuple[float | None, float, bool]] = {
    "prose": (0.88, 0.75, True),  # small and non-ASCII letters among the visible bytes
    "symbols": (0.05, 0.30, False),  # symbols a word
    "marked": (0.03, 0.20, False),  # runs of symbols a word
    "capitals": (0.15, 0.50, False),  # capitals among the ASCII letters
    "shouting": (0.03, 0.30, False),  # exclamation marks a word
    "repeats": (0.10, 0.40, False),  # words in repeated three-word windows
    "echoes": (0.03, 0.30, False),  # words equal to the word before
    "variety": (0.40, 0.15, True),  # distinct among the words of a stretch of STRETCH words, on average over the text
    "lines": (0.10, 0.50, False),  # lines that repeat an earlier one
    "stretch": (10.0, 20.0, False),  # code points a word
}
STRETCH = 400


def _variety(w: np.ndarray, distinct: int) -> float:
    """The part of different words in whole stretches of STRETCH words, on average; of all words where there are fewer."""
    if len(w) < STRETCH:
        return distinct / len(w) if len(w) else float("nan")
    cut = np.sort(w[: len(w) // STRETCH * STRETCH].reshape(-1, STRETCH), axis=1)
    return float(((cut[:, 1:] != cut[:, :-1]).sum(axis=1) + 1).mean() / STRETCH)


def _measure(data: bytes) -> tuple[list[int], list[float]]:
    """The counts and the ratios of one text (UTF-8)."""
    words = data.split()
    n = len(words)
    byte = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    chars = int(byte[:128].sum() + byte[192:].sum() - byte[list(_SPACES)].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    again = 0
    if n > 3:
        # pairs are numbered anew before the third word joins, so the numbers stay small whatever the vocabulary
        pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
        _, at, times = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        hit = times[at] > 1
        if hit.any():
            mark = np.zeros(n, dtype=bool)
            for shift in range(3):
                mark[shift : n - 2 + shift] |= hit
            again = int(mark.sum())
    symbols = int(byte[list(_SYMBOLS)].sum())
    upper, lower, visible = int(byte[65:91].sum()), int(byte[97:123].sum()), len(data) - int(byte[list(_SPACES)].sum())
    per = lambda x, y: x / y if y else float("nan")
    ratios = [per(lower + int(byte[128:].sum()), visible), per(symbols, n), per(len(_RUNS.findall(data)) if symbols else 0, n), per(upper, upper + lower), per(int(byte[33]), n), per(again, n), per(int((w[1:] == w[:-1]).sum()), n), _variety(w, len(ids)), per(dup, len(lines)), per(chars, n)]
    return [n, chars, symbols, dup, again], ratios


def votes_of(ratios: np.ndarray) -> list[str]:
    """One letter a rule for each row of ratios."""
    out = np.full(ratios.shape, "-", dtype="U1")
    for i, (good, bad, low) in enumerate(RULES.values()):
        sign = -1 if low else 1
        out[sign * ratios[:, i] > sign * bad, i] = "b"
        if good is not None:
            out[sign * ratios[:, i] <= sign * good, i] = "g"
    return ["".join(row) for row in out]


def with_votes(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts of each whole text (null: none) and votes, one letter a rule. df must not have these columns."""
    names = df.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            measured = [_measure(t) for t in texts(batch.column(at))]
            counts = np.array([m[0] for m in measured], dtype=np.int64).reshape(-1, len(COUNTS))
            said = votes_of(np.array([m[1] for m in measured], dtype=float).reshape(-1, len(RULES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(said, pa.string())], [*names, *COUNTS, "votes"])

    return small_batches(numbered(df)).mapInArrow(run, widened(df, *(StructField(c, LongType()) for c in COUNTS), StructField("votes", StringType())))


class VoteModel:
    """How often each rule votes bad on good and on bad texts, and the part of good texts, fitted by expectation-maximisation to
    counts of vote patterns.

    Given a text's class its votes are taken to be independent, and to abstain says nothing. Rates of either class are estimated
    apart, so a rule that knows one kind of junk only, and votes good on all others, weighs little when it votes good and much
    when it votes bad. Beforehand a vote on a good text is believed to be bad in a hundredth of all cases, one on a bad text in
    half of them, and the part `good` of the texts to be good, with the weight of a hundredth of the texts; a rule is never taken to be worse
    than chance, which keeps good and bad what they are called."""

    def __init__(self, patterns: dict[str, int], rounds: int = 200, good: float = 0.9):
        keys = sorted(patterns)
        n = np.array([patterns[k] for k in keys], dtype=float)
        votes = self._signs(keys)
        total, bad, cast = n.sum(), votes < 0, votes != 0
        weight = 5.0 + 0.01 * total
        self.good, self.on_good, self.on_bad = good, np.full(len(RULES), 0.01), np.full(len(RULES), 0.5)
        for _ in range(rounds):
            p = self._posterior(votes)
            was = np.concatenate([self.on_good, self.on_bad])
            rate = lambda share, believed: ((n * share) @ bad + believed * weight) / ((n * share) @ cast + weight)
            self.on_good = np.clip(rate(p, 0.01), 1e-4, 0.4)
            self.on_bad = np.clip(rate(1 - p, 0.5), self.on_good, 0.999)
            self.good = float(np.clip((n @ p + good * weight) / (total + weight), 0.5, 0.999))
            if np.abs(was - np.concatenate([self.on_good, self.on_bad])).max() < 1e-10:
                break

    @staticmethod
    def _signs(patterns: list[str]) -> np.ndarray:
        return np.array([[{"g": 1, "b": -1, "-": 0}[c] for c in k] for k in patterns], dtype=int).reshape(len(patterns), len(RULES))

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        said_good, said_bad = np.log((1 - self.on_good) / (1 - self.on_bad)), np.log(self.on_good / self.on_bad)
        odds = np.log(self.good / (1 - self.good)) + (votes > 0) @ said_good + (votes < 0) @ said_bad
        return 1 / (1 + np.exp(-odds))

    def quality(self, pattern: str) -> float:
        """The posterior probability that a text with these votes is good."""
        return float(self._posterior(self._signs([pattern]))[0])

    def accuracy(self) -> dict[str, float]:
        """How often a vote of each rule is right."""
        return dict(zip(RULES, map(float, self.good * (1 - self.on_good) + (1 - self.good) * self.on_bad), strict=True))


def fit_votes(voted: DataFrame) -> VoteModel:
    """Fit to all rows of voted. What reaches the driver is a count for each vote pattern, at most 3 to the number of rules."""
    return VoteModel({r[0]: r[1] for r in voted.groupBy("votes").count().collect()})


def judged(voted: DataFrame, model: VoteModel, patterns: DataFrame, least: float = 0.5) -> DataFrame:
    """voted with quality (posterior probability of a good text), base_failed and kept. patterns: the votes that occur."""
    rows = [(r[0], model.quality(r[0])) for r in patterns.select("votes").distinct().collect()]
    table = voted.sparkSession.createDataFrame(rows, "votes string, quality double")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    out = voted.join(F.broadcast(table), "votes", "left")  # at most 3 to the number of rules
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.coalesce("quality", F.lit(0.0)) >= least))


def judge(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """Every row of df, without its text, with the counts, votes, quality, base_failed and kept.

    kept is false for texts of fewer than 50 words, for those with more than half of their words in repeated three-word windows,
    and for those whose posterior probability of being good is below least. Null, empty and blank texts have no words and fail.
    Repeated rows vote as often as they occur; an empty table gives none; other columns pass through, but
    for those whose names are added here."""
    voted = materialize(with_votes(df.drop(*_ADDED), text).drop(text), "votes")
    return judged(voted, fit_votes(voted), voted, least)


def good_rows(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df that judge keeps, with df's columns. Votes are cast once, and written to the shared folder with the rows."""
    own = {c: f"_own_{c}" for c in df.columns if c in _ADDED}
    voted = materialize(with_votes(df.withColumnsRenamed(own), text), "voted")
    kept = judged(voted, fit_votes(voted), voted, least).filter("kept")
    return kept.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in df.columns])
