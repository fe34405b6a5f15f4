"""Comparing the rows of a bucket in blocks: units of two blocks are shuffled apart, and a task holds one unit at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, block: Column, blocks: Column, node: str = "node") -> DataFrame:
    """rows with block, left and right: every row goes to the units of its block with each of blocks (numbers from 0)."""
    placed = rows.withColumn("block", block.cast("int")).withColumn("_other", F.explode(blocks))
    return placed.withColumns({"left": F.least("block", "_other"), "right": F.greatest("block", "_other")}).drop("_other")


def pairs_within(cuts: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places (a, b), a before b, of all pairs of rows within units, which lie between the cuts: units of one size together, about
    `most` pairs at once, so that many small units cost no more than their pairs."""
    sizes, starts = np.diff(cuts), cuts[:-1]
    for k in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(int(k), 1)
        own = starts[sizes == k]
        step = max(1, most // len(i))
        for at in range(0, len(own), step):
            first = own[at : at + step, None]
            yield (first + i).ravel(), (first + j).ravel()


def each_unit(one: Callable[[pa.Table], Iterable[tuple]]) -> Callable[[pa.Table, np.ndarray], Iterable[tuple]]:
    """Work on several units by working on each of more than one row."""

    def work(t: pa.Table, cuts: np.ndarray) -> Iterator[tuple]:
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e - s > 1:
                yield from one(t.slice(s, e - s).combine_chunks())

    return work


def by_unit(units: DataFrame, group: Sequence[str], work: Callable[[pa.Table, np.ndarray], Iterable[tuple]], schema: str, names: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """What work gives for units, the rows that agree on the long or int columns group: it is handed a table of whole units and where they
    begin and end, and gives tuples of arrays, one a column of schema. Rows of a unit are brought together by a shuffle and a
    sort within partitions; memory holds a batch of rows, or one unit where that is larger. With order, columns that end with those of
    group, rows are dealt by ranges of them and come in their order."""
    group = list(group)

    def starts(t: pa.Table) -> np.ndarray:
        keys = np.stack([t[c].to_numpy() for c in group])
        return np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]]))

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        for columns in work(t, starts(t)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the unit that is not yet complete
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            last = int(starts(held)[-2]) if held.num_rows else 0
            if last:
                yield from done(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from done(held)

    parts = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = units.repartitionByRange(parts, *order).sortWithinPartitions(*order) if order else units.repartition(parts, *group).sortWithinPartitions(*group)
    return dealt.mapInArrow(run, schema)
