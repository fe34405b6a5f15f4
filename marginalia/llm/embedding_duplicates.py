"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, reranking with the original vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField

from marginalia.llm.blocks import by_unit, dealt, pairs_within
from marginalia.llm.common import lookup, materialize, spread_join, widened
from marginalia.llm.components import components

#: Vectors that the rotations are learnt from at most, the smallest by hash; every vector is indexed.
SAMPLE = 20_000
#: 64-bit words of a code, each from rotations of its own, and bits of a code.
WORDS = 4
BITS = 64 * WORDS
#: Part of the trial pairs, at the threshold and nearer, that the tables must bring together; trial pairs; tables at most.
SEEN, TRIALS, MOST = 0.98, 12_000, 128
#: Rows of a bucket that are compared in one piece; larger buckets are cut into blocks, and pairs of blocks are compared.
BLOCK = 1024


def learn_rotation(sample: np.ndarray, bits: int = 64, rounds: int = 30, seed: int = 0, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of balanced binary codes: principal directions of the centred sample, turned by the rotation that
    brings them nearest to the corners of the cube, found by alternating between corners and rotation. Not centred: mean 0."""
    mean = sample.mean(axis=0) if len(sample) and centred else np.zeros(sample.shape[1])
    v = sample - mean
    bits = min(bits, sample.shape[1])
    _, axes = np.linalg.eigh(v.T @ v)
    axes = axes[:, ::-1][:, :bits]
    v = v @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (left @ right).T
    return mean, axes @ turn


def learn_code(sample: np.ndarray, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to BITS columns): as many rotations, each learnt from another start, as the bits need."""
    mean, first = learn_rotation(sample, centred=centred)
    many = -(-BITS // first.shape[1])
    return mean, np.concatenate([first, *(learn_rotation(sample, seed=i, centred=centred)[1] for i in range(1, many))], axis=1)[:, :BITS]


def trial_pairs(sample: np.ndarray, least: float, seed: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors u of the sample, for each a unit vector near it, and the pair's group: at a cosine of least, half way from there
    to 1, or almost 1; in any direction, or towards another vector of the sample."""
    draw = np.random.default_rng(seed)
    group = np.arange(TRIALS) % 6
    u = sample[draw.integers(0, len(sample), TRIALS)]
    w = np.where(group[:, None] % 2 == 0, sample[draw.integers(0, len(sample), TRIALS)], draw.standard_normal(u.shape))
    w = w - (w * u).sum(axis=1, keepdims=True) * u
    length = np.sqrt((w * w).sum(axis=1, keepdims=True))
    w = np.where(length > 1e-9, w / np.where(length > 1e-9, length, 1.0), 0.0)
    near = np.array([least, (1 + least) / 2, 1 - (1 - least) / 1000])[group // 2][:, None]
    return u, near * u + np.sqrt(1 - near * near) * w, group


def plan_tables(apart: np.ndarray, group: np.ndarray, rows: int, seed: int = 1) -> tuple[list[np.ndarray], float]:
    """The bits that each table compares, and the part of the trial pairs that agree in some table, in the group that does worst.
    apart: which bits of the trial pairs differ. A table takes about log2(rows) bits, so that buckets stay small however many rows
    there are; tables are added, from one order of the bits after another, until SEEN of each group is met; if MOST tables don't
    reach it, they take fewer bits."""
    width = int(np.clip(np.ceil(np.log2(max(rows, 2))), 4, 31))
    while True:
        draw, met, tables = np.random.default_rng(seed), np.zeros(len(apart), dtype=bool), []
        while len(tables) < MOST:
            order = draw.permutation(BITS)
            for i in range(0, min(BITS - width + 1, (MOST - len(tables)) * width), width):
                tables.append(order[i : i + width])
                met |= ~apart[:, tables[-1]].any(axis=1)
                worst = min(met[group == g].mean() for g in range(6))
                if worst >= SEEN:
                    return tables, worst
        if width <= 4:
            return tables, worst
        width -= 2


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length in double precision, padded with zeros to dim, and which rows are valid: not null, not zero, and
    without null or non-finite components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=float)  # null components are nan
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    with np.errstate(all="ignore"):
        scale = np.abs(out).max(axis=1, initial=0)
        valid = np.isfinite(scale) & (scale > 0) & np.isfinite(out).all(axis=1)
        out = np.where(valid[:, None], out / np.where(valid, scale, 1.0)[:, None], 0.0)  # so that no square overflows
        norm = np.sqrt((out * out).sum(axis=1))
        out /= np.where(valid, norm, 1.0)[:, None]
    return out, valid


class Index:
    """What a fit to the sample gives: the code, the tables, their masks over a code's words, and how many bits a pair at the
    threshold may differ in (the most that trial pairs do, and an eighth of all bits more)."""

    def __init__(self, sample: np.ndarray, rows: int, least: float):
        self.dim = sample.shape[1]
        sample = sample if len(sample) else np.eye(1, self.dim)
        held = len(sample) // 5 if len(sample) >= 100 else 0  # trial pairs lie about vectors that the rotations were not learnt from
        u, v, group = trial_pairs(sample[:held] if held else sample, least)
        sample = sample[held:]
        for centred in (True, False):  # vectors about their mean are told apart by planes through the origin only
            self.mean, self.project = learn_code(sample, centred)
            apart = self.bits(u) != self.bits(v)
            self.tables, met = plan_tables(apart, group, rows)
            if met >= SEEN:
                break
        self.masks = np.array([[sum(1 << int(b % 64) for b in t if b // 64 == w) for w in range(WORDS)] for t in self.tables], dtype=np.uint64)
        self.far = int(apart.sum(axis=1).max()) + BITS // 8

    def bits(self, u: np.ndarray) -> np.ndarray:
        return (u - self.mean) @ self.project > 0

    def words(self, bits: np.ndarray) -> np.ndarray:
        """The bits of each row, 64 in a word."""
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")

    def buckets(self, bits: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table; tables don't share buckets."""
        return np.stack([(bits[:, t] @ (np.int64(1) << np.arange(len(t), dtype=np.int64))) + (np.int64(i) << 32) for i, t in enumerate(self.tables)], axis=1)


_CODE = [f"code{w}" for w in range(WORDS)]


def _coded(df: DataFrame, index: Index) -> DataFrame:
    """The rows (vec_id, vector) with digest (of the direction), valid, code words and buckets. Invalid rows have digests of
    their own."""
    added = [StructField("digest", BinaryType()), StructField("valid", BooleanType()), *(StructField(c, LongType()) for c in _CODE), StructField("buckets", ArrayType(LongType()))]
    schema = widened(df, *added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, valid = unit_vectors(batch.column(1), index.dim)
            bits = index.bits(u)
            words, buckets = index.words(bits).view(np.int64), index.buckets(bits)
            digest = [xxhash.xxh128_digest(r.tobytes()) if ok else b"?%r" % i for r, ok, i in zip(u, valid, batch.column(0).to_pylist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * len(index.tables), pa.int32()), pa.array(buckets.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(valid), *(pa.array(words[:, w]) for w in range(WORDS)), lists], schema.fieldNames())

    return df.mapInArrow(run, schema)


_UNIT = ("bucket", "left", "right")


def _near(t: pa.Table, cuts: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows within units whose codes are near enough, and that no earlier table brings together."""
    code = np.stack([t[c].to_numpy() for c in _CODE], axis=1).view(np.uint64)
    block, table, across = t["block"].to_numpy(), t["bucket"].to_numpy() >> 32, t["left"].to_numpy() != t["right"].to_numpy()
    found = [(np.empty(0, dtype=np.int64),) * 2]
    for a, b in pairs_within(cuts):
        apart = np.zeros(len(a), dtype=np.uint16)
        for w in range(WORDS):
            apart += np.bitwise_count(code[a, w] ^ code[b, w])
        near = (apart <= index.far) & (~across[a] | (block[a] != block[b]))  # two blocks: each row against the rows of the other
        a, b = a[near], b[near]
        for s in range(0, len(a), 1 << 14):
            x, y = a[s : s + (1 << 14)], b[s : s + (1 << 14)]
            agree = (((code[x] ^ code[y])[:, None, :] & index.masks[None]) == 0).all(axis=2)
            new = agree.argmax(axis=1) == table[x]
            found.append((x[new], y[new]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _flagged(units: DataFrame, index: Index) -> DataFrame:
    """The rows of units, without codes, that are in some pair to rerank. Pairs are not emitted."""

    def work(t: pa.Table, cuts: np.ndarray) -> Iterable[tuple]:
        hit = np.unique(np.concatenate(_near(t, cuts, index)))
        if len(hit):
            yield tuple(t[c].to_numpy()[hit] for c in (*_UNIT, "block", "node"))

    return by_unit(units, _UNIT, work, "bucket long, left int, right int, block int, node long", (*_UNIT, "block", "node"))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that it reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _reranked(units: DataFrame, index: Index, least: float) -> DataFrame:
    """(node, n, root): for the rows of each unit that are linked there, the linked vectors and the smallest row reached. A pair
    counts in the first table that brings it together, so neither pairs nor their duplicates are ever emitted."""

    def work(t: pa.Table, cuts: np.ndarray) -> Iterable[tuple]:
        ids, many = t["node"].to_numpy(), t["many"].to_numpy()
        u, _ = unit_vectors(t["vector"], index.dim)
        a, b = _near(t, cuts, index)
        step = max(1, (1 << 22) // index.dim)
        linked = np.concatenate([(u[a[s : s + step]] * u[b[s : s + step]]).sum(axis=1) >= least for s in range(0, len(a), step)] or [np.empty(0, dtype=bool)])
        a, b = a[linked], b[linked]
        if not len(a):
            return
        n = np.bincount(a, many[b], len(ids)) + np.bincount(b, many[a], len(ids))
        hit, order = np.flatnonzero(n), np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        root = ids[order][_forest(len(ids), rank[a], rank[b])][rank]
        yield ids[hit], n[hit].astype(np.int64), root[hit]

    return by_unit(units, _UNIT, work, "node long, n long, root long", ("node", "n", "root"))


def near_embeddings(df: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row of df: vec_id, n_links (other rows at a cosine of at least `least` that the index finds), component_id (the smallest
    key reachable over links) and kept.

    Cosines are computed in double precision from the original vectors, so no link is false. Vectors that are null, empty, zero,
    or hold null or non-finite components are linked with nothing; shorter vectors count as padded with zeros. Rows with one
    key are one node; keys must be whole numbers or cast to them; a null key keeps a null component. Other columns, labels too,
    are ignored; an empty table gives none.

    Vectors of one direction form a class and go on as one member with its count. Members meet in the buckets of the tables; the
    bits of a table grow with the rows, and the number of tables with what trial pairs need. A bucket of more than BLOCK members is
    cut into blocks by hash. First the codes alone (60 bytes a row and table) tell which members have a near code in their
    bucket; only these are met again with their vectors."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    size, n = rows.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    drawn = rows.filter("vector is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()["vector"]
    sample, valid = unit_vectors(drawn, max(1, size or 1))
    index = Index(sample[valid], n, least)
    coded = materialize(_coded(rows, index), "codes")
    classes = coded.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"))
    classes = materialize(classes, "classes")
    first = classes.select(F.col("rep").alias("vec_id"), "digest", "many")
    found = coded.filter("valid and vec_id is not null").join(first, ["vec_id", "digest"]).withColumnRenamed("vec_id", "node")
    members = materialize(found.select("node", "digest", *_CODE, "buckets").dropDuplicates(["node", "digest"]), "members")
    named = members.select("node", *_CODE, F.explode("buckets").alias("bucket"))
    crowded = materialize(named.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 2 * BLOCK).select("bucket", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks")), "crowded")
    placed = lookup(named, crowded, "bucket", F.col("node")).withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    units = dealt(placed, F.pmod(F.xxhash64("node"), F.col("_blocks")), F.sequence(F.lit(0), F.col("_blocks") - 1)).drop("_blocks")
    flagged = materialize(_flagged(units, index), "flagged")
    wanted = flagged.select("node").distinct()
    vectors = materialize(found.select("node", "digest", "many", *_CODE, "vector").join(wanted, "node", "left_semi").dropDuplicates(["node", "digest"]).drop("digest"), "vectors")
    links = materialize(_reranked(flagged.join(vectors, "node"), index, least), "links")
    reach = components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    counts = links.groupBy("node").agg(F.sum("n").alias("_n")).withColumnRenamed("node", "rep")
    known = materialize(classes.join(counts, "rep", "left").join(reach, "rep", "left"), "known")
    placed = spread_join(coded.select("vec_id", "digest", "valid"), known, "digest", "many", F.xxhash64("vec_id"))
    total = F.when(F.col("valid"), F.coalesce("_n", F.lit(0)) + F.col("many") - 1).otherwise(0).cast("long")
    out = placed.select("vec_id", total.alias("n_links"), F.when(F.col("valid"), F.coalesce("component", "rep")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
