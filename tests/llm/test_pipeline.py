"""The pipeline against plain Python, stage by stage, on a small table with copies, junk, personal data and odd rows."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from marginalia.llm import mixing, packing, pseudonyms, quality
from tests.llm.test_operators import DOCS, brute_near, prose, vocabulary

tokenizer = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw, words = random.Random(8), vocabulary()
    rows = [(i, prose(draw, words, draw.randint(60, 300)), "en", f"src{i % 3}", 0) for i in range(60)]
    rows += [(60 + i, " ".join(f"{w.upper()}!!" for w in rows[i][1].split()), "en", "src1", 0) for i in range(8)]
    rows += [(80 + i, rows[i][1] + " tail", "en", "src0", 0) for i in range(5)] + [(90 + i, rows[7][1], "en", "src2", 0) for i in range(3)]
    rows += [(100, rows[9][1].replace(" ", " mail a.1@b.org ", 1), "en", None, 0), (101, None, None, None, None), (102, "", "en", "src0", 0), (103, "too short", "en", "src0", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_in_a_row(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        steps[name] = (before.collect(), docs.collect(), docs.columns)
    assert list(steps) == ["quality_rules", "near_duplicate_removal", "pii_pseudonyms", "source_mixing", "best_fit_packing"]
    assert all(s[2] == ["doc_id", "text", "lang", "source", "n_chars"] for s in list(steps.values())[:-1])

    measured = {i: quality._measure((t or "").encode()) for i, t in texts.items()}
    import numpy as np

    votes = dict(zip(measured, quality.votes_of(np.array([m[1] for m in measured.values()])), strict=True))
    model = quality.VoteModel(Counter(votes.values()))
    kept = {i for i in texts if measured[i][0][0] >= 50 and 2 * measured[i][0][4] <= measured[i][0][0] and model.quality(votes[i]) >= 0.5}
    assert {r.doc_id for r in steps["quality_rules"][1]} == kept and set(range(60)) <= kept and not kept & {*range(60, 68), 101, 102, 103}

    rows = steps["near_duplicate_removal"]
    assert {r.doc_id for r in rows[1]} == {d for d, c in brute_near(rows[0], 5, 80)[1].items() if d == c} and not {r.doc_id for r in rows[1]} & set(range(80, 93))

    change = pseudonyms.Pseudonyms(b"fixture")
    rows = steps["pii_pseudonyms"]
    assert {r.doc_id: r.text for r in rows[1]} == {r.doc_id: change(r.text)[0] for r in rows[0]}

    rows = steps["source_mixing"]
    sizes = Counter()
    for r in rows[0]:
        sizes[r.source] += len(r.text.split())
    copies = Counter(r.doc_id for r in rows[1])
    for source, size in sizes.items():
        weight = dict(zip(sorted((s for s in sizes if s is not None)), (5, 2, 1), strict=False)).get(source, 5)  # null is the fourth source
        rate = [copies[r.doc_id] for r in rows[0] if r.source == source]
        assert max(rate) - min(rate) <= 1 and max(rate) <= 3 and weight and size

    rows = steps["best_fit_packing"]
    encode = packing.TokenBytes(tokenizer)
    held = Counter()
    for r in rows[1]:
        held[r.doc_id] += r.length
    assert held == Counter({d: n * (len(encode(next(r.text for r in rows[0] if r.doc_id == d))) // 4 + 1) for d, n in copies.items()})
    places = {}
    for r in rows[1]:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 1024 and [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:i]) for i in range(len(p))] for p in places.values())


def test_run_joins_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    plan = mixing.mixing_plan(spark.read.parquet(f"{folder}/documents.parquet"))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and 0 < got.count() and {r.doc_id for r in got.collect()} <= {r.doc_id for r in plan.collect()}


def test_sequences_hold_the_ids_of_every_copy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 20 or doc_id > 100")
    docs = docs.unionByName(docs.filter("doc_id < 5"))
    encode, rows = packing.TokenBytes(tokenizer), docs.collect()
    whole, got = Counter(), Counter()
    for r in rows:
        whole[r.doc_id] += len(encode(r.text or "")) // 4 + 1
    for r in corpus_pipeline.best_fit_packing(spark, docs, folder).collect():
        ids = encode(next(d.text for d in rows if d.doc_id == r.doc_id) or "") + (2).to_bytes(4, "little")
        assert bytes(r.ids) == ids[4 * r.start : 4 * (r.start + r.length)] and len(r.ids) == 4 * r.length
        got[r.doc_id] += r.length
    assert got == whole


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_odd_rows_defined(spark):
    """Nulls in every column, repeated rows, ties and a very long text go through all stages."""
    draw, words = random.Random(4), vocabulary(900)
    long, usual = prose(draw, words, 60_000), prose(draw, words, 80)
    docs = spark.createDataFrame([(1, long, "en", "a", 1), (2, usual, None, None, None), (2, usual, None, None, None), (None, prose(draw, words, 90), "en", "a", 2), (None, None, None, None, None), (3, "", "", "", 0)], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = Counter((r.doc_id, len(r.text)) for r in docs.collect())
    assert {k for k, _ in left} <= {1, 2, None} and (1, len(long)) in left
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter({k: sum(n for (d, _), n in left.items() if d == k) for k in {d for d, _ in left}})
