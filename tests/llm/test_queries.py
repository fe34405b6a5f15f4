"""Every opN query on the driver's tables: against its SQL where there is one, against plain Python or its own law where not."""

import base64
import binascii
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marginalia.llm import packing, pseudonyms, quality, queries
from tests.llm.test_operators import brute_counts

TABLES = [d for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01") if os.path.isdir(d)]
pytestmark = pytest.mark.skipif(not TABLES, reason="no tables here")


def rows(table):
    table = table.select(sorted(table.column_names))
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r.values())) for r in table.to_pylist())


@pytest.mark.parametrize("folder", TABLES)
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name, folder):
    db = pytest.importorskip("duckdb").connect()
    for file in os.listdir(folder):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{file}')")
    got = queries.QUERIES[name](spark, folder).toArrow()
    assert got.num_rows and rows(got) == rows(db.execute(queries.ORACLES[name]).to_arrow_table())


def test_op2_judges_by_the_rules_of_its_contract(spark, tmp_path):
    db = pytest.importorskip("duckdb").connect()
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = [f"http://{host}{name}/{path}{tail}" for name, path in (r.split("/", 1) for r in rules) for host in ("", "WWW.") for tail in ("", "1?q", "9/x#f")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op2_url_reputation(spark, str(tmp_path)).toArrow()
    for r in got.to_pylist():
        fits = [x for x in rules if (r["host"] == x.split("/")[0] or r["host"].endswith("." + x.split("/")[0])) and r["path"].startswith("/" + x.split("/", 1)[1])]
        assert (r["rule"], r["verdict"]) == (max(fits, key=len), rules[max(fits, key=len)]), urls[r["page_id"]]
    assert {r["rule"] for r in got.to_pylist()} == set(rules)
    for name in ("pages", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert rows(got) == rows(db.execute(queries.ORACLES["op2_url_reputation"]).to_arrow_table())


@pytest.fixture(scope="module", params=TABLES)
def folder(request):
    return request.param


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def test_op1_gives_every_document_back(spark, folder, texts):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    whole, got, places = tokenizers.Tokenizer.from_file(path), defaultdict(list), defaultdict(list)
    for r in queries.op1_pattern_packing(spark, folder).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    ids = {k: [*whole.encode(r.text or "", add_special_tokens=False).ids, 2] for k, r in texts.items()}
    for k, own in ids.items():
        n = len(own)
        cuts = [0, *range(n - (n - 1) // 1024 * 1024, n, 1024), n]
        want = [(i, a, b - a, zlib.crc32(np.array(own[a:b], dtype="<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert sorted(got[k]) == want
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(map(len, ids.values())) // 1024) * 1.03 + 2


def test_op3_equals_plain_python(spark, folder, texts):
    change = pseudonyms.Pseudonyms(b"fixture")
    for r in queries.op3_pii_pseudonyms(spark, folder).collect():
        text = texts[r.doc_id].text
        new, found = (None, []) if text is None else change(text)
        assert (r.text, r.n_pii, r.kinds) == (new, len(found), ",".join(sorted({f[0] for f in found})))
        # what is not replaced is the same, and nothing that a check confirms is left
        if text is not None:
            kept_old, kept_new, at = text, [], 0
            for _, start, end in found:
                kept_new.append(new[at:start])
                at = end
            kept_new.append(new[at:])
            for piece in kept_new:
                place = kept_old.find(piece)
                assert place >= 0
                kept_old = kept_old[place + len(piece) :]


def test_op6_cuts_an_interleaved_order(spark, folder, texts):
    got = {r.doc_id: r for r in queries.op6_interleaved_shards(spark, folder).collect()}
    assert set(got) == set(texts)
    sizes = Counter(r.shard for r in got.values())
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    order = sorted(got.values(), key=lambda r: (r.shard, r.slot))
    for shard in sizes:
        assert [r.slot for r in order if r.shard == shard] == list(range(sizes[shard]))
    for k, r in got.items():
        data = (texts[k].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, binascii.crc32(data), "rows", None)
    # plain ranking: the i-th row of a source of n lies at (i + 1/2) / n of the whole order, ties by source
    total = Counter(texts[r.doc_id].source for r in order)
    seen, places = Counter(), []
    for r in order:
        source = texts[r.doc_id].source
        places.append(((2 * seen[source] + 1) / (2 * total[source]), (source is None, source)))
        seen[source] += 1
    assert places == sorted(places)


def test_op8_counts_and_verdicts(spark, folder, texts):
    got = {r.doc_id: r for r in queries.op8_weak_supervision(spark, folder).collect()}
    measured = {k: quality._measure((r.text or "").encode()) for k, r in texts.items()}
    votes = dict(zip(measured, quality.votes_of(np.array([m[1] for m in measured.values()])), strict=True))
    model = quality.VoteModel(Counter(votes.values()))
    for k, r in got.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[k].text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.votes == votes[k] and r.quality == pytest.approx(model.quality(votes[k]))
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_op10_digests(spark, folder):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in queries.op10_warc_revisits(spark, folder).collect():
        assert (r.payload_bytes, r.payload_digest) == (len(pages[r.page_id]), base64.b32encode(hashlib.sha1(pages[r.page_id]).digest()).decode())


def test_op12_equals_the_library(spark, folder, texts):
    tiktoken, own = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    with open(own.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=own.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda data: hashlib.sha256(data).hexdigest()
    got = queries.op12_byte_bpe(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id].text or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode()))


def test_op3_by_a_plain_search_of_its_own(spark, folder, texts):
    """Values found by other patterns and checks than the operator's: each is replaced by one of its format that passes the same check, equal ones
    by equal ones and different ones by different ones, over all documents."""

    def luhn(s):
        digits = [int(c) for c in s if c.isdigit()]
        return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0

    def iban(s):
        plain = s.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1

    ssn = lambda s: s[:3] not in ("000", "666") and s < "900" and s[4:6] != "00" and s[7:] != "0000"
    kinds = {
        "card": (r"(?<![\d\-. ])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\d]|[ .\-]\d)", luhn), "email": (r"(?<![\w.+\-])[A-Za-z0-9]+(?:[.+\-][A-Za-z0-9]+)*@[a-z0-9\-]+(?:\.[a-z0-9\-]+)+", lambda s: True),
        "ssn": (r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)", ssn), "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){3,7}(?! ?[A-Za-z0-9])", iban)}
    maps, seen = defaultdict(dict), Counter()
    for r in queries.op3_pii_pseudonyms(spark, folder).collect():
        for kind, (pattern, valid) in kinds.items():
            old, new = ([m[0] for m in re.finditer(pattern, t or "") if valid(m[0])] for t in (texts[r.doc_id].text, r.text))
            assert len(old) == len(new), (kind, old, new)
            for a, b in zip(old, new, strict=True):
                assert a != b and len(a) == len(b) and [c.isalnum() for c in a] == [c.isalnum() for c in b]
                assert maps[kind].setdefault(a, b) == b
                seen[kind] += 1
    assert seen["email"] >= 3 and all(len(set(m.values())) == len(m) for m in maps.values())
