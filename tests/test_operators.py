"""The library's own operators on small rows, edge cases first."""

import io
import random
import time
import zipfile
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from marginalia.functions import citations, fragments, keys, references, shortforms, similarity, text
from marginalia.operators import audit, boundaries, chains, inventory, journals, links, lookup, quotes, scopes, sequences, splitting, structure
from marginalia.operators import registry as reg
from marginalia.sources import judgments, readers, shared, sinks


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}").select("i", f(F.col("c")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def most_rows(df):
    """The most rows that an operator of df's plan gives when it is run."""
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan(), 0

    def walk(node):
        nonlocal most
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        inner = [node.children().apply(i) for i in range(node.children().size())]
        kind = node.getClass().getSimpleName()
        inner += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        for n in inner:
            walk(n)

    walk(plan)
    return most


# ---- keys and texts


def test_citation_keys_keep_marks_between_digits(spark):
    got = column(spark, ["NB Reg 82-73, r 4.1", "NB Reg 82-73, r 41", "4.1.2", "２０２３ SCC 17", "[1988] 2 S.C.R. 833", None], keys.citation_key)
    assert got == ["nbreg82dash73r4dot1", "nbreg82dash73r41", "4dot1dot2", "2023scc17", "19882scr833", None]
    assert column(spark, ["2023 SCC 17 at para 5", "RSC 1985, c C-46, s 7", "[1962] SCR 746 at 763"], keys.broad_citation_key) == ["2023scc17", "rsc1985cc46", "1962scr746"]


def test_name_keys(spark):
    got = column(spark, ["R. v. A.B.", "Smith-Jones / Canada (AG)", "  Roe  v Wade "], keys.name_key)
    assert got[1:] == ["smith jones canada ag", "roe v wade"] and got[0].startswith("r v")
    assert column(spark, ["a, b, c"], keys.comma_tails) == [["a, b, c", "b, c", "c"]]


def test_comparable_and_containment(spark):
    pairs = [("“The long‐term plan.”", "Said: the long-term plan, then"), ("art", "artful dodger"), ("art", "the art of"), ("", "x"), ("a b", "xa by")]
    rows = spark.createDataFrame(pairs, "q string, s string").select(text.contained(text.comparable(F.col("q")), text.comparable(F.col("s"))).alias("r")).collect()
    assert [r.r for r in rows] == [True, False, True, False, True]


def test_plausible_thresholds(spark):
    pairs = [("cat", "the cat"), ("cat dog bird", "cat bird"), ("cat dog bird", "cat"), ("of the", "of the"), ("a1 a2 a3 a4 a5 a6", "a1 a2"), ("a1 a2 a3 a4 a5 a6", "a1 a2 a3")]
    rows = spark.createDataFrame(pairs, "q string, s string").select(text.plausible(F.col("q"), F.col("s")).alias("r")).collect()
    assert [r.r for r in rows] == [True, True, False, True, False, True]  # without content words nothing speaks against a quotation


def test_inline_quotes(spark):
    assert column(spark, ['a "b c" d “e” f "" g “ ” h "open', None], text.inline_quotes) == [["b c", "e"], None]
    assert column(spark, ["# Head\nA **bold** x ..... 3 , y ( z )"], text.source_text) == ["Head\nA bold x 3, y (z)"]


# ---- references


def test_reference_detectors(spark):
    assert column(spark, ["Smith, supra note 12 at 4", "supra n 3; supra note 9", "supra nn 4", "ibid"], references.supra_note) == [12, 9, 4, None]
    assert column(spark, ["supra n 3; supra note 9"], references.supra_notes) == [[3, 9]]
    assert column(spark, ["See also Smith, supra note 1", "Ibid"], references.supra_hint) == ["Smith", ""]
    assert column(spark, ["1,3,30-35", "12-10, x", "10-12", None], references.id_list) == [[1, 3, 30, 31, 32, 33, 34, 35], [10, 11, 12], [10, 11, 12], []]


def test_pinpoints(spark):
    assert column(spark, ["[1962] SCR 746 at 763–64", "at 5, 9-11", "pp 10-250", "none"], references.page_pinpoints) == [[763, 764], [5, 9, 10, 11], [10], []]
    assert column(spark, ["2020 SCC 1 at para 4, paras 9", "s 7 and section 16.1"], references.fragments) == [["par4", "par9"], ["sec7", "sec16.1"]]
    rows = spark.createDataFrame([("statute",), ("case",), ("gazette",)], "k string").select(references.guarded_fragments(F.col("k"), F.array(F.lit("par1"), F.lit("sec2"))).alias("r")).collect()
    assert [r.r for r in rows] == [["sec2"], ["par1"], []]
    pairs = spark.createDataFrame([(763, 64), (99, 2), (5, 9), (198, 205)], "a long, b long").select(references.range_end(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in pairs] == [764, 102, 9, 205]


def test_urls_and_kinds(spark):
    assert column(spark, ["https://x.org/2023/2023scc17/2023scc17.html", "https://x.org/a"], references.url_citation) == ["2023 SCC 17", ""]
    assert column(spark, ["2023 SCC 17", "RSC 1985, c C-46", "“Title” (2001) 3 J 4", "https://a.b", "book"], references.kind) == ["case", "statute", "journal", "website", "other"]
    rows = spark.createDataFrame([("u#x", 12, 10, None), ("u", 9, 10, None), ("u", 9, 10, 4)], "u string, p int, f int, m int").select(references.page_link(F.col("u"), F.col("p"), F.col("f"), F.col("m")).alias("r")).collect()
    assert [r.r for r in rows] == ["u#page=3", "u", "u#page=4"]


# ---- similarity


def test_matching_blocks_keep_operand_order(spark):
    assert SequenceMatcher(None, "tide", "diet").ratio() == 0.25
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x")], "q string, t string").select(similarity.title_ratio("q", "t").alias("r")).collect()
    assert [r.r for r in rows] == [0.25, 0.5, None]
    assert similarity.matched_share("the court has the final say", "the court has final say") == 1.0 and similarity.matched_share("a", "") == 0.0


def test_corrected_quotes(spark):
    rows = spark.createDataFrame([("the court has the final say", "the court has final say"), ("the court has the final say", "the high court has the last say"), ("x", "y"), ("x", "")], "s string, q string").select(similarity.corrected_quote("s", "q").alias("r")).collect()
    assert [r.r for r in rows] == ["the court has ... final say", "the [high] court has the [last] say", "[y]", "x"]
    assert similarity.corrected("the test was run by all of them", "the testing was run ... by [A]ll") == "the test[ing] was run ... by [A]ll"
    assert similarity.corrected("“The court held”, she said", "the court held") == "[t]he court held"
    assert similarity.fragment("[12] In the event of doubt the tribunal shall hear all. " + "Other words follow. " * 30, "in the event of doubt a tribunal shall hear all") == "In the event of doubt the tribunal shall hear all"
    assert similarity.fragment("nothing that is alike at all", "x y") == ""


def test_tokens_and_exact_endings():
    assert similarity.tokens("It's test[ing] [A]bc ... co-op “x”.") == ("It's", "test[ing]", "[A]bc", "...", "co", "-", "op", "“", "x", "”", ".")
    assert [similarity.canonical(t) for t in ("[T]he", "“", "’", "–", "Word", "A-")] == ["the", '"', "'", "-", "word", "A-"]
    assert similarity.exact_but_endings("they test all things", "test[ing] all things") and similarity.exact_but_endings("testing all", "test[ing] all") and not similarity.exact_but_endings("tests all", "test[ing] all")
    assert similarity.matched_share("they test all things", "test[ing] all things.") == 1.0


def test_whole_sources_are_aligned():
    """A near copy late in the text scores, whatever resembles its first words earlier; long sources are met around several phrases."""
    quote = "in the case of doubt the tribunal shall always hear both parties before it rules"
    near = "in the event of doubt the tribunal shall always hear both parties before it rules"
    early = "in the case of appeals nothing is heard. " + "filler words stand here and there. " * 100
    assert similarity.matched_share(early + near, quote) >= 14 / 15
    long = "in the case of appeals. " + "other words are written down in between. " * 2500 + near
    assert len(long) > similarity.LONG_CHARS and similarity.matched_share(long, quote) >= 14 / 15
    assert similarity.matched_share("unrelated text all over. " * 4000, quote) < 0.6
    draw = random.Random(3)
    for _ in range(50):
        a, b = ([draw.choice("abcdefg") for _ in range(n)] for n in (40, 8))
        blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        assert similarity.matched_share(" ".join(a), " ".join(b)) == sum(m.size for m in blocks) / 8


# ---- lookup


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, "A", "2020 SCC 1", None, "R v Smith"), (2, "A", "2020 SCC 2", "[2020] 1 SCR 5", "R v Jones"), (3, "B", "2020 SCC 2", "", "Roe v Wade"), (4, "B", " ", None, "R v Smith")]
    return spark.createDataFrame(rows, "row_id long, dataset string, citation_en string, citation2_en string, name_en string")


def test_lookup_statuses(spark, corpus):
    index = lookup.lookup_index(corpus)
    assert index.count() == 8
    asked = spark.createDataFrame([("2020 scc 1",), ("2020 SCC 2",), ("1999 SCC 9",), ("[2020] 1 S.C.R. 5",)], "c string").withColumn("lookup_key", keys.citation_key(F.col("c")))
    got = {r.c: (r.status, r.hits, r.row_id) for r in lookup.exact_lookup(asked, index).collect()}
    assert got == {"2020 scc 1": ("found", 1, 1), "2020 SCC 2": ("ambiguous", 2, None), "1999 SCC 9": ("not_found", 0, None), "[2020] 1 S.C.R. 5": ("found", 1, 2)}
    assert {r.row_id for r in lookup.matches(asked, index).collect()} == {1, 2, 3}
    names = spark.createDataFrame([("R. v. Jones",)], "n string").select(keys.name_key(F.col("n")).alias("lookup_key"))
    assert {(r.citation_key, r.row_id) for r in lookup.names_to_citations(names, index).collect()} == {("2020scc2", 2), ("2020scc2", 3), ("20201scr5", 2)}


def test_languages_and_sections(spark):
    rows = [(1, "e", "f", "en text", "texte"), (2, "e", "f", "", "texte"), (3, "e", "f", "en text", None), (4, "e", "f", None, None)]
    corpus = spark.createDataFrame(rows, "row_id long, citation_en string, citation_fr string, unofficial_text_en string, unofficial_text_fr string")
    assert [r.language for r in lookup.in_language(corpus, "en").orderBy("row_id").collect()] == ["en", "fr", "en", "en"]
    assert [r.language for r in lookup.in_language(corpus, "fr").orderBy("row_id").collect()] == ["fr", "fr", "en", "en"]
    maps = spark.createDataFrame([('{"16": "a", "672.54": "b"}', "672.54"), ('{"16": "a"}', "2"), (None, "1")], "m string, w string")
    assert [r.section_text for r in lookup.section(maps, "m", "w").collect()] == ["b", None, None]


def test_aliases_and_identities(spark):
    asked = spark.createDataFrame([(1, "Smith, 2020 X 1, 5 Y 6"), (2, "none")], "id int, citation string")
    aliases = spark.createDataFrame([("5y6", "short"), ("2020x15y6", "long")], "citation_key string, canonical_citation string")
    assert {r.id: r.canonical_citation for r in lookup.with_alias(asked, aliases).collect()} == {1: "long", 2: None}
    rows = [(1, "a", "x", 10, "a", "x"), (1, "a", "x", 11, "q", "x"), (2, "a", "x", 10, "q", "x"), (2, "a", "x", 11, "r", "x"), (3, "a", "x", 10, "q", "y")]
    got = lookup.unique_identity(spark.createDataFrame(rows, "id int, asked_literal string, asked_broad string, row_id long, literal_key string, broad_key string"))
    assert {r.id: (r.status, r.row_id) for r in got.collect()} == {1: ("found", 10), 2: ("ambiguous", None), 3: ("not_found", None)}


# ---- chains


def test_chains_end_loop_or_break(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "y"), ("m", "gone"), ("n", "m")] + [(f"r{i}", f"r{i - 1}" if i else None) for i in range(150)]
    got = {r.part: (r.origin, r.hops, r.note) for r in chains.resolve_chains(spark.createDataFrame(rows, "part string, target string")).collect()}
    assert got["a"] == ("a", 0, None) and got["c"] == ("a", 2, None) and got["r149"] == ("r0", 149, None)
    assert {got[k][2] for k in "xyz"} == {"loop"} and {got[k] for k in "mn"} == {(None, None, "missing target")}


def test_closure_and_inheritance(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "source int, target int")
    assert {r.node for r in chains.selection_closure(spark.createDataFrame([(1,)], "node int"), edges).collect()} == {1, 2, 3}
    rows = [("a", "a", "L", False), ("b", "a", "", True), ("c", "a", "own", True), ("d", "a", None, False)]
    got = chains.inherited(spark.createDataFrame(rows, "part string, origin string, link string, inherit boolean"), ("link",))
    assert {r.part: r.link for r in got.collect()} == {"a": "L", "b": "L", "c": "own", "d": None}


def test_closure_follows_long_chains_or_raises(spark):
    edges = spark.range(1, 104).selectExpr("id AS source", "id + 1 AS target").coalesce(1)
    start = spark.createDataFrame([(1,)], "node long")
    assert {r.node for r in chains.selection_closure(start, edges).collect()} == set(range(1, 105))
    assert {r.node for r in chains.selection_closure(start, edges.filter("source < 3"), rounds=2).collect()} == {1, 2, 3}
    with pytest.raises(RuntimeError):
        chains.selection_closure(start, edges, rounds=2)


def test_registry_tiers(spark):
    registry = spark.createDataFrame([("d", 1, 1, "Smith", "Smith v Roe", "u1#a"), ("d", 2, 2, "Act", "Big Act, Smith", "u2"), ("d", 9, 5, "Late", "x", "u9")], "doc_id string, seq int, note int, short_form string, verbatim string, link string")
    asked = spark.createDataFrame([("d", 3, "Smith", 2), ("d", 4, "Smith", None), ("d", 5, "Roe", None), ("d", 6, "Late", None), ("d", 7, "", None)], "doc_id string, seq int, token string, note int")
    got = {r.seq: (r.tier, r.link) for r in chains.registry_match(asked, registry).collect()}
    assert got == {3: (1, "u2"), 4: (2, "u1#a"), 5: (3, "u1#a"), 6: (None, None), 7: (None, None)}


# ---- sequences and quotations


def test_sequences(spark):
    rows = spark.createDataFrame([("d", 1, "ab", "x"), ("d", 2, "", "x"), ("d", 3, "abc", None), ("d", 4, "z", None)], "d string, n int, t string, v string")
    assert [r.offset for r in sequences.global_offsets(rows, "d", "n", "t").orderBy("n").collect()] == [0, 4, 6, 11]
    assert [r.v for r in sequences.suppress_repeats(rows, "d", ["n"], "v").orderBy("n").collect()] == ["x", "", None, None]
    assert [r.number for r in sequences.display_numbers(rows, "d", ["n"], F.col("n") == 2).orderBy("n").collect()] == [1, None, 2, 3]
    assert [r.n for r in sequences.running_cap(rows, ["n"], "n", 4).collect()] == [1, 2]
    parts = spark.createDataFrame([("d", 1, 0, 10), ("d", 2, 10, 2000), ("d", 3, 5, 5)], "d string, part int, start int, end int")
    links = spark.createDataFrame([("d", "a", 10, 12), ("d", "b", 9, 12), ("d", "c", 1900, 5000), ("d", "e", 7, 7)], "d string, link string, from int, to int")
    assert {r.link: r.part for r in sequences.first_overlap(parts, links, "d").collect()} == {"a": 2, "b": 1, "c": 2}
    blocks = spark.createDataFrame([("d", i, f"p{i}") for i in (1, 2, 3, 5)], "d string, number int, text string")
    ranges = spark.createDataFrame([("d", "x", 2, 3), ("d", "y", 3, 5)], "d string, scope string, low int, high int")
    assert [(r.scope, r.text) for r in sequences.combined_ranges(blocks, ranges, "d", "number", "text").collect()] == [("x", "p2\np3")]


def brute_exact(quotes_, docs):
    import re

    def norm(s):
        s = re.sub(r"\s+", " ", s.replace("“", '"').replace("”", '"')).strip().lower()
        return re.sub(r"[ ,.;:!?]+$", "", re.sub(r'"(?=[,.;:!?])', "", re.sub(r'^["\']+|["\']+$', "", s))).strip()

    return {(i, d) for i, q in quotes_ for d, t in docs if norm(q) and (norm(q) in norm(t) if " " in norm(q) else f" {norm(q)} " in f" {re.sub(r'[^a-z0-9]+', ' ', norm(t))} ")}


def test_exact_matches_and_places(spark):
    docs = [(1, "one two three four five\nsix seven eight nine ten\neleven"), (2, "zero one, two three four five six. End"), (3, ""), (4, "alpha beta")]
    asked = [(1, "two three four five six"), (2, "“Seven eight.”"), (3, "beta"), (4, "bet"), (5, ""), (6, "ne two thr"), (7, "one two three four five six seven eight nine ten eleven")]
    q, d = spark.createDataFrame(asked, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string")
    found = quotes.exact_matches(q, d)
    assert {(r.item_id, r.doc_id) for r in found.collect()} == brute_exact(asked, docs)
    places = {(r.item_id, r.doc_id): (r.block, r.span) for r in quotes.locate(found, q, quotes.line_blocks(d)).collect()}
    assert places[(1, 1)] == (0, 2) and places[(2, 1)] == (1, 1) and places[(1, 2)] == (0, 1) and (7, 1) not in places
    grams = {(r.item_id, r.doc_id): r.shared for r in quotes.ngram_candidates(q, d, 4).collect()}
    assert grams == {(1, 1): 2, (1, 2): 2, (7, 1): 8, (7, 2): 3}


def test_scores_and_verdicts(spark):
    q = spark.createDataFrame([(1, "the court has the final word on jurisdiction"), (2, "entirely different words here")], "item_id int, text string")
    d = spark.createDataFrame([(1, "Indeed the court has the last word on jurisdiction today. " + "filler text " * 50), (2, "The court has the final word on jurisdiction.")], "doc_id int, text string")
    pairs = spark.createDataFrame([(i, j) for i in (1, 2) for j in (1, 2)], "item_id int, doc_id int")
    got = {(r.item_id, r.doc_id): (r.exact, r.score) for r in quotes.scored(pairs, q, d).collect()}
    assert got == {(1, 1): (False, 0.875), (1, 2): (True, 1.0)}
    checked = spark.createDataFrame([("a", 1.0, False), ("a", 0.99, False), ("b", 1.0, True), ("c", 0.7, False), ("c", None, None), ("d", None, None)], "g string, score double, alternate boolean")
    assert {r.g: r.status for r in quotes.verdicts(checked, "g").collect()} == {"a": "OG_PINPOINT_MATCH", "b": "ALT_PINPOINT_MATCH", "c": "OG_PINPOINT_PARTIAL", "d": "NO_MATCH"}
    scores = spark.createDataFrame([(1, 1, 0.9, False), (1, 2, 0.85, False), (2, 1, 0.9, False), (2, 2, 0.7, False), (3, 1, 1.0, True), (3, 2, 1.0, True)], "item_id int, doc_id int, score double, exact boolean")
    assert {(r.item_id, r.doc_id) for r in quotes.clear_winner(scores).collect()} == {(2, 1), (3, 1)}


def test_marked_blocks_in_ascending_runs(spark):
    body = "\n".join(f"[{n}] paragraph {n}" for n in (1, 2, 3, 4, 5, 2, 6, 30))
    blocks = quotes.markers(spark.createDataFrame([(1, "head\n" + body)], "doc_id int, text string"), r"^\[(\d+)\]").withColumn("number", F.col("label").cast("int"))
    assert [(r.label, r.text) for r in blocks.orderBy("start").limit(2).collect()] == [("1", "[1] paragraph 1"), ("2", "[2] paragraph 2")]
    assert [r.number for r in quotes.monotone_blocks(blocks).orderBy("start").collect()] == [1, 2, 3, 4, 5]


# ---- splitting, inventory, journals


def test_notes_are_split(spark):
    notes = [("d", 1, "Smith v Roe, 2020 SCC 1 at para 4 [Smith]; RSC 1985, c C-46, s 7; Mary Roe, \"a b\" (2001) 3 JX 4"), ("d", 2, "Ibid at 9"), ("d", 3, "See Smith, supra note 1 at para 9; see also https://x.org/a.b c"), ("d", 4, "")]
    split = splitting.split_notes(spark.createDataFrame(notes, "doc_id string, footnote_id int, text string"))
    rows = {(r.footnote_id, r.part_index): r for r in split.collect()}
    assert set(rows) == {(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (3, 2)}
    assert (rows[1, 1].bare_citation, rows[1, 1].short_form, rows[1, 1].fragments, rows[1, 1].kind) == ("2020 SCC 1 at para 4", "Smith", ["par4"], "case")
    assert rows[1, 2].fragments == ["sec7"] and rows[1, 2].kind == "statute" and rows[2, 1].pages == [9] and rows[3, 2].link == "https://x.org/a.b"
    assert rows[1, 3].kind == "journal" and rows[1, 3].short_form == "Roe" and rows[2, 1].status == "complete" and rows[1, 1].citation_with_style.startswith("Smith")
    targets = {r.part: r.target for r in splitting.targets(split).collect()}
    assert targets["d/2/1"] == "d/1/3" and targets["d/3/1"] == "d/1/1" and targets["d/1/1"] is None
    assert column(spark, ["Ibid at para 25", "See Smith, supra note 3 at 5; ibid", "Smith v Roe, 2020 SCC 1"], splitting.pure_reference) == [True, True, False]


NOTES = [
    "R v Smith, 2020 SCC 5 at para 3; R v Jones, 2019 ONCA 7.", "R v Smith, 2020 SCC 5, citing R v Old, [1990] 1 SCR 33.", "Criminal Code, RSC 1985, c C-46, s 16. See Mary Roe, \"On Law\" (2001) 39:2 Osgoode Hall LJ 1.",
    "Ibid at para 25.", "Just some prose; more.", "See Roe, supra note 5 at 20 and Doe note 7.", "R v A, 2001 SCC 1 and R v B, 2002 SCC 2", "", "  ", "See <https://a.org/x;y> (a; b).", "e.g. this v that. No. 5 is one.", None,
    "Jane Doe, \"One\" (2001) 3 J 4, John Poe, \"Two\" (2002) 5 K 6", "Labour Act, RSC 1985, c L-2, the Canada Evidence Act, RSC 1985, c C-5",
]


def test_recall_first_parts_lose_nothing(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(NOTES)], "id int, text string")
    got = {}
    for r in boundaries.recall_parts(df).collect():
        got.setdefault(r.id, []).append(r)
    for i, t in enumerate(NOTES):
        rows = sorted(got.pop(i, []), key=lambda r: r.part_index)
        assert all(t[r.start : r.end] == r.verbatim for r in rows) and [r.part_index for r in rows] == list(range(1, len(rows) + 1))
        left = "".join((t or "")[a:b] for a, b in zip([0, *(r.end for r in rows)], [*(r.start for r in rows), len(t or "")], strict=True))
        assert not left.replace(";", "").strip()
    assert not got


def test_boundaries_and_their_reasons(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(NOTES)], "id int, text string")
    why = {}
    for r in boundaries.recall_parts(df).orderBy("id", "part_index").collect():
        why.setdefault(r.id, []).append(r.reason)
    assert why[0] == [None, "semicolon"] and why[1] == [None, "source_signal"] and why[2] == [None, "new_citation_sentence"] and why[3] == [None] and why[5] == [None, "conjoined_citation"] and why[6] == [None, "conjoined_citation"]
    assert why[12] == [None, "new_author_title_frame"] and why[13] == [None, "new_legal_source_frame"] and why[10] == [None]
    sure = {}
    for r in boundaries.conservative_parts(df).orderBy("id", "part_index").collect():
        sure.setdefault(r.id, []).append(r.verbatim)
    assert set(sure) == {0, 1, 2, 3} and sure[1] == ["R v Smith, 2020 SCC 5,", "citing R v Old, [1990] 1 SCR 33."]
    held = spark.createDataFrame([(1, "Roe, Law 1; Doe, Law 2, and Poe", ["Roe, Law 1", "Doe, Law 2", "nothing", "Poe"])], "id int, text string, parts array<string>")
    assert [(s.start, s.end, s.verbatim) for s in boundaries.snapped(held).first().snapped] == [(0, 10, "Roe, Law 1"), (12, 22, "Doe, Law 2"), (None, None, None), (28, 31, "Poe")]


def test_fields_of_parts(spark):
    cites = [
        "See also R v Brown, 2022 SCC 18 at paras 3-5, 7 [Brown (SCC)].", "Rules of Court, r 1-2", "Roe, supra note 4 at 763-64", "Jane Doe, Law (Toronto: Press, 2001) at 5", "Jane Doe, \"Part\" in John Poe, ed, Whole (Toronto: Press, 2001) 5",
        "RSC 1985, c C-46, ss 7, 11(1)", "See https://a.org/b.", "Smith v Roe, 2020 SCC 1, quoting Doe v Poe, 2019 SCC 2",
    ]
    parts = spark.createDataFrame([(i, t) for i, t in enumerate(cites)], "id int, text string")
    whole = boundaries.parts_between(parts.withColumn("boundaries", F.array().cast("array<struct<at: int, to: int, reason: string>>")))
    got = {r.id: r for r in splitting.fields(whole).collect()}
    assert got[0].kind == "case" and got[0].short_form == "Brown (SCC)" and got[0].fragments == ["par3", "par7"] and got[0].bare_citation == "2022 SCC 18 at paras 3-5, 7" and got[0].citation_with_style.startswith("R v")
    assert got[2].pages == [763, 764] and got[2].short_form == "Roe" and got[2].kind == "other" and got[3].kind == "book" and got[3].short_form == "Doe" and got[3].pages == [5] and got[4].kind == "essay_collection"
    assert got[5].fragments == ["sec7", "sec11(1)"] and got[6].link == "https://a.org/b" and got[6].kind == "website" and got[7].reasons == ["embedded_second_source"] and got[7].status == "partial"
    assert column(spark, ["R v Brown, 2022 SCC 18 at para 3 (Abella J, dissenting)"], lambda c: splitting.lookup_citation(c, F.lit("case"))) == ["2022 SCC 18"]
    assert column(spark, ["7", "672", "5"], lambda c: references.repaired_sections(F.array(F.concat(F.lit("sec"), c)), F.lit("see s 672.54 and s 5.1, s 5.2"))) == [["sec7"], ["sec672.54"], ["sec5"]]


# ---- registry


REGISTRY = [  # doc, seq, note, short form, verbatim, link, kind
    ("d", 1, 1, "Ipeelee", "R v Ipeelee, 2012 SCC 13 [Ipeelee]", "https://a.org/1#par1", "case"), ("d", 2, 2, "", "R v Brown, 2022 SCC 18 [Brown (SCC); hereinafter Browne]", "https://a.org/2", "case"), ("d", 3, 3, "Supply Act", "Supply Chains Act, SC 2023, c 9", "", "statute"),
    ("d", 4, 4, "Doe", "Jane Doe, \"On Brown and Ipeelee\" (2001) 3 J 4", "https://a.org/4", "journal"), ("d", 5, 5, "", "Fair Labour Standards Act, RSC 1985, c L-2", "https://a.org/5", "statute"), ("d", 6, 6, "Doe", "John Doe, Else", "https://a.org/6", "book"),
    ("d", 7, 7, "", "words " * 50 + "Later Named", "https://a.org/7", "other"), ("e", 1, 1, "Ipeelee", "R v Ipeelee", "https://b.org/1", "case"),
]


def test_supra_meets_entries_by_the_rarest_stretch_of_its_words(spark):
    k = F.col("id")
    entries = spark.range(2000).select(F.lit(1).alias("doc_id"), k.alias("seq"), k.alias("note"), F.concat(F.lit("Form"), k.cast("string"), F.lit("x")).alias("short_form"), F.concat(F.lit("R v Accused"), k.cast("string"), F.lit("y, 2020 SCC 5")).alias("verbatim"), F.concat(F.lit("https://a.org/"), k.cast("string")).alias("link"))
    asked = spark.range(2000).select(F.lit(1).alias("doc_id"), (k + 5000).alias("seq"), F.concat(F.when(k % 2 == 0, "see the Form").otherwise("Accused"), k.cast("string"), F.when(k % 2 == 0, "x").otherwise("y"), F.lit(", supra note 99999")).alias("verbatim"))
    out = reg.resolve_supra(asked, entries).select("seq", "link", "method")
    assert most_rows(out) <= 20_000  # 66,876 with an index of all three-letter stretches; the 4,000,000 pairs that it compared are dropped in the join and counted nowhere
    assert {r.seq: (r.link, r.method) for r in out.collect()} == {5000 + i: (f"https://a.org/{i}", "token_sf" if i % 2 == 0 else "token_verb") for i in range(2000)}
    # words inside longer ones, short words, letters beyond a to z, and a word that no entry has
    rows = [(1, 1, "1", "", "R v McDonaldson, 2020 SCC 1", "a"), (1, 2, "2", "Oak", "Roe on oaks", "b"), (1, 3, "3", "", "R v Cafés du Monde", "c")]
    held = spark.createDataFrame(rows, "doc_id int, seq int, note string, short_form string, verbatim string, link string")
    said = [(1, 10, "Donald, supra note 77"), (1, 11, "oak, supra note 77"), (1, 12, "see the oak, supra note 77"), (1, 13, "Monde Cafés, supra note 77"), (1, 14, "Monde Nobody, supra note 77"), (2, 15, "Donald, supra note 77"), (1, 0, "Donald, supra note 77")]
    got = {r.seq: (r.link, r.method) for r in reg.resolve_supra(spark.createDataFrame(said, "doc_id int, seq int, verbatim string"), held).collect()}
    assert got == {10: ("a", "token_verb"), 11: ("b", "exact_sf"), 12: ("b", "token_sf"), 13: ("c", "token_verb"), 14: (None, "abstain_no_match"), 15: (None, "abstain_no_match"), 0: (None, "abstain_no_match")}


def test_supra_tiers_and_abstentions(spark):
    registry = spark.createDataFrame(REGISTRY, "doc_id string, seq int, note int, short_form string, verbatim string, link string, kind string")
    asked = {
        10: ("Ipeelee, supra note 1 at para 5", "https://a.org/1#par1", "note_number"), 11: ("Ipeelee, supra note 9", "https://a.org/1#par1", "exact_sf"), 12: ("Supply Act, supra note 3", None, "abstain_unlinked_target"),
        13: ("Doe, supra note 99", None, "abstain_ambiguous_exact_sf"), 14: ("Labour Standards, supra note 99", "https://a.org/5", "token_verb"), 15: ("Browne, supra note 99", "https://a.org/2", "token_verb"), 16: ("supra note 99", None, "abstain_no_hint"),
        17: ("Nobody, supra note 2", None, "abstain_no_match"), 18: ("Later Named, supra note 99", None, "abstain_no_match"), 19: ("See Brown (SCC), supra note 2", "https://a.org/2", "note_number"),
    }
    references_ = spark.createDataFrame([("d", k, v[0]) for k, v in asked.items()] + [("e", 0, "Ipeelee, supra note 1")], "doc_id string, seq int, verbatim string")
    got = {(r.doc_id, r.seq): (r.link, r.method) for r in reg.resolve_supra(references_, registry).collect()}
    assert got.pop(("e", 0)) == (None, "abstain_no_match")  # entries behind the reference don't count
    assert got == {("d", k): v[1:] for k, v in asked.items()}


def test_note_guard_and_fallbacks(spark):
    registry = spark.createDataFrame(REGISTRY, "doc_id string, seq int, note int, short_form string, verbatim string, link string, kind string")
    proposed = spark.createDataFrame([("d", 20, "X, supra note 3", "https://a.org/2#p"), ("d", 21, "X, supra note 1", "https://a.org/7"), ("d", 22, "X, supra note 90", "https://z.org"), ("d", 23, "ibid", "https://z.org")], "doc_id string, seq int, verbatim string, link string")
    assert {r.seq: r.allowed for r in reg.note_guard(proposed, registry).collect()} == {20: True, 21: False, 22: True, 23: True}
    asked = spark.createDataFrame([("d", 30, "supra note 5"), ("d", 31, "FLSA, supra note 90"), ("d", 32, "Nobody, supra note 5"), ("d", 33, "supra note 3")], "doc_id string, seq int, verbatim string")
    got = {r.seq: (r.link, r.method) for r in reg.fallback_links(asked, registry).collect()}
    assert got == {30: ("https://a.org/5", "bare_note_unique_citation"), 31: ("https://a.org/5", "inferred_short_form:legislation_acronym"), 32: (None, None), 33: (None, None)}
    rows = reg.candidates(spark.createDataFrame([("d", 40, "Ipeelee, supra note 2")], "doc_id string, seq int, verbatim string"), registry).orderBy("rank").collect()
    assert rows[0].link == "https://a.org/1#par1" and rows[0].score >= 20 and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_short_forms_that_follow(spark):
    rows = [("R v Ipeelee, 2012 SCC 13", "case"), ("Roe v Wade, 410 US 113", "case"), ("Fair Labour Standards Act, RSC 1985, c L-2", "statute"), ("Mary Roe and John Doe, \"Law\" (2001) 1 X 2", "journal"), ("Roe, Law [Roe]", "book"), ("Ibid", "case"), ("A Roe & B Doe and C Poe, Law", "book")]
    got = [[(f.value, f.rule) for f in r.f] for r in spark.createDataFrame(rows, "v string, k string").select(shortforms.inferred_forms(F.col("v"), F.col("k")).alias("f")).collect()]
    assert got[0] == [("R v Ipeelee", "case_style"), ("Ipeelee", "case_party")] and got[1] == [("Roe v Wade", "case_style"), ("Roe", "case_party"), ("Wade", "case_party")]
    assert got[2] == [("Fair Labour Standards Act", "legislation_title"), ("FLSA", "legislation_acronym")] and got[3] == [("Roe, Doe", "secondary_authors")] and got[4] == got[5] == [] and got[6] == [("Roe, Doe & Poe", "secondary_authors")]
    hints = ["Ipeelee, supra note 6", "and considerations in Brown (SCC), supra note 2", "See also Roe et al supra", "no reference", "see, e.g., x; Doe, supra note 1"]
    assert column(spark, hints, shortforms.hint) == ["Ipeelee", "and considerations in Brown (SCC", "Roe et al", "", "Doe"]


def test_inventories(spark, tmp_path):
    kind = "path string, sha256 string, size long"
    a, b = spark.createDataFrame([("1", "x", 1), ("2", "y", 1), ("3", "z", 1)], kind), spark.createDataFrame([("1", "x", 1), ("2", "new", 1), ("4", "z", 1)], kind)
    assert {r.path: r.action for r in inventory.plan_update(a, b).collect()} == {"1": "reuse", "2": "download", "4": "copy", "3": "remove"}
    assert inventory.same_inventory(a, a) and not inventory.same_inventory(a, b)
    sinks.install(a, str(tmp_path / "s"), "r1")
    sinks.install(b, str(tmp_path / "s"), "r2")
    assert inventory.same_inventory(sinks.installed(spark, str(tmp_path / "s")), b)


def test_titles(spark):
    articles = spark.createDataFrame([(1, "The Rule of Law"), (2, "Rule of Thumb"), (3, "Law and Rule")], "article_id int, name_en string")
    asked = spark.createDataFrame([(1, "The rule of LAW"), (2, "A Rule of Laws")], "query_id int, title string")
    strict = {(r.query_id, r.article_id) for r in journals.title_candidates(asked, articles).collect()}
    loose = journals.title_candidates(asked, articles, loose=True)
    assert strict == {(1, 1)} and loose.count() == 6
    assert [(r.query_id, r.article_id, r.score) for r in journals.best_articles(asked, articles, loose).orderBy("query_id").collect()][0] == (1, 1, 1.0)


# ---- sources and sinks


def docx(paragraphs, notes):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r>' + "".join(f'<w:r><w:footnoteReference w:id="{i}"/></w:r><w:r><w:t>.</w:t></w:r>' for i in ids) + "</w:p>" for s, t, ids in paragraphs)
    n = "".join(f'<w:footnote w:id="{i}"><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:footnote>' for i, t in notes)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p}</w:body></w:document>")
        z.writestr("word/footnotes.xml", f'<w:footnotes {w}><w:footnote w:type="separator" w:id="-1"/>{n}</w:footnotes>')
    return out.getvalue()


def test_word_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([("Body", "One", [1]), ("Body", "Two", [2, 3])], [(1, "See  Smith"), (2, "Ibid"), (3, "x")]))
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    rows = readers.read_docx(spark, str(tmp_path))
    assert {(r.number, r.text) for r in rows.filter("part = 'footnote'").collect()} == {(1, "See Smith"), (2, "Ibid"), (3, "x")}
    assert [r.style for r in rows.filter("part = 'paragraph'").collect()] == ["Body", "Body"]
    assert {(r.footnote_id, r.number, r.position) for r in readers.anchors(rows).collect()} == {(1, 0, 3), (2, 1, 3), (3, 1, 4)}


def test_corpus_and_selections(spark, tmp_path, corpus):
    corpus.filter("dataset = 'A'").drop("dataset").coalesce(1).write.parquet(str(tmp_path / "cases/aa"))
    corpus.filter("dataset = 'B'").drop("dataset", "citation2_en").coalesce(1).write.parquet(str(tmp_path / "cases/bb"))
    read = readers.read_corpus(spark, str(tmp_path / "cases"))
    assert {r.dataset for r in readers.coverage(read).collect()} == {"AA", "BB"} and read.select("row_id").distinct().count() == 4
    (tmp_path / "s.csv").write_text("﻿Doc_Key,Footnotes\na,\"1,3-4\"\nb,2\n", encoding="utf-8")
    assert {(r.doc_key, r.footnote_id) for r in readers.read_selection(spark, str(tmp_path / "s.csv")).collect()} == {("a", 1), ("a", 3), ("a", 4), ("b", 2)}


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("d", 1, "a\x01b"), ("d", 2, "ab")], "d string, n int, t string")
    out = sinks.report(rows, "d", ["n"], ["t"])
    assert [r.t for r in out.orderBy("n").collect()] == ["ab", ""]
    sinks.write_csv(out, str(tmp_path / "c")), sinks.write_json(out, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    quotes_ = spark.createDataFrame([("d", 1), ("d", 1), ("d", 2)], "doc_key string, footnote_id int")
    targets = spark.createDataFrame([("d", 2, "ibid_target"), ("d", 3, "supra_target")], "doc_key string, footnote_id int, reason string")
    got = {r.footnote_id: (r.quote_count, r.include_reason) for r in sinks.quote_manifest(quotes_, targets).collect()}
    assert got == {1: (2, "quote"), 2: (1, "ibid_target;quote"), 3: (0, "supra_target")}


# ---- structure and scopes


def test_paragraph_structure(spark):
    from marginalia.operators import structure

    sentence = "contains enough substantive language here to establish a reliable sequence of blocks."
    good = "Heading\n" + "\n".join(f"[{n}] Paragraph {n} {sentence}" for n in range(1, 8))
    nested = "\n".join(f"{n}. Reason {n} {sentence}\n1. quoted" if n == 3 else f"{n}. Reason {n} {sentence}" for n in range(1, 8))
    short = "\n".join(f"[{n}] item" for n in range(1, 8))
    docs = spark.createDataFrame([(1, good), (2, nested), (3, short), (4, ""), (5, "[1] x\n[2] y")], "doc_id int, text string")
    got = {}
    for r in structure.paragraphs(docs).orderBy("start").collect():
        got.setdefault(r.doc_id, []).append((r.style, r.number))
    assert got == {1: [("bracket", n) for n in range(1, 8)], 2: [("dot", n) for n in range(1, 8)]}
    first = structure.paragraphs(docs.filter("doc_id = 1")).orderBy("start").first()
    assert first.text == f"[1] Paragraph 1 {sentence}" and good[first.start : first.end].rstrip() == first.text


def test_pages_and_sections(spark):
    from marginalia.operators import structure

    texts = [(1, "a\n[page 4]\none\n[page 5]\ntwo\n[page 6]\nthree"), (2, "[page 1]\na\n[page 2]\nb"), (3, "\n".join(f"[page {n}]\nx" for n in (1, 2, 3, 7, 8, 9))), (4, "Page 1\nx\nPage 2\ny\nPage 3\nz\nPage 9\n")]
    got = [(r.doc_id, r.label, r.text) for r in structure.pages(spark.createDataFrame(texts, "doc_id int, text string")).orderBy("doc_id", "start").collect()]
    assert got == [(1, "4", "[page 4]\none"), (1, "5", "[page 5]\ntwo"), (4, "1", "Page 1\nx"), (4, "2", "Page 2\ny")]
    law = "1 Title\nx\n2 Scope\ny\n2.1 More\nz\n2 Again\n10 Late\nend"
    rows = structure.sections(spark.createDataFrame([(1, law)], "doc_id int, text string")).orderBy("start").collect()
    assert [(r.label, r.parents) for r in rows] == [("1", []), ("2", []), ("2.1", ["2"]), ("10", [])]


def test_texts_are_cut_at_any_place_at_the_cost_of_the_piece(spark):
    import pyarrow as pa

    from marginalia.operators import structure

    texts = spark.createDataFrame([(1, "a😀b \n"), (2, None), (3, "xyz")], "doc_id int, text string")
    marks = spark.createDataFrame([(1, 0, 2, "p"), (1, 1, None, "q"), (1, 4, 4, "r"), (2, 0, None, "s"), (9, 0, 1, "t")], "doc_id int, start long, end long, label string")
    rows = lambda **how: sorted((r.doc_id, r.label, r.start, r.end, r.text) for r in quotes.cut(marks, texts, **how).collect())
    assert rows() == [(1, "p", 0, 2, "a😀"), (1, "q", 1, 5, "😀b \n"), (1, "r", 4, 4, ""), (2, "s", 0, None, None)]
    assert [r[-1] for r in rows(trimmed=True)] == ["a😀", "😀b", "", None]
    law = "\n".join(f"{n} The owner shall keep the thing in good order, and so on" for n in range(1, 40_001))
    began = time.time()
    found = structure.sections(spark.createDataFrame([(1, law)], "doc_id int, text string")).agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    assert tuple(found) == (40_000, len(law) - 39_999) and time.time() - began < 30  # characters counted from the beginning for each section: minutes
    began = time.time()
    assert structure.ascending_labels.func(pa.array([[[n] for n in range(30_000, 0, -1)]], pa.list_(pa.list_(pa.int32())))).to_pylist() == [list(range(30_000))]
    assert structure.ascending_labels.func(pa.array([[[1], [3], [1, 1], [2], [3], [1, 2], [2]], None], pa.list_(pa.list_(pa.int32())))).to_pylist() == [[0, 0, 1, 2, 2, 1, 3], None]
    assert time.time() - began < 10  # every label compared with all scopes: half a minute


def test_sentences_and_propositions(spark):
    from marginalia.operators import structure

    rows = [("First one. Then Smith v. Roe held it", 37), ("No end", 6), ("A (see s. 7). “Quoted.” Next", 28)]
    got = spark.createDataFrame(rows, "t string, p int").select(structure.sentence_before(F.col("t"), F.col("p")).alias("r")).collect()
    assert [r.r for r in got] == ["Then Smith v. Roe held it", "No end", "Next"]


def test_cited_scopes(spark):
    from marginalia.operators import scopes

    cites = ["2020 SCC 1 at paras 4-6, 9 and 12", "[1962] SCR 746 at 763–64", "RSC 1985, c C-46, s 672.54(1)", "https://x.org/a.html#par101", "none"]
    got = column(spark, cites, scopes.cited_scopes)
    pairs = lambda rs: [(r.low, r.high) for r in rs]
    assert pairs(got[0].paragraphs) == [(4, 6), (9, 9), (12, 12)] and pairs(got[1].pages) == [(763, 764)] and got[2].sections == ["672.54(1)"] and pairs(got[3].paragraphs) == [(101, 101)]
    assert not (got[4].paragraphs or got[4].pages or got[4].sections)


def test_locations(spark):
    from marginalia.operators import scopes

    blocks = [(1, n, f"Paragraph {n} has {'the exact quotation' if n == 3 else 'normal words'} in it") for n in range(1, 7)]
    table = spark.createDataFrame(blocks, "doc_id int, number int, text string")
    source = spark.createDataFrame([(1, "\n".join(b[2] for b in blocks))], "doc_id int, text string")
    asks = [(1, "the exact quotation", [(3, 3)]), (2, "the exact quotation", [(5, 5)]), (3, "the exact quotation", []), (4, "the exact quotation", [(40, 41)]), (5, "in it Paragraph 4 has", [(4, 4)]), (6, "absent words here", []), (7, "normal", [])]
    asked = spark.createDataFrame([(i, 1, q, r) for i, q, r in asks], "item_id int, doc_id int, quote string, ranges array<struct<low: long, high: long>>")
    got = {r.item_id: (r.location, r.labels) for r in scopes.resolve(asked, table, source).collect()}
    assert got == {1: ("cited", [3]), 2: ("alternate", [3]), 3: ("uncited", [3]), 4: ("scope_unavailable", [3]), 5: ("scope_unavailable_document", []), 6: ("unmatched", []), 7: ("uncited", [])} or got[5][0] == "alternate_document"
    matches = spark.createDataFrame([(1, "7", 0.9), (1, "7(1)", 0.9), (1, "8", 0.9), (2, "7", 1.0), (2, "7.2", 0.8)], "item_id int, label string, score double")
    assert {(r.item_id, r.label) for r in scopes.specific_labels(matches).collect()} == {(1, "7(1)"), (1, "8"), (2, "7"), (2, "7.2")}


# ---- citations and fragments


def test_what_citations_say(spark):
    from marginalia.functions import citations

    assert column(spark, ["[1988] 2 S.C.R. 833 at 840", "(2001) 39 Osgoode Hall LJ 1", "2020 SCC 1"], citations.first_page) == ["833", "1", ""]
    assert column(spark, ["A, “One Two,” and ‘Three’ and \"one two\""], citations.quoted_titles) == [["One Two", "Three"]]
    got = column(spark, ["“T” (2001) 39:2 Osgoode Hall LJ 101", "none"], citations.journal_details)
    assert tuple(got[0]) == ("2001", "39", "2", "Osgoode Hall LJ", "101") and set(got[1]) == {""}
    assert column(spark, ["2020 SCC 1", "RSC 1985, c C-46", "Smith"], citations.dataset_of) == ["SCC", "LEGISLATION-FED", None]
    assert column(spark, ["[2020] UKSC 5", "410 U.S. 113", "3:21-cv-00123", "2401234/2020", "x"], citations.provider) == ["uk_case_law", "us_reporter", "us_docket", "uk_employment", None]
    assert column(spark, ["R.S.C. 1985,  c. C-46", "LRC 1985"], citations.statute_text) == ["RSC 1985, c. C-46", "RSC 1985"]
    assert column(spark, ["2023 SCC 17 at para 4", "x"], citations.case_url) == ["https://example.org/en/scc/2023/2023scc17/2023scc17.html#par4", ""]
    rows = spark.createDataFrame([("u#par1", "ibid", True), ("u#par1", "supra", False), ("u#par1", "at para 9", False)], "l string, c string, i boolean").select(citations.anchored_link(F.col("l"), F.col("c"), F.col("i")).alias("r")).collect()
    assert [r.r for r in rows] == ["u#par1", "u", "u#par9"]
    found = citations.only_match(spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "id int, url string"), "id", "url")
    assert {r.id: r.url for r in found.collect()} == {1: "a", 2: ""}


def test_datasets_are_pruned(spark, corpus):
    from marginalia.functions import citations

    held = corpus.withColumn("dataset", F.when(F.col("dataset") == "A", "SCC").otherwise("BCCA"))
    assert citations.prune(spark.createDataFrame([("2020 SCC 1",)], "citation string"), held).count() == 2
    assert citations.prune(spark.createDataFrame([("2020 SCC 1",), ("x",)], "citation string"), held).count() == 4


def test_fragments(spark):
    from marginalia.functions import fragments

    made = spark.createDataFrame([("a-b", "c, d", "", "é")], "p string, s string, e string, x string").select(fragments.directive(F.col("p"), F.col("s"), F.col("e"), F.col("x")).alias("d"))
    assert made.first().d == "#:~:text=a%2Db-,c%2C%20d,-%C3%A9"
    assert tuple(made.select(fragments.parsed(F.col("d")).alias("r")).first().r) == ("a-b", "c, d", "", "é")
    lines = spark.createDataFrame([(1, 0, "the cat sat here"), (1, 1, "and the cat ran off"), (1, 2, "alone")], "doc_id int, block int, text string")
    targets = spark.createDataFrame([(1, 1, "cat"), (2, 1, "alone"), (3, 1, "dog")], "id int, doc_id int, target string")
    got = {r.id: r.directive for r in fragments.unique_fragments(targets, lines).collect()}
    assert got == {1: "#:~:text=the-,cat,-sat%20here", 2: "#:~:text=alone", 3: None}


# ---- links and provisions


def test_links(spark):
    from marginalia.operators import links

    link, method = links.cascade(("identity", F.col("a")), ("provider", F.col("b")))
    rows = spark.createDataFrame([("", "x"), ("y", "x"), (None, " ")], "a string, b string").select(link.alias("l"), method.alias("m")).collect()
    assert [(r.l, r.m) for r in rows] == [("x", "provider"), ("y", "identity"), (None, None)]
    parts = spark.createDataFrame([("d", "1", "a", None, "L1"), ("d", "2", "b", "1", ""), ("d", "3", "c", "b", ""), ("d", "4", "e", "4", "L4")], "doc_id string, display_key string, internal_key string, origin_key string, link string")
    assert {r.display_key: r.origin_link for r in links.attach_origin(parts, ("link",)).collect()} == {"1": None, "2": "L1", "3": "", "4": None}
    laws = spark.createDataFrame([("RSC 1985, c C-46", "https://x/laws/stat/rsc-1985-c-c-46/latest"), ("SC 1, c 2", "https://x/laws/stat/a/1"), ("SC 1, c 2", "https://x/laws/stat/b/1")], "citation string, url string")
    given = spark.createDataFrame([(1, "https://x/laws/stat/wrong/latest", "RSC 1985, c C-46"), (2, "https://x/laws/stat/q/1", "SC 1, c 2"), (3, "https://y/a", "RSC 1985, c C-46")], "id int, link string, citation string")
    assert {r.id: r.repaired for r in links.repair_slugs(given, laws).collect()} == {1: "https://x/laws/stat/rsc-1985-c-c-46/latest", 2: "https://x/laws/stat/q/1", 3: "https://y/a"}
    assert column(spark, [["a"], ["a", "b"], ["a", "b", "c", "d"]], links.summary, "array<string>") == ["a", "a, b", "a, b [+2 more instances]"]
    kinds = spark.createDataFrame([("IBID", "", "author"), ("SUPRA", "u", "author"), ("SUPRA", "u", "registry"), ("", "", None)], "k string, l string, m string")
    assert [r.r for r in kinds.select(links.should_inherit(F.col("k"), F.col("l"), F.col("m")).alias("r")).collect()] == [True, False, True, False]


def test_provisions(spark):
    from marginalia.operators import structure

    law = "(1) one\n(a) x\n(i) y\n(ii) z\n(A) q\n(b) w\n(2) two\n(h) h\n(i) letter\nplain"
    rows = structure.provisions(spark.createDataFrame([(1, law)], "doc_id int, text string")).orderBy("block").collect()
    assert [r.path for r in rows] == ["(1)", "(1)(a)", "(1)(a)(i)", "(1)(a)(ii)", "(1)(a)(ii)(A)", "(1)(b)", "(2)", "(2)(h)", "(2)(i)"]


def test_export_details(spark):
    rows = spark.createDataFrame([("a", 1, 2)], "x string, y int, _z int")
    assert sinks.projected(rows, "display", ["x"]).columns == ["x"] and sinks.projected(rows, "diagnostic", ["x"]).columns == ["x", "_z"]
    assert sinks.projected(rows, "display-json", ["x", "y"]).first().row == '{"x":"a","y":1}'
    with pytest.raises(ValueError):
        sinks.projected(rows, "none", ["x"])


# ---- what was added to chains, lookup, scopes, structure, sources


def test_chain_paths_and_maps(spark):
    rows = [("a", None, "", "12"), ("b", "a", "IBID", ""), ("c", "b", "SUPRA→1:1", ""), ("d", "c", "IBID", ""), ("x", "y", "IBID", ""), ("y", "x", "IBID", ""), ("z", "gone", "SUPRA→9:1", "")]
    parts = spark.createDataFrame(rows, "part string, target string, label string, first_page string")
    got = {r.part: (r.path, r.first_page) for r in chains.chain_paths(chains.resolve_chains(parts), "label").collect()}
    assert got == {"a": ("", "12"), "b": ("IBID", "12"), "c": ("SUPRA→1:1 → IBID", "12"), "d": ("IBID → SUPRA→1:1 → IBID", "12"), "x": (None, ""), "y": (None, ""), "z": (None, "")}
    said = {r.part: r.note for r in chains.chain_notes(chains.resolve_chains(parts)).collect()}
    assert "loop" in said["x"] and "not found" in said["z"] and said["a"] is None
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 2)], "source int, target int")
    assert {tuple(r) for r in chains.reverse_map(edges).collect()} == {(2, 1), (2, 3)}
    a, b = (spark.createDataFrame(x, "doc_key string, footnote_id int") for x in ([("d", 1), ("d", 2)], [("d", 2), ("e", 1)]))
    assert chains.selection_union(a, b).count() == 3
    held = chains.with_fields(spark.createDataFrame([("d", 1, 1), ("d", 9, 1)], "doc_id string, footnote_id int, part_index int"), spark.createDataFrame([("d", 1, 1, "SUPRA")], "doc_id string, footnote_id int, part_index int, ref_kind string"), ("ref_kind",))
    assert {r.footnote_id: r.ref_kind for r in held.collect()} == {1: "SUPRA", 9: None}


def test_long_paths(spark):
    parts = spark.createDataFrame([(i, i - 1 if i else None, str(i)) for i in range(300)], "part long, target long, label string")
    got = {r.part: r.path for r in chains.chain_paths(chains.resolve_chains(parts), "label").collect()}
    assert got[299] == " → ".join(str(i) for i in range(299, 0, -1)) and got[1] == "1" and got[0] == ""


def test_long_notes_without_sources_are_not_searched_from_the_left_for_each_place():
    long = "the owner and The keeper of it, as said and " * 2000
    began = time.time()
    assert boundaries.Note(long).boundaries() == [] and time.time() - began < 5  # each of 2,000 places asked what lies left of it
    assert [b[2] for b in boundaries.Note(long + "2020 SCC 1 and The Labour Act, RSC 1985, c L-2").boundaries()] == ["conjoined_citation"]
    assert [b[2] for b in boundaries.Note("Doe above note. Roe ſupra").boundaries()] == ["new_citation_sentence"]
    spoken, top, square = boundaries.Note('a "b" [c (d] “e” https://x.y/[z] f').scan
    assert [len(x) for x in (spoken, top, square)] == [35] * 3 and [i for i in range(35) if spoken[i]] == [3, 4, 14, 15]
    assert [i for i in range(34) if top[i]] == [0, 1, 2, 5, 6] and square[6:8] == [0, 1] and square[12:14] == [-1, -1]


def test_scored_resolution_reads_its_tables_once(spark):
    def counted(rows, schema):
        read = spark.sparkContext.accumulator(0)

        def run(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return spark.createDataFrame(rows, schema).mapInArrow(run, schema), read

    asked, n_asked = counted([(1, 1, "the owner shall keep it", [(1, 1)]), (2, 1, "nothing of the kind at all", [])], "item_id int, doc_id int, quote string, ranges array<struct<low: long, high: long>>")
    blocks, n_blocks = counted([(1, 1, "the owner shall keep it in order"), (1, 2, "more of it"), (2, 1, "not asked")], "doc_id int, number long, text string")
    sources, n_sources = counted([(1, "the owner shall keep it in order\nmore of it"), (2, "not asked")], "doc_id int, text string")
    got = {r.item_id: (r.location, r.labels) for r in scopes.resolve_scored(asked, blocks, sources).collect()}
    assert got == {1: ("cited", ["1"]), 2: ("unmatched", [])}
    assert (n_asked.value, n_blocks.value, n_sources.value) == (2, 3, 2)


def test_identities_and_locks(spark):
    rows = [(1, "SCC", "2020 SCC 1", None), (2, "SCC", "2020 SCC 2", "[2020] 1 SCR 5"), (3, "SCC", "2020 SCC 2", None), (4, "REG", "NB Reg 82-73, r 4.1", None), (5, "REG", "NB Reg 82-73, r 41", None), (6, "BCCA", "2019 BCCA 7", None)]
    corpus = spark.createDataFrame(rows, "row_id long, dataset string, citation_en string, citation2_en string")
    asked = spark.createDataFrame([(1, "2020 S.C.C. 1"), (2, "2020 SCC 2"), (3, "[2020] 1 SCR 5"), (4, "NB Reg 82-73, r 4.1"), (5, "NB Reg 82-73, r 9"), (6, "2020 SCC 1 at para 5"), (7, "2021 SCC 9")], "id int, citation string")
    got = {r.id: (r.status, r.row_id) for r in lookup.identities(asked, corpus, laws=True).collect()}
    assert got == {1: ("found", 1), 2: ("ambiguous", None), 3: ("found", 2), 4: ("found", 4), 5: ("not_found", None), 6: ("found", 1), 7: ("not_found", None)}
    aliases = spark.createDataFrame([("11dlr641", "2019 BCCA 7")], "citation_key string, canonical_citation string")
    cases = spark.createDataFrame([(1, "2020 SCC 1"), (2, "Hunter v Southam, 11 DLR 641"), (3, "2020 ZZCA 5")], "id int, citation string")
    locked = {r.id: (r.method, r.status, r.row_id) for r in lookup.locked_cases(cases, corpus, aliases).collect()}
    assert locked == {1: ("citation", "found", 1), 2: ("alias", "found", 6), 3: ("not_covered", "not_covered", None)}
    assert lookup.any_field(corpus, ["citation_en", "citation9"], "2019 BCCA 7").count() == 1 and lookup.any_field(corpus, ["citation_en"], " 2019 bcca 7 ").count() == 1


def test_identities_of_common_citations_meet_a_row_a_key(spark):
    corpus = spark.range(3000).select(F.col("id").alias("row_id"), F.concat(F.lit("2021 BCCA "), (F.col("id") % 2).cast("string"), F.when(F.col("id") == 7, ", s 5").otherwise("")).alias("citation_en"))
    asked = spark.range(6000).select("id", F.concat(F.lit("2021 BCCA "), (F.col("id") % 3).cast("string"), F.when(F.col("id") == 1, ", s 5").when(F.col("id") == 4, ", s 6").otherwise("")).alias("citation"))
    for laws in (False, True):
        out = lookup.identities(asked, corpus, laws=laws, unicode=False)
        joined = most_rows(out)
        got = {r.id: (r.status, r.row_id) for r in out.collect()}
        assert joined <= 20_000  # 12,000,000 where each citation met each row of its key
        assert got[1] == ("found", 7) and got[0] == got[3] == got[4] == ("ambiguous", None) and got[2] == ("not_found", None)
    few = spark.createDataFrame([(1, "NB Reg 1, s 4"), (2, "NB Reg 1, s 5"), (3, "NB Reg 2")], "row_id long, citation_en string")
    wanted = spark.createDataFrame([(1, "NB Reg 1, s 4 "), (2, "NB Reg 1, s 6"), (3, "NB Reg 1"), (4, "NB Reg 2, s 8"), (5, None)], "id int, citation string")
    assert {r.id: (r.status, r.row_id) for r in lookup.identities(wanted, few, laws=True).collect()} == {1: ("found", 1), 2: ("not_found", None), 3: ("ambiguous", None), 4: ("found", 3), 5: ("not_found", None)}


def test_laws_and_their_addresses(spark):
    cites = ["SOR/99-1", "rsc 1985, c C-46", "RSC 1985, c C-46", "Alta Reg 5/2001", "2020 BCCA 5", "nothing", "YOIC 2001/5"]
    assert column(spark, cites, citations.dataset_of) == ["REGULATIONS-FED", "LEGISLATION-FED", "LEGISLATION-FED", "REGULATIONS-AB", "BCCA", None, "REGULATIONS-YT"]
    urls = [("LEGISLATION-FED", "https://laws-lois.justice.gc.ca/eng/XML/C-46.xml"), ("LEGISLATION-FED", "https://laws-lois.justice.gc.ca/fra/XML/C-46.xml"), ("LEGISLATION-AB", "https://kings-printer.alberta.ca/1266.cfm?page=A.cfm&leg_type=Acts"), ("REGULATIONS-AB", "https://kings-printer.alberta.ca/1266.cfm?leg_type=Acts"), ("LEGISLATION-NL", "http://www.assembly.nl.ca/Legislation/sr/statutes/a.htm"), ("X", "https://laws.gnb.ca/en/document/cs/1")]
    got = spark.createDataFrame(urls, "d string, u string").select(citations.current_law_source(F.col("d"), F.col("u")).alias("r")).collect()
    assert [r.r for r in got] == [True, False, True, False, True, False]
    web = [("website", "https://a.com/x", True), ("website", "https://www.example.org/x", False), ("case", "https://a.com", False), ("other", None, False), ("other", "other", False)]
    assert [r.r for r in spark.createDataFrame(web, "k string, l string, w boolean").select(citations.prefilled_web(F.col("k"), F.col("l")).alias("r")).collect()] == [w for _, _, w in web]
    said = [("case", "https://a.com", None, True), ("journal", "https://a.com", True, True), ("journal", "https://a.com", None, False), ("case", "other", None, False), ("website", "https://a.com", True, False)]
    assert [r.r for r in spark.createDataFrame(said, "k string, l string, x boolean, w boolean").select(citations.reports_missing_text(F.col("k"), F.col("l"), F.col("x")).alias("r")).collect()] == [w for *_, w in said]
    asked = spark.createDataFrame([("2020 BCCA 5 at para 3",), ("2020 ZZ 1",), ("none",)], "citation string")
    routes = spark.createDataFrame([("BCCA", "bc/bcca")], "code string, route string")
    assert [r.url for r in citations.case_urls(asked, routes).collect()] == ["https://example.org/en/bc/bcca/doc/2020/2020bcca5/2020bcca5.html#par3", "", ""]
    laws = spark.createDataFrame([("LEGISLATION-FED", "RSC 1985, c C-46"), ("LEGISLATION-ON", "RSC 1985, c C-46"), ("REGULATIONS-NB", "NB Reg 82-73")], "d string, c string")
    assert [r.r for r in laws.select(citations.law_url(F.col("d"), F.col("c")).alias("r")).collect()] == ["https://example.org/en/ca/laws/stat/rsc-1985-c-c-46/latest/rsc-1985-c-c-46.html", "", "https://example.org/en/nb/laws/regu/nb-reg-82-73/latest/nb-reg-82-73.html"]


def test_cited_provisions_are_spread(spark):
    cites = ["ss 7-9", "s 7-9", "ss 11(1)–(3)", "rules 2(a) to (c), 5", "s 4 and 6, 8.1", "ss 7 to 2", "article 3", "none", "ss 1 to 90"]
    assert column(spark, cites, scopes.cited_provisions) == [["7", "8", "9"], ["7-9"], ["11(1)", "11(2)", "11(3)"], ["2(a)", "2(b)", "2(c)", "5"], ["4", "6", "8.1"], ["7", "2"], ["3"], [], ["1", "90"]]
    assert column(spark, ["7(1)(a)", "7"], scopes.section_ancestors) == [["7(1)(a)", "7(1)", "7"], ["7"]]
    asked = spark.createDataFrame([(1, 1, ["7(1)(a)", "9"]), (2, 1, ["7"])], "item_id int, doc_id int, sections array<string>")
    blocks = spark.createDataFrame([(1, "7"), (1, "7(1)"), (1, "8")], "doc_id int, label string")
    assert {tuple(r) for r in scopes.cited_sections(asked, blocks).collect()} == {(1, 1, "7(1)", False), (2, 1, "7", True)}


def test_quotations_are_resolved_with_scores(spark):
    words_ = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    lines = {1: "the tribunal shall hear both parties before it rules on costs", 2: "nothing of that kind is said here at all", 3: "the tribunal must hear both parties before it rules on costs", 4: " ".join(words_), 5: "and so the", 6: "matter rests there for good"}
    blocks = spark.createDataFrame([(1, n, t) for n, t in lines.items()], "doc_id int, number long, text string")
    source = spark.createDataFrame([(1, "\n".join(lines.values()))], "doc_id int, text string")
    exact, near = lines[1], "the tribunal should hear both parties before it rules on costs"
    asked = [(1, exact, [(1, 1)]), (2, exact, [(2, 2)]), (3, exact, []), (4, exact, [(90, 91)]), (5, near, [(3, 3)]), (6, near, []), (7, "and so the\nmatter rests there for good", [(5, 6)]), (8, "words that stand nowhere", []), (9, "hear both", []), (10, "so the matter rests there", [])]
    got = {r.item_id: (r.location, r.score, r.labels) for r in scopes.resolve_scored(spark.createDataFrame([(i, 1, q, [{"low": a, "high": b} for a, b in s]) for i, q, s in asked], "item_id int, doc_id int, quote string, ranges array<struct<low: long, high: long>>"), blocks, source).collect()}
    assert got[1] == ("cited", 1.0, ["1"]) and got[2] == ("alternate", 1.0, ["1"]) and got[3] == ("uncited", 1.0, ["1"]) and got[4] == ("scope_unavailable", 1.0, ["1"])
    assert got[5][0] == "cited" and got[5][2] == ["3"] and 0.9 < got[5][1] < 1 and got[6][0] == "uncited_document" and got[7] == ("cited", 1.0, ["5–6"]) and got[8][0] == "unmatched" and got[9] == ("uncited", 1.0, []) and got[10][0] == "uncited"
    located = scopes.locators(spark.createDataFrame([(["5"],), (["5", "6"],), ([],)], "labels array<string>"), "paragraph").collect()
    assert [r.locator for r in located] == ["par5", None, None]


def test_section_maps_and_structures(spark):
    body = "words that fill the section up to some length indeed " * 3
    law = "Title of the act\n" + "\n".join(f"{n} The {body}" for n in (1, 2, 3)) + f"\n3.1 The {body}\n3.2 The {body}\n4 The {body}"
    rules = "\n".join(f"{n} The {body}" for n in ("1-1", "1-2", "2-1"))
    pages_ = "front\n" + "\n".join(f"[page {n}]\n{body}" for n in (12, 13, 14))
    rows = [(1, "law", "An Act", law, None, None), (2, "law", "Civil Rules", rules, None, None), (3, "law", "Mapped", "x", '{"16": "first one", "Schedule": "middle", "672.54": "last"}', None), (4, "case", "R v X", pages_, None, 11), (5, "case", "none", "plain", None, None)]
    found = structure.structures(spark.createDataFrame(rows, "doc_id int, source_kind string, name string, text string, sections string, first_page int"))
    got = {}
    for r in found.orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.label))
    assert got[1] == [("section", x) for x in ("1", "2", "3", "3.1", "3.2", "4")] and got[2] == [("section", x) for x in ("1-1", "1-2", "2-1")] and got[3] == [("section", "16"), ("section", "672.54")]
    assert got[4] == [("page", f"page {n}") for n in (11, 12, 13)] and 5 not in got
    spans = {(r.label): (r.start, r.end, r.text) for r in structure.section_map(spark.createDataFrame(rows[2:3], "doc_id int, source_kind string, name string, text string, sections string, first_page int"), "sections").collect()}
    assert spans == {"16": (0, 9, "first one"), "672.54": (17, 21, "last")}
    at = [("He said so.” ", 12, 10), ("He said so, ", 11, 11), ("So it is.", 9, 8)]
    assert [r.r for r in spark.createDataFrame(at, "t string, p int, w int").select(structure.anchor_position(F.col("t"), F.col("p")).alias("r")).collect()] == [w for *_, w in at]
    assert column(spark, ["Title\nINTRODUCTION  Words", "none"], structure.introduction_end) == [20, 0]


def test_articles_fit_what_is_cited(spark):
    articles = spark.createDataFrame([(1, "On Law", "(2001) 39:2 OHLJ 1", "2001-05-01", "39", "2", "Osgoode Hall LJ", "OHLJ"), (2, "On Law", "(1980) 5 X 1", "1980-01-01", "5", "", "X Review", "X")], "article_id int, name_en string, citation_en string, document_date_en string, volume string, issue string, journal_name string, journal_abbrev string")
    asked = [(1, "On Law", "2002", "38", "3", "osgoode"), (2, "On Law", "2001", "39", "2", "X Review"), (3, "On Law", None, None, None, None), (4, "OHLJ piece", None, None, None, None), (5, "On Law", "1990", None, None, None)]
    queries_ = spark.createDataFrame(asked, "query_id int, title string, year string, volume string, issue string, journal string")
    pairs = journals.title_candidates(queries_, articles, loose=True)
    got = {tuple(r) for r in journals.fitting_candidates(queries_, articles, pairs).collect()}
    assert got == {(1, 1), (3, 1), (3, 2), (4, 1)}
    text_ = spark.createDataFrame([(7, "front [page 3] The words\nstand here. [Page 4] And there.")], "article_id int, text string")
    spans = journals.page_spans(text_)
    assert [(r.label, r.text) for r in spans.orderBy("start").collect()] == [("3", " The words\nstand here. "), ("4", " And there.")]
    wanted = spark.createDataFrame([(1, 7, "the  words stand"), (2, 7, "and there"), (3, 7, "nowhere")], "item_id int, doc_id int, quote string")
    assert {(r.item_id, r.label) for r in journals.pages_of_quotes(wanted, spans).collect()} == {(1, "3"), (2, "4")}
    held = journals.article_texts(spark.createDataFrame([(7,), (8,)], "article_id int"), text_)
    assert {r.article_id: r.text[:5] for r in held.collect()} == {7: "front", 8: ""}


def test_origins_links_and_texts(spark):
    rows = [("IBID", "", None, "", "", None, True), ("SUPRA", "https://a", False, "Roe", "Roe", None, False), ("SUPRA", "https://a", True, "Roe", "[roe]", None, True), ("SUPRA", "other", None, "Roe", "Doe", True, False), ("SUPRA", "", None, "", "Doe", True, True)]
    got = spark.createDataFrame(rows, "k string, l string, d boolean, f string, o string, h boolean, w boolean").select(links.takes_origin(*[F.col(c) for c in "kldfoh"]).alias("r"), "w").collect()
    assert all(r.r == r.w for r in got)
    seen = spark.createDataFrame([("ALT_PINPOINT_MATCH", "c", "f", "s", "f"), ("OG_PINPOINT_MATCH", "c", "f", "s", "c"), ("NO_MATCH", "", None, "s", "s")], "st string, c string, f string, s string, w string")
    assert all(r.r == r.w for r in seen.select(links.target_link(F.col("st"), F.col("c"), F.col("f"), F.col("s")).alias("r"), "w").collect())
    parts = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "g int, i int, t string")
    assert {r.g: r.t for r in links.joined_text(parts, ["g"], "i", "t").collect()} == {1: "a\n\nb", 2: "c"}


def test_snapshots_sidecars_and_logs(spark, tmp_path):
    one, two = spark.range(3), spark.range(5)
    root = str(tmp_path / "snap")
    sinks.install(one, root, "r1"), sinks.install(two, root, "r2")
    assert sinks.installed(spark, root).count() == 5
    sinks.install(one, root, "r1")
    assert sinks.installed(spark, root).count() == 3
    about = sinks.write_sidecar(two, str(tmp_path / "side"), "out.xlsx", "2024-01-01T00:00:00").first()
    again = sinks.write_sidecar(two.orderBy(F.col("id").desc()), str(tmp_path / "side2"), "out.xlsx", "2024-01-02T00:00:00").first()
    assert about.rows == 5 and about.signature == again.signature != sinks.write_sidecar(one, str(tmp_path / "side3"), "o", "t").first().signature
    sinks.log_timings(spark, str(tmp_path / "log"), [("a", 1.5)]), sinks.log_timings(spark, str(tmp_path / "log"), [("b", 2.0)])
    assert {r.event for r in spark.read.json(str(tmp_path / "log")).collect()} == {"a", "b"}
    sinks.write_csv(one, str(tmp_path / "csv"), bom=True)
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfid")
    quotes_ = spark.createDataFrame([("d", 1, "q one"), ("d", 1, "q two")], "doc_key string, footnote_id int, quote string")
    targets_ = spark.createDataFrame([("d", 1, "supra_target", 4), ("d", 2, "ibid_target", 3)], "doc_key string, footnote_id int, reason string, source_footnote int")
    notes = spark.createDataFrame([("d", 1, "Doc", "text one")], "doc_key string, footnote_id int, doc_name string, footnote_text string")
    rows = {r.footnote_id: r for r in sinks.quote_manifest(quotes_, targets_, notes).collect()}
    assert tuple(rows["1"].asDict()) == sinks.MANIFEST and rows["1"].include_reason == "quote;supra_target" and rows["1"].quotes_json == '["q one","q two"]' and rows["1"].supra_source_footnotes == "4" and rows["2"].ibid_source_footnotes == "3" and rows["2"].doc_name == ""
    found = spark.createDataFrame([("a", "x", 5), ("b", "y", 2), ("c", "z", 5)], "path string, sha256 string, size long")
    manifest = spark.createDataFrame([("a", "x", 5), ("b", "w", 5), ("c", "w", 5), ("d", "w", 5)], "path string, sha256 string, size long")
    assert {r.path: r.state for r in inventory.verified(found, manifest).collect()} == {"a": "whole", "b": "partial", "c": "wrong", "d": "missing"}
    cache = spark.createDataFrame([("exact", "e1", "A"), ("neutral", "n1", "B"), ("legacy", "l2", "C")], "level string, key string, answer string")
    asked = spark.createDataFrame([(1, "e1", "n1", "l1"), (2, "e2", "n1", "l2"), (3, "e3", "n3", "l2"), (4, "x", None, "y")], "id int, request_key string, neutral_key string, legacy_key string")
    assert {r.id: (r.level, r.answer) for r in inventory.cached_answers(asked, cache).collect()} == {1: ("exact", "A"), 2: ("neutral", "B"), 3: ("legacy", "C"), 4: (None, None)}


def test_references_get_links_from_references(spark):
    rows = [
        ("d", 1, 1, "R v Ipeelee, 2012 SCC 13", "Ipeelee", "https://a.org/1"), ("d", 2, 2, "Ibid at para 5", "", None), ("d", 3, 2, "Ibid", "", None), ("d", 4, 3, "Ipeelee, supra note 1 at para 9", "", None), ("d", 5, 4, "Ibid at para 7", "", "wrong"),
        ("d", 6, 5, "Unknown, supra note 44", "", None), ("d", 7, 6, "Ibid", "", None), ("d", 8, 7, "Jane Doe, Law", "Doe", ""), ("d", 9, 8, "Doe, supra note 7", "", None), ("e", 1, 1, "Ibid", "", None),
    ]
    parts = spark.createDataFrame(rows, "doc_id string, seq int, note int, verbatim string, short_form string, link string").withColumn("more", F.lit(1))
    got = {(r.doc_id, r.seq): (r.link, r.method) for r in reg.reference_links(parts).collect()}
    assert got["d", 1] == ("https://a.org/1", None) and got["d", 2] == ("https://a.org/1#par5", "previous") and got["d", 3] == ("https://a.org/1", "previous")
    assert got["d", 4] == ("https://a.org/1#par9", "note_number") and got["d", 5] == ("https://a.org/1#par7", "previous") and got["d", 6] == (None, "abstain_no_match") and got["d", 7] == (None, None)
    assert got["d", 9] == (None, "abstain_unlinked_target") and got["e", 1] == (None, None) and len(got) == len(rows)


def test_fragment_directives_are_verified(spark):
    lines = spark.createDataFrame([(1, 0, "the court held so and the court erred"), (1, 1, "nothing else")], "doc_id int, block int, text string")
    rows = [(1, 1, "#:~:text=the%20court,-erred", "the court"), (2, 1, "#:~:text=the%20court", "the court"), (3, 1, "#:~:text=court%20held", "court held"), (4, 1, "#:~:text=court%20held", "other"), (5, 1, "#:~:text=the%20court,so,-and", "the court held so"), (6, 1, "#:~:text=so%20nothing", "so nothing")]
    got = {r.id: r.verified for r in fragments.verified_fragments(spark.createDataFrame(rows, "id int, doc_id int, directive string, target string"), lines).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_audit_rows_of_a_document(spark):
    rows = [
        ("d", "paragraph", 0, "", "Introduction. The rule is old.⟦FN:2⟧ It was kept.⟦FN:3⟧"), ("d", "paragraph", 1, "", "Courts follow it.⟦FN:4⟧"), ("d", "footnote", 2, "", "* Thanks to all."),
        ("d", "footnote", 3, "", "R v Able, 2020 SCC 5 at para 3 [Able]; Roe v Doe, 2019 ONCA 7."), ("d", "footnote", 4, "", "Able, supra note 1 at para 9."), ("d", "footnote", 5, "", "Ibid at para 2."), ("d", "footnote", 6, "", "Nobody, supra note 77."),
    ]
    got = {(r.footnote_id, r.part_index): r for r in audit.audit_rows(spark.createDataFrame(rows, "doc_key string, part string, number int, style string, text string")).collect()}
    assert set(got) == {(2, 1), (3, 1), (3, 2), (4, 1), (5, 1), (6, 1)} and [got[k].display for k in ((2, 1), (3, 1), (4, 1), (6, 1))] == ["*", "1", "2", "4"]
    assert got[4, 1].origin == "d/3/1" and got[5, 1].origin == "d/3/1" and got[5, 1].path == "IBID → SUPRA→3:1" and got[5, 1].ref_kind == "IBID" and got[3, 1].path == ""
    assert got[6, 1].origin is None and "not found" in got[6, 1].note and got[3, 1].proposition == "It was kept." and got[4, 1].proposition == "Courts follow it." and got[5, 1].proposition is None


def test_paragraphs_of_judgments(spark):
    xml = '<akn:body><paragraph eId="para_4"><num>4.</num><p>Costs &amp; fees.</p></paragraph>\n<paragraph class="x" eId="para_5"><num>5.</num> <p>The <i>rule</i> holds.</p></paragraph><paragraph eId="para_55"><p>Else</p></paragraph></akn:body><p>tail</p>'
    got = spark.createDataFrame([(xml, n) for n in (4, 5, 55, 6)] + [(None, 4)], "x string, n int").select(readers.legal_paragraph(F.col("x"), F.col("n")).alias("t")).collect()
    assert [r.t for r in got] == ["4. Costs & fees.", "5. The rule holds.", "Else", "", ""]


# ---- candidates, regions, closures and sums over whole tables


def test_overlap_candidates_are_all_plausible_pairs(spark, monkeypatch):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(60)] + list(text.STOP_WORDS[:6])
    weights = [1 / (i + 1) for i in range(60)] + [3] * 6
    say = lambda n: " ".join(draw.choices(words, weights, k=n))
    q = spark.createDataFrame([(i, say(draw.randint(1, 9))) for i in range(80)] + [(80, "to the of"), (81, ""), (82, "... !"), (83, "w1 w1 w1")], "item_id int, text string")
    d = spark.createDataFrame([(i, say(draw.randint(0, 60))) for i in range(120)] + [(120, ""), (121, None), (122, "the")], "doc_id int, text string")
    both = q.withColumnRenamed("text", "q").crossJoin(d.withColumnRenamed("text", "d"))
    want = {(r.item_id, r.doc_id) for r in both.filter(text.plausible(F.col("q"), F.col("d")) & (F.size(text.content_words(F.col("q"))) > 0)).collect()}
    bare = {(r.item_id, r.doc_id) for r in both.filter((F.size(text.content_words(F.col("q"))) == 0) & F.arrays_overlap(text.words(F.col("q")), text.words(F.col("d")))).collect()}
    for rows in (100_000, 0):  # broadcast, and dealt over tasks
        monkeypatch.setattr(shared, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(shared, "HOT_ROWS", 20)
        found = {(r.item_id, r.doc_id) for r in quotes.plausible_pairs(q, d).collect()}
        assert found == want | bare and len(want) > 500 and bare
        assert found <= {(r.item_id, r.doc_id) for r in quotes.overlap_candidates(q, d).collect()}


def test_exact_matches_equal_brute_force_for_short_and_cut_quotations(spark):
    draw = random.Random(9)
    say = lambda n: " ".join("".join(draw.choice("abé") for _ in range(draw.randint(1, 5))) for _ in range(n))
    sources = [(i, say(60)) for i in range(60)]
    asked = []
    for i in range(300):
        whole = draw.choice(sources)[1]
        at = draw.randrange(len(whole) - 14)
        asked.append((i, whole[at : at + draw.randint(1, 14)]))
    q, d = spark.createDataFrame(asked, "item_id int, text string"), spark.createDataFrame(sources, "doc_id int, text string")
    both = q.select("item_id", text.comparable(F.col("text")).alias("q")).crossJoin(d.select("doc_id", text.comparable(F.col("text")).alias("d")))
    want = {(r.item_id, r.doc_id) for r in both.filter(text.contained(F.col("q"), F.col("d"))).collect()}
    got = [(r.item_id, r.doc_id) for r in quotes.exact_matches(q, d).collect()]
    assert set(got) == want and len(got) == len(want) > 300


def test_best_region_equals_the_exhaustive_window():
    draw = random.Random(11)
    for n in (1, 5, 60, 400):
        source, quote = [draw.choice("abcdefgh") for _ in range(n)], [draw.choice("abcdxyz") for _ in range(draw.randint(1, 20))]
        size = min(len(quote), n)
        shares = [sum((Counter(source[i : i + size]) & Counter(quote)).values()) for i in range(n - size + 1)]
        lo, hi, shared = similarity.best_region(source, quote)
        assert (lo, hi, shared) == (shares.index(max(shares)), shares.index(max(shares)) + size, max(shares))


def test_regions_of_long_sources():
    draw = random.Random(12)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(3000)]
    filler = lambda n: " ".join(draw.choice(words) for _ in range(n))
    said = "the court held that no duty of care arises where the harm was not foreseeable at all"
    for front, rear in ((5000, 5000), (9000, 9000)):
        source = f"{filler(front)} {said} {filler(rear)}"
        changed = said.replace("the court held", "a panel ruled").replace("was not", "is hardly")
        for quote in (said, changed):
            assert said in similarity.region(source, quote) and len(similarity.region(source, quote)) < 1500
    assert similarity.fragment(f"{filler(6000)} {said} {filler(200)}", said) == said
    assert similarity.region("", "a") == "" and similarity.region("a b", "") == "a b"


@pytest.mark.parametrize(("quoted", "given", "shown"), [("testing", "test", "test[ing]"), ("untested", "tested", "[un]tested"), ("foobar", "fobar", "fo[o]bar"), ("test", "testing", None), ("taste", "test", None), ("test", "test", None), ("abcdefgh", "ab", None), ("a[b]c", "ac", None)])
def test_insertions_into_a_word(quoted, given, shown):
    assert similarity._inside(quoted, given) == shown


def test_closure_of_a_long_chain_takes_few_rounds(spark):
    n = 10_000
    edges = spark.range(n).selectExpr("id as source", "id + 1 as target").unionByName(spark.createDataFrame([(20_000, 20_001), (n, 3), (7, 30_000), (30_000, 30_001), (30_001, 9)], "source long, target long"))
    got = {r.node for r in chains.selection_closure(spark.createDataFrame([(0,)], "node long"), edges, rounds=20).collect()}
    assert got == set(range(n + 1)) | {30_000, 30_001}


def test_closure_equals_a_walk_on_branching_graphs(spark):
    draw = random.Random(13)
    for n, many in ((30, 40), (60, 200)):
        pairs = [(draw.randrange(n), draw.randrange(n)) for _ in range(many)]
        start = [draw.randrange(n), n + 5]
        seen, front = set(start), list(start)
        while front:
            node = front.pop()
            for a, b in pairs:
                if a == node and b not in seen:
                    seen.add(b)
                    front.append(b)
        edges = spark.createDataFrame(pairs, "source int, target int")
        assert {r.node for r in chains.selection_closure(spark.createDataFrame([(x,) for x in start], "node int"), edges).collect()} == seen


def test_running_sums_over_ranges(spark):
    draw = random.Random(14)
    rows = [(draw.randrange(50), i, draw.randrange(-5, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b int, w int").repartition(5)
    total, want = 0, {}
    for a, b, w in sorted(rows):
        total += w
        want[b] = total
    assert {r.b: r.s for r in sequences.running_sum(df, ["a", "b"], "w", "s").collect()} == want
    assert sequences.running_sum(df.limit(0), ["a", "b"], "w", "s").count() == 0


def test_lines_with_offsets(spark):
    texts = ["a\nbé\n\n😀c", "", "\n", None, "x" * 100_000 + "\ny"]
    got = quotes.line_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("block", F.lit(1))).collect()
    want = []
    for i, t in enumerate(texts):
        at = 0
        for j, line in enumerate((t or "").split("\n") if t is not None else []):
            want.append((i, j, at, at + len(line), line))
            at += len(line) + 1
    assert sorted(map(tuple, got)) == want


# ---- the scanner of notes


def test_names_are_left_whole_and_signals_measured_between_hard_places():
    cut = lambda t: [b[2] for b in boundaries.Note(t).boundaries()]
    assert cut("2020 SCC 1, Smith Jones v Brown, 2019 ONCA 7") == []
    assert cut("R v Able, 2020 SCC 1, citing Smith, quoting R v Baker, 2019 ONCA 7") == ["source_signal", "source_signal"]
    assert cut("R v A, 2020 SCC 1 (R v B, 2019 ONCA 7)") == [] and cut("doe note 5 at 3, roe note 6") == ["new_note_reference"]


@pytest.mark.parametrize("deep", [1, 3, 10])
def test_brackets_quotations_and_urls_hide_semicolons(deep):
    note = boundaries.Note
    for a, z in ("()", "[]", "{}"):
        text = a * deep + "R v A, 2001 SCC 1; x" + z * deep + "; R v B, 2002 SCC 2"
        assert note(text).sure_boundaries() == [(text.rindex(";"), text.rindex(";") + 1, "top_level_semicolon")]
    for text in ("“a; ” R v A, 2001 SCC 1", '"a;" R v A, 2001 SCC 1', "https://a.org/a;b", "(R v A, 2001 SCC 1; ]"):
        assert note(text).sure_boundaries() is None and not any(note(text).scan[1][i] for i, c in enumerate(text) if c == ";")


def test_of_overlapping_anchors_the_longest_stays():
    draw = random.Random(15)
    pieces = ["R v A, ", "2020 SCC 5", ", ", "[1990] 1 SCR 33", "(2001) 39:2 Hall LJ 7", "RSC 1985, c C-46", "(Toronto: Press, 2001)", " at 5", "https://a.org/x", "; ", "12 Foo 3, "]
    for _ in range(300):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(1, 8)))
        found = boundaries.anchors_of(text)
        assert found == sorted(found) and all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
        for kind, form in boundaries._FORMS.items():
            for m in form.finditer(text):
                over = [x for x in found if x[0] < m.end() and m.start() < x[1]]
                assert (m.start(), m.end(), kind) in found or max(x[1] - x[0] for x in over) >= m.end() - m.start()


# ---- propositions


@pytest.mark.parametrize(("text", "at", "said"), [
    ("First one. Then Smith v. Roe held it. Next", 36, "Then Smith v. Roe held it."), ("No end", 6, "No end"), ("It is 3.5 of all. Yes", 5, "It is 3.5 of all."), ("One ... two. Three", 5, "One ... two."), ("a\nb c\nd", 3, "b c"), ("He left.” She stayed.", 12, "She stayed."), ("", 0, ""),
])
def test_sentences_around_places(text, at, said):
    start, end = structure.sentence_around(text, at)
    assert text[start:end].strip() == said


def test_propositions_carry_their_state_over_paragraphs(spark):
    docs = {
        "a": ["A Study⟦FN:1⟧ of law", "Introduction", "The rule is old. It held⟦FN:2⟧ firm."],
        "b": ["Introduction The duty is owed.⟦FN:1⟧ So it is.⟦FN:2⟧ Again⟦FN:2⟧."],
        "c": ["He wrote “one. Two.", "", "Three” and left⟦FN:1⟧ us. “Open once. Closed⟦FN:2⟧” here."],
        "d": ["“Shut.” Then⟦FN:5⟧ more.", "Open “one. Two.⟦FN:6⟧ Three” is⟦FN:7⟧ it"],
    }
    body = spark.createDataFrame([(k, i, "paragraph", t) for k, v in docs.items() for i, t in enumerate(v)], "doc_key string, number int, part string, text string")
    got = {(r.doc_key, r.footnote_id, r.position): r.proposition for r in structure.propositions(body, readers.anchors(body)).collect()}
    assert got == {
        ("a", 1, 7): "", ("a", 2, 24): "It held firm.", ("b", 1, 30): "The duty is owed.", ("b", 2, 40): "So it is.", ("b", 2, 46): None, ("c", 1, 15): "He wrote “one. Two. Three” and left us.", ("c", 2, 38): "“Open once. Closed” here.",
        ("d", 5, 12): "Then more.", ("d", 6, 15): "Open “one. Two.", ("d", 7, 25): "Three” is it"}
    assert structure.propositions(body.limit(0), readers.anchors(body.limit(0))).collect() == []


# ---- links in order


def test_links_follow_the_order_of_the_document(spark):
    a, b = "https://a.org/1", "https://b.org/2"
    rows = [
        (1, 1, 1, "R v Able, 2020 SCC 1 [Able]", "Able", a), (1, 2, 2, "Able, supra note 1 at para 7 [Later]", "Later", None), (1, 3, 3, "Ibid at para 9", "", None), (1, 4, 4, "Later, supra at para 2", "", None),
        # a second 'Later' of another document, further down, makes the last of them ambiguous only
        (1, 5, 5, "R v Baker, 2020 SCC 2 [Later]", "Later", b), (1, 6, 6, "Later, supra at para 3", "", None), (1, 7, 7, "Ibid", "", None), (2, 1, 1, "Able, supra note 1", "", None), (2, 2, 2, "Ibid", "", None),
        # no word of the hint is in the named note; an entry by part of a word
        (3, 1, 1, "Workers v Crown, 2001 SCC 3", "", a), (3, 2, 2, "Worker, supra note 9", "", None), (3, 3, 3, "Nobody, supra note 1", "", None)]
    parts = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, seq int, note int, verbatim string, short_form string, link string, more string")
    got = {(r.doc_id, r.seq): (r.link, r.method) for r in reg.reference_links(parts).collect()}
    assert got == {
        (1, 1): (a, None), (1, 2): (a + "#par7", "note_number"), (1, 3): (a + "#par9", "previous"), (1, 4): (a + "#par2", "exact_sf"), (1, 5): (b, None), (1, 6): (None, "abstain_ambiguous_exact_sf"), (1, 7): (None, None),
        (2, 1): (None, "abstain_no_match"), (2, 2): (None, None), (3, 1): (a, None), (3, 2): (a, "token_verb"), (3, 3): (None, "abstain_no_match")}
    picks = spark.createDataFrame([(1, 6, 1), (2, 1, 1), (1, 2, 1)], "doc_id int, seq int, rank int")
    chosen = {(r.doc_id, r.seq): (r.link, r.method) for r in reg.reference_links(parts, choices=picks).collect()}
    first = {r.seq: r.link for r in reg.candidates(parts.filter("doc_id = 1 and seq = 6"), parts.filter("doc_id = 1 and seq < 6").withColumn("link", F.coalesce("link", F.lit(a)))).filter("rank = 1").collect()}
    assert chosen[1, 6] == (first[6].split("#")[0] + "#par3", "chosen") and chosen[1, 7] == (chosen[1, 6][0], "previous")
    assert {k: v for k, v in chosen.items() if k not in ((1, 6), (1, 7))} == {k: v for k, v in got.items() if k not in ((1, 6), (1, 7))}


def test_a_chain_of_references_takes_a_round_a_link(spark):
    rows = [(1, 0, 0, "R v Able, 2020 SCC 1 [N0]", "N0", "https://a.org/1")] + [(1, i, i, f"N{i - 1}, supra at para {i} [N{i}]", f"N{i}", None) for i in range(1, 6)]
    parts = spark.createDataFrame(rows, "doc_id int, seq int, note int, verbatim string, short_form string, link string")
    assert {r.seq: r.link for r in reg.reference_links(parts, rounds=8).collect()} == {0: "https://a.org/1"} | {i: f"https://a.org/1#par{i}" for i in range(1, 6)}
    with pytest.raises(RuntimeError):
        reg.reference_links(parts, rounds=3)


# ---- substrings, pointers


@pytest.mark.parametrize("rows", [100_000, 0])
def test_pieces_inside_texts_are_those_of_a_plain_search(spark, monkeypatch, rows):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    draw = random.Random(16)
    texts = [(i, "".join(draw.choice("abcÉ %_ ") for _ in range(draw.randint(0, 40)))) for i in range(150)] + [(150, None), (151, "")]
    pieces = [(i, "".join(draw.choice("abcé%_ ") for _ in range(draw.randint(1, 6)))) for i in range(200)] + [(200, "  "), (201, ""), (202, None), (203, "aBc")]
    got = [(r.piece_id, r.text_id) for r in journals.containing(spark.createDataFrame(pieces, "piece_id int, piece string"), spark.createDataFrame(texts, "text_id int, text string")).collect()]
    want = {(i, j) for i, p in pieces for j, t in texts if p and p.strip() and t and p.lower() in t.lower()}
    assert set(got) == want and len(got) == len(want) > 200
    none = spark.createDataFrame([], "piece_id int, piece string")
    assert journals.containing(none, spark.createDataFrame(texts, "text_id int, text string")).collect() == []


def test_cut_words_of_titles(spark):
    asked = spark.createDataFrame([(1, "aw of ontrac"), (2, "ontrac aw"), (3, "of"), (4, "zzz law"), (5, "2001 law")], "query_id int, title string")
    articles = spark.createDataFrame([(1, "The Lawyer's Contracts", "(2001) 1 X 1"), (2, "Contract without it", "y"), (3, None, None)], "article_id int, name_en string, citation_en string")
    assert {tuple(r) for r in journals.like_candidates(asked, articles).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert {tuple(r) for r in journals.like_candidates(asked, articles, loose=True).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (4, 1), (5, 1)}


def test_two_writers_never_take_one_number(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "snapshots")
    one = lambda i: sinks.install(spark.createDataFrame([(i,)], "n int"), root, f"r{i}")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(one, range(12)))
    taken = [r.number for r in sinks._pointers(spark, root).collect()]
    assert sorted(taken) == list(range(1, 13)) and {r.revision for r in sinks._pointers(spark, root).collect()} == {f"r{i}" for i in range(12)}
    one(99)
    assert [r.n for r in sinks.installed(spark, root).collect()] == [99]
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda i: sinks._created(spark, f"{root}/once", str(i)), range(16))) == 1


# ---- nested provisions


@pytest.mark.parametrize(("marks", "paths"), [
    ("1 a i ii iii iv v vi b", "1 1a 1ai 1aii 1aiii 1aiv 1av 1avi 1b"), ("1 a b i ii c d", "1 1a 1b 1bi 1bii 1c 1d"), ("1 g h i j", "1 1g 1h 1i 1j"), ("1 g h i ii j", "1 1g 1h 1hi 1hii 1j"), ("a i A B ii A", "a ai aiA aiB aii aiiA"),
    ("2 a 1 3 b", "2 2a 3 3b"), ("1 a a b", "1 1a 1b"), ("1 1.1 2", "1 1.1 2"), ("u v w", "u v w"), ("i ii iii iv v", "i ii iii iv v"), ("1 a xl", "1 1a 1axl"), ("zz 1", "1"),
])
def test_labels_by_what_may_follow(marks, paths):
    text = "\n".join(f"({m}) words" for m in marks.split())
    got = ["".join(p).replace("(", "").replace(")", "") for p, _, _ in structure.nested(text)]
    assert got == paths.split()


def test_provisions_of_sections(spark):
    law = "Duties of the Minister under this enactment.\n(1) Report.\n(2) Publish.\n(a) Public.\n(i) Every year."
    rows = [(1, "3", 50, law), (1, "4", 900, "4 (1) First\n(2) Second"), (2, "7", 0, "no provisions"), (3, "8", 0, None)]
    got = {(r.doc_id, r.locator): (r.start, r.end) for r in structure.provision_blocks(spark.createDataFrame(rows, "doc_id int, label string, start long, text string")).collect() if r.start is not None and r.end is not None}
    assert {k for k in got if k[0] == 1} == {(1, f"sec{x}") for x in ("3", "3(1)", "3(2)", "3(2)(a)", "3(2)(a)(i)", "4", "4(1)", "4(2)")} and got[1, "sec4(1)"] == (902, 912)
    assert got[1, "sec3"] == (50, 50 + len(law)) and got[1, "sec3(2)(a)(i)"] == (50 + law.index("(i)"), 50 + len(law)) and got[2, "sec7"] == (0, 13)
    assert [structure.roman(x) for x in ("iv", "IX", "xl", "mcmxc", "a", "")] == [4, 9, 40, 1990, None, None]


def test_judgments_and_feeds_that_are_no_xml(spark):
    table = spark.createDataFrame([(1, None), (2, ""), (3, "<a><b></a>"), (4, '<x><paragraph eId="para_1">a<num>1</num>b<p>c <i>d</i></p>e</paragraph><paragraph>no id</paragraph></x>')], "doc_id int, xml string")
    assert [tuple(r) for r in judgments.judgment_paragraphs(table).collect()] == [(4, "para_1", 1, "abc de")]
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link rel="alternate" type="{}" href="{}"/><identifier xmlns="n" type="ukncn">[2020] UKSC 1</identifier></entry></feed>'
    for kind, url, want in (("text/html", "https://A.org/1", "https://A.org/1#para_3"), ("application/pdf", "https://a.org/1", None), ("text/html", "http://a.org/1", None), ("text/html", "https://a.org.evil.com/1", None)):
        asked = spark.createDataFrame([(1, "[2020] uksc 1", 3)], "id int, citation string, number int")
        assert judgments.judgment_addresses(asked, spark.createDataFrame([(feed.format(kind, url),), (None,), ("<x",)], "feed string"), "a.org").first().url == want


# ---- fragments


def test_least_contexts_are_unique_and_no_smaller_ones_are():
    draw = random.Random(17)
    for _ in range(400):
        lines = [" ".join(draw.choice(["ab", "b", "abc", "c"]) for _ in range(draw.randint(0, 12))) for _ in range(4)]
        target = draw.choice([" ".join(draw.choice(["ab", "b", "c"]) for _ in range(draw.randint(1, 3))), "b a", "zz"])
        found = fragments.least_context(lines, target)
        places = lambda p, s: sum(line.count(" ".join(x for x in (p, target, s) if x)) for line in lines)
        tried = [(n, fragments._around(line, target, n)) for n in fragments.WINDOWS for line in lines if target in line]
        unique = [around for _, around in tried if places(*around) == 1]
        assert (found[0], found[3]) == unique[0] if unique else found is None
    long = " ".join(f"w{i}" for i in range(35))
    assert fragments.least_context([f"a {long} b"], long) == ("", "w0 w1 w2 w3 w4", "w30 w31 w32 w33 w34", "")
    assert fragments.least_context([f"a {long} b", "x w0 w1 w2 w3 w4 y"], long) == ("a", "w0 w1 w2 w3 w4", "w30 w31 w32 w33 w34", "")
    assert fragments.least_context([], "a") is None and fragments.least_context(["a"], "") is None
