"""Registered queries of the citation operators. The tables hold no citations, so they are made from customers, orders and parts, one
form beside another; the SQL says what must be read off each form, and repeats no rule of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import citations, fragments, keys, shortforms
from marginalia.operators import audit, boundaries, chains, journals, links, lookup, quotes, registry, scopes, sequences, splitting, structure
from marginalia.sources import judgments, readers, sinks
from marginalia.sources.shared import materialize


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _notes(spark, sf_dir: str) -> DataFrame:
    """A note a customer, in five forms."""
    k, n = F.col("c_custkey"), 1 + F.col("c_custkey") % 900
    forms = (
        _text("R v Able", k, ", 2020 SCC ", n, " at para 3; R v Baker", k, ", 2019 ONCA 7."), _text("R v Able", k, ", 2020 SCC ", n, ", citing R v Baker", k, ", [1990] 1 SCR 33."), _text("Ibid at para ", n, "."),
        _text("Criminal Code, RSC 1985, c C-46, s ", n, '. See Mary Roe, "On Law" (2001) 39:2 Osgoode Hall LJ ', n, "."), _text("R v Able", k, ", 2001 SCC ", n, " and R v Baker", k, ", 2002 SCC ", n))
    text = forms[4]
    for i in range(4):
        text = F.when(k % 5 == i, forms[i]).otherwise(text)
    return _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), k.alias("footnote_id"), text.alias("text"))


#: Per form its parts: verbatim, reason, kind, fragments, short form.
_PARTS = """n AS (SELECT c_nationkey AS doc_id, c_custkey AS footnote_id, c_custkey % 5 AS form, c_custkey::VARCHAR AS k, (1 + c_custkey % 900)::VARCHAR AS n FROM customer),
p AS (SELECT doc_id, footnote_id, unnest(CASE form
    WHEN 0 THEN [{'i': 1, 'v': 'R v Able' || k || ', 2020 SCC ' || n || ' at para 3', 'r': NULL, 'kind': 'case', 'f': 'par3', 's': ''}, {'i': 2, 'v': 'R v Baker' || k || ', 2019 ONCA 7.', 'r': 'semicolon', 'kind': 'case', 'f': '', 's': ''}]
    WHEN 1 THEN [{'i': 1, 'v': 'R v Able' || k || ', 2020 SCC ' || n || ',', 'r': NULL, 'kind': 'case', 'f': '', 's': ''}, {'i': 2, 'v': 'citing R v Baker' || k || ', [1990] 1 SCR 33.', 'r': 'source_signal', 'kind': 'case', 'f': '', 's': ''}]
    WHEN 2 THEN [{'i': 1, 'v': 'Ibid at para ' || n || '.', 'r': NULL, 'kind': 'other', 'f': 'par' || n, 's': 'Ibid'}]
    WHEN 3 THEN [{'i': 1, 'v': 'Criminal Code, RSC 1985, c C-46, s ' || n || '.', 'r': NULL, 'kind': 'statute', 'f': 'sec' || n, 's': ''}, {'i': 2, 'v': 'See Mary Roe, "On Law" (2001) 39:2 Osgoode Hall LJ ' || n || '.', 'r': 'new_citation_sentence', 'kind': 'journal', 'f': '', 's': 'Roe'}]
    ELSE [{'i': 1, 'v': 'R v Able' || k || ', 2001 SCC ' || n, 'r': NULL, 'kind': 'case', 'f': '', 's': ''}, {'i': 2, 'v': 'and R v Baker' || k || ', 2002 SCC ' || n, 'r': 'conjoined_citation', 'kind': 'case', 'f': '', 's': ''}] END) AS p FROM n)"""


def note_boundaries(spark, sf_dir):
    found = boundaries.recall_parts(_notes(spark, sf_dir))
    return found.select("doc_id", "footnote_id", "part_index", "verbatim", F.coalesce("reason", F.lit("")).alias("reason"))


def note_rules(spark, sf_dir):
    """A note a customer in seven forms that reach the rules which note_boundaries' forms don't: names that are not cut in two, signals in
    a row, cases, authors, notes, short forms and laws that follow each other."""
    k, n = F.col("c_custkey"), 1 + F.col("c_custkey") % 900
    forms = (
        _text("2020 SCC ", n, ", Smith Jones v Brown", k, ", 2019 ONCA 7"), _text("R v Able", k, ", 2020 SCC ", n, ", citing Smith, quoting R v Baker", k, ", 2019 ONCA 7"),
        _text("R v Able", k, ", 2020 SCC ", n, ", R v Baker", k, ", 2019 ONCA 7."), _text('Jane Doe, "One" (2001) 3 J ', n, ', John Poe, "Two" (2002) 5 K 6'), _text("Roe, supra note ", n, " at 20, Doe note 7"), _text("See Roe and Doe."),
        _text("Labour Act, RSC 1985, c L-", n, ", the Canada Evidence Act, RSC 1985, c C-5"))
    text = F.element_at(F.array(*forms), (k % 7 + 1).cast("int"))
    found = boundaries.recall_parts(_table(spark, sf_dir, "customer").select(k.alias("id"), text.alias("text")))
    return found.select("id", "part_index", "verbatim", F.coalesce("reason", F.lit("")).alias("reason"))


def nested_notes(spark, sf_dir):
    """Notes whose first semicolon lies one to ten brackets deep: they split without doubt at the other one."""
    k, deep = F.col("c_custkey"), (F.col("c_custkey") % 10 + 1).cast("int")
    text = F.concat(F.repeat(F.lit("("), deep), _text("R v Able", k, ", 2001 SCC 1; x"), F.repeat(F.lit(")"), deep), F.lit("; R v Baker, 2002 SCC 2"))
    return boundaries.conservative_parts(_table(spark, sf_dir, "customer").select(k.alias("id"), text.alias("text"))).select("id", "part_index", "start", "end")


def anchor_places(spark, sf_dir):
    """Where a text cites a case, twice, a law, an article, a book and a page of the web."""
    k, n = F.col("c_custkey"), 1 + F.col("c_custkey") % 900
    text = _text("R v Able", k, ", 2020 SCC ", n, ", [1990] 1 SCR ", n, "; Criminal Code, RSC 1985, c C-", n, '; Roe, "On Law" (2001) 39:2 Osgoode Hall LJ ', n, "; Poe, Law (Toronto: Press, 2001), online: https://a.org/", k)
    found = _table(spark, sf_dir, "customer").select(k.alias("id"), text.alias("_t")).select("id", "_t", F.inline(boundaries.anchor_spans(F.col("_t"))))
    return found.select("id", "kind", "start", "end")


def note_propositions(spark, sf_dir):
    """Five customers are the paragraphs of a document, in forms that end sentences in different ways; the fourth opens a quotation that the fifth,
    with the note, closes."""
    k = F.col("c_custkey")
    mark = F.concat(F.lit("⟦FN:"), k.cast("string"), F.lit("⟧"))
    forms = (
        _text("First ", k, " claim. Second claim stands", mark, " here. Third."), _text("He said “no duty. It ends here”.", mark, " More."), _text("See s. 7 of Act ", k, ", it holds.", mark, " Next."),
        _text("Value 3.5 is ", k, "? Then it is so. The panel wrote “first part ", k, "."), _text("Last part”, it added", mark, " then. Third."))
    body = _table(spark, sf_dir, "customer").select(F.expr("c_custkey div 5").alias("doc_key"), (k % 5).alias("number"), F.lit("paragraph").alias("part"), F.element_at(F.array(*forms), (k % 5 + 1).cast("int")).alias("text"))
    return structure.propositions(body, readers.anchors(body)).select("footnote_id", "position", "proposition")


def nested_provisions(spark, sf_dir):
    """A section a customer: letters to (b), one to nine Roman numerals below (b), then letters to (l) at most, of which (c), (d) and (i) are numerals too."""
    k = F.col("c_custkey")
    numerals = F.array(*map(F.lit, ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")))
    letters = F.array(*map(F.lit, "cdefghijkl"))
    marks = F.concat(F.array(F.lit("1"), F.lit("a"), F.lit("b")), F.slice(numerals, F.lit(1), (k % 9 + 1).cast("int")), F.slice(letters, F.lit(1), (k % 10 + 1).cast("int")))
    text = F.concat(k.cast("string"), F.lit(" "), F.array_join(F.transform(marks, lambda m: F.concat(F.lit("("), m, F.lit(") words"))), "\n"))
    laws = _table(spark, sf_dir, "customer").select(k.alias("doc_id"), k.cast("string").alias("label"), F.lit(100).cast("long").alias("start"), text.alias("text"))
    return structure.provision_blocks(laws).select("doc_id", "locator", "start", "end")


def judgment_paragraphs(spark, sf_dir):
    """Judgments of customers: a paragraph with its number, one with a nested one, character data and numeric entities, and one eId twice."""
    k = F.col("c_custkey")
    xml = _text(
        '<a:akomaNtoso xmlns:a="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><a:body><a:paragraph eId="para_', k + 1, '"><a:num>', k + 1, ".</a:num> <a:p>Held &#8220;", F.col("c_name"), "&#8221; &amp; others</a:p>\n</a:paragraph>",
        '<a:paragraph eId="para_', k + 2, '"><a:num>x</a:num><a:p>Outer <![CDATA[a < b]]></a:p> <a:paragraph eId="para_', k + 2, '__a"><a:num>(a)</a:num> <a:p>inner&#x20;', k, "</a:p></a:paragraph></a:paragraph>",
        '<a:paragraph eId="twice"><a:p>1</a:p></a:paragraph><a:paragraph eId="twice"><a:p>2</a:p></a:paragraph></a:body></a:akomaNtoso>')
    table = _table(spark, sf_dir, "customer").select(k.alias("doc_id"), xml.alias("xml"))
    return judgments.judgment_paragraphs(table).select("doc_id", "eid", F.coalesce("number", F.lit(-1)).alias("number"), "text")


def judgment_addresses(spark, sf_dir):
    """A feed a customer, whose entry has the customer's citation; every third customer has a second page, every fourth another host's."""
    k = F.col("c_custkey")
    entry = lambda host, page: _text('<entry><t:identifier type="ukncn">[2020] EWCA Civ ', k, '</t:identifier><link rel="self" href="https://a.org/x"/><link rel="alternate" href="https://', host, "/ewca/", k, page, '"/></entry>')
    feed = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:t="https://t.org">'), F.when(k % 4 == 0, entry("b.org", "")).otherwise(entry("a.org", "")), F.when(k % 3 == 0, entry("a.org", "/2")).otherwise(""), F.lit("</feed>"))
    customer = _table(spark, sf_dir, "customer")
    asked = customer.select(k.alias("id"), _text("[2020]  EWCA Civ ", k).alias("citation"), F.when(k % 2 == 0, k % 50).alias("number"))
    return judgments.judgment_addresses(asked, customer.select(feed.alias("feed")), "a.org").select("id", F.coalesce("url", F.lit("")).alias("url"))


def snapped_parts(spark, sf_dir):
    """Proposed parts of a note, with other white space than the note's, one that doesn't stand in it, and one that repeats the first."""
    k = F.col("c_custkey")
    parts = F.array(_text("Roe", k, ", Law 1"), _text("Doe, Law ", k), F.lit("nothing"), _text("Roe", k, ", Law 1"), F.lit("Poe"))
    notes = _table(spark, sf_dir, "customer").select(k.alias("id"), _text("Roe", k, ",\tLaw 1; Doe, Law\n", k, ", Roe", k, ", Law 1, Poe").alias("text"), parts.alias("parts"))
    found = boundaries.snapped(notes).select("id", F.posexplode("snapped").alias("i", "p"))
    return found.select("id", "i", F.coalesce("p.start", F.lit(-1)).alias("start"), F.coalesce("p.end", F.lit(-1)).alias("end"), F.coalesce("p.verbatim", F.lit("")).alias("verbatim"))


def quoted_pages(spark, sf_dir):
    """Names and brands looked for on the pages of articles made of them, with other white space and case."""
    part = _table(spark, sf_dir, "part")
    articles = part.select(F.col("p_partkey").alias("article_id"), _text("front [page 3] words (", F.col("p_name"), ")\nhere. [Page 4] And ", F.col("p_brand"), " there.").alias("text"))
    asked = part.select(F.col("p_partkey").alias("item_id"), F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("("), F.replace(F.upper("p_name"), F.lit(" "), F.lit("  ")), F.lit(")\there"))).when(F.col("p_size") % 3 == 1, F.col("p_brand")).otherwise("nowhere").alias("quote"))
    return journals.pages_of_quotes(asked, journals.page_spans(articles)).select("item_id", "label")


def rows_by_place(spark, sf_dir):
    """The rows of files at the places that an index names, and fields that the corpus lacks."""
    k = F.col("c_custkey")
    corpus = _table(spark, sf_dir, "customer").select(_text("f", k % 3).alias("path"), F.expr("c_custkey div 3").alias("row"), "c_name")
    located = _table(spark, sf_dir, "orders").select("o_orderkey", _text("f", F.col("o_custkey") % 4).alias("path"), F.expr("o_custkey div 3").alias("row"))
    found = lookup.fetch_rows(located, corpus, ("c_name", "missing"))
    return found.select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("c_name"), F.coalesce("missing", F.lit("")).alias("missing"))


def case_locks(spark, sf_dir):
    """Cases by citation where their court is in the corpus, by alias where only the alias's is, and otherwise not covered."""
    k = F.col("c_custkey")
    customer = _table(spark, sf_dir, "customer")
    corpus = customer.filter(k % 5 > 0).select(F.lit("SCC").alias("dataset"), k.alias("row_id"), _text("2020 SCC ", k).alias("citation_en"))
    aliases = customer.select(keys.citation_key(_text("2019 XYZ ", k), True).alias("citation_key"), _text("2020 SCC ", k).alias("canonical_citation"))
    asked = customer.select(k.alias("id"), F.when(k % 3 == 0, _text("2020 SCC ", k)).when(k % 3 == 1, _text("2019 XYZ ", k)).otherwise(_text("2018 ABC ", k)).alias("citation"))
    return lookup.locked_cases(asked, corpus, aliases).select("id", "method", "status", F.coalesce(F.col("row_id").cast("long"), F.lit(-1)).alias("row_id"))


def checked_fragments(spark, sf_dir):
    """Directives for words that stand once, twice, with context that tells them apart, and over a line's end."""
    k = F.col("c_custkey")
    customer = _table(spark, sf_dir, "customer")
    lines = customer.select(k.alias("doc_id"), F.posexplode(F.array(_text("alpha word ", k, " beta"), _text("gamma word ", k, " delta once"), F.lit("the end"))).alias("block", "text"))
    word = _text("word ", k)
    target = F.when(k % 4 == 0, F.lit("once")).when(k % 4 < 3, word).otherwise("once the")
    named = fragments.directive(F.when(k % 4 == 2, F.lit("alpha")), target, F.lit(""), F.lit(""))
    return fragments.verified_fragments(customer.select(k.alias("id"), k.alias("doc_id"), named.alias("directive"), target.alias("target")), lines).select("id", "verified")


def audited_documents(spark, sf_dir):
    """Three customers are a document: paragraphs with a note each, a citation, an ibid and a supra by the printed number."""
    k, d, form = F.col("c_custkey"), F.expr("c_custkey div 3"), F.col("c_custkey") % 3
    customer = _table(spark, sf_dir, "customer")
    key = _text("d", d)
    body = customer.select(key.alias("doc_key"), F.lit("paragraph").alias("part"), form.cast("int").alias("number"), F.lit("").alias("style"), _text("An old one. Claim ", k, " stands.⟦FN:", k + 1, "⟧ More.").alias("text"))
    note = F.element_at(F.array(_text("R v Able", d, ", 2020 SCC ", k + 1, " [Able", d, "]."), _text("Ibid at para 2."), _text("Able", d, ", supra note 1 at para 9.")), (form + 1).cast("int"))
    notes = customer.select(key.alias("doc_key"), F.lit("footnote").alias("part"), (k + 1).cast("int").alias("number"), F.lit("").alias("style"), note.alias("text"))
    rows = audit.audit_rows(body.unionByName(notes))
    return rows.select("doc_id", "footnote_id", "display", "ref_kind", "origin", "path", "proposition")


def part_fields(spark, sf_dir):
    found = splitting.split_notes(_notes(spark, sf_dir))
    return found.select("doc_id", "footnote_id", "part_index", "kind", F.array_join("fragments", ",").alias("fragments"), "short_form", "status")


def conservative_notes(spark, sf_dir):
    """Notes that split without doubt, with the number of their parts: all forms but the one joined by 'and'."""
    return boundaries.conservative_parts(_notes(spark, sf_dir)).groupBy("doc_id", "footnote_id").agg(F.count(F.lit(1)).alias("parts"))


def _registry(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Citations, one a customer in the document of its nation, and references to them that reach every tier."""
    k = F.col("c_custkey")
    link = F.when(k % 7 == 0, "").otherwise(_text("https://a.org/", k, "#par1"))
    verbatim = _text("R v Accused", k, "y, 2020 SCC 5 ", F.when(k % 3 == 0, F.repeat(F.lit("and more "), 30)).otherwise(F.lit("")), "[Alias", k, "z]")
    c = _table(spark, sf_dir, "customer")
    entries = c.select(F.col("c_nationkey").alias("doc_id"), k.alias("seq"), k.alias("note"), _text("Form", k, "x").alias("short_form"), verbatim.alias("verbatim"), link.alias("link"), F.lit("case").alias("kind"))
    said = (_text("Form", k, "x, supra note ", k), _text("Form", k, "x, supra note 999999999"), F.lit("supra note 999999999"), _text("Nobody", k, ", supra note ", k), _text("see the Form", k, "x, supra note 999999999"), _text("Accused", k, "y, supra note 999999999"), _text("Alias", k, "z, supra note 999999999"))
    asked = said[6]
    for i in range(6):
        asked = F.when(k % 11 == i, said[i]).otherwise(asked)
    return c.select(F.col("c_nationkey").alias("doc_id"), (k + 1_000_000_000).alias("seq"), asked.alias("verbatim")), entries


def supra_tiers(spark, sf_dir):
    asked, entries = _registry(spark, sf_dir)
    return registry.resolve_supra(asked, entries).select("doc_id", "seq", "link", "method")


_SUPRA = """WITH r AS (SELECT c_nationkey AS doc_id, c_custkey + 1000000000 AS seq, c_custkey % 11 AS form, c_custkey % 7 <> 0 AS linked, c_custkey % 3 = 0 AS far, 'https://a.org/' || c_custkey || '#par1' AS l FROM customer),
m AS (SELECT *, CASE WHEN form = 0 THEN CASE WHEN linked THEN 'note_number' ELSE 'abstain_unlinked_target' END WHEN form = 2 THEN 'abstain_no_hint' WHEN form = 3 OR NOT linked THEN 'abstain_no_match'
    WHEN form = 1 THEN 'exact_sf' WHEN form = 4 THEN 'token_sf' WHEN form = 5 OR NOT far THEN 'token_verb' ELSE 'bracket_definition' END AS method FROM r)
SELECT doc_id, seq, CASE WHEN method NOT LIKE 'abstain%' THEN l END AS link, method FROM m"""


def ordered_links(spark, sf_dir):
    """Five customers are a document: a citation, a supra to it with a short form of its own, an ibid to that, a supra by the new short form,
    and an ibid to that, so that links take three rounds to reach all."""
    k, d = F.col("c_custkey"), F.expr("c_custkey div 5")
    form = F.col("c_custkey") % 5
    verbatim = F.element_at(F.array(_text("R v Able", d, ", 2020 SCC 1"), _text("Able", d, ", supra note 1 at para 7"), _text("Ibid at para 9"), _text("Later", d, ", supra at para 11"), _text("Ibid at para 12")), (form + 1).cast("int"))
    short = F.when(form == 0, _text("Able", d)).when(form == 1, _text("Later", d)).otherwise("")
    parts = _table(spark, sf_dir, "customer").select(d.alias("doc_id"), form.alias("seq"), (form + 1).alias("note"), verbatim.alias("verbatim"), short.alias("short_form"), F.when(form == 0, _text("https://a.org/", d, "#par1")).alias("link"))
    return registry.reference_links(parts).select("doc_id", "seq", F.coalesce("link", F.lit("")).alias("link"), F.coalesce("method", F.lit("")).alias("method"))


def note_guard(spark, sf_dir):
    """Links proposed for the same references: the customer's own, but a wrong one for every fourth."""
    asked, entries = _registry(spark, sf_dir)
    k = F.col("seq") - 1_000_000_000
    proposed = asked.withColumn("verbatim", _text("X, supra note ", k)).withColumn("link", F.when(k % 4 == 0, "https://elsewhere.org").otherwise(_text("https://a.org/", k)))
    return registry.note_guard(proposed, entries).select("doc_id", "seq", "allowed")


def fallback_links(spark, sf_dir):
    """References by a party's name, which no entry has as its short form, and by bare numbers."""
    asked, entries = _registry(spark, sf_dir)
    k = F.col("seq") - 1_000_000_000
    named = asked.withColumn("verbatim", F.when(k % 2 == 0, _text("Accused", k, ", supra note 5")).otherwise(_text("supra note ", k)))
    cases = entries.withColumn("short_form", F.lit("")).withColumn("verbatim", _text("R v Accused", F.col("seq"), ", 2020 SCC 5"))
    return registry.fallback_links(named, cases).select("doc_id", "seq", "link", "method")


def inferred_forms(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, _text("R v Accused", k, ", 2020 SCC 5")).when(k % 3 == 1, F.lit("Fair Labour Standards Act, RSC 1985, c L-2")).otherwise(F.lit('Mary Roe and John Doe, "Law" (2001) 1 X 2'))
    kind = F.when(k % 3 == 0, "case").when(k % 3 == 1, "statute").otherwise("journal")
    c = _table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.inline(shortforms.inferred_forms(text, kind)))


def chain_paths(spark, sf_dir):
    """An order points to its customer's order before it; the path names the priorities on the way to the first."""
    orders = _table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    parts = orders.select(F.col("o_orderkey").alias("part"), F.lag("o_orderkey").over(w).alias("target"), F.substring("o_orderpriority", 1, 1).alias("label"))
    return chains.chain_paths(chains.resolve_chains(parts), "label").select("part", "path")


def deep_closure(spark, sf_dir):
    """What a customer's last order needs: all before it, however many."""
    orders = _table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    edges = orders.select(F.col("o_orderkey").alias("source"), F.lag("o_orderkey").over(w).alias("target"), F.lead("o_orderkey").over(w).alias("_next"))
    return chains.selection_closure(edges.filter("_next is null").select(F.col("source").alias("node")), edges.filter("target is not null").select("source", "target"))


def provision_ranges(spark, sf_dir):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    text = F.when(n % 2 == 0, _text("ss ", n, "-", n + 3, ", ", q + 100)).otherwise(_text("s ", n, "-", n + 3, " and ", q + 100, "(1) to (3)"))
    found = _table(spark, sf_dir, "lineitem").select(text.alias("cited")).groupBy("cited").agg(F.count(F.lit(1)).alias("n"))
    return found.select("cited", "n", F.array_join(scopes.cited_provisions(F.col("cited")), " ").alias("provisions"))


def _laws(spark, sf_dir: str) -> DataFrame:
    """A law a brand: a section a part, by number."""
    line = F.struct("n", _text(F.col("n"), " The ", F.col("p_name"), " shall be kept in good order by its owner").alias("line"))
    numbered = _table(spark, sf_dir, "part").withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    return numbered.groupBy(F.col("p_brand").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"))


def section_structure(spark, sf_dir):
    return structure.sections(_laws(spark, sf_dir)).select("doc_id", "label", "start", "end")


def _paged(spark, sf_dir: str) -> DataFrame:
    """A report a customer of several orders: a page an order, from page 12 on."""
    line = F.struct("n", _text("[page ", F.col("n") + 11, "]\n", F.col("o_orderpriority"), " order").alias("line"))
    numbered = _table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n")
    return numbered.groupBy(F.col("o_custkey").alias("doc_id")).agg(_text("front\n", listed).alias("text"), F.lit(11).alias("first"))


def page_structure(spark, sf_dir):
    return structure.pages(_paged(spark, sf_dir), first="first").groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.min("label").alias("first"), F.max("end").alias("end"))


def provision_paths(spark, sf_dir):
    """A provision a region: nations as (1), (a) and (b) by turns."""
    numbered = _table(spark, sf_dir, "nation").withColumn("n", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    mark = F.when(F.col("n") % 3 == 0, _text("(", (F.col("n") / 3).cast("int") + 1, ")")).when(F.col("n") % 3 == 1, "(a)").otherwise("(b)")
    line = F.struct("n", _text(mark, " ", F.col("n_name")).alias("line"))
    laws = numbered.groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"))
    return structure.provisions(laws).select("doc_id", "block", "path")


def section_maps(spark, sf_dir):
    """Section maps as JSON: two sections and a schedule of every part."""
    part = _table(spark, sf_dir, "part")
    laws = part.select(F.col("p_partkey").alias("doc_id"), _text('{"', F.col("p_size"), '": "', F.col("p_name"), '", "Schedule": "none", "', F.col("p_size") + 1, '.5": "', F.col("p_brand"), '"}').alias("sections"))
    return structure.section_map(laws, "sections").select("doc_id", "label", "start", "end", "text")


def cited_sections(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    asked = part.select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("doc_id"), F.array(_text(F.col("p_size"), "(1)(a)"), F.lit("999")).alias("sections"))
    blocks = part.select(F.col("p_brand").alias("doc_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(_text(F.col("p_size"), "(1)")).alias("label")).distinct()
    return scopes.cited_sections(asked, blocks).select("item_id", "doc_id", "label", "exact")


def specific_labels(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    label = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise(_text(F.col("p_size"), "(", F.col("p_partkey") % 3, ")"))
    found = part.groupBy(F.col("p_brand").alias("item_id"), label.alias("label")).agg(F.max(F.round(F.col("p_retailprice") / 100000, 2)).alias("score"))
    return scopes.specific_labels(found).select("item_id", "label")


def combined_ranges(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    rows = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").cast("string").alias("text"))
    ranges = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("r").alias("scope"), F.lit(1).alias("low"), F.when(F.col("o_orderkey") % 2 == 0, 2).otherwise(3).alias("high"))
    return sequences.combined_ranges(rows, ranges, "l_orderkey", "l_linenumber", "text").select("l_orderkey", "high", "text")


def identity_lookup(spark, sf_dir):
    """Customers by citation with a pinpoint, parts by name as an ambiguous citation, and citations that nobody has."""
    customer, part = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "part")
    corpus = customer.select(F.col("c_custkey").alias("row_id"), _text("2020 SCC ", F.col("c_custkey")).alias("citation_en"), F.lit(None).cast("string").alias("citation2_en")).unionByName(
        part.select((F.col("p_partkey") + 10_000_000).alias("row_id"), _text("2021 BCCA ", F.col("p_size")).alias("citation_en"), _text("[2021] 1 SCR ", F.col("p_partkey")).alias("citation2_en")))
    k = F.col("c_custkey")
    asked = customer.select(k.alias("id"), F.when(k % 4 == 0, _text("2020 S.C.C. ", k, " at para 5")).when(k % 4 == 1, _text("[2021] 1 SCR ", k)).when(k % 4 == 2, _text("2021 BCCA ", 1 + k % 50)).otherwise(_text("2019 ONCA ", k)).alias("citation"))
    return lookup.identities(asked, corpus, unicode=False).select("id", "status", F.coalesce("row_id", F.lit(-1)).alias("row_id"))


def law_datasets(spark, sf_dir):
    """What datasets and addresses follow from a law's citation, by form."""
    k = F.col("c_custkey")
    cite = F.when(k % 4 == 0, _text("RSC 1985, c C-", k)).when(k % 4 == 1, _text("NB Reg 82-", k)).when(k % 4 == 2, _text("2020 BCCA ", k)).otherwise(F.lit("an unknown law"))
    c = _table(spark, sf_dir, "customer").select("c_custkey", cite.alias("cite")).withColumn("dataset", citations.dataset_of(F.col("cite")))
    return c.select("c_custkey", F.coalesce("dataset", F.lit("")).alias("dataset"), F.coalesce(citations.law_url(F.col("dataset"), F.col("cite")), F.lit("")).alias("url"))


def current_laws(spark, sf_dir):
    k = F.col("c_custkey")
    dataset = F.when(k % 2 == 0, "LEGISLATION-FED").otherwise("REGULATIONS-NB")
    url = F.when(k % 3 == 0, _text("https://laws-lois.justice.gc.ca/eng/XML/C-", k, ".xml")).when(k % 3 == 1, _text("https://laws.gnb.ca/en/document/cr/", k)).otherwise(_text("https://laws.gnb.ca/fr/document/cr/", k))
    return _table(spark, sf_dir, "customer").select("c_custkey", citations.current_law_source(dataset, url).alias("current"))


def journal_filters(spark, sf_dir):
    """Candidates by title that fit year, volume and journal as cited."""
    part = _table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.min("p_size").alias("s"), F.min("p_brand").alias("b"))
    articles = part.select(F.col("k").alias("article_id"), F.col("p_name").alias("name_en"), F.lit("none").alias("citation_en"), _text(F.col("s") + 1960, "-05-01").alias("document_date_en"), F.col("s").cast("string").alias("volume"), F.lit("").alias("issue"), F.col("b").alias("journal_name"), F.lit("").alias("journal_abbrev"))
    asked = part.select(F.col("k").alias("query_id"), F.col("p_name").alias("title"), (F.col("s") + 1960 + F.col("k") % 3).cast("string").alias("year"), F.lit(None).cast("string").alias("volume"), F.lit(None).cast("string").alias("issue"), F.lower("b").alias("journal"))
    return journals.fitting_candidates(asked, articles, journals.title_candidates(asked, articles)).filter("query_id = article_id").select("query_id")


def page_links(spark, sf_dir):
    """Pins of lines: to the mapped page for lines of three and more, else by counting from the first page."""
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    pins = lines.select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("page")).distinct()
    articles = orders.select(F.col("o_orderkey").alias("article_id"), _text("https://a.org/", F.col("o_orderkey"), "#x").alias("galley_url"), F.lit("2").alias("first_page"))
    mapped = pins.filter("page >= 3").select("article_id", F.col("page").cast("string").alias("page_label"), (F.col("page") * 10).alias("pdf_page"), F.lit(1).alias("page_order"))
    return journals.page_links(pins, articles, mapped).select("article_id", "page", "link")


def origin_fields(spark, sf_dir):
    """An order's origin is the order whose key is its customer's: its priority, never its own."""
    orders = _table(spark, sf_dir, "orders")
    rows = orders.select(F.lit("d").alias("doc_id"), F.col("o_orderkey").cast("string").alias("display_key"), (-F.col("o_orderkey")).cast("string").alias("internal_key"), F.col("o_custkey").cast("string").alias("origin_key"), F.col("o_orderpriority").alias("priority"))
    return links.attach_origin(rows, ("priority",)).select("display_key", F.coalesce("origin_priority", F.lit("")).alias("origin_priority"))


def slug_repairs(spark, sf_dir):
    k = F.col("c_custkey")
    c = _table(spark, sf_dir, "customer")
    laws = c.select(_text("RSC ", k).alias("citation"), _text("https://a.org/laws/stat/rsc-", k, "/x").alias("url")).unionByName(c.filter("c_custkey % 3 = 0").select(_text("RSC ", k).alias("citation"), _text("https://a.org/laws/stat/other-", k, "/x").alias("url")))
    rows = c.select(k.alias("id"), F.when(k % 2 == 0, _text("https://a.org/laws/stat/wrong-", k, "/x")).otherwise(_text("https://a.org/doc/", k)).alias("link"), _text("R.S.C. ", k).alias("citation"))
    return links.repair_slugs(rows, laws).select("id", "repaired")


def link_cascade(spark, sf_dir):
    k = F.col("c_custkey")
    some = lambda n: F.when(k % n == 0, _text("https://", n, ".org/", k))
    link, method = links.cascade(("identity", some(F.lit(5))), ("provider", F.when(k % 3 == 0, F.lit(" ")).otherwise(some(F.lit(2)))), ("author", some(F.lit(7))))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(link, F.lit("")).alias("link"), F.coalesce(method, F.lit("")).alias("method"))


def quotation_manifest(spark, sf_dir):
    """Purchases as quotations, errors as notes that others point to."""
    events = _table(spark, sf_dir, "events")
    key, note = F.concat(F.lit("d"), F.col("user_id").cast("string")), F.col("event_id") % 7
    quoted = events.filter("event_type = 'purchase'").select(key.alias("doc_key"), note.alias("footnote_id"))
    pointed = events.filter("event_type = 'error'").select(key.alias("doc_key"), note.alias("footnote_id"), F.lit("supra_target").alias("reason"))
    return sinks.quote_manifest(quoted, pointed)


def fragment_links(spark, sf_dir):
    """Links to the words of passages in documents that have them: the least context that names one place."""
    passages, docs = _table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents")
    found = quotes.exact_matches(passages, docs)
    head = F.regexp_extract("text", "^(\\S+(?:\\s+\\S+){0,4})", 1)
    targets = found.join(passages, "item_id").select(_text(F.col("item_id"), "/", F.col("doc_id")).alias("id"), "doc_id", head.alias("target"))
    lines = quotes.line_blocks(docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi"))
    return fragments.unique_fragments(targets, lines).select("id", "directive")


def made_fragments(spark, sf_dir):
    """Links to words that stand once, to words that their neighbours tell apart, and to a long passage by its ends."""
    k = F.col("c_custkey")
    long = _text("begin ", k, " of it now ", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " "), " and here it ends")
    customer = _table(spark, sf_dir, "customer")
    lines = customer.select(k.alias("doc_id"), F.posexplode(F.array(_text("alpha  word ", k, " beta"), _text("gamma word ", k, " delta once"), F.concat(F.lit("so "), long, F.lit(" indeed")))).alias("block", "text"))
    target = F.when(k % 4 == 0, F.lit("once")).when(k % 4 == 1, _text("word ", k)).when(k % 4 == 2, long).otherwise("nowhere")
    found = fragments.unique_fragments(customer.select(k.alias("id"), k.alias("doc_id"), target.alias("target")), lines)
    checked = fragments.verified_fragments(found.filter("directive is not null").select("id", "doc_id", "directive", "target"), lines).select("id", "verified")
    return found.join(checked, "id", "left").select("id", F.coalesce("directive", F.lit("")).alias("directive"), F.coalesce("verified", F.lit(False)).alias("verified"))


def quote_corrections(spark, sf_dir):
    """Partial matches shown with the words of their sources."""
    passages, docs = _table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents")
    pairs = quotes.ngram_candidates(passages, docs).select("item_id", "doc_id")
    return quotes.corrections(quotes.scored(pairs, passages, docs).filter("not exact"), passages, docs)


def quote_resolution(spark, sf_dir):
    """Passages resolved over the lines of documents that share words with them, the first three lines cited."""
    passages, docs = _table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents")
    pairs = materialize(quotes.ngram_candidates(passages, docs, least=3).select("item_id", "doc_id"), "pairs")  # the corpus is read once for them
    near = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    ranges = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.lit(2).cast("long").alias("high")))
    asked = pairs.join(passages.select("item_id", F.col("text").alias("quote")), "item_id").withColumn("ranges", ranges)
    found = scopes.resolve_scored(asked, quotes.line_blocks(near).select("doc_id", F.col("block").cast("long").alias("number"), "text"), near)
    return found.select("item_id", "doc_id", "location", "score", F.array_join("labels", ",").alias("labels"))


def _altered(words: Column) -> Column:
    """A text's words, every fourth with zqq for its letters, but for the first and last: no run of four words is left."""
    return F.array_join(F.transform(words, lambda w, i: F.when((i % 4 == 3) & (i < F.size(words) - 1), F.regexp_replace(w, "\\p{L}+", "zqq")).otherwise(w)), " ")


def _passages(spark, sf_dir) -> DataFrame:
    """Passages as single lines (text) and altered (quote)."""
    words = F.split(F.trim(F.regexp_replace("text", "\\s+", " ")), " ")
    return _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, " ").alias("text"), _altered(words).alias("quote"))


def made_quote_corrections(spark, sf_dir):
    """Altered passages against all passages: no run is shared, and the score is the share of tokens left. What was changed is shown in brackets."""
    passages = _passages(spark, sf_dir)
    asked, sources = passages.select("item_id", F.col("quote").alias("text")), passages.select(F.col("item_id").alias("doc_id"), "text")
    scores = quotes.scored(quotes.overlap_candidates(asked, sources), asked, sources)
    return quotes.corrections(scores, asked, sources).select("item_id", "doc_id", "exact", "score", "corrected")


def made_best_source(spark, sf_dir):
    """Altered passages against all passages, of which every third stands in two sources: then there is no clear winner."""
    passages = _passages(spark, sf_dir)
    asked = passages.select("item_id", F.col("quote").alias("text"))
    sources = passages.select(F.col("item_id").alias("doc_id"), "text").unionByName(passages.filter("item_id % 3 = 0").select((F.col("item_id") + 1_000_000).alias("doc_id"), "text"))
    return quotes.clear_winner(quotes.scored(quotes.overlap_candidates(asked, sources), asked, sources))


def made_quote_resolution(spark, sf_dir):
    """Four passages are the blocks of a document; each, altered or as it is, is looked for in its document, with its own block, another or none cited."""
    passages = _passages(spark, sf_dir).withColumn("doc_id", F.expr("item_id div 4"))
    number = (F.col("item_id") % 4 + 1).cast("long")
    blocks = passages.select("doc_id", number.alias("number"), "text")
    sources = passages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    one = lambda n: F.array(F.struct(n.alias("low"), n.alias("high")))
    cited = F.when(F.col("item_id") % 5 < 2, one(number)).when(F.col("item_id") % 5 == 2, one(number % 4 + 1)).when(F.col("item_id") % 5 == 3, one(number + 90)).otherwise(F.array().cast("array<struct<low: bigint, high: bigint>>"))
    asked = passages.select("item_id", "doc_id", F.when(F.col("item_id") % 2 == 0, F.col("quote")).otherwise(F.col("text")).alias("quote"), cited.alias("ranges"))
    found = scopes.resolve_scored(asked, blocks, sources)
    return found.select("item_id", "doc_id", "location", "score", F.array_join("labels", ",").alias("labels"))


#: Passages altered as _altered does, the tokens of a quotation without marks at its end, and how many of them are as they were.
_MADE = """w AS (SELECT item_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM benchmark),
a AS (SELECT item_id, w, array_to_string(list_transform(w, lambda x, i: CASE WHEN (i - 1) % 4 = 3 AND i < len(w) THEN regexp_replace(x, '\\p{L}+', 'zqq', 'g') ELSE x END), ' ') AS quote,
    array_to_string(list_transform(w, lambda x, i: CASE WHEN (i - 1) % 4 = 3 AND i < len(w) THEN regexp_replace(x, '\\p{L}+', '[zqq]', 'g') ELSE x END), ' ') AS shown FROM w),
t AS (SELECT *, regexp_extract_all(regexp_replace(quote, '[.,;:!?]+$', ''), '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]') AS t FROM a),
m AS (SELECT item_id, array_to_string(w, ' ') AS text, quote, shown, round(1 - len(list_filter(t, lambda x: x = 'zqq')) / len(t), 6) AS score FROM t)"""


def supra_targets(spark, sf_dir):
    """References of every second customer to the note of the customer before it in its document, by name, to its second part."""
    notes = _notes(spark, sf_dir).filter("footnote_id % 5 = 0")
    w = Window.partitionBy("doc_id").orderBy("footnote_id")
    asked = notes.withColumn("_n", F.lag("footnote_id").over(w)).filter("_n is not null").select("doc_id", (F.col("footnote_id") + 1_000_000).cast("long").alias("footnote_id"), _text("Baker", F.col("_n"), ", supra note ", F.col("_n"), " at para 9").alias("text"))
    split = splitting.split_notes(notes.unionByName(asked))
    return splitting.targets(split).filter("footnote_id > 1000000").select("part", "target")


_NAMES = (
    note_boundaries, note_rules, nested_notes, anchor_places, note_propositions, nested_provisions, judgment_paragraphs, judgment_addresses, snapped_parts, quoted_pages, rows_by_place, case_locks, checked_fragments, audited_documents, part_fields, conservative_notes, supra_tiers, ordered_links, note_guard, fallback_links, inferred_forms, chain_paths, deep_closure, provision_ranges, section_structure, page_structure, provision_paths, section_maps, cited_sections,
    specific_labels, combined_ranges, identity_lookup, law_datasets, current_laws, journal_filters, page_links, origin_fields, slug_repairs, link_cascade, quotation_manifest, fragment_links, made_fragments, quote_corrections, quote_resolution, made_quote_corrections, made_best_source, made_quote_resolution, supra_targets,
)
QUERIES = {f.__name__: f for f in _NAMES}

ORACLES = {
    "made_quote_corrections": f"WITH {_MADE} SELECT item_id, item_id AS doc_id, false AS exact, score, shown AS corrected FROM m",
    "made_best_source": f"WITH {_MADE} SELECT item_id, item_id AS doc_id, false AS exact, score FROM m WHERE item_id % 3 <> 0",
    "made_quote_resolution": f"""WITH {_MADE} SELECT item_id, item_id // 4 AS doc_id, CASE item_id % 5 WHEN 2 THEN 'alternate' WHEN 3 THEN 'scope_unavailable' WHEN 4 THEN 'uncited' ELSE 'cited' END AS location,
    CASE WHEN item_id % 2 = 0 THEN score ELSE 1.0 END AS score, (item_id % 4 + 1)::VARCHAR AS labels FROM m""",
    "nested_provisions": """WITH m AS (SELECT c_custkey AS k, list_concat(['(1)', '(1)(a)', '(1)(b)'], list_transform(['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][1:c_custkey % 9 + 1], lambda x: '(1)(b)(' || x || ')'),
    list_transform(string_split('cdefghijkl', '')[1:c_custkey % 10 + 1], lambda x: '(1)(' || x || ')')) AS p FROM customer),
e AS (SELECT k, p, i, p[i] AS path, length(regexp_extract(p[i], '\\([a-z0-9]+\\)$')) + 6 AS n FROM m, range(1, 30) t(i) WHERE i <= len(p)),
o AS (SELECT *, 100 + length(k::VARCHAR || ' ') + coalesce(sum(n + 1) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM e)
SELECT k AS doc_id, 'sec' || k || path AS locator, start::BIGINT AS start, (start + n + CASE WHEN i < len(p) THEN 1 ELSE 0 END)::BIGINT AS "end" FROM o
UNION ALL SELECT k, 'sec' || k, 100, max(start + n)::BIGINT FROM o GROUP BY k""",
    "judgment_paragraphs": """SELECT c_custkey AS doc_id, p.e AS eid, p.n::INT AS number, p.t AS text FROM (SELECT c_custkey, unnest([{'e': 'para_' || (c_custkey + 1), 'n': c_custkey + 1, 't': 'Held “' || c_name || '” & others'},
    {'e': 'para_' || (c_custkey + 2), 'n': c_custkey + 2, 't': 'Outer a < b (a) inner ' || c_custkey}, {'e': 'para_' || (c_custkey + 2) || '__a', 'n': -1, 't': 'inner ' || c_custkey}]) AS p FROM customer)""",
    "judgment_addresses": """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 3 = 0 THEN '' WHEN c_custkey % 4 = 0 AND c_custkey % 3 <> 0 THEN ''
    ELSE 'https://a.org/ewca/' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN '/2' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN '#para_' || (c_custkey % 50) ELSE '' END END AS url FROM customer""",
    "snapped_parts": """WITH n AS (SELECT c_custkey AS id, c_custkey::VARCHAR AS k, length(c_custkey::VARCHAR) AS n FROM customer)
SELECT id, 0 AS i, 0 AS start, 10 + n AS "end", 'Roe' || k || ',' || chr(9) || 'Law 1' AS verbatim FROM n UNION ALL SELECT id, 1, 12 + n, 21 + 2 * n, 'Doe, Law' || chr(10) || k FROM n
UNION ALL SELECT id, 2, -1, -1, '' FROM n UNION ALL SELECT id, 3, 23 + 2 * n, 33 + 3 * n, 'Roe' || k || ', Law 1' FROM n UNION ALL SELECT id, 4, 35 + 3 * n, 38 + 3 * n, 'Poe' FROM n""",
    "quoted_pages": "SELECT p_partkey AS item_id, CASE p_size % 3 WHEN 0 THEN '3' ELSE '4' END AS label FROM part WHERE p_size % 3 < 2",
    "rows_by_place": """SELECT o_orderkey, coalesce(c_name, '') AS c_name, '' AS missing FROM orders LEFT JOIN customer ON c_custkey % 3 = o_custkey % 4 AND c_custkey // 3 = o_custkey // 3""",
    "case_locks": """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'citation' WHEN 1 THEN 'alias' ELSE 'not_covered' END AS method, CASE WHEN c_custkey % 3 = 2 THEN 'not_covered' WHEN c_custkey % 5 = 0 THEN 'not_found' ELSE 'found' END AS status,
    CASE WHEN c_custkey % 3 = 2 OR c_custkey % 5 = 0 THEN -1 ELSE c_custkey END AS row_id FROM customer""",
    "checked_fragments": "SELECT c_custkey AS id, c_custkey % 4 IN (0, 2) AS verified FROM customer",
    "audited_documents": """WITH c AS (SELECT c_custkey AS k, 'd' || (c_custkey // 3) AS d, c_custkey % 3 AS f, c_custkey - c_custkey % 3 + 1 AS first FROM customer)
SELECT d AS doc_id, (k + 1)::INT AS footnote_id, (f + 1)::VARCHAR AS display, CASE f WHEN 0 THEN '' WHEN 1 THEN 'IBID' ELSE 'SUPRA' END AS ref_kind, d || '/' || first || '/1' AS origin,
    CASE f WHEN 0 THEN '' WHEN 1 THEN 'IBID' ELSE 'SUPRA→' || first || ':1' END AS path, 'Claim ' || k || ' stands.' AS proposition FROM c""",
    "made_fragments": """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '#:~:text=once' WHEN 1 THEN '#:~:text=alpha-,word%20' || c_custkey || ',-beta'
    WHEN 2 THEN '#:~:text=begin%20' || c_custkey || '%20of%20it%20now,w40%20and%20here%20it%20ends' ELSE '' END AS directive, c_custkey % 4 <> 3 AS verified FROM customer""",
    "note_propositions": """SELECT c_custkey AS footnote_id, CASE c_custkey % 5 WHEN 0 THEN length('First ' || c_custkey || ' claim. Second claim stands') WHEN 1 THEN length('He said “no duty. It ends here”.') WHEN 2 THEN length('See s. 7 of Act ' || c_custkey || ', it holds.') ELSE length('Last part”, it added') END AS position,
    CASE c_custkey % 5 WHEN 0 THEN 'Second claim stands here.' WHEN 1 THEN 'He said “no duty. It ends here”.' WHEN 2 THEN 'See s. 7 of Act ' || c_custkey || ', it holds.' ELSE 'The panel wrote “first part ' || (c_custkey - 1) || '. Last part”, it added then.' END AS proposition
FROM customer WHERE c_custkey % 5 <> 3""",
    "note_rules": """WITH n AS (SELECT c_custkey AS id, c_custkey::VARCHAR AS k, (1 + c_custkey % 900)::VARCHAR AS n FROM customer),
p AS (SELECT id, unnest(CASE id % 7 WHEN 0 THEN [{'i': 1, 'v': '2020 SCC ' || n || ', Smith Jones v Brown' || k || ', 2019 ONCA 7', 'r': ''}]
    WHEN 1 THEN [{'i': 1, 'v': 'R v Able' || k || ', 2020 SCC ' || n || ',', 'r': ''}, {'i': 2, 'v': 'citing Smith,', 'r': 'source_signal'}, {'i': 3, 'v': 'quoting R v Baker' || k || ', 2019 ONCA 7', 'r': 'source_signal'}]
    WHEN 2 THEN [{'i': 1, 'v': 'R v Able' || k || ', 2020 SCC ' || n || ',', 'r': ''}, {'i': 2, 'v': 'R v Baker' || k || ', 2019 ONCA 7.', 'r': 'new_case_frame'}]
    WHEN 3 THEN [{'i': 1, 'v': 'Jane Doe, "One" (2001) 3 J ' || n || ',', 'r': ''}, {'i': 2, 'v': 'John Poe, "Two" (2002) 5 K 6', 'r': 'new_author_title_frame'}]
    WHEN 4 THEN [{'i': 1, 'v': 'Roe, supra note ' || n || ' at 20,', 'r': ''}, {'i': 2, 'v': 'Doe note 7', 'r': 'new_note_reference'}]
    WHEN 5 THEN [{'i': 1, 'v': 'See Roe', 'r': ''}, {'i': 2, 'v': 'and Doe.', 'r': 'conjoined_short_form'}]
    ELSE [{'i': 1, 'v': 'Labour Act, RSC 1985, c L-' || n || ',', 'r': ''}, {'i': 2, 'v': 'the Canada Evidence Act, RSC 1985, c C-5', 'r': 'new_legal_source_frame'}] END) AS p FROM n)
SELECT id, p.i AS part_index, p.v AS verbatim, p.r AS reason FROM p""",
    "nested_notes": """WITH n AS (SELECT c_custkey AS id, 2 * (c_custkey % 10 + 1) + length('R v Able' || c_custkey || ', 2001 SCC 1; x') AS e FROM customer)
SELECT id, 1 AS part_index, 0 AS start, e AS "end" FROM n UNION ALL SELECT id, 2, e + 2, e + 2 + length('R v Baker, 2002 SCC 2') FROM n""",
    "anchor_places": """WITH n AS (SELECT c_custkey AS id, c_custkey::VARCHAR AS k, (1 + c_custkey % 900)::VARCHAR AS n FROM customer),
t AS (SELECT id, 'R v Able' || k || ', 2020 SCC ' || n || ', [1990] 1 SCR ' || n || '; Criminal Code, RSC 1985, c C-' || n || '; Roe, "On Law" (2001) 39:2 Osgoode Hall LJ ' || n || '; Poe, Law (Toronto: Press, 2001), online: https://a.org/' || k AS t,
    unnest([{'k': 'neutral', 'v': '2020 SCC ' || n}, {'k': 'reporter', 'v': '[1990] 1 SCR ' || n}, {'k': 'statute', 'v': 'RSC 1985, c C-' || n}, {'k': 'journal', 'v': '(2001) 39:2 Osgoode Hall LJ ' || n}, {'k': 'book', 'v': '(Toronto: Press, 2001)'}, {'k': 'url', 'v': 'https://a.org/' || k}]) AS a FROM n)
SELECT id, a.k AS kind, strpos(t, a.v) - 1 AS start, strpos(t, a.v) - 1 + length(a.v) AS "end" FROM t""",
    "note_boundaries": f"WITH {_PARTS} SELECT doc_id, footnote_id, p.i AS part_index, p.v AS verbatim, coalesce(p.r, '') AS reason FROM p",
    "part_fields": f"WITH {_PARTS} SELECT doc_id, footnote_id, p.i AS part_index, p.kind AS kind, p.f AS fragments, p.s AS short_form, 'complete' AS status FROM p",
    "conservative_notes": "SELECT c_nationkey AS doc_id, c_custkey AS footnote_id, (CASE WHEN c_custkey % 5 = 2 THEN 1 ELSE 2 END)::BIGINT AS parts FROM customer WHERE c_custkey % 5 <> 4",
    "supra_tiers": _SUPRA,
    "ordered_links": """SELECT c_custkey // 5 AS doc_id, c_custkey % 5 AS seq, 'https://a.org/' || (c_custkey // 5) || CASE c_custkey % 5 WHEN 0 THEN '#par1' WHEN 1 THEN '#par7' WHEN 2 THEN '#par9' WHEN 3 THEN '#par11' ELSE '#par12' END AS link,
    CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'note_number' WHEN 3 THEN 'exact_sf' ELSE 'previous' END AS method FROM customer""",
    "note_guard": """SELECT c.c_nationkey AS doc_id, c.c_custkey + 1000000000 AS seq, CASE WHEN count(e.c_custkey) = 0 THEN true ELSE coalesce(bool_or(e.c_custkey = c.c_custkey AND c.c_custkey % 4 <> 0), false) END AS allowed
FROM customer c LEFT JOIN customer e ON e.c_nationkey = c.c_nationkey AND e.c_custkey BETWEEN c.c_custkey - 3 AND c.c_custkey + 3 AND e.c_custkey % 7 <> 0 GROUP BY 1, 2""",
    "fallback_links": """SELECT c_nationkey AS doc_id, c_custkey + 1000000000 AS seq, CASE WHEN c_custkey % 7 <> 0 THEN 'https://a.org/' || c_custkey || '#par1' END AS link,
    CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'inferred_short_form:case_party' ELSE 'bare_note_unique_citation' END END AS method FROM customer""",
    "inferred_forms": """SELECT c_custkey, f.value AS value, f.rule AS rule FROM (SELECT c_custkey, unnest(CASE c_custkey % 3 WHEN 0 THEN [{'value': 'R v Accused' || c_custkey, 'rule': 'case_style'}, {'value': 'Accused' || c_custkey, 'rule': 'case_party'}]
    WHEN 1 THEN [{'value': 'Fair Labour Standards Act', 'rule': 'legislation_title'}, {'value': 'FLSA', 'rule': 'legislation_acronym'}] ELSE [{'value': 'Roe, Doe', 'rule': 'secondary_authors'}] END) AS f FROM customer)""",
    "chain_paths": """WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, substr(o_orderpriority, 1, 1) AS p FROM orders)
SELECT a.o_orderkey AS part, coalesce(string_agg(b.p, ' → ' ORDER BY b.i DESC), '') AS path FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.i BETWEEN 2 AND a.i GROUP BY 1""",
    "deep_closure": "SELECT o_orderkey AS node FROM orders",
    "provision_ranges": """WITH r AS (SELECT l_linenumber AS n, l_quantity::INT + 100 AS q, count(*) AS c FROM lineitem GROUP BY 1, 2)
SELECT CASE WHEN n % 2 = 0 THEN 'ss ' || n || '-' || (n + 3) || ', ' || q ELSE 's ' || n || '-' || (n + 3) || ' and ' || q || '(1) to (3)' END AS cited, c AS n,
    CASE WHEN n % 2 = 0 THEN n || ' ' || (n + 1) || ' ' || (n + 2) || ' ' || (n + 3) || ' ' || q ELSE n || '-' || (n + 3) || ' ' || q || '(1) ' || q || '(2) ' || q || '(3)' END AS provisions FROM r""",
    "section_structure": """WITH n AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, p_name FROM part), l AS (SELECT *, n || ' The ' || p_name || ' shall be kept in good order by its owner' AS line FROM n),
o AS (SELECT p_brand, n, coalesce(sum(length(line) + 1) OVER w, 0)::BIGINT AS start, sum(length(line) + 1) OVER (PARTITION BY p_brand)::BIGINT - 1 AS total, count(*) OVER (PARTITION BY p_brand) AS k FROM l WINDOW w AS (PARTITION BY p_brand ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT p_brand AS doc_id, n::VARCHAR AS label, start, coalesce(lead(start) OVER (PARTITION BY p_brand ORDER BY n), total) AS "end" FROM o WHERE k >= 3""",
    "page_structure": """WITH n AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS k, o_orderpriority AS p FROM orders)
SELECT o_custkey AS doc_id, count(*) AS pages, '11' AS first, (6 + sum(CASE WHEN n < k THEN length('[page ' || (n + 11) || ']' || chr(10) || p || ' order') + 1 ELSE 0 END))::BIGINT AS "end" FROM n WHERE k >= 3 GROUP BY 1""",
    "provision_paths": """WITH n AS (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS n FROM nation)
SELECT n_regionkey AS doc_id, n::INT AS block, '(' || (n // 3 + 1) || ')' || CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN '(a)' ELSE '(b)' END AS path FROM n""",
    "section_maps": """SELECT p_partkey AS doc_id, p_size::VARCHAR AS label, 0::BIGINT AS start, length(p_name)::BIGINT AS "end", p_name AS text FROM part
UNION ALL SELECT p_partkey, (p_size + 1) || '.5', length(p_name) + 6, length(p_name) + 6 + length(p_brand), p_brand FROM part""",
    "cited_sections": """SELECT p_partkey AS item_id, p_brand AS doc_id, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE p_size || '(1)' END AS label, false AS exact FROM part""",
    "specific_labels": """WITH l AS (SELECT p_brand AS item_id, p_size AS s, p_partkey % 3 AS c, max(round(p_retailprice / 100000, 2)) AS score FROM part GROUP BY 1, 2, 3)
SELECT item_id, CASE WHEN c = 0 THEN s::VARCHAR ELSE s || '(' || c || ')' END AS label FROM l a WHERE c > 0 OR NOT EXISTS (SELECT 1 FROM l b WHERE b.item_id = a.item_id AND b.s = a.s AND b.c > 0 AND b.score >= a.score)""",
    "combined_ranges": """WITH r AS (SELECT l_orderkey, l_linenumber, min(l_partkey)::VARCHAR AS t FROM lineitem GROUP BY 1, 2), h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END AS high FROM orders)
SELECT l_orderkey, high::INT AS high, string_agg(t, chr(10) ORDER BY l_linenumber) AS text FROM r JOIN h ON o_orderkey = l_orderkey AND l_linenumber <= high GROUP BY 1, 2 HAVING count(*) = any_value(high)""",
    "identity_lookup": """WITH s AS (SELECT p_size, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY 1)
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'found' WHEN 1 THEN CASE WHEN p.p_partkey IS NULL THEN 'not_found' ELSE 'found' END WHEN 2 THEN CASE coalesce(n, 0) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END ELSE 'not_found' END AS status,
    CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 1 THEN coalesce(p.p_partkey + 10000000, -1) WHEN 2 THEN CASE WHEN n = 1 THEN s.k + 10000000 ELSE -1 END ELSE -1 END AS row_id
FROM customer LEFT JOIN part p ON p.p_partkey = c_custkey LEFT JOIN s ON s.p_size = 1 + c_custkey % 50""",
    "law_datasets": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'LEGISLATION-FED' WHEN 1 THEN 'REGULATIONS-NB' WHEN 2 THEN 'BCCA' ELSE '' END AS dataset,
    CASE c_custkey % 4 WHEN 0 THEN 'https://example.org/en/ca/laws/stat/rsc-1985-c-c-' || c_custkey || '/latest/rsc-1985-c-c-' || c_custkey || '.html' WHEN 1 THEN 'https://example.org/en/nb/laws/regu/nb-reg-82-' || c_custkey || '/latest/nb-reg-82-' || c_custkey || '.html' ELSE '' END AS url FROM customer""",
    "current_laws": "SELECT c_custkey, (c_custkey % 2 = 0 AND c_custkey % 3 = 0) OR (c_custkey % 2 = 1 AND c_custkey % 3 = 1) AS current FROM customer",
    "journal_filters": "SELECT min(p_partkey) AS query_id FROM part GROUP BY p_name HAVING min(p_partkey) % 3 < 2",
    "page_links": """SELECT DISTINCT l_orderkey AS article_id, l_linenumber AS page, 'https://a.org/' || l_orderkey || CASE WHEN l_linenumber >= 3 THEN '#page=' || (l_linenumber * 10) WHEN l_linenumber = 2 THEN '#page=1' ELSE '' END AS link FROM lineitem""",
    "origin_fields": "SELECT o.o_orderkey::VARCHAR AS display_key, coalesce(p.o_orderpriority, '') AS origin_priority FROM orders o LEFT JOIN orders p ON p.o_orderkey = o.o_custkey AND p.o_orderkey <> o.o_orderkey",
    "slug_repairs": """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 1 THEN 'https://a.org/doc/' || c_custkey WHEN c_custkey % 3 = 0 THEN 'https://a.org/laws/stat/wrong-' || c_custkey || '/x' ELSE 'https://a.org/laws/stat/rsc-' || c_custkey || '/x' END AS repaired FROM customer""",
    "link_cascade": """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'https://5.org/' || c_custkey WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN 'https://2.org/' || c_custkey WHEN c_custkey % 7 = 0 THEN 'https://7.org/' || c_custkey ELSE '' END AS link,
    CASE WHEN c_custkey % 5 = 0 THEN 'identity' WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN 'provider' WHEN c_custkey % 7 = 0 THEN 'author' ELSE '' END AS method FROM customer""",
    "quotation_manifest": """SELECT 'd' || user_id AS doc_key, event_id % 7 AS footnote_id, count_if(event_type = 'purchase')::BIGINT AS quote_count, array_to_string(list_sort(list(DISTINCT CASE event_type WHEN 'purchase' THEN 'quote' ELSE 'supra_target' END)), ';') AS include_reason
FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2""",
    "supra_targets": """WITH n AS (SELECT c_nationkey AS d, c_custkey AS k, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS p FROM customer WHERE c_custkey % 5 = 0)
SELECT d || '/' || (k + 1000000) || '/1' AS part, d || '/' || p || '/2' AS target FROM n WHERE p IS NOT NULL""",
}
