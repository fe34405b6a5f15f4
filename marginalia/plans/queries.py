"""Registered queries of the library's own operators over the given tables, with the same in SQL where SQL can say it.

The tables hold no citations, so stand-ins are used: benchmark passages are quotations, documents sources and their lines blocks;
customers, suppliers, parts and nations are a corpus with citations and names; orders, events and conversations are ordered parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import keys, references, text
from marginalia.operators import chains, inventory, journals, lookup, quotes, scopes, sequences, splitting, structure
from marginalia.sources.shared import materialize


def _read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier, part, nation = _read(spark, sf_dir, "customer", "supplier", "part", "nation")
    row = lambda df, name, key, label: df.select(F.lit(name).alias("dataset"), F.concat(F.lit(f"{name} "), F.col(key).cast("string")).alias("row_id"), F.concat(F.lit(f"{name} 4."), F.col(key).cast("string")).alias("citation_en"), F.col(label).alias("name_en"))
    return row(customer, "C", "c_custkey", "c_name").unionByName(row(supplier, "S", "s_suppkey", "s_name")).unionByName(row(part, "P", "p_partkey", "p_name")).unionByName(row(nation, "N", "n_nationkey", "n_name"))


_CORPUS = """corpus AS (SELECT 'C ' || c_custkey AS row_id, 'C' AS dataset, 'C 4.' || c_custkey AS citation_en, c_name AS name_en FROM customer UNION ALL SELECT 'S ' || s_suppkey, 'S', 'S 4.' || s_suppkey, s_name FROM supplier
    UNION ALL SELECT 'P ' || p_partkey, 'P', 'P 4.' || p_partkey, p_name FROM part UNION ALL SELECT 'N ' || n_nationkey, 'N', 'N 4.' || n_nationkey, n_name FROM nation),
idx AS (SELECT row_id, 'citation_en' AS field_name, citation_en AS exact_value, 'citation' AS lookup_type, lower(replace(replace(citation_en, ' ', ''), '.', 'dot')) AS lookup_key FROM corpus
    UNION ALL SELECT row_id, 'name_en', name_en, 'name', lower(regexp_replace(name_en, '[^A-Za-z0-9_ ]', '', 'g')) FROM corpus)"""


def lookup_index_build(spark, sf_dir):
    return lookup.lookup_index(_corpus(spark, sf_dir), unicode=False)


def exact_lookup_batch(spark, sf_dir):
    (orders,) = _read(spark, sf_dir, "orders")
    asked = orders.select(F.col("o_orderkey").alias("id"), keys.citation_key(F.concat(F.lit("C 4."), (F.col("o_custkey") * 2).cast("string")), unicode=False).alias("lookup_key"))
    found = lookup.exact_lookup(asked, lookup.lookup_index(_corpus(spark, sf_dir), unicode=False).withColumn("row_id", F.substring_index("row_id", " ", -1).cast("long")))
    return found.select("id", "lookup_key", "hits", F.coalesce("row_id", F.lit(-1)).alias("row_id"), "status")


def name_citation_self_join(spark, sf_dir):
    (part,) = _read(spark, sf_dir, "part")
    names = part.select(keys.name_key(F.col("p_name"), unicode=False).alias("lookup_key"))
    return lookup.names_to_citations(names, lookup.lookup_index(_corpus(spark, sf_dir), unicode=False))


def lookup_status(spark, sf_dir):
    (docs,) = _read(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", F.md5(F.lower(F.trim(F.regexp_replace("text", "[ \\t\\n\\r\\f\\x0B]+", " ")))).alias("lookup_key"))
    keyed = materialize(keyed, "keyed")
    index = keyed.select("lookup_key", F.col("doc_id").alias("row_id"), F.lit("citation").alias("lookup_type"))
    return lookup.exact_lookup(keyed, index).select("doc_id", "status", "hits")


def coverage_by_dataset(spark, sf_dir):
    return _corpus(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name_en").alias("names"))


def prefetch_statistics(spark, sf_dir):
    (orders, customer) = _read(spark, sf_dir, "orders", "customer")
    key = lambda c: keys.citation_key(F.concat(F.lit("C 4."), c.cast("string")), unicode=False).alias("lookup_key")
    corpus = _corpus(spark, sf_dir)
    index = lookup.lookup_index(corpus, unicode=False)
    cached = customer.filter("c_mktsegment = 'BUILDING'").select(key(F.col("c_custkey")))
    return lookup.prefetch_stats(orders.select(key(F.col("o_custkey"))), index, cached, corpus.select("row_id", "dataset"))


def alias_tails(spark, sf_dir):
    (customer, nation) = _read(spark, sf_dir, "customer", "nation")
    asked = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.concat_ws(", ", "c_name", "c_mktsegment", "n_name").alias("citation"))
    aliases = nation.select(keys.citation_key(F.col("n_name"), unicode=False).alias("citation_key"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("canonical_citation"))
    building = customer.sparkSession.createDataFrame([("building" + f"nation{i}", f"B{i}") for i in range(3)], "citation_key string, canonical_citation string")
    return lookup.with_alias(asked, aliases.unionByName(building), unicode=False)


def unique_identity_status(spark, sf_dir):
    (part,) = _read(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("broad_key"), F.concat_ws("|", "p_name", "p_brand", F.col("p_size").cast("string")).alias("literal_key"))
    asked = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("asked_broad"), F.concat_ws("|", "p_name", "p_brand", F.lit("7")).alias("asked_literal"))
    joined = asked.join(rows, (F.col("asked_broad") == F.col("broad_key")) & (F.col("asked_literal") == F.col("literal_key")))
    return asked.select("id").join(lookup.unique_identity(joined), "id", "left").select("id", F.coalesce("status", F.lit("not_found")).alias("status"), F.coalesce("row_id", F.lit(-1)).alias("row_id"))


def dedupe_by_key(spark, sf_dir):
    (docs,) = _read(spark, sf_dir, "documents")
    w = Window.partitionBy("source", "_k").orderBy("doc_id")
    return docs.withColumn("_k", F.md5(text.squeezed(F.lower("text")))).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("doc_id", "source")


def quote_exact_match(spark, sf_dir):
    quotes_, docs = _read(spark, sf_dir, "benchmark", "documents")
    return quotes.exact_matches(quotes_, docs)


def _matched_lines(docs, matches):
    """The lines of the documents that have a match; no other document is cut."""
    return quotes.line_blocks(docs.join(matches.select("doc_id").distinct(), "doc_id", "left_semi"))


def quote_block_location(spark, sf_dir):
    quotes_, docs = _read(spark, sf_dir, "benchmark", "documents")
    matches = quotes.exact_matches(quotes_, docs)
    return quotes.locate(matches, quotes_, _matched_lines(docs, matches))


def line_block_offsets(spark, sf_dir):
    (docs,) = _read(spark, sf_dir, "documents")
    return quotes.line_blocks(docs).select("doc_id", "block", "start", "end")


def ngram_candidates(spark, sf_dir):
    quotes_, docs = _read(spark, sf_dir, "benchmark", "documents")
    return quotes.ngram_candidates(quotes_, docs)


def content_overlap(spark, sf_dir):
    quotes_, docs = _read(spark, sf_dir, "benchmark", "documents")
    q, d = quotes_.select("item_id", F.col("text").alias("q")), docs.select("doc_id", F.col("text").alias("d"))
    pairs = quotes.ngram_candidates(quotes_, docs).join(q, "item_id").join(d, "doc_id")
    mine = text.content_words(F.col("q"))
    return pairs.select("item_id", "doc_id", F.size(mine).alias("content"), F.size(F.array_intersect(mine, text.content_words(F.col("d")))).alias("common"), text.plausible(F.col("q"), F.col("d")).alias("plausible"))


def quote_match_score(spark, sf_dir):
    quotes_, docs = _read(spark, sf_dir, "benchmark", "documents")
    return quotes.scored(quotes.ngram_candidates(quotes_, docs).select("item_id", "doc_id"), quotes_, docs)


def plausible_pairs(spark, sf_dir):
    """Passages, and quotations of two to six of their words in another order (so that no run is shared), against all documents."""
    quotes_, docs = _read(spark, sf_dir, "benchmark", "documents")
    words = F.split(F.regexp_replace("text", "[\\s]+", " "), " ")
    short = F.array_join(F.reverse(F.slice(words, F.lit(4), (F.col("item_id") % 5 + 2).cast("int"))), " ")
    asked = quotes_.select("item_id", "text").unionByName(quotes_.select((F.col("item_id") + 1_000_000).alias("item_id"), short.alias("text")))
    return quotes.plausible_pairs(asked, docs)


def quote_best_source(spark, sf_dir):
    return quotes.clear_winner(quote_match_score(spark, sf_dir))


def verify_quotes(spark, sf_dir):
    """The flagship: each quotation with the number of sources that have it, its first place, and the verdict."""
    quotes_, docs = _read(spark, sf_dir, "benchmark", "documents")
    matches = quotes.exact_matches(quotes_, docs)
    found = quotes.locate(matches, quotes_, _matched_lines(docs, matches))
    first = found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("sources"), F.min(F.struct("doc_id", "block")).alias("at"))
    return quotes_.select("item_id").join(first, "item_id", "left").select("item_id", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("at.doc_id", F.lit(-1)).alias("doc_id"), F.coalesce("at.block", F.lit(-1)).alias("block"), F.when(F.col("sources") > 0, "OG_PINPOINT_MATCH").otherwise("NO_MATCH").alias("status"))


def inline_quotes(spark, sf_dir):
    (docs,) = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(text.inline_quotes(F.col("text"))).alias("n", "quote"))


def url_extraction(spark, sf_dir):
    (pages,) = _read(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("href=\"([^\"]*)\""), F.lit(1))).alias("link")).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.min("link").alias("first_link"))


def link_parts(spark, sf_dir):
    (pages,) = _read(spark, sf_dir, "pages")
    return pages.select("page_id", F.split_part("url", F.lit("#"), F.lit(1)).alias("bare"), F.regexp_extract("url", "#(.*)$", 1).alias("fragment"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))


def previous_part(spark, sf_dir):
    (turns,) = _read(spark, sf_dir, "conversations")
    parts = turns.select("conv_id", "turn", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("part"))
    return chains.previous_part(parts, "conv_id", ("turn",)).select("part", "previous")


def chain_origin(spark, sf_dir):
    (turns,) = _read(spark, sf_dir, "conversations")
    return chains.run_origin(turns.withColumn("own", F.col("role") == "user"), "own", "conv_id", ("turn",), "turn").select("conv_id", "turn", F.coalesce("origin", F.lit(-1)).alias("origin"))


def chain_pointers(spark, sf_dir):
    """Each order points to the customer's order before it; the chain ends at the first."""
    (orders,) = _read(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return chains.resolve_chains(orders.select(F.col("o_orderkey").alias("part"), F.lag("o_orderkey").over(w).alias("target"))).select("part", "origin", "hops", "note")


def selection_closure(spark, sf_dir):
    (turns,) = _read(spark, sf_dir, "conversations")
    parts = turns.select("conv_id", "turn", "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("node"))
    edges = parts.select(F.col("node").alias("source"), F.lag("node").over(Window.partitionBy("conv_id").orderBy("turn")).alias("target")).filter("target is not null")
    return chains.selection_closure(parts.filter("turn = 3"), edges)


def origin_inheritance(spark, sf_dir):
    (turns,) = _read(spark, sf_dir, "conversations")
    parts = chains.run_origin(turns.withColumn("own", F.col("role") == "user"), "own", "conv_id", ("turn",), "turn").select("conv_id", "turn", "own", "origin", F.when(F.col("own"), F.md5("text")).alias("link"))
    keyed = parts.select((F.col("conv_id") * 1000 + F.col("turn")).alias("part"), (F.col("conv_id") * 1000 + F.col("origin")).alias("origin"), "link", (~F.col("own")).alias("inherit"))
    return chains.inherited(keyed, ("link",)).select("part", "link")


def registry_tiers(spark, sf_dir):
    (events,) = _read(spark, sf_dir, "events")
    registry = events.filter("event_type in ('purchase', 'signup')").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("note"), F.lit("").alias("short_form"), F.lit("").alias("verbatim"), F.concat(F.lit("u/"), F.floor(F.col("value") / 4).cast("string"), F.lit("#"), F.col("event_id").cast("string")).alias("link"))
    asked = events.filter("event_type = 'error'").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("note"), F.lit("").alias("token"))
    return chains.registry_match(asked, registry).select("doc_id", "seq", F.coalesce("tier", F.lit(0)).alias("tier"), "link")


def asof_anchor(spark, sf_dir):
    (events,) = _read(spark, sf_dir, "events")
    return sequences.next_within(events, "user_id", "ts", "event_id", F.expr("interval 6 hours")).select("event_id", F.coalesce("next", F.lit(-1)).alias("next_id"))


def top_candidates(spark, sf_dir):
    (part,) = _read(spark, sf_dir, "part")
    return sequences.top_n(part.filter("lower(p_name) like '%widget%'"), 3, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")]).select("p_brand", "p_partkey", "rank")


def page_map_first(spark, sf_dir):
    (lines,) = _read(spark, sf_dir, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return sequences.first_by(lines.withColumn("o", order), ["l_orderkey"], "l_partkey", "o")


def range_scope_join(spark, sf_dir):
    lines, orders = _read(spark, sf_dir, "lineitem", "orders")
    ranges = orders.select("o_orderkey", F.col("o_orderpriority").alias("scope"), F.lit(2).alias("low"), (F.lit(2) + F.length("o_orderstatus") * 2).alias("high")).withColumnRenamed("o_orderkey", "l_orderkey")
    return sequences.in_ranges(lines.select("l_orderkey", "l_linenumber", "l_partkey"), ranges, "l_orderkey", "l_linenumber").groupBy("scope", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("keys"))


def interval_overlap(spark, sf_dir):
    (events,) = _read(spark, sf_dir, "events")
    at = F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200
    parts = events.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("part"), at.alias("start"), (at + 7200).alias("end"))
    links = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("link"), at.alias("from"), (at + 3600).alias("to"))
    return sequences.first_overlap(parts, links, "user_id", 7200)


def global_positions(spark, sf_dir):
    (turns,) = _read(spark, sf_dir, "conversations")
    return sequences.global_offsets(turns, "conv_id", "turn", "text").select("conv_id", "turn", "offset")


def display_numbering(spark, sf_dir):
    (turns,) = _read(spark, sf_dir, "conversations")
    return sequences.display_numbers(turns, "conv_id", ["turn"], F.col("role") == "system").select("conv_id", "turn", F.coalesce("number", F.lit(-1)).alias("number"))


def repeat_suppression(spark, sf_dir):
    (lines,) = _read(spark, sf_dir, "lineitem")
    return sequences.suppress_repeats(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "l_returnflag").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "").alias("suppressed"), F.count(F.lit(1)).alias("n"))


def verdict_rollup(spark, sf_dir):
    (lines,) = _read(spark, sf_dir, "lineitem")
    checked = lines.select("l_orderkey", F.when(F.col("l_quantity") > 5, F.round(F.col("l_quantity") / 50, 2)).alias("score"), (F.col("l_returnflag") == "R").alias("alternate"))
    return quotes.verdicts(checked, "l_orderkey")


def verdict_counters(spark, sf_dir):
    return verdict_rollup(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("quotes").alias("quotes"), F.sum("accepted").alias("accepted"))


def inventory_diff(spark, sf_dir):
    (part,) = _read(spark, sf_dir, "part")
    files = lambda cond, path: part.filter(cond).select(path.alias("path"), F.md5(F.concat_ws("|", "p_name", "p_brand", F.col("p_size").cast("string"))).alias("sha256"), F.col("p_partkey").alias("size"))
    path = F.concat(F.lit("p/"), F.col("p_partkey").cast("string"))
    return inventory.plan_update(files("p_size <= 30", path), files("p_size >= 20", F.when(F.col("p_size") == 25, F.concat(path, F.lit(".new"))).otherwise(path)))


def median_gate(spark, sf_dir):
    (docs,) = _read(spark, sf_dir, "documents")
    lines = quotes.line_blocks(docs).withColumn("n", F.regexp_count("text", F.lit("[^ ]+")))
    return lines.groupBy("doc_id").agg(F.median("n").alias("median_words"), F.round(F.avg((F.col("n") >= 12).cast("double")), 6).alias("substantive"))


def running_cap(spark, sf_dir):
    (orders,) = _read(spark, sf_dir, "orders")
    days = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return sequences.running_cap(days, ["day"], "n", 2000)


def id_lists(spark, sf_dir):
    (lines,) = _read(spark, sf_dir, "lineitem")
    spec = F.concat_ws(",", F.col("l_linenumber").cast("string"), F.concat_ws("-", (F.col("l_linenumber") + 3).cast("string"), F.col("l_quantity").cast("int").cast("string")), F.lit("x"))
    return lines.select(references.id_list(spec).alias("ids")).groupBy(F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")).agg(F.count(F.lit(1)).alias("n"))


def abbreviated_ranges(spark, sf_dir):
    (lines,) = _read(spark, sf_dir, "lineitem")
    a, b = F.col("l_partkey"), F.col("l_quantity").cast("long")
    return lines.select(a.alias("first"), b.alias("last"), references.range_end(a, b).alias("end")).distinct()


def title_search(spark, sf_dir):
    (part,) = _read(spark, sf_dir, "part")
    titled = part.withColumn("title", F.concat(F.col("p_name"), F.lit(" deluxe")))
    asked = titled.groupBy("title").agg(F.min("p_partkey").alias("query_id"))  # equal titles are aligned once
    articles = part.groupBy("p_name").agg(F.min("p_partkey").alias("article_id")).withColumnRenamed("p_name", "name_en")
    best = journals.best_articles(asked, articles, journals.title_candidates(asked, articles, loose=True), 2)
    found = best.join(asked, "query_id").drop("query_id")
    return titled.select(F.col("p_partkey").alias("query_id"), "title").join(found, "title").select("query_id", "article_id", "score", "rank")


def title_candidates(spark, sf_dir):
    (part,) = _read(spark, sf_dir, "part")
    articles = part.select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("name_en"))
    asked = part.groupBy("p_name").agg(F.min("p_partkey").alias("query_id")).withColumnRenamed("p_name", "title")
    return journals.title_candidates(asked, articles)


def title_substrings(spark, sf_dir):
    """Titles made of cut words (the first without its first letter, the second without its last), looked for inside the words of all names."""
    (part,) = _read(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    cut = F.concat_ws(" ", F.substring(w[0], 2, 100), F.substring(w[1], F.lit(1), F.length(w[1]) - 1))
    asked = part.select(cut.alias("title")).distinct().select(F.col("title").alias("query_id"), "title")
    articles = part.select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("name_en"))
    return journals.like_candidates(asked, articles)


def note_parts(spark, sf_dir):
    """Documents as notes: every text cut into parts, counted by kind."""
    (docs,) = _read(spark, sf_dir, "documents")
    split = splitting.split_notes(docs.select("doc_id", F.lit(1).alias("footnote_id"), "text"))
    return split.groupBy("kind").agg(F.count(F.lit(1)).alias("parts"), F.count_distinct("doc_id").alias("notes"), F.count_if(F.col("link") != "other").alias("links"))


def set_difference(spark, sf_dir):
    customer, orders = _read(spark, sf_dir, "customer", "orders")
    return customer.select(F.col("c_custkey").alias("key")).join(orders.select(F.col("o_custkey").alias("key")), "key", "left_anti")


def row_positions(spark, sf_dir):
    """Point fetch by position in the file: the first and the last row that a nation's customers have."""
    (customer,) = _read(spark, sf_dir, "customer")
    located = customer.select("c_nationkey", "c_custkey", F.col("_metadata.row_index").alias("row"))
    ends = located.groupBy("c_nationkey").agg(F.min("row").alias("lo"), F.max("row").alias("hi"))
    return ends.join(located.select(F.col("row").alias("lo"), F.col("c_custkey").alias("first_key")), "lo").join(located.select(F.col("row").alias("hi"), F.col("c_custkey").alias("last_key")), "hi").select("c_nationkey", "first_key", "last_key")


def json_sections(spark, sf_dir):
    (events,) = _read(spark, sf_dir, "events")
    return lookup.section(events.withColumn("wanted", F.when(F.col("event_type") == "view", "none").otherwise("k")), "props", "wanted").groupBy("event_type").agg(F.count("section_text").alias("found"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("section_text").cast("int")), F.lit(0)).alias("total"))


def _transcripts(spark, sf_dir):
    """Conversations as sources with numbered paragraphs: a line a turn."""
    (turns,) = _read(spark, sf_dir, "conversations")
    line = F.struct("turn", F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("] "), F.regexp_replace("text", "\n", " ")).alias("line"))
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"))


def paragraph_structure(spark, sf_dir):
    return structure.paragraphs(_transcripts(spark, sf_dir)).select("doc_id", "number", "start", "end")


def marker_blocks(spark, sf_dir):
    return quotes.markers(_transcripts(spark, sf_dir), "^\\[([0-9]+)\\] ").select("doc_id", "label", "start", "end")


def quote_locations(spark, sf_dir):
    """Passages in the documents that have them, with the first three lines as the cited scope."""
    quotes_, docs = _read(spark, sf_dir, "benchmark", "documents")
    ranges = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.lit(2).cast("long").alias("high")))
    matches = quotes.exact_matches(quotes_, docs)
    asked = matches.join(quotes_.select("item_id", F.col("text").alias("quote")), "item_id").withColumn("ranges", ranges)
    found = scopes.resolve(asked, _matched_lines(docs, matches).withColumnRenamed("block", "number"), docs)
    return found.select("item_id", "doc_id", "location", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


def cited_scope_ranges(spark, sf_dir):
    (lines,) = _read(spark, sf_dir, "lineitem")
    cite = F.concat(F.lit("2020 SCC 1 at paras "), F.col("l_linenumber").cast("string"), F.lit("-"), (F.col("l_linenumber") + 4).cast("string"), F.lit(", "), F.col("l_quantity").cast("int").cast("string"))
    ranges = lines.select("l_linenumber", "l_quantity", scopes.cited_scopes(cite)["paragraphs"].alias("r"))
    return ranges.select("l_linenumber", F.explode("r").alias("r")).groupBy("l_linenumber", "r.low", "r.high").agg(F.count(F.lit(1)).alias("n"))


_NAMES = (
    lookup_index_build, exact_lookup_batch, name_citation_self_join, lookup_status, coverage_by_dataset, prefetch_statistics, alias_tails, unique_identity_status, dedupe_by_key, quote_exact_match, quote_block_location, line_block_offsets,
    ngram_candidates, content_overlap, quote_match_score, quote_best_source, verify_quotes, inline_quotes, url_extraction, link_parts, previous_part, chain_origin, chain_pointers, selection_closure, origin_inheritance, registry_tiers, asof_anchor,
    top_candidates, page_map_first, range_scope_join, interval_overlap, global_positions, display_numbering, repeat_suppression, verdict_rollup, verdict_counters, inventory_diff, median_gate, running_cap, id_lists, abbreviated_ranges,
    plausible_pairs, title_search, title_candidates, title_substrings, note_parts, set_difference, row_positions, json_sections, paragraph_structure, marker_blocks, quote_locations, cited_scope_ranges,
)
QUERIES = {f.__name__: f for f in _NAMES}

_SPACE = "[ \\t\\n\\x0B\\f\\r\\x{00A0}]+"
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)*')"


def _comparable(c: str) -> str:
    """text.comparable in SQL. There is no look-around here: hyphens between letters are replaced twice, as matches don't overlap."""
    src, dst = text.SINGLE_QUOTES + text.DOUBLE_QUOTES + text.DASHES, "''" * len(text.SINGLE_QUOTES) + '"' * len(text.DOUBLE_QUOTES) + "-" * len(text.DASHES)
    c = f"translate({c}, '{src}', '{dst}')"
    for _ in range(2):
        c = f"regexp_replace({c}, '([\\p{{L}}\\p{{N}}])-([\\p{{L}}\\p{{N}}])', '\\1 \\2', 'g')"
    c = f"lower(trim(regexp_replace({c}, '{_SPACE}', ' ', 'g')))"
    c = f"""regexp_replace({c}, '^["'']+|["'']+$', '', 'g')"""
    c = f"""regexp_replace({c}, '"([,.;:!?])', '\\1', 'g')"""
    c = f"regexp_replace({c}, '[ ,.;:!?]+$', '')"
    return f"trim(regexp_replace({c}, '^\\[([a-z])\\]([a-z])', '\\1\\2'))"


_EXACT = f"""q AS (SELECT item_id, {_comparable('text')} AS q FROM benchmark), d AS (SELECT doc_id, text, {_comparable('text')} AS d FROM documents),
m AS (SELECT item_id, doc_id, q FROM q JOIN d ON length(q) > 0 AND CASE WHEN contains(q, ' ') THEN contains(d, q) ELSE contains(' ' || regexp_replace(d, '[^\\p{{L}}\\p{{N}}'']+', ' ', 'g') || ' ', ' ' || q || ' ') END)"""
_LINES = "lines AS (SELECT doc_id, i - 1 AS block, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i))"
_LOCATED = f"""{_EXACT}, {_LINES}, two AS (SELECT doc_id, block, {_comparable('text')} AS one, {_comparable('nxt')} AS second, {_comparable("text || coalesce(chr(10) || nxt, '')")} AS two
    FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY block) AS nxt FROM lines WHERE doc_id IN (SELECT doc_id FROM m))),
loc AS (SELECT item_id, doc_id, block, CASE WHEN contains(one, q) THEN 1 WHEN contains(two, q) AND NOT coalesce(contains(second, q), false) THEN 2 END AS span FROM m JOIN two USING (doc_id))"""
_GRAMS = f"""grams AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [] END) AS g FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark)),
dgrams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [] END) AS g FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)),
cand AS (SELECT item_id, doc_id, count(*) AS shared FROM grams JOIN dgrams USING (g) GROUP BY 1, 2)"""
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_VERDICT = """c AS (SELECT l_orderkey, CASE WHEN l_quantity > 5 THEN round(l_quantity / 50, 2) END AS score, l_returnflag = 'R' AS alternate FROM lineitem),
v AS (SELECT l_orderkey, count(*) AS quotes, coalesce(count_if(score >= 0.6::DOUBLE), 0)::BIGINT AS accepted, bool_and(coalesce(score >= 0.98::DOUBLE, false)) AS perfect, max(score) AS best, coalesce(bool_and(CASE WHEN score >= 0.6::DOUBLE THEN alternate END), false) AS all_alternate FROM c GROUP BY 1),
r AS (SELECT *, CASE WHEN accepted = 0 THEN 'NO_MATCH' ELSE CASE WHEN all_alternate THEN 'ALT_PINPOINT_' ELSE 'OG_PINPOINT_' END || CASE WHEN perfect THEN 'MATCH' ELSE 'PARTIAL' END END AS status FROM v)"""

ORACLES = {
    "lookup_index_build": f"WITH {_CORPUS} SELECT * FROM idx",
    "exact_lookup_batch": f"""WITH {_CORPUS}, a AS (SELECT o_orderkey AS id, 'c4dot' || (o_custkey * 2) AS lookup_key FROM orders),
h AS (SELECT lookup_key, min(substr(row_id, 3)::BIGINT) AS r, count(DISTINCT row_id) AS n FROM idx WHERE lookup_type = 'citation' GROUP BY 1)
SELECT id, lookup_key, coalesce(n, 0) AS hits, CASE WHEN n = 1 THEN r ELSE -1 END AS row_id, CASE coalesce(n, 0) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status FROM a LEFT JOIN h USING (lookup_key)""",
    "name_citation_self_join": f"""WITH {_CORPUS}, n AS (SELECT DISTINCT lower(p_name) AS k FROM part),
k AS (SELECT DISTINCT a.lookup_key, c.lookup_key AS citation_key FROM idx a JOIN n ON a.lookup_key = n.k JOIN idx c USING (row_id) WHERE a.lookup_type = 'name' AND c.lookup_type = 'citation')
SELECT DISTINCT k.lookup_key, citation_key, row_id FROM k JOIN idx c ON c.lookup_key = citation_key WHERE c.lookup_type = 'citation'""",
    "lookup_status": """WITH k AS (SELECT doc_id, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS k FROM documents)
SELECT doc_id, CASE WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status, n AS hits FROM (SELECT doc_id, count(*) OVER (PARTITION BY k) AS n FROM k)""",
    "coverage_by_dataset": f"WITH {_CORPUS} SELECT dataset, count(*) AS n, count(DISTINCT name_en) AS names FROM corpus GROUP BY 1",
    "prefetch_statistics": """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'), n AS (SELECT k FROM a WHERE k NOT IN (SELECT k FROM c) AND k IN (SELECT c_custkey FROM customer))
SELECT (SELECT count(*) FROM a) AS requested, (SELECT count(*) FROM a WHERE k IN (SELECT k FROM c)) AS cached, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END::BIGINT AS partitions, count(*) AS rows FROM n""",
    "alias_tails": """SELECT c_custkey AS id, c_name || ', ' || c_mktsegment || ', ' || n_name AS citation, CASE WHEN c_mktsegment = 'BUILDING' AND n_nationkey < 3 THEN 'B' || n_nationkey ELSE 'R' || n_regionkey END AS canonical_citation FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "unique_identity_status": """WITH r AS (SELECT p_name, p_brand, count(*) AS n, min(p_partkey) AS k FROM part WHERE p_size = 7 GROUP BY 1, 2)
SELECT p_partkey AS id, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN k ELSE -1 END AS row_id FROM part LEFT JOIN r USING (p_name, p_brand)""",
    "dedupe_by_key": f"SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, trim(regexp_replace(lower(text), '{_SPACE}', ' ', 'g'))",
    "quote_exact_match": f"WITH {_EXACT} SELECT item_id, doc_id FROM m",
    "quote_block_location": f"WITH {_LOCATED} SELECT item_id, doc_id, block::INT AS block, span FROM loc WHERE span IS NOT NULL",
    "line_block_offsets": f"""WITH {_LINES}, o AS (SELECT doc_id, block, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lines)
SELECT doc_id, block::INT AS block, start, start + length(text) AS "end" FROM o""",
    "plausible_pairs": f"""WITH asked AS (SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 1000000, array_to_string(list_reverse(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')[4:5 + item_id % 5]), ' ') FROM benchmark),
w AS (SELECT item_id, list_distinct({_WORDS.format('text')}) AS w FROM asked), c AS (SELECT item_id, w, list_filter(w, lambda x: NOT list_contains({_STOP}, x) AND (length(x) > 1 OR NOT regexp_matches(x, '^\\p{{L}}$'))) AS c FROM w),
q AS (SELECT item_id, len(c) AS n, unnest(CASE WHEN len(c) > 0 THEN c ELSE w END) AS w FROM c), d AS (SELECT doc_id, unnest(list_distinct({_WORDS.format('text')})) AS w FROM documents)
SELECT item_id, doc_id FROM q JOIN d USING (w) GROUP BY 1, 2 HAVING count(*) >= any_value(CASE WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 ELSE (n * 35 + 99) // 100 END)""",
    "ngram_candidates": f"WITH {_GRAMS} SELECT * FROM cand",
    "content_overlap": f"""WITH {_GRAMS}, p AS (SELECT item_id, doc_id, list_filter(list_distinct({_WORDS.format('b.text')}), lambda w: NOT list_contains({_STOP}, w) AND NOT regexp_full_match(w, '\\p{{L}}')) AS q, {_WORDS.format('d.text')} AS d FROM cand JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)),
n AS (SELECT item_id, doc_id, len(q) AS content, len(list_intersect(q, d)) AS common FROM p)
SELECT item_id, doc_id, content::INT AS content, common::INT AS common, CASE WHEN content = 0 THEN true WHEN content <= 2 THEN common >= 1 WHEN content <= 4 THEN common >= 2 ELSE common * 100 >= content * 35 END AS plausible FROM n""",
    "verify_quotes": f"""WITH {_LOCATED}, f AS (SELECT item_id, count(DISTINCT doc_id) AS sources, min((doc_id, block)) AS place FROM loc WHERE span IS NOT NULL GROUP BY 1)
SELECT item_id, coalesce(sources, 0) AS sources, coalesce(f.place[1], -1) AS doc_id, coalesce(f.place[2], -1)::INT AS block, CASE WHEN sources > 0 THEN 'OG_PINPOINT_MATCH' ELSE 'NO_MATCH' END AS status FROM benchmark LEFT JOIN f USING (item_id)""",
    "inline_quotes": """WITH q AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[“"]([^”"]*)[”"]', 1), lambda x: trim(x) <> '') AS q FROM documents) SELECT doc_id, (i - 1)::INT AS n, q[i] AS quote FROM q, unnest(range(1, len(q) + 1)) AS u(i)""",
    "url_extraction": """SELECT page_id, count(*) AS links, min(link) AS first_link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY 1""",
    "link_parts": "SELECT page_id, split_part(url, '#', 1) AS bare, regexp_extract(url, '#(.*)$', 1) AS fragment, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages",
    "previous_part": "SELECT conv_id || '/' || turn AS part, lag(conv_id || '/' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations",
    "chain_origin": "SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS origin FROM conversations",
    "chain_pointers": """SELECT o_orderkey AS part, first_value(o_orderkey) OVER w AS origin, row_number() OVER w - 1 AS hops, NULL::VARCHAR AS note FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "selection_closure": """WITH s AS (SELECT DISTINCT conv_id FROM conversations WHERE turn = 3) SELECT DISTINCT conv_id * 1000 + turn AS node FROM conversations JOIN s USING (conv_id) WHERE turn <= 3""",
    "origin_inheritance": """WITH o AS (SELECT conv_id, turn, role = 'user' AS own, md5(text) AS h, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS origin FROM conversations)
SELECT a.conv_id * 1000 + a.turn AS part, b.h AS link FROM o a LEFT JOIN o b ON a.conv_id = b.conv_id AND b.turn = a.origin""",
    "registry_tiers": """WITH r AS (SELECT user_id, event_id, floor(value)::BIGINT AS note, 'u/' || floor(value / 4)::BIGINT AS base, 'u/' || floor(value / 4)::BIGINT || '#' || event_id AS link FROM events WHERE event_type IN ('purchase', 'signup')),
a AS (SELECT user_id, event_id AS seq, floor(value)::BIGINT AS note FROM events WHERE event_type = 'error'),
t AS (SELECT a.user_id, seq, arg_min(link, event_id) AS link FROM a JOIN r ON a.user_id = r.user_id AND r.event_id < seq AND a.note = r.note GROUP BY 1, 2 HAVING count(DISTINCT base) = 1)
SELECT user_id AS doc_id, seq, CASE WHEN link IS NOT NULL THEN 1 ELSE 0 END AS tier, link FROM a LEFT JOIN t USING (user_id, seq)""",
    "asof_anchor": """SELECT event_id, CASE WHEN lead(ts) OVER w - ts <= INTERVAL 6 HOURS THEN lead(event_id) OVER w ELSE -1 END AS next_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "top_candidates": "SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey))::INT AS rank FROM part WHERE lower(p_name) LIKE '%widget%') WHERE rank <= 3",
    "page_map_first": "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS l_partkey FROM lineitem GROUP BY 1",
    "range_scope_join": "SELECT o_orderpriority AS scope, l_linenumber, count(*) AS n, sum(l_partkey)::BIGINT AS keys FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber BETWEEN 2 AND 2 + length(o_orderstatus) * 2 GROUP BY 1, 2",
    "interval_overlap": """WITH e AS (SELECT *, floor(epoch(ts))::BIGINT - 1704067200 AS at FROM events)
SELECT l.user_id, l.event_id AS link, min(p.event_id) AS part FROM e l JOIN e p ON l.user_id = p.user_id AND p.event_type = 'view' AND l.event_type = 'click' AND greatest(p.at, l.at) < least(p.at + 7200, l.at + 3600) GROUP BY 1, 2""",
    "global_positions": "SELECT conv_id, turn, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM conversations",
    "display_numbering": "SELECT conv_id, turn, CASE WHEN role <> 'system' THEN sum((role <> 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn) ELSE -1 END::BIGINT AS number FROM conversations",
    "repeat_suppression": """SELECT l_orderkey, count_if(r)::BIGINT AS suppressed, count(*) AS n FROM (SELECT l_orderkey, coalesce(l_returnflag = lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate), false) AS r FROM lineitem) GROUP BY 1""",
    "verdict_rollup": f"WITH {_VERDICT} SELECT * FROM r",
    "verdict_counters": f"WITH {_VERDICT} SELECT status, count(*) AS n, sum(quotes)::BIGINT AS quotes, sum(accepted)::BIGINT AS accepted FROM r GROUP BY 1",
    "inventory_diff": """WITH f AS (SELECT p_partkey, p_size, md5(p_name || '|' || p_brand || '|' || p_size) AS h FROM part), a AS (SELECT 'p/' || p_partkey AS path, h, p_partkey AS size FROM f WHERE p_size <= 30),
b AS (SELECT 'p/' || p_partkey || CASE WHEN p_size = 25 THEN '.new' ELSE '' END AS path, h, p_partkey AS size FROM f WHERE p_size >= 20)
SELECT path, CASE WHEN (path, h, size) IN (SELECT (path, h, size) FROM a) THEN 'reuse' WHEN (h, size) IN (SELECT (h, size) FROM a) THEN 'copy' ELSE 'download' END AS action FROM b
UNION ALL SELECT path, 'remove' FROM a WHERE path NOT IN (SELECT path FROM b)""",
    "median_gate": f"""WITH {_LINES}, n AS (SELECT doc_id, len(regexp_extract_all(text, '[^ ]+')) AS n FROM lines) SELECT doc_id, median(n)::DOUBLE AS median_words, round(avg((n >= 12)::INT::DOUBLE), 6) AS substantive FROM n GROUP BY 1""",
    "running_cap": "SELECT day, n FROM (SELECT day, n, sum(n) OVER (ORDER BY day) AS s FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1)) WHERE s <= 2000",
    "id_lists": """WITH r AS (SELECT l_linenumber AS a, l_linenumber + 3 AS b, l_quantity::INT AS c FROM lineitem), s AS (SELECT list_sort(list_distinct(list_append(range(least(b, c), greatest(b, c) + 1), a::BIGINT))) AS ids FROM r)
SELECT array_to_string(ids, ',') AS ids, count(*) AS n FROM s GROUP BY 1""",
    "abbreviated_ranges": """WITH r AS (SELECT DISTINCT l_partkey AS a, l_quantity::BIGINT AS b FROM lineitem), t AS (SELECT *, (10 ** length(b::VARCHAR))::BIGINT AS s FROM r)
SELECT a AS first, b AS last, CASE WHEN b >= a THEN b WHEN a - a % s + b >= a THEN a - a % s + b ELSE a - a % s + b + s END AS "end" FROM t""",
    "title_substrings": f"""WITH q AS (SELECT DISTINCT substr(string_split(p_name, ' ')[1], 2) || ' ' || substr(string_split(p_name, ' ')[2], 1, length(string_split(p_name, ' ')[2]) - 1) AS title FROM part),
k AS (SELECT title, list_filter({_WORDS.format('title')}, lambda x: length(x) > 2)[1:3] AS k FROM q)
SELECT title AS query_id, p_partkey AS article_id FROM k JOIN part ON len(k) > 0 AND len(list_filter(k, lambda x: NOT contains(lower(p_name), x))) = 0""",
    "title_candidates": f"""WITH w AS (SELECT p_partkey, list_filter({_WORDS.format('p_name')}, lambda x: length(x) > 2)[1:3] AS k, {_WORDS.format('p_name')} AS w, p_name FROM part), q AS (SELECT min(p_partkey) AS query_id, any_value(list_distinct(k)) AS k FROM w GROUP BY p_name)
SELECT query_id, p_partkey AS article_id FROM q JOIN w ON len(q.k) > 0 AND list_has_all(w.w, q.k)""",
    "marker_blocks": """WITH t AS (SELECT conv_id, turn, '[' || (turn + 1) || '] ' || replace(text, chr(10), ' ') AS line FROM conversations),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t) SELECT conv_id AS doc_id, (turn + 1)::VARCHAR AS label, start, start + length(line) AS "end" FROM o""",
    "quote_locations": f"""WITH {_LOCATED}, b AS (SELECT m.item_id, m.doc_id, max(contains(one, q)::INT) AS hit, max((contains(one, q) AND block <= 2)::INT) AS cited, string_agg(CASE WHEN contains(one, q) THEN block END::VARCHAR, ',' ORDER BY block) AS labels,
    string_agg(CASE WHEN contains(one, q) AND block <= 2 THEN block END::VARCHAR, ',' ORDER BY block) AS scoped FROM m JOIN two USING (doc_id) GROUP BY 1, 2)
SELECT item_id, doc_id, CASE WHEN cited = 1 THEN 'cited' WHEN hit = 1 THEN 'alternate' ELSE 'alternate_document' END AS location, CASE WHEN hit = 0 THEN '' WHEN cited = 1 THEN scoped ELSE labels END AS labels FROM b""",
    "cited_scope_ranges": """WITH r AS (SELECT DISTINCT l_linenumber, l_quantity, l_orderkey, l_partkey, l_suppkey, l_shipdate, l_linenumber AS a, l_linenumber + 4 AS b, l_quantity::INT AS c, row_number() OVER () AS i FROM lineitem),
e AS (SELECT l_linenumber, i, a AS low, b AS high FROM r UNION SELECT l_linenumber, i, c, c FROM r) SELECT l_linenumber, low::BIGINT AS low, high::BIGINT AS high, count(*) AS n FROM e GROUP BY 1, 2, 3""",
    "set_difference": "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders",
    "row_positions": "WITH n AS (SELECT c_nationkey, c_custkey, row_number() OVER () AS r FROM customer) SELECT c_nationkey, arg_min(c_custkey, r) AS first_key, arg_max(c_custkey, r) AS last_key FROM n GROUP BY 1",
    "json_sections": """WITH e AS (SELECT event_type, CASE WHEN event_type <> 'view' THEN (props->>'k')::INT END AS k FROM events) SELECT event_type, count(k) AS found, count(*) AS n, coalesce(sum(k), 0)::BIGINT AS total FROM e GROUP BY 1""",
}
