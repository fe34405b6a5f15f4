"""Articles by title: candidates, metadata filters, similarity, page links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.references import page_link
from marginalia.functions.similarity import score, title_ratio
from marginalia.functions.text import squeezed, words
from marginalia.sources.shared import materialize, small, spread_join

FLOOR, ACCEPT = 0.50, 0.70  # fixed: similarity that a candidate needs, and that a link needs


def normal_title(column: Column) -> Column:
    return F.array_join(words(column), " ")


def title_candidates(queries: DataFrame, articles: DataFrame, loose: bool = False, n: int | None = None) -> DataFrame:
    """(query_id, article_id): strict, the first three longer words (over two letters) of the query all occur in the title; loose,
    one of the first five occurs in the title, or in citation_en where the articles have that. Joined by word, so articles that
    share none never meet."""
    n = n or (5 if loose else 3)
    keys = F.slice(F.filter(words(F.col("title")), lambda w: F.length(w) > 2), 1, n)
    q = queries.withColumn("_keys", F.array_distinct(keys)).withColumn("_need", F.lit(1) if loose else F.size("_keys"))
    asked = q.select("query_id", "_need", F.explode("_keys").alias("word"))
    own = words(F.concat_ws(" ", "name_en", "citation_en")) if loose and "citation_en" in articles.columns else words(F.col("name_en"))
    held = articles.select("article_id", F.explode(F.array_distinct(own)).alias("word"))
    met = held.join(small(asked), "word").groupBy("query_id", "article_id").agg(F.count(F.lit(1)).alias("_n"), F.max("_need").alias("_need"))
    return met.filter("_n >= _need").select("query_id", "article_id")


def _grams(column: Column, n: int) -> Column:
    """All different stretches of n characters; a shorter text is one itself."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(column) - n + 1, F.lit(1))), lambda i: F.substring(column, i, F.lit(n))))


def containing(pieces: DataFrame, texts: DataFrame, n: int = 3) -> DataFrame:
    """(piece_id, text_id): the texts (text_id, text) that contain a piece (piece_id, piece), inside words too and whatever the case; blank
    pieces are in none.

    A piece is looked up by the rarest of its stretches of n characters, by how many texts have each; pieces shorter than n by
    themselves, in an index of stretches of their length. Only stretches of pieces leave the scan of the texts; places of
    frequent ones are dealt over tasks, and what is met is compared whole."""
    asked = pieces.select("piece_id", F.lower("piece").alias("_p")).filter(F.length(F.trim("_p")) > 0)
    asked = materialize(asked.withColumn("_n", F.least(F.length("_p"), F.lit(n))), "pieces")
    widths = [r[0] for r in asked.select("_n").distinct().collect()]  # at most n numbers
    if not widths:
        return asked.select("piece_id").join(texts.select("text_id"), F.lit(False))
    own = asked.select("piece_id", "_p", F.explode(F.coalesce(*[F.when(F.col("_n") == w, _grams(F.col("_p"), w)) for w in widths])).alias("gram"))
    low = texts.select("text_id", F.lower("text").alias("_t")).filter(F.col("_t").isNotNull())
    held = low.select("text_id", "_t", F.explode(F.flatten(F.array(*[_grams(F.col("_t"), w) for w in widths]))).alias("gram"))
    counts = held.select("gram").join(small(own.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("_many"))
    # a piece with a stretch that no text has is in none
    known = own.join(counts, "gram", "left").groupBy("piece_id", "_p").agg(F.min(F.struct(F.coalesce("_many", F.lit(0)).alias("_many"), "gram")).alias("_r")).filter("_r._many > 0")
    rarest = materialize(known.select("piece_id", "_p", "_r.gram", "_r._many"), "rarest")
    met = spread_join(held, rarest, "gram", "_many", F.xxhash64("text_id"))
    return met.filter(F.contains("_t", "_p")).select("piece_id", "text_id").distinct()


def like_candidates(queries: DataFrame, articles: DataFrame, loose: bool = False) -> DataFrame:
    """(query_id, article_id) as title_candidates, but the query's words count inside longer words of the title too: strict, the first three
    longer words all; loose, one of the first five, in the citation too where the articles have it. Queries without a longer word have
    none. A strict query is looked up by its longest word, and the others are looked for in what that finds."""
    keys = F.array_distinct(F.slice(F.filter(words(F.col("title")), lambda w: F.length(w) > 2), 1, 5 if loose else 3))
    q = queries.select("query_id", keys.alias("_keys")).filter("size(_keys) > 0")
    own = F.concat_ws("\n", "name_en", "citation_en") if loose and "citation_en" in articles.columns else F.col("name_en")
    held = articles.select(F.col("article_id").alias("text_id"), own.alias("text"))
    longest = F.array_max(F.transform("_keys", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = q.select("query_id", "_keys", F.explode("_keys").alias("piece")) if loose else q.select("query_id", "_keys", longest.alias("piece"))
    once = asked.select("piece").distinct().select(F.col("piece").alias("piece_id"), "piece")  # a word that many queries have is looked up once
    met = asked.join(containing(once, held).withColumnRenamed("piece_id", "piece"), "piece")
    if not loose:
        low = held.select("text_id", F.lower("text").alias("_t"))
        met = met.filter("size(_keys) = 1").select("query_id", "text_id").unionByName(met.filter("size(_keys) > 1").join(low, "text_id").filter(F.forall("_keys", lambda w: F.contains(F.col("_t"), w))).select("query_id", "text_id"))
    return met.select("query_id", F.col("text_id").alias("article_id")).distinct()


def metadata_fits(year: Column, citation: Column, date: Column, volume: Column, have_volume: Column, issue: Column | None = None, have_issue: Column | None = None, hint: Column | None = None, names: tuple[Column, ...] = ()) -> Column:
    """Whether an article fits what a citation says of it; what the citation lacks fits. Year: within one of the date's, or one of these
    years in the citation. Volume: within one, or its digits in the citation. Issue: within one, or behind a colon in the citation.
    hint: part of one of the names (journal, abbreviation, citation), in any case."""
    text, whole = F.coalesce(citation, F.lit("")), lambda c: c.try_cast("int")
    near = lambda have, want: F.coalesce(F.abs(whole(have) - whole(want)) <= 1, F.lit(False))
    y = F.coalesce(F.year(date).between(year - 1, year + 1), F.lit(False))
    for step in (-1, 0, 1):
        y = y | F.contains(text, (year + step).cast("string"))
    fits = (year.isNull() | y) & (whole(volume).isNull() | near(have_volume, volume) | F.contains(text, whole(volume).cast("string")))
    if issue is not None:
        fits = fits & (whole(issue).isNull() | near(have_issue, issue) | F.contains(text, F.concat(F.lit(":"), whole(issue).cast("string"))))
    if hint is not None:
        wanted, found = F.lower(F.trim(F.coalesce(hint, F.lit("")))), F.lit(False)
        for name in names:
            found = found | F.contains(F.lower(F.coalesce(name, F.lit(""))), wanted)
        fits = fits & ((wanted == "") | found)
    return F.coalesce(fits, F.lit(False))


def fitting_candidates(queries: DataFrame, articles: DataFrame, candidates: DataFrame) -> DataFrame:
    """Those of candidates (query_id, article_id) whose article fits the query's year, volume, issue and journal. articles have
    citation_en, document_date_en, volume, issue, journal_name and journal_abbrev."""
    q = queries.select("query_id", *[F.col(c).alias(f"_q_{c}") for c in ("year", "volume", "issue", "journal")])
    a = articles.select("article_id", "citation_en", "document_date_en", "volume", "issue", "journal_name", "journal_abbrev")
    joined = candidates.join(small(q), "query_id").join(a, "article_id")
    fits = metadata_fits(
        F.col("_q_year").try_cast("int"), F.col("citation_en"), F.col("document_date_en").try_cast("date"), F.col("_q_volume"), F.col("volume"), F.col("_q_issue"), F.col("issue"), F.col("_q_journal"),
        (F.col("journal_name"), F.col("journal_abbrev"), F.col("citation_en")))
    return joined.filter(fits).select("query_id", "article_id")


def article_texts(asked: DataFrame, articles: DataFrame) -> DataFrame:
    """asked (article_id and others) with the article's text; empty where there is no such article or text."""
    held = articles.groupBy("article_id").agg(F.min("text").alias("text"))
    return asked.join(held, "article_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def page_spans(articles: DataFrame) -> DataFrame:
    """(doc_id, label, start, end, text) of the pages of texts with [page N] markers: from behind a marker to the next, or to the end."""
    marks = articles.select(F.col("article_id").alias("doc_id"), F.split("text", "(?i)(?=\\[page\\s+[0-9ivxlc]{1,6}\\])").alias("_p"))
    each = marks.select("doc_id", F.posexplode("_p").alias("_i", "_piece"), F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.aggregate(F.slice("_p", F.lit(1), i - 1), F.lit(0), lambda s, x: s + F.length(x))).alias("_at"))
    head = F.regexp_extract("_piece", "(?i)^\\[page\\s+([0-9ivxlc]{1,6})\\]", 0)
    found = each.filter(head != "").select("doc_id", F.regexp_extract("_piece", "(?i)^\\[page\\s+([0-9ivxlc]{1,6})\\]", 1).alias("label"), (F.get("_at", F.col("_i")) + F.length(head)).cast("long").alias("start"), F.substring(F.col("_piece"), F.length(head) + 1, F.length("_piece")).alias("text"))
    return found.select("doc_id", "label", "start", (F.col("start") + F.length("text")).alias("end"), "text")


def pages_of_quotes(asked: DataFrame, spans: DataFrame, least: float = 0.0) -> DataFrame:
    """(item_id, doc_id, label) of the pages that hold a quotation of asked (item_id, doc_id, quote): its words in one piece whatever the
    white space and case, or, with least above 0, a match score of at least that."""
    flat = lambda c: F.lower(squeezed(c))
    joined = asked.join(spans, "doc_id").filter(squeezed(F.col("quote")) != "")
    exact = F.contains(flat(F.col("text")), flat(F.col("quote")))
    if least > 0:
        exact = exact | (score(F.col("text"), F.col("quote"), exact) >= least)
    return joined.filter(exact).select("item_id", "doc_id", "label")


def best_articles(queries: DataFrame, articles: DataFrame, candidates: DataFrame, n: int = 1, least: float = FLOOR) -> DataFrame:
    """The n best of each query's candidates by similarity of normal titles, ties by article_id; an equal title scores 1, is not
    aligned at all, and leaves no other candidates. Pairs of equal titles are aligned once."""
    q = queries.select("query_id", normal_title(F.col("title")).alias("_q"))
    a = articles.select("article_id", normal_title(F.col("name_en")).alias("_t"))
    joined = candidates.join(q, "query_id").join(a, "article_id")
    same = F.col("_q") == F.col("_t")
    rated = joined.withColumn("score", F.when(same, 1.0).otherwise(title_ratio(F.when(~same, F.col("_q")), F.col("_t")))).filter(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "article_id")
    return rated.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("query_id", "article_id", F.round("score", 6).alias("score"), "rank")


def page_links(pins: DataFrame, articles: DataFrame, pages: DataFrame) -> DataFrame:
    """pins (article_id, page) with link: to the mapped pdf page, else by counting from the first page of the article."""
    mapped = pages.groupBy("article_id", F.col("page_label").alias("_label")).agg(F.min_by("pdf_page", "page_order").alias("pdf_page"))
    joined = pins.withColumn("_label", F.col("page").cast("string")).join(articles.select("article_id", "galley_url", F.col("first_page").try_cast("int").alias("_first")), "article_id", "left").join(mapped, ["article_id", "_label"], "left")
    return joined.select(*pins.columns, page_link(F.col("galley_url"), F.col("page"), F.col("_first"), F.col("pdf_page")).alias("link"))
