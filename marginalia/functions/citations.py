"""What can be read off citations and links: first pages, journal details, titles, datasets, recognisers, urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.references import neutral_citation
from marginalia.functions.text import replace_all, words
from marginalia.sources.shared import small

_REPORTER = "(?:\\[[0-9]{4}\\]|\\([0-9]{4}\\))\\s+(?:[0-9]+\\s+)?(?:[\\p{L}.]+\\s+)+([0-9]+)"
#: Fixed: the dataset that a law's wording belongs to; the first that fits decides. Case doesn't matter.
LAW_DATASETS = (
    ("\\b(?:SOR|SI|DORS|TR)[/-][0-9]|\\bC\\.?R\\.?C\\.?\\b", "REGULATIONS-FED"), ("\\b(?:RSC|SC)\\s+[0-9]{4}\\b", "LEGISLATION-FED"),
    ("\\b(?:Alta|AB)\\s+Reg\\b", "REGULATIONS-AB"), ("\\b(?:RSA|SA)\\s+[0-9]{4}\\b", "LEGISLATION-AB"), ("\\bBC\\s+Reg\\b", "REGULATIONS-BC"), ("\\b(?:RSBC|SBC)\\s+[0-9]{4}\\b", "LEGISLATION-BC"),
    ("\\bMan\\s+Reg\\b", "REGULATIONS-MB"), ("\\b(?:RSM|SM)\\s+[0-9]{4}\\b", "LEGISLATION-MB"), ("\\bNB\\s+Reg\\b", "REGULATIONS-NB"), ("\\b(?:RSNB|SNB)\\s+[0-9]{4}\\b", "LEGISLATION-NB"),
    ("\\bNLR\\b", "REGULATIONS-NL"), ("\\b(?:RSNL|SNL)\\s+[0-9]{4}\\b", "LEGISLATION-NL"), ("\\bNS\\s+Reg\\b", "REGULATIONS-NS"), ("\\b(?:RSNS|SNS)\\s+[0-9]{4}\\b", "LEGISLATION-NS"),
    ("\\b(?:NWT\\s+Reg|RRNWT)\\b", "REGULATIONS-NT"), ("\\b(?:RSNWT|SNWT)\\s+[0-9]{4}\\b", "LEGISLATION-NT"), ("\\b(?:O|Ont)\\s+Reg\\b", "REGULATIONS-ON"), ("\\b(?:RSO|SO)\\s+[0-9]{4}\\b", "LEGISLATION-ON"),
    ("\\b(?:Sask\\s+Reg|RRS)\\b", "REGULATIONS-SK"), ("\\b(?:RSS|SS)\\s+[0-9]{4}\\b", "LEGISLATION-SK"), ("\\bYOIC\\b", "REGULATIONS-YT"), ("\\b(?:RSY|SY)\\s+[0-9]{4}\\b", "LEGISLATION-YT"),
)
#: Fixed: where each dataset's current laws are published, as (dataset, host, a pattern of path and query).
LAW_SOURCES = (
    ("LEGISLATION-AB", "kings-printer.alberta.ca", "/1266\\.cfm\\?(?:.*&)?leg_type=acts(?:&|$)"), ("REGULATIONS-AB", "kings-printer.alberta.ca", "/1266\\.cfm\\?(?:.*&)?leg_type=regs(?:&|$)"),
    ("LEGISLATION-BC", "bclaws.gov.bc.ca", "/civix/document/id/complete/statreg/[^?]*/xml(?:\\?|$)"), ("REGULATIONS-BC", "bclaws.gov.bc.ca", "/civix/document/id/complete/statreg/[^?]*/xml(?:\\?|$)"),
    ("LEGISLATION-FED", "laws-lois.justice.gc.ca", "^/eng/xml/[^?]*\\.xml(?:\\?|$)"), ("REGULATIONS-FED", "laws-lois.justice.gc.ca", "^/eng/xml/[^?]*\\.xml(?:\\?|$)"),
    ("LEGISLATION-MB", "web2.gov.mb.ca", "/laws/statutes/ccsm/[^?]*\\.php(?:\\?|$)"), ("REGULATIONS-MB", "web2.gov.mb.ca", "/laws/regs/current/[^?]*\\.php(?:\\?|$)"),
    ("LEGISLATION-NB", "laws.gnb.ca", "/en/document/cs/"), ("REGULATIONS-NB", "laws.gnb.ca", "/en/document/cr/"),
    ("LEGISLATION-NL", "assembly.nl.ca", "/legislation/sr/statutes/[^?]*\\.htm(?:\\?|$)"), ("REGULATIONS-NL", "assembly.nl.ca", "/legislation/sr/regulations/[^?]*\\.htm(?:\\?|$)"),
    ("LEGISLATION-NS", "nslegislature.ca", "/sites/default/files/legc/[^?]*\\.(?:htm|pdf)(?:\\?|$)"), ("REGULATIONS-NS", "novascotia.ca", "/just/regulations/regs/[^?]*\\.html?(?:\\?|$)"),
    ("LEGISLATION-NT", "justice.gov.nt.ca", "/en/files/legislation/[^?]*\\.a\\.pdf(?:\\?|$)"), ("REGULATIONS-NT", "justice.gov.nt.ca", "/en/files/legislation/[^?]*\\.r[0-9]+\\.pdf(?:\\?|$)"),
    ("LEGISLATION-ON", "ontario.ca", "/laws/api/v2/legislation/en/doc-search/statute/"), ("REGULATIONS-ON", "ontario.ca", "/laws/api/v2/legislation/en/doc-search/regulation/"),
    ("LEGISLATION-YT", "laws.yukon.ca", "/legislation/principal/[^?]*\\.pdf(?:\\?|$)"), ("REGULATIONS-YT", "laws.yukon.ca", "/legislation/(?:subordinate|regs)/[^?]*\\.pdf(?:\\?|$)"),
)
#: Fixed: kinds of web citations that come with their link, and of sources whose missing text is worth a report.
WEB_KINDS, REPORTED_KINDS = ("other", "non_parliamentary", "website"), ("case", "unreported", "statute", "regulation", "legislation", "gazette")
#: Fixed: forms by which services that hold foreign cases recognise a citation.
PROVIDERS = (
    ("uk_case_law", "\\[[0-9]{4}\\] (?:UKSC|UKPC|EWCA (?:Civ|Crim)|EWHC|UKUT|UKFTT) [0-9]+"),
    ("uk_employment", "\\b[0-9]{7}/(?:19|20)[0-9]{2}\\b"),
    ("us_reporter", "\\b[0-9]{1,4} (?:U\\.?S\\.?|S\\.? ?Ct\\.?|F\\.? ?(?:2d|3d|4th)|F\\.? ?Supp\\.?(?: ?[23]d)?) [0-9]{1,5}\\b"),
    ("us_docket", "\\b[0-9]:[0-9]{2}-(?:cv|cr|mc|md)-[0-9]{3,5}\\b"),
)


def first_page(column: Column) -> Column:
    """The page a reported citation begins at: the number behind year, volume and reporter; empty if there is none."""
    return F.regexp_extract(column, _REPORTER, 1)


def quoted_titles(column: Column) -> Column:
    """Titles in double, then in single curly quotation marks, each spelling once by its words."""
    found = F.concat(F.regexp_extract_all(column, F.lit("[“\"]([^”\"]+)[”\"]"), F.lit(1)), F.regexp_extract_all(column, F.lit("‘([^’]+)’"), F.lit(1)))
    clean = F.transform(found, lambda t: F.trim(F.regexp_replace(t, "[,.]+$", "")))
    keyed = F.transform(clean, lambda t: F.struct(F.array_join(words(t), " ").alias("k"), t.alias("t")))
    first = F.filter(keyed, lambda x, i: (x["k"] != "") & (F.array_position(F.transform(keyed, lambda y: y["k"]), x["k"]) == i + 1))
    return F.transform(first, lambda x: x["t"])


def journal_details(column: Column) -> Column:
    """Year, volume, issue, journal and first page of '(2001) 39:2 Osgoode Hall LJ 1'; empty strings if it has no such part."""
    form = "\\(([0-9]{4})\\)\\s+([0-9]+)(?::([0-9]+))?\\s+([\\p{L}][\\p{L}&. '’-]+?)\\s+([0-9]+)\\b"
    return F.struct(*[F.regexp_extract(column, form, i).alias(name) for i, name in enumerate(("year", "volume", "issue", "journal", "first_page"), 1)])


def dataset_of(column: Column) -> Column:
    """The partition that holds what is cited, for pruning: a neutral citation's court, or a law's dataset; null where it can't be told."""
    laws = F.coalesce(*[F.when(column.rlike(f"(?i){pattern}"), name) for pattern, name in LAW_DATASETS])
    court = F.upper(F.regexp_extract(column, "(?i)\\b(?:18|19|20)[0-9]{2}\\s+([A-Z][A-Z0-9]{1,15})\\s+[0-9]+\\b", 1))
    return F.coalesce(laws, F.nullif(court, F.lit("")))


def prune(asked: DataFrame, corpus: DataFrame, citation: str = "citation") -> DataFrame:
    """corpus rows of the datasets that asked citations name, which meet the partition column, so that partitions that none names are
    not read. All are kept if some citation's dataset can't be told. Codes come from free text, so they are counted before they
    are broadcast."""
    wanted = asked.select(dataset_of(F.col(citation)).alias("dataset")).distinct()
    if not wanted.filter("dataset is null").isEmpty():
        return corpus
    return corpus.join(small(wanted), "dataset", "left_semi")


def current_law_source(dataset: Column, url: Column) -> Column:
    """Whether a url has the shape under which the dataset's current laws are published."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)), "^www\\.", "")
    path = F.lower(F.regexp_extract(url, "(?i)^https?://[^/?#]+([^#]*)", 1))
    return F.coalesce(*[F.when((dataset == name) & (host == h), path.rlike(pattern)) for name, h, pattern in LAW_SOURCES], F.lit(False))


def prefilled_web(kind: Column, link: Column, kept_hosts: tuple[str, ...] = ("example.org",)) -> Column:
    """Whether a citation of the web brings its own link, which no search has to find: one of WEB_KINDS whose host is none of kept_hosts
    or their subdomains."""
    host = F.lower(F.regexp_extract(link, "(?i)^[a-z]+://([^/?#]+)", 1))
    own = F.lit(False)
    for h in kept_hosts:
        own = own | (host == h) | host.endswith(f".{h}")
    return F.coalesce(F.lower(F.trim(kind)).isin(*WEB_KINDS) & (host != "") & ~own, F.lit(False))


def reports_missing_text(kind: Column, link: Column, resolved: Column) -> Column:
    """Whether a source without text is worth a warning: it has a web address, and is a case, a law or a gazette, or an article whose
    link was resolved."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.coalesce(F.trim(link).rlike("(?i)^https?://[^/?#]"), F.lit(False)) & (k.isin(*REPORTED_KINDS) | ((k == "journal") & F.coalesce(resolved, F.lit(False))))


def provider(column: Column) -> Column:
    """The first service whose form the citation has; null if none has."""
    return F.coalesce(*[F.when(column.rlike(pattern), name) for name, pattern in PROVIDERS])


def only_match(candidates: DataFrame, by: str, value: str) -> DataFrame:
    """by and the value, where a service gave exactly one; empty where it gave several."""
    return candidates.groupBy(by).agg(F.when(F.count_distinct(value) == 1, F.min(value)).otherwise("").alias(value))


def statute_text(column: Column) -> Column:
    """Dotted series (R.S.C.) without dots, the French L.R.C. as RSC, white space collapsed."""
    plain = replace_all(column, ("\\b((?:[A-Z]\\.){2,})", "$1\u0001"), ("\\.(?=(?:[A-Z]\\.)*\u0001)", ""), ("\u0001", ""))
    return F.trim(replace_all(plain, ("\\bLRC\\b", "RSC"), ("\\bLC(?= [0-9]{4})", "SC"), ("\\s+", " ")))


def case_url(column: Column, base: str = "https://example.org", language: str = "en") -> Column:
    """The address of a neutral citation, by year and lower-case code; empty without one. A pinpoint adds #parN."""
    return _address(column, F.lower(F.regexp_extract(neutral_citation(column), "[0-9]{4} ([A-Z]+) [0-9]+", 1)), base, language)


def _address(column: Column, route: Column, base: str, language: str) -> Column:
    cite = neutral_citation(column)
    slug = F.lower(F.translate(cite, " ", ""))
    pin = F.regexp_extract(column, "(?i)\\bparas?\\.?\\s*([0-9]+)", 1)
    url = F.concat(F.lit(f"{base}/{language}/"), route, F.lit("/doc/"), F.regexp_extract(cite, "([0-9]{4})", 1), F.lit("/"), slug, F.lit("/"), slug, F.lit(".html"))
    plain = F.concat(F.lit(f"{base}/{language}/"), route, F.lit("/"), F.regexp_extract(cite, "([0-9]{4})", 1), F.lit("/"), slug, F.lit("/"), slug, F.lit(".html"))
    return F.when(cite == "", "").otherwise(F.concat(F.when(F.contains(route, F.lit("/")), url).otherwise(plain), F.when(pin == "", "").otherwise(F.concat(F.lit("#par"), pin))))


def case_urls(asked: DataFrame, routes: DataFrame, citation: str = "citation", base: str = "https://example.org", language: str = "en") -> DataFrame:
    """asked with url, the address of its neutral citation under the route of its court; routes: (code, route), as ('BCCA', 'bc/bcca').
    Empty without a neutral citation or a route."""
    code = F.regexp_extract(neutral_citation(F.col(citation)), "[0-9]{4} ([A-Z]+) [0-9]+", 1)
    joined = asked.withColumn("_code", code).join(small(routes.select(F.col("code").alias("_code"), F.col("route").alias("_route"))), "_code", "left")
    return joined.withColumn("url", F.coalesce(_address(F.col(citation), F.col("_route"), base, language), F.lit(""))).drop("_code", "_route")


def law_slug(citation: Column) -> Column:
    """A law's citation as the last part of its address: lower case, 'c' joined to its chapter, all else as dashes; RSC 1985, c C-46 is
    rsc-1985-c-c-46."""
    return replace_all(F.lower(statute_text(citation)), ("[.,]", " "), ("[^a-z0-9]+", "-"), ("^-|-$", ""))


def law_url(dataset: Column, citation: Column, base: str = "https://example.org", language: str = "en") -> Column:
    """The address of a law, by its dataset (statutes and regulations lie apart) and slug; empty where the citation isn't of that dataset."""
    place = F.lower(F.regexp_extract(dataset, "-([A-Z]+)$", 1))
    shelf = F.when(dataset.startswith("LEGISLATION-"), "stat").when(dataset.startswith("REGULATIONS-"), "regu")
    slug = law_slug(citation)
    return F.when(dataset_of(citation).eqNullSafe(dataset) & shelf.isNotNull(), F.concat(F.lit(f"{base}/{language}/"), F.when(place == "fed", "ca").otherwise(place), F.lit("/laws/"), shelf, F.lit("/"), slug, F.lit("/latest/"), slug, F.lit(".html"))).otherwise("")


def anchored_link(link: Column, column: Column, is_ibid: Column) -> Column:
    """An inherited link moved to the reference's own paragraph: an ibid without one keeps the link, a supra without one gets it
    bare."""
    pin = F.regexp_extract(column, "(?i)\\bparas?\\.?\\s*([0-9]+)", 1)
    bare = F.split_part(link, F.lit("#"), F.lit(1))
    return F.when(pin != "", F.concat(bare, F.lit("#par"), pin)).when(is_ibid, link).otherwise(bare)


def checkable(kind: Column, link: Column, hosts: tuple[str, ...] = ("example.org",)) -> Column:
    """Whether a source can be matched: websites, news and articles only where their host is known."""
    host = F.regexp_extract(link, "^[a-z]+://(?:www\\.)?([^/?#]+)", 1)
    return ~kind.isin("website", "news", "article") | host.isin(*hosts)
