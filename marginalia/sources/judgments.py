"""Judgments in LegalDocML and feeds of judgments in Atom, parsed as XML: numbered paragraphs, and the address that a citation has."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_ATOM = "{http://www.w3.org/2005/Atom}"  # fixed: the namespace of feeds
_PARAGRAPH = StructType([StructField("eid", StringType()), StructField("text", StringType())])
_ENTRY = StructType([StructField("kind", StringType()), StructField("citation", StringType()), StructField("url", StringType())])


def _parsed(xml: str | None) -> ET.Element | None:
    """The root of a document; None where there is none, or it is no XML."""
    try:
        return ET.fromstring(xml.encode()) if xml and xml.strip() else None
    except ET.ParseError:
        return None


def _name(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1] if isinstance(element.tag, str) else ""


def _said(element: ET.Element) -> str:
    """The text of a paragraph with all that is nested in it, but for its own number."""
    said = [element.text or ""]
    for child in element:
        said += [] if _name(child) == "num" else child.itertext()
        said.append(child.tail or "")
    return " ".join("".join(said).split())


def paragraphs_of(xml: str | None) -> list[tuple[str, str]]:
    """(eId, text) of the paragraphs of a judgment, whatever the namespace; an eId that stands twice is ambiguous and left out."""
    root = _parsed(xml)
    found = [(e.get("eId"), e) for e in root.iter() if _name(e) == "paragraph" and e.get("eId")] if root is not None else []
    names = [eid for eid, _ in found]
    return [(eid, _said(e)) for eid, e in found if names.count(eid) == 1]


def entries_of(xml: str | None) -> list[tuple[str, str, str]]:
    """(kind, citation, url) of the identifiers of a feed's entries; the address is the first alternate link to a page."""
    root = _parsed(xml)
    out = []
    for entry in root.iter(f"{_ATOM}entry") if root is not None else ():
        pages = [x.get("href", "") for x in entry.findall(f"{_ATOM}link") if x.get("rel") == "alternate" and x.get("type") in (None, "text/html")]
        out += [(e.get("type") or "", " ".join("".join(e.itertext()).split()), pages[0]) for e in entry if _name(e) == "identifier" and pages]
    return out


def _structs(rows: list[list[tuple]], names: list[str]) -> pa.Array:
    return pa.array([[dict(zip(names, x, strict=True)) for x in r] for r in rows], pa.list_(pa.struct([(n, pa.string()) for n in names])))


@F.arrow_udf(ArrayType(_PARAGRAPH))
def xml_paragraphs(xml: pa.Array) -> pa.Array:
    """paragraphs_of each document; none of null and of what is no XML."""
    return _structs([paragraphs_of(x) for x in xml.to_pylist()], _PARAGRAPH.fieldNames())


@F.arrow_udf(ArrayType(_ENTRY))
def feed_entries(xml: pa.Array) -> pa.Array:
    """entries_of each feed; none of null and of what is no XML."""
    return _structs([entries_of(x) for x in xml.to_pylist()], _ENTRY.fieldNames())


def judgment_paragraphs(judgments: DataFrame) -> DataFrame:
    """(doc_id, eid, number, text): the paragraphs of judgments (doc_id, xml), with paragraphs nested in them as text; number is that in an eId
    as para_5, else null. A judgment is parsed once for all that is asked of it."""
    each = judgments.select("doc_id", F.inline(xml_paragraphs(F.col("xml"))))
    return each.select("doc_id", "eid", F.nullif(F.regexp_extract("eid", "^para_([0-9]{1,9})$", 1), F.lit("")).cast("int").alias("number"), "text")


def _same(citation: Column) -> Column:
    """A citation as identifiers are compared: without marks, white space and case."""
    return F.lower(F.regexp_replace(citation, "[\\s\\[\\]().]+", ""))


def judgment_addresses(asked: DataFrame, feeds: DataFrame, host: str, kind: str = "ukncn") -> DataFrame:
    """asked (id, citation, number: a paragraph's or null) with url, the address that feeds (feed) give for the citation, with the paragraph's
    fragment: if entries of this kind of identifier lead to one page of the host, by https; null where they lead to none or several."""
    each = feeds.select(F.inline(feed_entries(F.col("feed")))).filter((F.col("kind") == kind) & F.col("url").rlike(f"(?i)^https://{re.escape(host)}(?:[/?#]|$)"))
    one = each.groupBy(_same(F.col("citation")).alias("_c")).agg(F.min("url").alias("_a"), F.max("url").alias("_z")).filter("_a = _z")
    fragment = F.when(F.col("number").isNotNull(), F.concat(F.lit("#para_"), F.col("number").cast("string"))).otherwise("")
    joined = asked.withColumn("_c", _same(F.col("citation"))).join(one, "_c", "left")
    return joined.withColumn("url", F.concat("_a", fragment)).drop("_c", "_a", "_z")
