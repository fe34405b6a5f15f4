"""Sources: the partitioned corpus, Word documents, selections."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.references import id_list
from marginalia.functions.text import squeezed

_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Fixed: headers under which selections name documents and notes.
ID_HEADERS = ("footnote_id", "footnote", "footnotes", "id", "ids")
DOC_HEADERS = ("doc_key", "source_doc_key", "doc", "document", "source_doc")


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Parquet files under root/DATASET/: their columns united by name, dataset (upper case) from the path, and row_id, which names
    the row for good: file and position in it, hashed."""
    df = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(root)
    path = F.col("_metadata.file_path")
    located = df.withColumn("path", path).withColumn("row", F.col("_metadata.row_index"))
    return located.withColumn("dataset", F.upper(F.regexp_extract("path", "([^/]+)/[^/]+$", 1))).withColumn("row_id", F.xxhash64("path", "row"))


def coverage(corpus: DataFrame) -> DataFrame:
    return corpus.select("dataset").distinct()


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, footnote_id) of a CSV with a header in any case and under any of the usual names; ids may be lists and ranges."""
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    by = {c.lstrip("﻿").strip().lower(): c for c in df.columns}
    ids, docs = (next((by[h] for h in headers if h in by), None) for headers in (ID_HEADERS, DOC_HEADERS))
    if ids is None:
        raise ValueError(f"no column of {', '.join(ID_HEADERS)} in {path}")
    key = F.col(f"`{docs}`") if docs else F.lit("")
    return df.select(key.alias("doc_key"), F.explode(id_list(F.col(f"`{ids}`"))).alias("footnote_id")).distinct()


def _note_text(node: ElementTree.Element, mark: bool) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab":
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
        elif mark and x.tag == f"{_W}footnoteReference" and x.get(f"{_W}id"):
            out.append(f"⟦FN:{x.get(f'{_W}id')}⟧")
    return "".join(out)


def _styles(root: ElementTree.Element | None) -> dict[str, tuple[str, int]]:
    """(name, left indent in twentieths of a point) of each paragraph style."""
    out = {}
    for style in root.findall(f"{_W}style") if root is not None else []:
        if style.get(f"{_W}type") == "paragraph":
            name, indent = style.find(f"{_W}name"), style.find(f"{_W}pPr/{_W}ind")
            left = (indent.get(f"{_W}left") or indent.get(f"{_W}start") or "0") if indent is not None else "0"
            out[style.get(f"{_W}styleId")] = (name.get(f"{_W}val") if name is not None else "", int(float(left)))
    return out


def _targets(root: ElementTree.Element | None) -> dict[str, str]:
    """The addresses of a part's relations."""
    return {r.get("Id"): r.get("Target") or "" for r in root} if root is not None else {}


def _links(note: ElementTree.Element, targets: dict[str, str], text: str) -> list[tuple[int, int, str]]:
    """(start, end, url) of the links that the author set in a note: of hyperlinked runs, by where their words stand in its text, and
    of addresses written out."""
    found, at = [], 0
    for link in note.iter(f"{_W}hyperlink"):
        words = re.sub(r"\s+", " ", _note_text(link, False)).strip()
        url = targets.get(link.get(_R), "")
        start = text.find(words, at) if words else -1
        if url and start >= 0:
            at = start + len(words)
            found.append((start, at, url))
    taken = [range(a, b) for a, b, _ in found]
    written = [(m.start(), m.end(), m[0]) for m in re.finditer(r"https?://[^\s<>\"”]+[^\s<>\"”.,;:)\]]", text)]
    return sorted(found + [w for w in written if not any(w[0] in t for t in taken)])


def docx_rows(content: bytes) -> list[tuple]:
    """(part, number, style, text, style_name, indent, links): paragraphs of the body (direct ones; notes marked where they are
    anchored) and notes, those that only separate left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        member = lambda name: ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None
        body, notes, styles, targets = member("word/document.xml"), member("word/footnotes.xml"), _styles(member("word/styles.xml")), _targets(member("word/_rels/footnotes.xml.rels"))
    rows = []
    for i, p in enumerate(body.findall(f"{_W}body/{_W}p") if body is not None else []):
        found = p.find(f"{_W}pPr/{_W}pStyle")
        style = found.get(f"{_W}val") if found is not None else ""
        own = p.find(f"{_W}pPr/{_W}ind")
        name, indent = styles.get(style, ("", 0))
        rows.append(("paragraph", i, style, _note_text(p, True), name, int(float((own.get(f"{_W}left") or own.get(f"{_W}start")) or indent)) if own is not None else indent, []))
    for note in notes.findall(f"{_W}footnote") if notes is not None else []:
        number = int(note.get(f"{_W}id") or 0)
        if number > 0 and note.get(f"{_W}type") is None:
            text = re.sub(r"\s+", " ", " ".join(_note_text(p, False) for p in note.findall(f"{_W}p"))).strip()
            rows.append(("footnote", number, "", text, "", 0, [{"start": a, "end": b, "url": u} for a, b, u in _links(note, targets, text)]))
    return rows


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, part, number, style, text, style_name, indent, links) of the Word files under path, lock files left out; one task a
    few files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path)
    named = files.withColumn("doc_key", F.regexp_extract("path", "([^/]+)\\.docx$", 1)).filter(~F.col("doc_key").startswith("~$"))
    links = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("url", pa.string())]))
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns = list(zip(*docx_rows(content), strict=True)) or [[]] * len(kinds)
                arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(arrays[0]), pa.string()), *arrays], ["doc_key", "part", "number", "style", "text", "style_name", "indent", "links"])

    return named.select("doc_key", "content").mapInArrow(run, "doc_key string, part string, number int, style string, text string, style_name string, indent int, links array<struct<start: int, end: int, url: string>>")


def author_links(rows: DataFrame) -> DataFrame:
    """(doc_key, footnote_id, start, end, url): the links that authors set in notes, of read_docx's rows."""
    return rows.filter("part = 'footnote'").select("doc_key", F.col("number").alias("footnote_id"), F.inline("links"))


def anchors(paragraphs: DataFrame) -> DataFrame:
    """(doc_key, footnote_id, number, position): where notes are anchored, by position in the text without marks."""
    pieces = F.split("text", "⟦FN:\\d+⟧")
    ids = F.regexp_extract_all("text", F.lit("⟦FN:(\\d+)⟧"), F.lit(1))
    found = paragraphs.filter("part = 'paragraph'").select("doc_key", "number", pieces.alias("_p"), F.posexplode(ids).alias("_i", "footnote_id"))
    at = F.aggregate(F.slice("_p", F.lit(1), F.col("_i") + 1), F.lit(0), lambda s, x: s + F.length(x))
    return found.select("doc_key", F.col("footnote_id").cast("int").alias("footnote_id"), "number", at.alias("position"))


def legal_paragraph(xml: Column, number: Column) -> Column:
    """The text of a numbered paragraph of a LegalDocML judgment, found by its eId (para_5): from its element to the next paragraph's, or
    the end of the body, without tags; empty where the judgment has no such paragraph."""
    pattern = F.concat(F.lit('(?s)<[^<>]*\\beId="para_'), number.cast("string"), F.lit('"[^<>]*>.*?(?=<[^<>]*\\beId="para_[0-9]+"|</[A-Za-z:]*[bB]ody>|$)'))
    plain = F.regexp_replace(F.coalesce(F.regexp_substr(xml, pattern), F.lit("")), "<[^>]*>", " ")
    for mark, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(mark), F.lit(c))
    return squeezed(plain)
