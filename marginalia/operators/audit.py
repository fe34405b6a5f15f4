"""One row a citation part of Word documents, with what it refers to and the sentence that it supports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import chains, sequences, splitting, structure
from marginalia.sources.readers import anchors
from marginalia.sources.shared import materialize


def audit_rows(rows: DataFrame) -> DataFrame:
    """Of read_docx's rows: doc_id, footnote_id, display (the note's number as printed; asterisks for starred notes), part_index, the part's
    text and fields, ref_kind, target, origin, path and note of its chain, and proposition, the sentence that the note is anchored in.

    Supra references name printed numbers, which are turned into the notes' own before targets are looked for; a printed number
    that no note has stays as it is and gives no target. Notes without an anchor have no proposition."""
    notes = rows.filter("part = 'footnote'").select(F.col("doc_key").alias("doc_id"), F.col("number").alias("footnote_id"), "text")
    star = F.regexp_extract("text", "^\\s*(\\*+)", 1)
    numbered = materialize(sequences.display_numbers(notes, "doc_id", ["footnote_id"], star != ""), "notes")
    split = splitting.split_notes(numbered.select("doc_id", "footnote_id", "text"))
    printed = numbered.filter("number is not null").select("doc_id", F.col("number").cast("int").alias("supra_note"), F.col("footnote_id").alias("_own"))
    own = split.join(printed, ["doc_id", "supra_note"], "left").withColumn("supra_note", F.coalesce("_own", -F.col("supra_note"))).drop("_own")
    aimed = materialize(splitting.targets(own), "targets")
    kind = F.when(F.col("supra_note").isNotNull(), "SUPRA").when(F.col("is_ibid"), "IBID").otherwise("")
    label = F.when(F.col("supra_note").isNotNull(), F.concat(F.lit("SUPRA→"), F.regexp_replace("target", "^.*/([^/]+)/([^/]+)$", "$1:$2"))).when(F.col("is_ibid"), "IBID")
    traced = chains.chain_paths(chains.resolve_chains(aimed.withColumn("ref_kind", kind).withColumn("label", label)), "label")
    shown = numbered.select("doc_id", "footnote_id", F.coalesce(F.col("number").cast("string"), star).alias("display"))
    body = rows.filter("part = 'paragraph'")
    said = structure.propositions(body, anchors(body)).groupBy(F.col("doc_key").alias("doc_id"), "footnote_id").agg(F.min_by("proposition", F.struct("number", "position")).alias("proposition"))
    out = chains.chain_notes(traced).join(shown, ["doc_id", "footnote_id"]).join(said, ["doc_id", "footnote_id"], "left")
    return out.select("doc_id", "footnote_id", "display", "part_index", "verbatim", "kind", "link", "fragments", "pages", "bare_citation", "short_form", "ref_kind", "target", "origin", "hops", "path", "note", "warning", "proposition")
