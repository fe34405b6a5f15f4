"""Sinks: reports, manifests, versioned snapshots."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import clean_cell
from marginalia.operators.sequences import suppress_repeats

#: Fixed: the columns of the manifest of quotations, in order.
MANIFEST = (
    "doc_key", "doc_name", "doc_path", "footnote_id", "include_reason", "source_footnotes", "supra_source_footnotes", "ibid_source_footnotes", "quote_count", "quotes_json", "proposition_text",
    "footnote_text")


def report(rows: DataFrame, by: str, order: list[str], repeated: list[str]) -> DataFrame:
    """rows for reading: control characters gone, and columns that repeat the row before left empty."""
    out = rows.select([clean_cell(F.col(c)).alias(c) if t == "string" and c != by else F.col(c) for c, t in rows.dtypes])
    for column in repeated:
        out = suppress_repeats(out, by, order, column)
    return out


def quote_manifest(quotes: DataFrame, targets: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """One row a note (doc_key, footnote_id) with quotations, or that others point to. quotes: (doc_key, footnote_id, and quote where it is
    known); targets: (doc_key, footnote_id, reason: supra_target or ibid_target, and source_footnote); notes: the note's other columns.
    Without notes the short form: quote_count and include_reason, the reasons joined in their order; with notes all of MANIFEST,
    as text, the notes that point to it by kind, and the quotations as JSON. A group is one note's."""
    quoted = quotes if "quote" in quotes.columns else quotes.withColumn("quote", F.lit(None).cast("string"))
    pointed = targets if "source_footnote" in targets.columns else targets.withColumn("source_footnote", F.lit(None).cast("int"))
    both = quoted.select("doc_key", "footnote_id", F.lit("quote").alias("reason"), "quote", F.lit(None).cast("int").alias("source_footnote")).unionByName(
        pointed.select("doc_key", "footnote_id", "reason", F.lit(None).cast("string").alias("quote"), F.col("source_footnote").cast("int")))
    sources = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("reason").isin(*kind), F.col("source_footnote")))), lambda n: n.cast("string")), ",")
    grouped = both.groupBy("doc_key", "footnote_id").agg(
        F.count_if(F.col("reason") == "quote").alias("quote_count"), F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("include_reason"), F.to_json(F.array_sort(F.collect_list("quote"))).alias("quotes_json"),
        sources(("supra_target", "ibid_target")).alias("source_footnotes"), sources(("supra_target",)).alias("supra_source_footnotes"), sources(("ibid_target",)).alias("ibid_source_footnotes"))
    if notes is None:
        return grouped.select("doc_key", "footnote_id", "quote_count", "include_reason")
    named = grouped.join(notes.select("doc_key", "footnote_id", *[c for c in MANIFEST if c in notes.columns and c not in grouped.columns]), ["doc_key", "footnote_id"], "left")
    return named.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in named.columns else F.lit("").alias(c) for c in MANIFEST])


def projected(rows: DataFrame, detail: str, shown: list[str]) -> DataFrame:
    """The columns of an export: display, display-json (all of it as one JSON column), or diagnostic (internal ones, which begin with
    an underscore, behind the shown ones)."""
    if detail == "display":
        return rows.select(*shown)
    if detail == "display-json":
        return rows.select(F.to_json(F.struct(*shown)).alias("row"))
    if detail == "diagnostic":
        return rows.select(*shown, *[c for c in rows.columns if c.startswith("_")])
    raise ValueError(f"no export detail {detail!r}")


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV files with a header under path. With bom each file begins with the UTF-8 mark by which spreadsheets know the encoding."""
    names = list(df.columns)
    if bom:
        df = df.withColumnRenamed(names[0], "\ufeff" + names[0])
    df.write.option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_sidecar(rows: DataFrame, path: str, file: str, exported_at: str, schema: str = "marginalia_diagnostics_v1", signed: tuple[str, ...] = ()) -> DataFrame:
    """Write what a report was made of beside it: the rows as JSON lines under path/rows, and one line under path/about with schema, file,
    signature, time and number of rows. The signature follows from the signed columns (all by default), whatever the order of the rows."""
    names = list(signed or rows.columns)
    marks = rows.select(F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in names]).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.pmod("h", F.lit(1 << 31))), F.lit(0)).alias("a"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("b"))
    signature = F.substring(F.sha2(F.concat_ws("|", F.lit(",".join(names)), F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256), 1, 20)
    about = marks.select(F.lit(schema).alias("schema"), F.lit(file).alias("file"), signature.alias("signature"), F.lit(exported_at).alias("exported_at"), F.col("n").alias("rows"))
    write_json(rows, f"{path}/rows")
    about.coalesce(1).write.json(f"{path}/about")
    return rows.sparkSession.read.json(f"{path}/about")


def log_timings(spark: SparkSession, path: str, events: list[tuple[str, float]]) -> None:
    """Append (event, seconds) lines to a JSON log under path; a run appends files of its own."""
    spark.createDataFrame(events, "event string, seconds double").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(path)


def install(df: DataFrame, root: str, revision: str) -> str:
    """Write a snapshot under its revision and then point to it: every install adds a numbered pointer, and none is ever overwritten,
    so a reader meets the old snapshot or the new one and never half of one. A revision that is there already, whole, is kept.
    Two writers never take one number: a pointer is a file that is created only if it is not there, and who comes late tries the next."""
    spark = df.sparkSession
    path = f"{root}/{revision}"
    df.write.mode("overwrite" if not _exists(spark, f"{path}/_SUCCESS") else "ignore").parquet(path)
    number = (_pointers(spark, root).agg(F.max("number")).first()[0] or 0) + 1
    while not _created(spark, f"{root}/pointers/{number:012d}.json", json.dumps({"number": number, "revision": revision, "path": path}) + "\n"):
        number += 1
    return path


def _created(spark: SparkSession, path: str, content: str) -> bool:
    """Create a small file if none of its name is there; whether that was so. Hadoop's local file system looks first and creates then, which two
    writers can do at once, so local files are created by the operating system, which does both in one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place.getParent())
    if files.getUri().getScheme() == "file":
        try:
            with open(place.toUri().getPath(), "x") as out:
                out.write(content)
        except FileExistsError:
            return False
        return True
    try:
        out = files.create(place, False)
    except Py4JJavaError:
        if files.exists(place):
            return False
        raise
    out.write(bytearray(content.encode()))
    out.close()
    return True


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    schema = "number long, revision string, path string"
    return spark.read.schema(schema).json(f"{root}/pointers") if _exists(spark, f"{root}/pointers") else spark.createDataFrame([], schema)


def installed(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot that was installed last."""
    path = _pointers(spark, root).orderBy(F.col("number").desc(), "path").first()["path"]
    return spark.read.parquet(path)
