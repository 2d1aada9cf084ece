"""Reading texts and tables from files, and writing what comes of them."""

from __future__ import annotations

import csv
import io
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.local import small
from tidemark.operators import evaluate
from tidemark.operators.detect import CELL
from tidemark.operators.store import saved
from tidemark.operators.tables import cells, scrub_rows
from tidemark.plans.rules import Rule, root

SUFFIXES = (".txt", ".md", ".json", ".csv")


def expand(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files of the known suffixes, folders searched to the bottom, sorted within each path; works on any file system that Spark does."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out: list[str] = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            raise FileNotFoundError(p)
        found = []
        if fs.getFileStatus(path).isDirectory():
            it = fs.listFiles(path, True)
            while it.hasNext():
                found.append(it.next().getPath().toString())
        else:
            found.append(path.toString())
        out += sorted(f for f in found if f.lower().endswith(SUFFIXES))
    return out


def read_texts(spark: SparkSession, files: list[str]) -> DataFrame:
    """A document for each file, as (source_id, row, col, text); bytes that aren't UTF-8 are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([x.decode("utf-8", "ignore") for x in b.column("content").to_pylist()], pa.string())], names=["source_id", "text"])

    d = spark.read.format("binaryFile").load(files).select("path", "content").mapInArrow(run, "source_id string, text string")
    return d.select("source_id", F.lit(None).cast("long").alias("row"), F.lit(None).cast("string").alias("col"), "text")


def read_csv(spark: SparkSession, file: str, max_rows: int | None = None) -> DataFrame:
    """All columns as strings, with the row number in ``_row``, counted from 0 in the file's order; max_rows is for previews."""
    d = spark.read.csv(file, header=True, inferSchema=False, multiLine=True, escape='"')
    return _numbered(d, max_rows)


def read_json(spark: SparkSession, file: str, max_rows: int | None = None) -> DataFrame:
    """An object is one record, an array its objects; all values are strings, nested ones JSON."""
    d = spark.read.json(file, multiLine=True, primitivesAsString=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    d = d.where("_bad is null").drop("_bad") if "_bad" in d.columns and len(d.columns) > 1 else d
    return _numbered(d.select(*[F.to_json(f"`{f.name}`").alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f"`{f.name}`") for f in d.schema]), max_rows)


def _numbered(d: DataFrame, max_rows: int | None) -> DataFrame:
    # a file with quoted line ends is read as one partition, so ids there are dense and in order
    d = d.withColumn("_row", F.monotonically_increasing_id())
    return d.orderBy("_row").limit(max_rows) if max_rows else d


def _records(name: str, body: str) -> Iterator[dict]:
    """The rows of a table's file as mappings of column to string."""
    if name.lower().endswith(".csv"):
        yield from csv.DictReader(io.StringIO(body, newline=""))
        return
    try:
        data = json.loads(body)
        exact = json.loads(body, parse_int=str, parse_float=str)  # numbers as they are written
    except ValueError:
        return
    pairs = zip(data, exact) if isinstance(data, list) else [(data, exact)]
    for row, written in pairs:
        if isinstance(row, dict):
            yield {k: None if v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":")) if isinstance(v, (dict, list)) else str(v).lower() if isinstance(v, bool) else written[k] for k, v in row.items()}


def read_tables(spark: SparkSession, files: list[str], max_rows: int | None = None) -> DataFrame:
    """(source_id, row, col, text) of all cells of many CSV and JSON files in one read, a task for some files each; for files that fit in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                out = []
                for i, row in enumerate(_records(name, content.decode("utf-8-sig", "ignore"))):
                    if max_rows is not None and i >= max_rows:
                        break
                    out += [(name, i, k, v.strip()) for k, v in row.items() if isinstance(k, str) and isinstance(v, str) and v.strip()]
                cols = list(zip(*out)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["source_id", "row", "col", "text"])

    d = spark.read.format("binaryFile").load(files).select("path", "content")
    return d.mapInArrow(run, "source_id string, row long, col string, text string")


#: a table's file of more bytes than this is read by itself, as a stream
LARGE = 256 << 20


def read_all(spark: SparkSession, paths: list[str], max_rows: int | None = None) -> DataFrame:
    """Documents and cells of all files in one table."""
    files = expand(spark, paths)
    plain = [f for f in files if f.lower().endswith((".txt", ".md"))]
    parts = [read_texts(spark, plain)] if plain else []
    tables = [f for f in files if f.lower().endswith((".csv", ".json"))]
    large = {r["path"] for r in spark.read.format("binaryFile").load(tables).where(F.col("length") > LARGE).select("path").collect()} if tables else set()
    if small := [f for f in tables if f not in large]:
        parts.append(read_tables(spark, small, max_rows))
    for f in sorted(large):
        d = read_csv(spark, f, max_rows) if f.lower().endswith(".csv") else read_json(spark, f, max_rows)
        parts.append(cells(d, f, "_row"))
    if not parts:
        return small(spark, [], "source_id string, row long, col string, text string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stamped(findings: DataFrame) -> DataFrame:
    """Findings with their source's short name as ``source_label``."""
    return findings.withColumn("source_label", label_of(F.col("source_id")))


def label_of(source_id: Column) -> Column:
    """A source's short name."""
    return F.element_at(F.split(source_id, "/"), -1)


def content_id(text: Column) -> Column:
    """An id for a text that has none."""
    return F.concat(F.lit("doc-"), F.substring(F.sha2(text, 256), 1, 12))


def read_gold(spark: SparkSession, files: list[str], texts: DataFrame, rules: tuple[Rule, ...], strict: bool = True) -> DataFrame:
    """(doc, start, end, text, entity_id) of JSONL files of true spans, their first line a header.

    doc is the file's name up to its first dot and must be a source_id of ``texts``.  With ``strict``, spans that
    don't match their text or name no known entity are an error; without it they are left out.  Entities are rolled
    up along is_a.
    """
    d = spark.read.text(files).select(F.split_part(F.element_at(F.split(F.input_file_name(), "/"), -1), F.lit("."), F.lit(1)).alias("doc"), F.from_json("value", "start int, end int, text string, entity_id string").alias("g")).where("g.start is not null").select("doc", "g.*")
    roots = small(spark, [(r.entity_id, root(r.entity_id, rules)) for r in rules], "entity_id string, root_id string")
    d = d.join(F.broadcast(roots), "entity_id", "left").join(texts.select(F.col("source_id").alias("doc"), F.col("text").alias("_text")), "doc", "left")
    good = F.col("root_id").isNotNull() & F.coalesce(F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text"), F.lit(False))
    if strict:
        d = d.withColumn("text", F.when(good, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("bad true span in "), F.col("doc"))).cast("string")))
    else:
        d = d.where(good)
    return d.select("doc", "start", "end", "text", F.coalesce("root_id", "entity_id").alias("entity_id"))


def discover_gold(spark: SparkSession, folder: str) -> list[str]:
    """The files of true spans in ``folder``, or in the set in it that a file ACTIVE names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    if fs.exists(path(folder + "/ACTIVE")):
        folder += "/" + spark.read.text(folder + "/ACTIVE").first()["value"].strip()
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(path(folder)) if s.getPath().getName().endswith(".gold.jsonl"))


def write_evaluation(gold: DataFrame, pred: DataFrame, texts: DataFrame, path: str) -> None:
    """An evaluation as folders of JSON lines: scores by entity and on the whole, both ways to match, confusions, errors, and what found what."""
    for name, exact in (("overlap", False), ("strict", True)):
        m = saved(evaluate.matches(gold, pred, exact))
        write_json(evaluate.prf(evaluate.counted(m, "entity_id")), f"{path}/{name}/entities")
        write_json(evaluate.micro_macro(evaluate.counted(m, "entity_id")), f"{path}/{name}/averages")
        write_json(evaluate.counted(m, "doc"), f"{path}/{name}/documents")
        write_json(evaluate.errors(m, texts), f"{path}/{name}/errors")
        write_json(evaluate.by_winner(m), f"{path}/{name}/winners")
        write_json(evaluate.rescues(m), f"{path}/{name}/rescues")
    write_json(evaluate.confusion(gold, pred), f"{path}/confusion")


def write_scrubbed(texts: DataFrame, path: str, form: str = "parquet") -> None:
    """Scrubbed texts, in one folder that no task needs to know the others of."""
    d = texts.select(*CELL, "text")
    d.write.mode("errorifexists").format(form).save(path)


def write_sources(texts: DataFrame, path: str) -> None:
    """Scrubbed documents as text files, a folder for each source, source=<short name>; equal short names share one."""
    d = texts.where("col is null").select(F.col("text").alias("value"), label_of(F.col("source_id")).alias("source"))
    d.write.mode("errorifexists").partitionBy("source").text(path)


def write_table(spark: SparkSession, df: DataFrame, plan: DataFrame, row: str, source_id: str, path: str, form: str = "csv") -> None:
    """A table with its planned cells spliced, as CSV with a header or as JSON lines, without the row number."""
    d = scrub_rows(df, plan, row, source_id).drop(row)
    d.write.mode("errorifexists").option("header", True).format(form).save(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(spark: SparkSession, report: dict, markdown: str, path: str) -> list[str]:
    """path.json and path.md, each naming the other; a report is small by nature."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for suffix, body in ((".json", json.dumps(report | {"markdown": os.path.basename(path) + ".md"}, indent=1, ensure_ascii=False, default=str)), (".md", markdown + f"\nThe same as data: {os.path.basename(path)}.json\n")):
        p = fs_path(path + suffix)
        s = p.getFileSystem(conf).create(p, True)
        s.write(bytearray(body.encode()))
        s.close()
        out.append(path + suffix)
    return out
