"""The same scan on a stream: detection needs no state, corpus figures are kept by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import text as T
from tidemark.operators.detect import documents, scan
from tidemark.plans.rules import Rule


def findings(stream: DataFrame, rules: tuple[Rule, ...], text: str = "text", source_id: str = "doc_id") -> DataFrame:
    """Spans of a stream of texts; all narrow, so any output mode works and no state is held."""
    return scan(documents(stream, text, source_id), rules)


def rates(stream: DataFrame, rules: tuple[Rule, ...], ts: str, text: str, source_id: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, entity_id, n) in tumbling windows of event time; events later than ``late`` are dropped."""
    d = stream.withWatermark(ts, late).select(F.col(ts).alias("_ts"), F.col(source_id).cast("string").alias("source_id"), F.col(text).cast("string").alias("text"))
    d = d.select("_ts", F.explode(F.concat(*[F.array_repeat(F.lit(r.entity_id), F.size(_found(F.col("text"), r))) for r in rules if r.patterns])).alias("entity_id"))
    return d.groupBy(F.window("_ts", window).alias("w"), "entity_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "entity_id", "n")


def _found(text: Column, r: Rule) -> Column:
    all_ = F.array_distinct(F.concat(*[T.find_all(text, p) for p in r.native]))
    return F.coalesce(F.when(text.rlike("(?U)" + r.anchor), all_) if r.anchor else all_, F.array().cast(f"array<{T.SPAN}>"))


def each_batch(stream: DataFrame, rules: tuple[Rule, ...], sink: Callable[[DataFrame, int], None], checkpoint: str, **columns: str) -> StreamingQuery:
    """Runs ``sink`` on the findings of every micro-batch, for what needs more than one row: elections, records, rollups."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda d, i: sink(findings(d, rules, **columns), i)).trigger(availableNow=True).start()
