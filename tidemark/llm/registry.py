"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, decontam, line_dedup, neighbours, quality, secrets, sharding, simhash, suffix_array, suffix_tree
from .common import table

#: a search asks for the rows whose id is divisible by this, among all rows
QUERIES_ARE = 100


def op1_secret_scan(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rk")


def op3_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), queries=QUERIES_ARE)


def op4_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark, sf_dir):
    return suffix_array.repeated_spans(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))).drop("rk")


def op7_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("rk", "copies")


def op8_sharding(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"))


def op9_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    return suffix_tree.repeated_spans(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_decontamination, op3_nearest_neighbours, op4_line_dedup, op5_suffix_array_dedup, op6_quality_classifier, op7_simhash_near_dedup, op8_sharding, op9_bpe, op10_substring_dedup)}
ORACLES = {"op3_nearest_neighbours": neighbours.sql(queries=QUERIES_ARE), "op4_line_dedup": line_dedup.SQL, "op5_suffix_array_dedup": suffix_tree.spans_sql(), "op10_substring_dedup": suffix_tree.spans_sql()}
