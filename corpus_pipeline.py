"""A corpus pipeline: quality rules, near-duplicates, substring deduplication, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes every stage's result to the shared folder and
reads it again as the next one's documents. All stages but the last return the columns of documents; where a stage
changes a text, n_chars follows it. The last returns the packed pieces.

Rows with a null or repeated doc_id are documents of their own wherever their texts differ; null texts go with the
quality rules; extra columns are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import lines, packing, quality, secrets, simhash
from gridloom.llm.common import materialise, table
from gridloom.llm.queries import WORD_BPE

#: Near-duplicates: sets of shingles of five words, linked at an exact Jaccard similarity of 0.8. Candidates are texts
#: within 80 of 256 bits: sets of similarity 0.8 differ in about 39 bits (standard deviation 6; sets of 4 and 5 shingles
#: in 48), unrelated ones in 128 (8).
SHINGLE, LANES, RADIUS, SIMILARITY = 5, 4, 80, 0.8


def sized(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, as the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without lines that are frequent in their source."""
    return sized(quality.clean_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest doc_id and text hash, null doc_ids last.

    Rows with one doc_id but different texts are different documents; of rows equal in both, one.
    """
    names = docs.columns
    free = "_kept" + "_" * max(map(len, names))  # longer than every name of docs
    prints, labelled = simhash.similar_groups(docs.select("doc_id", "text"), SHINGLE, RADIUS, LANES, SIMILARITY)
    least = labelled.groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.doc")
    rows = prints.groupBy("doc_id", "doc").agg(F.count("*").alias("rows"))
    first = least.join(rows, least["doc_id"].eqNullSafe(rows["doc_id"]) & (least["doc"] == rows["doc"]))
    first = materialise(first.select(F.struct(least["doc_id"], least["doc"], "rows").alias(free)), "first")
    # a shuffle join at every size: what stays grows with the documents
    same = docs["doc_id"].eqNullSafe(F.col(free)["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == F.col(free)["doc"])
    kept = docs.join(first.hint("merge"), same)
    if first.where(F.col(free)["rows"] > 1).limit(1).count():  # equal rows leave one
        order = Window.partitionBy("doc_id", F.col(free)["doc"]).orderBy(*[F.col(f"`{c}`") for c in names if c != "doc_id" and _sortable(docs, c)])
        several = kept.where(F.col(free)["rows"] > 1).withColumn(f"{free}n", F.row_number().over(order)).where(F.col(f"{free}n") == 1).drop(f"{free}n")
        kept = kept.where(F.col(free)["rows"] == 1).unionByName(several)
    return kept.select(*[F.col(f"`{c}`") for c in names])


def _sortable(docs: DataFrame, name: str) -> bool:
    return not docs.schema[name].dataType.simpleString().startswith(("map", "variant"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without lines and sentences that an earlier one holds."""
    return sized(lines.dedup_lines(docs, spans=None))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark."""
    return sized(secrets.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document with their sequence and offset."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express compression novelty or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialise(docs, "stage")
    return docs
