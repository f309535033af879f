"""The training-data pipeline: stages over documents, each written as Parquet and read again.

Every stage but the last returns the columns of the documents it gets; ``n_chars``, if there, follows the
text. A row is dropped only by a decision of its stage:

1. toxicity: documents that the labelled examples call toxic;
2. line dedup: later copies of repeated line runs go from the texts, and a document whose text had words and
   has none left goes;
3. MinHash near-dedup: of each group of near duplicates the text with the least (doc_id, hash) stays, a null doc_id
   after all others; of rows that repeat both doc_id and text, the one whose other columns come first as JSON;
4. benchmark decontamination: documents with an occurrence of a benchmark window go;
5. best-fit packing: the rest in sequences of at most 1024 tokens, a row for each piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm import decontamination, linededup, minhash, packing
from prismlake.llm import toxicity as toxic
from prismlake.llm.session import table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic.reject(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    extra = [c for c in ("n_lines", "removed_lines", "copies") if c in docs.columns]
    renamed = docs.withColumnsRenamed({c: f"__own_{c}" for c in extra})
    rows = linededup.dedup_lines(renamed)
    rows = rows.where((F.size("removed_lines") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size("removed_lines") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.drop("n_lines", "removed_lines", "copies").withColumnsRenamed({f"__own_{c}": c for c in extra}).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    decided = minhash.near_duplicates(docs).groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    decided = written(decided.withColumnsRenamed({c: f"__{c}" for c in decided.columns}))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__text_hash"))
    # a merge join at every size: what a small table would save by broadcasting tells nothing about a large one
    kept = docs.join(decided.where("__n > 1 or not __stays").hint("merge"), same, "left_anti")
    again = decided.where("__n > 1 and __stays")
    if again.isEmpty():
        return kept.select(*docs.columns)
    repeated = docs.join(again, same)
    # of rows that repeat both doc_id and text the one whose other columns come first
    first = repeated.groupBy("__doc_id", "__text_hash").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")))).alias("__row"))
    return kept.unionByName(first.select("__row.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits, _ = decontamination.occurrences(docs, table(spark, sf_dir, "benchmark"))
    hits = hits.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL for the stages: votes, signatures and token ids are beyond it; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
