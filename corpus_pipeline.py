"""A corpus from documents in five stages, each written as Parquet and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, decontaminate, minhash, secrets, toxicity

ORACLE_SQL: str | None = None  # trained scores, signatures and token merges are beyond SQL


def _print(text: Column) -> Column:
    """What tells texts apart; null for null."""
    return F.sha2(text.cast("binary"), 256)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Null and empty texts are scored as empty ones, repeated rows alike; columns named
    score or predicted are kept as they are; without labels, or without documents, nothing is learned and none goes that has no ground to."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    named, back = common.renamed(docs, toxicity.RESULT.fieldNames())
    return back(toxicity.score_texts(named, model).where("predicted = 0"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least doc_id stays, once; null is the greatest doc_id, and of equal ones the text of
    least SHA-256 stays.

    A document is a doc_id with a text: rows that repeat both are one document, and rows that share a doc_id, or have none, but differ in
    text are documents of their own, which go only if they are near copies. Null and empty texts are near copies of nothing. Other columns are
    kept whatever their names; an empty table gives none."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", _print(docs["text"]).alias("print"))
    kept = minhash.near_documents(docs.select(key.alias("doc_id"), "text")).where("kept").select("doc_id.*").distinct()
    same = docs["doc_id"].eqNullSafe(kept["doc_id"]) & _print(docs["text"]).eqNullSafe(kept["print"])
    left = docs.join(kept, same, "left_semi")
    named = left.toDF(*(f"column {i}" for i in range(len(docs.columns))))
    id_, text = (named[f"`column {docs.columns.index(c)}`"] for c in ("doc_id", "text"))
    once = named.withColumns({"id of": id_, "print of": _print(text)}).dropDuplicates(["id of", "print of"])
    return once.drop("id of", "print of").toDF(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, by doc_id and text. Null and empty texts stay, and so do all documents where the
    benchmark is empty; other columns are kept whatever their names; an empty table gives none."""
    hit = decontaminate.decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    same = docs["doc_id"].eqNullSafe(hit["doc_id"]) & (F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")) == hit["fingerprint"])
    return docs.join(hit, same, "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become [SECRET]; every document stays, repeated rows too, and its n_chars, if there is one, tells its new length. A null text
    stays null; columns with names of the scan's results are kept as they are."""
    named, back = common.renamed(docs, [*secrets.RESULT.fieldNames(), "n_chars"])
    found = back(secrets.scan_secrets(named).withColumn("text", F.col("redacted")))
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the text's byte-level BPE ids with their number, and whether they decode to the text again. Every row gives
    one row; null and empty texts have no ids; other columns go, whatever their names."""
    coded = bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"))
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", as_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are stored in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
