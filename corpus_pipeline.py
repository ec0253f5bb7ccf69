"""The training-data pipeline: language, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents, whatever these are besides doc_id,
text and n_chars. No stage can be told in SQL as a whole, so ORACLE_SQL is None and tests hold the pipeline
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import discard, keyed, shared_dir
from siftwell.llm.jaccard import link
from siftwell.llm.langid import UNKNOWN, fit, predict
from siftwell.llm.packing import pack
from siftwell.llm.suffixes import remove_repeats
from siftwell.llm.templates import contaminated


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a language is told, with it as their `lang`.

    Rejected: null texts, texts without a letter, and noise: texts that even the nearest language codes in 64
    bits more than plain bytes would take, so that odds of 2 ** 64 are against it (a short text of unknown words
    has no such odds and stays). Equal texts share their fate; no labelled text at all rejects everything.
    """
    found = predict(docs, fit(docs), carry=True)
    over = (F.col("bits_per_byte") - 8) * F.octet_length(f"c{docs.columns.index('text')}")
    found = found.where((F.col("lang_pred") != UNKNOWN) & (over < 64))
    return found.select(*[F.col("lang_pred" if x == "lang" else f"c{i}").alias(x) for i, x in enumerate(docs.columns)])


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id (then text) of each component of similar documents.

    Null ids come first; of repeated rows one stays. A text without a word is similar to none and stays.
    """
    rows = keyed(docs, carry=True)
    found = link(rows.select("ord", "text"), id_col="ord")
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("ord")
    return rows.join(kept, "ord").select("row.*")


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what earlier documents have said; documents of which nothing remains go.

    Earlier is by doc_id (nulls first), then by text; of repeated rows the first keeps its text. A character
    that is cut in its middle goes as a whole. A null or empty text stays as it is.
    """
    rows = keyed(docs, carry=True)
    found = remove_repeats(rows.select("ord", "text"), id_col="ord", decode=True).select("ord", "n_removed", "kept")
    cleaned = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    joined = rows.select("ord", "row").join(found, "ord").withColumn("_text", cleaned).where((F.col("n_removed") == 0) | (F.col("_text") != ""))
    columns = [{"text": F.col("_text"), "n_chars": F.length("_text").cast(dict(docs.dtypes).get("n_chars", "long"))}.get(x, F.col("row")[x]).alias(x) for x in docs.columns]
    return joined.select(*columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and empty texts have none, repeated rows share their fate."""
    rows = keyed(docs, carry=True)
    found = contaminated(rows.select("ord", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="ord")
    return rows.join(found.select("ord").distinct(), "ord", "left_anti").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' token pieces, each with its place in a sequence; a null text has its end id only."""
    return pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", keep_one_of_similar),
    ("suffix_array", remove_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over `documents`, each written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_dir(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                discard(spark, before)
            before = path
    return docs
