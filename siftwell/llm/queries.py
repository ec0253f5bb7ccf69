"""One query for each training-data operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import AUDIT, JACCARD, SUFFIXES


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predict

    docs = _documents(spark, sf_dir)
    model = fit(docs.where(_fold(3) != 1))
    return predict(docs, model).select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pitman_yor import score_documents

    found = score_documents(_documents(spark, sf_dir), _fold(7) != 2)
    return found.select("doc_id", (_fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import round_trip

    return round_trip(_documents(spark, sf_dir))


def op4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .templates import contaminated

    found = contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_tokens", "verbatim")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cws import fingerprints

    return fingerprints(_documents(spark, sf_dir))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_documents(spark, sf_dir))


def op7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spans import remove_spans

    return remove_spans(_documents(spark, sf_dir), passages=True).select("doc_id", "n_sentences", "n_removed", "n_spans", "kept")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    found = remove_repeats(_documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import link

    return link(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op10_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weak_labels import classify

    return classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))[0]


def op11_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .outliers import judge

    return judge(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "cell")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .align import align, count_links, digest
    from .common import written

    found, _ = written(digest(align(_documents(spark, sf_dir))), "aligned")
    return count_links(found).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import audit

    return audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_langid": op1_langid,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_repair": op3_repair,
    "op4_templates": op4_templates,
    "op5_fingerprints": op5_fingerprints,
    "op6_pack": op6_pack,
    "op7_spans": op7_spans,
    "op8_suffixes": op8_suffixes,
    "op9_jaccard": op9_jaccard,
    "op10_weak_labels": op10_weak_labels,
    "op11_outliers": op11_outliers,
    "op12_align": op12_align,
    "op13_audit": op13_audit,
}
ORACLES: dict[str, str] = {"op8_suffixes": SUFFIXES, "op9_jaccard": JACCARD, "op13_audit": AUDIT}
