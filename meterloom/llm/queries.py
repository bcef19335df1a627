"""The registered queries of this package: each applies an operator to its whole table and derives digest columns."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, check_sql, collocations, contamination, disclosure, jaccard, licences, line_frequency, line_runs, periods, substring, token_frames, warc_index, wordpiece


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = line_frequency.judged(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *line_frequency.STATS, "base_failed", "kept", "removed_words")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = disclosure.digest(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_term")


def op4_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), longest=None)


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op7_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_frames.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.without_repeats(_table(spark, sf_dir, "documents"), width=50)
    return out.select("doc_id", "n_words", "n_removed", F.coalesce("words_sha256", F.sha2("kept_text", 256)).alias("kept_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks).drop("text")
    out = bpe.decode(coded, ranks)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(_table(spark, sf_dir, "documents"), longest=3, least=10, inside_percent=50, top=2000)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.without_frequent(_table(spark, sf_dir, "documents"), least=40, holders=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periods.runs(periods.planted(_table(spark, sf_dir, "documents")), least=6, times=4)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    text = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(text, F.lit("\n"))).otherwise("")
    out = out.withColumn("best", best)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"), F.col("best.period").alias("period"),
                      F.floor(-F.col("best.n") * 1000 / F.col("best.period")).alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"),
                      F.when(F.size("runs") > 0, F.sha2("collapsed", 256)).otherwise(F.col("words_sha256")).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_frequency, op2_decontamination, op3_disclosure, op4_wordpiece_counts, op5_licence_scan, op6_ngram_jaccard_join,
                            op7_token_frames, op8_warc_index, op9_substring_dedup, op10_byte_bpe, op11_collocations, op12_line_dedup, op13_periodic_runs)
}
SQL: dict[str, str] = {"op11_collocations": check_sql.COLLOCATIONS, "op12_line_dedup": check_sql.FREQUENT_LINES}
