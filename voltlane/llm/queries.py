"""One query per operator, with production parameters, over its whole table; digests are derived here.

Where SQL can say the same, ``sql`` has it; word windows, components and learned scores are compared with brute force in
``tests/llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .chat import format_chats
from .decontaminate import contamination
from .fill_middle import fill_in_middle, restored
from .html_extract import extract
from .language import LanguageModels
from .lines import drop_lines, line_dedup
from .near_duplicates import near_duplicates
from .packing import pack
from .phrases import collocations
from .quality import quality_rules
from .sharding import shard_rows
from .sql import SQL as SQL  # noqa: PLC0414
from .substrings import substring_dedup
from .toxicity import ToxicityModel, learning_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minhash_near_dedup(spark, d):
    return near_duplicates(tx.read(spark, d, "documents"))


@query
def op2_substring_dedup(spark, d):
    kept = F.btrim(F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", " "))
    return substring_dedup(tx.read(spark, d, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"))


@query
def op3_benchmark_decontamination(spark, d):
    found = contamination(tx.read(spark, d, "documents"), tx.read(spark, d, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query
def op4_toxicity(spark, d):
    docs = tx.read(spark, d, "documents")
    model = ToxicityModel(learning_rows(docs, tx.read(spark, d, "labels")), docs=docs)
    held_out = F.coalesce(tx.fold_of("doc_id", 4) == 2, F.lit(False))
    return model.score(docs).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


@query
def op5_html_extraction(spark, d):
    return extract(tx.read(spark, d, "pages"))


@query
def op6_packing(spark, d):
    return pack(tx.read(spark, d, "documents"))


@query
def op7_sharding(spark, d):
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = tx.read(spark, d, "documents").select(
        "doc_id", (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))
    return shard_rows(docs, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_language_id(spark, d):
    docs = tx.read(spark, d, "documents")
    fold = tx.fold_of("doc_id", 5)
    held_out = F.coalesce(fold == 0, F.lit(False))
    found = LanguageModels(docs.filter(fold != 0)).identify(docs)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


@query
def op9_chat_formatting(spark, d):
    return format_chats(tx.read(spark, d, "conversations"))


@query
def op10_quality_rules(spark, d):
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"]
    return quality_rules(tx.read(spark, d, "documents")).select(*base)


@query
def op11_fill_in_middle(spark, d):
    done = fill_in_middle(tx.read(spark, d, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query
def op12_phrase_collocations(spark, d):
    return collocations(tx.read(spark, d, "documents"))


@query
def op13_line_dedup(spark, d):
    docs = tx.read(spark, d, "documents")
    return drop_lines(docs, line_dedup(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
