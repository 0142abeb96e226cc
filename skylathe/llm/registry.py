"""The queries of this package by name, with SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
import public_tokenizers

from . import bpe, chat, decontaminate, drake, language, licenses, linededup, mixing, quantize, toxicity, transport, urlfilter
from .common import table
from .simhash import near_duplicates


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.chosen(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_chats(turns.unionByName(own)))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(list(licenses.TEMPLATES.items()), "license string, text string")
    return licenses.scan(table(spark, sf_dir, "documents"), templates)


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([(x,) for x in urlfilter.LISTED], "url string")
    return urlfilter.verdicts(table(spark, sf_dir, "pages"), rules, listed)


def op7_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.digests(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filtering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.compressed(table(spark, sf_dir, "embeddings"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_drake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drake.clustered(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_mixing": op3_mixing,
    "op4_chat": op4_chat,
    "op5_licenses": op5_licenses,
    "op6_urlfilter": op6_urlfilter,
    "op7_transport": op7_transport,
    "op8_language": op8_language,
    "op9_linededup": op9_linededup,
    "op10_toxicity": op10_toxicity,
    "op11_filtering": op11_filtering,
    "op12_bpe": op12_bpe,
    "op13_drake": op13_drake,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op2_decontaminate": decontaminate.SQL, "op3_mixing": mixing.SQL, "op5_licenses": licenses.SQL, "op6_urlfilter": urlfilter.SQL, "op9_linededup": linededup.SQL, "op11_filtering": quantize.SQL, "op13_drake": drake.SQL}
