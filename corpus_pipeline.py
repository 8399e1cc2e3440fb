"""Cleaning and encoding a corpus in stages. Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.

Null and empty texts have no language, so the first stage drops them; an empty table stays empty through all stages. All
stages hand on every column of their input, whatever its name; those that a stage fills (text, lang, n_chars) may be missing,
doc_id and text may not. Texts of any length are handled whole. Rows of equal id and text are one document: line dedup treats
them alike, near-dedup keeps one. Of documents that tie, the one of the smallest id, then of the smallest hash of its text,
counts as the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchgraph.llm import decontaminate, langid, line_dedup, quality, sentencepiece_codec, simhash
from sketchgraph.llm._common import table, written
from sketchgraph.llm.queries import PIECES, tokenizer

def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones show, of which one part in four is held out; a null lang becomes the predicted one."""
    labelled = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    model = langid.learn(labelled.where(F.coalesce(quality.remainder("doc_id", 4) != 2, F.lit(True))))
    return langid.known_only(docs, model, lang_col="lang" if "lang" in docs.columns else None)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; those left without text stay, as empty ones."""
    kept = line_dedup.drop_recurring_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: op5's links of SimHash fingerprints, and texts that two bits don't reach by exact similarity."""
    return simhash.keep_one(docs, by_print=True)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether these give the text back, in place of columns of these names."""
    new = ("ids", "n_tokens", "round_trip")
    coded = sentencepiece_codec.encode(docs, tokenizer(PIECES), check_col="round_trip")
    return coded.select(*[c for c in docs.columns if c not in new], "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [("language ID", language_id), ("line dedup", dedup_lines), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", drop_benchmark), ("SentencePiece encoding and decoding", encode)]
#: Language models, SimHash bits and piece merges can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
