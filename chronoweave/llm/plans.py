"""Queries and SQL of the text operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import bpe, markup_clean, matching, mixing, residue, splitting
from chronoweave.plans.registry import Registry
from chronoweave.session import cut, read_table, spread

_LLM = Registry()
query = _LLM.query
QUERIES, SQL = _LLM.queries, _LLM.sql
#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZER_FOLDER", bpe.TOKENIZERS)


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(read_table(spark, d, "documents").select("doc_id", "text", *columns))


# --- 1: splitting oversized texts -------------------------------------------


@query("p1_found", "select doc_id from documents where length(text) > 4000")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(_documents(spark, d), "doc_id", "text", with_text=False)
    return pieces.where("piece_no = 1").select("doc_id")


@query("p1_pieces")
def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_documents(spark, d), "doc_id", "text")


# --- 2: markup residue ------------------------------------------------------


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    cleaned = markup_clean.clean_markup(_documents(spark, d), "doc_id", "text", with_text=False)
    return cleaned.select("doc_id", F.explode("markup").alias("markup"))


@query("p2_clean")
def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup_clean.clean_markup(_documents(spark, d), "doc_id", "text")


# --- 4: typed names to the reference list -----------------------------------


def _typed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All typed names, and the mapping of the distinct ones that aren't exactly a canonical name."""
    names = read_table(spark, d, "gdelt_slices").select(F.lit("gdelt_slices").alias("table_name"), F.col("globaleventid").alias("rec_id"), F.col("actor1name").alias("value"))
    src = read_table(spark, d, "corpus").select(F.lit("corpus").alias("table_name"), "rec_id", F.col("src").alias("value"))
    rows = names.unionByName(src).where("rec_id is not null")
    reference = read_table(spark, d, "actor_ref").select("ref_id", "canonical_name")
    exact = reference.select(F.col("canonical_name").alias("value")).distinct()
    typed = rows.join(exact, "value", "left_anti")
    return typed, cut(matching.map_values(typed, reference))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    typed, mapping = _typed(spark, d)
    return typed.distinct().join(mapping, "value").groupBy("table_name", "rec_id").agg(F.min("ref_id").alias("ref_id"))


@query("p4_unmatched")
def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values without an entry, with the number of rows that hold them."""
    typed, mapping = _typed(spark, d)
    counts = typed.groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(mapping.where("ref_id = -1"), "value").select("value", "n_rows")


# --- 8: token ids of the whole corpus ---------------------------------------


@query("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(_documents(spark, d), "doc_id", "text", TOKENIZERS)


@query("p8_decoded", "select doc_id, coalesce(text, '') as text from documents")
def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, decoded from their ids."""
    return bpe.decode_column(bpe.encode_column(_documents(spark, d), "doc_id", "text", TOKENIZERS), "doc_id", "ids", TOKENIZERS)


# --- 9: mixing sources ------------------------------------------------------


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each document of a source; written once, as several sums read it."""
    named = _documents(spark, d, "source").where("source is not null and text is not null and text <> ''")
    return cut(bpe.count_column(named, "text", ["doc_id", "source"], TOKENIZERS))


@query("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(_sized(spark, d), read_table(spark, d, "mix_target"))[0]


@query("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*mixing.mix_documents(_sized(spark, d), read_table(spark, d, "mix_target")))


# --- 10: template residue and error pages -----------------------------------


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(_documents(spark, d, "cik"), "doc_id", "text", F.col("cik")).select("doc_id")


@query("p10_validation")
def p10_validation(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the classifier on the hosts it was fitted on and on unseen ones."""
    figures = residue.train(_documents(spark, d, "cik"), "doc_id", "text", F.col("cik"))[1]
    schema = "part string, head string, n_windows bigint, n_labelled bigint, precision double, recall double"
    return spark.createDataFrame([tuple(f.values()) for f in figures], schema)
