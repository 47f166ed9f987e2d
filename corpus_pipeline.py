"""From raw documents to packed training sequences, one written table a stage.

Each stage takes all that its predecessor kept and returns the columns of ``documents``,
whatever others there are; the last returns the packed pieces.  Null ids stay and are rows of
their own, texts of any length are read whole, an empty table passes through as an empty
table; what else odd rows do is defined in the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import language, mixing, packing, pii, simhash
from tallyspark.llm.common import settle, table, word_count

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = ("lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (null text, or no letter) go; null languages are filled."""
    carried = docs.select("doc_id", "text", "lang", *[F.col(c).alias(f"_{c}") for c in REST], F.col("text").alias("_text"))
    said = language.identify(carried, carry=("_text", *(f"_{c}" for c in REST)))
    kept = said.filter(F.col("lang_pred") != language.UNKNOWN)
    return kept.select("doc_id", F.col("_text").alias("text"), F.coalesce("_lang", "lang_pred").alias("lang"), F.col("_source").alias("source"), F.col("_n_chars").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, once."""
    return simhash.one_of_each(docs, COLUMNS)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; all documents stay."""
    found = pii.find_personal_data(docs.select("doc_id", "text", *REST), carry=REST)
    length = F.when(F.col("spans") != "", F.length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", length.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated as often as the mix takes it; those it doesn't take go.

    Rows that share doc_id, source and size are taken as often in total as the mix says: where it
    takes some of them once more, those of the greatest weight come first, as in its draw.
    """
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("size").alias("words"))
    taken = taken.agg(F.min("copies").alias("least"), F.max("copies").alias("most"), F.sum(F.col("copies").cast("long")).alias("all"), F.count("*").alias("rows"))
    taken = settle(taken, "taken")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("words"))
    chosen = docs.select(*COLUMNS, word_count(F.col("text")).alias("size")).join(taken.filter("most > 0").hint("merge"), same)  # as many rows as documents
    alike = Window.partitionBy("doc_id", "source", "size").orderBy(F.desc(mixing.quality_weight(F.col("text"))), F.xxhash64("text", "lang", "n_chars"))
    more = F.row_number().over(alike) <= F.col("all") - F.col("rows") * F.col("least")
    even = chosen.filter("least = most").withColumn("copies", F.col("least"))
    uneven = chosen.filter("least < most").withColumn("copies", F.col("least") + more.cast("int")).filter("copies > 0")
    return even.unionByName(uneven).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("remove_personal_data", remove_personal_data),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: The stages' methods (n-gram profiles, fingerprints, trained span classifier) aren't SQL;
#: tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
