"""The corpus pipeline: stages that each apply one operator to all documents that the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerbench.llm.compression_bands import compression_bands
from peerbench.llm.order_minhash import near_duplicates
from peerbench.llm.packing import pack, token_pieces
from peerbench.llm.pii import personal_data
from peerbench.llm.queries import tokenizer_path
from peerbench.llm.substring_dedup import substring_dedup
from peerbench.llm.tables import read_table
from peerbench.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows without an id can't be told apart later and go. The
    verdict is made in the scan, so no text is shuffled."""
    return compression_bands(docs.where("doc_id is not null"), carry=COLUMNS).where("kept").select(COLUMNS)


def with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``docs`` with the texts of ``changed`` (doc_id, new_text; null: as it was)."""
    text = F.coalesce("new_text", "text")
    return docs.drop("n_chars").join(changed, "doc_id").select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id; of rows with one id, the one with the
    least text, which is the one that is compared, then that with the least other columns."""
    kept = near_duplicates(docs).where("doc_id = class_id").select("doc_id")
    row = F.struct(F.coalesce("text", F.lit("")).alias("_least"), *[F.col(c) for c in COLUMNS[1:]])
    least = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("_row"))
    return least.select("doc_id", *[F.col(f"_row.{c}").alias(c) for c in COLUMNS[1:]])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that appear earlier; documents of which nothing is left go."""
    out = substring_dedup(docs).where("n_removed < n_words")
    return with_text(docs, out.select("doc_id", F.expr("if(n_removed > 0, kept, null)").alias("new_text")))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the kind of each piece of personal data in its place."""
    text = F.coalesce("masked", "text")
    return personal_data(docs, with_masked=True, carry=COLUMNS).select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return pack(token_pieces(docs, tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", one_of_each_group),
    ("substring dedup", without_repeats),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: Compression, sketches and tokenizers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "_").replace("-", "_"))
    return docs
