"""The cleaning pipeline: stages over documents, each written and read again as the next one's input.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsieve.llm import jaccard, packing, private, quality
from capsieve.llm.exact_dedup import exact_dedup
from capsieve.llm.tables import prepare, table, text_digest
from capsieve.operators.ordering import number_rows
from capsieve.session import materialize

#: Rows up to which a list of ids is broadcast (16 MB); a longer one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def by_text(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with ``_row``, an id of the row's id and text in their order, rows without id last; and the table of them.

    Where each id names one text and none is null, ids serve as they are and there is no table.
    """
    digests = docs.select("doc_id", text_digest(F.col("text")).alias("_digest"))
    one = digests.groupBy("doc_id").agg(F.min("_digest").alias("a"), F.max("_digest").alias("b"))
    if not one.where("doc_id IS NULL OR a <> b").limit(1).count():
        return docs.withColumn("_row", F.col("doc_id")), None
    rows = materialize(number_rows(digests.distinct(), [F.col("doc_id").asc_nulls_last(), F.col("_digest")], "_row"))
    known = rows.select(F.col("doc_id").alias("_id"), "_digest", "_row")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_digest(F.col("text")) == F.col("_digest"))
    return docs.join(known, same).drop("_id", "_digest"), rows


def without(numbered: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose ``_row`` isn't among the ``doc_id`` of ``gone``."""
    ids = materialize(gone.select(F.col("doc_id").alias("_row")).where("_row IS NOT NULL").distinct())
    return numbered.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "_row", "left_anti").select(*columns)


def as_id(numbered: DataFrame, *columns: str) -> DataFrame:
    return numbered.select(F.col("_row").alias("doc_id"), *columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is too high for their language go.

    Rows are judged one by one: of an id with several texts only the bad ones go, rows without id like others. Null and
    empty texts stay. Repeated rows go or stay together. All columns are carried, an empty table gives none.
    """
    prepare(spark)
    numbered, rows = by_text(docs)
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    if rows is not None:
        trusted = rows.join(trusted.select("doc_id").distinct(), "doc_id").select(F.col("_row").alias("doc_id"))
    judged = quality.classify(as_id(numbered, "text", "lang"), trusted)
    return without(numbered, judged.where("NOT kept"), docs.columns)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that with the largest id.

    Null counts as an empty text; of repeated rows one stays, a row without id only if all of its group lack one. All
    columns are carried, an empty table gives none.
    """
    prepare(spark)
    return exact_dedup(docs).where("kept").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id.

    Rows are compared one by one, so the other texts of an id that has a near copy stay. Rows without id come after all
    others. Texts without words link with nothing and stay. All columns are carried, an empty table gives none.
    """
    prepare(spark)
    numbered, _ = by_text(docs)
    return without(numbered, jaccard.join(as_id(numbered, "text")).where("component_id <> doc_id"), docs.columns)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in angle brackets; n_chars, where there is such a column, is counted anew.

    Null texts stay null. Every row stays, in all columns.
    """
    prepare(spark)
    found = private.detect(docs).withColumn("text", private.mask(F.col("text"), F.col("found")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets and batches, from the words of the documents that are left; see ``packing.pack``.

    Null and empty texts have no words and give no row; repeated rows are packed each; other columns aren't carried.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good),
    ("exact dedup", unique),
    ("n-gram Jaccard join", distinct),
    ("personal data", masked),
    ("packing", packed),
]

#: The classifier, the components, the span model and the bucket search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
