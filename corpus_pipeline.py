"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.bloom import of_keys
from weir.llm.op1_mixing import mix
from weir.llm.op5_quality import CUT, score_quality, train
from weir.llm.op7_jaccard import linked_rows
from weir.llm.op8_packing import pack_documents
from weir.llm.op10_secrets import labelled_samples, redact, train_markov
from weir.session import bound_batches, settle, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Stands for a missing doc_id, which comes after all others.
LAST = (1 << 63) - 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    A row is judged by its text alone: repeated rows stay or go together, a null text counts as an empty one, and a row
    without a doc_id is judged like any other. Scores at the threshold stay. Without labels of both classes all rows stay.
    """
    ranker = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, ranker, COLUMNS).where(F.col("score") >= CUT).select(*COLUMNS)


def _side(batches: Iterator[pa.RecordBatch], known, inside: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        has = known.value.has(batch.column("key").to_numpy())
        yield batch.filter(pa.array(has if inside else ~has))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest doc_id.

    A null doc_id comes after all others; of rows of one doc_id in a group the text of smallest hash stays; of rows
    that agree in doc_id and text one stays. Different texts that share a doc_id are documents of their own.
    Documents without words link with nothing and all stay. Only texts that may have to go are shuffled.
    """
    bound_batches(spark)
    rows = settle(linked_rows(docs), "linked").where("comp is not null").withColumn("d", F.coalesce("doc_id", F.lit(LAST)))
    best = rows.groupBy("comp").agg(F.min(F.struct("d", "s")).alias("best"))
    gone = (F.col("best.d") != F.col("d")) | (F.col("best.s") != F.col("s"))
    touched = rows.join(best, "comp").groupBy("d", "s").agg(F.max(gone).alias("gone"), F.count("*").alias("rows")).where("gone or rows > 1")
    touched = settle(touched.select("d", "s", "gone"), "touched")
    key = F.xxhash64("d", "s").alias("key")
    known = spark.sparkContext.broadcast(of_keys(touched.select(key), touched.count()))
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("s")).select("*", key)
    rest = named.mapInArrow(partial(_side, known=known, inside=False), named.schema)
    some = named.mapInArrow(partial(_side, known=known, inside=True), named.schema).join(touched, ["d", "s"], "left")
    one = some.where("not gone").dropDuplicates(["d", "s"])
    return rest.select(*COLUMNS).union(some.where("gone is null").select(*COLUMNS)).union(one.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark, and n_chars counted anew where one was.

    Rows are treated each for itself: none goes, repeated rows stay repeated, null texts and ids stay null.
    """
    return redact(docs.select(*COLUMNS), train_markov(labelled_samples(spark)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents whose sources, languages and topics meet the target weights.

    A null source or language is a value of its own, a null text an empty one; rows of one doc_id and cell (rows
    without a doc_id among them) are drawn or left together.
    """
    return mix(docs, COLUMNS).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; a null text is an empty one, repeated rows are packed as often as they occur, a null doc_id stays."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packing", packing)]

#: Learned scores, tokenised texts and linear programs are beyond SQL; tests/llm/test_pipeline.py replays each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
