"""Corpus pipeline: language ID, near-dedup, mixing to target weights, packing.

Each stage takes all documents its predecessor kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rastra.llm import langid, order_minhash, packing, raking, storage, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier rejects go; it learns from the stage's own labelled rows.

    Null texts and texts without a letter go; without any labelled row all do; an empty table gives none.
    """
    model = langid.fit(docs.where(langid.fold() != 2))
    return langid.predict(docs.select(COLUMNS), model).where("not rejected").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts stays: the one of smallest doc_id, rows without one coming last.

    Every text is judged, whatever its doc_id (texts are told apart by a 64-bit hash); rows that share a
    doc_id with other texts are rows of their own, and of rows equal in both one stays, the smallest.  A null text is
    like no other, but for its doc_id's repeats; an empty table gives none.  Only texts that have a copy are shuffled, to
    meet the list of them.
    """
    scratch = storage.Scratch(spark, "near-dedup")
    docs = docs.select(COLUMNS)
    rows = docs.where("text is not null").withColumn("__h", F.xxhash64("text"))
    classes = scratch.write(order_minhash.near_duplicates(rows, 0.8, id_col="__h").select(F.col("doc_id").alias("h"), "class_id"))
    least = rows.groupBy(F.col("__h").alias("h")).agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id")).alias("m"))
    least = scratch.write(least.join(classes, "h"))
    groups = least.groupBy("class_id").agg(F.sum("n").alias("n"), F.min(F.struct("m", "h")).alias("s")).where("n > 1")
    listed = least.join(groups.select("class_id", "s"), "class_id").select(F.col("h").alias("__h"), (F.col("h") == F.col("s.h")).alias("__first"), F.col("m.doc_id").alias("__d"))
    listed = scratch.write(listed)
    likely, alone = storage.divided(rows, listed, "__h")
    repeated = scratch.write(
        likely.select("__h", "doc_id").join(listed.where("__first"), "__h").where(F.col("doc_id").eqNullSafe(F.col("__d"))).groupBy("__h").count().where("count > 1").select("__h", F.lit(True).alias("__more"))
    )
    marked = likely.join(listed.join(repeated, "__h", "left").hint("merge"), "__h", "left")  # alike at every size
    stay = marked.where(F.col("__first").isNull() | (F.col("__first") & F.col("doc_id").eqNullSafe(F.col("__d"))))
    single = stay.where("__more is null").select(COLUMNS)
    again = stay.where("__more").groupBy("__h").agg(F.min(F.struct(*COLUMNS)).alias("s")).select("s.*")
    empty = docs.where("text is null")
    named = empty.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("s")).select("s.*")
    return alone.select(COLUMNS).unionByName(single).unionByName(again).unionByName(named).unionByName(empty.where("doc_id is null"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A fixed share of all tokens, sampled so that they follow the tempered source, language and topic marginals.

    A null source or language is a category of its own; rows without tokens whose cell has none stay; rows that
    repeat a doc_id share their draw, rows without one draw by their text; an empty table gives none.
    """
    return raking.mix(docs.select(COLUMNS), rate=raking.PRODUCTION_RATE).where("sampled").select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4096 ids, each document ending with id 2; a null or empty text is that id alone; an empty
    table gives none."""
    return packing.digest(packing.pack(docs, tokens.default_path(), end_id=2, window=4096))


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_dedup), ("mixing", mixing), ("packing", packing_stage)]

#: Models, sketches and tokenizer ids have no SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
