"""Corpus preparation in five stages over the documents table.

Each stage takes what the one before it kept, read again from Parquet. A null in
any column is allowed: a null text counts as empty, and rows with a null doc_id
pass the stage that compares documents. Further columns of documents, whatever
their names, go through all stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import op1_bpe, op2_language, op4_jaccard, op7_line_dedup, op10_decontaminate
from strandloom.llm.common import shared_dir

#: Texts of which no language can be told are rejected, and those nearer to random n-grams than to held-out rows
#: of the language that they are told to be. Short clean texts are about as typical as long ones.
LEAST_TYPICAL = 0.5
#: Near duplicates have a Jaccard index J of 0.55 or more over shingles of five words. One edited word changes five
#: shingles; of single words that is a similarity of 0.93, by (2 J / (1 + J)) ** (1 / 5).
NEAR_WORDS, NEAR_PERCENT, NEAR_HUBS = 5, 55, 8


class _Documents:
    """Documents under names of their own, so that none is that of a column which an operator makes."""

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.name = {c: f"document_column_{k}" for k, c in enumerate(docs.columns)}
        self.rows = docs.toDF(*self.name.values())
        self.id, self.text = self.name["doc_id"], self.name["text"]

    def back(self, made: DataFrame, **new) -> DataFrame:
        """The columns of documents under their old names; `new` has those that changed."""
        return made.select(*[(new[c] if c in new else F.col(own)).alias(c) for c, own in self.name.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told."""
    own = _Documents(docs)
    model = op2_language.fit(own.rows.filter(op2_language.fold(own.id, 3) != 1), own.id, own.text, own.name["lang"])
    told = op2_language.predict(own.rows, model, own.id, own.text, carry=True, typical=True)
    return own.back(told.filter((F.col("lang_pred") != op2_language.UNDETERMINED) & (F.col("typical") >= LEAST_TYPICAL)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that many documents share; the documents stay, with the rest of their text."""
    own = _Documents(docs)
    kept = op7_line_dedup.dedup_lines(own.rows, own.id, own.text, carry=True)
    return own.back(kept, text=F.col("kept_text"), n_chars=F.length("kept_text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: that with the least doc_id.

    Rows that repeat a doc_id with another text are documents of their own; of
    rows with equal doc_id and text one stays.
    """
    own = _Documents(docs)
    key = F.when(F.col(own.id).isNotNull(), F.struct(F.col(own.id).alias("id"), F.sha2(F.coalesce(F.col(own.text), F.lit("")), 256).alias("text")))
    rows = own.rows.withColumn("key", key)
    linked = op4_jaccard.link_components(rows, "key", own.text, n=NEAR_WORDS, percent=NEAR_PERCENT, hubs=NEAR_HUBS)
    stay = linked.filter(F.col("key") == F.col("component_id")).select("key").distinct()
    # Rows without an id meet in no join and no group.
    named, others = rows.filter(F.col("key").isNotNull()).join(stay, "key", "left_semi"), rows.filter(F.col("key").isNull())
    if not linked.filter("key IS NOT NULL").groupBy("key").count().filter("count > 1").isEmpty():
        least = named.groupBy("key").agg(F.min(F.struct(*own.name.values())).alias("row"))
        named = least.select("key", "row.*")
    kept = named.select(*own.name.values()).union(others.select(*own.name.values()))
    return own.back(kept)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    own = _Documents(docs)
    marked = op10_decontaminate.decontaminate(own.rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), own.id, own.text, carry=True)
    return own.back(marked.filter(~F.col("contaminated")))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, and digests of them and of what they decode to.

    The columns of documents but the text stay; one that has a name of those made
    here gets `document_` in front.
    """
    own = _Documents(docs)
    made = op1_bpe.round_trip(own.rows, own.id, own.text, with_ids=True, carry=True)
    new = [c for c in made.columns if c not in own.name.values()]
    taken = {c.lower() for c in new}
    kept = [F.col(n).alias(f"document_{c}" if c.lower() in taken else c) for c, n in own.name.items() if c != "text"]
    return made.select(*kept, *new)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("decontaminate", decontaminate),
    ("byte_bpe", bpe),
]
#: Language identification, tiling and encoding are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
