"""From raw documents to packed training sequences, in stages that each rest on one operator of hubflow.llm."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hubflow.llm import tokens
from hubflow.llm.mixing import mix
from hubflow.llm.near_dedup import near_duplicates
from hubflow.llm.packing import pack
from hubflow.llm.quality import GOOD, fit, scored
from hubflow.llm.scratch import written
from hubflow.llm.substring_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a passage that may stand in the corpus once only.
PASSAGE = 50
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_OF_TEXT = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labels that aren't held out, predicts to be good."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs.select(*COLUMNS), model).where(F.col("score") >= GOOD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id; rows without doc_id stay. Of several rows of that doc_id the one whose text has the smallest hash stays, on every run."""
    first = near_duplicates(docs).where("doc_id = class_id").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy(F.md5("text"), "lang", "source", "n_chars")
    kept = docs.join(first, "doc_id", "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1")
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that also start earlier; texts that lose nothing stay as they are."""
    out = remove_repeats(docs, PASSAGE, keep=("lang", "source"), as_is=True)
    return out.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Rows of equal doc_id, source and text are one with as many copies as they get together; without doc_id too."""
    parts = (F.coalesce(c, F.lit("-")) for c in (F.col("doc_id").cast("string"), F.md5("source"), F.md5("text")))
    keyed = docs.select(*COLUMNS).withColumn("key", F.unhex(F.md5(F.concat_ws("|", *parts))))
    copies = mix(keyed.select("doc_id", "text", "source", "key"), keep=("key",)).groupBy("key").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    order = Window.partitionBy("key").orderBy("lang", "n_chars")
    rows = keyed.withColumn("place", F.row_number().over(order)).where("place = 1").join(copies, "key")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 ids: a row for each piece of a document, with its ids."""
    return pack(docs, tokens.read_tokenizer(TOKENIZER), END_OF_TEXT)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

#: No stage's decisions can be had from SQL alone.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
