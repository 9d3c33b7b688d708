"""The training-text pipeline: quality rules, near-dedup, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes every stage's
result as Parquet to the shared folder and reads it again as the next stage's documents.
All stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from presslens.llm import crf, mixing, neardup, packing, rules
from presslens.llm.components import saved
from presslens.llm.queries import tokenizer_definition
from presslens.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; of rows with one id and text, one. Rows without an id stay."""
    found = saved(neardup.near_duplicates(docs, percent=80), "near_duplicates")

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("_doc"), F.col("text_sha256").alias("_sha"))
        same = (rows["doc_id"].cast("long") == keys["_doc"]) & neardup.text_key("text").eqNullSafe(keys["_sha"])
        return rows.join(keys, same, how)

    named = found.where(F.col("doc_id").isNotNull())
    surplus = saved(neardup.surplus(found), "surplus")
    of_id = named.groupBy("doc_id").agg(F.min("text_sha256").alias("low"), F.max("text_sha256").alias("high"))
    several = saved(of_id.where("low <> high").select("doc_id"), "several")
    # where an id has one text the id tells what goes, so no text is moved for it
    ids = saved(surplus.join(several, "doc_id", "left_anti").select(F.col("doc_id").alias("_id")), "surplus_ids")
    left = neardup.without(docs.withColumn("_id", F.col("doc_id").cast("long")), ids, "_id").select(docs.columns)
    if not several.isEmpty():
        left = among(left, saved(surplus.join(several, "doc_id", "left_semi"), "surplus_of_several"), "left_anti")
    again = saved(named.groupBy("doc_id", "text_sha256").count().where("count > 1"), "repeated")
    if again.isEmpty():
        return left
    # only repeated rows are moved to be told apart
    return among(left, again, "left_anti").unionByName(among(left, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind; ``n_chars`` follows the text."""
    field = crf.train(crf.labelled_table(spark))
    out = docs.withColumn("text", crf.redacted(field, F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document taken in part is cut."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences: their token ids and the ids' checksum."""
    pieces = packing.pack(docs, tokenizer_definition(), window=1024)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("packing", packed),
]

#: Near-dedup, the field's spans and tokenization have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
