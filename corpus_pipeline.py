"""Five corpus stages in order, each over all rows that its predecessor kept.

``run(spark, sf_dir)`` applies them to ``documents``; between stages rows are written as Parquet in
the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodecat.llm import bpe, likeness, mixing, pii, quality
from lodecat.llm.common import NULL_ID, lookup
from lodecat.session import cut_lineage, run_folder


def keep_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model, F.col("source"), F.col("lang")).filter("keep").select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of documents linked by a likeness of at least 0.8 of their five-word
    shingles one stays, the one of smallest id.

    Documents are linked by their texts alone: rows that share an id, or have none, stay if their
    texts are unlike.  A null id counts as the smallest; of rows that share id and text, the one whose
    row as JSON has the smallest hash stays, and of rows that are equal throughout one.
    """
    key = ["doc_id", "mark"]
    found = cut_lineage(likeness.near_copies(docs))
    stay = found.groupBy("component").agg(F.min(F.struct(*key)).alias("s")).select("s.*")
    gone = cut_lineage(found.select(*key).join(stay, key, "left_anti").distinct())
    again = cut_lineage(found.groupBy(*key).count().filter("count > 1").select(*key).join(gone, key, "left_anti"))
    gone, again = lookup(gone, gone.count()), lookup(again, again.count())
    marked = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
                         F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    first = Window.partitionBy(*key).orderBy(F.xxhash64(F.to_json("row")))
    once = marked.join(gone, key, "left_anti").join(again, key, "left_anti")
    several = marked.join(again, key, "left_semi").withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return once.select("row.*").union(several.select("row.*"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every span found is replaced by its kind in brackets; n_chars follows."""
    columns = docs.columns
    done = docs.withColumn("text", pii.redacted_text(F.col("text")))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a document comes as often as the mix has it, at least once."""
    rows, _ = mixing.mix_sources(docs)
    return rows.select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: token ids of every row, with digests of the ids and of the decoded text."""
    return bpe.encode(docs)


STAGES = [("quality classifier", keep_fit), ("SimHash near-dedup", keep_one_of_near_copies), ("PII", redact),
          ("mixing sources to target weights", mix), ("BPE encoding and decoding", encode)]

#: The classifier is trained and the tokeniser read from a file: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = run_folder(spark, "corpus-pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
    return docs
