"""A corpus pipeline over the documents table, made of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns a DataFrame, which is written as Parquet and read again for the
next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bin_packing, jaccard_join, line_dedup, mix_sources, toxicity
from lodestar.llm.scratch import scope, written

#: Shingle width and similarity, in percent, of the near-duplicate stage.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field scores below a half stay, each as it is.

    A null or empty text has the score of no marginals; repeated rows stay or go
    together; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.fit(docs, labels)
    return toxicity.tag_rows(docs, chain).where("score < 0.5").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate within their source go; documents stay.

    Copies of a text count as one page of their source, so that a document doesn't
    lose its lines for being copied. Null and empty texts stay as they are; a null
    source is a source; n_chars follows the text where lines went.
    """
    mark = "lines_removed"
    while mark in docs.columns:
        mark += "_"
    clean = line_dedup.dedup_lines(docs, distinct_pages=True, removed_col=mark)
    if "n_chars" in docs.columns:
        length = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.col(mark) > 0, length).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of near copies stays: that of the least id, null ids last.

    Of rows with equal id and text one stays, any of them. Null and empty texts link
    with nothing and all stay, repeated ones too.
    """
    with scope() as keep:
        classes = keep(written(jaccard_join.standing_rows(docs, width=NEAR_WORDS, percent=NEAR_PERCENT), "near-classes"))
    keys = [F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text")]
    repeated = classes.where("n_shingles > 0 AND stands").groupBy(*keys).count().where("count > 1").select("k_id", "k_text")
    repeated = written(repeated, "repeated-rows")
    gone = written(classes.where("NOT stands").select(*keys).union(repeated).distinct(), "gone-rows")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), jaccard_join.text_key("text"))

    def among(keys: DataFrame, n: int, how: str) -> DataFrame:
        # broadcast behind a check of their number; beyond, both sides are dealt by key
        keys = F.broadcast(keys) if n <= jaccard_join.BROADCAST_IDS else keys
        return rows.join(keys, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("text_key") == F.col("k_text")), how)

    kept = among(gone, gone.count(), "left_anti").select("row.*")
    n_repeated = repeated.count()
    if not n_repeated:
        return kept
    once = among(repeated, n_repeated, "left_semi").groupBy("id", "text_key").agg(F.first("row").alias("row"))
    return kept.union(once.select("row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that the mix takes twice comes twice.

    Texts without words are in no mix; a null source is a source, ordered last.
    """
    return mix_sources.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as packed sequences: where each piece of a document stands; a null text is one end id."""
    return bin_packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can express neither the random field nor a tokenizer; tests hold stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
