"""The corpus pipeline: quality classifier, near-duplicate join, secret scan, source mixing, packing, each over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import jaccard, mixing, packing, quality, secret_scan
from tidelog.llm.common import n_words, table, written

#: Where SQL can't express a stage (the trained models, the hashed permutations) there is no SQL for the rows of run().
ORACLE_SQL = None
#: A document stays if its quality score is at least this.
LEAST_QUALITY = 0.7
#: Near duplicates share this percentage of their runs of WORDS words.
WORDS, PERCENT = 5, 80
#: No source is passed more often than this while the commonest is passed once.
MAX_REPEATS = 1.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labelled ones, scores LEAST_QUALITY or more. Null and empty texts are scored as empty ones; each row is judged by its own text, whatever its id, so repeated rows stay or go together. Without labels, or with labels of one kind only, all have one score."""
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, into="_score").where(F.col("_score") >= LEAST_QUALITY).select(*[F.col(c) for c in docs.columns])


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id (null last; of equal ids the first row written). Rows are told apart by a number of their own, so repeated and null ids lose nothing and hide nothing. Null, empty and white texts are no one's duplicate, and all stay."""
    keyed = written(docs.withColumn("_row", F.monotonically_increasing_id()))
    groups = jaccard.jaccard_components(keyed, WORDS, PERCENT, id_col="_row").select("_row", "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    firsts = groups.join(keyed.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first._row").alias("_row"))
    return keyed.join(firsts, "_row", "left_semi").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark and n_chars counted anew where one was. A null text stays null; repeated rows are masked each by itself."""
    out = secret_scan.scan(docs, path=F.col("source"))
    changed = F.size("secrets") > 0
    return out.withColumn("n_chars", F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.when(changed, F.col("clean_text")).otherwise(F.col("text"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mixture draws a document; each row is drawn once at least. A null source is a source of its own; null and empty texts count as one word; repeated rows are drawn together."""
    out = mixing.mix(docs.withColumn("_n_words", n_words(F.col("text"))), max_repeats=MAX_REPEATS, tokens_col="_n_words")
    return out.select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per drawn row its bucket, batch and slot; null and empty texts have length 0. Rows with null or repeated ids are packed each by itself."""
    return packing.pack(written(docs.select("doc_id", n_words(F.col("text")).alias("n_tokens"))))


STAGES = [("quality", keep_quality), ("near_duplicates", keep_one_of_group), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack_documents)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each stage's rows are written to the shared folder and read again, and deleted once the next stage's are written."""
    docs, before = table(spark, sf_dir, "documents"), ()
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), drop=before)
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    """The pipeline as a registered query."""
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    """None of the pipeline's rows can be had by SQL."""
    return {}
