"""The corpus pipeline: documents become packed training sequences in five stages.

Each stage works on all rows that the one before kept, and all but the last return the columns of ``documents``.
``run`` writes each stage's result as Parquet in the shared scratch folder and reads it again for the next one,
so a lost executor costs tasks of one stage at most.

All stages: an empty table gives an empty one, further columns are carried whatever their names, rows that repeat
are documents of their own until near-duplicates, of which one stays. A null id counts as held out (nothing is
learned from such a row), and the row stays unless the stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm import hyperminhash, langid, packing, quality, secrets
from leafwright.llm.common import fresh, held_out, table

#: A document stays if its language is known and at least this likely.
LANGUAGE_SCORE = 0.5
#: A document stays if its quality score is at least this.
QUALITY_SCORE = 0.3
#: Documents this similar (percent of the union of five-word shingles) are one group.
NEAR_PERCENT = 80


#: Bytes of an Arrow batch: five stages share executors, whose JVMs keep the buffers of earlier stages.
BATCH_BYTES = 1 << 20


def _begin(spark: SparkSession) -> None:
    """Set the batch size of the session, which keeps it: a stage's result is only planned when it is used."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without a letter and uncertain ones go."""
    _begin(spark)
    model = langid.train(docs, ~held_out(F.col("doc_id")))
    found, sure = fresh(docs.columns, "_lang_pred"), fresh(docs.columns, "_lang_score")
    judged = langid.predict(docs, "text", model, docs.columns, new=(found, sure))
    return judged.where((F.col(found) != langid.UNKNOWN) & (F.col(sure) >= LANGUAGE_SCORE)).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier trained on ``labels`` doesn't reject.

    Empty and null texts get the bias alone. Labels that are null or neither 0 nor 1 aren't used; without labels every
    document stays, with one half.
    """
    _begin(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, labels.where(~held_out(F.col("doc_id"))))
    found = fresh(docs.columns, "_quality_score")
    judged = quality.score(docs, "text", model, docs.columns, new=found)
    return judged.where(F.col(found) >= QUALITY_SCORE).select(*docs.columns)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id (ties: any one row of it).

    Texts that are null or without words are in no group and stay, each of them.
    """
    _begin(spark)
    # The operator replaces columns that are named like its own; those of the documents step aside.
    aside = {c: f"_own_{c}" for c in ("n_shingles", "component_id", "kept", "first") if c in docs.columns}
    found = hyperminhash.near_duplicates(docs.withColumnsRenamed(aside), percent=NEAR_PERCENT).where("first")
    return found.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars``, if there is one, of the masked text; null texts stay null."""
    _begin(spark)
    masked = secrets.redact(docs, secrets.default_forest(spark))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens; null and empty texts are an end token alone."""
    _begin(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("quality", good_quality), ("near-duplicates", unique), ("secrets", without_secrets), ("packing", packed)]

#: No stage but the last's arithmetic can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
