"""A corpus pipeline of the training-data operators: language, near-duplicates, personal data, mix, packing.

Each stage takes the documents that the stage before it kept and, but for the last, returns documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import language, mixing, packing, privacy, simhash
from orrery.llm.common import cut

#: Texts whose best language is regressed lower than this are in none of those learned. Of labelled texts, three letters suffice for more.
LEAST_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, null and empty texts among them, and those in no learned language; the rest stay as they are.

    Null ids, languages and sources don't matter to what is kept. If nothing is labelled, no language is known and all go. Repeated rows
    are judged alike; an empty table stays empty."""
    model = language.fitted(*language.training_rows(docs.where(~language.held_out())))
    found = language.identify(docs, model, name="_found")
    return found.where((F.col("_found.lang_pred") != language.UNDETERMINED) & (F.col("_found.score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component, the one with the smallest doc_id.

    Null and empty texts are one component, as their fingerprint is zero. A null doc_id is never the smallest unless alone. Of rows with
    the same id the one with the smallest text hash stays, and of equal ones one; an empty table stays empty."""
    return simhash.representatives(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates in place of personal data; n_chars follows where something was replaced.

    Null and empty texts stay; all rows stay, repeated ones rewritten alike; an empty table stays empty."""
    found = privacy.pseudonymise(docs, privacy.DEMO_SECRET, name="_pii")
    new = {"text": F.col("_pii.text"), "n_chars": F.when(F.col("_pii.n_entities") > 0, F.length("_pii.text")).otherwise(F.col("n_chars")).cast("long")}
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes of each source what its target gives: documents once or several times, or parts of them; n_chars follows.

    Null sources are one source; null and empty texts have no words and go; repeated rows are documents of their own; an empty table
    stays empty."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of 2048 tokens.

    Null and empty texts are an end mark alone; null ids and repeated rows are packed like any others; of an empty table nothing."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]
#: SQL can't express the kernel, hash and token stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
