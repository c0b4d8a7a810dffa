"""The corpus pipeline: quality rules, language ID, near-duplicates, secret scan and packing, in this order.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept. All but the last return
the columns of ``documents``, whatever they are, in their order. Stages compose: a stage may be given another's result as
it is, or the same rows twice, and removes nothing that others read. What a stage stores beside its result lies in the
workspace that is open when it is called, and belongs to the caller; ``run`` opens one for each stage and removes it once
the result is written. Texts may be null, empty or of any length; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, minhash, packing, quality, secrets
from tessera.llm._shared import discard, named, new_path, workspace
from tessera.llm.queries import vocabulary

#: Least score at which a language counts as identified.
LEAST_LANGUAGE_SCORE = 0.3

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*map(named, like.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules accept. A null or empty text fails; repeated rows are judged alike and all stay or go."""
    return _columns(quality.keep_good(docs), docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; a text that is null or without letters, or has a score under the least one,
    goes. Repeated rows are judged alike; equal scores go to the language that sorts first."""
    found = language.identify(docs, language.train(docs), prefix="l_")
    return _columns(found.where((F.col("l_lang_pred") != language.UNKNOWN) & (F.col("l_score") >= LEAST_LANGUAGE_SCORE)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more; the smallest id stays.

    Rows that repeat an id with texts that aren't alike are documents of their own; of rows alike in id and text one
    stays. Rows with a null id and rows without words are in no group and all stay.
    """
    return _columns(minhash.deduplicate(docs, words_each=5, percent=80), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the texts, and ``n_chars`` follows where it isn't null; no row goes."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return _columns(clean, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens. A null or empty text is its end id alone; null and repeated ids
    are kept, each row as a document of its own."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: SQL expresses neither the language model nor the tokenizer. Each stage's operator is tested against brute force or a
#: library, and the stages on planted rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result is written to the shared folder and read again, and removed when
    the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with workspace(spark, name) as beside:
            stage(spark, docs, sf_dir).write.parquet(path)
        discard(spark, beside)
        if before is not None:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
