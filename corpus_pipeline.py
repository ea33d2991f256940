"""The corpus pipeline: five stages from raw documents to token digests.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes each result as Parquet to
the shared folder and reads it again for the next stage.

1. quality rules: rejected documents go;
2. line dedup: lines that an earlier document has too are cut, documents left without a word go;
3. n-gram Jaccard join: the document with the smallest id of each near-duplicate group stays;
4. benchmark decontamination: contaminated documents go, others stay as they are;
5. SentencePiece: each document gets its token count and the digests of its ids and of the decoded text.

Defined results. Null, empty and blank texts fail the quality rules, so no later stage meets them in ``run``; alone, line dedup leaves them as
they are, the Jaccard join lets them stay, decontamination finds them clean and the tokenizer gives them no ids. Rows without ``doc_id`` are
judged like others, cut by no other document and link with none; null ``lang`` or ``source`` is a group of its own. Repeated rows: the copies lose
their shared lines or go with the Jaccard join, one stays. Very long texts are worked on whole. An empty table stays empty. Other columns of
documents go through all stages but the last, whatever their names, except for names that begin with ``__``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fettle.llm import contamination, jaccard, linededup, pieces, quality
from fettle.session import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words and a similarity of 0.8 or more, as all stages on word shingles."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode_decode(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece", tokenize),
]

#: SQL can't express the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
