"""A corpus pipeline of five stages, each one of the operators of barloom.llm applied to all that its predecessor kept.

toxicity (rejected documents go) -> near duplicates (of each group the document with the smallest id stays) ->
repeated passages (all but the first document lose them; a document that loses all its words goes) -> benchmark decontamination
(documents with a benchmark window go) -> packing.

Every stage but the last returns the columns it was given, whatever others they are. Rows without a doc_id stay but for the toxic ones, and are packed. Rows
with one doc_id and different texts are judged each by its own text. Null, empty and wordless texts stay. Empty tables: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import chaining, decontaminate, jaccard, pack, toxicity
from barloom.llm.common import scratch, small_batches, stash, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score THRESHOLD or more go. All labelled rows teach: op8's held-out third is a matter of its query."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, *toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays; documents without words all stay."""
    small_batches(spark)
    return jaccard.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose passages that earlier documents have; n_chars follows. A document that loses all its words goes."""
    small_batches(spark)
    out = chaining.cut_repeats(docs)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, cut into full sequences."""
    small_batches(spark)
    return pack.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL has no form for chaining or the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark):
            docs = stash(stage(spark, docs, sf_dir), keep=True)
    return docs
