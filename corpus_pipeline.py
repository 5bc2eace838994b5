"""Corpus preparation in five stages, each written as Parquet and read again by the next.

Toxicity drops documents scored at the threshold or above. The n-gram Jaccard join keeps the smallest
doc_id of each group of near copies, and all documents without a doc_id. Substring dedup cuts long repeats out of later documents.
Decontamination cuts benchmark passages. The last stage encodes what is left and decodes it again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. n_chars is the length of the text as it is after a stage that cuts.

Defined cases: rows with null texts stay, nothing in them is toxic, repeated or contaminated; an empty
table gives an empty table at each stage; very long texts are read whole, one at a time in a task; repeated
rows of one id are one document for the join and stay together, and of two rows with one id and unlike
texts both stay when their id is the smallest of its group; a tie in score at the threshold is toxic;
columns of documents keep their values whatever their names, and what a stage adds for itself has a name
that no column has; the last stage adds ids, decoded and n_tokens, which replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import decontamination, jaccard_join, sentencepiece_bpe, substring_dedup, toxicity
from touchline.llm.queries import table, tokenizer_path
from touchline.llm.regions import shared_table, unused


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "toxicity")
    return toxicity.score(docs, model, out=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = unused(docs, "kept")
    chosen = jaccard_join.join(docs).where("doc_id = component_id").select(F.col("doc_id").alias(kept))
    return docs.join(chosen, F.col("doc_id") == F.col(kept), "left_semi").unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(substring_dedup.clean(docs))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontamination.clean(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = sentencepiece_bpe.round_trip(docs, tokenizer_path())
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("decontamination", cut_benchmark),
    ("sentencepiece", encode),
]

#: The matching of whole texts and the merges have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = shared_table(docs, f"stage-{name}")
    return docs
