"""Clean a corpus: toxicity, quality, near duplicates, benchmark passages, then token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame, which
is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Only the columns in COLUMNS are carried; any further one of documents is left out by the first stage, so none can
clash. A null or empty text is scored as empty, has no copies and no benchmark passage, and has no token ids; rows
with equal or null ids are rows of their own; an empty table gives no rows. Where a stage finds rows by a key, the
key is written down with them first, so that another scan or a lost executor can't change it. The rows then pass a
hash table of one partition's keys, so that whole texts are not held to be sorted.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import common, decontamination, jaccard_join, quality, toxicity, word_bpe

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score 0.5 or more) go. It learns from all labelled rows of docs."""
    rows = common.pick(docs, **COLUMNS)
    model = toxicity.train(rows, common.table(spark, sf_dir, "labels", doc_id="long", toxic="int"))
    return toxicity.score(rows, model, keep_text=True).where("score < 0.5").select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects (score below 0.5) go. It learns from all labelled rows of docs."""
    rows = common.pick(docs, **COLUMNS)
    model = quality.train(rows, common.table(spark, sf_dir, "labels", doc_id="long", quality="int"))
    return quality.score(rows, model, keep_text=True).where("score >= 0.5").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest doc_id, and of equal ids the first.

    A row without id stays only where its whole group has none: the group's first. Rows without words have no group.
    """
    rows = common.keyed(docs, **COLUMNS)
    first = jaccard_join.linked_rows(rows, key="key").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("row"))
    return rows.join(first.select("row.key").hint("shuffle_hash"), "key", "left_semi").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten words of a benchmark item go."""
    rows = common.keyed(docs, **COLUMNS)
    items = common.table(spark, sf_dir, "benchmark", item_id="long", text="string")
    hit = decontamination.find_items(rows, items, key="key").where(F.size("spans") > 0).select("key")
    return rows.join(hit.hint("shuffle_hash"), "key", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and ids_sha256 of each document."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = word_bpe.encode(common.pick(docs, **COLUMNS), ranks, public_tokenizers.PATTERN)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", digest.alias("ids_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("word_bpe", encode),
]

#: SQL can express neither the classifiers nor the tokenizer; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; between them, the rows are in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
