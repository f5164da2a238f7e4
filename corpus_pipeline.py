"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

``run`` writes every stage's result as a table in the shared folder and reads
it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, toxicity
from tallyframe.llm.queries import tokenizer
from tallyframe.llm.shared import cut, free, maybe_broadcast, spare_name, table

#: Ids that may be broadcast when documents are dropped by id (8 bytes each).
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``docs`` less the given doc_ids; a null doc_id stays."""
    return docs.join(maybe_broadcast(cut(ids, name), BROADCAST_ROWS), "doc_id", "left_anti").select(docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = spare_name(docs, "toxic")
    return toxicity.with_score(docs, model, score).filter(F.col(score) < toxicity.THRESHOLD).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of 50 words and more are cut out of the texts; every document stays."""
    out = line_dedup.deduplicate(docs, count=(gone := spare_name(docs, "cut")))
    return out.select(*(F.when(out[gone] > 0, F.length("text").cast("long")).otherwise(out["n_chars"]).alias("n_chars") if c == "n_chars" else out[c] for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    found = jaccard_join.jaccard_components(docs)
    return without(docs, found.filter("doc_id <> component_id").select("doc_id").distinct(), "duplicates")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.select("doc_id").distinct(), "contaminated")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of what is left."""
    import public_tokenizers

    return byte_bpe.digests(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]
#: SQL cannot express the trained classifier; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        free(*before)
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
