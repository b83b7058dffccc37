"""From raw documents to token ids: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept.  Its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.

In every stage a null text counts as one without words: it is not toxic, links
with other texts without words, repeats nothing, is clean, and has no tokens.
Rows that repeat stay or go together, but for the near-copies stage, which keeps
one of them.  Null ids and other columns, whatever their names, are carried
along; an empty table stays empty; texts are worked on whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm import byte_bpe, decontaminate, simhash_dedup, substring_dedup, toxicity
from quillflow.llm.tables import dropped, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; it is trained on the labels of this input."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked SimHash fingerprints one document stays: that of the least id; of texts without words, one in all."""
    return simhash_dedup.representatives(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that stand anywhere else are cut out; ``n_chars`` follows the text.  A text may end up empty; its row stays."""
    kept = substring_dedup.deduplicate(docs)
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two benchmark items or more go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, ``n_tokens``, ``ids``, and whether the ids decode to the text (``intact``); no ids for a null or empty text."""
    import public_tokenizers

    found = byte_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "intact")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", to_tokens),
]

#: SQL can't express the trained classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``.  What a stage wrote is deleted once the next has written its own."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
