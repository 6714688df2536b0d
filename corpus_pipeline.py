"""The corpus pipeline: five stages from documents to token statistics.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All
but the last return the columns of documents, and further ones that docs brings along, whatever their names; the last
reads doc_id and text alone.

Cases, by stage. Null and empty texts: quality scores them like any text; lines leaves them as they are; of all that have
no words SimHash keeps one; they are never contaminated; they have no tokens. Null ids: kept and judged by their text; of
near copies a row with an id stays. Rows equal in id and text get one decision, and SimHash keeps one of them. Very long
texts are worked whole. Ties go to the smallest id, then to the least hash of the text. Empty documents give an empty
result; without labels quality gives every row the score 0.5 and keeps none; an empty benchmark removes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import bpe_codec, decontaminate, line_dedup, quality, simhash
from causeway.llm.common import held_out, stored, table


def quality_kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Rows equal in id and text get one decision."""
    return quality.accepted(docs, quality.classify(docs, table(spark, sf_dir, "labels"), "quality", ~held_out("doc_id", 4, 2)))


def lines_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; n_chars, where there is one, counts the text that stays."""
    out = line_dedup.deduplicated(docs)
    return out.withColumn("n_chars", F.char_length(F.col("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates_dropped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.contaminated_removed(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    import public_tokenizers

    return bpe_codec.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_kept),
    ("line_dedup", lines_deduplicated),
    ("simhash", near_duplicates_dropped),
    ("decontaminate", decontaminated),
    ("bpe", encoded),
]

#: The classifier and the encoder have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
