"""Corpus pipeline: quality classifier, line dedup, near-duplicate join, benchmark decontamination, byte-pair encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.bpe import tokens_of
from waymark.llm.common import documents, materialize
from waymark.llm.decontamination import drop_contaminated
from waymark.llm.jaccard_groups import keep_one_of_group
from waymark.llm.line_dedup import drop_common_lines
from waymark.llm.quality import keep_quality

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_common_lines),
    ("n-gram Jaccard join", keep_one_of_group),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", tokens_of),
]

#: The classifier is trained, which SQL cannot restate.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents that all stages keep, with token count and digests.

    Documents that the classifier rejects go; lines that ten or more rows have go from every text; of near copies (five
    words, 0.8) the row of smallest doc_id stays; rows with a benchmark passage go. NULL and empty texts are judged by the
    classifier's bias alone and then pass all stages, repeated ones too. Rows that repeat with words are near copies of each
    other. A NULL doc_id is an id like any other and stands last among near copies. Very long texts are worked whole. Columns
    beside doc_id, text and n_chars pass unchanged, whatever their names, but for those the last stage adds (n_tokens,
    ids_sha256, decoded_sha256), which it replaces. An empty table gives no rows.
    """
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
