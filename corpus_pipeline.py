"""A corpus pipeline of five stages over `documents`, each calling one operator of loomfield.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import byte_bpe, decontaminate, line_dedup, near_copies, quality_classifier
from loomfield.llm.common import materialize
from loomfield.llm.queries import RANK_FILE, quality_model
from loomfield.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all of `documents`, scores under a half go."""
    model = quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model, keep={c: F.col(c) for c in COLUMNS})
    return scored.where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents go from them; n_chars follows the text."""
    out = line_dedup.drop_lines(docs, "source", "text")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document of least id stays."""
    return near_copies.drop_near_copies(docs, "doc_id", "text").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a paraphrase with its answer, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded bytes."""
    return byte_bpe.encode(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs


#: Training, spectral search and fuzzy hashing have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
