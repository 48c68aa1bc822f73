"""Documents to packed training sequences, in five stages.

``run`` keeps each stage's rows in the checkpoint folder; a driver may as well write them and read
them again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, language, packing, queries, secrets, simhash
from tidemark.llm.common import checkpointed, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter, and those that fit no learned language.

    The model's log-probability a character decides, against what all texts of known languages
    show; the texts are scored once and stored with their scores.
    Every row is judged by itself: repeated rows and null ids stay or go like others, null and
    empty texts go, and an empty table stays empty.
    """
    model = queries.language_model(docs)
    scored = stored(language.fitted(docs, model), "fits")
    return language.keep_known(scored, language.floor(queries.language_labels(scored, "fit")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each SimHash component.

    Rows with equal ids and texts are one document, null ids come after all others; an empty table
    stays empty.
    """
    return simhash.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which at least a twentieth of the words are benchmark passages.

    Null and empty texts have no words and stay; repeated rows stay or go together.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; the documents stay, with repeated rows and null texts."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents with their places in the training sequences.

    Every row is a document; a null or empty text is the end id alone, an empty table has no piece.
    """
    return packing.pack(docs, public_tokenizers.path(queries.PACKING_VOCABULARY))


STAGES = [
    ("language ID", identify_language), ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate_benchmark), ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL has neither the piece models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        # Later stages read their input more than once.
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
