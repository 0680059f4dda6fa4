"""The corpus pipeline: quality filter, line dedup, near-dedup, mixing, tokenizing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchlake.llm import linededup, mixing, quality, sentencepiece_bpe, simhash
from wrenchlake.llm.common import stored, text_of


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the classifier rejects go.

    Columns are as they were, whatever their names; null and empty texts are scored as empty; rows that are equal in text stay or go
    together; null and repeated ids are rows like others. An empty table gives an empty one.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one line of each group of near copies stays; n_chars, where there is such a column, follows the text.

    Every row stays, with the columns it had, whatever their names; a text that loses all its lines is empty, a null text stays null, with null n_chars. Ties,
    repeated rows and null ids are as in ``linededup.dedup_lines``. An empty table gives an empty one.
    """
    done = linededup.dedup_lines(docs)
    length = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return done.select([length.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group of near copies stays: fingerprints of five-word shingles within five bits. Three segments of 21 bits
    need as many probes for that as two of 32 for three bits.

    Null and empty texts are alike; null and repeated ids, ties and names as in ``simhash.dedup``.
    """
    return simhash.dedup(docs, words=5, radius=5, segments=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each document as often as the mix takes it. Null sources, ids and texts, repeated rows and names are as in ``mixing.apply_mix``."""
    return mixing.apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the ids of each row's text, packed as little-endian unsigned 32-bit integers, and their number.

    A null text counts as empty: begin and end only. Repeated rows and null ids are rows like others; other columns are left behind. An empty table gives
    an empty one.
    """
    model = sentencepiece_bpe.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    coded = docs.select("doc_id", "lang", "source", sentencepiece_bpe.token_ids(text_of("text"), model).alias("ids"))
    return coded.withColumn("n_tokens", F.expr("octet_length(ids) div 4"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_documents),
    ("mixing sources", mix_sources),
    ("sentencepiece", tokenize),
]

#: The model, the hashes and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's rows stored before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs, f"pipeline-{k}") if k < len(STAGES) - 1 else docs
    return docs
