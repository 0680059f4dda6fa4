"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchlake.llm.common import bounded_batches, small, stored, text_of, whole_row
from wrenchlake.llm.components import connected_components
from wrenchlake.llm.hamming import radius_pairs

BLOCK = 1 << 15
SEED = 42


def fingerprint_of(text: str, words: int = 3) -> int:
    """The unsigned fingerprint: a bit is set if it is set in over half of the shingles' hashes.

    ASCII letters are lower-cased, words are split at ASCII white space, shingles count as often as they
    occur; a text of fewer words has one shingle, its whole sequence; one of no words has fingerprint 0.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """``fingerprint_of`` of a column, as a signed long."""

    bounded_batches()

    @F.pandas_udf(T.LongType())
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint_of(t, words) for t in batch], "<u8").view("<i8"))

    return of(text)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, segments: int = 2, words: int = 3) -> DataFrame:
    """``(doc_id, code, component_id)`` per row of ``docs``: documents whose fingerprints of shingles of ``words`` words are at most
    ``radius`` bits apart are linked; ``component_id`` is the smallest id reachable.

    Exact copies share a fingerprint and are collapsed (pre-aggregated) before any pair is formed; links
    are searched between distinct fingerprints only. Null texts count as empty: fingerprint 0, linked like any
    other. Null ids stay in the result and never name a component unless nothing else does. Repeated rows
    are each returned. Other columns are not read.
    """
    marked = stored(docs.select(F.col(id_col).alias("doc_id"), fingerprint(text_of(text_col), words).alias("code")), "simhash")
    classes = _classes(marked, radius, segments)
    return marked.join(small(classes), "code").select("doc_id", "code", "component_id")


def _classes(marked: DataFrame, radius: int, segments: int) -> DataFrame:
    """``(code, component, component_id)`` of each distinct code of ``marked(doc_id, code)``; stored."""
    nodes = marked.groupBy("code").agg(F.min("doc_id").alias("first_id"))
    parts = connected_components(radius_pairs(nodes, "code", radius, segments))
    named = nodes.join(parts, nodes["code"] == parts["node"], "left").select("code", "first_id", F.coalesce("component", "code").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return stored(named.join(lowest, "component").select("code", "component", "component_id"), "simhash-classes")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, segments: int = 2, words: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near copies: of its rows with the group's smallest id (null ids come after all others), one of the text of
    least hash. Columns stay as they are, whatever their names.

    Groups are of texts, so rows of one id whose texts are not alike are in different groups and each group keeps a row. Null and empty texts are alike. Of rows equal in id and text
    one stays. An empty table gives an empty one.
    """
    row = F.col("row")  # the whole row as one value, so that no name of its columns meets one of ours
    key = lambda t: F.xxhash64(F.coalesce(t.cast("string"), F.lit("")))
    marked = stored(docs.select(F.col(f"`{id_col}`").alias("doc_id"), key(F.col(f"`{text_col}`")).alias("key"), fingerprint(text_of(f"`{text_col}`"), words).alias("code")), "simhash")
    every = marked.groupBy("doc_id", "key", "code").agg(F.count("*").alias("rows")).join(small(_classes(marked, radius, segments)), "code")
    first = every.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "rows")).alias("b"))
    stay = small(stored(first.select(F.col("b.doc_id").alias("stay_id"), F.col("b.key").alias("stay_key"), F.col("b.rows").alias("rows")), "simhash-stay"))
    rows = docs.select(whole_row(docs).alias("row")).select("row", row[id_col].alias("id"), key(row[text_col]).alias("key"))
    kept = rows.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("key") == F.col("stay_key")))
    again = kept.where("rows > 1").groupBy("id", "key").agg(F.first("row").alias("row"))
    return kept.where("rows = 1").select("row").unionByName(again.select("row")).select([row[c].alias(c) for c in docs.columns])
