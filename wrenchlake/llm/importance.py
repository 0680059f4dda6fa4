"""Target-distribution importance resampling over hashed word n-grams: DuckDB counts in tasks, Spark merges and scores."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, ShortType, StructField, StructType

from wrenchlake.llm.common import bounded_batches, stored, text_of

BUCKETS = 10_000
#: Characters of text that one DuckDB query gets; longer texts are cut at a separator.
SLICE = 1 << 18
MEMORY = "512MB"
#: What separates words, as classes without brackets, before and after A-Z are lower-cased.
BEFORE, AFTER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F", r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WORD, GAP = re.compile(f"[^{BEFORE}]+"), re.compile(f"[{BEFORE}]")

COUNTS = f"""
    WITH texts AS (SELECT piece, row, context,
                          regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{AFTER}]+') AS words FROM batch),
    placed AS (SELECT piece, row, context, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM texts),
    runs AS MATERIALIZED (
        SELECT row, context, place, word, lag(word, 1) OVER w AS word_1, lag(word, 2) OVER w AS word_2
        FROM placed WINDOW w AS (PARTITION BY piece ORDER BY place)),
    features AS (
        SELECT row, word AS feature FROM runs WHERE place > context
        UNION ALL SELECT row, word_1 || ' ' || word FROM runs WHERE place > context AND word_1 IS NOT NULL
        UNION ALL SELECT row, word_2 || ' ' || word_1 || ' ' || word FROM runs WHERE place > context AND word_2 IS NOT NULL)
    SELECT row, zlib_crc32(encode(feature)) % {BUCKETS} AS bucket, count(*) AS n FROM features GROUP BY ALL"""


def _crc32(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return pa.array(np.fromiter(map(zlib.crc32, values.to_numpy(zero_copy_only=False)), np.int64, len(values)))


def connect() -> duckdb.DuckDBPyConnection:
    """A task's own database, in memory, of one thread and bounded memory, with zlib's CRC-32 as a function."""
    con = duckdb.connect(config={"threads": "1", "memory_limit": MEMORY})
    con.create_function("zlib_crc32", _crc32, ["BLOB"], "BIGINT", type="arrow")
    return con


def pieces(text: str, limit: int = SLICE) -> Iterator[tuple[int, str]]:
    """The text in pieces of about ``limit`` characters, none of which ends within a word, each with the (at most two) words before it put in
    front and their number: an n-gram belongs to the piece of its last word."""
    at, before = 0, []
    while True:
        gap = GAP.search(text, at + limit) if at + limit < len(text) else None
        part = text[at : gap.start()] if gap else text[at:]
        yield len(before), " ".join([*before, part])
        if gap is None:
            return
        at, before = gap.start(), (before + WORD.findall(part))[-2:]


def _batches(texts: list[str]) -> Iterator[pa.Table]:
    """Tables of (piece, row, context, text) of bounded size."""
    rows, size = [], 0
    for row, text in enumerate(texts):
        for context, part in pieces(text):
            if rows and size + len(part) > SLICE:
                yield _table(rows)
                rows, size = [], 0
            rows.append((row, context, part))
            size += len(part)
    if rows:
        yield _table(rows)


def _table(rows: list[tuple[int, int, str]]) -> pa.Table:
    of = list(zip(*rows, strict=True))
    return pa.table({"piece": pa.array(range(len(rows)), pa.int32()), "row": pa.array(of[0], pa.int32()), "context": pa.array(of[1], pa.int32()), "text": pa.array(of[2], pa.string())})


def _counts(con: duckdb.DuckDBPyConnection, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, n) by row and bucket, each pair once."""
    keys, ns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for batch in _batches(texts):
        con.register("batch", batch)
        got = con.sql(COUNTS).fetchnumpy()
        con.unregister("batch")
        keys.append(got["row"].astype(np.int64) * BUCKETS + got["bucket"].astype(np.int64))
        ns.append(got["n"].astype(np.int64))
    key, n = np.concatenate(keys), np.concatenate(ns)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    if len(first) < len(key):  # a text in several pieces has a bucket several times
        key, n = key[first], np.add.reduceat(n, first)
    return key // BUCKETS, key % BUCKETS, n


def bucket_counts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row's other columns with ``buckets`` (ascending) and ``counts``: how many of the text's runs of one to three words have each bucket.

    One pass in tasks: DuckDB takes the words apart, makes the runs by a window and counts buckets, a batch of bounded size at a time. Null
    texts have none. No shuffle.
    """
    bounded_batches()
    keep = [f for f in rows.schema.fields if f.name != text_col]
    names = [f.name for f in keep]
    schema = StructType([*keep, StructField("buckets", ArrayType(ShortType(), False), False), StructField("counts", ArrayType(IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        try:
            for batch in batches:
                row, bucket, n = _counts(con, batch.column(text_col).to_pylist())
                ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (bucket.astype(np.int16), n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *lists], [*names, "buckets", "counts"])
        finally:
            con.close()

    return rows.withColumn(text_col, text_of(text_col)).select(*names, text_col).mapInArrow(run, schema)


def merged(spilled: DataFrame) -> DataFrame:
    """``(bucket, n)`` over all rows of stored bucket counts: one partial sum a bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("buckets").flatten().to_numpy(), batch.column("counts").flatten().to_numpy(), BUCKETS).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    return spilled.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> list[int]:
    """By bucket ``floor(1000 * ln((t+1) * (S+B) / ((s+1) * (T+B))))`` for counts s of S and t of T, B the number of buckets. The result has
    ``BUCKETS`` longs whatever the input."""
    of_s, of_t = merged(corpus).withColumnRenamed("n", "s"), merged(target).withColumnRenamed("n", "t")
    both = of_s.join(of_t, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    every = both.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left").fillna(0)
    sums = every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1.0) * (F.col("all_s") + float(BUCKETS)) / ((F.col("s") + 1.0) * (F.col("all_t") + float(BUCKETS)))
    found = dict(every.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain")).collect())  # sums is one row
    return [found[b] for b in range(BUCKETS)]


def weighted(spilled: DataFrame, gain: list[int]) -> DataFrame:
    """The rows with ``n_features`` and ``weight``, the sum of gains over their features, in place of the counts."""
    by_bucket = np.array(gain, np.int64)
    keep = [f for f in spilled.schema.fields if f.name not in ("buckets", "counts")]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("counts").flatten().to_numpy().astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (n, n * by_bucket[batch.column("buckets").flatten().to_numpy()])]
            ends = np.concatenate([[0], np.cumsum(batch.column("buckets").value_lengths().to_numpy())]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(x[ends[1:]] - x[ends[:-1]]) for x in sums]], [*names, "n_features", "weight"])

    schema = StructType([*keep, *[StructField(c, LongType(), False) for c in ("n_features", "weight")]])
    return spilled.mapInArrow(run, schema)


def ranked(rows: DataFrame, order: list, rank: str = "rank") -> DataFrame:
    """``rows`` with the place of each in ``order``, from 1, without one task that sees them all: sorted by range partitions, whose sizes (one row
    each) the driver adds up. Rows that are equal in ``order`` are dealt to partitions by a number of their own. ``rows`` must be stored."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.withColumn("__own", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(parts, *order, F.col("__own")).sortWithinPartitions(*order, F.col("__own")).drop("__own")
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(dealt.withColumns({"__part": F.spark_partition_id(), "__nth": nth}), "importance-ranked")
    sizes, before, at = dict(placed.groupBy("__part").count().collect()), [], 0
    for part in sorted(sizes):
        before.append((part, at))
        at += sizes[part]
    offsets = F.broadcast(spark.createDataFrame(before, "__part int, __before long"))  # a row a partition
    return placed.join(offsets, "__part").withColumn(rank, F.col("__before") + F.col("__nth") + 1).drop("__part", "__nth", "__before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Every document with the importance of its n-grams for the target texts, and the rank of those drawn: ``(doc_id, n_features, weight, score, rank)``.

    Features are runs of one to three words; ``weight`` sums each one's log ratio of its bucket's share of the target's features to that of
    the documents'. ``score`` adds Gumbel noise from a hash of seed and id, so taking the highest scores draws without replacement
    in proportion to the exponential of a thousandth of the weight. Of the documents with at least ``min_words`` words, ``percent`` of a hundred are drawn
    (rounded down), ties going to the smaller id; ``rank`` is null for the others.

    The texts are read once: their bucket counts are written in the shared folder (about as large as the compressed texts), and merged and
    scored from there. Null and empty texts have no features and weight 0. A null id hashes as an empty text and comes after others of its score.
    Repeated rows are documents of their own, with the same score. An empty target makes all buckets
    equally rare in it. An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    spilled = stored(bucket_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "importance-documents")
    wanted = stored(bucket_counts(target.select(F.col(target_col).alias("text"))), "importance-target")
    scored = weighted(spilled, gains(spilled, wanted))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    # n words have 3n - 3 runs of up to three, from two words on
    words = F.when(F.col("n_features") < 2, F.col("n_features")).otherwise(F.expr("(n_features + 3) div 3"))
    scored = stored(scored.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (words >= min_words).alias("enough")), "importance-scored")
    fit, rest = scored.where("enough").drop("enough"), scored.where("not enough").drop("enough")
    drawn = percent * fit.count() // 100
    in_order = ranked(fit, [F.desc("score"), F.asc_nulls_last("doc_id")])
    return in_order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest.withColumn("rank", F.lit(None).cast("long")))
