"""I-Match fingerprints over randomised lexicons, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchlake.llm.common import stored, text_of

#: The lexicon's band: terms in at least this and at most that share of the documents (inverse document frequencies
#: ln(1/0.2) to ln(1/0.002)). The lower share bounds the lexicon: it has at most 500 times the mean number of
#: distinct terms of a document, whatever the corpus's size.
LEAST_SHARE, MOST_SHARE = 0.002, 0.2
#: Randomised lexicon subsets: that of level v and number k holds a term with probability 2**-v, by a hash of both. A
#: document of n terms uses LEVELS levels from log2(n) on, SUBSETS subsets each, which hold from 2 down to an
#: eighth of a term on average: of fewer most would be empty, and of more any edit changes the hash.
LEVELS, SUBSETS = 4, 4
SLOTS = 1 << 14
HEX = 8


#: Characters that end terms, besides the space.
SEPARATORS = "\n\t\r.,;:!?()|"


def terms(text: Column) -> Column:
    """Distinct terms as hashes, in order of appearance: what stands between separators in the lower-cased text.

    Separators become spaces one after the other and the text is split at a single character: both are plain scans,
    several times as fast as a regular expression.
    """
    words = F.lower(text)
    for c in SEPARATORS:
        words = F.replace(words, F.lit(c), F.lit(" "))
    hashes = F.transform(F.split(words, " "), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit("")))


def lexicon(documents: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """One row ``(version, slots)``: the hashes of the terms in the band, of all documents, dealt into ``SLOTS`` small
    arrays. ``documents`` has ``terms``. Counts are pre-aggregated by task before the shuffle; only the
    bounded band is gathered. A term must be in two documents at least."""
    n = documents.count()
    df = documents.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = df.where((F.col("df") >= max(2, least * n)) & (F.col("df") <= max(2, most * n)))
    slots = band.groupBy(F.col("term").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")).agg(F.collect_list("term").alias("own"))
    every = documents.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(slots, "slot", "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("own", F.array().cast("array<bigint>")).alias("own")))).alias("all"))
    return stored(row.select(F.lit(1).alias("version"), F.transform("all", lambda s: s["own"]).alias("slots")), "imatch-lexicon")


def _band(terms_col: Column, slots: Column) -> Column:
    """The terms in the band, sorted. A text without band terms uses all of its terms instead."""
    band = F.filter(terms_col, lambda t: F.array_contains(F.get(slots, t.bitwiseAND(F.lit(SLOTS - 1)).cast("int")), t))
    return F.sort_array(F.when(F.size(band) > 0, band).otherwise(terms_col))


def _subsets(used: Column) -> Column:
    """One entry for each subset that holds terms: its number, and the hash of those terms in order, in hexadecimal."""
    low = F.floor(F.log2(F.size(used))).cast("int")
    numbers = F.sequence(low * SUBSETS, (low + LEVELS) * SUBSETS - 1)

    def entry(number: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(number / SUBSETS).cast("int")) - 1
        own = F.filter(used, lambda t: F.xxhash64(t, number).bitwiseAND(mask) == 0)
        digest = F.right(F.lpad(F.lower(F.hex(F.xxhash64(own))), 16, "0"), F.lit(HEX))
        return F.when(F.size(own) > 0, F.concat(F.lpad(number.cast("string"), 3, "0"), F.lit(":"), digest))

    return F.when(F.size(used) == 0, F.array().cast("array<string>")).otherwise(F.array_compact(F.transform(numbers, entry)))


def _printed(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df``, which has the lexicon's ``slots``, with the fingerprint of column ``text`` as array ``name``."""
    df = df.withColumn("__terms", terms(F.col(text)))
    df = df.withColumn("__band", _band(F.col("__terms"), F.col("slots")))
    return df.withColumn(name, _subsets(F.col("__band"))).drop("__terms", "__band")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that hold terms of either text; 1 for two empty fingerprints."""
    number = lambda e: F.substring(e, 1, 3)
    either = F.size(F.array_union(F.transform(a, number), F.transform(b, number)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either).cast("double")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, hashes)`` per row of ``docs``; null texts count as empty, other columns are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), terms(text_of(text_col)).alias("terms"))
    found = F.broadcast(lexicon(rows))  # bounded by LEAST_SHARE
    return _printed(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("version", F.lit(1)).join(found, "version"), "text", "hashes").select("doc_id", "hashes")


def by_range(docs: DataFrame, parts: int) -> DataFrame:
    """``docs(doc_id, text)`` with ``part``, the number of the range of ids that a row is in.

    Ranges come from approximate percentiles, so that each part's rows are ordered within one task of bounded size; ids
    are near unique.
    """
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.coalesce(F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("doc_id"))), F.lit(-1)) if cuts else F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    return docs.withColumn("part", part.cast("int"))


def compare_edited(docs: DataFrame, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document's, by
    ascending id (nulls first, ties by text; after the last the first). Texts are shuffled once, by ranges of the id;
    the neighbour across a range's border comes from a table of each range's first row. Null texts count as
    empty. Repeated rows follow each other. A single document is its own next. Other columns are not read, whatever their names; an empty table gives an empty one. No Python runs on the
    executors. Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    found = F.broadcast(lexicon(rows.select(terms(F.col("text")).alias("terms"))))  # bounded by LEAST_SHARE
    dealt = by_range(rows, parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    firsts = dealt.groupBy("part").agg(F.min_by("text", F.struct("doc_id", "text")).alias("first_text"))
    firsts = stored(firsts, "imatch-firsts")  # a row a part
    # a row a part: the part before takes the first row of the next, the last part that of the first
    order, every = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = firsts.select(F.coalesce(F.lag("part").over(order), F.last("part").over(every)).alias("part"), "first_text")
    border = before.withColumn("version", F.lit(1)).join(found, "version")
    border = _printed(border, "first_text", "first_hashes").select("part", "first_text", "first_hashes")

    in_part = Window.partitionBy("part").orderBy("doc_id", "text")
    x = dealt.withColumn("version", F.lit(1)).join(found, "version")
    x = _printed(x, "text", "hashes").drop("slots")
    x = x.withColumn("next_text", F.lead("text").over(in_part)).withColumn("next_hashes", F.lead("hashes").over(in_part)).withColumn("last", F.lead(F.lit(1)).over(in_part).isNull())
    x = x.join(F.broadcast(border), "part")  # a row a part, with the text of one document
    x = x.withColumn("next_text", F.when(F.col("last"), F.col("first_text")).otherwise(F.col("next_text")))
    x = x.withColumn("next_hashes", F.when(F.col("last"), F.col("first_hashes")).otherwise(F.col("next_hashes")))
    n = F.length("text").cast("long")
    x = x.withColumn("n_chars", n).withColumn("q", F.floor(n / 4).cast("int"))
    x = x.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("q")).cast("int")), F.substring(F.col("next_text"), F.lit(1), F.col("q"))))
    x = _printed(x.join(found, "version"), "edited", "edited_hashes")
    return x.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.array_join("hashes", " ").alias("fingerprint"), F.array_join("edited_hashes", " ").alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
