"""Fuzzy line deduplication by MinHash, in DataFrame functions."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlake.llm.common import small, stored, text_of
from wrenchlake.llm.components import connected_components, merged

#: Characters (UTF-16 units) of a shingle; a shorter line has one shingle, itself.
SHINGLE = 8
#: Lines are linked at this Jaccard similarity of their sets of shingles.
SIMILARITY = 0.8
#: Minima of a line. A band takes four of them, ``STEPS`` from its first on, around the circle; two bands share one minimum at most. Lines that aren't
#: alike, of 0.1 for example, share a band with probability 0.1**4 a band: with three minima a band, such pairs outnumber near copies from some million lines on.
MINIMA = 24
STEPS = (0, 1, 4, 6)
#: A pair at exactly that similarity shares one of these bands with probability 0.997.
BANDS = [[(first + step) % MINIMA for step in STEPS] for first in range(MINIMA) if first % 4 != 3]
#: Lines of more places than this are signed by one hash function, whose values are dealt into bins of a minimum each; those of up to
#: ``LONG / SIMILARITY`` by ``MINIMA`` hash functions. Lines between are signed both ways, so that any two alike share one.
LONG = 96
#: Of a long line only so many shingles a bin, those of least hash, are looked at: the others hardly ever are a minimum.
IN_BIN = 4
#: A long line with fewer bins filled repeats itself; it is signed as short ones are, too.
FILLED = MINIMA * 3 // 4

_rng = random.Random(4)
#: Hash functions of short lines: a shingle's hash XOR a mask, times an odd factor modulo 2**32. By masks alone the minima
#: depend on each other.
MASKS = [_rng.getrandbits(32) - (1 << 31) for _ in range(MINIMA)]
FACTORS = [_rng.getrandbits(31) | 1 for _ in range(MINIMA)]
#: Before all pairs between a bucket's components are met, lines are tried with so many of its largest, so often, while there are more pairs
#: than so many a line: to look at so many costs less than a round does. Every pair is met in the end, whatever these are.
SOME, ROUNDS, PAIRS = 4, 3, 64
#: Bits of a key that aren't counted at first: 40 are.
KEPT = 24
#: Longs of a line's bitmap of shingles. Two of them and the keys make rows of over 100 columns, for which Spark compiles the bounds in
#: small methods instead of a single one that is too long for the JVM to optimise.
SKETCH = 48


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text_key, line_no, line)``: lines that aren't blank, trimmed and lower-cased."""
    text = text_of(text_col)
    split = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(F.lower(text), "\n")).alias("line_no", "line"))
    return split.withColumn("line", F.trim("line")).where("line <> ''").withColumn("line_id", F.xxhash64("line"))


def _hashed(lines: DataFrame, keep: list[str], hashed: str, where: str = "true", unit: int = 2) -> DataFrame:
    """One row per shingle of the lines, which have ``units`` (the text in units of so many bytes) and ``last`` (where the last shingle begins), with ``h``,
    its hash by the function named. Generated code, not a lambda: the array of places is exploded."""
    placed = lines.select(*keep, "units", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(unit))).alias("i"))
    return placed.select(*keep, F.expr(f"{hashed}(substring(units, i, {unit * SHINGLE}))").alias("h")).where(where)


def _in_units(lines: DataFrame) -> DataFrame:
    """The lines with ``units``, ``last`` and ``n``, the number of shingles, repeats included."""
    rows = lines.withColumn("units", F.encode(F.col("line"), "UTF-16BE"))
    return rows.withColumn("last", F.greatest(F.lit(1), F.octet_length("units") - 2 * SHINGLE + 1)).withColumn("n", F.expr("(last + 1) div 2"))


def _in_bytes(lines: DataFrame) -> DataFrame:
    """The same with UTF-8 bytes for units, for signing: half the work for the same windows where the text is ASCII, and elsewhere windows of fewer characters, each
    part of a shingle. ``n`` is still the number of shingles."""
    length = F.when(F.octet_length("line") == F.length("line"), F.length("line")).otherwise(F.expr("octet_length(encode(line, 'UTF-16BE')) div 2").cast("int"))
    rows = lines.withColumn("units", F.col("line").cast("binary")).withColumn("n", F.greatest(F.lit(1), length - SHINGLE + 1))
    return rows.withColumn("last", F.greatest(F.lit(1), F.octet_length("units") - SHINGLE + 1))


def _shingles(line: Column) -> Column:
    """The 64-bit hashes of a line's shingles, distinct. The encoded line is bound once, not encoded anew for each place."""

    def of(units: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(units) - 2 * SHINGLE + 1), F.lit(2))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substring(units, i, F.lit(SHINGLE * 2)))))

    return F.element_at(F.transform(F.array(F.encode(line, "UTF-16BE")), of), 1)


def _alike(a: Column, b: Column) -> Column:
    """Whether two sets at hand have a Jaccard similarity of at least ``SIMILARITY``. What they share is made once."""
    return (1 + SIMILARITY) * F.size(F.array_intersect(a, b)) + 1e-6 >= SIMILARITY * (F.size(a) + F.size(b))


def _similar(a: Column, b: Column) -> Column:
    """The same of sets yet to be made; each is made once."""
    return F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: _alike(p["a"], p["b"])), 1)


def _permuted(k: int) -> str:
    """The k-th hash function of a shingle's 32-bit hash ``h``."""
    return f"bigint(h ^ {MASKS[k]}) * {FACTORS[k]}L & 4294967295L"


def _sketches(texts: DataFrame) -> DataFrame:
    """``(line_id, size, s0, ..., line, bits)``: how many shingles a line has, repeats included, and a bitmap of their hashes. Where one bitmap has a bit
    that the other lacks, a shingle is in one set only, so they bound the sets' difference from below."""
    at = F.pmod("h", F.lit(64 * SKETCH)).cast("int")
    placed = _hashed(_in_units(texts), ["line_id"], "xxhash64").select("line_id", at.alias("at"))
    placed = placed.select("line_id", F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, at & 63)").alias("bit"))
    words = [F.expr(f"coalesce(bit_or(bit) filter (where word = {i}), 0L)").alias(f"s{i}") for i in range(SKETCH)]
    made = placed.groupBy("line_id").agg(F.count("*").alias("size"), *words)
    made = made.join(texts.select("line_id", "line"), "line_id")
    # bits comes last: names given to the words after it would multiply what the optimizer knows of it
    return made.withColumn("bits", reduce(Column.__add__, [F.bit_count(f"s{i}") for i in range(SKETCH)]))


def _possible() -> Column:
    """Whether two sketched sets can have the least similarity; never false for those that have it. A set has at most ``size``
    and at least as many shingles as ``bits`` set. The bounds that cost least come first."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(SKETCH)])
    most = F.expr(f"({1 - SIMILARITY} * (a_size + b_size) + 1e-6) / {1 + SIMILARITY}")
    near = F.expr(f"a_size + 1e-6 >= {SIMILARITY} * b_bits and b_size + 1e-6 >= {SIMILARITY} * a_bits")
    return near & (F.abs(F.col("a_bits") - F.col("b_bits")) <= most) & (differ <= most)


def _signed(lines: DataFrame, kinds: Column) -> DataFrame:
    """``(line_id, keys, collides, kind, filled)``: per line and kind (0: short, 1: long) one hash a band whose minima are all there."""
    rows = _in_bytes(lines.select("line_id", F.xxhash64("line", F.lit(1)).alias("check_id"), "line"))
    rows = rows.select("line_id", "check_id", "units", "last", "n", F.explode(kinds).alias("kind"))
    below = F.least(F.lit(2.0**31 - 1), F.lit(2.0**32) * (IN_BIN * MINIMA) / F.col("last") - 2.0**31).cast("int")
    rows = rows.withColumn("below", F.when(F.col("kind") == 0, F.lit((1 << 31) - 1)).otherwise(below))
    hashed = _hashed(rows, ["line_id", "check_id", "kind", "below"], "hash", "h <= below", unit=1)
    hashed = hashed.withColumn("bin", F.when(F.col("kind") == 0, -1).otherwise(F.shiftright(F.col("h").bitwiseAND(F.lit(0xFFFF)) * MINIMA, 16)))
    lows = [F.expr(f"min(if(bin = -1, {_permuted(k)}, bigint(h))) filter (where bin = {k} or bin = -1)").alias(f"m{k}") for k in range(MINIMA)]
    signed = hashed.groupBy("line_id", "kind").agg(*lows, *[F.expr(f"{f}(check_id) filter (where bin <= 2)").alias(f) for f in ("min", "max")])
    of_band = lambda band: [F.col(f"m{k}") for k in band]
    whole = lambda band: reduce(Column.__and__, [c.isNotNull() for c in of_band(band)])
    keys = [F.when(whole(band), F.xxhash64(F.col("kind") * len(BANDS) + b, *of_band(band))) for b, band in enumerate(BANDS)]
    filled = reduce(Column.__add__, [F.col(f"m{k}").isNotNull().cast("int") for k in range(MINIMA)])
    return signed.select("line_id", F.array_compact(F.array(*keys)).alias("keys"), F.coalesce(F.col("min") != F.col("max"), F.lit(False)).alias("collides"), "kind", filled.alias("filled"))


def signatures(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(line_id, keys, collides)``: one hash a band for each way a line is signed, and ``(line_id)`` of the lines that are signed too weakly.

    Shingles are exploded and their minima are aggregated within the task that made them; one row a line and task is
    shuffled. Long lines are signed by one hash function, short ones, those between and those that repeat few shingles by several (see
    ``LONG``). Lines that repeat few shingles without having been told are the weak ones: they are to be signed as short ones, too, once
    their text is at hand. Two lines of one id (a collision of 64-bit hashes) are marked: they are handled as lines without near copies,
    exactly, by ``decide``."""
    n = F.col("n")
    # most lines that repeat themselves are told by how often they hold what stands at three places
    piece = lambda k: F.substring(F.col("line"), F.expr(f"length(line) * {k} div 8 + 1"), F.lit(SHINGLE))
    often = lambda k: F.octet_length("line") - F.octet_length(F.replace(F.col("line"), piece(k), F.lit(""))) >= 4 * SHINGLE
    repeats = often(1) | often(4) | often(6)
    kinds = F.when(n <= LONG, F.array(F.lit(0))).when((n <= LONG / SIMILARITY) | repeats, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    signed = stored(_signed(lines, kinds), "lines-signed")
    both = signed.where("kind = 0").select("line_id")
    weak = signed.where((F.col("kind") == 1) & (F.col("filled") < FILLED) & ~F.col("collides")).select("line_id").join(both, "line_id", "left_anti")
    return signed.select("line_id", "keys", "collides"), stored(weak, "lines-weak")


def buckets(signed: DataFrame) -> DataFrame:
    """``(key, low, line_id)``: the members of each bucket of two lines or more, with its smallest line; of buckets of equal members one stays.

    Most keys are one line's, so counts of their upper 40 bits go through the shuffle before any line's id does."""
    banded = signed.where("not collides").select("line_id", F.explode("keys").alias("key")).withColumn("top", F.shiftright("key", KEPT))
    often = stored(banded.groupBy("top").agg(F.count("*").alias("n")).where("n > 1").select("top"), "lines-tops")
    likely = stored(banded.join(small(often), "top").select("key", "line_id"), "lines-bucketed")
    shared = likely.groupBy("key").agg(F.min("line_id").alias("low"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("line_id")).alias("all")).where("n > 1")
    shared = stored(shared.groupBy("low", "n", "all").agg(F.min("key").alias("key")).select("key", "low"), "lines-buckets")
    return stored(likely.join(small(shared), "key").select("key", "low", "line_id"), "lines-members")


def _more_buckets(signed: DataFrame, weak: DataFrame, texts: DataFrame) -> DataFrame:
    """The buckets that weak lines are in when they are signed as short ones."""
    again = stored(_signed(texts.join(small(weak), "line_id", "left_semi"), F.array(F.lit(0))).select("line_id", "keys", "collides"), "lines-signed-again")
    asked = small(stored(again.select(F.explode("keys").alias("key")).distinct(), "lines-weak-keys"))
    banded = signed.where("not collides").select("line_id", F.explode("keys").alias("key")).join(asked, "key", "left_semi")
    return buckets(banded.select("line_id", F.array("key").alias("keys"), F.lit(False).alias("collides")).unionByName(again))


def near_lines(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``(node, component)`` of lines that have a verified near copy; ``texts(line_id, line)`` holds the lines of the buckets, once each.

    Lines that share a key are candidates. Each is first compared with the smallest line of its bucket. Where
    that leaves buckets in several components with many pairs between them, the lines outside a bucket's largest component are compared with
    ``SOME`` lines of it, in one of the buckets that have the same largest, and components are contracted, up to ``ROUNDS`` times and while that
    halves the pairs. At last the
    lines outside the largest are compared with all of their bucket's lines of other components, each pair in one of the buckets that it shares.
    So every candidate pair is verified or already connected, and a bucket of copies of one line needs about as many comparisons as it has lines.
    Verified are exact Jaccard similarities of sets of 64-bit hashes; the last pairs only where sizes and sketches don't rule the similarity out.
    """

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(texts.select(F.col("line_id").alias("src"), F.col("line").alias("a")), "src").join(texts.select(F.col("line_id").alias("dst"), F.col("line").alias("b")), "dst")
        return stored(both.where(_similar(_shingles(F.col("a")), _shingles(F.col("b")))).select("src", "dst"), "lines-verified")

    star = members.where("line_id > low").select(F.col("low").alias("src"), F.col("line_id").alias("dst"))
    parts = stored(connected_components(verified(star)), "lines-parts")
    before = float("inf")
    for step in range(ROUNDS + 1):
        placed = members.join(small(parts), F.col("line_id") == F.col("node"), "left").select("key", "line_id", F.coalesce("component", "line_id").alias("part"))
        by_part = placed.groupBy("key", "part").agg(F.count("*").alias("n"))
        # the largest component of a bucket, ties to the smallest: counts and numbers only
        largest = by_part.groupBy("key").agg(F.max(F.struct("n", (-F.col("part")).alias("neg"))).alias("x"), F.count("*").alias("parts"), F.sum("n").alias("all")).where("parts > 1")
        main = stored(largest.select("key", (-F.col("x.neg")).alias("main"), (F.col("all") * (F.col("all") - F.col("x.n"))).alias("pairs")), "lines-main")
        split = stored(placed.join(small(main.drop("pairs")), "key"), "lines-split")
        todo, lines_in = main.agg(F.sum("pairs")).first()[0] or 0, split.count()
        if step == ROUNDS or todo <= PAIRS * lines_in or 2 * todo > before:
            break
        before = todo
        chosen = [F.min_by("line_id", F.xxhash64("line_id", F.lit(step * SOME + k))).alias(f"r{k}") for k in range(SOME)]
        some = split.where("part = main").groupBy("key").agg(*chosen).select("key", F.explode(F.array_distinct(F.array(*[f"r{k}" for k in range(SOME)]))).alias("src"))
        tried = split.where("part <> main").groupBy("main", F.col("line_id").alias("dst")).agg(F.min("key").alias("key")).join(some, "key").select("src", "dst")
        parts = stored(merged(parts, verified(tried)), "lines-parts")
    open_lines = stored(split.select("line_id").distinct(), "lines-open")
    sketches = stored(_sketches(texts.join(small(open_lines), "line_id", "left_semi")), "lines-sketches")
    of = lambda side: sketches.withColumnsRenamed({c: f"{side}_{c}" for c in sketches.columns if c != "line_id"})
    return merged(parts, stored(_across(split, of("a"), of("b")), "lines-verified"))


def _across(split: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``(src, dst)``: the pairs of similar lines that share a bucket of ``split(key, line_id, part, main)`` and lie in different components, each met once.

    Whether a pair lies in different components doesn't depend on the bucket, so it is met in the one of least key of those that both lines are in. A line
    is in as many buckets as it has bands at most. ``a`` and ``b`` are the lines' sketches, with names for either side. What costs least is asked first, the
    sets' own similarity last; both within the join, so that only links leave it. Sets are made where a bucket's lines meet, once a line and bucket."""
    keys = stored(split.groupBy("line_id").agg(F.collect_set("key").alias("keys")), "lines-keys")
    placed = split.join(keys, "line_id")
    apart = placed.where("part <> main").withColumnRenamed("keys", "a_keys").join(a, "line_id").withColumnRenamed("line_id", "one")
    others = placed.join(b, "line_id").select("key", F.col("line_id").alias("other"), F.col("part").alias("other_part"), F.col("keys").alias("b_keys"), *[c for c in b.columns if c != "line_id"])
    apart, others = (x.repartition("key").withColumn(f"{side}_line", _shingles(F.col(f"{side}_line"))).withColumnRenamed(f"{side}_line", f"{side}_set") for x, side in ((apart, "a"), (others, "b")))
    once = (F.col("other_part") == F.col("main")) | (F.col("one") < F.col("other"))
    least = F.array_min(F.array_intersect("a_keys", "b_keys")) == apart["key"]
    met = apart.join(others, (apart["key"] == others["key"]) & (F.col("part") != F.col("other_part")) & once & _possible() & least & _alike(F.col("a_set"), F.col("b_set")))
    return met.select(F.least("one", "other").alias("src"), F.greatest("one", "other").alias("dst"))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, drops)``: the numbers (from 0) of the lines that go, of rows that lose any.

    Of each component of lines the first occurrence stays, by (id, line number), null ids first. Equal lines are one
    line. Occurrences, not texts, are shuffled. Two lines of one 64-bit id are told apart by a second hash.
    """
    lines = _lines(docs, id_col, text_col)
    signed, weak = signatures(lines)
    members = buckets(signed)
    wanted = stored(members.select("line_id").unionByName(weak).distinct().withColumnRenamed("line_id", "wanted_id"), "lines-wanted")
    at_least = lines.select("*", F.xxhash64("line", F.lit(1)).alias("check_id")).join(small(wanted), F.col("line_id") == F.col("wanted_id"), "left")
    placed = stored(at_least.select("doc_id", "text_key", "line_no", "line_id", "check_id", F.when(F.col("wanted_id").isNotNull(), F.col("line")).alias("line")), "lines-placed")
    texts = stored(placed.where("line is not null").select("line_id", "line").distinct(), "lines-texts")
    if weak.take(1):
        more = _more_buckets(signed, weak, texts)
        members = members.unionByName(more).distinct()
        missing = stored(more.select("line_id").distinct().join(wanted, F.col("line_id") == F.col("wanted_id"), "left_anti"), "lines-missing")
        if missing.take(1):
            texts = stored(texts.unionByName(lines.select("line_id", "line").join(small(missing), "line_id", "left_semi").distinct()), "lines-texts")
    parts = stored(near_lines(members, texts), "lines-components")
    # (id, line number) as one number of fixed width, which hash aggregation can take the minimum of
    at = (F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(f"-{10**19}").cast("decimal(20,0)")) * F.lit(10**10).cast("decimal(11,0)") + F.col("line_no").cast("decimal(10,0)")).cast("decimal(38,0)")
    joined = placed.drop("line").join(small(parts), F.col("line_id") == F.col("node"), "left")
    twice = stored(signed.where("collides").select(F.col("line_id").alias("twice_id")).distinct(), "lines-collisions")  # as good as none
    joined = joined.join(small(twice), F.col("line_id") == F.col("twice_id"), "left")
    named = joined.select("doc_id", "text_key", "line_no", F.coalesce("component", "line_id").alias("part"), F.when(F.col("twice_id").isNotNull(), F.col("check_id")).otherwise(0).alias("sub"))
    first = stored(named.groupBy("part", "sub").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select("part", "sub", "first"), "lines-first")
    again = named.join(small(first), ["part", "sub"]).where(F.col("first") != at)
    return again.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one line kept of each group of near copies over all documents, and ``n_lines``, ``n_dropped``.

    Blank lines stay. A text that loses lines is what remains joined by newlines; one that loses all is empty. Null
    texts stay null, with no lines. Rows that repeat an id are one
    document as to which occurrence is first; rows that repeat id and text share their decisions. Lines end at ``\\n`` alone (a ``\\r`` before it belongs to the line). They are compared
    trimmed and lower-cased; those shorter than a shingle match only equal ones. Null ids come first. Other columns pass
    through, whatever their names, but for columns named ``n_lines`` and ``n_dropped``, which are replaced. An empty table gives an empty one.
    """
    drops = stored(decide(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("drops").alias("__drops")), "lines-drops")
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    rows, drops = docs.select([F.col(f"`{c}`") for c in columns]).alias("__docs"), small(drops).alias("__found")
    own = lambda c: F.col(f"__docs.`{c}`")
    joined = rows.join(drops, own(id_col).eqNullSafe(F.col("__found.__id")) & (F.xxhash64(F.coalesce(own(text_col).cast("string"), F.lit(""))) == F.col("__found.__key")), "left")

    def kept(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__found.__drops"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    rest = F.element_at(F.transform(F.array(F.split(own(text_col), "\n")), kept), 1)
    text = F.when(F.col("__found.__drops").isNull(), own(text_col)).otherwise(rest)
    breaks = F.octet_length(own(text_col)) - F.octet_length(F.replace(own(text_col), F.lit("\n"), F.lit("")))
    return joined.select(
        *[text.alias(c) if c == text_col else own(c).alias(c) for c in columns],
        F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col("__found.__drops")), F.lit(0)).cast("long").alias("n_dropped"),
    )
