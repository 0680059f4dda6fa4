"""Keyed lookups, code variants, bridge joins, dedup and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: built-in mapping of generic to maker codes ---
BUILT_IN_CODES = {
    "P0011": "2A81",
    "P0012": "2A82",
    "P0015": "2A87",
    "P0016": "2A88",
    "P0017": "2A89",
    "P0021": "2A8A",
    "P0022": "2A8B",
    "P0301": "29CC",
    "P0302": "29CD",
    "P0303": "29CE",
    "P0304": "29CF",
    "P0305": "29D0",
    "P0306": "29D2",
    "P0420": "420",
    "P0430": "430",
    "P0171": "171",
    "P0174": "174",
    "P0135": "135",
    "P0141": "141",
    "P0155": "155",
    "P0161": "161",
    "P2190": "2190",
    "P2192": "2192",
    "P2270": "2270",
    "P2272": "2272",
    "P6800": "6800",
    "P0442": "442",
    "P0455": "455",
    "P0101": "101",
    "P0102": "102",
    "P0103": "103",
}
# --- end of fixed values ---


def distinct_scan(df: DataFrame, col: str, like: str | None = None, limit: int | None = None) -> DataFrame:
    """A1: distinct non-empty values in order, optionally by a LIKE pattern and the first ``limit`` (none or 0: all)."""
    out = df.where(F.col(col).isNotNull() & (F.col(col) != "")).select(col).distinct()
    out = out.where(F.col(col).like(like)) if like else out
    return out.orderBy(col).limit(limit) if limit else out


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """A2, F8: the first row of each key by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of greatest ``order`` for each key, without a sort: a struct maximum."""
    rest = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(order), *rest)).alias("b"))
    return best.select(*keys, "b.*").select(*df.columns)


def page(df: DataFrame, order: list[str], skip: int = 0, limit: int = 100) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` of an explicit order."""
    return df.orderBy(*order).offset(skip).limit(limit)


def search_like(df: DataFrame, cols: list[str], needle: str, limit: int | None = 100, order: str | None = None) -> DataFrame:
    """Distinct rows with the text, of any case, in one of the columns."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False)) for c in cols])
    out = df.where(hit).dropDuplicates()
    out = out.orderBy(order) if order else out
    return out.limit(limit) if limit else out


def layered_map(*layers: DataFrame) -> DataFrame:
    """``(key, value)`` of all layers, later layers over earlier ones."""
    ranked = reduce(DataFrame.unionByName, [d.select("key", "value").withColumn("__layer", F.lit(i)) for i, d in enumerate(layers)])
    return ranked.groupBy("key").agg(F.max_by("value", "__layer").alias("value"))


def built_in_map(spark) -> DataFrame:
    return spark.createDataFrame(list(BUILT_IN_CODES.items()), "key string, value string")


def lookup_variants(code: Column, mapped: Column) -> Column:
    """H1: the code, its mapped codes (comma-separated), its suffix if it is P and four hex digits, and that without
    leading zeros; distinct, in this order."""
    c = F.upper(F.trim(code))
    suffix = F.nullif(F.regexp_extract(c, "^P([0-9A-F]{4})$", 1), F.lit(""))
    bare = F.when(suffix.startswith("0"), F.coalesce(F.nullif(F.regexp_replace(suffix, "^0+", ""), F.lit("")), F.lit("0")))
    listed = F.coalesce(F.transform(F.split(mapped, ","), lambda x: F.trim(x)), F.array().cast("array<string>"))
    every = F.concat(F.array(c), listed, F.array(suffix), F.array(bare))
    return F.array_distinct(F.filter(every, lambda v: v.isNotNull() & (v != "")))


def expand_codes(rows: DataFrame, mapping: DataFrame, code_col: str = "code") -> DataFrame:
    """Rows by variant of their code, ``variant_no`` from 0. The mapping is joined by code; Spark broadcasts it if small."""
    key = F.upper(F.trim(F.col(code_col)))
    joined = rows.join(mapping.withColumnsRenamed({"key": "__key", "value": "__mapped"}), key == F.col("__key"), "left")
    return joined.select(*rows.columns, F.posexplode(lookup_variants(F.col(code_col), F.col("__mapped"))).alias("variant_no", "variant"))


def first_variant_match(expanded: DataFrame, facts: DataFrame, on: str, keys: list[str]) -> DataFrame:
    """D3: facts of the first variant of each key that has any; duplicates are kept."""
    hits = expanded.join(facts, expanded["variant"] == facts[on])
    w = Window.partitionBy(*keys)
    return hits.withColumn("__first", F.min("variant_no").over(w)).where("variant_no = __first").drop("__first")


def codes_of(bridge: DataFrame, codes: DataFrame, on: str, group: str, code: str) -> DataFrame:
    """Distinct codes of each group through a bridge table, sorted and joined by commas."""
    return bridge.join(codes, on).groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(code)), ",").alias("codes"), F.count_distinct(code).alias("n_codes"))


def conditional_upsert(current: DataFrame, staged: DataFrame, key: str = "source_url") -> DataFrame:
    """B2: insert new keys; overwrite an old row only if the staged one is more certain, turns the outcome to success,
    or brings a first summary. Of several staged rows of a key, that of greatest confidence counts, then of the latest
    arrival. ``source_type`` and ``created_at`` of an old row stay.

    Both sides have ``confidence, outcome, summary, source_type, created_at``; staged also ``arrival``.
    """
    last = first_per_key(staged, [key], [F.desc_nulls_last("confidence"), F.desc("arrival")]).drop("arrival")
    c, s = current.alias("c"), last.alias("s")
    both = c.join(s, F.col(f"c.{key}") == F.col(f"s.{key}"), "full")
    had, got = F.col(f"c.{key}").isNotNull(), F.col(f"s.{key}").isNotNull()
    better = (
        (F.coalesce(F.col("s.confidence"), F.lit(0.0)) > F.coalesce(F.col("c.confidence"), F.lit(0.0)))
        | ((F.col("s.outcome") == "success") & ~F.col("c.outcome").eqNullSafe("success"))
        | (F.col("c.summary").isNull() & F.col("s.summary").isNotNull())
    )
    take = got & (~had | F.coalesce(better, F.lit(False)))
    fixed = {"source_type", "created_at"}
    return both.select(
        F.coalesce(F.col(f"c.{key}"), F.col(f"s.{key}")).alias(key),
        *[F.when(take & (~had if x in fixed else F.lit(True)), F.col(f"s.{x}")).otherwise(F.col(f"c.{x}")).alias(x) for x in current.columns if x != key],
        F.when(~had, "inserted").when(take, "updated").otherwise("kept").alias("action"),
    )


def upsert_by_key(current: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """Staged rows over current ones of the same key."""
    return current.join(staged, key, "left_anti").unionByName(staged)


def patch_events(events: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """Each key's latest non-null value of every column: create-or-patch as an event log."""
    return events.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols], F.max(order).alias(order))


def attempts(events: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """The latest status and the number of attempts of each key."""
    return events.groupBy(key).agg(F.max_by(status, order).alias("status"), F.count("*").alias("attempts"))


def missing_keys(wanted: DataFrame, key: str, *known: DataFrame) -> DataFrame:
    """Wanted keys that none of the tables has."""
    have = reduce(DataFrame.union, [k.select(key) for k in known]).distinct()
    return wanted.join(have, key, "left_anti")


def metadata_predicate(filters: dict) -> Column | None:
    """Equality for scalars, overlap for lists (blank values are ignored), all of them together; None for nothing."""
    parts = []
    for name, value in filters.items():
        if isinstance(value, (list, tuple, set)):
            values = [str(v).strip() for v in value if str(v).strip()]
            if values:
                parts.append(F.arrays_overlap(F.col(name), F.array(*[F.lit(v) for v in values])))
        else:
            parts.append(F.col(name) == F.lit(value))
    return reduce(lambda a, b: a & b, parts) if parts else None
