"""Pairing of records with procedures, each procedure once: the sequential greedy, computed in distributed rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlake.shared import kept

#: Phrases that make a summary generic.
GENERIC_PHRASES = (
    "repaired better and possibly cheaper", "repaired at a local shop", "fixed it", "problem solved", "no further information", "see above", "same as above",
)


def substantive(summary: Column) -> Column:
    """Whether a trimmed summary has 40 characters or more and no generic phrase; false for null."""
    plain = F.trim(F.lower(summary))
    generic = F.lit(False)
    for phrase in GENERIC_PHRASES:
        generic = generic | plain.contains(phrase)
    return F.coalesce((F.length(F.trim(summary)) >= 40) & ~generic, F.lit(False))


def choices(records: DataFrame, bridge: DataFrame, codes_used: int = 5) -> DataFrame:
    """``(record_id, wants)``: of each of ``records(record_id, codes)`` the first procedure of each of its first ``codes_used`` non-blank codes,
    in the order of the codes. ``bridge(code, place, procedure_id)``: a code's first procedure has the least place, then id. Codes without
    any and repeats are left out; records without any procedure too."""
    first = bridge.groupBy("code").agg(F.min(F.struct("place", "procedure_id"))["procedure_id"].alias("procedure_id"))
    named = F.filter(F.transform("codes", lambda c: F.trim(c)), lambda c: c != "")
    asked = records.select("record_id", F.posexplode(F.slice(named, 1, codes_used)).alias("nth", "code"))
    found = asked.join(first, "code").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("nth", "procedure_id"))).alias("found"))  # codes_used at most
    return found.select("record_id", F.array_distinct(F.transform("found", lambda x: x["procedure_id"])).alias("wants"))


def greedy_pairs(wishes: DataFrame, most: int | None = None) -> DataFrame:
    """``(record_id, procedure_id, choice)`` as if the records of ``wishes(record_id, turn, wants)``, in order of ``turn`` and id, each took the first
    procedure of its list that none before it took; ``choice`` is its place in the list, from 1. ``most``: only the first so many pairs.

    By rounds: every record without a pair asks for its next procedure, every procedure keeps the asker of least turn, the others go on. A record that
    was refused once would be refused always, since what a procedure keeps only gets earlier; so the rounds end at what the sequential
    loop gives. A round costs one aggregation by procedure, summed up per task before the shuffle, and one join; there are as many as the longest chain of
    refusals. Null turns come last. ``wishes`` has one row a record.
    """
    turn = F.struct(F.col("turn").isNull().alias("none"), "turn", "record_id")
    state = kept(wishes.where(F.size("wants") > 0).select("record_id", turn.alias("turn"), "wants", F.lit(1).alias("choice")), "greedy")
    while True:
        asking = state.where(F.col("choice") <= F.size("wants")).withColumn("procedure_id", F.element_at("wants", F.col("choice")))
        holder = asking.groupBy("procedure_id").agg(F.min("turn").alias("held"))
        moved = asking.join(holder, "procedure_id").withColumn("refused", F.col("turn") != F.col("held"))
        moved = kept(moved.select("record_id", "turn", "wants", (F.col("choice") + F.col("refused").cast("int")).alias("choice"), "procedure_id", "refused"), "greedy")
        if not moved.where("refused").take(1):
            break
        state = moved.drop("procedure_id", "refused")
    pairs = moved.select("record_id", "procedure_id", "choice", "turn")
    return (pairs if most is None else pairs.orderBy("turn").limit(most)).drop("turn")


def procedure_of(records: DataFrame, bridge: DataFrame, procedures: DataFrame, codes_used: int = 5) -> DataFrame:
    """D20, without the once-only rule: of each of ``records(record_id, codes)`` the first procedure that any of its first codes leads to, else the least of ``procedures(procedure_id)``: ``(record_id,
    procedure_id, by_code)``."""
    found = choices(records, bridge, codes_used).select("record_id", F.col("wants")[0].alias("procedure_id"))
    least = procedures.agg(F.min("procedure_id").alias("any_id"))
    joined = records.select("record_id").join(found, "record_id", "left").crossJoin(F.broadcast(least))  # least is one row
    return joined.select("record_id", F.coalesce("procedure_id", "any_id").alias("procedure_id"), F.col("procedure_id").isNotNull().alias("by_code"))


def fixed_negatives(samples: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """``samples(sample_id, anchor, positive, negatives)`` with exactly ``n`` negatives each, as training batches need them.

    Of more, the ``n`` of least seeded hash, in that order: a sample that is the same on every run. Of fewer, the last is repeated; of none, the anchor. Null and
    positive entries are no negatives. Only the row's own array is looked at: nothing is grouped or shuffled.
    """
    order = lambda x: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("sample_id").cast("string"), x.cast("string")), 256).alias("h"), x.alias("x"))
    own = F.filter("negatives", lambda x: x.isNotNull() & ~x.eqNullSafe(F.col("positive")))
    picked = F.transform(F.slice(F.array_sort(F.transform(own, order)), 1, n), lambda s: s["x"])
    chosen = F.when(F.size(own) > n, picked).otherwise(own)
    last = F.when(F.size(own) > 0, F.element_at(own, -1)).otherwise(F.col("anchor"))
    return samples.withColumn("negatives", F.slice(F.concat(chosen, F.array_repeat(last, n)), 1, n))


def pair_dataset(sessions: DataFrame, n: int = 5, min_samples: int = 10, validation_percent: int = 20, seed: int = 42) -> DataFrame:
    """Training rows ``(sample_id, anchor, positive, negatives, validation)`` of ``sessions(sample_id, anchor, selected, recommended)``.

    A session with an anchor, a selected guide and at least one other recommended guide is a sample. Fewer than ``min_samples`` are an error. ``validation`` splits
    by a hash of the id, so a sample stays on its side when others come and go.
    """
    from wrenchlake.operators.evaluate import is_validation

    other = F.exists("recommended", lambda x: x.isNotNull() & (x != F.col("selected")))
    fit = sessions.where(F.col("anchor").isNotNull() & F.col("selected").isNotNull() & other)
    if fit.limit(min_samples).count() < min_samples:
        raise ValueError(f"fewer than {min_samples} samples")
    rows = fixed_negatives(fit.select("sample_id", "anchor", F.col("selected").alias("positive"), F.col("recommended").alias("negatives")), n, seed)
    return rows.withColumn("validation", is_validation(F.col("sample_id"), seed, validation_percent))
