"""Records and procedures: gates, defaults, lookups, pairs, updates and accounting, as joins and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlake.functions import text as T
from wrenchlake.functions import vectors as V
from wrenchlake.operators.retrieval import top_k

OUTCOMES = ("success", "failure", "partial")


def _filled(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


# --- gates and scores ---


def batch_score(codes: Column, symptoms: Column, vehicle: Column, title: Column, n_steps: Column, summary: Column, n_sensors: Column, outcome: Column, cause: Column) -> Column:
    """The additive score of the batch route, whose guide part asks for a title with steps or with a summary of 50 characters."""
    told = F.coalesce(F.length(symptoms), F.lit(0))
    has = lambda name: F.coalesce(vehicle[name].cast("string") != "", F.lit(False))
    titled, stepped, summed = F.coalesce(title != "", F.lit(False)), F.coalesce(n_steps > 0, F.lit(False)), F.coalesce(F.length(summary) >= 50, F.lit(False))
    n = F.coalesce(n_sensors, F.lit(0))
    return (
        F.when(F.exists(codes, T.valid_code), 0.3).when(cause & (told >= 20), 0.2).when(cause & (told > 0), 0.1).otherwise(0.0)
        + F.when(has("make") & has("model") & has("year"), 0.2).when(has("make") & (has("model") | has("year")), 0.1).otherwise(0.0)
        + F.when(titled & (stepped | summed), 0.3).when(titled | stepped | summed, 0.15).otherwise(0.0)
        + F.when(n >= 5, 0.15).when(n >= 3, 0.1).when(n >= 1, 0.05).otherwise(0.0)
        + F.when(F.lower(outcome).isin(*OUTCOMES), 0.05).otherwise(0.0)
    )


def batch_gate(codes: Column, summary: Column, cause: Column, score: Column, least: float = 0.6) -> Column:
    """Why a record goes (``invalid``, ``quality``) or that it is ``valid``. A record of a cause needs a summary of 50 characters, any other a
    valid code."""
    usable = F.when(cause, F.length(F.coalesce(F.trim(summary), F.lit(""))) >= 50).otherwise(F.coalesce(F.exists(codes, T.valid_code), F.lit(False)))
    return F.when(~usable, "invalid").when(score < least, "quality").otherwise("valid")


def worth_extracting(text: Column, words: list[str] = T.REPAIR_WORDS) -> Column:
    """At least 200 characters and a code or one of the words of repair, of any case and not within another word."""
    told = text.rlike(r"(?i)(?:^|[^\p{L}\p{N}_])(?:" + "|".join(words) + r")(?:$|[^\p{L}\p{N}_])")
    return F.coalesce((F.length(text) >= 200) & ((F.size(T.extract_codes(text)) > 0) | told), F.lit(False))


def title_is_relevant(title: Column, words: list[str] = T.TITLE_FIX_WORDS + T.TITLE_WORDS) -> Column:
    """At least five characters, neither digits nor a word of navigation, and a word of four or five letters or digits (taken as a code) or one
    of the topic's words, even within another."""
    low = F.trim(F.lower(title))
    skipped = low.rlike("^[0-9]+$") | low.isin("last", "next", "prev", "previous", "page")
    return F.coalesce((F.length(title) >= 5) & ~skipped & (low.rlike(r"\b[0-9a-z]{4,5}\b") | T.any_of(low, words)), F.lit(False))


def clean_title(title: Column) -> Column:
    """The trimmed title, null unless it has 3 to 200 characters."""
    t = F.trim(title)
    return F.when(F.length(t).between(3, 200), t)


def with_defaults(rows: DataFrame, text: str, given: dict[str, Column]) -> DataFrame:
    """Each field as given, else what the rules find in the text; ``confidence`` 0.5 where codes had to be found."""
    found = {"codes": T.extract_codes(F.col(text)), "outcome": T.classify_outcome(F.col(text)), "make": T.extract_vehicle(F.col(text))["make"]}
    filled = {name: F.coalesce(given[name], found[name]) if name in given else found[name] for name in found}
    return rows.select("*", *[c.alias(n) for n, c in filled.items()], F.when(given["codes"].isNull() if "codes" in given else F.lit(True), 0.5).otherwise(1.0).alias("confidence"))


def normal_codes(codes: Column) -> Column:
    """Codes trimmed and upper-cased, blank ones dropped."""
    return F.filter(F.transform(codes, lambda c: F.upper(F.trim(c))), lambda c: c != "")


# --- lookups and joins ---


def first_key_join(rows: DataFrame, labels: DataFrame, keys: list[str], on: str, label: str) -> DataFrame:
    """Labels by the first of the keys that gives one that isn't blank; distinct. All keys are tried in one join."""
    good = labels.where(_filled(F.col(label))).select(F.col(on).alias("__on"), F.col(label).alias("label"))
    tried = rows.select("id", F.posexplode(F.array(*[F.col(k).cast("string") for k in keys])).alias("key_no", "__key"))
    hits = tried.join(good, F.col("__key") == F.col("__on").cast("string"))
    first = hits.groupBy("id").agg(F.min("key_no").alias("key_no"))
    return rows.select("id").distinct().join(hits.join(first, ["id", "key_no"]).select("id", "key_no", "label").distinct(), "id", "left")


def lookup_or_search(rows: DataFrame, held: DataFrame, ids: list[str], least: int = 50) -> DataFrame:
    """``rows(id, title)`` with the description of ``held`` that has the id in any of ``ids``, else of the smallest one whose title begins with the same three
    words; shorter ones than ``least`` don't count."""
    said = held.where(F.length("description") > least)
    words = lambda c: F.array_join(F.slice(F.split(F.lower(c), " "), 1, 3), " ")
    by_id = said.select(F.explode(F.array(*[F.col(i).cast("string") for i in ids])).alias("__id"), "description").groupBy("__id").agg(F.min("description").alias("by_id"))
    by_words = said.groupBy(words(F.col("title")).alias("__words")).agg(F.min("description").alias("by_words"))
    joined = rows.join(by_id, F.col("id").cast("string") == F.col("__id"), "left").join(by_words, words(F.col("title")) == F.col("__words"), "left")
    return joined.select("id", F.coalesce("by_id", "by_words").alias("description"), F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_words").isNotNull(), "words").alias("found_by"))


def session_pairs(sessions: DataFrame) -> DataFrame:
    """Of ``sessions(id, selected, recommended)`` the positive and its negatives, if there is one at least."""
    others = F.array_sort(F.array_except("recommended", F.array("selected")))
    return sessions.where("selected is not null").select("id", F.col("selected").alias("positive"), others.alias("negatives")).where(F.size("negatives") > 0)


def scraped_pairs(records: DataFrame) -> DataFrame:
    """Records to learn from: a known outcome, confidence of at least 0.7 or none stated, a summary, and codes or a cause."""
    sure = F.col("confidence").isNull() | (F.col("confidence") >= 0.7)
    return records.where(F.col("outcome").isin("success", "partial") & sure & F.col("summary").isNotNull() & (F.coalesce(F.size("codes") > 0, F.lit(False)) | (F.col("record_type") == "cause_to_solution")))


# --- results ---


def merge_chunks(results: DataFrame, k: int) -> DataFrame:
    """``results(query_id, id, score)`` of several searches: of each document its best score, then the best ``k``."""
    return top_k(results.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


def rerank(candidates: DataFrame, logit: Column, rerank_k: int) -> DataFrame:
    """The sigmoid of ``logit`` for the first ``rerank_k`` of each query, 0 for the others, and the order by it, ties as they were."""
    scored = candidates.withColumn("rerank_score", F.when(F.col("rank") <= rerank_k, V.sigmoid(logit)).otherwise(0.0)).withColumnRenamed("rank", "rank_before")
    return top_k(scored, 2**31 - 1, by="rerank_score", tie="rank_before")


def matcher_accuracy(pairs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Of ``pairs(similarity)``, null where nothing was retrieved: accuracy over all and over those evaluated, coverage, mean similarity."""
    hit = F.count_if(F.col("similarity") >= threshold)
    return pairs.agg(
        F.count("*").alias("attempted"), F.count("similarity").alias("evaluated"), hit.alias("matched"), (hit / F.nullif(F.count("similarity"), F.lit(0))).alias("accuracy"),
        (hit / F.nullif(F.count("*"), F.lit(0))).alias("accuracy_all"), (F.count("similarity") / F.nullif(F.count("*"), F.lit(0))).alias("coverage"), F.avg("similarity").alias("mean_similarity"),
    )


def success_by_form(ranks: DataFrame, k: int = 5) -> DataFrame:
    """Hit rate at ``k`` and mean rank of hits by the form of the query; rank 0 is a miss."""
    return ranks.groupBy("form").agg(F.count("*").alias("n"), F.avg(F.when(F.col("rank").between(1, k), 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(F.when(F.col("rank") > 0, F.col("rank"))).alias("mean_rank"))


# --- updates and accounting ---


def update_rows(rows: DataFrame, changes: DataFrame, key: str, keep: bool = True, order: str | None = None) -> DataFrame:
    """Columns of ``changes`` replace those of the rows with the same key; nulls keep what was there (``keep``) or overwrite it.

    Of several changes of a key the one of greatest ``order`` counts, or, without such a column, of greatest values; rows stay as many as they are. Null keys match nothing.
    """
    names = [c for c in changes.columns if c not in (key, order)]
    last = F.max(F.struct(*[F.col(c) for c in ([order] if order else [])], *[F.col(c) for c in names]))
    changes = changes.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("last")).select(key, *[F.col("last")[c].alias(c) for c in names])
    both = rows.alias("a").join(changes.withColumn("__there", F.lit(True)).alias("b"), key, "left")
    value = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if keep else F.when(F.col("b.__there"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return both.select(*[value(c).alias(c) if c in names else F.col(c if c == key else f"a.{c}") for c in rows.columns])


def delete_rows(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't in ``gone``."""
    return rows.join(gone.select(key), key, "left_anti")


def latest_active(weights: DataFrame) -> DataFrame:
    """The active row of the highest id."""
    return weights.where("is_active").orderBy(F.desc("id")).limit(1)


def resume_after(rows: DataFrame, checkpoint: DataFrame, key: str) -> DataFrame:
    """The rows beyond the last finished key; all where there is none. ``checkpoint`` has one row at most."""
    done = checkpoint.agg(F.max(key).alias("__done"))
    return rows.join(F.broadcast(done), F.col("__done").isNull() | (F.col(key) > F.col("__done"))).drop("__done")


# --- scans and projections ---


def scorable(records: DataFrame, again: bool = False) -> DataFrame:
    """Records with a summary and either a cause or a code; without ``again`` only those not scored yet."""
    fit = _filled(F.col("summary")) & ((F.col("record_type") == "cause_to_solution") | (F.size("codes") > 0))
    return records.where(fit if again else fit & F.col("quality_score").isNull())


def procedures(objects: DataFrame, issue_only: bool = False, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Distinct ``(id, title, name)`` of ``objects(id, title, name)``; ids may not be null or blank. Titles are trimmed, ``-`` counts as missing, the name stands for a missing title.
    ``issue_only`` keeps those whose title is missing. ``ids`` keeps these, and then ``limit`` doesn't count; else the first ``limit`` by id are kept."""
    id_ = F.trim(F.col("id").cast("string"))
    real = lambda c: F.nullif(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("-"))
    rows = objects.where(_filled(id_))
    rows = rows.where(real("title").isNull()) if issue_only else rows
    wanted = sorted({str(i).strip() for i in ids or [] if str(i).strip()})
    rows = rows.where(id_.isin(wanted)) if wanted else rows
    out = rows.select(id_.alias("id"), F.coalesce(real("title"), real("name")).alias("title"), real("name").alias("name")).distinct()
    return out if wanted or limit is None else out.orderBy("id", "title", "name").limit(limit)


def recommendations(ranked: DataFrame) -> DataFrame:
    """``(id, title, procedure_name, procedure_id, score)`` of results ``(id, procedure_id, title, procedure_name, combined_score, score)``: blanks count as missing, the procedure's id stands before the document's, a
    title for a missing name and the other way round, and the combined score before the plain one."""
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    own = F.coalesce(given("procedure_id"), F.col("id"))
    title = F.coalesce(given("title"), given("procedure_name"), F.lit("Unknown"))
    return ranked.select(
        F.coalesce(own, F.lit("")).alias("id"), title.alias("title"), F.coalesce(given("procedure_name"), title).alias("procedure_name"), F.nullif(own, F.lit("")).alias("procedure_id"),
        F.coalesce("combined_score", "score", F.lit(0.0)).alias("score"),
    )


def search_labels(faults: DataFrame, labels: DataFrame, needle: str, limit: int | None = None) -> DataFrame:
    """Distinct ``faults(id, code, ...)`` whose code, or the label or description of one of whose ``labels(fault_id, label, description)``, has the text, of any case; the first ``limit`` by id.

    Labels are cut to those that match before they are joined, so faults of many labels meet few.
    """
    has = lambda c: F.coalesce(F.lower(F.col(c)).contains(needle.lower()), F.lit(False))
    told = labels.where(has("label") | has("description")).select("fault_id").distinct().withColumn("told", F.lit(True))
    found = faults.join(told, faults["id"] == told["fault_id"], "left").where(has("code") | F.col("told").isNotNull()).select(*[faults[c] for c in faults.columns]).distinct()
    return found if limit is None else found.orderBy("id").limit(limit)


def guide_vectors(asked: DataFrame, stored: DataFrame, encode) -> DataFrame:
    """``(id, vector, from)`` of each of ``asked(id, text)``: the stored vector of least place (``stored(id, place, vec)``), else that of the text by ``encode``, else null. Texts are encoded only where
    nothing is stored."""
    first = stored.where("vec is not null").groupBy("id").agg(F.min(F.struct("place", "vec"))["vec"].alias("stored"))
    joined = asked.join(first, "id", "left")
    has, rest = joined.where("stored is not null"), joined.where("stored is null")
    old = has.select("id", F.col("stored").cast("array<double>").alias("vector"), F.lit("stored").alias("from"))
    blank = F.coalesce(F.trim("text") == "", F.lit(True))
    new = rest.where(~blank).select("id", encode(F.col("text")).alias("vector"), F.lit("encoded").alias("from"))
    none = rest.where(blank).select("id", F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("string").alias("from"))
    return old.unionByName(new).unionByName(none)


def tuning_pairs(records: DataFrame, limit: int | None = 500) -> DataFrame:
    """``(record_id, codes, summary, matched_id)`` of records with a good outcome, a summary and a match: the first ``limit`` by id."""
    fit = records.where(F.col("outcome").isin("success", "partial") & F.col("summary").isNotNull() & F.col("matched_id").isNotNull())
    out = fit.select("record_id", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), "summary", "matched_id")
    return out if limit is None else out.orderBy("record_id").limit(limit)


def enrich(records: DataFrame) -> DataFrame:
    """Golden records: two query texts, the ground truth and what is known for its evaluation, nested. Of ``records(record_id, codes, symptoms, summary, guide, matched_id, matched_title, sensors,
    quality_score, category)``; symptoms are cut at 200 characters, repair texts at 300 in queries and at 500 as truth."""
    symptoms, repair = F.coalesce("symptoms", F.lit("")), F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.nullif(F.col("guide"), F.lit("")))
    codes = F.coalesce("codes", F.array().cast("array<string>"))
    asked = F.concat(F.lit("Fault codes: "), F.array_join(codes, ", "), F.when(symptoms != "", F.concat(F.lit(". Problem: "), F.substring(symptoms, 1, 200))).otherwise(""))
    return records.select(
        "record_id", codes.alias("codes"), asked.alias("query_symptom"), F.coalesce(F.concat(F.lit("Fix: "), F.substring(repair, 1, 300)), asked).alias("query_solution"),
        F.struct(F.col("matched_id").alias("guide_id"), F.col("matched_title").alias("guide_title"), F.substring(repair, 1, 500).alias("repair_text")).alias("truth"),
        F.struct(F.size(codes).alias("n_codes"), (symptoms != "").alias("has_symptoms"), F.coalesce(F.size("sensors") > 0, F.lit(False)).alias("has_sensors"), "quality_score",
                 F.coalesce("category", F.lit("general")).alias("category")).alias("evaluation"),
    )


def coverage(records: DataFrame) -> DataFrame:
    """One row of ``records(codes, guide_id, has_symptoms, has_sensors)``: their number, distinct codes and guides, and the shares with symptoms and sensors. Code frequencies are
    ``code_counts``."""
    n_codes = records.select(F.explode("codes").alias("c")).agg(F.count_distinct("c").alias("n_codes"))
    share = lambda c: F.coalesce(F.count_if(F.col(c)) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
    rest = records.agg(F.count("*").alias("n_records"), F.count_distinct("guide_id").alias("n_guides"), share("has_symptoms").alias("symptom_share"), share("has_sensors").alias("sensor_share"))
    return rest.crossJoin(F.broadcast(n_codes))  # a row each


def code_counts(records: DataFrame) -> DataFrame:
    """In how many records' lists each code stands, repeats included."""
    return records.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def form_overhead(runs: DataFrame) -> DataFrame:
    """Of ``runs(query_id, form, seconds, length)``, form ``a`` or ``b``: mean times, what b takes more in percent, and the mean ratio of lengths, over the queries that have both."""
    by = runs.groupBy("query_id").agg(*[F.max(F.when(F.col("form") == f, F.col(c))).alias(f"{c}_{f}") for f in ("a", "b") for c in ("seconds", "length")])
    both = by.where("seconds_a is not null and seconds_b is not null")
    mean_a, mean_b = F.avg("seconds_a"), F.avg("seconds_b")
    return both.agg(F.count("*").alias("n"), mean_a.alias("mean_a"), mean_b.alias("mean_b"), (100 * (mean_b - mean_a) / F.nullif(mean_a, F.lit(0.0))).alias("overhead_pct"), F.avg(F.col("length_b") / F.nullif(F.col("length_a"), F.lit(0))).alias("length_ratio"))
