"""Text rules as column expressions: extraction, classification, scoring, cleaning, chunking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns, word lists, ranges and weights that results depend on ---
CODE_PATTERNS = [r"(?i)\b(P[0-9][0-9][0-9][0-9])\b", r"\b([A-Z][0-9][A-Z][0-9][0-9])\b", r"\b([A-Z][0-9][0-9][0-9][0-9])\b"]
VALID_CODE = r"^(P[0-9]{4}|[A-Z][0-9][A-Z][0-9]{2}|[A-Z][0-9]{4})$"
SENSOR_PATTERNS = {
    "engine_rpm": r"(?i)(?:engine\s*rpm|rpm)\s*[=:]\s*(\d+(?:\.\d+)?)|(\d+)\s*rpm",
    "coolant_temp": r"(?i)(?:coolant\s*temp(?:erature)?|coolant)\s*[=:]\s*(\d+(?:\.\d+)?)|(\d+)\s*[°cC]",
    "throttle_position": r"(?i)(?:throttle\s*position|tps)\s*[=:]\s*(\d+(?:\.\d+)?)|(\d+)\s*%",
    "maf_sensor": r"(?i)(?:maf|mass\s*air\s*flow)\s*[=:]\s*(\d+(?:\.\d+)?)|(\d+(?:\.\d+)?)\s*g/s",
    "fuel_trim_bank1": r"(?i)(?:fuel\s*trim\s*bank\s*1|stft\s*b1|ltft\s*b1)\s*[=:]\s*([+-]?\d+(?:\.\d+)?)|([+-]?\d+(?:\.\d+)?)\s*%",
    "fuel_trim_bank2": r"(?i)(?:fuel\s*trim\s*bank\s*2|stft\s*b2|ltft\s*b2)\s*[=:]\s*([+-]?\d+(?:\.\d+)?)|([+-]?\d+(?:\.\d+)?)\s*%",
    "o2_sensor_bank1": r"(?i)(?:o2\s*bank\s*1|oxygen\s*sensor\s*b1)\s*[=:]\s*(\d+(?:\.\d+)?)",
    "o2_sensor_bank2": r"(?i)(?:o2\s*bank\s*2|oxygen\s*sensor\s*b2)\s*[=:]\s*(\d+(?:\.\d+)?)",
    "intake_air_temp": r"(?i)(?:intake\s*air\s*temp|iat)\s*[=:]\s*(\d+(?:\.\d+)?)|(\d+)\s*[°cC]",
}
SENSOR_RANGES = {
    "engine_rpm": (0, 8000),
    "coolant_temp": (-40, 150),
    "throttle_position": (0, 100),
    "maf_sensor": (0, 1000),
    "fuel_trim_bank1": (-100, 100),
    "fuel_trim_bank2": (-100, 100),
    "o2_sensor_bank1": (0, 1.5),
    "o2_sensor_bank2": (0, 1.5),
    "intake_air_temp": (-40, 150),
    "barometric_pressure": (0, 200),
    "timing_advance": (-50, 50),
}
VEHICLE_MAKES = [
    "bmw", "mercedes", "audi", "volkswagen", "vw", "porsche", "mini",
    "ford", "chevrolet", "chevy", "dodge", "jeep", "toyota", "honda",
    "nissan", "mazda", "subaru", "hyundai", "kia", "volvo", "lexus",
    "acura", "infiniti", "cadillac", "buick", "gmc", "ram",
]
YEAR_PATTERN = r"\b(19[89]\d|20[0-2]\d)\b"
ENGINE_PATTERN = r"(?i)\b(N54|N55|B58|B48|S55|S58|M54|M52|2JZ|1JZ|LS[0-9]|VQ[0-9]{2})\b"
MILEAGE_PATTERN = r"(?i)(?:mileage|miles|km|odometer)\s*[=:]\s*([\d,]+)|([\d,]+)\s*(?:k\s*miles?|miles?|km)"
OUTCOME_WORDS = [
    ("success", ["fixed", "resolved", "worked", "solved", "no more", "cleared"]),
    ("failure", ["didn't work", "still getting", "still have", "failed", "no luck"]),
    ("partial", ["partially", "somewhat", "better but", "improved"]),
]
SUMMARY_PATTERNS = [
    r"(?is)(?:replaced|fixed|repaired|cleaned|reset)\s+[^.]+\.[^.]*\.",
    r"(?is)(?:solution|fix|repair)\s*[:\-]\s*[^.\n]+(?:\.[^.\n]+)*",
    r"(?is)(?:what\s+i\s+did|steps?\s*[:\-])\s*[^.\n]+(?:\.[^.\n]+)*",
]
ACTION_WORDS = [
    "replaced", "installed", "fixed", "repaired", "cleaned", "rebuilt",
    "adjusted", "tightened", "sealed", "flushed", "changed", "swapped",
    "upgraded", "reset", "cleared", "diagnosed", "tested", "removed",
]
VAGUE_PHRASES = ["fixed it", "it worked", "that fixed it", "problem solved", "all good"]
PART_WORDS = ["part", "sensor", "coil", "plug", "valve", "pump"]
CATEGORY_WORDS = [
    ("misfire", ["misfire", "cylinder"]),
    ("sensor", ["sensor", "maf", "o2", "oxygen"]),
    ("ignition", ["ignition", "coil", "spark", "plug"]),
    ("fuel", ["fuel", "injector", "pump", "filter"]),
    ("emissions", ["emission", "catalyst", "egr"]),
    ("transmission", ["transmission", "gearbox", "clutch"]),
    ("electrical", ["electrical", "wiring", "circuit", "fuse", "relay"]),
    ("diagnosis", ["diagnosis", "diagnostic", "test", "check"]),
    ("repair", ["repair", "replace", "install", "remove"]),
    ("calibration", ["calibration", "reset", "programming", "coding"]),
]
STOP_WORDS = ["the", "and", "or", "for", "with", "from", "this", "that", "are", "was", "were"]
PREVIEW_KEYWORDS = ["Problem:", "Symptom:", "Cause:", "Condition:", "When:", "If:"]
REPAIR_WORDS = [
    "replaced", "fixed", "repaired", "installed", "cleaned", "rebuilt", "adjusted", "sealed", "flushed", "changed", "swapped", "reset", "cleared", "diagnosed", "that fixed", "fixed it", "problem solved",
    "solution was", "fix was", "replacement of", "installed new",
]
TITLE_FIX_WORDS = [
    "fixed", "solved", "replaced", "installed", "repaired", "cleaned", "rebuilt", "fixed it", "that fixed", "fixed the", "problem solved", "issue resolved", "fixed my", "replacement", "fix for", "solution",
    "success", "update", "finally", "sorted", "resolved", "changed", "swapped", "new part", "thanks", "thank you", "appreciated", "cheers", "kudos", "diy", "guide", "tutorial", "how to", "how-to", "retrofit",
    "coding", "programmed", "flashed", "registered", "calibrated", "adapted", "reset", "procedure", "instructions",
]
TITLE_WORDS = [
    "check engine", "cel", "fault code", "obd", "code", "diagnostic", "misfire", "error", "dtc", "trouble code", "engine light", "abs", "transmission", "limp mode", "stalling", "rough idle", "symptom",
    "problem", "issue", "fail", "failing", "broken", "bad", "wont start", "no start", "crank", "cranking", "noise", "rattle", "whine", "clunk", "leak", "smoke", "overheat", "vibration", "shake", "shaking",
    "hesitate", "hesitation", "power loss", "loss of power", "sluggish", "surge", "surging", "rough run", "running rough", "jerk", "jerking", "warning", "message", "malfunction",
]
KEYWORD_TERMS = [
    "diagnosis", "repair", "replace", "check", "inspect", "test", "misfire", "sensor", "coil", "plug", "injector", "valve", "gasket", "seal", "filter", "pump", "motor", "actuator", "circuit", "wiring",
    "connector", "fuse", "relay", "module", "calibration", "reset", "programming", "coding", "update",
]
NAV_WORDS = ["last", "next", "prev", "previous", "page", "»", "«", "..."]
RATE_LIMIT_PHRASES = ["too often", "try again later", "performing that action", "rate limit", "being rate limited", "complete the captcha verification"]
INDEX_STRIP = [
    (r"\{[^}]*\}", " "),
    (r"(?s)function\s+\w+\s*\([^)]*\)\s*\{[^}]*\}", " "),
    (r"var\s+\w+\s*=\s*[^;]+;", " "),
    (r"(?s)if\s*\([^)]+\)\s*\{[^}]*\}", " "),
    (r"return\s+[^;]+;", " "),
    (r"(?s)@media\s+[^\{]+\{[^}]*\}", " "),
    (r"\.[a-zA-Z_-][a-zA-Z0-9_-]*\s*\{[^}]*\}", " "),
    (r"<[^>]+>", " "),
    (r"&[a-zA-Z]+;", " "),
    (r"\\x3c", "<"),
    (r"\\x3e", ">"),
    (r"\\x3d", "="),
    (r"\\", ""),
]
RESPONSE_STRIP = [
    (r"@media\s+[^{]+\{[^{}]*\}", " "),
    (r"[.#][a-zA-Z_-][a-zA-Z0-9_-]*\s*\{[^}]*\}", " "),
    (r"\{[^}]*\}", " "),
    (r"(?s)function\s+\w+\s*\([^)]*\)\s*\{[^}]*\}", " "),
    (r"var\s+\w+\s*=\s*[^;]+;", " "),
    (r"(?s)if\s*\([^)]+\)\s*\{[^}]*\}", " "),
    (r"return\s+[^;]+;", " "),
    (r"document\.write\([^)]+\);", " "),
    (r"<[^>]+>", " "),
    (r"\\x3c", " "),
    (r"\\x3e", " "),
    (r"\\x3d", " "),
    (r"\\", " "),
    (r"\bfont-family\b[^;]*;?", " "),
    (r"\bfont-size\b[^;]*;?", " "),
    (r"\bfont-weight\b[^;]*;?", " "),
    (r"\bcolor\b[^;]*;?", " "),
    (r"\btext-decoration\b[^;]*;?", " "),
    (r"\btext-align\b[^;]*;?", " "),
]
PREVIEW_STRIP = [
    (r"(?is)@media\s+screen\s*\{[^}]*\}", " "),
    (r"(?is)\.[a-zA-Z_][a-zA-Z0-9_-]*\s*\{[^}]*\}", " "),
    (r"(?is)var\s+\w+\s*=\s*[^;]+;", " "),
    (r"(?is)function\s+\w+\s*\([^)]*\)\s*\{[^}]*\}", " "),
    (r"(?is)tr\s*\{[^}]*\}", " "),
    (r"(?is)td\s*\{[^}]*\}", " "),
    (r"(?is)p\s*\{[^}]*\}", " "),
]
PROBLEM_PATTERN = r"(?i)(?:Problem|Symptom|Cause|Condition|When|If)\s*[:\-]\s*([^.\n]{20,500})"
SOLUTION_PATTERN = r"(?i)(?:Solution|Fix|Repair|Procedure|Remedy)\s*[:\-]\s*([^.\n]{20,500})"
CHUNK_CHARS, CHUNK_OVERLAP = 1200, 200
# --- end of fixed values ---


def any_of(text: Column, words: list[str]) -> Column:
    """True where the text has any of the words as a substring."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def extract_codes(text: Column) -> Column:
    """Upper-cased distinct codes of the three patterns, sorted; an empty array for null."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in CODE_PATTERNS])
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(found, F.upper))), F.array().cast("array<string>"))


def valid_code(code: Column) -> Column:
    """A trimmed, upper-cased code of one of the three forms."""
    return F.coalesce(F.upper(F.trim(code)).rlike(VALID_CODE), F.lit(False))


def _first_group(text: Column, pattern: str, groups: int) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in range(1, groups + 1)])


def extract_sensors(text: Column) -> Column:
    """A map of the sensors whose pattern matches, first match each, as doubles."""
    pairs = []
    for name, pattern in SENSOR_PATTERNS.items():
        value = F.regexp_replace(_first_group(text, pattern, pattern.count("(") - pattern.count("(?")), ",", "")
        pairs.append(F.struct(F.lit(name).alias("key"), value.try_cast("double").alias("value")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def normalize_sensors(raw: Column) -> Column:
    """Keys to lower case with underscores, values cast or dropped, known sensors out of range dropped.

    Of keys that become equal the last counts.
    """
    entries = F.transform(F.map_entries(raw), lambda e: F.struct(F.regexp_replace(F.lower(e["key"]), "[ -]", "_").alias("key"), e["value"].try_cast("double").alias("value")))
    low = F.create_map(*[F.lit(x) for k, (a, _) in SENSOR_RANGES.items() for x in (k, float(a))])
    high = F.create_map(*[F.lit(x) for k, (_, b) in SENSOR_RANGES.items() for x in (k, float(b))])
    kept = F.filter(entries, lambda e: e["value"].isNotNull() & F.coalesce(e["value"].between(low[e["key"]], high[e["key"]]), F.lit(True)))
    last = F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.greatest(F.size(kept), F.lit(1))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def extract_vehicle(text: Column) -> Column:
    """Make (title case), year, engine (upper case) and mileage; null where absent."""
    make = F.nullif(F.regexp_extract(text, r"(?i)\b(" + "|".join(VEHICLE_MAKES) + r")\b", 1), F.lit(""))
    return F.struct(
        F.initcap(make).alias("make"),
        F.regexp_extract(text, YEAR_PATTERN, 1).try_cast("int").alias("year"),
        F.upper(F.nullif(F.regexp_extract(text, ENGINE_PATTERN, 1), F.lit(""))).alias("engine"),
        F.regexp_replace(_first_group(text, MILEAGE_PATTERN, 2), ",", "").try_cast("int").alias("mileage"),
    )


def classify_outcome(text: Column) -> Column:
    """Success, failure, partial or unknown, tested in this order (so "not fixed" is a success)."""
    low, out = F.lower(text), F.lit("unknown")
    for name, words in reversed(OUTCOME_WORDS):
        out = F.when(any_of(low, words), name).otherwise(out)
    return out


def repair_summary(text: Column, most: int = 500) -> Column:
    """I4: the text if short, else the first matching section, else its first whole sentences."""
    t = F.trim(text)
    section = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 0), F.lit("")) for p in SUMMARY_PATTERNS])
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("total"), F.lit(False).alias("full"))

    def add(acc: Column, s: Column) -> Column:
        over = acc["full"] | (acc["total"] + F.length(s) + 1 > most)
        return F.struct(
            F.when(over, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(F.trim(s)))).alias("kept"),
            F.when(over, acc["total"]).otherwise(acc["total"] + F.length(s) + 1).alias("total"),
            over.alias("full"),
        )

    kept = F.aggregate(F.split(t, r"[.!?]\s+"), start, add, lambda acc: acc["kept"])
    sentences = F.concat(F.array_join(kept, ". "), F.when(F.size(kept) > 0, ".").otherwise(""))
    return F.when(t.isNull(), "").when(F.length(t) <= most, t).when(section.isNotNull(), F.substring(F.trim(section), 1, most)).otherwise(sentences)


def substantial(summary: Column) -> Column:
    """Whether a summary tells a concrete repair."""
    low, n = F.lower(summary), F.length(summary)
    return F.coalesce(
        F.when(n < 50, False)
        .when(any_of(low, ACTION_WORDS), True)
        .when(any_of(low, VAGUE_PHRASES) & (n < 80), False)
        .when((n >= 80) & any_of(low, PART_WORDS), True)
        .otherwise(n >= 100),
        F.lit(False),
    )


def quality_score(codes: Column, symptoms: Column, vehicle: Column, summary: Column, sensors: Column, outcome: Column, cause: Column) -> Column:
    """Additive score, summed in a fixed order. ``cause``: a cause-to-solution record."""
    said, told = F.length(F.coalesce(F.trim(symptoms), F.lit(""))), F.length(F.coalesce(F.trim(summary), F.lit("")))
    n = F.coalesce(F.size(F.map_keys(sensors)), F.lit(0))
    has = lambda f: vehicle[f].isNotNull() & (vehicle[f].cast("string") != "")
    return (
        F.when(F.exists(codes, valid_code), 0.3).when(cause & (said >= 20), 0.2).when(cause & (said > 0), 0.1).otherwise(0.0)
        + F.when(has("make") & has("model") & has("year"), 0.2).when(has("make") & (has("model") | has("year")), 0.1).otherwise(0.0)
        + F.when(told >= 50, 0.3).when(told > 0, 0.15).otherwise(0.0)
        + F.when(n >= 5, 0.15).when(n >= 3, 0.1).when(n >= 1, 0.05).otherwise(0.0)
        + F.when(F.lower(outcome).isin("success", "failure", "partial"), 0.05).otherwise(0.0)
    )


def _apply(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    return squeeze(text)


def squeeze(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_markup(text: Column) -> Column:
    """Braces, scripts, styles, tags, entities and escapes removed, in this order."""
    return _apply(text, INDEX_STRIP)


def clean_response(text: Column) -> Column:
    """The response side's cleaning, of another order."""
    return _apply(text, RESPONSE_STRIP)


def problem_solution(raw: Column) -> Column:
    """Labelled problem and solution phrases, first five distinct, of the stripped text; else empty."""
    text = strip_markup(raw)
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (PROBLEM_PATTERN, SOLUTION_PATTERN)])
    five = F.slice(F.transform(F.array_distinct(F.transform(found, lambda x: F.trim(x))), lambda s: F.substring(s, 1, 400)), 1, 5)
    return F.when((F.length(text) >= 20) & (F.size(five) > 0), F.concat(F.lit(" Problem/Solution: "), F.array_join(five, "; "))).otherwise("")


def chunks(text: Column, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """The text itself if short, else windows of ``size`` that start every ``size - overlap``."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size))))


def truncate_title(title: Column, most: int = 200) -> Column:
    """Lists keep whole items and a count of the others; else a cut at a late space."""
    items = F.transform(F.split(title, ","), lambda x: F.trim(x))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("len"), F.lit(False).alias("full"))

    def add(acc: Column, item: Column) -> Column:
        full = acc["full"] | (acc["len"] + F.length(item) + 2 > most - 20)
        return F.struct((acc["n"] + F.when(full, 0).otherwise(1)).alias("n"), F.when(full, acc["len"]).otherwise(acc["len"] + F.length(item) + 2).alias("len"), full.alias("full"))

    n = F.aggregate(items, start, add, lambda acc: acc["n"])
    head, left = F.array_join(F.slice(items, F.lit(1), n), ", "), F.size(items) - n
    listed = F.when(left > 0, F.concat(head, F.lit(" (+"), left.cast("string"), F.lit(" more)"))).otherwise(head)
    cut = F.substring(title, 1, most)
    last = F.length(cut) - F.locate(" ", F.reverse(cut))
    worded = F.when((F.locate(" ", F.reverse(cut)) > 0) & (last > most * 0.8), F.substring(cut, F.lit(1), last)).otherwise(cut)
    return F.when(title.isNull(), "").when(F.length(title) <= most, title).when(title.contains(","), listed).otherwise(F.concat(worded, F.lit("...")))


def preview(text: Column, most: int = 500) -> Column:
    """I16: the start of the cleaned text, or from 50 before the first keyword (in list order) that begins early."""
    clean = _apply(text, PREVIEW_STRIP)
    at = F.coalesce(*[F.when(F.locate(k, clean).between(1, most), F.locate(k, clean)) for k in PREVIEW_KEYWORDS], F.lit(0))
    start = F.greatest(at - 51, F.lit(0))
    return F.coalesce(
        F.concat(F.substring(clean, start + 1, F.lit(most)), F.when(F.length(clean) > start + most, "...").otherwise("")), F.lit("")
    )


def categorize(title: Column) -> Column:
    """The first category one of whose words is in the title."""
    low, out = F.lower(title), F.lit("other")
    for name, words in reversed(CATEGORY_WORDS):
        out = F.when(any_of(low, words), name).otherwise(out)
    return out


def keywords(title: Column) -> Column:
    """Distinct words, of letters of any script, digits and underscores, of over three characters that aren't stop words."""
    words = F.regexp_extract_all(F.lower(title), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS)))


def truncate_codes(codes: Column, most: int = 10) -> Column:
    """A placeholder for none; placeholders go if there are others; of too many the first after sorting."""
    real = F.filter(codes, lambda c: c != "P0000")
    ranked = F.array_sort(F.transform(real, lambda c: F.struct(F.when(F.left(F.upper(c), F.lit(1)).isin("P", "B", "C", "U"), 0).otherwise(1).alias("o"), c.alias("c"))))
    best = F.transform(F.slice(ranked, 1, most), lambda x: x["c"])
    return F.when(codes.isNull() | (F.size(real) == 0), F.array(F.lit("P0000"))).when(F.size(real) <= most, real).otherwise(best)


def repair_steps(text: Column) -> Column:
    """I8: numbered steps, else bullets, else up to ten longer lines."""
    numbered = F.regexp_extract_all(text, F.lit(r"(?m)(?:^|\n)\s*\d+[\.\)]\s*(.+?)(?=\n\s*\d+[\.\)]|$)"), F.lit(1))
    bullets = F.regexp_extract_all(text, F.lit(r"(?m)(?:^|\n)\s*[-•*]\s*(.+?)(?=\n\s*[-•*]|$)"), F.lit(1))
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda s: F.length(s) > 20), 1, 10)
    steps = F.when(F.size(numbered) > 0, F.transform(numbered, lambda x: F.trim(x))).when(F.size(bullets) > 0, F.transform(bullets, lambda x: F.trim(x))).otherwise(lines)
    return F.coalesce(steps, F.array().cast("array<string>"))


def normalize_url(url: Column) -> Column:
    """Without fragment and trailing slashes; thread pages by their number alone."""
    u = F.trim(F.regexp_replace(F.substring_index(url, "#", 1), "/+$", ""))
    by_query = F.nullif(F.regexp_extract(u, r"(?i)[?&]t=(\d+)", 1), F.lit(""))
    by_path = F.nullif(F.regexp_extract(u, r"threads/[^/]+\.(\d+)(?:/|$)", 1), F.lit(""))
    return (
        F.when(url.isNull(), "")
        .when((u.contains("showthread") | u.contains("viewtopic")) & by_query.isNotNull(), F.concat(F.lit("thread_t_"), by_query))
        .when(u.contains("threads/") & by_path.isNotNull(), F.concat(F.lit("thread_t_"), by_path))
        .otherwise(u)
    )


def nav_link(label: Column) -> Column:
    """C14: whether a link's text is paging or navigation."""
    t = F.lower(F.trim(label))
    return F.coalesce(
        F.when(label == "", True).when(F.length(label) > 80, False).when(t.rlike(r"^[0-9]+$"), True).when(t.isin(*NAV_WORDS), True).otherwise(t.startswith("page ") | t.endswith(" page")), F.lit(True)
    )


def rate_limited(html: Column) -> Column:
    """Whether a page tells of a rate limit."""
    return F.coalesce(any_of(F.lower(html), RATE_LIMIT_PHRASES), F.lit(False))


def placeholder_title(title: Column, name: Column) -> Column:
    """C17: the title, else the name; blank and dash count as missing."""
    real = lambda c: F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("-"))
    return F.coalesce(real(title), real(name))


def query_text(codes: Column, description: Column) -> Column:
    """``Fault codes: a, b. Problem: d``, either part alone if the other is missing."""
    listed = F.when(F.size(codes) > 0, F.concat(F.lit("Fault codes: "), F.array_join(codes, ", ")))
    return F.concat_ws(". ", listed, F.concat(F.lit("Problem: "), F.nullif(F.trim(description), F.lit(""))))


def tolerant_json(text: Column, schema: str) -> Column:
    """JSON between fences or other text, trailing commas allowed; null if it can't be read."""
    body = F.regexp_extract(F.regexp_replace(text, "```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return F.from_json(F.regexp_replace(F.nullif(body, F.lit("")), r",\s*([}\]])", "$1"), schema)


def sentence_summary(text: Column, most: int = 500) -> Column:
    """Whole sentences from the start while they fit in ``most`` characters, joined by ``. ``; a first sentence that is too long is cut and ends in
    ``...``. White space counts as single spaces; empty for null and blank texts."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\u00a0]+", " "))
    parts = F.split(plain, r"[.!?]\s+")
    start = F.struct(F.get(parts, F.lit(0)).alias("s"), F.lit(True).alias("open"))

    def add(acc: Column, sentence: Column) -> Column:
        fits = acc["open"] & (F.length(acc["s"]) + F.length(sentence) + 1 <= most)
        return F.struct(F.when(fits, F.concat(acc["s"], F.lit(". "), sentence)).otherwise(acc["s"]).alias("s"), fits.alias("open"))

    whole = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, add, lambda acc: acc["s"])
    return F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most - 3), F.lit("..."))).otherwise(whole)


def solution_text(guide: Column, summary: Column) -> Column:
    """I32: what a record says fixed the problem: of a guide in JSON its title and steps (a list, or one text), of any other guide the text itself, and without a guide the summary; trimmed."""
    shape = "struct<title: string, procedure_steps: array<string>, steps: array<string>>"
    one = F.from_json(guide, "struct<procedure_steps: string, steps: string>")
    many = F.from_json(guide, shape)
    plain = F.nullif(F.trim(guide), F.lit(""))
    first = lambda a, b: F.when(F.size(a) > 0, a).when(F.size(b) > 0, b)
    text = lambda c: F.when((c != "") & ~c.startswith("["), c)  # noqa: E731  not a list's JSON
    texts = F.coalesce(first(many["procedure_steps"], many["steps"]), first(F.array_compact(F.array(text(one["procedure_steps"]))), F.array_compact(F.array(text(one["steps"])))))
    steps = F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x != "")
    listed = F.concat_ws(" ", F.nullif(F.trim(many["title"]), F.lit("")), steps)
    told = F.when(plain.startswith("{") & many.isNotNull(), F.coalesce(F.nullif(listed, F.lit("")), plain)).otherwise(plain)
    return F.coalesce(told, F.trim(summary), F.lit(""))


def float_or(value: Column, default: float = 0.0) -> Column:
    """The value as a double, ``default`` where it is null or no number."""
    return F.coalesce(value.try_cast("double"), F.lit(default))


def iso_timestamp(text: Column) -> Column:
    """An ISO date or time, with or without zone; null for any other text."""
    return F.trim(text).try_cast("timestamp")
