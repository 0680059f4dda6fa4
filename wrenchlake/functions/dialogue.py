"""Questions, templates and formatted candidates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
QUERY_PREFIXES = ["expanded query:", "query:", "search query:", "result:"]
# --- end of fixed values ---


def parse_questions(response: Column, most: int = 3) -> Column:
    """Lines that are numbered, bulleted or end in a question mark, cleaned, of over ten characters, at most ``most``."""
    lines = F.transform(F.split(response, "\n"), lambda x: F.trim(x))
    marked = F.filter(lines, lambda s: s.rlike(r"^(\d+[.)]|[-*•])\s+") | s.endswith("?"))
    clean = F.transform(marked, lambda s: F.trim(F.regexp_replace(s, r"^(\d+[.)]|[-*•])\s+", "")))
    return F.coalesce(F.slice(F.filter(clean, lambda s: F.length(s) > 10), 1, most), F.array().cast("array<string>"))


def expanded_query(response: Column, original: Column) -> Column:
    """The response without a known prefix; one shorter than half of the original keeps the original."""
    t = F.trim(response)
    for p in QUERY_PREFIXES:
        t = F.when(F.lower(t).startswith(p), F.trim(F.substring(t, F.lit(len(p) + 1), F.length(t)))).otherwise(t)
    return F.when(t.isNull() | (F.length(t) < 0.5 * F.length(original)), original).otherwise(t)


def candidate_line(rank: Column, name: Column, score: Column) -> Column:
    """``1. name (score: 0.123)``."""
    return F.format_string("%d. %s (score: %.3f)", rank, name, score)


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template's ``{name}`` places filled; a name without a value is an error."""
    names = re.findall(r"\{(\w+)\}", template)
    if missing := sorted(set(names) - set(values)):
        raise KeyError(f"no value for {missing}")
    return reduce(lambda t, n: F.replace(t, F.lit("{" + n + "}"), F.coalesce(values[n].cast("string"), F.lit(""))), dict.fromkeys(names), F.lit(template))


def clarification_prompt(codes: Column, sensors: Column, candidates: Column, template: str) -> Column:
    """The template's ``{fault_codes}``, ``{obd_data}`` and ``{top_candidates}`` filled: codes joined by commas, readings as ``{name: value, ...}``, the candidates' lines; missing
    codes and candidates as nothing, missing readings as ``{}``."""
    pairs = F.transform(F.array_sort(F.map_entries(sensors)), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")))
    readings = F.concat(F.lit("{"), F.coalesce(F.array_join(pairs, ", "), F.lit("")), F.lit("}"))
    return fill(template, {"fault_codes": F.array_join(codes, ", "), "obd_data": readings, "top_candidates": candidates})


def limit_key(token_email: Column, header_email: Column, guest: Column, ip: Column) -> Column:
    """By the token's address, else the header's, else the guest cookie, else the network address."""
    known = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("ratelimit:"), known(token_email)), F.concat(F.lit("ratelimit:"), known(header_email)), F.concat(F.lit("guest:"), F.nullif(F.trim(guest), F.lit(""))), F.concat(F.lit("ratelimit:ip:"), F.coalesce(ip, F.lit("unknown")))
    )
