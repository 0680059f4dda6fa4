"""The back-off of a crawl that is being blocked, as a state machine over its responses."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

#: Statuses that mean a block.
BLOCKED = (403, 429)


@dataclass
class Crawl:
    """What a crawl knows after its responses so far: the proxy key in use, failures since its last success, and by domain the failures, bans
    and whether the proxy is given up."""

    keys: int
    rotate_at: int
    most: int
    key: int = 0
    key_failures: int = 0
    failures: Counter = field(default_factory=Counter)
    banned: set = field(default_factory=set)
    exhausted: set = field(default_factory=set)

    def step(self, domain: str, status: int | None, proxied: bool) -> str:
        """Take one response in; what becomes of it."""
        if domain in self.banned:
            return "ignored"
        if not self.keys:
            return "returned"
        if status in BLOCKED:
            return self._blocked_proxy(domain) if proxied else "returned" if domain in self.exhausted else "retry_with_proxy"
        if status == 200 and proxied:
            self.failures[domain] = max(0, self.failures[domain] - 1)
            self.key_failures = 0
        return "returned"

    def _blocked_proxy(self, domain: str) -> str:
        self.key_failures += 1
        last = self.key + 1 >= self.keys
        if self.key_failures >= self.rotate_at and not last:
            self.key, self.key_failures = self.key + 1, 0
            return "rotated"
        if last:
            self.exhausted.add(domain)
            return "exhausted"
        self.failures[domain] += 1
        if self.failures[domain] >= self.most:
            self.banned.add(domain)
            return "banned"
        return "failed"


def back_off(responses: DataFrame, keys: int = 2, rotate_at: int = 3, most: int = 5) -> DataFrame:
    """``responses(crawl, seq, domain, status, proxied, ...)`` with ``decision`` and, after each, ``key_index``, ``key_failures``, ``domain_failures`` and ``domain_banned``.

    A blocked direct response is retried by proxy unless the proxy is given up for its domain. A blocked proxied one counts against the key, which
    rotates at ``rotate_at``; on the last key the domain gives the proxy up; otherwise it counts against the domain, which is banned at ``most`` and whose
    later responses are ignored. A proxied success takes one failure from its domain and clears the key's.

    A response's decision depends on all before it in its crawl, so a crawl is walked in order of ``seq`` by one task, a batch of rows at a time: what it holds
    is the state of the crawl at hand, a few numbers a domain, never its rows. Crawls are spread over all tasks. Null domains are one domain; a null
    ``proxied`` counts as false; rows of a null crawl are one crawl; rows of one ``seq`` follow domain, status and proxied.
    """
    columns = responses.columns
    added = [("decision", StringType()), ("key_index", IntegerType()), ("key_failures", IntegerType()), ("domain_failures", IntegerType()), ("domain_banned", BooleanType())]
    schema = StructType([*responses.schema.fields, *[StructField(n, t, False) for n, t in added]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            rows = []
            for crawl, domain, status, proxied in zip(batch["crawl"], batch["domain"], batch["status"], batch["proxied"]):
                crawl, domain = (None if pd.isna(x) else x for x in (crawl, domain))
                if state is None or crawl != current:
                    current, state = crawl, Crawl(keys, rotate_at, most)
                decision = state.step(domain, None if pd.isna(status) else int(status), proxied is not None and not pd.isna(proxied) and bool(proxied))
                rows.append((decision, state.key, state.key_failures, state.failures[domain], domain in state.banned))
            yield batch.assign(**dict(zip([n for n, _ in added], zip(*rows, strict=True), strict=True))) if rows else batch.reindex(columns=[*columns, *[n for n, _ in added]])

    walked = responses.repartition(F.col("crawl")).sortWithinPartitions("crawl", "seq", "domain", "status", "proxied")
    return walked.mapInPandas(run, schema)
