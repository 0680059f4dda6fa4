"""Remembered choices, kept up event by event as keyed state, or computed at once from a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MEMORY = "codes_key string, position long, doc_ids array<string>"


def choices(events: DataFrame, least: int = 4) -> DataFrame:
    """The events that are remembered, ``(codes_key, doc_id, event_id)`` of ``events(event_id, codes, doc_id, rating)``: rated ``least`` or better, or not rated.

    The key is the sorted codes joined by commas, repeats included. Events with null codes, documents or ids are left out.
    """
    good = F.col("rating").isNull() | (F.col("rating") >= least)
    known = F.col("codes").isNotNull() & F.col("doc_id").isNotNull() & F.col("event_id").isNotNull()
    return events.where(good & known).select(F.array_join(F.array_sort("codes"), ",").alias("codes_key"), F.col("doc_id").cast("string").alias("doc_id"), F.col("event_id").cast("long").alias("event_id"))


def remembered(events: DataFrame, least: int = 4) -> DataFrame:
    """Of a whole table: by key its distinct documents in order of their first event, and the key's own first event (``position``)."""
    first = choices(events, least).groupBy("codes_key", "doc_id").agg(F.min("event_id").alias("event_id"))
    by_key = first.groupBy("codes_key").agg(F.min("event_id").alias("position"), F.array_sort(F.collect_list(F.struct("event_id", "doc_id"))).alias("d"))  # distinct documents of a key
    return by_key.select("codes_key", "position", F.transform("d", lambda x: x["doc_id"]).alias("doc_ids"))


class _Remember(StatefulProcessor):
    """A key's state: the least event id of every document, so neither the order of arrival nor the cut into triggers matters."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "doc_id string", "event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed = False
        for batch in rows:
            for doc, event in batch.groupby("doc_id")["event_id"].min().items():
                if not self.first.containsKey((doc,)) or self.first.getValue((doc,))[0] > event:
                    self.first.updateValue((doc,), (int(event),))
                    changed = True
        if changed:
            held = sorted((event[0], doc[0]) for doc, event in self.first.iterator())
            yield pd.DataFrame([(key[0], held[0][0], [d for _, d in held])], columns=["codes_key", "position", "doc_ids"])

    def close(self) -> None:
        pass


def remember(events: DataFrame, least: int = 4) -> DataFrame:
    """The same of a stream, in update mode: after a trigger, the memory of each key that it changed. The last row of a key over all triggers is
    what ``remembered`` gives of all events. The session needs Spark's RocksDB state store."""
    by_key = choices(events, least).groupBy("codes_key")
    return by_key.transformWithStateInPandas(_Remember(), outputStructType=MEMORY, outputMode="Update", timeMode="None")


def patterns(memory: DataFrame) -> DataFrame:
    """The memory as ``retrieval.overlap_boost`` takes it: ``(position, codes, doc_ids)``; an empty key has no codes."""
    codes = F.when(F.col("codes_key") == "", F.array().cast("array<string>")).otherwise(F.split("codes_key", ","))
    return memory.select("position", codes.alias("codes"), "doc_ids")
