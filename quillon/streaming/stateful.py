"""Streams that remember: the last alert level of a key, and a learning registry with examples and promotion.

State lies in RocksDB beside the checkpoint, so a stream goes on where it was after a lost executor or driver. What a key keeps is
bounded: one level, or two counters, twenty examples and the categories seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Examples of a parameter, their length, and the frequency at which it is promoted.
EXAMPLES, EXAMPLE_CHARS, PROMOTED_AT = 20, 200, 50


def _in_rocks(spark: SparkSession) -> None:
    """Streams with several state variables need this store; it is chosen before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class LastLevel(StatefulProcessor):
    """Passes a check on if its level is another than the last one sent for its key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "level string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        checks = pd.concat(list(rows)).dropna(subset=["level"]).sort_values(["at", "check_id"], kind="stable")
        if not len(checks):
            return
        before = self.last.get()[0] if self.last.exists() else None
        new = checks["level"] != checks["level"].shift(fill_value=before if before is not None else "\x00")
        self.last.update((checks["level"].iloc[-1],))
        if new.any():
            yield checks.loc[new, ["key", "check_id", "level"]]

    def close(self) -> None:
        pass


def new_levels(checks: DataFrame) -> DataFrame:
    """(key, check_id, level) of the checks of a stream (key, check_id, at, level) that are sent: the level differs from the last one sent.

    A level that comes back after another one is sent again. Checks of one micro-batch are taken in the order of ``at`` and
    check_id, later batches after earlier ones. A null level sends nothing and is not remembered; null keys are one key.
    """
    _in_rocks(checks.sparkSession)
    kind = checks.schema["check_id"].dataType.simpleString()
    keyed = checks.select("key", "check_id", "at", "level").groupBy("key")
    return keyed.transformWithStateInPandas(LastLevel(), f"key {checks.schema['key'].dataType.simpleString()}, check_id {kind}, level string", "Append", "None")


class Registry(StatefulProcessor):
    """Counts a parameter's sightings, keeps its first different examples and its categories, and promotes it once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "frequency long, promoted boolean")
        self.examples = handle.getMapState("examples", "example string", "place int")
        self.categories = handle.getMapState("categories", "category string", "known boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frequency, promoted = self.seen.get() if self.seen.exists() else (0, False)
        known = {e[0]: p[0] for e, p in self.examples.iterator()}
        # a batch of a key may have many rows: of each part only counts, categories and the earliest of its examples stay
        firsts: dict[str, tuple] = {}
        for part in rows:
            frequency += len(part)
            for category in part["category"].dropna().unique():
                self.categories.updateValue((category,), (True,))
            said = part[part["example"].notna() & (part["example"] != "")].assign(example=lambda f: f["example"].str.slice(0, EXAMPLE_CHARS))
            for row in said.sort_values(["at", "example"], kind="stable").drop_duplicates("example").itertuples():
                if row.example not in known:
                    firsts[row.example] = min(firsts.get(row.example, (row.at, row.example)), (row.at, row.example))
            if len(firsts) > 2 * EXAMPLES:
                firsts = dict(sorted(firsts.items(), key=lambda x: x[1])[:EXAMPLES])
        for example, _ in sorted(firsts.items(), key=lambda x: x[1])[: EXAMPLES - len(known)]:
            known[example] = len(known)
            self.examples.updateValue((example,), (known[example],))
        event = "promoted" if frequency >= PROMOTED_AT and not promoted else "seen"
        self.seen.update((frequency, promoted or event == "promoted"))
        n = sum(1 for _ in self.categories.keys())
        yield pd.DataFrame({"parameter": [key[0]], "event": [event], "frequency": [frequency], "categories": [n], "examples": [[e for e, _ in sorted(known.items(), key=lambda x: x[1])]]})

    def close(self) -> None:
        pass


def learned(sightings: DataFrame) -> DataFrame:
    """(parameter, event, frequency, categories, examples) of a stream of sightings (parameter, category, example, at).

    Each micro-batch gives a row for each parameter it holds, with all that is known by then; ``event`` is ``promoted``
    once, when the frequency reaches fifty, else ``seen``. The first twenty different examples stay, each cut to 200 characters; within a batch
    in the order of ``at``. Null or empty examples and null categories count as sightings only.
    """
    _in_rocks(sightings.sparkSession)
    keyed = sightings.select("parameter", "category", "example", "at").groupBy("parameter")
    return keyed.transformWithStateInPandas(Registry(), "parameter string, event string, frequency long, categories long, examples array<string>", "Update", "None")
