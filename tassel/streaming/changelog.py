"""The current answer of a stream in update mode, from segments that are merged into levels."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import last_per_key
from ..sources.snapshots import Change, SnapshotTable

#: So many segments of one level become one of the next.
FANOUT = 4


class ChangeLog(SnapshotTable):
    """A table of versions whose rows are changes: the newest batch that has a key holds the key's current row.

    Each micro-batch adds one segment of level 0. When a level has ``fanout`` segments, their newest row per key becomes
    one segment of the next level, so a reader opens at most ``fanout - 1`` segments a level, and as many levels as
    the number of batches has digits to the base ``fanout``; a row is merged at most once a level. Segments that
    were merged are deleted once the version after their merge is there too.
    """

    def __init__(self, spark, path: str, keys: list[str], fanout: int = FANOUT):
        super().__init__(spark, path)
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.keys, self.fanout = keys, fanout

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Add a micro-batch; one that was added before, or that is older than the newest, changes nothing.

        Its rows are computed all the same, because a stream writes the state of a batch while the batch is read.
        """
        state = self.state()
        if state is not None and batch_id <= state["applied"]["batch"]:
            rows.write.format("noop").mode("append").save()
            return
        change = rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
        added = self._add(change, [], counted=False)
        if state is None:
            state = {
                "version": 0,
                "schema": json.dumps(change.schema.jsonValue()),
                "keys": [],
                "partition_by": [],
                "applied": {},
                "writes": [],
                "levels": {},
            }
        self._replace(state, [], added, 0, {"batch": batch_id})
        self._merge()
        self.expire(2)

    def _replace(self, state: dict, gone: list[str], added: tuple[str, int], level: int, applied: dict) -> Change:
        left = [tuple(w) for w in state["writes"] if w[0] not in gone]
        levels = {p: n for p, n in state["levels"].items() if p not in gone} | {added[0]: level}
        return self._commit(state | {"levels": levels}, [*left, added], len(gone), len(left), [added], applied)

    def _merge(self) -> None:
        while True:
            state = self.state()
            by_level: dict[int, list[str]] = {}
            for path, level in state["levels"].items():
                by_level.setdefault(level, []).append(path)
            full = [level for level, paths in by_level.items() if len(paths) >= self.fanout]
            if not full:
                return
            level = min(full)
            newest = last_per_key(self._rows(by_level[level], state), self.keys, "batch_id")
            self._replace(state, by_level[level], self._add(newest, [], counted=False), level + 1, {})

    def segments(self) -> dict[str, int]:
        """The open segments with their level."""
        state = self.state()
        return {} if state is None else state["levels"]

    def current(self) -> DataFrame:
        """The newest row of every key."""
        return last_per_key(self.read(), self.keys, "batch_id").drop("batch_id")
