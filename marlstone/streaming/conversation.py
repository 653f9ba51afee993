"""What a conversation has told so far, kept by a stream: counts of wishes, the last budgets, failures in a row, and forgetting."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from json import loads

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Budgets that are remembered.
BUDGETS = 10
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW = "n_turns long, failures long, intent string, tastes string, budgets string"


class _Conversation(StatefulProcessor):
    """State of several kinds for each key: a value (turns, failures in a row, last time and intent), a map of what was wished how often, and a list of budgets.

    A turn that comes longer than the gap after the last one starts anew. A timer clears a key that has been silent for so
    long, so that what is kept doesn't grow with all keys there ever were; it changes no result.
    """

    def __init__(self, key: str, slots: list[str], gap: int):
        self.key, self.slots, self.gap = key, slots, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.summary = handle.getValueState("summary", "n_turns long, failures long, at long, intent string")
        self.wishes = handle.getMapState("wishes", "slot string, value string", "n long")
        self.spent = handle.getListState("budgets", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Each call to the state is a message to Spark, so a key that nothing is known of reads and clears nothing, and of another only what changed is written."""
        last = lambda x: (x is None, x)
        told = self.summary.get()
        n, run, at, intent = told or (0, 0, None, None)
        known = {tuple(k): v[0] for k, v in self.wishes.iterator()} if told else {}
        spent = [v[0] for v in self.spent.get()] if told else []
        before, wishes, budgets = at, Counter(known), spent
        turns = [(order, loads(told_)) for _, order, _, told_ in map(tuple, rows)]
        for _, row in sorted(turns, key=lambda r: (last(r[0]), last(r[1].get("at")))):
            when = row.get("at")
            if at is not None and when is not None and when - at > self.gap:
                n, run, wishes, budgets = 0, 0, Counter(), []
            n, run, at, intent = n + 1, run + 1 if row["failed"] else 0, at if when is None else when, row.get("intent")
            wishes.update((s, v) for s, v in zip(self.slots, row["slots"], strict=True) if v and isinstance(v, str))
            if "budget" in row:
                budgets = [*budgets, float(row["budget"])][-BUDGETS:]
        self.summary.update((n, run, at, intent))
        for wish in known.keys() - wishes.keys():
            self.wishes.removeKey(wish)
        for wish, count in wishes.items():
            if known.get(wish) != count:
                self.wishes.updateValue(wish, (count,))
        if budgets != spent:
            self.spent.put([(b,) for b in budgets]) if budgets else self.spent.clear()
        if at != before:
            if before is not None:
                self.handle.deleteTimer(before + self.gap)
            self.handle.registerTimer(at + self.gap)
        tastes = ";".join(f"{s}:{v}={c}" for (s, v), c in sorted(wishes.items()))
        yield Row(**{self.key: key[0], "n_turns": n, "failures": run, "intent": intent, "tastes": tastes, "budgets": ";".join(f"{b:.2f}" for b in budgets)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        told = self.summary.get()
        if told and told[2] is not None and told[2] + self.gap <= timerValues.getCurrentWatermarkInMs():
            for state in (self.summary, self.wishes, self.spent):
                state.clear()
        return iter(())

    def close(self) -> None:
        pass


def conversations(turns: DataFrame, key: str, order: str, at: str, failed: str, intent: str, slots: list[str], budget: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(key, n_turns, failures, intent, tastes, budgets): after each batch what every key that spoke has told since its last silence of ``gap``.

    ``tastes`` are the values of ``slots`` with how often each was wished, ``budgets`` the last ten that were named; a slot
    or budget that is null or empty names none. Batches count by arrival, rows of a batch by ``order``; rows that come more
    than ``late`` behind the newest are dropped. ``state_store`` must be called before the stream starts.
    """
    # Each value of a row that goes to the processor is converted by itself, so what a turn tells goes as one. Names that begin with an underscore don't reach it.
    spent = F.col(budget).cast("double")
    told = {"at": F.unix_millis(at), "failed": F.coalesce(failed, F.lit(False)), "intent": F.col(intent), "budget": F.when((spent > 0) & ~F.isnan(spent), spent), "slots": F.array(*slots)}
    rows = turns.withWatermark(at, late).select(key, F.col(order).alias("x_order"), F.col(at).alias("x_time"), F.to_json(F.struct(*[c.alias(n) for n, c in told.items()])).alias("x_told"))
    kind = dict(turns.dtypes)[key]
    return rows.groupBy(key).transformWithState(statefulProcessor=_Conversation(key, slots, int(pd.Timedelta(gap).total_seconds() * 1000)), outputStructType=f"{key} {kind}, {_ROW}", outputMode="Update", timeMode="EventTime")


def state_store(spark: SparkSession) -> None:
    """State of several kinds needs the store on disk, which also keeps it out of the executors' heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
