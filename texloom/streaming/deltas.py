"""Messages from streamed token deltas: keyed state that gathers the deltas of a message until its end has come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a delta is: ``last`` marks the end of its message; ``seq`` counts from 0 and may arrive in any order and more than once.
DELTA = "conv_id long, msg long, seq int, delta string, last boolean, at timestamp"
MESSAGE = "conv_id long, msg long, text string, n_deltas int, at timestamp"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cut(messages: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Deltas of at most ``size`` characters of messages (conv_id, msg, ``text``, at); an empty or null text is one empty delta."""
    whole = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.lit(1), F.ceil(F.length(whole) / size)).cast("int")
    each = messages.select("conv_id", "msg", "at", whole.alias("__text"), n.alias("__n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return each.select("conv_id", "msg", "seq", F.substring("__text", F.col("seq") * size + 1, F.lit(size)).alias("delta"), (F.col("seq") == F.col("__n") - 1).alias("last"), "at")


def assembled(deltas: DataFrame) -> DataFrame:
    """MESSAGE rows of the messages of which all deltas up to the last are there: the batch form of ``accumulated``."""
    one = deltas.groupBy("conv_id", "msg", "seq").agg(F.first("delta").alias("delta"), F.max("last").alias("last"), F.max("at").alias("at"))
    parts = one.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(F.struct("seq", "delta"))).alias("d"), F.max(F.when(F.col("last"), F.col("seq"))).alias("end"), F.max("at").alias("at"))
    whole = parts.where(F.size("d") == F.col("end") + 1)
    return whole.select("conv_id", "msg", F.array_join("d.delta", "").alias("text"), F.size("d").alias("n_deltas"), "at")


class Accumulator(StatefulProcessor):
    """The deltas of a message by their number, and the number of the last; both go with the message, or ``keep_ms`` of event time after the newest delta."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "seq int", "delta string")
        self.about = handle.getValueState("about", "end int, n int, at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.about.exists()
        end, n, at = self.about.get() if known else (-1, 0, 0)
        new: dict[int, str] = {}
        for batch in rows:
            for seq, delta, last, when in zip(batch["seq"], batch["delta"], batch["last"], batch["at"], strict=True):
                new.setdefault(int(seq), delta)
                end, at = int(seq) if last else end, max(at, int(when.timestamp() * 1000))
        if not known and len(new) == end + 1:  # a message that is whole in one batch leaves no state: each access is a round trip
            yield self.message(key, [new[k] for k in sorted(new)], at)
            return
        for seq, delta in new.items():
            if not (known and self.parts.containsKey((seq,))):
                self.parts.updateValue((seq,), (delta,))
                n += 1
        if n == end + 1:
            parts = [v[0] for _, v in sorted((k[0], v) for k, v in self.parts.iterator())]
            self.clear()
            yield self.message(key, parts, at)
        else:
            self.about.update((end, n, at))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at + self.keep_ms)

    def message(self, key, parts: list[str], at: int) -> pd.DataFrame:
        return pd.DataFrame({"conv_id": [key[0]], "msg": [key[1]], "text": ["".join(parts)], "n_deltas": [len(parts)], "at": [pd.Timestamp(at, unit="ms")]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.clear()
        return iter(())

    def clear(self) -> None:
        self.parts.clear()
        self.about.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)


def accumulated(deltas: DataFrame, late: str = "1 hour", keep_ms: int = 3_600_000) -> DataFrame:
    """MESSAGE rows of a stream of deltas, each when its last missing delta has come, whatever the micro-batches are.

    State of a message that gets no more deltas goes ``keep_ms`` after its newest one, by the watermark. The session's state store
    is to be STATE_STORE.
    """
    keyed = deltas.withWatermark("at", late).groupBy("conv_id", "msg")
    return keyed.transformWithStateInPandas(Accumulator(keep_ms), outputStructType=MESSAGE, outputMode="Append", timeMode="EventTime")
