"""Streamed answer parts, committed as messages when complete; open ones are kept as state."""
from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from filigree.operators.messages import ERROR, FINISH, SOURCE, TEXT

COMPLETE, FAILED, EXPIRED = "complete", "error", "expired"
ENDED = Row("message_id", "status", "text", "n_deltas", "n_sources", "error")
ENDED_FIELDS = "message_id string, status string, text string, n_deltas long, n_sources long, error string"
#: What the query needs of the session when it starts: state with several columns a key, and
#: no batches without parts, which timers by the clock would call for without end.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}


def milliseconds(interval: str) -> int:
    """`10 minutes` as milliseconds."""
    found = re.fullmatch(r"\s*(\d+)\s*(millisecond|second|minute|hour|day)s?\s*", interval)
    if not found:
        raise ValueError(f"not an interval: {interval}")
    number, unit = int(found[1]), found[2]
    return number if unit == "millisecond" else number * UNITS[unit] * 1000


class TurnAssembler(StatefulProcessor):
    """The state of one message.

    `parts` is appended to, one block for the parts that come together, and read only when
    the message may be whole. `turn` says whether it has ended, how many parts have come and
    which one is the last. A message ends with an error part, or when `finish` and every part
    before it have come, in any order and possibly twice; or it expires `idle` after its last
    part. Then its parts go, and a mark stays for `keep`, so that a late part does not open it
    again. Every call of the state costs a round trip, whatever it carries.
    """

    def __init__(self, idle: int, keep: int):
        self.idle, self.keep = idle, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "block array<struct<seq:int,part_type:string,payload:string>>")
        self.turn = handle.getValueState("turn", "ended boolean, n long, last int, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (message,) = key
        before = self.turn.get()
        ended, n, last, _ = before or (False, 0, None, 0)
        if ended:
            return
        new = [(row["seq"], row["part_type"], row["payload"]) for row in rows]
        finish = next((seq for seq, kind, _ in new if kind == FINISH), None)
        last = last if finish is None else finish
        error = next((payload or "" for _, kind, payload in new if kind == ERROR), None)
        now = timerValues.getCurrentProcessingTimeInMs()
        if before is None:
            self.handle.registerTimer(now + self.idle)
        held, n = n, n + len(new)
        if error is not None:
            yield self._end(message, FAILED, [], error, now, held)
            return
        if last is not None and n > last:
            earlier = [tuple(part) for (block,) in self.parts.get() for part in block] if held else ()
            whole = {seq: (kind, payload) for seq, kind, payload in [*earlier, *new] if seq <= last}
            if len(whole) == last + 1:
                yield self._end(message, COMPLETE, [whole[i] for i in range(last + 1)], None, now, held)
                return
        self.parts.appendValue((new,))
        self.turn.update((False, n, last, now + self.idle))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A message has one timer; it is set again if more parts, or the end, came meanwhile."""
        (message,) = key
        turn, now = self.turn.get(), timerValues.getCurrentProcessingTimeInMs()
        if turn is None:
            return
        ended, n, _, until = turn
        if now < until:
            self.handle.registerTimer(until)
        elif ended:
            self.turn.clear()
        else:
            self.handle.registerTimer(now + self.keep)
            yield self._end(message, EXPIRED, [], None, now, n)

    def _end(self, message, status, parts, error, now, held) -> Row:
        if held:
            self.parts.clear()
        self.turn.update((True, 0, None, now + self.keep))
        said = [payload or "" for kind, payload in parts if kind == TEXT]
        text = "".join(said) if status == COMPLETE else None
        return ENDED(message, status, text, len(said), sum(kind == SOURCE for kind, _ in parts), error)

    def close(self) -> None:
        pass


def ended_messages(parts: DataFrame, *, idle: str = "10 minutes", keep: str = "1 day") -> DataFrame:
    """A stream of messages `(message_id, status, text, n_deltas, n_sources, error)` that end,
    from a stream of parts; each message once. Start it within `started_with(spark)`."""
    return parts.groupBy("message_id").transformWithState(
        statefulProcessor=TurnAssembler(milliseconds(idle), milliseconds(keep)),
        outputStructType=ENDED_FIELDS,
        outputMode="append",
        timeMode="processingTime",
    )


@contextmanager
def started_with(spark: SparkSession):
    """`SETTINGS` for the queries started within; they keep them."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def commit_available(parts: DataFrame, path: str, *, idle: str = "10 minutes", keep: str = "1 day") -> None:
    """Take the available parts, commit the messages that ended to `<path>/ended`, then stop.

    Only what is new is written: the file sink appends the ended messages of a micro-batch
    once, also if the batch runs again, and the state in `<path>/checkpoint` changes by the
    new parts. Messages expire in the next batch that has parts. Nothing partial is committed.
    """
    writer = (
        ended_messages(parts, idle=idle, keep=keep)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/ended")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
    )
    with started_with(parts.sparkSession):
        query = writer.start()
    query.awaitTermination()


def _ended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENDED_FIELDS).parquet(f"{path}/ended")


def committed_messages(spark: SparkSession, path: str) -> DataFrame:
    return _ended(spark, path).where(f"status = '{COMPLETE}'").drop("error")


def failed_messages(spark: SparkSession, path: str) -> DataFrame:
    return _ended(spark, path).where(f"status = '{FAILED}'").select("message_id", "error")


def expired_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages that never ended."""
    return _ended(spark, path).where(f"status = '{EXPIRED}'").select("message_id")
