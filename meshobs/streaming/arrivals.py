"""State of a stream of messages, kept by Spark's state store: what has come before, by packet and by observer.

Every packet has a keyed state with the observations that it has had, their number, and whether its message is known; every observer has the windows that have a
telemetry snapshot.  So a micro-batch learns from its own keys' state which of its rows are new, and no history is read.  Keys free their state by timers.  A
timer's clock is the time of the micro-batches, which never runs back, so no row is ever late.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructType

from ..functions import expr as X

#: The state store that ``transformWithState`` needs; to be set in the session before the stream starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: How long after a key's last row its observations can have copies, and how long it is known at all: a copy's time is within an hour of the first's, and packets are kept for 30 days.
HOLD_S, KEEP_S = 2 * 86_400, 30 * 86_400


def micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def _with_marks(row: Row, columns: list[str], **marks) -> Row:
    """A row as it goes out again, its structs as dictionaries, with what it is."""
    values = row.asDict(recursive=True)
    return Row(**{c: values[c] for c in columns}, **marks)


class _Timed(StatefulProcessor):
    """Frees a key's short-lived state ``hold_s`` after its last row, and all of it after ``keep_s``."""

    def __init__(self, hold_s: float, keep_s: float):
        self.hold, self.keep = int(hold_s * 1000), int(keep_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def touch(self, now: int) -> None:
        """A row came: what is freed waits from now on."""
        self.last.update((now,))
        self.handle.registerTimer(now + self.hold)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None and at >= last + self.keep:
            self.free_all()
            self.last.clear()
        elif last is not None and at >= last + self.hold:
            self.free_short()
            self.handle.registerTimer(last + self.keep)
        return iter(())

    def close(self) -> None:
        pass


class PacketState(_Timed):
    """Rows of one packet in order of arrival, each with what it is: a new observation, the packet's n-th, with a first readable message."""

    def __init__(self, columns: list[str], hold_s: float, keep_s: float):
        super().__init__(hold_s, keep_s)
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.count = handle.getValueState("count", "n long")
        self.said = handle.getValueState("said", "yes boolean")
        self.seen = handle.getMapState("seen", "observer string, heard long", "yes boolean")

    def free_short(self) -> None:
        self.seen.clear()

    def free_all(self) -> None:
        for state in (self.seen, self.count, self.said):
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        n = self.count.get()[0] if self.count.exists() else 0
        said = self.said.exists()
        self.touch(timerValues.getCurrentWatermarkInMs())
        for row in sorted(rows, key=lambda r: r["seq"]):
            mark = (row["_observer"], row["_heard"])
            new = not self.seen.containsKey(mark)
            if new:
                self.seen.updateValue(mark, (True,))
                n += 1
            speaks = bool(row["_speaks"]) and not said
            said = said or speaks
            yield _with_marks(row, self.columns, new_observation=new, observation_count=n if new else None, new_message=speaks)
        self.count.update((n,))
        if said:
            self.said.update((True,))


class StatusState(_Timed):
    """Statuses of one observer in order of arrival; the first of each window is new."""

    def __init__(self, columns: list[str], hold_s: float, keep_s: float):
        super().__init__(hold_s, keep_s)
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.windows = handle.getMapState("windows", "start long", "yes boolean")

    def free_short(self) -> None:
        pass

    def free_all(self) -> None:
        self.windows.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        self.touch(timerValues.getCurrentWatermarkInMs())
        for row in sorted(rows, key=lambda r: r["seq"]):
            new = not self.windows.containsKey((row["_window"],))
            if new:
                self.windows.updateValue((row["_window"],), (True,))
            yield _with_marks(row, self.columns, new_window=new)


def _stateful(rows: DataFrame, key: str, processor: type[_Timed], flags: StructType, hold_s: float, keep_s: float) -> DataFrame:
    spark = rows.sparkSession
    if spark.conf.get(PROVIDER[0], None) != PROVIDER[1]:
        raise ValueError(f"the session needs {PROVIDER[0]} = {PROVIDER[1]}")
    columns = [c for c in rows.columns if not c.startswith("_")]
    schema = StructType([rows.schema[c] for c in columns] + flags.fields)
    timed = rows.withColumns({"_key": F.col(key), "_at": F.current_timestamp()}).withWatermark("_at", "0 seconds")
    return timed.groupBy("_key").transformWithState(processor(columns, hold_s, keep_s), schema, "append", "eventTime")


def packets_with_state(packets: DataFrame, *, hold_s: float = HOLD_S, keep_s: float = KEEP_S) -> DataFrame:
    """A stream of decoded packets with ``new_observation``, ``observation_count`` (null for a copy) and ``new_message``.

    The first arrival of a (packet, observer, time) is new, whichever broker it comes by; later ones are copies.  The count runs over the packet's new
    observations, so the first has 1.  A copy that comes more than ``hold_s`` after the packet's last row counts as new, and a packet that has been silent for ``keep_s``,
    the time after which packets are removed, begins anew.
    """
    flags = StructType().add("new_observation", BooleanType()).add("observation_count", LongType()).add("new_message", BooleanType())
    heard = X.heard_at(F.col("timestamp_text"), F.col("arrival_ts")) if "heard_at" not in packets.columns else F.col("heard_at")
    speaks = F.coalesce(F.col("message.ok") & (F.col("payload_type") == X.PAYLOAD_GROUP_TEXT), F.lit(False)) if "message" in packets.columns else F.lit(False)
    rows = packets.withColumns({"_observer": F.coalesce("observer_pubkey", F.lit("")), "_heard": F.unix_micros(heard.cast("timestamp")), "_speaks": speaks})
    return _stateful(rows, "packet_hash", PacketState, flags, hold_s, keep_s)


def statuses_with_state(status: DataFrame, *, resolution_s: int = 3600, keep_s: float = KEEP_S) -> DataFrame:
    """T4: a stream of statuses with ``new_window``: whether it is the first of its observer in its window of ``resolution_s``."""
    flags = StructType().add("new_window", BooleanType())
    rows = status.withColumn("_window", micros("arrival_ts") - F.pmod(micros("arrival_ts"), F.lit(resolution_s * 1_000_000)))
    return _stateful(rows, "pubkey", StatusState, flags, keep_s, keep_s)
