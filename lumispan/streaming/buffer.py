"""A buffer of traces in front of training, which is flushed when it holds enough traces or has been quiet long enough.

Traces are dealt by hash over buffers, as over parallel collectors. A buffer keeps each span under its trace and id, the
later one of equal ids, and counts the traces that it holds. It hands all of them on, as one flush, at the arrival that
makes it full, and by a timer when nothing has arrived for a while. Spans of a trace that was handed on begin a new,
partial trace. State is kept per span, so a trace may be of any length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .traces import SPAN_COLUMNS, BufferConfig

OUT = (
    "buffer int, flush bigint, trace_id string, span_id string, parent_span_id string, service string, operation string, kind string, "
    "status string, start_us bigint, dur_us bigint"
)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a flush that are handed to Spark at a time.
SLICE = 10_000


class TraceBuffer(StatefulProcessor):
    def __init__(self, max_traces: int, quiet_ms: int):
        self.max_traces, self.quiet_ms = max_traces, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getMapState("spans", "trace_id string, span_id string", "row string")
        self.traces = handle.getMapState("traces", "trace_id string", "n bigint")
        self.meta = handle.getValueState("meta", "held bigint, flushes bigint, timer bigint")

    def _meta(self) -> tuple[int, int, int]:
        return tuple(self.meta.get()) if self.meta.exists() else (0, 0, 0)

    def _flush(self, key: tuple, number: int) -> Iterator[pd.DataFrame]:
        rows = []
        for _, (row,) in self.spans.iterator():
            rows.append((int(key[0]), number, *json.loads(row)))
            if len(rows) >= SLICE:
                yield pd.DataFrame(rows, columns=["buffer", "flush", *SPAN_COLUMNS])
                rows = []
        yield pd.DataFrame(rows, columns=["buffer", "flush", *SPAN_COLUMNS])
        self.spans.clear()
        self.traces.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, flushes, timer = self._meta()
        for batch in rows:
            values = batch[SPAN_COLUMNS].astype(object).where(batch[SPAN_COLUMNS].notna(), None).to_numpy().tolist()
            for r in values:
                trace = (r[0] or "",)
                if not self.traces.containsKey(trace):
                    self.traces.updateValue(trace, (1,))
                    held += 1
                self.spans.updateValue((r[0] or "", r[1] or ""), (json.dumps(r, default=int),))
                if held >= self.max_traces:
                    yield from self._flush(key, flushes)
                    held, flushes = 0, flushes + 1
        if timer:
            self.handle.deleteTimer(timer)
            timer = 0
        if held:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
            self.handle.registerTimer(timer)
        self.meta.update((held, flushes, timer))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, flushes, _ = self._meta()
        if held:
            yield from self._flush(key, flushes)
            self.meta.update((0, flushes + 1, 0))

    def close(self) -> None:
        pass


def buffered(stream: DataFrame, config: BufferConfig = BufferConfig(), buffers: int = 1) -> DataFrame:
    """The spans of a stream in flushes: buffer, flush (numbered per buffer) and the span columns. The session must keep
    state in RocksDB (``ROCKS``), which timers need."""
    dealt = stream.select(F.pmod(F.xxhash64("trace_id"), F.lit(buffers)).cast("int").alias("buffer"), *SPAN_COLUMNS)
    processor = TraceBuffer(config.max_traces_per_model, config.flush_seconds * 1000)
    return dealt.groupBy("buffer").transformWithStateInPandas(processor, OUT, "append", "ProcessingTime")
