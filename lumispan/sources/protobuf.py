"""OTLP protobuf files: a sink that deals traces over chunk files, and spans of generated features.

The wire format is written and read by hand, since the distribution at hand has no Protobuf package for Spark; a file is
a run of resource messages, so neither side needs more than one of them at a time to write.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.expressions import KINDS, PRIMARY_KEYS, signature_value
from ..schema import ModelConfig

#: Spans of one service that a resource message holds at most; a longer run of them becomes several messages.
PER_MESSAGE = 10_000
COLUMNS = ("chunk", "trace_id", "span_id", "parent_span_id", "service", "operation", "kind", "status", "start_us", "dur_us", "attrs")


def fnv1a(text: Column) -> Column:
    """32 bits of the FNV-1a hash of a string's bytes."""
    digits = F.hex(F.encode(text, "UTF-8"))
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint")
    step = lambda h, i: F.pmod(h.bitwiseXOR(byte(i)) * 16_777_619, F.lit(1 << 32))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(2_166_136_261).cast("bigint"), step)


def _varint(x: int) -> bytes:
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def _bytes(n: int, v: bytes) -> bytes:
    return _varint(n << 3 | 2) + _varint(len(v)) + v


def _number(n: int, v: int) -> bytes:
    return _varint(n << 3) + _varint(v) if v else b""


def _fixed(n: int, v: int) -> bytes:
    return _varint(n << 3 | 1) + v.to_bytes(8, "little")


def _pair(key: str, value: str) -> bytes:
    return _bytes(1, key.encode()) + _bytes(2, _bytes(1, value.encode()))


def span_message(r: Row) -> bytes:
    """A span; ids are hexadecimal."""
    kind = KINDS.index(r["kind"]) if r["kind"] in KINDS else 0
    start = (r["start_us"] or 0) * 1000
    parts = [_bytes(1, bytes.fromhex(r["trace_id"] or "")), _bytes(2, bytes.fromhex(r["span_id"] or ""))]
    if r["parent_span_id"]:
        parts.append(_bytes(4, bytes.fromhex(r["parent_span_id"])))
    parts += [_bytes(5, (r["operation"] or "").encode()), _number(6, kind), _fixed(7, start), _fixed(8, start + (r["dur_us"] or 0) * 1000)]
    parts += [_bytes(9, _pair(k, v)) for k, v in sorted((r["attrs"] or {}).items()) if v]
    return b"".join(parts) + _bytes(15, _number(3, int(r["status"]) if r["status"] in ("1", "2") else 0))


def resource_message(service: str | None, spans: list[bytes]) -> bytes:
    """The spans of one service as a field of a request."""
    resource = _bytes(1, _bytes(1, _pair("service.name", service or "unknown")))
    return _bytes(1, resource + _bytes(2, b"".join(_bytes(2, s) for s in spans)))


def messages(rows: Iterable[Row]) -> Iterator[tuple[int, bytes]]:
    """Chunk and resource message, for rows in order of chunk, trace and service."""
    key, held = None, []
    for r in rows:
        now = (r["chunk"], r["trace_id"], r["service"])
        if held and (now != key or len(held) >= PER_MESSAGE):
            yield key[0], resource_message(key[2], held)
            held = []
        key = now
        held.append(span_message(r))
    if held:
        yield key[0], resource_message(key[2], held)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ChunkWriter(DataSourceWriter):
    """Each task writes its chunks beside the target; they get their names once all tasks are done."""

    def __init__(self, path: str):
        self.path, self.token = path, uuid.uuid4().hex

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def write(self, iterator: Iterator[Row]) -> Written:
        store, base = self._fs()
        store.create_dir(f"{base}/_{self.token}", recursive=True)
        name, out, files = None, None, []
        attempt = uuid.uuid4().hex
        for chunk, message in messages(iterator):
            if chunk != name:
                if out:
                    out.close()
                name = chunk
                files.append(f"{base}/_{self.token}/{attempt}-chunk_{chunk:04d}.pb")
                out = store.open_output_stream(files[-1])
            out.write(message)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = self._fs()
        for m in messages:
            for f in m.files if m else []:
                store.move(f, f"{base}/{f.rsplit('-', 1)[1]}")
        store.delete_dir(f"{base}/_{self.token}") if store.get_file_info(f"{base}/_{self.token}").type.name == "Directory" else None

    def abort(self, messages: list[Written | None]) -> None:
        store, base = self._fs()
        if store.get_file_info(f"{base}/_{self.token}").type.name == "Directory":
            store.delete_dir(f"{base}/_{self.token}")


class OtlpProtoSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "otlp_proto"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ChunkWriter(self.options["path"])


def write_otlp_proto(spans: DataFrame, path: str, files: int) -> None:
    """Files chunk_0000.pb and on: a trace is in the file that the FNV-1a hash of its id names. The folder must be one that
    driver and executors share."""
    spans.sparkSession.dataSource.register(OtlpProtoSink)
    rows = spans.withColumn("chunk", F.pmod(fnv1a(F.coalesce("trace_id", F.lit(""))), F.lit(files)).cast("int")).select(*COLUMNS)
    rows = rows.repartitionByRange(files, "chunk").sortWithinPartitions("chunk", "trace_id", "service", "start_us", "span_id")
    rows.write.format("otlp_proto").mode("append").option("path", path).save()


def spans_of_features(generated: DataFrame, config: ModelConfig) -> DataFrame:
    """Generated spans, whose names are in their feature, as spans; dependent attributes become attributes again."""
    columns = {c: signature_value(F.col("feature"), c) for c in config.primary}
    pairs = [F.struct(F.lit(c), columns[c]) for c in config.primary if c not in PRIMARY_KEYS] + [F.struct(F.lit(d), F.col(d)) for d in config.dependent]
    none = F.create_map().cast("map<string,string>")
    attrs = F.map_filter(F.map_from_entries(F.array(*pairs)), lambda k, v: F.coalesce(v, F.lit("")) != "") if pairs else none
    own = [columns[c].alias(c) if c in columns else F.lit("").alias(c) for c in ("service", "operation", "kind", "status")]
    return generated.select("trace_id", F.substring("span_id", 1, 16).alias("span_id"), F.substring("parent_span_id", 1, 16).alias("parent_span_id"), *own, "start_us", "dur_us", attrs.alias("attrs"))
