"""A stream of finished models from a folder, as a data source with offsets.

The offset is the name of the last model that was handed on, so a restart repeats none. A reader that fell behind gets
the newest ``queue`` models of what it missed; the older ones are dropped and counted. A store that can't be listed is
asked again after growing pauses, and after the last attempt there is nothing new for now.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "name string, path string, dropped bigint"
FIRST_PAUSE, LONGEST_PAUSE, ATTEMPTS = 1.0, 30.0, 6


def listed(path: str, marker: str) -> list[str]:
    """The names of the folders under ``path`` that hold the marker, in order."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    found = [x.base_name for x in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.type == fs.FileType.Directory]
    found = [n for n in found if not n.startswith(("_", "."))]
    marks = store.get_file_info([f"{base}/{n}/{marker}" for n in found]) if found else []
    return sorted(n for n, m in zip(found, marks, strict=True) if m.type != fs.FileType.NotFound)


class Models(InputPartition):
    def __init__(self, names: list[str], dropped: int):
        super().__init__(names)
        self.dropped = dropped


class FeedReader(DataSourceStreamReader):
    def __init__(self, path: str, queue: int, marker: str, first_pause: float = FIRST_PAUSE):
        if queue <= 0:
            raise ValueError("queue must be positive")
        self.path, self.queue, self.marker, self.first_pause = path.rstrip("/"), queue, marker, first_pause
        self.latest = ""

    def names(self) -> list[str] | None:
        pause = self.first_pause
        for attempt in range(ATTEMPTS):
            try:
                return listed(self.path, self.marker)
            except OSError:
                if attempt + 1 < ATTEMPTS:
                    time.sleep(pause)
                    pause = min(2 * pause, LONGEST_PAUSE)
        return None

    def initialOffset(self) -> dict:
        return {"upto": ""}

    def latestOffset(self) -> dict:
        names = self.names()
        if names:
            self.latest = max(self.latest, names[-1])
        return {"upto": self.latest}

    def partitions(self, start: dict, end: dict) -> list[Models]:
        names = [n for n in self.names() or [] if start["upto"] < n <= end["upto"]]
        kept = names[-self.queue :]
        return [Models(kept, len(names) - len(kept))] if kept else []

    def read(self, partition: Models) -> Iterator[tuple[str, str, int]]:
        for i, name in enumerate(partition.value):
            yield name, f"{self.path}/{name}", partition.dropped if i == 0 else 0

    def commit(self, end: dict) -> None:
        pass


class ModelFeed(DataSource):
    """Options: path, queue (models kept of what was missed, 16), marker (what a finished model holds)."""

    @classmethod
    def name(cls) -> str:
        return "model_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        o = self.options
        return FeedReader(o["path"], int(o.get("queue", 16)), o.get("marker", "done/_SUCCESS"), float(o.get("pause", FIRST_PAUSE)))
