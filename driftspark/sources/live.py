"""Raw frames from append-only logs, as a Python data source with offsets: what a receiver writes, a line per frame, into files of a folder.

An offset says how many bytes of each file have been read, so a query that is started again on its checkpoint goes on where it was; lines are
taken when their newline is there. The folder must be one that the driver and all executors see under the same path; for object
stores and buses use ``telemetry.stream_frames``, which reads by Spark's own sources.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: A partition reads about so many bytes.
PIECE = 32 << 20


class Piece(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def whole_lines(path: str, known: int = 0, block: int = 1 << 16) -> int:
    """Where the last complete line of a file ends, looked for from its end; not before ``known``."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > known:
            begin = max(known, at - block)
            f.seek(begin)
            cut = f.read(at - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            at = begin
    return known


class LogReader(DataSourceStreamReader):
    def __init__(self, path: str, piece: int):
        self.path, self.piece, self.known = path, piece, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        names = sorted(n for n in os.listdir(self.path) if not n.startswith((".", "_")))
        self.known = {n: end for n in names if (end := whole_lines(f"{self.path}/{n}", self.known.get(n, 0)))}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        """Pieces of what is new in each file; a piece has the lines that begin in it."""
        return [Piece(n, at, min(at + self.piece, upto)) for n, upto in sorted(end.items()) for at in range(start.get(n, 0), upto, self.piece)]

    def read(self, partition: Piece):
        with open(f"{self.path}/{partition.file}", "rb") as f:
            at = partition.start
            if at:  # a line that began before belongs to the piece before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                yield line.decode("utf-8", "replace").rstrip("\r\n"), partition.file, at
                at += len(line)

    def commit(self, end: dict) -> None:
        """Nothing to let go: the log keeps its lines."""


class FrameLog(DataSource):
    """Format ``frame_log``: option path, and piece for the bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "frame_log"

    def schema(self) -> str:
        return "value string, file string, at long"

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options["path"].removeprefix("file://"), int(self.options.get("piece", PIECE)))


def log_frames(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of (value, file, at): raw frames, and where each line stands."""
    spark.dataSource.register(FrameLog)
    return spark.readStream.format("frame_log").options(path=path, **options).load()
