"""A streaming source of recorded live frames, and the reconnection delays of a live one."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

LEAST_WAIT_S, MOST_WAIT_S = 5, 60


def waits(sessions: list[int]) -> list[int]:
    """Seconds to wait after each session, given how many messages it brought: doubling, back to 5 after any."""
    out, wait = [], LEAST_WAIT_S
    for n in sessions:
        wait = LEAST_WAIT_S if n > 0 else wait
        out.append(wait)
        wait = min(wait * 2, MOST_WAIT_S)
    return out


class RecordedFrames(DataSource):
    """Lines of a recorded file of JSON frames, ``rows`` to a micro-batch, with the time that each was received.

    Options: path; rows (1000); start_ms and step_ms, as recordings hold no time of reception.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_frames"

    def schema(self) -> str:
        return "value STRING, received_ms LONG"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.rows = options["path"], int(options.get("rows", 1000))
        self.start_ms, self.step_ms = int(options.get("start_ms", 0)), int(options.get("step_ms", 1000))

    def initialOffset(self) -> dict:
        return {"line": 0}

    def _lines(self, first: int, last: int) -> list[tuple[str, int]]:
        out = []
        with open(self.path, encoding="utf-8") as f:
            for k, line in enumerate(f):
                if first <= k < last:
                    out.append((line.rstrip("\n"), self.start_ms + k * self.step_ms))
                elif k >= last:
                    break
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = self._lines(start["line"], start["line"] + self.rows)
        return iter(found), {"line": start["line"] + len(found)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._lines(start["line"], end["line"]))

    def commit(self, end: dict) -> None:
        pass
