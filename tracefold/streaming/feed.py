"""Segment bytes as they come: pieces cut anywhere, in any order of batches, decoded as the whole file would be.

A feed is a stream of (path, piece, content, last): the pieces of a file are
numbered from 0, and ``last`` marks its end. State per path is the bytes of the
chunk or header that is not whole yet, pieces that are ahead of their turn, and
a few counters, so memory follows a chunk and the disorder, not the file.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources import chunks as ch

PIECES = "path string, piece long, content binary, last boolean"
COLUMNS = [c.split()[0] for c in ch.ROWS.split(", ")]


class ByteFeed:
    """The decoder of one file between pieces: ``state`` and ``rest`` are all that it keeps."""

    def __init__(self, path: str, state: dict | None = None, rest: bytes = b""):
        self.path, self.rest = path, rest
        self.state = state or {"next": 0, "chunk": 0, "inside": False, "done": False}

    def _problem(self, what: str) -> dict:
        self.state["done"], self.rest = True, b""
        return {"path": self.path, "chunk_id": self.state["chunk"], "problem": what}

    def take(self, content: bytes, last: bool) -> Iterator[dict]:
        """Rows of chunks.ROWS that the file's next bytes complete; damage gives a row that names it and ends the feed."""
        self.state["next"] += 1
        if self.state["done"]:
            return
        self.rest += content
        at = 0
        while True:
            left = memoryview(self.rest)[at:]
            if not self.state["inside"] or ch.mark_of(left) == ch.TRACE_MARK:
                if self.state["inside"] and not len(left):
                    break
                _, used, problem = ch.read_head(bytes(left[: ch.HEAD_SIZE]))
                if problem == "TRUNCATED_HEADER" and not last:
                    break
                if problem is not None:
                    yield self._problem(problem)
                    return
                self.state["inside"], at = True, at + used
                continue
            if len(left) < ch.CHUNK_HEADER.size:
                break
            if ch.mark_of(left) != ch.CHUNK_MARK:
                yield self._problem("BAD_MARK")
                return
            told = ch.read_chunk_head(left)
            end = ch.CHUNK_HEADER.size + told["payload_size"]
            if len(left) < end:
                break
            payload = bytes(left[ch.CHUNK_HEADER.size : end])
            own = {"path": self.path, "chunk_id": self.state["chunk"], "crc_ok": zlib.crc32(payload) == told["crc"]}
            yield from (own | e for e in ch._events(payload, told["records"]))
            self.state["chunk"] += 1
            at += end
        self.rest = self.rest[at:]
        if last:
            if self.rest:
                yield self._problem("TRUNCATED_CHUNK")
            self.state["done"] = True


class FeedProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")
        self.rest = handle.getValueState("rest", "rest binary")
        self.ahead = handle.getMapState("ahead", "piece long", "content binary, last boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for piece, content, last in zip(frame["piece"].tolist(), frame["content"].tolist(), frame["last"].tolist(), strict=True):
                self.ahead.updateValue((int(piece),), (bytes(content), bool(last)))
        feed = ByteFeed(key[0], json.loads(self.state.get()[0]) if self.state.exists() else None, bytes(self.rest.get()[0]) if self.rest.exists() else b"")
        out: list[dict] = []
        while self.ahead.containsKey((feed.state["next"],)):
            piece = feed.state["next"]
            content, last = self.ahead.getValue((piece,))
            self.ahead.removeKey((piece,))
            out += feed.take(bytes(content), last)
            if len(out) >= 4096:
                yield _frame(out)
                out = []
        self.state.update((json.dumps(feed.state),))
        self.rest.update((feed.rest,))
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([[r.get(c) for c in COLUMNS] for r in rows], columns=COLUMNS, dtype=object)


def stream_feed(pieces: DataFrame) -> DataFrame:
    """The events of byte feeds (PIECES), and a row for damage that ends one, as a stream of chunks.ROWS."""
    return pieces.groupBy("path").transformWithStateInPandas(FeedProcessor(), ch.ROWS, "Append", "None")
