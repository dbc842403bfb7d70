"""Byte feeds cut anywhere, and followers whose rows come late, out of order and never again."""

import random

import pytest

from tracefold.sources import chunks, segments
from tracefold.streaming.feed import ByteFeed
from tracefold.streaming.ingest import GapFinder, SliceFollower, StateFollower


def cases():
    rows = [{"event_name": ("TASK_BLOCK", "CTX_SWITCH", "IRQ_ENTER", "SYNC_CALIB")[i % 4], "seq": i, "ts_raw": 100 + i, "task_id": i % 3} for i in range(1, 13)]
    good = chunks.encode_segment("run", [chunks.encode_chunk(0, rows[:5]), chunks.encode_chunk(1, rows[5:]), chunks.encode_chunk(1, [])], cores=2)
    old = chunks.TRACE_HEADER.pack(chunks.TRACE_MARK, 1, 1, 1, 1, 1, 1, b"", b"", b"") + chunks.encode_chunk(3, rows[:2])
    flipped = bytearray(good)
    flipped[chunks.HEAD_SIZE + chunks.CHUNK_HEADER.size + 9] ^= 1
    return {
        "good": good, "two": good + chunks.encode_segment("more", [chunks.encode_chunk(2, rows[:3])], segment=2, before=1) + old, "short": good[:-3], "cut": good[: chunks.HEAD_SIZE + 30],
        "head": good[:20], "meta": good[: chunks.TRACE_HEADER.size + 4], "none": b"", "mark": b"x" + good[1:], "junk": good + b"junk" * 40, "tail": good + b"ab", "old": old, "second head cut": good + old[:30], "crc": bytes(flipped),
    }


@pytest.mark.parametrize("name", sorted(cases()))
def test_any_split_gives_the_offline_rows(name, tmp_path):
    content = cases()[name]
    whole = list(chunks._chunks("p", content, payloads=True))
    want = []
    for c in whole:
        if c["problem"]:
            want.append({"path": "p", "chunk_id": c["chunk_id"], "problem": c["problem"]})
        else:
            own = {"path": "p", "chunk_id": c["chunk_id"], "crc_ok": chunks.zlib.crc32(c["payload"]) == c["crc"]}
            want += [own | e for e in chunks._events(c["payload"], c["records"])]
    rng = random.Random(name)
    for size in (1, 7, 23, 64, 10**6, None):
        pieces, at = [], 0
        while at < len(content) or not pieces:
            n = size or rng.randrange(1, 90)
            pieces.append(content[at : at + n])
            at += n
        state, rest, got = None, b"", []
        for i, piece in enumerate(pieces):  # state goes through its stored form between pieces
            feed = ByteFeed("p", state, rest)
            got += feed.take(piece, i == len(pieces) - 1)
            state, rest = dict(feed.state), bytes(feed.rest)
        assert got == want and not rest or whole[-1]["problem"]
        assert got == want
    path = tmp_path / "x.seg"
    path.write_bytes(content)
    seek = segments.Segment(str(path))
    assert [{k: v for k, v in c.items() if k not in ("path", "payload")} for c in whole] == [{k: v for k, v in c.items() if k != "path"} for c in seek.chunks()]


class Store:
    """What a processor asks of its handle, in memory."""

    def __init__(self):
        self.value, self.map, self.timers = None, {}, set()

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        store = self

        class Value:
            exists = lambda _: store.value is not None
            get = lambda _: store.value
            update = lambda _, v: setattr(store, "value", v)
            clear = lambda _: setattr(store, "value", None)

        return Value()

    def registerTimer(self, at):
        self.timers.add(at)

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]

    def keys(self):
        return iter(list(self.map))


class At:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def follow(kind, rows, late, idle, key, seed):
    """All rows that a follower gives for one key when batches come shuffled within ``late`` ms and timers fire as the watermark moves on."""
    import pandas as pd

    rng = random.Random(seed)
    processor, store = kind(width=700, idle=idle), Store()
    processor.init(store)
    left, out, watermark, newest = sorted(rows, key=lambda r: r[0] // 1000 + rng.randrange(late)), [], 0, 0
    while left or store.timers:
        batch, left = left[:5], left[5:]
        assert all(r[0] > watermark * 1000 for r in batch)
        if batch:
            frames = [pd.DataFrame([dict(zip(kind.values, r, strict=True)) for r in part]) for part in (batch[:2], batch[2:]) if part]
            for frame in processor.handleInputRows(key, iter(frames), At(watermark)):
                out += frame.values.tolist()
        newest = max([newest, *(r[0] // 1000 for r in batch)]) if batch else newest + idle + late + 10
        watermark = max(watermark, newest - late - 1)
        for timer in sorted(t for t in store.timers if t <= watermark):
            store.timers.discard(timer)
            for frame in processor.handleExpiredTimer(key, At(watermark), None):
                out += frame.values.tolist()
    assert not store.map and store.value is None  # nothing stays behind an idle key
    return out


@pytest.mark.parametrize("seed", range(4))
def test_followers_put_shuffled_batches_in_order(seed):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(1_000, 400_000), 60))
    none = lambda rows: sorted([tuple(None if v != v else v for v in r) for r in rows], key=str)
    gaps = [(t, i + (i > 20) + 3 * (i > 40)) for i, t in enumerate(times)]
    assert none(follow(GapFinder, gaps, 50, 10_000, ("d", 0), seed)) == [("d", 0, 22, times[20], times[21]), ("d", 0, 45, times[40], times[41])]
    switches = [(t, i, rng.randrange(3), f"u{i}") for i, t in enumerate(times)]
    want = [("d", 1, r[2], r[0], n and n[0], r[3], n and n[3]) for r, n in zip(switches, [*switches[1:], None], strict=True) if r[2]]
    assert none(follow(SliceFollower, switches, 50, 10_000, ("d", 1), seed)) == sorted(want, key=str)
    states = [(t, 0, i, i % 2, *rng.choice([("READY", True), ("RUNNING", False), ("BLOCKED", False), ("EXIT", False)])) for i, t in enumerate(times)]
    kept = []
    for r in states:
        if not r[5] or kept and kept[-1][4] == "RUNNING":
            kept.append(r)
    want = [("d", 2, r[4], r[0], n and n[0]) for r, n in zip(kept, [*kept[1:], None], strict=True)]
    assert none(follow(StateFollower, states, 50, 10_000, ("d", 2), seed)) == sorted(want, key=str)


def test_idle_keys_close_and_begin_anew():
    rows = [(1_000_000, 1, 5, "a"), (2_000_000, 2, 6, "b"), (90_000_000, 3, 7, "c")]
    got = follow(SliceFollower, rows[:2], 1, 5_000, ("d", 0), 1)
    assert [r[2:5] for r in got] == [[5, 1_000_000, 2_000_000], [6, 2_000_000, None]]
