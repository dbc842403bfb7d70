"""Substring deduplication with fixed-block anchors.

A run of WINDOW words is removed wherever its word sequence also starts in a
document with a smaller doc_id.

1. Anchors. Every document's words are cut into non-overlapping blocks of
   WINDOW / 2 words, which are indexed (hash, smallest and largest doc_id).
   Any run of WINDOW words contains a whole block of each document it stands
   in. Every rolling window of a block's length of every document probes the
   index; it is hit if the block also stands in another document.
2. Extension. Around each hit a document's runs of WINDOW words that contain
   the hit place are hashed and compared over all documents; a run is a
   repeat if a smaller doc_id has it. The union of a document's repeats is the
   maximal repeated stretch, and its words are removed. Runs are equal if two
   independent hashes are, 96 to 128 bits in all: a range's bits and 32 more
   of the first, and all of the second.

Hashes travel packed by hash range: a shuffled row has the hashes of one
range from one slice of the texts, so a probe costs five bytes, not a row.
Within a range, index rows arrive first, already combined per slice, and the
probes stream past them; memory follows the distinct blocks of the range,
not the number of copies. The number of ranges, and with it that of the
tasks that match them, follows the size of the texts.

Defined results: null or short text (under WINDOW words) keeps all its
words; a null doc_id takes no part and keeps its words; rows that repeat a
doc_id are one document and never remove each other's words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, rolling_hashes, run_starts, string_slices, word_hashes, words
from .common import next_power_of_two, settle

WINDOW = 50
BLOCK = WINDOW // 2
RANGES, RANGE_BYTES, RANGES_A_TASK = 256, 16_000_000, 8
PACKED = "range int, kind int, ids binary, counts binary, hashes binary"
HITS = "doc_id bigint, hits array<bigint>"


def _packed(ids: np.ndarray, hashes: np.ndarray, text: np.ndarray, kind: int, bits: int, second: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of PACKED: by range, the 32 bits of each hash that follow the range's (in order of the texts), then the second hashes if any, with the ids they belong to and how many each has."""
    ranges = (hashes >> U(64 - bits)).astype(np.int64)
    order = np.argsort(ranges, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(ranges[order])) + 1, [len(order)])) if len(order) else np.zeros(1, np.int64)
    low = (hashes >> U(32 - bits)).astype(np.uint32)
    rows: list[tuple] = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = order[a:b]
        owner, counts = np.unique(text[part], return_counts=True)
        rows.append((int(ranges[part[0]]), kind, ids[owner].tobytes(), counts.astype(np.uint32).tobytes(), low[part].tobytes() + (b"" if second is None else second[part].tobytes())))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["range", "kind", "ids", "counts", "hashes"])


def _firsts(ids: np.ndarray, hashes: np.ndarray, text: np.ndarray, second: np.ndarray | None = None, largest: bool = False) -> np.ndarray:
    """Numbers of each distinct hash once, with the text of smallest (or largest) id; in order of texts."""
    owner = ids[text]
    order = np.lexsort((-owner if largest else owner, hashes) if second is None else (owner, second, hashes))
    first = np.ones(len(order), dtype=bool)
    for h in (hashes,) if second is None else (hashes, second):
        same = h[order][1:] == h[order][:-1]
        first[1:] = ~same if h is hashes else first[1:] | ~same
    return np.sort(order[first])


def _slices(batch: pa.RecordBatch, kinds: tuple[int, ...] = (0,)) -> Iterator[tuple]:
    """(first row, end row, ids, word hashes of each kind, first words) of the slices of a batch's texts."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for row, end, offsets, data in string_slices(batch.column(1)):
        starts, ends, first = words(offsets, data)
        yield row, end, ids[row:end], [word_hashes(data, starts, ends, False, k) for k in kinds], first


def _long(first: np.ndarray) -> np.ndarray:
    return np.diff(first) >= WINDOW


def _anchor_rows(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, ids, (hashes,), first in _slices(batch):
                at, text = run_starts(first, BLOCK)
                on = _long(first)[text]
                at, text = at[on], text[on]
                runs = rolling_hashes(hashes, BLOCK)[at]
                block = (at - first[:-1][text]) % BLOCK == 0
                anchors, owners = runs[block], text[block]
                for largest in (False, True):
                    keep = _firsts(ids, anchors, owners, largest=largest)
                    yield _packed(ids, anchors[keep], owners[keep], 0, bits)
                yield _packed(ids, runs, text, 1, bits)

    return run


def _run_rows(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(2)
            for row, _, ids, (hashes, others), first in _slices(batch, (0, 1)):
                blocks, runs, second = rolling_hashes(hashes, BLOCK), rolling_hashes(hashes, WINDOW), rolling_hashes(others, WINDOW, 1)
                keys = (blocks >> U(32 - bits)).view(np.int64)
                found = []
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if b - a >= WINDOW:
                        hit = np.flatnonzero(np.isin(keys[a : b - BLOCK + 1], hits[row + i].values.to_numpy(zero_copy_only=False)))
                        marks = np.zeros(b - a + 2, dtype=np.int64)
                        np.add.at(marks, np.maximum(hit - (WINDOW - BLOCK), 0), 1)
                        np.add.at(marks, hit + 1, -1)
                        found.append(a + np.flatnonzero(np.cumsum(marks[: b - a - WINDOW + 1])))
                    else:
                        found.append(np.zeros(0, dtype=np.int64))
                text = np.repeat(np.arange(len(found)), [len(f) for f in found])
                at = np.concatenate(found) if found else np.zeros(0, np.int64)
                runs, second = runs[at], second[at]
                keep = _firsts(ids, runs, text, second)
                yield _packed(ids, runs[keep], text[keep], 0, bits, second[keep])
                yield _packed(ids, runs, text, 1, bits, second)

    return run


def _matches(two: bool) -> Callable:
    """Streams sorted PACKED rows to HITS: hashes that another document (with ``two`` hashes: a smaller id) has in the index.

    A hit is named by its range and 32 bits, or by its second hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, index = None, [], None
        for batch in batches:
            ids_out: list[int] = []
            hits_out: list[np.ndarray] = []
            for range_, kind, ids, counts, packed in zip(*(c.to_pylist() if i < 2 else c for i, c in enumerate(batch.columns)), strict=True):
                ids, counts = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.uint32)
                n, packed = int(counts.sum()), packed.as_buffer()
                low = np.frombuffer(packed, np.uint32, n)
                second = np.frombuffer(packed, np.uint64, n, offset=4 * n) if two else np.zeros(n, np.uint64)
                owner = np.repeat(ids, counts)
                if range_ != now:
                    now, parts, index = range_, [], None
                if kind == 0:
                    parts.append((low.copy(), second.copy(), owner))
                    if len(parts) >= 64:
                        parts = [_bounds(parts)]
                    continue
                if index is None:
                    index = _table(parts)
                lows, seconds, least, most = index
                if not len(lows):
                    continue
                at = np.minimum(np.searchsorted(lows, low), len(lows) - 1)
                while two:  # past entries of the same 32 bits and a smaller second hash
                    on = (lows[at] == low) & (seconds[at] < second) & (at + 1 < len(lows))
                    if not on.any():
                        break
                    at = at + on
                hit = (lows[at] == low) & (seconds[at] == second) & ((least[at] < owner) | ((not two) & (most[at] > owner)))
                name = second.view(np.int64) if two else low.astype(np.int64) | np.int64(range_ << 32)
                for d, a, b in zip(ids.tolist(), (np.cumsum(counts) - counts).tolist(), np.cumsum(counts).tolist(), strict=True):
                    if (some := name[a:b][hit[a:b]]).size:
                        ids_out.append(d)
                        hits_out.append(np.unique(some))
            sizes = np.zeros(len(ids_out) + 1, dtype=np.int32)
            np.cumsum([len(h) for h in hits_out], out=sizes[1:])
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(hits_out) if hits_out else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids_out, type=pa.int64()), lists], names=["doc_id", "hits"])

    return run


def _table(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (32 bits, second hash) in order, each with its smallest and largest id."""
    if not parts:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lows, seconds, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((ids, seconds, lows))
    lows, seconds, ids = lows[order], seconds[order], ids[order]
    first = np.ones(len(lows), dtype=bool)
    first[1:] = (lows[1:] != lows[:-1]) | (seconds[1:] != seconds[:-1])
    at = np.flatnonzero(first)
    return lows[at], seconds[at], ids[at], ids[np.append(at[1:], len(ids)) - 1]


def _bounds(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lows, seconds, least, most = _table(parts)
    return np.concatenate([lows, lows]), np.concatenate([seconds, seconds]), np.concatenate([least, most])


def _shared(packed: DataFrame, bits: int, two: bool) -> DataFrame:
    tasks = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // RANGES_A_TASK)
    ordered = packed.repartition(tasks, "range").sortWithinPartitions("range", "kind")
    hits = ordered.mapInArrow(_matches(two), HITS)
    return hits.groupBy("doc_id").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = batch.column(2)
        for row, end, _, (hashes,), first in _slices(batch, (1,)):
            n_words, n_removed, kept = [], [], []
            runs = None
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                text = batch.column(1)[row + i].as_py()
                tokens = text.encode().split() if text else []
                n_words.append(b - a)
                repeats = hits[row + i]
                if repeats.is_valid and len(repeats) and b - a >= WINDOW:
                    runs = rolling_hashes(hashes, WINDOW, 1) if runs is None else runs
                    at = np.flatnonzero(np.isin(runs[a : b - WINDOW + 1].view(np.int64), repeats.values.to_numpy(zero_copy_only=False)))
                    marks = np.zeros(b - a + 1, dtype=np.int64)
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + WINDOW, -1)
                    keep = np.flatnonzero(np.cumsum(marks[:-1]) == 0)
                    n_removed.append(b - a - len(keep))
                    tokens = [tokens[j] for j in keep.tolist()]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(tokens).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = next_power_of_two(max(RANGES, total / RANGE_BYTES)).bit_length() - 1
    known = texts.where("doc_id is not null and text is not null")
    anchors = settle(_shared(known.mapInArrow(_anchor_rows(bits), PACKED), bits, two=False))
    near = known.join(anchors, "doc_id").select("doc_id", "text", "hits")
    repeats = settle(_shared(near.mapInArrow(_run_rows(bits), PACKED), bits, two=True))
    every = texts.join(repeats, "doc_id", "left").select("doc_id", "text", "hits")
    return every.mapInArrow(_kept, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
