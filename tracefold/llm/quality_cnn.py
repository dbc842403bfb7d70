"""Quality of texts by a byte-level convolutional network in numpy.

A text's bytes (256 is padding) are embedded; learned filters of WIDTH bytes
move over them STEP bytes at a time. A chunk is BLOCKS blocks of BLOCK bytes,
the last of them also the next chunk's first, so overlapping chunks cover the
whole text. In each chunk every filter keeps its maximum; a small hidden layer
turns the maxima into the chunk's log-odds. The document's log-odds are the
mean over its chunks, weighted by their blocks, and one logistic function of
that is its probability.

Training is plain gradient descent (Adam) on a bounded sample: ``rows``
documents of each label, those with the smallest hash of doc_id, of each at
most ``chunks`` evenly spread chunks. The sample is drawn, joined and cut to
chunks by Spark; only those chunks come to the driver (rows x 2 x chunks x 264
bytes at most). Both labels weigh alike in training; the labels' shares among
all labelled rows are put back as a shift of the log-odds.

Scoring is one pass over the documents without a shuffle; tasks work on
slices of about 1 MB or one text.

Defined results: null and empty texts are one block of padding; a doc_id that
is labelled both ways, a null doc_id and labels other than 0 and 1 teach
nothing; without labels of both kinds all scores are the share of label 1 (0.5
without any). Columns but ``text`` come back in the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrays import string_slices
from .common import in_struct

PAD, DIM, WIDTH, STEP = 256, 8, 8, 2
BLOCK, BLOCKS = 64, 4
FILTERS, HIDDEN = 48, 16
#: Bytes of a training chunk: its blocks and what the last windows read beyond them.
CHUNK = BLOCK * BLOCKS + WIDTH


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


@dataclass
class Network:
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    shift: float = 0.0

    def block_maxima(self, data: np.ndarray) -> np.ndarray:
        """Per block of the padded bytes (a multiple of BLOCK, and WIDTH more) the maximum of each filter."""
        w = self.weights
        n = len(data) - WIDTH
        both = np.concatenate((w["filters"][: WIDTH // 2].reshape(-1, FILTERS), w["filters"][WIDTH // 2 :].reshape(-1, FILTERS)), axis=1)
        out = np.empty((n // BLOCK, FILTERS), dtype=np.float32)
        per = 256  # blocks at a time
        for b in range(0, n // BLOCK, per):
            part = w["bytes"][data[b * BLOCK : min(n, (b + per) * BLOCK) + WIDTH]]
            most = None
            for offset in range(0, WIDTH // 2, STEP):
                # halves of a window are rows of this matrix, so no window is copied
                halves = part[offset : offset + len(part) - WIDTH // 2].reshape(-1, WIDTH // 2 * DIM) @ both
                found = (halves[:-1, :FILTERS] + halves[1:, FILTERS:])[: (len(part) - WIDTH) // (WIDTH // 2)].reshape(-1, BLOCK // (WIDTH // 2), FILTERS).max(axis=1)
                most = found if most is None else np.maximum(most, found)
            out[b : b + len(most)] = most
        return out

    def log_odds(self, maxima: np.ndarray) -> np.ndarray:
        w = self.weights
        hidden = np.maximum(np.maximum(maxima + w["bias"], 0) @ w["mix"] + w["mix_bias"], 0)
        return hidden @ w["out"] + w["out_bias"]

    def score(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each text between the offsets."""
        if not self.weights:
            return np.full(len(offsets) - 1, 1 / (1 + np.exp(-self.shift)))
        padded, first = padded_blocks(offsets, data)
        maxima = self.block_maxima(padded)
        begins, ends, text = chunk_bounds(np.diff(first))
        begins, ends = begins + first[text], ends + first[text]
        rows = np.concatenate((maxima, np.full((1, FILTERS), -np.inf, dtype=np.float32)))
        per_chunk = np.maximum.reduceat(rows, np.stack((begins, ends), 1).ravel(), axis=0)[::2]
        weight = (ends - begins).astype(float)
        logits = np.bincount(text, weight * self.log_odds(per_chunk), len(offsets) - 1) / np.bincount(text, weight, len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(logits + self.shift, -60, 60)))


def padded_blocks(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each text padded so that no window reaches the next, and the number of each text's first block (one more at the end)."""
    sizes = np.diff(offsets)
    first = np.concatenate(([0], np.cumsum((sizes + WIDTH + BLOCK - 1) // BLOCK)))
    out = np.full(first[-1] * BLOCK + WIDTH, PAD, dtype=np.int16)
    out[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK - offsets[:-1], sizes)] = data
    return out, first


def chunk_bounds(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end block of every chunk of texts of so many blocks, within the text, and the text of each."""
    hop = BLOCKS - 1
    counts = 1 + np.maximum(0, -(-(blocks - BLOCKS) // hop))
    text = np.repeat(np.arange(len(blocks)), counts)
    begins = hop * (np.arange(len(text)) - (np.cumsum(counts) - counts)[text])
    return begins, np.minimum(begins + BLOCKS, blocks[text]), text


def _training_chunks(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, offsets, data in string_slices(batch.column(2)):
                padded, first = padded_blocks(offsets, data)
                held = []
                for i in range(end - row):
                    begins, ends, _ = chunk_bounds(np.array([first[i + 1] - first[i]]))
                    chosen = np.unique(np.linspace(0, len(begins) - 1, min(most, len(begins))).round().astype(int))
                    held.append([{"blocks": int(ends[c] - begins[c]), "bytes": padded[(first[i] + begins[c]) * BLOCK : (first[i] + ends[c]) * BLOCK + WIDTH].astype(np.int16).tobytes()} for c in chosen])
                part = batch.slice(row, end - row)
                kind = pa.list_(pa.struct([("blocks", pa.int32()), ("bytes", pa.binary())]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(held, kind)], names=["quality", "hash", "chunks"])

    return run


def sample(docs: DataFrame, labels: DataFrame, rows: int, chunks: int) -> tuple[list, dict[int, int]]:
    """(label, chunks) of at most ``rows`` documents of each label, and how many labelled ids there are of each."""
    told = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    told = told.where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in told.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    # at most 2 x rows ids
    ids = told.where("quality = 0").orderBy(order, "doc_id").limit(rows).unionByName(told.where("quality = 1").orderBy(order, "doc_id").limit(rows))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id").select("quality", F.xxhash64("doc_id", "text").alias("hash"), "text")
    cut = found.mapInArrow(_training_chunks(chunks), "quality int, hash bigint, chunks array<struct<blocks:int,bytes:binary>>")
    out = []
    for q in (0, 1):  # a repeated doc_id can bring more rows than ids
        out += [(q, [(c["blocks"], c["bytes"]) for c in r["chunks"]]) for r in cut.where(F.col("quality") == q).orderBy("hash").limit(rows).collect()]
    return out, counts


def fit(docs: DataFrame, labels: DataFrame, rows: int = 800, chunks: int = 4, steps: int = 500, seed: int = 13) -> Network:
    """Learns from documents (doc_id, text) and labels (doc_id, quality) whose id is not held out."""
    drawn, counts = sample(docs, labels, rows, chunks)
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    # without both labels only their share is known
    shift = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if len({q for q, _ in drawn}) < 2:
        return Network(shift=shift)
    return Network(train(drawn, steps, seed), shift)


def train(drawn: list, steps: int, seed: int, batch: int = 64, rate: float = 3e-3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    w = {
        "bytes": normal(PAD + 1, DIM, scale=0.5), "filters": normal(WIDTH, DIM, FILTERS, scale=(2 / (WIDTH * DIM)) ** 0.5), "bias": np.zeros(FILTERS, np.float32),
        "mix": normal(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5), "mix_bias": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, scale=(1 / HIDDEN) ** 0.5), "out_bias": np.zeros(1, np.float32),
    }
    docs = [(q, [(blocks, np.frombuffer(data, np.int16)) for blocks, data in chunks]) for q, chunks in drawn]
    pools = [[d for d in docs if d[0] == q] for q in (0, 1)]
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        chosen = [pools[i % 2][rng.integers(len(pools[i % 2]))] for i in range(batch)]
        gradient = gradients(w, chosen)
        for k, g in gradient.items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.001 * (g * g - square[k])
            pace = rate * (0.1 if step > 0.8 * steps else 1)
            w[k] -= (pace * (mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8) + 1e-3 * w[k])).astype(np.float32)
    return w


def gradients(w: dict[str, np.ndarray], docs: list) -> dict[str, np.ndarray]:
    """Of the mean logistic loss over (label, [(blocks, bytes)]) documents."""
    blocks = np.array([b for _, chunks in docs for b, _ in chunks])
    text = np.repeat(np.arange(len(docs)), [len(chunks) for _, chunks in docs])
    data = np.full((len(blocks), CHUNK), PAD, dtype=np.int64)
    for row, x in zip(data, (x for _, chunks in docs for _, x in chunks), strict=True):
        row[: len(x)] = x
    embedded = w["bytes"][data]
    starts = np.arange(0, BLOCK * BLOCKS, STEP)
    windows = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH, axis=1)[:, ::STEP][:, : len(starts)].transpose(0, 1, 3, 2).reshape(len(blocks), len(starts), -1)
    found = windows @ w["filters"].reshape(-1, FILTERS)
    found[starts[None, :] >= (blocks * BLOCK)[:, None]] = -np.inf  # no window begins in a block that is not there
    at = found.argmax(axis=1)
    pre = np.take_along_axis(found, at[:, None], 1)[:, 0] + w["bias"]
    pooled = np.maximum(pre, 0)
    mixed = pooled @ w["mix"] + w["mix_bias"]
    hidden = np.maximum(mixed, 0)
    logits = hidden @ w["out"] + w["out_bias"]
    weight = blocks / np.bincount(text, blocks, len(docs))[text]
    p = 1 / (1 + np.exp(-np.clip(np.bincount(text, weight * logits, len(docs)), -30, 30)))
    g = ((p - np.array([q for q, _ in docs]))[text] * weight / len(docs)).astype(np.float32)
    g_mixed = g[:, None] * w["out"] * (mixed > 0)
    g_pre = (g_mixed @ w["mix"].T) * (pre > 0)
    rows = np.arange(len(blocks))[:, None]
    kept = windows[rows, at]  # chunk, filter, window
    g_filters = np.einsum("cf,cfw->wf", g_pre, kept).reshape(w["filters"].shape)
    # each chosen window hands its share on to the bytes it read
    g_windows = g_pre[:, :, None, None] * w["filters"].transpose(2, 0, 1)[None]
    read = data[rows[:, :, None], starts[at][:, :, None] + np.arange(WIDTH)]
    g_bytes = np.stack([np.bincount(read.ravel(), g_windows[..., d].ravel(), PAD + 1) for d in range(DIM)], 1)
    return {"bytes": g_bytes, "filters": g_filters, "bias": g_pre.sum(0), "mix": pooled.T @ g_mixed, "mix_bias": g_mixed.sum(0), "out": hidden.T @ g, "out_bias": g.sum(keepdims=True)}


def _score(network: Network) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, offsets, data in string_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(network.score(offsets, data), pa.float64())], names=["row", "score"])

    return run


def score(docs: DataFrame, network: Network) -> DataFrame:
    """Per row of ``docs``: row (its other columns), score (probability of label 1)."""
    rows = docs.select(in_struct(docs, but="text").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_score(network), StructType([rows.schema["row"], *StructType.fromDDL("score double").fields]))
