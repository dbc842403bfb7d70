"""Language identification by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public byte-level
vocabulary, whatever a piece's length. A word's probability is the sum over
all its segmentations into pieces (a forward pass over its bytes); a text's is
the product over its words, and the prediction is the language of largest
posterior under equal priors. A run without white space is one word, however
long: beyond RUN bytes its forward pass keeps only as many values as the
longest piece has bytes.

Piece probabilities are learned by expectation maximisation. The bounded
sample it uses, about ``sample`` rows per language chosen by a hash of the
row, is a parameter of the fit alone, as are the words of at most CHUNK bytes
that it cuts longer runs into, between characters; every text is scored whole. Words are
counted and expected piece counts summed by Spark; only languages x pieces
numbers reach the driver, so labels are taken to be a set of at most some
thousand values.

Defined results: null text, or text without a letter, is ``und`` with score
0; a label none of whose sampled texts holds a word is not learned and never
predicted; without any learned label all texts are ``und``; ties go to the
first language by code point; every row gives one row, whatever its columns are called. Scores are never NaN.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrays import U, mix64, string_slices, word_hashes, words
from .common import in_struct, settle

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
EXACT = 8  # bytes of a piece that are its key as they are; longer ones are hashed
CHUNK = 60  # most bytes of a word that the fit learns from
RUN = 512  # bytes from which on a word has a pass of its own
FLOOR = 1e-7  # least probability of a single byte
LETTER = regex.compile(r"\p{L}")
STEP = 0x9E3779B97F4A7C15


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a rank file (base64 piece and rank a line), read on the driver, and all single bytes.

    Words begin with one space and have no other, so pieces with white space behind their first byte can't occur and are left out.
    """
    if not os.path.isfile(path):
        raise FileNotFoundError(f"{path}: pass the path of a byte-level vocabulary (a rank file) as ``vocabulary``")
    with open(path, "rb") as lines:
        found = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    return sorted({p for p in found if p and not set(p[1:]) & set(b" \t\n\v\f\r")} | {bytes([b]) for b in range(256)})


def piece_key(matrix: np.ndarray) -> np.ndarray:
    """A key per row of a (n, length) byte matrix: up to EXACT bytes as one integer, more as a polynomial of them, with the length mixed in."""
    key = np.zeros(len(matrix), dtype=U)
    for i in range(matrix.shape[1]):
        key = (key << U(8)) | matrix[:, i].astype(U) if matrix.shape[1] <= EXACT else key * U(0xD1342543DE82EF95) + matrix[:, i].astype(U) + U(1)
    return mix64(key + U(matrix.shape[1] * STEP % 2**64))


@dataclass
class Lookup:
    """Piece numbers by key: hash tables, each for the keys that collide in those before it.

    ``long`` are the lengths above EXACT bytes; ``tails`` the keys of such pieces' last EXACT bytes, in order, by which nearly all places are seen to end none.
    """

    keys: np.ndarray
    tables: list[np.ndarray]
    long: list[int]
    tails: np.ndarray

    @classmethod
    def of(cls, pieces: list[bytes]) -> Lookup:
        keys = np.zeros(len(pieces), dtype=U)
        for length in {len(p) for p in pieces}:
            at = [i for i, p in enumerate(pieces) if len(p) == length]
            keys[at] = piece_key(np.frombuffer(b"".join(pieces[i] for i in at), np.uint8).reshape(-1, length))
        left, tables = np.arange(len(keys)), []
        while len(left):
            table = np.full(1 << 18, -1, dtype=np.int32)
            place = cls.place(keys[left], len(tables))
            table[place] = left
            left = left[table[place] != left]
            tables.append(table)
        long = [p for p in pieces if len(p) > EXACT]
        ends = np.frombuffer(b"".join(p[-EXACT:] for p in long), np.uint8).reshape(-1, EXACT)
        return cls(keys, tables, sorted({len(p) for p in long}), np.unique(piece_key(ends)))

    def ends_long(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys of EXACT bytes may end a longer piece."""
        if not len(self.tails):
            return np.zeros(len(keys), dtype=bool)
        return self.tails[np.minimum(np.searchsorted(self.tails, keys), len(self.tails) - 1)] == keys

    @staticmethod
    def place(keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys >> U(13 * level % 46)) & U((1 << 18) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers; the number of pieces where there is none."""
        out = np.full(len(keys), len(self.keys), dtype=np.int64)
        for level, table in enumerate(self.tables):
            got = table[self.place(keys, level)]
            hit = (got >= 0) & (self.keys[got] == keys)
            out[hit] = got[hit]
        return out


def forward(matrix: np.ndarray, sizes: np.ndarray, lookup: Lookup, probs: np.ndarray) -> tuple[np.ndarray, list, list]:
    """Log probability (n, languages) of the words in a padded byte matrix, and what a backward pass needs.

    probs: (pieces + 1, languages), the last row 0. Values are scaled at every
    place, so long words neither vanish nor overflow.
    """
    n, width = matrix.shape
    alphas = [np.ones((n, probs.shape[1]))]
    scales = [np.zeros((n, probs.shape[1]))]
    ids: list[dict[int, np.ndarray]] = [{}]
    for end in range(1, width + 1):
        total = np.zeros_like(alphas[0])
        found = {}
        for length in range(1, min(EXACT, end) + 1):
            keys = piece_key(matrix[:, end - length : end])
            found[length] = lookup.find(keys)
            total += alphas[end - length] * np.exp(np.minimum(scales[end - length] - scales[end - 1], 600)) * probs[found[length]]
        may = np.flatnonzero(lookup.ends_long(keys)) if end > EXACT else ()
        for length in lookup.long if len(may) else ():
            if length > end:
                break
            part = lookup.find(piece_key(matrix[may, end - length : end]))
            if (part < len(lookup.keys)).any():
                found[length] = np.full(n, len(lookup.keys), dtype=np.int64)
                found[length][may] = part
                total += alphas[end - length] * np.exp(np.minimum(scales[end - length] - scales[end - 1], 600)) * probs[found[length]]
        norm = np.where(total > 0, total, 1.0)  # each language its own, so none vanishes beside another
        alphas.append(total / norm)
        scales.append(scales[end - 1] + np.log(norm))
        ids.append(found)
    last = np.log(np.maximum(np.stack(alphas, 1)[np.arange(n), sizes], 1e-300)) + np.stack(scales, 1)[np.arange(n), sizes]
    return last, [alphas, scales], ids


def forward_run(word: np.ndarray, lookup: Lookup, probs: np.ndarray) -> np.ndarray:
    """``forward`` of one long word, with a leading space in it: the pieces that end at each place come first, then one pass that keeps the last values only."""
    n = len(word)
    lengths = [*range(1, EXACT + 1), *lookup.long]
    windows = lambda length: np.lib.stride_tricks.sliding_window_view(word, length)
    ids = np.full((len(lengths), n + 1), len(lookup.keys), dtype=np.int32)
    for i, length in enumerate(lengths[:EXACT]):
        if length <= n:
            keys = piece_key(windows(length))
            ids[i, length:] = lookup.find(keys)
    may = np.flatnonzero(lookup.ends_long(keys)) + EXACT if n >= EXACT else np.zeros(0, np.int64)
    for i, length in enumerate(lookup.long, EXACT):
        at = may[may >= length]
        if len(at):
            ids[i, at] = lookup.find(piece_key(windows(length)[at - length]))
    size = lengths[-1]
    ring = np.zeros((size, probs.shape[1]))
    ring[0] = 1.0
    back, log = np.array(lengths), np.zeros(probs.shape[1])
    for end in range(1, n + 1):
        some = ids[:, end] < len(lookup.keys)
        value = np.einsum("kl,kl->l", ring[(end - back[some]) % size], probs[ids[some, end]]) if some.any() else np.zeros(probs.shape[1])
        ring[end % size] = value
        if end % 8 == 0 or end == n:  # before values vanish
            scale = np.maximum(ring.max(axis=0), 1e-300)
            ring /= scale
            log += np.log(scale)
    return np.log(np.maximum(ring[n % size], 1e-300)) + log


def chunked(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with those above CHUNK bytes cut into several, never inside a UTF-8 character."""
    parts = np.maximum(1, -(-(ends - starts) // (CHUNK - 3)))
    if (parts == 1).all():
        return starts, ends, first
    ahead = np.concatenate(([0], np.cumsum(parts)))
    place = np.arange(ahead[-1]) - np.repeat(ahead[:-1], parts)
    begin = np.repeat(starts, parts) + place * (CHUNK - 3)
    for _ in range(3):
        begin = begin - ((place > 0) & ((data[begin] & 0xC0) == 0x80))
    stop = np.append(begin[1:], 0)
    stop[ahead[1:] - 1] = ends
    return begin, stop, ahead[first]


def by_length(starts: np.ndarray, ends: np.ndarray, data: np.ndarray, most: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, padded byte matrix with a leading space, sizes) of words of like length."""
    order = np.argsort(ends - starts, kind="stable")
    at = 0
    while at < len(order):
        width = int(ends[order[at]] - starts[order[at]])
        limit = width + 3
        stop = min(len(order), at + max(1, min(most, 40_000_000 // (64 * (limit + 1)))))
        part = order[at:stop]
        part = part[(ends[part] - starts[part]) <= limit]
        sizes = ends[part] - starts[part]
        wide = int(sizes.max())
        place = np.minimum(starts[part][:, None] + np.arange(wide), len(data) - 1)
        matrix = np.concatenate([np.full((len(part), 1), 32, np.uint8), np.where(np.arange(wide) < sizes[:, None], data[place], 0)], axis=1)
        yield part, matrix, sizes + 1
        at += len(part)


@dataclass
class Model:
    languages: list[str]
    pieces: list[bytes]
    probs: np.ndarray  # (pieces, languages)

    def scorer(self) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        lookup, probs = Lookup.of(self.pieces), np.vstack([self.probs, np.zeros((1, len(self.languages)))])

        def score(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            out = np.zeros((len(starts), len(self.languages)))
            long = ends - starts > RUN
            short = np.flatnonzero(~long)
            for part, matrix, sizes in by_length(starts[short], ends[short], data):
                out[short[part]] = forward(matrix, sizes, lookup, probs)[0]
            for i in np.flatnonzero(long):
                out[i] = forward_run(np.concatenate((np.array([32], np.uint8), data[starts[i] : ends[i]])), lookup, probs)
            return out

        return score


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for row, _, offsets, data in string_slices(batch.column(1)):
            data = _LOWER[data]
            starts, ends, first = words(offsets, data)
            starts, ends, first = chunked(starts, ends, first, data)
            hashes = word_hashes(data, starts, ends, lower=False)
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                _, at, n = np.unique(hashes[a:b], return_index=True, return_counts=True)
                found = [data[starts[a + j] : ends[a + j]].tobytes() for j in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([langs[row + i]] * len(found), pa.string()), pa.array(found, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])


def _expected(languages: list[str], pieces: list[bytes], probs: np.ndarray) -> Callable:
    """Expected piece counts of (lang, word, n) rows under the present probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, table = Lookup.of(pieces), np.vstack([probs, np.zeros((1, len(languages)))])
        sums = np.zeros((len(pieces) + 1, len(languages)))
        number = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            column = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8)
            counts = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            for part, matrix, sizes in by_length(offsets[:-1], offsets[1:], data):
                own, rows = lang[part], np.arange(len(part))
                _, (alphas, scales), ids = forward(matrix, sizes, lookup, table)
                a = np.stack([x[rows, own] for x in alphas], 1)
                s = np.stack([x[rows, own] for x in scales], 1)
                beta = np.zeros_like(a)  # scaled so that alpha * beta sums to the word's probability
                beta[rows, sizes] = 1.0
                end_scale, end_alpha = s[rows, sizes], np.maximum(a[rows, sizes], 1e-300)
                for end in range(matrix.shape[1], 0, -1):
                    for length, found in ids[end].items():
                        begin = end - length
                        flow = table[found, own] * beta[:, end]
                        beta[:, begin] += flow
                        share = a[:, begin] * flow * np.exp(s[:, begin] - end_scale) / end_alpha
                        np.add.at(sums, (found, own), share * counts[part])
        at, lang_at = np.nonzero(sums[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(lang_at.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[at, lang_at])], names=["lang", "piece", "n"])

    return run


def fit(docs: DataFrame, vocabulary: str = VOCABULARY, sample: int = 1500, rounds: int = 3) -> Model:
    """docs: (text, lang, ...), labelled. Learns from about ``sample`` rows per language; the other columns only tell copies of a text apart in the sample."""
    pieces = load_pieces(vocabulary)
    labelled = docs.where("text is not null and lang is not null")
    # one number per language label
    shares = {r["lang"]: min(1.0, sample / r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    share = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair]), F.col("lang"))
    row = F.xxhash64("text", *[F.col(f"`{c}`") for c in docs.columns if c == "doc_id"])
    chosen = labelled.where(F.pmod(row, F.lit(1_000_000)) < share * 1_000_000)
    counted = chosen.select("lang", "text").mapInArrow(_count_words, "lang string, word binary, n bigint")
    counted = settle(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    if not languages:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    single = np.array([len(p) == 1 for p in pieces])
    probs = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    for _ in range(rounds):
        sums = counted.mapInArrow(_expected(languages, pieces, probs), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        got = sums.toPandas()  # at most languages x pieces numbers
        probs = np.zeros_like(probs)
        probs[got["piece"], got["lang"]] = got["n"]
        probs[single] += FLOOR * probs.sum(axis=0)
        probs /= probs.sum(axis=0)
    kept = probs.max(axis=1) > 0  # others add nothing to any sum
    return Model(languages, [p for p, k in zip(pieces, kept, strict=True) if k], probs[kept])


def _predict(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer() if model.languages else None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for row, end, offsets, data in string_slices(texts):
                named, best = ["und"] * (end - row), np.zeros(end - row)
                if score is not None:
                    data = _LOWER[data]
                    starts, ends, first = words(offsets, data)
                    _, at, inverse = np.unique(word_hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
                    unique = score(data, starts[at], ends[at])
                    sums = np.zeros((len(starts) + 1, len(model.languages)))
                    np.cumsum(unique[inverse], axis=0, out=sums[1:])
                    total = sums[first[1:]] - sums[first[:-1]]
                    top = total.argmax(axis=1)
                    posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    for i in range(end - row):
                        text = texts[row + i].as_py()
                        if text and LETTER.search(text):
                            named[i], best[i] = model.languages[top[i]], posterior[i]
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(named, pa.string()), pa.array(best, pa.float64())], names=["row", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Per row of ``docs``: row (all its columns), lang_pred, score."""
    rows = docs.select(in_struct(docs).alias("row"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), StructType([rows.schema["row"], *StructType.fromDDL("lang_pred string, score double").fields]))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))
