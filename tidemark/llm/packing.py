"""Sequence packing by non-negative least squares over shallow length combinations.

Documents are tokenised, an end id is added and they are cut into pieces of at most ``window``
ids: whole windows and one remainder. The histogram of piece lengths has at most ``window``
entries, so planning works on it alone: combinations of one to three lengths that fill a window
are enumerated, non-negative repeat counts are fitted to the histogram by least squares (cyclic
coordinate descent), rounded down to what is there, and what remains is packed greedily, largest
length first. Spark then numbers the pieces of each length and looks up their places.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, record, rows

_CACHE = 150_000
#: A space that doesn't begin the token of what follows it.
_ODD_SPACE = re.compile(r" (?=\s)| \Z")


class _Words(dict):
    """Ids (little-endian bytes) of a space and the word, or of other text as it is."""

    def __init__(self, plain):
        super().__init__()
        self.plain = plain

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHE:
            self.clear()
        ids = self[word] = np.array(self.plain(" " + word), "<u4").tobytes()
        return ids


class Encoder:
    """Ids of a byte-level BPE vocabulary, word by word with a cache.

    A space before a character that isn't white space always begins a token, so a text can be cut
    there. Texts with other uses of spaces, and texts that spell a special token, are encoded
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.plain = self._by_ranks(path) or self._whole
        self.words = _Words(self.plain)

    def _whole(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _by_ranks(path: str):
        """The faster encoder, where the same vocabulary lies beside as ranks."""
        import base64
        import os

        ranks_path = os.path.splitext(path)[0] + ".tiktoken"
        if not os.path.exists(ranks_path):
            return None
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks=ranks).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self._whole(text), "<u4").tobytes()
        if _ODD_SPACE.search(text):
            return np.array(self.plain(text), "<u4").tobytes()
        words = text.split(" ")
        head = np.array(self.plain(words[0]), "<u4").tobytes() if words[0] else b""
        return head + b"".join(map(self.words.__getitem__, words[1:]))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
_PIECE_DDL = ", ".join(f"{f.name} bigint" for f in _PIECE)


def _pieces(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for docs, texts in rows(batches):
            out: list[list] = [[] for _ in _PIECE]
            for doc, text in zip(docs, texts):
                ids = encode(text or "") + end
                n = len(ids) // 4
                for at in range(0, n, window):
                    part = ids[4 * at:4 * (at + window)]
                    for c, v in zip(out, (doc, at, len(part) // 4, zlib.crc32(part), n)):
                        c.append(v)
            yield record(_PIECE, out)
    return run


def combinations(counts: np.ndarray, window: int, triples_from: int = 4,
                 slack: int = 2) -> list[tuple[int, ...]]:
    """One, two or three lengths that fill a window but for ``slack``.

    All such pairs; for triples, each length with the ``triples_from`` most frequent second
    lengths, so their number is at most proportional to the window.
    """
    there = np.flatnonzero(counts)
    there = there[there > 0]
    present = set(there.tolist())
    found = {(window,)} if window in present else set()
    for total in range(window - slack, window + 1):
        found |= {(a, total - a) for a in present if a >= total - a and total - a in present}
    common = there[np.argsort(-counts[there], kind="stable")][:triples_from].tolist()
    for total in range(window - slack, window + 1):
        for a in present:
            for b in common:
                if (c := total - a - b) in present:
                    found.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(found, reverse=True)


def solve(counts: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = 30) -> np.ndarray:
    """Non-negative repeat counts whose lengths fit the histogram in the least-squares sense."""
    x, rest = np.zeros(len(combos)), counts.astype(float)
    columns = [(np.array(list(set(c))), np.array([c.count(v) for v in set(c)], float))
               for c in combos]
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, times) in enumerate(columns):
            new = max(0.0, x[j] + float(rest[at] @ times) / float(times @ times))
            if new != x[j]:
                rest[at] -= times * (new - x[j])
                moved = max(moved, abs(new - x[j]))
                x[j] = new
        if moved < 0.25:
            break
    return x


def plan(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences); uses every piece of the histogram once."""
    left, chosen = counts.astype(np.int64).copy(), []
    combos = combinations(left, window)
    for j in np.argsort(-(x := solve(left, combos)), kind="stable"):
        combo = combos[j]
        times = min([int(x[j] + 1e-6), *(int(left[v]) // combo.count(v) for v in set(combo))])
        if times > 0:
            for v in combo:
                left[v] -= times
            chosen.append((combo, times))
    while len(there := np.flatnonzero(left[1:]) + 1):
        room, combo, used = window, [], {}
        for v in there[::-1].tolist():
            fits = min(room // v, int(left[v]))
            if fits:
                combo += [v] * fits
                used[v] = fits
                room -= v * fits
        times = min(int(left[v]) // n for v, n in used.items())
        for v, n in used.items():
            left[v] -= times * n
        chosen.append((tuple(combo), times))
    return chosen


def _places(chosen: list[tuple[tuple[int, ...], int]]) -> list[tuple]:
    """(length, first rank, end rank, first sequence, offset) of every slot of every combination."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for combo, times in chosen:
        offset = 0
        for v in combo:
            first = ranks.get(v, 0)
            ranks[v] = first + times
            out.append((v, first, first + times, sequence, offset))
            offset += v
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces with their sequence_id and offset: doc_id, start, length, ids_crc32, doc_tokens.

    A null or empty text is the end id alone. Each input row is a document of its own, repeated
    rows and null ids included. Sequences hold at most ``window`` ids without gaps from offset 0;
    no table has no sequences.
    """
    if window < 1:
        raise ValueError("window must be positive")
    pieces = checkpointed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                      F.col("text").cast("string").alias("text"))
                          .mapInArrow(_pieces(tokenizer, window, end_id), _PIECE_DDL))
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ranks within a length: within (length, bucket), plus the counts of the buckets before.
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)))
    counted = checkpointed(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(window + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # window rows at most
        histogram[r["length"]] = r["n"]
    before = counted.select("length", "bucket", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (pieces.withColumn("within", F.row_number().over(within) - 1)
              .join(before, ["length", "bucket"])
              .withColumn("rank", F.col("within") + F.col("before")))
    places = spark.createDataFrame(
        _places(plan(histogram, window)) or [],
        "length bigint, first bigint, last bigint, sequence bigint, offset bigint")
    # At most a few places for each of the window's lengths.
    return (ranked.join(F.broadcast(places), "length")
            .filter("rank >= first AND rank < last")
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                    (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"),
                    "offset"))


def padding(used: np.ndarray, window: int) -> int:
    """Padding ids of sequences with ``used`` ids: up to the window, except at a power of two."""
    power = (used & (used - 1)) == 0
    return int(np.where(power, 0, window - used).sum())
