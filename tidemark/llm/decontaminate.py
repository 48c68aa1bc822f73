"""Benchmark decontamination by winnowed k-gram fingerprints (local fingerprint selection).

Every run of ``span`` words that a document shares with a benchmark item leaves the same k-gram
chosen on both sides, because a window of ``span - k + 1`` consecutive k-grams always keeps its
smallest hash (the rightmost of equal ones). Chosen k-grams are joined by hash and each hit is
extended word by word on the actual words, so hash collisions cost time but not correctness.
Items shorter than ``span`` are joined by all document n-grams of their own length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, record, rows, utf8

#: Bits of the filter that keeps unrelated k-grams from the shuffle; its size never grows.
FILTER_BITS = 1 << 20
_BUCKET = 32768  # bits in one value of bitmap_construct_agg
_CACHE = 150_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(WORD_BYTES).split()


def grams(words: list[bytes], k: int) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j:j + n]) * _ODD
        out ^= out >> np.uint64(29)
    return out


def chosen(g: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Those of positions ``at`` that some full window of ``window`` grams keeps."""
    reach = [np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)]
    for side, step in ((0, -1), (1, 1)):
        going = np.ones(len(at), bool)
        for d in range(1, window):
            other = at + step * d
            inside = (other >= 0) & (other < len(g))
            value = g[np.clip(other, 0, len(g) - 1)]
            going &= inside & ((value >= g[at]) if side == 0 else (value > g[at]))
            reach[side] += going
    return at[reach[0] + reach[1] + 1 >= window]


_FINGERPRINT = pa.schema([("key", pa.int64()), ("words", pa.int64()), ("hash", pa.int64()),
                          ("at", pa.int64()), ("left", pa.int64()),
                          ("context", pa.list_(pa.binary()))])
_FINGERPRINT_DDL = ("key bigint, words bigint, hash bigint, at bigint, left bigint, "
                    "context array<binary>")


def _fingerprints(words, k, span, lengths, passes):
    """(hash, start, words before the gram, context) of every gram to be joined."""
    window = span - k + 1
    if len(words) >= span:
        g = grams(words, k)
        at = passes(g)
        for p in chosen(g, at, window).tolist() if len(at) else ():
            low = max(0, p + k - span)
            yield g[p], p, p - low, words[low:p + span]
    for n in lengths:
        g = grams(words, n)
        for p in passes(g).tolist() if len(g) else ():
            yield g[p], p, 0, words[p:p + n]


def _item_rows(k: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in rows(batches):
            out: list[list] = [[] for _ in _FINGERPRINT]
            for key, text in zip(keys, texts):
                words = words_of(text)
                short = (len(words),) if 0 < len(words) < span else ()
                found = {}
                for h, p, left, context in _fingerprints(words, k, span, short,
                                                         lambda g: np.arange(len(g))):
                    found.setdefault((h, left, tuple(context)), p)
                for (h, left, context), p in found.items():
                    for c, v in zip(out, (key, len(words), int(h.astype(np.int64)), p, left,
                                          list(context))):
                        c.append(v)
            yield record(_FINGERPRINT, out)
    return run


def _document_rows(k: int, span: int, lengths: tuple[int, ...], bitmap):
    """One row per document with its word count and one for each gram that passes the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").astype(bool)
        mask = np.uint64(FILTER_BITS - 1)

        def passes(g):
            return np.flatnonzero(bits[(g & mask).astype(np.int64)])

        for ids, marks, texts in rows(batches):
            out: list[list] = [[] for _ in range(7)]
            for i, mark, text in zip(ids, marks, texts):
                words = words_of(text)
                # No item has this hash together with an empty context.
                found = [(np.uint64(mark & (2**64 - 1)), -1, 0, [])]
                found += _fingerprints(words, k, span, lengths, passes)
                for h, p, left, context in found:
                    for c, v in zip(out, (i, mark, len(words), int(h.astype(np.int64)), p, left,
                                          context)):
                        c.append(v)
            yield record(_DOCUMENT, out)
    return run


_DOCUMENT = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), *list(_FINGERPRINT)[1:]])
_DOCUMENT_DDL = "doc_id bigint, mark bigint, " + _FINGERPRINT_DDL.split(", ", 1)[1]


def _run(a, b, most):
    """How many of the first ``most`` words of two arrays agree before one differs."""
    other = F.array_position(F.zip_with(a, b, lambda x, y: x != y), True)
    return F.when(other == 0, most).otherwise(other - 1)


def _extend(joined: DataFrame, span: int) -> DataFrame:
    """Extend joined grams on the words themselves; keep runs as long as the item's window.

    Native, since a Python step behind that of the document rows would need a second Python worker
    a task. Rows without words stand for their document and stay.
    """
    left, ileft = F.col("left").cast("int"), F.col("ileft").cast("int")
    back = F.least(left, ileft)
    ahead = F.least(F.size("context") - left, F.size("icontext") - ileft)

    def behind(words, at):
        return F.reverse(F.slice(words, at - back + 1, back))

    low = _run(behind("context", left), behind("icontext", ileft), back)
    high = _run(F.slice("context", left + 1, ahead), F.slice("icontext", ileft + 1, ahead), ahead)
    met = F.col("item_id").isNotNull() & (F.size("context") > 0)
    need = F.least(F.lit(span), F.col("size"))
    runs = joined.withColumns({"low": F.when(met, low), "high": F.when(met, high)})
    whole = F.coalesce((need > 0) & (F.col("low") + F.col("high") >= need), F.lit(False))
    return (runs.filter(whole | (F.size("context") == 0))
            .select("doc_id", "mark", "words", F.when(whole, F.col("item_id")).alias("item_id"),
                    F.when(whole, F.col("at") - F.col("low")).alias("first"),
                    F.when(whole, F.col("at") + F.col("high")).alias("last")))


_RESULT = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                     ("items", pa.list_(pa.int64())),
                     ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])
_RESULT_DDL = ("doc_id bigint, mark bigint, n_words bigint, n_hit bigint, items array<bigint>, "
               "spans array<struct<first:bigint,last:bigint>>")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for docs, marks, counts, hits in rows(batches):
        out: list[list] = [[] for _ in _RESULT]
        for doc, mark, n, found in zip(docs, marks, counts, hits):
            spans: list[list[int]] = []
            for first, last in sorted((x["first"], x["last"]) for x in found):
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], last)
                else:
                    spans.append([first, last])
            items = sorted({x["item_id"] for x in found if x["item_id"] is not None})
            for c, v in zip(out, (doc, mark, n, sum(b - a for a, b in spans), items,
                                  [{"first": a, "last": b} for a, b in spans])):
                c.append(v)
        yield record(_RESULT, out)


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 5, span: int = 13) -> DataFrame:
    """Words of each document that lie in a ``span``-word run of a benchmark item.

    Returns doc_id, mark (a hash of text and doc_id), n_words, n_hit, items (sorted item ids) and
    spans (merged word ranges, end exclusive). A null text has no words and no hits. Rows with the same doc_id and text are one
    document; the same doc_id with different texts gives a row for each text; a null doc_id is
    kept. An item with null or wordless text matches nothing; a null item_id is ignored.
    """
    if not 0 < k <= span:
        raise ValueError("k must lie between 1 and span")
    items = (benchmark.select(F.col("item_id").cast("bigint").alias("item_id"),
                              F.col("text").cast("string").alias("text"))
             .filter("item_id IS NOT NULL").mapInArrow(_item_rows(k, span), _FINGERPRINT_DDL)
             .withColumnRenamed("key", "item_id"))
    bit = F.col("hash").bitwiseAND(FILTER_BITS - 1) + 1
    parts = (items.groupBy(F.bitmap_bucket_number(bit).alias("b"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect())
    bitmap = bytearray(FILTER_BITS // 8)
    for row in parts:  # FILTER_BITS / 32768 rows at most
        at = (row["b"] - 1) * _BUCKET // 8
        bitmap[at:at + _BUCKET // 8] = row["bits"]
    lengths = tuple(sorted(r["words"] for r in items.filter(F.col("words") < span)
                           .select("words").distinct().collect()))  # span - 1 rows at most
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bitmap))
    mine = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
            .select("doc_id", F.xxhash64("text", "doc_id").alias("mark"), "text")
            .mapInArrow(_document_rows(k, span, lengths, shared), _DOCUMENT_DDL))
    theirs = items.select("item_id", F.col("words").alias("size"), "hash",
                          F.col("left").alias("ileft"), F.col("context").alias("icontext"))
    hits = _extend(mine.join(theirs, "hash", "left"), span)
    return (hits.groupBy("doc_id", "mark")
            .agg(F.max("words").alias("n_words"),
                 F.collect_set(F.when(F.col("first").isNotNull(),
                                      F.struct("item_id", "first", "last"))).alias("hits"))
            .select("doc_id", "mark", "n_words", "hits").mapInArrow(_merge, _RESULT_DDL))


def is_contaminated(n_words, n_hit):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, its columns as they were."""
    found = contamination(docs, benchmark)
    gone = found.filter(is_contaminated(F.col("n_words"), F.col("n_hit"))).select("mark")
    mark = F.xxhash64(docs["text"].cast("string"), docs["doc_id"].cast("bigint"))
    return docs.join(gone.distinct(), mark == gone["mark"], "left_anti")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of ``contamination``'s result."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], span: int = 13) -> dict:
    """doc_id -> (n_words, n_hit, item ids) by comparing every window; for tests."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        words = words_of(text)
        size = min(span, len(words))
        for i in range(len(words) - size + 1) if size else ():
            windows.setdefault(tuple(words[i:i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if (w := tuple(words[i:i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[w]
        names = ",".join(sorted(map(str, found)))
        out[doc] = (len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest())
    return out
