"""Alignment of two tokenizers by products of token-byte incidence matrices.

A text's tokens under either tokenizer are rows of a sparse 0/1 matrix whose columns are the bytes
of a space and the text. Row products (Gustavson: every stored column of a row of A picks a row of
the transpose of B, and the picked rows are added up) give the links of a text:

* ``overlap``: whole incidence matrices; the value of a link is the number of shared bytes;
* ``end``: only each token's last byte is stored, so linked tokens end together;
* ``group``: tokens by groups, which are cut wherever a token of A and one of B both end.

Rows: texts that are null, empty, or that either tokenizer doesn't give back byte by byte have no
tokens. Rows with equal or null doc_ids are separate documents; an empty table gives no rows.
Texts that spell a special token are ordinary text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, rows, stored
from .packing import Encoder

#: Products expanded at a time, and code points of text aligned at a time.
_EXPANDED, _CHARS = 4_000_000, 1_000_000


@dataclass
class Csr:
    """Compressed sparse rows: row i's columns are ``indices[indptr[i]:indptr[i + 1]]``."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def transpose(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        row = np.repeat(np.arange(self.rows), np.diff(self.indptr))
        counts = np.bincount(self.indices, minlength=self.columns)
        return Csr(np.r_[0, np.cumsum(counts)], row[order], self.data[order], self.rows)

    def products(self, other: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, column, value) of ``self @ other``, sorted, a block of rows at a time.

        A block holds about ``_EXPANDED`` terms, or one row if that has more.
        """
        width = np.diff(other.indptr)[self.indices]
        before = np.r_[0, np.cumsum(width)][self.indptr]     # terms before each row
        at = 0
        while at < self.rows:
            to = int(np.searchsorted(before, before[at] + _EXPANDED, "right")) - 1
            to = min(max(to, at + 1), self.rows)
            lo, hi = self.indptr[at], self.indptr[to]
            w = width[lo:hi]
            total = int(w.sum())
            row = np.repeat(np.repeat(np.arange(at, to), np.diff(self.indptr[at:to + 1])), w)
            # The terms of one stored entry are one row of ``other``, from its start on.
            start = other.indptr[self.indices[lo:hi]] - (np.cumsum(w) - w)
            place = np.arange(total) + np.repeat(start, w)
            value = np.repeat(self.data[lo:hi], w) * other.data[place]
            key = row * max(other.columns, 1) + other.indices[place]
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:total])
            key = key[first]
            yield (key // max(other.columns, 1), key % max(other.columns, 1),
                   np.add.reduceat(value, first) if len(first) else value)
            at = to

    def product(self, other: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blocks = list(self.products(other))
        if not blocks:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(c) for c in zip(*blocks))


def _ones(indptr: np.ndarray, indices: np.ndarray, columns: int) -> Csr:
    return Csr(indptr, indices, np.ones(len(indices), np.int64), columns)


def byte_incidence(lengths: np.ndarray) -> Csr:
    """Every token with each of its bytes."""
    ends = np.r_[0, np.cumsum(lengths)]
    return _ones(ends, np.arange(ends[-1]), int(ends[-1]))


def end_incidence(lengths: np.ndarray) -> Csr:
    """Every token with its last byte."""
    ends = np.cumsum(lengths)
    return _ones(np.arange(len(ends) + 1), ends - 1, int(ends[-1]) if len(ends) else 0)


def common_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Byte offsets where tokens of both kinds end, from the tokens' lengths."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    held = np.zeros(int(ends_b[-1]) + 1 if len(b) else 1, bool)
    held[ends_b] = True
    return ends_a[held[ends_a]]


def group_incidence(lengths: np.ndarray, cuts: np.ndarray) -> Csr:
    """Every token with the group that it lies in."""
    group = np.searchsorted(cuts, np.cumsum(lengths))
    return _ones(np.arange(len(group) + 1), group, len(cuts))


INCIDENCE = {"overlap": lambda own, cuts: byte_incidence(own),
             "end": lambda own, cuts: end_incidence(own),
             "group": group_incidence}


class _Plain(Encoder):
    """Ids without any special token: their strings are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.whole.encode_special_tokens = True
        self.special = []


def _bytes_of_levels() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = _Plain(a_path)
        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)
        level = _bytes_of_levels()
        self.a_bytes = [b""] * (1 + max(model["model"]["vocab"].values(), default=0))
        for token, i in model["model"]["vocab"].items():
            if all(c in level for c in token):
                self.a_bytes[i] = bytes(level[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                self.b_bytes.append(b"")
            else:
                self.b_bytes.append(piece.replace("▁", " ").encode("utf-8"))
        self.a_lengths = np.array([len(x) for x in self.a_bytes])
        self.b_lengths = np.array([len(x) for x in self.b_bytes])
        #: Decimal ids with what follows them: inside a group, at the end of its A or B part.
        self.shown = [b"%d%c" % (i, c) for i in range(len(self.a_bytes)) for c in b",|"] + [
            b"%d%c" % (i, c) for i in range(len(self.b_bytes)) for c in b",;"]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both kinds; none where a kind doesn't give the bytes of the text back."""
        none = np.zeros(0, np.int64)
        spaced = [" " + t if t else "" for t in texts]
        pieces = self.b.encode([t or "" for t in texts], num_threads=1)
        found = []
        for text, b in zip(spaced, pieces):
            a, want = none, text.encode("utf-8", "surrogatepass")
            if text and b"".join([self.b_bytes[i] for i in b]) == want:
                a = np.frombuffer(self.a(text), "<u4").astype(np.int64)
                if b"".join([self.a_bytes[i] for i in a.tolist()]) != want:
                    a = none
            found.append((a, np.array(b, np.int64) if len(a) else none))
        return found


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


class Block:
    """Some texts side by side: their bytes, tokens and groups follow each other."""

    def __init__(self, both: Pair, texts: list[str | None]):
        self.both = both
        ids = both.encode(texts)
        self.n_a = np.array([len(a) for a, _ in ids])
        self.n_b = np.array([len(b) for _, b in ids])
        self.a = np.concatenate([a for a, _ in ids]) if ids else np.zeros(0, np.int64)
        self.b = np.concatenate([b for _, b in ids]) if ids else np.zeros(0, np.int64)
        self.a_lengths, self.b_lengths = both.a_lengths[self.a], both.b_lengths[self.b]
        self.cuts = common_ends(self.a_lengths, self.b_lengths)

    def links(self, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, value), numbered over the block."""
        build = INCIDENCE[kind]
        left, right = build(self.a_lengths, self.cuts), build(self.b_lengths, self.cuts)
        return left.products(right.transpose())

    def groups(self) -> list[tuple[int, bytes]]:
        """Each text's number of groups and their ids as text."""
        ga = group_incidence(self.a_lengths, self.cuts).indices
        gb = group_incidence(self.b_lengths, self.cuts).indices
        in_a, in_b = (np.bincount(g, minlength=len(self.cuts)) for g in (ga, gb))
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        codes = np.empty(len(ga) + len(gb), np.int64)
        last_a, last_b = (np.r_[g[1:] != g[:-1], True][:len(g)] for g in (ga, gb))
        codes[np.arange(len(ga)) + (upto_b - in_b)[ga]] = 2 * self.a + last_a
        codes[np.arange(len(gb)) + upto_a[gb]] = 2 * (len(self.both.a_bytes) + self.b) + last_b
        found, at, shown = [], 0, self.both.shown
        for n_a, n_b in zip(self.n_a.tolist(), self.n_b.tolist()):
            part = codes[at:at + n_a + n_b]
            at += n_a + n_b
            text = b"".join([shown[c] for c in part.tolist()])[:-1]
            found.append((text.count(b";") + 1 if text else 0, text))
        return found


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Columns (other values, texts) of rows with about ``_CHARS`` code points at a time."""
    for *others, texts in rows(batches, 200):
        at, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size > _CHARS or i + 1 == len(texts):
                yield [c[at:i + 1] for c in others], texts[at:i + 1]
                at, size = i + 1, 0


def links(docs: DataFrame, a_path: str, b_path: str, kind: str = "overlap") -> DataFrame:
    """Every link of every text: doc_id, a_index, b_index (tokens from 0), a_id, b_id, value.

    ``kind`` is overlap, end or group. The links of a group are all its pairs, as the product says.
    """
    if kind not in INCIDENCE:
        raise ValueError(f"kind must be one of {sorted(INCIDENCE)}")
    schema = pa.schema([(n, pa.int64()) for n in
                        ("doc_id", "a_index", "b_index", "a_id", "b_id", "value")])

    def run(batches):
        both = pair(a_path, b_path)
        for (ids,), texts in _portions(batches):
            block = Block(both, texts)
            owner = np.repeat(np.arange(len(texts)), block.n_a)
            a_first, b_first = (np.cumsum(n) - n for n in (block.n_a, block.n_b))
            for i, j, value in block.links(kind):
                doc = owner[i]
                yield record(schema, [
                    pa.array(ids, pa.int64()).take(pa.array(doc)), i - a_first[doc],
                    j - b_first[doc], block.a[i], block.b[j], value])

    return _texts(docs).mapInArrow(run, ", ".join(f"{n} bigint" for n in schema.names))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


_ALIGNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()),
                      ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                      ("groups_sha256", pa.string()), ("pairs", pa.binary()),
                      ("times", pa.binary())])
_ALIGNED_DDL = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, "
                "n_links bigint, groups_sha256 string, pairs binary, times binary")


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: its counts, the hash of its groups, and its end links by id pair.

    ``pairs`` has the distinct pairs as little-endian 64-bit numbers (A id times 2^24, plus B id)
    and ``times`` how many links each has (32 bits). ``row`` tells rows apart. The table is
    written, as tokenising is dear and every link counts corpus-wide.
    """
    def run(batches):
        both = pair(a_path, b_path)
        number = TaskContext.get().partitionId() << 40
        for (ids,), texts in _portions(batches):
            block = Block(both, texts)
            owner = np.repeat(np.arange(len(texts)), block.n_a)
            held = [((owner[i] << 48) | (block.a[i] << 24) | block.b[j])
                    for i, j, _ in block.links("end")]
            keys, times = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64),
                                    return_counts=True)
            cut = np.searchsorted(keys, np.arange(len(texts) + 1) << 48)
            keys, times = (keys & ((1 << 48) - 1)).astype("<u8"), times.astype("<u4")
            out: list[list] = [[] for _ in _ALIGNED]
            for k, (n, text) in enumerate(block.groups()):
                lo, hi = cut[k], cut[k + 1]
                for column, value in zip(out, (
                        number, ids[k], int(block.n_a[k]), int(block.n_b[k]), n,
                        int(times[lo:hi].sum()), hashlib.sha256(text).hexdigest() if text else "",
                        keys[lo:hi].tobytes(), times[lo:hi].tobytes())):
                    column.append(value)
                number += 1
            yield record(_ALIGNED, out)

    return stored(_texts(docs).mapInArrow(run, _ALIGNED_DDL), "aligned")


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _lists(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs and times of all rows of a batch, one after another."""
    pairs, times = batch.column(at).to_pylist(), batch.column(at + 1).to_pylist()
    return (np.frombuffer(b"".join(pairs), "<u8").astype(np.int64),
            np.frombuffer(b"".join(times), "<u4").astype(np.int64))


def pair_counts(found: DataFrame, held: int = 1 << 20) -> DataFrame:
    """pair, n (links of the id pair in the corpus), best (n is the highest of its B id).

    A task adds its pairs up, up to ``held`` at a time, before any row is shuffled.
    """
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches):
        none = np.zeros(0, np.int64)
        sums = (none, none)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                keys, counts = _lists(batch.slice(at, 64), 0)
                sums = _added(np.r_[sums[0], keys], np.r_[sums[1], counts])
                if len(sums[0]) > held:
                    yield record(schema, [pa.array(c) for c in sums])
                    sums = (none, none)
        yield record(schema, [pa.array(c) for c in sums])

    counts = (found.select("pairs", "times").mapInArrow(run, "pair bigint, n bigint")
              .groupBy("pair").agg(F.sum("n").alias("n"))
              .withColumn("b", F.col("pair").bitwiseAND((1 << 24) - 1)))
    counts = stored(counts, "pairs")
    # One row for each id of a vocabulary, at most 2^24 of them and 32,000 here.
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


_SCORED = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()),
                     ("pair", pa.int64()), ("times", pa.int64())])
_SCORED_DDL = ", ".join(f"{f.name} bigint" for f in _SCORED)


def scores(found: DataFrame, counts: DataFrame, head: int = 1 << 20) -> DataFrame:
    """``found`` with n_best and count_sum, without its pairs.

    At most ``head`` pairs, the most frequent ones, are sent to every task; they cover nearly all
    links however large the corpus is, so a frequent pair is never a join key. The pairs below
    the head, if there are any, are joined with the documents that hold them.
    """
    spark = found.sparkSession
    counts = stored(counts, "counts")
    sizes = {r["k"]: r["count"] for r in
             counts.groupBy(F.floor(F.log2("n")).alias("k")).count().collect()}  # at most 64 rows
    least, total = 64, 0
    for k in sorted(sizes, reverse=True):
        if total + sizes[k] > head:
            break
        least, total = k, total + sizes[k]
    top = counts.filter(F.floor(F.log2("n")) >= least).toPandas()                # ``head`` at most
    order = np.argsort(top["pair"].to_numpy(np.int64), kind="stable")
    sent = spark.sparkContext.broadcast(tuple(
        top[c].to_numpy(np.int64)[order] for c in ("pair", "n", "best")))

    def run(batches):
        pairs, n, best = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                row = part.column(0).to_numpy()
                keys, times = _lists(part, 1)
                sizes = [len(x) // 8 for x in part.column(1).to_pylist()]
                owner = np.repeat(np.arange(len(row)), sizes)
                place = np.searchsorted(pairs, keys)
                known = np.zeros(len(keys), bool)
                inside = place < len(pairs)
                known[inside] = pairs[place[inside]] == keys[inside]
                got = place[known]
                add_best = np.zeros(len(row), np.int64)
                add_sum = np.zeros(len(row), np.int64)
                np.add.at(add_best, owner[known], times[known] * best[got])
                np.add.at(add_sum, owner[known], times[known] * n[got])
                blank = pa.nulls(len(row), pa.int64())
                yield record(_SCORED, [row, add_best, add_sum, blank, blank])
                rest = ~known
                if rest.any():
                    none = pa.nulls(int(rest.sum()), pa.int64())
                    yield record(_SCORED, [row[owner[rest]], none, none, keys[rest], times[rest]])

    looked_up = found.select("row", "pairs", "times").mapInArrow(run, _SCORED_DDL)
    if total < sum(sizes.values()):
        rare = counts.filter(F.floor(F.log2("n")) < least)
        looked_up = stored(looked_up, "lookups")
        looked_up = looked_up.filter("pair IS NULL").select("row", "n_best", "count_sum").unionByName(
            looked_up.drop("n_best", "count_sum").join(rare, "pair").select(
                "row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"),
                (F.col("times") * F.col("n")).alias("count_sum")))
    summed = looked_up.groupBy("row").agg(F.sum("n_best").alias("n_best"),
                                          F.sum("count_sum").alias("count_sum"))
    return found.drop("pairs", "times").join(summed, "row").drop("row")


def align(docs: DataFrame, a_path: str, b_path: str, head: int = 1 << 20) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    found = aligned(docs, a_path, b_path)
    return scores(found, pair_counts(found), head)


def brute_force(texts: list[tuple], a_path: str, b_path: str) -> list[tuple]:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) token by token; small."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(a_path)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=b_path)
    level = _bytes_of_levels()
    counts: dict[tuple, int] = {}
    kept = []
    for doc, text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        spans = []
        for ids, raw in ((a, lambda i: bytes(level[c] for c in one.id_to_token(i))),
                         (b, lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i)
                          else two.id_to_piece(i).replace("▁", " ").encode())):
            at, ends, joined = 0, [], b""
            for i in ids:
                joined += raw(i)
                ends.append(len(joined))
            spans.append((ends, joined))
        if not text or any(s[1] != (" " + text).encode() for s in spans):
            kept.append((doc, [], [], [], []))
            continue
        (ends_a, _), (ends_b, _) = spans
        both = sorted(set(ends_a) & set(ends_b))
        linked = [(a[i], b[j]) for i, e in enumerate(ends_a) for j, f in enumerate(ends_b) if e == f]
        for x in linked:
            counts[x] = counts.get(x, 0) + 1
        groups, low = [], 0
        for cut in both:
            groups.append(tuple(",".join(str(i) for i, e in zip(ids, ends) if low < e <= cut)
                                for ids, ends in ((a, ends_a), (b, ends_b))))
            low = cut
        kept.append((doc, a, b, groups, linked))
    top: dict[int, int] = {}
    for (_, j), n in counts.items():
        top[j] = max(top.get(j, 0), n)
    return [(doc, len(a), len(b), len(groups), len(linked),
             sum(counts[x] == top[x[1]] for x in linked), sum(counts[x] for x in linked),
             ";".join(f"{x}|{y}" for x, y in groups)) for doc, a, b, groups, linked in kept]
