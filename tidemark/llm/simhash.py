"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into two-bit segments and mapped to their bit counts. The Manhattan distance
of two count vectors is a lower bound of the Hamming distance, since moving one bit changes one
count by one. The 32 counts form six bands; two fingerprints within four bits have equal counts in
at least two bands, so the cells of the grid are the pairs of bands. Within a cell the Manhattan
bound is tested first and the exact distance last. Counts are kept in unary code (0, 1, 3), which
makes their Manhattan distance the popcount of an exclusive or.

Equal fingerprints collapse before anything is joined. A cell that holds more fingerprints than
``block`` is cut into blocks by hash, and every pair of blocks is a piece of work of its own, so no
task holds more than two blocks, however hot the cell. A task returns links that keep its part of
the cell connected, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, checkpointed, record, rows, utf8

#: Segments of two bits in each band; six bands hold all 32.
BANDS = (6, 6, 5, 5, 5, 5)
BITS = 4


def _band_masks() -> list[int]:
    masks, at = [], 0
    for n in BANDS:
        masks.append(((1 << 2 * n) - 1) << at)
        at += 2 * n
    return masks


#: Bits of the unary counts that make up each cell.
CELLS = [a | b for a, b in combinations(_band_masks(), 2)]
_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of ``width``-word shingles, repeats included; no words: zero."""
    words = utf8(text).translate(LOWER_BYTES).split()  # at space and \t to \r
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-width]]
    digest = xxhash.xxh64_intdigest
    counts, size = np.zeros(64, np.int64), len(starts)
    for at in range(0, size, 50_000):
        part = slice(at, at + 50_000)
        h = np.array([digest(joined[a:b], seed) for a, b in
                      zip(starts[part].tolist(), (ends[width - 1:][part] - 1).tolist())], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > size, bitorder="little").view(np.uint64)[0])


_PRINTS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("print", pa.int64())])


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, marks, texts in rows(batches):
            values = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield record(_PRINTS, [ids, marks, pa.array(values)])
    return run


def unary(f: np.ndarray) -> np.ndarray:
    """Two-bit segments replaced by the unary code of their bit count."""
    high, low = (f >> _ONE) & _LOW, f & _LOW
    return high | low | ((high & low) << _ONE)


_CELL = pa.schema([("cell", pa.int64()), ("print", pa.int64())])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pair of bands: a key mixed from the pair and its counts, and the print."""
    masks = np.array(CELLS, np.uint64)
    for batch in batches:
        f = batch.column(0).to_numpy().view(np.uint64)
        u = unary(f)
        keys = (u[:, None] & masks) ^ (np.arange(len(masks), dtype=np.uint64)
                                       * np.uint64(0x9E3779B97F4A7C15))
        yield record(_CELL, [pa.array(keys.ravel().view(np.int64)),
                             pa.array(np.repeat(f, len(masks)).view(np.int64))])


def components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each node's component, for edges between nodes 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(bits: int):
    def whole_cells(batches):
        """Rows of whole cells at a time: the last cell of a batch waits for the next batch."""
        kept = None
        for batch in batches:
            part = np.stack([batch.column(i).to_numpy() for i in range(4)])
            part = part if kept is None else np.concatenate([kept, part], axis=1)
            same = (part[:3, 1:] == part[:3, :-1]).all(axis=0)
            cut = np.flatnonzero(~same)
            at = int(cut[-1]) + 1 if len(cut) else 0
            if at:
                yield part[:, :at]
            kept = part[:, at:]
        if kept is not None and kept.shape[1]:
            yield kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_cells(batches):
            f = part[3].view(np.uint64)
            u = unary(f)
            n = part.shape[1]
            start = np.r_[True, (part[:3, 1:] != part[:3, :-1]).any(axis=0)]
            group = np.cumsum(start)
            label = np.arange(n)
            left, right, pending = [], [], 0
            at, lag = np.arange(n - 1), 1
            while len(at):
                at = at[at + lag < n]
                at = at[group[at] == group[at + lag]]
                near = at[np.bitwise_count(u[at] ^ u[at + lag]) <= bits]
                near = near[np.bitwise_count(f[near] ^ f[near + lag]) <= bits]
                left.append(near)
                right.append(near + lag)
                pending += len(near)
                lag += 1
                if pending > 1_000_000 or not len(at):
                    new = components(label[np.concatenate(left)], label[np.concatenate(right)], n)
                    label = new[label]
                    left, right, pending = [], [], 0
            linked = np.flatnonzero(label != np.arange(n))
            if len(linked):
                yield record(_LINK, [pa.array(part[3][linked]), pa.array(part[3][label[linked]])])
    return run


def links(prints: DataFrame, bits: int = BITS, block: int = 4096) -> DataFrame:
    """Links (a, b) that connect the same distinct prints as all pairs within ``bits`` bits do."""
    if not 0 <= bits <= BITS:
        raise ValueError(f"bits must be from 0 to {BITS}: six bands guarantee no more")
    cells = prints.select("print").distinct().mapInArrow(_cells, "cell bigint, print bigint")
    blocks = F.ceil(F.col("n") / block).cast("int")
    hot = (cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
           .select("cell", blocks.alias("blocks")))
    spread = (cells.join(hot, "cell", "left")
              .withColumn("own", F.when(F.col("blocks").isNull(), 0).otherwise(
                  F.pmod(F.xxhash64("print"), F.col("blocks")))))
    # Block i meets every block j; the pair is named by its smaller and larger number.
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).cast("array<int>"))
    pieces = spread.select("cell", "own", "print", other.alias("other")).select(
        "cell", F.least(F.col("own").cast("int"), "other").alias("i"),
        F.greatest(F.col("own").cast("int"), "other").alias("j"), "print")
    return (pieces.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "print")
            .select("cell", F.col("i").cast("bigint").alias("i"),
                    F.col("j").cast("bigint").alias("j"), "print")
            .mapInArrow(_links(bits), "a bigint, b bigint").distinct())


def roots(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each linked node can reach, by large and small stars.

    Each round hangs the larger neighbours of a node on its smallest one, and then the smaller
    ones; every second exchange ends in a checkpoint, so the plan stays short and a lost executor
    costs one round. Rounds grow with the logarithm of the longest chain.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                         .filter("a <> b").distinct())
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (both.join(low, "a").filter("b > a AND b <> low")
                 .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = (joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .union(low.select("a", F.col("low").alias("b"))).distinct())
        small = checkpointed(small.filter("a <> b"))
        # Done when every edge hangs on a node that hangs on nothing.
        deeper = small.join(small.select(F.col("a").alias("b")), "b", "left_semi")
        twice = small.groupBy("a").count().filter("count > 1")
        if not deeper.limit(1).count() and not twice.limit(1).count():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = small


def row_mark(docs: DataFrame):
    """A hash that tells rows apart by doc_id and text; repeated rows share it."""
    return F.xxhash64(docs["text"].cast("string"), docs["doc_id"].cast("bigint"))


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = BITS,
                    block: int = 4096) -> DataFrame:
    """doc_id, mark, print (signed 64 bits), component_id and keeper of every document.

    Prints link at ``bits`` or fewer differing bits; component_id is the smallest doc_id that can
    be reached, and keeper the mark (see ``row_mark``) of that document. Texts without words, null
    ones too, have print zero and link like any other. One row per input row; repeated rows are
    copies of each other. A null doc_id never names a component unless all its members' ids are
    null; of equal ids the row with the smallest mark is the keeper.
    """
    prints = checkpointed(
        docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), row_mark(docs).alias("mark"),
                    docs["text"].cast("string").alias("text"))
        .mapInArrow(_prints(width), "doc_id bigint, mark bigint, print bigint"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark"))
    distinct = checkpointed(prints.groupBy("print").agg(first.alias("low")))
    found = roots(links(distinct, bits, block)).withColumnRenamed("node", "print")
    rooted = distinct.join(found, "print", "left").select(
        "print", "low", F.coalesce("root", "print").alias("root"))
    names = rooted.groupBy("root").agg(F.min("low").alias("low"))
    classes = rooted.select("print", "root").join(names, "root").select(
        "print", F.col("low.doc_id").alias("component_id"), F.col("low.mark").alias("keeper"))
    return prints.join(classes, "print").select("doc_id", "mark", "print", "component_id",
                                                "keeper")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component, its columns as they were."""
    found = near_duplicates(docs)
    kept = found.filter("mark = keeper").select("mark")
    once = kept.distinct()
    marked = docs.select("*", row_mark(docs).alias("_row_mark"))
    out = marked.join(once, marked["_row_mark"] == once["mark"], "left_semi")
    if kept.groupBy("mark").count().filter("count > 1").limit(1).count():
        out = out.dropDuplicates(["_row_mark"])
    return out.drop("_row_mark")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of ``near_duplicates``'s result."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
                        "component_id")
