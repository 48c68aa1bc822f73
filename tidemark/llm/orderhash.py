"""Order MinHash fingerprints, sensitive to edit distance, as column expressions only.

The k-mers of a text are runs of ``k`` words; a k-mer that occurs again gets the number of its
occurrence, so that all are distinct. Each is hashed once. An entry orders them by the exclusive or
of their hash with its own seed, a bijection, so every k-mer is equally likely to come first: the
``keep`` smallest of all are selected, put back into text order, and their k-mers are hashed as a
tuple. Equal texts have equal fingerprints, and the share of equal entries falls with edits and
with moved passages alike.

The hashes that are smallest after the exclusive or share the most leading bits with the seed, so in
sorted order they lie next to each other around the seed: an entry looks at a few neighbours, and at
all hashes with the same leading bits where these reach beyond them.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, KEEP, ENTRIES = 2, 2, 32
#: Low bits of a packed value that hold the position of a k-mer: a string of 2 GiB has no more
#: words. The bits above hold its hash, and the sign is clear.
_POSITION = 30
_MASK = (1 << _POSITION) - 1
_HASH = 63 - _POSITION
#: Neighbours of a seed that are looked at first, on either side.
_NEAR = 6
#: Most ranges of ids; beyond it they grow, and a task's window spills.
MOST_RANGES = 16_383


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def seeds_of(entries: int) -> list[int]:
    """Fixed seeds with different leading bits, spread over all hashes."""
    rng = random.Random(8)
    step = (1 << _HASH) // entries
    return [e * step + rng.randrange(step) for e in range(entries)]


def _packed(high: Column, low: Column) -> Column:
    """A hash's leading bits above a position."""
    return F.shiftrightunsigned(high, 1).bitwiseAND(~_MASK).bitwiseOR(low.cast("bigint"))


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, _POSITION)


def signature(text: Column, k: int = K, keep: int = KEEP, entries: int = ENTRIES) -> Column:
    """Array of ``entries`` hashes of a text, each from its own order of all k-mers.

    A text of fewer than ``k`` words has its whole sequence as its only k-mer.
    """
    seeds = F.array(*(F.lit(s) for s in seeds_of(entries)))
    halves = F.array(*(F.lit(1 << b) for b in range(_POSITION - 1, -1, -1)))

    def of_words(words):
        count = F.greatest(F.size(words) - (k - 1), F.lit(1))

        def gram(i):
            return F.xxhash64(*(F.get(words, i + j) for j in range(k)))

        packed = F.sort_array(F.transform(
            F.sequence(F.lit(0), count - 1), lambda i: _packed(gram(i), i)))

        def numbered(grams):
            def same(i, back):
                return _hash(F.get(grams, i - back)) == _hash(F.get(grams, i))

            def occurrence(i):
                # Equal k-mers are neighbours, so the run's start is found by halving steps.
                return F.when((i > 0) & same(i, 1), F.aggregate(
                    halves, F.lit(0), lambda done, step: F.when(
                        (i - done - step >= 0) & same(i, done + step), done + step)
                    .otherwise(done))).otherwise(0)

            return F.sort_array(F.transform(grams, lambda g, i: _packed(
                F.xxhash64(_hash(g), occurrence(i)), g.bitwiseAND(_MASK))))

        def tuples(hashed):
            def nearest(some, seed):
                """Distances to the seed above positions, the ``keep`` smallest."""
                return F.slice(F.sort_array(F.transform(some, lambda x: F.shiftleft(
                    _hash(x).bitwiseXOR(seed), _POSITION).bitwiseOR(x.bitwiseAND(_MASK)))), 1, keep)

            def around(seed):
                # How many hashes are below the seed, by halving steps.
                below = F.aggregate(halves, F.lit(0), lambda done, step: F.when(
                    F.get(hashed, done + step - 1) < F.shiftleft(seed, _POSITION), done + step)
                    .otherwise(done))
                return F.greatest(below - _NEAR, F.lit(0))

            def entry(seed):
                return _let(around(seed), lambda at: _let(
                    F.slice(hashed, at + 1, 2 * _NEAR), lambda some: _let(
                        nearest(some, seed), lambda best: chosen(seed, at, some, best))))

            def chosen(seed, at, some, best):
                # All hashes as near as the last one found share its leading bits with the seed.
                span = _let(_hash(F.element_at(best, -1)), lambda d: F.when(d == 0, F.lit(0))
                            .otherwise(F.pow(F.lit(2.0), F.floor(F.log2(d)) + 1) - 1)
                            .cast("bigint"))
                return _let(span, lambda rest: _let(F.when(
                    ((at == 0) | (_hash(F.get(some, 0)) < seed.bitwiseAND(F.bitwise_not(rest))))
                    & ((at + 2 * _NEAR >= count)
                       | (_hash(F.element_at(some, -1)) > seed.bitwiseOR(rest))), best).otherwise(
                    nearest(F.filter(hashed, lambda x: _hash(x).bitwiseOR(rest)
                                     == seed.bitwiseOR(rest)), seed)), in_order))

            def in_order(best):
                return F.aggregate(
                    F.sort_array(F.transform(best, lambda x: x.bitwiseAND(_MASK).cast("int"))),
                    F.lit(0).cast("bigint"), lambda s, i: F.xxhash64(s, gram(i)))

            return F.transform(seeds, entry)

        return _let(packed, lambda g: _let(numbered(g), tuples))

    return _let(F.split(F.coalesce(text, F.lit("")), r"\s+"), of_words)


def as_text(entries: Column) -> Column:
    return F.concat_ws("", F.transform(
        entries, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0),
                        lambda s, x: s + x)
    return equal / F.size(a).cast("double")


def with_next(docs: DataFrame, per_bucket: int = 2000) -> DataFrame:
    """``docs`` (doc_id and more) with ``next``, a struct of the following row's other columns.

    Rows follow each other by descending doc_id (nulls last, equal ids by text), and the first
    follows the last. Ids are cut into ranges by quantiles; each range's first row is copied into
    the range above it, where it stands last, so one exchange suffices and no task sees more than
    a few ranges. The driver holds two numbers for each range, never rows.
    """
    others = [c for c in docs.columns if c != "doc_id"]
    n = docs.select(F.count(F.lit(1))).first()[0]
    ranges = min(max(1, -(-n // per_bucket)), MOST_RANGES)
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL")
    cuts = ids.select(F.percentile_approx(
        "doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts)) if ranges > 1 else []
    bounds = F.lit(cuts).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull() | F.lit(not cuts), F.lit(0)).otherwise(
        # Cuts at or below the id, found by halving steps.
        F.aggregate(F.array(*(F.lit(1 << b) for b in range(MOST_RANGES.bit_length() - 1, -1, -1))),
                    F.lit(0), lambda done, step: F.when(
                        F.get(bounds, done + step - 1) <= F.col("doc_id"), done + step)
                    .otherwise(done)))
    marked = docs.withColumn("bucket", bucket)
    heads = {r["bucket"]: r["top"] for r in
             docs.select("doc_id").withColumn("bucket", bucket).groupBy("bucket")
             .agg(F.max("doc_id").alias("top")).collect()}
    if not heads:
        return docs.withColumn("next", F.struct(*others))
    order = sorted(heads)
    # The first row of a range goes to the end of the next higher one; the first of all to the
    # end of the lowest.
    goes = {heads[b]: above for b, above in zip(order, [*order[1:], order[0]])}
    pairs = [(k, v) for k, v in goes.items()]
    spark = docs.sparkSession
    targets = spark.createDataFrame(pairs, "doc_id bigint, target int")
    copies = F.when(F.col("target").isNotNull(), F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra")),
        F.struct(F.col("target").alias("bucket"), F.lit(1).alias("extra")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra"))))
    dealt = (marked.join(F.broadcast(targets), marked["doc_id"].eqNullSafe(targets["doc_id"]),
                         "left").drop(targets["doc_id"])
             .withColumn("copy", F.explode(copies)))
    follow = Window.partitionBy(F.col("copy.bucket")).orderBy(
        F.col("copy.extra"), F.col("doc_id").desc_nulls_last(), *others[:1])
    return (dealt.withColumn("next", F.lead(F.struct(*others)).over(follow))
            .filter("copy.extra = 0").select(*docs.columns, "next"))


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by as many first ones of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half),
                    F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited text's digest, both fingerprints, near_edited and near_next.

    A null text counts as empty. One row per input row; equal ids follow each other by text; a
    null id comes last. A single document is followed by itself.
    """
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = with_next(texts.withColumn("sig", signature(F.col("text"))))
    changed = signed.select("doc_id", "text", "sig", F.col("next.sig").alias("next_sig"),
                            edited(F.col("text"), F.col("next.text")).alias("edited"))
    both = changed.withColumn("edited_sig", signature(F.col("edited")))
    return both.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
