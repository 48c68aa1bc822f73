"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are known for documents only, so tokens are labelled first: a word is an offence where, in
documents labelled toxic, it stands between significantly more different pairs of neighbours than
elsewhere (neighbours, not occurrences: copied documents and repeated lines repeat the neighbours,
too). In toxic documents the tokens of such words are labelled toxic, all others ordinary; in clean
documents every token is ordinary. Windows of labelled tokens train a field of two tags over hashed
features (word, ends, shape, neighbours). Forward-backward gives every token of a text its
probability to be toxic; four statistics of these give the document's score by a logistic
regression on the labels, at their own rate.

Rows: one per input row, repeated ones and null ids included; a null text is empty and scores what
no token at all tells. Without two kinds of labels the score is the share of toxic ones, 0 if there
are none. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, record, stored

WORD = re.compile(r"[^\W_]+")
#: Hashed features, features of a token, tokens of a training window, windows of a document.
BUCKETS, WIDTH, WINDOW, WINDOWS = 1 << 17, 11, 32, 6
_CACHE, _LONG, _CHUNK = 300_000, 64, 64


def features(word: str) -> list[list[int]]:
    """Hashed features that a word gives to its own token, to the one after and the one before."""
    low = word.lower()
    shape = "U" if word.isupper() else "T" if word[:1].isupper() else "d" if word.isdigit() else (
        "m" if any(c.isdigit() for c in word) else "l")
    own = ["w" + low, "3" + low[:3], "4" + low[:4], "e" + low[-3:], "s" + shape,
           f"n{min(len(low), 16)}", "b"]
    after, before = ["pw" + low, "p3" + low[:3]], ["nw" + low, "n3" + low[:3]]
    return [[1 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for x in part]
            for part in (own, after, before)]


class Chain:
    """Potentials of many sequences side by side; a matrix is two by two, tag before and tag.

    At a sequence's first token both rows of the matrix are alike, so nothing is carried over.
    Products run over all chunks of the tokens at once, then over the chunks.
    """

    def __init__(self, emission: np.ndarray, first: np.ndarray, moves: np.ndarray,
                 start: np.ndarray):
        self.n = len(emission)
        chunks = max(1, -(-self.n // _CHUNK))
        pad = chunks * _CHUNK - self.n
        toxic = 1 / (1 + np.exp(-np.clip(np.r_[emission, np.full(pad, -30.0)], -30, 30)))
        factor = np.stack([1 - toxic, toxic])
        first = np.r_[first, np.ones(pad, bool)]
        step = np.exp(moves)
        # matrix[i, j]: from tag i to tag j, by place in a chunk and chunk.
        self.matrix = np.where(first, np.exp(start)[None, :, None], step[:, :, None]) * factor[None]
        self.matrix = self.matrix.reshape(2, 2, chunks, _CHUNK).transpose(0, 1, 3, 2)

    @staticmethod
    def _through(m: np.ndarray) -> np.ndarray:
        """Row vectors after every token, each scaled to a sum of 1: (2, places, chunks)."""
        _, _, places, chunks = m.shape
        p = np.zeros((2, 2, chunks))
        p[0, 0] = p[1, 1] = 1
        for j in range(places):
            a = m[:, :, j]
            p = np.stack([p[:, 0] * a[0, 0] + p[:, 1] * a[1, 0],
                          p[:, 0] * a[0, 1] + p[:, 1] * a[1, 1]], axis=1)
            p /= p.sum((0, 1))
        starts = np.empty((2, chunks))
        u, v = 0.5, 0.5
        for c, (a, b, d, e) in enumerate(p.reshape(4, chunks).T.tolist()):
            starts[0, c], starts[1, c] = u, v
            u, v = u * a + v * d, u * b + v * e
            u, v = u / (u + v), v / (u + v)
        found = np.empty((2, places, chunks))
        x = starts
        for j in range(places):
            a = m[:, :, j]
            x = np.stack([x[0] * a[0, 0] + x[1] * a[1, 0], x[0] * a[0, 1] + x[1] * a[1, 1]])
            x = x / x.sum(0)
            found[:, j] = x
        return found

    def alpha_beta(self) -> tuple[np.ndarray, np.ndarray]:
        alpha = self._through(self.matrix).transpose(0, 2, 1).reshape(2, -1)
        # Backwards the matrices are transposed and the vector stands before its token's matrix.
        turned = self.matrix.transpose(1, 0, 2, 3)[:, :, ::-1, ::-1]
        passed = self._through(turned)[:, ::-1, ::-1].transpose(0, 2, 1).reshape(2, -1)
        beta = np.c_[passed[:, 1:], [[0.5], [0.5]]]
        return alpha, beta

    def marginals(self) -> np.ndarray:
        """Each token's probability of the toxic tag."""
        alpha, beta = self.alpha_beta()
        both = alpha * beta
        return (both[1] / both.sum(0))[:self.n]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Marginals, and probabilities of (tag before, tag) summed over tokens that aren't first.

        The first tokens add to the second result alike in both rows; callers leave them out.
        """
        alpha, beta = self.alpha_beta()
        both = alpha * beta
        m = self.matrix.transpose(0, 1, 3, 2).reshape(2, 2, -1)
        before = np.c_[[[0.5], [0.5]], alpha[:, :-1]]
        joint = before[:, None] * m * beta[None]
        return (both[1] / both.sum(0))[:self.n], (joint / joint.sum((0, 1)))[:, :, :self.n]


class Field:
    """Weights of hashed features and of neighbouring tags."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, start: np.ndarray,
                 calibration: np.ndarray | None = None, constant: float | None = None):
        self.weights, self.moves, self.start = weights, moves, start
        self.calibration, self.constant = calibration, constant

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        z = self.calibration[0] + stats @ self.calibration[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _arranged(sequences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, WIDTH) feature numbers, 0 where there is no neighbour, and which tokens are first."""
    known: dict[str, list[list[int]]] = {}
    x, first = [], []
    for words in sequences:
        found = []
        for w in words:
            if w not in known:
                known[w] = features(w)
            found.append(known[w])
        for i, (own, _, _) in enumerate(found):
            x.append(own + (found[i - 1][1] if i else [0, 0])
                     + (found[i + 1][2] if i + 1 < len(found) else [0, 0]))
            first.append(i == 0)
    return np.array(x, np.int32).reshape(-1, WIDTH), np.array(first, bool)


def fit(sequences: list[list[str]], tags: list[list[int]], rounds: int = 80, rate: float = 0.1,
        penalty: float = 1e-6) -> Field:
    """Maximum likelihood with an L2 penalty, by Adam over all tokens."""
    x, first = _arranged(sequences)
    y = np.array([t for part in tags for t in part], float)
    n = max(1, len(y))
    theta = np.zeros(BUCKETS + 6)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.flatnonzero(~first)
    held_moves = np.zeros((2, 2))
    np.add.at(held_moves, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    held_start = np.bincount(y[first].astype(int), minlength=2)
    flat = x.ravel()
    for t in range(1, rounds + 1):
        weights = theta[:BUCKETS]
        chain = Chain(weights[x].sum(1), first, theta[BUCKETS:BUCKETS + 4].reshape(2, 2),
                      theta[BUCKETS + 4:])
        p, joint = chain.pairs()
        gradient = np.empty_like(theta)
        gradient[:BUCKETS] = np.bincount(flat, np.repeat(p - y, WIDTH), BUCKETS)
        gradient[0] = 0                                              # no neighbour, no weight
        gradient[BUCKETS:BUCKETS + 4] = (joint[:, :, inner].sum(2) - held_moves).ravel()
        gradient[BUCKETS + 4:] = np.array([(1 - p[first]).sum(), p[first].sum()]) - held_start
        gradient = gradient / n + penalty * theta
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient ** 2
        theta = theta - rate * (mean / (1 - 0.9 ** t)) / (
            np.sqrt(square / (1 - 0.99 ** t)) + 1e-8)
        theta[0] = 0
    return Field(theta[:BUCKETS], theta[BUCKETS:BUCKETS + 4].reshape(2, 2), theta[BUCKETS + 4:])


class _Emissions(dict):
    """Row of a word in ``table``, which has its weight for itself, the next and the token before."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field
        self.table = np.zeros((1 << 12, 3))
        self.used = 0

    def __missing__(self, word: str) -> int:
        if self.used == len(self.table):
            self.table = np.r_[self.table, np.zeros_like(self.table)]
        row = self.used
        self.table[row] = [self.field.weights[part].sum() for part in features(word)]
        self.used += 1
        if len(word) <= _LONG:
            self[word] = row
        return row

    def trim(self) -> None:
        if self.used > _CACHE:
            self.clear()
            self.used = 0


def tagged(field: Field, texts: list[str | None], cache: _Emissions | None = None
           ) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of all tokens, number of tokens of each text), over whole texts."""
    cache = _Emissions(field) if cache is None else cache
    cache.trim()
    words = [WORD.findall(t or "") for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    ids = np.array([cache[w] for part in words for w in part], np.int64)
    if not len(ids):
        return np.zeros(0), sizes
    first = np.zeros(len(ids), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    own, after, before = cache.table[ids].T
    emission = own.copy()
    emission[1:] += np.where(first[1:], 0, after[:-1])
    emission[:-1] += np.where(first[1:], 0, before[1:])
    return Chain(emission, first, field.moves, field.start).marginals(), sizes


def statistics(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text: log odds-like evidence of any toxic token, their number, the surest, their share."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(owner, p, len(sizes))
    none = np.bincount(owner, -np.log1p(-np.minimum(p, 1 - 1e-6)), len(sizes))
    most = np.zeros(len(sizes))
    np.maximum.at(most, owner, p)
    return np.column_stack([np.minimum(none, 12), np.log1p(total), most,
                            np.sqrt(total / np.maximum(sizes, 1))])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3
             ) -> np.ndarray:
    """(intercept, weights) by Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(z.shape[1])
    ridge = np.diag([1e-6] + [penalty] * x.shape[1]) * weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge,
                               z.T @ (weight * (p - y)) + ridge @ b)
        b = b - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return b


# Training from document labels

def drawn(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, float] | None:
    """(distinct texts with toxic 0 or 1, share of toxic labels) for up to ``sample`` documents.

    As many of either label, chosen by a hash of doc_id; rows with nulls and ids with two
    different labels teach nothing, copies of a text count once with the label most of them have.
    """
    one = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
           .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
           .filter("toxic = other").select(F.col("doc_id").alias("id"), "toxic"))
    sizes = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    if not sizes:
        return None
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("toxic") == label, min(1.0, sample / len(sizes) / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 30))
    # The draw leaves about ``sample`` rows; the limit makes the bound of the broadcast certain.
    chosen = one.filter(draw < share * (1 << 30)).orderBy(draw, "id").limit(2 * sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("id")).filter("text <> ''")
    held = (texts.groupBy("text").agg(F.avg("toxic").alias("toxic"))
            .select("text", (F.col("toxic") >= 0.5).cast("int").alias("toxic")))
    return stored(held, "labelled"), sizes.get(1, 0) / sum(sizes.values())


def offences(held: DataFrame, least: float = 12.0, ratio: float = 4.0, most: int = 5000) -> set[str]:
    """Words with significantly more different neighbours in toxic texts than in clean ones.

    ``least`` bounds the likelihood ratio statistic, ``ratio`` the relative rate; of more than
    ``most`` such words the surest are taken.
    """
    schema = pa.schema([("word", pa.string()), ("around", pa.int64()), ("toxic", pa.int64())])

    def run(batches):
        for texts, toxic in portions(batches):
            for text, label in zip(texts, toxic):
                words = ["", *(w.lower() for w in WORD.findall(text)), ""]
                seen = {(b, zlib.crc32(f"{a} {c}".encode("utf-8", "surrogatepass")))
                        for a, b, c in zip(words, words[1:], words[2:])}
                if seen:
                    found, around = zip(*sorted(seen))
                    yield record(schema, [found, around, [label] * len(found)])

    placed = (held.select("text", "toxic")
              .mapInArrow(run, "word string, around bigint, toxic bigint")
              .groupBy("word", "around").agg(F.max("toxic").alias("bad"), F.min("toxic").alias("good"))
              .groupBy("word").agg(F.sum("bad").alias("a"), F.sum(1 - F.col("good")).alias("b")))
    whole = placed.agg(F.sum("a"), F.sum("b")).first()
    if not whole[0] or not whole[1]:
        return set()
    sides = [(F.col("a"), whole[0]), (F.col("b"), whole[1])]
    all_ = (F.col("a") + F.col("b")) / F.lit(whole[0] + whole[1])

    def gain(x, n):
        return F.when(x > 0, x * F.log(x / (all_ * n))).otherwise(0.0)

    ranked = placed.withColumn("sure", 2 * sum((gain(x, n) for x, n in sides), F.lit(0.0))).filter(
        (F.col("a") >= 3) & (F.col("sure") >= least)
        & (F.col("a") / F.lit(float(whole[0])) >= ratio * F.col("b") / F.lit(float(whole[1]))))
    return {r["word"] for r in
            ranked.orderBy(F.desc("sure"), "word").limit(most).select("word").collect()}


def windows(held: DataFrame, words: set[str]) -> tuple[list[list[str]], list[list[int]]]:
    """Labelled token windows: of a text at most WINDOWS with such a word and two without.

    They are drawn by a hash from all windows of the whole text. Toxic texts without any such
    word say nothing about their tokens and are left out.
    """
    schema = pa.schema([("words", pa.list_(pa.string())), ("tags", pa.list_(pa.int64()))])

    def run(batches):
        for texts, toxic in portions(batches):
            out: list[list] = [[], []]
            for text, label in zip(texts, toxic):
                tokens = WORD.findall(text)
                hit = [t.lower() in words for t in tokens]
                if label and not any(hit):
                    continue
                order = sorted(range(0, len(tokens), WINDOW), key=lambda i: (zlib.crc32(
                    " ".join(tokens[i:i + WINDOW]).encode("utf-8", "surrogatepass")), i))
                with_word = [i for i in order if any(hit[i:i + WINDOW])]
                without = [i for i in order if not any(hit[i:i + WINDOW])]
                for i in with_word[:WINDOWS] + without[:2]:
                    out[0].append([t[:_LONG] for t in tokens[i:i + WINDOW]])
                    out[1].append([int(bool(label) and h) for h in hit[i:i + WINDOW]])
            yield record(schema, out)

    found = sorted((r["words"], r["tags"]) for r in held.select("text", "toxic").mapInArrow(
        run, "words array<string>, tags array<bigint>").toLocalIterator())
    return [w for w, _ in found], [t for _, t in found]


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Field:
    """Fit on about ``sample`` labelled documents (doc_id, toxic 0 or 1), twice that at most.

    The driver gets their windows, at most eight of 32 words a document, and four numbers each.
    """
    blank = (np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros(2))
    got = drawn(docs, labels, sample)
    if got is None:
        return Field(*blank, constant=0.0)
    held, rate = got
    words = offences(held)
    sequences, tags = windows(held, words)
    if not 0 < rate < 1 or not sequences:
        return Field(*blank, constant=rate)
    field = fit(sequences, tags)
    schema = pa.schema([(f"s{i}", pa.float64()) for i in range(4)] + [("toxic", pa.int64())])

    def run(batches):
        for texts, toxic in portions(batches):
            yield record(schema, [*statistics(*tagged(field, texts)).T, toxic])

    rows = np.array(sorted(tuple(r) for r in held.select("text", "toxic").mapInArrow(
        run, ", ".join(f"s{i} double" for i in range(4)) + ", toxic bigint").collect()))
    y = rows[:, 4]
    if not 0 < y.mean() < 1:
        return Field(*blank, constant=rate)
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    field.calibration = np.round(logistic(rows[:, :4], y, weight), 9)
    return field


_FOUND = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_toxic", pa.int64()),
                    ("spans", pa.string())])


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score (0 to 1), n_toxic, spans (start:end,... in code points) of every whole text.

    A token is offending where its marginal is at least one half.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        cache = _Emissions(field)
        for ids, texts in portions(batches):
            p, sizes = tagged(field, texts, cache)
            scores = field.score(statistics(p, sizes))
            ends = np.cumsum(sizes)
            counts, spans = [], []
            for text, end, size in zip(texts, ends.tolist(), sizes.tolist()):
                bad = np.flatnonzero(p[end - size:end] >= 0.5)
                counts.append(len(bad))
                if len(bad):
                    held = [m.span() for m in WORD.finditer(text)]
                    spans.append(",".join("%d:%d" % held[i] for i in bad.tolist()))
                else:
                    spans.append("")
            yield record(_FOUND, [ids, scores, counts, spans])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, score double, n_toxic bigint, spans string")


def brute_force(emission: list[float], moves, start) -> list[float]:
    """Marginals of one short sequence by summing over all its taggings."""
    n = len(emission)
    total, toxic = 0.0, [0.0] * n
    for code in range(1 << n):
        tag = [code >> i & 1 for i in range(n)]
        energy = start[tag[0]] + sum(e for e, t in zip(emission, tag) if t) + sum(
            moves[a][b] for a, b in zip(tag, tag[1:]))
        total += math.exp(energy)
        for i, t in enumerate(tag):
            toxic[i] += t * math.exp(energy)
    return [x / total for x in toxic]
