"""Language identification by unigram piece models, marginalised over segmentations.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a
word is the sum over all its segmentations into pieces, computed by the forward algorithm in
linear space with scaling; pieces never cross white space, so a text's log-probability is the sum
over its words. Probabilities come from expectation maximisation over the word counts of a small
labelled sample. Tasks score each distinct word of a batch once and keep a bounded cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import record, rows

MARK = "▁"
#: Longest piece that is looked up; longer ones of the vocabulary are left out.
LONGEST = 12
_CACHE = 120_000
_TABLE = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return sorted({p for i in range(model.get_piece_size())
                   if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
                   and 0 < len(p := model.id_to_piece(i)) <= LONGEST})


def _code_points(words: list[str], width: int) -> np.ndarray:
    joined = "".join(w.ljust(width, "\0") for w in words)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").reshape(
        len(words), width).astype(np.uint64)


class Pieces:
    """Finds the vocabulary number of every substring of many words at once."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        keys = np.zeros(self.n, np.uint64)
        for length in {len(p) for p in pieces}:
            at = [i for i, p in enumerate(pieces) if len(p) == length]
            points, value = _code_points([pieces[i] for i in at], length), np.zeros(len(at), np.uint64)
            for j in range(length):
                value = self.step(value, points[:, j])
            keys[at] = value
        order = np.argsort(keys)
        self.keys, self.number = keys[order], order
        slots = (self.keys >> np.uint64(44)).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange(_TABLE + 1))
        self.most = int(np.diff(self.first).max()) if self.n else 0

    @staticmethod
    def step(value: np.ndarray, point: np.ndarray) -> np.ndarray:
        value = (value ^ (point + np.uint64(1))) * _MULT
        return value ^ (value >> np.uint64(32))

    def find(self, value: np.ndarray) -> np.ndarray:
        """Piece numbers, ``n`` for none."""
        slot = (value >> np.uint64(44)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(value), self.n, np.int64)
        for _ in range(self.most):
            live = np.flatnonzero(at < end)
            if not len(live):
                break
            hit = live[self.keys[at[live]] == value[live]]
            out[hit] = self.number[at[hit]]
            at = at + 1
        return out


class Model:
    """Languages, pieces and their probabilities (a last row of zeros stands for no piece)."""

    def __init__(self, languages: list[str], pieces: list[str], probability: np.ndarray,
                 unknown: float = 1e-7):
        self.languages, self.pieces = languages, pieces
        self.lookup = Pieces(pieces)
        self.probability = np.vstack([probability, np.zeros((1, len(languages)))])
        self.unknown = unknown
        self.cache: dict[str, int] = {}
        self.values = np.zeros((1024, len(languages)))

    def __getstate__(self):
        return self.languages, self.pieces, self.probability[:-1], self.unknown

    def __setstate__(self, state):
        self.__init__(*state)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word under each language, over all segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        bound = 8
        while True:
            at = np.flatnonzero((lengths <= bound) & (lengths > (bound // 2 if bound > 8 else 0)))
            for s in range(0, len(at), chunk := max(1, 100_000 // bound)):
                part = at[s:s + chunk]
                out[part] = self._forward([MARK + words[i] for i in part], lengths[part])
            if not (lengths > bound).any():
                return out
            bound *= 2

    def _forward(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        width, many = int(lengths.max()), len(self.languages)
        points = _code_points(words, width)
        # back[d] is the scaled forward sum d positions before the current one.
        back = [np.ones((len(words), many))]
        scale, out = np.zeros((len(words), many)), np.zeros((len(words), many))
        hashes: list[np.ndarray] = []  # of substrings that end here, by their start
        for i in range(width):
            point = points[:, i]
            hashes = [Pieces.step(h, point) for h in hashes[-(LONGEST - 1):]]
            hashes.append(Pieces.step(np.zeros(len(words), np.uint64), point))
            now = back[0] * self.unknown
            for d, value in enumerate(reversed(hashes)):  # substring of d + 1 characters
                number = self.lookup.find(value)
                known = np.flatnonzero(number < self.lookup.n)
                now[known] += back[d][known] * self.probability[number[known]]
            ended = lengths == i + 1
            if ended.any():
                out[ended] = np.log(now[ended]) + scale[ended]
            size = now.max(axis=1, keepdims=True)
            size = np.maximum(now, size * 1e-250)  # per language; keeps the shares of each finite
            back = [b / size for b in [now, *back[:LONGEST - 1]]]
            scale += np.log(size)
        return out

    def text_scores(self, texts: list[str | None]) -> np.ndarray:
        """Sum of word scores of each text."""
        split = [(t or "").split() for t in texts]
        missing = list({w for words in split for w in words if w not in self.cache})
        if len(self.cache) + len(missing) > _CACHE:
            self.cache = {}
            missing = list({w for words in split for w in words})
        if missing:
            start = len(self.cache)
            need = start + len(missing)
            if need > len(self.values):
                self.values = np.vstack([self.values[:start], np.zeros(
                    (max(need, 2 * len(self.values)) - start, len(self.languages)))])
            self.values[start:need] = self.word_scores(missing)
            self.cache.update(zip(missing, range(start, need)))
        out = np.zeros((len(texts), len(self.languages)))
        for i, words in enumerate(split):
            if words:
                at = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
                out[i] = self.values[at].sum(axis=0)
        return out


def expect(counts: dict[str, list[tuple[str, int]]], pieces: list[str],
           rounds: int = 4) -> np.ndarray:
    """Piece probabilities by language: expectation maximisation over weighted words."""
    lookup = {p: i for i, p in enumerate(pieces)}
    out = np.zeros((len(pieces), len(counts)))
    for column, words in enumerate(counts.values()):
        spans, weights = [], []
        for word, times in words:
            w = MARK + word
            spans.append([(i, j, lookup[w[i:j]]) for j in range(1, len(w) + 1)
                          for i in range(max(0, j - LONGEST), j) if w[i:j] in lookup])
            weights.append(times)
        p = np.full(len(pieces), 1 / len(pieces))
        for _ in range(rounds):
            found = np.full(len(pieces), 0.01)
            for (word, _), pieces_at, times in zip(words, spans, weights):
                n = len(word) + 1
                a, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
                pr = [p[k] for _, _, k in pieces_at]
                for (i, j, _), q in zip(pieces_at, pr):
                    a[j] += a[i] * q
                if not a[n] > 1e-300:
                    continue
                for (i, j, _), q in zip(reversed(pieces_at), reversed(pr)):
                    b[i] += b[j] * q
                for (i, j, k), q in zip(pieces_at, pr):
                    found[k] += times * a[i] * q * b[j] / a[n]
            p = found / found.sum()
        out[:, column] = p
    return out


def train(labelled: DataFrame, vocabulary_path: str, sample: int = 250,
          words: int = 6000) -> Model:
    """Fit piece probabilities on about ``sample`` documents of each language.

    ``labelled`` has doc_id, text and lang. Documents are chosen by a hash of doc_id, whatever
    their partitions; of each language's sample the ``words`` most frequent words of at most 40
    characters count. Rows without text or lang teach nothing.
    """
    usable = labelled.filter("lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], [], np.zeros((0, 0)))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    chosen = usable.filter(draw < share * (1 << 30)).filter("text IS NOT NULL")
    counted = (chosen.select("lang", F.explode(F.split("text", r"\s+")).alias("word"))
               .filter("length(word) BETWEEN 1 AND 40").groupBy("lang", "word").count())
    first = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    top = counted.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= words)
    by: dict[str, list[tuple[str, int]]] = {lang: [] for lang in sorted(sizes)}
    for r in top.orderBy("lang", "r").collect():
        by[r["lang"]].append((r["word"], r["count"]))
    pieces = vocabulary(vocabulary_path)
    return Model(list(by), pieces, expect(by, pieces))


_PREDICTION = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()),
                         ("score", pa.float64())])


def predictions(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    preds, scores = [], []
    values = model.text_scores(texts) if model.languages else None
    for i, text in enumerate(texts):
        if values is None or not text or not any(map(str.isalpha, text)):
            preds.append("und")
            scores.append(0.0)
            continue
        best = int(values[i].argmax())
        preds.append(model.languages[best])
        scores.append(float(1 / np.exp(np.minimum(values[i] - values[i][best], 0)).sum()))
    return preds, scores


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (posterior with equal priors) of every whole text.

    ``und`` with score 0 for a null text, a text without letters, or a model without languages.
    One row per input row; ties go to the language first by name; null ids are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces times languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(batches, 400):
            yield record(_PREDICTION, [ids, *predictions(texts, shared.value)])

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id bigint, lang_pred string, score double"))


def fits(texts: list[str | None], model: Model) -> np.ndarray:
    """Log-probability a character of each text under its best language; -inf without letters."""
    out = np.full(len(texts), -np.inf)
    if model.languages:
        best = model.text_scores(texts).max(axis=1)
        for i, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):
                out[i] = best[i] / sum(len(w) + 1 for w in text.split())
    return out


def fitted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the ``fit`` of every row (see ``fits``), each row judged by itself."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 400):
                part = batch.slice(first, 400)
                fit = pa.array(fits(part.column(at).to_pylist(), shared.value), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, fit],
                                                 names=[*part.schema.names, "fit"])

    schema = T.StructType([*docs.schema.fields, T.StructField("fit", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def floor(labelled: DataFrame, margin: float = 4.0) -> float:
    """The least fit of a text in a known language, from every row with a lang and a ``fit``.

    The floor lies as far below the worst of them as that lies below their median, ``margin`` at
    least; the median is taken of fits in thousandths, so what is collected for it is bounded.
    Without such texts nothing is below it.
    """
    steps = (labelled.filter("lang IS NOT NULL AND fit > double('-infinity')")
             .groupBy(F.floor(F.col("fit") * 1000).alias("step"))
             .agg(F.min("fit").alias("low"), F.count(F.lit(1)).alias("n")))
    low, middle = steps.agg(F.min("low"), F.expr("percentile(step, 0.5, n) / 1000")).first()
    return -np.inf if low is None else low - max(middle - low, margin)


def keep_known(scored: DataFrame, least: float = -np.inf) -> DataFrame:
    """The rows of ``fitted`` that have a letter and fit a language, without their ``fit``.

    A text stays whose log-probability a character, under the best language, is ``least`` or more
    (see ``floor``). A model without languages judges nothing and rejects every row. Repeated rows
    and null ids are judged each by itself; nothing is joined or shuffled.
    """
    return scored.filter((F.col("fit") > -np.inf) & (F.col("fit") >= least)).drop("fit")
