"""Secret scans: fixed patterns plus two character Markov models compared by likelihood ratio.

Long unbroken tokens are scored under a first-order model of random strings and one of ordinary
identifiers; where the logarithm of the ratio, per character, is high enough the token is a span of
kind ``markov``. The ordinary model learns words of the corpus and identifiers that are built from
words, dates and numbers as paths, slugs, versions, constants and camel case; the threshold is
fitted on samples held out from both models. Spans of the fixed patterns always stay, and a model's
span never overlaps them.

The models judge runs of at least 16 of ``A-Za-z0-9+/_=-`` that have a letter and are not a single
word of lower-case or capitalised letters; shorter runs, digits alone and plain words are never
``markov`` spans.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record, rows
from .orderhash import _let

#: Kinds of the base patterns, in the order used for ties.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.I | re.A)
_HINT = re.compile("passw|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.zeros(128, np.int64)
for _i, _c in enumerate(_ALPHABET):
    _CODE[ord(_c)] = _i


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind."""
    found = []
    if any(x in text for x in ":=") and _HINT.search(text):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text)
                  if len(m[2]) >= 6]
    # Keys and hexadecimal runs of interest lie inside long unbroken runs.
    for run in _RUN.finditer(text):
        token, at = run[0], run.start()
        if "AKIA" in token:
            found += [(at + m.start(), at + m.end(), "access") for m in _ACCESS.finditer(token)
                      if m.end() - m.start() >= 20]
        if len(token) >= 24:
            found += [(at + m.start(), at + m.end(), "hex") for m in _HEX.finditer(token)
                      if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class MarkovRatio:
    """Log-probability ratio of characters given the one before: random against ordinary."""

    def __init__(self, samples: list[tuple[str, int]], smooth: float = 0.5,
                 weight: float = 5.0):
        size = len(_ALPHABET)
        counts = np.zeros((2, size + 1, size))
        for token, label in samples:
            codes = self._codes(token)
            np.add.at(counts[label], (np.r_[size, codes[:-1]], codes), 1)
        # Pairs fall back on single characters, and these on an even spread.
        single = counts.sum(axis=1, keepdims=True) + smooth
        counts += weight * single / single.sum(axis=2, keepdims=True)
        logs = np.log(counts / counts.sum(axis=2, keepdims=True))
        self.ratio = logs[1] - logs[0]

    @staticmethod
    def _codes(token: str) -> np.ndarray:
        return _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]

    def score(self, token: str) -> float:
        """Mean over the characters, so that long ordinary tokens don't add up to a secret."""
        codes = self._codes(token)
        return float(self.ratio[np.r_[len(_ALPHABET), codes[:-1]], codes].mean())


#: Ordinary identifiers, labelled 0 beside the words of the corpus.
IDENTIFIERS = (
    "user_name", "getElementById", "max_connections", "content-type", "application/json",
    "index.html", "README", "HttpServletRequest", "self.assertEqual", "utf-8", "version_2",
    "BUFFER_SIZE", "toString", "page_count", "last_modified_date", "x86_64-linux-gnu",
    "static/images/logo", "DatabaseConnectionFactory", "lower_case_with_underscores",
    "section-heading-title", "TestCaseForReader", "org/example/project/Main", "sha256sum",
    "background-color", "transaction_isolation_level", "numpy/core/multiarray",
)


#: Words that identifiers are built from, beside those of the corpus.
WORDS = """
    able access account action admin alert android api archive area array article auth average
    backup base black block board boot branch browser buffer build cache call card category
    change channel check city client clock cloud code column command comment common config connect
    console content count create current custom date day debug default desktop detail digital directory
    domain download draft driver element email empty engine event example export factory field file
    filter final flag float folder font format frame full function general global graph group
    handle header health history host hour html http image import index info install interface
    invalid invoice job join json key language large layout length library light limit line
    list load local lock login machine main manager market match media memory message method
    mobile mode module month mouse music network next node note number office online open
    order origin output owner page panel park path photo plan player point pool port
    post price process profile program proxy query queue random record release remote report request
    result review road root sample scale school score script search server service share short
    single size south sport stack start stock store
""".split()


def identifiers(words: list[str], n: int, seed: int) -> list[str]:
    """``n`` ordinary identifiers of many shapes, built from words, dates and numbers."""
    rng, made = random.Random(seed), []
    for i in range(n if words else 0):
        a, b, c, d = (rng.choice(words) for _ in range(4))
        year, month, day = rng.randrange(1990, 2036), rng.randrange(1, 13), rng.randrange(1, 29)
        number, few = rng.randrange(10 ** rng.randrange(1, 9)), rng.randrange(100)
        made.append((
            f"{a}/{b}/{c}/{d}", f"/{a}/{b}{few}/{c}-{d}", f"{a}_{b}_{c}".upper(),
            f"{a}_{b}_{c}_{few}".upper(), a.capitalize() + b.capitalize() + c.capitalize(),
            a + b.capitalize() + c.upper() + d.capitalize() + str(few % 10),
            f"{year}/{month:02d}/{day:02d}/{a}-{b}-{c}",
            f"{year}-{month:02d}-{day:02d}T{few % 24:02d}-{few % 60:02d}-{day:02d}",
            f"{a}-{year}-{month:02d}-{day:02d}-{b}", f"{a}-{number}-{few}-{b}",
            f"{a.upper()}/{few}/{number}/{b.upper()}/{year}", f"{a}-v{month}_{day}_{few}-{b}",
            f"{a}_{b}_{c}_{d}", f"{a}-{b}-{c}-{d}", f"{a}-{b}-{number}", f"{a}={b}={number}",
            f"{a}++/{b}+{c}/{few}", f"{a[:3]}/{b[:3]}/{c[:3]}/{d[:2]}".upper(),
        )[i % 18])
    return made


def random_samples(spark: SparkSession, n: int = 600) -> DataFrame:
    """Labelled random strings (text, 1): digests of a counter as hexadecimal, base 64 and others."""
    seed = spark.range(n).select(F.sha2(F.col("id").cast("string"), 512).alias("h"))
    packed = F.base64(F.unhex("h"))
    kinds = F.array(F.substring("h", 1, 40), F.substring(packed, 1, 40),
                    F.upper(F.regexp_replace(F.substring(packed, 20, 30), "[+/=]", "")),
                    F.regexp_replace(F.substring(packed, 40, 30), "[+/=]", ""))
    return seed.select(F.explode(kinds).alias("text"), F.lit(1).alias("label"))


def ordinary_samples(docs: DataFrame, n_docs: int = 300, n_words: int = 60_000) -> DataFrame:
    """Labelled ordinary identifiers (text, 0) from at most ``n_docs`` documents.

    The documents are those of the smallest hashes of distinct ids, one text of each, so the choice
    depends neither on partitions nor on how often an id occurs. Of each text at most
    ``n_words / n_docs`` words are taken, by a hash of word and place over the whole text. Words of
    letters stand for themselves; neighbours are also joined by ``_`` and in camel case.
    """
    ids = [r[0] for r in docs.filter("doc_id IS NOT NULL").select("doc_id").distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs).collect()]
    most = max(1, n_words // max(1, n_docs))
    texts = docs.filter(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min("text").alias("text"))

    def chosen(words):
        def following(i):
            return F.coalesce(F.get(words, i + 1), F.lit(""))

        places = F.slice(F.array_sort(F.transform(words, lambda w, i: F.struct(
            F.xxhash64(w, i).alias("draw"), i.alias("at")))), 1, most)
        return F.transform(F.transform(places, lambda p: p["at"]), lambda i: F.when(
            i % 7 == 0, F.concat(F.get(words, i), F.lit("_"), following(i)))
            .when(i % 7 == 1, F.concat(F.get(words, i), F.initcap(following(i))))
            .otherwise(F.get(words, i)))

    words = F.filter(F.split(F.col("text"), "[^A-Za-z]+"), lambda w: F.length(w) >= 3)
    return texts.select(F.explode(_let(words, chosen)).alias("text"), F.lit(0).alias("label"))


def _ascii(token: str) -> str:
    return re.sub(r"[^A-Za-z0-9+/_=-]", "_", token)


def fit(samples: list[tuple[str, int]], built: int = 9000) -> tuple[MarkovRatio, float]:
    """Both models from labelled tokens (1: random) and the threshold per character.

    ``built`` identifiers are made from the words given here and half as many from those with label
    0. Every fifth token is held out; the threshold stands in the middle between what one in a
    thousand held-out ordinary tokens and ninety-nine in a hundred random ones reach, and never
    below the former.
    """
    words = sorted({t for t, label in samples if not label and t.isalpha()})
    rows_ = sorted(samples) + [(_ascii(x), 0) for x in (
        *IDENTIFIERS, *identifiers(WORDS, built, 5), *identifiers(words, built // 2, 6))]
    model = MarkovRatio([r for i, r in enumerate(rows_) if i % 5])
    held = [(t, label) for i, (t, label) in enumerate(rows_) if not i % 5 and len(t) >= 16]
    ordinary, secret = ([model.score(t) for t, x in held if x == label] for label in (0, 1))
    low = float(np.quantile(ordinary, 0.999)) if ordinary else 0.0
    high = float(np.quantile(secret, 0.01)) if secret else low
    return model, max(low, (low + high) / 2)


def train(samples: DataFrame) -> tuple[MarkovRatio, float]:
    """``fit`` on a small labelled table (text, label 1 for random)."""
    return fit([(r["text"], int(r["label"])) for r in samples.filter(
        "text RLIKE '^[A-Za-z0-9+/_=-]+$'").select("text", "label").collect()])


def markov_spans(text: str, model: MarkovRatio, taken: list, threshold: float) -> list:
    """Long tokens with letters, not plain words, that the ratio calls random, outside ``taken``."""
    found = []
    for run in _RUN.finditer(text):
        token = run[0]
        if (token.isalpha() and (token.islower() or token.istitle())) or \
                not any(c.isalpha() for c in token) or any(
                s < run.end() and run.start() < e for s, e, _ in taken):
            continue
        if model.score(token) >= threshold:
            found.append((run.start(), run.end(), "markov"))
    return found


_SCAN = pa.schema([
    ("doc_id", pa.int64()), ("text", pa.string()),
    ("spans", pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()),
                                  ("last", pa.int64())])))])
_SCAN_DDL = "doc_id bigint, text string, spans array<struct<kind:string,first:bigint,last:bigint>>"


def _scan(model, redact):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, least = model.value
        for ids, texts in rows(batches):
            out: list[list] = [[], [], []]
            for i, text in zip(ids, texts):
                spans = base_spans(text or "")
                spans = sorted(spans + markov_spans(text or "", fitted, spans, least))
                for c, v in zip(out, (i, _blank(text, spans) if redact else None, [
                        {"kind": kind, "first": s, "last": e} for s, e, kind in sorted(
                            spans, key=lambda x: (x[0], (*KINDS, "markov").index(x[2])))])):
                    c.append(v)
            yield record(_SCAN, out)
    return run


def _blank(text, spans, mark="[SECRET]"):
    """``text`` with every span, overlapping ones together, replaced by ``mark``."""
    if not spans:
        return text
    parts, at = [], 0
    last = -1
    for s, e, _ in sorted(spans):
        if s >= last:
            parts += [text[at:s], mark]
        at = last = max(last, e)
    return "".join([*parts, text[at:]])


def _sent(spark: SparkSession, samples: DataFrame, threshold: float | None):
    """The model (67 x 66 numbers) and the threshold, for every task."""
    model, fitted = train(samples)
    return spark.sparkContext.broadcast((model, fitted if threshold is None else threshold))


def find_secrets(docs: DataFrame, samples: DataFrame | None = None,
                 threshold: float | None = None, redact: bool = False) -> DataFrame:
    """Secret spans of every whole text: doc_id, text (with ``redact``, else null), spans.

    Spans hold kind, first and last (code points, end exclusive), by start and then kind. One row
    per input row, repeated rows included; a null or empty text has no spans, null ids are kept.
    ``threshold`` is the least log-likelihood ratio in nats a character, by default the fitted one.
    ``samples`` (text, label) defaults to generated random strings against words of at most 300
    documents.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    if samples is None:
        samples = random_samples(spark).unionByName(ordinary_samples(docs))
    return docs.mapInArrow(_scan(_sent(spark, samples, threshold), redact), _SCAN_DDL)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_secrets``'s result."""
    def text_of(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(text_of(F.filter("spans", lambda s: s["kind"] != "markov")), 256)
        .alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


def brute_force(text: str | None) -> tuple:
    """Base counts and digest straight from the patterns; for tests."""
    text = text or ""
    spans = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text) if len(m[0]) >= 24]
    spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    joined = ",".join(f"{k}:{s}:{e}" for s, k, e in spans)
    return (*(sum(s[1] == k for s in spans) for k in KINDS),
            hashlib.sha256(joined.encode()).hexdigest())


def redact(docs: DataFrame, samples: DataFrame | None = None,
           threshold: float | None = None) -> DataFrame:
    """``docs`` with its columns in their order, secrets in ``text`` replaced by a mark.

    Where there is an ``n_chars`` column it follows the new text. The other columns ride along,
    so nothing is joined or shuffled.
    """
    spark = docs.sparkSession
    if samples is None:
        samples = random_samples(spark).unionByName(ordinary_samples(docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), "text")))
    model = _sent(spark, samples, threshold)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, least = model.value
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = []
                for text in part.column(at).to_pylist():
                    spans = base_spans(text or "")
                    spans += markov_spans(text or "", fitted, spans, least)
                    texts.append(_blank(text, spans))
                yield part.set_column(at, part.schema.field(at),
                                      pa.array(texts, part.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
