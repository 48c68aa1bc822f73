"""Tokenizer links, the conversation trie and toxic spans against brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import crossalign, prefixtrie, queries, toxicity

from .conftest import TEXTS, prose

SF = "/root/testdata/sf0.001"
A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")


# Links between tokenizers

def dense(m):
    full = np.zeros((m.rows, m.columns), np.int64)
    for i in range(m.rows):
        for k in range(m.indptr[i], m.indptr[i + 1]):
            full[i, m.indices[k]] += m.data[k]
    return full


@pytest.mark.parametrize("expanded", [1, 7, 1000])
def test_row_products_equal_dense_products(monkeypatch, expanded):
    monkeypatch.setattr(crossalign, "_EXPANDED", expanded)
    rng = np.random.default_rng(expanded)
    for n, k, m in ((1, 1, 1), (5, 4, 6), (9, 3, 2), (0, 3, 2), (4, 5, 4)):
        made = []
        for r, c in ((n, k), (k, m)):
            full = rng.integers(0, 3, (r, c)) * rng.integers(0, 2, (r, c))
            row, col = np.nonzero(full)
            made.append((full, crossalign.Csr(
                np.r_[0, np.cumsum(np.bincount(row, minlength=r))].astype(int), col,
                full[row, col], c)))
        (x, sparse_x), (y, sparse_y) = made
        assert (dense(sparse_x.transpose()) == x.T).all()
        i, j, v = sparse_x.product(sparse_y)
        got = np.zeros((n, m), np.int64)
        got[i, j] = v
        assert (got == x @ y).all() and (v > 0).all()
        assert (np.diff(i * max(m, 1) + j) > 0).all()


def odd_texts():
    rng = random.Random(5)
    kinds = [lambda: rng.randrange(32, 127), lambda: rng.randrange(160, 0x2000),
             lambda: rng.randrange(0x4E00, 0x9FFF), lambda: rng.choice([9, 10, 32, 32, 0x2581]),
             lambda: rng.randrange(0x1F300, 0x1F700)]
    return ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(60))) for _ in range(60)]


def test_links_equal_brute_force(spark):
    texts = [(i, t) for i, t in TEXTS if i != 9] + [(7, "<|endoftext|> <s>x</s> <unk>")]
    texts += [(100 + i, t) for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in texts],
                                 "doc_id bigint, text string, n bigint, pair string").repartition(5)
    want = sorted(((*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "")
                   for r in crossalign.brute_force(texts, A, B)), key=str)
    found = crossalign.aligned(docs, A, B)
    counts = crossalign.pair_counts(found, held=100)
    for head in (1 << 20, 40, 0):          # all pairs sent to the tasks, some of them, none
        got = crossalign.scores(found, counts, head).select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_kinds_of_links(spark):
    docs = spark.createDataFrame([(1, "Understanding ünï tokens"), (2, None)],
                                 "doc_id bigint, text string")
    both = crossalign.pair(A, B)
    (a, b), _ = both.encode(["Understanding ünï tokens", None])
    ends = [np.cumsum(lengths[ids]) for lengths, ids in ((both.a_lengths, a), (both.b_lengths, b))]
    starts = [np.r_[0, e[:-1]] for e in ends]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    group = [np.searchsorted(cuts, e) for e in ends]
    want = {"overlap": {}, "end": {}, "group": {}}
    for i in range(len(a)):
        for j in range(len(b)):
            shared = min(ends[0][i], ends[1][j]) - max(starts[0][i], starts[1][j])
            for kind, value in (("overlap", max(0, shared)), ("end", int(ends[0][i] == ends[1][j])),
                                ("group", int(group[0][i] == group[1][j]))):
                if value:
                    want[kind][i, j] = (a[i], b[j], value)
    for kind in want:
        got = {(r.a_index, r.b_index): (r.a_id, r.b_id, r.value)
               for r in crossalign.links(docs, A, B, kind).collect()}
        assert got == want[kind]
    with pytest.raises(ValueError):
        crossalign.links(docs, A, B, "other")


def test_links_of_an_empty_table(empty):
    assert crossalign.align(empty, A, B).count() == 0


# The trie of conversations

def forests():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 8, 60, 300):
        for near in (1, 4, n):
            yield [-1 if not i or rng.random() < .03 else rng.randrange(max(0, i - near), i)
                   for i in range(n)]
    yield [-1] + [0] * 500


def test_centroids_add_up_every_subtree():
    for parent in forests():
        values = [(i % 7, 1) for i in range(len(parent))]
        want = [list(v) for v in values]
        for i in range(len(parent) - 1, -1, -1):
            if parent[i] >= 0:
                want[parent[i]] = [a + b for a, b in zip(want[parent[i]], want[i])]
        assert prefixtrie.decompose(parent, values) == want


def test_a_long_path_is_decomposed_quickly():
    n = 100_000
    got = prefixtrie.decompose(list(range(-1, n - 1)), [(1,)] * n)
    assert got[0] == [n] and got[-1] == [1]


def conversations():
    rng = random.Random(4)
    rows = [(None, 1, "user", "x")]
    for c in [*range(0, 30), *range(100, 120), 250, 777, -5, -150, -100]:
        for t in range(rng.choice([1, 2, 3, 4, 7, 9])):
            rows.append((c, t or None, rng.choice(["user", None]), rng.choice(["a", "ü", None, "cc"])))
    rows += [(600, t, "user", str(t % 3)) for t in range(40)]
    rows += [(600 + i, t, "user", str(t % 3)) for i in (1, 2) for t in range(38 + i)]
    return rows


def trie_of(spark, rows, held=1 << 18):
    turns = spark.createDataFrame([(*r, 1, "n", 5) for r in rows], (
        "conv_id bigint, turn bigint, role string, text string, depth int, tree string, n int"))
    return sorted(map(tuple, prefixtrie.trie(turns.repartition(3), held).collect()), key=str)


def test_trie_equals_brute_force(spark):
    assert trie_of(spark, conversations()) == sorted(
        prefixtrie.brute_force(conversations()), key=str)


def test_trie_with_small_pieces_everywhere(spark, monkeypatch):
    """Turns, ids and trees all cut: ranges of turns, ranges of ids, centroids by joins."""
    monkeypatch.setattr(prefixtrie, "_TURNS", 4)
    monkeypatch.setattr(prefixtrie, "_IDS", 3)
    assert trie_of(spark, conversations(), held=12) == sorted(
        prefixtrie.brute_force(conversations()), key=str)


def test_trie_of_few_rows(spark):
    assert trie_of(spark, []) == []
    for rows in ([(100, 0, "u", "x")], [(101, 0, None, None)]):
        assert trie_of(spark, rows) == sorted(prefixtrie.brute_force(rows), key=str)


def test_equal_turns_are_turns_of_their_own(spark):
    rows = [(0, 1, "u", "x")] * 3 + [(1, 1, "u", "x")] * 2
    got = trie_of(spark, rows)
    assert got == sorted(prefixtrie.brute_force(rows), key=str)


# Toxicity

def test_marginals_equal_brute_force():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7):
        emission, moves, start = rng.normal(size=n) * 3, rng.normal(size=(2, 2)), rng.normal(size=2)
        around = [rng.normal(size=k) for k in (0, 1, 70, 200)]
        whole = np.concatenate([*around, emission, *around])
        first = np.zeros(len(whole), bool)
        first[np.cumsum([0, *map(len, around)])] = True
        at = sum(map(len, around))
        first[at + n] = True
        chain = toxicity.Chain(whole, first, moves, start)
        want = toxicity.brute_force(emission.tolist(), moves, start)
        assert np.allclose(chain.marginals()[at:at + n], want)
        p, joint = chain.pairs()
        assert np.allclose(joint.sum(0)[1], p)


def test_field_learns_context():
    """'lost' is toxic after 'you' only, so neighbours and tags must decide."""
    bad, good = ["you", "lost", "fool"], ["we", "lost", "keys"]
    field = toxicity.fit([bad, good] * 20, [[0, 1, 1], [0, 0, 0]] * 20)
    p, sizes = toxicity.tagged(field, ["you lost fool", "", None, "we lost keys"])
    assert sizes.tolist() == [3, 0, 0, 3]
    assert (p >= 0.5).tolist() == [False, True, True, False, False, False]


def labelled(spark):
    rng = random.Random(8)
    rows = []
    for i in range(160):
        words = prose(3000 + i, 30).split()
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["Zorgon", "blarg", "vexnit"]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows],
                                 "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows],
                                   "doc_id bigint, toxic int, text string")
    return rows, docs, labels


def test_spans_and_scores(spark, docs, empty):
    rows, known, labels = labelled(spark)
    field = toxicity.train(known, labels.filter("doc_id < 120"))
    found = {r.doc_id: r for r in toxicity.find(known, field).collect()}
    for i, text, y in rows[120:]:
        got = found[i]
        words = {text[a:b] for a, b in (map(int, s.split(":")) for s in got.spans.split(",") if s)}
        assert (got.score >= 0.7) == bool(y)
        assert words == {w for w in text.split() if w in ("Zorgon", "blarg", "vexnit")}
    odd = toxicity.find(docs, field).collect()
    assert sorted(str(r.doc_id) for r in odd) == sorted(str(i) for i, _ in TEXTS)
    assert all(0 <= r.score <= 1 for r in odd)
    assert toxicity.find(empty, field).count() == 0


def test_labels_of_one_kind_or_none(spark, docs):
    _, known, labels = labelled(spark)
    for some, constant in ((labels.filter("toxic = 0"), 0.0), (labels.filter("toxic = 1"), 1.0),
                           (labels.limit(0), 0.0), (labels.withColumn("toxic", F.lit(None)), 0.0)):
        field = toxicity.train(known, some)
        assert {r.score for r in toxicity.find(docs, field).collect()} == {constant}


def test_copies_teach_no_words(spark):
    """One toxic text many times over makes none of its words an offence."""
    text = prose(77, 40)
    held = spark.createDataFrame(
        [(text + f" {i}", 1) for i in range(50)] + [(prose(400 + i, 40), 0) for i in range(50)],
        "text string, toxic int")
    assert not toxicity.offences(held) & set(text.split()[1:-2])


def test_toxicity_on_unseen_documents(spark):
    folder = SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.op11_toxicity(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    unseen = [r for r in got if r.held_out and r.doc_id in truth]
    caught = [r.predicted for r in unseen if truth[r.doc_id]]
    wrong = [r.predicted for r in unseen if not truth[r.doc_id]]
    assert np.mean(caught) > 0.7 and np.mean(wrong) < 0.02
