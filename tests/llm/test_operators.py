"""The text operators against brute force, on rows with nulls, ties, repeats and long texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import (decontaminate, htmltext, language, licenses, orderhash, packing, quality,
                          queries, secrets, simhash, trees, urlfilter)

from .conftest import BENCHMARK, TEXTS, prose

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# Decontamination

def test_contamination_equals_brute_force(docs, benchmark):
    got = {(r.doc_id, r.n_words): (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in
           decontaminate.digests(decontaminate.contamination(docs, benchmark)).collect()}
    items = [x for x in BENCHMARK if x[0] is not None]
    for i, text in TEXTS:
        want = decontaminate.brute_force([(i, text)], items)[i]
        assert got[(i, want[0])] == want, i
    assert len(got) == len({(i, t) for i, t in TEXTS})


@pytest.mark.parametrize("k", [1, 4, 13])
def test_contamination_for_any_gram_length(docs, benchmark, k):
    one = decontaminate.contamination(docs, benchmark, k=k).select("doc_id", "n_hit", "spans")
    two = decontaminate.contamination(docs, benchmark).select("doc_id", "n_hit", "spans")
    key = lambda r: str(r)
    assert sorted(map(key, one.collect())) == sorted(map(key, two.collect()))


def test_contamination_of_empty_tables(docs, benchmark, empty):
    assert decontaminate.contamination(empty, benchmark).count() == 0
    none = decontaminate.contamination(docs, benchmark.limit(0))
    assert none.filter("n_hit > 0").count() == 0


def test_windows_always_share_a_choice():
    words = [w.encode() for w in prose(7, 200).split()]
    for at in range(0, 180, 3):
        g, own = decontaminate.grams(words, 5), decontaminate.grams(words[at:at + 13], 5)
        picked = set(decontaminate.chosen(g, np.arange(len(g)), 9).tolist())
        mine = decontaminate.chosen(own, np.arange(len(own)), 9).tolist()
        assert {at + p for p in mine} & picked


# Secrets

def test_secrets_equal_patterns(docs):
    found = secrets.digests(secrets.find_secrets(docs)).collect()
    assert len(found) == len(TEXTS)
    want = collections.Counter((i, *secrets.brute_force(t)) for i, t in TEXTS)
    assert collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)
                               for r in found) == want


def test_markov_finds_random_tokens_only(spark, docs, empty):
    key, text = "q7Zk2Vt9Lx4Rb8Wn3Hs6Jd1Fg5Yp0Mc", "plain words and enlichachschlichenbe "
    more = spark.createDataFrame([(1, text + key), (2, text * 3), (3, "4785380592391139")],
                                 "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in secrets.digests(secrets.find_secrets(more)).collect()}
    assert got == {1: f"markov:{len(text)}:{len(text) + len(key)}", 2: "", 3: ""}
    assert secrets.find_secrets(empty).count() == 0


#: Ordinary tokens that no training sample holds.
ORDINARY = """
    2023/11/14/some-long-article 2024-01-02T03-04-05 HTTP/1/200/OK/2019-12
    org/apache/spark/sql/catalyst /usr/local/lib/python3/site-packages INTERNAL_SERVER_ERROR_500
    ENABLE_EXPERIMENTAL_FEATURES getHTTPResponseCode2 product-12345678-90-xl
    AbstractSingletonProxyFactoryBean application/vnd/openxmlformats
    wp-content/uploads/2021/03/header-image node_modules/react-dom/server
    DEFAULT_CONNECTION_TIMEOUT_MS isUserAuthenticatedAndActive Mozilla/5/Windows-NT-10
    build-2024-02-11-nightly release/v2/stable/notes images/gallery/photo_0012
    chapter-03-section-02 KafkaConsumerGroupCoordinator com/google/common/collect/ImmutableList
    test_should_return_empty_list SELECT_FOR_UPDATE_NOWAIT en-US/docs/Web/JavaScript
    blog/archive/2019/07/page/2 https-www-example-com spring-boot-starter-web
    JavaScriptObjectNotation order_items_2023_q4_final IMG_20230514_142530
    screenshot-2022-08-19-at-10 /var/log/nginx/access_log TransactionRollbackException
    kubernetes/cluster/addons rsa-sha2-512-signature unsigned_long_long_int
    MAX_RETRY_ATTEMPTS_EXCEEDED users/profile/settings/edit 2019-ncov-report-update
    background-attachment-fixed XMLHttpRequestUpload setDefaultCloseOperation ISO-8859-1-characters
    0800-555-0199-ext-12 page/about-us/our-history windows-server-2019-datacenter
    covid-19-vaccination-rates api/v1/customers/1024/orders JSONWebTokenAuthentication
    invoice_number_000123456 Content-Transfer-Encoding multipart/form-data/boundary
    assertRaisesRegexMatch docker-compose-override requirements/base/dev/test
    2020/12/31/year-in-review python-3-11-slim-bookworm MIT-License-Copyright-2015
    ThreadPoolExecutorService src/main/java/com/example CREATE_TABLE_IF_NOT_EXISTS
    max_allowed_packet_size category/sports/football UTF-16-little-endian InnoDB_buffer_pool_size
    state-of-the-art-results pre-trained-language-models 1234-5678-9012-3456 192-168-100-254-local
    article-id-100045678 Q3-2022-earnings-call getElementsByClassName readme-for-contributors
    vacation-photos-2018/day-04 x-forwarded-for-header libstdc++/include/c++/11
    CamelCaseToSnakeCaseConverter world-wide-web-consortium error_code_404_not_found
    tests/unit/test_parser STATUS_ACCESS_VIOLATION datetime/timezone/utc-offset
    GeneralDataProtectionRegulation intermediate_representation ubuntu-22-04-lts-amd64
    macos-monterey-12-6 first_name_last_name_email NullPointerExceptionHandler
    2024-Q1-roadmap-draft-v2 TCP/IP/UDP/ICMP/ARP news/world/europe/67012345 thread-safe-queue-impl
    LIST_OF_SUPPORTED_LANGUAGES ftp/pub/linux/kernel/v5 part-00000-of-00128 VERY_IMPORTANT_NOTICE
    model-checkpoint-epoch-10 google-analytics-tracking lorem-ipsum-dolor-sit-amet
""".split()


def test_a_hundred_ordinary_and_a_hundred_random_tokens():
    import base64

    made = []
    for i in range(25):
        raw = hashlib.sha384(f"unseen {i}".encode()).digest()
        packed = base64.b64encode(raw).decode()
        made += [raw.hex()[:32], packed[:40], re.sub("[+/=]", "", packed)[:24],
                 re.sub("[+/=]", "", packed)[10:42].upper()]
    words = [w for i in range(60) for w in prose(600 + i, 50).split()]
    training = [(w, 0) for w in words] + [
        (kind, 1) for i in range(600) for h in [hashlib.sha512(str(i).encode()).digest()]
        for kind in (h.hex()[:40], base64.b64encode(h).decode()[:40],
                     re.sub("[+/=]", "", base64.b64encode(h).decode())[20:50].upper())]
    model, least = secrets.fit(training)
    assert len(ORDINARY) == len(made) == 100
    alarms = [t for t in ORDINARY if secrets.markov_spans(t, model, [], least)]
    missed = [t for t in made if not secrets.markov_spans(t, model, [], least)]
    assert len(alarms) <= 1 and len(missed) <= 5, (alarms, missed, least)


def test_markov_spans_equal_sums_over_pairs():
    """The score recomputed pair by pair from the ratio table."""
    model, least = secrets.fit([("abcdefgh", 0), ("9f8Xq2Z7", 1), ("some_words", 0)], built=200)
    alphabet = secrets._ALPHABET
    for text in ["see 9f8Xq2Z79f8Xq2Z7 and org/some/ordinary/path", "x" * 20 + "7", ORDINARY[0]]:
        want = []
        for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
            total = model.ratio[len(alphabet), alphabet.index(m[0][0])] + sum(
                model.ratio[alphabet.index(a), alphabet.index(b)] for a, b in zip(m[0], m[0][1:]))
            plain = m[0].isalpha() and (m[0].islower() or m[0].istitle())
            if total / len(m[0]) >= least and not plain and re.search("[A-Za-z]", m[0]):
                want.append((m.start(), m.end(), "markov"))
        assert secrets.markov_spans(text, model, [], least) == want


def test_ordinary_words_of_distinct_documents_and_whole_texts(spark):
    """A frequent id counts as one document, and late words are drawn as well as early ones."""
    late = "early " * 2000 + "later " * 2000
    rows = [(i, late) for i in range(20)] + [(7, late)] * 400 + [(7, None), (None, "none"), (21, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [r.text for r in secrets.ordinary_samples(docs, 10, 1000).collect()]
    assert len(got) <= 1000 and len(got) >= 800  # 100 words of each document, one may be empty
    share = sum("later" in w.lower() for w in got) / len(got)
    assert 0.3 < share < 0.7


def test_redaction_keeps_rows_and_columns(docs):
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = out.filter("doc_id = 14").first()
    assert text.text == "[SECRET] [SECRET] [SECRET]'" and text.n_chars == len(text.text)
    assert out.filter("doc_id = 0").first().text == TEXTS[0][1]


# SimHash

def slow_print(text):
    words = (text or "").encode().translate(simhash.LOWER_BYTES).split()
    if not words:
        return 0
    grams = [words] if len(words) < 4 else [words[i:i + 4] for i in range(len(words) - 3)]
    h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(docs, empty):
    found = simhash.digests(simhash.near_duplicates(docs)).collect()
    prints = [slow_print(t) for _, t in TEXTS]
    a, b = zip(*[(i, j) for i, x in enumerate(prints) for j, y in enumerate(prints)
                 if (x ^ y).bit_count() <= 4])
    label = simhash.components(np.array(a), np.array(b), len(prints))
    low_id = {c: min((TEXTS[i][0] for i in range(len(prints)) if label[i] == c
                      and TEXTS[i][0] is not None), default=None) for c in set(label.tolist())}
    want = [(i, f"{p:016x}", low_id[label[k]]) for k, ((i, _), p) in enumerate(zip(TEXTS, prints))]
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == \
        collections.Counter(want)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_links_connect_what_all_pairs_connect(spark, block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
            for b in base for n in (1, 2, 3, 4, 5)]
    chain = [np.uint64(2**k - 1) for k in range(0, 60, 4)]
    f = np.unique(np.array([*base, *near, *chain, 0], np.uint64))
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4)
    label = simhash.components(a, b, len(f))
    prints = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "print bigint")
    got = {r.node: r.root for r in simhash.roots(simhash.links(prints, block=block)).collect()}
    groups = collections.defaultdict(set)
    for x in f.view(np.int64).tolist():
        groups[got.get(x, x)].add(x)
    want = collections.defaultdict(set)
    for x, c in zip(f.view(np.int64).tolist(), label.tolist()):
        want[c].add(x)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values()}


def test_count_distance_is_a_lower_bound():
    f = np.random.default_rng(1).integers(0, 2**64, (2, 5000), dtype=np.uint64)
    u = simhash.unary(f)
    assert (np.bitwise_count(u[0] ^ u[1]) <= np.bitwise_count(f[0] ^ f[1])).all()
    assert all((np.bitwise_count(u[0] & np.uint64(3 << 2 * s)) ==
                np.bitwise_count(f[0] & np.uint64(3 << 2 * s))).all() for s in range(32))


# Packing

def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer
    path = public_tokenizers.path(queries.PACKING_VOCABULARY)
    rows = packing.pack(docs, path).collect()
    whole = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, text in TEXTS:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for at in range(0, len(ids), 1024):
            part = ids[at:at + 1024]
            want[(i, at, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(empty, path).count() == 0


def test_plan_uses_every_piece_with_little_padding():
    rng = np.random.default_rng(2)
    counts = np.zeros(1025, np.int64)
    np.add.at(counts, rng.integers(1, 1025, 30_000), 1)
    chosen = packing.plan(counts, 1024)
    used = np.zeros(1025, np.int64)
    for combo, times in chosen:
        assert sum(combo) <= 1024 and times > 0
        for v in combo:
            used[v] += times
    assert (used == counts).all()
    total = sum(t for _, t in chosen) * 1024
    assert (counts * np.arange(1025)).sum() / total > 0.99


# Language

def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "ab", "b", "ba", "▁ab"]
    p = np.array([[.1, .2], [.2, .1], [.1, .1], [.3, .1], [.1, .3], [.1, .1], [.1, .1]])
    model = language.Model(["x", "y"], pieces, p, unknown=1e-12)

    def total(word, column):
        sums = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            sums[j] = sum(sums[i] * p[pieces.index(word[i:j]), column]
                          for i in range(j) if word[i:j] in pieces)
        return sums[-1]

    words = ["a", "ab", "aba", "abba" * 3, "b" * 20]
    got = model.word_scores(words)
    for k, w in enumerate(words):
        for c in range(2):
            assert got[k, c] == pytest.approx(math.log(total("▁" + w, c)), rel=1e-6)


def test_language_on_unseen_documents(spark, docs, empty):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.language_model(documents)
    found = language.identify(documents, model).join(
        documents.select("doc_id", "lang"), "doc_id").filter(queries._remainder(4) == 2)
    assert found.filter("lang_pred = lang").count() >= 0.95 * found.count()
    odd = {r.doc_id: r for r in language.identify(docs, model).filter("doc_id > 0").collect()}
    for i in (1, 2, 10, 11, 18, 19):
        assert (odd[i].lang_pred, odd[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in odd.values()) and odd[12].lang_pred != "und"
    assert language.identify(empty, model).count() == 0
    nothing = language.train(empty.select("doc_id", "text", "lang"),
                             public_tokenizers.path(queries.LANGUAGE_VOCABULARY))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


# Main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>"</p>"</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it work better for you.</div>
<article><h1>Big &amp; small</h1><p>First   <b>bold</b>
line.<br>Next</p><p>One<p>Two &lt;tags&gt; &#233;&eacute;<div class="ad">Buy now and save much money today</div>
<section id="comments"><p>Great article, I liked reading all of it.</p></section></article>
<aside>More stories from around the web for you</aside><form>Sign up</form>
<footer>&copy; all rights</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"),
            (3, "w", PAGE[:PAGE.index("Two") + 16], "x"),
            (4, "z", "<article><p>" + "word " * 100_000 + "</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = collections.defaultdict(list)
    for r in htmltext.extract(pages).collect():
        got[r.page_id].append(r)
    text = "Big & small\nFirst bold line. Next\nOne\nTwo <tags> éé"
    assert [r.text for r in got[1]] == [text, text] and got[1][0].n_chars == len(text)
    assert got[2][0].text == got[None][0].text == ""
    assert got[3][0].text == "Big & small\nFirst bold line. Next\nOne\nTwo <tags>"
    assert got[4][0].n_chars == 5 * 100_000 - 1
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_main_text_of_all_pages(spark):
    import html
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in htmltext.extract(pages).collect():
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r.page_id], re.S)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", m[1]) if m else "")
        plain = (" ".join(html.unescape(re.sub("<[^>]+>", "", x.replace("<br>", " "))).split())
                 for x in parts)
        assert r.text == "\n".join(x for x in plain if x)


def page_text(body):
    return htmltext.main_text(f"<html><body>{body}</body></html>", htmltext.train())


LAST = "The last paragraph of the article has quite enough words to stay."


def test_article_blocks_beside_link_blocks():
    footer = "<footer><a>Home</a> | <a>About</a></footer>"
    menu = "<div><a>Home</a></div><div><a>All the older stories of this site by year</a></div>"
    assert page_text(f"<article><h1>Title</h1><p>{LAST}</p></article>{footer}") == f"Title\n{LAST}"
    assert page_text(f"{menu}<article><p>Short</p></article>{menu}") == "Short"
    assert page_text(f"<article><p>{LAST}</p><p><a>One link only</a></p><p>{LAST}</p></article>") \
        == f"{LAST}\nOne link only\n{LAST}"
    assert page_text(f"<div><p>{LAST}</p></div>{footer}") == LAST


def test_long_link_blocks_are_not_main_text():
    long = "<a>All the older stories of this site sorted by year and author</a>"
    assert page_text(f"<div><p>{LAST}</p></div><div>{long}</div>") == LAST
    assert page_text(f"<div>{long}</div><div><p>{LAST}</p></div>") == LAST
    assert page_text(f"<main><p>{LAST}</p><nav>{long}</nav><aside>{long}</aside></main>") == LAST


@pytest.mark.parametrize("layout", [
    "class='has-sidebar'", "class='content with-sidebar'", "class='layout sidebar-right'",
    "id='page-no-comments'", "class='layout--has_left-sidebar'", "class=widget"])
def test_wrappers_with_layout_names(layout):
    body = f"<main><article><h1>Title</h1><p>{LAST}</p></article></main>"
    assert page_text(f"<div {layout}>{body}</div>") == f"Title\n{LAST}"
    after = f"<div class='related'><p>{LAST}</p></div>"
    assert page_text(f"<div {layout}>{body}{after}</div>{after}") == f"Title\n{LAST}"


def test_what_stays_aside():
    ad = f"<p>{LAST}</p>"
    for aside in (f"<div class='sidebar'>{ad}</div>", f"<div class='no-js nav'>{ad}</div>",
                  f"<div hidden><article>{ad}</article></div>",
                  f"<aside><article>{ad}</article></aside>",
                  f"<main><ol class='comment-list'><article>{ad}</article></ol></main>",
                  f"<article><div class='ad'>{ad}</div></article>"):
        assert page_text(aside) == "", aside


def test_ids_of_headings_are_no_hints():
    assert page_text(f"<article><h2 id='related-work'>Related work</h2><p id='naval-history'>{LAST}</p>"
                     "<h2 id=nav-history>Naval</h2></article>") == f"Related work\n{LAST}\nNaval"


# URLs

def test_url_rules_and_model(spark):
    urls = [("http://a.EXAMPLE.com/en/1?x", "a.example.com", "/en/1", "example.com/en/", "block"),
            ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
            ("http://x.www.example.com/en/9", "x.www.example.com", "/en/9", "www.example.com/en/", "allow"),
            ("https://notexample.com/en/1#t", "notexample.com", "/en/1", "com/", "allow"),
            ("x://com", "com", "", None, None), ("http://b.net/es/1", "b.net", "/es/1", "net/es/", "block"),
            ("http://planet/es/1", "planet", "/es/1", None, None), (None, "", "", None, None),
            ("mailto:x", "", "", None, None), ("", "", "", None, None),
            ("http://casino-slots-porn.example.org/xxx", "casino-slots-porn.example.org", "/xxx", None, "block"),
            ("https://thther.example.org/en/4", "thther.example.org", "/en/4", None, "allow")]
    pages = spark.createDataFrame([(k, u[0], "h") for k, u in enumerate(urls)] * 2,
                                  "page_id bigint, url string, host string")
    out = urlfilter.judge(pages)
    rows = out.collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        _, host, path, rule, verdict = urls[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert "Python" not in out._jdf.queryExecution().toString()
    assert urlfilter.judge(pages.limit(0)).count() == 0


# Licenses

def test_licenses_equal_brute_force(docs, empty):
    found = collections.defaultdict(list)
    for r in licenses.scan(docs).collect():
        found[r.doc_id].append(r)
    assert sum(map(len, found.values())) == len({(i, t) for i, t in TEXTS})
    for i, text in TEXTS:
        words, places = WORD.findall(low(text or "")), []
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            places += [(k, label) for k in range(len(words)) if words[k:k + len(p)] == p]
        matches = [(label, len({*t.split()} & {*WORD.findall(low(line))}) / len({*t.split()}))
                   for line in (text or "").split("\n") for label, t in licenses.TEMPLATES]
        matches = [m for m in matches if m[1] >= 0.8]
        got = next(r for r in found[i] if r.n_words == len(words))
        assert got.n_base == len(places)
        assert (got.first_word, got.last_word) == ((min(places)[0], max(places)[0]) if places
                                                   else (None, None))
        assert got.base_labels == ",".join(sorted({x for _, x in places}))
        assert got.labels == ",".join(sorted({x for _, x in places} | {m[0] for m in matches}))
        assert got.score == (1.0 if places else max([m[1] for m in matches], default=0.0))
    assert licenses.scan(empty).count() == 0


def test_wrapped_notices_equal_brute_force(spark):
    notice = {label: text for label, text in licenses.TEMPLATES}
    bsd = notice["bsd"].split()
    mit = notice["mit"].split()  # the later of two
    texts = [
        " ".join(mit[:13]) + "\n" + " ".join(mit[13:]),
        "# " + " ".join(bsd[:9]) + "\n# " + " ".join(bsd[9:]) + "\n",
        prose(80, 300) + "\n" + "\n".join(bsd) + "\n" + prose(81, 300),
        " ".join(bsd[:7]) + "\n" + prose(82, 100) + "\n" + " ".join(bsd[7:]),  # too far apart
        "\n".join(" ".join(t.split()[k:k + 3]) for _, t in licenses.TEMPLATES
                  for k in range(0, len(t.split()), 3)),
        " ".join(x for w in bsd for x in (w, "x")), "\n".join(x for w in bsd for x in (w, "x", "y")),
        "this work is licensed\nunder a creative commons\nattribution license", "licensed\nunder"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    for i, text in enumerate(texts):
        words = WORD.findall(low(text))
        base = {label for phrase, label in licenses.PHRASES if f" {phrase} " in f" {' '.join(words)} "}
        found = {}
        for label, t in licenses.TEMPLATES:
            own, width = {*t.split()}, 2 * len(t.split())
            parts = [words[k:k + width] for k in range(len(words))]
            parts += [WORD.findall(low(line)) for line in text.split("\n")]
            best = max(len(own & {*p}) / len(own) for p in parts)
            if best >= 0.8:
                found[label] = max(best, found.get(label, 0))
        assert got[i].labels == ",".join(sorted(base | {*found})), text[:60]
        assert got[i].score == (1.0 if base else max(found.values(), default=0.0))
    assert [got[i].labels for i in (0, 1, 2, 3)] == ["mit", "bsd", "bsd", ""]


# Order MinHash

def test_order_hash(spark, docs, empty):
    rows = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, ), reverse=True)
    out = orderhash.fingerprints(docs)
    got = out.collect()
    assert len(got) == len(TEXTS) and "Python" not in out._jdf.queryExecution().toString()
    by_text = collections.defaultdict(set)
    plain = {i: t or "" for i, t in rows if i is not None}
    order = sorted(plain, reverse=True)
    for r in got:
        if r.doc_id in (None, 4, 0):  # followed by a null or an equal id
            continue
        following = plain[order[(order.index(r.doc_id) + 1) % len(order)]]
        text = plain[r.doc_id]
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest(), r.doc_id
        assert r.n_chars == len(text) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text[text].add(r.fingerprint)
        if changed == text:
            assert r.near_edited == 1 and r.edited_fingerprint == r.fingerprint
    assert all(len(v) == 1 for v in by_text.values())
    assert orderhash.fingerprints(empty).count() == 0
    one = orderhash.fingerprints(docs.filter("doc_id = 0")).first()
    assert one.near_next == 1.0


@pytest.mark.parametrize("per_bucket", [1, 3, 100])
def test_next_across_ranges(spark, per_bucket):
    ids = [3, 9, 2**40, -5, 17, 18, 19, 400]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string")
    got = {r.doc_id: r.next.text for r in orderhash.with_next(rows, per_bucket).collect()}
    down = sorted(ids, reverse=True)
    assert got == {i: f"t{down[(k + 1) % len(down)]}" for k, i in enumerate(down)}


def test_order_hash_follows_edits(spark):
    text = prose(11, 400)
    words = text.split()
    few = " ".join([*words[:200], "inserted", *words[201:]])
    moved = " ".join([*words[200:], *words[:200]])
    shuffled = " ".join(sorted(words))
    rows = spark.createDataFrame([(0, text), (1, few), (2, moved), (3, shuffled), (4, prose(12, 400))],
                                 "id int, text string")
    sig = {r.id: r.s for r in rows.select("id", orderhash.signature(rows.text).alias("s")).collect()}
    like = [sum(a == b for a, b in zip(sig[0], sig[i])) / len(sig[0]) for i in range(5)]
    assert like[0] == 1 and like[1] > 0.8 and like[1] > like[2] > like[4]


def test_occurrences_are_numbered(spark):
    """One more repeat of a k-mer changes less than thousands more."""
    texts = spark.createDataFrame([(n, "la " * n + "end") for n in (50, 51, 3000)],
                                  "id int, text string")
    sig = {r.id: r.s for r in texts.select("id", orderhash.signature(texts.text).alias("s")).collect()}
    near = sum(a == b for a, b in zip(sig[50], sig[51])) / len(sig[50])
    far = sum(a == b for a, b in zip(sig[50], sig[3000])) / len(sig[50])
    assert near > far


def slow_order_hash(text):
    """Order MinHash by sorting all k-mers for every seed; hashes as Spark's xxhash64."""
    def h(*values):
        out = 42
        for v in values:
            if v is not None:
                raw = v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little")
                out = xxhash.xxh64_intdigest(raw, out)
        return out

    words = re.split(r"[ \t\n\x0b\f\r]+", text)
    lead = lambda v: (v >> 1) >> orderhash._POSITION
    grams = [h(*words[i:i + orderhash.K]) for i in range(max(1, len(words) - orderhash.K + 1))]
    seen, ids = collections.Counter(), []
    for g in grams:
        n = seen[lead(g)]
        seen[lead(g)] += 1
        # The number of the occurrence is an int: four bytes to Spark.
        ids.append(lead(xxhash.xxh64_intdigest(n.to_bytes(4, "little"), h(lead(g)))))
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    out = []
    for seed in orderhash.seeds_of(orderhash.ENTRIES):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] ^ seed, i))
        value = 0
        for i in sorted(order[:orderhash.KEEP]):
            value = h(value, grams[i])
        out.append(signed(value))
    return out


def test_order_hash_equals_brute_force(spark):
    texts = [prose(40 + n, n) for n in range(1, 60)] + [prose(200 + n, 300) for n in range(40)] + [
        "", "a", " ".join(f"w{i}" for i in range(5000)), "x" * 300, "\u65e5\u672c\u8a9e" * 40, "la " * 60 + "end", prose(70, 33), prose(71, 900)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: list(r.s) for r in rows.select(
        "id", orderhash.signature(rows.text).alias("s")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == slow_order_hash(text), (i, text[:40])


def test_entries_collide_as_often_as_texts_share_kmers():
    """One kept hash of sets with a third in common is equal in a third of the entries."""
    rng = random.Random(6)
    for n in (4, 20, 200, 1000):
        equal = 0
        for _ in range(60):
            ids = [rng.getrandbits(orderhash._HASH) for _ in range(2 * n)]
            first, second = ids[:n + n // 2], ids[n // 2:]      # n of 2n are common
            equal += sum(min(first, key=lambda x: x ^ s) == min(second, key=lambda x: x ^ s)
                         for s in orderhash.seeds_of(orderhash.ENTRIES))
        assert abs(equal / 60 / orderhash.ENTRIES - 0.5) < 0.06


def test_order_hash_of_short_texts_that_share_nothing(spark):
    pairs = [(" ".join(f"a{i}" for i in range(n)), " ".join(f"b{i}" for i in range(n)))
             for n in range(1, 21)] + [("x" * 200, "x" * 100 + "y" * 100)]
    rows = spark.createDataFrame(pairs, "a string, b string").select(orderhash.likeness(
        orderhash.signature(F.col("a")), orderhash.signature(F.col("b"))).alias("near"))
    assert [r.near for r in rows.collect()] == [0.0] * len(pairs)


# Quality

def test_quality_on_unseen_documents(spark, docs, empty):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(
        "/root/testdata/sf0.01/labels.parquet").collect()}
    rows = queries.op10_quality(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    known = [(r.predicted, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert sum(a == b for a, b in known) >= 0.95 * len(known)


def test_quality_of_odd_rows(docs, empty, spark):
    labels = spark.createDataFrame([(0, 1, 9), (3, 1, 9), (8, 0, 9), (11, 0, 9), (None, 1, 9),
                                    (1, None, 9)], "doc_id bigint, quality int, words int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(empty, model).count() == 0
    assert quality.train(docs, labels.limit(0)).weighted == []


def test_repeats_of_any_length(spark, docs):
    """A word repeated 100,000 times is scored; all shares equal those of the pattern."""
    pattern = re.compile(r"(?<!\S)(\S+)(?:\s+\1(?!\S))+", re.ASCII)
    texts = [t for _, t in TEXTS if t] + [
        "word " * 100_000, "| | " * 30_000, " a\t\ta a b  b\n\nb c", "a aa a a-a a", "x x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.s for r in rows.select(
        "doc_id", quality.statistics(rows.text)["repeats"].alias("s")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == (len(text) - len(pattern.sub(r"\1", text))) / len(text), text[:60]
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))],
                                   "doc_id bigint, quality int")
    scored = quality.score(rows, quality.train(rows, labels)).collect()
    assert len(scored) == len(texts) and all(0 <= r.score <= 1 for r in scored)


def test_rules_as_columns_equal_rules_as_arrays(docs):
    rng = np.random.default_rng(3)
    x = rng.random((400, len(quality.STATISTICS))) * 5
    y = ((x[:, 0] > 2) & (x[:, 3] < 3)).astype(float)
    rules = quality.rules_of(x, y)
    z = np.column_stack([quality.holds(r, x) for r in rules]).astype(float)
    b, w = quality.lasso(z, y)
    assert ((1 / (1 + np.exp(-(z @ w + b))) > 0.5) == y).mean() > 0.97
    assert (np.abs(w) < 1e-4).mean() > 0.3


def test_tree_learns_a_conjunction():
    x = np.array([[a, b] for a in range(6) for b in range(6)], float)
    y = ((x[:, 0] > 2) & (x[:, 1] <= 3)).astype(float)
    assert (trees.predict(trees.grow(x, y, 3), x) == y).all()


def test_neighbours_decide_where_structure_is_silent():
    tree, long_ = htmltext.train(), "word " * 40
    used = {htmltext.FEATURES[f] for path in trees.paths(tree) for f, _, _ in path}
    assert {"words_before", "words_after"} & used and {"links_before", "links_after"} & used
    x = np.array(htmltext.LABELLED, float)
    assert ((htmltext.predict(tree, x[:, :-1]) >= 0.5) == x[:, -1]).all()
    text = htmltext.main_text(f"<h1>A title of four</h1><p>{long_}</p><h2>Methods</h2><p>{long_}</p>",
                              tree)
    assert text.split("\n")[::2] == ["A title of four", "Methods"]
    assert htmltext.main_text(
        "<div><a href=x>Home</a></div><p>Short line</p><div><a href=y>About us</a></div>", tree) == ""


def test_captions_formulas_and_adverts_inside_lines():
    page = ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds. <span class='ad'>BUY "
            "NOW</span> End.</p><figure><figcaption>A caption</figcaption></figure>"
            "<audio>no sound here</audio></article>")
    assert htmltext.main_text(page, htmltext.train()) == (
        "So x=2 holds. End.\nA caption\nno sound here")


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "</x>" * 200_000,
                                  "<p><b>" * 100_000 + "</x>" * 100_000,
                                  "<p>a</b></p>" * 60_000, "<a <b <c " * 60_000])
def test_broken_pages_take_linear_time(page):
    import time

    start = time.perf_counter()
    htmltext.blocks(page)
    assert time.perf_counter() - start < 20
