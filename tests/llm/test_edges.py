"""Every operator on large ids beside nulls, columns that differ by case, empty tables and very long texts."""

import base64
import math
import time
from collections import Counter

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from sedge.llm import licenses, near_dedup, packing, queries, secret_scan, tiff, topk, url_filter
from sedge.llm.near_dedup import keep_one, near_duplicates
from sedge.llm.secret_scan import mask_secrets
from sedge.llm.toxicity import drop_toxic, toxicity_scores

BIG = 2**53 + 1
LONG = "Some words, 12 numbers and token = abcdefghijklmnop in a row. " * 5_000
TEXTS = [(BIG, "one two three four five six"), (None, "no id"), (BIG + 1, None), (BIG + 2, ""), (7, LONG), (7, LONG), (BIG + 3, "one two three four five six")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    # names that clash with those asked for, and with those that operators use inside
    return rows.select("doc_id", "text", F.lit(1).alias("DOC_ID"), F.lit("x").alias("TEXT"), F.lit(None).cast("long").alias("node"), F.lit(2.0).alias("n_words"), F.lit(3).alias("c0"), F.lit(4).alias("rid"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 == 0), "x", 9) for i in range(60)], "doc_id long, toxic int, DOC_ID string, TOXIC int")


OPERATORS = {
    "token_counts": queries.token_counts, "license_scan": licenses.license_scan, "secret_spans": secret_scan.secret_spans, "bpe_roundtrip": queries.bpe_roundtrip,
    "text_media": tiff.text_media, "near_duplicates": near_duplicates, "pack_documents": packing.pack_documents,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_ids_stay_exact_and_names_may_clash(docs, name):
    out = OPERATORS[name](docs)
    rows = out.where("start = 0") if name == "pack_documents" else out
    assert Counter(r.doc_id for r in rows.collect()) == Counter(i for i, _ in TEXTS)
    assert out.schema["doc_id"].dataType.simpleString() == "bigint"
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_toxicity_edges(spark, labels):
    training = spark.createDataFrame([(i, " ".join(f"x{i}y{j} {'good' if i % 3 else 'bad'}" for j in range(12))) for i in range(60)], "doc_id long, text string")
    both = spark.createDataFrame(TEXTS, "doc_id long, text string").union(training).select("*", F.lit(1).alias("DOC_ID"), F.lit("x").alias("TEXT"), F.lit(4).alias("rid"))
    out = toxicity_scores(both, labels)
    assert Counter(r.doc_id for r in out.collect()) == Counter([i for i, _ in TEXTS] + list(range(60)))
    kept = drop_toxic(both, labels)
    assert kept.columns == both.columns and {BIG, None, 1} <= {r[0] for r in kept.collect()} and 3 not in {r[0] for r in kept.collect()}
    assert toxicity_scores(both.limit(0), labels).count() == 0 and drop_toxic(both.limit(0), labels).count() == 0


def test_stages_keep_clashing_columns_and_large_ids(docs):
    for stage, lost in ((mask_secrets, []), (keep_one, [7, BIG + 3])):
        out = stage(docs)
        assert out.dtypes == docs.dtypes
        assert Counter(r[0] for r in out.collect()) == Counter(i for i, _ in TEXTS) - Counter(lost)


def test_near_duplicates_link_large_ids_beside_null(docs):
    out = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert out[BIG + 3].component_id == BIG and not out[BIG + 3].kept and out[BIG].kept and out[None].component_id is None and out[None].kept


def test_top_k_with_clashing_names(spark):
    rows = spark.createDataFrame([(50, [1.0, 2.0]), (BIG, [3.0, 4.0]), (None, [5.0, 6.0])], "vec_id long, embedding array<double>").select("*", F.lit(1).alias("VEC_ID"), F.lit("x").alias("Embedding"), F.lit(2).alias("group"))
    assert [tuple(r) for r in topk.exact_topk(rows).collect()] == [(50, 1, BIG, 256 * 256 * 11)]


@pytest.mark.parametrize("far", [0.0, 4.0])
def test_top_k_drops_candidates_before_the_last_step(far):
    rng = np.random.default_rng(7)
    matrix = rng.integers(-40, 40, (64, 3000))
    matrix[:8, :30] += int(40 * far)
    query = np.where(np.arange(64) < 8, 200, 3) + rng.integers(0, 5, 64)
    order = np.argsort(-(query.astype(float) ** 2), kind="stable")
    m, q = np.ascontiguousarray(matrix[order]), query[order]
    mass = np.vstack([np.cumsum((m.astype(float) ** 2)[::-1], axis=0)[::-1], np.zeros((1, 3000))])
    ids, scores, survivors = topk.search_block(np.arange(3000), m, -1, q, 5, m.astype(float), mass)
    want = sorted((-int(query @ matrix[:, i]), i) for i in range(3000))[:5]
    assert list(zip(-scores, ids)) == want and survivors[0] < 300 and survivors == sorted(survivors, reverse=True)


def test_urls_with_large_ids_and_no_rows(spark):
    rows = [(BIG, "h://a.org/fr/x"), (None, "h://b.net/"), (BIG + 1, None), (BIG + 1, None), (3, "h://" + "ab" * 500 + ".com/" + "library/" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").select("*", F.lit(1).alias("PAGE_ID"), F.lit("x").alias("URL"), F.lit("y").alias("word"))
    out = url_filter.judge_urls(pages).collect()
    assert Counter((r.page_id, r.rule) for r in out) == Counter([(BIG, "org/fr/"), (None, "net/"), (BIG + 1, None), (BIG + 1, None), (3, None)])
    assert next(r.words for r in out if r.page_id == 3) == "ab" * 500
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_splits_against_all_splits():
    rng = np.random.default_rng(2)
    counts = {w: int(n) for w, n in zip(("a", "ab", "abc", "b", "bc", "ca", "cab", "c"), rng.integers(1, 50, 8))}
    total = sum(counts.values())

    def cost(words):
        return sum(-math.log(counts[w] / total) if w in counts else math.log(10 * total) + 2.5 * len(w) for w in words)

    def splits(run):
        return [[]] if not run else [[run[:i], *rest] for i in range(1, len(run) + 1) for rest in splits(run[i:])]

    for _ in range(60):
        run = "".join(rng.choice(list("abcx"), rng.integers(1, 9)))
        assert math.isclose(cost(url_filter.best_split(run, counts, total)), min(map(cost, splits(run))))


def test_bayes_against_a_plain_version(spark):
    hosts = {"h1": ["casino", "win", "blue"], "h2": ["library", "blue"], "h3": ["blue", "sky"], "h4": ["win", "sky", "sky"], "h5": [], "h6": ["museum", "casino"]}
    paths = {("h1", "spins"), ("h3", "spins"), ("h2", "books"), ("h5", "sky")}
    named = spark.createDataFrame([(h, w) for h, w in hosts.items()], "host string, words array<string>")
    got = {r.word: r.odds for r in url_filter.word_odds(named, spark.createDataFrame(sorted(paths), "host string, word string")).collect()}
    tokens = {h: set(w) | {x for g, x in paths if g == h} for h, w in hosts.items()}
    tokens = {h: w for h, w in tokens.items() if w}
    block, allow = set(url_filter.BLOCK_WORDS), set(url_filter.ALLOW_WORDS)
    fixed = {}
    for h, words in hosts.items():
        if mark := len(set(words) & block) - len(set(words) & allow):
            fixed[h] = float(mark > 0)
    odds = None
    for _ in range(url_filter.ROUNDS + 1):
        p = {h: fixed.get(h, 1 / (1 + math.exp(-(url_filter.PRIOR + (sum(odds[w] for w in ws) if odds else 0))))) for h, ws in tokens.items()}
        b, a = Counter({w: 1.0 for w in block}), Counter({w: 1.0 for w in allow})
        n = b + a
        for h, ws in tokens.items():
            for w in ws:
                b[w] += p[h]
                a[w] += 1 - p[h]
                n[w] += 1
        of = lambda c, w: 0.8 * c[w] / sum(c.values()) + 0.2 * n[w] / sum(n.values())
        odds = {w: math.log(of(b, w) / of(a, w)) for w in n}
    assert got.keys() == odds.keys() and all(math.isclose(got[w], odds[w], abs_tol=1e-9) for w in got)


def test_one_strong_word_decides(spark):
    urls = ["casino.com", "porn.info", "xxx.info", "citylibrary.info", "bluesky.info", "free-spins.info", "casinospins.info", "spins-library.info"]
    out = url_filter.judge_urls(spark.createDataFrame([(i, f"h://{u}/") for i, u in enumerate(urls)], "page_id long, url string"))
    assert [r.verdict for r in out.orderBy("page_id").collect()] == ["block", "block", "block", "allow", "allow", "block", "block", "allow"]


def test_secrets_take_linear_time_and_do_not_fail():
    keywords = secret_scan.automaton()
    deep = base64.urlsafe_b64encode(b'{"alg":' + b"[" * 100_000).decode().rstrip("=")
    good = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    assert not [s for s in secret_scan.scan(f"{deep}.eyJab.{'a' * 20}", keywords) if s[2] == "jwt"]
    token = f"{good}.eyJab.{'Z' * 20}"
    assert [s for s in secret_scan.scan(f"eyJx.y {token} eyJz", keywords) if s[2] == "jwt"] == [(7, 7 + len(token), "jwt")]
    for text in ("eyJ" * 333_333, "eyJa." * 200_000, "token " * 166_666, "-----BEGIN PRIVATE KEY-----\n" * 35_000, "AKIA" * 250_000, "password" + " " * 1_000_000):
        began = time.process_time()
        secret_scan.scan(text, keywords)
        assert time.process_time() - began < 5


def test_whole_licences_and_licences_at_the_ends_of_texts():
    found = licenses.Templates(licenses.TEMPLATES)
    for name in ("MIT", "BSD", "ISC"):
        text = max(licenses.TEMPLATES[name], key=len)
        for before, after in (("", ""), ("word " * 300, " word" * 300)):
            (span,), _ = licenses.license_spans(before + text + after, found)
            assert span[2] == name and abs(span[0] - len(before)) < 3 and abs(span[1] - len(before) - len(text)) < 3
    # few of many cues belong to the notice
    many = "license " * 200 + ". Released under the MIT License. " + "license " * 200
    assert [s[2] for s in licenses.license_spans(many, found)[0]] == ["MIT"]


def test_packing_takes_the_lowest_cost_that_fits():
    rng = np.random.default_rng(4)
    lengths = [int(n) for n in rng.integers(1, 9_000, 300)]
    pieces = packing.pack(lengths)
    rooms = packing.capacities(sum(lengths))
    filled = sum(n // 4096 for n in lengths)
    left, cost = {s: rooms[s] for s in range(filled, len(rooms))}, Counter()
    parts = sorted(((n % 4096, d) for d, n in enumerate(lengths) if n % 4096), key=lambda p: (-p[0], p[1]))
    placed = {(d, n): s for d, start, n, s in pieces if start == lengths[d] - lengths[d] % 4096}
    homeless = False
    for n, d in parts:
        fits = [s for s in left if left[s] >= n]
        if not fits:
            homeless = True
            continue
        best = min(fits, key=lambda s: (cost[s], s))
        assert placed[d, n] == best
        left[best] -= n
        cost[best] += packing.cost(n)
    assert homeless and Counter(s for *_, n, s in pieces for _ in range(1)).keys() == set(range(len(rooms)))


def test_media_digests_and_features(spark):
    text = "é" * 700
    row = tiff.text_media(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    payload = text.encode() + b" " * (1536 - 1400)
    page = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3).astype(int)
    means = [int(page[:, :, c].sum()) * 1000 // (page.shape[0] * 64) for c in range(3)]
    steps = [sum(abs(int(r[x + 1, c]) - int(r[x, c])) for r in page for x in range(63)) * 1000 // (page.shape[0] * 63) for c in range(3)]
    assert row.feature == f"64x{page.shape[0]}x3;mean={'/'.join(map(str, means))};step={'/'.join(map(str, steps))}"
    media = tiff.to_media(payload)
    import hashlib

    assert (row.n_bytes, row.payload_bytes, row.media_bytes, row.media_sha256) == (1400, 1536, len(media), hashlib.sha256(media).hexdigest())


def test_tiff_pages_of_null_keys(spark):
    data = bytearray(tiff.write_pages([np.zeros((2, 3, 1), np.uint8)]))
    out = tiff.tiff_pages(spark.createDataFrame([(None, data), (BIG, data), (BIG, data), (5, None)], "rid long, media binary")).collect()
    assert Counter((r.rid, r.page) for r in out) == Counter([(None, 0), (BIG, 0), (BIG, 0)])


def near(size, percent, seed):
    """Pairs of texts of about that similarity."""
    rng, out = np.random.default_rng(seed), []
    for k in range(size):
        words = [f"w{k}x{i}" for i in range(120)]
        out.append(" ".join(words))
        # each changed word changes four shingles of both texts
        for at in rng.choice(np.arange(5, 115, 6), percent, replace=False):
            words[at] = f"v{k}x{at}"
        out.append(" ".join(words))
    return out


def test_recall_near_the_threshold_and_wide_groups(spark, monkeypatch):
    texts = near(150, 3, 1)  # 117 shingles, 12 of them changed: 105 / 129 = 0.814
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [plain.shingles(t, 4) for t in texts]
    assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.82
    for least in (3, 1):
        out = {r.doc_id: r.component_id for r in near_duplicates(docs, words=4, least=least).collect()}
        assert all(out[2 * k + 1] == 2 * k for k in range(150))
    # one base with many variants that aren't all linked, by blocks of few sets and a grid of cells
    base, rng, wide = [f"b{i}" for i in range(60)], np.random.default_rng(5), []
    for k in range(70):
        words = list(base)
        for at in rng.choice(56, 2, replace=False):
            words[at] = f"c{k}x{at}"
        wide.append(" ".join(words))
    for name, value in (("WIDE", 0), ("BLOCK", 5), ("GRID", 2), ("STARS", 1)):
        monkeypatch.setattr(near_dedup, name, value)
    docs = spark.createDataFrame(list(enumerate(wide)), "doc_id long, text string")
    root = plain.linked([plain.shingles(t, 4) for t in wide])
    assert len(set(root)) > 1
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, words=4).collect()} == dict(enumerate(root))
