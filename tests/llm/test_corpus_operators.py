"""Each corpus operator against a brute-force version, on the small tables and on awkward rows."""

import base64
import hashlib
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from forecastlab.llm import bpe, components, cws, exact_dedup, html_extract, mixing, pretokenize, quality, queries, sharding, simhash, token_files, url_filter
from forecastlab.llm.common import shared_dir, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, salt string, fp string, bucket string, k string, shard string"
LONG = "word " * 30_000 + "end"


def docs_of(spark, rows):
    """Rows of (doc_id, text, source), with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), "x", "x", "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


AWKWARD = [(5, "a b c d e f", "s1"), (4, "a b c d e f", "s1"), (3, None, None), (2, "", "s2"), (1, " \n ", None), (None, "a b c d e f", "s1"), (7, "x", "s3"), (8, LONG, "s1"), (8, LONG, "s1"), (9, "été 漢字 😀 it's", "é"), (10, "tail " * 50, None)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def test_shared_dir_is_the_named_one(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


# --- 1 mixing


def brute_targets(sizes, weights):
    target, fixed = {}, set()
    while True:
        left = 1.5 * sum(sizes) - sum(2 * sizes[i] for i in fixed)
        free = [i for i in range(len(sizes)) if i not in fixed]
        target = {i: 2.0 * sizes[i] for i in fixed} | {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if target[i] > 2 * sizes[i]}
        if not over:
            return [target[i] for i in range(len(sizes))]
        fixed |= over


def test_mixing_reaches_targets(spark, sf, docs, texts):
    rows = [r.asDict() for r in queries.op1_mixing(spark, sf).collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    size = Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]]))
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[source[r["doc_id"]]] += r["size"]
    order = sorted(size)
    targets = dict(zip(order, brute_targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(targets[s])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 64 + 0.02 * targets[s] for s in order)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_counts(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_mixing_awkward(spark):
    rows = mixing.mix_counts(docs_of(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix_counts(docs_of(spark, [])).count() == 0
    assert mixing.mix_documents(docs_of(spark, [])).count() == 0


def test_draws_have_the_same_law_at_every_size():
    """Means and deviations of 400 draws of 4096 slots at 30,000, a million, 2e9 and 1e11 blocks; exact sums; small cases against numpy."""
    for total in (30_000, 1_000_000, 2_000_000_000, 100_000_000_000):
        quota = np.array([total * 6 // 10, total // 4, total - total * 6 // 10 - total // 4], dtype=np.int64)
        got = np.array([mixing._part(quota, 4096, np.random.default_rng([9, k])) for k in range(400)])
        assert (got.sum(axis=1) == 4096).all() and (got >= 0).all()
        p = quota / total
        sd = np.sqrt(4096 * p * (1 - p) * (total - 4096) / (total - 1))
        assert (np.abs(got.mean(axis=0) - 4096 * p) < 4 * sd / 20).all()
        assert (np.abs(got.std(axis=0) / sd - 1) < 0.2).all()
    half = [mixing._part(np.array([6 * 10**10, 4 * 10**10]), 5 * 10**10, np.random.default_rng(k))[0] for k in range(40)]
    sd = (5e10 * 0.24 / 2) ** 0.5
    assert abs(np.mean(half) - 3e10) < 4 * sd / 6 and 0.6 < np.std(half) / sd < 1.5
    assert [mixing.hypergeometric(3, 2, 5, u) for u in (0, 0.5, 0.999)] == [3, 3, 3] and mixing.hypergeometric(0, 9, 4, 0.5) == 0
    grid = [mixing.hypergeometric(5, 7, 6, (i + 0.5) / 20_000) for i in range(20_000)]
    want = np.random.default_rng(0).hypergeometric(5, 7, 6, 200_000)
    assert np.abs(np.bincount(grid, minlength=6) / 20_000 - np.bincount(want, minlength=6) / 200_000).max() < 0.01


def test_mixed_repeated_rows_hold_what_they_take(spark):
    """Rows that repeat each other, one id with two texts, and columns called epoch, no and row."""
    words = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    rows = [(1, words(500, "a"), "s1")] * 2 + [(1, words(500, "b"), "s1"), (2, words(700, "c"), "s2"), (None, words(90, "d"), None), (None, words(90, "d"), None), (3, None, "s1")]
    docs = docs_of(spark, rows).selectExpr("*", "'e' AS epoch", "1L AS no", "2L AS row")
    taken = sum(r["taken"] for r in mixing.mix_counts(docs).collect())
    mixed = mixing.mix_documents(docs)
    got = mixed.collect()
    assert mixed.columns == docs.columns and {(r["epoch"], r["no"], r["row"]) for r in got} == {("e", 1, 2)}
    assert sum(len(r["text"].split()) for r in got) == taken
    for r in got:
        assert any(set(r["text"].split()) <= set((t or "").split()) and r["doc_id"] == i for i, t, _ in rows)


def test_mixed_documents_hold_what_is_taken(docs):
    whole = docs.filter("text is not null")
    counts = {r["doc_id"]: r["taken"] for r in mixing.mix_counts(whole).collect()}
    words, texts_ = Counter(), {r["doc_id"]: r["text"] for r in whole.collect()}
    mixed = mixing.mix_documents(whole)
    assert mixed.columns == whole.columns
    for r in mixed.collect():
        n = len(WORD.findall(r["text"]))
        words[r["doc_id"]] += n
        assert r["n_chars"] == len(r["text"])
        if n == len(WORD.findall(texts_[r["doc_id"]])):
            assert r["text"] == texts_[r["doc_id"]]
    assert {k: v for k, v in counts.items() if v} == dict(words)


def test_shard_counts_add_up():
    quota = (1000, 37, 0, 501)
    got = [mixing.shard_counts(k, 16, 100, quota, 3) for k in range(16)]
    assert np.array_equal(sum(here for here, _ in got), np.array(quota))
    assert np.array_equal(got[5][1], sum(here for here, _ in got[:5]))
    assert all(here.sum() == 100 for here, _ in got[:15])
    assert sorted(mixing.permuted(np.arange(1237), 1237, 9).tolist()) == list(range(1237))


# --- 2 html


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header>Site</header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- c --><main><article><h1>T &lt;%d&gt; &amp;</h1>
<p>One   <b>two</b>&nbsp;three<span class="ad">BUY</span> four%d.<p>Second<br>line<form><label>mail</label></form><div class="comments"><p>nice</p></div></article></main>
<aside>rel</aside><div class="ad">buy</div><footer>&copy; f</footer>"""


def test_html_main_text(spark):
    rows = [(i, f"http://a.example/{i}", PAGE % (i, i)) for i in range(8)] + [(8, None, None), (9, "nonsense", ""), (10, "http://b.example/", "<p>only <i>this</i>"), (10, "http://b.example/", "<p>only <i>this</i>"), (11, "http://c.example/", "<div " * 500 + "x")]
    pages = spark.createDataFrame([(*r, "y") for r in rows], "page_id long, url string, html string, host string")
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows)
    joined = html_extract.extract(pages, most_hosts=0)
    assert sorted(map(str, joined.collect())) == sorted(map(str, got))
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[i] == f"T <{i}> &\nOne two three four{i}.\nSecond\nline" for i in range(8))
    assert text[8] == "" == text[9] and text[10] == "only this"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_on_pages(spark, sf):
    import html as h

    pages = {r["page_id"]: r["html"] for r in table(spark, sf, "pages").collect()}
    for r in queries.op2_html_extraction(spark, sf).collect():
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_html_marks():
    page = """<body class="sidebar-left"><div id="sidebar2">s</div><article><div class="entry-header"><h1>T</h1></div><p>a</p><ul class="commentlist"><li>c</li></ul><p hidden>h</p><p>b &amp; c</p></article>
    <div class="article-comments"><p>x</p></div></body>"""
    own = html_extract.profile(html_extract.read(page).wrapper, 1)
    assert html_extract.main_text(page, own) == "T\na\nb & c"
    plain = "<body><div class='menu'><p>m</p></div><div id='text'><p>first block of text</p><p>second block</p></div><div class='footer'>f</div></body>"
    assert html_extract.main_text(plain, html_extract.profile(html_extract.read(plain).wrapper, 1)) == "first block of text\nsecond block"


def test_wrapper_alignment():
    one = html_extract.read("<body><nav>m</nav><p>a</p><p>b</p><div>x</div></body>").wrapper
    two = html_extract.read("<body><nav>m</nav><p>c</p><h2>t</h2></body>").wrapper
    body = html_extract.merged(one, two).inner[0]
    assert [(n.key, n.least, n.many, n.text) for n in body.inner] == [("nav", 1, False, "m"), ("p", 1, True, True), ("div", 0, False, "x"), ("h2", 0, False, "t")]


# --- 3 sharding


def test_sharding_awkward(spark):
    got = sharding.shard_rows(docs_of(spark, AWKWARD + [(8, LONG, "s1")] * 3), 400_000).collect()
    assert len(got) == len(AWKWARD) + 3
    held = Counter()
    for r in got:
        held[r["shard"]] += r["doc_bytes"]
        assert r["shard_bytes"] <= 400_000
    assert all(v <= 400_000 for v in held.values())
    assert sharding.shard_rows(docs_of(spark, []), 10).count() == 0
    one = sharding.shard_rows(docs_of(spark, [(1, "abc" * 10, None), (2, "b", None)]), 10).collect()
    assert {(r["doc_id"], r["oversized"], r["shard_docs"]) for r in one} == {(1, True, 1), (2, False, 1)}


def test_sharding_prefixes_and_limits(docs):
    got = sharding.shard_rows(docs, 20_000).collect()
    held = Counter()
    for r in got:
        held[r["shard"]] += r["doc_bytes"]
        assert len(r["shard"]) == r["depth"]
    names = sorted(held)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:]))
    assert {r["shard"]: r["shard_bytes"] for r in got} == dict(held)
    assert all(v <= 20_000 or sum(r["shard"] == k for r in got) == 1 for k, v in held.items())


# --- 4 simhash


def brute_components(fps, bits=4):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def brute_simhash(text):
    import xxhash

    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query(spark, sf, texts):
    fps = {i: brute_simhash(t) for i, t in texts.items()}
    want = brute_components(fps)
    got = queries.op4_simhash(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_covers_meet_whatever_differs_by_the_threshold():
    """In each plan two values at most threshold apart meet at the own anchor of either, and an own anchor is within 1."""
    rng = np.random.default_rng(2)
    for n in (10, 10**7, 10**10):
        for cover, (width, threshold) in zip(simhash.covers(tuple(simhash.segments(n, 4))), simhash.segments(n, 4)):
            a = rng.integers(0, 2**63, 300, dtype=np.int64)
            flips = [sum({1 << int(b) for b in rng.choice(width, rng.integers(0, threshold + 1), replace=False)}) for _ in a]
            b = (a.view(np.uint64) ^ (np.array(flips, dtype=np.uint64) << cover.shift)).view(np.int64)
            key, own, row = cover.anchors(a)
            homes = dict(zip(row[own].tolist(), key[own].tolist()))
            assert all((h ^ int(v >> int(cover.shift)) & int(cover.mask)).bit_count() <= 1 for h, v in zip(map(homes.get, range(300)), a.view(np.uint64).tolist()))
            there = {i: set() for i in range(300)}
            key, _, row = cover.anchors(b)
            for k, i in zip(key.tolist(), row.tolist()):
                there[i].add(k)
            assert all(homes[i] in there[i] for i in range(300))


def test_anchors_hold_few_rows_however_many_fingerprints():
    """From 1e4 to 1e11 fingerprints homes at an anchor stay below 16,384, and comparisons a fingerprint grow far less than tenfold a step."""
    for n in (10**k for k in range(4, 12)):
        plan = simhash.segments(n, 4)
        assert max(n / 2 ** (w - (4 if w >= 15 else 3)) for w, _ in plan) < 16_384
    rng = np.random.default_rng(6)
    for n in (3_000, 30_000):
        fps = rng.integers(-(2**63), 2**63, n, dtype=np.int64)
        key, own, _ = simhash._covered(fps, tuple(simhash.segments(n, 4)))
        assert len(key) <= 12 * n and np.unique(key[own], return_counts=True)[1].max() < n / 1024 * 3 + 20


def test_links_are_complete(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.concatenate([base] + [base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (40, n), dtype=np.uint64), axis=1) for n in (1, 2, 3, 4, 5, 6)])
    fps = {int(x.view(np.int64)): int(x) for x in np.unique(near)}
    order = sorted(fps)
    want = brute_components({i: fps[i] for i in order})
    for crowd, n in ((4096, 10), (5, 10), (4096, 10**7), (5, 10**7), (4096, 10**10)):
        nodes = spark.createDataFrame([(i,) for i in order], "fp long")
        got = {r["node"]: r["root"] for r in components.components(simhash.links(nodes, 4, crowd, simhash.segments(n, 4))).collect()}
        assert {i: got.get(i, i) for i in order} == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_awkward(spark):
    got = simhash.near_groups(docs_of(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    groups = {r["doc_id"]: r["component_id"] for r in got}
    assert groups[1] == groups[2] == groups[3] == 1 and groups[4] == groups[5] == groups[None] == 4
    kept = simhash.drop_near_copies(docs_of(spark, AWKWARD))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 7, 8, 9, 10]
    assert simhash.near_groups(docs_of(spark, [])).count() == 0
    unnamed = docs_of(spark, [(None, "x y", None), (None, "x y", None), (1, "z", None), (1, "z", None)])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.drop_near_copies(unnamed).collect()) == [(0, "x y"), (1, "z")]


# --- 5 weighted sampling


def test_fingerprints_query(spark, sf, texts):
    order = sorted(texts)
    got = {r["doc_id"]: r for r in queries.op5_fingerprints(spark, sf).collect()}
    assert sorted(got) == order
    for i, after in zip(order, order[1:] + order[:1]):
        n = len(texts[i])
        edited = texts[i][: n - n // 4] + texts[after][: n // 4]
        r = got[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == cws.as_text(cws.fingerprint(texts[i])) and r["edited_fingerprint"] == cws.as_text(cws.fingerprint(edited))
        assert r["near_next"] == pytest.approx(cws.likeness(cws.fingerprint(texts[i]), cws.fingerprint(texts[after])))
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.5 > 0.2 > np.mean([r["near_next"] for r in got.values()])


def test_many_ranges_pair_like_one(spark, docs, texts):
    small = [r for r in cws.with_next(docs.select("doc_id", "text"), per_bucket=17).collect()]
    assert len({r["bucket"] for r in small}) > 5 and sum(not r["guest"] for r in small) == len(texts)
    assert sum(r["guest"] for r in small) == len({r["bucket"] for r in small})


def test_collision_rate_is_jaccard():
    rng, errors = np.random.default_rng(3), []
    for _ in range(60):
        h = rng.integers(0, 2**63, 200, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = rng.integers(0, 5, 200), rng.integers(0, 5, 200)
        b[:120] = a[:120]
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        errors.append(cws.likeness(cws.sign(h[a > 0], a[a > 0].astype(float)), cws.sign(h[b > 0], b[b > 0].astype(float))) - want)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def test_fingerprints_awkward(spark):
    assert cws.compare_edited(docs_of(spark, AWKWARD)).count() == len(AWKWARD)
    assert cws.compare_edited(docs_of(spark, [])).count() == 0
    (one,) = cws.compare_edited(docs_of(spark, [(1, "abcd efgh", None)])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest() and one["near_next"] == 1


# --- 6 exact


def test_exact_awkward(spark):
    rows = AWKWARD + [(20, "\u00e9", "s"), (21, "e\u0301", "s")]
    got = exact_dedup.exact_groups(docs_of(spark, rows), salts=3).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["text_sha256"]): r for r in got}
    assert len({r["text_sha256"] for r in got}) == 9 == sum(r["kept"] for r in got)
    digest = hashlib.sha256(b"a b c d e f").hexdigest()
    assert by[None, digest]["keep_id"] == 5 and by[None, digest]["group_size"] == 3
    assert exact_dedup.exact_groups(docs_of(spark, [])).count() == 0
    kept = exact_dedup.drop_exact_copies(docs_of(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 7, 8, 9, 10, 20, 21]


def test_exact_runs_no_python(docs):
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 7 urls


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://Example.ORG/es/1?x=/a", "example.org", "/es/1", "example.org/es/", "block"),
    ("https://sub.example.org/en/12#t", "sub.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://sub.example.org/en/2", "sub.example.org", "/en/2", "org/", "allow"),
    ("https://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
    ("http://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"), ("http://a.com/de/x", "a.com", "/de/x", "com/de/", "block"),
    ("http://org?x", "org", "", None, None), ("x.org/es/", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    (r,) = url_filter.judge(spark.createDataFrame([(1, url, "x")], "page_id long, url string, rule string")).collect()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
    assert r["verdict"] == (verdict or ("block" if url_filter.score(host, path, url_filter.train()) >= 0.5 else "allow"))


def test_url_model_fits_and_generalises():
    model = url_filter.train()
    table_ = url_filter.url_table()
    assert np.mean([(url_filter.score(h, p, model) >= 0.5) == y for h, p, y in table_]) > 0.97
    assert url_filter.score("casino.other.net", "/free-bonus/slots", model) > 0.5 > url_filter.score("www.history.example.org", "/articles/rivers.html", model)


# --- 8 token files and 10 BPE


def test_token_files_query(spark, sf, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, {}
    for i in sorted(texts):
        ids = np.array([*t.encode(texts[i], add_special_tokens=False).ids, 2], dtype="<u4")
        want[i] = (start, len(ids), crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op8_token_files(spark, sf).collect()} == want


@pytest.mark.parametrize("planes", [4, 32])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000, 70_000])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    got, lengths = token_files.unpack_ids(token_files.pack_ids(ids, np.array([n, 0]), block=1000, planes=planes))
    assert np.array_equal(got, ids) and lengths.tolist() == [n, 0]


def test_token_files_awkward(spark):
    for rows in (AWKWARD, []):
        path = token_files.new_folder(shared_dir(spark), "t")
        token_files.write_token_files(docs_of(spark, rows), path, public_tokenizers.path("byte_bpe_50k.json"), per_shard=3, ids_per_file=10)
        got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
        assert len(got) == len(rows)
        assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
        assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query(spark, sf, texts, tiktoken_encoding):
    got = {r["doc_id"]: r for r in queries.op10_bpe(spark, sf).collect()}
    assert sorted(got) == sorted(texts)
    for i, t in texts.items():
        ids = np.array(tiktoken_encoding.encode_ordinary(t), dtype="<u4")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_on_random_texts(tiktoken_encoding):
    import random

    rng, some = random.Random(1), "abst 'sr ve'll  \n\t'td1２é½!?.　 \x1c漢😀m'\U0010ffff"
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", "a" * 3000 + "bc" * 2000, " " * 300, "'s's''s", "<|endoftext|>"]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for t, ids in zip(texts, bpe.encode(texts, path)):
        assert ids.tolist() == tiktoken_encoding.encode_ordinary(t)
        at = bpe.offsets(ids, path)
        assert bpe.decode(ids, at, path) == t.encode()
        assert at[-1] == len(t.encode()) and [t.encode()[a:b] for a, b in zip(at, at[1:])] == [tiktoken_encoding.decode_single_token_bytes(i) for i in ids]


def test_boundaries_cover_texts():
    for data, at in pretokenize.boundaries(["", "a", "it's  fine\n\n ok", "\U0010ffff"]):
        assert at[-1] == len(data) and at.tolist() == sorted({*at.tolist()} | {0})


def test_bpe_awkward(spark, tiktoken_encoding):
    got = bpe.encode_documents(docs_of(spark, AWKWARD), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = [(i, np.array(tiktoken_encoding.encode_ordinary(t or ""), dtype="<u4").tobytes()) for i, t, _ in AWKWARD]
    rows = got.collect()
    assert sorted([(r["doc_id"], bytes(r["ids"])) for r in rows], key=key) == sorted(want, key=key)
    assert all(r["decoded_sha256"] in {hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in AWKWARD} for r in rows)
    assert all(len(r["offsets"]) == 8 * (r["n_tokens"] + 1) for r in rows)
    assert bpe.encode_documents(docs_of(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_piece_table_starts_anew_when_full(monkeypatch, tiktoken_encoding):
    """A small table: full several times, its slots crowded, texts longer than a chunk; ids stay right."""
    from forecastlab.llm import piece_table

    for name, value in (("SLOT_BITS", 10), ("REMEMBERED", 600), ("CHUNK", 1 << 11)):
        monkeypatch.setattr(piece_table, name, value)
    piece_table._powers.cache_clear()
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    table_ = piece_table.PieceTable(lambda pieces: [bpe.merge(p, ranks) for p in pieces])
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{rng.integers(900)}" for _ in range(n)) for n in (1, 50, 3000, 0, 2000)] + ["y" * 5000 + " tail"]
    got = [x.tolist() for _ in range(2) for x in table_.encode(texts)]
    piece_table._powers.cache_clear()
    assert got == [tiktoken_encoding.encode_ordinary(t) for t in texts] * 2


# --- 9 quality


def test_quality_held_out(spark, sf):
    rows = queries.op9_quality(spark, "/root/testdata/sf0.01").collect()
    label = {r["doc_id"]: r["quality"] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert np.mean([p == y for p, y in held]) > 0.93


def test_quality_gradients():
    rng = np.random.default_rng(0)
    bags, y = [rng.normal(size=(n, quality.FEATURES)) for n in (1, 3, 2)], np.array([1.0, 0.0, 1.0])
    shapes = {"A": (quality.FEATURES, 4), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "a": (4,), "b": ()}
    w = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}
    x, at, sizes = np.concatenate(bags), np.array([0, 1, 4]), np.array([1, 3, 2])
    loss = lambda w: -np.mean(y * np.log(p := quality._forward(w, x, at, sizes)["p"]) + (1 - y) * np.log(1 - p))
    got = quality._gradients(w, x, at, sizes, y)
    for k in w:
        i = tuple(0 for _ in shapes[k])
        up, down = {n: v.copy() for n, v in w.items()}, {n: v.copy() for n, v in w.items()}
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert got[k][i] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-7)


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(5, 1), (7, 0), (None, 1), (4, None), (5, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        got = quality.score_quality(docs_of(spark, AWKWARD), some).collect()
        assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_quality(docs_of(spark, []), labels).count() == 0
    assert quality.keep_good(docs_of(spark, AWKWARD), labels.limit(0)).count() == len(AWKWARD)
