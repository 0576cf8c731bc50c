"""The whole queries of the URL filter and the quality classifier against plain versions that share none of their code."""

import math
from zlib import crc32

import numpy as np
import pytest

from forecastlab.llm import quality, queries, url_filter
from forecastlab.llm.common import table

RULES = [("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("org", "/", "allow")]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest, host, path = url[url.index("://") + 3 :], "", ""
    while rest and rest[0] not in "/?#":
        host, rest = host + (rest[0].lower() if rest[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else rest[0]), rest[1:]
    while rest and rest[0] not in "?#":
        path, rest = path + rest[0], rest[1:]
    return host, path


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host[-len(h) - 1 :] == "." + h) and path[: len(p)] == p]
    return max(fits)[1:] if fits else (None, None)


def plain_score(host, path, weights, bias):
    places = set()
    for kind, part in (("h^", host), ("p^", path)):
        whole = "^" + part + "$"
        for n in (3, 4, 5):
            for i in range(len(whole)):
                if i + n <= len(whole):
                    places.add(crc32((kind + whole[i : i + n]).encode()) % 16384)
    total = 0.0
    for k in places:
        total += weights[k]
    return 1 / (1 + math.exp(-(total / math.sqrt(max(1, len(places))) + bias)))


def check_urls(got, urls):
    weights, bias = url_filter.train()
    assert sorted(r["page_id"] for r in got) == sorted(i for i, _ in urls)
    by_id = dict(urls)
    for r in got:
        host, path = plain_parts(by_id[r["page_id"]])
        rule, says = plain_rule(host, path)
        p = plain_score(host, path, weights, bias)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["block_score"] == pytest.approx(p, abs=1e-9)
        if says or abs(p - 0.5) > 1e-6:
            assert r["verdict"] == (says or ("block" if p >= 0.5 else "allow"))


def test_url_query_equals_a_plain_version(spark, sf):
    urls = [(r["page_id"], r["url"]) for r in table(spark, sf, "pages").select("page_id", "url").collect()]
    check_urls(queries.op7_url_filter(spark, sf).collect(), urls)


def test_urls_awkward_empty_and_repeated(spark):
    schema = "page_id long, url string, host string, rule string"
    urls = [None, "", "no scheme", "://", "http://", "HTTP://Sub.Example.ORG/es/1?q=/x#y", "http://example.org/en/12", "http://example.orgx/es/", "http://x.com", "http://x.com/de/", "http://x.com/fr/a", "a://b://c/d", "http://ÄÖ.de/ü#f", "http://h?x=/de/", "http://" + "a" * 50_000 + ".com/de/" + "b" * 50_000]
    rows = [(i, u) for i, u in enumerate(urls)]
    check_urls(url_filter.judge(spark.createDataFrame([(i, u, "no", "no") for i, u in rows], schema)).collect(), rows)
    twice = spark.createDataFrame([(7, "http://x.com/de/", "a", "b")] * 3, schema)
    assert [(r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge(twice).collect()] == [(7, "com/de/", "block")] * 3
    assert url_filter.judge(twice.limit(0)).count() == 0


@pytest.mark.parametrize("what", ["hosts", "paths"])
def test_url_model_on_hosts_or_paths_that_it_has_not_seen(what):
    """A tenth of each kind's hosts, or paths, left out in turn. With both unseen it is hardly better than chance: see the README."""
    rows, right, at = url_filter.url_table(), [], 0 if what == "hosts" else 1
    kinds = [[(p.partition("?")[0]) for p in names] for names in ((url_filter.GOOD_HOSTS, url_filter.BAD_HOSTS) if what == "hosts" else (url_filter.GOOD_PATHS, url_filter.BAD_PATHS))]
    for k in range(10):
        out = {kinds[0][k], kinds[1][k]}
        model = url_filter.fit([r for r in rows if r[at] not in out])
        right += [(url_filter.score(h, p, model) >= 0.5) == bool(y) for h, p, y in rows if (h, p)[at] in out]
    assert len(right) == 200 and np.mean(right) > 0.9


def test_url_table_of_a_user(spark):
    mine = [(f"good{i}.example", "/read/me", 0) for i in range(5)] + [(f"bad{i}.example", "/zzz/qqq", 1) for i in range(5)]
    pages = spark.createDataFrame([(1, "http://good9.example/read/this"), (2, "http://bad9.example/zzz/q")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, [], labelled=mine).collect()} == {1: "allow", 2: "block"}


SETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t\x0b\x0c", ".", ",", "!?", "#$%&*@^~+=", "|\\/<>[]{}_", "\"'`:;()-"]


def plain_features(text):
    """A list of features a passage of 64 words, byte by byte. Bytes before the first word belong to the first passage."""
    data, space = text.encode(), b" \n\r\t\x0b\x0c"
    begins = [i for i, b in enumerate(data) if b not in space and (i == 0 or data[i - 1] in space)]
    if not begins:
        return [[0.0] * 67]
    edges, out = [0, *begins[64::64], len(data)], []
    for at, end in zip(edges, edges[1:]):
        counts, pairs = [0] * 13, [0] * 48
        for i in range(at, end):
            kind = next((k for k, chars in enumerate(SETS) if data[i] < 128 and chr(data[i]) in chars), 11 if data[i] >= 128 else 12)
            counts[kind] += 1
            if i + 1 < len(data):
                pairs[(data[i : i + 1].lower()[0] * 37 + data[i + 1 : i + 2].lower()[0]) % 48] += 1
        words = [w.decode() for w in data[at:end].split()]
        m, size = len(words), end - at
        more = [len(set(words)) / m, sum(a == b for a, b in zip(words, words[1:])) / m, min(size / m, 40) / 10, min(max(len(w) for w in words), 60) / 20, m / 64, sum(w.isupper() for w in words) / m]
        out.append([4 * c / size for c in counts] + [math.sqrt(c / size) for c in pairs] + more)
    return out


def plain_quality(text, model):
    """Gated attention over the passages of one text, by loops."""
    w, hs, es = model.weights, [], []
    for row in plain_features(text):
        x = [(v - m) / s for v, m, s in zip(row, model.mean.tolist(), model.scale.tolist())]
        h = [math.tanh(sum(a * b for a, b in zip(x, w["A"][:, j].tolist())) + w["a"][j]) for j in range(w["A"].shape[1])]
        gates = [math.tanh(sum(a * b for a, b in zip(h, w["V"][:, j].tolist()))) / (1 + math.exp(-sum(a * b for a, b in zip(h, w["U"][:, j].tolist())))) for j in range(w["V"].shape[1])]
        hs.append(h)
        es.append(sum(g * b for g, b in zip(gates, w["w"].tolist())))
    total = sum(math.exp(e - max(es)) for e in es)
    attention = [math.exp(e - max(es)) / total for e in es]
    z = [sum(a * h[j] for a, h in zip(attention, hs)) for j in range(len(hs[0]))]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(z, w["c"].tolist())) + float(w["b"])))))


def test_quality_query_equals_a_plain_version(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.learn(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = queries.op9_quality(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert r["score"] == pytest.approx(plain_quality(texts[r["doc_id"]], model), abs=1e-5) and r["predicted"] == int(r["score"] >= 0.3)


def test_quality_scores_of_awkward_texts(spark):
    rows = [(1, "good words here"), (2, None), (3, ""), (4, " \n\t "), (5, "x" * 20_000), (6, "Äß 漢字 \u00a0 é " * 200), (7, "a b c " * 100), (7, "a b c " * 100), (8, "  leading"), (None, "null id")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1), (7, 0), (6, 0)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    got = sorted(((r["doc_id"] or 0, round(r["score"], 6)) for r in quality.score_quality(docs, labels).collect()))
    want = sorted((i or 0, plain_quality(t or "", model)) for i, t in rows)
    assert len(got) == len(want) and all(a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-5) for a, b in zip(got, want))
