"""Whitening, cross-tokenizer alignment and packing against brute-force versions, on the small tables and on awkward rows."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecastlab.llm import packing, queries, token_align, whitening
from forecastlab.llm.common import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, source string, row long, pair long, n long, links long, place long, bucket int, ids string"
LONG = "word " * 20_000 + "end"
TEXTS = [
    "the cat sat on the mat", "naïve ☃ 日本𝄞 <s> a  b\n\tc\x00d", "<|endoftext|> plain <unk>", " leading", "trailing ", "  ", "\n\n  x\n y", "a▁b", "x  y z 　 w", "été 漢字漢字 😀 it's 12345",
    "", None, "the cat sat on the mat", LONG, "𝄞𝄞𝄞 𝄞", "don't  stop --- now!!", "é combining", "\x1c \x85 odd  spaces ​ z",
]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3, 4, 5, 6, "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "the cat"), (3, " leading"), (3, " leading"), (3, "other text of one id")]
    return docs_of(spark, rows), rows


# --- 11 whitening


def brute_whitening(vectors):
    """n, S, exact deviations and the covariance of x, by Python's integers."""
    x = [[floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(dim)]
    deviations = [sum((n * c - t) ** 2 for c, t in zip(r, s)) for r in x]
    v = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3) for j in range(dim)] for i in range(dim)]
    return x, n, s, deviations, v


def check_whitening(rows, vectors, keys, most=8):
    x, n, s, deviations, v = brute_whitening(vectors)
    dim = len(s)
    value, direction = np.linalg.eigh(np.array(v, dtype=float))
    value, direction = value[::-1], direction[:, ::-1]
    trace = float(sum(v[i][i] for i in range(dim)))
    k = min(most, dim)
    assert len(rows) == k * n
    want = Counter((key, str(d)) for key, d in zip(keys, deviations) for _ in range(k))
    assert Counter((r["vec_id"], r["deviation_exact"]) for r in rows) == want
    assert all(r["n"] == n and r["deviation"] == (int(r["deviation_exact"]) if int(r["deviation_exact"]) < 2**63 else None) for r in rows)
    got = defaultdict(dict)
    for r in rows:
        got[r["vec_id"]][r["component"]] = r["whitened"]
        assert r["explained"] == pytest.approx(value[r["component"] - 1] / trace, rel=1e-4, abs=1e-12)
    if len(set(keys)) == n:
        for c in range(k):
            if value[c] > 1e-9 * value[0]:
                mine = np.array([got[key][c + 1] for key in keys])
                want_c = np.array([[float(Fraction(n * a - t, n)) for a, t in zip(r, s)] for r in x]) @ direction[:, c] / np.sqrt(value[c])
                assert np.allclose(mine, want_c, atol=1e-6) or np.allclose(mine, -want_c, atol=1e-6)
    assert len({r["identity_error"] for r in rows}) == 1


def test_whitening_equals_brute_force(spark, sf):
    rows = queries.op11_whitening(spark, sf).collect()
    data = table(spark, sf, "embeddings").collect()
    check_whitening(rows, [r["embedding"] for r in data], [r["vec_id"] for r in data])
    assert rows[0]["identity_error"] < 1e-4
    white = defaultdict(dict)
    for r in rows:
        white[r["vec_id"]][r["component"]] = r["whitened"]
    w = np.array([[d[c] for c in range(1, 9)] for d in white.values()])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(8)).max() == pytest.approx(rows[0]["identity_error"], abs=1e-12)


@pytest.mark.parametrize("rows, dim", [(1, 3), (63, 2), (64, 5), (65, 1), (1000, 4), (20_000, 3)])
def test_cross_products_are_exact(rows, dim):
    x = np.random.default_rng(rows).integers(-(2**44) if dim == 3 else -50, 2**44 if dim == 3 else 70, (rows, dim))
    x[:, -1] = 7  # no planes at all
    sums, products = whitening.cross_products(x)
    o = x.astype(object)
    assert sums.tolist() == o.sum(axis=0).tolist() and products.tolist() == (o.T @ o).tolist()


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, v string, w string, key int")


def test_whitening_awkward(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(np.float32(c)) for c in rng.standard_normal(3)]) for i in range(40)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]), (93, [float("inf"), 0.0, 1.0]), (94, [float("-inf"), 0.0, 1.0]), (95, []), (96, [1.0, 2.0])]
    rows = whitening.whiten(vectors_of(spark, good + bad)).collect()
    check_whitening(rows, [v for _, v in good], [i for i, _ in good])
    repeated = [*good, *good, (None, [0.5, 0.25, -0.125])]
    check_whitening(whitening.whiten(vectors_of(spark, repeated)).collect(), [v for _, v in repeated], [i for i, _ in repeated])
    huge = [(i, [c * 1e9 for c in v]) for i, v in good]
    check_whitening(whitening.whiten(vectors_of(spark, huge, "double")).collect(), [v for _, v in huge], [i for i, _ in huge])
    assert whitening.whiten(vectors_of(spark, bad[:5])).count() == 0
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    flat = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(flat) == 4 and all(r["whitened"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in flat)
    line = whitening.whiten(vectors_of(spark, [(i, [float(i), 2.0 * i, -1.0 * i]) for i in range(9)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line) and line[0]["identity_error"] < 1e-4


# --- 12 alignment


@pytest.fixture(scope="module")
def tokenizers_of():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def whole_tokens(tokenizers, text):
    """Ids and bytes of each token of both tokenizers, each text by itself; none where the bytes differ."""
    a, b = tokenizers
    if not text:
        return [], []
    letters = {c: k for k, c in token_align.LETTERS.items()}
    at = [(i, bytes(letters[c] for c in t)) for e in [a.encode(" " + text, add_special_tokens=False)] for i, t in zip(e.ids, e.tokens)]
    bt = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (at, bt) if b"".join(t for _, t in at) == whole == b"".join(t for _, t in bt) else ([], [])


def brute_alignment(tokenizers, rows):
    found, counts = [], Counter()
    for doc, text in rows:
        at, bt = whole_tokens(tokenizers, text)
        owner_a = [k for k, (_, t) in enumerate(at) for _ in t]
        owner_b = [k for k, (_, t) in enumerate(bt) for _ in t]
        links = sorted(set(zip(owner_a, owner_b)))
        groups, x, y = [], 0, 0
        for i in range(len(owner_a)):
            if i + 1 == len(owner_a) or (owner_a[i] != owner_a[i + 1] and owner_b[i] != owner_b[i + 1]):
                groups.append(",".join(str(t[0]) for t in at[x : owner_a[i] + 1]) + "|" + ",".join(str(t[0]) for t in bt[y : owner_b[i] + 1]))
                x, y = owner_a[i] + 1, owner_b[i] + 1
        pairs = [(at[i][0], bt[j][0]) for i, j in links]
        counts.update(pairs)
        found.append((doc, len(at), len(bt), groups, pairs))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return Counter(
        (doc, a, b, len(groups), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc, a, b, groups, pairs in found
    )


def as_counter(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_alignment_equals_brute_force(spark, sf, tokenizers_of):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    assert as_counter(queries.op12_alignment(spark, sf)) == brute_alignment(tokenizers_of, rows)


def test_alignment_awkward(spark, awkward, tokenizers_of):
    docs, rows = awkward
    want = brute_alignment(tokenizers_of, rows)
    assert as_counter(token_align.alignment_report(docs, A, B)) == want
    assert as_counter(token_align.alignment_report(docs, A, B, few=0)) == want  # the way without a broadcast of all pairs
    assert token_align.alignment_report(docs.limit(0), A, B).count() == 0
    out = {r["doc_id"]: r for r in token_align.alignments(docs.filter("doc_id = 1"), A, B).collect()}[1]
    at, bt = whole_tokens(tokenizers_of, TEXTS[1])
    assert out["a_ids"] == [i for i, _ in at] and out["b_ids"] == [i for i, _ in bt]
    assert out["a_ends"] == np.cumsum([len(t) for _, t in at]).tolist() and out["b_ends"] == np.cumsum([len(t) for _, t in bt]).tolist()


def test_segments_are_cut_before_plain_spaces():
    """Quick and careful ways of cutting agree: before each space that follows no white space and has a character after it."""
    aligner, rng = token_align.Aligner.__new__(token_align.Aligner), random.Random(7)
    aligner.cut = True
    for _ in range(3000):
        text = " " + "".join(rng.choices("ab\n\t\u00a0\u180e\u2581é ", weights=[9, 9, 1, 1, 1, 1, 1, 2, 6], k=rng.randint(1, 14)))
        ends = [i for i in range(1, len(text) - 1) if text[i] == " " and not text[i - 1].isspace() and text[i - 1] != "\u180e"]
        assert aligner.segments(text) == [text[x:y] for x, y in zip([0, *ends], [*ends, len(text)])]


def test_segments_encode_as_whole_texts(tokenizers_of):
    """Random strings of letters, spaces of many kinds and marks: segments give the ids that whole texts do."""
    rng = np.random.default_rng(8)
    letters = list("ab1'.s,é漢😀́") + [" ", " ", "  ", "\n", "\t", " ", " ", "\u0085", "\x1c", "▁", "​", "<s>", "'s", "᠎"]
    known = token_align.Aligner(A, B)
    texts = ["".join(rng.choice(letters, rng.integers(1, 30))) for _ in range(4000)]
    entries, of = known.align(texts)
    for k, text in enumerate(texts):
        at, bt = whole_tokens(tokenizers_of, text)
        assert known.a_ids.of(entries[of == k])[0].tolist() == [i for i, _ in at], repr(text)
        assert known.b_ids.of(entries[of == k])[0].tolist() == [i for i, _ in bt], repr(text)


# --- 13 packing


def check_packing(pieces, rows, length=2048, end=1):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A)
    want = Counter()
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")
        want[doc, len(ids), crc32(ids.tobytes())] += 1
    total = sum(n * k for (_, n, _), k in want.items())
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    used = []
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at and n > 0
            at += n
        used.append(at)
    assert sum(used) == total and max(used) <= length
    assert all(u & (u - 1) == 0 for u in used) and used.count(length) == total // length  # no padding at all
    texts = defaultdict(list)
    for p in pieces:
        texts[p["doc_id"], p["doc_tokens"]].append(p)
    got = Counter()
    for (doc, n), ps in texts.items():
        at = defaultdict(list)  # of rows that repeat a doc_id, each piece follows one that ends where it starts
        for p in sorted(ps, key=lambda p: (p["sequence_id"], p["offset"])):
            before = at[p["start"]].pop() if p["start"] else b""
            assert p["length"] * 4 == len(p["ids"])
            whole = before + bytes(p["ids"])
            if len(whole) == 4 * n:
                got[doc, n, crc32(whole)] += 1
            else:
                at[len(whole) // 4].append(whole)
        assert not any(at.values())
    assert got == want


def test_packing_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    pieces = packing.pack_documents(docs, A).collect()
    check_packing(pieces, rows)
    digests = Counter(tuple(r) for r in queries.op13_packing(spark, sf).collect())
    assert digests == Counter((p["doc_id"], p["start"], p["length"], crc32(p["ids"]), p["doc_tokens"], p["sequence_id"], p["offset"]) for p in pieces)


@pytest.mark.parametrize("per_bucket", [2_000, 3])
def test_packing_awkward(spark, awkward, per_bucket):
    docs, rows = awkward
    check_packing(packing.pack_documents(docs, A, per_bucket=per_bucket).collect(), rows)
    assert packing.pack_documents(docs.limit(0), A).count() == 0
    same = [(1, "one text of all rows")] * 300
    check_packing(packing.pack_documents(docs_of(spark, same), A, per_bucket=10).collect(), same)


def test_packing_one_document_of_one_token(spark):
    pieces = packing.pack_documents(docs_of(spark, [(7, None)]), A).collect()
    assert [(p["doc_id"], p["start"], p["length"], p["doc_tokens"], p["sequence_id"], p["offset"]) for p in pieces] == [(7, 0, 1, 1, 0, 0)]


def test_equal_rows_are_spread(spark):
    same = docs_of(spark, [(1, "one text of all rows")] * 300)
    places = packing.encode_places(same, A).groupBy("place").count()
    assert places.count() == 64 and places.agg(F.max("count")).first()[0] <= 20


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2), (1, 5), (2, 1)])
def test_hilbert_curve_visits_every_cell_by_single_steps(dims, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(side**dims))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_neighbours_share_words(spark):
    """Along the curve, documents of one vocabulary come together more than by chance."""
    rng, rows = np.random.default_rng(2), []
    words = [[f"{w}{t}" for w in ("alpha", "beta", "gamma", "delta", "omega", "sigma", "theta", "kappa")] for t in ("ka", "mo", "ri", "tu")]
    for i in range(400):
        rows.append((i, " ".join(rng.choice(words[i % 4], 60))))
    order = [r["doc_id"] % 4 for r in packing.encode_places(docs_of(spark, rows), A).orderBy("place").collect()]
    assert sum(a == b for a, b in zip(order, order[1:])) > 0.5 * len(order)


def test_empty_schema_matches(spark):
    empty, full = (whitening.whiten(vectors_of(spark, r)).schema for r in ([], [(1, [1.0, 2.0]), (2, [0.0, 2.5])]))
    assert [(f.name, f.dataType) for f in empty] == [(f.name, f.dataType) for f in full] and isinstance(full["deviation"].dataType, T.LongType)
