"""The near-duplicate stage: exact Jaccard similarity of five-word shingles."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from forecastlab.llm import near_copies

from .test_corpus_operators import docs_of


def similarity(a, b):
    """The Jaccard similarity of five-word shingles, by plain sets."""
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def edited(words, n, rng):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"e{rng.randrange(10**9)}"
    return words


def test_near_stage_drops_copies_of_eight_tenths(spark, sf):
    """Of 40 pairs with similarities of 0.8 to 0.95 at most 2 stay, and none with less goes; 4 bits of 4-word shingles leave most."""
    rng, rows = random.Random(3), []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows += [(2 * i, " ".join(words), "s"), (2 * i + 1, " ".join(edited(words, 3 + i % 5, rng)), "s")]
    for i in range(40, 60):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows += [(2 * i, " ".join(words), "s"), (2 * i + 1, " ".join(edited(words, 14, rng)), "s")]
    near = {i for i in range(60) if similarity(rows[2 * i][1], rows[2 * i + 1][1]) >= 0.8}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs_of(spark, rows), sf).collect()}
    assert near == set(range(40)) and {2 * i for i in range(60)} <= kept
    assert len([i for i in near if 2 * i + 1 in kept]) <= 2 and all(2 * i + 1 in kept for i in range(40, 60))


@pytest.mark.parametrize("crowd", [4096, 5])
def test_near_candidates_are_whole_and_bounded(spark, crowd):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (6, 2), dtype=np.uint64)
    fps = [b.copy() for b in base]
    for b in base:
        for n in range(1, 12):
            f = b.copy()
            for bit in rng.choice(128, n, replace=False):
                f[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            fps.append(f)
    rows = [(i, int(f[0].view(np.int64)), int(f[1].view(np.int64)), 100, i, True) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "node long, low long, high long, size int, label long, asks boolean")
    got = {(min(r["guest"], r["home"]), max(r["guest"], r["home"])) for r in near_copies.candidates(nodes, None, crowd).collect()}
    apart = {(i, j): int(np.bitwise_count(fps[i] ^ fps[j]).sum()) for i, j in combinations(range(len(fps)), 2)}
    assert {p for p, n in apart.items() if n <= 15} <= got <= {p for p, n in apart.items() if n <= near_copies.RADIUS}
    some = near_copies.candidates(nodes, 2, crowd).collect()
    assert {(min(r["guest"], r["home"]), max(r["guest"], r["home"])) for r in some} < got and any(r["besides"] for r in some)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_confirmed_pairs_are_those_of_eight_tenths(spark, hot):
    """Hot homes are dealt out to several tasks, and no pair is lost."""
    rng, texts = random.Random(8), []
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(edited(base, n % 12, rng)) for n in range(24)]
    rows = [(i, near_copies.digests(near_copies.shingles(t))[:, 0].tobytes()) for i, t in enumerate(texts)]
    sets = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "node long, hashes binary")
    pairs = spark.createDataFrame(list(combinations(range(24), 2)), "guest long, home long")
    got = sorted((r["guest"], r["home"]) for r in near_copies.confirmed(pairs, sets, hot).collect())
    assert got == [(i, j) for i, j in combinations(range(24), 2) if similarity(texts[i], texts[j]) >= 0.8]


def test_near_copies_of_a_crowd_leave_one(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(words, 2, rng)), "s") for i in range(120)]
    assert [r["doc_id"] for r in near_copies.drop_near_copies(docs_of(spark, rows)).collect()] == [0]
    assert near_copies.drop_near_copies(docs_of(spark, [])).count() == 0


def test_near_components_equal_brute_force_in_crowds(spark):
    """A crowd that shares a passage of 60 to 79% of its words and links to nothing, a loose group, and a tight one: all as by comparing all with all."""
    from .test_corpus_pipeline import kept_of_near_copies

    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, base = [word() for _ in range(120)], [word() for _ in range(150)]
    texts = [" ".join(passage + [word() for _ in range(rng.randint(32, 80))]) for _ in range(60)]
    texts += [" ".join(edited(base, rng.randint(0, 4), rng)) for _ in range(60)] + [" ".join([word() for _ in range(100)]) for _ in range(20)] + ["", "one two", "One  TWO"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs_of(spark, rows)).collect())
    assert got == kept_of_near_copies(dict(enumerate(texts)))
