"""The pipeline's stages, each held against its own input by brute force."""

import hashlib
import re
from itertools import combinations

import numpy as np
import public_tokenizers

import corpus_pipeline
from forecastlab.llm import mixing, quality
from forecastlab.llm.common import DOCUMENT_COLUMNS, table


def kept_of_near_copies(texts):
    """The smallest doc_id of each component of texts whose sets of five-word shingles are 0.8 alike, by comparing all with all."""
    sets = {}
    for i, t in texts.items():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in texts}

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, j in combinations(sorted(texts), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return sorted({top(i) for i in texts})


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    steps = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], sf).write.parquet(f"{tmp_path}/{k}")
        steps.append(spark.read.parquet(f"{tmp_path}/{k}"))
    rows = [[r.asDict() for r in s.collect()] for s in steps]
    assert all(s.columns == DOCUMENT_COLUMNS for s in steps[:-1])
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, table(spark, sf, "labels")).collect()}
    assert {r["doc_id"] for r in rows[1]} == {i for i, s in scores.items() if s >= 0.3}
    best = {}
    for r in rows[1]:
        best[r["text"] or ""] = max(best.get(r["text"] or "", -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(best.values())
    assert sorted(r["doc_id"] for r in rows[3]) == kept_of_near_copies({r["doc_id"]: r["text"] or "" for r in rows[2]})
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_counts(steps[3]).collect() if r["taken"]}
    assert {r["doc_id"] for r in rows[4]} == set(taken)
    import tiktoken

    from forecastlab.llm.bpe import load_ranks

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((r["doc_id"], hashlib.sha256(np.array(encoding.encode_ordinary(r["text"] or ""), dtype="<u4").tobytes()).hexdigest()) for r in rows[4])
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in rows[5]) == want


def test_stages_on_awkward_rows(spark, sf):
    from .test_corpus_operators import AWKWARD, docs_of

    for rows in (AWKWARD, []):
        docs = docs_of(spark, rows)
        texts = [t or "" for _, t, _ in rows]
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            got = out.collect()
            assert name == "byte-level BPE" or out.columns == DOCUMENT_COLUMNS
            if name == "quality classifier":
                model = quality.learn(table(spark, sf, "documents"), table(spark, sf, "labels"))
                good = [t for t in texts if model.scores([quality.passages(t)])[0] >= 0.3]
                assert sorted(r["text"] or "" for r in got) == sorted(good)
            elif name == "exact dedup":
                assert sorted(r["text"] or "" for r in got) == sorted(set(texts))
            elif name == "SimHash near-dedup":
                assert len(got) == len(kept_of_near_copies(dict(enumerate(sorted(set(texts))))))
            elif name == "mixing sources":
                assert {r["text"] for r in got if r["text"] in texts} <= set(texts) and all((r["text"] or "").strip() for r in got)
            else:
                assert sorted(r["doc_id"] is None for r in got) == sorted(i is None for i, _, _ in rows)
                assert all(r["n_tokens"] >= 0 and len(r["decoded_sha256"]) == 64 for r in got)


def test_run_is_registered(spark, sf):
    import __spark_entry__

    assert {"pipeline", *[f"op{n}" for n in range(1, 11)]} <= {re.sub("_.*", "", n) for n in __spark_entry__.queries()}
