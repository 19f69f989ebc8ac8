"""The queries that SQL can't express, on the smallest tables, against brute force."""

from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from plain import plain_difference, plain_digest

from reelquery.llm import digests, languages, pieces, sharding
from reelquery.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_all_are_here():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(QUERIES) - set(ORACLES) == {"op2_language_mixtures", "op3_shards", "op4_near_duplicates", "op6_digests", "op8_sentencepiece"}


def test_op2(spark, texts):
    model = languages.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op2_language_mixtures"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        # EM without screening, one text at a time, from the whole set down to what the result names.
        bucket, begins, n = languages.grams([texts[i].text])
        ll = np.stack([np.add.reduceat(row[bucket], begins, dtype=np.float64) for row in model.logp], axis=1)
        names = [*model.languages, None]
        members = [names.index(x) for x in r.languages] + ([len(names) - 1] if r.unknown > 0 else [])
        lik = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -60))
        start = np.zeros(len(names))
        start[members] = 1 / len(members)
        shares, value = languages.em(lik, n, start[None])
        assert shares[0, members[0]] == pytest.approx(r.shares[0] if r.languages else r.unknown, abs=0.05)
        single = np.log(lik).sum(0).max()
        if len(members) > 1:
            assert value[0] - single > languages.PENALTY * np.log(n[0] + 1) * 0.9
    assert np.mean([r.languages[:1] == [texts[i].lang] for i, r in got.items()]) > 0.97


def test_op3(spark, texts):
    got = QUERIES["op3_shards"](spark, SF).collect()
    groups = defaultdict(set)
    sums = np.zeros(sharding.SHARDS, np.int64)
    for r in got:
        groups[texts[r.doc_id].text].add(r.shard)
        assert r.bytes == len(texts[r.doc_id].text.encode())
        sums[r.shard] += r.bytes
    assert len(got) == len(texts) and all(len(s) == 1 for s in groups.values())
    sizes = defaultdict(int)
    for t in texts.values():
        sizes[t.text] += len(t.text.encode())
    greedy = np.zeros(sharding.SHARDS, np.int64)
    for size in sorted(sizes.values(), reverse=True):
        greedy[greedy.argmin()] += size
    assert sums.max() - sums.min() <= greedy.max() - greedy.min()


def test_op4(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {tuple(sorted((rows[i].vec_id, rows[j].vec_id))) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)))}
    links = defaultdict(int)
    for p in want:
        for i in p:
            links[i] += 1
    got = {r.vec_id: r.links for r in QUERIES["op4_near_duplicates"](spark, SF).collect()}
    assert set(got) == {r.vec_id for r in rows}
    assert all(n <= links[i] for i, n in got.items()) and sum(got.values()) >= 0.9 * sum(links.values())


def test_op6(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op6_digests"](spark, SF).collect()}
    counts = {i: np.array(plain_digest(t.text)) for i, t in texts.items()}
    totals = defaultdict(lambda: np.zeros(digests.BUCKETS, np.int64))
    for i, t in texts.items():
        totals[t.lang] += counts[i]
    for i, t in texts.items():
        want = digests.to_text(*digests.encode(counts[i][None], np.array([len(t.text.encode())])))[0]
        profile = digests.to_text(*digests.encode(totals[t.lang][None], np.array([1])))[0]
        assert (got[i].digest, got[i].profile_score) == (want, plain_difference(want, want[:2] + profile[2:]))


def test_op8(spark, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in QUERIES["op8_sentencepiece"](spark, SF).collect():
        assert r.ids == sp.encode(texts[r.doc_id].text) and r.decoded == texts[r.doc_id].text
