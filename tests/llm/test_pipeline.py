"""The pipeline's stages on odd tables, and run() against the stages done by brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from reelquery.llm import common, languages, line_dedup, mixing, ngram_join, pieces


def words(text):
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def brute_lines(rows):
    contents = defaultdict(set)
    first = {}
    for i, text, _, source in rows:
        for line in text.split("\n"):
            if line.strip(" "):
                contents[line].add(source)
                first[line] = min(first.get(line, i), i)
    out = []
    for i, text, lang, source in rows:
        lines = text.split("\n")
        kept = [x for x in lines if len(contents[x]) < line_dedup.MIN_SITES or first[x] == i]
        if len(kept) == len(lines) or "\n".join(kept).strip(" "):
            out.append((i, "\n".join(kept), lang, source))
    return out


def brute_near(rows):
    sets = []
    for i, text, *_ in rows:
        w = words(text)
        sets.append((i, {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()))
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 2 * len(a & b) >= len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [r for r in rows if root(r[0]) == r[0]]


def brute_mix(rows):
    size = defaultdict(int)
    for _, text, _, source in rows:
        size[source] += len(text.encode())
    weight = {s: b**mixing.ALPHA for s, b in size.items()}
    out = Counter()
    for i, _, _, source in rows:
        rate = weight[source] / sum(weight.values()) * sum(size.values()) / size[source]
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, c = 0, math.exp(-rate)
        p = c
        while u >= c:
            k += 1
            p *= rate / k
            c += p
        out[i] = k
    return +out


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_run_is_the_stages_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = languages.fit(docs)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.orderBy("doc_id").collect()]
    kept = []
    for r in rows:
        shares, n, _ = languages.mixtures(model, [r[1]])
        if n[0] and shares[0, -1] < languages.MAX_UNKNOWN:
            kept.append(r)
    assert len(kept) >= 0.99 * len(rows)
    left = brute_near(brute_lines(kept))
    want = brute_mix(left)
    texts = {r[0]: r[1] for r in left}
    got = pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in got) == want
    assert all(r.decoded == texts[r.doc_id] for r in got)
    codec = pieces.codec()
    assert all(codec.encode([texts[r.doc_id]])[0].tolist() == r.ids for r in got)


def test_stages_keep_columns_and_take_odd_and_no_documents(spark, odd, empty):
    assert len(pipeline.STAGES) == 5
    for docs in (odd, empty):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != "tokens":
                assert out.columns == docs.columns
                assert name == "mix_sources" or out.count() <= docs.count()
            else:
                assert out.count() == docs.count()
    near = pipeline.near_duplicates(spark, odd, "")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near.collect()) == [(False, i) for i in (1, 2, 3, 4, 5, 6, 7, 7)] + [(True, 0)]


def test_a_family_of_near_copies_has_few_edges(spark, docs, monkeypatch):
    r = random.Random(7)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(r.choice(base) if r.random() < 0.02 else x for x in base), "en", "s") for i in range(200)]
    # 500 has two texts, by which 400 and 450 are connected.
    rows += [(500, "a b c d e f", "en", "s"), (400, "a b c d e f", "en", "s"), (500, "u v w x y z", "en", "s"), (450, "u v w x y z", "en", "s")]
    written = Counter()
    real = common.spool

    def counting(df, name):
        out = real(df, name)
        written[name] = max(written[name], out.count())
        return out

    for module in (common, ngram_join):
        monkeypatch.setattr(module, "spool", counting)
    left = pipeline.near_duplicates(spark, docs(rows), "").collect()
    assert {r.doc_id for r in left} == {0, 400}
    # All pairs would be 39,800 rows.
    assert 0 < written["edges"] <= 4 * len(rows)
