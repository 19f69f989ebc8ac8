"""Language mixtures, digests, SentencePiece, the n-gram join and NN-descent."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from plain import plain_difference, plain_digest
from pyspark.sql import functions as F

from reelquery.llm import digests, languages, ngram_join, nn_descent, pieces
from reelquery.llm.common import components

WORDS = {"aa": ["the", "this", "then", "that", "other", "thing"], "bb": ["kozu", "zoku", "kuzo", "okuz", "uzok", "zuko"]}


def labelled(docs, n=60):
    r = random.Random(0)
    return docs([(i, " ".join(r.choices(WORDS[lang], k=30)), lang, "s") for i, lang in enumerate(["aa", "bb"] * (n // 2))])


@pytest.fixture(scope="module")
def model(docs):
    return languages.fit(labelled(docs))


def test_mixtures(model, docs):
    r = random.Random(1)
    pick = lambda lang, k: " ".join(r.choices(WORDS[lang], k=k))
    texts = [pick("aa", 40), pick("bb", 40), pick("aa", 60) + " " + pick("bb", 20), "qqqwx xxxyp vvvq wwwj pppx", "12 34 ##"]
    out = {x.doc_id: x for x in languages.infer(docs([(i, t, None, "s") for i, t in enumerate(texts)]), model).collect()}
    assert out[0].languages == ["aa"] and out[1].languages == ["bb"] and out[0].shares == [1.0]
    assert out[2].languages == ["aa", "bb"] and out[2].shares[0] == pytest.approx(0.75, abs=0.03)
    assert not out[3].accepted and out[3].unknown > 0.9
    assert not out[4].accepted and out[4].n_words == 0


def test_fit_takes_the_smallest_hashes(spark, docs):
    """Against ranking all documents; of more languages than asked for, the commonest."""
    rows = [(i % 700, f"{'ab'[i % 2]}{i % 700} word", f"l{i % 3}" if i % 50 else f"rare{i}", "s") for i in range(900)]
    d = docs(rows)
    ranked = d.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)).alias("h")).distinct().collect()
    got = languages.fit(d, 5, 3)
    assert got.languages == ["l0", "l1", "l2"]
    for row, lang in enumerate(got.languages):
        ids = {r.doc_id for r in sorted((r for r in ranked if r.lang == lang), key=lambda r: (r.h, r.doc_id))[:5]}
        counts = np.bincount(languages.grams([t for i, t, x, _ in rows if x == lang and i in ids])[0], minlength=languages.BUCKETS)
        want = np.log((counts + languages.PRIOR) / (counts.sum() + languages.PRIOR * languages.BUCKETS))
        assert np.allclose(got.logp[row], want, atol=1e-5)


def test_em_reaches_the_maximum():
    r = np.random.default_rng(3)
    words = np.array([30, 50, 5])
    lik = r.random((85, 3)) ** 3 + 1e-3
    steps, languages.STEPS, tol, languages.TOLERANCE = languages.STEPS, 3000, languages.TOLERANCE, 1e-9
    try:
        shares, value = languages.em(lik, words, np.full((3, 3), 1 / 3))
    finally:
        languages.STEPS, languages.TOLERANCE = steps, tol
    grid = [(a, b, 1 - a - b) for a in np.linspace(0, 1, 101) for b in np.linspace(0, 1 - a, 101)]
    for i, (a, b) in enumerate(zip(np.cumsum(words) - words, np.cumsum(words))):
        best = max(np.log(lik[a:b] @ np.array(g)).sum() for g in grid)
        assert value[i] >= best - 1e-6
        assert shares[i].sum() == pytest.approx(1)


def test_screening_changes_nothing(model):
    """Growing the set with EM for every language, as the slope's bound promises it may be skipped."""
    r = random.Random(2)
    texts = [" ".join(r.choices(WORDS["aa"] + WORDS["bb"] * (i % 3) + ["xqx"] * (i % 2), k=r.randint(1, 40))) for i in range(40)]
    fast, words, _ = languages.mixtures(model, texts)
    bucket, begins, n = languages.grams(texts)
    ll = np.stack([np.add.reduceat(row[bucket], begins, dtype=np.float64) for row in model.logp], axis=1)
    r_ = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -60))
    at = 0
    for i in range(40):
        part = r_[at : at + n[i]]
        at += n[i]
        single = np.log(part).sum(0)
        shares = np.eye(3)[single.argmax()]
        value = single.max()
        while True:
            tries = []
            for b in np.flatnonzero(shares == 0):
                start = shares * 0.9
                start[b] = 0.1
                s, v = languages.em(part, n[i : i + 1], start[None])
                tries.append((v[0], b, s[0]))
            best = max(tries, key=lambda x: x[0], default=None)
            if best is None or best[0] - value <= languages.PENALTY * np.log(n[i] + 1):
                break
            value, _, shares = best
        assert (fast[i] > 0).tolist() == (shares > 0).tolist()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = languages.fit(d.filter("doc_id % 2 = 0"), 200)
    rest = languages.infer(d.filter("doc_id % 2 = 1"), fitted).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.languages[:1] == [r.lang] for r in rest]) > 0.98
    assert np.mean([r.accepted for r in rest]) > 0.99


def test_languages_of_odd_and_no_documents(odd, empty, model):
    out = languages.infer(odd, model).collect()
    assert len(out) == 10
    assert {r.doc_id for r in out if r.n_words == 0} == {1, 2, 3}
    kept = languages.keep_accepted(odd, model)
    assert kept.columns == odd.columns and not kept.filter("doc_id in (1, 2, 3)").count()
    assert languages.infer(empty, model).count() == languages.keep_accepted(empty, model).count() == 0
    none = languages.fit(empty)
    assert none.languages == [] and {r.doc_id for r in languages.infer(odd, none).collect() if not r.accepted} == {1, 2, 3}


def test_digests(spark, docs):
    r = random.Random(4)
    texts = ["".join(r.choices("abcdefgé ", k=r.randint(5, 400))) for _ in range(12)]
    counts, size = digests.bucket_counts(texts)
    assert counts.tolist() == [plain_digest(t) for t in texts]
    out = digests.to_text(*digests.encode(counts, size))
    df = spark.createDataFrame([(a, b) for a in out for b in out], "a string, b string").withColumn("d", digests.difference(F.col("a"), F.col("b")))
    for row in df.collect():
        assert row.d == plain_difference(row.a, row.b)
        assert (row.d == 0) == (row.a == row.b)


def test_near_copies_have_near_digests(docs):
    r = random.Random(6)
    a = " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(300))
    b = a.replace("a", "b", 5)
    c = " ".join("".join(r.choices("klmnopqrst", k=5)) for _ in range(300))
    out = digests.to_text(*digests.encode(*digests.bucket_counts([a, b, c])))
    assert plain_difference(out[0], out[1]) < 30 < plain_difference(out[0], out[2])


def test_digests_of_odd_and_no_documents(odd, empty):
    out = digests.digests(odd).collect()
    assert len(out) == 10
    none = {r.doc_id for r in out if r.digest is None}
    assert none == {1, 2, 4} and {r.n_bytes for r in out if r.doc_id == 1} == {None}
    assert len({r.digest for r in out if r.doc_id in (7, 8)}) == 1
    assert digests.digests(empty).count() == 0


def test_copies_and_near_digests_are_found(spark, docs, tmp_path):
    r = random.Random(9)
    texts = []
    for _ in range(12):
        base = "".join(r.choices("abcdefghij ", k=r.randint(200, 3000)))
        texts += [base, base] + [base[:k] + "x" + base[k + 1 :] for k in r.choices(range(200), k=12)]
    docs([(i, t, "en", "s") for i, t in enumerate(texts)]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = digests.op6_digests(spark, str(tmp_path)).collect()
    own = {x.doc_id: x.digest for x in rows}
    assert len(rows) == len(own) == len(texts)
    groups = {}
    for i in sorted(own):
        groups.setdefault(own[i], []).append(i)
    assert {tuple(x.copies) for x in rows if x.copies} == {tuple(g) for g in groups.values() if len(g) > 1}
    want = {(a, b, s) for a in groups for b in groups if a < b and (s := plain_difference(a, b)) <= digests.NEAR}
    assert len(want) > 20
    assert {(x.digest, n.digest, n.score) for x in rows for n in x.near or []} == want


@pytest.fixture(scope="module")
def codec():
    if not os.path.exists(pieces.MODEL):
        pytest.skip("needs the tokenizer files")
    return pieces.codec()


def test_pieces_are_the_library_s(codec):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(7)
    texts = ["", " ", "a", "  two  spaces ", "日本語\t\n😀￭", "x" * 700, " " * 50, "Été à la plage", "\u0000▁ mark"]
    texts += ["".join(r.choices("abcde  thequ\n.,éß日", k=r.randint(1, 200))) for _ in range(300)]
    ids, n = codec.encode(texts)
    ends = np.append(0, np.cumsum(n))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == sp.encode(texts)
    assert codec.decode(ids, n) == [t.replace(pieces.MARK, " ") for t in texts]


def test_words_of_earlier_batches_are_not_segmented_again(codec, monkeypatch):
    r = random.Random(9)
    batches = [[" ".join("".join(r.choices("abehnt" + "é" * (k > 2), k=r.randint(1, 4))) for _ in range(300)) + " 日 " + "x" * 100 for _ in range(3)] for k in range(6)]
    want = [pieces.codec().encode(b) for b in batches]
    monkeypatch.setattr(pieces, "KEPT", 400)
    done = Counter()
    segment = pieces.Codec._units

    def units(self, code, start, size):
        done.update(code[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist()))
        return segment(self, code, start, size)

    monkeypatch.setattr(pieces.Codec, "_units", units)
    c = pieces.codec()
    for b, (ids, n) in zip(batches, want):
        for _ in range(2):
            before = done.total()
            got = c.encode(b)
            assert (got[0] == ids).all() and (got[1] == n).all()
        assert done.total() - before == 1  # the long one isn't kept
    assert all(len(u.keys) < 2000 for u in c._seen)
    # Units with one hash aren't taken for each other.
    known, code = pieces.Units(np.uint16), np.array([5, 6, 7, 5, 6, 8], np.int32)
    one, size = np.array([9], np.uint64), np.array([3])
    known.add(one, code, np.array([0]), size, np.array([1, 2], np.int32), np.array([0]), np.array([2]))
    assert [len(x) for x in known.find(one, code, np.array([0]), size)] == [1, 1]
    assert [len(x) for x in known.find(one, code, np.array([3]), size)] == [0, 0]


def test_viterbi_of_a_unigram_model():
    """Against all segmentations."""
    r = random.Random(8)
    vocab = ["a", "b", "c", "ab", "bc", "abc", "ca", "▁", "▁a", "▁ab", "aab"]
    scored = [("<unk>", 0.0, 2)] + [(p, -r.random() * 5, 1) for p in vocab]
    c = pieces.Codec(scored, False)
    score = {p: s for p, s, _ in scored}
    index = {p: i for i, (p, _, _) in enumerate(scored)}

    def best(t):
        out = [(0.0, [])]
        for e in range(1, len(t) + 1):
            out.append(max(((out[s][0] + score[t[s:e]], out[s][1] + [index[t[s:e]]]) for s in range(e) if t[s:e] in score), key=lambda x: x[0]))
        return out[-1]

    texts = ["".join(r.choices("abc ", k=r.randint(1, 14))) for _ in range(200)]
    ids, n = c.encode(texts)
    ends = np.append(0, np.cumsum(n))
    for t, a, b in zip(texts, ends, ends[1:]):
        got = ids[a:b].tolist()
        assert sum(c.scores[i] for i in got) == pytest.approx(best("▁" + t.replace(" ", "▁"))[0])


def test_pieces_of_odd_and_no_documents(odd, empty, codec):
    out = pieces.encode_documents(odd).collect()
    assert len(out) == 10
    for r, want in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(odd.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))):
        assert r.decoded == want.text and r.n_tokens == len(r.ids or [])
        assert (r.ids is None) == (want.text is None)
    assert pieces.encode_documents(empty).count() == 0


def grams(text, n=3):
    w = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else None


def brute(rows, t):
    sets = {i: grams(x) for i, x in rows if x is not None and i is not None}
    sets = {i: s for i, s in sets.items() if s}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def classes(ids, pairs):
    """{id: (least id that is connected with it, its links)}"""
    least, links = {i: i for i in ids}, Counter(x for p in pairs for x in p)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return {i: (least[i], links[i]) for i in least}


def classes_of(df):
    rows = df.collect()
    out = {r[0]: (r.class_id, r.links) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed, block, cells", [(0, 1000, 1_500_000), (1, 3, 50)])
def test_ngram_join_is_exact(docs, monkeypatch, seed, block, cells):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "CELLS", cells)
    monkeypatch.setattr(ngram_join, "POSTINGS", 3000)
    monkeypatch.setattr(ngram_join, "SLICE", 700)
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    passage = r.choices(vocab, k=40)
    rows = []
    for f in range(25):
        base = r.choices(vocab, k=r.choice([1, 2, 5, 30, 80, 200]))
        if f % 3 == 0:
            base = base[:30] + passage + base[30:]
        for _ in range(r.choice([1, 2, 6, 20])):
            w = [r.choice(vocab) if r.random() < 0.04 else x for x in base]
            rows.append((len(rows), " ".join(w)))
    want = brute(rows, 0.5)
    assert len(want) > 500
    got = ngram_join.similar_documents(docs([(i, t, "en", "s") for i, t in rows]))
    assert classes_of(got) == classes(range(len(rows)), want)


def test_ngram_join_of_odd_and_no_documents(odd, empty, docs):
    assert classes_of(ngram_join.similar_documents(odd)) == classes(range(1, 9), {(7, 8)})
    assert ngram_join.similar_documents(empty).count() == 0
    two = docs([(1, "a b c d e f", "en", "s"), (1, "z y x w v u", "en", "s"), (2, "a b c d e f g", "en", "s")])
    assert classes_of(ngram_join.similar_documents(two)) == {1: (1, 1), 2: (1, 1)}


def test_ngram_join_loses_no_link(docs):
    # Texts with one set of n-grams differ and are linked. 5 has two similar texts, by which 7 and 9 are linked, and 3 and 4 are connected by it.
    a, b = "a b c d e f g h", "a b c d e f g x"
    rows = [(5, a), (7, a), (5, b), (9, b), (3, "A b, c d e f g h"), (20, "k l m"), (21, "k L m"), (22, "K l m"), (20, "n o p q"), (12, "n o p q")]
    got = classes_of(ngram_join.similar_documents(docs([(i, t, "en", "s") for i, t in rows])))
    assert got == {3: (3, 4), 5: (3, 8), 7: (3, 4), 9: (3, 4), 12: (12, 1), 20: (12, 3), 21: (12, 2), 22: (12, 2)}


def test_rows_of_a_family_are_its_documents(docs):
    # 300 near copies are 44,850 links.
    r = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(r.choice(base) if r.random() < 0.02 else x for x in base), "en", "s") for i in range(300)]
    got = classes_of(ngram_join.similar_documents(docs(rows)))
    want = brute([x[:2] for x in rows], 0.5)
    assert len(want) > 40_000 and got == classes(range(300), want)


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>")


def true_pairs(x, t):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(x @ x.T >= t, 1))
    return set(zip(i.tolist(), j.tolist()))


@pytest.mark.parametrize("block", [1024, 7])
def test_nn_descent_finds_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(nn_descent, "BLOCK", block)
    r = np.random.default_rng(5)
    base = r.standard_normal((300, 16))
    family = base[0] + 0.05 * r.standard_normal((60, 16))
    x = np.concatenate([base, family, base[1:40] + 0.05 * r.standard_normal((39, 16))]).astype(np.float32).astype(float)
    want = true_pairs(x, 0.95)
    got, true = classes_of(nn_descent.near_duplicates(vectors(spark, x))), classes(range(len(x)), want)
    assert len(want) > 1700 and set(got) == set(true)
    assert all(got[i][1] <= n and got[i][0] >= c for i, (c, n) in true.items())
    assert sum(n for _, n in got.values()) >= 0.98 * 2 * len(want)


def test_copies_of_one_vector_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 64)
    r = np.random.default_rng(2)
    v = r.standard_normal((1, 16))
    x = np.concatenate([np.repeat(v, 400, axis=0), np.repeat(-v, 20, axis=0)])
    got = classes_of(nn_descent.near_duplicates(vectors(spark, x)))
    assert got == {i: (0, 399) if i < 400 else (400, 19) for i in range(420)}


def test_vectors_without_near_duplicates_are_in_no_list(spark, monkeypatch):
    written = Counter()
    real = nn_descent.spool

    def counting(df, name):
        out = real(df, name)
        written[name] += out.count()
        return out

    monkeypatch.setattr(nn_descent, "spool", counting)
    r = np.random.default_rng(8)
    base = r.standard_normal((3000, 64))
    x = np.concatenate([base, base[:1] + 0.01 * r.standard_normal((50, 64)), base[1:20] + 0.03 * r.standard_normal((19, 64))]).astype(np.float32).astype(float)
    got, true = classes_of(nn_descent.near_duplicates(vectors(spark, x))), classes(range(len(x)), true_pairs(x, 0.95))
    assert sum(n for _, n in got.values()) >= 0.98 * sum(n for _, n in true.values()) > 2500
    assert set(got) == set(true) and all(got[i][1] <= n and got[i][0] >= c for i, (c, n) in true.items())
    # Full lists of all vectors would be 30,000 rows a round.
    assert written["lists"] < 5000


def test_low_recall_raises(spark, monkeypatch):
    seeds = []
    monkeypatch.setattr(nn_descent, "audit", lambda *_: 0.5)
    real = nn_descent.neighbours
    monkeypatch.setattr(nn_descent, "neighbours", lambda *a, **k: seeds.append(k["seed"]) or real(*a, **k))
    with pytest.raises(RuntimeError, match="0.500"):
        nn_descent.near_duplicates(vectors(spark, np.random.default_rng(3).standard_normal((30, 4))))
    assert len(set(seeds)) == nn_descent.DOUBLINGS + 1


def test_lists_of_nn_descent_converge(spark):
    x = np.random.default_rng(6).standard_normal((400, 8))
    v = nn_descent.spool(nn_descent.unit_vectors(vectors(spark, x)), "v")
    lists = nn_descent.neighbours(v, 10).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(400) for j in np.argsort(-s[i])[:10]}
    assert len(want & {(e.id, e.nbr) for e in lists}) > 0.9 * len(want)


def test_near_duplicates_of_odd_and_no_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [2.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"id": F.lit(1), "vec": F.lit("x")})
    got = classes_of(nn_descent.near_duplicates(df))
    assert got == classes(range(1, 10), {(1, 2), (1, 9), (2, 9)})
    assert nn_descent.near_duplicates(df.filter("vec_id is null")).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 6), (9, 8), (8, 7), (7, 1), (20, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in (1, 2, 3, 7, 8, 9)} == {1} and got[6] == 5 and got[20] == 20
    assert {got[i] for i in range(100, 141)} == {100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
