"""Language mixtures of documents by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelquery.llm.common import spool, table, unspool
from reelquery.llm.pieces import chunks

#: Labelled documents of each language that the model is fitted on: those with the smallest hashes; and languages, the commonest.
SAMPLE, LANGUAGES = 2_000, 256
#: Hash buckets of character trigrams, and what is added to each count.
BUCKETS = 1 << 16
PRIOR = 0.5
#: Nats for each further language, times the logarithm of the number of words.
PENALTY = 1.5
#: A document with this share of words, or more, in no known language is rejected.
MAX_UNKNOWN = 0.5
#: EM ends after so many steps, or when no share changes by more than TOLERANCE.
STEPS, TOLERANCE = 60, 1e-3


@cache
def _folded() -> np.ndarray:
    """The lower case of each letter or mark by code point; 0 for all else."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] in "LM":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram around each letter, where each word begins among them, words of each text).

    A word is a run of letters and marks; the trigrams at its ends take in one space.
    """
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _folded()[points]
    at = np.flatnonzero(low)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    h = low[at - 1] * np.uint32(0x9E3779B1) + low[at] * np.uint32(0x85EBCA77) + low[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    bucket = (h >> np.uint32(16)).astype(np.int64)
    begins = np.flatnonzero(np.diff(at, prepend=-1) > 1) if at[0] else np.flatnonzero(np.diff(at, prepend=-2) > 1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    words = np.diff(np.searchsorted(at[begins], ends, side="right"), prepend=0)
    return bucket, begins, words


class Model(NamedTuple):
    """languages, and log-probabilities (language, bucket); the last row is text in no known language, all buckets alike."""

    languages: list[str]
    logp: np.ndarray


def fit(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """The trigram model of each value of lang, from at most sample of its documents; null langs and texts aren't labels.

    The sample and the number of languages bound the fit alone: where lang has more values than
    languages (misspelt ones, say), the commonest are fitted, of equally common ones the first by
    name. The documents with the smallest hashes are the sample; ties go by doc_id. Rows with
    equal doc_id and lang are one document of it, whose texts all count. Only what has a hash under a
    bound that lets a few more than sample through is ranked. An empty table gives a model without languages. Other columns aren't looked at.
    """
    spark = docs.sparkSession
    labelled = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()  # at most languages rows
    # Ten standard deviations more than the sample, so that it is all there.
    bound = [(r["lang"], min(1.0, (sample + 10 * math.sqrt(sample) + 100) / r["count"])) for r in sizes]
    below = F.broadcast(spark.createDataFrame(bound, "lang string, share double"))
    hashed = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30))
    labelled = labelled.join(below, "lang").filter(hashed <= F.col("share") * (1 << 30))
    ids = labelled.select("doc_id", "lang").distinct()
    rank = Window.partitionBy("lang").orderBy(hashed, "doc_id")
    ids = spool(ids.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= sample).select("doc_id", "lang"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.bincount(grams([text])[0], minlength=BUCKETS)
                sums[lang] = sums[lang] + got if lang in sums else got
        for lang, n in sums.items():
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(n[hit])], ["lang", "bucket", "n"])

    texts = labelled.join(ids, ["doc_id", "lang"], "left_semi").select("lang", "text")
    rows = texts.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    unspool(ids)
    names = sorted(rows["lang"].unique())
    counts = np.zeros((len(names) + 1, BUCKETS))
    counts[rows["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(np.int64), rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    logp = np.log((counts + PRIOR) / (counts.sum(1, keepdims=True) + PRIOR * BUCKETS))
    return Model(names, logp.astype(np.float32))


def _sums(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sums of rows by document; every document has words."""
    return np.add.reduceat(x, np.cumsum(words) - words, axis=0)


def em(r: np.ndarray, words: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log-likelihoods) of the documents whose words have likelihoods r (word, language). Shares that are 0 stay 0."""
    shares = shares.copy()
    doc = np.repeat(np.arange(len(words)), words)
    live = np.arange(len(words))
    lr, lw, ld = r, words, doc
    for step in range(STEPS):
        mixed = lr * shares[ld]
        mixed /= mixed.sum(1, keepdims=True)
        new = _sums(mixed, lw) / lw[:, None]
        moved = np.abs(new - shares[live]).max(1) > TOLERANCE
        shares[live] = new
        if not moved.any():
            break
        if moved.mean() < 0.7:
            keep = np.repeat(moved, lw)
            live, lr, lw, ld = live[moved], lr[keep], lw[moved], ld[keep]
    return shares, _sums(np.log((r * shares[doc]).sum(1)), words)


def mixtures(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shares (text, language and unknown), words, log-likelihoods less those of unknown) of the texts.

    The language set grows from the best single one: the language that raises the
    likelihood most is added while the gain exceeds the penalty. The gain is at most the
    slope of the likelihood towards a language, as it is concave in the shares, so EM runs
    only for languages whose slope exceeds the penalty.
    """
    bucket, begins, words = grams(texts)
    k = len(model.logp)
    out, gain_of = np.zeros((len(texts), k)), np.zeros(len(texts))
    some = np.flatnonzero(words)
    if not len(some):
        return out, words, gain_of
    n = words[some]
    ll = np.stack([np.add.reduceat(row[bucket], begins, dtype=np.float64) for row in model.logp], axis=1)
    top = ll.max(1, keepdims=True)
    r = np.exp(np.maximum(ll - top, -60.0))
    base = _sums(top[:, 0] - ll[:, -1], n)
    single = _sums(np.log(r), n)
    best = single.argmax(1)
    shares = np.zeros((len(some), k))
    shares[np.arange(len(some)), best] = 1
    value = single[np.arange(len(some)), best]
    penalty = PENALTY * np.log(n + 1.0)
    live, lr = np.arange(len(some)), r
    while len(live):
        doc = np.repeat(np.arange(len(live)), n[live])
        slope = _sums(lr / (lr * shares[live][doc]).sum(1, keepdims=True), n[live]) - n[live][:, None]
        slope[shares[live] > 0] = -1
        most, to, how = np.full(len(live), -np.inf), np.zeros(len(live), np.int64), np.zeros((len(live), k))
        for b in range(k):
            who = np.flatnonzero(slope[:, b] > penalty[live])
            if not len(who):
                continue
            held = shares[live[who]]
            start = held * 0.9
            start[:, b] = 0.1
            keep = np.isin(doc, who)
            got, v = em(lr[keep], n[live[who]], start)
            better = v > most[who]
            most[who[better]], to[who[better]], how[who[better]] = v[better], b, got[better]
        grown = most - value[live] > penalty[live]
        shares[live[grown]], value[live[grown]] = how[grown], most[grown]
        keep = np.repeat(grown, n[live])
        live, lr = live[grown], lr[keep]
    out[some], gain_of[some] = shares, value + base
    return out, words, gain_of


def accepted(shares: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether a text has words, most of them in known languages; where no language is known, nothing can be said against one."""
    return (words > 0) & ((shares[:, -1] < MAX_UNKNOWN) | (shares.shape[1] == 1))


def infer(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, languages and shares (by share, then name), unknown (share of words in no known language), n_words, gain
    (log-likelihood over that of unknown text) and accepted for every row.

    Whole texts count. Null texts and texts without letters have no languages, 0 words and
    aren't accepted. Repeated rows are inferred as often as they occur. A model without
    languages accepts all texts with letters. Languages with equal shares come by name; of
    languages that raise the likelihood equally the first by name is added. A very long text
    is worked on whole, and alone. An empty table gives no rows. Other columns of docs
    aren't looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, texts in chunks(batch.column(1)):
                shares, words, gain = mixtures(m, [t or "" for t in texts])
                names, parts = [], []
                for row in shares[:, :-1]:
                    order = [i for i in np.argsort(-row, kind="stable").tolist() if row[i] > 0]
                    names.append([m.languages[i] for i in order])
                    parts.append([float(row[i]) for i in order])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(names, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64())), pa.array(shares[:, -1]), pa.array(words), pa.array(gain), pa.array(accepted(shares, words))],
                    ["doc_id", "languages", "shares", "unknown", "n_words", "gain", "accepted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, languages array<string>, shares array<double>, unknown double, n_words bigint, gain double, accepted boolean")


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that infer accepts, with all their columns, whatever these are called; repeated rows stay or go together."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [accepted(*mixtures(shared.value, [t or "" for t in texts])[:2]) for _, _, texts in chunks(batch.column(at))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


def op2_language_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return infer(docs, fit(docs))
