"""Quality classifier: supervised subword embeddings.

Every word, every run of 3 to 5 UTF-8 bytes and whether a word recurs a few words on is hashed to a bucket, each
bucket has a learned vector, a document is the mean of the vectors of its features, and a softmax layer over that mean
gives the class.  Training is plain stochastic gradient descent in numpy on a bounded sample of labelled rows; scoring
is a map over whole texts.  As the softmax layer is linear in the mean, a bucket enters a score only through one
number (its vector times the difference of the two class weights), so that is all the scoring tasks carry.

Defined results: null and empty texts have no features and score the learned prior; without labelled rows of both
classes the model is the constant share of label 1 (0.5 without any).  Repeated rows score alike; a null id is held
in.  A document with several labels counts as its lowest one, a labelled id with several texts is trained on with the
smallest; null labels are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm import tokens
from tallyfold.llm.common import text_batches

LAGS = (1, 2, 4)
LABELLED, FOLDS, HELD_OUT = 1000, 3, 1  #: most labelled rows of a class that are trained on; crc32 folds of ids


@dataclass(frozen=True)
class Settings:
    """``rows``: most labelled rows taken of each class, chosen by hash of id."""

    buckets_log2: int = 16
    dim: int = 8
    epochs: int = 4
    rate: float = 0.6
    rows: int = LABELLED
    seed: int = 1


@dataclass(frozen=True)
class Model:
    weights: np.ndarray = field(repr=False)  #: by bucket, what one feature adds
    bias: float
    buckets_log2: int

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for start, part in text_batches(texts, 1 << 20):
            total, count = np.zeros(len(part)), np.zeros(len(part))
            for buckets, begin, end in features(part, self.buckets_log2):
                sums = np.zeros(len(buckets) + 1)
                np.cumsum(self.weights[buckets], dtype=np.float64, out=sums[1:])
                total += sums[end] - sums[begin]
                count += end - begin
            out[start:start + len(part)] = total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-(out + self.bias)))


def features(texts: pa.Array, buckets_log2: int):
    """Of each kind of feature (words, whether a word equals the one ``lag`` words on, runs of 3, 4, 5 bytes): its
    buckets, first and last of each text."""
    hashes, first, _, _ = tokens.words(texts)
    yield (hashes >> np.uint64(64 - buckets_log2)).astype(np.int64), first[:-1], first[1:]
    for lag in LAGS:
        begin = np.minimum(first[:-1], max(0, len(hashes) - lag))
        yield (hashes[lag:] == hashes[:-lag]) * 1 + 2 * lag, begin, np.maximum(begin, first[1:] - lag)
    raw, offsets = tokens.utf8(texts)
    run = raw.astype(np.uint32)
    shift = np.uint32(32 - buckets_log2)
    with np.errstate(over="ignore"):
        for size in (2, 3, 4, 5):
            run = run[:-1] * np.uint32(0x01000193) + raw[size - 1:]
            if size > 2:
                mixed = (run ^ (run >> np.uint32(15))) * np.uint32(0x9E3779B1)
                begin = np.minimum(offsets[:-1], len(run))
                yield (mixed >> shift).astype(np.int64), begin, np.maximum(begin, offsets[1:] - size + 1)


def labelled(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """At most ``rows`` labelled texts of each class outside the held-out fold, chosen by hash of id."""
    kept = (labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
            .where("doc_id is not null and quality in (0, 1)")
            .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT)
            .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    place = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = kept.withColumn("place", F.row_number().over(place)).where(F.col("place") <= settings.rows).drop("place")
    share = kept.groupBy("quality").count()
    # Bounded by 2 x rows, so safe to broadcast.  An id on many rows gives the smallest of its texts.
    return (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
            .groupBy("doc_id", "quality").agg(F.min("text").alias("text")).join(F.broadcast(share), "quality"))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    got = labelled(docs, labels, settings).select("doc_id", "text", "quality", "count").toArrow().combine_chunks()
    got = got.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    size = 1 << settings.buckets_log2
    target = got["quality"].to_numpy().astype(np.float64)
    shares = dict(zip(got["quality"].to_pylist(), got["count"].to_pylist(), strict=True))
    if len(shares) < 2:
        one = 0.5 if not shares else float(next(iter(shares)))
        prior = np.clip(one, 1e-3, 1 - 1e-3)
        return Model(np.zeros(size, np.float32), float(np.log(prior / (1 - prior))), settings.buckets_log2)
    seen = {k: max(1, int((target == k).sum())) for k in shares}
    weight = np.array([shares[k] / seen[k] for k in target.astype(int)])
    weight /= weight.mean()
    texts = got["text"].combine_chunks() if isinstance(got["text"], pa.ChunkedArray) else got["text"]
    docs_features = []
    for i in range(len(texts)):
        found = [b[lo[0]:hi[0]] for b, lo, hi in features(texts.slice(i, 1), settings.buckets_log2)]
        buckets, counts = np.unique(np.concatenate(found), return_counts=True)
        docs_features.append((buckets.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1 / settings.dim, 1 / settings.dim, (size, settings.dim)).astype(np.float32)
    layer, bias = np.zeros((2, settings.dim), np.float32), np.zeros(2, np.float32)
    steps, step = settings.epochs * len(target), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(target)):
            rate = settings.rate * (1 - step / steps)
            step += 1
            buckets, shares_of = docs_features[i]
            mean = shares_of @ vectors[buckets]
            logits = layer @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(target[i])] -= 1
            p *= rate * weight[i]
            back = p @ layer
            layer -= np.outer(p, mean)
            bias -= 0.1 * p
            if len(buckets):
                # Shares are small; dividing by their square sum keeps a document's step at the given rate.
                vectors[buckets] -= np.outer(shares_of / max(1e-6, float(shares_of @ shares_of)), back) * 0.2
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]), settings.buckets_log2)


def score(model: Model, text: str = "text") -> Column:
    """Likelihood of label 1 of a text column."""
    handle = {"model": model}

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(handle["model"].scores(texts), pa.float64())

    return scored(F.col(text))
