"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffspark.llm.samples import labelled

#: Byte map that keeps lengths: sentence ends become line feeds, other ASCII punctuation spaces, A-Z lower case.
_MAP = bytes(10 if chr(b) in ".!?\n\r" else b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
SPAN = "array<struct<start: int, end: int, score: double>>"


def sentences(text: str | None) -> list[bytes]:
    """Sentences in order: lower-cased bytes without punctuation, each as long as in the text; one separator byte lies between two."""
    return (text or "").encode().translate(_MAP).split(b"\n")


def features(word: bytes) -> list[bytes]:
    """A word and its beginnings of 4 to 8 bytes, each with a ``^`` in front, which no word has."""
    return [word, *(b"^" + word[:k] for k in range(4, min(9, len(word))))]


class Known(dict):
    """Word -> indexes of its features in the vocabulary; a memo, emptied when full."""

    def __init__(self, vocabulary: list[bytes], most: int = 1_000_000):
        super().__init__()
        self.vocabulary, self.most = {w: i for i, w in enumerate(vocabulary)}, most

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = tuple(self.vocabulary[f] for f in features(word) if f in self.vocabulary)
        return found

    def text(self, text: str | None) -> tuple[list[tuple[int, int, list[int]]], int]:
        """(start, end, features) in bytes of each sentence with known features, and how many sentences have words but no known feature."""
        at, out, others = 0, [], 0
        for s in sentences(text):
            if parts := s.split():
                if found := [k for w in parts for k in self[w]]:
                    out.append((at, at + len(s), sorted(set(found))))
                else:
                    others += 1
            at += len(s) + 1
        return out, others


class NoisyOr:
    """p(sentence) = sigmoid(bias + sum of the weights of its features); p(document) = 1 - product of (1 - p(sentence))."""

    def __init__(self, vocabulary: list[bytes], weights: np.ndarray, bias: float):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias

    def score(self, text: str | None, known: Known) -> tuple[float, list[dict]]:
        """Of the document, and the sentences that are more likely offending than not."""
        spans, others = known.text(text)
        z = np.array([self.bias + self.weights[ids].sum() for _, _, ids in spans])
        log_clean = -np.logaddexp(0, z).sum() - others * np.logaddexp(0, self.bias)
        return float(-np.expm1(log_clean)), [{"start": a, "end": b, "score": float(1 / (1 + np.exp(-v)))} for (a, b, _), v in zip(spans, z, strict=True) if v > 0]


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", among: Column | None = None, per_class: int = 4000, vocabulary: int = 2000, least_z: float = 3.0, ridge: float = 0.05, steps: int = 400) -> NoisyOr:
    """Learn from at most ``per_class`` documents of each label, with at most ``vocabulary`` features (words and their beginnings): those that documents labelled 1 have more often, by ``least_z`` standard errors at least.

    Word counts and sentences are made by Spark over whole texts; only the chosen features and, for each sentence, its own of them reach the driver. Without labelled documents the model scores 0 everywhere but for its bias.
    """
    sample = labelled(docs, labels, "toxic", doc_id=doc_id, text=text, per_class=per_class, among=among).persist()

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in {f for s in sentences(t) for w in s.split() for f in features(w)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32())], ["word", "label"])

    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not (n0 and n1):
        sample.unpersist()
        return NoisyOr([], np.zeros(0), -9.0)
    counts = sample.select("text", "label").mapInArrow(distinct, "word binary, label int").groupBy("word").agg(F.sum(1 - F.col("label")).alias("c0"), F.sum("label").alias("c1"))
    share = (F.col("c0") + F.col("c1") + 1) / float(n0 + n1 + 2)
    z = (F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
    words = [bytes(r["word"]) for r in counts.where("c0 + c1 >= 3").where(z > least_z).orderBy(z.desc(), "word").limit(vocabulary).collect()]

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(words)
        for b in batches:
            got = [known.text(t) for t in b.column(0).to_pylist()]
            found = [[ids for _, _, ids in g[0]] for g in got]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.list_(pa.int32()))), pa.array([g[1] for g in got], pa.int32()), b.column(1), b.column(2)], ["found", "others", "label", "id"])

    rows = sample.select("text", "label", "id").mapInArrow(sparse, "found array<array<int>>, others int, label int, id " + dict(sample.dtypes)["id"]).orderBy("id").collect()
    sample.unpersist()
    doc = np.array([i for i, r in enumerate(rows) for _ in r["found"]], int)
    pair_s = np.array([k for k, s in enumerate(s for r in rows for s in r["found"]) for _ in s], int)
    pair_w = np.array([w for r in rows for s in r["found"] for w in s], int)
    others, y = np.array([r["others"] for r in rows], float), np.array([r["label"] for r in rows], float)
    # Adam on the mean log loss; the ridge is a normal prior of the weights.
    theta = np.concatenate([np.zeros(len(words)), [-6.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        logit = theta[-1] + np.bincount(pair_s, theta[pair_w], len(doc))
        p, p0 = 1 / (1 + np.exp(-logit)), 1 / (1 + np.exp(-theta[-1]))
        log_clean = -np.bincount(doc, np.logaddexp(0, logit), len(rows)) - others * np.logaddexp(0, theta[-1])
        clean = np.exp(log_clean)
        pull = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)  # of the loss by a sentence's logit, over p
        d = pull[doc] * p
        grad = np.concatenate([np.bincount(pair_w, d[pair_s], len(words)), [d.sum() + (pull * others).sum() * p0]]) / len(rows)
        grad[:-1] += ridge / len(rows) * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return NoisyOr(words, theta[:-1], float(theta[-1]))


def toxicity(docs: DataFrame, model: NoisyOr, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Score every whole text: doc_id, score (0 to 1), predicted (int), offending (spans in UTF-8 bytes of sentences that are likelier toxic than not, with their score).

    Defined cases: a null or empty text, and one without words, scores 0; repeated rows and null ids give a row each; an empty table gives an empty table; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(model.vocabulary)
        for b in batches:
            scored = [model.score(x.as_py(), known) for x in b.column(1)]
            spans = pa.array([s[1] for s in scored], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s[0] for s in scored], pa.float64()), spans], ["doc_id", "score", "offending"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, offending {SPAN}")
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")
