"""Toxicity grades by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import bounded_batches, map_columns, pick, settled, texts
from keyloom.llm.license_scan import words_of


#: Lengths in bytes of the word beginnings that are features beside whole words; inflected forms share them.
PREFIXES = (4, 5, 6, 7)


def features_of_word(word: bytes) -> list[bytes]:
    return [word, *[word[:n] + b"*" for n in PREFIXES if len(word) > n]]


def features_of(text: str) -> set[bytes]:
    """A text's sparse features: its distinct words, and their beginnings marked by a star."""
    words = set(words_of(text))
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + b"*" for w in words if len(w) > n])
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade > k) = sigmoid(sum of the weights of a text's features - thresholds[k]), thresholds ascending."""

    weights: dict[bytes, float]
    any_weight: float  # of one feature more: that the text has any of the others
    thresholds: np.ndarray

    def severity(self, features: set[bytes]) -> tuple[float, float]:
        """Expected grade, and the probability of any grade above 0."""
        if not len(self.thresholds):
            return 0.0, 0.0
        known = sorted(self.weights.keys() & features)
        total = sum(self.weights[w] for w in known) + self.any_weight * bool(known)
        above = 1 / (1 + np.exp(np.clip(self.thresholds - total, -60, 60)))
        return float(above.sum()), float(above[0])


def judged(labels: DataFrame) -> DataFrame:
    """doc_id, toxic (0 or 1). Of repeated ids the worse label counts; rows with a null doc_id or label are left out."""
    rows = pick(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    return rows.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def severity_grades(toxic: np.ndarray, signs: np.ndarray, levels: int) -> np.ndarray:
    """Grade 0 for texts that aren't toxic; toxic ones get 1 to levels by how many words with a tie to toxicity they have.

    The labels only say yes or no, so the quantiles of that count among toxic texts part the grades.
    """
    cuts = np.quantile(signs[toxic > 0], np.arange(1, levels) / levels)
    return np.where(toxic > 0, 1 + np.searchsorted(cuts, signs, side="left"), 0)


def fit_ordinal(hits: list[list[int]], grade: np.ndarray, n_features: int, ridge: float = 1e-5, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ascending thresholds that maximise the ordinal likelihood; full-batch Adam, no random part."""
    levels = int(grade.max())
    x = np.zeros((len(hits), n_features), np.float32)
    for row, features in enumerate(hits):
        x[row, features] = 1
    above = np.array([(grade > k).mean() for k in range(levels)]).clip(1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(np.log((1 - above) / above))
    # parameters: weights, first threshold, logarithms of the gaps between thresholds
    p = np.concatenate([np.zeros(n_features), start[:1], np.log(np.diff(start) + 0.1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        gaps = np.exp(p[n_features + 1 :])
        thresholds = p[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        total = (x @ p[:n_features].astype(np.float32)).astype(np.float64)
        tail = 1 / (1 + np.exp(np.clip(thresholds[None, :] - total[:, None], -60, 60)))
        edges = np.hstack([np.ones((len(x), 1)), tail, np.zeros((len(x), 1))])
        slope = np.hstack([np.zeros((len(x), 1)), tail * (1 - tail), np.zeros((len(x), 1))])
        rows = np.arange(len(x))
        mass = np.maximum(edges[rows, grade] - edges[rows, grade + 1], 1e-12)
        by_total = -(slope[rows, grade] - slope[rows, grade + 1]) / mass
        by_threshold = np.zeros_like(thresholds)
        np.add.at(by_threshold, grade[grade > 0] - 1, (slope[rows, grade] / mass)[grade > 0])
        np.add.at(by_threshold, grade[grade < levels], -(slope[rows, grade + 1] / mass)[grade < levels])
        after = np.cumsum(by_threshold[::-1])[::-1]
        gradient = np.concatenate([x.T @ by_total.astype(np.float32), after[:1], after[1:] * gaps]) / len(x)
        gradient[:n_features] += ridge * p[:n_features]
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    thresholds = p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1 :]))])
    return p[:n_features], thresholds


def class_shares(clean: int, toxic: int, sample_docs: int) -> tuple[float, float]:
    """Shares of the clean and of the toxic labels to draw: half of the bound for each class, and what one leaves goes to the other."""
    few = min(toxic, sample_docs // 2)
    rest = min(clean, sample_docs - few)
    return rest / max(clean, 1) or 1.0, min(toxic, sample_docs - rest) / max(toxic, 1) or 1.0


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 8_000, n_features: int = 512, min_toxic: int = 5, min_tie: float = 15.0, min_purity: float = 0.5, levels: int = 2) -> OrdinalModel:
    """Fit on labelled documents.

    sample_docs bounds the labelled documents used, a fixed pseudo-random part of more, drawn per class: toxic ones are all used
    while they are half of the bound at most; purity and thresholds are those of the labels before the draw. Whole texts count, equal
    texts once. Of the words and word beginnings in min_toxic toxic texts or more, those count that are
    commoner there by a log-likelihood ratio of min_tie or more, and have min_purity of their texts there, the n_features strongest. Toxic texts have
    `levels` grades, see severity_grades. Without labels, or
    with one grade only, the model finds nothing.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    marked = judged(labels)
    labelled = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = class_shares(labelled.get(0, 0), labelled.get(1, 0), sample_docs)
    share = F.when(F.col("toxic") > 0, F.lit(int(shares[1] * 1_000_000))).otherwise(F.lit(int(shares[0] * 1_000_000)))
    marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000)) < share)
    rows = texts(docs).join(F.broadcast(marked), "doc_id").groupBy(F.md5("text").alias("key")).agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = settled(rows.select("text", "toxic"))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, toxic = sum(sizes.values()), sum(c for yes, c in sizes.items() if yes)
    if not toxic or toxic == n:
        return OrdinalModel({}, 0.0, np.zeros(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad = Counter(), Counter()
        for batch in batches:
            for text, bad_text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = features_of(text)
                seen.update(found)
                if bad_text:
                    bad.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64()), pa.array([bad[w] for w in seen], pa.int64())], ["word", "n", "bad"])

    counted = rows.mapInArrow(count, "word binary, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    clean_odds = shares[1] / shares[0]  # clean labels that each drawn one stands for, in units of toxic ones
    pure = F.col("bad") >= min_purity * (F.col("bad") + (F.col("n") - F.col("bad")) * clean_odds)
    common = counted.where((F.col("bad") >= min_toxic) & pure & (F.col("bad") * n > F.col("n") * toxic)).collect()
    ties = {bytes(r.word): _tie(r.n, r.bad, n, toxic) for r in common}
    ranked = sorted((w for w, tie in ties.items() if tie >= min_tie), key=lambda w: (-ties[w], w))[:n_features]
    place = {w: k for k, w in enumerate(ranked)}

    def featurise(batch: dict[str, list]) -> Iterator[dict[str, object]]:
        found = [features_of(t) for t in batch["text"]]
        signs = [sum(not place.keys().isdisjoint(features_of_word(w)) for w in f if not w.endswith(b"*")) for f in found]
        yield {"toxic": batch["toxic"], "signs": signs, "hits": [sorted(place[w] for w in place.keys() & f) for f in found]}

    table = map_columns(rows, "toxic int, signs int, hits array<int>", featurise).collect()
    table.sort(key=lambda r: (r.toxic, r.signs, r.hits))
    grade = severity_grades(np.array([r.toxic for r in table]), np.array([r.signs for r in table]), levels)
    hits = [[*r.hits, len(place)] if r.hits else [] for r in table]
    weights, thresholds = fit_ordinal(hits, grade, len(place) + 1)
    return OrdinalModel({w: float(weights[k]) for w, k in place.items()}, float(weights[-1]), thresholds + np.log(clean_odds))


def _tie(n: int, bad: int, total: int, toxic: int) -> float:
    """Log-likelihood ratio of a word's presence against toxicity."""
    out = 0.0
    for have, row, column in ((bad, n, toxic), (n - bad, n, total - toxic), (toxic - bad, total - n, toxic), (total - n - toxic + bad, total - n, total - toxic)):
        if have > 0:
            out += 2 * have * np.log(have * total / (row * column))
    return out


def grade_documents(docs: DataFrame, model: OrdinalModel, threshold: float = 0.4) -> DataFrame:
    """One row per document: doc_id, severity (expected grade), p_toxic, grade (rounded), toxic (p_toxic at least threshold).

    Whole texts count; a null or empty one has no features and the base severity. Equal texts and repeated
    rows get equal values. The model has a fixed number of words, so what is broadcast doesn't grow.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batch: dict[str, list]) -> Iterator[dict[str, object]]:
        found = [shared.value.severity(features_of(t)) for t in batch["text"]]
        yield {
            "doc_id": batch["doc_id"],
            "severity": [s for s, _ in found],
            "p_toxic": [p for _, p in found],
            "grade": [round(s) for s, _ in found],
            "toxic": [p >= threshold for _, p in found],
        }

    return map_columns(texts(docs), "doc_id long, severity double, p_toxic double, grade int, toxic boolean", run)
