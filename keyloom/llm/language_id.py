"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import bounded_batches, map_columns, pick

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Characters that one numpy pass may hold.
PASS_CHARS = 1 << 18
#: Log-probabilities are multiples of this, so that sums of them are exact in any order and by any passes.
GRAIN = 2.0**-18
#: More languages than these are refused: the matrix of all of them goes to every worker.
MAX_LANGUAGES = 1_000


@dataclass(frozen=True)
class LanguageModel:
    """labels in code point order; log_probs[bucket, label]; priors[label]; bits: log2 of the buckets.

    mean and spread: of the log-probability of an n-gram of letters and blanks, in texts of the label itself.
    """

    labels: tuple[str, ...]
    log_probs: np.ndarray
    priors: np.ndarray
    bits: int
    orders: tuple[int, ...]
    mean: np.ndarray
    spread: np.ndarray


def _code_points(text: str) -> np.ndarray:
    """The text in lower case. The last form of sigma is written as the common one, so that no character's case hangs on its neighbours."""
    return np.frombuffer(text.lower().replace("\u03c2", "\u03c3").encode("utf-32-le", "surrogatepass"), np.uint32)


def passes(texts: list[str], overlap: int, limit: int) -> Iterator[list[tuple[int, np.ndarray, int]]]:
    """Texts in passes of about `limit` characters: (text's place, code points, how many of them were in the pass before).

    A blank is put at both ends of a text. A long text runs over several passes, whose pieces overlap by `overlap` code points.
    """
    run: list[tuple[int, np.ndarray, int]] = []
    held = 0
    for place, text in enumerate(texts):
        tail = np.zeros(0, np.uint32)
        for at in range(0, max(1, len(text)), limit):
            points = _code_points(" " * (at == 0) + text[at : at + limit] + " " * (at + limit >= len(text)))
            run.append((place, np.concatenate([tail, points]), len(tail)))
            tail = run[-1][1][max(0, len(run[-1][1]) - overlap) :]
            held += len(points)
            if held >= limit:
                yield run
                run, held = [], 0
    if run:
        yield run


def ngram_buckets(pieces: list[tuple[int, np.ndarray, int]], bits: int, orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order, the hash buckets of all character n-grams that end in the new part of each piece, the piece of each, and whether it has letters and
    blanks only (non-ASCII characters count as letters).

    N-grams lie inside a text; white space runs as it stands.
    """
    lengths = np.array([len(p) for _, p, _ in pieces], np.int64)
    old = np.array([o for *_, o in pieces], np.int64)
    chars = np.concatenate([p for _, p, _ in pieces]).astype(np.uint64) if pieces else np.zeros(0, np.uint64)
    piece = np.repeat(np.arange(len(pieces)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))  # characters from here to the piece's end
    starts = np.cumsum(lengths) - lengths
    begun = np.flatnonzero(old)  # pieces that go on from the pass before
    odd = np.concatenate([[0], np.cumsum(~((chars > 127) | (chars == 32) | (chars == 10) | ((chars >= 97) & (chars <= 122))))])
    for n in orders:
        size = max(0, len(chars) - n + 1)
        mixed = np.full(size, n, np.uint64)
        for k in range(n):
            mixed = (mixed ^ chars[k : size + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        buckets = (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)
        own = ends[:size] >= n
        for k in begun:
            own[starts[k] : starts[k] + max(0, old[k] - n + 1)] = False
        yield buckets[own], piece[:size][own], (odd[n:] == odd[: size])[own] if size else own


def fit(labelled: DataFrame, bits: int = 14, orders: tuple[int, ...] = (2, 3), sample_docs: int = 3_000) -> LanguageModel:
    """Fit on rows of (text, lang), and doc_id where there is one; null texts or languages and texts without a letter teach nothing.

    sample_docs bounds the labelled rows used of each language: of a larger one a fixed pseudo-random part by the hash of
    text and id is taken, about so many. So a rare language is learned from all its rows. Priors are shares of all labelled rows. Counts are made on the executors; the driver gets one number for
    each bucket and language, of MAX_LANGUAGES at most; more are an error. alpha = 0.5 smooths the counts.
    """
    names = ["text", "lang", *[c for c in ("doc_id",) if c in labelled.columns]]
    rows = pick(labelled, *names).where("text IS NOT NULL AND lang IS NOT NULL")
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if large := {lang: n for lang, n in totals.items() if n > sample_docs}:
        share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(int(sample_docs / n * 1_000_000_000))) for lang, n in sorted(large.items())], F.lit(1_000_000_000))
        rows = rows.where(F.pmod(F.xxhash64(*[c for c in names if c != "lang"], F.lit(17)), F.lit(1_000_000_000)) < share)
    bounded_batches(labelled.sparkSession)
    overlap = max(orders) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, bool], np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if LETTER.search(text):
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for pieces in passes(texts, overlap, PASS_CHARS):
                    for buckets, _, plain in ngram_buckets(pieces, bits, orders):
                        for key, some in (((lang, False), buckets), ((lang, True), buckets[plain])):
                            sums[key] = sums.get(key, 0) + np.bincount(some, minlength=1 << bits)
        for (lang, plain), counts in sums.items():
            at = np.flatnonzero(counts)
            columns = [pa.array([lang] * len(at)), pa.array([plain] * len(at)), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "plain", "bucket", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, plain boolean, bucket long, n long")
    sums = counted.groupBy("lang", "plain", "bucket").agg(F.sum("n").alias("n")).toPandas()
    labels = tuple(sorted(set(sums["lang"])))
    place = {lang: k for k, lang in enumerate(labels)}
    counts = np.zeros((2, 1 << bits, len(labels)))
    counts[sums["plain"].astype(int), sums["bucket"].astype(int), [place[lang] for lang in sums["lang"]]] = sums["n"]
    return model_of(labels, counts[0], counts[1], np.array([totals[lang] for lang in labels], float), bits, orders)


def model_of(labels: tuple[str, ...], counts: np.ndarray, plain: np.ndarray, docs: np.ndarray, bits: int, orders: tuple[int, ...]) -> LanguageModel:
    """The model of n-gram counts [bucket, label], of those of letters and blanks only, and of how many documents each label has."""
    smooth = counts + 0.5
    log_probs = np.round(np.log(smooth / smooth.sum(axis=0, keepdims=True)) / GRAIN) * GRAIN
    shares = plain / np.maximum(plain.sum(axis=0, keepdims=True), 1)
    mean = (shares * log_probs).sum(axis=0)
    spread = np.sqrt((shares * (log_probs - mean) ** 2).sum(axis=0))
    priors = np.log((docs + 1) / (docs.sum() + len(labels) or 1))
    return LanguageModel(labels, log_probs.astype(np.float32), priors, bits, orders, mean, spread)


def score_texts(model: LanguageModel, texts: list[str | None], with_fit: bool = True, limit: int = PASS_CHARS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior, and (with_fit, else 0) fit of each text; `und` and 0 for null texts, texts without a letter and empty models.

    Fit: how far the mean log-probability of its n-grams of letters lies above (or, below 0, under) that of the language's own texts, in units of
    the spread of one n-gram plus four times that of a mean of so many. Sums are exact, so neither company nor the size of a pass changes a score.
    """
    langs, scores, fits = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    known = [k for k, t in enumerate(texts) if t and LETTER.search(t)] if model.labels else []
    totals, letters, sizes = (np.zeros((len(known), n)) for n in (len(model.labels), len(model.labels), 1))
    for pieces in passes([texts[k] for k in known], max(model.orders) - 1, limit):
        rows = np.array([row for row, *_ in pieces])
        for buckets, piece, plain in ngram_buckets(pieces, model.bits, model.orders):
            if not len(piece):
                continue
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            at = rows[piece[starts]]
            found = model.log_probs[buckets]
            np.add.at(totals, at, np.add.reduceat(found, starts, axis=0, dtype=np.float64))
            if with_fit:
                found[~plain] = 0
                np.add.at(letters, at, np.add.reduceat(found, starts, axis=0, dtype=np.float64))
                np.add.at(sizes[:, 0], at, np.add.reduceat(plain, starts, dtype=np.float64))
    if known:
        best = (totals + model.priors).argmax(axis=1)
        places = np.arange(len(known))
        n = np.maximum(sizes[:, 0], 1)
        unit = model.spread[best] * (1 + 4 / np.sqrt(n)) + 1e-12
        fit_of = np.where(sizes[:, 0] > 0, (letters[places, best] / n - model.mean[best]) / unit, 0.0)
        totals += model.priors
        shifted = np.exp(totals - totals.max(axis=1, keepdims=True))
        posterior = shifted.max(axis=1) / shifted.sum(axis=1)
        for row, k in enumerate(known):
            langs[k], scores[k], fits[k] = model.labels[best[row]], posterior[row], fit_of[row]
    return langs, scores, fits


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (posterior, 0 to 1).

    Whole texts are scored, in passes of bounded size. A null or empty text, or one without a letter, is `und` with
    score 0. Only the text matters, so equal texts get equal values and repeated rows repeat their
    result. The broadcast matrix has 2^bits buckets times the learned languages, whatever the corpus size.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def predict(batch: dict[str, list]) -> Iterator[dict[str, object]]:
        langs, scores, _ = score_texts(shared.value, batch["text"], with_fit=False)
        yield {"doc_id": batch["doc_id"], "lang_pred": langs, "score": scores}

    rows = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_columns(rows, "doc_id long, lang_pred string, score double", predict)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is outside the training fold: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, min_score: float = 0.3, min_fit: float = -2.0) -> DataFrame:
    """The documents whose text has an identified language, with all their columns as they were.

    Dropped are documents without a letter (also null and empty ones), those whose best language has
    a posterior under min_score, and those whose n-grams are on average less likely in it than its own texts' by more than
    min_fit allows: letters that are no words of a learned language. The model is fitted on the training fold of the same table; where
    that teaches nothing, no document is identified.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = fit(pick(docs, "doc_id", "text", "lang").where(~held_out()))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(column: pd.Series) -> pd.Series:
        found = zip(*score_texts(shared.value, list(column)), strict=True)
        return pd.Series([lang != UNKNOWN and s >= min_score and f >= min_fit for lang, s, f in found], dtype=bool)

    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    return plain.where(good(F.col(f"c{names.index('text')}"))).toDF(*names)
