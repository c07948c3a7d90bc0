"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of the characters (code points) of whole lower-cased texts, weighted
by 1 + log(count) and an inverse document frequency that is counted over all training rows, and
normalised. The model is fitted with follow-the-regularised-leader updates, on the features that
a batch of rows has, and an elastic-net penalty, which leaves most weights at zero; its
probabilities are calibrated by a temperature on rows that the fit has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.llm import runtime as R

#: Hashed features (a power of two), lengths of the n-grams in characters, and labelled rows that the fit sees at most.
FEATURE_BITS, ORDERS, FIT_ROWS = 13, (1, 2, 3), 6000
FEATURES = 1 << FEATURE_BITS
#: Labelled rows of a language at least, of those that the fit sees; so it learns the FIT_ROWS // LEAST_ROWS most frequent languages.
LEAST_ROWS = 20
EPOCHS, ALPHA, BETA, L1, L2 = 6, 0.8, 1.0, 2e-3, 1e-4
_ROWS = 64
#: Characters that are hashed at once.
_PART = 1 << 20


def _codes(low: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Row * FEATURES + feature of every n-gram inside a row, from code points and their rows."""
    codes = []
    low = low.astype(np.uint32)
    for n in ORDERS:
        size = len(low) - n + 1
        if size <= 0:
            continue
        h = low[:size].copy()
        for k in range(1, n):
            h = h * np.uint32(0x01000193) ^ low[k : size + k]
        h = h * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        feature = (h >> np.uint32(32 - FEATURE_BITS)).astype(np.int64)
        at = row[:size] * FEATURES + feature
        codes.append(at[row[:size] == row[n - 1 :]] if n > 1 else at)
    return np.concatenate(codes) if codes else np.zeros(0, np.int64)


def term_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Counts of the FEATURES features (rows x FEATURES), for up to _ROWS texts at a time."""
    for start in range(0, len(column), _ROWS):
        part = pa.compute.utf8_lower(column.slice(start, _ROWS).cast(pa.large_string()).fill_null(""))
        lengths = pa.compute.utf8_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = len(part)
        out = np.zeros(rows * FEATURES, dtype=np.int64)
        a = 0
        while a < rows:
            # some texts at once; one very long text goes in parts, each with the characters that its last n-grams need
            b = max(a + 1, a + int(np.searchsorted(np.cumsum(lengths[a:]), _PART, side="right")))
            points = np.frombuffer("".join(part[a:b].to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            row = np.repeat(np.arange(a, b, dtype=np.int64), lengths[a:b])
            more = max(ORDERS) - 1
            for lo in range(0, len(points), _PART):
                hi = lo + _PART
                codes = _codes(points[lo : hi + more], row[lo : hi + more])
                out += np.bincount(codes, minlength=len(out))
                if hi < len(points):  # what lies past the edge alone comes again with the next part
                    out -= np.bincount(_codes(points[hi : hi + more], row[hi : hi + more]), minlength=len(out))
            a = b
        yield out.reshape(rows, FEATURES)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return (x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  #: FEATURES + 1 (a constant) x languages
    temperature: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        x = weighted(counts, self.idf)
        return _softmax((x @ self.weights[:-1] + self.weights[-1]) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


Rows = list[tuple[np.ndarray, np.ndarray]]


def ftrl(x: Rows, y: np.ndarray, features: int, classes: int, of: np.ndarray | None = None, seed: int = 7, batch: int = 16) -> np.ndarray:
    """Weights of a multinomial logistic regression by FTRL-proximal updates on small batches of the rows ``of``.

    A row is its features, in order, and their values. Only the features of a batch are touched.
    """
    z, n = np.zeros((features, classes)), np.zeros((features, classes))
    target = np.eye(classes)[y]
    rng = np.random.default_rng(seed)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        order = rng.permutation(np.arange(len(x)) if of is None else of)
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            used = np.unique(np.concatenate([x[r][0] for r in rows]))
            block = np.zeros((len(rows), len(used)))
            for i, r in enumerate(rows):
                block[i, np.searchsorted(used, x[r][0])] = x[r][1]
            w = weights(z[used], n[used])
            g = block.T @ (_softmax(block @ w) - target[rows]) / len(rows) * 4
            old = n[used]
            z[used] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / ALPHA * w
            n[used] += g * g
    return weights(z, n)


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()

    a, b, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for counts in term_counts(batch.column("text")):
            total += (counts > 0).sum(0)
            rows += len(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(FEATURES), -1).astype(np.int64)), pa.array(np.append(total, rows).astype(np.int64))], names=["feature", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, at = batch.column("lang").to_pylist(), 0
        for counts in term_counts(batch.column("text")):
            where = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(langs[at : at + len(counts)], pa.string()),
                    pa.array([i.astype(np.uint16).tobytes() for i in where], pa.binary()),
                    pa.array([c[i].astype(np.uint32).tobytes() for i, c in zip(where, counts, strict=True)], pa.binary()),
                ],
                names=["lang", "at", "n"],
            )
            at += len(counts)


def train(rows: DataFrame) -> Model | None:
    """Fit a model to rows of (doc_id, text, lang); None if there are no labelled texts.

    The document frequencies are over all rows with a text and a language. The weights come
    from FIT_ROWS of them at most, an even share for each language, those with the smallest
    hashes of their ids; a fifth of these set the temperature. Of more languages than
    FIT_ROWS // LEAST_ROWS those with the most rows are learned. Empty texts count as rows
    without n-grams, repeated rows as often as they are there; a null id is as good as any.
    """
    rows = R.columns(rows, "doc_id", "text", "lang").where("text is not null and lang is not null").select(F.xxhash64("doc_id").alias("h"), "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(FIT_ROWS // LEAST_ROWS).collect()}
    if not sizes:
        return None
    frequency = {r.feature: r.n for r in R.arrow_map(rows.select("text"), _document_frequency, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    total = frequency.pop(-1, 0)
    idf = np.log((1 + total) / (1 + np.asarray([frequency.get(i, 0) for i in range(FEATURES)]))) + 1
    languages = sorted(sizes)
    share = FIT_ROWS // len(languages)
    spread = float(1 << 64)
    # hashes below the bound are a share of 1.2 times the rows wanted; what is below makes it exact
    bound = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, 1.2 * (share + 30) / sizes[k]))])
    picked = rows.where((F.col("h").cast("double") / spread + 0.5) <= bound[F.col("lang")]).repartition(R.partitions(rows.sparkSession), "h").select("h", "text", "lang")
    got = R.arrow_map(picked.select("text", "lang"), _sparse, "lang string, at binary, n binary").limit(4 * FIT_ROWS).collect()
    got.sort(key=lambda r: (r.lang, r.at, r.n))
    by_lang: dict[str, list] = {}
    for r in got:
        by_lang.setdefault(r.lang, []).append(r)
    rng = np.random.default_rng(11)
    chosen = [own[i] for lang in languages if (own := by_lang.get(lang)) for i in rng.permutation(len(own))[:share]]
    x: Rows = []
    for r in chosen:
        at, n = np.frombuffer(r.at, np.uint16).astype(np.int64), np.frombuffer(r.n, np.uint32)
        v = (1 + np.log(n)) * idf[at]
        v = v / max(np.sqrt((v**2).sum()), 1e-12)
        x.append((np.append(at, FEATURES), np.append(v, 1.0)))  # the constant comes last
    y = np.asarray([languages.index(r.lang) for r in chosen], dtype=np.int64)
    apart = np.arange(len(y)) % 5 == 0 if len(y) >= 20 else np.zeros(len(y), bool)
    w = ftrl(x, y, FEATURES + 1, len(languages), np.flatnonzero(~apart))
    logits = np.asarray([v @ w[at] for at, v in (x[i] for i in np.flatnonzero(apart))]).reshape(-1, len(languages))
    return Model(languages, idf, w.astype(np.float32), best_temperature(logits, y[apart]))


def has_letter(text: str | None) -> bool:
    """Whether a character is of a Unicode category of letters (digits, numerals and fractions aren't)."""
    return bool(text) and any(map(str.isalpha, text))


def _predicted(column: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray]:
    """Language and its probability for each text: und and 0 without a letter or a model."""
    letters = [has_letter(x) for x in column.to_pylist()]
    if model is None:
        return ["und"] * len(letters), np.zeros(len(letters))
    p = [model.probabilities(c) for c in term_counts(column)]
    p = np.concatenate(p) if p else np.zeros((0, len(model.languages)))
    best, score = p.argmax(1), p.max(1)
    return [model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def predict(documents: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row with lang_pred and score, the calibrated probability.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if
    there is no model. Ties go to the first language in order. Repeated rows, and nulls in
    other columns, are kept as they are.
    """
    rows = R.columns(documents, *keep, "text").select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _predicted(batch.column(batch.num_columns - 1), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores.astype(np.float64), pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return R.arrow_map(rows, run, f"{schema}, lang_pred string, score double")


def with_language(documents: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The documents, all columns, whose text has a language with a probability of ``least`` or more.

    Null texts and texts without a letter go. Without a model there is nothing to reject the
    others by, and they stay. Rows are independent: repeated ones stay or go together.
    """
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                yield batch.filter(pa.array([has_letter(x) for x in batch.column(at).to_pylist()], pa.bool_()))
                continue
            langs, scores = _predicted(batch.column(at), model)
            yield batch.filter(pa.array([a != "und" and b >= least for a, b in zip(langs, scores, strict=True)], pa.bool_()))

    return R.same_columns(documents, run)
