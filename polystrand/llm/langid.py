"""Language identification: sparse multinomial logistic regression on TF-IDF character
n-grams, trained by follow-the-regularised-leader with elastic-net penalties, with
temperature calibration.

Features are the n-grams of 1 to 3 characters of the lower-cased text, runs of other
characters than letters being one blank, hashed to ``FEATURES`` slots. Document
frequencies count every document that may be learned from; the classifier is fitted on
at most about ``PER_LANGUAGE`` of them for each language, chosen by a hash of doc_id, of
which every fifth sets the temperature.

Defined cases: null and empty texts and texts without a letter are ``und`` with score 0; null
languages are never learned; with nothing to learn from every prediction is ``und``; texts
of any length are read whole; of equally likely languages the first by name is taken;
repeated rows and rows without a doc_id are predicted each; other columns of any name take
no part, and pass through the filter; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, staged, trimmed

FEATURES, ORDERS, PER_LANGUAGE = 1 << 15, 3, 500
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The features of a whole text and their counts; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = is_letter()[points]
    if not letters.any():
        return None
    points = np.where(letters, points, 32)
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    points = points[keep].astype(np.uint32)
    total = np.zeros(FEATURES, dtype=np.int64) if len(points) > 4000 else None
    found, code = [], np.zeros(len(points), dtype=np.uint32)
    for order in range(ORDERS):
        # a code for the n characters from each place on
        code = (code[: len(points) - order] ^ points[order:]) * np.uint32(0x9E3779B1)
        code = code ^ (code >> np.uint32(15))
        slots = (code * np.uint32(0x85EBCA6B + 2 * order)) >> np.uint32(17)
        if total is not None:
            total += np.bincount(slots, minlength=FEATURES)
        else:
            found.append(slots)
    if total is not None:
        kept = np.flatnonzero(total)
        return kept, total[kept]
    return np.unique(np.concatenate(found), return_counts=True)


def tf_idf(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and their unit-length weights, with sublinear term frequencies."""
    slots, counts = found
    weights = (1 + np.log(counts)) * idf[slots]
    norm = np.sqrt(weights @ weights)
    return slots, weights / norm if norm else weights


def gathered(docs: DataFrame, learnable) -> tuple[list[tuple[str, bytes, bytes]], np.ndarray, int]:
    """The sample's languages, features and counts; document frequencies and the number of
    documents, over all that may be learned from."""
    text = F.col("text").cast("string")
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    if not sizes:
        return [], np.zeros(FEATURES, dtype=np.int64), 0
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, PER_LANGUAGE / r["n"])) for r in sizes], "known string, share double")
    place = F.pmod(F.xxhash64(F.lit(10), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), text.alias("text"), place.alias("place"))
    chosen = rows.join(F.broadcast(share), F.col("lang") == F.col("known")).select("lang", "text", (F.col("place") < F.col("share")).alias("chosen"))

    def parts(batches: Iterator[pa.RecordBatch]):
        df, documents = np.zeros(FEATURES, dtype=np.int64), 0
        for b in batches:
            out = []
            for lang, value, take in zip(*(b.column(i) for i in range(3)), strict=True):
                found = ngram_counts(value.as_py())
                if found is not None:
                    df[found[0]] += 1
                    documents += 1
                    if take.as_py():
                        out.append((lang.as_py(), found[0].astype("<u2").tobytes(), found[1].astype("<u4").tobytes()))
            if out:
                yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary()))] + [pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.int64())], names=["lang", "slots", "counts", "slot", "n"])
        slots = np.append(np.flatnonzero(df), -1)
        n = np.append(df[slots[:-1]], documents)
        yield pa.record_batch([pa.nulls(len(slots), pa.string()), pa.nulls(len(slots), pa.binary()), pa.nulls(len(slots), pa.binary()), pa.array(slots, pa.int32()), pa.array(n, pa.int64())], names=["lang", "slots", "counts", "slot", "n"])

    small_batches(docs.sparkSession)
    found = staged(chosen.mapInArrow(lambda batches: trimmed(parts(batches)), "lang string, slots binary, counts binary, slot int, n long"), "ngrams")
    sample = sorted(map(tuple, found.where("lang is not null").select("lang", "slots", "counts").collect()))
    sums = dict(map(tuple, found.where("slot is not null").groupBy("slot").agg(F.sum("n")).collect()))  # at most FEATURES rows
    discard(found)
    documents = sums.pop(-1, 0)
    df = np.zeros(FEATURES, dtype=np.int64)
    df[list(sums)] = list(sums.values())
    return sample, df, documents


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = 4, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 10) -> np.ndarray:
    """Weights (feature, class): FTRL-Proximal with per-coordinate rates; slot FEATURES is
    the constant term."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            slots, x = rows[i]
            at = np.append(slots, FEATURES)
            x = np.append(x, 0.1)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(z, n)


def scores(row: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> np.ndarray:
    slots, x = row
    return x @ weights[slots] + 0.1 * weights[FEATURES]


def fit(docs: DataFrame, learnable) -> dict:
    """The classifier: languages, idf, weights and temperature."""
    sample, df, documents = gathered(docs, learnable)
    languages = sorted({x[0] for x in sample})
    idf = np.log((1 + documents) / (1 + df)) + 1
    rows = [tf_idf((np.frombuffer(s, "<u2").astype(np.int64), np.frombuffer(c, "<u4")), idf) for _, s, c in sample]
    labels = np.array([languages.index(x[0]) for x in sample], dtype=np.int64)
    held = np.arange(len(rows)) % 5 == 4
    weights = train_ftrl([r for r, h in zip(rows, held, strict=True) if not h], labels[~held], len(languages)) if rows else np.zeros((FEATURES + 1, 0))
    temperature = 1.0
    if held.any():
        logits = np.array([scores(r, weights) for r, h in zip(rows, held, strict=True) if h])
        truth = labels[held]
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        temperature = float(min(np.exp(np.linspace(-1.5, 3, 91)), key=loss))
    return {"languages": languages, "idf": idf, "weights": weights, "temperature": temperature}


def predict(docs: DataFrame, model: dict, *more: str) -> DataFrame:
    """doc_id, lang_pred and score of every row, and the columns ``more``. The text alone
    is looked at."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            names, sure = [], []
            for value in b.column(0):
                found = ngram_counts(value.as_py()) if model["languages"] else None
                if found is None:
                    names.append(UNKNOWN)
                    sure.append(0.0)
                    continue
                p = softmax(scores(tf_idf(found, model["idf"]), model["weights"]) / model["temperature"])
                names.append(model["languages"][int(p.argmax())])
                sure.append(float(p.max()))
            yield pa.record_batch([*b.columns[1:], pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=[*b.schema.names[1:], "lang_pred", "score"])

    kept = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *more)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]] + ["lang_pred string", "score double"])
    small_batches(docs.sparkSession)
    return kept.mapInArrow(lambda batches: trimmed(rows(batches)), schema)


def held_out() -> F.Column:
    """True for documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on all but the held-out documents."""
    model = fit(docs, ~held_out())
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_share(row: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> float:
    """The share of a text's squared weight that is on n-grams the classifier has kept; it is
    low for junk and for languages that nothing was learned of, however sure the softmax is."""
    slots, x = row
    return float(x * x @ weights[slots].any(1))


def keep_identified(docs: DataFrame, model: dict, least_known: float = 0.2, least_margin: float = 0.05) -> DataFrame:
    """The rows whose language is known, unchanged: with at least ``least_known`` of the text
    in n-grams of the learned languages, and a probability of at least ``least_margin`` of
    the way from chance to certainty."""
    least_score = (chance := 1 / max(len(model["languages"]), 1)) + least_margin * (1 - chance)

    def identified(text: str | None) -> bool:
        found = ngram_counts(text) if model["languages"] else None
        if found is None:
            return False
        row = tf_idf(found, model["idf"])
        return known_share(row, model["weights"]) >= least_known and (chance == 1 or softmax(scores(row, model["weights"]) / model["temperature"]).max() >= least_score)

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield b.filter(pa.array([identified(value.as_py()) for value in b.column(b.schema.get_field_index("text"))], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(lambda batches: trimmed(rows(batches)), docs.schema)
