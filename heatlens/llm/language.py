"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, runs of anything but letters become one space, and the character
n-grams of orders 1 to 3 are hashed into ``BUCKETS`` features. Document frequencies cover
every training row; the weights are fitted by follow-the-regularised-leader (proximal, with
an elastic net, so most stay 0) on a bounded sample. A temperature calibrates the probabilities. It
is fitted on a part of the sample that the weights have not seen: whole texts and, as these are
easily told apart, a piece of a few words from each, with smoothed targets, so that rows
without an error don't make it certain of everything.

Null texts and texts without a letter get ``und`` and score 0; so does every text when there
is no training row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from heatlens.llm.common import chunks

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
# The weights are fitted on this many labelled rows at most, spread evenly over the labels.
SAMPLE_DOCS = 6000
EPOCHS = 3
# The temperature is also fitted on pieces of 1 to so many words.
PIECE_WORDS = 6
TEMPERATURES = np.geomspace(0.05, 20, 80)
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
UNDETERMINED = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram buckets and how often each occurs; empty without a letter."""
    codes = _codes((text or "").lower())
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    plain = np.where(letter, codes, 32).astype(np.uint32)[keep]
    plain = np.concatenate([[np.uint32(32)], plain, [np.uint32(32)]]).astype(np.uint32)
    mixed = np.zeros(len(plain), np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for order in range(1, max(ORDERS) + 1):
        span = plain[order - 1 :]
        mixed = (mixed[: len(span)] + span) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        if order in ORDERS:
            counts += np.bincount(mixed >> np.uint32(17), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        values = (1 + np.log(counts)) * self.idf[found]
        return values / (np.sqrt(values @ values) or 1.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        found, counts = features(text)
        if not len(found) or not self.labels:
            return UNDETERMINED, 0.0
        logits = (self.vector(found, counts) @ self.weights[found] + self.bias) / self.temperature
        odds = np.exp(logits - logits.max())
        best = int(odds.argmax())
        return self.labels[best], float(odds[best] / odds.sum())


def _document_frequencies(rows: DataFrame) -> np.ndarray:
    """In how many of all rows each bucket occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in chunks(batches):
            for text in batch["text"].to_pylist():
                seen[features(text)[0]] += 1
        found = np.flatnonzero(seen)
        yield pa.record_batch({"bucket": pa.array(found, pa.int64()), "df": pa.array(seen[found], pa.int64())})

    frequencies = np.zeros(BUCKETS, np.int64)
    for row in rows.select("text").mapInArrow(count, "bucket long, df long").groupBy("bucket").sum("df").collect():
        frequencies[row[0]] = row[1]
    return frequencies


# A label, and the buckets and counts of a text.
Example = tuple[int, np.ndarray, np.ndarray]


def piece(text: str | None, place: int) -> str:
    """A few words in a row, how many and which by ``place``; the whole text if it has no more."""
    words = (text or "").split()
    size = place % PIECE_WORDS + 1
    start = place // PIECE_WORDS % max(1, len(words) - size + 1)
    return " ".join(words[start : start + size])


def _sample(rows: DataFrame, per_label: int, sizes: dict[str, int]) -> list[tuple[Example, Example]]:
    """About ``per_label`` rows of each label, by hashed id: the whole text and a piece of it."""
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 40))
    share = F.lit(0).cast("long")
    for label, size in sizes.items():
        share = F.when(F.col("lang") == label, int(min(1.0, per_label / size) * (1 << 40))).otherwise(share)
    index = {label: i for i, label in enumerate(sizes)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch["text"].to_pylist()
            pieces = [piece(t, at) for t, at in zip(texts, batch["place"].to_pylist())]
            columns = {"place": batch["place"], "label": pa.array([index[x] for x in batch["lang"].to_pylist()], pa.int64())}
            for name, some in (("whole", texts), ("piece", pieces)):
                found = [features(t) for t in some]
                columns[f"{name}_buckets"] = pa.array([f.astype("<u2").tobytes() for f, _ in found], pa.binary())
                columns[f"{name}_counts"] = pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary())
            yield pa.record_batch(columns)

    def example(row, name: str) -> Example:
        found, counts = np.frombuffer(row[f"{name}_buckets"], "<u2"), np.frombuffer(row[f"{name}_counts"], "<u4")
        return row.label, found.astype(int), counts.astype(int)

    chosen = rows.withColumn("place", place).filter(place < share).select("place", "lang", "text")
    got = chosen.mapInArrow(
        encode,
        "place long, label long, whole_buckets binary, whole_counts binary, piece_buckets binary, piece_counts binary",
    ).collect()
    got.sort(key=lambda r: (r.place, r.label, r.whole_buckets))
    return [(example(r, "whole"), example(r, "piece")) for r in got]


def _softmax(logits: np.ndarray) -> np.ndarray:
    odds = np.exp(logits - logits.max())
    return odds / odds.sum()


def fit_weights(model: LanguageModel, sample: list) -> None:
    """Follow the regularised leader: each weight is the closed-form minimiser of the
    gradients seen so far plus the elastic net, and 0 inside the L1 band."""
    n = len(model.labels)
    z, g2 = np.zeros((BUCKETS + 1, n)), np.zeros((BUCKETS + 1, n))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        pull = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -pull / ((BETA + np.sqrt(g2[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for label, found, counts in sample:
            if not len(found):
                continue
            at = np.append(found, BUCKETS)
            x = np.append(model.vector(found, counts), 1.0)
            w = weights(at)
            error = _softmax(x @ w)
            error[label] -= 1
            gradient = x[:, None] * error
            before = g2[at]
            after = before + gradient**2
            z[at] += gradient - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
            g2[at] = after
    fitted = weights(slice(None))
    model.weights, model.bias = fitted[:-1], fitted[-1]


def fit_temperature(model: LanguageModel, sample: list[Example]) -> None:
    """The temperature with the smallest log loss, on a grid of equal ratios. Of N rows the label is held to
    be right with N + 1 in N + 2, the others share the rest; with one label there is nothing to calibrate."""
    sample = [s for s in sample if len(s[1])]
    n = len(model.labels)
    if not sample or n < 2:
        return
    logits = np.array([model.vector(f, c) @ model.weights[f] + model.bias for _, f, c in sample])
    rest = 1 / (len(sample) + 2)
    targets = np.full(logits.shape, rest / (n - 1))
    targets[np.arange(len(sample)), [y for y, _, _ in sample]] = 1 - rest

    def loss(t: float) -> float:
        scaled = (logits - logits.max(axis=1, keepdims=True)) / t
        return -float((targets * (scaled - np.log(np.exp(scaled).sum(axis=1, keepdims=True)))).sum())

    model.temperature = float(min(TEMPERATURES, key=loss))


def train(rows: DataFrame) -> LanguageModel:
    """``rows``: ``doc_id`` (only to draw the sample), ``text``, non-null ``lang``."""
    sizes = {r.lang: r["count"] for r in sorted(rows.groupBy("lang").count().collect(), key=lambda r: r.lang)}
    total = sum(sizes.values())
    if not total:
        return LanguageModel([], np.zeros(BUCKETS))
    model = LanguageModel(list(sizes), np.log((1 + total) / (1 + _document_frequencies(rows))) + 1)
    sample = _sample(rows, max(1, SAMPLE_DOCS // len(sizes)), sizes)
    apart = len(sample) >= 50
    fit_weights(model, [whole for i, (whole, _) in enumerate(sample) if i % 5 or not apart])
    fit_temperature(model, [one for both in (sample[::5] if apart else sample) for one in both])
    return model


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; only ``text`` is looked at."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = [model.predict(t) for t in batch["text"].to_pylist()]
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "lang_pred": pa.array([f[0] for f in found], pa.string()),
                    "score": pa.array([f[1] for f in found], pa.float64()),
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        score, "doc_id long, lang_pred string, score double"
    )
