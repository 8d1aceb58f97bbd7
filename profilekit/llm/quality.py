"""Text quality by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed trigrams of its character classes (letters by
case, digits, white space, each mark) and of its lower-cased letters, plus a few
counts that say how much of it repeats. Log counts with inverse document
frequencies are reduced by a singular value decomposition of a bounded sample of
labelled texts. The sample's latent vectors are broadcast; every document takes
exact cosine products with all of them, a block of documents at a time, and its
nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilekit.llm.common import bounded_labels, id_crc, with_text_columns
from profilekit.runtime import quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled texts in the sample at most (about), hashed trigrams of each kind, latent dimensions, voting neighbours.
LABELLED, BUCKETS, LATENT, NEIGHBOURS = 4096, 1024, 48, 15
#: Bins of each repetition measure, and the weight of these terms against trigrams.
BINS, REPETITION_WEIGHT = 12, 3.0
TERMS = 2 * BUCKETS + 4 * BINS
#: Documents in a block of cosine products, and bytes of text looked at in one step.
BLOCK, STEP = 256, 1 << 20


def class_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bytes to character classes, and bytes to lower-cased letters with everything else alike."""
    shape, letters = np.zeros(256, np.uint32), np.zeros(256, np.uint32)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            shape[b], letters[b] = 1, b - 127
        elif c.isalpha():
            shape[b], letters[b] = 2 + c.isupper(), 130 + ord(c.lower())
        elif c.isdigit():
            shape[b], letters[b] = 4, 260
        elif c == "\n":
            shape[b], letters[b] = 5, 128
        elif c.isspace():
            shape[b], letters[b] = 6, 128
        else:
            shape[b], letters[b] = 7 + b, 128
    return shape, letters


SHAPE, LETTERS = class_tables()


def bucketed(classes: np.ndarray) -> np.ndarray:
    """Counts of hashed trigrams of a sequence of classes."""
    if len(classes) < 3:
        return np.zeros(BUCKETS)
    mixed = classes[:-2] * np.uint32(0x9E3779B1) + classes[1:-1] * np.uint32(0x85EBCA6B) + classes[2:] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return np.bincount((mixed >> np.uint32(12)) % np.uint32(BUCKETS), minlength=BUCKETS)


def counts(text: str) -> np.ndarray:
    """Term counts of a whole text, in steps of bounded memory."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    total = np.zeros(TERMS)
    for at in range(0, len(data), STEP):
        part = data[max(0, at - 2) : at + STEP]
        total[:BUCKETS] += bucketed(SHAPE[part])
        total[BUCKETS : 2 * BUCKETS] += bucketed(LETTERS[part])
    words = text.split()
    if words:
        distinct = len(set(words))
        # How much of the text is new words, plainly and for its length; how long its words are, and how many.
        measures = (
            distinct / len(words),
            np.log(distinct + 1) / np.log(len(words) + 1),
            min(1.0, len(text) / len(words) / 24),
            min(1.0, len(words) ** 0.25 / 16),
        )
        for k, x in enumerate(measures):
            total[2 * BUCKETS + k * BINS + min(BINS - 1, int(x * BINS))] = 1
    return total


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log counts times inverse document frequencies, rows of length one (or zero)."""
    x = np.log1p(rows) * idf
    x[:, : 2 * BUCKETS] /= np.maximum(np.linalg.norm(x[:, : 2 * BUCKETS], axis=1, keepdims=True), 1e-12)
    x[:, 2 * BUCKETS :] *= REPETITION_WEIGHT / 10
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Voters:
    """The latent space and the labelled vectors in it; their number is bounded by the sample."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def vote(self, rows: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest neighbours, weighted by cosine; the prior where no neighbour has any."""
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        latent = unit(weighted(rows, self.idf).astype(np.float32) @ self.axes)
        k, out = min(NEIGHBOURS, len(self.labels)), np.empty(len(rows))
        for at in range(0, len(rows), BLOCK):
            cosine = latent[at : at + BLOCK] @ self.vectors.T
            near = np.argpartition(cosine, len(self.labels) - k, axis=1)[:, len(self.labels) - k :]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0).astype(np.float64) ** 4
            total = weight.sum(axis=1)
            share = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[at : at + BLOCK] = np.where(total > 1e-9, share, self.prior)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", trained=None, labelled: int = LABELLED) -> Voters:
    """Latent space and voters from about ``labelled`` labelled texts at most, drawn by hash of their id.

    Term counts are taken on the executors; only the sample's counts reach the
    driver. Null labels and unmatched labels are left out, null texts count as
    empty. Without labelled texts every score is 0.5.
    """
    sample = bounded_labels(labels, doc_id, label, F.lit(True) if trained is None else trained, labelled)
    texts = docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("body")).join(
        F.broadcast(sample), F.col("id") == F.col("train_id")
    )

    def start():
        return lambda bodies: [[counts(b).astype("<u4").tobytes() for b in bodies]]

    rows = with_text_columns(texts.select("body", "id", "train_label"), "body", [T.StructField("counts", T.BinaryType())], start)
    found = sorted(rows.select("id", "train_label", "counts").toArrow().to_pylist(), key=lambda r: (r["id"], r["train_label"], r["counts"]))
    if not found:
        return Voters(np.ones(TERMS), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    raw = np.stack([np.frombuffer(r["counts"], "<u4") for r in found]).astype(np.float64)
    y = np.array([float(r["train_label"] > 0) for r in found])
    idf = np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))) + 1.0
    x = weighted(raw, idf).astype(np.float32)
    _, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = axes[:, ::-1][:, : min(LATENT, len(raw))].astype(np.float32)
    return Voters(idf, axes, unit(x @ axes), y, float(y.mean()))


def score(docs: DataFrame, voters: Voters, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the likelihood of label 1; a column of this name is replaced.

    A null or empty text has no direction and gets the prior. Repeated rows stay.
    Long texts are counted whole, in steps of bounded memory. No shuffle.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(
        (voters.idf, voters.axes, voters.vectors, voters.labels, voters.prior)
    )

    def start():
        own = Voters(*broadcast.value)

        def compute(texts):
            out = [np.zeros(0)]
            for at in range(0, len(texts), BLOCK):
                out.append(own.vote(np.stack([counts(t) for t in texts[at : at + BLOCK]])))
            return [np.concatenate(out)]

        return compute

    return with_text_columns(docs, text, [T.StructField("score", T.DoubleType())], start)


def trained_rows(doc_id: str = "doc_id"):
    """The training part: the id's checksum modulo 4 is not 2."""
    return id_crc(F.col(quoted(doc_id))) % 4 != 2
