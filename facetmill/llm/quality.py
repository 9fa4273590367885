"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words and its byte trigrams (each hashed to a bounded
number of places), pairs of neighbouring character classes, and how often its
word pairs are repeated (in powers of two). All are weighted alike: by the log
of their frequency in a thousand and by inverse document frequency. The
weights and a truncated singular value decomposition are learned on a bounded
sample of labelled documents: at most ``max_labelled``, chosen by a hash of text
and id, are fitted on, projected and broadcast. Every document is projected,
its cosine to every labelled vector is computed exactly, block by block, and
the labels of the nearest ones vote with their similarity as weight.

Only narrow work is done on the documents: no shuffle, whatever their number.
A text is read in parts of about 256 KiB, cut at white space, so what a task
holds besides is a few bytes for each of its words.

Defined results: null and empty texts, and any text if there is no labelled
row, have no neighbours and get the labelled rows' share of label 1 (1.0
without any); labels other than 0 and 1 and labels without id or document are
not learned from; repeated rows get the same score. A row without id is not
held out. Columns of documents besides doc_id and text are not looked at, and
their names may be any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, unused_name, written
from .shingles import _shingles, parts_at_spaces, word_hashes

RANK, NEIGHBOURS, MAX_LABELLED = 48, 15, 8192
THRESHOLD = 0.3

# Characters that share a class; bytes of other characters are told apart as lead, continuation or rest.
CLASSES = ("a", "e", "i", "o", "u", "bcd", "fgh", "jkl", "mnp", "qrs", "tvw", "xyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", " ", "\t\n\r", ".", ",", "!", "?", "#", "$", "%", "&", "*", "|", "'\"")
N_CLASSES = len(CLASSES) + 3
#: Places for hashed words and trigrams, and steps of repetition (once, twice, 4 times, …).
N_WORDS, N_TRIGRAMS, N_REPEATS = 512, 512, 8
N_PAIRS = N_CLASSES * N_CLASSES
N_TERMS = N_PAIRS + N_WORDS + N_TRIGRAMS + N_REPEATS
_TRIGRAM_FACTOR = np.uint32(0x9E3779B1)


def _class_table() -> np.ndarray:
    table = np.full(256, N_CLASSES - 1, dtype=np.uint16)
    table[0x80:0xC0], table[0xC0:] = N_CLASSES - 2, N_CLASSES - 3
    for i, chars in enumerate(CLASSES):
        table[[ord(c) for c in chars]] = i
    return table


_TABLE = _class_table()


def _byte_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Counts of class pairs and of hashed trigrams."""
    data = np.frombuffer(raw, dtype=np.uint8)
    kinds = _TABLE[data]
    pairs = np.bincount(kinds[:-1] * np.uint16(N_CLASSES) + kinds[1:], minlength=N_PAIRS)
    wide = data.astype(np.uint32)
    trigrams = ((wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]) * _TRIGRAM_FACTOR
    return pairs, np.bincount(trigrams >> np.uint32(32 - N_TRIGRAMS.bit_length() + 1), minlength=N_TRIGRAMS)


def term_vector(text: str) -> np.ndarray:
    """Log frequencies in a thousand of a text's terms: class pairs, words, trigrams, repeated word pairs."""
    out = np.zeros(N_TERMS, dtype=np.float32)
    raw = text.encode("utf-8", "replace")
    if not raw:
        return out
    pairs, trigrams, words = np.zeros(N_PAIRS), np.zeros(N_TRIGRAMS), []
    for part in parts_at_spaces(raw):
        p, t = _byte_counts(part)
        pairs, trigrams = pairs + p, trigrams + t
        words.append(word_hashes(part))
    words = np.concatenate(words)
    repeats = np.zeros(N_REPEATS)
    if len(words):
        times = np.unique(_shingles(words, min(2, len(words))), return_counts=True)[1]
        steps = np.minimum(np.frexp(times)[1] - 1, N_REPEATS - 1)
        repeats = np.bincount(steps, times, minlength=N_REPEATS)
    at = 0
    for counts in (pairs, np.bincount((words % np.uint64(N_WORDS)).astype(np.int64), minlength=N_WORDS), trigrams, repeats):
        out[at : at + len(counts)] = np.log1p(counts * (1000.0 / max(1.0, counts.sum())))
        at += len(counts)
    return out


def weighted(terms: np.ndarray, weight: np.ndarray, rows: int = 512) -> Iterator[np.ndarray]:
    """The terms times their weights, some rows at a time."""
    for at in range(0, len(terms), rows):
        yield terms[at : at + rows] * weight


@dataclass
class Model:
    weight: np.ndarray  # per term
    basis: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled x rank, unit length
    labels: np.ndarray
    prior: float

    def project(self, terms: np.ndarray) -> np.ndarray:
        z = np.concatenate([x @ self.basis for x in weighted(terms, self.weight)] or [np.zeros((0, self.basis.shape[1]), np.float32)])
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)

    def score(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(terms), self.prior)
        z = self.project(terms)
        cosine = z @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(cosine, len(self.labels) - k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(cosine, near, 1).astype(np.float64), 0.0)
        total = weight.sum(1)
        vote = (weight * self.labels[near]).sum(1)
        return np.clip(np.divide(vote, total, out=np.full(len(z), self.prior), where=total > 0), 0.0, 1.0)


def fit_vectors(terms: np.ndarray, labels: np.ndarray, rank: int = RANK, rounds: int = 6) -> Model:
    """Weights, the leading singular directions (by subspace iteration, which never makes a terms x terms table) and the labelled vectors."""
    n = len(labels)
    if not n:
        return Model(np.ones(N_TERMS, np.float32), np.zeros((N_TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 1.0)
    seen = sum((x > 0).sum(0) for x in weighted(terms, np.ones(terms.shape[1], np.float32)))
    weight = (1 + np.log((1 + n) / (1 + seen))).astype(np.float32)
    basis = np.random.default_rng(7).standard_normal((terms.shape[1], min(rank + 12, n))).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(sum(x.T @ (x @ basis) for x in weighted(terms, weight)))[0]
    turn = np.linalg.svd(np.concatenate([x @ basis for x in weighted(terms, weight)]), full_matrices=False)[2].T
    basis = np.ascontiguousarray((basis @ turn)[:, : min(rank, n)])
    model = Model(weight, basis, np.zeros((0, 1), np.float32), labels.astype(np.float64), float(labels.mean()))
    model.vectors = model.project(terms)
    return model


def held_out(doc_id: Column) -> Column:
    """True for every fifth row, by checksum of the id as text; no label of these is learned."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learns from at most ``max_labelled`` labelled documents that are not held out."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    marks = marks.where(~held_out(F.col("doc_id"))).distinct()
    order = F.xxhash64("doc_id", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [term_vector(t.as_py() or "").astype(np.float16).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.binary())], names=["quality", "terms"])

    known = docs.where("doc_id is not null").select("doc_id", "text", order.alias("place"))
    labelled = written(known.select("doc_id", "place").join(marks, "doc_id"), "quality-labelled")
    chosen = hash_sample(labelled, "place", max_labelled, labelled.count())
    texts = known.join(chosen, ["doc_id", "place"]).orderBy("place", "doc_id", "quality").select("quality", "text")
    rows = texts.mapInArrow(vectors, "quality int, terms binary").toArrow()  # at most max_labelled vectors of N_TERMS short numbers
    terms = np.empty((rows.num_rows, N_TERMS), dtype=np.float16)
    for i, value in enumerate(rows.column("terms")):
        terms[i] = np.frombuffer(value.as_buffer(), dtype=np.float16)
    marks = rows.column("quality").to_numpy()
    del rows
    return fit_vectors(terms, marks)


def score_quality(docs: DataFrame, model: Model, out: str = "quality_score", block: int = 128) -> DataFrame:
    """The rows of ``docs`` with their score in a new last column."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                terms = np.stack([term_vector(t.as_py() or "") for t in part.column(at)])
                empty = ~terms.any(axis=1)
                scores = np.where(empty, own.prior, own.score(terms))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, out])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    names = [f"`{c}`" for c in docs.columns]
    score = unused_name("quality_score", docs)
    return score_quality(docs.select(*names), fit_quality(docs, labels), score).where(F.col(score) >= threshold).select(*names)
