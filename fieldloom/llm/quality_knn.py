"""Quality classifier: nearest-neighbour voting over labelled latent-semantic vectors.

Terms are pairs of neighbouring byte kinds (letters by case, digits, line ends, single symbols) and word repetitions, so
they say how a text is written, not what about or in which language. Weighted by inverse document frequency and projected
on the leading singular vectors of the labelled sample, texts are compared by exact cosines, block by block, with every
labelled vector. Labels vote with the power of their similarity.

What the driver and every task hold is bounded by max_labelled: labelled vectors and term weights, about 10 MB.

Defined results: a null or empty text scores the labelled sample's mean label; without labelled texts every score is 0.5;
labels with null doc_id or quality are left out, of several for a doc_id the smallest counts; rows that repeat a doc_id are
scored each by its own text; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import bytehash
from fieldloom.llm.common import steps, text_bytes, tidy

#: Kinds of bytes: lower, upper, digit, space, line feed, other control, beyond ASCII, then these symbols, then the others.
_SYMBOLS = ".,;:!?#$%&*|<>()[]{}/\\@=+-_\"'"
_KINDS = 8 + len(_SYMBOLS)


def _kinds() -> np.ndarray:
    kind = np.full(256, 7 + len(_SYMBOLS), np.int64)
    kind[97:123], kind[65:91], kind[48:58], kind[32], kind[10] = 0, 1, 2, 3, 4
    kind[:10], kind[11:32], kind[128:] = 5, 5, 6
    for k, c in enumerate(_SYMBOLS):
        kind[ord(c)] = 7 + k
    return kind


_KIND = _kinds()
#: Terms: byte kind pairs; word equal to the one before; word seen earlier in the text, by tenths of the words.
TERMS = _KINDS * _KINDS + 1 + 11


def term_shares(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of every text the square roots of its terms' shares, float32 (texts, TERMS)."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    if not len(raw):
        return out
    text = np.repeat(np.arange(n), np.diff(offsets))
    kind = _KIND[raw]
    pair = kind[:-1] * _KINDS + kind[1:]
    same = text[1:] == text[:-1]
    counts = np.bincount((text[:-1] * (_KINDS * _KINDS) + pair)[same], minlength=n * _KINDS * _KINDS).reshape(n, -1)
    out[:, : _KINDS * _KINDS] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    start, end, of = bytehash.words(raw, offsets)
    if len(start):
        h = bytehash.run_hashes(raw, start, end, lower=True)
        total = np.maximum(np.bincount(of, minlength=n), 1)
        again = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        out[:, _KINDS * _KINDS] = np.sqrt(np.bincount(of[1:][again], minlength=n) / total)
        order = np.lexsort((h, of))
        hs, os = h[order], of[order]
        seen = np.bincount(os[1:][(hs[1:] == hs[:-1]) & (os[1:] == os[:-1])], minlength=n) / total
        has = np.bincount(of, minlength=n) > 0
        out[np.flatnonzero(has), _KINDS * _KINDS + 1 + np.floor(seen[has] * 10).astype(int)] = 1.0
    return out


@dataclass(frozen=True)
class Model:
    """Term weights, projection (terms, dims), labelled unit vectors (rows, dims) and their labels."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: float

    def embed(self, shares: np.ndarray) -> np.ndarray:
        v = (shares * self.weights) @ self.projection
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def score(self, shares: np.ndarray, block: int = 512) -> np.ndarray:
        """Votes of the nearest labelled vectors, for blocks of texts."""
        if not len(self.labels):
            return np.full(len(shares), 0.5)
        out = np.full(len(shares), float(self.labels.mean()))
        k = min(self.neighbours, len(self.labels))
        for at in range(0, len(shares), block):
            q = self.embed(shares[at : at + block])
            sims = q @ self.vectors.T
            near = np.argpartition(sims, len(self.labels) - k, axis=1)[:, len(self.labels) - k :]
            w = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(float) ** self.power
            total = w.sum(1)
            vote = (w * self.labels[near]).sum(1)
            some = total > 0
            out[at : at + block][some] = vote[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def fit(shares: np.ndarray, labels: np.ndarray, dims: int = 48, neighbours: int = 15, power: float = 16.0) -> Model:
    """Inverse document frequencies and the leading right singular vectors of the weighted terms."""
    n = len(shares)
    weights = (np.log((1 + n) / (1 + (shares > 0).sum(0))) + 1).astype(np.float32) if n else np.ones(TERMS, np.float32)
    weights[_KINDS * _KINDS] *= 4  # repetition of words is one term among very many pairs
    x = shares * weights
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64)) if n else (None, np.eye(TERMS))
    model = Model(weights, vectors[:, ::-1][:, :dims].astype(np.float32).copy(), np.zeros((0, dims), np.float32), np.zeros(0), neighbours, power)
    return Model(model.weights, model.projection, model.embed(shares), labels.astype(float), neighbours, power)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[np.ndarray, np.ndarray]:
    """Term shares and labels of the training rows with the smallest hashes of their ids, max_labelled at most."""
    picked = (
        labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality")

    @tidy
    def terms(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            for lo, hi in steps(offsets):
                x = term_shares(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), batch.column("quality").slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "terms"])

    rows = texts.mapInArrow(terms, "doc_id long, quality int, terms binary").orderBy(F.xxhash64("doc_id"), "doc_id", "terms").limit(max_labelled).collect()
    shares = np.array([np.frombuffer(r.terms, np.float16) for r in rows], np.float32).reshape(len(rows), TERMS)
    return shares, np.array([r.quality for r in rows], float)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, **how) -> Model:
    return fit(*labelled_sample(docs, labels, max_labelled), **how)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and score (double); no shuffle. A column named score is replaced."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            scores = [shared.value.score(term_shares(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])) for lo, hi in steps(offsets)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", score double"
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labelled: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels, max_labelled)).select("doc_id", "score")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
