"""Quality by nearest-neighbour voting in a latent semantic space.

Terms are hashed byte pairs and a few shares (capitals, symbols, repeated lines, repeated word windows, word length). The space is the leading singular vectors of
the weighted terms of a bounded, balanced sample of labelled documents; the sample's vectors are broadcast (at most ``2 * per_label`` of them) and every
document's cosines with all of them are computed in blocks. The ``k`` nearest vote with their similarity; of equally near ones those with the smallest ids. Cosines are
double-precision sums rounded to 9 places, so that no vote hangs on the order in which a block's products are summed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import _LOWER, buffers, hashed_words, shingle_hashes, slices

BUCKETS = 1024
SHARES = 6
#: How much a share counts against a byte pair's weight.
SHARE_WEIGHT = 6.0
_CLASS = np.arange(256)
_PAIR = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(13)).astype(np.int64) % BUCKETS


def repeated(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Entries of each row whose hash stands earlier in the row."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    return np.bincount(r[1:][same], minlength=n)


def terms(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Term weights of consecutive texts: rows of BUCKETS damped byte-pair counts and SHARES shares; zero for an empty text."""
    n = len(offsets) - 1
    offsets = offsets.astype(np.int64)
    out = np.zeros((n, BUCKETS + SHARES), np.float32)
    body = data[offsets[0] : offsets[-1]]
    if not len(body):
        return out
    at = offsets - offsets[0]
    sizes = np.diff(at)
    row = np.repeat(np.arange(n), sizes)
    pair = body[:-1].astype(np.int64) * 256 + body[1:]
    inside = row[:-1] == row[1:]
    counts = np.bincount(row[:-1][inside] * BUCKETS + _PAIR[pair[inside]], minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, :BUCKETS] = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    total = lambda mask: np.bincount(row[mask], minlength=n)
    upper = total((body >= 65) & (body <= 90))
    symbol = total(np.isin(body, np.frombuffer(b"#*$%&|<>!", np.uint8)))
    words, of = hashed_words(offsets, data)
    n_words = np.bincount(of, minlength=n)
    windows, wof = shingle_hashes(words, of, 3, n)
    lines = body == 10
    for i, (x, y, least) in enumerate(((upper, sizes, 100), (symbol, n_words, 20), (repeated(windows, wof, n), n_words, 20), (repeated(words, of, n), n_words, 40), (total(lines), n_words, 40), (sizes - total(lines), n_words, 40))):
        out[:, BUCKETS + i] = np.sqrt(x / (y + least))
    out[:, BUCKETS + 5] *= 0.1
    out[sizes == 0] = 0
    return out


class Model:
    """Weights, axes and the labelled vectors; at most a few MB whatever the corpus."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, dims: int, k: int):
        seen = (x[:, :BUCKETS] > 0).sum(axis=0)
        self.weight = np.ones(x.shape[1], np.float32)
        self.weight[:BUCKETS] = np.log((1 + len(x)) / (1 + seen)) * 0.3 + 0.1
        self.weight[BUCKETS:] = SHARE_WEIGHT
        x = self.unit(x * self.weight)
        _, axes = np.linalg.eigh(x.T @ x) if len(x) else (None, np.eye(x.shape[1]))
        self.axes = np.ascontiguousarray(axes[:, ::-1][:, :dims])
        self.vectors = self.unit(self.projected(x)).astype(np.float64)
        self.labels, self.k = labels.astype(np.float32), min(k, len(labels))

    @staticmethod
    def unit(x):
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return (x / np.where(norm > 0, norm, 1)).astype(np.float32)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """On the axes, to 6 places: the same for a text whatever others stand in its block."""
        return np.round(x.astype(np.float64) @ self.axes, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Votes for label 1 among the k nearest, weighted by similarity; without text or labelled rows, 0.5 drawn to 0 for empty texts."""
        empty = ~x.any(axis=1)
        if not self.k:
            return np.where(empty, 0.0, 0.5)
        v = self.unit(self.projected(self.unit(x * self.weight))).astype(np.float64)
        out = np.empty(len(v))
        for at in range(0, len(v), 512):
            cos = np.round(v[at : at + 512] @ self.vectors.T, 9)
            near = np.argpartition(-cos, self.k - 1, axis=1)[:, : self.k]
            sim = np.take_along_axis(cos, near, 1)
            least = sim.min(axis=1)
            for row in np.flatnonzero((cos >= least[:, None]).sum(axis=1) > self.k):  # ties at the last place: vectors are in order of ids
                above = np.flatnonzero(cos[row] > least[row])
                near[row] = [*above, *np.flatnonzero(cos[row] == least[row])[: self.k - len(above)]]
                sim[row] = cos[row, near[row]]
            vote = np.maximum(sim, 0.0) ** 8 + 1e-12
            out[at : at + 512] = (vote * self.labels[near]).sum(axis=1) / vote.sum(axis=1)
        out[empty] = 0.0
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def batches_of(column, limit: int = 1 << 20):
    offsets, data = buffers(column)
    for a, b in slices(offsets, limit):
        yield a, b, offsets[a : b + 1], data


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1500, dims: int = 48, k: int = 15) -> Model:
    """Learn from at most ``per_label`` documents of each label: those with the smallest hashes of their ids, held-out ids left out.

    Null labels and ids teach nothing; of contradictory labels of an id the smaller holds; of rows with one id that is chosen the one with the least terms counts. An empty table of either kind
    gives a model that scores 0.5.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64("doc_id")
    chosen = known.where("quality = 0").orderBy(order).limit(per_label).unionByName(known.where("quality = 1").orderBy(order).limit(per_label))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * per_label rows of two numbers

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, offsets, data in batches_of(batch.column(1)):
                x = terms(offsets, data).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    rows = texts.select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("int")).mapInArrow(run, "doc_id long, quality int, x binary")
    rows = sorted(rows.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("r")).select("doc_id", "r.*").collect(), key=lambda r: r.doc_id)  # one row an id
    x = np.array([np.frombuffer(r.x, np.float16) for r in rows], np.float32).reshape(-1, BUCKETS + SHARES)
    return Model(x, np.array([r.quality for r in rows]), dims, k)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null or empty text scores 0; a text of any length is read whole; a null id counts as not held out. Repeated rows score alike; ties among neighbours go to the smallest ids. An empty table gives an empty result. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see Model

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, offsets, data in batches_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sent.value.score(terms(offsets, data)), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
