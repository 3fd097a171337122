"""Document quality by random-indexing word vectors and a small network.

Every word has two units: its form, and its shape (letter case, digits and punctuation with
runs squeezed, and whether it repeats the word before).  Units fall into a fixed number of
buckets.  A bucket has a fixed sparse random index vector; its context vector is the sum of
the index vectors of the words around it, over the whole corpus, in whole numbers.  Both
tables have a fixed size, whatever the corpus.

A document is the mean of its words' unit-length context vectors and of their squares, the
mean of its shapes' context vectors and of their index vectors.  A two-layer network in numpy
is fitted on labelled documents, and a temperature, chosen on rows kept aside, turns its
output into calibrated probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .columns import annotate, blocks, free, ragged, trim, utf8
from .words import NOT_BLANK, mix, span_hashes, split

FORMS, SHAPES, DIMS, ONES = 8192, 1024, 32, 2
REACH = 2  # words on either side that count as context
BLOCK_BYTES = 1 << 20
POOLED_BYTES = 1 << 18  # of text whose words' vectors are in memory at once
SAMPLE_ROWS = 20_000  # labelled documents that a classifier is fitted on, at most
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 0.01, 1e-4
FEATURES = 4 * DIMS

_b = np.arange(256)
#: lower case, upper case, digits and non-ASCII letters as one sign each, others as themselves
_SIGN = np.select(
    [(_b >= 97) & (_b <= 122), (_b >= 65) & (_b <= 90), (_b >= 48) & (_b <= 57), _b >= 128],
    [97, 65, 48, 97], _b,
).astype(np.uint8)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    h = mix(np.arange(1, (FORMS + SHAPES) * ONES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    places = (h >> np.uint64(8)) % np.uint64(DIMS)
    signs = np.where(h & np.uint64(1), 1.0, -1.0)
    return places.astype(np.int64).reshape(-1, ONES), signs.reshape(-1, ONES)


PLACE, SIGN = _index_vectors()


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Form bucket and shape bucket of each word, and where each text's words begin."""
    words = split(data, offsets, NOT_BLANK)
    form = span_hashes(data, words.starts, words.ends)
    sign = _SIGN[data]
    kept = np.ones(len(sign), bool)
    kept[1:] = sign[1:] != sign[:-1]
    kept[words.starts] = True
    at = np.concatenate([[0], np.cumsum(kept)])
    shape = span_hashes(sign[kept], at[words.starts], at[words.ends])
    again = np.zeros(len(form), bool)
    again[1:] = form[1:] == form[:-1]
    again[words.first[:-1][np.diff(words.first) > 0]] = False
    shape = mix(shape ^ again.astype(np.uint64))
    return (form % np.uint64(FORMS)).astype(np.int64), (shape % np.uint64(SHAPES)).astype(np.int64) + FORMS, words.first


def add_contexts(total: np.ndarray, form: np.ndarray, shape: np.ndarray, first: np.ndarray) -> None:
    """Add the contexts of some texts' words to the flat table ``total``."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def add(of: np.ndarray, near: np.ndarray) -> None:
        for k in range(ONES):
            total[:] += np.bincount(of * DIMS + PLACE[near, k], SIGN[near, k], len(total))

    add(form, shape)
    for d in range(1, REACH + 1):
        same = np.flatnonzero(text[d:] == text[:-d])
        for units_ in (form, shape):
            left, right = units_[same], units_[same + d]
            add(left, right)
            add(right, left)


def context_table(documents: DataFrame) -> np.ndarray:
    """Context vector of each bucket over all texts: whole numbers, FORMS + SHAPES rows."""
    n = FORMS + SHAPES
    names = [f"c{i}" for i in range(DIMS)]

    def run(batches):
        total = np.zeros(n * DIMS)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in blocks(offsets, BLOCK_BYTES):
                add_contexts(total, *units(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
        table = total.reshape(n, DIMS).astype(np.int64)
        used = np.flatnonzero(table.any(1))
        batch = data = offsets = total = None
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(table[used, i]) for i in range(DIMS))], names=["bucket", *names])

    parts = documents.select("text").mapInArrow(run, "bucket bigint, " + ", ".join(f"{c} bigint" for c in names))
    sums = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    table = np.zeros((n, DIMS))
    if sums.num_rows:
        table[np.asarray(sums.column("bucket"))] = np.stack([np.asarray(sums.column(c)) for c in names], 1)
    return table


@dataclass
class Pooler:
    """Turns texts into document vectors; fixed size, so that it can be broadcast."""

    forms: np.ndarray
    shapes: np.ndarray

    @staticmethod
    def of(table: np.ndarray) -> Pooler:
        size = np.sqrt((table**2).sum(1, keepdims=True))
        unit = table / np.where(size > 0, size, 1)
        index = np.zeros_like(unit)
        for k in range(ONES):
            np.add.at(index, (np.arange(len(index)), PLACE[:, k]), SIGN[:, k])
        forms = np.concatenate([unit, unit**2], 1)[:FORMS]
        return Pooler(forms.astype(np.float32), np.concatenate([unit, index], 1)[FORMS:].astype(np.float32))

    def pool(self, texts: pa.Array) -> np.ndarray:
        data, offsets = utf8(texts)
        out = np.zeros((len(texts), FEATURES), np.float32)
        for lo, hi in blocks(offsets, POOLED_BYTES):
            form, shape, first = units(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            full = np.flatnonzero(np.diff(first))
            if len(full):
                n = np.diff(first)[full][:, None]
                sums = [np.add.reduceat(t[u], first[full]) for t, u in ((self.forms, form), (self.shapes, shape - FORMS))]
                out[lo + full] = np.concatenate(sums, 1) / n
        return out


def _pooled(shared):
    def start():
        pooler = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            found = pooler.pool(texts)
            return [ragged(found.ravel(), np.full(len(texts), FEATURES), pa.float32())]

        return work

    return start


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
        """Fitted by Adam; one row in six is kept aside for the temperature."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        aside, used = order[: len(y) // 6], order[len(y) // 6 :]
        centre = x[used].mean(0) if len(used) else np.zeros(x.shape[1])
        scale = x[used].std(0) + 1e-3 if len(used) else np.ones(x.shape[1])
        net = Network(centre, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
        params = [net.w1, net.b1, net.w2, np.zeros(1)]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        z = (x - centre) / scale
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            shuffled = rng.permutation(used)
            for lo in range(0, len(shuffled), BATCH):
                rows = shuffled[lo : lo + BATCH]
                hidden = np.tanh(z[rows] @ params[0] + params[1])
                error = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -40, 40))) - y[rows]
                back = error[:, None] * params[2] * (1 - hidden**2)
                n = len(rows)
                slopes = [z[rows].T @ back / n + DECAY * params[0], back.mean(0), hidden.T @ error / n + DECAY * params[2], error.mean(keepdims=True)]
                step += 1
                for p, g, m, v in zip(params, slopes, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        net.b2 = float(params[3][0])
        if len(aside) >= 20:
            logits, marks = net.logits(x[aside]), 2 * y[aside] - 1
            tried = np.geomspace(0.25, 8, 64)
            net.temperature = float(tried[np.argmin([np.logaddexp(0, -marks * logits / t).mean() for t in tried])])
        return net


@dataclass
class Model:
    pooler: Pooler
    network: Network


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never used: crc32 of the doc_id as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> tuple[Model, DataFrame]:
    """A model, and the (doc_id, vector) table of all documents it was fitted from.

    Word vectors come from all texts.  The network is fitted on at most ``sample`` labelled
    rows, the first by a hash of the doc_id, whose label may be used.  Repeated labels of a
    doc_id count once, the larger one; null labels not at all.  Without labels every score is
    one half.
    """
    spark = documents.sparkSession
    pooler = Pooler.of(context_table(documents))
    shared = spark.sparkContext.broadcast(pooler)
    vectors = materialize(annotate(documents.select("doc_id", "text"), ["text"], "vector array<float>", _pooled(shared), ["doc_id"]), "vectors")
    usable = labels.where("quality is not null").where(~held_out("doc_id"))
    known = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # Half as many again by their hashes, so that each task gives the driver its share only.
    share = min(1.0, 1.5 * sample / max(known.count(), 1))
    known = known.where(F.xxhash64("doc_id") <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    rows = vectors.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "vector").limit(sample).toArrow()
    if not rows.num_rows:
        zero = np.zeros(FEATURES)
        return Model(pooler, Network(zero, zero + 1, np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)), vectors
    x = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
    return Model(pooler, Network.fit(x, (np.asarray(rows.column("quality")) >= 1).astype(np.float64))), vectors


def score(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``documents`` (doc_id, text).

    ``labels`` has doc_id and quality (1 good, 0 bad).  Null, empty and blank texts have a zero
    vector and are scored by it.  Repeated rows keep a row each; a null doc_id has no label and
    is not held out.  An empty table stays empty.  Other columns are not looked at.
    """
    model, vectors = fit(documents, labels, sample)
    shared = documents.sparkSession.sparkContext.broadcast(model.network)

    def start():
        def work(found: pa.Array) -> list[pa.Array]:
            x = found.flatten().to_numpy().reshape(len(found), FEATURES).astype(np.float64)
            return [pa.array(shared.value.probability(x), pa.float64())]

        return work

    scored = annotate(vectors, ["vector"], "score double", start, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE_ROWS) -> DataFrame:
    """``documents`` with a score of ``threshold`` or more; all columns stay, nothing is joined.

    Null and empty texts are scored by a zero vector; repeated rows are judged alike; without
    labels every score is one half; an empty table stays empty.  Columns may be called anything.
    """
    model, _ = fit(documents, labels, sample)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    score = free("_llm_score", documents.columns)

    def start():
        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array(shared.value.network.probability(shared.value.pooler.pool(texts).astype(np.float64)), pa.float64())]

        return work

    scored = annotate(documents, ["text"], f"{score} double", start)
    return scored.where(F.col(score) >= threshold).drop(score)
