"""Near-duplicate groups by MinHash, with odd sketches as the filter between bands and full sets.

1. Each text becomes its set of word shingles.  Equal sets are one class, known by a digest.
2. A class has ``ROWS * BANDS`` MinHash values, in bands by the wanted similarity.  Classes whose values agree on all rows of a
   band share a bucket.
3. The values are also folded into an odd sketch: value i and its place are hashed to one bit
   of a bitmap, and each time that bit is flipped.  Equal values cancel, so the ones in the XOR
   of two bitmaps tell how many values differ, most precisely where few do.
   A second bitmap is made from all shingles of the set: the ones in the XOR of two can only be
   fewer than the shingles in which the sets differ, so too many rule a pair out for certain.
4. Pairs whose sketches allow the wanted similarity are compared on their full sets.

In a bucket, first every class is paired with the least one only.  Most buckets fall into one
component by that.  In the others each class is paired with those of other components, in
blocks of bounded size that compare bitmaps and give out only pairs that pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..storage import discard, materialize
from .columns import Work, annotate, blocks, ragged, trim, utf8
from .components import components
from .words import FOLD, NOT_BLANK, mix, span_hashes, split

BANDS, ROWS = 42, 6  # of similarity 0.8 and more; the number of values is the same for all
MISSED = 4e-6  # at most, the probability that two sets of the wanted similarity share no bucket
SKETCH_BITS = 1024
SET_BITS = 2048
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 2048  # classes of one bucket that are compared with as many others at a time
PAIRS_HELD = 1 << 17  # of a block, before all but the nearest are dropped
FILTER_BITS = 1 << 25  # of the bitmap that tells which texts a comparison may need, or which may go: 4 MB
PAGE_BITS = 1 << 15  # of the bitmaps that Spark aggregates
_rng = np.random.default_rng(20_11)
FACTORS = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
PLACES = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def bands_for(similarity: float) -> tuple[int, int]:
    """Bands and rows that find a pair of this similarity but for a probability of ``MISSED``."""
    for rows in range(ROWS, 0, -1):
        bands = BANDS * ROWS // rows
        if (1 - similarity**rows) ** bands <= MISSED:
            return bands, rows
    raise ValueError(f"similarity {similarity} is too low for {BANDS * ROWS} MinHash values")


def shingle_sets(texts: pa.Array, words_each: int):
    """Sorted hashes of the distinct shingles of each text, a block of texts at a time."""
    data, offsets = utf8(texts)
    for lo, hi in blocks(offsets, BLOCK_BYTES):
        folded = FOLD[data[offsets[lo] : offsets[hi]]]
        words = split(folded, offsets[lo : hi + 1] - offsets[lo], NOT_BLANK)
        h = span_hashes(folded, words.starts, words.ends)
        for a, b in zip(words.first, words.first[1:]):
            yield shingles(h[a:b], words_each)


def shingles(h: np.ndarray, words_each: int) -> np.ndarray:
    n = len(h) - words_each + 1
    if len(h) == 0:
        return h
    width = words_each if n > 0 else len(h)
    out = np.full(max(n, 1), width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[k : k + len(out)])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _digest(shingle: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle.tobytes(), digest_size=16).digest()


def min_hashes(shingle: np.ndarray) -> np.ndarray:
    x = (shingle >> np.uint64(32)).astype(np.uint32)
    step = max(1, (1 << 18) // len(x))
    out = np.empty(len(FACTORS), np.uint32)
    for i in range(0, len(out), step):
        out[i : i + step] = (FACTORS[i : i + step, None] * x + SHIFTS[i : i + step, None]).min(1)
    return out


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Bitmap as 64-bit words: parity of the values, each with its place, that fall on a bit."""
    bit = (mix(PLACES ^ values.astype(np.uint64)) >> np.uint64(40)).astype(np.int64) % SKETCH_BITS
    return _parity(bit, SKETCH_BITS)


def set_sketch(shingle: np.ndarray) -> np.ndarray:
    """The same of all shingles of a set."""
    return _parity((shingle >> np.uint64(16)).astype(np.int64) % SET_BITS, SET_BITS)


def _parity(bit: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits((np.bincount(bit, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def most_ones(similarity: float) -> int:
    """Ones in the XOR of two sketches beyond which the similarity is surely lower.

    Allows five standard deviations of the MinHash sample and as many of the folding.
    """
    k = BANDS * ROWS
    worst = max(0.0, similarity - 5 * (similarity * (1 - similarity) / k) ** 0.5)
    flips = 2 * k * (1 - worst)
    ones = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** flips)
    return int(ones + 5 * (flips * flips / SKETCH_BITS) ** 0.5)


def most_apart(left, right, similarity: float):
    """Shingles in which sets of these sizes differ at most, at the similarity."""
    return (left + right) * ((1 - similarity) / (1 + similarity)) + 1e-6


def signatures(documents: DataFrame, words_each: int, similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, class, buckets, sketch, whole); class is null for a text without words."""
    bands, rows = bands_for(similarity)

    def start():
        def work(texts: pa.Array) -> list[pa.Array]:
            sizes, classes, keys, sketches, wholes = [], [], [], [], []
            band = mix(np.arange(bands, dtype=np.uint64) + np.uint64(77))
            for s in shingle_sets(texts, words_each):
                sizes.append(len(s))
                if not len(s):
                    classes.append(None)
                    continue
                classes.append(_digest(s))
                values = min_hashes(s)
                key = band.copy()
                for row in values[: bands * rows].reshape(bands, rows).T:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
                keys.append(key.view(np.int64))
                sketches.append(odd_sketch(values))
                wholes.append(set_sketch(s))
            full = np.array(sizes) > 0
            flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            return [
                pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()),
                ragged(flat(keys), full * bands, pa.int64()), ragged(flat(sketches), full * (SKETCH_BITS // 64), pa.int64()),
                ragged(flat(wholes), full * (SET_BITS // 64), pa.int64()),
            ]

        return work

    added = "n_shingles bigint, class binary, buckets array<bigint>, sketch array<bigint>, whole array<bigint>"
    return annotate(documents.select("doc_id", "text"), ["text"], added, start, keep=["doc_id"])


def close_enough(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity."""
    left = sketches.select(F.col("class").alias("a"), F.struct("n_shingles", "sketch", "whole").alias("_a"))
    right = sketches.select(F.col("class").alias("b"), F.struct("n_shingles", "sketch", "whole").alias("_b"))

    def ones(field: str):
        differ = F.zip_with(F.col("_a")[field], F.col("_b")[field], lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        return F.aggregate(differ, F.lit(0), lambda s, x: s + x)

    one, two = F.col("_a.n_shingles"), F.col("_b.n_shingles")
    sizes = F.least(one, two) >= F.greatest(one, two) * similarity - 0.001
    near = sizes & (ones("sketch") <= most_ones(similarity)) & (ones("whole") <= most_apart(one, two, similarity))
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b")


def class_of(words_each: int):
    """The class of each text, as :func:`signatures` gives it."""

    def start():
        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([_digest(s) if len(s) else None for s in shingle_sets(texts, words_each)], pa.binary())]

        return work

    return start


def _place(key: str):
    """Bit of a key in the bitmap."""
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def _page(key: str):
    return F.floor(_place(key) / PAGE_BITS)


def _pages(keys: DataFrame) -> DataFrame:
    """(page, bits): the bitmap of the keys in the only column, without its empty pages."""
    key = keys.columns[0]
    return keys.groupBy(_page(key).alias("page")).agg(F.bitmap_construct_agg(_place(key) % PAGE_BITS).alias("bits"))


def split_by(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose key is surely not in the only column of ``keys``, and the others.

    The bitmap of the keys, which is of fixed size, is broadcast.  So only the others, which
    are the rows that have such a key and few more, need be shuffled to be told apart.  They
    have the key's page beside them, ``_llm_page``: a join by the key alone would be moved
    before this one, and shuffle all rows.
    """
    pages = _pages(keys).withColumnsRenamed({"page": "_llm_page", "bits": "_llm_bits"})
    placed = df.join(F.broadcast(pages), _page(key) == F.col("_llm_page"), "left")
    at = _place(key) % PAGE_BITS
    byte = F.substring("_llm_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))
    there = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) == 1
    columns = [F.col(f"`{c}`") for c in df.columns]
    return placed.where(~F.coalesce(there, F.lit(False))).select(*columns), placed.where(there).select(*columns, "_llm_page")


def rows_in(df: DataFrame, key: str, wanted: DataFrame, inputs: Sequence[str], added: str, start: Callable[[], Work]) -> DataFrame:
    """Rows of ``df`` whose key may be in the only column of ``wanted``, and few others, annotated.

    The keys' hashes are set in a bitmap of fixed size, which is broadcast; so the texts of
    other rows need not be shuffled.  Many keys let more rows through, but lose none.  The
    columns ``added`` are computed as by :func:`annotate`, in the same pass: two passes in a
    stage would take two Python workers a task, which Spark keeps.
    """
    whole = np.zeros((FILTER_BITS // PAGE_BITS, PAGE_BITS // 8), np.uint8)
    for r in _pages(wanted).collect():
        whole[r.page] = np.frombuffer(r.bits, np.uint8)
    shared, names = df.sparkSession.sparkContext.broadcast(whole.ravel()), df.columns
    schema = StructType([*df.schema, *StructType.fromDDL(added)])

    def run(batches):
        work = start()
        for batch in batches:
            at = np.asarray(batch.column(0))
            there = (shared.value[at >> 3] >> (at & 7)) & 1
            held = pa.RecordBatch.from_arrays(batch.columns[1:], names=names).filter(pa.array(there.astype(bool)))
            batch = at = there = None
            yield pa.RecordBatch.from_arrays([*held.columns, *work(*[held.column(c) for c in inputs])], names=schema.names)
            held = None
        work = None
        trim()

    return df.select(_place(key).alias("_llm_place"), *[F.col(f"`{c}`") for c in df.columns]).mapInArrow(run, schema)


def class_texts(documents: DataFrame, first: DataFrame, pairs: DataFrame, words_each: int) -> DataFrame:
    """(class, text) for the classes in ``pairs``; ``first`` has the least doc_id of each.

    Rows may share a doc_id, or lack one, and differ in text, so the class is told from the
    text again, and rows are joined by it.
    """
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    chosen = materialize(needed.join(first, "class").select("class", "least"), "needed")
    named = rows_in(documents.select("doc_id", "text"), "doc_id", chosen.select("least"), ["text"], "class binary", class_of(words_each))
    return named.join(chosen.select("class"), "class", "left_semi").dropDuplicates(["class"]).select("class", "text")


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: float, words_each: int) -> DataFrame:
    """The pairs whose full sets have the similarity; ``texts`` has one text per class."""
    percent = round(similarity * 100)
    left = texts.select(F.col("class").alias("a"), F.col("text").alias("_ta"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("_tb"))

    def start():
        def work(one: pa.Array, two: pa.Array) -> list[pa.Array]:
            out = []
            for s, t in zip(shingle_sets(one, words_each), shingle_sets(two, words_each)):
                both = np.intersect1d(s, t, assume_unique=True).size
                out.append(100 * both >= percent * (len(s) + len(t) - both))
            return [pa.array(out, pa.bool_())]

        return work

    held = pairs.join(right, "b").join(left, "a")
    return annotate(held, ["_ta", "_tb"], "linked boolean", start, keep=["a", "b"]).where("linked").select("a", "b")


class Nearest:
    """The ``best`` nearest pairs (a, b) of any two components, and which of these have more.

    Pairs are added in any order and thinned out whenever they have doubled, so what is held
    grows with what is taken, not with the pairs that were compared.  A pair is two whole
    numbers: that of its components, and that of its distance and members, below ``n``.
    """

    def __init__(self, n: int, best: int) -> None:
        self.n, self.best, self.most = n, best, PAIRS_HELD
        self.waiting: list[np.ndarray] = []
        self.held, self.thinned = 0, False
        self.cut = np.zeros(0, np.int64)  # components that had more

    def add(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append(np.stack([low * self.n + high, (ones * self.n + a) * self.n + b]))
        self.held += len(low)
        if self.held > self.most:
            self._thin()
            self.thinned = True
            self.most = max(PAIRS_HELD, 2 * self.held)

    def _thin(self) -> None:
        pairs = np.concatenate(self.waiting, 1)
        self.waiting.clear()
        pairs = pairs[:, np.lexsort(pairs[::-1])]  # by components, nearest first
        begins = np.flatnonzero(np.diff(pairs[0], prepend=-1))
        n = np.diff(np.append(begins, pairs.shape[1]))
        self.cut = np.union1d(self.cut, pairs[0, begins[n > self.best]])
        kept = pairs[:, np.arange(pairs.shape[1]) - np.repeat(begins, n) < self.best]
        self.waiting.append(kept)
        self.held = kept.shape[1]

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self._thin()
        of, rank = self.waiting[0]
        return rank // self.n % self.n, rank % self.n, np.isin(of, self.cut)


def other_pairs(members: DataFrame, similarity: float, best: int) -> DataFrame:
    """(bucket, a, b, more): pairs of different components whose sketches allow the similarity.

    ``members`` has bucket, class, label, n_shingles, sketch and whole.  A task compares the
    classes of one bucket, or two blocks of a larger one, and gives out the ``best`` pairs of
    any two components; ``more`` tells that they have further ones.  In a large bucket the
    classes of its largest component are only compared with the others, so what is sent does
    not grow with that component's square.
    """
    in_label = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("_k"))
    sizes = in_label.groupBy("bucket").agg(
        F.sum("_k").alias("_n"), F.max("_k").alias("_large"), F.max_by("label", F.struct("_k", "label")).alias("_top")
    )
    blocks_of = lambda n: F.greatest(F.ceil(n / BLOCK_ROWS), F.lit(1)).cast("int")
    blocked = members.join(sizes, "bucket").withColumns({
        "_major": (F.col("_n") > BLOCK_ROWS) & (F.col("label") == F.col("_top")),
        "_minors": F.when(F.col("_n") > BLOCK_ROWS, blocks_of(F.col("_n") - F.col("_large"))).otherwise(F.lit(1)),
        "_majors": F.when(F.col("_n") > BLOCK_ROWS, blocks_of(F.col("_large"))).otherwise(F.lit(0)),
    })
    own = F.pmod(F.xxhash64("class"), F.when(F.col("_major"), F.col("_majors")).otherwise(F.col("_minors"))).cast("int")
    blocked = blocked.withColumn("_own", own)

    def with_blocks(n: str, i, j):
        each = F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(each, lambda x: F.struct(F.lit(n == "_majors" or i is None).alias("_cross"), (x if i is None else i(x)).alias("_i"), j(x).alias("_j")))

    minor = F.concat(
        with_blocks("_minors", lambda x: F.least(F.col("_own"), x), lambda x: F.greatest(F.col("_own"), x)),
        with_blocks("_majors", lambda x: F.col("_own"), lambda x: x),
    )
    major = with_blocks("_minors", None, lambda x: F.col("_own"))
    blocked = blocked.withColumn("_with", F.explode(F.when(F.col("_major"), major).otherwise(minor))).select("*", "_with.*")
    limit = most_ones(similarity)
    kind = members.schema["class"].dataType
    schema = StructType([StructField("a", kind), StructField("b", kind), *StructType.fromDDL("more boolean, bucket bigint")])

    def compare(key: tuple[object, ...], frame: pd.DataFrame) -> pd.DataFrame:
        bucket, cross, i, j = key
        frame = frame.sort_values("class", ignore_index=True)
        bits = np.stack(frame["sketch"].to_numpy()).view(np.uint64)
        whole = np.stack(frame["whole"].to_numpy()).view(np.uint64)
        size, name = frame["n_shingles"].to_numpy(), frame["class"].to_numpy()
        large, own = frame["_major"].to_numpy(), frame["_own"].to_numpy()
        code = pd.factorize(frame["label"], sort=True)[0]
        mine, other = (np.flatnonzero(~large), np.flatnonzero(large)) if cross else (np.flatnonzero(own == i), np.flatnonzero(own == j))
        nearest = Nearest(len(frame), best)
        for r in mine:
            ok = (code[other] != code[r]) & ((other > r) if i == j and not cross else True)
            ok &= np.minimum(size[other], size[r]) >= np.maximum(size[other], size[r]) * similarity - 0.001
            near = other[ok]
            if len(near):
                ones = np.bitwise_count(bits[near] ^ bits[r]).sum(1, dtype=np.int64)
                near = near[ones <= limit]
                ones = np.bitwise_count(whole[near] ^ whole[r]).sum(1, dtype=np.int64)
                ok = ones <= most_apart(size[near], size[r], similarity)
                near, ones = near[ok], ones[ok]
                low, high = np.minimum(code[near], code[r]), np.maximum(code[near], code[r])
                nearest.add(low, high, ones, np.minimum(near, r), np.maximum(near, r))
        a, b, more = nearest.taken()
        found = pd.DataFrame({"a": name[a], "b": name[b], "more": more, "bucket": bucket})
        if nearest.thinned:
            del bits, whole, frame, nearest, a, b, more
            trim()  # takes too long for the many small buckets, which hold nothing
        return found

    columns = ["bucket", "_cross", "_i", "_j", "_own", "_major", "class", "label", "n_shingles", "sketch", "whole"]
    return blocked.select(*columns).groupBy("bucket", "_cross", "_i", "_j").applyInPandas(compare, schema)


def open_buckets(buckets: DataFrame, labels: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(bucket, class, label) of buckets of three classes and more in two components and more.

    ``wanted`` has the only buckets to look at, if given.

    Of buckets with the same classes one is enough; two are the same if their number, least
    class and two sums of 64-bit hashes agree.
    """
    named = buckets.where("_n > 2").join(labels.withColumnRenamed("node", "class"), "class", "left")
    named = named.select("bucket", "class", F.coalesce("label", "class").alias("label"))
    mixed = named.groupBy("bucket").agg(
        F.min("label").alias("_low"), F.max("label").alias("_high"), F.count(F.lit(1)).alias("_n"), F.min("class").alias("_first"),
        F.bit_xor(F.xxhash64("class")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("_y"),
    )
    if wanted is not None:
        mixed = mixed.join(wanted, "bucket", "left_semi")
    mixed = mixed.where("_low <> _high").groupBy("_n", "_first", "_x", "_y").agg(F.min("bucket").alias("bucket"))
    return named.join(mixed.select("bucket"), "bucket", "left_semi")


def near_duplicates(documents: DataFrame, similarity: float = 0.8, words_each: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``documents`` (doc_id, text).

    Texts are linked if the Jaccard similarity of their sets of ``words_each``-word shingles
    (lower-cased A-Z, split at blanks) is ``similarity`` or more; a text of fewer words has its
    whole sequence as its only shingle.  ``component_id`` is the least doc_id that links reach,
    ``kept`` whether that is the row's own.  Null, empty and blank texts have no shingles and
    are linked with nothing.  Equal sets are linked by their digest, whatever their number;
    repeated rows keep a row each.  A row without a doc_id is linked like any other and is
    never the least one unless all of its component are without.  An empty table stays empty.
    Other columns are not looked at.  Bands are chosen for the similarity; one for which no
    choice misses a pair with a probability of ``MISSED`` at most (below 0.05) is an error.
    """
    return _with_classes(documents, similarity, words_each).drop("class")


def _with_classes(documents: DataFrame, similarity: float, words_each: int) -> DataFrame:
    """:func:`near_duplicates` with the digest of each row's set, ``class``, beside it."""
    signed = materialize(signatures(documents, words_each, similarity), "signatures")
    classes = signed.where("class is not null")
    distinct = materialize(classes.select("class", "n_shingles", "buckets", "sketch", "whole").dropDuplicates(["class"]), "classes")
    slim = materialize(signed.select("doc_id", "n_shingles", "class"), "memberships")
    discard(signed)
    first = slim.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    # Dealt by bucket once, for the counts and for the join with them.
    rows = distinct.select(F.explode("buckets").alias("bucket"), "class").repartition("bucket")
    shared = rows.groupBy("bucket").agg(F.min("class").alias("a"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    buckets = materialize(rows.join(shared, "bucket"), "buckets")
    # Bitmaps of classes that share no bucket are compared with nothing, so no join need shuffle them.
    met = split_by(distinct.select("class", "n_shingles", "sketch", "whole"), "class", buckets.select("class"))[1]
    sketches = materialize(met.drop("_llm_page"), "sketches")
    discard(distinct)
    stars = buckets.where("class <> a").select("a", F.col("class").alias("b")).distinct()
    candidates = materialize(close_enough(stars, sketches, similarity), "candidates")
    texts = class_texts(documents, first, candidates, words_each)
    links = materialize(confirmed(candidates, texts, similarity, words_each), "links")
    labels = components(links)

    # A link joins two components whole, so each two are tried by their nearest pairs first.
    # More are taken, in the buckets that have more, until every pair that may be linked was
    # compared or is in one component.
    best, wanted = 64, None
    while True:
        members = open_buckets(buckets, labels, wanted).join(sketches, "class")
        found = materialize(other_pairs(members, similarity, best), "pairs")
        new = materialize(found.select("a", "b").distinct().join(candidates, ["a", "b"], "left_anti"), "candidates")
        if not new.isEmpty():
            texts = class_texts(documents, first, new, words_each)
            links = materialize(links.union(confirmed(new, texts, similarity, words_each)), "links")
            candidates = candidates.union(new)
            labels = components(links)
        left = labels.select(F.col("node").alias("a"), F.col("label").alias("_la"))
        right = labels.select(F.col("node").alias("b"), F.col("label").alias("_lb"))
        apart = F.coalesce("_la", "a") != F.coalesce("_lb", "b")
        wanted = found.where("more").join(left, "a", "left").join(right, "b", "left").where(apart)
        wanted = materialize(wanted.select("bucket").distinct(), "further")
        if wanted.isEmpty():
            break
        best *= 64

    placed = first.join(labels.withColumnRenamed("node", "class"), "class", "left")
    placed = materialize(placed.select("class", "least", F.coalesce("label", "class").alias("label")), "placed")
    # Written, so that adaptive execution may split a component of very many classes, or broadcast.
    ids = materialize(placed.groupBy("label").agg(F.min("least").alias("component_id")), "components")
    component = materialize(placed.join(ids, "label").select("class", "component_id"), "component-of-class")
    discard(sketches)
    discard(buckets)
    joined = slim.where("class is not null").join(component, "class").select("doc_id", "n_shingles", "component_id", "class")
    alone = slim.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "class")
    return joined.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(documents: DataFrame, similarity: float = 0.8, words_each: int = 5) -> DataFrame:
    """``documents`` with one document of each group of near-duplicates: that of the least doc_id.

    All columns stay.  Rows that repeat a doc_id with one text are one document.  Where a
    doc_id stands for several texts, each is judged by itself.  Rows without a doc_id stay, as
    nothing could name them, and so do null and empty texts.  An empty table stays empty.
    Columns may be called anything.
    """
    inner = [c if c in ("doc_id", "text") else f"_given{i}" for i, c in enumerate(documents.columns)]
    return _kept(documents.toDF(*inner), similarity, words_each).toDF(*documents.columns)


def _kept(documents: DataFrame, similarity: float, words_each: int) -> DataFrame:
    judged = materialize(_with_classes(documents, similarity, words_each).where("doc_id is not null").select("doc_id", "class", "kept"), "judged")
    gone = judged.where("not kept").select("doc_id", "class").distinct()
    gone = gone.select(F.col("doc_id").alias("_llm_gone"), F.col("class").alias("_llm_class"), _page("doc_id").alias("_llm_at"))
    # An id that stays with one text and goes with another; only its rows have their class told again.
    both = materialize(gone.join(judged.where("kept"), F.col("doc_id") == F.col("_llm_gone"), "left_semi"), "both")
    clear = gone.join(both.select("_llm_gone").distinct(), "_llm_gone", "left_anti")
    stay, others = split_by(documents, "doc_id", gone.select("_llm_gone"))
    named = (F.col("doc_id") == F.col("_llm_gone")) & (F.col("_llm_page") == F.col("_llm_at"))
    kept = others.join(clear, named, "left_anti")
    if both.isEmpty():
        return stay.unionByName(kept.drop("_llm_page"))
    ids = both.select("_llm_gone", "_llm_at").distinct()
    sure = kept.join(ids, named, "left_anti").drop("_llm_page")
    unsure = kept.join(ids, named, "left_semi").drop("_llm_page")
    told = annotate(unsure, ["text"], "_llm_told binary", class_of(words_each))
    same = (F.col("doc_id") == F.col("_llm_gone")) & (F.col("_llm_told") == F.col("_llm_class"))
    return stay.unionByName(sure).unionByName(told.join(both, same, "left_anti").drop("_llm_told"))
