"""Benchmark decontamination with suffix arrays over the training texts.

A task sorts the suffixes of its documents' words, a few MB of text at a time, and looks every
suffix of the benchmark up in that array by binary search.  The range found holds all places
where the suffix occurs, its neighbours give the longest match.  Suffixes are compared up to
the length of a window, which decides every hit, and those that cannot match two words of any
benchmark suffix (one, for one-word windows) are left out of the array before it is sorted.
Longest matches go on beyond the window: where whole windows were found, the words of both
sides are sorted once more to their ends, by prefix doubling.

Words are compared by 64-bit hashes; within the benchmark's vocabulary they become ranks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .columns import annotate, blocks, ragged, trim, utf8
from .words import FOLD, WORDY, span_hashes, split

WINDOW = 10
BLOCK_BYTES = 1 << 20  # of training text whose suffixes are sorted together
BENCHMARK_BYTES = 64 << 20  # of benchmark text that is broadcast at a time


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts, and where each text's words begin."""
    folded = FOLD[data]
    words = split(folded, offsets, WORDY)
    return span_hashes(folded, words.starts, words.ends), words.first


def windows_of(ranks: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``depth`` ranks from each place on, packed in pairs; 0 pads past the end."""
    padded = np.concatenate([ranks, np.zeros(depth + 1, ranks.dtype)]).astype(np.uint64)
    pairs = []
    for k in range(0, depth, 2):
        second = padded[at + k + 1] if k + 1 < depth else np.uint64(0)
        pairs.append((padded[at + k] << np.uint64(32)) | second)
    return np.stack(pairs)


def before(left: np.ndarray, right: np.ndarray, strict: bool) -> np.ndarray:
    """Whether packed rows of ``left`` stand before those of ``right``."""
    less, same = np.zeros(left.shape[1], bool), np.ones(left.shape[1], bool)
    for a, b in zip(left, right):
        less |= same & (a < b)
        same &= a == b
    return less if strict else less | same


def common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many leading words packed rows share; 0 pads do not count."""
    n, same = np.zeros(left.shape[1], np.int64), np.ones(left.shape[1], bool)
    low = np.uint64(0xFFFFFFFF)
    for a, b in zip(left, right):
        for x, y in ((a >> np.uint64(32), b >> np.uint64(32)), (a & low, b & low)):
            same &= (x == y) & (x > 0)
            n += same
    return n


def cut(packed: np.ndarray, lengths: np.ndarray, rest: int = 0) -> None:
    """Put ``rest`` (0 or all ones) for what packed rows hold after ``lengths`` words."""
    low = np.uint64(0xFFFFFFFF)
    for k, pair in enumerate(packed):
        pair[lengths <= 2 * k] = np.uint64(rest)
        half = lengths == 2 * k + 1
        pair[half] = (pair[half] & ~low) | (np.uint64(rest) & low)


@dataclass
class Benchmark:
    """Part of a benchmark, ready to be looked up: arrays only, so that it can be broadcast."""

    depth: int
    vocabulary: np.ndarray  # sorted hashes; rank = place + 1
    first_pairs: np.ndarray  # sorted codes of the two words that a suffix may begin with
    single: np.ndarray  # whether a rank is a window of one word
    suffixes: np.ndarray  # distinct suffixes, packed, a column each
    lengths: np.ndarray  # their words
    window: np.ndarray  # whether a suffix is a window
    items_at: np.ndarray  # window i stands in items[items_at[i] : items_at[i + 1]]
    items: np.ndarray
    names: list[str]  # item_id of each item as text
    places: np.ndarray  # suffix, item, word number and words of the item, for every place in the items
    text: np.ndarray  # ranks of the items' words, a 0 after each item

    @staticmethod
    def of(rows: list[tuple], depth: int) -> Benchmark:
        names = sorted({"null" if i is None else str(i) for i, _ in rows})
        place = {name: k for k, name in enumerate(names)}
        hashes, first = words_of(*utf8(pa.array([t for _, t in rows], pa.string())))
        vocabulary = np.unique(hashes)
        ranks = np.searchsorted(vocabulary, hashes) + 1
        n = np.diff(first)
        item = np.repeat(np.arange(len(rows)), n)
        left = np.repeat(first[1:], n) - np.arange(len(ranks))  # words from a place to its item's end
        apart = np.zeros(len(ranks) + len(rows), np.uint32)  # a 0 after each item
        at = np.arange(len(ranks)) + item
        apart[at] = ranks
        packed = windows_of(apart, at, depth)
        # A key after a 0 may hold the next item's words: cut it to the item.
        length = np.minimum(left, depth)
        cut(packed, length)
        suffixes, inverse = np.unique(packed, axis=1, return_inverse=True)
        inverse = inverse.reshape(-1)
        lengths = np.zeros(suffixes.shape[1], np.int64)
        lengths[inverse] = length
        begins = (left >= depth) | ((np.repeat(n, n) < depth) & (np.arange(len(ranks)) == np.repeat(first[:-1], n)))
        owners = np.array([place["null" if i is None else str(i)] for i, _ in rows], np.int64)
        pairs = np.unique(np.stack([inverse[begins], owners[item[begins]]]), axis=1) if begins.any() else np.zeros((2, 0), np.int64)
        window = np.zeros(len(lengths), bool)
        window[pairs[0]] = True
        size = np.uint64(len(vocabulary) + 1)
        head = suffixes[0] if len(lengths) else np.zeros(0, np.uint64)
        one, two = head >> np.uint64(32), head & np.uint64(0xFFFFFFFF)
        single = np.zeros(len(vocabulary) + 1, bool)
        single[one[window & (lengths == 1)].astype(np.int64)] = True
        return Benchmark(
            depth, vocabulary, np.unique(one[lengths > 1] * size + two[lengths > 1]), single, suffixes, lengths, window,
            np.searchsorted(pairs[0], np.arange(len(lengths) + 1)), pairs[1], names,
            np.stack([inverse, owners[item], np.arange(len(ranks)) - np.repeat(first[:-1], n), np.repeat(n, n)]), apart,
        )

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.uint32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)


class SuffixArray:
    """Sorted suffixes of some documents' words, as far as they can match the benchmark."""

    def __init__(self, benchmark: Benchmark, hashes: np.ndarray, first: np.ndarray) -> None:
        n, b = np.diff(first), benchmark
        ranks = b.ranks(hashes)
        text = np.zeros(len(ranks) + len(n), np.uint32)  # a 0 after each document
        self.doc = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(ranks)) + self.doc
        text[place] = ranks
        at = np.flatnonzero(text[:-1] > 0) if len(text) else np.zeros(0, np.int64)
        second = text[np.minimum(at + 1, len(text) - 1)].astype(np.uint64)
        code = text[at].astype(np.uint64) * np.uint64(len(b.vocabulary) + 1) + second
        found = np.searchsorted(b.first_pairs, code)
        can = b.single[text[at]]
        if len(b.first_pairs):
            can |= (b.first_pairs[np.minimum(found, len(b.first_pairs) - 1)] == code) & (second > 0)
        at = at[can]
        keys = windows_of(text, at, b.depth)
        order = np.lexsort(keys[::-1])
        self.keys, self.at, self.text, self.place = keys[:, order], at[order], text, place

    def _bound(self, suffixes: np.ndarray, strict: bool) -> np.ndarray:
        low = np.zeros(suffixes.shape[1], np.int64)
        high = np.full(suffixes.shape[1], self.keys.shape[1])
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            right = before(self.keys[:, middle], suffixes[:, open_], strict)
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        return low

    def search(self, b: Benchmark) -> tuple[np.ndarray, np.ndarray]:
        """For each benchmark suffix the range of the array where it occurs."""
        return self._range(b.suffixes, b.lengths)

    def _range(self, suffixes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = suffixes.copy()
        cut(top, lengths, 0xFFFFFFFFFFFFFFFF)
        return self._bound(suffixes, True), self._bound(top, False)

    def longest(self, b: Benchmark, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, words, place in ``text``) of the longest match of each benchmark suffix.

        A suffix of which no whole window occurs counts under its own number; the places of
        others under the number of suffixes and theirs, as what follows the window may differ.
        Of equally long matches that of the document of least ``order`` and of the first place
        is taken.
        """
        low, high = self.search(b)
        whole = (b.lengths == b.depth) & (high > low)
        # The suffixes around the place where one would stand share the most words with it.
        best = np.zeros(len(low), np.int64)
        for neighbour in (low - 1, low):
            inside = np.flatnonzero((neighbour >= 0) & (neighbour < self.keys.shape[1]) & ~whole)
            shared = common(self.keys[:, neighbour[inside]], b.suffixes[:, inside])
            best[inside] = np.maximum(best[inside], shared)
        used = np.flatnonzero((best > 1) | ((best == 1) & b.window & (b.lengths == 1)))
        keys = b.suffixes[:, used].copy()
        cut(keys, best[used])
        lo, hi = self._range(keys, best[used])
        at = self.at[first_of(self._turns(self.at, order), lo, hi)]
        place, n, far = self._beyond(b, whole, low, high, order)
        return np.concatenate([used, len(low) + place]), np.concatenate([best[used], n]), np.concatenate([at, far])

    def _turns(self, at: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Which place comes first, second, ... by its document's order and by itself."""
        turn = np.empty(len(at), np.int64)
        turn[np.lexsort((at, order[self.doc[np.searchsorted(self.place, at)]]))] = np.arange(len(at))
        return turn

    def _beyond(self, b: Benchmark, whole: np.ndarray, low: np.ndarray, high: np.ndarray, order: np.ndarray):
        """(place in the benchmark, words, place in ``text``) of the longest match where a whole window occurs.

        A match of n words is a chain of windows that all occur, so it lies in stretches of
        such windows on both sides and only these are sorted.
        """
        place = np.flatnonzero(whole[b.places[0]])
        if not len(place):
            return place, place, place
        change = np.zeros(self.keys.shape[1] + 1, np.int64)
        np.add.at(change, low[whole], 1)
        np.add.at(change, high[whole], -1)
        at = np.sort(self.at[np.cumsum(change)[:-1] > 0])
        ours, mine = stretches(b.text, np.flatnonzero(b.text)[place], b.depth)
        theirs, other = stretches(self.text, at, b.depth)
        ranks = doubled(np.concatenate([ours, theirs]))
        sorted_ = np.argsort(ranks[-1][other + len(ours)])
        at, other = at[sorted_], other[sorted_] + len(ours)
        where = np.searchsorted(ranks[-1][other], ranks[-1][mine])
        best = np.zeros(len(mine), np.int64)
        for neighbour in (where - 1, where):
            inside = np.flatnonzero((neighbour >= 0) & (neighbour < len(other)))
            x, y, n = mine[inside], other[neighbour[inside]], np.zeros(len(inside), np.int64)
            for k in range(len(ranks) - 1, -1, -1):
                n += (ranks[k][x + n] == ranks[k][y + n]).astype(np.int64) << k
            best[inside] = np.maximum(best[inside], n)
        # The places that share all these words stand side by side around it.
        level = np.frexp(best.astype(np.float64))[1] - 1
        rest = best - (np.int64(1) << level.astype(np.int64))

        def same(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            x, y, k, r = mine[i], other[j], level[i], rest[i]
            # Within the array wherever the first half is the same.
            return (ranks[k, x] == ranks[k, y]) & (ranks[k, x + r] == ranks[k, np.minimum(y + r, ranks.shape[1] - 1)])

        bounds = []
        for below in (True, False):
            lo, hi = (np.zeros_like(where), where.copy()) if below else (where.copy(), np.full_like(where, len(other)))
            while (open_ := np.flatnonzero(lo < hi)).size:
                middle = (lo[open_] + hi[open_]) // 2
                right = same(open_, middle) ^ below
                lo[open_[right]] = middle[right] + 1
                hi[open_[~right]] = middle[~right]
            bounds.append(lo)
        return place, best, at[first_of(self._turns(at, order), *bounds)]


def stretches(text: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """What of ``text`` the windows from ``at`` on cover, a 0 after each stretch, and where each begins there."""
    change = np.zeros(len(text) + 1, np.int64)
    change[at] += 1
    change[at + depth] -= 1
    held = np.flatnonzero(np.cumsum(change) > 0)
    place = np.arange(len(held)) + np.concatenate([[0], np.cumsum(np.diff(held) > 1)])
    out = np.zeros(place[-1] + 2, np.int64)
    out[place] = text[held]
    return out, place[np.searchsorted(held, at)]


def doubled(text: np.ndarray) -> np.ndarray:
    """Row k: ranks of the 2 ** k words from each place on; in the last row no two are equal.

    Each 0 is unlike any other word, so what is equal lies between two of them.
    """
    ends = np.flatnonzero(text == 0)
    text = text.copy()
    text[ends] = text.max() + 1 + np.arange(len(ends))
    ranks, n = [np.unique(text, return_inverse=True)[1].astype(np.int32)], len(text)
    while ranks[-1].max() + 1 < n:
        width = 1 << (len(ranks) - 1)
        second = np.zeros(n, np.int64)
        second[: n - width] = ranks[-1][width:]
        ranks.append(np.unique(ranks[-1] * np.int64(n) + second, return_inverse=True)[1].astype(np.int32))
    return np.stack(ranks)


def first_of(turn: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of the least ``turn`` in each range; no range is empty, no turn occurs twice."""
    least, index = [turn], np.argsort(turn)
    while 2 << (len(least) - 1) <= len(turn):
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    out = np.zeros(len(low), np.int64)
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    for k in np.unique(level):
        i = np.flatnonzero(level == k)
        out[i] = np.minimum(least[k][low[i]], least[k][high[i] - (1 << int(k))])
    return index[out]


def find(b: Benchmark, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of hit runs in word numbers and (document, item) pairs of occurring windows."""
    array = SuffixArray(b, hashes, first)
    low, high = array.search(b)
    used = np.flatnonzero(b.window & (high > low))
    count = high[used] - low[used]
    which = np.repeat(used, count)
    index = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
    at = array.at[index]
    word = np.searchsorted(array.place, at)
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, word, 1)
    np.add.at(change, word + b.lengths[which], -1)
    hit = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
    # A run ends where its document does.
    edge = np.zeros(len(hashes) + 1, bool)
    edge[first] = True
    starts = np.flatnonzero(hit[1:] & (~hit[:-1] | edge))
    ends = np.flatnonzero(hit[:-1] & (~hit[1:] | edge))
    pairs = np.unique(array.doc[word] * np.int64(len(b.lengths)) + which)
    doc, window = np.divmod(pairs, max(len(b.lengths), 1))
    n_items = b.items_at[window + 1] - b.items_at[window]
    item = b.items[np.repeat(b.items_at[window], n_items) + np.arange(n_items.sum()) - np.repeat(np.cumsum(n_items) - n_items, n_items)]
    both = np.unique(np.repeat(doc, n_items) * np.int64(max(len(b.names), 1)) + item)
    doc, item = np.divmod(both, max(len(b.names), 1))
    return starts, ends, doc, item


def _looked_up(shared):
    def start():
        b = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            data, offsets = utf8(texts)
            counts, n_runs, run_at, run_n, n_items, names = [], [], [], [], [], []
            for lo, hi in blocks(offsets, BLOCK_BYTES):
                hashes, first = words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                starts, ends, doc, item = find(b, hashes, first)
                of = np.searchsorted(first, starts, side="right") - 1
                counts.append(np.diff(first))
                n_runs.append(np.bincount(of, minlength=hi - lo))
                run_at.append(starts - first[of])
                run_n.append(ends - starts)
                n_items.append(np.bincount(doc, minlength=hi - lo))
                names.append(item)
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            runs = pa.StructArray.from_arrays([pa.array(join(run_at), pa.int64()), pa.array(join(run_n), pa.int64())], names=["start", "n"])
            at = np.concatenate([[0], np.cumsum(join(n_runs))]).astype(np.int32)
            found = ragged(np.array(b.names, object)[join(names).astype(np.int64)], join(n_items), pa.string())
            return [pa.array(join(counts), pa.int64()), pa.ListArray.from_arrays(pa.array(at), runs), found]

        return work

    return start


ADDED = "_llm_n_words bigint, _llm_runs array<struct<start: bigint, n: bigint>>, _llm_items array<string>"


def look_up(documents: DataFrame, benchmark: DataFrame, keep, window: int = WINDOW) -> DataFrame:
    """``keep`` columns plus _llm_n_words, _llm_runs (hit words, start and number) and _llm_items of each document.

    The benchmark is collected and broadcast in parts of ``BENCHMARK_BYTES``; after each part
    but the last, what was found is written, and the parts' findings are united per row.
    """
    spark = documents.sparkSession
    slim = benchmark.select("item_id", "text")
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, df, carried = -(-total // BENCHMARK_BYTES) or 1, documents, []
    for part in range(n):
        mine = slim if n == 1 else slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == part)
        shared = spark.sparkContext.broadcast(Benchmark.of([(r.item_id, r.text) for r in mine.collect()], window))
        own = [f"_llm_runs{part}", f"_llm_items{part}"]
        added = ADDED.replace("_llm_runs", own[0]).replace("_llm_items", own[1]) if part + 1 < n else ADDED
        last = part + 1 == n
        columns = [*keep, *carried] if last else list(dict.fromkeys([*keep, "text", *carried]))
        df = annotate(df, ["text"], added, _looked_up(shared), columns)
        if not last:
            carried += own
            df = materialize(df.drop("_llm_n_words"), "looked-up")
    if carried:
        runs = F.concat("_llm_runs", *[c for c in carried if c.startswith("_llm_runs")])
        items = F.concat("_llm_items", *[c for c in carried if c.startswith("_llm_items")])
        df = df.withColumn("_llm_runs", _united(F.array_sort(runs))).withColumn("_llm_items", F.array_distinct(items)).drop(*carried)
    return df


def _united(runs):
    """Sorted runs of words with overlaps cut off."""
    empty = F.struct(F.array().cast("array<struct<start: bigint, n: bigint>>").alias("kept"), F.lit(0).cast("bigint").alias("to"))

    def add(state, run):
        start, end = F.greatest(run["start"], state["to"]), run["start"] + run["n"]
        new = F.array(F.struct(start.alias("start"), (end - start).alias("n")))
        kept = F.when(end > start, F.concat(state["kept"], new)).otherwise(state["kept"])
        return F.struct(kept.alias("kept"), F.greatest(state["to"], end).alias("to"))

    return F.aggregate(runs, empty, add, lambda s: s["kept"])


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``documents`` (doc_id, text) how much of it ``benchmark`` (item_id, text) holds.

    (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_hit, longest_at): the
    last two are the longest run of hit words and where it starts, null without a hit.  Words
    are runs of digits, letters and non-ASCII characters in lower case; a window is ``window``
    consecutive words of an item, or all words of a shorter one.  Null and wordless texts have
    no words and no windows.  Items that share an item_id count once, a null item_id is called
    "null".  Repeated rows keep a row each.  Empty tables: no rows, or no hits.  Other columns
    are not looked at.  Documents are read once and nothing is shuffled.
    """
    found = look_up(documents.select("doc_id", "text"), benchmark, ["doc_id"], window)
    hit = F.coalesce(F.aggregate("_llm_runs", F.lit(0).cast("bigint"), lambda a, r: a + r["n"]), F.lit(0).cast("bigint"))
    best = F.get(F.array_sort(F.transform("_llm_runs", lambda r: F.struct((-r["n"]).alias("n"), r["start"].alias("start")))), F.lit(0))
    return found.select(
        "doc_id", F.col("_llm_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_llm_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("_llm_items")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        (-best["n"]).alias("longest_hit"), best["start"].alias("longest_at"),
    )


def longest_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, start, n_words, doc_id, doc_start): the longest match of each benchmark suffix.

    A suffix is named by its item and first word and goes to the item's end, as its match may;
    ``window`` only says how many words are looked up before longer matches are told apart.
    Of equally long matches the one of the least doc_id and first place counts, one without a
    doc_id last.  Suffixes of which no two words (one, for items of one word) occur together
    are not listed.
    """
    spark = documents.sparkSession
    slim = benchmark.select("item_id", "text")
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, found = -(-total // BENCHMARK_BYTES) or 1, None
    for part in range(parts):
        mine = slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        b = Benchmark.of([(r.item_id, r.text) for r in mine.collect()], window)
        matched = documents.select("doc_id", "text").mapInArrow(_longest(spark.sparkContext.broadcast(b)), "suffix bigint, n_words bigint, doc_id bigint, doc_start bigint")
        best = F.min(F.struct((-F.col("n_words")).alias("n"), F.col("doc_id").isNull().alias("_"), "doc_id", "doc_start"))
        best = matched.groupBy("suffix").agg(best.alias("m"))
        suffix, item, start, words = b.places
        listed = pa.table({
            "place": np.arange(len(suffix)), "suffix": suffix.astype(np.int64), "item_id": pa.array(np.array(b.names, object)[item], pa.string()),
            "start": start.astype(np.int64), "alone": words == 1,
        }) if len(suffix) else None
        places = spark.createDataFrame(listed) if listed else spark.createDataFrame([], "place bigint, suffix bigint, item_id string, start bigint, alone boolean")
        # What is known of all places with these words, and of this one.
        both = F.explode(F.array("suffix", F.col("place") + F.lit(len(b.lengths)))).alias("suffix")
        rows = places.select("place", "item_id", "start", "alone", both).join(best, "suffix")
        rows = rows.groupBy("place", "item_id", "start", "alone").agg(F.min("m").alias("m")).where("m.n < -1 or alone")
        rows = rows.select("item_id", "start", (-F.col("m.n")).alias("n_words"), "m.doc_id", "m.doc_start")
        found = rows if found is None else found.unionByName(rows)
    return found


def _longest(shared):
    def best_of(rows: list[np.ndarray]) -> np.ndarray:
        found = np.concatenate(rows, 1)
        found = found[:, np.lexsort((found[4], found[3], found[2], -found[1], found[0]))]
        return found[:, np.concatenate([[True], found[0, 1:] != found[0, :-1]])]

    def run(batches):
        b = shared.value
        rows: list[np.ndarray] = []  # suffix, words, whether without a doc_id, doc_id, place
        held = kept = 0
        for batch in batches:
            missing = np.asarray(batch.column(0).is_null()).astype(np.int64)
            ids = np.asarray(batch.column(0).cast(pa.int64()).fill_null(0))
            data, offsets = utf8(batch.column(1))
            for lo, hi in blocks(offsets, BLOCK_BYTES):
                hashes, first = words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                array = SuffixArray(b, hashes, first)
                order = np.empty(hi - lo, np.int64)
                order[np.lexsort((ids[lo:hi], missing[lo:hi]))] = np.arange(hi - lo)
                suffix, n, at = array.longest(b, order)
                if not len(suffix):
                    continue
                word = np.searchsorted(array.place, at)
                doc = array.doc[word]
                rows.append(np.stack([suffix, n, missing[lo + doc], ids[lo + doc], word - first[doc]]))
                held += len(suffix)
                if held > max(2 * kept, 1 << 16):
                    rows = [best_of(rows)]
                    held = kept = rows[0].shape[1]
        if rows:
            suffix, n, no_id, doc_id, at = best_of(rows)
            columns = [pa.array(suffix), pa.array(n), pa.array(doc_id, mask=no_id > 0), pa.array(at)]
            yield pa.RecordBatch.from_arrays(columns, names=["suffix", "n_words", "doc_id", "doc_start"])
        trim()

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` without those that hold an occurrence of a window; all columns stay.

    Null and empty texts stay, as they hold no words; repeated rows are judged alike.  Items
    without words have no window, and a null item_id does no harm.  With an empty benchmark
    all rows stay, and an empty table stays empty.  Columns may be called anything.
    """
    inner = [c if c == "text" else f"_given{i}" for i, c in enumerate(documents.columns)]
    found = look_up(documents.toDF(*inner), benchmark, inner, window)
    return found.where(F.size("_llm_runs") == 0).select(*inner).toDF(*documents.columns)
