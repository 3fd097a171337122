"""Hierarchical packing of documents into windows of several context sizes.

Documents are encoded where they are read and routed to the tier of the smallest window that
holds them; longer ones first give whole windows of the largest size.  Each task packs its
tiers from the longest down: a document opens a window of its tier, whole shorter documents
fill the gap, and where none fits a shorter one is cut to the gap.  So all windows are full.
What is left at the end of a task, less than one large window, is carried with its ids and
joined into large windows over all tasks.  Only that rest can leave padding, in one window.

Nothing is shuffled: pieces are written once with their task and window number there, and the
counts of windows per (tier, task) turn those into global numbers.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..storage import materialize
from .columns import trim
from .tokens import CACHED_PIECES, Encoder

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 8 * 4096
#: Of documents that are encoded and packed at a time in a task.
BATCH_BYTES = 4_000_000
PIECE = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "tier int, part int, window bigint, offset bigint, ids binary"
)


class Packer:
    """Packs the documents of one task; ``rows`` holds the pieces that are placed."""

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers = sorted(tiers)
        self.pools = {t: deque() for t in self.tiers}
        self.held = dict.fromkeys(self.tiers, 0)
        self.windows = dict.fromkeys(self.tiers, 0)
        self.rows: list[tuple] = []

    def _hold(self, doc, start: int, ids: bytes, total: int) -> None:
        n = len(ids) // 4
        tier = next(t for t in self.tiers if n <= t)
        self.pools[tier].append((doc, start, ids, total))
        self.held[tier] += n

    def _take(self, tier: int) -> tuple:
        item = self.pools[tier].popleft()
        self.held[tier] -= len(item[2]) // 4
        return item

    def _place(self, item: tuple, tier: int, offset: int) -> int:
        doc, start, ids, total = item
        n = len(ids) // 4
        self.rows.append((doc, start, n, zlib.crc32(ids), total, tier, self.windows[tier], offset, None))
        return offset + n

    def add(self, doc, ids: bytes) -> None:
        total, widest = len(ids) // 4, self.tiers[-1]
        start = 0
        while total - start >= widest:
            self._place((doc, start, ids[4 * start : 4 * (start + widest)], total), widest, 0)
            self.windows[widest] += 1
            start += widest
        if start < total:
            self._hold(doc, start, ids[4 * start :], total)

    def _window(self, tier: int) -> None:
        """One full window; the pools up to ``tier`` hold enough for it."""
        offset = self._place(self._take(tier), tier, 0)
        usable = [t for t in self.tiers if t <= tier]
        while offset < tier:
            gap = tier - offset
            whole = (t for t in reversed(usable) if self.pools[t] and len(self.pools[t][0][2]) // 4 <= gap)
            found = next(whole, None)
            if found is not None:
                offset = self._place(self._take(found), tier, offset)
                continue
            doc, start, ids, total = self._take(next(t for t in usable if self.pools[t]))
            offset = self._place((doc, start, ids[: 4 * gap], total), tier, offset)
            self._hold(doc, start + gap, ids[4 * gap :], total)
        self.windows[tier] += 1

    def pack(self) -> list[tuple]:
        """Fill all windows that can be filled, and give the pieces placed since the last call."""
        for tier in reversed(self.tiers):
            while self.pools[tier] and sum(self.held[t] for t in self.tiers if t <= tier) >= tier:
                self._window(tier)
        rows, self.rows = self.rows, []
        return rows

    def rest(self) -> list[tuple]:
        """The unplaced pieces, with their ids and their place in this task's rest."""
        rows, at = [], 0
        for tier in reversed(self.tiers):
            for doc, start, ids, total in self.pools[tier]:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, 0, 0, at, ids))
                at += len(ids) // 4
        return rows


def pack(
    documents: DataFrame,
    tokenizer_file: str,
    style: str,
    end: int = 2,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    cached: int = CACHED_PIECES,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step).

    ``documents`` has doc_id and text, null being an empty text; every row is a document of
    its own, also a repeated one, and has the token ``end`` after its ids, so even an empty
    text gives a piece.  Each id lies in exactly one piece.  A window of ``tier`` tokens is
    full, except the last one of all.  Windows of a tier are dealt to steps of
    ``step_tokens``: ``step`` counts them within the tier, and all but its last are equal.
    ``cached`` bounds the pieces of text whose ids a task remembers, about 200 bytes each.
    Other columns are not looked at.  An empty table gives no pieces.
    """
    widest = max(tiers)
    kind = documents.schema["doc_id"]
    schema = StructType([StructField("doc_id", kind.dataType), *StructType.fromDDL(PIECE)])
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        encoder, packer, part = Encoder(tokenizer_file, style, cached), Packer(tiers), TaskContext.get().partitionId()
        kinds = cut = doc = ids = rows = None

        def rows_out(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, n, crc, total, tier, window, offset, ids = zip(*rows)
            columns = [doc, start, n, crc, total, tier, [part] * len(rows), window, offset, ids]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

        for batch in batches:
            i64 = pa.int64()
            kinds = kinds or [batch.schema.field(0).type, i64, i64, i64, i64, pa.int32(), pa.int32(), i64, i64, pa.binary()]
            step = max(1, min(1000, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1))))
            for lo in range(0, batch.num_rows, step):
                cut = batch.slice(lo, step)
                for doc, ids in zip(cut.column(0).to_pylist(), encoder.many(cut.column(1).to_pylist())):
                    packer.add(doc, ids + tail)
                if rows := packer.pack():
                    yield rows_out(rows)
            # Nothing of this batch is held while the next one is read.
            batch = cut = doc = ids = rows = None
            trim()
        if rows := packer.rest():
            yield rows_out(rows)
        encoder = packer = rows = None
        trim()

    pieces = materialize(documents.select("doc_id", "text").mapInArrow(run, schema), "pieces")

    # One row per task and tier: how many windows, or loose tokens, the tasks before have.
    before = W.partitionBy("tier").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = pieces.groupBy("tier", "part").agg(
        (F.max("window") + 1).alias("windows"), F.sum("length").alias("tokens")
    )
    sizes = sizes.withColumn("size", F.when(F.col("tier") == 0, F.col("tokens")).otherwise(F.col("windows")))
    shifts = sizes.select("tier", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    shifted = pieces.join(shifts, ["tier", "part"])

    placed = shifted.where("tier > 0").withColumn("window", F.col("window") + F.col("shift"))
    at = F.col("shift") + F.col("offset")
    loose = (
        shifted.where("tier = 0")
        .withColumn("at", at)
        .withColumn("window", F.explode(F.sequence(F.floor(F.col("at") / widest), F.floor((F.col("at") + F.col("length") - 1) / widest))))
        .withColumn("from", F.greatest(F.col("at"), F.col("window") * widest))
        .withColumn("to", F.least(F.col("at") + F.col("length"), (F.col("window") + 1) * widest))
        .withColumn("skip", (F.col("from") - F.col("at")).cast("int"))
        .withColumn("n", (F.col("to") - F.col("from")).cast("int"))
        .select(
            "doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("n").cast("bigint").alias("length"),
            F.crc32(F.substring("ids", F.col("skip") * 4 + 1, F.col("n") * 4)).alias("ids_crc32"), "doc_tokens",
            F.lit(0).alias("tier"), "window", (F.col("from") - F.col("window") * widest).alias("offset"),
        )
    )
    # Numbers of the tiers follow each other, the windows of the rest come last.
    totals = sizes.groupBy("tier").agg(F.sum("windows").alias("n")).where("tier > 0")
    bases = totals.agg(F.map_from_entries(F.collect_list(F.struct("tier", "n"))).alias("counts"))
    counts = (bases.first() or [None])[0] or {}
    base, bases_by_tier = 0, {}
    for tier in sorted(tiers, reverse=True):
        bases_by_tier[tier], base = base, base + counts.get(tier, 0)
    bases_by_tier[0] = base
    first = F.create_map(*[F.lit(x).cast("bigint") for pair in bases_by_tier.items() for x in pair])[F.col("tier").cast("bigint")]
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    width = F.when(F.col("tier") == 0, F.lit(widest)).otherwise(F.col("tier"))
    return placed.select(*columns, "tier", "window", "offset").unionByName(loose).select(
        *columns,
        (first + F.col("window")).alias("sequence_id"),
        "offset",
        "tier",
        F.floor(F.col("window") * width / F.lit(step_tokens)).alias("step"),
    )
