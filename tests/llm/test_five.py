"""Sharding, chat formatting, token counts, exact search and packing against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fundlens.llm import chat, packing, sharding, token_counts, topk
from fundlens.llm.queries import catalog, table
from fundlens.llm.tokens import Encoder, load

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "B", "ö", " ", "  ", "\n", "\t", ".", ",", "'s", "12", "<|endoftext|>", " ", "　", "é", "İ", "!!", "_", "日本", "👍", "\x1c", "'LL", " the", "\r\n", "Σ", "x" * 60]
DOCS = "doc_id bigint, text string, score string, digest int, _at int"


def odd_texts(n: int) -> list[str | None]:
    rng = random.Random(5)
    return [None, "", *("".join(rng.choices(ODD, k=rng.randint(0, 12))) for _ in range(n))]


@pytest.mark.parametrize("file,style", [(BYTE, "byte"), (WORD, "word")])
def test_encoder_gives_the_library_s_ids(file, style):
    plain = load(file)
    texts = odd_texts(5000)
    for text, ids in zip(texts, Encoder(file, style).many(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_full_caches_start_anew():
    encoder = Encoder(WORD, "word", cached=3)
    for text in ("some few words here", "and other words there", "some few words here"):
        assert encoder.many([text])[0] == encoder.whole(text)


def odd_documents(spark):
    texts = odd_texts(40) + ["hot text, often"] * 30 + ["w%d " % i * 3 for i in range(20)] + ["long " * 9000]
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(None, "no id", "y", 1, 2), (0, None, "x", 1, 2)]
    return spark.createDataFrame(rows, DOCS), [(r[0], r[1]) for r in rows]


def test_token_counts(spark, folder):
    plain = load(BYTE)
    df, rows = odd_documents(spark)
    want = Counter((i, len((t or "").encode()), n := len(plain.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows)
    assert Counter(map(tuple, token_counts.count_tokens(df, BYTE, "byte").collect())) == want
    assert token_counts.count_tokens(df.limit(0), BYTE, "byte").count() == 0
    docs = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    for r in catalog.plans["op5_token_counts"](spark, folder).collect():
        assert r.n_tokens == len(plain.encode(docs[r.doc_id], add_special_tokens=False).ids)


def test_cache_encodes_only_misses(spark, tmp_path):
    cache = str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "three")], "doc_id bigint, text string")
    token_counts.count_tokens(df, BYTE, "byte", cache).collect()
    assert spark.read.parquet(cache).count() == 2
    more = df.union(spark.createDataFrame([(4, "four")], df.schema))
    assert token_counts.count_tokens(more, BYTE, "byte", cache).count() == 4
    assert spark.read.parquet(cache).count() == 3
    token_counts.count_tokens(df, WORD, "word", cache).collect()
    assert spark.read.parquet(cache).count() == 5


def check_packing(rows, texts, tokenizer=WORD):
    """rows: pieces of :func:`packing.pack`; texts: list of (doc_id, text)."""
    plain = load(tokenizer)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length, r.tier))
    want = defaultdict(list)
    for doc, text in texts:
        want[doc].append(plain.encode(text or "", add_special_tokens=False).ids + [2])
    assert set(pieces) == set(want)
    for doc, found in pieces.items():
        if len(want[doc]) > 1:
            assert sum(p[1] for p in found) == sum(map(len, want[doc]))
            continue
        ids, at = want[doc][0], 0
        for start, n, crc, total in sorted(found):
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
            at += n
        assert at == len(ids)
    partial = 0
    assert sorted(windows) == list(range(len(windows)))
    for parts in windows.values():
        at = 0
        for offset, n, tier in sorted(parts):
            assert offset == at
            at += n
        assert len({p[2] for p in parts}) == 1
        partial += at != (parts[0][2] or 4096)
        assert at <= 4096
    assert partial <= 1
    return windows


def test_packing(spark, folder):
    df, rows = odd_documents(spark)
    check_packing(packing.pack(df.repartition(5), WORD, "word").collect(), rows)
    assert packing.pack(df.limit(0), WORD, "word").count() == 0
    docs = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    found = catalog.plans["op10_packing"](spark, folder).collect()
    check_packing(found, docs)
    steps = Counter()
    for r in found:
        steps[r.tier, r.step] += r.length
    for (tier, step), n in steps.items():
        assert n == packing.STEP_TOKENS or step == max(s for t, s in steps if t == tier)


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.indices((1 << bits,) * dims).reshape(dims, -1)
        at = sharding.hilbert_index(list(grid), bits)
        assert sorted(at) == list(range(1 << bits * dims))
        path = grid[:, np.argsort(at)]
        assert (np.abs(np.diff(path)).sum(0) == 1).all()


def check_shards(rows, n_rows):
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in shards.values())
    assert sum(map(len, shards.values())) == n_rows
    return shards


def test_shards(spark, folder):
    docs = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    found = catalog.plans["op2_hilbert_shards"](spark, folder).collect()
    shards = check_shards(found, len(docs))
    assert set(shards) == set(range(8)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    for r in found:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    by_place = sorted(found, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in by_place] == sorted(r.curve for r in found)


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_of_odd_rows(spark, law, tmp_path):
    rows = [(i, ["a", None, "b", ""][i % 4], float("nan") if i % 7 == 0 else i / 3, 1 + i % 9) for i in range(500)]
    rows += [(None, None, None, 1)] * 3 + [(7, "a", 1.0, 1)] * 100
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, x double, size bigint")
    out = sharding.shard(df, ["lang", "x"], ["doc_id"], 8, law, "size")
    found = out.collect()
    shards = check_shards(found, len(rows))
    if law == "rows":
        assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    else:
        sums = Counter()
        for r in found:
            sums[r.shard] += r["size"]
        assert max(sums.values()) - min(sums.values()) <= 2 * 9
    assert sharding.shard(df.limit(0), ["lang", "x"], ["doc_id"], 8, law, "size").count() == 0
    sharding.write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)


def digests(turns):
    said = "".join(t or "" for r, t in turns if r == "assistant")
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_chat(spark, folder):
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "\n", "é👍", " ", "x", "s>", "/INST]", None]
    rng = random.Random(3)
    roles = ["user", "assistant", "system", None, "a [/INST]\nb</s>\n", ""]
    rows, want = [], {}
    for conv in [*range(200), None]:
        turns = []
        for turn in range(rng.randint(1, 9)):
            parts = rng.choices(bits, k=rng.randint(0, 8))
            turns.append((rng.choice(roles), None if None in parts else "".join(parts)))
            rows.append((conv, turn, *turns[-1], "extra"))
        want[conv] = digests(turns)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    formatted = chat.format_chat(df)
    for r in formatted.collect():
        controls = r.formatted.count("<s>") + r.formatted.count("</s>") + r.formatted.count("[INST]") + r.formatted.count("[/INST]")
        assert controls == 4 * r.n_turns
    assert {r[0]: tuple(r)[1:5] for r in chat.read_back(formatted).collect()} == want
    assert chat.format_chat(df.limit(0)).count() == 0
    tied = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "c"), (1, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    assert [t for _, t in chat.read_turns(chat.format_chat(tied).first().formatted)] == ["c", "a", "a", "b"]

    given = defaultdict(list)
    for r in table(spark, folder, "conversations").orderBy("turn").collect():
        given[r.conv_id].append((r.role, r.text))
    given[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    found = catalog.plans["op3_chat_format"](spark, folder).collect()
    assert {r[0]: tuple(r)[1:5] for r in found} == {k: digests(v) for k, v in given.items()}


def brute_top(rows, k, query):
    usable = []
    for vec_id, x in rows:
        if vec_id is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        usable.append((vec_id, [math.floor(256 * float(np.float32(c))) for c in x]))
    want = {}
    for q, v in usable:
        if query(q):
            scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v)]
            want[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return want


def found_top(df):
    found = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found[r.query_id]) + 1
        found[r.query_id].append((r.vec_id, r.score))
    return dict(found)


def test_exact_top_k(spark, folder, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(400)]
    rows += [(2000, None), (2001, []), (2002, [1.0, None]), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2050, [1.0]), (2051, [2.0]), (None, [1.0] * 8), (4000, [0.0] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, score string").repartition(3)
    want = {q: v for q, v in brute_top(rows, 5, lambda q: q % 50 == 0).items() if v}
    assert found_top(topk.top_k(df, F.col("vec_id") % 50 == 0)) == want
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    assert found_top(topk.top_k(df, F.col("vec_id") % 50 == 0)) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    given = [(r.vec_id, r.embedding) for r in table(spark, folder, "embeddings").collect()]
    want = brute_top(given, 5, lambda q: q % 50 == 0)
    assert found_top(catalog.plans["op6_exact_top_k"](spark, folder)) == want


def test_exact_top_k_of_large_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(500, [3e5, 0.25, 0.0, 0.0]), (501, [-4e9, 3.0, 0.0, 0.0]), (502, [1e8 + 1, 7.0, 1.0, 0.0]), (550, [0.0, 0.0, 2e7, 1.0]), (551, [1e8 + 1, 7.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    ints = {i: [math.floor(256 * c) for c in x] for i, x in rows}
    want = {}
    for q in (0, 50, 100, 150, 200, 250, 500, 550):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], w)), i) for i, w in ints.items() if i != q)
        want[q] = [(i, -s) for s, i in scores[:5]]
    assert any(i in (500, 501, 502, 550) for i, _ in want[50])
    assert found_top(topk.top_k(df, F.col("vec_id") % 50 == 0)) == want
    for sign in (1.0, -1.0):  # two vectors only, so a score that is too small counts as well
        beyond = spark.createDataFrame([(0, [1e9, 1e9]), (1, [sign * 1e9, sign * 1e9])], "vec_id bigint, embedding array<double>")
        with pytest.raises(Exception, match="does not fit a long"):
            topk.top_k(beyond, F.col("vec_id") == 0).collect()


def test_tree_saves_distances():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 6)) * 4000
    vectors = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 6)) * 40)
    search = topk.Search(topk.Tree(np.arange(6000), vectors).packed())
    place, found, scores = search.best_of(vectors[:50], np.arange(50), 5, np.full(50, topk.BELOW))
    assert search.computed < 0.5 * 50 * 6000
    products = vectors[:50] @ vectors.T
    for q in range(50):
        order = [i for i in np.lexsort((np.arange(6000), -products[q])) if i != q][:5]
        mine = place == q
        assert found[mine].tolist() == order and scores[mine].tolist() == products[q, order].astype(int).tolist()


def test_top_k_is_exact_at_every_size(spark):
    """Components from 2 ** 10 to 2 ** 62 after scaling, clustered and not, and beyond any long."""
    rng = np.random.default_rng(9)
    for power in (10, 20, 24, 25, 26, 27, 30, 40, 62):
        wide = 2.0 ** (power - 8)
        centre = rng.normal(size=12) * wide
        near = [centre + rng.normal(size=12) * wide * 1e-7 for _ in range(120)]
        apart = [rng.uniform(-wide, wide, 12) for _ in range(120)]
        rows = [(i, [float(c) for c in v]) for i, v in enumerate(near + apart)]
        ints = {i: [math.floor(256 * c) for c in x] for i, x in rows}
        held = pa.array([x for _, x in rows], pa.list_(pa.float64()))
        usable, vectors = topk.scaled(held)
        assert [[int(c) for c in v] for v in vectors] == [ints[i] for i in range(240)]
        small = [i for i in usable if not topk.is_large(vectors[i])]
        if len(small) < 240:
            continue  # those are compared one by one, which another test covers
        blob = topk.Tree(np.array(small), np.stack(vectors)).packed()
        queries, own = np.stack(vectors), np.arange(240)
        floors = topk._first_bounds(own, vectors, [topk.pickle.loads(blob)], 5)
        place, found, scores = topk.Search(blob).best_of(queries, own, 5, floors)
        for q in range(240):
            best = sorted((-sum(a * b for a, b in zip(ints[q], w)), i) for i, w in ints.items() if i != q)[:5]
            assert list(zip(found[place == q].tolist(), scores[place == q].tolist())) == [(i, -s) for s, i in best]
    rows = [(0, [0.0, 1.0, 2.0]), (1, [1e30, 0.5, 0.0]), (2, [0.0, 3.0, 1.0]), (3, [-1e308, 0.0, 0.5]), (4, [0.0, -1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = {q: v for q, v in brute_doubles(rows, 4).items() if q in (0, 2, 4)}
    assert found_top(topk.top_k(df, F.col("vec_id") % 2 == 0, 4)) == want
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(df, F.col("vec_id") == 1, 4).collect()


def brute_doubles(rows, k):
    ints = {i: [math.floor(256 * c) if abs(c) < 1e300 else int(c) * 256 for c in x] for i, x in rows}
    return {q: [(i, -s) for s, i in sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints.items() if i != q)[:k]] for q, v in ints.items()}
