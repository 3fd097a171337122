"""Repairs against a plain search without grammar, and its parts one by one."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fundlens.llm import repair
from fundlens.llm.queries import catalog

SHAPE = "conv_id bigint, turn bigint, role string, text string"
FORM = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(key.encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def faults_of(rows):
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(repair.BLANKS)
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    return faults


def cheapest(initials, faults):
    """Shortest way over (row, state), by cost and then audit, without matrices."""
    best = {(0, 0): (0, "")}
    for i in range(len(initials) + 1):
        for _ in range(3):  # insertions
            for state in range(4):
                if (i, state) in best:
                    cost, audit = best[i, state]
                    for letter in "ua":
                        to = repair.NEXT.get((state, letter))
                        if to is not None:
                            best[i, to] = min(best.get((i, to), (1 << 60, "")), (cost + 3, audit + "I"))
        if i == len(initials):
            break
        for state in range(4):
            if (i, state) not in best:
                continue
            cost, audit = best[i, state]
            moves = [(state, 4, "D")]
            if faults[i] not in ("b", "d"):
                more = 3 if faults[i] == "t" else 0
                moves.append((repair.NEXT.get((state, initials[i])), more, "K"))
                moves += [(repair.NEXT.get((state, letter)), 3 + more, "R") for letter in "ua"]
            for to, price, edit in moves:
                if to is not None:
                    best[i + 1, to] = min(best.get((i + 1, to), (1 << 60, "")), (cost + price, audit + edit))
    return min(best[len(initials), s] for s in (0, 3) if (len(initials), s) in best)


def apply(rows, audit):
    length, out, at = len(audit) - audit.count("D"), [], 0
    for edit in audit:
        role = "user" if (len(out) - length % 2) % 2 == 0 else "assistant"
        if edit == "I":
            out.append((role, ""))
            continue
        if edit != "D":
            out.append((rows[at][2] if edit == "K" else role, rows[at][3]))
        at += 1
    assert at == len(rows)
    return out


def expected(rows, ids):
    found = {}
    for conv in ids:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        initials, faults = [r[2][:1] for r in own], faults_of(own)
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit = cheapest(initials, faults)
        out = apply(own, audit)
        assert FORM.fullmatch("".join(role[0] for role, _ in out))
        found[conv] = {
            "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
        }
    return found


def by_id(df):
    rows = [r.asDict() for r in df.collect()]
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: r for r in rows}


def many(seed, conversations=60):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "assist", "uber"]
    texts = ["Fine.", "Cut of", "", " \t\n", None, "Why?", "Yes!  ", "é.", "a", "b.", "c."]
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(rng.randrange(0, 14)):
            place = rng.choice([turn, turn, turn, turn, None, turn + 3, 0, -2])
            rows.append((conv, place, rng.choice(roles), rng.choice(texts)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def test_search_is_cheapest_and_least():
    """The plain search itself against every edit sequence of short conversations."""
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randrange(0, 4)
        initials = [rng.choice(["s", "u", "a", "t", ""]) for _ in range(n)]
        faults = [rng.choice(["", "", "t", "b", "d"]) for _ in range(n)]
        found = []

        def go(i, out, cost, audit):
            if cost > 14:
                return
            if i == n and FORM.fullmatch(out):
                found.append((cost, audit))
            for role in "ua":
                go(i, out + role, cost + 3, audit + "I")
            if i < n:
                go(i + 1, out, cost + 4, audit + "D")
                if faults[i] not in ("b", "d"):
                    more = 3 if faults[i] == "t" else 0
                    go(i + 1, out + (initials[i] or "-"), cost + more, audit + "K")
                    for role in "ua":
                        go(i + 1, out + role, cost + 3 + more, audit + "R")

        go(0, "", 0, "")
        if found:
            assert min(found) == cheapest(initials, faults)


def test_ropes():
    rng = random.Random(2)
    ropes = [repair.Rope(t) for t in ("", "D", "K", "I", "KK", "R")]
    for _ in range(300):
        ropes.append(rng.choice(ropes[-30:]) + rng.choice(ropes))
    for _ in range(3000):
        a, b = rng.choice(ropes), rng.choice(ropes)
        assert len(str(a)) == a.size and (a < b) == (str(a) < str(b))


def test_pairs_and_rules():
    x = repair.flat(pa.array(["AAAAA", "", "ABAB", "BA", None, "AAB"]))
    pairs, n = repair.count_pairs(x, 16)
    assert dict(zip(pairs.tolist(), n.tolist())) == {0: 3, 1: 3, 16: 2}
    assert repair.replace(x, [(0, 0)], 16).tolist() == [16, 16, 0, -1, -1, 0, 1, 0, 1, -1, 1, 0, -1, -1, 16, 1, -1]
    assert repair.choose([(0, 1, 9), (1, 2, 8), (2, 2, 7), (3, 4, 1)], 5) == [(0, 1), (2, 2)]
    assert repair.choose([(0, 1, 9), (2, 2, 7)], 1) == [(0, 1)]


def test_grammar_gives_the_sequences_back(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("EIEIEIABM") for _ in range(rng.randrange(0, 40))) for _ in range(200)] + ["EI" * 500, "E" * 77]
    grammar = repair.grammar_of(spark.createDataFrame([(t,) for t in texts], "symbols string").repartition(3))
    assert grammar.rounds and all(len({*sum(r, ())}) == len({a for a, _ in r}) + len({b for a, b in r if a != b}) for r in grammar.rounds)
    rules = [p for r in grammar.rounds for p in r]

    def letters(symbol):
        return chr(65 + symbol) if symbol < 16 else letters(rules[symbol - 16][0]) + letters(rules[symbol - 16][1])

    packed = repair.split(grammar.compress(repair.flat(pa.array(texts))))
    assert ["".join(letters(s) for s in p[:-1].tolist()) for p in packed] == texts
    assert sum(map(len, packed)) < sum(map(len, texts)) / 2
    matrices = grammar.matrices()
    for text, x in zip(texts, packed):
        row = [(0, repair.Rope("")), None, None, None]
        for s in x[:-1].tolist():
            row = repair.row_times(row, matrices[s])
        codes = [ord(c) - 65 for c in text]
        assert repair.best(row) == cheapest(["sua?"[c // 4] for c in codes], [["", "b", "d", "t"][c % 4] for c in codes])


@pytest.mark.parametrize("seed, chunk", [(1, 4096), (2, 3)])
def test_against_plain_search(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = many(seed)
    table = spark.createDataFrame([(*r, 1) for r in rows], SHAPE + ", position int").repartition(7)
    ids = {r[0] for r in rows}
    assert by_id(repair.damaged_and_repaired(table)) == expected(damaged(rows), ids)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "tool", "So."), (2, 0, "system", "Be."), (3, None, "user", None)]
    summary, repaired = repair.repair(spark.createDataFrame(rows, SHAPE), spark.createDataFrame([(9,)], "conv_id bigint"))
    audits = {r.conv_id: (r.audit, r.cost) for r in summary.collect()}
    assert audits == {1: ("KDR", 7), 2: ("D", 4), 3: ("D", 4), 9: ("", 0)}
    assert [tuple(r) for r in repaired.orderBy("position").collect()] == [(1, 0, "user", "Hi."), (1, 1, "assistant", "So.")]


def test_empty_and_long(spark):
    assert repair.damaged_and_repaired(spark.createDataFrame([], SHAPE)).collect() == []
    rows = [(5, t, ["user", "assistant"][t % 2], "x" * 20_000 + f"{t}.") for t in range(300)]
    assert by_id(repair.damaged_and_repaired(spark.createDataFrame(rows, SHAPE))) == expected(damaged(rows), {5})


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = by_id(catalog.plans["op11_conversation_repair"](spark, folder))
    assert found == expected(damaged(rows), {r[0] for r in rows})
    assert np.mean([r["cost"] > 0 for r in found.values()]) > 0.05
