"""Personal data in texts: four kinds by rule, secrets by weak supervision.

Base kinds (email, ip, card, phone) are regular expressions and checks of what they match.
For secrets, candidates are long mixed runs of letters and digits.  Labelers vote on each: two
look at its form, one looks the word before it up in a gazetteer, two look at the context.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler
is.  Its posteriors are soft labels for the span classifier, a naive Bayes model over form and
context, which decides.  Patterns and features have few values, so the driver sees counts only.

All work on texts is built-in column functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

LOCAL = r"[A-Za-z0-9._%+-]"
# The kinds in the order that breaks ties of spans.  Quantifiers are possessive where what
# follows cannot take back a character, so long runs neither backtrack nor recurse; a match
# that could start anywhere in a run is tried at its first character, or where the last ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = tuple(PATTERNS)
ADDED = "secret"
RUN = r"[A-Za-z0-9_+/-]"
SECRET = (
    rf"(?:\G|(?<!{RUN}))(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z]){RUN}{{12,}}+(?![@.]{RUN})"
)
GAZETTEER = ("password", "passwd", "pwd", "pass", "token", "secret", "key", "api_key", "apikey", "auth", "bearer", "credential")
LABELERS = ("known_prefix", "plain_hex", "named", "assigned", "mixed")
FEATURES = ("size", "letters", "named", "assigned", "prefix")
ROUNDS = 200
SPAN = "array<struct<start: int, end: int, kind: string>>"


def matches(text: Column, pattern: str, wanted: Column) -> Column:
    """(start, end, value, gap) of each match, in code points; ``gap`` is the text since the last.

    ``wanted`` is a cheap condition that every text with a match meets.
    """
    # \G keeps the search after the last match from starting over at every later character.
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")
    gaps = F.when(wanted, F.regexp_extract_all(text, whole, F.lit(1)))
    values = F.when(wanted, F.regexp_extract_all(text, whole, F.lit(2)))
    return F.zip_with(gaps, values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))


def placed(pairs: Column) -> Column:
    """Code points where each match of :func:`matches` starts."""
    sizes = F.transform(pairs, lambda p: F.struct(F.char_length(p["gap"]).alias("g"), F.char_length(p["value"]).alias("v")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def add(state: Column, size: Column) -> Column:
        start = state["at"] + size["g"]
        return F.struct((start + size["v"]).alias("at"), F.concat(state["starts"], F.array(start)).alias("starts"))

    return F.aggregate(sizes, zero, add, lambda s: s["starts"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, -i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        digits = digits_of(value)
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits_of(value)).between(10, 15)
    return F.lit(True)


def base_spans(df: DataFrame) -> DataFrame:
    """``df`` plus one column of spans per base kind; needs a column _text without nulls."""
    text = F.col("_text")
    digit = F.col("_digit")
    wanted = {
        "email": F.contains(text, F.lit("@")),
        "ip": digit & text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
        "card": digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
        "phone": digit & F.contains(text, F.lit("+")),
    }
    out = df.withColumn("_digit", text.rlike("[0-9]"))
    for kind, pattern in PATTERNS.items():
        out = out.withColumn("_found", matches(text, pattern, wanted[kind])).withColumn("_starts", placed(F.col("_found")))
        out = out.withColumn(f"_{kind}", F.coalesce(_kept(kind), F.array().cast(SPAN))).drop("_found", "_starts")
    return out


def _kept(kind: str) -> Column:
    spans_ = F.zip_with("_found", "_starts", lambda f, s: F.struct(
        s.alias("start"), (s + F.char_length(f["value"])).cast("int").alias("end"), F.lit(kind).alias("kind"), f["value"].alias("value"),
    ))
    kept = F.filter(spans_, lambda x: valid(kind, x["value"]))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def candidates(df: DataFrame) -> DataFrame:
    """``df`` plus _candidates: places, votes and features of what may be a secret."""
    text = F.col("_text")
    out = df.withColumn("_found", matches(text, SECRET, F.col("_digit") & text.rlike("[0-9][A-Za-z_+/-]|[A-Za-z_+/-][0-9]")))
    out = out.withColumn("_starts", placed(F.col("_found")))

    def look(found: Column, start: Column) -> Column:
        value = found["value"]
        ahead = F.right(found["gap"], F.lit(40))
        named = F.lower(F.regexp_extract(ahead, r"([A-Za-z_]+)[\x20\"':=]*$", 1)).isin(*GAZETTEER)
        assigned = ahead.rlike(r"[=:]\x20?[\"']?$")
        prefix = value.rlike("^(AKIA|ASIA|AIza|ghp_|gho_|xox[bp]-|sk-|sk_live_)")
        plain_hex = value.rlike("^[0-9a-f]{16,}$")
        turns = F.length(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "0"), "[^0]+", "a"))
        letters = F.when(plain_hex, "hex").when(value.rlike("^[A-Z0-9]+$"), "upper").when(value.rlike("^[a-z0-9]+$"), "lower").otherwise("other")
        size = F.when(F.length(value) < 16, "short").when(F.length(value) <= 24, "middle").otherwise("long")
        return F.struct(
            start.alias("start"), (start + F.char_length(value)).cast("int").alias("end"),
            prefix.alias("known_prefix"), plain_hex.alias("plain_hex"), named.alias("named"), assigned.alias("assigned"), (turns >= 5).alias("mixed"),
            size.alias("size"), letters.alias("letters"), prefix.alias("prefix"),
        )

    return out.withColumn("_candidates", F.zip_with("_found", "_starts", look)).drop("_found", "_starts")


@dataclass
class Reliability:
    prior: float
    hits: list[float]  # probability of a vote if the span is a secret
    alarms: list[float]  # and if it is not

    def posterior(self, votes: tuple) -> float:
        yes, no = math.log(self.prior), math.log(1 - self.prior)
        for v, h, a in zip(votes, self.hits, self.alarms):
            yes += math.log(h if v else 1 - h)
            no += math.log(a if v else 1 - a)
        return 1 / (1 + math.exp(max(-500.0, min(500.0, no - yes))))


def reliabilities(counts: dict[tuple, int]) -> Reliability:
    """Expectation-maximisation over counts of vote patterns; labelers start as better than chance."""
    n = len(LABELERS)
    known, total = Reliability(0.5, [0.7] * n, [0.2] * n), sum(counts.values())
    for _ in range(ROUNDS if total else 0):
        weight = {v: c * known.posterior(v) for v, c in counts.items()}
        sure = sum(weight.values())
        rest = total - sure
        hits = [(sum(w for v, w in weight.items() if v[i]) + 1.4) / (sure + 2) for i in range(n)]
        alarms = [(sum(counts[v] - w for v, w in weight.items() if v[i]) + 0.4) / (rest + 2) for i in range(n)]
        known = Reliability((sure + 1) / (total + 2), hits, alarms)
    return known


def classifier(rows: list) -> Callable[[Column], Column]:
    """Decision over a candidate struct, learned from counted (votes, features, n) rows."""
    counts: dict[tuple, int] = {}
    for r in rows:
        votes = tuple(r[x] for x in LABELERS)
        counts[votes] = counts.get(votes, 0) + r["n"]
    known = reliabilities(counts)
    soft = [(r, known.posterior(tuple(r[x] for x in LABELERS)) * r["n"]) for r in rows]
    sure = sum(w for _, w in soft)
    rest = sum(r["n"] for r in rows) - sure
    weights: list[tuple] = []
    for feature in FEATURES:
        seen = sorted({r[feature] for r in rows}, key=str)
        for value in seen:
            yes = sum(w for r, w in soft if r[feature] == value)
            no = sum(r["n"] - w for r, w in soft if r[feature] == value)
            ratio = math.log((yes + 1) / (sure + len(seen))) - math.log((no + 1) / (rest + len(seen)))
            weights.append((feature, value, ratio))

    def decide(c: Column) -> Column:
        score = F.lit(math.log((sure + 1) / (rest + 1)))
        for feature, value, ratio in weights:
            score = score + F.when(c[feature] == F.lit(value), F.lit(ratio)).otherwise(F.lit(0.0))
        return score > 0

    return decide


def spans(documents: DataFrame, keep) -> DataFrame:
    """``keep`` columns of ``documents`` (text among its columns), _base and _all spans in order."""
    own = documents.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    found = candidates(base_spans(own)).drop("_text", "_digit")
    found = materialize(found, "spans")
    exploded = found.select(F.explode("_candidates").alias("_c"))
    names = list(dict.fromkeys([*LABELERS, *FEATURES]))
    counted = exploded.groupBy(*[F.col(f"_c.{x}").alias(x) for x in names]).agg(F.count(F.lit(1)).alias("n"))
    decide = classifier(counted.orderBy(*names).collect())

    def chosen(c: Column) -> Column:
        return F.struct(c["start"], c["end"], F.lit(ADDED).alias("kind"))

    order = {kind: i for i, kind in enumerate((*BASE, ADDED))}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])

    def in_order(spans_: Column) -> Column:
        ranked = F.array_sort(F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.transform(ranked, lambda s: F.struct(s["start"], s["end"], s["kind"]))

    secrets = F.transform(F.filter("_candidates", decide), chosen)
    base = F.concat(*[f"_{k}" for k in BASE])
    every = F.concat(base, F.coalesce(secrets, F.array().cast(SPAN)))
    return found.select(*[F.col(f"`{c}`") for c in keep], *[f"_{k}" for k in BASE], in_order(base).alias("_base"), in_order(every).alias("_all"))


def listed(spans_: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def find_pii(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_secret, base_sha256, spans, n_spans, has_personal_data) per row of ``documents``.

    Spans are in code points, ends exclusive.  Those of one base kind do not overlap; those of
    different kinds may.  Null and empty texts have none.  Repeated rows keep a row each and
    a null doc_id stays null.  An empty table stays empty.  Other columns are not looked at.

    Texts are read once; their spans are written, the candidates' votes counted, and the
    spans read again with the classifier.  Only counts of vote and feature patterns are shuffled.
    """
    found = spans(documents, ["doc_id"])
    counts = [F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in BASE]
    n_secret = (F.size("_all") - F.size("_base")).cast("bigint").alias("n_secret")
    return found.select(
        "doc_id", *counts, n_secret, F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_all")).alias("spans"),
        F.size("_all").cast("bigint").alias("n_spans"), (F.size("_all") > 0).alias("has_personal_data"),
    )


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with each span replaced by its kind in angle brackets; all columns stay.

    Where spans overlap, the text from the first's start to the last's end is replaced by the
    first's kind.  A null text stays null.  A column n_chars, if there is one, is counted anew.
    """
    clash = [c for c in documents.columns if c in ("_base", "_all", "_text", "_digit", "_candidates", "_found", "_starts", *[f"_{k}" for k in BASE])]
    renamed = documents.withColumnsRenamed({c: f"_llm{c}" for c in clash})
    found = spans(renamed, renamed.columns)
    empty = F.struct(F.array().cast(SPAN).alias("kept"), F.lit(0).alias("to"))

    def add(state: Column, s: Column) -> Column:
        last = F.element_at(state["kept"], -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        apart = (F.size(state["kept"]) == 0) | (s["start"] >= state["to"])
        head = F.slice(state["kept"], F.lit(1), F.greatest(F.size(state["kept"]) - 1, F.lit(0)))
        kept = F.when(apart, F.concat(state["kept"], F.array(s))).otherwise(F.concat(head, F.array(longer)))
        return F.struct(kept.alias("kept"), F.greatest(state["to"], s["end"]).alias("to"))

    merged = F.aggregate("_all", empty, add, lambda state: state["kept"])
    out = found.withColumn("_all", F.when(F.size("_all") > 0, merged))
    before = F.concat(F.array(F.lit(0)), F.transform("_all", lambda s: s["end"]))
    pieces = F.zip_with("_all", F.slice(before, F.lit(1), F.size("_all")), lambda s, at: F.concat(
        F.substring(F.col("text"), at + 1, s["start"] - at), F.lit("<"), F.upper(s["kind"]), F.lit(">")
    ))
    rest = F.substring("text", F.element_at(before, -1) + 1, F.char_length("text"))
    clean = F.when(F.col("_all").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.concat(F.concat_ws("", pieces), rest))
    out = out.withColumn("text", clean)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("_all").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(documents.schema["n_chars"].dataType)))
    back = {f"_llm{c}": c for c in clash}
    return out.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in renamed.columns])
