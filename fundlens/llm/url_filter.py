"""Allow or block urls: rules first, then a path-template tree for the rest.

Per host, paths become templates, level by level.  Digit runs of a segment are wildcards.  Below
a node of ``FAN`` children or more, a child with a twentieth of the node's pages stays as it is
and all others become one wildcard, whose own children are then looked at together.  That is a
matter of shares, so a table and its ten-fold have the same templates, and no node keeps more
than ``KEPT`` children and a wildcard.  Templates that some rule labels have a purity: the share
of blocked pages.  Sibling branches, and sibling templates, are merged along their sorted shares
where neighbours do not differ significantly.  Purities are smoothed down the tree, from all pages
to host, the branch above, branches and templates; a template whose purity is ``REJECT`` or more
is blocked.

Everything after the first aggregation works on distinct templates, not on pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialize

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEPTH = 12  # levels of the tree; what is below is one segment
FAN = 16  # children from which a node has a wildcard
KEPT = 20  # a child with one of so many parts of its node's pages is no part of the wildcard
SMOOTH = 8.0  # labelled pages that a parent's purity counts as
SIMILAR = 2.0  # standard errors that merged siblings may be apart
REJECT = 0.7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host, in lower case, and path of a url; both empty if it is null or has no ``://``."""
    after = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for of, start, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # longer ones go outside
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        text = F.when(fits, F.lit(of + start)).otherwise(text)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def segments(path: Column) -> Column:
    """The path's segments with digit runs as ``#``, ``DEPTH`` at most."""
    plain = F.split(F.regexp_replace(path, "[0-9]+", "#"), "/")
    tail = F.array(F.array_join(F.slice(plain, DEPTH, F.greatest(F.size(plain) - (DEPTH - 1), F.lit(1))), "/"))
    return F.when(F.size(plain) > DEPTH, F.concat(F.slice(plain, 1, DEPTH - 1), tail)).otherwise(plain)


def templates(pages: DataFrame) -> DataFrame:
    """(host, lexical, upper, above, template, labelled, blocked) per distinct lexical template.

    ``pages`` has host, lexical (an array of segments) and blocked (1, 0 or null if unlabelled).
    ``above`` is the branch a template hangs on and ``upper`` the one that hangs on.  Each level
    is named and written before the next.  Only children that change are joined, by host,
    branch and segment, from a written table that adaptive execution may split or broadcast.
    """
    distinct = pages.groupBy("host", "lexical").agg(
        F.count(F.lit(1)).alias("n"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked")
    )
    start = [F.lit("").alias(c) for c in ("upper", "above", "template")]
    tree = materialize(distinct.select("*", *start), "templates")
    deepest = tree.agg(F.max(F.size("lexical"))).first()[0] or 0
    for level in range(1, deepest + 1):
        rows = tree.withColumn("segment", F.get("lexical", F.lit(level - 1)))
        children = materialize(rows.where("segment is not null").groupBy("host", "template", "segment").agg(F.sum("n").alias("n")), "children")
        nodes = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("fan"), F.sum("n").alias("total")).where(F.col("fan") >= FAN)
        light = children.join(materialize(nodes, "nodes"), ["host", "template"]).where(F.col("n") * KEPT < F.col("total"))
        light = materialize(light.select("host", "template", "segment", F.lit("*").alias("star")), "wildcards")
        named = rows.join(light, ["host", "template", "segment"], "left")
        there, shown = F.col("segment").isNotNull(), F.coalesce("star", "segment")
        longer = shown if level == 1 else F.concat("template", F.lit("/"), shown)
        tree = materialize(named.select(
            "host", "lexical", "n", "labelled", "blocked",
            F.when(there, F.col("above")).otherwise(F.col("upper")).alias("upper"),
            F.when(there, F.col("template")).otherwise(F.col("above")).alias("above"),
            F.when(there, longer).otherwise(F.col("template")).alias("template"),
        ), "templates")
    return tree


def alike(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """The labelled ``rows`` with ``pooled`` and ``pooled_blocked``: their group's label counts.

    Along the shares of the rows of one parent, a new group begins where a row's share differs
    from the one before by more than ``SIMILAR`` standard errors.  A parent has a bounded number of rows.
    """
    order = W.partitionBy(*by).orderBy("share", name)
    known = rows.where("labelled > 0").withColumn("share", F.col("blocked") / F.col("labelled"))
    before, before_n, before_blocked = (F.lag(c).over(order) for c in ("share", "labelled", "blocked"))
    joint = (F.col("blocked") + before_blocked) / (F.col("labelled") + before_n)
    error = F.sqrt(joint * (1 - joint) * (1 / F.col("labelled") + 1 / before_n))
    known = known.withColumn("apart", F.coalesce((F.col("share") - before > SIMILAR * error + 1e-9).cast("int"), F.lit(0)))
    known = known.withColumn("group", F.sum("apart").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    group = W.partitionBy(*by, "group")
    sums = [F.sum("labelled").over(group).alias("pooled"), F.sum("blocked").over(group).alias("pooled_blocked")]
    return known.select(*by, name, *sums)


def purities(found: DataFrame) -> DataFrame:
    """(host, above, template, purity) with similar siblings merged and shares smoothed down the tree."""
    counts = [F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")]
    leaves = materialize(found.groupBy("host", "upper", "above", "template").agg(*counts), "leaves")
    branches = leaves.groupBy("host", "upper", "above").agg(*counts)
    hosts = branches.groupBy("host").agg(*counts)
    total = hosts.agg(*counts).select(((F.col("blocked") + 1) / (F.col("labelled") + 2)).alias("overall")).first()
    overall = (total and total[0]) or 0.5

    def smooth(blocked: str, labelled: str, above: Column) -> Column:
        blocked, labelled = F.coalesce(blocked, F.lit(0)), F.coalesce(labelled, F.lit(0))
        return (blocked + above * SMOOTH) / (labelled + SMOOTH)

    hosts = materialize(hosts.select("host", smooth("blocked", "labelled", F.lit(overall)).alias("of_host")), "hosts")
    uppers = branches.groupBy("host", "upper").agg(*counts).join(hosts, "host")
    uppers = materialize(uppers.select("host", "upper", smooth("blocked", "labelled", F.col("of_host")).alias("of_upper")), "uppers")
    pooled = branches.join(alike(branches, ["host", "upper"], "above"), ["host", "upper", "above"], "left").join(uppers, ["host", "upper"])
    pooled = pooled.select("host", "upper", "above", smooth("pooled_blocked", "pooled", F.col("of_upper")).alias("of_branch"))
    keys = ["host", "upper", "above", "template"]
    merged = leaves.join(alike(leaves, ["host", "upper", "above"], "template"), keys, "left")
    merged = merged.join(materialize(pooled, "branches"), ["host", "upper", "above"])
    return merged.select(*keys, smooth("pooled_blocked", "pooled", F.col("of_branch")).alias("purity"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) per row of ``pages`` (page_id, url).

    ``rule`` is null where none fits; then the template's purity gives the verdict.  Pages that
    a rule fits are the labels.  A null url, or one without ``://``, has an empty host and
    path and is judged by the template of those.  Repeated rows keep a row each and count each
    time.  An empty table stays empty.  Other columns are not looked at.
    """
    host, path = host_and_path("url")
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.select("*", rule.alias("rule"), verdict.alias("ruled"), segments(F.col("path")).alias("lexical"))
    labelled = ruled.withColumn("blocked", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    found = templates(labelled)
    keys = ["host", "upper", "above", "template"]
    judged = found.select("lexical", *keys).join(materialize(purities(found), "purities"), keys)
    # Written, so that adaptive execution can split a hot template's pages in the last join.
    judged = materialize(judged.select("host", "lexical", "template", "purity"), "judged")
    chosen = F.coalesce(F.col("ruled"), F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return ruled.join(judged, ["host", "lexical"]).select("page_id", "host", "path", "rule", chosen.alias("verdict"), "template", "purity")
