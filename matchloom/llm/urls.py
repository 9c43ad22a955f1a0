"""URL filters: host and path rules, and a path-template tree for what no rule fits.

Everything is DataFrame functions.  Parsing: the host runs from the first
``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path from there
to ``?``, ``#`` or the end.  A null url or one without ``://`` has both empty.

The tree: per host, all path segments are first generalised by kind (digits, long
hex, dates become wildcards), then all children of a node that has too many different ones become one wildcard, from the root down to any
depth.  A round settles, for every node reached, all levels up to the first where it branches into a few children: on the way there the
same urls stay together, whether a level is a wildcard or has one child, so long shared paths cost no rounds.
At every level, sibling branches of a node are put in the order of their smoothed shares of blocked urls; neighbours are merged where a two-proportion z-test
does not tell the shares apart and at least ``overlap`` of what they lead on to is common.  A template
is rejected if its smoothed purity (share of blocked among the urls that rules
label) reaches ``reject_at``.  Purity is smoothed along the path: all urls are the prior of the host, the host of its merged
branch, that of the merged branch below it, and so on to the template; a branch without siblings is no step, since it says nothing that
its parent does not.

Defined results: null urls get the verdict of the empty host; repeated pages
are judged each; an empty table gives an empty result; other columns are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import stash as S

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits; both null if none does.

    A rule is text ``host/path``; it fits its host and all subdomains where the
    path starts with the rule's path. Rules are a fixed list, so one expression.
    """
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    out = none
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.find("/")
        h, p = (rule[:at], rule[at:]) if at >= 0 else (rule, "")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def kind_of(segment: Column) -> Column:
    """A segment with its variable parts as wildcards; the file ending stays."""
    s = F.regexp_replace(segment, r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?", "{date}")
    s = F.regexp_replace(s, r"[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}", "{uuid}")
    s = F.regexp_replace(s, r"\b(?=[0-9a-f]*[0-9])[0-9a-f]{12,}", "{hex}")
    return F.regexp_replace(s, r"[0-9]+", "{n}")


def _segments(path: Column) -> Column:
    """All path segments, each generalised by kind."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", -1), kind_of)


def _node(host: Column, segments: Column, level: Column) -> Column:
    """The node that the first ``level`` segments lead to, by two hashes."""
    path = F.slice(segments, 1, level)
    return F.struct(F.xxhash64(host, path).alias("a"), F.hash(path, host).alias("b"))


def _generalised(tree: DataFrame, most_children: int) -> DataFrame:
    """tree (a table of templates) with the children of nodes that have over ``most_children`` as wildcards.

    ``at`` is the level that a row has reached; rows that agree up to there are a node.
    """
    tree = tree.withColumn("at", F.lit(0))
    while True:
        node = _node(F.col("host"), F.col("segments"), F.col("at"))
        open_ = tree.filter(F.size("segments") > F.col("at")).select(node.alias("node"), "at", "segments")
        # a node with few rows has few children at every level below
        large = open_.groupBy("node").agg(F.count("*").alias("rows")).filter(F.col("rows") > most_children).select("node")
        seen = open_.join(large, "node").select("node", F.posexplode("segments").alias("level", "segment"), "at").filter("level >= at")
        kids = seen.groupBy("node", "level").agg(F.count_distinct("segment").alias("kids"))
        many, few = F.col("kids") > most_children, (F.col("kids") > 1) & (F.col("kids") <= most_children)
        found = kids.groupBy("node").agg(F.min(F.when(few, F.col("level"))).alias("fork"), F.collect_list(F.when(many, F.col("level"))).alias("stars"))
        found = S.stash(found, "nodes")
        if found.isEmpty():
            S.drop(found)
            return tree.drop("at")
        star = F.transform("segments", lambda x, i: F.when(F.array_contains("stars", i) & (F.col("fork").isNull() | (i < F.col("fork"))), F.lit("*")).otherwise(x))
        keep = [c for c in tree.columns if c not in ("segments", "at")]
        up = tree.withColumn("node", F.when(F.size("segments") > F.col("at"), node)).join(found, "node", "left")
        up = up.select(*keep, F.when(F.col("stars").isNotNull(), star).otherwise(F.col("segments")).alias("segments"), F.coalesce(F.col("fork") + 1, F.size("segments")).alias("at"))
        before, tree = tree, S.stash(up, "tree")
        S.drop(before)
        S.drop(found)


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    most_children: int = 24,
    z: float = 1.96,
    overlap: float = 0.5,
    weight: float = 8.0,
    reject_at: float = 0.5,
) -> DataFrame:
    """Columns page_id, host, path, rule, verdict, template, purity.

    The tree is built from counts by (host, kinds), each level from the one before;
    its verdicts join back to pages by that key. Pages are shuffled there only if
    the tree is above Spark's broadcast threshold; then AQE splits hot keys.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    cut = parsed.select("*", rule_for(F.col("host"), F.col("path"), rules).alias("r"), _segments(F.col("path")).alias("segments"))
    cut = cut.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"), F.xxhash64("segments").alias("kinds"), "segments")

    # One row per (host, kinds): all later work is on this table of templates.
    labelled = F.count("ruled")
    blocked = F.count(F.when(F.col("ruled") == "block", 1))
    tree = cut.groupBy("host", "kinds", "segments").agg(F.count("*").alias("n"), labelled.alias("labelled"), blocked.alias("blocked"))
    tree = _generalised(S.stash(tree, "tree"), most_children)
    tree = tree.withColumn("template", F.concat_ws("/", "segments"))

    # Smoothed shares, from the root to the leaf; each is the prior of the next.
    def share(prior: Column) -> Column:
        return (F.sum("blocked") + weight * prior) / (F.sum("labelled") + weight)

    whole = tree.agg(share(F.lit(0.5)).alias("p_all"))
    hosts = tree.groupBy("host").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    hosts = hosts.crossJoin(F.broadcast(whole)).select("host", ((F.col("blocked") + weight * F.col("p_all")) / (F.col("labelled") + weight)).alias("p_host"))
    templates = tree.groupBy("host", "template").agg(F.first("segments").alias("segments"), F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    templates = S.stash(templates.join(hosts, "host"), "templates")

    # A row for each template and level: the node above, the segment, what it leads on to.
    level = F.explode(F.sequence(F.lit(0), F.size("segments") - 1)).alias("level")
    nodes = templates.select("host", "template", "segments", "p_host", "blocked", "labelled", level)
    nodes = nodes.select("host", "template", "p_host", "blocked", "labelled", "level", _node(F.col("host"), F.col("segments"), F.col("level")).alias("parent"), F.get("segments", F.col("level")).alias("branch"), F.coalesce(F.get("segments", F.col("level") + 1), F.lit("")).alias("lead"))
    # A node has at most most_children branches, and a branch leads on to at most so many, or to none.
    branches = nodes.groupBy("parent", "branch").agg(share(F.first("p_host")).alias("p"), F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"), F.collect_set("lead").alias("leads"))
    rise = Window.partitionBy("parent").orderBy("p", "branch")
    before = lambda c: F.lag(c).over(rise)
    n1, n2 = F.col("labelled") + weight, before("labelled") + weight
    mean = (F.col("p") * n1 + before("p") * n2) / (n1 + n2)
    apart = F.abs(F.col("p") - before("p")) > z * F.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n2))
    common = F.size(F.array_intersect("leads", before("leads"))) / F.size(F.array_union("leads", before("leads")))
    branches = branches.withColumn("siblings", F.count("*").over(Window.partitionBy("parent")) - 1).filter("siblings > 0")
    branches = branches.withColumn("new", F.coalesce(apart | (common < overlap), F.lit(True)).cast("int")).withColumn("group", F.sum("new").over(rise))
    pooled = Window.partitionBy("parent", "group")
    branches = branches.select("parent", "branch", F.sum("blocked").over(pooled).alias("of_blocked"), F.sum("labelled").over(pooled).alias("of_labelled"))

    steps = nodes.select("host", "template", "level", "parent", "branch").join(branches, ["parent", "branch"])
    steps = steps.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("level", "of_blocked", "of_labelled"))).alias("steps"))
    prior = F.aggregate(F.coalesce("steps", F.array().cast("array<struct<level:int,of_blocked:bigint,of_labelled:bigint>>")), F.col("p_host"), lambda p, x: (x["of_blocked"] + weight * p) / (x["of_labelled"] + weight))
    pure = templates.join(steps, ["host", "template"], "left").select("host", "template", ((F.col("blocked") + weight * prior) / (F.col("labelled") + weight)).alias("purity"))
    key = tree.select("host", "kinds", "template").join(pure, ["host", "template"])
    return (
        cut.select("page_id", "host", "path", "rule", "ruled", "kinds")
        .join(key, ["host", "kinds"])
        .select(
            "page_id", "host", "path", "rule",
            F.coalesce(F.col("ruled"), F.when(F.col("purity") >= reject_at, "block").otherwise("allow")).alias("verdict"),
            "template", F.round("purity", 9).alias("purity"),
        )
    )
