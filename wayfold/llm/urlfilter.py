"""URL verdicts from a tree of path templates for each host.

Path segments become shapes, positions at which a branch has very many different segments become wildcards, and siblings
that look alike in what stands below them and in their labels become one, level by level from the leaves up. A template is
rejected if the smoothed share of blocked pages among its labelled ones is high. Rules label the pages they fit, and decide
these themselves. Everything here is DataFrame operations; paths may be of any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.store import written

#: A position is a wildcard if it has so many different segments and fewer pages than this for each of them.
MANY, FEW_PAGES = 12, 4
#: Weight of the overall share of blocked pages in a template's share, and the share from which it is rejected.
PRIOR, REJECT = 4.0, 0.8
#: Standard deviations by which the shares of branches that are merged may differ from those of all their siblings.
ALIKE = 2.0

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both are empty where it is null or has no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct (size, rule, verdict); null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's. Rules are a short list that goes into
    the plan; of rules of one length the one that sorts last wins.
    """
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in rules
    ]
    nothing = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.array_max(F.array(nothing, *fits))


def shape(segment: Column) -> Column:
    """A segment's shape: digits and long hexadecimal or mixed strings lose their value, other segments stay."""
    number = F.regexp_replace(segment, r"[0-9]+", "{n}")
    token = segment.rlike(r"^[0-9A-Fa-f-]{16,}$") | segment.rlike(r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z_-]{12,}$")
    return F.when(token, F.lit("{id}")).otherwise(number)


def _shapes(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)


def _near(part: str, whole: str, all_part: str, all_whole: str) -> Column:
    """Whether a branch's share part / whole is within ALIKE standard deviations of its siblings' share."""
    share = F.col(all_part) / F.greatest(F.col(all_whole), F.lit(1))
    deviation = F.sqrt(share * (1 - share) / F.greatest(F.col(whole), F.lit(1)))
    return (F.col(whole) == 0) | (F.abs(F.col(part) / F.greatest(F.col(whole), F.lit(1)) - share) <= ALIKE * deviation + 0.02)


def _with_wildcard(steps: str, level: int) -> Column:
    return F.transform(steps, lambda x, at: F.when(at == level, F.lit("*")).otherwise(x))


def _levels(paths: DataFrame, steps: str, kinds: int) -> list[int]:
    """Levels at which some host has at least so many different segments: no more than its longest path that others share."""
    each = paths.select("host", F.posexplode(steps).alias("level", "segment")).distinct()
    found = each.groupBy("host", "level").count().where(F.col("count") >= kinds).select("level").distinct()
    return sorted(r["level"] for r in found.collect())


def template_verdicts(labelled: DataFrame) -> DataFrame:
    """(host, shapes, template, purity, rejected) from rows (host, shapes, blocked: 1, 0 or null for unlabelled).

    Rows are counted by host and shapes first, so that a host with very many pages weighs no more than its templates.
    """
    counts = [F.count("*").alias("n"), F.count("blocked").alias("labels"), F.coalesce(F.sum("blocked"), F.lit(0)).cast("long").alias("bad")]
    paths = written(labelled.groupBy("host", "shapes").agg(*counts), "paths").withColumn("steps", F.col("shapes"))
    # Only at levels where some host has so many different segments can a position be a wildcard.
    for level in _levels(paths, "steps", MANY):
        segment, branch = F.get("steps", F.lit(level)), F.slice("steps", 1, level)
        at = paths.where(segment.isNotNull()).groupBy("host", branch.alias("branch"))
        stats = at.agg(F.approx_count_distinct(segment).alias("kinds"), F.sum("n").alias("pages"))
        wild = written(stats.where((F.col("kinds") >= MANY) & (F.col("pages") < FEW_PAGES * F.col("kinds"))).select("host", "branch", F.lit(True).alias("wild")), "wild")
        paths = paths.withColumn("branch", branch).join(wild, ["host", "branch"], "left")
        paths = written(paths.withColumn("steps", F.when(F.col("wild"), _with_wildcard("steps", level)).otherwise(F.col("steps"))).drop("wild", "branch"), "paths")
    # Siblings differ at one level only; what is merged below makes branches above more alike.
    sums = [F.sum(c).alias(c) for c in ("n", "labels", "bad")]
    branches = written(paths.groupBy("host", "steps").agg(*sums).withColumn("merged", F.col("steps")), "branches")
    for level in reversed(_levels(branches, "merged", 2)):
        one = branches.where(F.get("merged", F.lit(level)).isNotNull()).groupBy("host", "merged").agg(*sums)
        one = one.withColumns({"above": F.slice("merged", 1, level), "below": F.expr(f"slice(merged, {level + 2}, size(merged))")})
        family = one.groupBy("host", "above", "below").agg(F.count("*").alias("siblings"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labels", "bad")])
        family = written(family.where("siblings > 1"), "siblings")
        alike = _near("labels", "n", "all_labels", "all_n") & _near("bad", "labels", "all_bad", "all_labels")
        joined = one.join(family, ["host", "above", "below"]).where(alike)
        joined = written(joined.select("host", "merged", F.lit(True).alias("alike")), "alike")
        branches = branches.join(joined, ["host", "merged"], "left")
        branches = written(branches.withColumn("merged", F.when(F.col("alike"), _with_wildcard("merged", level)).otherwise(F.col("merged"))).drop("alike"), "branches")
    name = lambda steps: F.when(F.size(steps) > 0, F.concat(F.lit("/"), F.array_join(steps, "/"))).otherwise("")
    branches = branches.withColumns({"template": name("steps"), "merged": name("merged")}).drop("steps")
    paths = paths.withColumn("template", name("steps"))
    overall = branches.agg((F.sum("bad") / F.greatest(F.sum("labels"), F.lit(1))).alias("share")).first()["share"] or 0.0
    purity = (F.col("bad") + PRIOR * overall) / (F.col("labels") + PRIOR)
    judged = branches.groupBy("host", "merged").agg(*sums).withColumn("purity", purity)
    judged = written(judged.select("host", "merged", "purity", (F.col("purity") >= REJECT).alias("rejected")), "judged")
    named = branches.select("host", "template", "merged").join(judged, ["host", "merged"])
    return paths.select("host", "shapes", "template").join(written(named, "named"), ["host", "template"]).select("host", "shapes", F.col("merged").alias("template"), "purity", "rejected")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row.

    A rule's verdict stands for the pages it fits; the rest are blocked where their template is rejected and allowed
    otherwise. Null urls, urls without "://" and empty hosts are judged like any others, as host "". Repeated rows each
    count and are each returned; without rows nothing is.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("shapes", _shapes(F.col("path")))
    blocked = F.when(F.col("fit").isNotNull(), (F.col("fit.verdict") == "block").cast("int"))
    verdicts = written(template_verdicts(rows.select("host", "shapes", blocked.alias("blocked"))), "verdicts")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("rejected"), "block").otherwise("allow"))
    joined = rows.join(verdicts, ["host", "shapes"], "left")
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
