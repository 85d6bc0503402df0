"""URL filters by a tree of path templates (DataFrame operations only).

Paths are generalised level by level from the root: a segment that is variable by its shape (numbers, long hexadecimal
strings, long mixed ones) becomes the wildcard of its shape, keeping a file ending. Then the branches of each node, of any
size, are compared:

* Labelled branches are tested against the node's share of blocked labels, with a bound that grows with their number.
  Those above it, those below it and those that do not differ are three groups of statistically similar branches; the
  branches of a group, two or more, merge into one wildcard (/*+, /*- and /*).
* A node with many branches that hold few urls each merges all that the test leaves, labelled or not, into /*.

Four segments are levels of their own; all that follow are one last level, whose branches are whole remainders of paths,
so no part of a path is left out. The templates that remain get a smoothed purity: the share of blocked labels in the
template of the host, drawn towards the same template over all hosts, which is drawn towards the share over all labels.
Templates at or above `reject_at` are blocked.

Labels are what the rules say of the urls that they fit; a table of labels may be added. Rules themselves always win:
a rule fits its host and all subdomains when the path starts with the rule's path; the longest rule wins (longer host and
path together; on equal length the longer host).

All statistics are counted after map-side aggregation; urls of a hot host are joined to its node's few branches and are
never gathered. Defined cases: a null url, or one without ://, has empty host and path, no rule, and the verdict of the
empty template; urls of any length are read whole; rules that tie in length of host and path go by the longer host; a null
page_id has no label, repeated page_ids are rows of their own and share their label (blocked, if one of several says so);
further columns are not read, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    Rule("org", "/", False),
    Rule("example.org", "/es/", True),
    Rule("example.org", "/en/1", True),
    Rule("com", "/fr/", False),
    Rule("com", "/de/", True),
)
#: Segments that are levels of their own; the rest of a path is one more level.
LEVELS = 4
#: A node merges what is left of its branches when it has more than this many and the mean branch holds less than LEAST_MEAN urls.
MOST_BRANCHES = 16
LEAST_MEAN = 4.0
#: Least variance that a share of labels is taken to have.
LEAST_VARIANCE = 0.01
#: Pseudo-labels with which a template is drawn to its parent, and the purity from which on it is rejected.
SMOOTHING = 4.0
REJECT_AT = 0.8


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def ruled(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """struct<rule,block> of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,block:boolean>")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        out = F.when(fits(rule, host, path), F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.block).alias("block"))).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    """The segment with its variable part as a wildcard of its kind, its ending kept."""
    stem, ending = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z][A-Za-z0-9]{1,4})?$", 1), F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z][A-Za-z0-9]{1,4})?$", 2)
    kind = (
        F.when(stem.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(stem.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("{hex}"))
        .when(stem.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("{date}"))
        .when(stem.rlike(r"[0-9]") & (F.length(stem) >= 12), F.lit("{id}"))
        .otherwise(stem)
    )
    return F.concat(kind, ending)


def merges(shapes: DataFrame) -> DataFrame:
    """host, template, branch, wildcard: the branches that merge, of shapes (host, template, branch, n, known, bad)."""
    node = ["host", "template"]
    branches = shapes.groupBy(*node, "branch").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    nodes = branches.groupBy(*node).agg(
        F.count(F.lit(1)).alias("branches"), F.sum("n").alias("urls"), F.count_if(F.col("known") > 0).alias("labelled"), F.try_divide(F.sum("bad"), F.sum("known")).alias("share")
    )
    error = F.sqrt(F.greatest(F.col("share") * (1 - F.col("share")), F.lit(LEAST_VARIANCE)) * F.col("known"))
    off = (F.col("bad") - F.col("share") * F.col("known")) / error
    # So many standard errors as the largest of `labelled` branches reaches by chance.
    bound = F.sqrt(2 * F.log(2.0 * F.col("labelled")))
    side = F.when(F.col("known") == 0, "?").when(off > bound, "+").when(off < -bound, "-").otherwise("")
    many = (F.col("branches") > MOST_BRANCHES) & (F.col("urls") < LEAST_MEAN * F.col("branches"))
    tested = branches.join(nodes, node).select(*node, "branch", side.alias("side"), many.alias("many"))
    sides = tested.groupBy(*node, "side").agg(F.count(F.lit(1)).alias("members"))
    found = tested.join(sides, [*node, "side"])
    rest = F.col("many") & F.col("side").isin("", "?")
    alike = (F.col("members") > 1) & (F.col("side") != "?")
    return found.filter(rest | alike).select(*node, "branch", F.concat(F.lit("/*"), F.when(F.col("side") != "?", F.col("side")).otherwise("")).alias("wildcard"))


def judge(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    labels: DataFrame | None = None,
    url: str = "url",
    smoothing: float = SMOOTHING,
    reject_at: float = REJECT_AT,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row of pages; labels: optional (page_id, blocked)."""
    scratch = Scratch(pages.sparkSession)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", ruled(rules, F.col("host"), F.col("path")))
    rows = rows.withColumn("blocked", F.col("fit.block"))
    if labels is not None:
        known = labels.groupBy("page_id").agg(F.max("blocked").alias("__blocked"))
        rows = rows.join(known, "page_id", "left").withColumn("blocked", F.coalesce("blocked", "__blocked")).drop("__blocked")
    segments = F.filter(F.split(F.col("path"), "/"), lambda s: s != "")
    rows = rows.withColumn("segments", F.transform(segments, shape))
    rest = F.array_join(F.slice("segments", LEVELS + 1, F.greatest(F.size("segments") - LEVELS, F.lit(0))), "/")
    levels = F.concat(F.slice("segments", 1, LEVELS), F.when(F.size("segments") > LEVELS, F.array(rest)).otherwise(F.expr("cast(array() as array<string>)")))
    rows = scratch.table(rows.select("page_id", "host", "path", "fit.rule", F.col("fit.block").alias("ruled"), "blocked", levels.alias("segments")))

    # One row for each host and shape of path; urls of one shape are settled together from here on.
    shapes = rows.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), F.count("blocked").alias("known"), F.count_if("blocked").alias("bad"))
    shapes = scratch.table(shapes.withColumn("template", F.lit("")))
    for level in range(1, LEVELS + 2):
        here = shapes.withColumn("branch", F.try_element_at("segments", F.lit(level)))
        merged = merges(here.filter("branch is not null"))
        step = F.when(F.col("branch").isNull(), "").otherwise(F.coalesce("wildcard", F.concat(F.lit("/"), "branch")))
        before = shapes
        following = here.join(merged, ["host", "template", "branch"], "left").withColumn("template", F.concat("template", step))
        shapes = scratch.table(following.drop("branch", "wildcard"))
        scratch.drop(before)

    own = shapes.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    wide = shapes.groupBy("template").agg(F.sum("known").alias("wide_known"), F.sum("bad").alias("wide_bad"))
    total = shapes.agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")).first()
    prior = (total["bad"] or 0) / total["known"] if total["known"] else 0.0
    purity = own.join(wide, "template")
    drawn = (F.col("wide_bad") + smoothing * prior) / (F.col("wide_known") + smoothing)
    purity = purity.select("host", "template", ((F.col("bad") + smoothing * drawn) / (F.col("known") + smoothing)).alias("purity"))
    settled = scratch.table(shapes.select("host", "segments", "template").join(purity, ["host", "template"]))
    judged = rows.join(settled, ["host", "segments"], "left")
    block = F.coalesce(F.col("ruled"), F.col("purity") >= reject_at)
    return judged.select("page_id", "host", "path", "rule", F.when(block, "block").otherwise("allow").alias("verdict"), "template", "purity")
