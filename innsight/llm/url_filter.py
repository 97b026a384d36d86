"""URL filtering: fixed host and path rules, then a learned tree of path templates.

Per host the paths form a tree of segments.  Level by level (:func:`templates`)

* a node whose children are many and mostly seen once is variable: its children
  become one wildcard branch ``*``;
* children whose labelled share of bad pages does not differ significantly from
  their siblings' (two-proportion z test) merge into one branch ``~``;
* those that do differ merge by their smoothed share, in steps of 1 /
  ``LEVELS``: a branch ``=0`` of the clean ones, ``=9`` of the bad ones, and so on.

The first ``ALWAYS`` levels are built for every URL.  Further down a node goes on
while its labelled pages are unlike; where they are all clean, all bad or none,
labels give no reason to part it, and what lies below is one branch ``**``.
There is no greatest depth: segments that all URLs of a node share are passed in
one step, so the number of steps is that of the branchings, not of the segments.
A template (host and branches) is rejected when its labelled purity, smoothed towards the
corpus' share of bad pages with ``PRIOR`` pseudo-pages, falls short:
``(bad + PRIOR * base) / (labelled + PRIOR) >= REJECT``.  Every URL counts in the
tree; labels only decide verdicts.

All steps are group-bys with map-side partial sums and joins on (host, prefix);
URLs travel without their pages.  A host with a third of all rows adds one row
a task and branch to a shuffle, and its rows are split in the join by adaptive
execution.

Defined results: a null URL or one without ``://`` has empty host and path, no
rule and template ``/``; its verdict comes from the tree like any other's;
unlabelled templates get the corpus' share; repeated rows count each; with no
labels at all everything is allowed; empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.util import written

ALWAYS = 8  # levels that every URL goes through
FANOUT = 8  # a variable node has more children than this ...
SPREAD = 0.3  # ... and more than this share of them to its URLs
Z = 1.96
LEVELS = 10
PRIOR = 4.0
REJECT = 0.5

Rule = tuple[str, str, str]  # allow or block, host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(longest fitting rule as host + path, its verdict); nulls where none fits.

    A rule fits its host and all subdomains where the path starts with its own.
    ``rules`` is a plan parameter: a list of some hundreds at most.
    """
    name = verdict = None
    for action, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def _branch(rows: DataFrame, at: int | Column) -> DataFrame:
    """``rows`` with the branch of segment ``at`` (0-based) added to _template; those without that segment unchanged."""
    below = rows.withColumn("_segment", F.get("_segments", F.lit(at) if isinstance(at, int) else at))
    children = below.where("_segment IS NOT NULL").groupBy("_host", "_template", "_segment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_labelled").alias("l"), F.sum("_bad").alias("b"))
    nodes = children.groupBy("_host", "_template").agg(
        F.sum("n").alias("nn"), F.sum("l").alias("nl"), F.sum("b").alias("nb"), F.count(F.lit(1)).alias("fan"))
    nodes = nodes.withColumn("_variable", (F.col("fan") > FANOUT) & (F.col("fan") > SPREAD * F.col("nn")))
    fixed = children.join(nodes.where("NOT _variable"), ["_host", "_template"])
    others = F.col("nl") - F.col("l")
    pooled = F.col("nb") / F.col("nl")
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("l") + 1 / others))
    apart = F.abs(F.col("b") / F.col("l") - (F.col("nb") - F.col("b")) / others)
    differs = F.when((F.col("l") > 0) & (others > 0), apart > Z * spread).otherwise(False)
    # Those that differ merge by the level of their smoothed share, all others into ~.
    level = F.round(LEVELS * (F.col("b") + PRIOR * pooled) / (F.col("l") + PRIOR)).cast("int")
    own = fixed.where(differs).select("_host", "_template", F.col("_segment").alias("_own"), F.concat(F.lit("="), level.cast("string")).alias("_branch"))
    wild = nodes.where("_variable").select(F.col("_host"), F.col("_template"), F.lit("*").alias("_wild"))
    step = below.join(wild, ["_host", "_template"], "left")
    step = step.join(own, (step["_host"] == own["_host"]) & (step["_template"] == own["_template"]) & (step["_segment"] == own["_own"]), "left").select(
        *[step[c] for c in step.columns], own["_branch"])
    branch = F.coalesce("_wild", "_branch", F.lit("~"))
    moved = F.when(F.col("_segment").isNull(), F.col("_template")).otherwise(F.concat("_template", branch, F.lit("/")))
    return step.withColumn("_template", moved).select(*rows.columns)


def _open(rows: DataFrame) -> DataFrame:
    """``rows`` (segments from ``_at`` on are left) plus _shared: how many segments all URLs of the node share; null where it is closed."""
    rest = F.slice("_segments", F.col("_at") + 1, F.size("_segments") - F.col("_at"))
    nodes = rows.groupBy("_host", "_template").agg(F.sum("_labelled").alias("l"), F.sum("_bad").alias("b"), F.min(rest).alias("lo"), F.max(rest).alias("hi"))
    # What the least and the greatest array share, all between them share.
    unlike = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), False)
    shared = F.when(unlike == 0, F.size("lo").cast("long")).otherwise(unlike - 1).cast("int")
    nodes = nodes.where("b > 0 AND b < l").select("_host", "_template", shared.alias("_shared"))
    return rows.join(nodes, ["_host", "_template"], "left")


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` (_host, _path, _labelled 0/1, _bad 0/1, more) plus _template, the branches below the host."""
    segments = F.array_remove(F.split("_path", "/"), "")
    rows = urls.withColumn("_segments", segments).withColumn("_template", F.lit("/"))
    rows = written(rows, "urls")
    deepest = rows.agg(F.max(F.size("_segments"))).first()[0] or 0
    for depth in range(min(deepest, ALWAYS)):
        rows = written(_branch(rows, depth), f"templates{depth}")
    left = F.size("_segments") > ALWAYS
    done, rows = [rows.where(~left)], rows.where(left).withColumn("_at", F.lit(ALWAYS))
    while deepest > ALWAYS:
        rows = written(_open(rows), "open")
        closed = rows.where("_shared IS NULL").withColumn("_template", F.concat("_template", F.lit("**")))
        rows = rows.where("_shared IS NOT NULL").withColumn("_template", F.concat("_template", F.repeat(F.lit("~/"), F.col("_shared"))))
        rows = rows.withColumn("_at", F.col("_at") + F.col("_shared")).drop("_shared")
        rows = _branch(rows, F.col("_at")).withColumn("_at", F.col("_at") + 1)
        rows = written(rows, "deeper")
        done += [f.select(*done[0].columns) for f in (closed, rows.where(F.size("_segments") <= F.col("_at")))]
        rows = rows.where(F.size("_segments") > F.col("_at"))
        if rows.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.drop("_segments")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], bad: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", label_key: Column | None = None) -> DataFrame:
    """One row per page: ``id_col``, host, path, rule, verdict, template, bad_share.

    ``bad`` (columns key, bad 0/1) labels the pages whose ``label_key`` equals a key;
    a key that is labelled twice counts as bad if one label says so.
    """
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), (F.lit(None).cast("long") if label_key is None else label_key).alias("_key"))
    rows = rows.withColumn("_host", host).withColumn("_path", path)
    if bad is None:
        rows = rows.withColumn("_labelled", F.lit(0)).withColumn("_bad", F.lit(0))
    else:
        one = bad.where("key IS NOT NULL").groupBy("key").agg(F.max("bad").alias("_label"))
        rows = rows.join(one, F.col("_key") == F.col("key"), "left")
        rows = rows.withColumn("_labelled", F.col("_label").isNotNull().cast("int")).withColumn("_bad", F.coalesce("_label", F.lit(0)).cast("int"))
    tree = templates(rows.select("_id", "_host", "_path", "_labelled", "_bad"))
    sums = tree.groupBy("_host", "_template").agg(F.sum("_labelled").alias("l"), F.sum("_bad").alias("b"))
    total = tree.agg(F.sum("_labelled").alias("l"), F.sum("_bad").alias("b")).first()
    base = (total["b"] or 0) / total["l"] if total["l"] else 0.0
    shares = sums.select("_host", "_template", ((F.col("b") + PRIOR * base) / (F.col("l") + PRIOR)).alias("bad_share"))
    out = tree.join(shares, ["_host", "_template"])
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    learned = F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow")
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"),
                      F.coalesce(verdict, learned).alias("verdict"), F.col("_template").alias("template"), "bad_share")
