"""URL filter: fixed rules first, then a path-template tree judged by labelled purity.

Per host, the segments of its paths form a tree.  Digits become wildcards at once; below each
node, rare children without enough labels are then generalised to one wildcard.  Templates of the same form
whose labelled rates do not differ significantly are merged, and a template is rejected when its
smoothed share of bad pages reaches a limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.tables import columns
from shelfline.session import hand_over

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS, WILD = "#", "*"


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains when the URL's path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the pages query.
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for NULL and for a URL without `://`."""
    after = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else NULLs.  Rules are tried in order of
    length inside one expression, so pass hundreds, not millions."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        inside = (host == rule.host) | host.endswith("." + rule.host)
        fits = inside & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.text)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def path_shape(path: Column) -> Column:
    """Segments of the path, runs of digits as `#`."""
    return F.filter(F.split(F.regexp_replace(path, r"[0-9]+", DIGITS), "/"), lambda s: s != "")


def _wild(segments: Column) -> Column:
    return F.transform(segments, lambda s: F.when(s == DIGITS, s).otherwise(F.lit(WILD)))


def _common(low: Column, high: Column) -> Column:
    """Number of leading segments that the smallest and largest list share, and so all between."""
    unlike = F.transform(
        F.zip_with(low, high, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: ~x
    )
    first = F.array_position(unlike, True)
    return F.when(first == 0, F.size(low)).otherwise(first - 1).cast("int")


def _chain_ends(rows: DataFrame, node: list[str], least: int) -> DataFrame:
    """(node, _deep): of nodes whose lists are all heads of one list, how many segments `least`
    pages or more still have."""
    head = F.col("_left") == F.slice("_high", F.lit(1), F.size("_left"))
    sizes = rows.groupBy(*node, F.size("_left").alias("_size")).agg(
        F.sum("pages").alias("_pages"), F.bool_and(head).alias("_heads")
    )
    longer = Window.partitionBy(*node).orderBy(F.desc("_size"))
    deep = F.when(F.sum("_pages").over(longer) >= least, F.col("_size"))
    return (
        sizes.withColumn("_deep", deep)
        .groupBy(*node)
        .agg(F.bool_and("_heads").alias("_heads"), F.coalesce(F.max("_deep"), F.lit(0)).alias("_deep"))
        .where("_heads")
        .drop("_heads")
    )


def template_tree(
    shapes: DataFrame, share: float, least: int, least_labels: int
) -> DataFrame:
    """Add `template` to (host, shape, pages, labelled, ...): node by node, a child with `least`
    pages stays itself if it has the `share` of its node's pages or `least_labels` labels, which is
    evidence that does not shrink with the host; otherwise it joins the node's wildcard.

    A node keeps at most 1 / share children without enough labels.  What lies below a node of one
    shape or of fewer than `least` pages is known at once: all children stay, or none does.  So is
    what all shapes of a node share, whatever its length, and what lies below a node whose shapes
    are all heads of one.  Rounds therefore follow the branchings of a path, not its segments."""
    node = ["host", "template"]
    level = shapes.withColumn("template", F.array().cast("array<string>"))
    names = level.columns
    done, level = [level.where(F.size("shape") == 0)], level.where(F.size("shape") > 0)
    while True:
        level = level.withColumn(
            "_left", F.slice("shape", F.size("template") + 1, F.size("shape"))
        )
        nodes = level.groupBy(*node).agg(
            F.sum("pages").alias("_total"),
            F.count(F.lit(1)).alias("_shapes"),
            F.min("_left").alias("_low"),
            F.max("_left").alias("_high"),
        )
        nodes = nodes.withColumn("_skip", _common(F.col("_low"), F.col("_high")))
        # The smallest list is the shared head itself if some shape ends with it.
        nodes = nodes.withColumn("_ends", F.size("_low") == F.col("_skip")).drop("_low")
        level = level.join(hand_over(nodes, "url-nodes"), node)
        level = level.join(_chain_ends(level.where("_ends"), node, least), node, "left")
        left = F.col("_left")
        chain = F.concat(
            F.slice(left, F.lit(1), F.col("_deep")),
            _wild(F.slice(left, F.col("_deep") + 1, F.size(left))),
        )
        rest = (
            F.when(F.col("_total") < least, _wild(left))
            .when(F.col("_shapes") == 1, left)
            .when(F.col("_deep").isNotNull(), chain)
            .when(F.size(left) == F.col("_skip"), left)
        )
        level = hand_over(level.withColumn("_rest", rest), "url-level")
        over = level.where(F.col("_rest").isNotNull())
        done.append(over.withColumn("template", F.concat("template", "_rest")).select(*names))
        level = level.where(F.col("_rest").isNull()).withColumn(
            "template", F.concat("template", F.slice("_left", F.lit(1), F.col("_skip")))
        )
        if level.isEmpty():
            break
        # What ends here is no page of the node that goes on: that one is looked at anew.
        waiting = level.where("_ends").select(*names)
        level = level.where("NOT _ends").withColumn("_part", F.get("_left", F.col("_skip")))
        children = level.groupBy(*node, "_part").agg(
            F.sum("pages").alias("_pages"),
            F.sum("labelled").alias("_labelled"),
            F.first("_total").alias("_total"),
        )
        # Only kept children leave this step; the others need no row of their own.
        kept = children.where(
            (F.col("_pages") >= least)
            & (
                (F.col("_pages") >= share * F.col("_total"))
                | (F.col("_labelled") >= least_labels)
            )
        ).select(*node, "_part", F.lit(True).alias("_kept"))
        named = F.when(F.col("_kept") | (F.col("_part") == DIGITS), F.col("_part"))
        level = (
            level.join(kept, [*node, "_part"], "left")
            .withColumn("template", F.concat("template", F.array(named.otherwise(F.lit(WILD)))))
            .select(*names)
        )
        level = hand_over(level.unionByName(waiting), "url-grown")
        ending = F.size("shape") <= F.size("template")
        done.append(level.where(ending))
        level = level.where(~ending)
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out


def judge_templates(leaves: DataFrame, weight: float, z: float) -> DataFrame:
    """(host, template, group, purity): the merged branch and its smoothed share of bad pages.

    Templates of a host with the same form (literals aside) are put in order of their rates; a
    new group begins where two neighbours differ by more than `z` standard errors.  A group's
    share is smoothed towards its host's, and that towards the share of all labelled pages.
    """
    tally = [F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]
    found = leaves.groupBy("host", "template").agg(*tally)
    hosts = found.groupBy("host").agg(*tally)
    everywhere = hosts.agg(F.try_divide(F.sum("bad"), F.sum("labelled"))).scalar()
    hosts = hosts.select(
        "host",
        (
            (F.col("bad") + weight * F.coalesce(everywhere, F.lit(0.0)))
            / (F.col("labelled") + weight)
        ).alias("host_rate"),
    )
    form = F.transform(
        "template", lambda s: F.when(s.isin(DIGITS, WILD), s).otherwise(F.lit("+"))
    )
    order = Window.partitionBy("host", "form").orderBy("rate", "template")
    pooled = (F.col("bad") + F.lag("bad").over(order) + weight * F.col("host_rate")) / (
        F.col("labelled") + F.lag("labelled").over(order) + weight
    )
    spread = F.sqrt(
        pooled
        * (1 - pooled)
        * (1 / (F.col("labelled") + 1) + 1 / (F.lag("labelled").over(order) + 1))
    )
    apart = F.coalesce(
        F.col("rate") - F.lag("rate").over(order) > F.lit(z) * spread, F.lit(False)
    )
    merged = (
        found.join(hosts, "host")
        .withColumn(
            "rate",
            (F.col("bad") + weight * F.col("host_rate")) / (F.col("labelled") + weight),
        )
        .withColumn("form", form)
        .withColumn("_apart", apart.cast("int"))
        .withColumn("group", F.sum("_apart").over(order))
    )
    group = Window.partitionBy("host", "form", "group")
    purity = (F.sum("bad").over(group) + weight * F.col("host_rate")) / (
        F.sum("labelled").over(group) + weight
    )
    return merged.select("host", "template", "group", purity.alias("purity"))


def filter_urls(
    urls: DataFrame,
    labels: DataFrame,
    key: str = "page_id",
    rules: list[Rule] = RULES,
    share: float = 0.05,
    least: int = 5,
    least_labels: int = 5,
    weight: float = 10.0,
    z: float = 1.96,
    limit: float = 0.5,
) -> DataFrame:
    """Judge every row of (key, url): key, host, path, rule, verdict, template and purity.

    `labels` has (key, bad): 1 for a bad page, 0 for a good one.  Rows with a NULL key or label
    are no labels, and of several labels of a key the worst holds; without any label every
    template is allowed.  A NULL or broken URL has an empty host and path, which form a template
    like any other.  Repeated rows are judged alike and all kept; other columns are dropped.
    """
    host, path = split_url(F.col("url"))
    pages = columns(urls, [key, "url"]).select(
        F.col(key), host.alias("host"), path.alias("path")
    )
    pages = pages.withColumn("shape", path_shape(F.col("path")))
    known = (
        columns(labels, [key, "bad"])
        .dropna()
        .groupBy(key)
        .agg(F.max(F.col("bad").cast("bigint")).alias("bad"))
    )
    shapes = (
        pages.join(known, key, "left")
        .groupBy("host", "shape")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.count("bad").alias("labelled"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        )
    )
    tree = template_tree(hand_over(shapes, "url-shapes"), share, least, least_labels)
    judged = tree.select("host", "shape", "template").join(
        judge_templates(tree, weight, z), ["host", "template"]
    )
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("purity") >= limit, "block").otherwise("allow")
    return pages.join(judged, ["host", "shape"]).select(
        key,
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, learned).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"),
        "purity",
    )


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) of pages whose path ends in the number of a labelled document."""
    _, path = split_url(F.col("url"))
    number = F.regexp_extract(path, r"([0-9]{1,18})[^/0-9]*/?$", 1)
    numbered = columns(pages, ["page_id", "url"]).select(
        "page_id", F.nullif(number, F.lit("")).cast("bigint").alias("doc_id")
    )
    known = columns(labels, ["doc_id", "quality"]).dropna()
    return numbered.join(known, "doc_id").select(
        "page_id", (1 - F.col("quality")).cast("int").alias("bad")
    )
