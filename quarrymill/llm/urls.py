"""URL filters: rules first, then a tree of path templates per host, judged by smoothed labelled purity.

Every page's path is cut into segments. A segment becomes a wildcard of its form (number, hex, date, long slug) where its
characters say that it varies, or where a branch has many different values with few pages each. The templates of a host form
a tree (host, then one node for each further segment). Branches of one parent, at any level, with the same remaining shape
and labelled shares that a test of two proportions doesn't tell apart are merged. Each node's purity (the labelled share to block) is smoothed towards its parent's, from all
hosts down over domain suffixes, host and path nodes, and templates whose purity reaches the limit are rejected. Suffixes
only smooth: a template is rejected only where its host or one of its branches has labels of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: (host suffix, path prefix, verdict). Fixed values.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Pseudo-count of the parent's purity; purity at which a template is rejected.
SMOOTHING, LIMIT = 2.0, 0.5
#: A branch with at least so many values of which each has few pages on average is variable.
MANY_VALUES, FEW_PAGES = 20, 4.0
#: Labels of a branch that may be merged, and standard deviations within which two shares aren't told apart.
LEAST, APART = 5, 1.96


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.when(url.contains("://"), common.ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.when(url.contains("://"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (host and path together; ties: as listed) that fits, and its verdict; null where none does."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [(F.lit("." + h), p, v, h) for h, p, v in ordered]
    dotted = F.concat(F.lit("."), host)
    name = reduce(lambda c, r: c.when(dotted.endswith(r[0]) & path.startswith(r[1]), r[3] + r[1]), fits, F)
    verdict = reduce(lambda c, r: c.when(dotted.endswith(r[0]) & path.startswith(r[1]), r[2]), fits, F)
    return name.otherwise(F.lit(None).cast("string")), verdict.otherwise(F.lit(None).cast("string"))


def generalised(segment: Column) -> Column:
    """A segment's form where its characters show that it varies, with a file ending kept; else the segment itself."""
    ending = F.regexp_extract(segment, r"\.[A-Za-z0-9]{1,5}$", 0)
    stem = F.regexp_replace(segment, r"\.[A-Za-z0-9]{1,5}$", "")
    form = (
        F.when(stem.rlike(r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"), "{date}")
        .when(stem.rlike(r"^[0-9]+$"), "{n}")
        .when(stem.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "{hex}")
        .when(stem.rlike(r"^(?=.*[0-9])[A-Za-z0-9_-]{12,}$"), "{id}")
        .when(F.length(stem) > 40, "{slug}")
    )
    return F.when(form.isNull(), segment).otherwise(F.concat(form, ending))


def prefix_keys(host: Column, segments: Column) -> Column:
    """A hash of the host and of each prefix of the segments, none to all: one more element than segments."""
    start = F.array(F.xxhash64(F.lit("/"), host))
    return F.aggregate(segments, start, lambda acc, s: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), s))))


def variable_values(steps: DataFrame) -> DataFrame:
    """Branches whose literal values vary (many values, few pages each): prefix, and paths that go through them."""
    values = steps.groupBy("prefix", "segment").agg(F.sum("pages").alias("n"), F.count(F.lit(1)).alias("paths"))
    spread = values.groupBy("prefix").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("pages"), F.sum("paths").alias("paths"))
    varying = (F.col("values") >= MANY_VALUES) & (F.col("pages") < F.col("values") * FEW_PAGES)
    return spread.where(varying).select("prefix", "paths")


def with_wildcards(paths: DataFrame) -> DataFrame:
    """Adds template: a path's segments, those below a varying branch as *, at any depth. paths: path, host, segments, pages."""
    keys = prefix_keys(F.col("host"), F.col("segments"))
    # A row for each segment carries hashes and the path's number, not the path.
    steps = F.transform("segments", lambda s, i: F.struct(i.alias("depth"), s.alias("segment"), F.get("keys", i).alias("prefix")))
    steps = paths.withColumn("keys", keys).select("path", "pages", F.inline(steps))
    varying = common.materialise(variable_values(steps))
    stars = common.join_groups(steps, varying, "prefix", "paths").groupBy("path").agg(F.collect_set("depth").alias("stars"))
    out = paths.join(stars, "path", "left")
    starred = F.transform("segments", lambda s, i: F.when(F.array_contains("stars", i), F.lit("*")).otherwise(s))
    return out.withColumn("template", F.when(F.col("stars").isNull(), F.col("segments")).otherwise(starred)).drop("stars")


def host_level(host: Column) -> Column:
    """Place of the host's own node among the nodes of a page."""
    return F.least(F.size(F.split(host, r"\.")), F.lit(3)) + 1


def nodes_of(host: Column, segments: Column) -> Column:
    """The keys of a page's nodes from the root down: all hosts, domain suffixes, the host, one for each segment."""
    labels = F.slice(F.reverse(F.split(host, r"\.")), 1, 3)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
        lambda i: F.xxhash64(F.lit("."), F.array_join(F.reverse(F.slice(labels, 1, i)), ".")),
    )
    return F.concat(F.array(F.lit(0).cast("long")), suffixes, prefix_keys(host, segments))


def purities(paths: DataFrame) -> DataFrame:
    """Smoothed purity of every template that has labelled nodes: host, template, purity, own. paths: n labelled, bad of them.

    own: whether the host or a branch of the template is labelled, and not only what lies above the host.
    A node's purity is smoothed towards its parent's, the root's towards a half. Labelled pages label all their nodes, so the
    labelled nodes of a template are the first ones of its path: its purity follows from their counts in order.
    """
    templates = paths.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    templates = common.materialise(templates.withColumn("t", F.monotonically_increasing_id()))
    # A row for each node carries its template's number, not the template.
    nodes = nodes_of(F.col("host"), F.col("template"))
    placed = templates.withColumn("nodes", nodes).select("t", "n", "bad", F.posexplode("nodes").alias("level", "node"))
    counted = placed.where("n > 0").groupBy("node", "level").agg(F.sum("n").alias("_n"), F.sum("bad").alias("_bad"))
    # A node has as many rows as templates below it: the root has all, so the few such nodes are broadcast.
    counted = counted.join(placed.groupBy("node", "level").agg(F.count(F.lit(1)).alias("templates")), ["node", "level"])
    met = common.join_groups(placed.drop("level"), common.materialise(counted), "node", "templates")
    met = met.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("level", "_n", "_bad"))).alias("met"))
    fold = lambda above, x: (x["_bad"] + above * SMOOTHING) / (x["_n"] + SMOOTHING)
    own = F.element_at("met", -1)["level"] >= host_level(F.col("host"))
    return templates.select("t", "host", "template").join(met, "t").select("host", "template", F.aggregate("met", F.lit(0.5), fold).alias("purity"), own.alias("own"))


def judged(
    pages: DataFrame, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", rules=RULES
) -> DataFrame:
    """One row per input row: id, host, path, rule, template, purity, verdict.

    labels: (id, bad 0 or 1) of some pages; without it the pages that a rule judges are the labelled ones. A url that is
    null or has no :// has an empty host and path; all such pages are one host. Where nothing is labelled the purity is a
    half of the limit. Where neither the host nor a branch of the template is labelled, the verdict is allow. Repeated rows
    count as often as they stand; repeated labels of an id count as one, the stricter. An empty table gives no rows.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    literal = F.filter(F.split("path", "/"), lambda s: s != "")
    tail = F.when(F.col("path").endswith("/") & (F.length("path") > 1), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"rule": name, "ruled": verdict})
    rows = rows.withColumn("segments", F.concat(F.transform(literal, generalised), tail))
    if labels is None:
        rows = rows.withColumn("bad", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    else:
        known = labels.where("bad in (0, 1)").groupBy("id").agg(F.max("bad").alias("bad"))
        rows = rows.join(known, "id", "left")
    rows = common.materialise(rows.withColumn("_key", F.concat(F.array("host"), F.col("segments"))))
    # All that follows goes by path, not by page: one row for a path however many pages it has.
    paths = rows.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.sum("bad").alias("bad"))
    paths = common.materialise(paths.withColumn("path", F.monotonically_increasing_id()))
    paths = merged(common.materialise(with_wildcards(paths)))
    paths = common.materialise(paths)
    # The deepest labelled node of a template judges it.
    found = paths.join(purities(paths), ["host", "template"], "left")
    shape = F.concat(F.lit("/"), F.array_join("template", "/")).alias("template")
    purity = F.coalesce("purity", F.lit(LIMIT / 2)).alias("purity")
    method = F.when(F.col("own") & (F.col("purity") >= LIMIT), "block").otherwise("allow").alias("method")
    found = found.select(F.concat(F.array("host"), F.col("segments")).alias("_key"), shape, purity, method, "pages")
    out = common.join_groups(rows, common.materialise(found), "_key", "pages")
    return out.select("id", "host", "path", "rule", "template", "purity", F.coalesce("ruled", "method").alias("verdict"))


def suffix_keys(segments: Column) -> Column:
    """A hash of what follows each segment."""
    back = F.aggregate(F.reverse(segments), F.array(F.lit(0).cast("long")), lambda acc, s: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), s))))
    return F.slice(F.reverse(back), F.lit(2), F.size(segments))


def similar(bad: Column, n: Column, bad_before: Column, n_before: Column) -> Column:
    """Two proportions that the labels don't tell apart: the pooled test of their difference."""
    share = (bad + bad_before) / (n + n_before)
    off = bad / n - bad_before / n_before
    return off * off <= APART * APART * share * (1 - share) * (1 / n + 1 / n_before)


def merged(paths: DataFrame) -> DataFrame:
    """Literal branches of one parent, at any level, with the same shapes below them and similar labels become a wildcard.

    A branch takes part if it has LEAST labels. Branches of one parent and shape stand by their share of bad labels; each
    joins the one before unless a test of the two proportions tells them apart. All levels are judged at once, by the
    templates as they come in; a row for each segment carries hashes of what is above and below it.
    """
    above = prefix_keys(F.col("host"), F.col("template"))
    inner = F.transform(
        "template", lambda s, i: F.struct(i.alias("depth"), s.alias("branch"), F.get("_above", i).alias("parent"), F.get("_below", i).alias("shape"))
    )
    literal = F.filter(inner, lambda x: ~x["branch"].startswith("{") & ~x["branch"].isin("*", ""))
    steps = paths.withColumns({"_above": above, "_below": suffix_keys(F.col("template"))}).select("path", "n", "bad", F.inline(literal))
    steps = steps.withColumn("key", F.struct("parent", "branch"))
    shapes = steps.where("n > 0").groupBy("key", "shape").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # A branch's set of shapes as a count and a sum of hashes: bounded whatever the branch holds.
    branches = shapes.groupBy("key").agg(
        F.count(F.lit(1)).alias("shapes"), F.sum(F.col("shape").cast("decimal(38,0)")).alias("signature"), F.sum("n").alias("n"), F.sum("bad").alias("bad")
    )
    branches = branches.where(F.col("n") >= LEAST)
    alike = [F.col("key.parent"), "shapes", "signature"]
    by_share = W.partitionBy(*alike).orderBy(F.col("bad") / F.col("n"), "key.branch")
    before = [F.lag(x).over(by_share) for x in ("bad", "n")]
    branches = branches.withColumn("_joins", F.coalesce(similar(F.col("bad"), F.col("n"), *before), F.lit(False)))
    branches = branches.withColumn("_group", F.sum((~F.col("_joins")).cast("int")).over(by_share))
    group = W.partitionBy(*alike, "_group")
    branches = branches.withColumns({"_size": F.count(F.lit(1)).over(group), "low": F.min("key.branch").over(group), "high": F.max("key.branch").over(group)})
    names = branches.where("_size > 1").select("key", F.concat(F.lit("{"), "low", F.lit(".."), "high", F.lit("}")).alias("name"))
    # How many paths go through a renamed branch: a hot one's rows are joined by broadcast.
    sizes = steps.groupBy("key").agg(F.count(F.lit(1)).alias("paths"))
    named = common.join_groups(steps.select("path", "depth", "key"), common.materialise(names.join(sizes, "key")), "key", "paths")
    names_of = named.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("depth", "name"))).alias("_names"))
    out = paths.join(names_of, "path", "left")
    renamed = F.transform("template", lambda s, i: F.coalesce(F.try_element_at("_names", i), s))
    return out.withColumn("template", F.when(F.col("_names").isNull(), F.col("template")).otherwise(renamed)).drop("_names")


#: A page whose visible text has this share of words with doubled symbols is bad; with at most the other share, and so many
#: words at least, good. Fixed values.
JUNK, CLEAN, WORDS = 0.3, 0.1, 50


def visible(html: Column) -> Column:
    """The text outside of tags, scripts and styles. One pass: what follows <script or <style goes up to its end tag."""
    parts = F.split(html, r"(?i)<(?=(?:script|style)\b)")
    shown = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.get(F.split(p, r"(?i)</(?=(?:script|style)\b)", 2), F.lit(1))))
    text = F.array_join(F.transform(shown, lambda p: F.coalesce(F.when(p.rlike(r"(?i)^(?:script|style)\b"), F.concat(F.lit("<"), p)).otherwise(p), F.lit(""))), " ")
    return F.regexp_replace(text, r"<[^>]*+>?+", " ")


def page_signal(html: Column) -> Column:
    """1 where a page's visible text is junk, 0 where it is clean and long enough, else null."""
    text = F.array(visible(F.coalesce(html, F.lit(""))))
    junk = r"(?:[#*%$~|^{}=]|&[a-z]{2,8}+;){2,}+"
    # Through arrays of one element, so that the text and its counts are taken once.
    counts = F.transform(text, lambda t: F.struct(F.regexp_count(t, F.lit(r"\S++")).alias("n"), F.regexp_count(t, F.lit(junk)).alias("junk")))
    signal = lambda c: F.when(c["junk"] >= F.greatest(c["n"], F.lit(1)) * JUNK, 1).when((c["n"] >= WORDS) & (c["junk"] <= c["n"] * CLEAN), 0)
    return F.get(F.transform(counts, signal), F.lit(0))


def text_labels(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, bad): 1 where a page's visible text is junk, 0 where it is clean and long enough; no row for other pages.

    Labels come from what a page shows, on every host and path; neither urls nor rules are looked at.
    """
    labels = pages.select(F.col(id_col).alias("id"), page_signal(F.col(html_col)).alias("bad"))
    # Written before it is filtered: a filter would take the text a second time.
    return common.materialise(labels).where("bad is not null")


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = judged(pages, text_labels(pages))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "template", "purity")
