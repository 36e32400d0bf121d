"""URL filters: rules first, then a path-template tree for what no rule decides.

Per host the paths form a tree of segments.

*Generalising.*  A segment made of digits, hexadecimal digits or a date is a typed wildcard.  A node
with many, thinly filled literal children turns them into one wildcard, from the root down, so that
what lies below a wildcard is looked at together: /u/<name>/<slug> has two.  Each round turns the
shallowest such node of every template; the rounds end when no node is left, so their number is that
of wildcards nested in a path, whatever the paths' length.

*Merging.*  Each node carries the labels of all pages below it.  A branch stands apart if its share
of bad ones among its labelled pages differs from that of its siblings by more than chance allows (a
two-proportion test); a branch without labels, or whose siblings have none, can't differ.  A template
belongs to the deepest branch above it that stands apart, or to its host: similar branches of all
levels are one group.

*Rejecting.*  A group is rejected if its share of bad pages among its labelled ones, smoothed with
the whole table's, reaches ``PURITY``; groups with under ``LEAST_LABELS`` labels are kept.  So pages
without any label share the verdict of similar branches of their host.

Labels are the verdicts of the rules themselves (block: bad), with any given ones in ``labelled``.

Pages are counted by (host, typed path) with partial sums before anything is joined, so one host with
a third of all pages only adds to counters; a typed path with very many pages is split in the last
join.  Nodes are named by (host, depth, a 64-bit hash of the segments above).

A null url or one without ``://`` has an empty host and path, fits no rule and is judged like any
other template; repeated rows are judged alike; paths of any number of segments are read whole; extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import let, skewed_join, written

#: A node generalises its literal children from so many on, if they have fewer pages each than the second number.
FAN, THIN = 20, 4.0
#: Two shares differ beyond this many standard errors.
Z = 2.58
LEAST_LABELS, STRENGTH, PURITY = 5, 4.0, 0.9


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    host = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; ``rules`` are (verdict, "host/path")."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, prefix = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + prefix)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def typed(segment: Column) -> Column:
    """Segments that are plainly variable, as typed wildcards; a file name keeps its extension."""
    stem, ext = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2)
    kind = (
        F.when(stem.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "{date}")
        .when(stem.rlike(r"^[0-9]+$"), "{n}")
        .when(stem.rlike(r"^(?=.*[0-9])[0-9A-Fa-f]{8,}$|^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"), "{x}")
    )
    return F.when(kind.isNotNull(), F.concat(kind, ext)).otherwise(segment)


def typed_path(path: Column) -> Column:
    """The path's segments with typed wildcards, as one string."""
    return F.array_join(F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", -1), typed), "/")


def literal(segment: Column) -> Column:
    return ~segment.startswith("{") & ~segment.isin("*", "")


def prefixes(segments: Column) -> Column:
    """A hash of the first d segments for each d from 0 to all, each from the one before, so that a
    segment is read once however deep the path."""
    start = F.array(F.lit(42).cast("long"))
    return F.aggregate(segments, start, lambda seen, s: F.concat(seen, F.array(F.xxhash64(F.element_at(seen, -1), s))))


def generalised(paths: DataFrame) -> DataFrame:
    """Adds template (array of segments) to (host, typed, n, ...), one row each."""
    now = paths.withColumn("template", F.split("typed", "/", -1))
    while True:
        now = written(now, "templates")
        own = let(prefixes(F.col("template")), lambda p: F.transform("template", lambda s, i: F.struct(i.alias("level"), F.get(p, i).alias("above"), s.alias("seg"))))
        steps = now.select("host", "typed", "n", F.explode(own).alias("s")).select("host", "typed", "n", "s.*").where(literal(F.col("seg")))
        children = steps.groupBy("host", "level", "above", "seg").agg(F.sum("n").alias("own"))
        nodes = children.groupBy("host", "level", "above").agg(F.count("*").alias("children"), F.sum("own").alias("pages"))
        fans = nodes.where((F.col("children") >= FAN) & (F.col("pages") < THIN * F.col("children"))).select("host", "level", "above")
        first = steps.join(fans, ["host", "level", "above"], "left_semi").groupBy("host", "typed").agg(F.min("level").alias("turn"))
        first = written(first, "fans")
        if first.isEmpty():
            return now
        now = now.join(first, ["host", "typed"], "left")
        star = F.transform("template", lambda x, i: F.when(i == F.col("turn"), "*").otherwise(x))
        now = now.withColumn("template", F.when(F.col("turn").isNull(), F.col("template")).otherwise(star)).drop("turn")


def branches(leaves: DataFrame) -> DataFrame:
    """Adds depth and node of the group that each of the leaves (host, template, labels, bads) belongs to."""
    own = let(prefixes(F.col("template")), lambda p: F.transform(p, lambda x, i: F.struct(i.alias("depth"), x.alias("node"), F.get(p, i - 1).alias("above"))))
    chain = leaves.select("host", "leaf", "labels", "bads", F.explode(own).alias("s")).select("host", "leaf", "labels", "bads", "s.*")
    nodes = chain.groupBy("host", "depth", "node").agg(F.first("above").alias("above"), F.sum("labels").alias("labels"), F.sum("bads").alias("bads"))
    over = nodes.select("host", (F.col("depth") + 1).alias("depth"), F.col("node").alias("above"), F.col("labels").alias("all_labels"), F.col("bads").alias("all_bads"))
    both = nodes.join(over, ["host", "depth", "above"])
    rest, rest_bad = F.col("all_labels") - F.col("labels"), F.col("all_bads") - F.col("bads")
    share = F.try_divide(F.col("all_bads"), F.col("all_labels"))
    error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1), F.col("labels")) + F.try_divide(F.lit(1), rest)))
    apart = both.where(F.abs(F.try_divide("bads", "labels") - F.try_divide(rest_bad, rest)) > Z * error).select("host", "depth", "node")
    own = chain.join(apart, ["host", "depth", "node"], "left_semi").groupBy("host", "leaf").agg(F.max(F.struct("depth", "node")).alias("group"))
    return leaves.join(own, ["host", "leaf"], "left").withColumn("group", F.coalesce("group", F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("node"))))


def rejected_paths(urls: DataFrame) -> DataFrame:
    """(host, typed) of rejected groups; ``urls`` has host, typed and bad (true, false, null)."""
    label = [F.count("bad").alias("labels"), F.count_if("bad").alias("bads")]
    paths = generalised(urls.groupBy("host", "typed").agg(F.count("*").alias("n"), *label)).withColumn("leaf", F.array_join("template", "/"))
    leaves = written(paths.groupBy("host", "leaf").agg(F.first("template").alias("template"), *[F.sum(c).alias(c) for c in ("labels", "bads")]), "leaves")
    grouped = branches(leaves)
    merged = grouped.groupBy("host", "group").agg(F.sum("labels").alias("labels"), F.sum("bads").alias("bads"))
    totals = leaves.agg(F.sum("labels"), F.sum("bads")).first()
    prior = totals[1] / totals[0] if totals[0] else 0.0
    purity = (F.col("bads") + prior * STRENGTH) / (F.col("labels") + STRENGTH)
    bad = merged.where((F.col("labels") >= LEAST_LABELS) & (purity >= PURITY)).select("host", "group")
    leaf = grouped.join(bad, ["host", "group"], "left_semi").select("host", "leaf")
    return written(paths.join(leaf, ["host", "leaf"], "left_semi").select("host", "typed"), "rejected")


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule (null: none fits), verdict.

    ``labelled`` may add (page_id, bad boolean) for pages that no rule decides.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", rule).withColumn("own", verdict).withColumn("typed", typed_path(F.col("path")))
    marked = urls.withColumn("bad", F.col("own") == "block")
    if labelled is not None:
        given = labelled.groupBy("page_id").agg(F.max("bad").alias("given"))
        marked = marked.join(given, "page_id", "left").withColumn("bad", F.coalesce("bad", "given"))
    bad = rejected_paths(marked.select("host", "typed", "bad")).withColumn("rejected", F.lit(True))
    out = skewed_join(urls, bad, ["host", "typed"], "left", F.xxhash64("page_id"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("rejected"), "block"), F.lit("allow")).alias("verdict"))


#: The same for the rules of the registered query, without given labels: the tree is walked level by
#: level, from the root down.
TEMPLATES_SQL = r"""
WITH RECURSIVE rests AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM urls),
judged AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS own,
         list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s:
           CASE WHEN regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}(\.[A-Za-z]{1,5})?$') THEN '{date}' || regexp_extract(s, '(\.[A-Za-z]{1,5})?$')
                WHEN regexp_matches(s, '^[0-9]+(\.[A-Za-z]{1,5})?$') THEN '{n}' || regexp_extract(s, '(\.[A-Za-z]{1,5})?$')
                WHEN regexp_matches(s, '^([0-9A-Fa-f]{8,}|[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12})(\.[A-Za-z]{1,5})?$') AND regexp_matches(s, '^[0-9A-Fa-f]*[0-9]|-') THEN '{x}' || regexp_extract(s, '(\.[A-Za-z]{1,5})?$')
                ELSE s END) AS segs FROM ruled),
pages_of AS (
  SELECT host, segs, count(*) AS n, count(own) AS labels, count(*) FILTER (own = 'block') AS bads FROM judged GROUP BY host, segs),
walk AS (
  SELECT host, segs, n, labels, bads, 0 AS d, []::VARCHAR[] AS t FROM pages_of
  UNION ALL
  SELECT host, segs, n, labels, bads, d + 1, list_append(t, CASE WHEN fixed OR kids < 20 OR held >= 4.0 * kids THEN s ELSE '*' END)
  FROM (SELECT *, count(DISTINCT CASE WHEN NOT fixed THEN s END) OVER (PARTITION BY host, t) AS kids,
               sum(CASE WHEN fixed THEN 0 ELSE n END) OVER (PARTITION BY host, t) AS held
        FROM (SELECT *, segs[d + 1] AS s, starts_with(segs[d + 1], '{') OR segs[d + 1] IN ('*', '') AS fixed FROM walk WHERE d < len(segs)))),
named AS (
  SELECT host, segs, n, labels, bads, t FROM walk WHERE d = len(segs)),
above AS (
  SELECT host, t, t[1:d] AS node, d, sum(labels) AS labels, sum(bads) AS bads FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM named) GROUP BY ALL),
nodes AS (
  SELECT host, d, node, sum(labels) AS l, sum(bads) AS b FROM above GROUP BY ALL),
tested AS (
  SELECT c.host, c.d, c.node, c.b / c.l AS own_share, (p.b - c.b) / (p.l - c.l) AS other_share, p.b / p.l AS share, c.l, p.l - c.l AS rest
  FROM nodes c JOIN nodes p ON p.host = c.host AND p.d = c.d - 1 AND p.node = c.node[1:c.d - 1] WHERE c.l > 0 AND p.l > c.l),
standing AS (
  SELECT host, d, node FROM tested WHERE abs(own_share - other_share) > 2.58 * sqrt(share * (1 - share) * (1 / l + 1 / rest))),
grouped AS (
  SELECT n.host, n.t, coalesce(max(s.d), 0) AS d FROM (SELECT DISTINCT host, t FROM named) n
  LEFT JOIN standing s ON s.host = n.host AND s.d <= len(n.t) AND s.node = n.t[1:s.d] GROUP BY ALL),
sums AS (
  SELECT host, t[1:d] AS node, sum(labels) AS labels, sum(bads) AS bads FROM named JOIN grouped USING (host, t) GROUP BY ALL),
rejected AS (
  SELECT host, node FROM sums
  WHERE labels >= 5 AND (bads + 4.0 * (SELECT sum(bads) / sum(labels) FROM sums)) / (labels + 4.0) >= 0.9)
SELECT page_id, j.host, path, rule, coalesce(own, CASE WHEN r.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM judged j JOIN named n ON n.host = j.host AND n.segs = j.segs JOIN grouped g ON g.host = n.host AND g.t = n.t
LEFT JOIN rejected r ON r.host = g.host AND r.node = g.t[1:g.d]
"""
