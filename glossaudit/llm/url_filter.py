"""URL filters: rules by host and path, and for all other urls a tree of path templates per host.

The urls that a rule fits are the labelled ones. Each host has a tree of path prefixes, grown from the root as long as
a node holds both labels. Below a node, numbers are one branch and rare or unlabelled segments one wildcard; the other
segments are ordered by their share of blocked urls, and neighbours whose labels do not differ beyond chance are merged
into one branch, or into the wildcard. Merged branches share what grows below them. A template's purity is its share of
blocked urls, smoothed towards the purity of the template above it, then of the host, the site and all urls. All steps
are joins and sums over counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaudit.llm.stages import Stages
from glossaudit.storage import broadcast_if_small

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SUPPORT = 0.02  # least share of a node's urls for a branch of its own, so a node compares at most 50
LEAST = 5  # and least number of urls
Z = 2.58  # labels of two branches differ beyond chance from here
STRENGTH = 4.0  # so many urls' worth of the purity above count in each template
REJECT = 0.7

NUMBER, ANY = "<n>", "*"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits; both null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # longer ones go outside
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    """Segments as the tree names them: numbers as one, and signs that the names of branches use as they are in urls."""
    for sign, code in (("*", "%2A"), ("|", "%7C"), ("<", "%3C")):
        path = F.replace(path, F.lit(sign), F.lit(code))
    parts = F.array_remove(F.split(path, "/"), "")
    return F.transform(parts, lambda s: F.when(s.rlike(r"^[0-9]+(\.[a-z]{1,5})?$"), F.lit(NUMBER)).otherwise(s))


def _alike(b1: Column, k1: Column, b2: Column, k2: Column) -> Column:
    """Whether b1 of k1 and b2 of k2 differ by no more than chance."""
    pooled = (b1 + b2 + 1) / (k1 + k2 + 2)
    return F.abs(b1 / k1 - b2 / k2) <= Z * F.sqrt(pooled * (1 - pooled) * (1 / k1 + 1 / k2))


def _merged(entries: Column) -> Column:
    """Groups (names, b, k) of entries (share, segment, b, k), which are sorted: neighbours that are alike are one."""
    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        grown = F.struct(F.concat(last.names, F.array(x.segment)).alias("names"), (last.b + x.b).alias("b"), (last.k + x.k).alias("k"))
        new = F.struct(F.array(x.segment).alias("names"), x.b.alias("b"), x.k.alias("k"))
        return F.when((F.size(done) > 0) & _alike(last.b, last.k, x.b, x.k), F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(new)))

    return F.aggregate(entries, F.array().cast("array<struct<names:array<string>,b:bigint,k:bigint>>"), add)


def _branches(children: DataFrame, mixed: DataFrame) -> DataFrame:
    """(node, segment, branch) for segments that do not fall to a wildcard, at most 1 / SUPPORT for each node."""
    frequent = children.where((F.col("segment") != NUMBER) & (F.col("n") >= LEAST) & (F.col("k") > 0)).join(
        broadcast_if_small(mixed, 48), "node").where(F.col("n") >= SUPPORT * F.col("all_n"))
    found = frequent.groupBy("node", "word_b", "word_k").agg(
        F.collect_list(F.struct((F.col("b") / F.col("k")).alias("share"), "segment", "b", "k")).alias("own"),
        F.sum("b").alias("own_b"), F.sum("k").alias("own_k"))
    rest_b, rest_k = F.col("word_b") - F.col("own_b"), F.col("word_k") - F.col("own_k")
    rest = F.struct((rest_b / F.nullif(rest_k, F.lit(0))).alias("share"), F.lit(ANY).alias("segment"), rest_b.alias("b"), rest_k.alias("k"))
    entries = F.when(rest_k > 0, F.concat("own", F.array(rest))).otherwise(F.col("own"))
    groups = found.select("node", _merged(F.array_sort(entries)).alias("groups")).where(F.size("groups") > 1)
    named = groups.select("node", F.explode("groups").alias("group")).select("node", F.col("group.names").alias("names"))
    named = named.where(~F.array_contains("names", ANY))
    return named.select("node", F.array_join(F.array_sort("names"), "|").alias("branch"), F.explode("names").alias("segment"))


def _templates(paths: DataFrame, stages: Stages) -> DataFrame:
    """(host, path, n, blocked, known, template): one round for each level that has a node with both labels."""
    walk = paths.select("*", F.xxhash64("host").alias("node"), F.array().cast("array<string>").alias("template"))
    while True:
        # The template is as long as the levels walked; a path that ended, or whose node has one label only, has no node.
        step = walk.withColumn("segment", F.get("segments", F.size("template")))
        children = stages.keep(step.where("node IS NOT NULL").groupBy("node", "segment").agg(
            F.sum("n").alias("n"), F.sum("blocked").alias("b"), F.sum("known").alias("k")), "children")
        word = lambda c: F.sum(F.when(F.col("segment") != NUMBER, F.col(c)).otherwise(0))
        mixed = children.groupBy("node").agg(
            F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.sum("k").alias("all_k"),
            word("b").alias("word_b"), word("k").alias("word_k")).where("all_b > 0 AND all_b < all_k")
        mixed = stages.keep(mixed.select("node", "all_n", "word_b", "word_k"), "mixed")
        if mixed.isEmpty():
            break
        branches = stages.keep(_branches(children, mixed), "branches")
        grows = mixed.select("node", F.lit(True).alias("grows"))
        step = step.join(broadcast_if_small(grows, 32), "node", "left").join(
            broadcast_if_small(branches, 200), ["node", "segment"], "left")
        branch = F.when(F.col("grows") & F.col("segment").isNotNull(), F.coalesce("branch", _wildcard(F.col("segment"))))
        walk = stages.keep(step.select(
            "host", "path", "n", "blocked", "known", "segments", F.when(branch.isNotNull(), F.xxhash64("node", branch)).alias("node"),
            F.when(branch.isNotNull(), F.concat("template", F.array(branch))).otherwise(F.col("template")).alias("template")), "walk")
    rest = F.slice("segments", F.size("template") + 1, F.size("segments"))
    return walk.select("host", "path", "n", "blocked", "known", F.concat("template", F.transform(rest, _wildcard)).alias("template"))


def _wildcard(segment: Column) -> Column:
    return F.when(segment == NUMBER, F.lit(NUMBER)).otherwise(F.lit(ANY))


def _site(host: Column) -> Column:
    return F.regexp_extract(host, r"[^.]*\.?[^.]*$", 0)


def _smoothed(blocked: Column, known: Column, above: Column) -> Column:
    return (blocked + STRENGTH * above) / (known + STRENGTH)


def _purities(templates: DataFrame, stages: Stages) -> DataFrame:
    """(host, template, purity) from the counts of each template."""
    def keys(template: Column) -> Column:
        return F.aggregate(template, F.array().cast("array<long>"), lambda done, s: F.concat(
            done, F.array(F.xxhash64(F.col("host"), F.get(done, F.size(done) - 1), s))))

    total = templates.agg(F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.coalesce(F.sum("known"), F.lit(0)).alias("k")).first()
    hosts = templates.groupBy("host").agg(F.sum("blocked").alias("hb"), F.sum("known").alias("hk"))
    hosts = hosts.withColumn("site", _site(F.col("host")))
    sites = hosts.groupBy("site").agg(F.sum("hb").alias("sb"), F.sum("hk").alias("sk"))
    of_site = _smoothed(F.col("sb"), F.col("sk"), F.lit((total["b"] + 1) / (total["k"] + 2)))
    hosts = hosts.join(sites, "site").select(
        "host", _smoothed(F.col("hb"), F.col("hk"), of_site).alias("host_purity"))
    steps = templates.select("host", "template", F.posexplode(keys(F.col("template"))).alias("depth", "key"), "blocked", "known")
    steps = stages.keep(steps, "steps")
    nodes = stages.keep(steps.groupBy("key").agg(F.sum("blocked").alias("nb"), F.sum("known").alias("nk")), "nodes")
    chains = steps.join(nodes, "key").groupBy("host", "template").agg(
        F.sort_array(F.collect_list(F.struct("depth", "nb", "nk"))).alias("chain"))  # as long as the template
    purity = F.aggregate(F.coalesce("chain", F.array().cast("array<struct<depth:int,nb:bigint,nk:bigint>>")),
                         F.col("host_purity"), lambda above, x: _smoothed(x.nb, x.nk, above))
    return templates.select("host", "template").join(chains, ["host", "template"], "left").join(hosts, "host").select(
        "host", "template", purity.alias("purity"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, template, purity.

    Reads page_id and url, whatever else there is. A null url or one without ``://`` has an empty host and path and no
    rule; its verdict is that of the empty template. Repeated urls count as often as they come and are judged alike.
    Without any labelled url each purity is 1/2 and all urls are allowed. An empty table gives no rows. Deep paths cost
    no more levels than there are nodes with both labels. Runs its steps when called.
    """
    stages = Stages(pages.sparkSession, "url-filter")
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    split = stages.keep(split.withColumns({"rule": rule, "said": said}), "urls")
    paths = split.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("said") == "block", 1).otherwise(0)).alias("blocked"),
        F.count("said").alias("known"))
    paths = stages.keep(paths.withColumn("segments", _segments(F.col("path"))), "paths")
    named = stages.keep(_templates(paths, stages), "named")
    templates = named.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("known").alias("known"))
    purities = _purities(stages.keep(templates, "templates"), stages)
    judged = stages.keep(named.join(purities, ["host", "template"]).select(
        "host", "path", F.concat("host", F.lit("/"), F.array_join("template", "/")).alias("template"), "purity"), "judged")
    verdict = F.coalesce("said", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return split.join(judged, ["host", "path"]).select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))
