"""URL filter by a tree of path templates per host (DataFrame functions).

The tree is grown level by level on (host, path segments, counts), not on pages: pages with the same
segments, after digit runs and long hexadecimal runs became ``<n>`` and ``<x>``, are one row.

* *Wildcards.* Under a parent with more than ``max_children`` different segments, a segment that holds
  less than ``min_share`` of the parent's pages is variable and becomes ``*``.
* *Merging.* At every level literal siblings are joined if a chi-square test finds no difference between the
  distributions of their pages over the templates below them, these overlap by half, and a two-proportion z-test finds
  no difference between their blocked shares. A sibling without labels has no such share and is judged by
  its subtree alone. One of fewer than ``min_labels`` pages is too small to be compared.
* *Purity.* Pages that a rule judges are the labels. A template is rejected if it has ``min_labels`` and
  ``(blocked + (strength + lacking) * prior) / (pages + strength)`` reaches ``min_purity``; ``lacking`` are its pages without
  a label, the prior is the blocked share of all labels. A template without labels is allowed.

A rule's verdict always wins for the pages it fits.

Scale: a hot host is many (host, prefix, segment) groups, all aggregated before the shuffle; the
verdicts are joined back by (host, segments), an equi-join whose hot keys adaptive execution splits. The tree grows
as deep as two paths of a host still share a template; below that every branch is a single path, which neither
becomes a wildcard nor has siblings, so a lone path of any length costs no level.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule that needs either, and
is judged as a template of the empty host; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

Rule = tuple[str, str]  # verdict, host/path

#: The rules of the query.
RULES: tuple[Rule, ...] = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
                           ("block", "net/es/"), ("block", "net/fr/"))


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. ``rules`` is a short list of literals."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def segments_of(path: Column) -> Column:
    shaped = F.regexp_replace(F.regexp_replace(path, r"[0-9a-fA-F]{16,}", "<x>"), r"[0-9]+", "<n>")
    return F.split(F.regexp_replace(shaped, "^/", ""), "/", -1)


def _from(segments: str, d: int) -> Column:
    """The segments from level ``d`` on, as an array that may be empty."""
    return F.slice(F.col(segments), d + 1, F.greatest(F.size(segments) - d, F.lit(0)))


def _branches(tree: DataFrame, prefix: str, segments: str, d: int) -> bool:
    """Whether two different paths that go on at level ``d`` share their prefix."""
    deeper = tree.filter(F.size(segments) > d).groupBy("host", prefix)
    return not deeper.agg((F.min(segments) < F.max(segments)).alias("two")).filter("two").isEmpty()


def template_tree(shapes: DataFrame, max_children: int, min_share: float) -> DataFrame:
    """``shapes`` (host, segs, n, n_label, n_block) with ``t`` (array, the segments with wildcards)."""
    tree, d = shapes.withColumn("t", F.array().cast("array<string>")), 0
    while _branches(tree, "t", "segs", d):
        seg = F.get("segs", F.lit(d))
        here = tree.filter(seg.isNotNull())
        child = here.groupBy("host", "t", seg.alias("s")).agg(F.sum("n").alias("c"))
        parent = child.groupBy(F.col("host").alias("p_host"), F.col("t").alias("p_t")).agg(
            F.count("*").alias("kinds"), F.sum("c").alias("all"))
        # only rare segments under wide parents
        rare = (child.join(parent, (F.col("host") == F.col("p_host")) & (F.col("t") == F.col("p_t")))
                .filter((F.col("kinds") > max_children) & (F.col("c") < min_share * F.col("all")))
                .select(F.col("host").alias("r_host"), F.col("t").alias("r_t"), F.col("s").alias("r_s")))
        tree = tree.join(rare, (F.col("host") == F.col("r_host")) & (F.col("t") == F.col("r_t")) & (seg == F.col("r_s")), "left")
        tree = tree.withColumn("t", F.when(seg.isNull(), F.col("t")).otherwise(
            F.concat("t", F.array(F.when(F.col("r_s").isNull(), seg).otherwise("*"))))).drop("r_host", "r_t", "r_s")
        tree, d = stage(tree, f"op5-level{d}"), d + 1  # a level reads the one before three times
    return tree.withColumn("t", F.concat("t", _from("segs", d)))


def merge_siblings(tree: DataFrame, z: float, min_pages: int) -> DataFrame:
    """``tree`` with ``m``, the merged template: a segment names all siblings joined to it.

    From the root down, the siblings below one merged parent are compared two by two; there are at most
    ``1 / min_share + max_children`` literal ones. One joins the largest it is similar to, and what that one joins."""
    tree, d = stage(tree, "op5-templates").withColumn("ms", F.array().cast("array<string>")), 0
    while _branches(tree, "ms", "t", d):
        s = F.get("t", F.lit(d))
        below = F.array_join(F.slice(F.col("t"), d + 2, F.greatest(F.size("t") - d, F.lit(1))), "/")
        # an array of its own tells a branch that ends here from one with an empty segment below
        part = tree.filter(s.isNotNull() & (s != "*")).groupBy(
            "host", "ms", s.alias("s"), F.struct((F.size("t") > d + 1).alias("more"), below.alias("below")).alias("x")).agg(
            F.sum("n").alias("n"), F.sum("n_label").alias("l"), F.sum("n_block").alias("b"))
        part = stage(part, f"op5-parts{d}")
        sums = part.groupBy("host", "ms", "s").agg(
            F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b"), F.count("*").alias("kinds")).filter(F.col("n") >= min_pages)
        part = part.join(sums.select("host", "ms", "s", F.col("n").alias("all")), ["host", "ms", "s"])
        one, two = (part.select("host", "ms", "x", F.col("s").alias(f"s{i}"), F.col("n").alias(f"n{i}"), F.col("all").alias(f"all{i}")) for i in (1, 2))
        common = one.join(two, ["host", "ms", "x"]).filter((F.col("all1") > F.col("all2")) | ((F.col("all1") == F.col("all2")) & (F.col("s1") < F.col("s2"))))
        ratio = F.sqrt(F.col("all2") / F.col("all1"))
        common = common.groupBy("host", "ms", "s1", "s2").agg(
            F.count("*").alias("shared"), F.sum("n1").alias("both1"), F.sum("n2").alias("both2"),
            F.sum(F.least(F.col("n1") / F.col("all1"), F.col("n2") / F.col("all2"))).alias("overlap"),
            F.sum(F.pow(ratio * F.col("n1") - F.col("n2") / ratio, F.lit(2)) / (F.col("n1") + F.col("n2"))).alias("chi"))
        for i in (1, 2):
            common = common.join(sums.select("host", "ms", F.col("s").alias(f"s{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("n", "l", "b", "kinds")]),
                                 ["host", "ms", f"s{i}"])
        # two-sample chi-square over the templates below; those that only one sibling has add its pages, scaled
        chi = (F.col("chi") + F.col("n2") / F.col("n1") * (F.col("n1") - F.col("both1")) + F.col("n1") / F.col("n2") * (F.col("n2") - F.col("both2")))
        free = F.col("kinds1") + F.col("kinds2") - F.col("shared") - 1
        part9 = 2 / (9 * F.greatest(free, F.lit(1)))
        same = (free == 0) | (chi <= free * F.pow(1 - part9 + z * F.sqrt(part9), F.lit(3)))  # Wilson-Hilferty
        pooled = (F.col("b1") + F.col("b2") + 1) / (F.col("l1") + F.col("l2") + 2)
        l1, l2 = F.greatest("l1", F.lit(1)), F.greatest("l2", F.lit(1))
        score = F.abs(F.col("b1") / l1 - F.col("b2") / l2) / F.sqrt(pooled * (1 - pooled) * (1 / l1 + 1 / l2))
        alike = same & (F.col("overlap") >= 0.5) & ((F.col("l1") == 0) | (F.col("l2") == 0) | (score <= z))
        joins = (common.filter(alike).groupBy("host", "ms", F.col("s2").alias("s"))
                 .agg(F.max_by("s1", F.struct(F.col("n1"), F.col("s1"))).alias("to")))
        joins = stage(joins, f"op5-joins{d}")
        names = sums.select("host", "ms", "s").join(joins, ["host", "ms", "s"], "left").withColumn("to", F.coalesce("to", "s"))
        while True:  # to the one that joins nothing: the way halves each time
            names = stage(names, f"op5-names{d}")
            step = names.select("host", "ms", F.col("s").alias("to"), F.col("to").alias("next"))
            names = names.join(step, ["host", "ms", "to"]).select("host", "ms", "s", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
            names = stage(names, f"op5-names{d}")
            if not names.filter("moved").limit(1).count():
                break
            names = names.drop("moved")
        own = W.partitionBy("host", "ms", "to")
        names = names.select(F.col("host").alias("m_host"), F.col("ms").alias("m_ms"), F.col("s").alias("m_s"),
                             F.array_join(F.sort_array(F.collect_list("s").over(own)), "|").alias("m_name"))
        tree = tree.join(names, (F.col("host") == F.col("m_host")) & (F.col("ms") == F.col("m_ms")) & (s == F.col("m_s")), "left")
        tree = stage(tree.withColumn("ms", F.when(s.isNull(), F.col("ms")).otherwise(
            F.concat("ms", F.array(F.coalesce(F.col("m_name"), s))))).drop("m_host", "m_ms", "m_s", "m_name"), f"op5-merged{d}")
        d += 1
    return tree.withColumn("m", F.array_join(F.concat("ms", _from("t", d)), "/")).drop("ms")


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules: Sequence[Rule] = RULES,
                 max_children: int = 20, min_share: float = 0.02, z: float = 1.96,
                 strength: float = 4.0, min_labels: int = 5, min_purity: float = 0.8) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, purity (of the template)."""
    url = F.col(f"`{url_col}`").cast("string")
    df = pages.select(F.col(f"`{id_col}`").alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    df = df.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("path", F.coalesce("path", F.lit("")))
    df = df.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("segs", segments_of(F.col("path")))
    label = F.col("_rule.verdict")
    shapes = stage(df.groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count(label).alias("n_label"), F.count_if(label == "block").alias("n_block")), "op5-shapes")
    tree = stage(merge_siblings(template_tree(shapes, max_children, min_share), z, min_labels), "op5-tree")
    prior = tree.agg((F.sum("n_block") / F.greatest(F.sum("n_label"), F.lit(1))).alias("prior"))
    lacking = F.col("n") - F.col("l")
    purity = (tree.groupBy("host", "m").agg(F.sum("n").alias("n"), F.sum("n_label").alias("l"), F.sum("n_block").alias("b"))
              .crossJoin(F.broadcast(prior))  # one row
              .select(F.col("host").alias("t_host"), F.col("m").alias("t_m"), "l",
                      ((F.col("b") + (strength + lacking) * F.coalesce("prior", F.lit(0.0))) / (F.col("n") + strength)).alias("purity")))
    known = (tree.join(purity, (F.col("host") == F.col("t_host")) & (F.col("m") == F.col("t_m")))
             .select("t_host", F.col("segs").alias("t_segs"), F.concat(F.col("t_host"), F.lit("/"), "m").alias("template"), "l", "purity"))
    out = df.join(known, (F.col("host") == F.col("t_host")) & (F.col("segs") == F.col("t_segs")), "left")
    method = F.when((F.col("l") >= min_labels) & (F.col("purity") >= min_purity), "block").otherwise("allow")
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"),
                      F.coalesce(label, method).alias("verdict"), "template", "purity")
