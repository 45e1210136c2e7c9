"""URL filters: rules first, then a tree of path templates learnt from labelled URLs.

Rules name a host with all its subdomains and the start of a path; the longest
that fits decides. For other URLs every host has a tree of path templates.
Segments whose form alone tells that they vary (numbers, dates, hashes) become
wildcards at once, so that URLs shrink to few distinct paths with counts. Level
by level a node whose children are many and mostly rare gets one wildcard child
instead. Then, from the deepest level up, branches under one parent (and at last
the hosts of a domain) that do not differ significantly in their children and
labels are merged, and a template is rejected if its smoothed share of blocked
labels, over all that was merged into it, reaches ``reject``.

The tree is counted, not collected: each level is a few aggregations of distinct
paths or templates by parent and joins with their results, stored; siblings are
compared with the sum of their kind, never with each other. A template that no
label reaches is allowed.

Null URL, or one without ``://``: empty host and path, no rule; it belongs to
the template of the empty path of the empty host. Null id: kept. Repeated rows
are judged each and count each. Empty table: no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforo.llm.common import ascii_lower, pick, stored

Rule = tuple[str, str, str]
FANOUT = 16
RARE = 0.2
SMOOTHING = 2.0
REJECT = 0.8
ALIKE = 1.96
#: Chance at which equal branches may be held for different (Hoeffding's bound).
DIFFER = 0.05
#: Forms of segments that vary by themselves, and the wildcard of each.
FORMS = (
    (r"^\d{4}-\d{2}(-\d{2})?$", "{date}"),
    (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "{uuid}"),
    (r"^\d+(\.[A-Za-z]{1,5})?$", "{number}"),
    (r"^(?=.*\d)[0-9a-fA-F]{8,}(\.[A-Za-z]{1,5})?$", "{hash}"),
)
WILDCARD = "{any}"


def host_and_path(url: Column) -> tuple[Column, Column]:
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, form, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct of the longest fitting rule ``(verdict, rule)``, or null; ``rules`` is a stated list."""
    found = None
    for verdict, domain, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(domain + start).alias("rule"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if found is None else found


def lexical_path(path: Column) -> Column:
    """The path with segments of a varying form replaced, without empty segments."""

    def generalise(segment: Column) -> Column:
        out = None
        for form, name in FORMS:
            fits = segment.rlike(form)
            out = F.when(fits, name) if out is None else out.when(fits, name)
        return out.otherwise(segment)

    return F.concat_ws("/", F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), generalise))


def path_templates(paths: DataFrame, fanout: int = FANOUT, rare: float = RARE) -> DataFrame:
    """Add ``template`` to ``(host, lexical, n, ...)``, a row per distinct path of a host.

    Each level is worked on by the paths that reach it; the others are done.
    """
    segments = F.split("lexical", "/")
    rows = paths.withColumns({"template": F.lit(""), "_depth": F.size(segments)})
    done, columns = [], [*paths.columns, "template"]
    for level in range(1, (rows.agg(F.max("_depth")).first()[0] or 0) + 1):
        done.append(rows.filter(F.col("_depth") < level).select(*columns))
        rows = rows.filter(F.col("_depth") >= level).withColumn("_segment", F.get(segments, F.lit(level - 1)))
        children = rows.groupBy("host", "template", "_segment").agg(F.sum("n").alias("_n"))
        nodes = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("_children"), F.sum("_n").alias("_all"))
        variable = nodes.filter((F.col("_children") >= fanout) & (F.col("_children") >= F.col("_all") * rare))
        variable = stored(variable.select("host", "template", F.lit(True).alias("_variable")), "url-nodes")
        joined = rows.join(variable, ["host", "template"], "left")
        segment = F.when(F.col("_variable"), F.lit(WILDCARD)).otherwise(F.col("_segment"))
        rows = stored(joined.withColumn("template", F.concat("template", F.lit("/"), segment)).drop("_segment", "_variable"), "url-level")
    return reduce(DataFrame.union, done, rows.select(*columns))


def _merge_level(nodes: DataFrame, level: int, alike: float) -> DataFrame:
    """``nodes`` with the classes of one level of ``cls`` named; those below it are named already.

    Siblings are of one kind if they have the same most frequent child. Each is
    held against the sum of its kind: by the distance of their shares of
    children, and of blocked labels where both have labels. Those that do not
    differ are one class, named by its least segment.
    """
    parent = F.when(F.lit(level == 0), F.col("domain")).otherwise(F.concat_ws("/", F.slice("seg", 1, level)))
    below = F.get("cls", F.lit(level + 1))
    child = F.when(below.isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), below))
    rows = nodes.filter(F.size("seg") > level).select(
        F.col("domain"), parent.alias("parent"), F.get("seg", F.lit(level)).alias("own"), child.alias("child"), "n", "labelled", "blocked"
    )
    here, kind = ["domain", "parent", "own"], ["domain", "parent", "kind"]
    counts = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    spread = stored(rows.groupBy(*here, "child").agg(*counts), "url-children")
    branches = spread.groupBy(*here).agg(*counts, F.max(F.struct("n", "child")).getField("child").alias("kind"))
    branches = stored(branches, "url-branches")
    kinds = branches.groupBy(*kind).agg(
        F.count(F.lit(1)).alias("members"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_l"), F.sum("blocked").alias("all_b")
    )
    kinds = stored(kinds.filter("members > 1"), "url-kinds")
    open_ = branches.join(kinds, kind)
    parts = spread.select(*here, "child", F.col("n").alias("part")).join(open_.select(*here, "kind", "n", "all_n"), here)
    totals = parts.groupBy(*kind, "child").agg(F.sum("part").alias("all_part"))
    p, q = F.col("part") / F.col("n"), (F.col("all_part") - F.col("part")) / (F.col("all_n") - F.col("n"))
    # children that the branch lacks count with the share that the others have of them
    gaps = parts.join(totals, [*kind, "child"]).groupBy(*here).agg(((F.sum(F.abs(p - q)) + 1 - F.sum(q)) / 2).alias("gap"))
    rest_n, rest_l = F.col("all_n") - F.col("n"), F.col("all_l") - F.col("labelled")
    near = F.col("gap") <= F.lit(math.sqrt(math.log(2 / DIFFER) / 2)) * (1 / F.sqrt("n") + 1 / F.sqrt(rest_n))
    share = F.col("all_b") / F.col("all_l")
    error = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / rest_l))
    apart = F.abs(F.col("blocked") / F.col("labelled") - (F.col("all_b") - F.col("blocked")) / rest_l)
    agree = F.when((F.col("labelled") > 0) & (rest_l > 0), apart <= alike * error).otherwise(True)
    same = open_.join(gaps, here).filter(near & agree).select(*here, "kind")
    names = same.groupBy(*kind).agg(F.min("own").alias("name"))
    named = stored(same.join(names, kind).select(*here, "name"), "url-classes")
    found = nodes.withColumns({"parent": parent, "own": F.get("seg", F.lit(level))}).join(named, here, "left")
    renamed = F.concat(F.slice("cls", 1, level), F.array("name"), F.slice("cls", level + 2, F.greatest(F.size("cls"), F.lit(1))))
    return stored(found.withColumn("cls", F.when(F.col("name").isNull(), F.col("cls")).otherwise(renamed)).drop("parent", "own", "name"), "url-merged")


def judge_templates(templates: DataFrame, smoothing: float = SMOOTHING, reject: float = REJECT, alike: float = ALIKE) -> DataFrame:
    """``(host, template, branch, labelled, purity, rejected)`` of ``(host, template, n, labelled, blocked)``.

    From the deepest level up to the hosts of a domain, branches that do not
    differ are merged (:func:`_merge_level`), so those without labels share the
    purity of the labelled ones that they resemble. ``branch`` names the merged
    template; ``labelled`` counts the labels of all of it.
    """
    counts = templates.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    seg = F.concat(F.array("host"), F.filter(F.split("template", "/"), lambda x: x != ""))
    domain = F.substring_index("host", ".", -2)
    nodes = stored(counts.withColumns({"domain": domain, "seg": seg, "cls": seg}), "url-templates")
    deepest = nodes.agg(F.max(F.size("seg"))).first()[0] or 0
    for level in range(deepest - 1, -1, -1):
        nodes = _merge_level(nodes, level, alike)
    nodes = nodes.withColumn("branch", F.concat_ws("/", "domain", "cls"))
    pools = nodes.groupBy("branch").agg(F.sum("labelled").alias("_l"), F.sum("blocked").alias("_b"))
    purity = (F.col("_b") + smoothing / 2) / (F.col("_l") + smoothing)
    rows = nodes.join(stored(pools, "url-pools"), "branch")
    return rows.select("host", "template", "branch", F.col("_l").alias("labelled"), purity.alias("purity"), (purity >= reject).alias("rejected"))


def judge(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", label: Column | None = None) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, template, branch, purity, labelled.

    ``label`` (true: block) is a column over ``host``, ``path`` and ``_rule``;
    by default the verdict of the rule that fits, so the tree learns from the
    rules where else on their hosts the same kinds of page stand.
    """
    host, path = host_and_path(F.col("_url"))
    rows = pick(pages, page_id=page_id, _url=url).select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    blocked = (F.col("_rule.verdict") == "block") if label is None else label
    rows = rows.withColumns({"lexical": lexical_path(F.col("path")), "_blocked": blocked})
    rows = stored(rows, "url-rows")
    paths = rows.groupBy("host", "lexical").agg(
        F.count(F.lit(1)).alias("n"), F.count("_blocked").alias("labelled"), F.count_if("_blocked").alias("blocked")
    )
    templates = stored(path_templates(stored(paths, "url-paths")), "url-tree")
    verdicts = judge_templates(templates)
    known = templates.select("host", "lexical", "template").join(verdicts, ["host", "template"])
    found = rows.join(stored(known.select("host", "lexical", "template", "branch", "purity", "labelled", "rejected"), "url-verdicts"), ["host", "lexical"])
    own = F.when(F.col("rejected"), "block").otherwise("allow")
    verdict = F.coalesce("_rule.verdict", own).alias("verdict")
    return found.select("page_id", "host", "path", "_rule.rule", verdict, "template", "branch", "purity", "labelled")
