"""URL filter: explicit host/path rules, and for all other URLs a path-template tree judged by labelled purity. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import lower_ascii, table, written

#: The rules that the registered query is given.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. At equal length block comes first, then the text."""
    rule = verdict = None
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, act) if verdict is None else verdict.when(fits, act)
    none = F.lit(None).cast("string")
    return (none if rule is None else rule, none if verdict is None else verdict)


def _segments(path: Column) -> Column:
    """The path's segments that aren't empty, runs of digits as #."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, "[0-9]+", "#"))


def _similar(n: Column, good: Column, n_all: Column, good_all: Column, z: float) -> Column:
    """Whether a share of good labels differs from that of all by no more than z standard errors, with a continuity correction; without labels it doesn't."""
    share = good_all / F.nullif(n_all, F.lit(0)).cast("double")
    off = F.greatest(F.abs(good - n * share) - F.lit(0.5), F.lit(0.0))
    return (n == 0) | (off * off <= F.lit(z * z) * n * share * (1 - share))


def template_verdicts(urls: DataFrame, labels: DataFrame, max_children: int = 12, z: float = 1.96, weight: float = 10.0, least_purity: float = 0.5) -> DataFrame:
    """(host, shape, template, n_labelled, purity, verdict) for every path shape that occurs: a path's segments with runs of digits as #.

    urls: id, host, path. labels: id, good (0/1; null is unlabelled). Shapes are counted first, so that all that follows
    runs over shapes and not over pages. The tree grows level by level, one round for each level at which paths branch or end. At a node, more than max_children different
    segments become one wildcard. Of its branches those become one wildcard whose share of good labels is that of all the node's branches, within z standard errors, and so is,
    for each segment that may come next, the share below it: branches whose inside differs stay apart. A node of one shape is a leaf. Purity is a template's good share smoothed by
    `weight` labels at the corpus's own share; a template below least_purity is blocked. Without any label everything is allowed. No URLs give no rows.
    """
    shape = _segments(F.col("path"))
    joined = urls.select("id", "host", F.array_join(shape, "/").alias("shape")).join(labels, "id", "left")
    shapes = written(joined.groupBy("host", "shape").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")))
    segs = F.filter(F.split("shape", "/"), lambda x: x != "")
    live = shapes.select("host", "shape", "n", "good", F.array().cast("array<string>").alias("g"), segs.alias("rest"))
    done = []
    while True:
        node = ["host", "g"]
        # what all shapes of a node have in common is passed at once; a node of one shape, and a path that ends here, need no more
        sizes = live.groupBy(*node).agg(F.count(F.lit(1)).alias("shapes"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        alike = F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False)))
        live = live.join(sizes.withColumn("k", F.when(F.array_contains(alike, False), F.array_position(alike, False) - 1).otherwise(F.size(alike)).cast("int")), node)
        g, rest = F.concat("g", F.slice("rest", F.lit(1), F.col("k"))), F.slice("rest", F.col("k") + 1, F.size("rest"))
        live = live.select("host", "shape", "n", "good", "shapes", g.alias("g"), rest.alias("rest"))
        ended = (F.col("shapes") == 1) | (F.size("rest") == 0)
        done.append(live.where(ended).select("host", "shape", "n", "good", F.array_join(F.concat("g", "rest"), "/").alias("template")))
        live = written(live.where(~ended).select("host", "shape", "n", "good", "g", F.element_at("rest", 1).alias("seg"), F.coalesce(F.try_element_at("rest", F.lit(2)), F.lit("")).alias("next"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest")))
        if not live.limit(1).count():
            break
        wide = live.groupBy(*node).agg(F.count_distinct("seg").alias("kinds"))
        live = live.join(wide, node).withColumn("c", F.when(F.col("kinds") > max_children, F.lit("*")).otherwise(F.col("seg")))
        below = live.groupBy(*node, "c", "next").agg(F.sum("n").alias("n_b"), F.sum("good").alias("good_b"))
        next_of_all = below.groupBy(*node, "next").agg(F.sum("n_b").alias("n_q"), F.sum("good_b").alias("good_q"))
        branches = below.join(next_of_all, [*node, "next"]).groupBy(*node, "c").agg(F.sum("n_b").alias("n_c"), F.sum("good_b").alias("good_c"), F.bool_and(_similar(F.col("n_b"), F.col("good_b"), F.col("n_q"), F.col("good_q"), z)).alias("inside"))
        whole = branches.groupBy(*node).agg(F.count(F.lit(1)).alias("branches"), F.sum("n_c").alias("n_p"), F.sum("good_c").alias("good_p"))
        merges = (F.col("branches") > 1) & F.col("inside") & _similar(F.col("n_c"), F.col("good_c"), F.col("n_p"), F.col("good_p"), z)
        named = branches.join(whole, node).select(*node, "c", F.when(merges, F.lit("*")).otherwise(F.col("c")).alias("name"))
        live = written(live.join(named, [*node, "c"]).select("host", "shape", "n", "good", F.concat("g", F.array("name")).alias("g"), "rest"))
    leaves = written(reduce(DataFrame.unionByName, done))
    own = leaves.groupBy("host", "template").agg(F.sum("n").alias("n_labelled"), F.sum("good").alias("n_good"))
    all_ = own.agg(F.sum("n_labelled").alias("n"), F.sum("n_good").alias("good")).first()
    prior = float(all_["good"]) / all_["n"] if all_["n"] else 1.0
    judged = own.withColumn("purity", (F.col("n_good") + F.lit(weight * prior)) / (F.col("n_labelled") + F.lit(weight)))
    judged = judged.withColumn("verdict", F.when(F.col("purity") < least_purity, F.lit("block")).otherwise(F.lit("allow"))).drop("n_good")
    return leaves.select("host", "shape", "template").join(judged, ["host", "template"]).select("host", "shape", "template", "n_labelled", "purity", "verdict")


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", **params) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) for every row of pages, repeated rows and null ids included.

    labels: id, good. Where ids repeat in labels, the lower label counts. A rule's verdict comes before the tree's. Null
    URLs, and those without ://, have an empty host and path and so the template ''. URLs may be of any length and depth. Other columns of pages are left out.
    """
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    good = labels.where("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good"))
    verdicts = written(template_verdicts(urls, good, **params).select("host", "shape", "template", "purity", F.col("verdict").alias("by_tree")))
    rule, act = rule_columns(F.col("host"), F.col("path"), rules)
    keyed = urls.withColumn("shape", F.array_join(_segments(F.col("path")), "/"))
    return keyed.join(verdicts, ["host", "shape"]).select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(act, F.col("by_tree")).alias("verdict"), "template", "purity")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filter_urls over all pages; a page is labelled by the quality label of its number."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))
    return filter_urls(table(spark, sf_dir, "pages"), labels)


def oracle(depth: int = 6) -> str:
    """DuckDB SQL for the registered query, for paths of at most `depth` segments; the given ones have two."""
    s = [f"s{i}" for i in range(1, depth + 2)]
    g = [f"g{i}" for i in range(1, depth + 1)]
    similar = lambda n, good, n_all, good_all: f"({n} = 0 or greatest(abs({good} - {n} * ({good_all} / nullif({n_all}, 0)::double)) - 0.5::double, 0.0::double) * greatest(abs({good} - {n} * ({good_all} / nullif({n_all}, 0)::double)) - 0.5::double, 0.0::double) <= (1.96::double * 1.96::double) * {n} * ({good_all} / nullif({n_all}, 0)::double) * (1 - ({good_all} / nullif({n_all}, 0)::double)))"
    steps, last = [], "shapes"
    for i in range(depth):
        node, seg, after = ", ".join(["host", *g[:i]]), s[i], s[i + 1]
        steps += [
            f"w{i} as (select {node}, count(distinct {seg}) as kinds from {last} where {seg} <> '' group by all)",
            f"c{i} as (select x.*, case when kinds > 12 then '*' else {seg} end as c from {last} x join w{i} using ({node}) where {seg} <> '')",
            f"b{i} as (select {node}, c, {after} as nxt, sum(n)::bigint as n_b, sum(good)::bigint as good_b from c{i} group by all)",
            f"q{i} as (select {node}, nxt, sum(n_b)::bigint as n_q, sum(good_b)::bigint as good_q from b{i} group by all)",
            f"r{i} as (select {node}, c, sum(n_b)::bigint as n_c, sum(good_b)::bigint as good_c, bool_and({similar('n_b', 'good_b', 'n_q', 'good_q')}) as inside from b{i} join q{i} using ({node}, nxt) group by all)",
            f"p{i} as (select {node}, count(*) as branches, sum(n_c)::bigint as n_p, sum(good_c)::bigint as good_p from r{i} group by all)",
            f"m{i} as (select {node}, c, case when branches > 1 and inside and {similar('n_c', 'good_c', 'n_p', 'good_p')} then '*' else c end as name from r{i} join p{i} using ({node}))",
            f"t{i} as (select x.* exclude (c), name as {g[i]} from c{i} x join m{i} using ({node}, c) union all select *, '' as {g[i]} from {last} where {seg} = '')",
        ]
        last = f"t{i}"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", a, h + p) for a, h, p in ordered]
    rule, act = ("case " + " ".join(f"when {f} then '{x[k]}'" for f, *x in fits) + " end" for k in (1, 0))
    columns = ", ".join(f"coalesce(regexp_replace(segs[{i}], '[0-9]+', '#', 'g'), '') as s{i}" for i in range(1, depth + 2))
    return f"""
with urls as (select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
keyed as (select page_id, host, path, {columns} from (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as segs from urls)),
lab as (select doc_id, min(quality) as good from labels where doc_id is not null and quality is not null group by doc_id),
shapes as (select host, {', '.join(s)}, count(good) as n, coalesce(sum(good), 0)::bigint as good from keyed left join lab on page_id = doc_id group by all),
{', '.join(steps)},
named as (select *, concat_ws('/', {', '.join(f"nullif({x}, '')" for x in g)}) as template from {last}),
own as (select host, template, sum(n)::bigint as n_t, sum(good)::bigint as good_t from named group by all),
prior as (select case when sum(n_t) > 0 then sum(good_t)::double / sum(n_t)::double else 1.0::double end as p0 from own),
judged as (select host, template, (good_t + 10.0::double * p0) / (n_t + 10.0::double) as purity from own cross join prior),
final as (select n.host, {', '.join(f'n.{x}' for x in s)}, template, purity from named n join judged using (host, template))
select page_id, host, path, {rule} as rule, coalesce({act}, case when purity < 0.5 then 'block' else 'allow' end) as verdict, template, purity
from keyed join final using (host, {', '.join(s)})"""


ORACLE = oracle()
