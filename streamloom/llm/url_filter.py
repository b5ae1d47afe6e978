"""URL filtering by rules and by a path-template tree, in DataFrame operations only.

Explicit rules judge the urls that they fit. The tree judges the rest. Per host, a path is a branch of segments, all of
them. A segment with a digit becomes a wildcard, and so do all values at a node that has many, most of them rare. What
is left is the template of the path.

The labels are the verdicts of the rules on the urls that they fit. A template's blocked share is found top-down along a
chain of branches: under all hosts, from the first segment to the whole template; the whole template under the registered
domain; under the host itself, from its root to the whole template. A branch that doesn't differ from the one above by a proportion test is merged with it
and takes its share; one that does has its own, smoothed towards the one above. So the same template under hosts that
agree is one branch, and a host without labels of its own is judged by the hosts and domains that have some. A branch
above the whole template speaks for what lies below it only if labels cover at least half of its urls: a rule for one
path of a host says nothing of the host's other paths. A template is rejected from a smoothed share of REJECT on.

A null url, or one without ``://``, has an empty host and path, no rule, and is allowed. Null ids and repeated rows are
kept, one result a row; a share of exactly REJECT blocks; extra columns are ignored; an empty table gives an empty result;
without labels every url is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.common import cut, table

#: host, path prefix, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Pseudo-counts of the share above, values and mean count from which a node's values become a wildcard, the squared z
#: from which a branch differs, the labelled share from which a branch speaks for what is below, and the rejected share.
PRIOR, MANY, RARE, DIFFERS, COVER, REJECT = 4.0, 20, 3.0, 6.63, 0.5, 0.8
#: Rows (of some 100 bytes) up to which a counted side is broadcast; more are joined by a shuffle.
FEW = 100_000
#: The last two labels of a host, or three where the last two are a country's common suffix.
DOMAIN = r"([^.]+[.](?:(?:co|com|org|net|gov|ac|edu)[.][a-z][a-z]|[^.]+))$"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; else null."""
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ordered])


def few(df: DataFrame) -> DataFrame:
    """``df``, for a join: counted, and broadcast only if it is small."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= FEW else df


def parts_of(path: Column) -> Column:
    """The segments of a joined path; none for the empty one."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def templates(stats: DataFrame) -> DataFrame:
    """stats(host, shape, n, ...) with the template of each shape: crowded nodes' values as wildcards."""
    levels = F.transform(parts_of(F.col("shape")), lambda s, i: F.struct(i.alias("i"), F.array_join(F.slice(parts_of(F.col("shape")), 1, i), "/").alias("prefix"), s.alias("value")))
    each = stats.select("host", "shape", "n", F.explode(levels).alias("x")).select("host", "shape", "n", "x.*")
    values = each.groupBy("host", "prefix", "value").agg(F.sum("n").alias("n"))
    crowd = values.groupBy("host", "prefix").agg(F.count("*").alias("values"), F.sum("n").alias("all"))
    crowd = few(crowd.filter((F.col("values") >= MANY) & (F.col("all") < RARE * F.col("values"))).select("host", "prefix", F.lit("*").alias("wild")))
    named = each.join(crowd, ["host", "prefix"], "left").select("host", "shape", F.struct("i", F.coalesce("wild", "value").alias("value")).alias("x"))
    named = named.groupBy("host", "shape").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["value"]), "/").alias("template"))
    return stats.join(named, ["host", "shape"], "left").withColumn("template", F.coalesce("template", F.lit("")))


def shares(branches: DataFrame, root: float) -> DataFrame:
    """host, template, share from branches(domain, host, template, blocked, labelled, n)."""
    parts = parts_of(F.col("template"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(parts, 1, i), "/").alias("prefix"), (i == F.size(parts)).alias("leaf")))
    scopes = F.array(*[F.struct(F.lit(k).alias("scope"), c.alias("key")) for k, c in enumerate((F.lit(""), F.col("domain"), F.col("host")))])
    each = branches.withColumn("x", F.explode(prefixes)).withColumn("y", F.explode(scopes)).select("host", "template", "blocked", "labelled", "n", "x.*", "y.*")
    each = each.filter("leaf or scope = 2 or (scope = 0 and i > 0)")
    nodes = each.groupBy("scope", "key", "prefix").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("m"), F.sum("n").alias("all"))
    nodes = few(nodes.filter("m > 0"))
    link = F.struct("scope", "i", "leaf", "b", "m", "all")
    chains = each.drop("n").join(nodes, ["scope", "key", "prefix"]).groupBy("host", "template").agg(F.array_sort(F.collect_list(link)).alias("chain"))

    def below(share: Column, x: Column) -> Column:
        expected = x["m"] * share
        off = x["b"] - expected
        differs = off * off > F.lit(DIFFERS) * F.greatest(expected * (1 - share), F.lit(0.25))
        speaks = x["leaf"] | (x["m"] >= F.lit(COVER) * x["all"])
        return F.when(speaks & differs, (x["b"] + F.lit(PRIOR) * share) / (x["m"] + F.lit(PRIOR))).otherwise(share)

    return chains.select("host", "template", F.aggregate("chain", F.lit(root), below).alias("share"))


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the template and smoothed blocked share that the method found."""
    found = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = found.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    found = found.withColumn("label", F.when(F.col("hit.verdict") == "block", 1).when(F.col("hit").isNotNull(), 0))
    found = found.withColumn("shape", F.array_join(F.transform(parts_of(F.col("path")), lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s)), "/"))
    # The tree is built on distinct shapes with their counts: hot hosts and pages are summed before any other exchange.
    stats = cut(found.groupBy("host", "shape").agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"), F.count("label").alias("labelled")))
    named = cut(templates(stats))
    domain = F.regexp_extract("host", DOMAIN, 1)
    branches = named.groupBy(F.when(domain != "", domain).otherwise(F.col("host")).alias("domain"), "host", "template").agg(*[F.sum(c).alias(c) for c in ("blocked", "labelled", "n")])
    whole = stats.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("m")).first()
    root = min(0.5, ((whole["b"] or 0) + 1.0) / ((whole["m"] or 0) + 2.0))
    share = shares(branches, root)
    leaves = few(named.select("host", "shape", "template").join(share, ["host", "template"], "left").select("host", "shape", "template", F.coalesce("share", F.lit(root)).alias("share")))
    out = found.join(leaves, ["host", "shape"], "left")
    verdict = F.coalesce("hit.verdict", F.when(F.round("share", 9) >= REJECT, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), F.concat(F.lit("/"), "template").alias("template"), F.round("share", 9).alias("share"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_rules = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
_fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for h, p, _ in _rules]
#: The same in SQL, for another engine.
SQL = f"""WITH RECURSIVE split AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
 ruled AS (SELECT *, CASE {' '.join(f"{w} '{h + p}'" for w, (h, p, _) in zip(_fits, _rules, strict=True))} END AS rule,
  CASE {' '.join(f"{w} '{v}'" for w, (_, _, v) in zip(_fits, _rules, strict=True))} END AS known,
  list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' ELSE s END) AS segs FROM split),
 stats AS (SELECT host, segs, count(*) AS n, count(CASE WHEN known = 'block' THEN 1 END) AS blocked, count(known) AS labelled FROM ruled GROUP BY host, segs),
 whole AS (SELECT least(0.5::DOUBLE, (coalesce(sum(blocked), 0) + 1)::DOUBLE / (coalesce(sum(labelled), 0) + 2)) AS root FROM stats),
 steps AS (SELECT host, segs, n, unnest(range(1, len(segs) + 1)) AS i FROM stats),
 crowd AS (SELECT host, prefix FROM (SELECT host, segs[1:i-1] AS prefix, segs[i] AS value, sum(n) AS n FROM steps GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) >= {MANY} AND sum(n) < {RARE} * count(*)),
 made AS (SELECT s.host, s.segs, list(CASE WHEN c.host IS NULL THEN s.segs[s.i] ELSE '*' END ORDER BY s.i) AS template FROM steps s LEFT JOIN crowd c ON c.host = s.host AND c.prefix = s.segs[1:s.i-1] GROUP BY 1, 2),
 named AS (SELECT stats.*, coalesce(made.template, []) AS template FROM stats LEFT JOIN made ON made.host = stats.host AND made.segs = stats.segs),
 branches AS (SELECT host, coalesce(nullif(regexp_extract(host, '{DOMAIN}', 1), ''), host) AS domain, template, sum(blocked) AS blocked, sum(labelled) AS labelled, sum(n) AS n FROM named GROUP BY 1, 2, 3),
 each AS (SELECT host, template, blocked, labelled, n, scope, CASE scope WHEN 0 THEN '' WHEN 1 THEN domain ELSE host END AS key, template[1:i] AS prefix, i, i = len(template) AS leaf
  FROM (SELECT *, unnest(range(0, len(template) + 1)) AS i FROM branches), range(3) AS r(scope) WHERE i = len(template) OR scope = 2 OR (scope = 0 AND i > 0)),
 nodes AS (SELECT scope, key, prefix, sum(blocked)::DOUBLE AS b, sum(labelled)::DOUBLE AS m, sum(n)::DOUBLE AS n FROM each GROUP BY 1, 2, 3 HAVING sum(labelled) > 0),
 links AS (SELECT e.host, e.template, row_number() OVER (PARTITION BY e.host, e.template ORDER BY e.scope, e.i) AS k, e.leaf OR d.m >= {COVER} * d.n AS speaks, d.b, d.m FROM each e JOIN nodes d ON d.scope = e.scope AND d.key = e.key AND d.prefix = e.prefix),
 walk AS (SELECT DISTINCT host, template, 0 AS k, root AS share FROM links, whole
  UNION ALL SELECT w.host, w.template, l.k::INTEGER, CASE WHEN l.speaks AND (l.b - l.m * w.share) * (l.b - l.m * w.share) > {DIFFERS} * greatest(l.m * w.share * (1 - w.share), 0.25::DOUBLE)
   THEN (l.b + {PRIOR} * w.share) / (l.m + {PRIOR}) ELSE w.share END FROM walk w JOIN links l ON l.host = w.host AND l.template = w.template AND l.k = w.k + 1),
 shares AS (SELECT host, template, arg_max(share, k) AS share FROM walk GROUP BY 1, 2)
 SELECT page_id, r.host, path, rule, coalesce(known, CASE WHEN round(coalesce(s.share, root), 9) >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
  '/' || array_to_string(n.template, '/') AS template, round(coalesce(s.share, root), 9) AS share
 FROM ruled r JOIN named n ON n.host = r.host AND n.segs = r.segs LEFT JOIN shares s ON s.host = n.host AND s.template = n.template, whole"""
