"""URL filters as a sort-merge range join, with DataFrame functions only.

A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the rule's. In canonical form
a host's labels stand in reverse order, so a rule is a prefix, and a prefix is an interval of the sort order. Each page
contributes one row for every rule depth its host reaches (`com`, `com.example`, ...), keyed by that reversed host and
the path. Pages and rules are sorted together and swept: the window keeps a stack of the last rule seen at each nesting
depth, and a slot whose rule is no prefix of the current key is no longer active. The deepest active slot is the longest
rule. The longest host decides between depths, then the longest path.

Pages are dealt by row number to as many buckets as there are shuffle partitions, and the rules go to each bucket, so a
host with a third of all pages loads no bucket more than another, and nothing is broadcast.

Defined results: null URLs and URLs without `://` have empty host and path and the default verdict; hosts lose only A-Z
case; repeated pages are judged each for itself; of equal rules with different verdicts `block` holds; without rules every
page has the default verdict; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditweave.llm.common import partitions

DEFAULT_VERDICT = "allow"
#: The registered query's rules.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    if not rules:
        return spark.createDataFrame([], "host string, path string, verdict string")
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))))


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path (both empty for null URLs and those without ://)."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return pages.select("*", F.translate(host, string.ascii_uppercase, string.ascii_lowercase).alias("host"), path.alias("path"))


def _reversed(host, depth):
    return F.array_join(F.slice(F.reverse(F.split(host, "\\.")), 1, depth), ".")


def nested_rules(rules: DataFrame) -> DataFrame:
    """hkey, hdepth, path, rule, verdict, nest: how many rules of the same host are proper prefixes of this one."""
    depth = F.size(F.split("host", "\\."))
    keyed = (
        rules.where("host is not null and path is not null and verdict is not null")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
        .select(_reversed(F.col("host"), depth).alias("hkey"), depth.alias("hdepth"), "path", F.concat("host", "path").alias("rule"), "verdict")
    )
    shorter = keyed.where("length(path) > 0").select("rule", "hkey", F.explode(F.sequence(F.lit(0), F.length("path") - 1)).alias("n"), "path")
    shorter = shorter.select("rule", "hkey", F.substring(F.col("path"), F.lit(1), F.col("n")).alias("path"))
    above = shorter.join(keyed.select("hkey", "path"), ["hkey", "path"]).groupBy("rule").agg(F.count("*").cast("int").alias("nest"))
    return keyed.join(above, "rule", "left").withColumn("nest", F.coalesce("nest", F.lit(0)))


def judge(pages: DataFrame, rules: DataFrame, *, page_id: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    spark = pages.sparkSession
    buckets = partitions(spark)
    nested = nested_rules(rules)
    # two small facts of the rules, not of the pages: which host depths occur (at most 127) and how deep rules nest
    shape = nested.agg(F.collect_set("hdepth").alias("depths"), F.max("nest").alias("nest")).first()
    depths, slots = sorted(shape.depths), range((shape.nest if shape.nest is not None else -1) + 1)

    paged = with_host_and_path(pages.select(F.col(page_id), F.col(url)), url).select(page_id, "host", "path", F.monotonically_increasing_id().alias("row"))
    paged = paged.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    if not depths:
        return paged.select(page_id, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    reach = F.filter(F.array(*map(F.lit, [0, *depths])), lambda d: d <= F.size(F.split("host", "\\.")))
    # depth 0 stands for the page itself; it alone carries the id and the host
    leveled = paged.select("bucket", "row", F.explode(reach).alias("hdepth"), page_id, "host", "path").select(
        "bucket", "row", "hdepth", F.when(F.col("hdepth") > 0, _reversed(F.col("host"), F.col("hdepth"))).otherwise("").alias("hkey"), "path",
        F.when(F.col("hdepth") == 0, F.struct(page_id, "host")).alias("page"), F.lit(None).cast("int").alias("nest"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    )
    marks = nested.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))).alias("bucket"), F.lit(None).cast("bigint").alias("row"), "hdepth", "hkey", "path",
        F.lit(None).cast(leveled.schema["page"].dataType).alias("page"), "nest", "rule", "verdict",
    )
    sweep = Window.partitionBy("bucket").orderBy("hkey", "path", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    slot = lambda d: F.last(F.when(F.col("nest") == d, F.struct("hkey", F.col("path").alias("prefix"), F.col("rule"), F.col("verdict"))), ignorenulls=True).over(sweep)
    swept = leveled.union(marks.select(leveled.columns)).select("bucket", "row", "hdepth", "hkey", "path", "page", *(slot(d).alias(f"slot{d}") for d in slots)).where("row is not null")
    active = [F.when((F.col(f"slot{d}.hkey") == F.col("hkey")) & F.startswith(F.col("path"), F.col(f"slot{d}.prefix")), F.col(f"slot{d}")) for d in reversed(slots)]
    best = F.coalesce(*active)
    found = swept.select("bucket", "row", "hdepth", "path", "page", F.when(F.col("hdepth") > 0, best).alias("best"))
    out = found.groupBy("bucket", "row").agg(
        F.max_by("page", F.when(F.col("hdepth") == 0, 1)).alias("page"), F.max_by("path", F.when(F.col("hdepth") == 0, 1)).alias("path"),
        F.max_by("best", F.when(F.col("best").isNotNull(), F.col("hdepth"))).alias("best"),
    )
    return out.select(F.col("page")[page_id].alias(page_id), F.col("page.host").alias("host"), "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def sql(rules: list[tuple[str, str, str]] = RULES, default: str = DEFAULT_VERDICT) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
with parts as (
  select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
hosts as (
  select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from parts),
split as (
  select row_number() over () as n, page_id, translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') as host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from hosts),
fits as (
  select s.n, r.host || r.path as rule, r.verdict,
         row_number() over (partition by s.n order by length(r.host) desc, length(r.path) desc) as k
  from split s join (values {values}) r(host, path, verdict)
    on (s.host = r.host or ends_with(s.host, '.' || r.host)) and starts_with(s.path, r.path))
select s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, '{default}') as verdict
from split s left join fits f on s.n = f.n and f.k = 1"""
