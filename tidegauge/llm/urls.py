"""Operator 1, URL filters: a temporal join of captures with dated list entries.

Entries become validity intervals per list and pattern; the as-of join finds, for
every capture, the entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

_FAR = (1 << 62) - 1


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, verdict, valid_from, valid_to): from each ``add`` to the
    next entry for its list, kind and pattern, the end not included. Of entries at
    one time the removal counts last; repeated rows make empty intervals, which go.
    Entries with a null kind, pattern, action or time are void."""
    valid = entries.where("kind is not null and pattern is not null and action in ('add', 'remove') and listed_at is not null")
    w = Window.partitionBy("list", "kind", "pattern").orderBy("listed_at", "action", "verdict")
    out = valid.select("list", "kind", F.lower("pattern").alias("pattern"), "verdict", "action", F.col("listed_at").cast("long").alias("listed_at"))
    out = out.withColumn("valid_to", F.coalesce(F.lead("listed_at").over(w), F.lit(_FAR)))
    return out.where("action = 'add' and listed_at < valid_to").select("list", "kind", "pattern", "verdict", F.col("listed_at").alias("valid_from"), "valid_to")


def temporal_list_join(captures: DataFrame, entries: DataFrame, bin_width: int = 30) -> DataFrame:
    """``captures`` (url, fetched_at, any others) with ``n_active``, ``decided_by``,
    ``verdict`` and ``blocked`` in place of such columns.

    ``entries``: (list, kind, pattern, verdict, action, listed_at); kind ``domain``
    matches the pattern's host and all below it, ``prefix`` matches host/segment/...
    at segment ends; patterns and hosts are compared in lower case, paths too.
    Times are whole numbers. Of the entries active at ``fetched_at`` the longest
    pattern decides, ``block`` before ``allow`` at equal length, then the pattern.
    A null or unparsable url or a null time matches nothing (n_active 0, not
    blocked). Repeated captures each get their row; empty tables are fine.

    Scale: captures are reduced to distinct (url, time) pairs, and pairs meet
    intervals by kind, pattern and time bin, so a hot host is spread over the bins;
    what is still skewed is split by the adaptive skew join. Intervals reach from
    bin to bin up to the last capture only. Nothing is broadcast unless Spark has
    measured it to be small.
    """
    added = ("n_active", "decided_by", "verdict", "blocked")
    out = captures.select(*(c for c in captures.columns if c not in added))
    pairs = out.select("url", F.col("fetched_at").cast("long").alias("t")).where("url is not null and t is not null").distinct()
    pairs = pairs.withColumn("host", host_of(F.col("url"))).where("host <> ''").withColumn("b", F.floor(F.col("t") / bin_width))
    labels, segments = F.split("host", r"\."), F.filter(F.split(F.lower(path_of(F.col("url"))), "/"), lambda x: x != "")
    pairs = pairs.withColumn("labels", labels).withColumn("segments", segments)
    n, m = F.size("labels"), F.size("segments")
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice("labels", i, n), ".").alias("pattern")))
    prefixes = F.transform(F.sequence(F.lit(0), m), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", F.col("host"), F.slice("segments", 1, i)).alias("pattern")))
    keys = pairs.select("url", "t", "b", F.explode(F.concat(domains, prefixes)).alias("key")).select("url", "t", "b", "key.kind", "key.pattern")
    last = pairs.agg(F.max("b").alias("last_bin"), F.min("b").alias("first_bin")).first()
    spans = intervals(entries)
    if last.last_bin is not None:
        low = F.greatest(F.floor(F.col("valid_from") / bin_width), F.lit(last.first_bin))
        high = F.least(F.floor((F.col("valid_to") - 1) / bin_width), F.lit(last.last_bin))
        spans = spans.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("b", F.explode(F.sequence("low", "high"))).drop("low", "high")
    else:
        spans = spans.withColumn("b", F.lit(0).cast("long")).where(F.lit(False))
    hits = keys.join(spans, ["kind", "pattern", "b"]).where("t >= valid_from and t < valid_to")
    best = F.max(F.struct(F.length("pattern"), (F.col("verdict") == "block").alias("blocks"), "pattern", "verdict"))
    verdicts = hits.groupBy("url", "t").agg(F.count("*").alias("n"), best.alias("best")).select(F.col("url").alias("u"), F.col("t").alias("at"), "n", "best")
    joined = out.join(verdicts, (F.col("url") == F.col("u")) & (F.col("fetched_at").cast("long") == F.col("at")), "left")
    return joined.select(
        *out.columns, F.coalesce("n", F.lit(0)).cast("long").alias("n_active"), F.col("best.pattern").alias("decided_by"), F.col("best.verdict").alias("verdict"),
        F.coalesce(F.col("best.verdict") == "block", F.lit(False)).alias("blocked"),
    )


# --- the registered query --------------------------------------------------


def _number(x: str) -> Column:
    return F.conv(F.substring(F.md5(F.col(x)), 1, 6), 16, 10).cast("long")


def dated_entries(pages: DataFrame) -> DataFrame:
    """A stand-in for published lists, made by rule from the table's own hosts: a
    third of the hosts is blocked, freed and blocked again, half of the parent
    domains is blocked late, and a quarter of the first path segments is allowed
    for a while."""
    urls = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    hosts = urls.select(F.col("host").alias("pattern")).distinct().withColumn("k", _number("pattern")).where("k % 3 = 0")

    def event(action: str, at: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), at.cast("long").alias("at"))

    k = F.col("k") % 200
    dates = F.explode(F.array(event("add", k), event("remove", k + 60), event("add", k + 120)))
    first = hosts.select(F.lit("hosts").alias("list"), F.lit("domain").alias("kind"), "pattern", F.lit("block").alias("verdict"), dates.alias("e")).select("list", "kind", "pattern", "verdict", "e.action", F.col("e.at").alias("listed_at"))
    parents = urls.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("pattern")).where("pattern <> ''").distinct().where(_number("pattern") % 2 == 0)
    second = parents.select(F.lit("parents"), F.lit("domain"), "pattern", F.lit("block"), F.lit("add"), F.lit(250).cast("long"))
    paths = urls.select(F.concat("host", F.lit("/"), F.lower(F.regexp_extract("path", "^/([^/]+)", 1))).alias("pattern")).where("pattern not like '%/'").distinct().where(_number("pattern") % 4 == 0)
    dates = F.explode(F.array(event("add", F.lit(30)), event("remove", F.lit(300))))
    third = paths.select(F.lit("paths"), F.lit("prefix"), "pattern", F.lit("allow"), dates.alias("e")).select("paths", "prefix", "pattern", "allow", "e.action", "e.at")
    return first.union(second).union(third)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture; its fetch day is a rule of its id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.pmod(F.col("page_id") * 37, F.lit(360)))
    return temporal_list_join(captures, dated_entries(pages))


OP1_SQL = r"""
with captures as (select page_id, url, ((page_id * 37) % 360)::bigint as fetched_at,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) as path from pages),
numbered as (select distinct host as pattern, ('0x' || substr(md5(host), 1, 6))::bigint as k from captures where host <> ''),
parents as (select distinct regexp_extract(host, '([^.]+\.[^.]+)$', 1) as pattern from captures),
paths as (select distinct host || '/' || lower(regexp_extract(path, '^/([^/]+)', 1)) as pattern from captures where host <> ''),
spans as (
  select 'hosts' as list, 'domain' as kind, pattern, 'block' as verdict, k % 200 as valid_from, k % 200 + 60 as valid_to from numbered where k % 3 = 0
  union all select 'hosts', 'domain', pattern, 'block', k % 200 + 120, 1000000 from numbered where k % 3 = 0
  union all select 'parents', 'domain', pattern, 'block', 250, 1000000 from parents where pattern <> '' and ('0x' || substr(md5(pattern), 1, 6))::bigint % 2 = 0
  union all select 'paths', 'prefix', pattern, 'allow', 30, 300 from paths where pattern not like '%/' and ('0x' || substr(md5(pattern), 1, 6))::bigint % 4 = 0),
hits as (select c.page_id, s.pattern, s.verdict from captures c join spans s on c.fetched_at >= s.valid_from and c.fetched_at < s.valid_to
  and case when s.kind = 'domain' then c.host = s.pattern or ends_with(c.host, '.' || s.pattern)
      else c.host || lower(regexp_replace(rtrim(c.path, '/'), '/+', '/', 'g')) || '/' like s.pattern || '/%' end),
ranked as (select *, row_number() over (partition by page_id order by length(pattern) desc, verdict = 'block' desc, pattern desc) as r, count(*) over (partition by page_id) as n from hits)
select c.page_id, c.url, c.fetched_at, coalesce(r.n, 0)::bigint as n_active, r.pattern as decided_by, r.verdict, coalesce(r.verdict = 'block', false) as blocked
from captures c left join ranked r on r.page_id = c.page_id and r.r = 1"""
