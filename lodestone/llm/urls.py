"""URL filters: path rules first, then an empirical-Bayes reputation of the host.

Method.  Labelled pages give each host a number of outcomes and of bad ones.  Beta-binomial priors
shrink them level by level: the suffix's rate towards the global one, the registered domain's
towards its suffix, the host's towards its domain, each upper rate without the outcomes of the member
itself, which so count once.  The strength of each prior is a moment estimate
of the overdispersion among the level's members.  A page no rule decides is blocked if the lower
bound of its host's posterior bad rate (mean less ``z`` standard deviations) exceeds ``limit``, or
``lift`` times the global rate if that is less: the host is surely worse than pages are at large.

A host's suffix is the longest of ``suffixes`` that ends it, else its last label; its registered
domain has one label more.  Only counts by host are shuffled, combined before, and each level is made
once from the one below and stored; the join of hosts to pages is a plain equi join, which may be split
where one host has a large share of the pages.

Defined cases.  A null url, or one without ``://``, has an empty host and path; the empty host is
judged like any other.  Outcomes that are null are not counted; a host without outcomes takes its
domain's rate.  Repeated rows each get a result.  Extra columns are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import ascii_lower, stored, table

# Fixed values: (verdict, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# Public suffixes of two labels; a parameter, to be replaced by a full list where one is at hand.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
LIFT = 1.25


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(df: DataFrame, n: str, y: str, mean: str, name: str) -> DataFrame:
    """One row: the prior's strength from the overdispersion of y of n around mean."""
    v = F.col(mean) * (1 - F.col(mean))
    extra = F.sum(F.when(F.col(n) > 0, F.col(n) * F.pow(F.col(y) / F.col(n) - F.col(mean), 2) - v))
    rho = F.greatest(F.lit(1e-3), F.least(F.lit(0.9), F.coalesce(extra / F.nullif(F.sum(F.when(F.col(n) > 0, v * (F.col(n) - 1))), F.lit(0.0)), F.lit(0.5))))
    return df.agg((1 / rho - 1).alias(name))


def _levels(host: Column, suffixes: tuple[str, ...]) -> tuple[Column, Column]:
    """(registered domain, suffix)."""
    labels = F.split(host, r"\.")
    width = F.lit(1)
    for s in sorted(suffixes, key=lambda s: (s.count("."), s)):
        width = F.when((host == s) | host.endswith("." + s), F.lit(s.count(".") + 1)).otherwise(width)
    tail = lambda n: F.array_join(F.slice(labels, -F.least(n, F.size(labels)), F.least(n, F.size(labels))), ".")
    return tail(width + 1), tail(width)


def reputation(pages: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """host, n, bad, mean, sd of the posterior bad rate and overall, the global one, from pages(host, bad)."""
    hosts = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("y"))
    domain, suffix = _levels(F.col("host"), suffixes)
    hosts = stored(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("y").alias("dy")), "domains")
    ends = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dy").alias("sy"))
    top = domains.agg(((F.coalesce(F.sum("dy"), F.lit(0)) + 1) / (F.coalesce(F.sum("dn"), F.lit(0)) + 2)).alias("m0"))
    ends = stored(ends.crossJoin(F.broadcast(top)), "suffixes")  # top has one row, as all strengths have
    ends = ends.crossJoin(F.broadcast(_strength(ends, "sn", "sy", "m0", "k0")))
    # what a level adds to a prior is the outcomes of its other members
    rest = lambda y, n, k, m: (F.col(y[0]) - F.col(y[1]) + F.col(k) * F.col(m)) / (F.col(n[0]) - F.col(n[1]) + F.col(k))
    domains = stored(domains.join(ends, "suffix").withColumn("m1", rest(("sy", "dy"), ("sn", "dn"), "k0", "m0")), "domains")
    domains = domains.crossJoin(F.broadcast(_strength(domains, "dn", "dy", "m1", "k1"))).select("domain", "dn", "dy", "m0", "m1", "k1")
    hosts = stored(hosts.join(domains, "domain").withColumn("m2", rest(("dy", "y"), ("dn", "n"), "k1", "m1")), "hosts")
    hosts = hosts.crossJoin(F.broadcast(_strength(hosts, "n", "y", "m2", "k2")))
    a, b = F.col("y") + F.col("k2") * F.col("m2"), F.col("n") - F.col("y") + F.col("k2") * (1 - F.col("m2"))
    return hosts.select("host", "n", F.col("y").alias("bad"), (a / (a + b)).alias("mean"), F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1))).alias("sd"), F.col("m0").alias("overall"))


def judge(pages: DataFrame, outcomes: DataFrame, limit: float = 0.5, lift: float = LIFT, z: float = 1.645, rules: tuple[tuple[str, str, str], ...] = RULES, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict of pages(page_id, url), and what the host's posterior rests on: its labelled pages
    n and bad ones, its mean and lower bound.

    outcomes(doc_id, bad) label the document a page shows: the number that ends the url's path."""
    host, path = host_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    p = p.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    shown = F.regexp_extract("path", r"/(\d{1,18})(?:\.html?)?/?$", 1)
    labelled = p.select("host", F.when(shown != "", shown.cast("long")).alias("doc_id"))
    known = outcomes.where("doc_id is not null and bad is not null").groupBy("doc_id").agg(F.max("bad").cast("int").alias("bad"))
    rep = reputation(labelled.join(known, "doc_id", "left").select("host", "bad"), suffixes)
    got = p.join(rep.select("host", "n", "bad", "mean", (F.col("mean") - z * F.col("sd")).alias("bound"), "overall"), "host", "left")
    worse = F.round("bound", 9) > F.round(F.least(F.lit(limit), lift * F.col("overall")), 9)
    return got.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(worse, "block").otherwise("allow")).alias("verdict"), "n", "bad", F.round("mean", 9).alias("mean"), F.round("bound", 9).alias("bound"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    bad = labels.select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), bad)


def oracle() -> str:
    rules = " ".join(f"when (host = '{h}' or suffix(host, '.{h}')) and prefix(path, '{p}') then '{h + p}'" for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])))
    kinds = " ".join(f"when '{h + p}' then '{v}'" for v, h, p in RULES)
    long = " ".join(f"when host = '{x}' or suffix(host, '.{x}') then {x.count('.') + 1}" for x in sorted(SUFFIXES, key=lambda x: (-x.count("."), x)))
    k = lambda n, y, m, name, t: f"(select 1 / greatest(1e-3, least(0.9, coalesce(sum(case when {n} > 0 then {n} * pow({y} / {n} - {m}, 2) - {m} * (1 - {m}) end) / nullif(sum(case when {n} > 0 then {m} * (1 - {m}) * ({n} - 1) end), 0), 0.5))) - 1 from {t})"
    return f"""with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
b as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) bad from labels where doc_id is not null and (quality is not null or toxic is not null) group by 1),
h as (select host, count(bad)::double n, coalesce(sum(bad), 0)::double y from (select host, try_cast(nullif(regexp_extract(path, '/(\\d{{1,18}})(?:\\.html?)?/?$', 1), '') as bigint) doc_id from p) left join b using (doc_id) group by 1),
h1 as (select *, string_split(host, '.') a, case {long} else 1 end k from h), h2 as (select host, n, y, array_to_string(a[greatest(1, len(a) - k):], '.') domain, array_to_string(a[greatest(1, len(a) - k + 1):], '.') sfx from h1),
d as (select domain, sfx, sum(n) dn, sum(y) dy from h2 group by 1, 2), s as (select sfx, sum(dn) sn, sum(dy) sy from d group by 1),
s0 as (select *, (select (coalesce(sum(sy), 0) + 1) / (coalesce(sum(sn), 0) + 2) from s) m0 from s), s1 as (select *, {k('sn', 'sy', 'm0', 'k0', 's0')} k0 from s0),
d0 as (select d.*, (sy - dy + k0 * m0) / (sn - dn + k0) m1 from d join s1 using (sfx)), d1 as (select *, {k('dn', 'dy', 'm1', 'k1', 'd0')} k1 from d0),
e0 as (select h2.*, (dy - y + k1 * m1) / (dn - n + k1) m2 from h2 join d1 using (domain)), e1 as (select *, {k('n', 'y', 'm2', 'k2', 'e0')} k2 from e0),
e2 as (select host, n::bigint n, y::bigint y, y + k2 * m2 a, n - y + k2 * (1 - m2) b, (select max(m0) from s0) m0 from e1), e as (select host, m0, n, y, a / (a + b) mean, a / (a + b) - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) bound from e2),
r as (select *, case {rules} end rule from p)
select page_id, host, path, rule, coalesce(case rule {kinds} end, case when round(bound, 9) > round(least(0.5, {LIFT} * m0), 9) then 'block' else 'allow' end) verdict, n, y bad, round(mean, 9) mean, round(bound, 9) bound from r left join e using (host)"""
