"""URL filtering by empirical-Bayes host reputation (operator 7); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: host, path, verdict of the given rules. Fixed values.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Second-level labels under which names are registered below two-letter domains. Fixed values.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first :// up to /, ?, # or the end, A-Z lower-cased; then up to ? or #. Both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)\A.*?://", ""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), upper, upper.lower())
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits as struct(rule, verdict), else null. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def registered_domain(host: Column) -> Column:
    """The last two labels of a host without user and port, or three where a two-letter domain has a second-level label; short names stand for themselves."""
    labels = F.split(F.regexp_replace(F.regexp_replace(host, r"(?s)\A.*@", ""), r":[0-9]*\z", ""), r"\.")
    n = F.size(labels)
    three = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL)
    return F.when(three, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(domain: Column) -> Column:
    """What follows the first label of a registered domain; a single label is its own suffix."""
    return F.when(F.instr(domain, ".") > 0, F.regexp_replace(domain, r"(?s)\A[^.]*\.", "")).otherwise(domain)


def _shrunk(children: DataFrame, parents: DataFrame, child: str, parent: str, floor: float, ceiling: float) -> tuple[DataFrame, DataFrame]:
    """Joins the parents' prior to the children and shrinks: alpha, beta and mean of the posterior; and the level's strength (one row).

    The strength of the prior (its alpha + beta) comes by the method of moments from the spread of all children's rates
    about their parents' means, between floor and ceiling. Both are written once, as the next level and the verdicts read them.
    """
    both = materialize(children.join(parents.select(F.col(parent), F.col("mean").alias("prior")), parent), f"{child}-rates")
    # E[(bad - n m)^2] = n m (1 - m) (1 + (n - 1) rho), strength = 1 / rho - 1
    expected = F.col("n") * F.col("prior") * (1 - F.col("prior"))
    moments = both.agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("prior"), 2) - expected).alias("over"),
        F.sum(expected * (F.col("n") - 1)).alias("base"),
    ).select(F.when((F.col("base") > 0) & (F.col("over") > 0), F.greatest(F.lit(floor), F.least(F.lit(ceiling), F.col("base") / F.col("over") - 1))).otherwise(F.lit(ceiling)).alias("strength"))
    moments = materialize(moments, f"{child}-strength")
    both = both.crossJoin(F.broadcast(moments))  # a single row
    alpha = F.col("strength") * F.col("prior") + F.col("bad")
    beta = F.col("strength") * (1 - F.col("prior")) + F.col("n") - F.col("bad")
    return materialize(both.select(child, parent, "n", "bad", alpha.alias("alpha"), beta.alias("beta"), (alpha / (alpha + beta)).alias("mean")), f"{child}-posterior"), moments


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    key_col: str = "doc_id",
    bad: Column | None = None,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    threshold: float | None = None,
    z: float = 0.6745,
    floor: float = 2.0,
    ceiling: float = 200.0,
) -> DataFrame:
    """A verdict for every page: the longest fitting rule's, else by the reputation of its host.

    Labelled outcomes (bad or not; those with a null are left out) are counted by host, registered domain and suffix, also
    those of pages that a rule decides. The overall rate (1 bad of 2 added) is the prior mean of suffixes, the
    posterior mean of a suffix that of its domains, and so on to the hosts; each level's prior strength is estimated
    from the data (see _shrunk). A host is blocked when the bound mean - z x deviation of its beta posterior is above the overall rate
    (or above a given threshold): with z = 0.6745, when it is worse than pages are at large with a probability of about three quarters. A level
    without spread beyond chance pulls its members to one mean, and then nothing is blocked. A host without any labelled page has its prior for a posterior: the mean of its domain, else of its
    suffix, else of all, with the strength of the hosts' level; so have nulls and urls without a host.

    Null urls have empty host and path; repeated page rows give repeated results, repeated outcomes count again; empty tables give empty
    results or verdicts from the overall prior; other columns are ignored. Hosts, not pages, meet in one group; the join back to pages is one that Spark can split by skew.
    """
    host, path = url_parts(pages[f"`{url_col}`"])
    base = pages.select(pages[f"`{id_col}`"].alias("page_id"), host.alias("host"), path.alias("path"))
    flag = (outcomes["toxic"] == 1) if bad is None else bad
    known = outcomes.select(outcomes[f"`{key_col}`"].alias("_key"), flag.cast("long").alias("bad")).where("bad is not null and _key is not null").groupBy("_key").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    sited = lambda x: x.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    # one row a host, whether it has outcomes or not
    counted = base.join(known, base["page_id"] == known["_key"], "left").groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    every_host = materialize(sited(counted), "hosts")
    hosts = every_host.where("n is not null")
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("top", F.lit(1))
    top = materialize(suffixes.agg(F.lit(1).alias("top"), ((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mean")), "overall")
    s, _ = _shrunk(suffixes, top, "suffix", "top", floor, ceiling)
    d, _ = _shrunk(domains, s, "domain", "suffix", floor, ceiling)
    h, strength = _shrunk(hosts.drop("suffix"), d, "host", "domain", floor, ceiling)
    own = h.select("host", "alpha", "beta", F.col("n").alias("of_n"), F.col("bad").alias("of_bad"))
    mean_of = lambda x, k: x.select(F.col(k), F.col("mean").alias(f"{k}_mean"))
    seen = every_host.join(own, "host", "left").join(mean_of(d, "domain"), "domain", "left").join(mean_of(s, "suffix"), "suffix", "left")
    seen = seen.crossJoin(F.broadcast(top.select(F.col("mean").alias("all_mean")))).crossJoin(F.broadcast(strength))  # single rows
    prior = F.coalesce("domain_mean", "suffix_mean", "all_mean")
    alpha, beta = F.coalesce("alpha", F.col("strength") * prior), F.coalesce("beta", F.col("strength") * (1 - prior))
    mean, total = alpha / (alpha + beta), alpha + beta
    bound = mean - z * F.sqrt(mean * (1 - mean) / (total + 1))
    seen = seen.select(
        F.col("host").alias("_host"), F.round("all_mean", 6).alias("overall"), F.round(mean, 6).alias("bad_rate"), F.round(bound, 6).alias("bad_bound"),
        F.coalesce("of_n", F.lit(0)).cast("long").alias("host_labels"), F.coalesce("of_bad", F.lit(0)).cast("long").alias("host_bad"),
    )
    judged = base.join(seen, base["host"] == seen["_host"], "left").withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    by_host = F.when(F.col("bad_bound") > (F.col("overall") if threshold is None else F.lit(threshold)), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), by_host).alias("verdict"), "bad_rate", "bad_bound", "host_labels", "host_bad")


#: The same in SQL, for a table `pages` with outcomes in `labels`.
ORACLE = r"""
WITH base AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM base)
), known AS (
  SELECT doc_id, count(*) AS n, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE toxic IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1
), named AS (
  SELECT host, CASE WHEN len(p) >= 3 AND length(p[-1]) = 2 AND p[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org')
                    THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain
  FROM (SELECT DISTINCT host, string_split(regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', ''), '.') AS p FROM split)
), sited AS (
  SELECT host, domain, CASE WHEN strpos(domain, '.') > 0 THEN substr(domain, strpos(domain, '.') + 1) ELSE domain END AS suffix FROM named
), hosts AS (
  SELECT host, domain, suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM split JOIN known ON page_id = doc_id JOIN sited USING (host) GROUP BY ALL
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
top AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM suffixes),
s0 AS (SELECT suffix, n, bad, mean AS prior FROM suffixes, top),
s1 AS (SELECT CASE WHEN sum(n * prior * (1 - prior) * (n - 1)) > 0 AND sum(pow(bad - n * prior, 2) - n * prior * (1 - prior)) > 0
         THEN greatest(2.0, least(200.0, sum(n * prior * (1 - prior) * (n - 1)) / sum(pow(bad - n * prior, 2) - n * prior * (1 - prior)) - 1)) ELSE 200.0 END AS k FROM s0),
s AS (SELECT suffix, k * prior + bad AS a, k * (1 - prior) + n - bad AS b, n, bad, (k * prior + bad) / (k * prior + bad + (k * (1 - prior) + n - bad)) AS mean FROM s0, s1),
d0 AS (SELECT domain, suffix, domains.n, domains.bad, mean AS prior FROM domains JOIN s USING (suffix)),
d1 AS (SELECT CASE WHEN sum(n * prior * (1 - prior) * (n - 1)) > 0 AND sum(pow(bad - n * prior, 2) - n * prior * (1 - prior)) > 0
         THEN greatest(2.0, least(200.0, sum(n * prior * (1 - prior) * (n - 1)) / sum(pow(bad - n * prior, 2) - n * prior * (1 - prior)) - 1)) ELSE 200.0 END AS k FROM d0),
d AS (SELECT domain, k * prior + bad AS a, k * (1 - prior) + n - bad AS b, n, bad, (k * prior + bad) / (k * prior + bad + (k * (1 - prior) + n - bad)) AS mean FROM d0, d1),
h0 AS (SELECT host, hosts.n, hosts.bad, mean AS prior FROM hosts JOIN d USING (domain)),
h1 AS (SELECT CASE WHEN sum(n * prior * (1 - prior) * (n - 1)) > 0 AND sum(pow(bad - n * prior, 2) - n * prior * (1 - prior)) > 0
         THEN greatest(2.0, least(200.0, sum(n * prior * (1 - prior) * (n - 1)) / sum(pow(bad - n * prior, 2) - n * prior * (1 - prior)) - 1)) ELSE 200.0 END AS k FROM h0),
h AS (SELECT host, k * prior + bad AS a, k * (1 - prior) + n - bad AS b, n, bad FROM h0, h1),
best AS (
  SELECT sited.host, coalesce(h.a, h1.k * coalesce(d.mean, s.mean, top.mean)) AS a, coalesce(h.b, h1.k * (1 - coalesce(d.mean, s.mean, top.mean))) AS b,
         coalesce(h.n, 0)::BIGINT AS host_labels, coalesce(h.bad, 0)::BIGINT AS host_bad
  FROM sited LEFT JOIN h ON sited.host = h.host LEFT JOIN d ON sited.domain = d.domain LEFT JOIN s ON sited.suffix = s.suffix CROSS JOIN top CROSS JOIN h1
), judged AS (
  SELECT host, host_labels, host_bad, (SELECT round(mean, 6) FROM top) AS overall, round(a / (a + b), 6) AS bad_rate, round(a / (a + b) - 0.6745 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)), 6) AS bad_bound FROM best
), ruled AS (
  SELECT *, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                 WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM split
)
SELECT page_id, ruled.host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN bad_bound > overall THEN 'block' ELSE 'allow' END AS verdict, bad_rate, bad_bound, host_labels, host_bad
FROM ruled JOIN judged USING (host)
"""
