"""URL filter: host rules first, then an empirical-Bayes reputation of the host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpace.llm.common import hinted, query, table

# The rules of the contract, as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRENGTH_MIN, STRENGTH_MAX = 2.0, 200.0  # bounds of a prior's weight, in pages
ROOT = (0.5, 0.5)  # Jeffreys prior of a bad outcome, above all suffixes
Z, BAD = 1.0, 0.5  # a host is blocked when its posterior mean less Z deviations is over BAD
BROADCAST_ROWS = 100_000  # suffix or domain rows sent to every task; more are shuffled
SHARE = 1000  # a host with over 1/SHARE of all pages is split when pages meet reputations; at most SHARE hosts are

# Common public suffixes of two labels.
SUFFIXES = ("ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn",
            "com.co", "com.hk", "com.mx", "com.my", "com.pe", "com.ph", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "go.jp", "gov.au",
            "gov.br", "gov.cn", "gov.in", "gov.uk", "govt.nz", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "or.jp", "or.kr", "org.au", "org.br", "org.cn",
            "org.nz", "org.uk", "org.za")
IP = r"^(\[.*|[0-9]+([.][0-9]+){3})$"


def host_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def levels(host: Column) -> list[Column]:
    """Registered domain and suffix, without a port. A suffix is one of SUFFIXES or the last label, a domain has one label more;
    an IP address is its own domain and suffix."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    listed = two.isin(*SUFFIXES)
    domain = F.when(bare.rlike(IP), bare).when(listed, F.substring_index(bare, ".", -3)).otherwise(two)
    suffix = F.when(bare.rlike(IP), bare).when(listed, two).otherwise(F.substring_index(bare, ".", -1))
    return [domain.alias("domain"), suffix.alias("suffix")]


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest rule that fits, else null. A rule fits its host and all its subdomains."""
    best = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = rule.partition("/")
        best = F.when(((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}"),
                      F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(best)
    return best


def _prior(children: DataFrame, parents: DataFrame, key: str, n_parents: int) -> DataFrame:
    """Beta prior (a, b) for the children of each ``key``: the parent's posterior mean, weighed by the moments of the children."""
    c = children.join(hinted(parents, n_parents, BROADCAST_ROWS), key)
    rate, m = F.col("bad") / F.col("n"), F.col("mean")
    g = c.groupBy(key, "mean").agg(
        F.sum(F.col("n") * (rate - m) * (rate - m)).alias("ss"), F.sum("n").alias("n"), F.sum(F.lit(1)).alias("k"))
    # between-child variance of a beta-binomial, as ss = sum n (rate - m)^2 is about k m(1-m) + (n - k) rho m(1-m)
    v = m * (1 - m)
    rho = F.when(F.col("n") > F.col("k"), (F.col("ss") - F.col("k") * v) / ((F.col("n") - F.col("k")) * v))
    s = F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(STRENGTH_MIN)), F.lit(STRENGTH_MAX))).otherwise(STRENGTH_MAX)
    return g.select(key, (m * s).alias("a"), ((1 - m) * s).alias("b"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior (a, b) of a bad outcome per host, from rows (host, bad 0/1).

    Outcomes are counted map-side per host, so a host of any size sends one row per task. Suffixes are shrunk to ROOT,
    domains to their suffix, hosts to their domain.
    """
    hosts = (outcomes.where("bad is not null and host is not null and host <> ''").groupBy("host")
             .agg(F.sum(F.lit(1)).cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad"))
             .select("host", *levels(F.col("host")), "n", "bad"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n_suffixes, n_domains = suffixes.count(), domains.count()
    mean = (F.col("bad") + ROOT[0]) / (F.col("n") + sum(ROOT))
    suffix_mean = suffixes.select("suffix", mean.alias("mean"))
    prior = _prior(domains.select("suffix", "n", "bad"), suffix_mean, "suffix", n_suffixes)
    domain_mean = domains.join(hinted(prior, n_suffixes, BROADCAST_ROWS), "suffix").select(
        "domain", ((F.col("bad") + F.col("a")) / (F.col("n") + F.col("a") + F.col("b"))).alias("mean"))
    prior = _prior(hosts.select("domain", "n", "bad"), domain_mean, "domain", n_domains)
    return hosts.join(hinted(prior, n_domains, BROADCAST_ROWS), "domain").select(
        "host", (F.col("bad") + F.col("a")).alias("a"), (F.col("n") - F.col("bad") + F.col("b")).alias("b"))


def bound(a: Column, b: Column, z: float = Z) -> Column:
    """Lower bound of a Beta(a, b): its mean less ``z`` standard deviations."""
    return a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))


def meet(p: DataFrame, rep: DataFrame) -> DataFrame:
    """``p`` with the columns of ``rep`` (one row per host); pages of a host with over 1/SHARE of all go to several tasks.

    At most SHARE hosts hold so much, so the table of them is small whatever the input. A page's part is its place in the scan.
    """
    counts = p.groupBy("host").agg(F.count(F.lit(1)).alias("_n"))  # map-side: a row per host and task
    total = p.count()
    hot = F.broadcast(counts.where(F.col("_n") * SHARE > total).select("host", F.ceil(F.col("_n") * SHARE / F.lit(max(total, 1))).alias("_meet_parts")))
    parts = F.coalesce("_meet_parts", F.lit(1).cast("bigint"))
    pages = p.withColumn("_meet_at", F.monotonically_increasing_id()).join(hot, "host", "left").withColumn("_meet_part", F.pmod("_meet_at", parts)).drop("_meet_at", "_meet_parts")
    copies = rep.join(hot, "host", "left").withColumn("_meet_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_meet_parts")
    return pages.join(copies, ["host", "_meet_part"], "left").drop("_meet_part")


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = Z, bad: float = BAD) -> DataFrame:
    """``pages`` with host, path, rule, verdict and bad_bound; clashing columns are replaced.

    ``outcomes`` has page_id and bad (0, 1 or null: no outcome). Verdict: the longest rule that fits, else block if the
    host's posterior bound is over ``bad``, else allow. A url that is null or has no ``://`` has empty host and path
    and, like a host without outcomes, bound null: allow. Repeated pages are each judged; outcomes of a repeated page_id count
    once, by their mean, rounded up. Tables may be empty.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "bad_bound")]
    url = F.col("url")
    p = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"))
    p = p.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    once = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.ceil(F.avg("bad")).alias("bad"))
    rep = reputation(p.select("page_id", "host").distinct().join(once, "page_id").select("host", "bad"))
    rep = rep.select("host", bound(F.col("a"), F.col("b"), z).alias("bad_bound"))
    j = meet(p, rep).withColumn("_r", ruled(F.col("host"), F.col("path"), rules))
    return j.select(*keep, "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(
        F.col("_r.action"), F.when(F.col("bad_bound") > bad, "block").otherwise("allow")).alias("verdict"), "bad_bound")


def label_outcomes(labels: DataFrame) -> DataFrame:
    """Outcomes of the pages that ``labels`` covers, matching page_id to doc_id: bad where quality is 0 or toxic is 1."""
    return labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0).alias("bad"))


SQL = r"""
with sfx(two) as (values {SUFFIXES}),
p as (
  select page_id,
    case when contains(url, '://') then translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when contains(url, '://') then regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
lab as (select doc_id as page_id, ceil(avg(case when quality = 0 or toxic = 1 then 1 when quality is not null then 0 end)) as bad from labels where doc_id is not null group by 1),
hh as (select host, cast(count(*) as double) as n, cast(sum(bad) as double) as bad, regexp_replace(host, ':[0-9]*$', '') as bare
      from (select distinct page_id, host from p) join lab using (page_id) where bad is not null and host <> '' group by 1),
hl as (select *, regexp_matches(bare, '^(\[.*|[0-9]+([.][0-9]+){3})$') as ip, string_split(bare, '.') as labels from hh),
hs as (select *, array_to_string(labels[-2:], '.') as two, array_to_string(labels[-2:], '.') in (select two from sfx) as listed from hl),
h as (select host, n, bad, case when ip then bare when listed then array_to_string(labels[-3:], '.') else two end as domain,
        case when ip then bare when listed then two else labels[-1] end as suffix from hs),
d as (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by 1, 2),
s as (select suffix, (sum(bad) + 0.5e0) / (sum(n) + 1e0) as m from d group by 1),
sg as (select suffix, m, sum(n * (bad / n - m) * (bad / n - m)) as ss, sum(n) as n, count(*) as k from d join s using (suffix) group by 1, 2),
sr as (select suffix, m, case when n > k then (ss - k * m * (1 - m)) / ((n - k) * m * (1 - m)) end as rho from sg),
sp as (select suffix, m, case when rho > 0 then least(greatest(1 / rho - 1, 2e0), 200e0) else 200e0 end as w from sr),
dm as (select domain, (bad + m * w) / (n + w) as m from d join sp using (suffix)),
dg as (select domain, m, sum(n * (bad / n - m) * (bad / n - m)) as ss, sum(n) as n, count(*) as k from h join dm using (domain) group by 1, 2),
dr as (select domain, m, case when n > k then (ss - k * m * (1 - m)) / ((n - k) * m * (1 - m)) end as rho from dg),
dp as (select domain, m, case when rho > 0 then least(greatest(1 / rho - 1, 2e0), 200e0) else 200e0 end as w from dr),
hp as (select host, bad + m * w as a, n - bad + (1 - m) * w as b from h join dp using (domain)),
rep as (select host, a / (a + b) - sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bad_bound from hp),
r as (
  select page_id, host, path,
    case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
         when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
         when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
         when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
  from p)
select page_id, host, path, rule,
  case rule when 'net/' then 'block' when 'example.net/en/' then 'allow' when 'example.com/de/' then 'block' when 'org/fr/' then 'allow'
       else case when bad_bound > 0.5 then 'block' else 'allow' end end as verdict
from r left join rep using (host)
""".replace("{SUFFIXES}", ", ".join(f"('{x}')" for x in SUFFIXES))


@query("op6_url_reputation", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, label_outcomes(table(spark, sf_dir, "labels"))).drop("url", "bad_bound")
