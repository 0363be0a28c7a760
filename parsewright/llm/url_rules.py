"""URL filters (operator 10) [DataFrame functions only]: rules, and empirical-Bayes host reputation for the rest.

Labelled page outcomes (good or bad) are counted for each host, registered domain and suffix. The share of good outcomes
is shrunk level by level through beta-binomial priors: the corpus share is the suffix's prior mean, the suffix's posterior
mean the domain's, the domain's the host's. Each level's prior strength is fitted by the method of moments over the units
of that level, between ``weakest`` and ``strongest``. A host is allowed if its posterior says with at least
``confidence`` that its share of good pages is ``least`` or more, that is, if the lower quantile of its beta posterior
reaches ``least``; the beta integral is summed on a grid in logit space, in SQL functions.
Counts are pre-aggregated before the shuffle, and every host's verdict is one row, so a host of a third of all pages
only meets in counts; hosts with more than a thousandth of the pages are joined by a broadcast of a thousand rows at most.

Outcomes. Rules say what to do with a path, not what a host is worth, and no table labels pages. So a page's outcome is
learned from labelled documents, unless ``outcomes`` are given: each word or mark has log-odds of good against bad documents
(good: of quality and not toxic), drawn towards zero by ``shrink`` standard deviations, and a page is good if those of the
distinct words and marks of its visible text outside links and those of all documents don't sum up below zero. At most about ``max_labelled`` documents
are learned from, and a word counts if a thousandth of them has it, three at least. A page without html has no outcome.

A host's name is what follows a user's name and precedes a port. Its suffix is one of ``SUFFIXES`` or its last label; its
registered domain has one label more.

Rules of the form host/path: a rule fits its host and all subdomains if the url's path starts with the rule's; the
longest fitting rule wins.

Defined results: a null url, or one without ``://``, has empty host and path and no rule, and the empty host is judged
like any other; a host without outcomes is judged by the prior that its domain, suffix or the corpus gives it; without
any outcome the prior share is one half; a page without telling words is as most documents are, and good if nothing was learned; a posterior that reaches the confidence exactly allows, and of rules of equal
length the greater in text order wins; very long urls and pages are read whole; repeated rows each give a row; extra
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graphs

#: The given rules: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first :// up to /, ?, # or end, A-Z lower-cased; then up to ? or # or end. Both empty if there is none."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict); null if none does. Few rules: one expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


#: Suffixes of two labels under which names are registered; any other suffix is the last label.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx",
    "com.sg", "com.tr", "com.tw", "com.ua", "edu.au", "go.jp", "gov.au", "gov.uk", "ne.jp", "net.au", "net.br", "net.nz", "or.jp", "org.au", "org.br",
    "org.nz", "org.uk", "org.za",
)

#: What is no visible text outside links; then what is markup. The same in Java's and DuckDB's expressions.
UNSEEN = r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<head.*?</head>|<a[ >].*?</a>"
MARKUP, TOKEN = r"<[^>]*>", r"\p{L}+|[^\p{L}\p{N}\x00-\x20]"


def name_of(host: Column) -> Column:
    """The host without a user's name and a port."""
    return F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*$", "")


def suffix_of(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


SHRINK = 2.5  # standard deviations


def tokens(text: Column) -> Column:
    """The distinct words, A-Z lower-cased, and marks of a text."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TOKEN), F.lit(0)))


def visible(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, UNSEEN, " "), MARKUP, " ")


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, shrink: float = SHRINK) -> DataFrame:
    """(token, weight): log-odds of the tokens that tell good documents from bad ones, and under the empty token of all documents."""
    of = lambda c, missing: F.coalesce(F.col(c).cast("int"), F.lit(missing))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min(of("quality", 1)) * (1 - F.max(of("toxic", 0)))).alias("good"))
    n = known.count()
    if n > max_labelled:
        known = known.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(10)), F.lit(1 << 20)) < int(max_labelled / n * (1 << 20)))
    shared = common.Shared(docs.sparkSession)
    seen = common.columns(docs, "doc_id", "text").join(F.broadcast(known), "doc_id")  # about max_labelled rows
    seen = shared.keep(seen.filter("text IS NOT NULL").select("good", tokens(F.col("text")).alias("t")), "labelled")
    good, bad = seen.agg(F.coalesce(F.sum("good"), F.lit(0)), F.count(F.lit(1)) - F.coalesce(F.sum("good"), F.lit(0))).first()
    g, b = F.col("g") + 0.5, F.col("b") + 0.5
    delta = F.log(g / F.lit(good + 1.0)) - F.log(b / F.lit(bad + 1.0))
    sure = F.abs(delta) - F.lit(shrink) * F.sqrt(1 / g + 1 / b)
    counts = seen.select("good", F.explode("t").alias("token")).groupBy("token").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b"))
    telling = counts.filter((F.col("g") + F.col("b") >= max(3.0, (good + bad) / 1000)) & (sure > 0))
    prior = docs.sparkSession.range(1).select(F.lit("").alias("token"), F.log(F.lit((good + 1.0) / (bad + 1.0))).alias("weight"))
    return shared.keep(telling.select("token", F.when(delta > 0, sure).otherwise(-sure).alias("weight")).unionByName(prior), "telling")


def outcomes_of(pages: DataFrame, telling: DataFrame) -> DataFrame:
    """(name, good) of every page (name, html) with html; the weights of a page are summed where its tokens are."""
    rows = pages.filter("html IS NOT NULL").select("name", F.monotonically_increasing_id().alias("row"), F.concat(F.array(F.lit("")), tokens(visible(F.col("html")))).alias("t"))
    rows = rows.select("name", "row", F.explode("t").alias("token"))  # numbered before, as a number belongs to a page
    return rows.join(telling, "token", "left").groupBy("row", "name").agg((F.coalesce(F.sum("weight"), F.lit(0.0)) >= 0).cast("int").alias("good")).select("name", "good")


def agreement(docs: DataFrame, labels: DataFrame, held: Column) -> DataFrame:
    """(good, called_good, n) of the documents under the condition ``held`` on doc_id, of which nothing was learned."""
    telling = learn(docs, labels.filter(~held))
    true = labels.filter(held).select("doc_id", (F.col("quality") * (1 - F.col("toxic"))).alias("true"))
    rows = common.columns(docs, "doc_id", "text").join(F.broadcast(true), "doc_id")  # held-out labels; for reports
    called = outcomes_of(rows.select(F.struct("doc_id", "true").alias("name"), F.col("text").alias("html")), telling)
    return called.groupBy(F.col("name.true").alias("good"), F.col("good").alias("called_good")).count()


def strength(units: DataFrame, weakest: float, strongest: float) -> float:
    """Method of moments over units (n, good, m): the prior strength under which good/n scatters around m as it does."""
    p = F.col("good") / F.col("n")
    r = units.filter("n > 1").agg(
        F.sum(F.col("n") * F.pow(p - F.col("m"), 2)).alias("s"),
        F.sum(F.col("m") * (1 - F.col("m"))).alias("b"),
        F.sum((F.col("n") - 1) * F.col("m") * (1 - F.col("m"))).alias("w"),
    ).first()
    if not r["w"] or r["w"] <= 0:
        return weakest
    rho = (r["s"] - r["b"]) / r["w"]  # the intra-unit correlation, 1 / (strength + 1)
    return strongest if rho <= 1 / (strongest + 1) else max(weakest, 1 / rho - 1)


STEPS = 512  # of the grid on which a posterior is summed


def probability_above(a: Column, b: Column, least: float) -> Column:
    """P(X >= least) of a beta posterior, by midpoint sums over u = logit(X), whose density has no poles.

    The grid reaches to where nothing is left on either side, and a step ends at logit(least).
    """
    at = math.log(least / (1 - least))
    top, wide = F.log(a / b), 8 * F.sqrt((a + b) / (a * b))
    low, high = top - F.greatest(wide, 40 / a), top + F.greatest(wide, 40 / b)
    h = (high - low) / STEPS
    soft = lambda u: F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u)))
    log_density = lambda u: -a * soft(-u) - b * soft(u)
    grid = F.sequence(F.floor((low - at) / h), F.ceil((high - at) / h))
    mass = F.transform(grid, lambda j: F.struct((j >= 0).alias("above"), F.exp(log_density(at + (j + 0.5) * h) - log_density(top)).alias("p")))
    sums = F.aggregate(mass, F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("above")), lambda s, x: F.struct((s["all"] + x["p"]).alias("all"), (s["above"] + F.when(x["above"], x["p"]).otherwise(0.0)).alias("above")))
    return sums["above"] / sums["all"]


def reputation(outcomes: DataFrame, names: DataFrame, weakest: float = 2.0, strongest: float = 1000.0) -> DataFrame:
    """For every row of ``names`` (name, ...) the posterior beta's ``a`` and ``b``, from ``outcomes`` (name, good 0/1)."""
    hosts = outcomes.filter(F.col("good").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
    shared = common.Shared(outcomes.sparkSession)
    hosts = shared.keep(hosts.withColumn("domain", domain_of(F.col("name"))).withColumn("suffix", suffix_of(F.col("name"))), "hosts")
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    share = (total[1] + 1) / (total[0] + 2) if total[0] else 0.5

    def level(units: DataFrame) -> DataFrame:
        s = strength(units, weakest, strongest)
        return units.withColumn("mean", (F.col("good") + F.lit(s) * F.col("m")) / (F.col("n") + F.lit(s)))

    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    suffixes = shared.keep(level(hosts.groupBy("suffix").agg(*sums).withColumn("m", F.lit(share))).select("suffix", "mean"), "suffixes")
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes.withColumnRenamed("mean", "m"), "suffix")
    domains = shared.keep(level(domains).select("domain", "mean"), "domains")
    s = strength(hosts.join(domains.withColumnRenamed("mean", "m"), "domain"), weakest, strongest)
    every = names.withColumn("domain", domain_of(F.col("name"))).withColumn("suffix", suffix_of(F.col("name")))
    every = every.join(hosts.select("name", "n", "good"), "name", "left").join(domains.withColumnRenamed("mean", "_d"), "domain", "left").join(suffixes.withColumnRenamed("mean", "_s"), "suffix", "left")
    m, n, good = F.coalesce("_d", "_s", F.lit(share)), F.coalesce("n", F.lit(0)), F.coalesce("good", F.lit(0))
    return every.select(*names.columns, (good + F.lit(s) * m).alias("a"), (n - good + F.lit(s) * (1 - m)).alias("b"))


def judge(pages: DataFrame, outcomes: DataFrame | None = None, rules=RULES, least: float = 0.5, confidence: float = 0.9, telling: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and bound (how sure the host's posterior is of ``least``; null under a rule).

    ``outcomes`` (host, good) are given, or read from the pages' ``html`` by ``telling`` (as ``learn`` makes it), or there are none.
    """
    host, path = host_and_path(F.col("url"))
    html = F.col("html") if telling is not None and "html" in pages.columns else F.lit(None)
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), html.cast("string").alias("html")).select("page_id", host.alias("host"), path.alias("path"), "html").withColumn("name", name_of(F.col("host")))
    if outcomes is not None:
        outcomes = outcomes.select(name_of(F.translate(F.col("host"), UPPER, LOWER)).alias("name"), "good")
    elif telling is not None:
        outcomes = outcomes_of(pages, telling)
    else:
        outcomes = pages.select("name", F.lit(None).cast("int").alias("good"))
    pages = pages.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "name", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))
    seen = pages.groupBy("name").agg(F.count(F.lit(1)).alias("pages"))  # a row for each host
    judged = reputation(outcomes, seen).select("name", "pages", probability_above(F.col("a"), F.col("b"), least).alias("bound"))
    judged = common.Shared(pages.sparkSession).keep(judged, "judged")
    total = judged.agg(F.sum("pages")).first()[0] or 0
    out = graphs.spread_join(pages, judged, ["name"], "pages", ["bound"], total)
    verdict = F.coalesce("ruled", F.when(F.col("bound") >= confidence, F.lit("allow")).otherwise(F.lit("block")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("ruled").isNull(), F.col("bound")).alias("bound"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page's url: the rules', else that of its host's reputation over all pages."""
    telling = learn(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "labels"))
    return judge(common.load(spark, sf_dir, "pages"), telling=telling).drop("bound")


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _tokens(text: str) -> str:
    return f"list_distinct(regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{TOKEN}'))"


#: Method of moments, as ``strength`` has it.
_STRENGTH = """SELECT CASE WHEN coalesce(w, 0) <= 0 THEN 2.0 WHEN (s - b) / w <= 1 / 1001.0 THEN 1000.0 ELSE greatest(2.0, w / (s - b) - 1) END AS k
       FROM (SELECT sum(n * power(good / n - m, 2)) AS s, sum(m * (1 - m)) AS b, sum((n - 1) * m * (1 - m)) AS w FROM {units} WHERE n > 1)"""

OP10_SQL = rf"""
WITH p AS (
  SELECT page_id, html, strpos(url, '://') AS pos, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
s AS (
  SELECT page_id, html,
         CASE WHEN pos > 0 THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN pos > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM p),
rules(rule, rhost, rpath, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fit AS (
  SELECT s.page_id, s.host, s.path, s.html, regexp_replace(string_split(s.host, '@')[-1], ':[0-9]*$', '') AS name, r.rule, r.verdict
  FROM s, LATERAL (SELECT rule, verdict FROM rules
    WHERE (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)
    UNION ALL SELECT NULL, NULL ORDER BY length(rule) DESC NULLS LAST LIMIT 1) r),
known AS (SELECT doc_id, min(coalesce(quality, 1)) * (1 - max(coalesce(toxic, 0))) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
seen AS (SELECT good, {_tokens("text")} AS t FROM documents JOIN known USING (doc_id) WHERE text IS NOT NULL),
sizes AS (SELECT coalesce(sum(good), 0)::DOUBLE AS good, count(*) - coalesce(sum(good), 0)::DOUBLE AS bad FROM seen),
counts AS (SELECT token, sum(good) + 0.5::DOUBLE AS g, sum(1 - good) + 0.5::DOUBLE AS b FROM (SELECT good, unnest(t) AS token FROM seen) GROUP BY token),
odds AS (SELECT token, g, b, good, bad, ln(g / (good + 1)) - ln(b / (bad + 1)) AS delta FROM counts, sizes),
telling AS (SELECT token, sign(delta) * (abs(delta) - {SHRINK}::DOUBLE * sqrt(1 / g + 1 / b)) AS weight FROM odds
            WHERE g + b - 1 >= greatest(3, (good + bad) / 1000) AND abs(delta) > {SHRINK}::DOUBLE * sqrt(1 / g + 1 / b)),
rows AS (SELECT *, row_number() OVER () AS row FROM fit WHERE html IS NOT NULL),
words AS (SELECT row, unnest({_tokens(f"regexp_replace(regexp_replace(html, '{UNSEEN}', ' ', 'g'), '{MARKUP}', ' ', 'g')")}) AS token FROM rows),
sums AS (SELECT row, sum(weight) AS s FROM words JOIN telling USING (token) GROUP BY row),
o AS (SELECT name, CASE WHEN coalesce(s, 0) + ln((good + 1) / (bad + 1)) >= 0 THEN 1 ELSE 0 END AS good FROM rows LEFT JOIN sums USING (row), sizes),
parts AS (SELECT DISTINCT name, string_split(name, '.') AS l FROM fit),
units AS (
  SELECT name, CASE WHEN two IN ({_list(SUFFIXES)}) THEN array_to_string(l[-3:], '.') ELSE two END AS domain, CASE WHEN two IN ({_list(SUFFIXES)}) THEN two ELSE l[-1] END AS suffix
  FROM (SELECT name, l, array_to_string(l[-2:], '.') AS two FROM parts)),
h AS (SELECT name, domain, suffix, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS good FROM o JOIN units USING (name) GROUP BY ALL),
share AS (SELECT CASE WHEN count(*) = 0 THEN 0.5 ELSE (sum(good) + 1) / (sum(n) + 2) END AS m FROM h),
xm AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(m) AS m FROM h, share GROUP BY suffix),
xk AS ({_STRENGTH.format(units="xm")}),
xp AS (SELECT suffix, (good + k * m) / (n + k) AS mean FROM xm, xk),
dm AS (SELECT domain, sum(n) AS n, sum(good) AS good, any_value(xp.mean) AS m FROM h JOIN xp USING (suffix) GROUP BY domain),
dk AS ({_STRENGTH.format(units="dm")}),
dp AS (SELECT domain, (good + k * m) / (n + k) AS mean FROM dm, dk),
hm AS (SELECT h.*, dp.mean AS m FROM h JOIN dp USING (domain)),
hk AS ({_STRENGTH.format(units="hm")}),
ab AS (
  SELECT name, coalesce(good, 0) + k * m AS a, coalesce(n, 0) - coalesce(good, 0) + k * (1 - m) AS b
  FROM (SELECT units.name, h.n, h.good, hk.k, coalesce(dp.mean, xp.mean, share.m) AS m
        FROM units CROSS JOIN share CROSS JOIN hk LEFT JOIN h ON h.name = units.name LEFT JOIN dp ON dp.domain = units.domain LEFT JOIN xp ON xp.suffix = units.suffix)),
grid AS (SELECT name, a, b, ln(a / b) AS t, ln(a / b) - greatest(8 * sqrt((a + b) / (a * b)), 40 / a) AS low, ln(a / b) + greatest(8 * sqrt((a + b) / (a * b)), 40 / b) AS high FROM ab),
dense AS (
  SELECT name, j >= 0 AS above, -a * (greatest(-u, 0) + ln(1 + exp(-abs(u)))) - b * (greatest(u, 0) + ln(1 + exp(-abs(u)))) + a * (greatest(-t, 0) + ln(1 + exp(-abs(t)))) + b * (greatest(t, 0) + ln(1 + exp(-abs(t)))) AS g
  FROM (SELECT *, (j + 0.5::DOUBLE) * h AS u FROM (SELECT *, (high - low) / {STEPS} AS h, unnest(range(CAST(floor(low / ((high - low) / {STEPS})) AS BIGINT), CAST(ceil(high / ((high - low) / {STEPS})) AS BIGINT) + 1)) AS j FROM grid))),
sure AS (SELECT name, sum(exp(g)) FILTER (above) / sum(exp(g)) AS bound FROM dense GROUP BY name)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(bound, 0) >= 0.9 THEN 'allow' ELSE 'block' END) AS verdict FROM fit LEFT JOIN sure USING (name)
"""
