"""URL filter: path rules first, then a beta-binomial reputation of the host.

Every url is split into host and path. The longest rule that fits decides.
A url without a rule is judged by its host: the labelled pages of the host,
shrunk towards those of its registered domain, of the public suffix and of the
whole table. All of it is DataFrame expressions.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txscreen.llm.common import ascii_lower

ALLOW, BLOCK = "allow", "block"

# The rules of the query's contract, verdict and host with path.
RULES = (
    (ALLOW, "org/"),
    (BLOCK, "example.org/es/"),
    (BLOCK, "example.org/en/1"),
    (ALLOW, "com/fr/"),
    (BLOCK, "com/de/"),
)

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Lower-cased host and path; both empty for null and for a url without ``://``."""
    found = [F.coalesce(F.regexp_extract(F.col(url), _SPLIT, i), F.lit("")) for i in (1, 2)]
    return ascii_lower(found[0]), found[1]


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, null if none does.

    The rules are a short list of the caller's and become one expression.
    """
    longest_first = sorted((r for _, r in rules), key=lambda r: (-len(r), r))
    found = F.lit(None).cast("string")
    for rule in reversed(longest_first):
        name, slash, rest = rule.partition("/")
        at_host = (host == name) | host.endswith(f".{name}")
        found = F.when(at_host & path.startswith(slash + rest), rule).otherwise(found)
    return found


def domain_levels(host: Column, long_suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """Registered domain and public suffix of ``host``.

    The suffix is the last label, or two labels when they are in
    ``long_suffixes`` (such as ``co.uk``); the domain has one label more.
    """
    two = F.substring_index(host, ".", -2)
    is_long = two.isin(*long_suffixes) if long_suffixes else F.lit(False)
    suffix = F.when(is_long, two).otherwise(F.substring_index(host, ".", -1))
    return F.when(is_long, F.substring_index(host, ".", -3)).otherwise(two), suffix


def _strength(mean: Column, n: Column, children: Column, spread: Column) -> Column:
    """Prior strength from how far the children's rates lie apart (method of moments).

    ``spread`` is the sum of good² / n over the children. Rates no further
    apart than chance would have them give the largest strength.
    """
    chance = mean * (1 - mean)
    between = spread / n - mean * mean
    surplus = between - chance * children / n
    estimate = (chance - between) / surplus
    return (
        F.when(n.isNull() | (n == 0), 2.0)
        .when(surplus <= 1e-12, 1000.0)
        .otherwise(F.least(F.greatest(estimate, F.lit(1.0)), F.lit(1000.0)))
    )


def _up(children: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of ``keys`` and what the prior of their children needs."""
    labelled = F.col("n") > 0
    return children.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("good").alias("good"),
        F.count_if(labelled).alias("children"),
        F.sum(F.when(labelled, F.col("good") * F.col("good") / F.col("n"))).alias("spread"),
    )


def _shrink(table: DataFrame, above: DataFrame, key: str) -> DataFrame:
    """Posterior ``mean`` of each row under the prior of the row above it.

    ``strength`` is that of the row as a prior for the level below.
    """
    prior = above.select(
        key, F.col("mean").alias("prior_mean"), F.col("strength").alias("prior_strength")
    )
    k, m = F.col("prior_strength"), F.col("prior_mean")
    mean = (F.col("good") + k * m) / (F.col("n") + k)
    out = table.join(prior, key).withColumn("mean", mean)
    if "children" not in table.columns:
        return out
    n = F.col("n").cast("double")
    rate = F.col("good") / F.when(n > 0, n)
    return out.withColumn("strength", _strength(rate, n, F.col("children"), F.col("spread")))


def host_reputation(
    outcomes: DataFrame, *, z: float = 1.645, long_suffixes: Sequence[str] = ()
) -> DataFrame:
    """Posterior share of good pages per host.

    ``outcomes`` has ``host`` and ``good`` (1, 0, or null for a page without a
    label). Returns host, n (labelled pages), good, mean, and the bounds
    ``lower`` and ``upper`` that lie ``z`` posterior standard deviations off.
    A host without labels gets the mean of its domain, one in a domain without
    labels that of its suffix, and so on. No label at all: mean one half.

    Counting combines map-side, so a host with a third of all pages is one row
    per map task; the levels above are built from one row per host.
    """
    domain, suffix = domain_levels(F.col("host"), long_suffixes)
    hosts = (
        outcomes.groupBy("host")
        .agg(
            F.count("good").alias("n"),
            F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"),
        )
        .withColumns({"domain": domain, "suffix": suffix, "all": F.lit(0)})
    )
    domains = _up(hosts, ["all", "suffix", "domain"])
    suffixes = _up(domains, ["all", "suffix"])
    n = F.col("n").cast("double")
    rate = F.coalesce(F.col("good") / F.when(n > 0, n), F.lit(0.5))
    top = (
        _up(suffixes, ["all"])
        .withColumn("mean", rate)
        .withColumn("strength", _strength(rate, n, F.col("children"), F.col("spread")))
    )
    level = _shrink(suffixes, top, "all")
    level = _shrink(domains, level, "suffix")
    level = _shrink(hosts, level, "domain")
    mean, size = F.col("mean"), F.col("n") + F.col("prior_strength")
    margin = z * F.sqrt(mean * (1 - mean) / (size + 1))
    return level.select(
        "host", "n", "good", "mean", (mean - margin).alias("lower"), (mean + margin).alias("upper")
    )


def filter_urls(
    pages: DataFrame,
    *,
    page_id: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    outcomes: DataFrame | None = None,
    block_below: float = 0.5,
    z: float = 1.645,
    long_suffixes: Sequence[str] = (),
) -> DataFrame:
    """Host, path, rule and verdict of every row of ``pages``.

    ``outcomes`` (host, good) are labelled pages. Without it, what the rules
    decided are the labels: an allowed page is good, a blocked one bad. A page
    no rule fits is blocked when the upper bound of its host's share of good
    pages lies below ``block_below``; a host nobody knows passes.

    A null url has empty host and path; repeated rows each get their verdict;
    other columns of ``pages`` are not looked at. An empty table gives none.
    """
    host, path = host_and_path(url)
    split = pages.select(
        F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")
    ).withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    allowed = [r for v, r in rules if v == ALLOW]
    by_rule = F.when(F.col("rule").isin(*allowed), ALLOW).when(F.col("rule").isNotNull(), BLOCK)
    judged = split.withColumn("by_rule", by_rule)
    good = F.when(F.col("by_rule") == ALLOW, 1).when(F.col("by_rule") == BLOCK, 0)
    known = judged.select("host", good.alias("good"))
    if outcomes is not None:
        hosts = judged.select("host", F.lit(None).cast("int").alias("good"))
        known = hosts.unionByName(outcomes.select("host", F.col("good").cast("int").alias("good")))
    bad = (
        host_reputation(known, z=z, long_suffixes=long_suffixes)
        .filter(F.col("upper") < block_below)
        .select("host", F.lit(BLOCK).alias("by_host"))
    )
    verdict = F.coalesce("by_rule", "by_host", F.lit(ALLOW))
    return judged.join(bad, "host", "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict")
    )


SQL = """
WITH split AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM split),
hosts AS (
  SELECT host, count(rule)::DOUBLE AS n, count(*) FILTER (rule IN ('org/', 'com/fr/'))::DOUBLE AS good,
    string_split(host, '.') AS labels
  FROM judged GROUP BY host),
hosts2 AS (
  SELECT *, labels[-1] AS suffix, array_to_string(labels[-2:], '.') AS domain FROM hosts),
domains AS (
  SELECT suffix, domain, sum(n) AS n, sum(good) AS good, count(*) FILTER (n > 0) AS children,
    sum(good * good / n) FILTER (n > 0) AS spread
  FROM hosts2 GROUP BY suffix, domain),
suffixes AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good, count(*) FILTER (n > 0) AS children,
    sum(good * good / n) FILTER (n > 0) AS spread
  FROM domains GROUP BY suffix),
world AS (
  SELECT sum(n) AS n, sum(good) AS good, count(*) FILTER (n > 0) AS children,
    sum(good * good / n) FILTER (n > 0) AS spread
  FROM suffixes),
kept AS (
  SELECT 0 AS level, '' AS name, n, good, children, spread FROM world
  UNION ALL SELECT 1, suffix, n, good, children, spread FROM suffixes
  UNION ALL SELECT 2, domain, n, good, children, spread FROM domains),
strengths AS (
  SELECT level, name, n, good, CASE WHEN n = 0 THEN 2.0
    WHEN spread / n - p * p - p * (1 - p) * children / n <= 1e-12 THEN 1000.0
    ELSE least(greatest((p * (1 - p) - (spread / n - p * p))
      / (spread / n - p * p - p * (1 - p) * children / n), 1.0), 1000.0) END AS k
  FROM (SELECT *, CASE WHEN n > 0 THEN good / n END AS p FROM kept)),
l0 AS (SELECT k, CASE WHEN n > 0 THEN good / n ELSE 0.5 END AS m FROM strengths WHERE level = 0),
l1 AS (SELECT s.name AS suffix, s.k, (s.good + l0.k * l0.m) / (s.n + l0.k) AS m
  FROM strengths s, l0 WHERE level = 1),
l2 AS (SELECT d.domain, s.k, (s.good + l1.k * l1.m) / (s.n + l1.k) AS m
  FROM strengths s JOIN domains d ON s.name = d.domain JOIN l1 USING (suffix) WHERE level = 2),
l3 AS (SELECT host, (h.good + l2.k * l2.m) / (h.n + l2.k) AS m, h.n + l2.k AS size
  FROM hosts2 h JOIN l2 USING (domain))
SELECT page_id, judged.host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN m + 1.645 * sqrt(m * (1 - m) / (size + 1)) < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM judged JOIN l3 ON judged.host = l3.host
"""
