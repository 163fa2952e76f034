"""URL filters: explicit rules first, else an empirical-Bayes reputation of the host.

Labelled outcomes of pages (bad or not, by their url's words and what they hold) are counted by host, registered domain and suffix. Each level
has a beta-binomial prior whose mean is the posterior mean of the level above and whose strength is
fitted to the spread of that level's own counts (method of moments). A host is blocked if the lower
bound of its posterior bad rate is over ``most_bad``; a host without labelled pages has its domain's prior.
A prior never weighs more than MOST_PRIOR pages, however alike the fitted groups are, so a host with bad pages enough is
told from its neighbours; reputations() shows each host's prior and its weight.

Rules are a table: a host meets those of its own suffixes in a join, once per host, and a page picks the longest whose path it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import split_join, stored, table, text_or_empty

#: Suffixes of two labels: one of these below a country's. Every other suffix is the last label. A table of suffixes may add more.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
#: A page is bad if its markup holds fewer words than this, or more links than one in so many words.
LEAST_WORDS = 100
LINK_WORDS = 10
#: A page is bad too if one of these is a word of its host's name (weak labels; a parameter).
BAD_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "viagra")
#: Hosts are blocked whose rate of bad pages is surely higher.
MOST_BAD = 0.1
#: Standard deviations below the posterior mean where the bound lies (one-sided 95 %).
Z = 1.645
#: Pages that a prior weighs at most; the spread between groups is never taken for less.
MOST_PRIOR = 50
LEAST_SPREAD, MOST_SPREAD = 1 / (MOST_PRIOR + 1), 0.999


@dataclass(frozen=True)
class Rule:
    """verdict for a host and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://, else empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


RULE_TYPE = "array<struct<length:int,name:string,path:string,verdict:string>>"


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")


def rules_of(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: for hosts (distinct) that have any, their rules, the longest first; of equally long ones the first in the alphabet.

    rules: verdict, host, path. A rule fits its host and all subdomains. Its rules are as many as a host has, however many there are in all.
    """
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    names = F.concat("rule_host", "path")
    own = rules.select(F.col("host").alias("rule_host"), "path", "verdict").select("rule_host", F.struct((-F.length(names)).alias("length"), names.alias("name"), "path", "verdict").alias("rule"))
    met = hosts.select("host", F.explode(tails).alias("rule_host")).join(own, "rule_host")
    return met.groupBy("host").agg(F.array_sort(F.collect_list("rule")).alias("rules"))


def levels(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds domain (registered) and suffix to rows with a host, without port and user.

    suffixes: a table of public suffixes, column suffix; the longest that ends a host after a dot counts.
    """
    bare = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    double = F.size(labels) > 1
    double &= F.get(labels, F.size(labels) - 2).isin(*SECOND_LABELS) & (F.length(F.substring_index(bare, ".", -1)) == 2)
    n = F.when(double, 2).otherwise(1)
    rows = hosts.withColumns({"_labels": labels, "_n": n})
    if suffixes is not None:
        tails = F.transform(F.sequence(F.lit(1), F.size("_labels")), lambda i: F.struct(i.alias("_known"), F.array_join(F.slice("_labels", -i, i), ".").alias("suffix")))
        known = rows.select("host", F.explode(tails).alias("tail")).select("host", "tail.*")
        known = known.join(suffixes.select("suffix").distinct(), "suffix", "left_semi").groupBy("host").agg(F.max("_known").alias("_known"))
        rows = rows.join(known, "host", "left").withColumn("_n", F.coalesce("_known", "_n")).drop("_known")
    tail = lambda k: F.array_join(F.slice("_labels", -F.least(k, F.size("_labels")), F.least(k, F.size("_labels"))), ".")
    return rows.withColumns({"domain": tail(F.col("_n") + 1), "suffix": tail(F.col("_n"))}).drop("_labels", "_n")


def _spread(groups: DataFrame, prior: Column) -> float:
    """Overdispersion rho of the groups' counts around their prior means, by moments."""
    n, x = F.col("n"), F.col("x")
    own = prior * (1 - prior)
    row = groups.agg(F.sum((x - n * prior) ** 2 - n * own).alias("over"), F.sum(n * (n - 1) * own).alias("base")).first()
    rho = (row["over"] or 0.0) / row["base"] if row["base"] else LEAST_SPREAD
    return min(max(rho, LEAST_SPREAD), MOST_SPREAD)


def reputations(outcomes: DataFrame, suffixes: DataFrame | None = None, hosts: DataFrame | None = None) -> DataFrame:
    """host, n, bad_rate, bad_bound, prior, prior_pages from rows (host, bad) of labelled pages; a row per host, the empty host too.

    hosts: distinct hosts to be in the result even if none of their pages is labelled (n is 0): their rate is the prior.
    prior, prior_pages: the domain's rate and the pages that it weighs.
    """
    labelled = outcomes.where(F.col("host").isNotNull() & F.col("bad").isNotNull()).select("host", F.lit(1).alias("n"), F.col("bad").cast("double").alias("x"))
    if hosts is not None:
        labelled = labelled.unionByName(hosts.select("host", F.lit(0).alias("n"), F.lit(0.0).alias("x")))
    counted = labelled.groupBy("host").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    by_host = stored(levels(counted, suffixes), "url-hosts")
    whole = by_host.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).first()
    root = F.lit((whole["x"] + 0.5) / (whole["n"] + 1.0) if whole["n"] else 0.0)  # without any label no host is bad
    sums = (F.sum("n").alias("n"), F.sum("x").alias("x"))
    shrunk = lambda prior, rho: (F.col("x") + (1 - rho) / rho * prior) / (F.col("n") + (1 - rho) / rho)
    by_suffix = by_host.groupBy("suffix").agg(*sums)
    by_suffix = by_suffix.select("suffix", shrunk(root, _spread(by_suffix, root)).alias("suffix_rate"))
    by_domain = by_host.groupBy("domain", "suffix").agg(*sums).join(by_suffix, "suffix")
    by_domain = by_domain.select("domain", "suffix", shrunk(F.col("suffix_rate"), _spread(by_domain, F.col("suffix_rate"))).alias("domain_rate"))
    found = by_host.join(by_domain, ["domain", "suffix"])
    rho = _spread(found, F.col("domain_rate"))
    rate = shrunk(F.col("domain_rate"), rho)
    return found.select("host", "n", rate.alias("bad_rate"), F.col("domain_rate").alias("prior"), F.lit((1 - rho) / rho).alias("prior_pages")).withColumn(
        "bad_bound", F.col("bad_rate") - Z * F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("n") + F.col("prior_pages") + 1))
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", most_bad: float = MOST_BAD, suffixes: DataFrame | None = None) -> DataFrame:
    """Returns id, host, path, rule, verdict: a row per page.

    rules: a table of verdict, host, path; rule_table() by default. A null url, or one without ://, has an empty host and path
    and is allowed unless rules or the empty host's own outcomes say otherwise. Rows with equal or null ids stay. Other columns are ignored.
    """
    rules = rule_table(pages.sparkSession) if rules is None else rules
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    split = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = stored(split.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "url-pages")
    bad = reputations(outcomes, suffixes, hosts).select("host", F.coalesce(F.col("bad_bound") > most_bad, F.lit(False)).alias("bad"))
    own = rules_of(hosts, rules)
    known = stored(hosts.join(bad, "host").join(own, "host", "left").select("host", "pages", "bad", F.coalesce("rules", F.array().cast(RULE_TYPE)).alias("rules")), "url-verdicts")
    judged = split_join(split, known, ["host"], "pages", int(known.agg(F.sum("pages")).first()[0] or 0))
    fits = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), 0)
    return judged.select(id_col, "host", "path", fits["name"].alias("rule"), F.coalesce(fits["verdict"], F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def page_words(html: Column) -> Column:
    """The words of a page outside of tags, scripts, styles and comments."""
    shown = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.regexp_count(F.regexp_replace(shown, "<[^>]*>", " "), F.lit(r"[^\x20\x09-\x0D]+"))


def marked_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_words: int = LEAST_WORDS, link_words: int = LINK_WORDS, bad_words: tuple[str, ...] = BAD_WORDS) -> DataFrame:
    """(host, bad) of every page: bad are thin pages, lists of links, and pages of a host with a bad word in its name. A null page is empty."""
    host = host_of(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    html = text_or_empty(html_col)
    words = page_words(html)
    named = F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, bad_words))) if bad_words else F.lit(False)
    return pages.select(host.alias("host"), (named | (words < least_words) | (F.regexp_count(html, F.lit("<a ")) * link_words > words)).alias("bad"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, marked_pages(pages))


SQL = {
    "op5_url_filter": r"""
        WITH s AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
        c AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        w AS (SELECT page_id, len(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[^\x20\x09-\x0D]+')) AS words,
                     len(regexp_extract_all(html, '<a ')) AS links FROM c),
        o AS (SELECT host, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS labels, count(*) AS n,
                     sum((words < 100 OR links * 10 > words OR list_has_any(string_split_regex(host, '[.-]'), ['adult', 'ads', 'bets', 'casino', 'pills', 'porn', 'spam', 'viagra']))::DOUBLE) AS x FROM h JOIN w USING (page_id) GROUP BY host),
        l AS (SELECT *, CASE WHEN len(labels) > 1 AND labels[-2] IN ('ac', 'co', 'com', 'edu', 'go', 'gov', 'ne', 'net', 'or', 'org') AND length(labels[-1]) = 2 THEN 2 ELSE 1 END AS k FROM o),
        g AS (SELECT host, n, x, array_to_string(labels[-(k + 1):], '.') AS domain, array_to_string(labels[-k:], '.') AS suffix FROM l),
        r AS (SELECT (sum(x) + 0.5) / (sum(n) + 1.0) AS m FROM g),
        su AS (SELECT suffix, sum(n) AS n, sum(x) AS x, any_value(m) AS m FROM g, r GROUP BY suffix),
        ks AS (SELECT least(greatest(coalesce(sum((x - n * m) * (x - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 1.0 / 51), 1.0 / 51), 0.999) AS rho FROM su),
        sm AS (SELECT suffix, (x + (1 - rho) / rho * m) / (n + (1 - rho) / rho) AS m FROM su, ks),
        d AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x, any_value(m) AS m FROM g JOIN sm USING (suffix) GROUP BY domain, suffix),
        kd AS (SELECT least(greatest(coalesce(sum((x - n * m) * (x - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 1.0 / 51), 1.0 / 51), 0.999) AS rho FROM d),
        dm AS (SELECT domain, suffix, (x + (1 - rho) / rho * m) / (n + (1 - rho) / rho) AS m FROM d, kd),
        hh AS (SELECT host, n, x, m FROM g JOIN dm USING (domain, suffix)),
        kh AS (SELECT least(greatest(coalesce(sum((x - n * m) * (x - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 1.0 / 51), 1.0 / 51), 0.999) AS rho FROM hh),
        hm AS (SELECT host, n, (1 - rho) / rho AS k, (x + (1 - rho) / rho * m) / (n + (1 - rho) / rho) AS rate FROM hh, kh),
        b AS (SELECT host, rate - 1.645 * sqrt(rate * (1 - rate) / (n + k + 1)) > 0.1 AS bad FROM hm),
        f AS (SELECT page_id, host, path, CASE
                WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
        SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow'
               WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN bad THEN 'block' ELSE 'allow' END END AS verdict
        FROM f LEFT JOIN b USING (host)"""
}
QUERIES = {"op5_url_filter": op5_url_filter}
