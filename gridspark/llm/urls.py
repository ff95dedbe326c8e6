"""URL filters: rules by host and path, and trust and distrust propagated over host links.

Native: SQL expressions, joins and aggregates only. Pages a rule fits seed their host:
allowed pages give trust, blocked pages distrust. Trust follows links (personalised
PageRank), distrust follows them backwards. The state is one row per host; links are
counted per host pair before anything is joined, so a host with a third of all pages is
one row after the first partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.runtime import settle

# (host, path, verdict); a rule fits the host and its subdomains.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DAMPING = 0.85
ROUNDS = 12
# Of trust and distrust, over all hosts, from one round to the next; both sum to 1 at most.
TOLERANCE = 1e-9
MOST_ROUNDS = 1000
BLOCK_RATIO = 1.0
PARTS = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]*)"""


def host_of(url) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url) -> Column:
    """From the host's end up to ? # or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Add host, path, rule (the longest that fits, ties by name, else null) and its verdict.

    ``rules`` is a short list, compiled into one expression; no join is needed.
    """
    judged = pages.withColumns({"host": host_of("url"), "path": path_of("url")})
    rule = F.lit(None).cast("string")
    verdict = rule
    for host, path, way in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(way)).otherwise(verdict)
    return judged.withColumns({"rule": rule, "ruled": verdict})


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, share) over hosts from absolute and protocol-relative links in ``html``.

    Links inside a host carry no trust and are left out; ``share`` is the part of the
    source host's links that goes to ``dst``. Null pages and links without a host give none.
    """
    to = F.transform(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)),
                     lambda u: F.translate(F.regexp_extract(u, r"//([^/?#]*)", 1), UPPER, LOWER))
    links = pages.where(F.col("html").contains("//")).select(
        host_of("url").alias("src"), F.explode(to).alias("dst"))
    links = links.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    counted = links.groupBy("src", "dst").agg(F.count("*").alias("links"))
    total = counted.groupBy("src").agg(F.sum("links").alias("total"))
    back = counted.groupBy("dst").agg(F.sum("links").alias("back_total"))
    return counted.join(total, "src").join(back, "dst").select(
        "src", "dst", (F.col("links") / F.col("total")).alias("share"),
        (F.col("links") / F.col("back_total")).alias("back_share"))


def propagate(seeds: DataFrame, links: DataFrame, rounds: int = MOST_ROUNDS, damping: float = DAMPING,
              tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of personalised PageRank from seed masses, at its fixed point.

    Rounds end when the summed change is at most ``tolerance`` and no host was reached for the
    first time; more than ``rounds`` of them are an error.

    ``seeds`` has (host, good, bad), summing to 1 each where there are any. Trust of a host
    is (1 - d) * good + d * sum of trust * share over the hosts linking to it; distrust goes
    the other way round. Hosts that nothing reaches have 0. One joint round per step, one
    checkpoint per step: a row per host.
    """
    base = settle(seeds.select("host", "good", "bad"))
    state = base.select("host", ((1 - damping) * F.col("good")).alias("trust"),
                        ((1 - damping) * F.col("bad")).alias("distrust"))
    links = settle(links)
    if links.isEmpty():
        return state
    for _ in range(rounds):
        held = state.withColumnRenamed("host", "at")
        out = links.join(held, F.col("src") == F.col("at")).select(
            F.col("dst").alias("host"), (F.col("trust") * F.col("share")).alias("gain"), F.lit(0.0).alias("loss"))
        back = links.join(held, F.col("dst") == F.col("at")).select(
            F.col("src").alias("host"), F.lit(0.0).alias("gain"), (F.col("distrust") * F.col("back_share")).alias("loss"))
        start = base.select("host", ((1 - damping) * F.col("good")).alias("gain"),
                            ((1 - damping) * F.col("bad")).alias("loss"))
        flow = out.unionByName(back).select(
            "host", (F.col("gain") * damping).alias("gain"), (F.col("loss") * damping).alias("loss"))
        before, state = state, settle(flow.unionByName(start).groupBy("host").agg(
            F.sum("gain").alias("trust"), F.sum("loss").alias("distrust")))
        was = before.select(F.col("host").alias("_host"), F.col("trust").alias("_trust"), F.col("distrust").alias("_distrust"))
        both = state.join(was, F.col("host") == F.col("_host"), "left")
        change, fresh = F.lit(0.0), F.lit(False)
        for now in ("trust", "distrust"):
            then = F.coalesce(f"_{now}", F.lit(0.0))
            change, fresh = change + F.abs(F.col(now) - then), fresh | ((F.col(now) > 0) & (then == 0))
        moved = both.agg(F.sum(change).alias("change"), F.count_if(fresh).alias("fresh")).first()
        if moved.change <= tolerance and not moved.fresh:
            return state
    raise ValueError(f"trust still changes after {rounds} rounds")


def seed_masses(judged: DataFrame) -> DataFrame:
    """(host, good, bad): each host's part of all allowed and of all blocked pages."""
    per = judged.where(F.col("host") != "").groupBy("host").agg(
        F.count_if(F.col("ruled") == "allow").alias("allowed"),
        F.count_if(F.col("ruled") == "block").alias("blocked"))
    total = per.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).select(F.struct("a", "b")).scalar()
    return per.select("host", F.coalesce(F.try_divide("allowed", total["a"]), F.lit(0.0)).alias("good"),
                      F.coalesce(F.try_divide("blocked", total["b"]), F.lit(0.0)).alias("bad"))


def judge_urls(pages: DataFrame, rules=RULES, block_ratio: float = BLOCK_RATIO,
               rounds: int = MOST_ROUNDS, damping: float = DAMPING) -> DataFrame:
    """One row per page: its columns page_id, host, path, rule, verdict, trust, distrust.

    A rule decides where one fits. Elsewhere a page is blocked when its host's distrust is
    above ``block_ratio`` times its trust; a host no seed reaches is allowed, and so is a
    null url or one without a host. Repeated pages are judged one by one.
    """
    judged = with_rules(pages.select("page_id", "url"), rules)
    state = propagate(seed_masses(judged), host_links(pages), rounds, damping)
    scored = judged.join(state.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left")
    zero = F.lit(0.0)
    trust, distrust = F.coalesce("trust", zero), F.coalesce("distrust", zero)
    method = F.when(distrust > trust * block_ratio, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"),
                         trust.alias("trust"), distrust.alias("distrust"))


def op9_url_filters(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    fits = [(h, p, v) for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))]
    cases = "".join(f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '%s'" for h, p, _ in fits)
    rule = "CASE" + cases % tuple(h + p for h, p, _ in fits) + " END"
    ruled = "CASE" + cases % tuple(v for _, _, v in fits) + " END"
    steps = ""
    for i in range(ROUNDS):
        steps += f""",
s{i + 1} AS (SELECT host, sum(gain) trust, sum(loss) distrust FROM (
  SELECT dst AS host, {DAMPING} * (trust * share) gain, 0.0 loss FROM shares JOIN s{i} ON src = s{i}.host
  UNION ALL SELECT src, 0.0, {DAMPING} * (distrust * back_share) FROM shares JOIN s{i} ON dst = s{i}.host
  UNION ALL SELECT host, {1 - DAMPING} * good, {1 - DAMPING} * bad FROM seeds) GROUP BY host)"""
    return rf"""
WITH cut AS (
  SELECT page_id, html,
    translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{UPPER}', '{LOWER}') host,
    coalesce(regexp_extract(url, '{PARTS}', 2), '') path FROM pages),
judged AS (SELECT page_id, host, path, {rule} AS rule, {ruled} AS ruled FROM cut),
per AS (SELECT host, CAST(count(*) FILTER (ruled = 'allow') AS DOUBLE) a,
               CAST(count(*) FILTER (ruled = 'block') AS DOUBLE) b
        FROM judged WHERE host <> '' GROUP BY host),
seeds AS (SELECT host, coalesce(a / nullif(sum(a) OVER (), 0), 0) good,
                 coalesce(b / nullif(sum(b) OVER (), 0), 0) bad FROM per),
links AS (SELECT host src, translate(regexp_extract(l, '//([^/?#]*)', 1), '{UPPER}', '{LOWER}') dst
  FROM (SELECT host, unnest(regexp_extract_all(html, '{HREF.replace("'", "''")}', 1)) l FROM cut)),
counted AS (SELECT src, dst, CAST(count(*) AS DOUBLE) n FROM links
            WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
shares AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) share,
                  n / sum(n) OVER (PARTITION BY dst) back_share FROM counted),
s0 AS (SELECT host, {1 - DAMPING} * good trust, {1 - DAMPING} * bad distrust FROM seeds){steps}
SELECT page_id, j.host, path, rule, coalesce(ruled,
  CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * {BLOCK_RATIO} THEN 'block' ELSE 'allow' END) verdict
FROM judged j LEFT JOIN s{ROUNDS} s ON j.host = s.host
"""


SQL = _sql()
