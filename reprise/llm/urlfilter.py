"""URL filtering by host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.llm.common import let


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first :// to / ? # or the end, A-Z lower-cased; path from there to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """All host suffixes at label borders, each with all path prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    kept = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    prefixes = F.transform(kept, lambda n: F.substring(path, F.lit(1), n))
    return let(prefixes, lambda ps: F.flatten(F.transform(hosts, lambda h: F.transform(ps, lambda p: F.struct(h.alias("h"), p.alias("p"))))))


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256))


def _short(digest: Column) -> Column:
    """The first 32 bits of a digest."""
    return F.substring(digest, 1, 4)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All columns of `pages` with host, path, rule and verdict.

    `rules` has (host, path, verdict). A rule fits its own host and every subdomain where the page's
    path begins with the rule's path; of the fitting rules the longest (host and path together)
    wins, then the longer host, then block before allow. Without a fitting rule, rule is null and
    verdict is `default`.

    Each distinct URL is expanded into host suffixes and path prefixes (of those lengths only that
    some rule path has), equi-joined to the rules on the first 32 bits of a SHA-256 and
    confirmed on the whole digest after the join. URLs are judged once each, so a URL on a third of all pages costs one
    row; pages get their verdict back by a join that adaptive execution may split. The number of
    distinct path lengths among the rules is read to the driver (at most a URL's length).

    A null URL, or one without ://, has an empty host and path, fits no rule with a host and takes the
    default. Rules with a null host, path or verdict are ignored; repeated rules count once. Columns of `pages`
    named like a result column are replaced.
    """
    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select("host", "path", "verdict").distinct()
    lengths = sorted(r[0] for r in known.select(F.length("path")).distinct().collect())
    found = known.select(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("hl"), F.length(F.concat("host", "path")).alias("rl"), _digest(F.col("host"), F.col("path")).alias("d"))
    found = found.withColumn("k", _short(F.col("d")))
    host, path = split_url(F.col("u"))
    urls = pages.select(F.col(url).alias("u")).where("u IS NOT NULL").distinct()
    parts = urls.select("u", host.alias("h0"), path.alias("p0")).where("h0 <> ''")
    terms = parts.select("u", F.explode(_expressions(F.col("h0"), F.col("p0"), lengths)).alias("e")) if lengths else parts.select("u", F.lit(None).cast("struct<h:string,p:string>").alias("e")).where("false")
    terms = terms.select("u", _digest(F.col("e.h"), F.col("e.p")).alias("td")).withColumn("tk", _short(F.col("td")))
    # Digests are of one length, so one begins with the other where they are equal; as an equality it would become a join key.
    fits = terms.join(found, terms.tk == found.k).where(F.startswith("td", "d"))
    best = fits.groupBy("u").agg(F.max(F.struct("rl", "hl", (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("best"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col("url"))
    rows = pages.select(F.struct(*pages.columns).alias("row"), F.col(url).alias("url"))
    out = rows.join(best, rows["url"] == best["u"], "left")
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
