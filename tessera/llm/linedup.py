"""Line deduplication by site-relative frequency (DataFrame functions only).

Pages are grouped by host; for each line, the host's pages that contain it are
divided by the host's pages; lines above the ratio are boilerplate and are
dropped from every page of the host, if at least MIN_PAGES (5) of its distinct
pages contain them; so on hosts with under 50 distinct pages the threshold is 5
pages, and on hosts with up to 4 pages every line stays.  Exact copies of a page count once on both
sides of the division, else a page crawled a thousand times would make its own
content look like boilerplate.

Defined results: a null text stays null and has no lines; an empty text stays
empty; lines without a word are never boilerplate and stay; a null host is a
host of its own; repeated rows are treated alike; all columns of the input are
kept, whatever their names.  Lines are compared by 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import free_name, scratch_scope, stage

RATIO = 0.1
MIN_PAGES = 5
#: Up to this many boilerplate lines in all (16 bytes each) and on one host, hosts' lists
#: are broadcast; beyond, each page gets its own lines by a join of (host, line).
BROADCAST_LINES, HOST_LINES = 500_000, 4096


def host_of_url(url: Column) -> Column:
    """Host of a URL, lower case, without port and user; null if there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(h != "", h)


def _key(line: Column) -> Column:
    return F.xxhash64(line)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _hashed_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), _has_word)
    return F.array_distinct(F.transform(lines, _key))


def _pages(docs: DataFrame, host: Column, text: str) -> DataFrame:
    """(host, page, lines): a page's hash and the hashes of its lines."""
    own = F.col(f"`{text}`")
    return docs.where(own.isNotNull()).select(host.alias("host"), _page(own).alias("page"), _hashed_lines(own).alias("lines"))


def _page(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def boilerplate(docs: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_hash, pages, host_pages) of lines over ``ratio``.

    Copies are counted once by grouping (host, line, page text hash) before
    (host, line): both groupings combine on the map side, so a host or a line
    with a third of all rows arrives as a few partial counts.
    """
    rows = _pages(docs, host, text)
    pages = rows.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_pages"))
    seen = (
        rows.select("host", "page", F.explode("lines").alias("line_hash"))
        .groupBy("host", "page", "line_hash")
        .agg(F.lit(1).alias("one"))
        .groupBy("host", "line_hash")
        .agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    return (
        seen.join(pages, seen["host"].eqNullSafe(pages["host"]))
        .select(seen["host"], "line_hash", "pages", "host_pages")
        .where(F.col("pages") > F.lit(ratio) * F.col("host_pages"))
    )


def _lines_of_pages(docs: DataFrame, host: Column, text: str, bad: DataFrame, small: bool) -> DataFrame:
    """(host, page, bad): the boilerplate lines that a page holds, never more than its own."""
    bad = bad.select(F.col("host").alias("bad_host"), F.col("line_hash").alias("bad_line"))
    lines = _pages(docs, host, text).select("host", "page", F.explode("lines").alias("line")).distinct()
    on = F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("line") == F.col("bad_line"))
    return lines.join(F.broadcast(bad) if small else bad, on).groupBy("host", "page").agg(F.collect_list("line").alias("bad"))


def drop_lines(
    docs: DataFrame,
    host: Column | str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
    dropped: str | None = None,
) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``.

    ``dropped`` names an optional column with the number of removed lines.
    A page keeps the order of its other lines, joined by newlines.
    """
    host = F.col(f"`{host}`") if isinstance(host, str) else host
    own = F.col(f"`{text}`")
    with scratch_scope(docs.sparkSession) as scratch:
        bad = stage(boilerplate(docs, host, text, ratio, min_pages), "boilerplate")
        size = bad.groupBy("host").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.max("count"), F.lit(0)).alias("most")).first()
        small = size["n"] <= broadcast_lines
        names = [free_name([*docs.columns, dropped or ""], x) for x in ("bad_host", "bad_page", "bad_lines", "hit_lines", "kept_lines")]
        at_host, at_page, known, hits, rest = names
        on = host.eqNullSafe(F.col(at_host))
        if small and size["most"] <= HOST_LINES:
            per_host = bad.groupBy(F.col("host").alias(at_host)).agg(F.collect_set("line_hash").alias(known))
            joined = docs.join(F.broadcast(per_host), on, "left")
        else:
            mine = stage(_lines_of_pages(docs, host, text, bad, small), "pages").toDF(at_host, at_page, known)
            joined = docs.join(mine, on & (_page(own) == F.col(at_page)), "left")
        scratch.release(joined)
    lines = F.split(own, "\n", -1)
    found = F.array_intersect(F.transform(lines, _key), F.col(known))
    joined = joined.withColumn(hits, F.when(F.col(known).isNotNull() & own.isNotNull(), found).otherwise(F.array().cast("array<bigint>")))
    hit = F.size(hits) > 0
    joined = joined.withColumn(rest, F.when(hit, F.filter(lines, lambda x: ~F.array_contains(F.col(hits), _key(x)))))
    out = [F.when(hit, F.array_join(rest, "\n")).otherwise(own).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if dropped:
        out.append(F.when(hit, F.size(lines) - F.size(rest)).otherwise(F.lit(0)).cast("bigint").alias(dropped))
    return joined.select(*out)
