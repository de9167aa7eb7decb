"""Boilerplate lines by how many of a site's pages hold them.

Lines are compared after trimming and turning runs of white space into one space; blank lines are
neither counted nor dropped. A line counts once per page. Lines on more than ``ratio`` of the pages
of a site, and on at least ``min_pages`` of them, are dropped from that site's pages; the other
lines stay as they are, letter for letter.

A page adds each line once, so the boilerplate lines of a site are at most (lines of an average
page) / ``ratio``: the list per site is bounded whatever the number of pages. The counting rows are
(site, digest) pairs that are summed before the shuffle; texts never meet by line.

Defined cases: a null site is a site; a null text has no lines and stays null; a text whose lines
are all dropped becomes empty, its row stays; equal rows are pages of their own. ``n_chars`` is set
if the table has it; ``dropped_lines`` is added. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipweave.llm.tables import marked, stored

RATIO = 0.05
MIN_PAGES = 5


def _plain(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


def _digests(lines: Column) -> Column:
    """Digests of the distinct lines of a page that are not blank."""
    full = F.filter(F.transform(lines, _plain), lambda s: s != "")
    return F.array_distinct(F.transform(full, lambda s: F.xxhash64(s)))


def line_shares(
    pages: DataFrame, min_pages: int, site: str, text: str, copies: bool = True
) -> DataFrame:
    """``(__site, digest, pages, all_pages)`` of lines on at least ``min_pages`` pages of a site."""
    sited = pages.select(
        marked(site).alias("__site"), F.xxhash64(text).alias("__page"),
        _digests(F.split(F.col(text), "\n")).alias("__digests"),
    )
    if not copies:
        sited = sited.dropDuplicates(["__site", "__page"])
    lines = sited.select("__site", F.explode("__digests").alias("digest"))
    counted = lines.groupBy("__site", "digest").agg(F.count(F.lit(1)).alias("pages"))
    totals = sited.groupBy("__site").agg(F.count(F.lit(1)).alias("all_pages"))
    return counted.where(F.col("pages") >= min_pages).join(totals, "__site")


def _of_differing(
    pages: DataFrame, common: DataFrame, ratio: float, min_pages: int, site: str, text: str
) -> DataFrame:
    """Those of the common lines that are still common if only pages count that are for the most part
    something else: near copies of one page share most of their lines, and are not boilerplate."""
    listed = common.groupBy("__site").agg(F.collect_set("digest").alias("__common"))
    sited = pages.select(
        marked(site).alias("__site"), F.xxhash64(text).alias("__page"),
        _digests(F.split(F.col(text), "\n")).alias("__digests"),
    ).dropDuplicates(["__site", "__page"])
    own = sited.join(stored(listed, "candidates"), "__site").withColumn(
        "__own", F.array_intersect("__digests", "__common")
    )
    differing = own.where(2 * F.size("__own") <= F.size("__digests"))
    seen = differing.select("__site", F.explode("__own").alias("digest")).groupBy(
        "__site", "digest"
    ).agg(F.count(F.lit(1)).alias("pages"))
    totals = common.select("__site", "digest", "all_pages")
    return seen.join(totals, ["__site", "digest"]).where(
        (F.col("pages") >= min_pages) & (F.col("pages") > F.lit(ratio) * F.col("all_pages"))
    )


def drop_boilerplate(
    pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES,
    site: str = "source", text: str = "text", copies: bool = True,
) -> DataFrame:
    """The pages without the boilerplate lines of their site, and the number of dropped lines.

    Without ``copies``, pages of a site with equal texts count as one page, and a line must be common
    among pages of which common lines are at most half, so near copies keep theirs; all pages stay."""
    shares = line_shares(pages, min_pages, site, text, copies)
    common = shares.where(F.col("pages") > F.lit(ratio) * F.col("all_pages"))
    if not copies:
        common = _of_differing(pages, stored(common, "common"), ratio, min_pages, site, text)
    listed = stored(
        common.groupBy("__site").agg(F.collect_set("digest").alias("__common")), "boilerplate"
    )
    lines = F.split(F.col(f"`{text}`"), "\n")
    own = F.array_intersect(_digests(lines), F.col("__common"))
    kept = F.filter(lines, lambda s: ~F.array_contains(F.col("__own"), F.xxhash64(_plain(s))))
    hit = F.size("__own") > 0
    out = (
        pages.drop("dropped_lines").withColumn("__site", marked(site))
        .join(listed, "__site", "left")
        .withColumn("__own", F.coalesce(own, F.array().cast("array<bigint>")))
        .withColumn("__kept", F.when(hit, kept))
        .withColumn("dropped_lines", F.when(hit, F.size(lines) - F.size("__kept")).otherwise(0))
        .withColumn(text, F.when(hit, F.array_join("__kept", "\n")).otherwise(F.col(f"`{text}`")))
    )
    if "n_chars" in pages.columns:
        out = out.withColumn("n_chars", F.length(F.col(f"`{text}`")).cast("bigint"))
    names = [c for c in pages.columns if c != "dropped_lines"]
    return out.select(*[F.col(f"`{c}`") for c in names], "dropped_lines")
