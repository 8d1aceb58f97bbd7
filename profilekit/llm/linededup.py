"""Boilerplate lines by their frequency within a site.

For each site, the distinct pages that hold a line are divided by all distinct
pages of the site; a line above a ratio on enough pages is boilerplate and is
dropped from the site's pages. Everything is DataFrame operations.

Pages with the same text count once, so copies of a page don't make its lines
boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilekit.llm.common import free_name, without
from profilekit.runtime import cut_lineage, hint_if_small, quoted

#: A line is boilerplate on more than this share of a site's pages, and on as many pages at least.
MOST_RATIO, LEAST_PAGES = 0.05, 3
#: White space at the ends of a line, which is left out when lines are compared; line ends of CR LF are part of it.
WHITE = " \t\r\x0b\x0c"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, null if it has none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def blank(line: Column) -> Column:
    return F.length(bare(line)) == 0


def boilerplate(pages: DataFrame, site: str = "source", text: str = "text", most_ratio: float = MOST_RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``site``, ``line``, ``n_pages``, ``n_site`` and ``ratio`` of each boilerplate line.

    A null site is a site of its own. Blank lines are never boilerplate. Lines
    are compared without white space at their ends.
    """
    # Pages are compared by digest; counts of both kinds are partial sums before any shuffle by site.
    rows = pages.select(
        F.coalesce(F.col(quoted(site)).cast("string"), F.lit("")).alias("site"),
        F.col(quoted(site)).isNull().alias("no_site"),
        F.xxhash64(quoted(text), F.length(quoted(text))).alias("page"),
        lines_of(F.col(quoted(text))).alias("lines"),
    )
    totals = rows.select("site", "no_site", "page").distinct().groupBy("site", "no_site").agg(F.count("*").alias("n_site"))
    totals = cut_lineage(totals)
    lines = rows.select("site", "no_site", "page", F.explode(F.array_distinct(F.transform("lines", lambda line: bare(line)))).alias("line")).where(F.length("line") > 0)
    held = lines.groupBy("site", "no_site", F.xxhash64("line").alias("key"), "page").agg(F.count("*").alias("k"))
    n = held.groupBy("site", "no_site", "key").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= least_pages)
    ratio = F.col("n_pages") / F.col("n_site")
    found = n.join(hint_if_small(totals), ["site", "no_site"]).withColumn("ratio", ratio).where(F.col("ratio") > most_ratio)
    return found.select("site", "no_site", "key", "n_pages", "n_site", "ratio")


def drop_boilerplate(pages: DataFrame, site: str = "source", text: str = "text", most_ratio: float = MOST_RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` with boilerplate lines dropped from ``text``, and ``n_lines``, ``n_dropped`` (columns of these names are replaced).

    Null texts stay null with no lines; every row stays, repeated rows
    included, also one that loses all its lines. A site has at most (lines of a page / ``most_ratio``) such lines.
    """
    found = cut_lineage(boilerplate(pages, site, text, most_ratio, least_pages))
    by_site = cut_lineage(found.groupBy("site", "no_site").agg(F.collect_list("key").alias("keys")))
    out = without(pages, ["n_lines", "n_dropped"])
    columns = out.columns
    its_site, no_site, keys, split, stay = (free_name(pages, f"join {n}") for n in ("site", "no site", "keys", "lines", "kept"))
    out = out.join(
        hint_if_small(by_site.select(F.col("site").alias(its_site), F.col("no_site").alias(no_site), F.col("keys").alias(keys)), 10_000),
        (F.coalesce(F.col(quoted(site)).cast("string"), F.lit("")) == F.col(its_site)) & (F.col(quoted(site)).isNull() == F.col(no_site)),
        "left",
    )
    lines = lines_of(F.col(quoted(text)))
    stays = lambda line: blank(line) | ~F.array_contains(keys, F.xxhash64(bare(line)))
    kept = F.when(F.col(keys).isNull(), lines).otherwise(F.filter(lines, stays))
    out = out.withColumn(split, lines).withColumn(stay, kept)
    rest = F.array_join(stay, "\n")
    dropped = F.size(split) - F.size(stay)
    n_lines = F.when(F.col(quoted(text)).isNull(), 0).otherwise(F.size(split))
    new = F.when((dropped == 0) | F.col(quoted(text)).isNull(), F.col(quoted(text))).otherwise(rest)
    return out.select(
        *[new.alias(c) if c == text else F.col(quoted(c)) for c in columns],
        n_lines.alias("n_lines"),
        dropped.alias("n_dropped"),
    )
