"""Line removal by site-relative frequency.

A line's share is the number of its host's pages that contain it over the
number of the host's pages.  Lines above the ratio are boilerplate and go from
all pages of that host.  Lines are named by 128-bit hashes; counting is a
partial aggregate by (host, line) and never gathers a host in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineament.llm.words import unused
from lineament.plans.storage import sized, written

RATIO, LEAST_PAGES, LEAST_COUNT = 0.1, 20, 10


def _line_names(line):
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.concat(F.lit("~"), line)).alias("g"))


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float, least_pages: int, least_count: int) -> DataFrame:
    """(__host, lines): the names of a host's boilerplate lines, in the order of h, g.

    A host has at most (lines of a mean page) / ratio of them, however many its
    pages.  Trimmed lines without a character don't count; a page counts a line
    once.  Pages with a null host are a host of their own.
    """
    lines = F.array_distinct(F.transform(F.filter(F.transform(F.split(F.col(text), "\n"), F.trim), lambda x: x != ""), _line_names))
    pages = docs.select(F.col(host).alias("__host"), lines.alias("lines"))
    totals = docs.groupBy(F.col(host).alias("__host_")).agg(F.count("*").alias("pages"))
    counts = pages.select("__host", F.explode("lines").alias("line")).groupBy("__host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)
    many = counts.join(totals, counts["__host"].eqNullSafe(totals["__host_"]))
    many = many.filter((F.col("pages") >= least_pages) & (F.col("n") > F.lit(ratio) * F.col("pages")))
    return many.groupBy("__host").agg(F.sort_array(F.collect_list("line")).alias("__lines"))


def site_lines_removed(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, least_count: int = LEAST_COUNT) -> DataFrame:
    """docs with the text rid of its host's boilerplate lines, and __n_lines, __n_dropped.

    A line goes if its trimmed form is on over `ratio` of its host's pages, on
    `least_count` of them at least, and the host has `least_pages` at least.
    What stays is joined by line feeds, unchanged; a null text stays null and has
    no lines, an empty one has one.  Rows that repeat are pages each; an empty
    table gives no rows; columns named like the two that are added are replaced.  Hosts'
    line sets are met by a join on the host: broadcast up to a counted size,
    else a shuffle whose hot hosts adaptive execution splits.
    """
    names = [n for n in docs.columns if n.lower() not in ("__n_lines", "__n_dropped")]
    docs = docs.select(*names)
    sets = written(boilerplate(docs.select(host, text), host, text, ratio, least_pages, least_count), "boilerplate")
    size = sets.select(F.coalesce(F.sum(F.size("__lines")), F.lit(0)).alias("n"), F.count("*").alias("hosts")).first()
    key, gone, stays = unused(docs, "host"), unused(docs, "lines"), unused(docs, "kept_lines")
    hinted = sized(sets.toDF(key, gone), 24, size["n"] + 8 * size["hosts"])
    rows = docs.join(hinted, docs[host].eqNullSafe(hinted[key]), "left").drop(key)
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(gone), _line_names(F.trim(x))), F.lit(False)))
    out = rows.withColumn(stays, F.when(F.col(gone).isNull(), lines).otherwise(kept))
    columns = [F.array_join(stays, "\n").alias(n) if n == text else docs[n] for n in names]
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    n_kept = F.when(F.col(text).isNull(), 0).otherwise(F.size(stays))
    return out.select(*columns, n_lines.cast("long").alias("__n_lines"), (n_lines - n_kept).cast("long").alias("__n_dropped"))
