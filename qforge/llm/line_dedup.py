"""Cross-site line removal by distinct-site spread, DataFrame functions only.

A line (trimmed of blanks, tabs and carriage returns) is boilerplate when it
stands in ``min_sites`` sites or more, or, where none is given, in half of the sites that
speak, but at least ``FEWEST`` and at most ``MIN_SITES``.  Copies of one text speak for one site
(the least of theirs), so a page mirrored everywhere isn't boilerplate.
HyperLogLog sketches per line hash merge by aggregation; lines whose estimate
lies within ``BAND`` relative errors (one site at least) of the threshold get
an exact distinct count; those above go, those below stay.

Lines are written once as (line hash, text hash, site), so three passes read
small rows.  The lines to remove are gathered per text hash, at most the
lines of that text, and joined to the documents; hot texts and hot lines are
pre-aggregated or split by the skew join, whose other side is always a
written table.

Defined cases: a null text stays null with 0 lines; a null site is a site of
its own; empty lines are never boilerplate; every occurrence of a boilerplate
line goes, and a text that loses nothing is returned as it was; repeated rows
are all kept; empty input gives no rows.  Other columns pass through, except
that earlier columns n_lines, n_removed and clean_text are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qforge.llm.common import Scratch

MIN_SITES = 10          # the most that any corpus asks for
FEWEST = 3              # the least, however few sites there are
LG_K = 12               # sketch of 4096 registers: relative error 1.04 / 64
BAND = 3.0
BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def boilerplate(lines: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES) -> DataFrame:
    """Line hashes ``h`` that stand in at least ``min_sites`` distinct sites of
    ``lines(h, site)``."""
    slack = max(1.0, BAND * 1.04 / (1 << LG_K) ** 0.5 * min_sites)
    spread = (lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
              .select("h", F.hll_sketch_estimate("sketch").alias("est"))
              .where(F.col("est") >= min_sites - slack))
    spread = scratch.keep(spread, "spread")
    near = spread.where(F.col("est") <= min_sites + slack).select("h")
    exact = (lines.join(near, "h").select("h", "site").distinct()
             .groupBy("h").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("h"))
    return scratch.keep(spread.where(F.col("est") > min_sites + slack).select("h").unionByName(exact), "boilerplate")


def share_of_sites(rows: DataFrame) -> int:
    """The threshold for ``rows(t, site)``: half of the sites that speak for a text, within bounds."""
    speak = rows.groupBy("t").agg(F.min("site").alias("site")).select("site").distinct()
    return min(MIN_SITES, max(FEWEST, -(-speak.limit(2 * MIN_SITES).count() // 2)))


def drop_boilerplate_lines(df: DataFrame, text_col: str = "text", site_col: str = "source",
                           min_sites: int | None = MIN_SITES) -> DataFrame:
    """``df`` plus ``clean_text, n_lines, n_removed``.  Without ``min_sites`` the
    threshold is half of the sites that speak for a text, 3 to 10."""
    scratch = Scratch(df.sparkSession, "lines")
    text = F.col(f"`{text_col}`")
    site = F.coalesce(F.concat(F.lit("s"), F.col(f"`{site_col}`").cast("string")), F.lit("null"))
    docs = df.where(text.isNotNull()).select(F.xxhash64(text).alias("t"), site.alias("site"), text.alias("text"))
    # the site that speaks for a text with copies
    voice = docs.groupBy("t").agg(F.min("site").alias("voice"), F.max("site").alias("other"))
    voice = scratch.keep(voice.where("voice != other").select("t", "voice"), "voice")
    rows = scratch.keep(docs.select("t", "site", F.explode(_lines(F.col("text"))).alias("line"))
                        .select("t", "site", _trimmed(F.col("line")).alias("line"))
                        .where("line != ''").select("t", "site", F.xxhash64("line").alias("h")), "lines")
    spoken = rows.join(voice, "t", "left").select("h", F.coalesce("voice", "site").alias("site"))
    drop = boilerplate(spoken, scratch, share_of_sites(rows) if min_sites is None else min_sites)
    gone = scratch.keep(rows.join(drop, "h").select("t", "h").distinct()
                        .groupBy("t").agg(F.collect_list("h").alias("gone")), "gone")
    mine = ("clean_text", "n_lines", "n_removed")
    rest = [c for c in df.columns if c.lower() not in mine or c == text_col]
    kept = F.filter(_lines(text), lambda x: ~F.coalesce(F.array_contains("_gone.gone", F.xxhash64(_trimmed(x))), F.lit(False)))
    n = F.when(text.isNull(), 0).otherwise(F.size(_lines(text)))
    joined = df.select(*[F.col(f"`{c}`") for c in rest]).withColumn("_t", F.xxhash64(text)) \
        .join(gone.select(F.col("t").alias("_t"), F.struct("gone").alias("_gone")).hint("merge"), "_t", "left")
    out = joined.withColumn("_kept", F.when(F.col("_gone").isNotNull() & text.isNotNull(), kept))
    return out.select(*[F.col(f"`{c}`") for c in rest if c.lower() not in mine],
                      F.coalesce(F.array_join("_kept", "\n"), text).alias("clean_text"), n.alias("n_lines"),
                      F.coalesce(n - F.size("_kept"), F.lit(0)).alias("n_removed"))
