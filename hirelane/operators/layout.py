"""Page layout: words to reading-order text, links to segments, text quality and OCR choice.

Grouping words into lines follows a running mean, so a page is folded in one Arrow-batched call; a group is one page and
never more.  The rest are Column expressions and joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import EMAIL, PHONE

#: Fixed values of the layout rules, in points or shares of the page width.
Y_TOLERANCE, SEGMENT_GAP, GAP_SHARE, FULL_WIDTH, BAND, LINK_SLACK = 3.0, 36.0, 0.06, 0.72, 48.0, 4.0
SPLIT, SPLIT_LOW, SPLIT_HIGH = 0.38, 0.28, 0.55
LEAST_CANDIDATES, LEAST_SIDE, LEAST_LONG, LONG_TEXT, LEAST_BANDS, DATE_SHARE = 16, 8, 6, 8, 4, 0.65
SHORT_DATE = r"(?:\d{1,2}/)?\d{4}(?:\s*[-–]\s*(?:present|\d{1,2}/)?\d{4})?|present|current"
SEGMENTS = "doc string, page int, seg int, x0 double, y0 double, x1 double, y1 double, text string, page_width double"


def line_numbers(y: np.ndarray) -> np.ndarray:
    """Line of each item in order of y: an item joins a line whose mean y is near enough."""
    out, n, total, line = np.zeros(len(y), np.int64), 0, 0.0, -1
    for i, v in enumerate(y.tolist()):
        if n and abs(v - total / n) <= Y_TOLERANCE:
            n, total = n + 1, total + v
        else:
            line, n, total = line + 1, 1, v
        out[i] = line
    return out


def segments(words: DataFrame) -> DataFrame:
    """SEGMENTS of (doc, page, page_width, x0, y0, x1, y1, text) words: lines cut at wide gaps."""

    def page(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["y0", "x0"], kind="stable").reset_index(drop=True)
        g["line"] = line_numbers(g["y0"].to_numpy())
        g = g.sort_values(["line", "x0"], kind="stable").reset_index(drop=True)
        wide = max(SEGMENT_GAP, float(g["page_width"].iloc[0]) * GAP_SHARE)
        new = (g["line"] != g["line"].shift()) | (g["x0"] - g["x1"].shift() > wide)
        s = g.groupby(new.cumsum()).agg(doc=("doc", "first"), page=("page", "first"), x0=("x0", "min"), y0=("y0", "min"), x1=("x1", "max"), y1=("y1", "max"), text=("text", lambda t: " ".join(map(str, t)).strip()), page_width=("page_width", "first"))
        return s.assign(seg=range(len(s)))[["doc", "page", "seg", "x0", "y0", "x1", "y1", "text", "page_width"]]

    return words.groupBy("doc", "page").applyInPandas(page, SEGMENTS)


def _column_split(s: DataFrame) -> DataFrame:
    """(doc, page, split_x) of the pages with two columns."""
    weight = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    c = s.withColumns({"weight": weight, "left": F.col("x0") < F.col("page_width") * SPLIT}).where("weight >= 2")
    long = F.col("weight") >= LONG_TEXT
    bands = F.when(long, F.sequence(F.floor(F.col("y0") / BAND), F.floor(F.col("y1") / BAND)))
    date = F.lower(F.trim("text")).rlike(f"^(?:{SHORT_DATE})$") & (F.size(F.split(F.trim("text"), r"\s+")) <= 4)
    side = lambda flag, c: F.when(F.col("left") if flag else ~F.col("left"), c)
    a = c.groupBy("doc", "page", "page_width").agg(
        F.count("*").alias("n"), F.count(side(True, F.lit(1))).alias("nl"), F.count(side(False, F.lit(1))).alias("nr"),
        F.count(side(True, F.when(long, 1))).alias("ll"), F.count(side(False, F.when(long, 1))).alias("lr"),
        F.median(side(True, F.when(long, F.col("x1")))).alias("mx"), F.median(side(False, F.when(long, F.col("x0")))).alias("mr"),
        F.flatten(F.collect_list(side(True, bands))).alias("bl"), F.flatten(F.collect_list(side(False, bands))).alias("br"),
        F.sum(side(False, date.cast("int"))).alias("dates"),
    )
    two = (F.col("n") >= LEAST_CANDIDATES) & (F.least("nl", "nr") >= LEAST_SIDE) & (F.least("ll", "lr") >= LEAST_LONG) & (F.col("mr") - F.col("mx") >= F.col("page_width") * GAP_SHARE)
    two = two & (F.size(F.array_intersect("bl", "br")) >= LEAST_BANDS) & (F.col("dates") / F.greatest("nr", F.lit(1)) <= DATE_SHARE)
    x = F.greatest(F.least((F.col("mx") + F.col("mr")) / 2, F.col("page_width") * SPLIT_HIGH), F.col("page_width") * SPLIT_LOW)
    return a.where(two).select("doc", "page", x.alias("split_x"))


def link_segments(s: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, page, link, url, seg): the first segment, in order, that a link's rectangle overlaps; null without one.

    links: (doc, page, link, url, x0, y0, x1, y1).
    """
    a, b = s.alias("a"), links.alias("b")
    near = (F.col("b.x1") >= F.col("a.x0") - LINK_SLACK) & (F.col("b.x0") <= F.col("a.x1") + LINK_SLACK) & (F.col("b.y1") >= F.col("a.y0") - LINK_SLACK) & (F.col("b.y0") <= F.col("a.y1") + LINK_SLACK)
    hit = b.join(a, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.page") == F.col("b.page")) & near, "left")
    return hit.groupBy("b.doc", "b.page", "b.link", "b.url").agg(F.min("a.seg").alias("seg"))


def reading_order(s: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(doc, page, text): segments top to bottom, or full-width, left and right ones on pages of two columns; a segment's links follow it, the unmatched ones the page."""
    d = s.join(_column_split(s), ["doc", "page"], "left")
    place = F.when(F.col("split_x").isNull() | (F.col("x1") - F.col("x0") >= F.col("page_width") * FULL_WIDTH), 0).when(F.col("x0") < F.col("split_x"), 1).otherwise(2)
    rows = d.select("doc", "page", place.alias("place"), "y0", "x0", "seg", F.lit(-1).alias("link"), "text").where("text != ''")
    if links is not None:
        found = link_segments(s, links)
        clean = F.regexp_replace(F.trim("url"), r"[.,;)]+$", "")
        found = found.withColumn("url", clean).where(F.col("url").rlike("(?i)^https?://"))
        first = Window.partitionBy("doc", "page", F.lower(F.regexp_replace("url", "/+$", ""))).orderBy(F.col("seg").isNull(), "link")
        found = found.withColumn("n", F.row_number().over(first)).where("n = 1")
        at = found.join(rows.where("link = -1").select("doc", "page", "seg", "place", "y0", "x0"), ["doc", "page", "seg"], "left")
        rows = rows.unionByName(at.select("doc", "page", F.coalesce("place", F.lit(9)).alias("place"), "y0", "x0", "seg", "link", F.col("url").alias("text")))
    key = F.struct("place", "y0", "x0", "seg", "link", "text")
    return rows.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["text"]), "\n").alias("text"))


def text_quality(text: Column, bad_glyphs: list[str] | None = None) -> Column:
    """struct of what an extracted text has and which regions need OCR."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    marks = bad_glyphs or ["�", "□", "(cid:"]
    bad = sum(((F.length(t) - F.length(F.replace(t, F.lit(m), F.lit("")))) / len(m) for m in marks), F.lit(0.0))
    ratio = bad / F.greatest(F.length(t), F.lit(1))
    has = {"has_email": t.rlike(EMAIL), "has_phone": t.rlike(PHONE), "has_github": low.contains("github.com"), "has_linkedin": low.contains("linkedin.com"), "has_education": low.contains("education") | low.contains("academic"), "has_projects": low.contains("project"), "has_experience": low.contains("experience")}
    return F.struct(
        *[c.alias(k) for k, c in has.items()],
        ratio.alias("corrupted_glyph_ratio"),
        (bad > 0).alias("has_bad_glyphs"),
        ((bad > 0) | ~has["has_email"] | ~has["has_phone"]).alias("needs_header_ocr"),
        (~has["has_experience"]).alias("needs_bottom_ocr"),
        ((F.length(t) < 300) | (ratio > 0.03) | (bad > 0)).alias("needs_full_page_ocr"),
    )


def ocr_regions(q: Column) -> Column:
    pick = lambda c, names: F.when(c, F.array(*[F.lit(n) for n in names])).otherwise(F.array().cast("array<string>"))
    return F.concat(pick(q["needs_header_ocr"], ["header", "left_sidebar", "top_left", "top_right"]), pick(q["needs_bottom_ocr"], ["bottom", "bottom_right"]), pick(q["needs_full_page_ocr"], ["full_page"]))


def ocr_lines(items: DataFrame, least: float = 0.5, zoom: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(lines, counts per document) of OCR items (doc, page, region, x0..y1, text, confidence): empty and doubtful ones dropped, boxes scaled back."""
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    doubtful = ~empty & (F.coalesce("confidence", F.lit(0.0)) < least)
    n = lambda c: F.sum(c.cast("int"))
    counts = items.groupBy("doc").agg(F.count("*").alias("raw"), n(~empty & ~doubtful).alias("accepted"), n(empty).alias("rejected_empty"), n(doubtful).alias("rejected_low_confidence"))
    return items.where(~empty & ~doubtful).withColumns({c: F.col(c) / zoom for c in ("x0", "y0", "x1", "y1")}), counts


def choose_language(results: DataFrame, order: list[str]) -> DataFrame:
    """(doc, lang, text): of OCR results (doc, lang, text, clean) the first clean one in order, else the longest."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("lang"))
    rank = F.struct(F.col("clean").cast("int"), F.when(F.col("clean"), -place).otherwise(F.length("text").cast("long")), (-place).alias("tie"))
    return results.groupBy("doc").agg(F.max_by(F.struct("lang", "text"), rank).alias("r")).select("doc", "r.*")


def merge_ocr(primary: Column, ocr: Column, corrupt: Column, ocr_clean: Column) -> Column:
    """OCR text in place of a corrupt one if it's clean and at least half as long."""
    return F.when(corrupt & ocr_clean & (F.length(ocr) >= 0.5 * F.length(primary)), ocr).otherwise(primary)
