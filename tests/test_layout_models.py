import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hirelane.operators import layout as L
from hirelane.operators import models

WORDS = "doc string, page int, page_width double, x0 double, y0 double, x1 double, y1 double, text string"


def word(text, x, y, w=40.0, page=1):
    return ("d", page, 600.0, float(x), float(y), float(x + w), float(y + 10), text)


def test_gap_splits_a_line(spark):
    words = spark.createDataFrame([word("left", 10, 100), word("part", 55, 101.5), word("right", 300, 102)], WORDS)
    got = [(r.text, r.x0) for r in L.segments(words).orderBy("seg").collect()]
    assert got == [("left part", 10.0), ("right", 300.0)]


def test_two_columns(spark):
    rows = [word("Full width heading of the page", 20, 10, 560)]
    for i in range(12):
        rows += [word(f"leftcolumn{i}", 20, 60 + 30 * i, 150), word(f"rightcolumn{i}", 300, 60 + 30 * i, 200)]
    text = L.reading_order(L.segments(spark.createDataFrame(rows, WORDS))).first().text.split("\n")
    assert text == ["Full width heading of the page", *(f"leftcolumn{i}" for i in range(12)), *(f"rightcolumn{i}" for i in range(12))]


def test_links(spark):
    s = L.segments(spark.createDataFrame([word("code", 10, 100), word("end", 10, 200)], WORDS))
    links = spark.createDataFrame([("d", 1, 0, "https://x.org/a.", 8.0, 98.0, 30.0, 108.0), ("d", 1, 1, "https://X.org/a/", 8.0, 98.0, 30.0, 108.0), ("d", 1, 2, "https://y.org", 400.0, 400.0, 410.0, 410.0)], "doc string, page int, link int, url string, x0 double, y0 double, x1 double, y1 double")
    assert L.reading_order(s, links).first().text == "code\nhttps://x.org/a\nend\nhttps://y.org"


def test_quality_and_ocr(spark):
    d = spark.createDataFrame([("a@b.org +84 901 234 567 experience " + "x" * 300,), ("bad � text",), (None,)], "t string")
    q = [r[0] for r in d.select(L.text_quality(F.col("t"))).collect()]
    assert (q[0].needs_header_ocr, q[0].needs_bottom_ocr, q[0].needs_full_page_ocr) == (False, False, False)
    assert q[1].has_bad_glyphs and q[1].needs_full_page_ocr and q[2].needs_header_ocr
    items = spark.createDataFrame([("d", "x", 0.9, 3.0), ("d", " ", 0.9, 3.0), ("d", "y", 0.1, 3.0)], "doc string, text string, confidence double, x0 double").withColumns({c: F.lit(6.0) for c in ("y0", "x1", "y1")})
    lines, counts = L.ocr_lines(items)
    assert lines.first().x0 == 1.0 and tuple(counts.first()) == ("d", 3, 1, 1, 1)
    r = spark.createDataFrame([("d", "vi", "longer text", False), ("d", "en", "ok", True), ("e", "vi", "ab", False), ("e", "en", "abc", False)], "doc string, lang string, text string, clean boolean")
    assert {x.doc: x.text for x in L.choose_language(r, ["vi", "en"]).collect()} == {"d": "ok", "e": "abc"}


def fakes():
    """Local classes travel to workers by value."""

    class Overlap:
        def predict(self, pairs):
            if any(b == "boom" for _, b in pairs):
                raise ValueError("no score")
            return [len(set(a.split()) & set(b.split())) / 2 for a, b in pairs]

    class Lengths:
        classes = ["a", "b"]

        def encode(self, texts):
            return np.array([[len(t)] for t in texts], float)

        def predict_proba(self, x):
            p = 1 / (1 + np.exp(-x[:, 0] + 3))
            return np.column_stack([1 - p, p])

    return Overlap, Lengths


def test_pair_model(spark):
    d = spark.createDataFrame([("a b", "a b"), ("a b c", "a b c"), (None, "x")], "l string, r string").coalesce(1)
    assert [r[0] for r in d.select(models.pair_scores(F.col("l"), F.col("r"), fakes()[0])).collect()] == [100.0, 100.0, 0.0]
    d = spark.createDataFrame([("a", "boom")], "l string, r string")
    assert d.select(models.pair_scores(F.col("l"), F.col("r"), fakes()[0])).first()[0] is None


def test_line_model(spark):
    d = spark.createDataFrame(pd.DataFrame({"t": ["x", "xxxxxx"]}))
    p = [r.proba for r in models.line_probabilities(d, "t", fakes()[1], F.array(F.lit(1.0))).collect()]
    assert p[0][0] > 0.5 > p[1][0]


def test_train_line_classifier(spark):
    d = spark.createDataFrame([([float(i % 5), float(i)], "a" if i < 10 else "b") for i in range(20)], "f array<double>, label string")
    index, model = models.train_line_classifier(d, "f", "label", 50)
    assert index.labels == ["a", "b"] and model.summary.accuracy > 0.9
