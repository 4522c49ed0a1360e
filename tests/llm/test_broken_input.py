"""Input that is cut off, repeated or named like the operators' own columns."""

import gzip
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from hirelane.llm import html_extract, packing, secrets, warc


@pytest.mark.parametrize("html", ["<a" + " b" * 5000, "<p>x" + "<a" * 20000, "<p>x" + '<a b="' * 20000, "<!--" * 20000, "<a b='\"" * 9000 + ">", "<script>" * 20000, "<p " + "=" + " " * 60000 + "<p>x"])
def test_unfinished_tags_take_linear_time(html):
    began = time.time()
    html_extract.blocks(html)
    assert time.time() - began < 3


def test_tags_are_read_as_a_browser_does():
    said = [t for _, t, _ in html_extract.blocks("<p title=\"a > b\">one</p><p data-x='>'>two<script>if (a<b && c='</p>') {}</script> more</p><!-- <p>no --><p>if a < b</p><p>5 <x y=\"z>end")]
    assert said == ["one", "two more", "if a < b", "5 end"]
    assert [t for _, t, _ in html_extract.blocks("<p>a</p><!-- never closed <p>b</p> c")] == ["a"]


def test_redact_keeps_clashing_columns(spark):
    names = ("its", "blob", "findings", "row", "hidden", "spans_found", "blob_found")
    docs = spark.createDataFrame([(1, "password = hunter22", 19), (2, "clean", 5), (3, None, 0)], "doc_id long, text string, n_chars long").withColumns({c: F.lit(7) for c in names})
    got = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert secrets.redact(docs).columns == docs.columns
    assert (got[1].text, got[1].n_chars, got[2].text, got[3].text) == ("[SECRET]", 8, "clean", None)
    assert all(r[c] == 7 for r in got.values() for c in names)


def test_a_ledger_written_twice_gives_each_row_once(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    docs = spark.createDataFrame([(1, "password = hunter22"), (2, "clean")], "doc_id long, text string")
    first = secrets.find(docs, path).collect()
    spark.read.parquet(path).write.mode("append").parquet(path)
    assert sorted(secrets.find(docs, path).collect()) == sorted(first) and len(first) == 2
    other = [("assign", r"hunter\d+", 0, 1)]
    assert secrets.rule_version(other) != secrets.rule_version(secrets.RULES)
    assert [r.findings[0].start for r in secrets.update(docs, path, rules=other).collect()] == [11]


def test_truncated_archives_name_their_problems(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>" * 400) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    place = warc.write(pages).removeprefix("file://")
    name = next(f for f in os.listdir(place) if f.startswith("part-"))
    plain = gzip.decompress(open(f"{place}/{name}", "rb").read())
    whole = {r.page_id: r.payload_digest for r in warc.read(spark, f"file://{place}").collect()}
    for k, raw in enumerate([plain[:-700], gzip.compress(plain)[:-300], plain.replace(b"Content-Length", b"Content-Lost", 1), b"not an archive", b""]):
        folder = tmp_path / str(k)
        folder.mkdir()
        (folder / "part-0").write_bytes(raw)
        rows = warc.read(spark, f"file://{folder}").collect()
        fine = [r for r in rows if r.problem is None]
        assert all(whole[r.page_id] == r.payload_digest for r in fine)
        assert (len(rows) - len(fine) >= 1) == bool(raw)
    members = b"".join(gzip.compress(x) for x in re.split(rb"(?<=\r\n\r\n)(?=WARC/)", plain))
    assert warc.gunzip(members) == (plain, None)


def test_packing_numbers_many_rounds(spark):
    # Lengths that leave gaps too large to close and too small to fill, so rounds follow rounds.
    rows = [(i, 0, 0, 1100 if i % 3 else 900, i) for i in range(600)]
    out = packing.pack(spark.createDataFrame(rows, packing.PIECES), shard=20).collect()
    fill = {}
    for r in out:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert len(out) == 600 and max(fill.values()) <= 2048 and len(fill) <= 480
