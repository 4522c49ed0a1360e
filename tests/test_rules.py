import io
import zipfile

from pyspark.sql import functions as F

from hirelane.operators import quality_rules as Q
from hirelane.operators import textviews as V
from hirelane.sources import documents

RESUME = "id string, source string, candidate_level string, raw_text string, summary string, skills array<string>, normalized_skills array<string>, projects array<struct<name:string,description:string>>, anonymized boolean, language string"
PAIR = "id string, resume_id string, job_description_id string, split string, label string, overall_score int, criterion_scores map<string,int>, label_notes string, label_version string"
CRITERIA = dict.fromkeys(["SKILLS_MATCH", "EXPERIENCE_RELEVANCE", "PROJECT_RELEVANCE", "EDUCATION_CERTIFICATION", "KEYWORD_DOMAIN_ALIGNMENT"], 50)


def rules(df):
    return sorted((r.key, r.rule) for r in df.collect() if r.level == "error")


def test_resume_rules(spark):
    good = ("r1", "web", "junior", "text", None, [], [], [], True, "en")
    d = spark.createDataFrame([good, ("r2", "", "boss", "mail a@b.org", None, None, [], [], None, "fr")], RESUME)
    got = rules(Q.resumes(d))
    assert {k for k, _ in got} == {"r2"} and {"source is missing", "unknown candidate_level", "unknown language", "not anonymized", "text has email", "skills must be a list"} <= {r for _, r in got}
    assert ("r1", "raw_text too short") in rules(Q.resumes(d, strict=True))


def test_pair_rules(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    note = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([("p1", "r1", "j1", "train", "weak_match", 50, CRITERIA, note, "rubric_v0.2"), ("p2", "r9", "j1", "dev", "strong_match", 50, {"SKILLS_MATCH": 120}, "x", "old")], PAIR)
    got = Q.pairs(d, ids("r1"), ids("j1"))
    assert {k for k, _ in rules(got)} == {"p2"}
    assert {"unknown resume_id", "unknown split", "label doesn't match the score", "criteria don't match the rubric", "criterion score out of range"} <= {r for _, r in rules(got)}
    assert sorted(r.rule for r in got.collect() if r.level == "warning") == ["label_notes too short", "old label_version"]
    assert not Q.readiness(d).first().ready


def test_lines_ids_and_states(spark):
    lines = spark.createDataFrame([("a", i, "t", "x") for i in range(3)] + [("a", 3, " ", "zz")], "doc_id string, line_index int, text string, label string")
    assert sorted(r.rule for r in Q.labelled_lines(lines, ["x"]).collect()) == ["empty text", "few labels", "few lines", "unknown label"]
    e, a = spark.createDataFrame([("1",), ("2",)], "id string"), spark.createDataFrame([("2", 1, True), ("2", 2, True), ("3", 3, True)], "id string, n int, ok boolean")
    assert sorted(tuple(r) for r in Q.reconcile_ids(e, a).collect()) == [("1", "missing"), ("3", "unexpected")]
    assert [r.state for r in Q.accept(a, e, F.col("ok"), "id", "n").orderBy("n").collect()] == ["accepted", "duplicate", "unexpected"]
    rounds = spark.createDataFrame([("r1", 1)], "id string, round int"), spark.createDataFrame([("j1", 2)], "id string, round int")
    p = spark.createDataFrame([("p", "r1", "j1")], "id string, resume_id string, job_description_id string")
    assert [r.key for r in Q.round_mismatch(p, *rounds).collect()] == ["p"]


def test_views(spark):
    t = 'a ```json\n{"pair_id": "p1", "overall_score": 3}\n``` ```json\n{bad\n```'
    bare = 'x {"pair_id": "p2", "c": {"k": 1}} {"other": 1}'
    d = spark.createDataFrame([(t,), (bare,), (None,)], "t string")
    got = [[x.pair_id for x in (r[0] or [])] for r in d.select(V.json_blocks(F.col("t"), "pair_id string, overall_score int")).collect()]
    assert got[:2] == [["p1"], ["p2"]]
    assert spark.createDataFrame([("resume_7",), ("resume_12",), ("resume_x",), ("jd_99",)], "i string").select(V.max_numeric_id(F.col("i"), "resume_")).first()[0] == 12
    assert V.fill_targets({"a": 5, "b": 0, "c": 1}, 4) == {"a": 0, "b": 2, "c": 2} or sum(V.fill_targets({"a": 5, "b": 0, "c": 1}, 4).values()) == 4
    assert spark.range(1).select(V.list_with_rest(F.array(*[F.lit(x) for x in "abcdefg"]))).first()[0] == "a, b, c, d, e (+2 more)"


def docx(paragraphs, rows):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(p, paragraphs))}<w:tbl>{table}</w:tbl></w:body></w:document>")
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(["One", " ", "Two"], [["x", "y"], ["", "z"]]))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_bytes(b"other")
    got = {r.path[-6:]: r for r in documents.extract_docx(documents.read_files(spark, f"file://{tmp_path}")).collect()}
    assert got["a.docx"].text == "One\nTwo\nx | y\nz" and got["b.docx"].text is None and got["b.docx"].warning and len(got) == 2
    bad = spark.createDataFrame([("t", None, None, None), (None, None, None, None), (None, "u", None, "PDF")], "raw_text string, signed_url string, file_name string, file_type string")
    assert documents.input_errors(bad).count() == 2
