import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hirelane.functions import dates as DT
from hirelane.functions import extract as X
from hirelane.functions import text as T


def as_of():
    return F.lit("2024-06-15").cast("date")


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def many(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


def folded(s):
    return unicodedata.normalize("NFKD", (s or "").replace("Đ", "D").replace("đ", "d")).encode("ascii", "ignore").decode()


def test_fold_ascii(spark):
    values = [None, "", "Đường đến", "ﬁn ½ Ⅻ ß", "naïve — 日本", "é", "ＡＢ"]
    assert many(spark, values, T.fold_ascii) == [folded(v) for v in values]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs"]), max_size=12), min_size=20, max_size=40))
def test_fold_ascii_of_any_text(spark, values):
    assert many(spark, values, T.fold_ascii) == [folded(v) for v in values]


def test_tokens_keep_dots_and_symbols(spark):
    assert one(spark, "C++, C# and SQL. rest_API ci/cd", T.tokens) == ["c++", "c#", "and", "sql.", "rest", "api", "ci", "cd"]
    assert one(spark, "Rest_API", T.norm) == "rest api"
    assert one(spark, None, T.tokens) == []


def test_meaningful(spark):
    assert many(spark, ["data", "data platform", "sql", "go", "data lake"], T.is_meaningful) == [False, False, True, False, True]


def test_lines_and_keys(spark):
    assert one(spark, " a\r\nb\x0bc  \n\n d", T.split_lines) == ["a", "b", "c", "d"]
    assert one(spark, "Học vấn & Kỹ năng", T.heading_key) == "hoc van and ky nang"
    assert many(spark, ["•Created x", "12) y", "- z", "1.5 w"], T.strip_list_marker) == ["Created x", "y", "z", "5 w"]
    assert one(spark, "a\x00  b\r\n\r\n\r\nc", T.sanitize) == "a b\n\nc"
    assert one(spark, "B\na\nb\n\nA", lambda c: T.first_by_key(F.split(c, "\n"), F.lower)) == ["B", "a"]


def test_dates(spark):
    values = ["Sept 2020", "06/2021", "2020-13", "31.02.2020", "May 2019", "March, 2018", "5 Jan 2017", "2016", "Present", "hiện tại", "2015 Dec", "soon", None]
    want = ["2020-09", "2021-06", None, None, "2019-05", "2018-03", "2017-01", "2016-01", "present", "present", "2015-12", None, None]
    assert many(spark, values, lambda c: DT.label(c, as_of())) == want


def test_durations(spark):
    assert many(spark, ["2 years 3 months", "1.5 yrs", "2 năm 6 tháng", "none", "0.125 years"], DT.explicit_months) == [27, 18, 30, None, 2]
    r = one(spark, "Dev, 06/2021 – Present", lambda c: DT.date_range(c, as_of()))
    assert (r.start_date, r.end_date, r.duration_months) == ("2021-06", "present", 36)
    assert one(spark, "no dates", lambda c: DT.date_range(c, as_of())) is None
    assert one(spark, "Jan 2021 to Mar 2020", lambda c: DT.date_range(c, as_of())).duration_months == 0


def test_contacts(spark):
    t = "a.b@x.org, A.B@x.org a.b@x.org +84 (90) 123-45678, 12345 https://x.org/a."
    assert one(spark, t, X.emails) == ["a.b@x.org", "A.B@x.org"]
    assert one(spark, t, X.phones) == ["+849012345678"]
    assert one(spark, t, X.links) == ["https://x.org/a"]
