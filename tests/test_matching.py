import hashlib

from pyspark.sql import functions as F

from sieveline.functions import matching as m


def values(spark, rows, ddl, **cols):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_canonical_url(spark):
    cases = {
        "HTTPS://Ex.com:443//a//b/?q#f": "https://ex.com/a/b", "https://ex.com": "https://ex.com/", "https://ex.com:8443/%e3%Ab/": "https://ex.com:8443/%E3%AB",
        "http://ex.com/": None, "https://u@ex.com/": None, "https://ex.com/%zz": None, "https://ex..com/": None, "https://-ex.com/": None,
        "https://1.2.3.256/": None, "https://1.2.3.4/": "https://1.2.3.4/", "https://ex.com:0/": None, "https://ex.com/a b": None, "": None, None: None,
    }
    assert [r[0] for r in values(spark, [(u,) for u in cases], "u string", c=m.canonical_url(F.col("u")))] == list(cases.values())


def test_text(spark):
    t = F.col("t")
    got = values(spark, [("x A: one  B: two",), ("none",), (None,)], "t string", s=m.section(t, ["A:"], ["B:", "C:"]), k=m.keyword_filter(t, ["one"], ["bad"]), r=m.role_match(t, ["two/one", "/", "", " \t"]), c=m.truncate(t, 5))
    assert got == [("one", True, True, "x A:…"), ("", True, False, "none"), (None, False, False, None)]
    assert values(spark, [("a\n\n•b   c ㆍd",)], "t string", q=m.requirement_lines(t, 2)) == [(["a", "b c"],)]
    assert values(spark, [([" b\n", "a", "", "b", None],)], "t array<string>", q=m.ordered_distinct(t)) == [(["b", "a"],)]
    key = hashlib.sha256(b'posting-v3\0{"kind":"id","value":null}').hexdigest()[:32]
    assert values(spark, [(None,)], "t string", q=m.hashed_key("posting-v3", F.struct(F.lit("id").alias("kind"), t.alias("value")))) == [(key,)]


def test_roles_fold_case_and_white_space(spark):
    t = F.col("t")
    assert [r[0] for r in values(spark, [("SENIOR  Data Engineer",), ("Straße",), ("x",)], "t string", q=m.role_match(t, ["data engineer", "STRASSE"]))] == [True, True, False]


def test_requirement_lines_of_a_text_without_any(spark):
    texts = [" \n• ", "•" * 241, "", None, "a\n"]
    assert [r[0] for r in values(spark, [(t,) for t in texts], "t string", q=m.requirement_lines(F.col("t")))] == [[" \n• "], ["•" * 239 + "…"], [], None, ["a"]]


def test_section_lines(spark):
    texts = ["Intro\n주요업무\nbuild\nrun\n우대사항\nnice", "nothing", "주요업무", None]
    assert [r[0] for r in values(spark, [(t,) for t in texts], "t string", q=m.section_lines(F.col("t"), ["우대사항", "주요업무"]))] == [["nice"], [], ["주요업무"], []]


def test_scores(spark):
    n, d = F.col("n"), F.col("d")
    got = values(spark, [(1, 3), (1, 0), (3, 3), (1, 16)], "n int, d int", c=m.component(40, n, d), s=m.total_score({"required": (n, d), "preferred": (n, d)}, n))
    assert got == [(13, 7), (0, 0), (40, 50), (3, 0)]
    flag = lambda x: F.lit(bool(x))
    labels = [m.disposition(flag(i), F.lit(g), flag(e), flag(b), flag(q), F.lit(s)) for i, g, e, b, q, s in ((1, 1, 1, 1, 1, 99), (0, 1, 1, 1, 1, 9), (0, 0, 1, 1, 1, 9), (0, 0, 0, 1, 1, 9), (0, 0, 0, 0, 1, 9), (0, 0, 0, 0, 0, 75), (0, 0, 0, 0, 0, 50), (0, 0, 0, 0, 0, 49))]
    assert values(spark, [(1,)], "x int", a=F.array(*labels)) == [(["exclude", "hold", "expired", "exclude", "manual_review", "apply", "hold", "low_priority"],)]
