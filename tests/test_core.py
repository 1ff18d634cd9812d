from pyspark.sql import functions as F

from sieveline.functions import scalars, text
from sieveline.operators import groups


def test_scalars(spark):
    df = spark.createDataFrame([(" a  b ", "2024-02-30"), ("", "2024-02-29"), (None, "2024"), ("x", "2024-02-29\n")], "a string, d string")
    got = df.select(scalars.normalize_scalar(F.col("a")).alias("n"), scalars.deadline(F.col("d")).cast("string").alias("d")).collect()
    assert [tuple(r) for r in got] == [("a b", None), (None, "2024-02-29"), (None, None), ("x", None)]


def test_decoding(spark):
    cases = {"a &amp; b": "a & b", r"\[x\]\, y": "[x], y", r"a\nb": "a\nb", r"a\\nb": r"a\nb", r"a\qb": r"a\qb", "é": "é", "plain": "plain", "": "", None: None}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(text.decode(F.col("t"))).collect()] == list(cases.values())
    lists = spark.createDataFrame([([" a&lt;b ", None, "", "c  d"],), (None,), ([],)], "t array<string>")
    assert [r[0] for r in lists.select(scalars.normalize_list(F.col("t"))).collect()] == [["a<b", "c d"], [], []]


def test_ids(spark):
    cases = {" Abc ": "abc", "abc\n": "abc", "a b": None, "": None, None: None, "é": None, "x" * 65: None}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(scalars.source_id(F.col("t"))).collect()] == list(cases.values())
    cases = {" abc  d ": "abc d", "": None, " ": None, "a\tb": None, "x" * 257: None, "x" * 256: "x" * 256, None: None}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(scalars.identifier(F.col("t"))).collect()] == list(cases.values())


def test_visible_text(spark):
    page = "<p>a&amp;b</p><script>x</style>y</script>.c1{color:red} color: red; ABCDEF; <b>c</b>"
    assert spark.createDataFrame([(page,)], "h string").select(scalars.visible_text(F.col("h"))).first()[0] == "a&b c"


def test_visible_text_of_cut_references(spark, tmp_path):
    """The query decodes what its SQL does: references that a semicolon ends."""
    import duckdb

    import __spark_entry__ as e

    rows = [(1, "<title>a&amp</title>b&amp;&quot;"), (2, "x &ampy; &quot z &copy"), (3, "&amp;quot; &copy;"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    df.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in e.queries()["p18_visible_text"](spark, str(tmp_path)).collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        assert got == sorted(con.execute(e.oracle_sql()["p18_visible_text"]).fetchall())
    assert got[0] == (1, 'a&amp b&"')
    assert df.filter("page_id = 1").select(scalars.visible_text(F.col("html"))).first()[0] == 'a& b&"'


def test_best_of_group_and_latest(spark):
    df = spark.createDataFrame([(1, "x", 2), (2, "x", 1), (3, "y", 5)], "id int, k string, o int")
    assert {(r.id, r.group_size) for r in groups.best_of_group(df, F.col("k"), [F.col("o")]).collect()} == {(2, 2), (3, 1)}
    assert {tuple(r) for r in groups.latest(df, "k", "id", ["o"]).collect()} == {("x", 1), ("y", 3)}


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
