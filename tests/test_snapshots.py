import json
import sqlite3

import pytest

from plainlake import api
from plainlake.__main__ import main
from plainlake.operators import compare, infer, order
from plainlake.plans import show
from plainlake.plans.sql_runner import ReadOnlyError, run_sql, to_spark
from plainlake.sources import ddl, hooks, settings, snapshot


@pytest.fixture
def database(tmp_path):
    path = tmp_path / "store.sqlite"
    con = sqlite3.connect(path)
    con.executescript(
        """CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, score REAL);
        CREATE TABLE orders (id INTEGER PRIMARY KEY, user_id INTEGER REFERENCES users(id), amount REAL, note TEXT, raw BLOB);
        CREATE INDEX by_user ON orders(user_id);
        CREATE VIEW totals AS SELECT u.name, count(o.id) AS n, sum(o.amount) AS total FROM users u LEFT JOIN orders o ON o.user_id = u.id GROUP BY u.name;
        CREATE VIEW big AS SELECT * FROM totals WHERE total > 20;
        INSERT INTO users VALUES (1, 'Ann', 95.0), (2, 'Bo "B", x', 87.5), (10, 'Cy\nnew', NULL);
        INSERT INTO orders VALUES (1, 1, 9.99, NULL, x'cafe'), (2, 1, 19.99, '', NULL), (3, 2, 5, '\\N?', x'00');"""
    )
    con.commit()
    con.close()
    return path


def test_round_trips_keep_the_checksum(spark, database, tmp_path):
    first = api.checksum(database, spark)
    api.to_csv(database, tmp_path / "a.tables", spark)
    assert (tmp_path / "a.tables" / "users.csv").read_bytes() == b'"id","name","score"\n"1","Ann","95"\n"10","Cy\nnew","\\N"\n"2","Bo ""B"", x","87.5"\n'
    assert (tmp_path / "a.tables" / "orders.csv").read_text().splitlines()[1] == '"1","1","9.99","\\N","cafe"'
    assert api.checksum(tmp_path / "a.tables", spark) == first
    api.to_sqlite(tmp_path / "a.tables", tmp_path / "b.sqlite", spark)
    assert api.checksum(tmp_path / "b.sqlite", spark) == first
    api.to_parquet(tmp_path / "b.sqlite", tmp_path / "c.parquetdir", spark)
    assert api.checksum(tmp_path / "c.parquetdir", spark) == first
    api.to_csv(tmp_path / "c.parquetdir", tmp_path / "d.tables", spark, compressed=True)
    assert (tmp_path / "d.tables" / "users.csv.gz").exists()
    assert api.checksum(tmp_path / "d.tables", spark) == first
    with pytest.raises(FileExistsError):
        api.to_csv(database, tmp_path / "a.tables", spark)


def test_duckdb_round_trip(spark, database, tmp_path):
    pytest.importorskip("duckdb")
    api.to_duckdb(database, tmp_path / "x.duckdb", spark)
    s = api.load(tmp_path / "x.duckdb", spark)
    assert sorted(r["id"] for r in s["users"].collect()) == [1, 2, 10]
    assert s.pk("users") == ["id"]


def test_views_and_sql(spark, database):
    s = api.load(database, spark)
    assert [tuple(r) for r in s.sql("SELECT name, n FROM big").collect()] == [("Ann", 2)]
    assert show.to_csv(s.sql("SELECT id, score FROM users ORDER BY id")) == "id,score\n1,95\n2,87.5\n10,\n"
    assert "NULL" in show.to_table(s.sql("SELECT score FROM users")) and "(3 rows)" in show.to_table(s.sql("SELECT score FROM users"))
    for bad in ("DROP TABLE users", "INSERT INTO users VALUES (1)", "WITH t AS (SELECT 1 AS a) INSERT INTO users SELECT a, 'x', 1 FROM t"):
        with pytest.raises(Exception) as e:
            run_sql(bad, {}, spark)
        assert isinstance(e.value, ReadOnlyError) or "INSERT" in bad
    assert to_spark("SELECT \"a b\", 'SEMI JOIN' FROM t SEMI JOIN u USING (k)") == "SELECT `a b`, 'SEMI JOIN' FROM t LEFT SEMI JOIN u USING (k)"
    assert not spark.catalog.tableExists("users") and not spark.catalog.tableExists("big")  # no view stays
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        run_sql("SELECT * FROM users", {}, spark)


SPELLINGS = {
    "SELECT regexp_replace('aba', 'a', 'b') AS x": "bba",
    "SELECT regexp_replace('a1b2', '([a-z])([0-9])', '\\2\\1') AS x": "1ab2",
    "SELECT sha256(concat('a', 'b')) AS x": "fb8e20fc2e4c3f248c60c39bd652f3c1347298bb977b8b4d5903b85055620603",
    "SELECT 7//2 AS x": 3, "SELECT CAST(2.7e0 AS INTEGER) AS x": 3, "SELECT 2.5e0::INT AS x": 2, "SELECT CAST(2.5 AS INT) AS x": 3, "SELECT try_cast('x' AS INTEGER) AS x": None,
    "SELECT 1 / 0 AS x": float("inf"), "SELECT -1 / 0.0e0 AS x": float("-inf"), "SELECT 7 / 2 AS x": 3.5, "SELECT 2 ** 3 ^ 2 AS x": 64.0,
    "SELECT list_transform([1, 2], lambda x: x * 10)[2] AS x": 20, "SELECT [1, 2, 3][2:3][1] AS x": 2, "SELECT len('abc') AS x": 3, "SELECT len([1, 2]) AS x": 2, "SELECT [1][5] AS x": None,
    "SELECT strftime(TIMESTAMP '2024-01-02 03:04:05', '%Y-%m-%d, %H h') AS x": "2024-01-02, 03 h", "SELECT date_diff('hour', TIMESTAMP '2024-01-01 00:59:00', TIMESTAMP '2024-01-01 01:00:00') AS x": 1,
    "SELECT 'it''s \\d' AS x": "it's \\d", "SELECT string_agg(a, '+' ORDER BY a DESC) AS x FROM (VALUES ('p'), ('q'), (NULL)) t(a)": "q+p", "SELECT list(a ORDER BY a)[1] AS x FROM (VALUES (3), (1)) t(a)": 1,
    "SELECT max(range) AS x FROM range(5)": 4, "SELECT sum(generate_series) AS x FROM generate_series(1, 3)": 6, "SELECT x FROM (SELECT unnest([4]) AS x)": 4, "SELECT a AS x FROM (VALUES (1), (3), (2)) t(a) QUALIFY rank() OVER (ORDER BY a DESC) = 1": 3,
    "SELECT a AS x FROM (VALUES (NULL), (2)) t(a) ORDER BY a LIMIT 1": 2, "SELECT a AS x FROM (VALUES (NULL), (2)) t(a) ORDER BY a DESC LIMIT 1": 2, "SELECT a AS x FROM (VALUES (NULL), (2)) t(a) ORDER BY a NULLS FIRST LIMIT 1": None,
    "SELECT round(skewness(a), 4) AS x FROM (VALUES (1), (2), (9)) t(a)": 1.6301, "SELECT CASE WHEN 3 / 2 > 1 THEN 'a' ELSE 'b' END AS x": "a", "SELECT (SELECT 5) / 2 AS x": 2.5, "SELECT 1 - 6 / 4 AS x": -0.5,
}


@pytest.mark.parametrize("text", SPELLINGS)
def test_spellings(spark, text):
    """The other engine says the same of the same text."""
    duckdb = pytest.importorskip("duckdb")
    got = run_sql(text, {}, spark).first()[0]
    assert got == SPELLINGS[text] and duckdb.sql(text).fetchall()[0][0] == SPELLINGS[text]


def test_incremental(spark, database, tmp_path):
    to = tmp_path / "i.tables"
    assert api.to_csv(database, to, spark, incremental=True) == {"orders": "added", "users": "added"}
    con = sqlite3.connect(database)
    con.execute("UPDATE users SET score = 1 WHERE id = 1")
    con.commit()
    assert api.to_csv(database, to, spark, incremental=True) == {"orders": "unchanged", "users": "updated"}
    assert api.to_csv(database, to, spark, incremental=True, tables=["users"]) == {"users": "unchanged"}
    assert (to / "orders.csv").exists()


def test_validate(spark, database, tmp_path):
    api.to_csv(database, tmp_path / "v.tables", spark)
    assert api.validate(spark, tmp_path / "v.tables").ok
    f = tmp_path / "v.tables" / "users.csv"
    good = f.read_text()
    f.write_text(good + '"1","again","3"\n')
    assert "duplicate keys" in api.validate(spark, tmp_path / "v.tables").errors[0]
    f.write_text(good + '"7","short"\n')
    assert not api.validate(spark, tmp_path / "v.tables").ok
    f.write_text(good.replace('"score"', '"points"'))
    assert "columns" in api.validate(spark, tmp_path / "v.tables").errors[0]
    f.unlink()
    r = api.validate(spark, tmp_path / "v.tables")
    assert r.ok and r.warnings


def test_init_infers_keys(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "categories.csv").write_text("id,name\n1,a\n2,b\n")
    (raw / "products.csv").write_text("id,name,price,category_id,made,ok\n1,x,1.5,1,2024-01-15,yes\n2,y,2,2,2024-01-15T10:30:00,\n")
    found = {t.table: t for t in api.init(spark, raw, tmp_path / "out.tables")}
    p = found["products"]
    assert p.columns == {"id": "INTEGER", "name": "TEXT", "price": "REAL", "category_id": "INTEGER", "made": "TIMESTAMP", "ok": "BOOLEAN"}
    assert (p.pk, p.foreign, p.nullable["ok"]) == ("id", [("category_id", "categories", "id")], True)
    text = (tmp_path / "out.tables" / "schema.sql").read_text()
    assert text.index('"categories"') < text.index('"products"')
    assert api.validate(spark, tmp_path / "out.tables").ok


@pytest.mark.parametrize(("values", "kind"), [({"1", "t"}, "INTEGER"), ({"1", "2.5"}, "REAL"), ({"2024-01-15", "2024-01-15 10:00:00"}, "TIMESTAMP"), ({"2024-01-15", "1"}, "TEXT"), ({"007"}, "INTEGER"), ({"2024-1-15"}, "TEXT"), (set(), "INTEGER"), ({"nan"}, "TEXT"), ({"99999999999999999999"}, "REAL")])
def test_widening(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in sorted(values)] + [("",)], "v string")
    assert infer.infer_table("t", df).columns["v"] == kind


def test_diff_and_merge(spark, database, tmp_path):
    for n in ("base", "left", "right"):
        api.to_csv(database, tmp_path / n, spark)
    assert all(df.count() == 0 for df in api.diff(tmp_path / "base", tmp_path / "left", spark).values())
    f = tmp_path / "left" / "users.csv"
    f.write_text(f.read_text().replace('"95"', '"96"'))
    g = tmp_path / "right" / "users.csv"
    g.write_text(g.read_text().replace('"95"', '"97"').replace('"87.5"', '"88"') + '"11","Di","1"\n')
    d = api.diff(tmp_path / "base", tmp_path / "left", spark)["users"].collect()
    assert [(r["id"], r["kind"], [tuple(c) for c in r["columns"]]) for r in d] == [("1", "modified", [("score", "95", "96")])]
    rows, tables = api.merge(tmp_path / "base", tmp_path / "left", tmp_path / "right", tmp_path / "m", spark=spark)
    assert {(r["id"], r["class"]) for r in rows["users"].collect()} == {("1", "modify_modify"), ("2", "right"), ("10", "unchanged"), ("11", "right_add")} and not tables
    assert {r["id"]: r["score"] for r in api.load(tmp_path / "m", spark)["users"].collect()} == {1: 96.0, 2: 88.0, 10: None, 11: 1.0}
    theirs, _ = api.merge(tmp_path / "base", tmp_path / "left", tmp_path / "right", strategy="theirs", spark=spark)
    assert theirs["users"].filter("id = '1'").first()["result"]["score"] == "97"
    same, _ = api.merge(tmp_path / "base", tmp_path / "base", tmp_path / "right", spark=spark)
    assert compare.diff(compare.merged_table(same["users"], ["id"]), snapshot.load(spark, tmp_path / "right", raw=True)["users"], ["id"]).count() == 0


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.0), (2, "b", 1.0)], "k int, s string, d double")
    f = lambda x: tuple(compare.fingerprint(x).first())
    assert f(df) == f(df.repartition(3)) != f(df.distinct())
    assert f(spark.createDataFrame([("ab", "c")], "a string, b string")) != f(spark.createDataFrame([("a", "bc")], "a string, b string"))
    assert f(df.limit(0))[0] == 0


def test_canonical_values(spark):
    from pyspark.sql import functions as F

    from plainlake.functions.canon import double_text, natural_key, normal_value

    want = {"": "", "42.0": "42", "1e5": "100000", "007": "7", "3.14159265358979": "3.1415926536", "1.1000000000001": "1.1", "hello": "hello", " 5": " 5", "5d": "5d", "Infinity": "inf", "-0.0": "0", ".5": "0.5"}
    df = spark.createDataFrame([(k,) for k in want], "v string")
    assert {r["v"]: r["n"] for r in df.select("v", normal_value(F.col("v")).alias("n")).collect()} == want
    d = spark.createDataFrame([(1e7,), (42.0,), (0.12345,), (1e-5,), (None,)], "d double")
    assert [r[0] for r in d.select(double_text(F.col("d"))).collect()] == ["10000000", "42", "0.12345", "0.00001", None]
    names = ["a1b10", "item10", "item2", "", "10", "2", "a1b2", "item", "x99999999999999999999999", "x1"]
    got = [r["v"] for r in spark.createDataFrame([(n,) for n in names], "v string").orderBy(natural_key(F.col("v"))).collect()]
    assert got == ["", "2", "10", "a1b2", "a1b10", "item", "item2", "item10", "x99999999999999999999999", "x1"]


def test_orders(spark):
    df = spark.createDataFrame([(k,) for k in (10, 2, 1)], "id int")
    assert [r["id"] for r in order.ordered(df, ["id"]).collect()] == [1, 10, 2]
    assert [r["id"] for r in order.ordered(df, order_by="id DESC").collect()] == [10, 2, 1]
    with pytest.raises(ValueError):
        order.ordered(df)
    assert [tuple(r) for r in order.with_synthetic_key(df, ["id"]).orderBy("id").collect()] == [(1, 1), (2, 2), (3, 10)]
    d = spark.createDataFrame([(None, 1), (None, 1), ("", 1)], "a string, b int")
    assert tuple(order.duplicate_rows(d).first()) == (3, 1)


def test_ddl():
    s = ddl.parse("CREATE TABLE \"a;b\" (x TEXT DEFAULT 'p;q', k INTEGER, PRIMARY KEY (k, x)); CREATE VIEW v AS SELECT * FROM w; CREATE VIEW w AS SELECT 1 AS one")
    assert s.tables["a;b"].pk == ["k", "x"] and ddl.view_order(s.views) == ["w", "v"]
    assert ddl.parse(s.text()).tables.keys() == s.tables.keys()
    with pytest.raises(ddl.SchemaError):
        ddl.table_order({"a": "CREATE TABLE a (x INT REFERENCES b(y))", "b": "CREATE TABLE b (y INT REFERENCES a(x))"})
    with pytest.raises(ddl.SchemaError):
        ddl.parse("CREATE TABLE broken (")


def test_settings(tmp_path):
    s = settings.Settings(order_by="a DESC", null_mode="postgres", table_checksums={"t": "x"})
    (tmp_path / "any.toml").write_text(s.text())
    again = settings.load(tmp_path)
    assert (again.order_by, again.null_mode, again.table_checksums) == ("a DESC", "marker", {"t": "x"})
    assert settings.resolve(tmp_path, order="all-columns").order_by is None
    with pytest.raises(ValueError):
        settings.Settings(tables=["a"], exclude=["b"])


def test_detect(tmp_path):
    with pytest.raises(snapshot.FormatError):
        snapshot.detect(tmp_path)
    (tmp_path / "schema.sql").write_text("")
    assert snapshot.detect(tmp_path) == "csv"
    (tmp_path / "x.parquet").write_text("")
    assert snapshot.detect(tmp_path) == "parquetdir"


def test_command_line(spark, database, tmp_path, capsys):
    assert main(["to-csv", str(database), "-o", str(tmp_path / "c.tables")]) == 0
    assert main(["diff", str(database), str(tmp_path / "c.tables"), "--json"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"orders": [], "users": []}
    assert main(["sql", "SELECT count(*) AS n FROM users", str(tmp_path / "c.tables"), "--format", "csv"]) == 0
    assert capsys.readouterr().out == "n\n3\n"
    assert main(["validate", str(tmp_path / "c.tables")]) == 0
    (tmp_path / "c.tables" / "schema.sql").write_text("CREATE TABLE (")
    assert main(["validate", str(tmp_path / "c.tables")]) == 1


def test_hooks(tmp_path):
    (tmp_path / ".git").mkdir()
    assert hooks.install(tmp_path) == ["pre-commit", "post-merge"]
    (tmp_path / ".git" / "hooks" / "pre-commit").write_text("mine")
    assert hooks.install(tmp_path) == ["post-merge"]  # one of another origin is left alone
    assert hooks.uninstall(tmp_path) == ["post-merge"]
    with pytest.raises(ValueError):
        hooks.install("/")


def test_watch(tmp_path):
    from plainlake.streaming.watch import watch

    (tmp_path / "t.csv").write_text("a")
    ticks, built = [0], []

    def stop():
        ticks[0] += 1
        if ticks[0] == 3:
            (tmp_path / "t.csv").write_text("changed")
        return ticks[0] > 30 or len(built) == 2

    def build():
        built.append(1)
        if len(built) == 1:
            raise ValueError("first build fails")

    assert watch(tmp_path, build, 0.05, 0.02, stop) == 1 and len(built) == 2


def test_stream_windows(spark, tmp_path):
    from plainlake.streaming.events import deduplicated, windowed

    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(df.schema).parquet("/root/testdata/sf0.001/", pathGlobFilter="events.parquet")
    q = windowed(deduplicated(stream), "1 day").writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("w").collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in windowed(df, "1 day").collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_doubles_survive_their_text(spark):
    """Shortest, without an exponent, and the same number again."""
    from pyspark.sql import functions as F

    from plainlake.functions.canon import double_text

    from decimal import Decimal

    odd = [1e-38, 1e38, -1.5e20, 1.2345678901234567e-05, 9.007199254740992e15, 0.1, 100.5, 2.0**-44, 1e23, 1.23e22, 2e-3, 0.30000000000000004]
    plain = [format(Decimal(repr(x)), "f").removesuffix(".0") for x in odd] + ["0", "-0", "100", "NaN", "inf", "-inf"]
    odd += [0.0, -0.0, 100.0, float("nan"), float("inf"), float("-inf")]
    more = [k * 10.0**e for k in (1.7976931348623157, 3.3333333333333335, 2.2250738585072014, -7.123) for e in range(-30, 30)]
    rows = spark.createDataFrame([(float(x),) for x in [*odd, *more]], "x double").select("x", double_text(F.col("x")).alias("t")).collect()
    for r in rows:
        assert "E" not in r["t"] and (float(r["t"]) == r["x"] or r["x"] != r["x"])
    assert [r["t"] for r in rows[: len(odd)]] == plain


def test_widths_of_ranges(spark):
    """Ranges of any length, endless ones too, against all pairs."""
    from plainlake.operators.order import range_join

    inf = float("inf")
    ends = [(0.0, 1e12), (5.0, 5.5), (-3.0, 2.0), (1e-9, 2e-9), (-inf, 0.0), (7.0, inf), (4.0, 4.0), (9.0, 1.0), (-1e300, 1e300), (1024.0, 2048.0)]
    at = [-inf, -1e308, -2.5, 0.0, 1.5e-9, 1.0, 2.0, 5.25, 5.5, 1023.9, 1024.0, 2048.0, 1e11, 1e12, 1e308, None]
    r = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "r int, low double, high double")
    p = spark.createDataFrame([(i, x) for i, x in enumerate(at)], "p int, _cell double")
    got = sorted((x["p"], x["r"]) for x in range_join(p, r, "_cell", "low", "high").collect())
    assert got == sorted((i, j) for i, x in enumerate(at) for j, (a, b) in enumerate(ends) if x is not None and a <= x < b)


def test_columns_of_any_name_stay(spark):
    from plainlake.operators.order import SYNTHETIC, with_synthetic_key

    names = ["_p", "_m", "_n", "_first", "_s", "_pl0", "_pl1"]
    df = spark.createDataFrame([(i % 3, *range(i, i + len(names))) for i in range(20)], ["k", *names])
    rows = with_synthetic_key(df, ["k", "_p"]).collect()
    assert sorted(r[SYNTHETIC] for r in rows) == list(range(1, 21)) and all([r[n] for n in names] == list(range(r["_p"], r["_p"] + len(names))) for r in rows)


def test_fingerprints_of_values(spark):
    from plainlake.operators.compare import fingerprint

    of = lambda rows, kind: fingerprint(spark.createDataFrame(rows, kind)).first()["digest"]
    base = of([(1, 2.0, "a", None), (2, 0.1, None, "b")], "a long, b double, c string, d string")
    assert of([(2, 0.1 + 1e-13, None, "b"), (1, 2.0, "a", None)], "a int, b double, c string, d string") == base
    for other in ([(1, 2.0, None, "a"), (2, 0.1, None, "b")], [(1, 2.0, "a", None)], [(1, 2.0, "a", None), (2, 0.11, None, "b")], [(1, 2.0, "a", None), (2, 0.1, None, "b"), (2, 0.1, None, "b")], []):
        assert of(other, "a long, b double, c string, d string") != base
    assert of([(2,)], "a int") == of([(2.0,)], "a double") != of([("2",)], "a string")


def test_more_verbs(spark, database, tmp_path):
    assert api.sql_arrow("SELECT id FROM users ORDER BY id", database, spark).column("id").to_pylist() == [1, 2, 10]
    assert list(api.sql_pandas("SELECT id FROM users ORDER BY id", database, spark)["id"]) == [1, 2, 10]
    same = api.diff_detail(database, database, spark)
    assert same["identical"] and {t["name"] for t in same["tables"]} == {"users", "orders"}
    api.to_csv(database, tmp_path / "d.tables", spark)
    con = sqlite3.connect(database)
    con.execute("DELETE FROM users WHERE id = 10")
    con.commit()
    found = api.diff_detail(tmp_path / "d.tables", database, spark, tables=["users"])
    assert not found["identical"] and found["tables"][0]["deleted"] == 1 and found["tables"][0]["rows"][0]["kind"] == "deleted"


def test_stores_by_url(spark, database, tmp_path):
    """Folders that only Spark's file systems open."""
    api.to_csv(database, tmp_path / "a.tables", spark)
    first = api.checksum(tmp_path / "a.tables", spark)
    assert api.checksum(f"file://{tmp_path}/a.tables", spark, tables=["users", "orders"]) == api.checksum(tmp_path / "a.tables", spark, tables=["users", "orders"]) and first
    api.to_parquet(tmp_path / "a.tables", f"file://{tmp_path}/b", spark)
    assert (tmp_path / "b" / "users.parquet").is_dir()
    back = api.load(f"file://{tmp_path}/b", spark)
    assert back.pk("users") == ["id"] and sorted(r["id"] for r in back["users"].collect()) == [1, 2, 10]
    with pytest.raises(Exception):
        api.to_parquet(tmp_path / "a.tables", f"file://{tmp_path}/b", spark)


def test_asof_over_stretches(spark):
    """A hot key, gaps over many stretches, ties and NULLs, for any number of stretches."""
    from plainlake.operators.order import asof_join

    left = [(k, t, i) for i, (k, t) in enumerate([("a", x) for x in range(0, 1000, 7)] + [("b", 5), ("b", 990), ("c", 3), (None, 7), ("a", None)])]
    right = [("a", x, x) for x in range(100, 900, 13)] + [("a", 100, 7), ("b", 5, 1), ("b", 6, 2), (None, 1, 9)]
    x, y = spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame(right, "k string, s long, _pl0 long")
    want = {i: max(((s, v) for kk, s, v in right if kk == k and t is not None and s <= t), default=(0, None))[1] for k, t, i in left}
    for n in (1, 3, 256):
        assert {r["i"]: r["_pl0"] for r in asof_join(x, y, ["k"], "t", "s", ["_pl0"], n).collect()} == want
    assert asof_join(x.limit(0), y, ["k"], "t", "s", ["_pl0"]).count() == 0 and asof_join(x, y.limit(0), ["k"], "t", "s", ["_pl0"]).filter("_pl0 is not null").count() == 0
