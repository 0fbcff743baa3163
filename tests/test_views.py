"""Views, word boxes and stateless ingest on literal rows."""

import random

import duckdb
from lodestar.operators import extract, views
from lodestar.plans import registry
from lodestar.streaming.ingest import ingest_new, watch
from pyspark.sql import functions as F


def test_views(spark):
    df = spark.createDataFrame([("a", None, "B"), ("", "x", "S"), (None, "nan", "?"), ("d", " ", None)], "p string, q string, size string")
    assert {r.column_name: r.pct for r in views.coverage(df, ["p", "q"]).collect()} == {"p": 50.0, "q": 75.0}
    assert [r.pct for r in views.coverage(df.limit(0), ["p"]).collect()] == [None]
    shown = views.display(df, {"name": ["p", "none", "q"], "extra": ["none"]}, default="-")
    assert [tuple(r) for r in shown.collect()] == [("a", "-"), ("x", "-"), ("-", "-"), ("d", "-")]
    assert [r[0] for r in df.select(views.label(F.col("size"), {"B": "big"})).collect()] == ["big", "S", "?", None]
    assert [r.size for r in df.orderBy(views.place(F.col("size"), ["S", "B"]), F.asc_nulls_last("size")).collect()] == ["S", "B", "?", None]
    assert views.facets(df, {"size": ["B", "S"], "p": None}).count() == 2 and views.facets(df, {"size": "B"}).count() == 1


def test_display_table_shows_keys_and_codes_as_they_are(spark, tmp_path):
    rows = [(0, "O", "1-URGENT"), (7, "P", "2-HIGH"), (8, "-", "2-HIGH"), (9, None, "1-URGENT"), (10, "", "1-URGENT"), (None, "0", "2-HIGH"), (11, "F", "5-LOW"), (12, "F", None)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderpriority string").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(registry.oracles()["display_table"]).fetchall()
    got = [tuple(r) for r in registry.queries()["display_table"](spark, str(tmp_path)).select("id", "status", "note").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and ("0", "open", "-") in got and ("9", None, "-") in got


def test_suggest_and_statistics(spark):
    df = spark.createDataFrame([("Alpha",), ("alpha b",), ("ALP%",), (None,), ("Alpha",)], "n string")
    assert [tuple(r) for r in views.suggest(df, "n", "alpha").collect()] == [("Alpha", True), ("alpha b", False)]
    assert [r.value for r in views.suggest(df, "n", "p%").collect()] == ["ALP%"]
    r = spark.createDataFrame([("a", 1, 0.01), ("b", 2, 0.5), ("a", 1, 0.4), ("c", 1, None)], "o string, rank int, s double")
    assert {x.o: x.n for x in views.leaders(r, ["o"]).collect()} == {"a": 2, "c": 1}
    assert tuple(views.run_statistics(r, "s").first()) == (3, 0.01, 0.3033, 0.5, 33.3)
    assert tuple(views.run_statistics(r.limit(0), "s").first()) == (0, None, None, None, None)


def brute_lines(words, tolerance):
    lines = []
    for x, y, w in sorted((b for b in words if b[2].strip()), key=lambda b: (round(b[1], 1), b[0], b[1], b[2].strip())):
        if lines and abs(y - sum(b[1] for b in lines[-1]) / len(lines[-1])) <= tolerance:
            lines[-1].append((x, y, w.strip()))
        else:
            lines.append([(x, y, w.strip())])
    return [" ".join(b[2] for b in sorted(line, key=lambda b: (b[0], b[2]))) for line in lines]


def test_word_lines(spark):
    rnd = random.Random(3)
    pages = {p: [(float(rnd.randrange(500)), float(rnd.randrange(400)) / 4, rnd.choice(["a", "b ", " ", "cc"])) for _ in range(80)] for p in range(4)}
    df = spark.createDataFrame([(p, *b) for p, bs in pages.items() for b in bs] + [(9, None, 1.0, "z")], "page int, x double, y double, word string")
    got = extract.word_lines(df, ["page"]).orderBy("page", "line_no").collect()
    assert {p: [r.raw_line for r in got if r.page == p] for p in pages} == {p: brute_lines(b, 4.0) for p, b in pages.items()}
    assert all(r.page != 9 for r in got)


def test_ingest_new(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    for name, body in (("a", b"%PDF-1 same"), ("b", b"%PDF-1 same"), ("c", b"%PDF-2 other")):
        (box / f"{name}.pdf").write_bytes(body)
    for checkpoint in ("one", "two"):  # the second reads every file again
        ingest_new(watch(spark, str(box), archive=str(tmp_path / "done")), "sha256", str(tmp_path / "t"), str(tmp_path / checkpoint)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
