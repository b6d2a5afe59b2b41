"""The replay of the pattern cache: rows of any kind, and detections that are made once."""

import re

import duckdb

from scriptorium.plans import catalog, learning


def test_replay_keeps_rows_without_text_or_id(spark, tmp_path):
    rows = [(i, "mala khup aahe tu kay kashala" if i % 3 else "kya baat hai yaar bahut accha") for i in range(40)] + [(i, None) for i in range(40, 46)] + [(i, "") for i in range(46, 50)] + [(None, "one text alone")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = [tuple(r) for r in catalog.QUERIES["cache_hits_simulated"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(got, key=repr) == sorted(con.sql(catalog.ORACLES["cache_hits_simulated"]).fetchall(), key=repr)
    assert len(got) == len(rows) and {r[2] for r in got} == {True, False}


def test_replay_of_short_runs_equals_one_loop(spark):
    rows = [(i * 7 % 101, f"s{i % 4}" if i % 9 else None, (0.95, 0.4, 0.8, 0.6)[i * 5 % 11 % 4]) for i in range(101)]
    stored, expected = {}, {}
    for i, key, conf in sorted(rows, key=lambda r: r[0]):
        kept = stored.setdefault(key, [])
        expected[i] = len(kept) >= 3 and round(sum(kept) / len(kept), 9) >= 0.7
        if not expected[i]:
            kept.append(conf)
    seen = spark.createDataFrame(rows, "doc_id long, signature string, confidence double")
    for width in (10, 100_000):
        got = {r["doc_id"]: (r["signature"], r["cache_hit"]) for r in learning.cache_replay(seen, width=width).collect()}
        assert got == {i: (key, expected[i]) for i, key, _ in rows}


def test_replay_makes_detections_once(spark):
    df = catalog.QUERIES["cache_hits_simulated"](spark, "/root/testdata/sf0.001")
    df.write.format("noop").mode("overwrite").save()  # the plan that ran is another object
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan", plan)) == 1 and plan.count("Filter (") == 0
