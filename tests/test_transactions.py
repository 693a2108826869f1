import datetime as dt

import duckdb

from tessera import catalog

START = dt.datetime(2024, 1, 1)


def test_unknown_merchants_equal_sql_without_lists(spark, tmp_path):
    """Ids that rows share, events without a user or a merchant, and users of more merchants than are read."""
    rows = [(i, START + dt.timedelta(minutes=i % 97, seconds=i), i % 3, "view", 1.0 + i % 7, '{"k": %d}' % (i * 7 % 45)) for i in range(400)]
    rows += [(400 + i, START + dt.timedelta(minutes=i), None, "view", 1.0, '{"k": %d}' % (i % 2)) for i in range(6)]
    rows += [(500 + i, START + dt.timedelta(minutes=i), 1, "view", 1.0, "{}") for i in range(3)]
    rows += [(i, START + dt.timedelta(days=1, seconds=i), 7 - i % 2, "view", 1.0, '{"k": %d}' % (i % 45)) for i in range(0, 400, 9)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()["unknown_merchant_anti_join"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["unknown_merchant_anti_join"]).fetchall()
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want)
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_texts_and_vectors_are_made_once(spark, tmp_path, monkeypatch):
    """What is served, and what the index is built of, is read back from storage."""
    rows = [(i, START + dt.timedelta(seconds=i), i % 3, "view", 1.0 + i % 7, '{"k": %d}' % (i % 45)) for i in range(40)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    plans = []

    class Built:
        @staticmethod
        def build(records, *_):
            plans.append(records._jdf.queryExecution().optimizedPlan().toString())

    def serve(requests, _):
        plans.append(requests._jdf.queryExecution().optimizedPlan().toString())
        return requests.selectExpr("*", "1 AS status", "raw AS answer")

    monkeypatch.setattr(catalog, "Index", Built)
    monkeypatch.setattr(catalog, "serve", serve)
    assert catalog.queries()["http_answers"](spark, str(tmp_path)).count() == 8
    assert len(plans) == 2 and all(p.startswith("Relation") for p in plans)
