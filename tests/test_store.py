"""Commits of the store: all or nothing, in one order, with nothing lost."""

import threading

import pytest
from pyspark.sql import functions as F

from cipherscape.operators import persist
from cipherscape.plans import queries


@pytest.fixture
def store(spark, tmp_path):
    return persist.Store(spark, f"file://{tmp_path}")


def _put(store, run, n, expected=None):
    rows = store.spark.range(n).select("id", F.lit(run).alias("who"))
    return store.commit([(t, run, w) for t, w in store.stage({"a": rows, "b": rows.limit(1)}).items()], expected)


def test_a_reader_during_a_rewrite_sees_old_or_new_rows(spark, store):
    _put(store, "r", 10)
    before = store.read("a")
    written = store.stage({"a": spark.range(4).select("id", F.lit("r").alias("who")), "b": spark.range(0).select("id", F.lit("r").alias("who"))})
    assert store.read("a").count() == 10 and store.read("b").count() == 1  # written, not committed
    store.commit([("a", "r", written["a"]), ("b", "r", written["b"])])
    assert before.count() == 10 and store.read("a").count() == 4 and store.read("b").count() == 0
    assert persist.Store(spark, store.root).read("a").count() == 4
    assert store.sweep(hours=1) == 0 and store.sweep(hours=-1) == 2 and store.read("a").count() == 4  # the folders that were replaced
    store.commit([("a", "r", None)])
    assert store.read("a").count() == 0 and store.read("a").columns == ["id", "who"]


def test_writers_at_once_lose_nothing(spark, store):
    failed = []

    def work(k):
        try:
            mine = persist.Store(spark, store.root)
            for n in range(4):
                _put(mine, f"{k}.{n}", 3)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and store.state().number == 16
    rows = store.read("a", numbered=True).groupBy("run", "number").count().collect()
    assert sorted(r.number for r in rows) == list(range(1, 17)) and all(r["count"] == 3 for r in rows)
    own = {r.run: r.number for r in rows}
    assert all(own[f"{k}.{n}"] < own[f"{k}.{n + 1}"] for k in range(4) for n in range(3))


def test_expectations(store):
    first = _put(store, "r", 2, {("a", "r"): None})
    with pytest.raises(persist.Conflict):
        _put(store, "r", 3, {("a", "r"): None})
    second = _put(store, "r", 3, {("a", "r"): first})
    with pytest.raises(persist.Conflict):
        _put(store, "r", 9, {("a", "r"): first})
    assert (first, second, store.read("a").count()) == (1, 2, 3)


def test_whole_states(spark, store, monkeypatch):
    monkeypatch.setattr(persist.Store, "FULL", 3)
    for k in range(8):
        _put(store, f"r{k % 5}", k + 1)
    fresh = persist.Store(spark, store.root)
    asked = []
    text = fresh._text
    fresh._text = lambda n: asked.append(n) or text(n)
    assert fresh.state() == store.state() and asked == [6, 7, 8]
    assert fresh.read("a").count() == 4 + 5 + 6 + 7 + 8


def test_a_store_behind_other_file_systems(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store9.link./in", f"file://{tmp_path}")
    store = persist.Store(spark, "viewfs://store9/in/db")
    assert _put(store, "r", 5) == 1 and _put(store, "s", 2) == 2 and store.read("a").count() == 7
    assert not store._create(2, "{}")


def test_tables_written_once_follow_their_inputs(spark, tmp_path):
    def copy(rows):
        lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(rows)
        lineitem.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")

    copy(4000)
    old = queries.finding_list(spark, str(tmp_path)).count()
    copy(50)
    spark.catalog.clearCache()
    new = queries.finding_list(spark, str(tmp_path)).count()
    assert 0 < new < old and new == queries.dedup_findings(spark, str(tmp_path)).count()
    persist.forget(spark)
    assert not [k for k in persist._stored if k[0] == spark.sparkContext.applicationId]


def test_findings_need_few_exchanges(spark, sf_dir):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.all_findings(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") <= 10  # 50 where the parsed files don't lie by file
