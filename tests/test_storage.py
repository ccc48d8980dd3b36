"""Paths with and without a scheme, the shared folder, hot keys, limits by number."""

import pytest
from pyspark.sql import functions as F

from quillsift import session
from quillsift.operators import attempts, cache, order, tasks
from quillsift.sources import readers, storage


def test_paths_of_any_scheme(spark, tmp_path):
    for base in (str(tmp_path / "plain"), (tmp_path / "uri").as_uri()):
        for revision, n in (("r1", 1), ("r2", 2)):
            spark.range(n).write.parquet(f"{base}/d/{revision}/train")
        assert readers.snapshot(spark, base, "d", "train").count() == 2 and storage.names(spark, f"{base}/d") == ["r1", "r2"]
        assert storage.exists(spark, base) and not storage.is_file(spark, base) and not storage.exists(spark, base + "/no")
        cache.put(spark.range(3), f"{base}/c")
        assert storage.exists(spark, f"{base}/c")
        storage.remove(spark, base)
        assert not storage.exists(spark, base)


def test_cache_behind_a_scheme(spark, tmp_path):
    from quillsift.operators.generate import memoized

    asked = tmp_path / "asked"
    asked.mkdir()

    def factory():
        def client(prompt):
            (asked / f"{prompt}-{len(list(asked.iterdir()))}").touch()
            return "x"

        return client

    requests = spark.createDataFrame([("k", "p")], "key string, prompt string")
    for recorded in (False, True):
        got = memoized(requests, "key", "prompt", (tmp_path / "cache").as_uri(), factory, retries=1, backoff=False).collect()
        assert [(r.output, r.recorded) for r in got] == [("x", recorded)] and len(list(asked.iterdir())) == 1


def test_shared_folder(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    path = storage.workspace(spark, "w")
    assert path.startswith(session.shared_dir(spark).rstrip("/") + "/w-") and path != storage.workspace(spark, "w")


class Elsewhere:
    """A session as on a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(name, default):
            return default

    class sparkContext:
        master = "yarn"

        @staticmethod
        def getCheckpointDir():
            return None


def test_no_local_folder_on_a_cluster(monkeypatch):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Elsewhere())
    monkeypatch.setattr(Elsewhere.sparkContext, "getCheckpointDir", staticmethod(lambda: "hdfs://x/y"))
    assert session.shared_dir(Elsewhere()) == "hdfs://x/y"


def test_hot_keys_meet_single_rows(spark):
    many = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    one = spark.createDataFrame([("hot", 1), ("5", 2)], "k string, v int")
    assert attempts.meet(many, one, "k").count() == 335 and attempts.meet(many, one, "k", "left").where("v is null").count() == 665


def test_limits_by_number(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.lit("x").alias("__rank2")).repartition(5)
    assert sorted(r.k for r in order.pre_limit(rows, "k", 20).collect()) == list(range(20)) and order.pre_limit(rows, "k", 0).count() == 500
    numbered = order.with_ordinal(rows, "k", keep=F.col("k") % 10 == 0)
    assert {(r.k, r.row_index) for r in numbered.collect()} == {(k, k) for k in range(0, 500, 10)}
    train, held = order.evaluation_split(rows, "k", rows.limit(3), 0.5)
    assert train.count() == 500 and held.count() == 3 and order.evaluation_split(rows, "k", None, 0.0)[1] is None


def test_structured_contents(spark):
    rows = spark.createDataFrame([([("user", [("text", "a")]), ("user", None)],)], "prompt array<struct<role:string,content:array<struct<type:string,text:string>>>>")
    assert tasks.normalize(rows).collect()[0].task_prompt == '[{"type":"text","text":"a"}]'
    assert tasks.initial(rows).select("generated_code", "mini_gen_cache_hit").collect()[0] == ("", False)
