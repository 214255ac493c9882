"""Paged reading and transactions, with services that fail."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerloom.sources import files, outbox, paged
from ledgerloom.sources.sinks import Refused

ROOT = Path(__file__).resolve().parents[1]
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Flaky(paged.TableService):
    """Refuses each page once, and writes down what it gave."""

    def __init__(self, folder, *args, **more):
        super().__init__(*args, **more)
        self.folder = folder

    def page(self, low, high, token, size, conditions):
        if files.create(f"{self.folder}/asked-{low}-{token}", b""):
            raise Refused(503, 0)
        rows, following = super().page(low, high, token, size, conditions)
        files.put(f"{self.folder}/gave-{low}-{token}-{len(rows)}-{len(conditions)}", b"")
        return rows, following


class Turning(paged.TableService):
    def page(self, low, high, token, size, conditions):
        rows, _ = super().page(low, high, None, size, conditions)
        return rows, "again" if token is None else f"{token}!"


@pytest.fixture
def table(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(3000).select((F.col("id") * 3).alias("k"), F.concat(F.lit("t"), F.col("id") % 7).alias("title"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("n")).write.parquet(path)
    return path


SCHEMA = "k bigint, title string, n bigint"


def test_pages_are_read_whole_and_once(spark, table, tmp_path):
    service = Flaky(f"{tmp_path}/log", table, "k", SCHEMA, taken=("title",))
    want = spark.read.parquet(table)
    got = paged.read(spark, service, partitions=4)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    gave = [n.split("-") for n in files.names(f"{tmp_path}/log") if n.startswith("gave")]
    assert sum(int(n[3]) for n in gave) == 3000 and max(int(n[3]) for n in gave) == 256 and len({n[1] for n in gave}) == 4


@pytest.mark.parametrize(
    ("where", "pushed"),
    [("k >= 30 AND k < 90", 0), ("k = 33", 0), ("k = 34", 0), ("k > 90 AND k < 30", 0), ("title = 't3'", 1), ("title IN ('t1', 't2') AND k > 8000", 1), ("n IS NULL AND title = 't0'", 1), ("title <> 't3'", 0), ("n > 100 OR k = 3", 0), ("k BETWEEN -5 AND 100000", 0)],
)
def test_conditions_are_pushed_down(spark, table, tmp_path, where, pushed):
    service = Flaky(f"{tmp_path}/log", table, "k", SCHEMA, taken=("title",))
    got, want = paged.read(spark, service, partitions=2).where(where), spark.read.parquet(table).where(where)
    assert sorted(got.collect()) == sorted(want.collect()) if "n IS NULL" not in where else got.count() == want.count()
    gave = [n.split("-") for n in files.names(f"{tmp_path}/log") if n.startswith("gave")]
    assert all(int(n[4]) == pushed for n in gave)
    if "k >= 30" in where:
        assert sum(int(n[3]) for n in gave) == 20


def test_pages_that_turn_back_are_an_error(spark, table):
    with pytest.raises(Exception, match="out of order"):
        paged.read(spark, Turning(table, "k", SCHEMA), partitions=1).count()


def test_empty_service(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/e.parquet")
    assert paged.read(spark, paged.TableService(f"{tmp_path}/e.parquet", "k", SCHEMA)).count() == 0


ROWS = "id bigint, v string, deleted boolean"


def test_transactions(spark, tmp_path):
    service = outbox.FolderService(f"{tmp_path}/s")
    rows = lambda ids, v, deleted=False: spark.createDataFrame([(i, v, deleted) for i in ids], ROWS)
    stored = lambda version=None: {r.id: r.v for r in service.read(spark, ROWS, "id", version).collect()}
    assert stored() == {}
    first = outbox.transact(lambda v: rows(range(200), "a"), service, "id", 7)
    outbox.transact(lambda v: rows(range(150, 250), "b").unionByName(rows([3, 4], "x", True)), service, "id")
    assert stored() == {i: "b" if i >= 150 else "a" for i in range(250) if i not in (3, 4)} and len(stored(1)) == 200
    service.commit(first, 0, [])  # the same call again
    assert service.version() == 2
    with pytest.raises(ValueError):
        outbox.transact(lambda v: rows([1, 1], "c"), service, "id")
    outbox.transact(lambda v: rows([], "c"), service, "id")
    assert len(stored()) == 248

    tried = []

    def make(version):
        tried.append(version)
        if len(tried) == 1:  # somebody else is faster
            outbox.transact(lambda v: rows([7], "theirs"), service, "id")
        before = service.read(spark, ROWS, "id", version).where("id = 7")
        return before.withColumn("v", F.concat("v", F.lit("+ours")))

    outbox.transact(make, service, "id")
    assert tried == [3, 4] and stored()[7] == "theirs+ours"
    with pytest.raises(outbox.Conflict):
        outbox.write(rows([8], "late"), service, 1, "id")
    assert stored()[8] == "a"


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    service = outbox.FolderService(f"{tmp_path}/s")
    bad = spark.range(100).select(F.col("id"), F.when(F.col("id") == 99, F.raise_error(F.lit("boom"))).otherwise("a").alias("v"), F.lit(False).alias("deleted")).repartition(4, "id")
    with pytest.raises(Exception, match="boom"):
        outbox.write(bad, service, 0, "id", 5)
    assert service.version() == 0 and service.read(spark, ROWS, "id").count() == 0


_KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from ledgerloom.sources import files, outbox
class Killing(outbox.FolderService):
    def stage(self, transaction, key, rows):
        super().stage(transaction, key, rows)
        if len(files.names(f"{{self.folder}}/staged", deep=True)) > 9 and files.create(f"{{self.folder}}/killed", b""):
            os._exit(9)
spark = SparkSession.builder.master("local[2,4]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
service = Killing({folder!r})
outbox.transact(lambda v: spark.range(500).select("id", F.lit("a").alias("v")).repartition(3, "id"), service, "id", 20)
rows = service.read(spark, "id bigint, v string", "id")
print("RESULT", service.version(), rows.count(), rows.select("id").distinct().count(), files.read({folder!r} + "/killed") is not None)
"""


def test_a_killed_task_leaves_each_row_once(tmp_path):
    code = _KILLED.format(root=str(ROOT), folder=str(tmp_path / "s"))
    (tmp_path / "run.py").write_text(code)
    done = subprocess.run([sys.executable, str(tmp_path / "run.py")], capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": f"{ROOT}:{tmp_path}"})
    assert "RESULT 1 500 500 True" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("ordered", [False, True])
def test_a_table_service_holds_a_stretch_of_a_range(tmp_path, monkeypatch, ordered):
    """However many rows a range has; keys in order and out of order in the file, conditions and gaps."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    n, text = 6000, "x" * 2000
    keys = [i * 3 for i in range(n)] if ordered else [(i * 7919) % n * 3 for i in range(n)]
    pq.write_table(pa.table({"k": pa.array(keys, pa.int64()), "u": [f"u{k % 2}" for k in keys], "t": [text + str(k) for k in keys]}), tmp_path / "t.parquet", row_group_size=500)
    monkeypatch.setattr(paged, "HELD", 1 << 20, raising=False)
    service = paged.TableService(str(tmp_path / "t.parquet"), "k", "k bigint, u string, t string", taken=("u",))
    for conditions, want in (([], [k for k in range(30, 17001) if k % 3 == 0]), ([("u", "==", "u1")], [k for k in range(30, 17001) if k % 6 == 3])):
        token, got, held = None, [], 0
        while True:
            rows, token = service.page(30, 17000, token, 256, conditions)
            got += [r["k"] for r in rows]
            held = max(held, service._held[-1].nbytes)
            assert all(r["t"] == text + str(r["k"]) for r in rows)
            if token is None:
                break
        assert got == want and held < 4 << 20
    assert service.page(30, 17000, "999", 4, [])[0][0]["k"] == 1002 == service.page(30, 17000, "999", 4, [])[0][0]["k"]  # asked again
    assert service.page(17002, 17002, None, 256, []) == ([], None)
