"""What must not grow with the input: broadcasts, passes, comparisons a value, and memory of a task."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyveil import queries
from tallyveil.functions.prf import geometric_rank_array
from tallyveil.operators import circuits, encode, sketch
from tallyveil.sources import views


def _jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_customers_are_not_broadcast(spark, sf):
    plan = views.orders_raw(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [o_custkey" in plan


def test_orders_view_is_joined_and_coded_once(spark, sf):
    first, again = views.orders_view(spark, sf), views.orders_view(spark, sf)
    assert first.inputFiles() and set(first.inputFiles()) == set(again.inputFiles())
    assert "Join" not in again._jdf.queryExecution().executedPlan().toString()
    assert again.count() == views.read(spark, sf, "orders").count()


def test_orders_view_is_made_anew_where_files_went_or_came(spark, sf, tmp_path):
    for table in ("orders", "customer", "nation"):
        views.read(spark, sf, table).write.parquet(f"{tmp_path}/{table}.parquet")
    before = views.orders_view(spark, str(tmp_path))
    held = sorted(before.collect())
    path = before.inputFiles()[0].rsplit("/", 1)[0]
    files, place = views._place(spark, path)
    files.delete(place, True)
    assert sorted(views.orders_view(spark, str(tmp_path)).collect()) == held
    more = views.read(spark, sf, "orders").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    more.write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    assert views.orders_view(spark, str(tmp_path)).count() == 2 * len(held)


@pytest.mark.parametrize("count", [0, 1, 2, 5, 63])
def test_slices_by_halving(spark, count):
    rng = random.Random(count)
    cuts = sorted({round(rng.uniform(-5, 5), 2) for _ in range(count)})
    values = [None, float("nan"), -9.0, 9.0, *cuts, *(rng.uniform(-6, 6) for _ in range(50))]
    table = spark.createDataFrame([(x,) for x in values], "x double")
    column = encode.slice_of(F.col("x"), cuts)
    for r in table.select("x", column.alias("at")).collect():
        x = r["x"]
        assert r["at"] == (0 if x is None else len(cuts) if math.isnan(x) else sum(x > c for c in cuts))


def test_slices_meet_few_cuts():
    def depth(text):
        most = now = 0
        for word in text.replace("CASE", " CASE ").replace("END", " END ").split():
            now += (word == "CASE") - (word == "END")
            most = max(most, now)
        return most

    assert depth(str(encode.slice_of(F.col("x"), [float(c) for c in range(63)]))) == 6


def test_packed_operations_scan_a_few_times(spark, sf):
    views.orders_view(spark, sf)
    rows, jobs = _jobs(spark, "packed", lambda: queries.QUERIES["cr2_packed_operations"](spark, sf).collect())
    assert len(rows) == 20
    assert jobs <= 24


def test_ranks_of_a_batch_take_little_memory():
    rng = np.random.default_rng(7)
    ids, has, best = rng.integers(0, 1 << 40, 10_000), rng.random((10_000, 5)) < 0.3, np.zeros((5, 256), np.uint16)
    has[:, 4] = False
    tracemalloc.start()
    sketch.fold_ranks(best, ids, has, 2026, 1.0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 << 20  # 2 million ranks at once took more than 40 MB
    every = geometric_rank_array(ids, np.arange(256), 2026, 1.0)
    for k in range(4):
        assert (best[k] == every[has[:, k]].max(0)).all()
    assert not best[4].any()


def test_transforms_scan_the_rows_once(spark, sf):
    views.orders_view(spark, sf)
    plan = queries.QUERIES["t11_transform_chain"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1  # it was read some twenty times, for each level of each group's tuples
    assert "Exchange hashpartitioning" not in plan and "Union" not in plan


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_merged_features_of_few_and_many_tuples(spark, monkeypatch, most):
    monkeypatch.setattr(encode, "MOST_TUPLES", most)
    rng = random.Random(5)
    rows = [(k, rng.randrange(-2, 3), rng.randrange(4), rng.randrange(2)) for k in range(200)]
    wide = spark.createDataFrame(rows, "tid bigint, a0 bigint, a1 bigint, a2 bigint")
    places = [{t: k for k, t in enumerate(sorted({tuple(r[1 + a] for a in g) for r in rows}))} for g in ((2, 0), (1,))]
    found = {r["tid"]: (r["a0"], r["a1"]) for r in encode.merge_features(wide, [[2, 0], [1]]).collect()}
    assert found == {t: (places[0][c, a], places[1][b,]) for t, a, b, c in rows}


def test_samples_take_their_number_whatever_ids_repeat(spark):
    wide = spark.createDataFrame([(k // 7,) for k in range(140)], "tid bigint")
    for n in (1, 7, 10, 70, 139, 140, 150):
        assert encode.sample_rows(wide, n, 3).count() == min(n, 140)


def _python_in_a_row(df):
    """The most Python steps that the tasks of one stage pass rows through."""
    most = now = 0
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        now = 0 if "Exchange" in line else now + ("MapInArrow" in line)
        most = max(most, now)
    return most


def test_sketches_keep_one_python_process_a_core(spark):
    wide = spark.createDataFrame([(k, k % 3) for k in range(90)], "tid bigint, a0 bigint")
    clean = sketch.folded_sketches(wide, [F.col("a0") == 0, F.col("a0") == 1], 16, 5)
    assert _python_in_a_row(clean) == 1  # folding and opening were two
    alphas = sketch.released_table(clean, [(k, sketch.Asked(0, ((0, k),), 1.0, 1e-5, 9.0, 2.0, 7)) for k in (0, 1)], 1.0)
    assert _python_in_a_row(alphas) == 1  # and adding the noise a third
    assert alphas.count() == 2


def test_comparisons_are_dealt_evenly_over_the_cores(spark, monkeypatch):
    seen, total = [], circuits._total_ciphers
    monkeypatch.setattr(circuits, "_total_ciphers", lambda rows, *more: seen.append(rows) or total(rows, *more))
    wide = spark.createDataFrame([(k, k % 2, k % 2) for k in range(12)], "tid bigint, a0 bigint, a1 bigint")
    found, _ = circuits.encrypted_mining(wide, [((0, 1), (1, 1)), ((0, 0), (1, 1))], {0: 0, 1: 1}, 2, bits=256)
    assert found == {((0, 1), (1, 1)): 6, ((0, 0), (1, 1)): 0}
    parts = 4 * spark.sparkContext.defaultParallelism  # they were joined again by their bytes
    assert f", {parts}), REPARTITION_BY_NUM" in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_orders_view_of_files_written_over_has_coders_of_its_own(spark, sf, tmp_path):
    def put(folder, orders):
        for table in ("orders", "customer", "nation"):
            found = orders if table == "orders" else pq.read_table(f"{sf}/{table}.parquet")
            pq.write_table(found, f"{folder}/{table}.parquet")

    folder, other = tmp_path / "with space", tmp_path / "other"
    folder.mkdir(), other.mkdir()
    held = pq.read_table(f"{sf}/orders.parquet")
    put(folder, held)
    before = sorted(views.orders_view(spark, str(folder)).collect())
    states = pa.array(["A" + s for s in held["o_orderstatus"].to_pylist()])
    changed = held.set_column(held.column_names.index("o_orderstatus"), "o_orderstatus", states).slice(0, held.num_rows // 2)
    put(folder, changed)
    put(other, changed)
    spark.catalog.refreshByPath(str(folder))
    after = sorted(views.orders_view(spark, str(folder)).collect())
    assert after == sorted(views.orders_view(spark, str(other)).collect())
    assert len(after) == len(before) // 2


@pytest.fixture(scope="session")
def sizes(spark, sf, tmp_path_factory):
    """Folders of the smallest tables, and of 30 times their orders and customers with shifted keys; their views are there."""
    out = []
    for times in (1, 30):
        folder = tmp_path_factory.mktemp(f"x{times}")
        for table, names in (("orders", ("o_orderkey", "o_custkey")), ("customer", ("c_custkey",)), ("nation", ())):
            more = views.read(spark, sf, table)
            if names:
                more = more.crossJoin(spark.range(times).withColumnRenamed("id", "_k"))
                more = more.withColumns({c: F.col(c) + F.col("_k") * 1_000_000 for c in names}).drop("_k")
            more.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        views.orders_view(spark, str(folder))
        out.append(str(folder))
    return out


def _sent_and_read(spark, name, folder):
    """Bytes of results that the driver got, and rows that were read from files."""
    spark.sparkContext.setJobGroup(folder + name, name)
    try:
        queries.QUERIES[name](spark, folder).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told, stages = spark.sparkContext.statusTracker(), spark._jsc.sc().statusStore()
    ids = {s for j in told.getJobIdsForGroup(folder + name) for s in told.getJobInfo(j).stageIds}
    done = [stages.lastStageAttempt(s) for s in sorted(ids)]
    return sum(s.resultSize() for s in done), sum(s.inputRecords() for s in done)


@pytest.mark.parametrize("name, scans", [("b8_overlap_account", 2), ("m2_fo", 4), ("r1_single_keys", 2), ("v7_encrypted_supports_match", 9)])
def test_queries_over_orders_send_no_more_of_more_rows(spark, sizes, name, scans):
    (few, _), (many, read) = (_sent_and_read(spark, name, folder) for folder in sizes)
    assert many < 1.1 * few + 20_000  # customers were sent through the driver by each scan
    rows = views.read(spark, sizes[1], "orders").count()
    assert read <= scans * rows + 9  # and each scan read and joined customers, too; a row comes of what is counted without reading


@pytest.mark.parametrize("name", ["v7_encrypted_supports_match", "r1_single_keys"])
def test_first_query_over_orders_sends_no_more_of_more_rows(spark, sizes, monkeypatch, name):
    """As above, with the making of the view, which a session's first query does."""
    for held in ("_written", "_fitted"):
        monkeypatch.setattr(views, held, {}, raising=False)
    (few, _), (many, read) = (_sent_and_read(spark, name, folder + "/") for folder in sizes)  # a job group of its own
    assert many < 1.1 * few + 20_000
    assert read > 4 * views.read(spark, sizes[1], "orders").count()  # the view was made here
