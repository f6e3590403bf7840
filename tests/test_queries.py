"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

from __future__ import annotations

import pytest
from oracle import same

from rillstone import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    ours, theirs = same(spark, sf_dir, QUERIES[name], SQL[name])
    assert ours == theirs


def test_greedy_never_overbooks(spark, sf_dir):
    from rillstone.operators import placement as L
    from rillstone.plans import placements

    placed = [r.asDict() for r in placements.f9_greedy(spark, sf_dir).collect()]
    free = {r.worker_id: r.free for r in placements.workers(spark, sf_dir).select("worker_id", L.free_slots().alias("free")).collect()}
    used: dict = {}
    for r in placed:
        used[r["worker_id"]] = used.get(r["worker_id"], 0) + 1
    assert placed and all(n <= free[w] for w, n in used.items())
    assert len({r["task_id"] for r in placed}) == len(placed)
    contexts = [r["context_id"] for r in placed if r["context_id"] is not None]
    assert contexts and len(contexts) == len(set(contexts))


def place(spark, pairs, free, waits=None, contexts=None):
    """Tasks' workers in order of placement; pairs: {task: workers}, or {task: (workers, context)}."""
    from rillstone.operators import placement as L

    contexts = contexts or {}
    rows = []
    for task, workers in pairs.items():
        workers, context = workers if isinstance(workers, tuple) else (workers, None)
        rows += [(0, task, w, context, 0, 0, 0, 100, 50, 10, 4, free[w], 0, 0) for w in workers]
    frame = spark.createDataFrame(rows, "pool long, task_id long, worker_id long, context_id long, remote long, unknown_sizes long, remote_bytes long, total_memory_bytes long, available_memory_bytes long, cpu_percent long, cpu_cores long, total_slots long, running_slots long, reserved_slots long")
    ready = spark.createDataFrame([(t, t, (waits or {}).get(t, 0), 0, 0, 0) for t in pairs], "task_id long, ready_sequence long, wait_rounds long, depth long, descendants long, fan_out long")
    slots = spark.createDataFrame([(0, w, False, n) for w, n in free.items()] + [(0, c, True, n) for c, n in contexts.items()], "pool long, owner long, is_context boolean, free long")
    return [(r.task_id, r.worker_id) for r in L.greedy(frame, ready, slots).orderBy("step").collect()]


def test_greedy_prefers_scarce_tasks(spark):
    assert place(spark, {1: [1, 2], 2: [1]}, {1: 1, 2: 1}) == [(2, 1), (1, 2)]


def test_greedy_counts_feasible_workers_anew(spark):
    """Once 1 is full, the task for 1 or 2 is scarcer than the one for 2 or 3."""
    assert place(spark, {1: [2, 3], 2: [1, 2], 3: [1]}, {1: 1, 2: 1, 3: 1}) == [(3, 1), (2, 2), (1, 3)]


def test_greedy_takes_free_slots_as_they_are(spark):
    assert place(spark, {1: [1, 2], 2: [1, 2], 3: [1, 2]}, {1: 2, 2: 2}) == [(1, 1), (2, 2), (3, 1)]


def test_greedy_takes_aged_tasks_first(spark):
    assert place(spark, {1: [1], 2: [1, 2], 3: [1, 2]}, {1: 1, 2: 1}, waits={2: 8, 3: 9}) == [(2, 1), (3, 2)]


def test_greedy_keeps_to_the_slots_of_contexts(spark):
    pairs = {1: ([1], 7), 2: ([1], 7), 3: [1]}
    assert place(spark, pairs, {1: 3}, contexts={7: 1}) == [(1, 1), (3, 1)]
    assert place(spark, pairs, {1: 3}, contexts={7: 2}) == [(1, 1), (2, 1), (3, 1)]
    assert place(spark, pairs, {1: 3}) == [(3, 1)]


def test_every_reason_against_a_worker(spark):
    from rillstone.operators import placement as L

    good = {"worker_id": 1, "online": True, "accepting_work": True, "total_slots": 1, "running_slots": 0, "reserved_slots": 0, "missing": 0, "environment_ids": ["e"], "environment_id": "e", "supported_modes": ["m"], "mode": "m", "required_worker": None, "allowed_workers": None, "context_worker": None}
    bad = {"offline": {"online": False}, "not_accepting": {"accepting_work": False}, "no_free_slot": {"reserved_slots": 1}, "missing_input": {"missing": 2}, "wrong_environment": {"environment_id": "f"}, "wrong_mode": {"mode": "n"}, "other_worker_required": {"required_worker": 2}, "not_in_allowed_workers": {"allowed_workers": []}, "context_not_prepared": {"context_worker": 2}}
    schema = "id string, worker_id long, online boolean, accepting_work boolean, total_slots long, running_slots long, reserved_slots long, missing long, environment_ids array<string>, environment_id string, supported_modes array<string>, mode string, required_worker long, allowed_workers array<long>, context_worker long"
    rows = [("", *good.values()), ("offline+no_free_slot", *(good | {"online": False, "running_slots": 1}).values()), *((k, *(good | v).values()) for k, v in bad.items())]
    for r in L.rejections(spark.createDataFrame(rows, schema)).collect():
        assert "+".join(r.reasons) == r.id


def test_workers_rank_by_tenths_of_load(spark):
    from rillstone.operators import placement as L

    rows = [(1, 100, 50, 24), (2, 100, 95, 20), (3, 100, 94, 9), (4, 0, 0, 0), (5, 100, 96, 10)]
    frame = spark.createDataFrame(rows, "worker_id long, total_memory_bytes long, available_memory_bytes long, cpu_percent long")
    frame = frame.selectExpr("*", "1 AS task_id", "0 AS remote", "0 AS unknown_sizes", "0 AS remote_bytes", "4 AS total_slots", "0 AS running_slots", "0 AS reserved_slots", "4 AS cpu_cores")
    assert [r.worker_id for r in L.ranked_workers(frame).orderBy("place").collect()] == [3, 5, 2, 1, 4]


def test_task_order_is_whole(spark):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").filter("o_orderstatus = 'O'").count()
    places = [r.place for r in QUERIES["f7_task_order"](spark, "/root/testdata/sf0.01").collect()]
    assert orders > 1024 and sorted(places) == list(range(1, orders + 1))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_locality_moves_nothing_once_holders_are_rows(spark, sf_dir):
    """Pairs of tasks and workers are many times the input; only inputs and lists of holders are shuffled."""
    from rillstone.plans import placements

    plan = placements.f5_locality(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "Join" not in plan.split("Generate explode")[0]
    executed = placements.f5_locality(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in executed.split("Generate explode")[0]
