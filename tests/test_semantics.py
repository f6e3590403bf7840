"""Scalar helpers against Python itself, on a grid of awkward values."""

from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F

from rillstone.functions import rowflow as R
from rillstone.functions import semantics as P
from rillstone.operators import graph as G

INTS = [0, 1, -1, 2, -2, 7, -7, 2**31, -(2**31), 2**53 + 1, -(2**53) - 1, 2**62, -(2**62)]


def test_floor_division_and_modulo(spark):
    pairs = [(a, b) for a, b in itertools.product(INTS, INTS) if b]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", P.floor_div(F.col("a"), F.col("b")).alias("d"), P.modulo(F.col("a"), F.col("b")).alias("m")).collect()
    assert all((r.d, r.m) == (r.a // r.b, r.a % r.b) for r in rows)


@pytest.mark.parametrize("expr", [lambda a, b: P.floor_div(a, b), lambda a, b: P.modulo(a, b), lambda a, b: P.true_div(a, b)])
def test_zero_divisor_raises(spark, expr):
    with pytest.raises(Exception, match="ZERO"):
        spark.createDataFrame([(1, 0)], "a long, b long").select(expr(F.col("a"), F.col("b"))).collect()


def test_ranges(spark):
    cases = [(0, 0), (0, 3), (3, 0), (-2, 2), (5, 5)]
    for step in (1, 2, -1, -3):
        rows = spark.createDataFrame(cases, "a long, b long").select("a", "b", P.int_range(F.col("a"), F.col("b"), step).alias("r")).collect()
        assert all(r.r == list(range(r.a, r.b, step)) for r in rows)


def test_indexing(spark):
    row = spark.createDataFrame([([10, 20, 30],)], "a array<long>")
    for k in (0, 1, 2, -1, -3):
        assert row.select(P.item(F.col("a"), k)).first()[0] == [10, 20, 30][k]
    with pytest.raises(Exception, match="INDEX"):
        row.select(P.item(F.col("a"), 3)).collect()


def test_truth_and_sums(spark):
    frame = spark.createDataFrame([([], "", 0), ([0], "x", -1), (None, None, None)], "a array<long>, s string, n long")
    got = [tuple(r) for r in frame.select(P.truthy_list(F.col("a")), P.truthy_text(F.col("s")), P.truthy_number(F.col("n")), P.list_sum(F.coalesce("a", F.array().cast("array<bigint>")))).collect()]
    assert got == [(False, False, False, 0), (True, True, True, 0), (False, False, False, 0)]
    assert frame.filter("n > 5").agg(P.column_sum(F.col("n"))).first()[0] == 0


def test_comparison_chain_and_nan(spark):
    frame = spark.createDataFrame([(math.nan,), (math.inf,), (1.0,), (-0.0,)], "x double")
    assert [r[0] for r in frame.select(P.between_chain(F.lit(0.0), F.col("x"), F.lit(2.0))).collect()] == [0.0 <= x < 2.0 for x in (math.nan, math.inf, 1.0, -0.0)]


def test_dict_keeps_last_value(spark):
    got = spark.range(1).select(P.last_wins(F.array(*map(F.lit, "aba")), F.array(*map(F.lit, "123")))).first()[0]
    assert got == dict(zip("aba", "123", strict=True))


def test_primes_and_collatz(spark):
    primes = [r.id for r in spark.range(-3, 200).filter(R.is_prime(F.col("id"))).collect()]
    assert primes == [n for n in range(2, 200) if all(n % d for d in range(2, n))]

    def steps(n):
        k = 0
        while n != 1:
            n, k = (n // 2 if n % 2 == 0 else 3 * n + 1), k + 1
        return k

    got = {r.start: r.steps for r in R.collatz_steps(spark, spark.range(1, 60), "id").collect()}
    assert got == {n: steps(n) for n in range(1, 60)}


def test_cycles_and_orders(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "source string, target string")
    with pytest.raises(ValueError, match="cycle"):
        G.levels(tasks, loop)
    chain = [("a", "b"), ("b", "c"), ("a", "c")]
    for order in itertools.permutations(chain):
        levels = {r.id: r.level for r in G.levels(tasks, spark.createDataFrame(list(order), "source string, target string").repartition(3)).collect()}
        assert levels == {"a": 0, "b": 1, "c": 2}
    assert {tuple(r) for r in G.closure(loop).collect()} == {("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "b"), ("c", "c")}


def test_files_and_reports(spark, tmp_path):
    from rillstone.sources import tables as T

    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.py").write_text("x = 1\n")
    (tmp_path / "p" / "b.txt").write_text("y\n")
    files = T.package(spark, str(tmp_path / "p"))
    assert files.count() == 2
    first = T.package_identity(files).first().identity
    (tmp_path / "p" / "b.txt").write_text("z\n")
    assert T.package_identity(T.package(spark, str(tmp_path / "p"))).first().identity != first
    T.write_report(spark.range(2), str(tmp_path / "r"))
    with pytest.raises(Exception, match="EXISTS"):
        T.write_report(spark.range(2), str(tmp_path / "r"))
    bad = spark.createDataFrame([('{"k": 1}',), ("oops",)], "s string").select(T.decode_json("s", "k long"))
    with pytest.raises(Exception, match="MALFORMED"):
        bad.collect()


@pytest.mark.parametrize("lanes", [1, 2, 4])
def test_admission_is_first_come_first_served(spark, lanes):
    """A transfer that waits for one side takes no lane of the other."""
    import random

    from rillstone.operators.movement import admitted

    rng = random.Random(lanes)
    rows = [(1, 1, 1), (2, 1, 2), (3, 2, 2)] + [(k, rng.randrange(8), rng.randrange(9)) for k in range(4, 80)]
    sending, receiving, expected = {}, {}, {}
    for i, s, d in rows:
        expected[i] = sending.get(s, 0) < lanes and receiving.get(d, 0) < lanes
        if expected[i]:
            sending[s], receiving[d] = sending.get(s, 0) + 1, receiving.get(d, 0) + 1
    got = admitted(spark.createDataFrame(rows, "id long, source long, destination long").repartition(3), lanes).collect()
    assert {r.id: r.admitted for r in got} == expected and len(got) == len(rows)


def test_levels_of_random_graphs(spark):
    import random

    rng = random.Random(4)
    for size, extra in ((60, 0), (60, 20), (60, 90)):
        edges = {(rng.randrange(max(0, b - 9), b), b) for b in range(1, size) if rng.random() < 0.8}
        edges |= {tuple(sorted(rng.sample(range(size), 2))) for _ in range(extra)}
        expected = {}
        for b in range(size):
            expected[b] = max((expected[a] + 1 for a, c in edges if c == b), default=0)
        tasks = spark.createDataFrame([(b,) for b in range(size)], "id long")
        got = {r.id: r.level for r in G.levels(tasks, spark.createDataFrame(sorted(edges), "source long, target long")).collect()}
        assert got == expected


@pytest.mark.parametrize("loop", [[("a", "b"), ("b", "a")], [("a", "a")], [("a", "b"), ("c", "b"), ("b", "d"), ("d", "c")]])
def test_every_cycle_raises(spark, loop):
    tasks = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    with pytest.raises(ValueError, match="cycle"):
        G.levels(tasks, spark.createDataFrame(loop, "source string, target string"))


def test_closure_and_parallel_counts(spark):
    import random

    rng = random.Random(6)
    edges = {(rng.randrange(b), b) for b in range(1, 30) for _ in range(rng.randrange(1, 3))}
    paths = set(edges)
    while more := {(a, d) for a, b in paths for c, d in edges if b == c} - paths:
        paths |= more
    frame = spark.createDataFrame(sorted(edges), "source long, target long")
    closed = G.closure(frame)
    assert {tuple(r) for r in closed.collect()} == paths
    tasks = spark.createDataFrame([(k, "certain" if k % 5 else "conservative", "isolated") for k in range(30)], "id long, certainty string, placement string")
    free = [k for k in range(30) if k % 5]
    beside = {a: {b for b in free if a != b and (a, b) not in paths and (b, a) not in paths} for a in free}
    assert {r.id: r.beside for r in G.parallel_counts(tasks, closed).collect()} == {a: len(x) for a, x in beside.items()}
    asked = spark.createDataFrame([(1,), (5,), (7,)], "id long")
    assert {tuple(r) for r in G.parallel_with(tasks, closed, asked).collect()} == {(a, b) for a in (1, 7) for b in beside[a]}


def test_rows_are_numbered_over_ranges(spark):
    rows = [(k * 7919 % 1000, k % 3) for k in range(1000)]
    got = G.numbered(spark.createDataFrame(rows, "x long, y long").repartition(7), [F.col("y").desc(), F.col("x")], "place").collect()
    assert [(r.x, r.y) for r in sorted(got, key=lambda r: r.place)] == sorted(rows, key=lambda r: (-r[1], r[0]))
    assert sorted(r.place for r in got) == list(range(1, 1001))
    assert G.numbered(spark.createDataFrame([], "x long, y long"), [F.col("x")], "place").collect() == []


def test_packages_over_a_limit_are_refused(spark, tmp_path, monkeypatch):
    from rillstone.sources import tables as T

    for k in range(4):
        (tmp_path / f"f{k}.py").write_text("x" * (10 + k))
    assert T.package(spark, str(tmp_path)).count() == 4
    for limit, value, reason in (("MOST_FILES", 3, "too_many_files"), ("MOST_FILE_BYTES", 12, "file_too_large"), ("MOST_BYTES", 45, "too_large")):
        with monkeypatch.context() as m:
            m.setattr(T, limit, value)
            with pytest.raises(ValueError, match=reason):
                T.package(spark, str(tmp_path))
    monkeypatch.setattr(T, "MOST_FILES", 3)
    with pytest.raises(ValueError, match="too_many_files"):
        T.package_identity(spark.createDataFrame([("a", 1, "x")] * 4, "path string, bytes long, sha256 string"))


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(ValueError, match="checkpoint"):
        G.shared_folder(Session)


def test_unknown_names_fail_at_analysis(spark):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException, match="UNRESOLVED"):
        spark.range(1).select("nothing_of_this_name")


def test_proved_functions_run_without_python(spark):
    from rillstone.functions.task import proved, task

    @task("string")
    def slow(x):
        return x + "!"

    f = proved(lambda x: x + 1, slow, ("bigint",))
    frame = spark.createDataFrame([(1, "a")], "n long, s string")
    assert tuple(frame.select(f(frame, "n"), f(frame, "s")).first()) == (2, "a!")
    plan = frame.select(f(frame, "n"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
