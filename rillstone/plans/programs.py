"""Row control flow, reductions, small dataflow programs and user functions (groups C, D, I and parts of E)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rowflow as R
from ..functions import semantics as P
from ..functions.task import batch_task, checked_task, in_context, proved, task
from ..sources import tables as T
from .registry import query


@query("SELECT p_partkey, CAST(p_size * (p_size - 1) // 2 + 10 AS BIGINT) AS total FROM part")
def c2_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = R.fold_range(F.col("p_size").cast("long"), F.lit(10).cast("long"), lambda t, i: t + i)
    return T.table(spark, sf_dir, "part").select("p_partkey", total.alias("total"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN -1 WHEN c_acctbal < 1000 THEN 0 ELSE 1 END AS sign FROM customer")
def c3_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, -1).when(F.col("c_acctbal") < 1000, 0).otherwise(1).alias("sign"))


@query("SELECT p_partkey, CAST((SELECT coalesce(sum(CASE WHEN i % 2 = 0 THEN i * i ELSE -i END), 0) FROM range(0, p_size) r(i)) AS BIGINT) AS total FROM part")
def c4_for_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = R.fold_range(F.col("p_size").cast("long"), F.lit(0).cast("long"), lambda t, i: t + F.when(i % 2 == 0, i * i).otherwise(-i))
    return T.table(spark, sf_dir, "part").select("p_partkey", total.alias("total"))


COLLATZ = "w(start, n, steps) AS (SELECT p_partkey, p_partkey, CAST(0 AS BIGINT) FROM part WHERE p_partkey >= 1 UNION ALL SELECT start, CASE WHEN n % 2 = 0 THEN n // 2 ELSE 3 * n + 1 END, steps + 1 FROM w WHERE n <> 1)"


@query(f"WITH RECURSIVE {COLLATZ} SELECT start, max(steps) AS steps FROM w GROUP BY start")
def c5_while_collatz(spark: SparkSession, sf_dir: str) -> DataFrame:
    @batch_task("bigint")
    def steps(n: np.ndarray) -> np.ndarray:
        """All numbers of a batch walk at once; those that have arrived leave."""
        k = np.zeros(len(n), np.int64)
        left, now = np.arange(len(n)), n.astype(np.int64)
        while len(left := left[now != 1]):
            now = now[now != 1]
            k[left] += 1
            now = np.where(now % 2 == 0, now // 2, 3 * now + 1)
        return k

    parts = T.table(spark, sf_dir, "part").filter("p_partkey >= 1")
    return parts.select(F.col("p_partkey").alias("start"), steps(F.col("p_partkey")).alias("steps"))


SMALL = "(SELECT range + 1 AS k FROM range(199))"


@query("WITH RECURSIVE w(start, n, steps) AS (SELECT k, k, CAST(0 AS BIGINT) FROM " + SMALL + " UNION ALL SELECT start, CASE WHEN n % 2 = 0 THEN n // 2 ELSE 3 * n + 1 END, steps + 1 FROM w WHERE n <> 1) SELECT start, max(steps) AS steps FROM w GROUP BY start")
def c5_while_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.collatz_steps(spark, spark.range(1, 200).withColumnRenamed("id", "k"), "k")


@query("SELECT p_partkey, (SELECT min(d) FROM range(2, 100) r(d) WHERE p_partkey % d = 0) AS divisor FROM part")
def c6_first_divisor(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return T.table(spark, sf_dir, "part").select("p_partkey", R.first_where(F.sequence(F.lit(2).cast("long"), F.lit(99).cast("long")), lambda d: k % d == 0).alias("divisor"))


@query("SELECT p_partkey FROM part WHERE p_partkey >= 2 AND NOT EXISTS (SELECT 1 FROM range(2, p_partkey) r(d) WHERE d * d <= p_partkey AND p_partkey % d = 0)")
def c7_loop_else_primes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "part").filter(R.is_prime(F.col("p_partkey"))).select("p_partkey")


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS items, CAST(CASE WHEN p_size > 0 THEN (p_size - 1) * (p_size - 1) END AS BIGINT) AS last FROM part")
def c8_list_append_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    squares = R.appended(P.int_range(F.lit(0).cast("long"), F.col("p_size").cast("long")), lambda i: i * i)
    return T.table(spark, sf_dir, "part").select("p_partkey", F.size(squares).cast("long").alias("items"), F.when(F.size(squares) > 0, P.item(squares, -1)).alias("last"))


@query("SELECT p_partkey, p_size * 3 + 5 AS by_position, p_size * 2 + 5 AS by_default, p_size * 2 + 1 AS by_name FROM part")
def c10_call_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    def line(x, a=2, *, b=5):
        return x * a + b

    x = F.col("p_size")
    return T.table(spark, sf_dir, "part").select("p_partkey", line(x, 3).alias("by_position"), line(x).alias("by_default"), line(x, b=1).alias("by_name"))


@query("SELECT p_partkey, (p_size + 1) * 2 - ((p_size + 3) * 2) AS result FROM part")
def c12_nested_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(x):
        return x * 2

    return T.table(spark, sf_dir, "part").select("p_partkey", (f(F.col("p_size") + 1) - f(F.col("p_size") + 3)).alias("result"))


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS total, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned FROM lineitem")
def d1_sum_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "lineitem").agg(P.column_sum(F.col("l_linenumber").cast("long")).alias("total"), P.column_sum(P.as_int(F.col("l_returnflag") == "R")).alias("returned"))


@query("SELECT CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS total FROM lineitem WHERE l_quantity < 0")
def d1_sum_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "lineitem").filter("l_quantity < 0").agg(P.column_sum(F.col("l_linenumber").cast("long")).alias("total"))


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_returnflag")
def d2_sum_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def d3_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {COLLATZ}, s AS (SELECT start, max(steps) AS steps FROM w GROUP BY start) SELECT CAST(sum(steps) AS BIGINT) AS checksum, max(steps) AS longest, count(*) FILTER (steps > 50) AS long_walks FROM s")
def d4_collatz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = c5_while_collatz(spark, sf_dir)
    return s.agg(F.sum("steps").alias("checksum"), F.max("steps").alias("longest"), F.count_if(F.col("steps") > 50).alias("long_walks"))


@query("SELECT s AS slice, round(sum(4.0::DOUBLE / (1 + ((s * 100000 + i + 0.5::DOUBLE) / 300000) ** 2)) / 300000, 8) AS area FROM range(3) a(s), range(100000) b(i) GROUP BY s")
def d5_quadrature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quadrature(spark, 3, 100_000, lambda x: 4.0 / (1 + x * x)).select("slice", F.round("area", 8).alias("area"))


@query("SELECT s AS slice, CAST(sum((s * 100000 + i) * (s * 100000 + i)) AS BIGINT) AS total FROM range(3) a(s), range(100000) b(i) GROUP BY s")
def d6_build_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.number_range(spark, 0, 300_000)
    return n.groupBy(F.expr("id div 100000").alias("slice")).agg(F.sum(F.col("id") * F.col("id")).alias("total"))


@query("SELECT p_partkey // 500 AS block, count(*) FILTER (p_partkey >= 2 AND NOT EXISTS (SELECT 1 FROM range(2, p_partkey) r(d) WHERE d * d <= p_partkey AND p_partkey % d = 0)) AS primes FROM part GROUP BY 1")
def d7_prime_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fan-out of independent blocks: primes among the part keys of each block of 500."""
    return T.table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 500").alias("block")).agg(F.count_if(R.is_prime(F.col("p_partkey"))).alias("primes"))


@query("SELECT count(*) AS primes FROM part WHERE p_partkey >= 2 AND NOT EXISTS (SELECT 1 FROM range(2, p_partkey) r(d) WHERE d * d <= p_partkey AND p_partkey % d = 0)")
def d7_prime_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fan-in: partial counts by block, then their sum."""
    return d7_prime_blocks(spark, sf_dir).agg(P.column_sum(F.col("primes")).alias("primes"))


@query("SELECT o_custkey, round(sum(o_totalprice) + max(o_totalprice), 2) AS combined FROM orders GROUP BY o_custkey")
def e_diamond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source, two branches, one join; both branches are one pass over the source."""
    branches = T.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("left"), F.max("o_totalprice").alias("right"))
    return branches.select("o_custkey", F.round(F.col("left") + F.col("right"), 2).alias("combined"))


@query("""WITH u AS (SELECT count(*) AS users FROM customer WHERE c_acctbal > 0), o AS (SELECT sum(o_totalprice) AS revenue, count(*) AS orders FROM orders WHERE o_orderstatus = 'O'),
 p AS (SELECT max(p_retailprice) AS top FROM part) SELECT users, orders, round(revenue * 1.2, 2) AS converted, round(revenue / users, 4) AS per_user, top FROM u, o, p""")
def e_pipeline4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables and a rate, combined; each side is a single row."""
    users = T.table(spark, sf_dir, "customer").filter("c_acctbal > 0").agg(F.count("*").alias("users"))
    orders = T.table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").agg(F.sum("o_totalprice").alias("revenue"), F.count("*").alias("orders"))
    top = T.table(spark, sf_dir, "part").agg(F.max("p_retailprice").alias("top"))
    one = lambda f: f.withColumn("one", F.lit(1))
    return one(users).join(one(orders), "one").join(one(top), "one").select("users", "orders", F.round(F.col("revenue") * 1.2, 2).alias("converted"), F.round(F.col("revenue") / F.col("users"), 4).alias("per_user"), "top")


@query("SELECT l_orderkey, CAST(sum(q) + 100 AS BIGINT) AS with_append, count(*) + 1 AS items FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY l_orderkey")
def e_branches_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list for each order; appending makes a new version that later reads see."""
    lists = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("long")).alias("items"))
    second = F.array_append("items", F.lit(100).cast("long"))
    return lists.select("l_orderkey", P.list_sum(second).alias("with_append"), F.size(second).cast("long").alias("items"))


@query("SELECT version, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT 1 AS version, n_nationkey AS k FROM nation UNION ALL SELECT 2, n_nationkey FROM nation UNION ALL SELECT 2, r_regionkey + 100 FROM region) GROUP BY version")
def e4_append_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    second = first.unionByName(T.table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("k")))
    both = first.withColumn("version", F.lit(1)).unionByName(second.withColumn("version", F.lit(2)))
    return both.groupBy("version").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("SELECT n_nationkey, length(n_name) * 10 + n_regionkey AS score FROM nation")
def i1_task_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @task("bigint")
    def score(name: str, region: int) -> int:
        return len(name) * 10 + region

    return T.table(spark, sf_dir, "nation").select("n_nationkey", score(F.col("n_name"), F.col("n_regionkey")).alias("score"))


@query("SELECT p_partkey, round(p_retailprice * 1.1 + p_size, 4) AS price FROM part")
def i1_task_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def price(retail: pd.Series, size: pd.Series) -> pd.Series:
        return retail * 1.1 + size

    return T.table(spark, sf_dir, "part").select("p_partkey", F.round(price("p_retailprice", "p_size"), 4).alias("price"))


@query("SELECT p_partkey, p_size * 3 + 1 AS of_int, CAST(p_retailprice * 3 + 1 AS DOUBLE) AS of_float, p_brand || '+' || p_brand || '+' || p_brand || '+' AS of_text FROM part")
def i2_auto_proved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unmarked function, called with three argument types: a column expression for numbers, which it is proved for, a task for text."""

    @task("string")
    def plain(x: str) -> str:
        return "".join(x + "+" for _ in range(3))

    f = proved(lambda x: x * 3 + 1, plain, ("int", "bigint", "double"))
    p = T.table(spark, sf_dir, "part")
    return p.select("p_partkey", f(p, "p_size").alias("of_int"), f(p, "p_retailprice").alias("of_float"), f(p, "p_brand").alias("of_text"))


NAMES = ["len", "sum", "abs", "min", "max", "range", "round", "p_size", "missing"]


@query("SELECT name, CASE WHEN name IN ('len', 'sum', 'abs', 'min', 'max', 'range') THEN 'builtin' WHEN name = 'p_size' THEN 'value' ELSE 'external' END AS origin, name IN ('round', 'missing') AS maybe_unbound FROM (VALUES " + ", ".join(f"('{x}')" for x in NAMES) + ") n(name)")
def a8_name_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each name that a program reads is: a value of its scope, one of the six builtins, or external and perhaps unbound."""
    scope = spark.createDataFrame([(c,) for c in T.table(spark, sf_dir, "part").columns], "name string")
    return T.name_origins(spark.createDataFrame([(x,) for x in NAMES], "name string"), scope)


@query("SELECT o_orderkey, length(o_orderpriority) + 1 AS result FROM orders")
def i4_context_mapinpandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(state: dict, batch: pd.DataFrame) -> pd.DataFrame:
        state["seen"] = state["seen"] + len(batch)
        return pd.DataFrame({"o_orderkey": batch["o_orderkey"], "result": batch["o_orderpriority"].str.len() + state["bonus"]})

    return in_context(T.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), lambda: {"bonus": 1, "seen": 0}, step, "o_orderkey bigint, result bigint")


@query("SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN CAST(100 // (p_size % 5) AS BIGINT) END AS value, CASE WHEN p_size % 5 = 0 THEN 'ZeroDivisionError' END AS error_type FROM part")
def i8_error_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    @checked_task("bigint")
    def share(size: int) -> int:
        return 100 // (size % 5)

    return T.table(spark, sf_dir, "part").withColumn("r", share(F.col("p_size"))).select("p_partkey", "r.value", "r.error_type")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority")
def a1_program_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program given as text: SQL over tables that are passed to it, not looked up by name."""
    text = "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_orderpriority"
    return spark.sql(text, orders=T.table(spark, sf_dir, "orders"))


@query("SELECT r_regionkey AS x, r_regionkey + 1 AS y FROM region")
def b1_name_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name reads its newest binding: x is bound twice, y is computed from the second."""
    first = T.table(spark, sf_dir, "region").select((F.col("r_regionkey") * 10).alias("x"), "r_regionkey")
    second = first.withColumn("x", F.col("r_regionkey"))
    return second.select("x", (F.col("x") + 1).alias("y"))


@query("SELECT p_partkey, (p_size + 1) * (p_size + 1) - p_size AS result FROM part")
def c1_local_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = T.table(spark, sf_dir, "part").withColumn("a", F.col("p_size") + 1).withColumn("b", F.col("a") * F.col("a"))
    return body.select("p_partkey", (F.col("b") - F.col("p_size")).alias("result"))


@query("SELECT p_partkey, CAST((SELECT coalesce(sum(i), 0) FROM range(0, p_size) r(i) WHERE i % 3 <> 0) AS BIGINT) AS total FROM part")
def c6_continue(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = R.skip_where(P.int_range(F.lit(0).cast("long"), F.col("p_size").cast("long")), lambda i: i % 3 == 0)
    return T.table(spark, sf_dir, "part").select("p_partkey", P.list_sum(left).alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity AS unit FROM lineitem")
def e5_completion_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A division that could fail: its check is part of the plan, and a failure ends the job."""
    unit = P.fenced(P.true_div(F.col("l_extendedprice"), F.col("l_quantity")), F.col("l_quantity") != 0, "division by zero")
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", unit.alias("unit"))
