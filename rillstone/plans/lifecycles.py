"""Lifecycle, movement and history (groups G, H, D9, D10 and parts of A): events are heartbeats of users, orders runs, lines attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import lifecycle as C
from ..operators import movement as M
from ..sources import tables as T
from .registry import query

BEATS = "beats AS (SELECT user_id AS worker, ts AS tm, event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS seq, event_type FROM events)"
RUNS = "runs AS (SELECT o_orderkey AS run, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS run_status, o_orderdate AS archived_at FROM orders)"
ATTEMPTS = "attempts AS (SELECT l_orderkey AS run, l_linenumber AS task, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_tax, l_discount) AS attempt, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'running' ELSE 'reserved' END AS status, l_suppkey AS worker FROM lineitem)"


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = T.decode_json("props", "k long")["k"]
    return T.table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.col("ts").alias("at"), F.col("event_id").alias("id"), seq.alias("seq"), "event_type")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), status.alias("run_status"), F.col("o_orderdate").alias("archived_at"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_tax", "l_discount"))
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "running").otherwise("reserved")
    return T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("task"), n.cast("long").alias("attempt"), status.alias("status"), F.col("l_suppkey").alias("worker"))


@query(f"WITH {BEATS} SELECT worker, id, row_number() OVER (PARTITION BY worker ORDER BY tm, id) AS generation, lead(id) OVER (PARTITION BY worker ORDER BY tm, id) IS NULL AS active FROM beats WHERE event_type = (SELECT min(event_type) FROM beats)")
def g1_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = beats(spark, sf_dir)
    first = b.agg(F.min("event_type").alias("kind"))
    return C.generations(b.join(F.broadcast(first), F.col("event_type") == F.col("kind"), "left_semi")).select("worker", "id", "generation", "active")


@query(f"WITH {BEATS} SELECT worker, id, CASE WHEN seq < high THEN 'stale' WHEN seq = high THEN 'duplicate' ELSE 'applied' END AS verdict FROM (SELECT *, max(seq) OVER (PARTITION BY worker ORDER BY tm, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM beats)")
def g2_stale_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.heartbeat_verdicts(beats(spark, sf_dir)).select("worker", "id", "verdict")


@query(f"WITH {BEATS} SELECT worker, id, CASE WHEN seq < high THEN 'stale' WHEN seq = high THEN 'duplicate' ELSE 'applied' END AS verdict FROM (SELECT *, max(seq) OVER (PARTITION BY worker ORDER BY tm, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM beats)")
def g2_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same verdicts from a stream with keyed state, run until its input ends."""
    from ..streaming.heartbeats import run_to_end, verdict_stream

    schema = T.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if not sf_dir.endswith("/") else "*").parquet(sf_dir)
    b = stream.select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), T.decode_json("props", "k long")["k"].alias("seq"))
    return run_to_end(spark, verdict_stream(b)).select("worker", "id", "verdict")


@query(f"WITH {BEATS} SELECT worker, id, gap_seconds FROM (SELECT worker, id, date_sub('second', lag(tm) OVER (PARTITION BY worker ORDER BY tm, id), tm) AS gap_seconds FROM beats) WHERE gap_seconds > 30")
def g3_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.silent_gaps(beats(spark, sf_dir), 30)


PHASE = "CASE l_linenumber % 5 WHEN 0 THEN 'prepare' WHEN 1 THEN 'context' WHEN 2 THEN 'dispatch' WHEN 3 THEN 'transfer' ELSE 'cancel' END"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, phase FROM (SELECT *, {PHASE} AS phase, CAST(l_quantity * 2 AS BIGINT) AS age, CAST(l_extendedprice * 100 AS BIGINT) AS bytes FROM lineitem) WHERE age > CASE phase WHEN 'prepare' THEN 60 WHEN 'context' THEN 30 WHEN 'dispatch' THEN 30 WHEN 'transfer' THEN 60 + bytes // 1048576 ELSE 30 END")
def g4_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(PHASE).alias("phase"), (-(F.col("l_quantity") * 2).cast("long")).alias("started"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("bytes"))
    return C.overdue(ops, F.lit(0)).select("l_orderkey", "l_linenumber", "l_partkey", "phase")


@query(f"WITH {RUNS}, {ATTEMPTS} SELECT DISTINCT a.task, a.worker FROM attempts a JOIN runs r USING (run) WHERE r.run_status = 'running' AND a.status = 'reserved'")
def g5_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the replicas that tasks ready to run need."""
    ready = runs(spark, sf_dir).filter("run_status = 'running'")
    return attempts(spark, sf_dir).filter("status = 'reserved'").join(ready, "run", "left_semi").select("task", "worker").distinct()


@query("SELECT id, outcome FROM (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'stale' WHEN row_number() OVER (PARTITION BY user_id, event_type, event_id % 3 = 0 ORDER BY ts, event_id) = 1 THEN 'committed' ELSE 'duplicate' END AS outcome FROM events)")
def g8_first_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.attempt_outcomes(_reports(spark, sf_dir)).select("id", "outcome")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success reports of tasks, a task for each user and type."""
    task = F.concat_ws("/", F.col("user_id").cast("string"), "event_type")
    return T.table(spark, sf_dir, "events").select(task.alias("task"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, 1).otherwise(2).alias("generation"), F.lit(2).alias("current"), "value")


@query("SELECT user_id || '/' || event_type AS task, count(*) AS commits FROM events WHERE value > 50 AND event_id % 3 <> 0 GROUP BY 1 HAVING count(*) > 1")
def g9_unique_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that a log commits more than once; here a log that took every report of a high value, whatever came before."""
    recorded = F.when((F.col("value") > 50) & (F.col("generation") == F.col("current")), "committed").otherwise("ignored")
    return C.commit_violations(_reports(spark, sf_dir).withColumn("outcome", recorded))


KIND = "CASE l_linenumber % 5 WHEN 0 THEN 'INPUT_UNAVAILABLE' WHEN 1 THEN 'ENVIRONMENT_MISMATCH' WHEN 2 THEN 'EXECUTION_ERROR' WHEN 3 THEN 'PYTHON_EXCEPTION' ELSE 'CONTEXT_LOST' END"


@query(f"WITH {ATTEMPTS} SELECT run, task, attempt, CASE WHEN task % 5 IN (0, 1, 2) AND attempt < 2 AND worker % 9 <> 0 THEN 'retry' ELSE 'fail' END AS decision FROM attempts WHERE status = 'failed'")
def g10_retry_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = attempts(spark, sf_dir).filter("status = 'failed'").withColumn("kind", F.expr(KIND.replace("l_linenumber", "task"))).withColumn("native", F.col("worker") % 9 == 0)
    return C.retry_decisions(failed).select("run", "task", "attempt", "decision")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 THEN 'NATIVE_STATE_UNCERTAIN' WHEN s_suppkey % 5 = 0 THEN 'CONTEXT_LOST' WHEN s_suppkey % 3 = 0 THEN 'PLACEMENT_CONSTRAINT_LOST' WHEN s_suppkey % 2 = 0 THEN 'DATA_LOST' ELSE 'replay' END AS outcome FROM supplier")
def g11_worker_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    facts = T.table(spark, sf_dir, "supplier").select("s_suppkey", (s % 7 == 0).alias("native_in_flight"), (s % 11 == 0).alias("shared_in_flight"), (s % 5 == 0).alias("context_needed"), (s % 3 == 0).alias("affinity_impossible"), (s % 2 == 0).alias("data_gone"))
    return C.loss_decisions(facts).select("s_suppkey", "outcome")


@query("WITH e AS (SELECT event_type AS value, user_id AS worker, event_id AS seq, CASE WHEN value > 10 THEN 'available' ELSE 'withdrawn' END AS kind FROM events) SELECT value, worker, max(seq) AS seq FROM e GROUP BY 1, 2 HAVING max_by(kind, seq) = 'available'")
def g14_latest_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("value") > 10, "available").otherwise("withdrawn")
    return C.latest_replicas(T.table(spark, sf_dir, "events").select(F.col("event_type").alias("value"), F.col("user_id").alias("worker"), F.col("event_id").alias("seq"), kind.alias("kind")))


@query(f"WITH {RUNS} SELECT l_orderkey // 2 AS value FROM lineitem LEFT JOIN runs ON l_orderkey = run GROUP BY 1 HAVING bool_and(coalesce(run_status IN ('succeeded', 'failed', 'cancelled'), false))")
def g15_releasable(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.expr("l_orderkey div 2").alias("value"))
    return C.releasable(uses, runs(spark, sf_dir).withColumnRenamed("run_status", "status"))


LAST = "last AS (SELECT run, task, max(attempt) AS attempt, max_by(status, attempt) AS status, count(*) AS attempts FROM attempts GROUP BY 1, 2)"


@query(f"WITH {RUNS}, {ATTEMPTS}, {LAST} SELECT run, run_status, task, attempt, status, attempts, count(*) OVER (PARTITION BY run) AS task_count, count(*) OVER (PARTITION BY run) > 1024 AS truncated FROM last JOIN runs USING (run)")
def g16_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.run_status(runs(spark, sf_dir), attempts(spark, sf_dir))


@query(f"WITH {ATTEMPTS} SELECT s_suppkey AS worker, s_name AS name, coalesce(count(DISTINCT a.run), 0) AS runs FROM supplier LEFT JOIN attempts a ON a.worker = s_suppkey AND a.status = 'running' GROUP BY 1, 2")
def g17_cluster_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    busy = attempts(spark, sf_dir).filter("status = 'running'").groupBy("worker").agg(F.count_distinct("run").alias("runs"))
    return T.table(spark, sf_dir, "supplier").join(busy, F.col("s_suppkey") == F.col("worker"), "left").select(F.col("s_suppkey").alias("worker"), F.col("s_name").alias("name"), F.coalesce("runs", F.lit(0)).cast("long").alias("runs"))


@query(f"WITH {RUNS}, {ATTEMPTS} SELECT DISTINCT 'orphan_attempt' AS rule, run AS subject FROM attempts WHERE run NOT IN (SELECT run FROM runs) UNION ALL SELECT DISTINCT 'running_in_finished_run', run FROM attempts JOIN runs USING (run) WHERE status = 'running' AND run_status <> 'running' UNION ALL SELECT DISTINCT 'attempt_hole', run FROM (SELECT run, task FROM attempts GROUP BY 1, 2 HAVING max(attempt) <> count(DISTINCT attempt))")
def g18_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.state_violations(attempts(spark, sf_dir), runs(spark, sf_dir))


@query(f"WITH {RUNS}, k AS (SELECT run FROM runs WHERE run_status <> 'running' ORDER BY archived_at DESC, run LIMIT 500) SELECT count(*) AS tombstones FROM runs WHERE run_status <> 'running' AND run NOT IN (SELECT run FROM k)")
def g19_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived runs that leave memory when the newest 500 stay."""
    done = runs(spark, sf_dir).filter("run_status <> 'running'")
    return H.pruned(done, H.kept_runs(done, 500)).agg(F.count("*").alias("tombstones"))


@query("SELECT l_partkey AS value, o_custkey % 100 AS destination, min(s) AS source FROM (SELECT DISTINCT l_partkey, o_custkey % 100 AS o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) n JOIN (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) r ON p = l_partkey WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_partkey = n.l_partkey AND x.l_suppkey = n.o_custkey % 100) GROUP BY 1, 2")
def h1_source_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T.table(spark, sf_dir, "lineitem")
    needs = li.join(T.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("value"), (F.col("o_custkey") % 100).alias("destination")).distinct()
    return M.transfer_sources(needs, li.select(F.col("l_partkey").alias("value"), F.col("l_suppkey").alias("worker")).distinct())


STEP = "CASE event_id % 11 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'started' WHEN 3 THEN 'accepted' WHEN 4 THEN 'requested' WHEN 5 THEN 'ready' ELSE 'prepare' END"


@query(f"WITH e AS (SELECT user_id % 2000 * 100 + event_id % 97 AS id, event_id AS seq, {STEP} AS kind FROM events) SELECT id, coalesce(min_by(kind, seq) FILTER (kind IN ('completed', 'failed')), ['prepare', 'ready', 'requested', 'accepted', 'started'][greatest(1, max(coalesce(list_position(['prepare', 'ready', 'requested', 'accepted', 'started'], kind), 0)))]) AS state FROM e GROUP BY id")
def h2_transfer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select((F.col("user_id") % 2000 * 100 + F.col("event_id") % 97).alias("id"), F.col("event_id").alias("seq"), F.expr(STEP).alias("kind"))
    return M.transfer_states(e)


# A fold over the transfers in order: lanes in use of every source and destination, and the transfers that went.
FOLD = """WITH t AS (SELECT event_id AS id, user_id AS s, event_id % 500 AS d FROM events), n AS (SELECT max(s) + 1 AS s, max(d) + 1 AS d FROM t),
x AS (SELECT list({s: [s], d: [d], went: [id]} ORDER BY id) AS all_ FROM t),
f AS (SELECT list_reduce(all_, lambda a, e: CASE WHEN a.s[e.s[1] + 1] < 4 AND a.d[e.d[1] + 1] < 4
  THEN {s: list_transform(a.s, lambda v, i: v + CAST(i = e.s[1] + 1 AS BIGINT)), d: list_transform(a.d, lambda v, i: v + CAST(i = e.d[1] + 1 AS BIGINT)), went: list_append(a.went, e.went[1])} ELSE a END,
  {s: list_transform(range(n.s), lambda v: CAST(0 AS BIGINT)), d: list_transform(range(n.d), lambda v: CAST(0 AS BIGINT)), went: CAST([] AS BIGINT[])}) AS end_ FROM x, n)
SELECT t.id, t.id IN (SELECT unnest(end_.went) FROM f) AS admitted FROM t"""


@query(FOLD)
def h3_admission4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), (F.col("event_id") % 500).alias("destination"))
    return M.admitted(e).select("id", "admitted")


@query("SELECT sha256(text) AS digest, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1")
def h6_content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.content_groups(T.table(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT id FROM (SELECT event_id AS id, event_id % 50 = 0 AS pinned, sum(event_id % 90 + 1) OVER (PARTITION BY user_id ORDER BY event_id % 50 = 0 DESC, ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS kept FROM events) WHERE kept > 1000 AND NOT pinned")
def h7_lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("pool"), F.col("event_id").alias("id"), F.col("ts").alias("last_used"), (F.col("event_id") % 90 + 1).alias("bytes"), (F.col("event_id") % 50 == 0).alias("pinned"))
    return M.evicted(e, 1000).select("id")


@query(f"WITH {ATTEMPTS} SELECT worker, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'reserved') AS reserved FROM attempts GROUP BY worker")
def d9_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.loads(attempts(spark, sf_dir))


@query(f"WITH {ATTEMPTS} SELECT run, worker, count(*) AS active FROM attempts WHERE status IN ('running', 'reserved') GROUP BY GROUPING SETS ((run), (worker), ())")
def d10_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.capacity_counts(attempts(spark, sf_dir))


@query("SELECT extension, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CASE WHEN max(bytes) > 8388608 THEN 'file_too_large' WHEN count(*) > 2048 THEN 'too_many_files' WHEN sum(bytes) > 67108864 THEN 'too_large' END AS refused FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'py' ELSE 'txt' END AS extension, strlen(text) AS bytes FROM documents) GROUP BY 1")
def a6_package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages, here the documents of an extension, and why one is refused: a limit that is broken refuses the whole package."""
    files = T.table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, "py").otherwise("txt").alias("extension"), F.octet_length("text").cast("long").alias("bytes"))
    return T.package_limits(files, "extension")


@query("SELECT sha256(string_agg(n_name || chr(9) || n_regionkey || chr(9) || sha256(n_name), chr(10) ORDER BY n_name || chr(9) || n_regionkey || chr(9) || sha256(n_name))) AS identity, count(*) AS files FROM nation")
def a6_package_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = T.table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.col("n_regionkey").alias("bytes"), F.sha2("n_name", 256).alias("sha256"))
    return T.package_identity(files).select("identity", "files")


@query("SELECT r_regionkey, r_name FROM region")
def a7_file_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, f"{sf_dir}/region.parquet").select("r_regionkey", "r_name")


@query(f"WITH {RUNS} SELECT run, run_status FROM runs WHERE run % 2 = 0")
def a14_append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archiving is idempotent: runs already there, here the odd ones, are not appended again, nor is a repeated run twice."""
    r = runs(spark, sf_dir)
    return H.new_rows(r.filter("run % 2 = 1"), r.union(r), ["run"]).select("run", "run_status")


@query(f"WITH {RUNS}, {ATTEMPTS} SELECT r.run, r.run_status, a.task, a.attempt, a.status FROM runs r LEFT JOIN attempts a USING (run) WHERE r.run = 77")
def a15_load_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir)
    return H.load_run(77, runs(spark, sf_dir), a.select("run", "task").distinct(), a).select("run", "run_status", "task", "attempt", "status")


@query(f"WITH {RUNS} SELECT run FROM runs ORDER BY archived_at DESC, run LIMIT 1000")
def a16_prune_keep_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention of the newest 1 000 runs."""
    return H.kept_runs(runs(spark, sf_dir), 1000).select("run")


@query("SELECT o_custkey AS program, o_orderkey AS run FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 20")
def a13_keep_20_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run reports: of each program, the newest 20 stay."""
    o = T.table(spark, sf_dir, "orders")
    return T.newest(o, 20, [F.col("o_orderdate").desc(), F.col("o_orderkey").asc()], ["o_custkey"]).select(F.col("o_custkey").alias("program"), F.col("o_orderkey").alias("run"))


@query("""SELECT '{"id":"' || n_name || '","inputs":' || n_regionkey || '}' AS line FROM nation""")
def a17_graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("inputs")).select(T.encode_json("id", "inputs").alias("line"))


