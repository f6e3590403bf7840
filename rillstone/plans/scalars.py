"""Projections, predicates and scalar expressions (groups A and B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as P
from ..sources import tables as T
from .registry import query

FLOOR = "(({a}) - ((({a}) % ({b})) + CASE WHEN ({a}) % ({b}) <> 0 AND (({a}) % ({b}) < 0) <> (({b}) < 0) THEN ({b}) ELSE 0 END)) // ({b})"
MOD = "(({a}) % ({b})) + CASE WHEN ({a}) % ({b}) <> 0 AND (({a}) % ({b}) < 0) <> (({b}) < 0) THEN ({b}) ELSE 0 END"


@query("SELECT CAST(7 AS BIGINT) AS int_value, 2.5::DOUBLE AS float_value, 'text' AS text_value, true AS bool_value, CAST(NULL AS VARCHAR) AS none_value")
def a2_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(7).cast("long").alias("int_value"), F.lit(2.5).alias("float_value"), F.lit("text").alias("text_value"), F.lit(True).alias("bool_value"), F.lit(None).cast("string").alias("none_value"))


@query("SELECT range AS i FROM range(3, 2000, 7)")
def a3_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.number_range(spark, 3, 2000, 7).select(F.col("id").alias("i"))


@query("SELECT p_partkey, p_size, p_size * 2 AS twice, CAST(2 AS INTEGER) AS items FROM part")
def a4_list_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.array(F.col("p_size"), F.col("p_size") * 2)
    return T.table(spark, sf_dir, "part").withColumn("pair", pair).select("p_partkey", P.item(F.col("pair"), 0).alias("p_size"), P.item(F.col("pair"), -1).alias("twice"), F.size("pair").alias("items"))


@query("SELECT n_nationkey, n_name AS by_key, CAST(CASE WHEN n_regionkey = 1 THEN 1 ELSE 2 END AS INTEGER) AS set_size, CAST('later' AS VARCHAR) AS repeated FROM nation")
def a5_dict_set_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.last_wins(F.array(F.lit("name"), F.lit("k"), F.lit("k")), F.array(F.col("n_name"), F.lit("first"), F.lit("later")))
    s = F.array_distinct(F.array(F.lit(1), F.col("n_regionkey")))
    return T.table(spark, sf_dir, "nation").withColumn("d", d).select("n_nationkey", F.col("d")["name"].alias("by_key"), F.size(s).alias("set_size"), F.col("d")["k"].alias("repeated"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}' AS record FROM events")
def a19_json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    return e.select("event_id", T.decode_json("props", "k long")["k"].alias("k"), T.encode_json("event_id", "user_id").alias("record"))


@query("SELECT doc_id, CAST(CASE WHEN strlen(text) > 4096 THEN right(text, 256) ELSE text END AS VARCHAR) AS tail, strlen(text) > 4096 AS truncated FROM documents")
def a21_truncate_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail, cut = T.bounded_text("text", 4096, 256)
    return T.table(spark, sf_dir, "documents").select("doc_id", tail.alias("tail"), cut.alias("truncated"))


@query("SELECT DISTINCT '  \"r' || n_regionkey || '\" -> \"n' || n_nationkey || '\";' AS line FROM nation")
def a18_dot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.table(spark, sf_dir, "nation")
    return T.dot_lines(n.select(F.concat(F.lit("r"), "n_regionkey").alias("source"), F.concat(F.lit("n"), "n_nationkey").alias("target")).distinct())


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_acctbal AS same FROM customer")
def b2_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_acctbal").alias("same"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) * 3 + l_orderkey - 1 AS result FROM lineitem")
def b3_int_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber").cast("long") * 3 + F.col("l_orderkey") - 1).alias("result"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_linenumber, 4) AS result FROM lineitem")
def b4_float_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) + F.col("l_linenumber"), 4).alias("result"))


SIGNED = "SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS a, CAST(CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE -7 END AS BIGINT) AS b FROM customer"


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "customer").select("c_custkey", F.floor("c_acctbal").cast("long").alias("a"), F.when(F.col("c_custkey") % 2 == 0, 7).otherwise(-7).cast("long").alias("b"))


@query(f"SELECT c_custkey, {FLOOR.format(a='a', b='b')} AS result FROM ({SIGNED})")
def b5_floor_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir).select("c_custkey", P.floor_div(F.col("a"), F.col("b")).alias("result"))


@query(f"SELECT c_custkey, {MOD.format(a='a', b='b')} AS result FROM ({SIGNED})")
def b6_mod_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir).select("c_custkey", P.modulo(F.col("a"), F.col("b")).alias("result"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity AS result FROM lineitem WHERE l_quantity <> 0")
def b7_true_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "lineitem").filter("l_quantity <> 0").select("l_orderkey", "l_linenumber", "l_partkey", P.true_div(F.col("l_extendedprice"), F.col("l_quantity")).alias("result"))


@query("SELECT c_custkey, -c_acctbal AS negated, +c_acctbal AS same, -(c_custkey) - 1 AS inverted FROM customer")
def b8_unary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "customer").select("c_custkey", F.negative("c_acctbal").alias("negated"), F.positive("c_acctbal").alias("same"), F.bitwise_not("c_custkey").alias("inverted"))


@query("SELECT event_id, NOT (user_id IS NOT NULL AND user_id <> 0) AS no_user, NOT (event_type IS NOT NULL AND length(event_type) > 0) AS no_type, NOT (user_id % 3 > 0) AS empty_list FROM events")
def b9_not_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = P.int_range(F.lit(0).cast("long"), F.col("user_id") % 3)
    return T.table(spark, sf_dir, "events").select("event_id", (~P.truthy_number(F.col("user_id"))).alias("no_user"), (~P.truthy_text(F.col("event_type"))).alias("no_type"), (~P.truthy_list(items)).alias("empty_list"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE 10 <= l_quantity AND l_quantity < 20")
def b10_compare_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return T.table(spark, sf_dir, "lineitem").filter((q >= 10) & (q < 20)).filter(P.between_chain(F.lit(10.0), q, F.lit(20.0))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT s_suppkey, abs(s_acctbal) AS result FROM supplier")
def b11_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "supplier").select("s_suppkey", F.abs("s_acctbal").alias("result"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, least(l_orderkey, l_partkey, l_suppkey) AS low, greatest(l_discount, l_tax) AS high FROM lineitem")
def b12_least_greatest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.least("l_orderkey", "l_partkey", "l_suppkey").alias("low"), F.greatest("l_discount", "l_tax").alias("high"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS code_points, CAST(strlen(text) AS BIGINT) AS bytes, CAST(len(string_split(text, ' ')) AS BIGINT) AS items FROM documents")
def b13_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("code_points"), F.octet_length("text").cast("long").alias("bytes"), F.size(F.split("text", " ", -1)).cast("long").alias("items"))


@query("SELECT vec_id, embedding[1] AS first, embedding[64] AS last FROM embeddings")
def b14_subscript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "embeddings").select("vec_id", P.item(F.col("embedding"), 0).alias("first"), P.item(F.col("embedding"), -1).alias("last"))


@query("SELECT vec_id, embedding[1] AS x, embedding[2] AS y, CAST(61 AS BIGINT) AS rest_len, embedding[3] AS rest_first, embedding[64] AS z FROM embeddings")
def b15_unpack_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    (x, y), rest, (z,) = P.star_unpack(F.col("embedding"), 2, 1)
    return T.table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"), y.alias("y"), F.size(rest).cast("long").alias("rest_len"), P.item(rest, 0).alias("rest_first"), z.alias("z"))


@query("SELECT o_orderkey, round(o_totalprice * 2, 2) AS a, round(o_totalprice * 2, 2) AS b FROM orders")
def b16_multi_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.round(F.col("o_totalprice") * 2, 2)
    return T.table(spark, sf_dir, "orders").select("o_orderkey", e.alias("a"), e.alias("b"))


@query("SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CAST(floor(x * 100) AS BIGINT))) AS BIGINT) AS total FROM embeddings")
def b17_comprehension_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = F.transform("embedding", lambda x: F.floor(x * F.lit(100).cast("float")).cast("long"))
    return T.table(spark, sf_dir, "embeddings").select("vec_id", P.list_sum(mapped).alias("total"))


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive FROM embeddings")
def b18_comprehension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "embeddings").select("vec_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' WHEN p_size > 10 THEN 'medium' ELSE 'small' END AS kind FROM part")
def b20_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, "large").when(F.col("p_size") > 10, "medium").otherwise("small").alias("kind"))


@query("SELECT o_orderkey, (o_totalprice > 100000 AND o_orderstatus = 'O') OR o_orderpriority LIKE '1%' AS urgent, CASE WHEN o_custkey <> 0 THEN o_custkey ELSE -1 END AS or_value FROM orders")
def b20_boolop(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = ((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "O")) | F.col("o_orderpriority").startswith("1")
    return T.table(spark, sf_dir, "orders").select("o_orderkey", urgent.alias("urgent"), F.when(P.truthy_number(F.col("o_custkey")), F.col("o_custkey")).otherwise(F.lit(-1).cast("long")).alias("or_value"))


@query("SELECT n_nationkey, n_name || '@' || n_regionkey AS label, upper(left(n_name, 3)) AS short FROM nation")
def b20_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "nation").select("n_nationkey", F.format_string("%s@%d", "n_name", "n_regionkey").alias("label"), F.upper(F.substring("n_name", 1, 3)).alias("short"))


@query("SELECT vec_id, CAST(len(list_distinct(list_transform(embedding, lambda x: CAST(floor(x * 10) AS BIGINT)))) AS BIGINT) AS set_size, CAST(3 AS BIGINT) AS dict_size FROM embeddings")
def b20_set_dict_comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.array_distinct(F.transform("embedding", lambda x: F.floor(x * F.lit(10).cast("float")).cast("long")))
    d = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(k, k * k)))
    return T.table(spark, sf_dir, "embeddings").select("vec_id", F.size(s).cast("long").alias("set_size"), F.size(F.map_keys(d)).cast("long").alias("dict_size"))
