"""Keyed state, joins, dictionaries, set operations."""

from pyspark.sql import functions as F

from siftyard.operators import ids, keyed
from siftyard.session import table


def _ops(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")


def first_wins(spark, sf_dir):
    return keyed.first_wins(_ops(spark, sf_dir), "user_id", "event_id", ["event_id", "value"])


def upsert_last_wins(spark, sf_dir):
    return keyed.last_wins(_ops(spark, sf_dir), "user_id", "event_id", ["value", "event_type"])


def update_existing(spark, sf_dir):
    state = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return keyed.update_existing(state, new, "c_custkey", "c_acctbal")


def delete_keys(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return keyed.delete_keys(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_orderkey")


def hash_lookup_join(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return keyed.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey").select("c_custkey", "n_name")


def semi_join_known(spark, sf_dir):
    known = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return keyed.known(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), known, "l_orderkey")


def anti_join_new(spark, sf_dir):
    return keyed.unknown(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey")


def left_lookup_default(spark, sf_dir):
    top = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return keyed.lookup_default(table(spark, sf_dir, "customer").select("c_custkey"), top, ["c_custkey"], "n_orders", F.lit(0).cast("long"))


def composite_remap(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    new = rows.filter("l_returnflag = 'R'").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.max(F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("new_id"))
    return keyed.lookup_default(rows.drop("l_returnflag"), new, ["l_orderkey", "l_partkey", "l_suppkey"], "new_id", F.col("l_partkey"))


def _dictionary(spark, sf_dir):
    return ids.dictionary(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id")


def dict_scan(spark, sf_dir):
    return _dictionary(spark, sf_dir).orderBy("id")


def dict_encode(spark, sf_dir):
    return ids.encode(table(spark, sf_dir, "events").select("event_id", "event_type"), _dictionary(spark, sf_dir), "event_type").select("event_id", "id")


def dict_lookup(spark, sf_dir):
    """Languages and sources looked up in the dictionary of languages: the latter are not in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    known = ids.dictionary(docs, "lang", "doc_id")
    return ids.encode(docs.select("doc_id", F.explode(F.array("lang", "source")).alias("name")), known, "name")


def dict_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7).alias("key"))
    return ids.decode(rows, _dictionary(spark, sf_dir), "key")


def distinct_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


def _two(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))


def set_union(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.union(b).distinct()


def set_intersect(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.intersect(b)


def set_except(spark, sf_dir):
    """Orders without a line."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).exceptAll(lines.distinct())


QUERIES = {f.__name__: f for f in (first_wins, upsert_last_wins, update_existing, delete_keys, hash_lookup_join, semi_join_known, anti_join_new, left_lookup_default, composite_remap, dict_scan, dict_encode, dict_lookup, dict_decode, distinct_keys, set_union, set_intersect, set_except)}

_DICT = "WITH d AS (SELECT event_type AS value, row_number() OVER (ORDER BY min(event_id)) - 1 AS id FROM events GROUP BY event_type)"
ORACLES = {
    "first_wins": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1",
    "upsert_last_wins": "SELECT user_id, value, event_type, m AS inserted_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, min(event_id) OVER (PARTITION BY user_id) AS m FROM events) WHERE r = 1",
    "update_existing": "SELECT c_custkey, coalesce(m, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "delete_keys": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "hash_lookup_join": "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "semi_join_known": "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "anti_join_new": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "left_lookup_default": "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "composite_remap": """WITH n AS (SELECT l_orderkey, l_partkey, l_suppkey, max(l_partkey * 10 + l_linenumber) AS new_id FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3)
SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, coalesce(n.new_id, l.l_partkey) AS new_id FROM lineitem l LEFT JOIN n USING (l_orderkey, l_partkey, l_suppkey)""",
    "dict_scan": f"{_DICT} SELECT id, value FROM d",
    "dict_encode": f"{_DICT} SELECT event_id, id FROM events JOIN d ON d.value = event_type",
    "dict_lookup": """WITH d AS (SELECT lang AS value, row_number() OVER (ORDER BY min(doc_id), lang) - 1 AS id FROM documents WHERE lang IS NOT NULL GROUP BY lang),
n AS (SELECT doc_id, unnest([lang, source]) AS name FROM documents) SELECT doc_id, name, id FROM n LEFT JOIN d ON value = name""",
    "dict_decode": f"{_DICT} SELECT event_id, event_id % 7 AS key, d.value FROM events LEFT JOIN d ON id = event_id % 7",
    "distinct_keys": "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem",
    "set_union": "SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders",
    "set_intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders",
    "set_except": "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
}
