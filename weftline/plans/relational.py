"""Scans, filters, joins, aggregations, windows and set operations on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import capability as C
from weftline.operators import relational as R
from weftline.plans.registry import Registry, table

relational = Registry()
q = relational.query


@q("""SELECT l_orderkey, l_linenumber, l_quantity, 'lineitem' AS src FROM lineitem
      WHERE l_returnflag = 'R' AND l_linestatus IN ('F') AND l_quantity >= 10 AND l_shipdate < TIMESTAMP '1997-01-01'""")
def scan_filter_project(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").filter((F.col("l_returnflag") == "R") & F.col("l_linestatus").isin("F") & (F.col("l_quantity") >= 10) & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
    return x.select("l_orderkey", "l_linenumber", "l_quantity", F.lit("lineitem").alias("src"))


@q("""SELECT doc_id, CASE WHEN text IS NULL OR trim(text, E' \\n\\r\\t') = '' THEN 'EMPTY' WHEN contains(text, '```') THEN 'FENCED' WHEN contains(lower(text), ' warn ') OR contains(lower(text), ' fail ') THEN 'LOG'
      WHEN starts_with(text, '#') THEN 'TITLED' WHEN n_chars > 5000 THEN 'LONG' ELSE 'PLAIN' END AS input_class FROM documents""")
def case_classify(spark: SparkSession, d: str) -> DataFrame:
    t, low = F.col("text"), F.lower("text")
    c = F.when(t.isNull() | (F.trim(t, F.lit(" \n\r\t")) == ""), "EMPTY").when(t.contains("```"), "FENCED").when(low.contains(" warn ") | low.contains(" fail "), "LOG").when(t.startswith("#"), "TITLED").when(F.col("n_chars") > 5000, "LONG")
    return table(spark, d, "documents").select("doc_id", c.otherwise("PLAIN").alias("input_class"))


@q("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events""")
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    k = X.first_present(F.get_json_object("props", "$.key"), F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", F.coalesce(k.try_cast("int"), F.lit(0)).alias("k"))


@q("""SELECT 'customer' AS src, c_name AS party, c_nationkey AS nation, c_acctbal AS balance FROM customer
      UNION ALL SELECT 'supplier', s_name, s_nationkey, s_acctbal FROM supplier""")
def union_tagged(spark: SparkSession, d: str) -> DataFrame:
    parts = {"customer": table(spark, d, "customer"), "supplier": table(spark, d, "supplier")}
    cols = {"customer": {"party": "c_name", "nation": "c_nationkey", "balance": "c_acctbal"}, "supplier": {"party": "s_name", "nation": "s_nationkey", "balance": "s_acctbal"}}
    return R.union_tagged(parts, cols)


@q("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2")
def weighted_union_count(spark: SparkSession, d: str) -> DataFrame:
    return R.weighted_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@q("""SELECT r_name, n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def inner_join_star(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@q("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_totalprice > 100000")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@q("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 450000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@q("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'NEW' WHEN b.k IS NULL THEN 'MISSING' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'CONFIRMED' ELSE 'CONFLICT' END AS comparison
      FROM (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
      FULL JOIN (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k""")
def full_outer_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    side = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("v"))
    return R.compare_status(side("F"), side("O"), ["k"], "v")


@q("SELECT p_partkey, p_brand, coalesce(n, 0) AS n_lines FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON p_partkey = l_partkey")
def left_enrich_default(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").filter("l_quantity > 45").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_brand", F.coalesce("n", F.lit(0)).alias("n_lines"))


@q("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_wins(table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@q("""WITH e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_totalprice > 300000)
      SELECT DISTINCT a.src, a.dst AS mid, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst""")
def two_hop_self_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_totalprice > 300000")
    x = o.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return R.two_hop(x, "c_nationkey", "s_nationkey")


@q("""SELECT a.n_nationkey AS src, b.n_nationkey AS dst, coalesce(c.n, 0) AS n_customers, coalesce(s.n, 0) AS n_suppliers, c.n IS NOT NULL AND s.n IS NOT NULL AS feasible
      FROM nation a CROSS JOIN nation b LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c ON c.k = a.n_nationkey
      LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = b.n_nationkey WHERE a.n_nationkey <> b.n_nationkey""")
def route_grid(spark: SparkSession, d: str) -> DataFrame:
    n = F.broadcast(table(spark, d, "nation").select("n_nationkey"))  # a fixed dimension of 25 rows
    c = table(spark, d, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("src")).agg(F.count(F.lit(1)).alias("cn"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("sn"))
    g = n.select(F.col("n_nationkey").alias("src")).crossJoin(n.select(F.col("n_nationkey").alias("dst"))).filter("src <> dst").join(c, "src", "left").join(s, "dst", "left")
    return g.select("src", "dst", F.coalesce("cn", F.lit(0)).alias("n_customers"), F.coalesce("sn", F.lit(0)).alias("n_suppliers"), (F.col("cn").isNotNull() & F.col("sn").isNotNull()).alias("feasible"))


@q("""WITH need AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
      have AS (SELECT DISTINCT p_size AS s, p_brand AS b FROM part), k AS (SELECT o, count(*) AS n FROM need GROUP BY 1)
      SELECT need.o, have.s FROM need JOIN have USING (b) JOIN k ON k.o = need.o GROUP BY need.o, have.s, k.n HAVING count(*) = k.n""")
def containment_join(spark: SparkSession, d: str) -> DataFrame:
    """Part sizes that come in every brand an order holds."""
    need = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o"), F.col("p_brand").alias("b"))
    return R.containment_join(need, table(spark, d, "part").select(F.col("p_size").alias("s"), F.col("p_brand").alias("b")), "o", "s", "b")


@q("""WITH p AS (SELECT DISTINCT p_size AS v, p_brand AS b FROM part), n AS (SELECT v, count(*) AS n FROM p GROUP BY 1),
      j AS (SELECT x.v AS a, y.v AS b, count(*) AS n_both FROM p x JOIN p y ON x.b = y.b AND x.v < y.v GROUP BY 1, 2)
      SELECT a, b, n_both, CASE WHEN n_both = na.n AND na.n = nb.n THEN 'EXACT' ELSE 'IMPLICATION' END AS relation FROM j JOIN n na ON na.v = a JOIN n nb ON nb.v = b WHERE n_both = least(na.n, nb.n)""")
def vector_equal_or_subset(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_relations(table(spark, d, "part").select(F.col("p_size").alias("v"), F.col("p_brand").alias("brand")), "v", "brand")


@q("""WITH p AS (SELECT DISTINCT package_name AS v, lang_id AS b FROM semantic_package_file WHERE package_name IS NOT NULL AND lang_id IS NOT NULL), n AS (SELECT v, count(*) AS n FROM p GROUP BY 1),
      j AS (SELECT x.v AS a, y.v AS b, count(*) AS n_both FROM p x JOIN p y ON x.b = y.b AND x.v < y.v GROUP BY 1, 2)
      SELECT a, b, n_both, CASE WHEN n_both = na.n AND na.n = nb.n THEN 'EXACT' ELSE 'IMPLICATION' END AS relation FROM j JOIN n na ON na.v = a JOIN n nb ON nb.v = b WHERE n_both = least(na.n, nb.n)""")
def vector_relations_packages(spark: SparkSession, d: str) -> DataFrame:
    """Packages whose languages equal or include another's, over the whole table."""
    return R.vector_relations(table(spark, d, "semantic_package_file").filter("package_name IS NOT NULL AND lang_id IS NOT NULL"), "package_name", "lang_id")


@q("""SELECT doc_id, band FROM documents JOIN (VALUES (0, 500, 'short'), (500, 2000, 'medium'), (2000, 10000, 'long'), (10000, 10000000, 'huge')) AS b(lo, hi, band) ON n_chars >= lo AND n_chars < hi""")
def range_containment(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame([(0, 500, "short"), (500, 2000, "medium"), (2000, 10000, "long"), (10000, 10000000, "huge")], "lo long, hi long, band string")
    return R.range_join(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", bands, "lo", "hi", 10000.0).select("doc_id", "band")


@q("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@q("""SELECT event_type, count(*) FILTER (WHERE value > 50) AS n_pass, count(*) FILTER (WHERE value <= 50) AS n_fail, count(*) FILTER (WHERE value IS NULL) AS n_unknown FROM events GROUP BY 1""")
def conditional_count(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(v > 50).alias("n_pass"), F.count_if(v <= 50).alias("n_fail"), F.count_if(v.isNull()).alias("n_unknown"))


@q("SELECT event_type, count(DISTINCT user_id) AS n_users, count(DISTINCT props) AS n_props FROM events GROUP BY 1")
def distinct_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("props").alias("n_props"))


@q("SELECT r_name, string_agg(DISTINCT n_name, ';' ORDER BY n_name) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def collect_distinct_joined(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return x.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ";").alias("nations"))


@q("SELECT p_brand, string_agg(p_name, '|' ORDER BY p_name, p_partkey) AS sample3 FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS r FROM part) WHERE r <= 3 GROUP BY 1")
def sample3_sorted(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")
    x = table(spark, d, "part").withColumn("r", F.row_number().over(w)).filter("r <= 3")
    return x.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "p_name"))), lambda s: s["p_name"]), "|").alias("sample3"))


PROOF = """SELECT lower(trim(lang)) AS lang_id, doc_kind, count(DISTINCT sha256(text)) AS n_hashes, count(DISTINCT package_name) AS n_packages, count(*) FILTER (WHERE n_chars > 0) AS n_positive, count(*) FILTER (WHERE n_chars <= 1) AS n_contradicting FROM documents WHERE lang IS NOT NULL AND doc_kind IS NOT NULL GROUP BY 1, 2"""


def _proof(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").filter("lang IS NOT NULL AND doc_kind IS NOT NULL").withColumn("h", X.content_hash(F.col("text")))
    return x.groupBy(X.normalize_language(F.col("lang")).alias("lang_id"), "doc_kind").agg(F.countDistinct("h").alias("n_hashes"), F.countDistinct("package_name").alias("n_packages"), F.count_if(F.col("n_chars") > 0).alias("n_positive"), F.count_if(F.col("n_chars") <= 1).alias("n_contradicting"))


@q(f"""SELECT *, CASE WHEN n_contradicting > 0 THEN 'CONTRADICTED' WHEN n_hashes >= 3 AND n_packages >= 2 THEN 'PROVEN' ELSE 'INSUFFICIENT' END AS classification FROM ({PROOF})""")
def proof_gate(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("n_contradicting") > 0, "CONTRADICTED").when((F.col("n_hashes") >= 3) & (F.col("n_packages") >= 2), "PROVEN").otherwise("INSUFFICIENT")
    return _proof(spark, d).withColumn("classification", c)


@q(f"""SELECT doc_kind, bool_or(n_hashes >= 3 AND n_packages >= 2) AND NOT bool_or(n_contradicting > 0) AS is_proven, CAST(sum(n_positive) AS BIGINT) AS n_positive FROM ({PROOF}) GROUP BY 1""")
def proof_rollup(spark: SparkSession, d: str) -> DataFrame:
    ok, bad = F.bool_or((F.col("n_hashes") >= 3) & (F.col("n_packages") >= 2)), F.bool_or(F.col("n_contradicting") > 0)
    return _proof(spark, d).groupBy("doc_kind").agg((ok & ~bad).alias("is_proven"), F.sum("n_positive").alias("n_positive"))


@q("""SELECT r_name, n_name, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup_total(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@q("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS status_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS status_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS status_p FROM orders GROUP BY 1""")
def pivot_status(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return x.select("o_orderpriority", *[F.coalesce(F.col(s), F.lit(0)).alias(f"status_{s.lower()}") for s in "FOP"])


@q("""WITH s AS (SELECT l_linestatus, l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS k FROM lineitem GROUP BY 1, 2)
      SELECT l_linestatus, l_returnflag, round(greatest((k / n::DOUBLE + 1.95996398454 * 1.95996398454 / (2 * n) - 1.95996398454 * sqrt((k / n::DOUBLE) * (1 - k / n::DOUBLE) / n + 1.95996398454 * 1.95996398454 / (4.0 * n * n))) / (1 + 1.95996398454 * 1.95996398454 / n), 0), 6) AS lower_bound FROM s""")
def wilson_bound(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("k"))
    return s.select("l_linestatus", "l_returnflag", F.round(R.wilson_lower(F.col("k"), F.col("n")), 6).alias("lower_bound"))


@q("SELECT p_brand, round(CASE WHEN count(*) FILTER (WHERE p_size > 49) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE p_size < 3) / (count(*) FILTER (WHERE p_size > 49))::DOUBLE END, 6) AS small_to_large FROM part GROUP BY 1")
def ratio_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(R.ratio(F.count_if(F.col("p_size") < 3), F.count_if(F.col("p_size") > 49)), 6).alias("small_to_large"))


@q("""WITH a AS (SELECT user_id, arg_min(event_type, event_id) AS s FROM events GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, event_id) AS s FROM events GROUP BY 1)
      SELECT a.s AS old_status, b.s AS new_status, count(*) AS n FROM a JOIN b USING (user_id) GROUP BY 1, 2""")
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return R.transitions(e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("s")), e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("s")), "user_id", "s")


@q("SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first_status, min(o_orderdate) AS first_date FROM orders GROUP BY 1")
def min_by_stage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("first_status"), F.min("o_orderdate").alias("first_date"))


@q("""SELECT p_brand, p_partkey, p_size, count(*) OVER (PARTITION BY p_brand) AS n_ties FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size, p_type) AS r FROM part) WHERE r = 1""")
def argmin_ties(spark: SparkSession, d: str) -> DataFrame:
    return R.argmin_with_ties(table(spark, d, "part").select("p_brand", "p_partkey", "p_size", "p_type"), ["p_brand"], ["p_size", "p_type"]).drop("p_type")


@q("""SELECT p_brand, p_type, p_size, count(DISTINCT p_partkey) AS n_members, printf('Q%05d', dense_rank() OVER (ORDER BY p_brand, p_type, p_size)) AS class_id FROM part GROUP BY 1, 2, 3""")
def quotient_signature(spark: SparkSession, d: str) -> DataFrame:
    return R.quotient(table(spark, d, "part"), "p_partkey", ["p_brand", "p_type", "p_size"], "Q")


ROW_CLASS = """WITH s AS (SELECT {row} AS r, string_agg(DISTINCT CAST({col} AS VARCHAR), chr(31) ORDER BY CAST({col} AS VARCHAR)) AS s FROM {src} GROUP BY 1)
      SELECT substr(sha256(s), 1, 16) AS signature, count(*) AS n_members, min(r) AS first_member FROM s GROUP BY 1"""


@q(ROW_CLASS.format(row="o_custkey", col="o_orderpriority", src="orders"))
def row_class(spark: SparkSession, d: str) -> DataFrame:
    return R.set_quotient(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@q(ROW_CLASS.format(row="p_brand", col="p_size", src="part"))
def column_class(spark: SparkSession, d: str) -> DataFrame:
    return R.set_quotient(table(spark, d, "part"), "p_brand", "p_size")


@q("""WITH p AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey)
      SELECT x.b AS a, y.b AS b, count(*) AS n_both FROM p x JOIN p y ON x.o = y.o AND x.b < y.b GROUP BY 1, 2""")
def cooccurrence_gram(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return R.cooccurrence(p, "l_orderkey", "p_brand")


@q("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_pass, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_unknown, round((count(*) FILTER (WHERE o_orderstatus = 'F')) / count(*)::DOUBLE, 6) AS lower_rate,
      round((count(*) FILTER (WHERE o_orderstatus IN ('F', 'P'))) / count(*)::DOUBLE, 6) AS upper_rate FROM orders GROUP BY 1""")
def masked_counts(spark: SparkSession, d: str) -> DataFrame:
    s, n = F.col("o_orderstatus"), F.count(F.lit(1))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(s == "F").alias("n_pass"), F.count_if(s == "P").alias("n_unknown"), F.round(R.ratio(F.count_if(s == "F"), n), 6).alias("lower_rate"), F.round(R.ratio(F.count_if(s.isin("F", "P")), n), 6).alias("upper_rate"))


@q("""SELECT p AS previous, event_type AS next, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL AND p <> event_type GROUP BY 1, 2""")
def lag_dependency(spark: SparkSession, d: str) -> DataFrame:
    return R.lag_changes(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").groupBy("previous", "next").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_family, count(*) - 1 AS n_hidden FROM orders GROUP BY 1")
def latent_hidden(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("first_family"), F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("n_hidden"))


@q("""SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS cum_sum, min(o_totalprice) OVER w AS cum_min, max(o_totalprice) OVER w AS cum_max FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def running_sum_min_max(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum(p).over(w), 2).alias("cum_sum"), F.min(p).over(w).alias("cum_min"), F.max(p).over(w).alias("cum_max"))


STEPS = "a AS (SELECT l_orderkey AS k, l_linenumber AS step, l_returnflag AS v FROM lineitem), b AS (SELECT k - 1 AS k, step, v FROM a)"


def _neighbours(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("step"), F.col("l_returnflag").alias("v"))
    return s, s.withColumn("k", F.col("k") - 1)


@q(f"WITH {STEPS} SELECT k, min(step) AS first_step FROM a JOIN b USING (k, step) WHERE a.v <> b.v GROUP BY 1")
def first_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Every order compared step by step with the next one."""
    return R.first_divergence(*_neighbours(spark, d), ["k"], "step", "v", strict=False)


@q(f"WITH {STEPS} SELECT coalesce(a.k, b.k) AS k, min(coalesce(a.step, b.step)) AS first_step FROM a FULL JOIN b ON a.k = b.k AND a.step = b.step WHERE a.v IS DISTINCT FROM b.v OR a.k IS NULL OR b.k IS NULL GROUP BY 1")
def strict_divergence(spark: SparkSession, d: str) -> DataFrame:
    return R.first_divergence(*_neighbours(spark, d), ["k"], "step", "v", strict=True)


@q("""WITH x AS (SELECT DISTINCT c_nationkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey), g AS (SELECT *, o_orderkey - row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) AS g FROM x)
      SELECT c_nationkey, min(o_orderkey) AS range_start, max(o_orderkey) AS range_end FROM g GROUP BY c_nationkey, g""")
def islands_ranges(spark: SparkSession, d: str) -> DataFrame:
    return R.islands(table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")), ["c_nationkey"], "o_orderkey")


@q("""WITH RECURSIVE o AS (SELECT o_custkey AS k, o_totalprice AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
      f AS (SELECT k, i, 1 AS unit, 1 AS n, c FROM o WHERE i = 1 UNION ALL
            SELECT f.k, o.i, CASE WHEN f.c + o.c > 500000 OR f.n >= 4 THEN f.unit + 1 ELSE f.unit END, CASE WHEN f.c + o.c > 500000 OR f.n >= 4 THEN 1 ELSE f.n + 1 END, CASE WHEN f.c + o.c > 500000 OR f.n >= 4 THEN o.c ELSE f.c + o.c END FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
      SELECT k AS o_custkey, unit, max(n) AS n_items, round(max(c), 2) AS unit_cost FROM f GROUP BY 1, 2""")
def greedy_pack(spark: SparkSession, d: str) -> DataFrame:
    return R.greedy_units(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 500000.0, 4).withColumn("unit_cost", F.round("unit_cost", 2))


@q("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


@q("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def best_per_key(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", (-F.col("p_retailprice")).alias("cost"))
    return R.first_per_group(x, ["p_brand"], ["cost", "p_partkey"]).drop("cost")


@q("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 5 OFFSET 3")
def offset_limit(spark: SparkSession, d: str) -> DataFrame:
    """A row-range scan over a total order."""
    return table(spark, d, "supplier").select("s_suppkey", "s_name").orderBy("s_suppkey").offset(3).limit(5)


@q("""SELECT o_custkey, CASE min(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 END) WHEN 1 THEN 'DIRECT' WHEN 2 THEN 'REWRITE' WHEN 3 THEN 'HELPER' WHEN 4 THEN 'EMULATE' ELSE 'ERROR' END AS mode FROM orders GROUP BY 1""")
def mode_preference(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    m = F.when(p == "1-URGENT", "DIRECT").when(p == "2-HIGH", "REWRITE").when(p == "3-MEDIUM", "HELPER").when(p == "4-NOT SPECIFIED", "EMULATE")
    return C.preferred_route(table(spark, d, "orders").select("o_custkey", m.alias("mode")), ["o_custkey"])


NORMAL = "regexp_replace(regexp_replace(regexp_replace(text, E'\\r\\n?', E'\\n', 'g'), E'[ \\t]+(\\n|$)', E'\\\\1', 'g'), E'\\n+$', '') || E'\\n'"


@q(f"""WITH n AS (SELECT doc_id, coalesce(source, '') AS source, sha256({NORMAL}) AS h FROM documents WHERE text IS NOT NULL)
      SELECT h AS content_hash, min(doc_id) AS doc_id, count(*) AS n_members, string_agg(DISTINCT source, '|' ORDER BY source) AS provenance FROM n GROUP BY 1""")
def dedup_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the hash of their normalised text: the least id survives, with the sources it was found in."""
    return R.dedup_with_provenance(_hashed_documents(spark, d), "content_hash", "doc_id", F.col("source")).select("content_hash", "doc_id", "n_members", "provenance")


def _hashed_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), X.content_hash(X.normalize_source(F.col("text"))).alias("content_hash"))


@q(f"SELECT sha256({NORMAL}) AS content_hash, coalesce(source, '') || ':' || CAST(doc_id AS VARCHAR) AS origin, count(*) AS n_members FROM documents WHERE text IS NOT NULL GROUP BY 1, 2")
def document_origins(spark: SparkSession, d: str) -> DataFrame:
    """Every origin of every text, a row each, so that a text held by a third of all documents is no single row."""
    return R.origins(_hashed_documents(spark, d), "content_hash", F.concat("source", F.lit(":"), F.col("doc_id").cast("string")))


@q("""SELECT count(*) AS n_docs, count(DISTINCT sha256(text)) AS n_hashes, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(DISTINCT package_name) AS n_packages, count(*) FILTER (WHERE lang IS NULL) AS n_no_lang FROM documents""")
def summary_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct(X.content_hash(F.col("text"))).alias("n_hashes"), F.sum("n_chars").alias("n_chars"), F.countDistinct("package_name").alias("n_packages"), F.count_if(F.col("lang").isNull()).alias("n_no_lang"))


@q("SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9500")
def intersect_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).intersect(table(spark, d, "customer").filter("c_acctbal > 9500").select("c_nationkey"))


@q("SELECT n_nationkey AS nation FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
def except_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("nation")).subtract(table(spark, d, "customer").filter("c_acctbal > 9900").select("c_nationkey"))


@q("""SELECT trace_id, max(recorded_at) AS last_at, count(DISTINCT node_kind) AS n_kinds, CAST(sum(arity) AS BIGINT) AS arity FROM semantic_trace_node GROUP BY 1""")
def trace_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "semantic_trace_node").groupBy("trace_id").agg(F.max("recorded_at").alias("last_at"), F.countDistinct("node_kind").alias("n_kinds"), F.sum("arity").alias("arity"))


@q("""SELECT lang_name, semantic_feature, CASE min(CASE evidence_state WHEN 'SEEN' THEN 1 WHEN 'ABSENT' THEN 2 ELSE 3 END) WHEN 1 THEN 'PRESENT' WHEN 2 THEN 'ABSENT' ELSE 'UNRESOLVED' END AS status,
      count(*) FILTER (WHERE evidence_state = 'SEEN') AS n_present, count(*) FILTER (WHERE evidence_state = 'ABSENT') AS n_absent, count(*) FILTER (WHERE evidence_state IS NULL OR evidence_state NOT IN ('SEEN', 'ABSENT')) AS n_unresolved FROM frontend_compiler_m_lang GROUP BY 1, 2""")
def evidence_precedence(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("evidence_state")
    x = table(spark, d, "frontend_compiler_m_lang").select("lang_name", "semantic_feature", F.when(s == "SEEN", "PRESENT").when(s == "ABSENT", "ABSENT").otherwise("UNRESOLVED").alias("status"))
    return C.combine_evidence(x, ["lang_name", "semantic_feature"])
