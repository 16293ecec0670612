"""Matrices, graphs, mining and capability queries on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import fixpoint as G
from weftline.operators import matrix as M
from weftline.operators import mining as X
from weftline.operators import relational as R
from weftline.plans.registry import Registry, table
from weftline.session import Staging, whole_number

algebra = Registry()
q = algebra.query

# ---------------------------------------------------------------- matrices

A = "a AS (SELECT c_nationkey AS i, o_orderpriority AS j, count(*)::DOUBLE AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
B = "b AS (SELECT o_orderpriority AS i, o_orderstatus AS j, count(*)::DOUBLE AS v FROM orders GROUP BY 1, 2)"


def _a(spark: SparkSession, d: str) -> DataFrame:
    return M.from_counts(table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")), "c_nationkey", "o_orderpriority")


def _b(spark: SparkSession, d: str) -> DataFrame:
    return M.from_counts(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@q(f"WITH {A}, {B} SELECT a.i, b.j, sum(a.v * b.v) AS v FROM a JOIN b ON a.j = b.i GROUP BY 1, 2")
def sparse_multiply(spark: SparkSession, d: str) -> DataFrame:
    return M.multiply(_a(spark, d), _b(spark, d))


@q(f"WITH {A} SELECT j AS i, i AS j, v FROM a")
def sparse_transpose(spark: SparkSession, d: str) -> DataFrame:
    return M.transpose(_a(spark, d))


@q(f"WITH {A}, s AS (SELECT c_nationkey AS i, o_orderpriority AS j, count(*)::DOUBLE AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY 1, 2) SELECT i, j, a.v * s.v AS v FROM a JOIN s USING (i, j)")
def sparse_hadamard(spark: SparkSession, d: str) -> DataFrame:
    s = M.from_counts(table(spark, d, "orders").filter("o_orderstatus = 'P'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")), "c_nationkey", "o_orderpriority")
    return M.hadamard(_a(spark, d), s)


@q(f"WITH {A} SELECT i, j, 1.0::DOUBLE AS v FROM a WHERE v <> 0")
def sparse_threshold(spark: SparkSession, d: str) -> DataFrame:
    return M.threshold(_a(spark, d))


@q("WITH p AS (SELECT DISTINCT l_suppkey AS i, p_brand AS j FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT x.i, y.i AS j, count(*)::DOUBLE AS v FROM p x JOIN p y ON x.j = y.j GROUP BY 1, 2")
def incidence_gram(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return M.gram(M.from_pairs(x, "l_suppkey", "p_brand"))


@q(f"WITH {A}, w AS (SELECT o_orderpriority AS j, count(DISTINCT o_custkey)::DOUBLE AS w FROM orders GROUP BY 1) SELECT i, sum(v * w) AS v FROM a JOIN w USING (j) GROUP BY 1")
def matrix_vector(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("j")).agg(F.countDistinct("o_custkey").cast("double").alias("v"))
    return M.matrix_vector(_a(spark, d), w)


@q(f"WITH {A} SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 9) AS v FROM a")
def l1_normalise(spark: SparkSession, d: str) -> DataFrame:
    return M.l1_normalize(_a(spark, d)).withColumn("v", F.round("v", 9))


@q(f"WITH {A}, m AS (SELECT i, j, CASE WHEN i % 3 = 0 THEN v ELSE v / sum(v) OVER (PARTITION BY i) END AS v FROM a) SELECT i, abs(sum(v) - 1) < 1e-9 AS is_stochastic FROM m GROUP BY 1")
def row_stochastic(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the rows add up to one, the others hold counts."""
    a = _a(spark, d)
    return M.row_stochastic(M.l1_normalize(a.filter("i % 3 <> 0")).unionByName(a.filter("i % 3 = 0")))


@q("SELECT p_partkey AS i, j, v FROM (SELECT p_partkey, 'p_size' AS j, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part) WHERE v <> 0")
def unpivot_coo(spark: SparkSession, d: str) -> DataFrame:
    return M.unpivot_coo(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"])


@q(f"WITH {A} SELECT count(*) AS nnz, sum(v) AS total FROM a")
def nnz_and_sum(spark: SparkSession, d: str) -> DataFrame:
    return M.nnz_and_sum(_a(spark, d))


@q("SELECT unnest(['node_id', 'arity', 'node_kind']) AS column_name, unnest([bool_and(TRY_CAST(trim(node_id, E' \\t\\n') AS DOUBLE) IS NOT NULL), bool_and(arity IS NOT NULL), bool_and(TRY_CAST(node_kind AS DOUBLE) IS NOT NULL)]) AS is_numeric FROM semantic_trace_node")
def numeric_columns(spark: SparkSession, d: str) -> DataFrame:
    return M.numeric_columns(table(spark, d, "semantic_trace_node"), ["node_id", "arity", "node_kind"])


@q("SELECT l_orderkey AS i, l_linenumber AS j, count(DISTINCT l_returnflag) AS n_status FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) <> 1")
def one_hot_faults(spark: SparkSession, d: str) -> DataFrame:
    return M.one_hot_faults(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("j"), F.col("l_returnflag").alias("status")))


@q(f"WITH {B}, m AS (SELECT i, max(v) AS m FROM b GROUP BY 1) SELECT b.i, min(b.j) AS label FROM b JOIN m ON b.i = m.i AND b.v = m.m GROUP BY 1")
def argmax_class(spark: SparkSession, d: str) -> DataFrame:
    return M.argmax_class(_b(spark, d), "NONE")


@q("SELECT o_orderpriority AS previous, lead_p AS next, count(*) AS n FROM (SELECT o_orderpriority, lead(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS lead_p FROM orders) WHERE lead_p IS NOT NULL AND lead_p <> o_orderpriority GROUP BY 1, 2")
def walk_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.lag_changes(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority").groupBy("previous", "next").agg(F.count(F.lit(1)).alias("n"))


@q("""WITH a AS (SELECT c_nationkey AS i, s_nationkey AS j, count(*) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey IS NOT NULL AND s_nationkey IS NOT NULL GROUP BY 1, 2)
      SELECT x.i, y.j, CAST(sum(x.v * y.v) AS BIGINT) AS v FROM a x JOIN a y ON x.j = y.i GROUP BY 1, 2""")
def two_hop_walk_counts(spark: SparkSession, d: str) -> DataFrame:
    """Walks of two purchases between nations of customers and suppliers, diagonal included."""
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = x.filter("c_nationkey IS NOT NULL AND s_nationkey IS NOT NULL").groupBy(F.col("c_nationkey").alias("i"), F.col("s_nationkey").alias("j")).agg(F.count(F.lit(1)).alias("v"))
    a = Staging(spark, "walks").put(edges)
    return M.multiply(a, a)


SUPPORT = """need AS (SELECT DISTINCT proof_class AS need, semantic_feature AS feature FROM frontend_compiler_m_lang WHERE proof_class IS NOT NULL AND semantic_feature IS NOT NULL),
      sup AS (SELECT lang_name AS target, semantic_feature AS feature, CASE WHEN bool_or(evidence_state = 'SEEN') THEN true WHEN bool_or(evidence_state = 'ABSENT') THEN false END AS supported FROM frontend_compiler_m_lang WHERE lang_name IS NOT NULL GROUP BY 1, 2),
      t AS (SELECT DISTINCT target FROM sup), g AS (SELECT need, target, feature, supported FROM need CROSS JOIN t LEFT JOIN sup USING (target, feature))"""


def _support(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = table(spark, d, "frontend_compiler_m_lang")
    need = m.filter("proof_class IS NOT NULL AND semantic_feature IS NOT NULL").select(F.col("proof_class").alias("need"), F.col("semantic_feature").alias("feature")).distinct()
    yes, no = F.bool_or(F.col("evidence_state") == "SEEN"), F.bool_or(F.col("evidence_state") == "ABSENT")
    sup = m.filter("lang_name IS NOT NULL").groupBy(F.col("lang_name").alias("target"), F.col("semantic_feature").alias("feature")).agg(F.when(yes, True).when(no, False).alias("supported"))
    return need, sup, sup.select("target").distinct()


@q(f"WITH {SUPPORT} SELECT need, target, count(*) FILTER (WHERE supported) AS n_supported, count(*) FILTER (WHERE NOT supported) AS n_missing, count(*) FILTER (WHERE supported IS NULL) AS n_unknown FROM g GROUP BY 1, 2")
def target_plan(spark: SparkSession, d: str) -> DataFrame:
    return M.plan_targets(*_support(spark, d))


@q(f"""WITH {SUPPORT}, wanted AS (SELECT 'as ' || target AS need, feature FROM sup WHERE supported AND feature IS NOT NULL AND ascii(feature) % 4 = 0)
      SELECT need, t.target FROM wanted CROSS JOIN t LEFT JOIN sup s ON s.target = t.target AND s.feature = wanted.feature GROUP BY 1, 2 HAVING count(*) = count(*) FILTER (WHERE s.supported)""")
def route_search(spark: SparkSession, d: str) -> DataFrame:
    """Targets that support all that another one supports, of the features whose first letter's code divides by four."""
    _, sup, targets = _support(spark, d)
    need = sup.filter("supported AND feature IS NOT NULL").filter(F.ascii("feature") % 4 == 0).select(F.concat(F.lit("as "), "target").alias("need"), "feature")
    return M.eligible(M.plan_targets(need, sup, targets))


@q(f"""WITH {SUPPORT}, o AS (SELECT need, target, coalesce(string_agg(DISTINCT feature, ';' ORDER BY feature) FILTER (WHERE NOT supported), '') AS missing, coalesce(string_agg(DISTINCT feature, ';' ORDER BY feature) FILTER (WHERE supported IS NULL), '') AS unknown FROM g GROUP BY 1, 2)
      SELECT * FROM o WHERE missing <> '' OR unknown <> ''""")
def demand_gate(spark: SparkSession, d: str) -> DataFrame:
    return M.demand_gate(*_support(spark, d))


# ---------------------------------------------------------------- graphs: the parent links of the traces

E = r"""n AS (SELECT DISTINCT CAST(trace_id AS VARCHAR) || '/' || CAST(TRY_CAST(trim(node_id, E' \t\n') AS BIGINT) AS VARCHAR) AS node, CAST(trace_id AS VARCHAR) || '/' || CAST(TRY_CAST(trim(parent_node_id, E' \t\n') AS BIGINT) AS VARCHAR) AS parent, type_model FROM semantic_trace_node),
      e AS (SELECT DISTINCT node AS src, parent AS dst FROM n WHERE parent IS NOT NULL), u AS (SELECT DISTINCT e.src, e.dst FROM e JOIN n ON n.node = e.dst)"""
CLOSURE = "c AS (SELECT src, dst FROM u UNION SELECT c.src, u.dst FROM c JOIN u ON c.dst = u.src)"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "semantic_trace_node")
    name = lambda c: F.concat(F.col("trace_id").cast("string"), F.lit("/"), whole_number(c).cast("string"))
    return t.select(name("node_id").alias("node"), name("parent_node_id").alias("parent"), "type_model").distinct()


def _edges(spark: SparkSession, d: str, known: bool = True) -> DataFrame:
    """(src, dst) from node to parent; ``known`` keeps the parents that are nodes."""
    n = _nodes(spark, d)
    e = n.filter("parent IS NOT NULL").select(F.col("node").alias("src"), F.col("parent").alias("dst")).distinct()
    return e.join(n.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst") if known else e


@q(f"WITH RECURSIVE {E}, {CLOSURE} SELECT src, dst FROM c")
def transitive_closure(spark: SparkSession, d: str) -> DataFrame:
    return G.transitive_closure(_edges(spark, d))


@q(f"WITH RECURSIVE {E}, {CLOSURE} SELECT src AS node FROM c WHERE src = dst")
def graph_cycles(spark: SparkSession, d: str) -> DataFrame:
    return G.cycles(G.transitive_closure(_edges(spark, d)))


@q(f"WITH RECURSIVE {E}, {CLOSURE} SELECT src AS node, count(*) AS n_reached FROM c GROUP BY 1")
def reach_count_order(spark: SparkSession, d: str) -> DataFrame:
    return G.reach_counts(G.transitive_closure(_edges(spark, d)))


@q(f"""WITH RECURSIVE {E}, r AS (SELECT DISTINCT node FROM n WHERE node NOT IN (SELECT src FROM u)), w AS (SELECT node, 0 AS depth FROM r UNION SELECT u.src, w.depth + 1 FROM w JOIN u ON u.dst = w.node)
      SELECT node, min(depth) AS depth FROM w GROUP BY 1""")
def reach_roots(spark: SparkSession, d: str) -> DataFrame:
    e = Staging(spark, "reach").put(_edges(spark, d))
    top = _nodes(spark, d).select("node").distinct().join(e.select(F.col("src").alias("node")), "node", "left_anti")
    return G.reachable(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), top)


@q(f"WITH {E} SELECT DISTINCT dst AS node FROM u WHERE dst NOT IN (SELECT src FROM u)")
def graph_roots(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return G.roots(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@q(f"WITH {E} SELECT src, dst FROM e WHERE dst NOT IN (SELECT node FROM n)")
def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.dangling(_edges(spark, d, known=False), _nodes(spark, d).select("node"))


@q(f"WITH RECURSIVE {E}, k AS (SELECT DISTINCT node FROM n WHERE type_model = 'opaque' UNION SELECT u.dst FROM k JOIN u ON u.src = k.node) SELECT node FROM k")
def unknown_propagation(spark: SparkSession, d: str) -> DataFrame:
    """A node is unknown if its type is opaque or a node below it is unknown."""
    e = Staging(spark, "unknown").put(_edges(spark, d))
    return G.propagate(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), _nodes(spark, d).filter("type_model = 'opaque'"))


NEEDS = """m AS (SELECT DISTINCT module_path AS src, unnest(map_keys(go_requirements)) AS dst FROM semantic_package_manifest WHERE go_requirements IS NOT NULL AND module_path IS NOT NULL),
      all_m AS (SELECT DISTINCT module_path AS fact FROM semantic_package_manifest WHERE module_path IS NOT NULL)"""


@q(f"""WITH RECURSIVE {NEEDS}, c AS (SELECT src, dst FROM m UNION SELECT c.src, m.dst FROM c JOIN m ON c.dst = m.src),
      bad AS (SELECT src AS fact FROM c WHERE src = dst OR dst NOT IN (SELECT fact FROM all_m) UNION SELECT c.src FROM c JOIN c k ON k.src = c.dst AND k.dst = k.src),
      h AS (SELECT fact, 0 AS rank FROM all_m WHERE fact NOT IN (SELECT src FROM m) UNION SELECT m.src, h.rank + 1 FROM h JOIN m ON m.dst = h.fact WHERE m.src NOT IN (SELECT fact FROM bad))
      SELECT fact, max(rank) AS rank FROM h GROUP BY 1""")
def horn_closure(spark: SparkSession, d: str) -> DataFrame:
    """A module is ready once all modules it requires are; modules without requirements are facts."""
    t = table(spark, d, "semantic_package_manifest").filter("module_path IS NOT NULL")
    m = t.select(F.col("module_path").alias("rule"), F.col("module_path").alias("head"), F.explode(F.map_keys("go_requirements")).alias("body")).distinct()
    every = t.select(F.col("module_path").alias("fact")).distinct()
    return G.horn_closure(m, every.join(m.select(F.col("head").alias("fact")), "fact", "left_anti"))


@q()
def partition_refinement(spark: SparkSession, d: str) -> DataFrame:
    """Trace nodes that look the same below: same kind, same ordered children."""
    t = table(spark, d, "semantic_trace_node")
    name = lambda c: F.concat(F.col("trace_id").cast("string"), F.lit("/"), whole_number(c).cast("string"))
    st = Staging(spark, "refine-in")
    n = st.put(t.groupBy(name("node_id").alias("node")).agg(F.max("node_kind").alias("kind")))
    e = t.select(name("parent_node_id").alias("src"), whole_number("node_id").alias("ordinal"), name("node_id").alias("dst")).filter("src IS NOT NULL").distinct()
    return G.refine(n, st.put(e), "kind")


@q("""SELECT r_regionkey AS id, r_name AS label FROM region UNION ALL SELECT n_nationkey + (SELECT max(r_regionkey) + 1 FROM region), n_name FROM nation""")
def union_renumber(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label"))
    b = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    none = spark.createDataFrame([], "src int, dst int")
    return R.merge_graphs([(a, none), (b, none)])[0]


# ---------------------------------------------------------------- mining

FACTS = """o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, c_mktsegment AS m FROM orders JOIN customer ON o_custkey = c_custkey),
      f AS (SELECT k AS case_id, 'status:' || s AS fact FROM o UNION SELECT k, 'priority:' || p FROM o UNION SELECT k, 'segment:' || m FROM o)"""
R1 = """s AS (SELECT fact, count(*) AS support FROM f GROUP BY 1 HAVING count(*) >= 2),
      r1 AS (SELECT a.fact AS antecedent, b.fact AS consequent, s.support, count(*) AS joint, CAST(count(*) * 100 // s.support AS BIGINT) AS confidence_percent, s.support - count(*) AS counterexamples FROM f a JOIN f b ON a.case_id = b.case_id AND a.fact <> b.fact JOIN s ON s.fact = a.fact GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return X.facts_long(x, "o_orderkey", {"status": "o_orderstatus", "priority": "o_orderpriority", "segment": "c_mktsegment"})


@q(f"WITH {FACTS} SELECT case_id, fact FROM f")
def facts_long(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d)


@q(f"WITH {FACTS}, {R1} SELECT * FROM r1")
def rules_one(spark: SparkSession, d: str) -> DataFrame:
    return X.rules_one(_facts(spark, d))


@q(f"""WITH {FACTS}, s AS (SELECT x.fact AS x, y.fact AS y, count(*) AS support FROM f x JOIN f y ON x.case_id = y.case_id AND x.fact < y.fact GROUP BY 1, 2 HAVING count(*) >= 4)
      SELECT x.fact AS x, y.fact AS y, z.fact AS z, s.support, count(*) AS joint, CAST(count(*) * 100 // s.support AS BIGINT) AS confidence_percent FROM f x JOIN f y ON x.case_id = y.case_id AND x.fact < y.fact JOIN f z ON z.case_id = x.case_id AND z.fact <> x.fact AND z.fact <> y.fact JOIN s ON s.x = x.fact AND s.y = y.fact GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2""")
def rules_two(spark: SparkSession, d: str) -> DataFrame:
    return X.rules_two(_facts(spark, d))


TRACE_FACTS = "f AS (SELECT trace_id AS case_id, 'kind:' || node_kind AS fact FROM semantic_trace_node UNION SELECT trace_id, 'op:' || semantic_operation FROM semantic_trace_node UNION SELECT trace_id, 'lang:' || language_operation FROM semantic_trace_node), g AS (SELECT * FROM f WHERE fact IS NOT NULL)"


def _trace_facts(spark: SparkSession, d: str) -> DataFrame:
    return X.facts_long(table(spark, d, "semantic_trace_node"), "trace_id", {"kind": "node_kind", "op": "semantic_operation", "lang": "language_operation"})


@q(f"""WITH {TRACE_FACTS}, {R1.replace('FROM f', 'FROM g').replace('JOIN f', 'JOIN g')} SELECT antecedent, consequent, support, joint, confidence_percent, counterexamples FROM (SELECT *, row_number() OVER (PARTITION BY consequent ORDER BY support DESC, antecedent) AS rn FROM r1 WHERE counterexamples = 0) WHERE rn = 1""")
def rule_basis(spark: SparkSession, d: str) -> DataFrame:
    return X.rule_basis(X.rules_one(_trace_facts(spark, d)))


DOC_FACTS = "f AS (SELECT doc_id AS case_id, 'kind:' || trim(doc_kind) AS fact FROM documents UNION SELECT doc_id, 'lang:' || trim(lang) FROM documents UNION SELECT doc_id, 'source:' || trim(source) FROM documents), g AS (SELECT * FROM f WHERE fact IS NOT NULL)"


@q(f"""WITH {DOC_FACTS}, s AS (SELECT fact, count(*) AS support, split_part(fact, ':', 1) AS prefix FROM g GROUP BY 1 HAVING count(*) >= 3)
      SELECT a.fact AS a, b.fact AS b, a.support AS support_a, b.support AS support_b FROM s a JOIN s b ON a.prefix = b.prefix AND a.fact < b.fact WHERE NOT EXISTS (SELECT 1 FROM g x JOIN g y ON x.case_id = y.case_id WHERE x.fact = a.fact AND y.fact = b.fact)""")
def negative_rules(spark: SparkSession, d: str) -> DataFrame:
    return X.negative_rules(X.facts_long(table(spark, d, "documents"), "doc_id", {"kind": "doc_kind", "lang": "lang", "source": "source"}))


@q(f"""WITH {TRACE_FACTS}, {R1.replace('FROM f', 'FROM g').replace('JOIN f', 'JOIN g')}, b AS (SELECT antecedent, consequent FROM r1 WHERE confidence_percent >= 90 AND counterexamples > 0)
      SELECT b.antecedent, b.consequent, x.case_id FROM b JOIN g x ON x.fact = b.antecedent WHERE NOT EXISTS (SELECT 1 FROM g y WHERE y.case_id = x.case_id AND y.fact = b.consequent)""")
def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    f = Staging(spark, "facts").put(_trace_facts(spark, d))
    return X.rule_violations(X.rules_one(f).filter("confidence_percent >= 90 AND counterexamples > 0"), f)


@q("""WITH p AS (SELECT DISTINCT p_brand AS o, p_size AS a FROM part), n AS (SELECT a, count(*) AS extent_size FROM p GROUP BY 1),
      c AS (SELECT x.a, y.a AS b, n.extent_size FROM p x JOIN p y ON x.o = y.o JOIN n ON n.a = x.a GROUP BY 1, 2, 3 HAVING count(*) = n.extent_size)
      SELECT a, extent_size, string_agg(CAST(b AS VARCHAR), ';' ORDER BY CAST(b AS VARCHAR)) AS intent FROM c GROUP BY 1, 2""")
def concept_closure(spark: SparkSession, d: str) -> DataFrame:
    return X.concept_closure(table(spark, d, "part"), "p_brand", "p_size")


@q("""WITH p AS (SELECT DISTINCT lang_id AS o, package_name AS a FROM semantic_package_file WHERE package_name IS NOT NULL AND lang_id IS NOT NULL), n AS (SELECT a, count(*) AS extent_size FROM p GROUP BY 1),
      c AS (SELECT x.a, y.a AS b, n.extent_size FROM p x JOIN p y ON x.o = y.o JOIN n ON n.a = x.a GROUP BY 1, 2, 3 HAVING count(*) = n.extent_size)
      SELECT a, extent_size, string_agg(b, ';' ORDER BY b) AS intent FROM c GROUP BY 1, 2""")
def concept_closure_packages(spark: SparkSession, d: str) -> DataFrame:
    """Per package, the packages found in all of its languages, over the whole table."""
    return X.concept_closure(table(spark, d, "semantic_package_file").filter("package_name IS NOT NULL AND lang_id IS NOT NULL"), "lang_id", "package_name")


@q()
def greedy_cover(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers chosen greedily until every part is covered."""
    return X.greedy_cover(table(spark, d, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")
