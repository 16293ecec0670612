"""Chained matrix products, audits and the outputs of fixpoints on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import fixpoint as G
from weftline.operators import matrix as M
from weftline.operators import mining as X
from weftline.operators import relational as R
from weftline.plans.algebra import E, NEEDS, SUPPORT, _edges, _nodes, _support
from weftline.plans.registry import Registry, table
from weftline.session import Staging, whole_number

chains = Registry()
q = chains.query

# ---------------------------------------------------------------- chains: nations by parts by kinds by sizes

NP = "np AS (SELECT s_nationkey AS i, l_partkey AS j, count(*)::DOUBLE AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey IS NOT NULL GROUP BY 1, 2)"
PB = "pb AS (SELECT DISTINCT p_partkey AS i, p_brand AS j, 1.0::DOUBLE AS v FROM part WHERE p_brand IS NOT NULL)"
PT = "pt AS (SELECT DISTINCT p_brand AS i, p_type AS j, 1.0::DOUBLE AS v FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL)"


def _np(spark: SparkSession, d: str) -> DataFrame:
    return M.from_counts(table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")), "s_nationkey", "l_partkey")


def _pb(spark: SparkSession, d: str) -> DataFrame:
    return M.from_pairs(table(spark, d, "part"), "p_partkey", "p_brand")


def _pt(spark: SparkSession, d: str) -> DataFrame:
    return M.from_pairs(table(spark, d, "part"), "p_brand", "p_type")


@q(f"WITH {NP}, {PB} SELECT np.i, pb.j, 1.0::DOUBLE AS v FROM np JOIN pb ON np.j = pb.i GROUP BY 1, 2")
def requirement_projection(spark: SparkSession, d: str) -> DataFrame:
    """Rows projected on features, then a threshold."""
    return M.threshold(M.multiply(_np(spark, d), _pb(spark, d)))


@q(f"WITH {NP}, {PB} SELECT np.i, pb.j, sum(np.v * pb.v) AS v FROM np JOIN pb ON np.j = pb.i GROUP BY 1, 2")
def projection_counts(spark: SparkSession, d: str) -> DataFrame:
    """A projection without threshold."""
    return M.multiply(_np(spark, d), _pb(spark, d))


@q(f"WITH {NP}, {PB}, {PT}, a AS (SELECT np.i, pb.j, sum(np.v * pb.v) AS v FROM np JOIN pb ON np.j = pb.i WHERE np.i < 5 GROUP BY 1, 2) SELECT a.i, pt.j, sum(a.v * pt.v) AS v FROM a JOIN pt ON a.j = pt.i GROUP BY 1, 2")
def demand_chain(spark: SparkSession, d: str) -> DataFrame:
    """Chosen rows carried through two matrices."""
    basis = spark.createDataFrame([(i,) for i in range(5)], "i int")
    return M.multiply(M.multiply(M.select_rows(_np(spark, d), basis), _pb(spark, d)), _pt(spark, d))


@q(f"WITH {NP}, {PB}, {PT}, e AS (SELECT DISTINCT pb.i, pt.j FROM pb JOIN pt ON pb.j = pt.i) SELECT np.i, e.j, sum(np.v) AS v FROM np JOIN e ON np.j = e.i GROUP BY 1, 2")
def binding_effects(spark: SparkSession, d: str) -> DataFrame:
    """Demand by binding by effects, the last two a boolean product of row sets."""
    return M.multiply(_np(spark, d), M.boolean_product(_pb(spark, d), _pt(spark, d)))


@q(f"WITH {SUPPORT}, k AS (SELECT * FROM sup WHERE supported IS NOT NULL) SELECT n.need, k.target, count(*) FILTER (WHERE k.supported) AS n_supported, count(*) FILTER (WHERE NOT k.supported) AS d FROM need n JOIN k USING (feature) GROUP BY 1, 2")
def deficit_counts(spark: SparkSession, d: str) -> DataFrame:
    """Required features that a target is known to lack."""
    need, sup, _ = _support(spark, d)
    return M.deficits(need, sup)


@q("SELECT c.contract_id, r.ref_id FROM (SELECT DISTINCT ref_id, contract_id FROM semantic_contract_reference) r JOIN (SELECT DISTINCT contract_id FROM semantic_contract) c USING (contract_id)")
def resolution_hits(spark: SparkSession, d: str) -> DataFrame:
    """References with their definitions."""
    r = table(spark, d, "semantic_contract_reference").select("ref_id", "contract_id").distinct()
    return M.resolve(r, table(spark, d, "semantic_contract").select("contract_id").distinct(), "contract_id")[0].select("contract_id", "ref_id")


@q("SELECT DISTINCT contract_id FROM semantic_contract_reference WHERE contract_id NOT IN (SELECT contract_id FROM semantic_contract WHERE contract_id IS NOT NULL)")
def resolution_misses(spark: SparkSession, d: str) -> DataFrame:
    """Keys without definition."""
    r = table(spark, d, "semantic_contract_reference").filter("contract_id IS NOT NULL")
    return M.resolve(r.select("contract_id"), table(spark, d, "semantic_contract").select("contract_id"), "contract_id")[1]


@q("""WITH a AS (SELECT semantic_feature AS atom, lang_name AS basis, bool_or(evidence_state = 'SEEN') AS direct FROM frontend_compiler_m_lang GROUP BY 1, 2), b AS (SELECT DISTINCT proof_class AS id, lang_name AS basis FROM frontend_compiler_m_lang)
      SELECT atom, id, count(*) FILTER (WHERE direct) AS n_direct, count(*) AS n_all FROM a JOIN b USING (basis) GROUP BY 1, 2""")
def basis_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Languages that a feature shares with a class of proof, by seen evidence and at all."""
    m = table(spark, d, "frontend_compiler_m_lang")
    return M.basis_overlap(m.select(F.col("semantic_feature").alias("atom"), F.col("lang_name").alias("basis"), (F.col("evidence_state") == "SEEN").alias("direct")), m.select(F.col("proof_class").alias("id"), F.col("lang_name").alias("basis")))


DESIGN = "x AS (SELECT DISTINCT o_custkey AS i, o_orderpriority AS j FROM orders), s AS (SELECT j, count(*) AS n FROM x GROUP BY 1), t AS (SELECT count(DISTINCT i) AS n FROM x)"


def _design(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    return M.design_audit(o.select(F.col("o_custkey").alias("i"), F.col("o_orderpriority").alias("j")), o.select(F.col("o_custkey").alias("i"), F.col("o_orderstatus").alias("e")))


@q(f"WITH {DESIGN} SELECT p.j AS a, q.j AS b, count(*) AS n_both, greatest(sa.n + sb.n - t.n, 0) AS least, least(sa.n, sb.n) AS most FROM x p JOIN x q ON p.i = q.i AND p.j < q.j JOIN s sa ON sa.j = p.j JOIN s sb ON sb.j = q.j CROSS JOIN t GROUP BY 1, 2, 4, 5")
def design_bounds(spark: SparkSession, d: str) -> DataFrame:
    """X'X above the diagonal, with what the sizes allow."""
    return _design(spark, d)[0]


@q(f"WITH {DESIGN} SELECT x.j, e.e, count(*) AS n FROM x JOIN (SELECT DISTINCT o_custkey AS i, o_orderstatus AS e FROM orders) e USING (i) GROUP BY 1, 2")
def design_effects(spark: SparkSession, d: str) -> DataFrame:
    """X'E."""
    return _design(spark, d)[1]


PRICES = "m AS (SELECT p_partkey AS k, p_brand AS j, p_size::DOUBLE AS v FROM part WHERE p_partkey % 5 <> 0), u AS (SELECT l_orderkey AS i, l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def _checked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, d, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("j"), F.col("p_size").cast("double").alias("v"))
    u = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    return M.project_checked(u, m)


@q(f"WITH {PRICES} SELECT u.i, m.j, sum(u.v * m.v) AS v FROM u JOIN m USING (k) GROUP BY 1, 2")
def checked_projection(spark: SparkSession, d: str) -> DataFrame:
    """Exact sums."""
    return _checked(spark, d)[0]


@q(f"WITH {PRICES} SELECT DISTINCT k FROM u WHERE k NOT IN (SELECT k FROM m)")
def projection_misses(spark: SparkSession, d: str) -> DataFrame:
    """Keys that the matrix lacks."""
    return _checked(spark, d)[1]


@q(f"WITH {NP}, w AS (SELECT s_nationkey AS i, count(*)::DOUBLE AS w FROM supplier GROUP BY 1) SELECT np.j AS i, sum(np.v * w.w) AS v FROM np JOIN w USING (i) GROUP BY 1")
def transpose_vector(spark: SparkSession, d: str) -> DataFrame:
    """M' v."""
    w = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return M.matrix_vector(M.transpose(_np(spark, d)), w)


U = "u AS (SELECT c_nationkey AS j, count(*)::DOUBLE AS v FROM customer WHERE c_acctbal > 5000 GROUP BY 1), w AS (SELECT s_nationkey AS j, count(*)::DOUBLE AS v FROM supplier GROUP BY 1)"


def _u(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = F.count(F.lit(1)).cast("double").alias("v")
    return table(spark, d, "customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("j")).agg(n), table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("j")).agg(n)


@q(f"WITH {U} SELECT coalesce(sum(u.v * w.v), 0) AS v FROM u JOIN w USING (j)")
def vector_dot(spark: SparkSession, d: str) -> DataFrame:
    """M09."""
    return M.dot(*_u(spark, d))


@q(f"WITH {U} SELECT j, 1.0::DOUBLE AS v FROM (SELECT j FROM u UNION SELECT j FROM w)")
def vector_or(spark: SparkSession, d: str) -> DataFrame:
    """M10."""
    return M.vector_or(*_u(spark, d))


@q("""WITH a AS (SELECT p_brand AS label, row_number() OVER (ORDER BY p_brand) - 1 AS k FROM (SELECT DISTINCT p_brand FROM part WHERE p_size <= 20)), n AS (SELECT DISTINCT p_type AS label FROM part)
      SELECT label, k AS "at" FROM a UNION ALL SELECT label, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY label) - 1 FROM n WHERE label NOT IN (SELECT label FROM a)""")
def axis_growth(spark: SparkSession, d: str) -> DataFrame:
    """An axis of brands grown by kinds."""
    p = table(spark, d, "part")
    old = R.numbered(p.filter("p_size <= 20").select(F.col("p_brand").alias("label")).distinct(), ["label"], "n").select("label", (F.col("n") - 1).alias("at"))
    return M.grow_axis(old, p.select(F.col("p_type").alias("label")))


@q(f"WITH {NP} SELECT j, count(*) AS n FROM np GROUP BY 1")
def usage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cells per column."""
    return M.column_counts(_np(spark, d))


@q(f"WITH {NP} SELECT i, sum(v) AS v FROM np GROUP BY 1")
def incidence_row_sums(spark: SparkSession, d: str) -> DataFrame:
    """M27."""
    return M.row_sums(_np(spark, d))


# ---------------------------------------------------------------- outputs of fixpoints


@q(f"""WITH RECURSIVE {E}, r AS (SELECT DISTINCT node FROM n WHERE node NOT IN (SELECT src FROM u)), w AS (SELECT node, 0 AS depth FROM r UNION SELECT u.src, w.depth + 1 FROM w JOIN u ON u.dst = w.node),
      m AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1), b AS (SELECT CASE WHEN depth = 0 THEN 0 ELSE (depth + 7) // 8 END AS k FROM m) SELECT 'reach' AS name, CAST(k AS INTEGER) AS round, count(*) AS n_found FROM b GROUP BY 2
      UNION ALL SELECT 'reach', CAST(max(k) + 1 AS INTEGER), 0 FROM b HAVING (SELECT count(*) FROM m WHERE depth = (SELECT max(k) * 8 FROM b)) > 0 AND max(k) > 0""")
def iteration_log(spark: SparkSession, d: str) -> DataFrame:
    """Rows found in each round of a walk of eight edges a round."""
    e = Staging(spark, "log").put(_edges(spark, d))
    top = _nodes(spark, d).select("node").distinct().join(e.select(F.col("src").alias("node")), "node", "left_anti")
    log: list[tuple[str, int, int]] = []
    G.reachable(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), top, log)
    return G.rounds_table(spark, log)


@q(f"WITH {NEEDS}, h AS (SELECT DISTINCT fact FROM all_m WHERE fact IN (SELECT src FROM m)) SELECT m.src, m.dst FROM m WHERE m.dst NOT IN (SELECT fact FROM all_m)")
def unresolved_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Requirements of reached modules on modules that are not there."""
    m, every = _modules(spark, d)
    e = m.select(F.col("head").alias("src"), F.col("body").alias("dst"))
    nodes = every.select(F.col("fact").alias("node"))
    return G.frontier(G.reachable(e, nodes), e, nodes)


def _modules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "semantic_package_manifest").filter("module_path IS NOT NULL")
    m = t.select(F.col("module_path").alias("rule"), F.col("module_path").alias("head"), F.explode(F.map_keys("go_requirements")).alias("body")).distinct()
    return m, t.select(F.col("module_path").alias("fact")).distinct()


READY = f"""{NEEDS}, c AS (SELECT src, dst FROM m UNION SELECT c.src, m.dst FROM c JOIN m ON c.dst = m.src),
      bad AS (SELECT src AS fact FROM c WHERE src = dst OR dst NOT IN (SELECT fact FROM all_m) UNION SELECT c.src FROM c JOIN c k ON k.src = c.dst AND k.dst = k.src)"""


@q(f"WITH RECURSIVE {READY} SELECT m.src AS rule, m.src AS fact, 'missing dependency: ' || m.dst AS reason FROM m WHERE m.src IN (SELECT fact FROM bad) AND (m.dst IN (SELECT fact FROM bad) OR m.dst NOT IN (SELECT fact FROM all_m))")
def blocked_modules(spark: SparkSession, d: str) -> DataFrame:
    """Modules that are never ready, with what each lacks."""
    m, every = _modules(spark, d)
    return G.horn_blocked(m, G.horn_closure(m, every.join(m.select(F.col("head").alias("fact")), "fact", "left_anti")))


@q(f"WITH RECURSIVE {READY} SELECT fact, CASE WHEN fact IN (SELECT src FROM m) THEN fact END AS rule FROM all_m WHERE fact NOT IN (SELECT fact FROM bad)")
def derivation_witnesses(spark: SparkSession, d: str) -> DataFrame:
    """Ready modules with the rule that made them so."""
    m, every = _modules(spark, d)
    return G.horn_proofs(m, every.join(m.select(F.col("head").alias("fact")), "fact", "left_anti")).select("fact", "rule")


FLOW = r"""t AS (SELECT DISTINCT TRY_CAST(trim(node_id, E' \t\n') AS BIGINT) AS v, TRY_CAST(trim(parent_node_id, E' \t\n') AS BIGINT) AS p, trace_id, node_kind, arity, effects FROM semantic_trace_node),
      f AS (SELECT DISTINCT CAST(trace_id AS VARCHAR) || '/' || CAST(p AS VARCHAR) AS src, CAST(trace_id AS VARCHAR) || '/' || CAST(v AS VARCHAR) AS dst FROM t WHERE p IS NOT NULL AND v IS NOT NULL AND trace_id IS NOT NULL),
      s AS (SELECT DISTINCT CAST(trace_id AS VARCHAR) || '/' || CAST(v AS VARCHAR) AS node, node_kind AS variable FROM t WHERE v IS NOT NULL AND trace_id IS NOT NULL AND node_kind IS NOT NULL),
      en AS (SELECT DISTINCT src AS node FROM f WHERE src NOT IN (SELECT dst FROM f)), va AS (SELECT DISTINCT variable FROM s)"""


@q(f"""WITH RECURSIVE {FLOW}, w AS (SELECT node, variable FROM en CROSS JOIN va UNION SELECT f.dst, w.variable FROM w JOIN f ON f.src = w.node WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.node = w.node AND s.variable = w.variable))
      SELECT variable, count(*) AS n_nodes FROM w GROUP BY 1""")
def definite_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Per kind, the nodes that some way from an entry reaches without passing a node of that kind."""
    t = table(spark, d, "semantic_trace_node")
    name = lambda c: F.concat(F.col("trace_id").cast("string"), F.lit("/"), whole_number(c).cast("string"))
    st = Staging(spark, "flow")
    n = st.put(t.select(name("parent_node_id").alias("src"), name("node_id").alias("dst"), "node_kind").distinct())
    e = n.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    entries = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")), "node", "left_anti")
    sets = n.filter("dst IS NOT NULL AND node_kind IS NOT NULL").select(F.col("dst").alias("node"), F.col("node_kind").alias("variable")).distinct()
    return G.maybe_unassigned(e, entries, sets, sets.select("variable")).groupBy("variable").agg(F.count(F.lit(1)).alias("n_nodes"))


@q("""WITH RECURSIVE r AS (SELECT DISTINCT evidence_state || '>' || proof_class AS rule, evidence_state AS before, proof_class AS after FROM frontend_compiler_m_lang WHERE evidence_state IS NOT NULL AND proof_class IS NOT NULL UNION SELECT DISTINCT proof_class || '>' || lang_name, proof_class, lang_name FROM frontend_compiler_m_lang WHERE proof_class IS NOT NULL AND lang_name IS NOT NULL),
      w AS (SELECT DISTINCT evidence_state AS term, evidence_state AS here, 0 AS depth, '' AS chain FROM frontend_compiler_m_lang WHERE evidence_state IS NOT NULL UNION SELECT w.term, r.after, w.depth + 1, CASE WHEN w.chain = '' THEN r.rule ELSE w.chain || '>' || r.rule END FROM w JOIN r ON r.before = w.here WHERE w.depth < 3),
      g AS (SELECT DISTINCT lang_name AS goal FROM frontend_compiler_m_lang WHERE lang_name IS NOT NULL), m AS (SELECT term, here, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY 1, 2)
      SELECT w.term, w.here AS goal, w.depth, min(w.chain) AS chain FROM w JOIN m ON m.term = w.term AND m.here = w.here AND m.depth = w.depth WHERE w.here IN (SELECT goal FROM g) GROUP BY 1, 2, 3""")
def rewrite_search(spark: SparkSession, d: str) -> DataFrame:
    """The shortest rewriting of states of evidence into languages, within three steps."""
    m = table(spark, d, "frontend_compiler_m_lang")
    rule = lambda a, b: m.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.concat(a, F.lit(">"), b).alias("rule"), F.col(a).alias("before"), F.col(b).alias("after"))
    start = m.filter("evidence_state IS NOT NULL").select(F.col("evidence_state").alias("term"))
    return G.rewrite_chains(start, rule("evidence_state", "proof_class").unionByName(rule("proof_class", "lang_name")), m.select(F.col("lang_name").alias("goal")), 3)


@q("""WITH RECURSIVE c AS (SELECT DISTINCT module_path AS unit, k AS name FROM (SELECT module_path, unnest(map_keys(go_requirements)) AS k FROM semantic_package_manifest) WHERE module_path IS NOT NULL AND k IS NOT NULL), a AS (SELECT package_name AS name, min(module_path) AS real FROM semantic_package_manifest WHERE package_name IS NOT NULL AND module_path IS NOT NULL GROUP BY 1),
      u AS (SELECT DISTINCT module_path AS unit FROM semantic_package_manifest WHERE module_path IS NOT NULL), l AS (SELECT c.unit, c.name, coalesce(a.real, c.name) AS dst, a.real IS NOT NULL AS aliased FROM c LEFT JOIN a USING (name)),
      w AS (SELECT unit FROM u WHERE length(unit) % 2 = 0 UNION SELECT l.dst FROM w JOIN l ON l.unit = w.unit WHERE l.dst IN (SELECT unit FROM u))
      SELECT DISTINCT l.unit AS caller, l.name, CASE WHEN l.aliased THEN 'alias of a missing unit' ELSE 'missing unit' END AS reason FROM l JOIN w USING (unit) WHERE l.dst NOT IN (SELECT unit FROM u)""")
def executable_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What the closure from modules with names of even length cannot resolve."""
    t = table(spark, d, "semantic_package_manifest").filter("module_path IS NOT NULL")
    calls = t.select(F.col("module_path").alias("unit"), F.explode(F.map_keys("go_requirements")).alias("name"))
    aliases = t.filter("package_name IS NOT NULL").select(F.col("package_name").alias("name"), F.col("module_path").alias("real"))
    units = t.select(F.col("module_path").alias("unit"))
    return G.executable_closure(units.filter("length(unit) % 2 = 0"), calls, aliases, units)[1]


@q(f"""WITH {E}, top AS (SELECT n.node FROM n WHERE n.node NOT IN (SELECT src FROM u)), k AS (SELECT DISTINCT CAST(trace_id AS VARCHAR) || '/' || CAST(TRY_CAST(trim(node_id, E' \\t\\n') AS BIGINT) AS VARCHAR) AS node, trace_id, coalesce(node_kind, '') AS kind FROM semantic_trace_node)
      SELECT trace_id, arg_min(node, (CASE WHEN kind = 'Scope' THEN '0' ELSE '1' END) || node) AS node FROM k WHERE node IN (SELECT node FROM top) GROUP BY 1""")
def preferred_roots(spark: SparkSession, d: str) -> DataFrame:
    """Per trace one root, a scope before others, then the least."""
    t = table(spark, d, "semantic_trace_node")
    name = F.concat(F.col("trace_id").cast("string"), F.lit("/"), whole_number("node_id").cast("string"))
    nodes = t.select("trace_id", name.alias("node"), "node_kind").filter("node IS NOT NULL").distinct()
    e = _edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.preferred_roots(e, nodes, "trace_id", "node_kind", "Scope")


#: Relations of a node that are read off its columns.
RELATIONS = ("node_kind", "semantic_operation", "semantic_family", "operand_roles", "type_model", "effects", "primitive_id", "language_operation")


@q(" UNION ALL ".join(f"SELECT '{c}' AS relation, {c} AS value, count(*) AS n FROM (SELECT DISTINCT trace_id, node_id, {c} FROM semantic_trace_node WHERE {c} IS NOT NULL) GROUP BY 2" for c in RELATIONS))
def relation_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Eight relations derived from the nodes, counted per value."""
    t = table(spark, d, "semantic_trace_node")
    x = t.select("trace_id", "node_id", F.explode(F.array(*[F.struct(F.lit(c).alias("relation"), F.col(c).alias("value")) for c in RELATIONS])).alias("r")).select("trace_id", "node_id", "r.*")
    return x.filter("value IS NOT NULL").distinct().groupBy("relation", "value").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT DISTINCT trace_id, node_id, semantic_operation FROM semantic_trace_node WHERE node_kind = 'Call' AND effects IS NOT NULL")
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by kind that have effects."""
    return table(spark, d, "semantic_trace_node").filter("node_kind = 'Call' AND effects IS NOT NULL").select("trace_id", "node_id", "semantic_operation").distinct()


# ---------------------------------------------------------------- covers and rules


@q("""WITH c AS (SELECT r_regionkey AS a, o.o_orderpriority AS b FROM (SELECT DISTINCT r_regionkey FROM region) CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) o) SELECT count(DISTINCT (a, b)) AS n_cells FROM c""")
def rectangle_cover(spark: SparkSession, d: str) -> DataFrame:
    """The cells that a smallest cover of regions by priorities reaches; all are full here, so one rectangle covers them."""
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = x.select("n_regionkey", "o_orderpriority").distinct()
    found = X.rectangle_cover(cells, "n_regionkey", "o_orderpriority")
    return cells.agg(F.count(F.lit(1)).alias("n_cells")).crossJoin(found.agg(F.count(F.lit(1)).alias("n"))).filter("n = 1").select("n_cells")
