"""Predicates, labels, families and runtime functions on the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import formulas
from weftline.functions import ints as I
from weftline.functions import text as X
from weftline.functions import vector as V
from weftline.operators import mining
from weftline.operators import relational as R
from weftline.plans.registry import Registry, table
from weftline.session import Staging
from weftline.sources import registries
from weftline.sources.files import row_range, write_sorted_csv

evidence = Registry()
q = evidence.query

# ---------------------------------------------------------------- predicates and labels

#: Words of a diagnostic and the label each gives, in catalogue order.
LABELS = {"order": "ORDER", "run": "RUN", "guard": "GUARD", "stage": "STAGE", "not": "DENIAL", "second": "REPEAT"}
_CASES = ", ".join(f"CASE WHEN contains(lower(mapping_guidance), '{w}') THEN '{k}' END" for w, k in LABELS.items())


@q(f"SELECT row_id, array_to_string(list_filter([{_CASES}], lambda x: x IS NOT NULL), ';') AS labels, count(*) AS n FROM frontend_compiler_evidence GROUP BY 1, 2")
def diagnostic_labels(spark: SparkSession, d: str) -> DataFrame:
    """P10: all labels of a text, in catalogue order."""
    e = table(spark, d, "frontend_compiler_evidence")
    return e.select("row_id", F.array_join(X.labels_of(F.col("mapping_guidance"), LABELS), ";").alias("labels")).groupBy("row_id", "labels").agg(F.count(F.lit(1)).alias("n"))


#: Marks of a text and what they say about construct, contract and what is missing; the first that fits counts.
DISPATCH = [("look", ("MODULE", "LINK", "RESOLVER")), ("const", ("TYPE", "CHECK", "MODEL")), ("inv", ("CALL", "ABI", "BINDING"))]


@q("""SELECT trace_id, node_id, c.a AS construct, c.b AS contract, c.c AS missing, count(*) AS n FROM (SELECT *, CASE WHEN contains(lower(semantic_operation), 'look') THEN {'a': 'MODULE', 'b': 'LINK', 'c': 'RESOLVER'} WHEN contains(lower(semantic_operation), 'const') THEN {'a': 'TYPE', 'b': 'CHECK', 'c': 'MODEL'}
      WHEN contains(lower(semantic_operation), 'inv') THEN {'a': 'CALL', 'b': 'ABI', 'c': 'BINDING'} ELSE {'a': 'UNKNOWN', 'b': 'UNKNOWN', 'c': 'UNKNOWN'} END AS c FROM semantic_trace_node) GROUP BY ALL""")
def diagnostic_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Three columns from the first rule that fits."""
    t = table(spark, d, "semantic_trace_node")
    x = t.select("trace_id", "node_id", X.dispatch(F.col("semantic_operation"), DISPATCH, ("construct", "contract", "missing")).alias("c")).select("trace_id", "node_id", "c.*")
    return x.groupBy("trace_id", "node_id", "construct", "contract", "missing").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT doc_id, coalesce(lower(trim(lang)) IN ('1', 'true', 'pass'), false) OR (starts_with(coalesce(source, ''), 'i') AND n_chars > 100 AND package_name IS NOT NULL) AS trusted FROM documents")
def trust_filter(spark: SparkSession, d: str) -> DataFrame:
    """A flag's spellings, a prefix and a conjunction."""
    x = table(spark, d, "documents")
    all_three = F.coalesce(F.col("source"), F.lit("")).startswith("i") & (F.col("n_chars") > 100) & F.col("package_name").isNotNull()
    return x.select("doc_id", (X.truthy_text(F.col("lang")) | F.coalesce(all_three, F.lit(False))).alias("trusted"))


@q("SELECT lang_name, count(*) FILTER (WHERE evidence_state IN ('SEEN', 'ABSENT')) AS n_known, count(*) FILTER (WHERE evidence_state = 'SEEN') AS n_true, count(*) FILTER (WHERE evidence_state IS NULL OR evidence_state NOT IN ('SEEN', 'ABSENT')) AS n_unknown FROM frontend_compiler_m_lang GROUP BY 1")
def column_validity(spark: SparkSession, d: str) -> DataFrame:
    """Known and value, derived from a status."""
    known, value = X.validity(F.col("evidence_state"), "SEEN", "ABSENT")
    m = table(spark, d, "frontend_compiler_m_lang").select("lang_name", known.alias("k"), value.alias("v"))
    return m.groupBy("lang_name").agg(F.count_if(F.col("k")).alias("n_known"), F.count_if(F.col("v")).alias("n_true"), F.count_if(~F.col("k")).alias("n_unknown"))


# ---------------------------------------------------------------- quotients and families

_SIG = "upper(trim(coalesce(compiler_name, ''))) || '|' || upper(trim(coalesce(stage_name, ''))) || '|' || upper(trim(coalesce(evidence_class, '')))"


@q(f"SELECT substr(sha256({_SIG}), 1, 16) AS signature, min(row_id) AS first_row, count(*) AS n FROM frontend_compiler_evidence GROUP BY {_SIG}")
def failure_quotient(spark: SparkSession, d: str) -> DataFrame:
    """Classes of equal failure signatures."""
    s = X.failure_signature(F.col("compiler_name"), F.col("stage_name"), F.col("evidence_class"))
    return table(spark, d, "frontend_compiler_evidence").withColumn("s", s).groupBy("s").agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n")).select(X.short_hash(F.col("s")).alias("signature"), "first_row", "n")


@q("SELECT family, n, row_number() OVER (ORDER BY n DESC, family) AS place FROM (SELECT coalesce(nullif(trim(phase_class), ''), 'unclassified') AS family, count(*) AS n FROM frontend_compiler_evidence GROUP BY 1)")
def family_partition(spark: SparkSession, d: str) -> DataFrame:
    """Families with a fallback key, most common first."""
    f = table(spark, d, "frontend_compiler_evidence").groupBy(F.coalesce(F.nullif(F.trim("phase_class"), F.lit("")), F.lit("unclassified")).alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return R.numbered(f.withColumn("m", -F.col("n")), ["m", "family"], "place").select("family", "n", F.col("place").cast("bigint").alias("place"))


@q("SELECT stage_name, count(*) AS n_rows, count(DISTINCT evidence_class) AS n_families, count(DISTINCT source_area) AS n_areas FROM frontend_compiler_evidence GROUP BY 1")
def stage_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Instances and different families per stage."""
    return table(spark, d, "frontend_compiler_evidence").groupBy("stage_name").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("evidence_class").alias("n_families"), F.countDistinct("source_area").alias("n_areas"))


TRIPLE = "e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 45)"


def _trade(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").filter("l_quantity > 45").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


@q(f"WITH {TRIPLE} SELECT a.src, a.dst AS mid, b.dst, NOT EXISTS (SELECT 1 FROM e WHERE e.src = a.src AND e.dst = b.dst) AS only_by_mid FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> a.dst AND b.src <> b.dst AND a.src <> b.dst")
def feasible_triples(spark: SparkSession, d: str) -> DataFrame:
    """Routes over an intermediate, told from direct ones; two joins on edges, no grid of triples."""
    return R.feasible_triples(_trade(spark, d))


@q(f"WITH {TRIPLE} SELECT a.src, b.dst, min(a.dst) AS mid FROM e a JOIN e b ON a.dst = b.src WHERE a.dst <> a.src AND a.dst <> b.dst GROUP BY 1, 2")
def intermediate_routes(spark: SparkSession, d: str) -> DataFrame:
    """The least intermediate of each pair that has one."""
    e = _trade(spark, d)
    pairs = R.two_hop(e, "src", "dst").select("src", "dst").unionByName(e.select(F.col("src"), F.col("src").alias("dst")))
    return R.intermediate_routes(e, pairs)


@q("SELECT DISTINCT contract_id FROM semantic_contract WHERE contains(payload, '\"slots\": 4') AND contract_id IN (SELECT contract_id FROM semantic_contract_reference)")
def reverse_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Referenced contracts whose payload holds a text."""
    refs = table(spark, d, "semantic_contract_reference").select("contract_id")
    return R.reverse_lookup(table(spark, d, "semantic_contract"), "payload", '"slots": 4', refs, "contract_id").select("contract_id").distinct()


@q("SELECT DISTINCT r.ref_id FROM semantic_contract_reference r WHERE r.contract_id IN (SELECT contract_id FROM semantic_contract) AND r.trace_id IN (SELECT trace_id FROM semantic_trace_node)")
def crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """References whose both ends exist."""
    r = table(spark, d, "semantic_contract_reference")
    both = r.join(table(spark, d, "semantic_contract").select("contract_id"), "contract_id", "left_semi").join(table(spark, d, "semantic_trace_node").select("trace_id"), "trace_id", "left_semi")
    return both.select("ref_id").distinct()


@q("SELECT m.row_id, e.evidence_class, count(*) AS n_routes FROM (SELECT DISTINCT row_id, lang_name FROM frontend_compiler_m_lang) m LEFT JOIN (SELECT DISTINCT lang_name, evidence_class FROM frontend_compiler_evidence) e USING (lang_name) GROUP BY 1, 2")
def registry_routes(spark: SparkSession, d: str) -> DataFrame:
    """Left joins along a registry, with the routes counted."""
    m = table(spark, d, "frontend_compiler_m_lang").select("row_id", "lang_name").distinct()
    e = table(spark, d, "frontend_compiler_evidence").select("lang_name", "evidence_class").distinct()
    return m.join(e, "lang_name", "left").groupBy("row_id", "evidence_class").agg(F.count(F.lit(1)).alias("n_routes"))


@q("SELECT lang AS id FROM (SELECT lang_name AS lang FROM frontend_compiler_m_lang UNION SELECT lang_name FROM frontend_compiler_evidence UNION SELECT unnest(['Zig', 'Go'])) WHERE lang IS NOT NULL")
def union_authorities(spark: SparkSession, d: str) -> DataFrame:
    """Ids of two tables and constants, each once."""
    parts = [table(spark, d, t).select(F.col("lang_name").alias("id")) for t in ("frontend_compiler_m_lang", "frontend_compiler_evidence")]
    return parts[0].unionByName(parts[1]).unionByName(spark.createDataFrame([("Zig",), ("Go",)], "id string")).filter("id IS NOT NULL").distinct()


@q("SELECT lang_name, semantic_feature, evidence_state, min(row_id) AS row_id FROM frontend_compiler_m_lang GROUP BY 1, 2, 3")
def distinct_signatures(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each signature."""
    m = table(spark, d, "frontend_compiler_m_lang").select("lang_name", "semantic_feature", "evidence_state", "row_id")
    return R.first_per_group(m, ["lang_name", "semantic_feature", "evidence_state"], ["row_id"])


@q("SELECT id, arg_min(label, src || coalesce(label, '')) AS label FROM (SELECT file_id AS id, package_name AS label, 'a' AS src FROM semantic_package_file UNION ALL SELECT manifest_id, package_name, 'b' FROM semantic_package_manifest) WHERE id IS NOT NULL AND label IS NOT NULL GROUP BY 1")
def node_union(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of two graphs, the first of each id."""
    part = lambda t, k, s: table(spark, d, t).select(F.col(k).alias("id"), F.col("package_name").alias("label"), F.lit(s).alias("src")).filter("id IS NOT NULL AND label IS NOT NULL")
    return R.first_per_group(part("semantic_package_file", "file_id", "a").unionByName(part("semantic_package_manifest", "manifest_id", "b")), ["id"], ["src", "label"]).select("id", "label")


@q("SELECT trace_id, parent, string_agg(node, ',' ORDER BY arity, operation, node) AS children FROM (SELECT DISTINCT trace_id, trim(parent_node_id) AS parent, coalesce(arity, -1) AS arity, coalesce(semantic_operation, '') AS operation, trim(node_id) AS node FROM semantic_trace_node WHERE node_id IS NOT NULL AND trim(parent_node_id) <> '') GROUP BY 1, 2")
def ordered_children(spark: SparkSession, d: str) -> DataFrame:
    """Children by ordinal, role and id."""
    t = table(spark, d, "semantic_trace_node").filter("node_id IS NOT NULL AND trim(parent_node_id) <> ''")
    x = t.select("trace_id", F.trim("parent_node_id").alias("parent"), F.coalesce("arity", F.lit(-1)).alias("arity"), F.coalesce("semantic_operation", F.lit("")).alias("operation"), F.trim("node_id").alias("node")).distinct()
    return R.ordered_children(x, ["trace_id", "parent"], ["arity", "operation", "node"], "node").withColumnRenamed("joined", "children")


@q("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r > 100 AND r <= 150")
def range_shard(spark: SparkSession, d: str) -> DataFrame:
    """Rows 101 to 150 in a total order."""
    return row_range(table(spark, d, "orders"), ["o_totalprice", "o_orderkey"], 100, 50).select("o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- mined rules


TRIPLES = "f AS (SELECT DISTINCT lang_name AS case_id, 'feature:' || semantic_feature AS fact FROM frontend_compiler_m_lang WHERE lang_name IS NOT NULL AND trim(semantic_feature) <> '' UNION SELECT DISTINCT lang_name, 'proof:' || proof_class FROM frontend_compiler_m_lang WHERE lang_name IS NOT NULL AND trim(proof_class) <> '')"


@q(f"""WITH {TRIPLES}, s AS (SELECT fact, count(*) AS support FROM f GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT a.fact AS antecedent, b.fact AS consequent, s.support, count(*) AS joint, CAST(count(*) * 100 // s.support AS BIGINT) AS confidence_percent FROM f a JOIN f b ON a.case_id = b.case_id AND a.fact <> b.fact JOIN s ON s.fact = a.fact GROUP BY 1, 2, 3 HAVING count(*) >= 2)
      SELECT CASE WHEN confidence_percent = 100 AND support >= 3 AND joint >= 2 THEN 'UNIVERSAL' WHEN confidence_percent >= 90 AND support >= 3 THEN 'STRONG' ELSE 'OBSERVED' END AS rule_class, count(*) AS n_rules FROM r GROUP BY 1""")
def rule_classes(spark: SparkSession, d: str) -> DataFrame:
    """The strongest rule of each pair, classified and counted."""
    m = table(spark, d, "frontend_compiler_m_lang").filter("lang_name IS NOT NULL")
    rules = mining.strongest_rules(mining.rules_one(mining.facts_long(m, "lang_name", {"feature": "semantic_feature", "proof": "proof_class"})))
    return rules.groupBy(mining.classify_rule("confidence_percent", "support", "joint").alias("rule_class")).agg(F.count(F.lit(1)).alias("n_rules"))


@q("""WITH p AS (SELECT DISTINCT lang_name AS o, semantic_feature AS a FROM frontend_compiler_m_lang WHERE lang_name IS NOT NULL AND semantic_feature IS NOT NULL AND evidence_state = 'SEEN'), n AS (SELECT o, count(*) AS n FROM p GROUP BY 1)
      SELECT o AS lang_name FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.o <> n.o AND (m.n > n.n OR m.n = n.n AND m.o < n.o) AND NOT EXISTS (SELECT 1 FROM p WHERE p.o = n.o AND p.a NOT IN (SELECT a FROM p x WHERE x.o = m.o)))""")
def undominated_sets(spark: SparkSession, d: str) -> DataFrame:
    """Languages whose seen features are no part of another's."""
    m = table(spark, d, "frontend_compiler_m_lang").filter("lang_name IS NOT NULL AND semantic_feature IS NOT NULL AND evidence_state = 'SEEN'")
    return mining.undominated(m, "lang_name", "semantic_feature")


@q("""SELECT CAST(k AS VARCHAR) AS fact_key, CASE WHEN k IN (SELECT contract_id FROM semantic_contract WHERE deleted_at IS NULL) THEN 'EXACT' WHEN fam IN (SELECT contract_role FROM semantic_contract_reference WHERE contract_id % 7 = 0) THEN 'PARAMETERISED' ELSE 'NEW' END AS residual
      FROM (SELECT DISTINCT contract_id AS k, contract_role AS fam FROM semantic_contract_reference WHERE contract_id IS NOT NULL)""")
def residual_classes(spark: SparkSession, d: str) -> DataFrame:
    """Known exactly, known by family, or new."""
    r = table(spark, d, "semantic_contract_reference").select(F.col("contract_id").alias("k"), F.col("contract_role").alias("fam"))
    exact = table(spark, d, "semantic_contract").filter("deleted_at IS NULL").select(F.col("contract_id").alias("k"))
    return R.split_known(r.filter("k IS NOT NULL").distinct(), exact, r.filter("k % 7 = 0"), "k", "fam").select(F.col("k").cast("string").alias("fact_key"), "residual")


@q("SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM lineitem w WHERE w.l_partkey = l.l_partkey AND w.l_suppkey = l.l_suppkey AND w.l_returnflag = l.l_returnflag AND w.l_linestatus = l.l_linestatus AND w.l_quantity > 30) AS observed FROM lineitem l")
def exact_witness(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a witness confirms in four columns."""
    li = table(spark, d, "lineitem")
    keys = ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    return R.witnessed(li.select("l_orderkey", "l_linenumber", *keys), li.filter("l_quantity > 30"), keys).select("l_orderkey", "l_linenumber", "observed")


@q("SELECT n_nationkey, coalesce((SELECT max(s_name) FROM supplier WHERE s_nationkey = n_nationkey), n_name) AS label FROM nation")
def override_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Defaults with the work's values where it has the key."""
    work = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("label"))
    return R.override(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("label")), work, "n_nationkey", "label")


WORDS = "SELECT {t} AS {a}, unnest(list_distinct(regexp_extract_all(lower(replace({t}, '_', ' ')), '[a-z0-9]+'))) AS w FROM (SELECT DISTINCT {t} FROM {f} WHERE {t} IS NOT NULL)"


@q(f"WITH a AS ({WORDS.format(a='x', t='mapping_guidance', f='frontend_compiler_evidence')}), b AS ({WORDS.format(a='y', t='semantic_feature', f='frontend_compiler_m_lang')}) SELECT x AS guidance, y AS feature, count(*) AS n_shared FROM a JOIN b USING (w) GROUP BY 1, 2")
def shared_words(spark: SparkSession, d: str) -> DataFrame:
    """Texts of two tables that share a word."""
    a = table(spark, d, "frontend_compiler_evidence").select(F.col("mapping_guidance").alias("guidance")).filter("guidance IS NOT NULL").distinct()
    b = table(spark, d, "frontend_compiler_m_lang").select(F.col("semantic_feature").alias("feature")).filter("feature IS NOT NULL").distinct()
    return R.token_overlap(a.withColumn("t", F.col("guidance")), b.withColumn("t", F.translate("feature", "_", " ")), "guidance", "feature", "t")


@q("""WITH o AS (SELECT DISTINCT trace_id || '/' || node_id AS k, semantic_operation AS name, arity FROM semantic_trace_node WHERE trace_id IS NOT NULL AND node_id IS NOT NULL), p AS (SELECT DISTINCT semantic_operation AS name, arity AS n FROM semantic_trace_node WHERE arity >= 2 AND semantic_operation IS NOT NULL)
      SELECT o.k, CASE WHEN bool_or(p.n = o.arity) THEN 'exact' WHEN count(p.n) > 0 THEN 'unsupported' ELSE 'no_match' END AS match_status FROM o LEFT JOIN p USING (name) GROUP BY 1, o.name, o.arity""")
def structural_matches(spark: SparkSession, d: str) -> DataFrame:
    """Operations matched to patterns of the same name and number of operands."""
    t = table(spark, d, "semantic_trace_node")
    kinds = lambda n: F.when(F.col(n).isNotNull(), F.array_repeat(F.lit("value"), F.greatest(F.col(n), F.lit(0)))).alias("kinds")
    o = t.filter("trace_id IS NOT NULL AND node_id IS NOT NULL").select(F.concat(F.col("trace_id").cast("string"), F.lit("/"), "node_id").alias("k"), F.col("semantic_operation").alias("name"), "arity").distinct()
    keyed = o.withColumn("id", F.struct("k", "name", "arity")).select("id", "name", kinds("arity"))
    p = t.filter("arity >= 2 AND semantic_operation IS NOT NULL").select(F.col("semantic_operation").alias("name"), kinds("arity")).distinct()
    return R.structural_match(keyed, p, "id", "name", "kinds").select("id.k", "match_status")


# ---------------------------------------------------------------- runtime functions


@q("SELECT p_partkey, pow(p_size, 1.5) AS pow_v, round(log10(gamma(p_size)), 6) AS gamma_digits, round(lgamma(p_size), 6) AS lgamma_v FROM part")
def power_gamma(spark: SparkSession, d: str) -> DataFrame:
    """powers, gamma (compared by its digits) and its logarithm."""
    x = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.pow(x, F.lit(1.5)).alias("pow_v"), F.round(F.log10(V.gamma(x)), 6).alias("gamma_digits"), F.round(V.lgamma(x), 6).alias("lgamma_v"))


@q("SELECT p_partkey, sin(x) AS sin_v, cos(x) AS cos_v, tan(x) AS tan_v, asin(x / 100) AS asin_v, acos(x / 100) AS acos_v, atan(x) AS atan_v, sinh(x / 100) AS sinh_v, cosh(x / 100) AS cosh_v, tanh(x / 100) AS tanh_v FROM (SELECT p_partkey, p_size::DOUBLE AS x FROM part)")
def trig_funcs(spark: SparkSession, d: str) -> DataFrame:
    """F14."""
    x = F.col("p_size").cast("double")
    small = {"asin": F.asin, "acos": F.acos, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh}
    wide = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "atan": F.atan}
    return table(spark, d, "part").select("p_partkey", *[f(x).alias(f"{k}_v") for k, f in wide.items()], *[f(x / 100).alias(f"{k}_v") for k, f in small.items()])


@q("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda w, i: CASE WHEN contains(w, 'e') THEN CAST(i AS VARCHAR) END), lambda i: i IS NOT NULL), ',') AS places FROM part")
def grep_places(spark: SparkSession, d: str) -> DataFrame:
    """the places of the words that match."""
    return table(spark, d, "part").select("p_partkey", F.array_join(V.grep("e", F.split("p_name", " ")).cast("array<string>"), ",").alias("places"))


@q("SELECT 'character' AS text_type, 'double' AS number_type, 'logical' AS flag_type, 'list' AS list_type, 'NULL' AS none_type, count(*) AS n FROM part")
def type_names(spark: SparkSession, d: str) -> DataFrame:
    """what the runtime calls each kind of value."""
    p = table(spark, d, "part")
    kinds = {"text": "p_name", "number": "p_retailprice", "flag": "flag", "list": "items", "none": "none"}
    x = p.withColumn("flag", F.lit(True)).withColumn("items", F.array("p_name")).withColumn("none", F.lit(None).cast("string"))
    one = x.select(*[V.type_of(F.col(c)).alias(f"{k}_type") for k, c in kinds.items()])
    return one.groupBy(*one.columns).agg(F.count(F.lit(1)).alias("n"))


@q("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_size::DOUBLE END IS NULL AS is_na, p_size % 5 <> 0 AS is_finite, p_size % 5 = 0 AS is_infinite, p_size % 2 = 1 AND p_name <> '' AS both, p_size > 10 OR p_size < 3 AS one_of, -p_size AS negative FROM part")
def tests_and_logic(spark: SparkSession, d: str) -> DataFrame:
    """Tests of values and logic."""
    s = F.col("p_size")
    v = F.when(s % 5 == 0, float("inf")).otherwise(s.cast("double"))
    return table(spark, d, "part").select(
        "p_partkey", V.is_na(F.when(s % 2 != 0, s.cast("double"))).alias("is_na"), V.is_finite(v).alias("is_finite"), V.is_infinite(v).alias("is_infinite"),
        ((s % 2 == 1) & (F.col("p_name") != "")).alias("both"), ((s > 10) | V.less(s, F.lit(3))).alias("one_of"), (-s).alias("negative"),
    )


@q("SELECT p_partkey, coalesce(TRY_CAST(trim(x) AS DOUBLE), 0) AS number_v, trunc(coalesce(TRY_CAST(trim(x) AS DOUBLE), 0)) AS integer_v, coalesce(TRY_CAST(trim(x) AS DOUBLE), 0) <> 0 AS logical_v FROM (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name ELSE ' ' || CAST(p_retailprice - 905.5 AS VARCHAR) END AS x FROM part)")
def conversions(spark: SparkSession, d: str) -> DataFrame:
    """Texts as numbers, whole numbers and truth values."""
    x = F.when(F.col("p_size") % 4 == 0, F.col("p_name")).otherwise(F.concat(F.lit(" "), (F.col("p_retailprice") - 905.5).cast("string")))
    return table(spark, d, "part").select("p_partkey", V.as_numeric(x).alias("number_v"), V.as_integer(x).alias("integer_v"), V.as_logical_number(V.as_numeric(x)).alias("logical_v"))


@q("""SELECT p_partkey, array_to_string(CASE WHEN p_size >= 10 THEN range(10, p_size + 1) ELSE list_reverse(range(p_size, 11)) END, ',') AS colon_v, array_to_string(range(1, p_size + 1), ',') AS len_v, array_to_string([p_size, 7, p_size, 7, p_size, 7], ',') AS rep_v, array_to_string(range(0, p_size + 1, 5), ',') AS by_v FROM part""")
def sequences(spark: SparkSession, d: str) -> DataFrame:
    """Ranges both ways, lengths, repeats and steps."""
    s = F.col("p_size").cast("int")
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("bigint").cast("string")), ",")
    return table(spark, d, "part").select("p_partkey", text(V.colon(F.lit(10), s)).alias("colon_v"), text(V.sequence_length(s)).alias("len_v"), text(V.rep(F.array(s, F.lit(7)), F.lit(3))).alias("rep_v"), text(V.seq_by(F.lit(0.0), s.cast("double"), F.lit(5.0))).alias("by_v"))


@q("""WITH v AS (SELECT o_custkey, list(k ORDER BY o_orderkey) AS a FROM (SELECT o_custkey, o_orderkey, (o_orderkey % 5 + 1)::DOUBLE AS k FROM orders) GROUP BY 1)
      SELECT o_custkey, list_product(a) AS prod_v, list_min(a) AS min_v, list_sum(list_transform(a, lambda x, i: list_product(a[1:i]))) AS cumprod_sum, list_sum(list_transform(a, lambda x, i: list_min(a[1:i]))) AS cummin_sum, list_bool_or(list_transform(a, lambda x: x > 4)) AS any_v, list_bool_and(list_transform(a, lambda x: x > 1)) AS all_v FROM v""")
def reductions(spark: SparkSession, d: str) -> DataFrame:
    """Products, running products and minima, any and all; a customer's orders are few."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 5 + 1).cast("double").alias("k"))
    v = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "k"))), lambda s: s["k"]).alias("a"))
    a = F.col("a")
    return v.select(
        "o_custkey", V.prod(a).alias("prod_v"), F.array_min(a).alias("min_v"), V.sum_(V.running(a, lambda s, x: s * x)).alias("cumprod_sum"), V.sum_(V.running(a, F.least)).alias("cummin_sum"),
        F.exists(a, lambda x: x > 4).alias("any_v"), F.forall(a, lambda x: x > 1).alias("all_v"),
    )


@q("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS decimal_text, o_orderkey <= 127 AS fits, (o_custkey + o_orderkey) % 256 AS sum_u8, ((o_custkey - o_orderkey) % 256 + 256) % 256 AS diff_u8, o_custkey < o_orderkey AS is_less, o_custkey = o_orderkey AS is_equal, CAST(floor((o_custkey - 300) / 4.0) AS BIGINT) AS shr_signed FROM orders")
def int_values(spark: SparkSession, d: str) -> DataFrame:
    """Values in a domain, their text, sums, differences, comparisons and signed shifts."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    n = lambda x, k: x.cast("bigint").alias(k)
    return table(spark, d, "orders").select(
        "o_orderkey", I.format_value(o, 64, True).alias("decimal_text"), I.literal(o.cast("string"), 8, True).isNotNull().alias("fits"), n(I.add(c, o, 8, False), "sum_u8"), n(I.subtract(c, o, 8, False), "diff_u8"),
        I.compare(I.value(c, 64, True), o, "less").alias("is_less"), I.compare(c, o, "equal").alias("is_equal"), n(I.shift_right(c - 300, F.lit(2), 32, True), "shr_signed"),
    )


@q("SELECT doc_id, sha256('document' || chr(0) || '{\"id\":' || doc_id || ',\"kind\":' || to_json(coalesce(doc_kind, '')) || '}') AS digest FROM documents")
def json_digests(spark: SparkSession, d: str) -> DataFrame:
    """F64: the digest of a record's canonical JSON under its tag."""
    return table(spark, d, "documents").select("doc_id", X.tagged_digest("document", F.struct(F.coalesce("doc_kind", F.lit("")).alias("kind"), F.col("doc_id").alias("id"))).alias("digest"))


@q("WITH l AS (SELECT n_regionkey, sha256('leaf' || chr(0) || n_name) AS h, n_nationkey FROM nation) SELECT n_regionkey, sha256('root' || chr(0) || string_agg(h, '' ORDER BY h)) AS root FROM l GROUP BY 1")
def merkle_roots(spark: SparkSession, d: str) -> DataFrame:
    """F64: one root over the digests of a group's records, whatever their order."""
    n = table(spark, d, "nation").select("n_regionkey", X.sha_tagged("leaf", F.col("n_name")).alias("h"))
    return n.groupBy("n_regionkey").agg(X.sha_tagged("root", F.array_join(F.array_sort(F.collect_list("h")), "")).alias("root"))


@q(r"""SELECT row_id, coalesce(nullif(regexp_extract(source_url, '^([a-z]+)://', 1), ''), 'none') AS scheme, regexp_replace(coalesce(source_area, '') || ' at 17', ' at [0-9]+$', '') AS stripped,
      rtrim(regexp_replace(regexp_replace('x /* ' || coalesce(stage_name, '') || ' */ y // z', '/\*.*?\*/', ''), '//.*$', '')) AS body FROM frontend_compiler_evidence""")
def text_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """groups of patterns, offsets and comments."""
    e = table(spark, d, "frontend_compiler_evidence")
    stage = F.coalesce("stage_name", F.lit(""))
    return e.select(
        "row_id", F.coalesce(F.nullif(F.regexp_extract("source_url", "^([a-z]+)://", 1), F.lit("")), F.lit("none")).alias("scheme"), X.strip_offset(F.concat(F.coalesce("source_area", F.lit("")), F.lit(" at 17"))).alias("stripped"),
        F.rtrim(X.strip_comments(F.concat(F.lit("x /* "), stage, F.lit(" */ y // z")))).alias("body"),
    )


@q("SELECT contract_id, CAST(CAST('0x' || substr(contract_hash, 1, 12) AS BIGINT) AS VARCHAR) AS hex_v FROM semantic_contract WHERE contract_hash IS NOT NULL")
def hex_numbers(spark: SparkSession, d: str) -> DataFrame:
    """hexadecimal text."""
    return table(spark, d, "semantic_contract").filter("contract_hash IS NOT NULL").select("contract_id", X.hex_value(F.concat(F.lit("0x"), F.substring("contract_hash", 1, 12))).alias("hex_v"))


@q()
def seeded_random(spark: SparkSession, d: str) -> DataFrame:
    """seeded uniform and normal numbers and the time, within their bounds; their values are Spark's own."""
    p = table(spark, d, "part").select(F.rand(7).alias("u"), F.randn(7).alias("n"), (V.sys_time() > 1.7e9).alias("t"), (V.sys_date() > 19_000).alias("day"))
    return p.agg(F.min("u").between(0, 1).alias("from_zero"), F.max("u").between(0, 1).alias("below_one"), (F.abs(F.avg("n")) < 1).alias("centred"), F.bool_and("t").alias("now"), F.bool_and("day").alias("today"))


def batch_responses(requests: DataFrame, key: str, expression: Column) -> DataFrame:
    """(key, code, error): every request answered under its own key; one that fails has its message and no code."""
    return requests.select(key, expression.alias("code"), F.when(expression.isNull(), F.concat(F.lit("cannot read: "), F.coalesce(F.col("request"), F.lit("null")))).alias("error"))


@q("SELECT doc_id, TRY_CAST(regexp_extract(package_name, '([0-9]+)$', 1) AS BIGINT) AS code, CASE WHEN TRY_CAST(regexp_extract(package_name, '([0-9]+)$', 1) AS BIGINT) IS NULL THEN 'cannot read: ' || coalesce(package_name, 'null') END AS error FROM documents")
def batch_requests(spark: SparkSession, d: str) -> DataFrame:
    """The same ids out as in, each with its code or its error."""
    x = table(spark, d, "documents").select("doc_id", F.col("package_name").alias("request"))
    return batch_responses(x, "doc_id", F.regexp_extract("request", "([0-9]+)$", 1).try_cast("bigint"))


@q("SELECT p_partkey, x AS value_v, x * 2 AS double_v, (x + y) / 2 AS average_v, x > 10 AND y > 900 AS all_v FROM (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y FROM part)")
def derived_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Formulas over named arguments with defaults."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    p = V.Formula("DOUBLE", "a", "a * 2").apply(p, "double_v", F.col("x"))
    p = V.Formula("AVERAGE2", "a, b=0", "(a + b) / 2").apply(p, "average_v", F.col("x"), b=F.col("y"))
    p = V.Formula("ALL2", "a, b=true", "a AND b").apply(p, "all_v", F.col("x") > 10, b=F.col("y") > 900)
    return p.select("p_partkey", F.col("x").alias("value_v"), "double_v", "average_v", "all_v")


@q("""WITH v AS (SELECT o_custkey, list(k ORDER BY o_orderkey) AS a FROM (SELECT o_custkey, o_orderkey, (o_orderkey % 4)::DOUBLE AS k FROM orders) GROUP BY 1)
      SELECT o_custkey, round(list_sum(a) / len(a), 9) AS mean_v, round(sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)), 9) AS rms_v, list_sum(list_transform(a, lambda x: x + x)) AS double_v, (a[1] + len(a)) / 2 AS average_v, list_bool_and(list_transform(a, lambda x: x <> 0)) AS all_v FROM v""")
def formula_recipes(spark: SparkSession, d: str) -> DataFrame:
    """Derived primitives read from their formulas; a customer's orders are few."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 4).cast("double").alias("k"))
    v = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "k"))), lambda s: s["k"]).alias("a"))
    a = F.col("a")
    made = lambda text, args, arrays: formulas.build(formulas.read(text), args, frozenset(arrays))
    return v.select(
        "o_custkey", F.round(made("DIV(SUM($0),LENGTH($0))", [a], {0}), 9).alias("mean_v"), F.round(made("SQRT(DIV(SUM(MUL($0,$0)),LENGTH($0)))", [a], {0}), 9).alias("rms_v"), V.sum_(made("ADD($0,$0)", [a], {0})).alias("double_v"),
        made("DIV(ADD($0,$1),CONST(2))", [a[0], F.size(a).cast("double")], ()).alias("average_v"), made("REDUCE_AND($0)", [a], {0}).alias("all_v"),
    )


def _registry(spark: SparkSession, d: str) -> DataFrame:
    """A registry written from the parts, as a file of primitives."""
    path = f"{Staging(spark, 'registry').root}/primitives"
    p = table(spark, d, "part")
    name = F.concat(F.lit("prim_"), (F.col("p_partkey") - F.when(F.col("p_partkey") % 50 == 1, 1).otherwise(0)).cast("string"))
    write_sorted_csv(p.select(F.col("p_partkey").alias("table_index"), name.alias("name"), F.col("p_brand").alias("kernel"), (F.col("p_size") - 3).alias("arity"), F.round(F.col("p_retailprice") / 1000, 3).cast("string").alias("baseline_readiness")), path)
    return registries.load_primitives(spark, path)


PRIMS = "r AS (SELECT CAST(p_partkey AS INTEGER) AS table_index, 'prim_' || (p_partkey - CASE WHEN p_partkey % 50 = 1 THEN 1 ELSE 0 END) AS name, p_brand AS kernel, p_size - 3 AS arity, round(p_retailprice / 1000, 3) AS readiness FROM part)"


@q(f"WITH {PRIMS} SELECT kernel, count(*) AS n, CAST(sum(arity) AS BIGINT) AS arity, max(table_index) AS last_index FROM r GROUP BY 1")
def primitive_registry(spark: SparkSession, d: str) -> DataFrame:
    """A registry of primitives loaded from its file, by kernel."""
    return _registry(spark, d).groupBy("kernel").agg(F.count(F.lit(1)).alias("n"), F.sum("arity").alias("arity"), F.max("table_index").alias("last_index"))


@q(f"WITH {PRIMS} SELECT name, CASE WHEN arity < -1 THEN 'arity' ELSE 'readiness' END AS fault FROM r WHERE arity < -1 OR readiness > 1 UNION ALL SELECT name, 'duplicate' FROM r GROUP BY 1 HAVING count(*) > 1")
def registry_faults(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with a registry."""
    return registries.primitive_faults(_registry(spark, d))


@q(f"WITH {PRIMS}, k AS (SELECT DISTINCT p_brand AS kernel, p_type AS m FROM part WHERE p_size > 10), a AS (SELECT DISTINCT p_type AS m, 'size' || p_size AS t FROM part WHERE p_size > 40) SELECT name, count(DISTINCT k.m) AS n_micro, count(DISTINCT a.t) AS n_atomic FROM r LEFT JOIN k USING (kernel) LEFT JOIN a ON a.m = k.m GROUP BY 1")
def lowering_routes(spark: SparkSession, d: str) -> DataFrame:
    """Primitives by kernel to micro and atomic operations."""
    p = table(spark, d, "part")
    path = f"{Staging(spark, 'micro').root}/map"
    write_sorted_csv(p.select(F.col("p_type").alias("micro_operation"), F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("atomic_operation"), (F.col("p_size") > 40).cast("int").alias("required")).distinct(), path)
    kernels = p.filter("p_size > 10").select(F.col("p_brand").alias("kernel"), F.col("p_type").alias("micro_operation")).distinct()
    return registries.lowering_routes(_registry(spark, d), kernels, registries.load_micro_map(spark, path))


@q("SELECT semantic_feature, " + ", ".join(f"coalesce(min(evidence_state) FILTER (WHERE lang_name = '{x}'), 'UNKNOWN') AS {x}" for x in ("Go", "Java", "Rust")) + " FROM frontend_compiler_m_lang GROUP BY 1")
def implementation_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Operations by stages, from the long form."""
    return registries.implementation_matrix(table(spark, d, "frontend_compiler_m_lang"), "semantic_feature", "lang_name", "evidence_state", ["Go", "Java", "Rust"])


BIND = """p AS (SELECT semantic_operation AS callee, string_split(roles, ';')[1] AS parameter FROM (SELECT semantic_operation, min(operand_roles) AS roles FROM semantic_trace_node WHERE operand_roles <> '' AND semantic_operation IS NOT NULL GROUP BY 1)),
      c AS (SELECT DISTINCT trace_id || '/' || node_id AS call, semantic_operation AS callee, operand_roles FROM semantic_trace_node WHERE operand_roles <> '' AND semantic_operation IS NOT NULL AND trace_id IS NOT NULL AND node_id IS NOT NULL), a AS (SELECT call, callee, unnest(string_split(operand_roles, ';')) AS argument FROM c)"""


def _bound(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "semantic_trace_node").filter("operand_roles <> '' AND semantic_operation IS NOT NULL")
    p = t.groupBy(F.col("semantic_operation").alias("callee")).agg(F.min("operand_roles").alias("r")).select("callee", F.lit(0).alias("place"), F.split("r", ";")[0].alias("parameter"))
    c = t.filter("trace_id IS NOT NULL AND node_id IS NOT NULL").select(F.concat(F.col("trace_id").cast("string"), F.lit("/"), "node_id").alias("call"), F.col("semantic_operation").alias("callee"), "operand_roles").distinct()
    a = c.select("call", "callee", F.posexplode(F.split("operand_roles", ";")).alias("place", "argument")).withColumn("name", F.col("argument"))
    return R.bind_arguments(a, p)


@q(f"WITH {BIND}, b AS (SELECT a.call, a.argument, p.parameter FROM a LEFT JOIN (SELECT DISTINCT * FROM p) p ON p.callee = a.callee AND p.parameter = a.argument) SELECT call, argument, CASE WHEN parameter IS NULL THEN 'unknown' ELSE 'duplicate' END AS fault FROM b WHERE parameter IS NULL OR (call, parameter) IN (SELECT (call, parameter) FROM b WHERE parameter IS NOT NULL GROUP BY call, parameter HAVING count(*) > 1)")
def binding_faults(spark: SparkSession, d: str) -> DataFrame:
    """Operands that name another role than the first of their operation, or it twice."""
    return _bound(spark, d)[1]


def _slow(text: str | None) -> str:
    import time

    if text is None:
        raise ValueError("no text")
    if text.endswith("77"):
        time.sleep(5)
    return text[-2:]


@q("SELECT c_custkey, CASE WHEN c_name LIKE '%77' THEN 'TIMEOUT' WHEN c_custkey % 31 = 0 THEN 'ERROR' ELSE 'OK' END AS state, CASE WHEN c_name LIKE '%77' THEN NULL WHEN c_custkey % 31 = 0 THEN 'no text' ELSE right(c_name, 2) END AS result FROM customer")
def record_timeouts(spark: SparkSession, d: str) -> DataFrame:
    """Records worked on by the executors, each with its own time and state."""
    c = table(spark, d, "customer")
    text = F.when((F.col("c_custkey") % 31 == 0) & ~F.col("c_name").endswith("77"), None).otherwise(F.col("c_name"))
    return R.with_timeout(c.select("c_custkey", text.alias("t")), "c_custkey", "t", _slow, 0.05)
