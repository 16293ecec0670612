"""p2 to p5: hierarchies, orphan references, packed fields and nested records of the trace tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import hierarchy, nested, orphans, packed
from weftline.plans.registry import Registry, table
from weftline.session import Staging, whole_number

records = Registry()


TREES = r"""k AS (SELECT trace_id, TRY_CAST(trim(node_id, E' \t\n') AS BIGINT) AS node_id, TRY_CAST(trim(parent_node_id, E' \t\n') AS BIGINT) AS parent, recorded_at FROM semantic_trace_node),
      l AS (SELECT trace_id, node_id, parent FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, node_id ORDER BY recorded_at DESC, parent DESC NULLS LAST) AS r FROM k) WHERE r = 1 AND node_id IS NOT NULL AND trace_id IS NOT NULL),
      n AS (SELECT l.trace_id, l.node_id, u.node_id AS parent FROM l LEFT JOIN l u ON u.trace_id = l.trace_id AND u.node_id = l.parent),
      d AS (SELECT trace_id, node_id, node_id AS root, 0 AS depth, CAST(node_id AS VARCHAR) AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.trace_id, n.node_id, d.root, d.depth + 1, d.path || '/' || CAST(n.node_id AS VARCHAR) FROM d JOIN n ON n.trace_id = d.trace_id AND n.parent = d.node_id)"""
LOOPS = """o AS (SELECT n.* FROM n ANTI JOIN d ON d.trace_id = n.trace_id AND d.node_id = n.node_id),
      c AS (SELECT trace_id, node_id AS src, parent AS dst FROM o UNION SELECT c.trace_id, c.src, o.parent FROM c JOIN o ON o.trace_id = c.trace_id AND o.node_id = c.dst)"""


def trace_tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euler tours of all traces."""
    t = table(spark, sf_dir, "semantic_trace_node")
    nodes = hierarchy.nodes_of(t, F.col("trace_id"), whole_number("node_id"), whole_number("parent_node_id"), F.col("recorded_at"))
    return hierarchy.build_hierarchy(nodes)


@records.query(f"""WITH RECURSIVE {TREES}, {LOOPS} SELECT trace_id, node_id, root AS root_node_id, depth AS node_depth FROM d WHERE depth >= 12
      UNION ALL SELECT trace_id, src, -1, CASE WHEN bool_or(src = dst) THEN -1 ELSE -2 END FROM c GROUP BY 1, 2""")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of depth 12 or more, and nodes without a root."""
    t = trace_tours(spark, sf_dir).filter((F.col("depth") >= 12) | (F.col("root") == -1) & (F.col("entry") < 0))
    return t.select(F.col("grp").alias("trace_id"), F.col("node").alias("node_id"), F.col("root").alias("root_node_id"), F.col("depth").cast("int").alias("node_depth"))


@records.query(f"""WITH RECURSIVE {TREES}, {LOOPS}, b AS (SELECT trace_id, node_id AS a, node_id, CAST(0 AS BIGINT) AS distance FROM d UNION ALL SELECT b.trace_id, b.a, n.node_id, b.distance + 1 FROM b JOIN n ON n.trace_id = b.trace_id AND n.parent = b.node_id),
      s AS (SELECT trace_id, a AS node_id, count(*) - 1 AS n_below FROM b GROUP BY 1, 2), h AS (SELECT d.trace_id, d.node_id, d.root, d.depth, n.parent, s.n_below FROM d JOIN n USING (trace_id, node_id) JOIN s USING (trace_id, node_id)),
      e AS (SELECT *, coalesce(sum(2 * (n_below + 1)) OVER (PARTITION BY trace_id, parent, CASE WHEN parent IS NULL THEN node_id END ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS step FROM h),
      p AS (SELECT b.trace_id, b.node_id, sum(e.step) AS entry FROM b JOIN e ON e.trace_id = b.trace_id AND e.node_id = b.a GROUP BY 1, 2)
      SELECT e.trace_id, e.node_id, e.root AS root_node_id, e.depth AS node_depth, CAST(p.entry AS BIGINT) AS entry, CAST(p.entry + 2 * e.n_below + 1 AS BIGINT) AS exit, e.n_below FROM e JOIN p USING (trace_id, node_id)
      UNION ALL SELECT trace_id, src, -1, CASE WHEN bool_or(src = dst) THEN -1 ELSE -2 END, -1, -1, NULL FROM c GROUP BY 1, 2""")
def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node: root, depth, interval and number of nodes below."""
    t = trace_tours(spark, sf_dir)
    below = F.when(F.col("entry") >= 0, F.expr("(exit - entry - 1) div 2")).alias("n_below")
    return t.select(F.col("grp").alias("trace_id"), F.col("node").alias("node_id"), F.col("root").alias("root_node_id"), F.col("depth").cast("int").alias("node_depth"), "entry", "exit", below)


@records.query(f"WITH RECURSIVE {TREES} SELECT trace_id, node_id, path AS node_path FROM d")
def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rooted node's path from its root."""
    return hierarchy.paths(trace_tours(spark, sf_dir)).select(F.col("grp").alias("trace_id"), F.col("node").alias("node_id"), F.col("path").alias("node_path"))


@records.query(f"""WITH RECURSIVE {TREES}, b AS (SELECT trace_id, node_id AS a, node_id, 0 AS distance FROM d UNION ALL SELECT b.trace_id, b.a, n.node_id, b.distance + 1 FROM b JOIN n ON n.trace_id = b.trace_id AND n.parent = b.node_id)
      SELECT trace_id, a AS node_id, node_id AS below_node_id, distance FROM b WHERE distance > 0""")
def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with every node below it, and how far below."""
    d = hierarchy.descendants(trace_tours(spark, sf_dir))
    return d.select(F.col("grp").alias("trace_id"), F.col("ancestor").alias("node_id"), F.col("node").alias("below_node_id"), "distance")


#: The evidence ids of a field, cut at every separator, without brackets and quotes: what SQL can say of p4 for ids.
LOST = r"""g AS (SELECT row_id, observed_at, evidence_ids FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY observed_at DESC, evidence_ids DESC NULLS LAST) AS r FROM frontend_compiler_m_lang) WHERE r = 1),
      i AS (SELECT row_id, observed_at, upper(trim(unnest(regexp_split_to_array(evidence_ids, '[;；,|\s\[\]"'']+')))) AS evidence_id FROM g WHERE row_id IS NOT NULL),
      k AS (SELECT DISTINCT trace_id, TRY_CAST(trim(node_id, E' \t\n') AS BIGINT) AS node_id, min(recorded_at) AS born FROM semantic_trace_node GROUP BY 1, 2),
      lost AS (SELECT 'semantic_contract_reference' AS src_table, ref_id AS src_id, 'node_id' AS field_name, CAST(node_id AS VARCHAR) AS ref_key, strftime(referenced_at, '%Y-%m') AS ref_period FROM semantic_contract_reference r WHERE node_id IS NOT NULL AND trace_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.trace_id = r.trace_id AND k.node_id = r.node_id AND k.born <= r.referenced_at)
      UNION SELECT 'semantic_contract_reference', ref_id, 'contract_id', CAST(contract_id AS VARCHAR), strftime(referenced_at, '%Y-%m') FROM semantic_contract_reference r WHERE contract_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM semantic_contract c WHERE c.contract_id = r.contract_id AND created_at <= referenced_at AND (deleted_at IS NULL OR referenced_at < deleted_at))
      UNION SELECT 'frontend_compiler_m_lang', row_id, 'evidence_ids', evidence_id, strftime(observed_at, '%Y-%m') FROM i WHERE evidence_id <> '' AND NOT EXISTS (SELECT 1 FROM frontend_compiler_evidence e WHERE upper(trim(e.evidence_id)) = i.evidence_id AND published_at <= observed_at AND (retired_at IS NULL OR observed_at < retired_at)))"""


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "semantic_contract_reference")
    nodes = table(spark, sf_dir, "semantic_trace_node").select("trace_id", whole_number("node_id").alias("node_id"), "recorded_at")
    by_node = orphans.find_orphans(refs, nodes, keys=["trace_id", "node_id"], ref_at="referenced_at", carry=["ref_id"], born="recorded_at")
    contracts = table(spark, sf_dir, "semantic_contract")
    by_contract = orphans.find_orphans(refs, contracts, keys=["contract_id"], ref_at="referenced_at", carry=["ref_id"], born="created_at", ended="deleted_at")
    m = table(spark, sf_dir, "frontend_compiler_m_lang")
    named = packed.split_packed(m, "row_id", "evidence_ids", "observed_at", atomic=True, carry=("observed_at",))
    seen = Staging(spark, "named").put(named.select("row_id", "observed_at", F.upper(F.trim("item")).alias("evidence_id")))
    evidence = table(spark, sf_dir, "frontend_compiler_evidence").select(F.upper(F.trim("evidence_id")).alias("evidence_id"), "published_at", "retired_at")
    by_evidence = orphans.find_orphans(seen, evidence, keys=["evidence_id"], ref_at="observed_at", carry=["row_id"], born="published_at", ended="retired_at")

    def shaped(df: DataFrame, src: str, sid: str, field: str, key: str) -> DataFrame:
        return df.select(F.lit(src).alias("src_table"), F.col(sid).alias("src_id"), F.lit(field).alias("field_name"), F.col(key).cast("string").alias("ref_key"), orphans.period_text(F.col("period")).alias("ref_period"))

    return reduce(
        DataFrame.unionByName,
        [
            shaped(by_node, "semantic_contract_reference", "ref_id", "node_id", "node_id"),
            shaped(by_contract, "semantic_contract_reference", "ref_id", "contract_id", "contract_id"),
            shaped(by_evidence, "frontend_compiler_m_lang", "row_id", "evidence_ids", "evidence_id"),
        ],
    )


@records.query(f"WITH {LOST} SELECT * FROM lost")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to nodes, contracts and evidence that did not exist when named."""
    return _orphans(spark, sf_dir)


@records.query("""SELECT DISTINCT ref_id, contract_id, strftime(referenced_at, '%Y-%m') AS ref_period FROM semantic_contract_reference r WHERE contract_id IS NOT NULL AND NOT EXISTS
      (SELECT 1 FROM semantic_contract c WHERE c.contract_id = r.contract_id AND created_at <= referenced_at AND (deleted_at IS NULL OR referenced_at < deleted_at))""")
def p3_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to contracts that did not exist when named."""
    o = orphans.find_orphans(table(spark, sf_dir, "semantic_contract_reference"), table(spark, sf_dir, "semantic_contract"), keys=["contract_id"], ref_at="referenced_at", carry=["ref_id"], born="created_at", ended="deleted_at")
    return o.select("ref_id", "contract_id", orphans.period_text(F.col("period")).alias("ref_period"))


@records.query(f"WITH {LOST} SELECT src_table, field_name, ref_period, count(*) AS n_orphans FROM lost GROUP BY 1, 2, 3")
def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, field and month."""
    return orphans.orphan_report(_orphans(spark, sf_dir), "src_table", "field_name", "ref_period")


def _pieces(src: str, field: str, at: str, blanks: bool) -> str:
    """SQL that cuts a field at all separators outside quotes, as its writers quote every value that holds one."""
    gap = r"\s" if blanks else r"\n\t"
    trimmed = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
    whole = trimmed.format(field)
    inner = f"CASE WHEN starts_with({whole}, '[') AND ends_with({whole}, ']') THEN substr({whole}, 2, length({whole}) - 2) ELSE {whole} END"
    pattern = r"""\s*"(?:[^"]|"")*"|\s*''(?:[^'']|'''')*''|[^;；,|GAP]+""".replace("GAP", gap)
    items = f"list_transform(regexp_extract_all({inner}, '{pattern}'), lambda x: {trimmed.format('x')})"
    bare = lambda q, twice: f"WHEN length(x) > 1 AND starts_with(x, '{q}') AND ends_with(x, '{q}') THEN trim(replace(substr(x, 2, length(x) - 2), '{twice}', '{q}'))"
    plain = "list_transform(items, lambda x: CASE " + bare('"', '""') + " " + bare("''", "''''") + " ELSE x END)"
    latest = f"(SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY {at} DESC NULLS LAST, {field} DESC NULLS LAST) AS r FROM {src})"
    named = f"(SELECT row_id, list_filter({plain}, lambda x: x <> '') AS named FROM (SELECT row_id, {items} AS items FROM {latest} WHERE r = 1 AND row_id IS NOT NULL AND {field} IS NOT NULL))"
    return f"SELECT '{src}' AS src_table, row_id, '{field}' AS field_name, CAST(generate_subscripts(named, 1) AS INTEGER) AS pos, unnest(named) AS item FROM {named}"


PIECES = [("frontend_compiler_m_lang", "evidence_ids", "observed_at", True), ("frontend_compiler_evidence", "semantic_features", "published_at", False), ("frontend_compiler_evidence", "suggested_matrices", "published_at", False)]


@records.query(" UNION ALL ".join(_pieces(*p) for p in PIECES))
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the packed fields with its place."""
    m, e = table(spark, sf_dir, "frontend_compiler_m_lang"), table(spark, sf_dir, "frontend_compiler_evidence")
    fields = [
        (m, "frontend_compiler_m_lang", "evidence_ids", "observed_at", True),
        (e, "frontend_compiler_evidence", "semantic_features", "published_at", False),
        (e, "frontend_compiler_evidence", "suggested_matrices", "published_at", False),
    ]
    found = [
        packed.split_packed(df, "row_id", field, at, atomic).select(F.lit(src).alias("src_table"), "row_id", F.lit(field).alias("field_name"), "pos", "item")
        for df, src, field, at, atomic in fields
    ]
    return reduce(DataFrame.unionByName, found)


#: Members of each kind of object, as the reference's records define them; parts of open form are JSON text.
_NODE = "id bigint, kind string, scope bigint, type string, type_origin string, semantics string, effects array<string>, source string, attributes string, extensions string, name string"
SCHEMAS = {
    "document": "schema string, schema_version string, evaluation string, index_base bigint, origin string, universal_ast string, trace string",
    "manifest": "package_name string, module_path string, schema_version int, go_requirements map<string,string>, root_dir string, package_hash string, licenses array<string>, dependencies array<string>, imported_at timestamp_ntz",
    "statement": f"{_NODE}, assign_op string",
    "expression": f"{_NODE}, typed_operation string, binding bigint, operator string, literal_kind string, text string, function string, arguments string, call_resolution string, double_index boolean",
    "ast_node": "id bigint, structural_kind string, semantic_facets array<string>, field_mask array<string>, fields string, source_span string, attributes string",
    "ast_relation": "kind string, `from` bigint, `to` struct<domain:string, id:string>, attributes string",
    "trace_node": "node_id string, parent_node_id string, node_kind string, semantic_operation string, semantic_family string, arity bigint, operand_roles string, result_role string, type_model string, numeric_model string, effects string, evaluation_order string, binding string, scope string, ownership string, lifetime string, representation string, control_flow string, memory_behavior string, exception_behavior string, primitive_id string, primitive_family string, parameterization string, language_operation string, source_start string, source_end string",
    "file": "file_path string, file_kind string, lang_id string, semantic_path string, source_hash string, dependencies array<string>, symbols array<string>, file_status string",
}


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects of both tables with their payloads, emitted once and written by tag."""
    doc = nested.flatten_json(table(spark, sf_dir, "semantic_document"), "document_id", "payload", "received_at", top_tag="document")
    man = nested.flatten_structs(table(spark, sf_dir, "semantic_package_manifest"), "manifest_id", "files", "imported_at", "file", top_tag="manifest")
    return nested.stage_tagged(spark, doc.unionByName(man))


def _flat(spark: SparkSession, sf_dir: str, tag: str) -> DataFrame:
    return nested.tagged_table(_objects(spark, sf_dir), tag, SCHEMAS[tag])


_INDEX = r"(\[\d+\])?"
_STATEMENT = rf"\$\.root{_INDEX}(\.(then|else|body|statements){_INDEX})*"
_OPERAND = rf"(\.(left|right|value){_INDEX}|\.arguments{_INDEX}\.value{_INDEX})"
_EXPRESSION = rf"{_STATEMENT}\.(expression|condition|sequence|patterns){_INDEX}{_OPERAND}*"
_LEAF = rf"\$\.(universal_ast{_INDEX}\.(nodes|relations)|trace{_INDEX}\.nodes){_INDEX}"
#: Every object of a document by its path, texts that hold JSON opened in place, and the path of the object above it.
OBJECTS = rf"""t AS (SELECT document_id AS record_id, '$' AS base, payload AS p FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY received_at DESC NULLS LAST, payload DESC NULLS LAST) AS r FROM semantic_document WHERE document_id IS NOT NULL) WHERE r = 1 AND json_valid(payload)
      UNION ALL SELECT t.record_id, t.base || substr(j.fullkey, 2), j.atom->>'$' FROM t, json_tree(t.p) j WHERE j.type = 'VARCHAR' AND regexp_matches(j.atom->>'$', '^\s*[\[{{]') AND json_valid(j.atom->>'$')),
      o AS (SELECT DISTINCT t.record_id, t.base || substr(j.fullkey, 2) AS obj_path FROM t, json_tree(t.p) j WHERE j.type = 'OBJECT'),
      found AS (SELECT 'semantic_document' AS src_table, record_id, obj_path, CASE WHEN regexp_full_match(obj_path, '{_LEAF}') OR regexp_full_match(obj_path, '\$\.root{_INDEX}') THEN '$' WHEN regexp_full_match(obj_path, '{_STATEMENT}') THEN regexp_replace(obj_path, '\.(then|else|body|statements){_INDEX}$', '')
      ELSE regexp_replace(obj_path, '({_OPERAND}|\.(expression|condition|sequence|patterns){_INDEX})$', '') END AS parent_path FROM o WHERE regexp_full_match(obj_path, '{_LEAF}|{_STATEMENT}|{_EXPRESSION}')
      UNION ALL SELECT DISTINCT 'semantic_package_manifest', manifest_id, '$.files[' || CAST(i - 1 AS VARCHAR) || ']', '$' FROM (SELECT manifest_id, unnest(files) AS f, generate_subscripts(files, 1) AS i FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY imported_at DESC NULLS LAST) AS r FROM semantic_package_manifest WHERE manifest_id IS NOT NULL) WHERE r = 1) WHERE f IS NOT NULL)"""


@records.query(f"WITH RECURSIVE {OBJECTS} SELECT * FROM found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object of the nested records with the path of its parent."""
    src = F.when(F.col("table_tag") == "file", "semantic_package_manifest").otherwise("semantic_document")
    # The records themselves have a row each beside these.
    return _objects(spark, sf_dir).filter(~F.col("table_tag").isin("document", "manifest")).select(src.alias("src_table"), "record_id", "obj_path", "parent_path")


@records.query("""SELECT DISTINCT manifest_id AS record_id, '$.files[' || CAST(i - 1 AS VARCHAR) || ']' AS obj_path, f.file_path AS file_path FROM (SELECT manifest_id, unnest(files) AS f, generate_subscripts(files, 1) AS i FROM semantic_package_manifest) WHERE f IS NOT NULL""")
def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of a manifest's files."""
    return _flat(spark, sf_dir, "file").select("record_id", "obj_path", "file_path")


@records.query()
def p5_file_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of a manifest's files, all fields."""
    return _flat(spark, sf_dir, "file")


@records.query()
def p5_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of statements."""
    return _flat(spark, sf_dir, "statement")


@records.query()
def p5_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of expressions."""
    return _flat(spark, sf_dir, "expression")


@records.query()
def p5_ast_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of the universal AST's nodes."""
    return _flat(spark, sf_dir, "ast_node")


@records.query()
def p5_ast_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of the universal AST's relations."""
    return _flat(spark, sf_dir, "ast_relation")


def _members(tag: str, where: str) -> str:
    """SQL for the flat table of a tag whose members are all single values."""
    kinds = [c.strip().split(" ") for c in SCHEMAS[tag].split(",")]
    columns = ", ".join(f"CAST(w.v->>'$.{n}' AS BIGINT) AS {n}" if k == "bigint" else f"w.v->>'$.{n}' AS {n}" for n, k in kinds)
    return f"""WITH RECURSIVE {OBJECTS}, w AS (SELECT DISTINCT t.record_id, t.base || substr(j.fullkey, 2) AS obj_path, j.value AS v FROM t, json_tree(t.p) j WHERE j.type = 'OBJECT')
      SELECT f.record_id, f.obj_path, f.parent_path, {columns} FROM found f JOIN w USING (record_id, obj_path) WHERE f.src_table = 'semantic_document' AND {where}"""


@records.query(_members("trace_node", "starts_with(f.obj_path, '$.trace')"))
def p5_trace_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of the trace's nodes."""
    return _flat(spark, sf_dir, "trace_node")


@records.query("""SELECT record_id, payload->>'$.schema' AS schema_name, payload->>'$.schema_version' AS schema_version, payload->>'$.evaluation' AS evaluation, CAST(payload->>'$.index_base' AS BIGINT) AS index_base, payload->>'$.origin.language' AS origin_language
      FROM (SELECT document_id AS record_id, payload, row_number() OVER (PARTITION BY document_id ORDER BY received_at DESC NULLS LAST, payload DESC NULLS LAST) AS r FROM semantic_document WHERE document_id IS NOT NULL) WHERE r = 1 AND json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT'""")
def p5_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of the documents themselves: what they hold beside their objects."""
    x = _flat(spark, sf_dir, "document")
    return x.select("record_id", F.col("schema").alias("schema_name"), "schema_version", "evaluation", "index_base", F.get_json_object("origin", "$.language").alias("origin_language"))


@records.query("""SELECT manifest_id AS record_id, package_name, module_path, schema_version, root_dir, package_hash, array_to_string(licenses, ';') AS licenses, len(map_keys(go_requirements)) AS n_requirements, imported_at
      FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY imported_at DESC NULLS LAST) AS r FROM semantic_package_manifest WHERE manifest_id IS NOT NULL) WHERE r = 1""")
def p5_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of the manifests themselves."""
    x = _flat(spark, sf_dir, "manifest")
    return x.select("record_id", "package_name", "module_path", "schema_version", "root_dir", "package_hash", F.array_join("licenses", ";").alias("licenses"), F.when(F.col("go_requirements").isNotNull(), F.size("go_requirements")).cast("bigint").alias("n_requirements"), "imported_at")
