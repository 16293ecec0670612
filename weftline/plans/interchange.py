"""Sources and sinks: each query writes what a table holds into the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import lexer
from weftline.plans.registry import Registry, table
from weftline.sources import files as S
from weftline.session import Staging

interchange = Registry()
q = interchange.query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{Staging(spark, name).root}/{name}"


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns])


def _lines(spark: SparkSession, header: str, rows: DataFrame, path: str) -> str:
    """A text file of a header and one line per row; one file, as its header belongs to all lines."""
    first = spark.createDataFrame([(0, header)], "at int, value string")
    first.unionByName(rows.select(F.lit(1).alias("at"), "value")).coalesce(1).sortWithinPartitions("at", "value").select("value").write.text(path)
    return path


@q("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, coalesce(trim(c_mktsegment), '') AS c_mktsegment FROM customer")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Sorted CSV written and read as evidence rows."""
    path = _folder(spark, "csv")
    S.write_sorted_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), path)
    return S.read_csv(spark, path)


def _ragged(spark: SparkSession, d: str) -> str:
    """Rows without their last field where the key is divisible by three."""
    p = F.col("p_partkey")
    whole = F.concat_ws(",", p.cast("string"), "p_name", "p_brand")
    return _lines(spark, "p_partkey, p_name ,p_brand", table(spark, d, "part").select(F.when(p % 3 == 0, F.concat_ws(",", p.cast("string"), "p_name")).otherwise(whole).alias("value")), _folder(spark, "ragged"))


@q("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS p_brand FROM part")
def csv_ragged(spark: SparkSession, d: str) -> DataFrame:
    """Rows with too few fields are kept, absent cells empty."""
    return S.read_csv(spark, _ragged(spark, d))


@q("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand FROM part WHERE p_partkey % 3 <> 0")
def csv_bad_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows with too few fields are skipped."""
    return S.read_csv(spark, _ragged(spark, d), malformed="drop")


@q("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def csv_optional(spark: SparkSession, d: str) -> DataFrame:
    """A missing file is an empty relation beside one that is there."""
    path = _folder(spark, "optional")
    S.write_sorted_csv(table(spark, d, "supplier").select("s_suppkey", "s_name"), path)
    columns = ["s_suppkey", "s_name"]
    return S.read_optional(spark, path, columns).unionByName(S.read_optional(spark, path + "-none", columns))


@q("SELECT event_type AS kind, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def csv_aliases(spark: SparkSession, d: str) -> DataFrame:
    """The first alias of a column that is present, in any case; numbers that are none count 0."""
    path = _folder(spark, "aliases")
    x = table(spark, d, "events").select(F.col("event_type").alias("Event_Type"), F.lit("").alias("kind"), F.get_json_object("props", "$.k").alias("K_Value"))
    S.write_sorted_csv(x, path)
    r = S.resolve_aliases(S.read_csv(spark, path), {"kind": ["kind", "event_type"], "k": ["key", "k_value"]})
    return r.groupBy("kind", S.lenient_int(F.col("k")).alias("k")).agg(F.count(F.lit(1)).alias("n"))


EVENT = "event_id bigint, user_id bigint, event_type string"


@q("SELECT event_id, user_id, event_type FROM events")
def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines written and read; a malformed and a blank line are skipped."""
    path = _folder(spark, "jsonl")
    S.write_jsonl(table(spark, d, "events").select("event_id", "user_id", "event_type"), path)
    spark.createDataFrame([("{broken",), (" ",)], "value string").coalesce(1).write.mode("append").text(path)
    return S.read_jsonl(spark, path, EVENT)


@q("SELECT event_id, user_id, event_type FROM events")
def jsonl_gzip(spark: SparkSession, d: str) -> DataFrame:
    """The same, compressed."""
    path = _folder(spark, "jsonl-gz")
    S.write_jsonl(table(spark, d, "events").select("event_id", "user_id", "event_type"), path, compressed=True)
    return S.read_jsonl(spark, path, EVENT)


@q("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status FROM orders")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    """JSON records mapped to canonical names."""
    path = _folder(spark, "json-map")
    S.write_jsonl(table(spark, d, "orders").select(F.col("o_orderkey").alias("OrderId"), F.lit("").alias("state"), F.col("o_orderstatus").alias("Status")), path)
    return S.resolve_aliases(S.read_jsonl(spark, path, "OrderId string, state string, Status string"), {"id": ["id", "orderid"], "status": ["state", "status"]})


@q("SELECT DISTINCT nation.n_name || '.csv' AS member, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def zip_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """ZIP archives written, one a region, and their members read."""
    x = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    members = x.groupBy("n_regionkey", F.concat("n_name", F.lit(".csv")).alias("member")).agg(F.array_join(F.array_sort(F.collect_set(F.col("c_custkey").cast("string"))), "\n").alias("text"))
    path = _folder(spark, "zip")
    S.write_zips(members.select(F.col("n_regionkey").cast("string").alias("archive"), "member", F.encode("text", "utf-8").alias("content")), path)
    got = S.zip_members(S.read_folder(spark, path, "*.zip"), ".csv")
    return got.select("member", F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("c")).select("member", F.col("c").cast("bigint").alias("c_custkey"))


@q("SELECT r_name, count(*) AS n_lines FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def folder_walk(spark: SparkSession, d: str) -> DataFrame:
    """Only files below ``records``; partial, Parquet and contract files are left out."""
    root = _folder(spark, "walk")
    x = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = x.select(F.concat_ws("|", "r_name", "n_name").alias("value"), F.col("n_regionkey").alias("part"))
    lines.write.partitionBy("part").text(f"{root}/records/a")
    for other in ("elsewhere", "records/contract-kinds", "records/run.partial"):
        lines.select("value").write.text(f"{root}/{other}")
    lines.select("value").write.parquet(f"{root}/records/columns")
    text = S.walk_records(spark, root).select(F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("line")).filter("line <> ''")
    return text.groupBy(F.split_part("line", F.lit("|"), F.lit(1)).alias("r_name")).agg(F.count(F.lit(1)).alias("n_lines"))


_EXT = ", ".join(f"'{k}'" for k in S.EXTENSIONS)
_LANG = ", ".join(f"'{v}'" for v in S.EXTENSIONS.values())


@q(f"SELECT [{_LANG}][list_position([{_EXT}], lower(regexp_extract(file_path, '\\.([A-Za-z]+)$', 1)))] AS lang, count(*) AS n FROM semantic_package_file GROUP BY 1")
def source_languages(spark: SparkSession, d: str) -> DataFrame:
    """Files by the language of their extension."""
    return table(spark, d, "semantic_package_file").groupBy(S.language_of(F.col("file_path")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@q("SELECT DISTINCT manifest_id AS task_id, unnest(map_keys(go_requirements)) AS feature FROM semantic_package_manifest WHERE go_requirements IS NOT NULL")
def nested_features(spark: SparkSession, d: str) -> DataFrame:
    """Nested task and result lines; the keys of the result's feature map as rows."""
    path = _folder(spark, "nested")
    x = table(spark, d, "semantic_package_manifest").select(F.struct(F.col("manifest_id").alias("id")).alias("task"), F.struct(F.col("go_requirements").alias("features")).alias("result"))
    S.write_jsonl(x, path)
    r = S.read_jsonl(spark, path, "task struct<id:bigint>, result struct<features:map<string,string>>")
    return S.map_keys_long(r.select(F.col("task.id").alias("task_id"), F.col("result.features").alias("f")), "task_id", "f", "feature").distinct()


@q("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE props IS NOT NULL")
def json_tree(spark: SparkSession, d: str) -> DataFrame:
    """The objects of a JSON tree as rows of cells."""
    rows = lexer.json_tree_rows(table(spark, d, "events").select("event_id", "props"), "event_id", "props")
    return rows.select("event_id", F.try_element_at("cells", F.lit("k")).alias("k"))


@q("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def csv_sniffed(spark: SparkSession, d: str) -> DataFrame:
    """The delimiter is told from the first line."""
    return S.read_sniffed(spark, _lines(spark, "n_nationkey|n_name", table(spark, d, "nation").select(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name").alias("value")), _folder(spark, "sniff")))


@q("SELECT * FROM (VALUES ('csv', CAST(NULL AS VARCHAR), 1), ('json', NULL, 1), ('parquet', NULL, 1)) t(kind, language, n_files)")
def project_discovery(spark: SparkSession, d: str) -> DataFrame:
    """What a project folder holds and how each file would be read."""
    root = _folder(spark, "project")
    x = table(spark, d, "region").coalesce(1)
    x.write.csv(f"{root}/a", header=True)
    x.write.json(f"{root}/b")
    x.write.parquet(f"{root}/c")
    found = S.discover(spark, root).filter("kind <> 'other' AND n_bytes > 0")
    return found.groupBy("kind", "language").agg(F.count(F.lit(1)).cast("int").alias("n_files"))


@q("SELECT CAST(r_regionkey AS VARCHAR) AS region_id, r_name AS region_name FROM region")
def header_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Header spellings brought to canonical names."""
    path = _lines(spark, "Region-Key,region  NAME", table(spark, d, "region").select(F.concat_ws(",", F.col("r_regionkey").cast("string"), "r_name").alias("value")), _folder(spark, "header"))
    return S.rename_synonyms(S.read_csv(spark, path), {"region key": "region_id", "region_name": "region_name"})


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "supplier")
    cells = F.array(F.col("s_suppkey").cast("string"), "s_name")
    path = _folder(spark, "xlsx")
    S.write_sheets(x.select(F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("book"), F.col("s_suppkey").alias("row_no"), cells.alias("cells")), path)
    return S.xlsx_rows(S.read_folder(spark, path, "*.xlsx"))


@q("SELECT 'nation' || s_nationkey || '.xlsx' AS book, count(*) AS n_rows FROM supplier GROUP BY 1")
def sheet_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows per workbook."""
    return _sheets(spark, d).groupBy(F.regexp_extract("file_path", r"([^/]+)$", 1).alias("book")).agg(F.count(F.lit(1)).alias("n_rows"))


@q("SELECT 'nation' || s_nationkey || '.xlsx' AS book, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS row_no, s_suppkey, s_name FROM supplier")
def sheet_rows(spark: SparkSession, d: str) -> DataFrame:
    """The cells of workbooks."""
    return _sheets(spark, d).select(F.regexp_extract("file_path", r"([^/]+)$", 1).alias("book"), F.col("row_no").cast("bigint").alias("row_no"), F.col("cells")[0].cast("bigint").alias("s_suppkey"), F.col("cells")[1].alias("s_name"))


@q("SELECT n_name AS member, CASE WHEN n_nationkey % 5 = 0 THEN 'changed' ELSE 'missing' END AS fault FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 7 = 1")
def checksum_check(spark: SparkSession, d: str) -> DataFrame:
    """Members whose content was changed or is missing."""
    n = table(spark, d, "nation")
    key = F.col("n_nationkey")
    held = n.filter(~((key % 7 == 1) & (key % 5 != 0))).select(F.col("n_name").alias("member"), F.encode(F.when(key % 5 == 0, "other").otherwise(F.col("n_name")), "utf-8").alias("content"))
    manifest = n.select(F.col("n_name").alias("member"), F.upper(F.sha2("n_name", 256)).alias("sha256"))
    return S.checksum_faults(held, manifest).select("member", F.when(F.col("found").isNull(), "missing").otherwise("changed").alias("fault"))


@q("SELECT n_name || '.txt' AS member, sha256(n_name) AS sha256 FROM nation")
def checksum_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The checksums of files that were written."""
    path = _folder(spark, "manifest")
    S.write_files(table(spark, d, "nation").select(F.concat("n_name", F.lit(".txt")).alias("name"), F.encode("n_name", "utf-8").alias("content")), path)
    return S.manifest_of(spark, path)


@q("SELECT 'region' || n_regionkey || '.bundle' AS bundle, n_name AS member, CAST(n_nationkey AS VARCHAR) AS text, true AS verified FROM nation")
def bundle_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Bundles written and read, members verified."""
    path = _folder(spark, "bundle")
    n = table(spark, d, "nation")
    S.write_bundles(n.select(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("bundle"), F.col("n_name").alias("member"), F.encode(F.col("n_nationkey").cast("string"), "utf-8").alias("content")), path)
    got = S.bundle_members(S.read_folder(spark, path, "*.bundle"))
    return got.select(F.regexp_extract("file_path", r"([^/]+)$", 1).alias("bundle"), "member", F.decode("content", "utf-8").alias("text"), "verified")


@q("SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r FROM orders) WHERE r % 7 = 3")
def shard_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh row in walk order, from the fourth on."""
    return S.shard(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 7, 3).select("o_orderkey", "o_orderstatus")


@q("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def dimension_scan(spark: SparkSession, d: str) -> DataFrame:
    """A dimension kept as JSON lines, loaded and joined; Spark broadcasts it where it is small."""
    path = _folder(spark, "dimension")
    S.write_jsonl(table(spark, d, "nation").select("n_nationkey", "n_name"), path)
    dim = S.load_dimension(spark, path, "n_nationkey int, n_name string", "n_nationkey")
    return table(spark, d, "customer").join(dim, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@q("SELECT count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_finished FROM orders")
def summary_sink(spark: SparkSession, d: str) -> DataFrame:
    """Counters as one JSON text, written and read."""
    path = _folder(spark, "summary")
    S.summary_json(table(spark, d, "orders"), n_orders=F.count(F.lit(1)), n_customers=F.countDistinct("o_custkey"), n_finished=F.count_if(F.col("o_orderstatus") == "F")).write.text(path)
    return S.read_jsonl(spark, path, "n_orders bigint, n_customers bigint, n_finished bigint")


@q("SELECT DISTINCT file_id, 1 AS n_times FROM semantic_package_file WHERE file_id IS NOT NULL")
def append_resume(spark: SparkSession, d: str) -> DataFrame:
    """Appended in two overlapping runs and once more, every key is there once."""
    path = _folder(spark, "append")
    x = table(spark, d, "semantic_package_file").filter("file_id IS NOT NULL").select("file_id", "package_name")
    for part in (x.filter("file_id % 3 <> 0"), x, x):
        S.append_new(part, "file_id", path)
    return spark.read.parquet(path).groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("n_times"))


@q("SELECT o_orderkey, o_orderpriority AS v FROM orders")
def atomic_replace(spark: SparkSession, d: str) -> DataFrame:
    """A checkpoint replaced by a later one; readers see either whole."""
    path = _folder(spark, "replace")
    o = table(spark, d, "orders")
    S.replace_table(o.select("o_orderkey", F.col("o_orderstatus").alias("v")), path)
    S.replace_table(o.select("o_orderkey", F.col("o_orderpriority").alias("v")), path)
    return spark.read.parquet(path)


@q("SELECT coalesce(nullif(regexp_replace(lower(trim(source)), '[^a-z0-9_-]', '_', 'g'), ''), 'unknown') AS family, count(*) AS n FROM documents GROUP BY 1")
def family_folders(spark: SparkSession, d: str) -> DataFrame:
    """A folder per family, names sanitised."""
    path = _folder(spark, "family")
    S.write_by_family(table(spark, d, "documents").select("doc_id", "source"), "source", path)
    return spark.read.parquet(path).groupBy(F.col("family").cast("string").alias("family")).agg(F.count(F.lit(1)).alias("n"))
