"""Vector, text, integer and streaming functions on the supplied tables."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import ints as I
from weftline.functions import text as X
from weftline.functions import vector as V
from weftline.plans.registry import Registry, table
from weftline.session import Staging
from weftline.streaming import evidence as S

scalar = Registry()
q = scalar.query


@q("""SELECT event_id, round(abs(value), 6) AS abs_v, round(sqrt(abs(value)), 6) AS sqrt_v, round(exp(value / 1000), 6) AS exp_v, CASE WHEN value > 0 THEN round(ln(value), 6) WHEN value = 0 THEN '-infinity'::DOUBLE ELSE 'nan'::DOUBLE END AS log_v,
      round(sin(value), 6) AS sin_v, round(atan(value), 6) AS atan_v, round(cosh(value / 1000), 6) AS cosh_v, round(log10(abs(value) + 1), 6) AS log10_v, round(log2(abs(value) + 1), 6) AS log2_v FROM events""")
def math_funcs(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    r = lambda c, n: F.round(c, 6).alias(n)
    return table(spark, d, "events").select("event_id", r(F.abs(v), "abs_v"), r(F.sqrt(F.abs(v)), "sqrt_v"), r(F.exp(v / 1000), "exp_v"), r(V.log(v), "log_v"), r(F.sin(v), "sin_v"), r(F.atan(v), "atan_v"), r(F.cosh(v / 1000), "cosh_v"), r(V.log(F.abs(v) + 1, 10), "log10_v"), r(V.log(F.abs(v) + 1, 2), "log2_v"))


@q("""SELECT c_custkey, round(c_acctbal / 7) AS round_v, trunc(c_acctbal / 7) AS trunc_v, floor(c_acctbal / 7) AS floor_v, ceil(c_acctbal / 7) AS ceil_v, sign(c_acctbal)::DOUBLE AS sign_v FROM customer""")
def round_trunc_sign(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("c_acctbal") / 7
    return table(spark, d, "customer").select("c_custkey", F.round(x).alias("round_v"), V.trunc(x).alias("trunc_v"), F.floor(x).cast("double").alias("floor_v"), F.ceil(x).cast("double").alias("ceil_v"), F.signum("c_acctbal").alias("sign_v"))


@q("""SELECT o_orderkey, round(a - floor(a / b) * b, 6) AS mod_v, floor(a / b) AS div_v, round(a / b, 6) AS quot_v, CASE WHEN a = 0 THEN 'nan'::DOUBLE WHEN a > 0 THEN 'infinity'::DOUBLE ELSE '-infinity'::DOUBLE END AS by_zero
      FROM (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) - 100 AS a, -7.0::DOUBLE AS b FROM orders)""")
def floor_mod(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("o_custkey").cast("double") - 100, F.lit(-7.0)
    return table(spark, d, "orders").select("o_orderkey", F.round(V.floor_mod(a, b), 6).alias("mod_v"), V.floor_div(a, b).alias("div_v"), F.round(V.divide(a, b), 6).alias("quot_v"), V.divide(a, F.lit(0.0)).alias("by_zero"))


@q("""SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, length(p_name)::INTEGER AS n, substr(p_name, 2, 4) AS sub, p_brand || ' ' || p_type AS pasted, p_brand || p_type AS pasted0 FROM part""")
def string_funcs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"), F.char_length("p_name").alias("n"), V.substr(F.col("p_name"), F.lit(2), F.lit(5)).alias("sub"), V.paste(" ", F.col("p_brand"), F.col("p_type")).alias("pasted"), V.paste("", F.col("p_brand"), F.col("p_type")).alias("pasted0"))


@q(r"""SELECT file_id, regexp_matches(file_path, '[0-9_]') AS is_match, regexp_replace(file_path, '[aeiou]', '$1') AS sub_first, regexp_replace(file_path, '([a-z])/', '\1:', 'g') AS gsub_all, regexp_extract(file_path, '\.([A-Za-z]+)$', 1) AS ext,
      list_last(string_split_regex(file_path, '[/\\]')) AS base_name FROM (SELECT DISTINCT file_id, file_path FROM semantic_package_file WHERE file_path IS NOT NULL)""")
def regex_funcs(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("file_path")
    x = table(spark, d, "semantic_package_file").filter("file_path IS NOT NULL").select("file_id", "file_path").distinct()
    return x.select("file_id", p.rlike("[0-9_]").alias("is_match"), V.sub_literal(p, "[aeiou]", "$1").alias("sub_first"), V.gsub(p, "([a-z])/", "$1:").alias("gsub_all"), F.regexp_extract(p, r"\.([A-Za-z]+)$", 1).alias("ext"), X.basename(p).alias("base_name"))


@q(r"""SELECT doc_id, substr(trim(regexp_replace(regexp_replace(lower(text), '0x[0-9a-f]+|[0-9]+', '<n>', 'g'), '\s+', ' ', 'g')), 1, 500) AS signature, trim(regexp_replace(lower(source), '\s+', ' ', 'g')) AS diagnostic, coalesce(nullif(regexp_replace(lower(trim(source)), '[^a-z0-9_-]', '_', 'g'), ''), 'unknown') AS family FROM documents""")
def signature_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.normalize_signature(F.col("text")).alias("signature"), X.normalize_diagnostic(F.col("source")).alias("diagnostic"), X.sanitize_name(F.col("source")).alias("family"))


@q("SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 16) AS short_digest FROM documents")
def sha256_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("digest"), X.short_hash(F.col("text")).alias("short_digest"))


@q(r"""SELECT row_id, len(list_filter(list_transform(string_split_regex(evidence_ids, '[;,|]'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''))::INTEGER AS n_pieces, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(evidence_ids, '[;,|]'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''))), ';') AS as_set
      FROM (SELECT DISTINCT row_id, evidence_ids FROM frontend_compiler_m_lang WHERE evidence_ids IS NOT NULL)""")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "frontend_compiler_m_lang").filter("evidence_ids IS NOT NULL").select("row_id", "evidence_ids").distinct()
    parts = X.split_multi(F.col("evidence_ids"))
    return x.select("row_id", F.size(parts).alias("n_pieces"), X.set_text(parts).alias("as_set"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """The lines' quantities of each order, in line order; equal line numbers by quantity."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("s"))
    return li.select("l_orderkey", F.transform("s", lambda e: e["l_quantity"]).alias("a"))


VEC = "v AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS a FROM lineitem GROUP BY 1)"


@q(f"""WITH {VEC} SELECT l_orderkey, len(a)::INTEGER AS n, list_sum(a) AS total, round(list_avg(a), 6) AS mean_v, round(sqrt(list_avg(list_transform(a, lambda x: x * x))), 6) AS rms_v, list_min(a) AS min_v, list_max(a) AS max_v,
      list_position(a, list_max(a))::INTEGER AS which_max, list_position(a, list_min(a))::INTEGER AS which_min, len(list_distinct(a))::INTEGER AS n_unique, array_to_string(list_transform(list_sort(a), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS sorted_text, coalesce(CAST(nullif(list_position(a, 10.0), 0) AS DOUBLE), 'nan'::DOUBLE) AS match_ten FROM v""")
def array_funcs(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    return _vectors(spark, d).select(
        "l_orderkey", F.size(a).alias("n"), V.sum_(a).alias("total"), F.round(V.mean(a), 6).alias("mean_v"), F.round(V.rms(a), 6).alias("rms_v"), F.array_min(a).alias("min_v"), F.array_max(a).alias("max_v"),
        V.which_max(a).alias("which_max"), V.which_min(a).alias("which_min"), F.size(F.array_distinct(a)).alias("n_unique"), F.array_join(F.transform(F.array_sort(a), V.number_text), ",").alias("sorted_text"), V.match(F.lit(10.0), a).alias("match_ten"),
    )


def _text(a: Column) -> Column:
    return F.array_join(F.transform(a, V.number_text), ",")


TXT = "array_to_string(list_transform({}, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')"


@q(f"""WITH {VEC} SELECT l_orderkey, {TXT.format('list_transform(a, lambda x, i: x + [1.0, 10.0][((i - 1) % 2) + 1])')} AS recycled, coalesce({TXT.format('list_filter([a[3], a[1], a[9]], lambda x: x IS NOT NULL)')}, '') AS picked,
      {TXT.format('list_transform(a, lambda x, i: list_sum(a[1:i]))')} AS cum_sum, {TXT.format('list_transform(a, lambda x, i: list_max(a[1:i]))')} AS cum_max, {TXT.format('list_filter(list_transform(a, lambda x, i: CASE WHEN x > 25 THEN i END), lambda x: x IS NOT NULL)')} AS which_big FROM v""")
def subset_recycle(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    rec = F.when(F.size(a) > 1, V.recycle(a, F.array(F.lit(1.0), F.lit(10.0)), lambda x, y: x + y)).otherwise(F.transform(a, lambda x: x + 1.0))
    return _vectors(spark, d).select(
        "l_orderkey", _text(rec).alias("recycled"), _text(V.subset(a, F.array(F.lit(3), F.lit(1), F.lit(9)))).alias("picked"), _text(V.running(a, lambda s, x: s + x)).alias("cum_sum"),
        _text(V.running(a, F.greatest)).alias("cum_max"), _text(V.which(F.transform(a, lambda x: x > 25))).alias("which_big"),
    )


def _wrap_sql(x: str, w: int, signed: bool) -> str:
    m = 2**w
    p = f"(((({x})::HUGEINT % {m}) + {m}) % {m})"
    return f"CASE WHEN {p} >= {m // 2} THEN {p} - {m} ELSE {p} END" if signed else p


BIG = "(o_orderkey::HUGEINT * 6364136223846793 + o_custkey * 1442695040888963 - 4611686018427387904)"


@q(f"""SELECT o_orderkey, CAST({_wrap_sql(BIG, 8, True)} AS BIGINT) AS i8, CAST({_wrap_sql(BIG, 16, False)} AS BIGINT) AS u16, CAST({_wrap_sql(BIG, 32, True)} AS BIGINT) AS i32, CAST({_wrap_sql(_wrap_sql(BIG, 32, False) + ' * ' + _wrap_sql('o_custkey * 987654321', 32, False).replace('CASE', '(CASE'), 32, False)} AS BIGINT) AS product32, CAST({_wrap_sql('-(' + _wrap_sql(BIG, 16, True) + ')', 16, True)} AS BIGINT) AS neg16 FROM orders""")
def int_wrap(spark: SparkSession, d: str) -> DataFrame:
    big = (F.col("o_orderkey").cast("decimal(20,0)") * F.expr("CAST(6364136223846793 AS DECIMAL(17,0))")).cast(I.WIDE) + (F.col("o_custkey").cast("decimal(20,0)") * F.expr("CAST(1442695040888963 AS DECIMAL(17,0))")).cast(I.WIDE) - F.expr("CAST(4611686018427387904 AS DECIMAL(38,0))")
    n = lambda c, k: c.cast("bigint").alias(k)
    return table(spark, d, "orders").select(
        "o_orderkey", n(I.convert(big, 8, True), "i8"), n(I.convert(big, 16, False), "u16"), n(I.convert(big, 32, True), "i32"),
        n(I.multiply(big, F.col("o_custkey") * 987654321, 32, False), "product32"), n(I.negate(I.convert(big, 16, True), 16, True), "neg16"),
    )


@q("""SELECT o_orderkey, (b // d) AS quot, (b % d) AS rem, CASE WHEN b > 127 THEN NULL ELSE b END AS in_range FROM (SELECT o_orderkey, CAST(o_custkey % 400 - 200 AS BIGINT) AS b, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE -7 END AS BIGINT) AS d FROM orders)""")
def int_div(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("o_custkey") % 400 - 200
    k = F.when(F.col("o_orderkey") % 2 == 0, 7).otherwise(-7)
    x = table(spark, d, "orders").select("o_orderkey", b.alias("b"), k.alias("d"))
    return x.select("o_orderkey", I.divide(F.col("b"), F.col("d"), 32, True).cast("bigint").alias("quot"), I.remainder(F.col("b"), F.col("d"), 32, True).cast("bigint").alias("rem"), F.when(F.col("b") <= 127, F.col("b")).alias("in_range"))


@q("""SELECT o_orderkey, (u & v) AS and_v, (u | v) AS or_v, xor(u, v) AS xor_v, (u & (65535 - v)) AS and_not_v, ((u << 3) & 65535) AS shl_v, (u >> 5) AS shr_v, (65535 - u) AS not_v, CAST(0 AS BIGINT) AS shl_wide
      FROM (SELECT o_orderkey, CAST(o_orderkey & 65535 AS BIGINT) AS u, CAST((o_custkey * 40503) & 65535 AS BIGINT) AS v FROM orders)""")
def int_bits(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").bitwiseAND(65535).alias("u"), (F.col("o_custkey") * 40503).bitwiseAND(65535).alias("v"))
    u, v = F.col("u"), F.col("v")
    n = lambda c, k: c.cast("bigint").alias(k)
    return x.select(
        "o_orderkey", n(I.bit_and(u, v, 16, False), "and_v"), n(I.bit_or(u, v, 16, False), "or_v"), n(I.bit_xor(u, v, 16, False), "xor_v"), n(I.bit_and_not(u, v, 16, False), "and_not_v"),
        n(I.shift_left(u, F.lit(3), 16, False), "shl_v"), n(I.shift_right(u, F.lit(5), 16, False), "shr_v"), n(I.complement(u, 16, False), "not_v"), n(I.shift_left(u, F.lit(16), 16, False), "shl_wide"),
    )


@q("SELECT key_name, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key_name FROM events) GROUP BY 1")
def json_harvest(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("key_name"))
    return x.groupBy("key_name").agg(F.count(F.lit(1)).alias("n"))


def _arrived(spark: SparkSession, d: str, root: str, shards: int) -> tuple[DataFrame, list]:
    """A growing folder over events and what adds its shards, one at a time."""
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).drop("ts")
    schema = ", ".join(f"{n} {t}" for n, t in e.dtypes)
    e.limit(0).write.parquet(f"{root}/in")
    adds = [lambda k=k: e.filter(F.pmod(F.col("event_id"), F.lit(shards)) == k).write.mode("append").parquet(f"{root}/in") for k in range(shards)]
    return S.folder_stream(spark, f"{root}/in", schema), adds


@q("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts kept by a checkpointed stream over a folder that grows between three runs of it."""
    root = Staging(spark, "stream").root
    s, adds = _arrived(spark, d, root, 3)
    for add in adds:
        add()
        S.run_counts(s, ["event_type"], f"{root}/counts", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/counts")


@q("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Events by user after a stream has kept the first arrival of each event; half of them arrive twice."""
    root = Staging(spark, "stream").root
    s, adds = _arrived(spark, d, root, 2)
    for add in (adds[0], adds[1], adds[0]):
        add()
        S.run_dedup(s, "event_id", f"{root}/out", f"{root}/state", "at", "3650 days").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT event_id, upper(event_type) AS kind, 1 AS n_times FROM events")
def stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """Every record worked on once though the stream starts anew over all of it."""
    root = Staging(spark, "stream").root
    s, adds = _arrived(spark, d, root, 2)
    for k, add in enumerate(adds):
        add()
        S.run_resumable(s, "event_id", lambda x: x.select("event_id", F.upper("event_type").alias("kind")), f"{root}/out", f"{root}/state-{k}").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("event_id", "kind").agg(F.count(F.lit(1)).cast("int").alias("n_times"))


@q("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts < (SELECT date_trunc('day', max(ts) - INTERVAL 1 DAY) FROM events) GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts per day of event time, given out once the watermark of a day has passed the day."""
    root = Staging(spark, "stream").root
    s, adds = _arrived(spark, d, root, 1)
    adds[0]()
    S.run_windows(s, "at", "event_type", "1 day", "1 day", f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@q("SELECT p_partkey, round(gamma(p_size / 8.0), 6) AS gamma_v, round(lgamma(p_size), 6) AS lgamma_v FROM part")
def gamma_funcs(spark: SparkSession, d: str) -> DataFrame:
    """Gamma and log-gamma of part sizes (no JVM function exists; one Arrow call per batch)."""
    x = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(V.gamma(x / 8), 6).alias("gamma_v"), F.round(V.lgamma(x), 6).alias("lgamma_v"))
