"""p1, p6, p7 and p8: similar sets, packing, mixing and reading levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import mixing, packing, reading, similar, tokens
from weftline.plans.registry import Registry, table
from weftline.session import Staging

llm = Registry()


def _levels(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    return reading.read_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_sample"), doc_id="doc_id", text="text", sample_text="sample_text", sample_level="reading_level", keep=keep, label="lang")


@llm.query()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents of at least 60 words of prose that read at level 4 or 5."""
    x = _levels(spark, sf_dir, [])
    return x.filter(F.col("is_english") & (F.col("n_words") >= 60) & (F.col("level") >= 3.5)).select("doc_id").distinct()


@llm.query()
def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents, words and mean score per kind of document and reading level."""
    x = _levels(spark, sf_dir, ["doc_kind"]).filter("is_english")
    return x.groupBy("doc_kind", F.round("level").cast("int").alias("reading_level")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"), F.avg("score").alias("mean_score"))


def _sized(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return Staging(spark, "tokens").put(tokens.with_token_counts(docs, "text", list(keep)))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sized(spark, sf_dir, "doc_id"), "doc_id", "n_tokens", table(spark, sf_dir, "pack_spec"), pack_id="pack_id", capacity="capacity_tokens", joint="join_tokens")


@llm.query()
def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and slot of every document (or piece of one) for every kind of container."""
    return _packed(spark, sf_dir).withColumnRenamed("item", "doc_id")


@llm.query()
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and the share of space used per kind of container."""
    return packing.fill_report(_packed(spark, sf_dir), table(spark, sf_dir, "pack_spec"), "pack_id", "capacity_tokens", "join_tokens")


def _mixer(spark: SparkSession, sf_dir: str) -> mixing.Mixer:
    docs = table(spark, sf_dir, "documents").withColumn("text_hash", F.sha2("text", 256))
    sized = Staging(spark, "tokens").put(tokens.with_token_counts(docs, "text", ["doc_id", "source", "text_hash"]))
    return mixing.mixer(sized, table(spark, sf_dir, "mix_target"), doc_id="doc_id", source="source", text_hash="text_hash", n_tokens="n_tokens", mix_id="mix_id", source_name="source_name", share="target_share", repeats="max_repeats")


@llm.query()
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every mix with their rate and number of copies."""
    return _mixer(spark, sf_dir).copies()


@llm.query()
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source of every mix."""
    m = _mixer(spark, sf_dir)
    return m.report(m.copies())


def _similar(spark: SparkSession, sf_dir: str) -> similar.SimilarSets:
    files = table(spark, sf_dir, "semantic_package_file")
    return similar.SimilarSets(similar.sets_of(files, "file_id", ["symbols", "dependencies"], "imported_at"))


#: All pairs by a join on shared values, for the small tables: what the sketches must find.
PAIRS = """f AS (SELECT file_id, symbols, dependencies FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY imported_at DESC NULLS LAST) AS r FROM semantic_package_file WHERE file_id IS NOT NULL) WHERE r = 1),
      v AS (SELECT DISTINCT field_name, file_id, trim(x, E' \\t\\n\\r') AS x FROM (SELECT 'symbols' AS field_name, file_id, unnest(symbols) AS x FROM f UNION ALL SELECT 'dependencies', file_id, unnest(dependencies) FROM f) WHERE trim(x, E' \\t\\n\\r') <> ''),
      n AS (SELECT field_name, file_id, count(*) AS n FROM v GROUP BY 1, 2 HAVING count(*) >= 3), s AS (SELECT a.field_name, a.file_id AS a, b.file_id AS b, count(*) AS k FROM v a JOIN v b ON a.field_name = b.field_name AND a.x = b.x AND a.file_id < b.file_id GROUP BY 1, 2, 3),
      p AS (SELECT s.field_name, s.a AS file_id_a, s.b AS file_id_b FROM s JOIN n x ON x.field_name = s.field_name AND x.file_id = s.a JOIN n y ON y.field_name = s.field_name AND y.file_id = s.b WHERE 5 * s.k >= 3 * (x.n + y.n - s.k))"""


CLASSES = f"""{PAIRS}, k AS (SELECT v.field_name, v.file_id, string_agg(x, chr(31) ORDER BY x) AS s FROM v JOIN n USING (field_name, file_id) GROUP BY 1, 2), c AS (SELECT field_name, file_id, min(file_id) OVER (PARTITION BY field_name, s) AS class_id FROM k),
      l AS (SELECT DISTINCT p.field_name, least(a.class_id, b.class_id) AS file_id_a, greatest(a.class_id, b.class_id) AS file_id_b FROM p JOIN c a ON a.field_name = p.field_name AND a.file_id = p.file_id_a JOIN c b ON b.field_name = p.field_name AND b.file_id = p.file_id_b WHERE a.class_id <> b.class_id)"""


@llm.query(f"WITH {PAIRS} SELECT * FROM p")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of package files that share at least 0.6 of their symbols, or of their dependencies."""
    pairs = _similar(spark, sf_dir).record_pairs()
    return pairs.select(F.col("field").alias("field_name"), F.col("record_a").cast("bigint").alias("file_id_a"), F.col("record_b").cast("bigint").alias("file_id_b"))


@llm.query(f"WITH {CLASSES}, m AS (SELECT field_name, class_id, count(*) AS n_links FROM (SELECT field_name, file_id_a AS class_id FROM l UNION ALL SELECT field_name, file_id_b FROM l) GROUP BY 1, 2) SELECT c.field_name, c.file_id, c.class_id, coalesce(m.n_links, 0) AS n_links FROM c LEFT JOIN m USING (field_name, class_id)")
def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with a set of three values or more: the class of its set and the number of classes similar to it."""
    return _similar(spark, sf_dir).classes().select(F.col("field").alias("field_name"), F.col("record").cast("bigint").alias("file_id"), "class_id", "n_links")


@llm.query(f"WITH {CLASSES} SELECT * FROM l")
def p1_class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar classes, each named by its least file: copies are not expanded into pairs."""
    return _similar(spark, sf_dir).representative_pairs().select(F.col("field").alias("field_name"), F.col("a").cast("bigint").alias("file_id_a"), F.col("b").cast("bigint").alias("file_id_b"))
