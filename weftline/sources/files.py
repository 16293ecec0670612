"""Scans and sinks: CSV in its spellings, JSON lines, archives, sheets, checksums and resumable appends."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import os
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import first_present, sanitize_name
from weftline.operators.relational import numbered

#: Fixed value: the name space of sheets.
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def trimmed(df: DataFrame) -> DataFrame:
    """Evidence rows: every cell text, trimmed, absent as empty; header cells trimmed, a byte-order mark removed."""
    names = [c.lstrip("﻿").strip() for c in df.columns]
    return df.toDF(*names).select(*[F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c) for c in names])


def read_csv(spark: SparkSession, path: str, *, malformed: str = "keep", delimiter: str = ",", multiline: bool = False) -> DataFrame:
    """CSV with a header as evidence rows; ``malformed``: keep ragged rows, drop them, or fail.

    With ``multiline`` quoted cells may hold line ends; such files cannot be split, so each is one task.
    """
    mode = {"keep": "PERMISSIVE", "drop": "DROPMALFORMED", "fail": "FAILFAST"}[malformed]
    return trimmed(spark.read.csv(path, header=True, mode=mode, sep=delimiter, multiLine=multiline, enforceSchema=True, escape='"'))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p))


def read_optional(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV, or an empty relation of the columns where the file is missing."""
    if exists(spark, path):
        return read_csv(spark, path)
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """One column per canonical name: the first alias (any case) that is present and not empty; else null."""
    have = {c.lower(): c for c in df.columns}
    cols = []
    for name, other in aliases.items():
        found = [F.col(f"`{have[a.lower()]}`").cast("string") for a in other if a.lower() in have]
        cols.append((first_present(*found) if found else F.lit(None).cast("string")).alias(name))
    return df.select(*cols)


def rename_synonyms(df: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """Header spellings mapped to canonical keys, without regard to case, blanks and hyphens."""
    norm = lambda s: re.sub(r"[\s\-]+", "_", s.strip().lower())
    table = {norm(k): v for k, v in synonyms.items()}
    return df.withColumnsRenamed({c: table.get(norm(c), norm(c)) for c in df.columns})


def lenient_int(c: Column) -> Column:
    """A whole number, 0 where the text is none."""
    return F.coalesce(F.trim(c).try_cast("int"), F.lit(0))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines (``.gz`` too) under a schema; blank and malformed lines are skipped."""
    text = spark.read.text(path).filter(F.trim("value") != "")
    parsed = text.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"), F.try_parse_json("value").alias("v"))
    return parsed.filter("v IS NOT NULL").select("r.*")


def sniff_delimiter(header: str) -> str:
    """The separator a header line uses most; a comma where none occurs."""
    return max((",", "\t", ";", "|"), key=lambda d: (header.count(d), d == ","))


def read_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose delimiter is told from its first line."""
    line = spark.read.text(path).first()
    return read_csv(spark, path, delimiter=sniff_delimiter(line[0] if line else ""))


def read_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file_path, content) of a folder's files, all levels down; partial and hidden ones left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return raw.filter(~F.col("path").rlike(r"\.partial$|/[._][^/]*$")).select(F.col("path").alias("file_path"), "content")


#: Language by file extension.
EXTENSIONS = {"go": "go", "py": "python", "js": "javascript", "ts": "typescript", "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "java": "java", "kt": "kotlin", "rb": "ruby", "swift": "swift", "r": "r"}


def language_of(path: Column) -> Column:
    """Language of a file by its extension, null if unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), ext)


def walk_records(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, content) of the files below a ``records`` folder; partial, Parquet and contract files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inner = F.substring_index("path", path.rstrip("/") + "/", -1)
    keep = inner.rlike(r"^(.*/)?records/") & ~inner.rlike(r"\.partial(/|$)|\.parquet$|contract|(^|/)[._][^/]*$")
    return raw.filter(keep).select(F.col("path").alias("file_path"), "content")


def map_keys_long(df: DataFrame, key: str, features: str, name: str) -> DataFrame:
    """(key, name): a row per key of a map; null and empty maps give none."""
    return df.select(key, F.explode(F.map_keys(features)).alias(name))


def load_dimension(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A dimension from JSON lines, one row per key (the least of several); null keys are left out."""
    x = read_jsonl(spark, path, schema).filter(F.col(key).isNotNull())
    rest = [c for c in x.columns if c != key]
    return x.groupBy(key).agg(F.min(F.struct(*rest)).alias("__b")).select(key, "__b.*")


def shard(df: DataFrame, order: list[str], n: int, k: int) -> DataFrame:
    """Rows whose place (from 0) in a total order is k modulo n."""
    return numbered(df, order, "__at").filter(F.pmod(F.col("__at") - 1, F.lit(n)) == k).drop("__at")


def _zip_members(suffix: str):  # noqa: ANN202
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content.as_py()))
                except (zipfile.BadZipFile, TypeError):
                    continue
                for m in z.infolist():
                    if m.filename.endswith(suffix) and not m.is_dir():
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([m.filename]), pa.array([z.read(m)], pa.binary())], ["file_path", "member", "content"])

    return run


def zip_members(files: DataFrame, suffix: str = "") -> DataFrame:
    """(file_path, member, content) of the members of ZIP files by name suffix; broken archives give none."""
    return files.select("file_path", "content").mapInArrow(_zip_members(suffix), "file_path string, member string, content binary")


def _sheet(content: bytes) -> list[list[str]]:
    ns = {"m": SHEET}
    z = zipfile.ZipFile(io.BytesIO(content))
    words: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        words = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
    name = min(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n))
    rows = []
    for r in ElementTree.fromstring(z.read(name)).iter(f"{{{ns['m']}}}row"):
        row = []
        for c in r.findall("m:c", ns):
            v = c.find("m:v", ns)
            text = v.text if v is not None and v.text else "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
            row.append(words[int(text)] if c.get("t") == "s" and text else text)
        rows.append(row)
    return rows


def xlsx_rows(files: DataFrame) -> DataFrame:
    """(file_path, row_no, cells) of the first sheet of each workbook; unreadable ones give none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    rows = _sheet(content.as_py())
                except (zipfile.BadZipFile, ValueError, TypeError, KeyError):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(1, len(rows) + 1), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["file_path", "row_no", "cells"])

    return files.select("file_path", "content").mapInArrow(run, "file_path string, row_no int, cells array<string>")


def checksum_faults(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows (member, sha256) whose file is missing or has another checksum; empty means verified."""
    have = files.select("member", F.sha2("content", 256).alias("found"))
    x = manifest.select("member", F.lower("sha256").alias("sha256")).join(have, "member", "left")
    return x.filter(~F.col("sha256").eqNullSafe(F.col("found"))).select("member", "sha256", "found")


# ---------------------------------------------------------------- sinks


def write_sorted_csv(df: DataFrame, path: str) -> None:
    """CSV with header, globally sorted by all columns as text."""
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    text.orderBy(*df.columns).write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')


def write_jsonl(df: DataFrame, path: str, compressed: bool = False) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path, compression="gzip" if compressed else "none")


def write_by_family(df: DataFrame, family: str, path: str) -> None:
    """One folder per family, its name sanitised, in a column ``family``; families with equal names share one."""
    df.withColumn("family", sanitize_name(F.col(family))).write.mode("overwrite").partitionBy("family").parquet(path)


KEY_BUCKETS = 64


def unseen(df: DataFrame, key: str, path: str) -> DataFrame:
    """One row per key that the target does not hold yet, with the bucket it belongs to.

    The target is laid out by a hash of the key. Only the keys of the buckets that the new rows fall into are read.
    Rows with a null key cannot be told apart and are left out.
    """
    spark = df.sparkSession
    fresh = df.filter(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("key_bucket", _bucket(key))
    if not exists(spark, path):
        return fresh
    wanted = [r[0] for r in fresh.select("key_bucket").distinct().collect()]  # at most KEY_BUCKETS
    return fresh.join(spark.read.parquet(path).filter(F.col("key_bucket").isin(wanted)).select(key), key, "left_anti")


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def append_rows(df: DataFrame, key: str, path: str) -> None:
    """Append rows to a target laid out by a hash of the key."""
    df.withColumn("key_bucket", _bucket(key)).write.mode("append").partitionBy("key_bucket").parquet(path)


def append_new(df: DataFrame, key: str, path: str) -> int:
    """Append the rows whose key the target does not hold yet; the number appended. A second run appends nothing."""
    seen = Observation()
    append_rows(unseen(df, key, path).observe(seen, F.count(F.lit(1)).alias("n")), key, path)
    return int(seen.get["n"])


def replace_table(df: DataFrame, path: str) -> None:
    """A checkpoint written beside the old one and then renamed over it, so that no reader sees a part."""
    spark = df.sparkSession
    fresh, old = f"{path}.{uuid.uuid4().hex[:8]}", f"{path}.old"
    df.write.parquet(fresh)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.delete(path_of(old), True)
    if fs.exists(path_of(path)):
        fs.rename(path_of(path), path_of(old))
    fs.rename(path_of(fresh), path_of(path))
    fs.delete(path_of(old), True)


def write_files(files: DataFrame, path: str) -> None:
    """One file per row (name, content) in the shared folder ``path``, each written whole and then renamed.

    Executors write them; ``path`` must be a folder they share (``file:`` or a plain path).
    """
    folder = re.sub(r"^file:/*", "/", path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = os.path.join(folder, f".{os.path.basename(name)}.{uuid.uuid4().hex[:8]}")
                with open(part, "wb") as f:
                    f.write(content or b"")
                os.replace(part, os.path.join(folder, os.path.basename(name)))
            yield pa.RecordBatch.from_arrays([b.column(0)], ["name"])

    files.select("name", "content").filter("name IS NOT NULL").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def _grouped_files(df: DataFrame, group: str, order: str, make, suffix: str, path: str) -> None:  # noqa: ANN001
    """A file per group made by ``make`` from its rows in order; a group must fit the archive it becomes."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by(order).to_pylist()
        return pa.table({"name": [f"{rows[0][group]}{suffix}"], "content": pa.array([make(rows)], pa.binary())})

    write_files(df.groupBy(group).applyInArrow(run, "name string, content binary"), path)


def write_zips(members: DataFrame, path: str) -> None:
    """A ZIP file per ``archive`` of its (member, content) rows."""

    def make(rows: list[dict]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows:
                z.writestr(r["member"], r["content"] or b"")
        return out.getvalue()

    _grouped_files(members, "archive", "member", make, ".zip", path)


def write_sheets(rows: DataFrame, path: str) -> None:
    """A workbook of one sheet per ``book`` of its (row_no, cells) rows, all cells text."""

    def make(found: list[dict]) -> bytes:
        body = "".join(f"<row>{''.join(f'<c t=\"inlineStr\"><is><t>{escape(c or "")}</t></is></c>' for c in r['cells'])}</row>" for r in found)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{SHEET}"><sheetData>{body}</sheetData></worksheet>')
        return out.getvalue()

    _grouped_files(rows, "book", "row_no", make, ".xlsx", path)


def write_bundles(members: DataFrame, path: str) -> None:
    """A bundle per ``bundle`` of its (member, content) rows, as ``bundle_members`` reads them."""

    def make(rows: list[dict]) -> bytes:
        listed = [{"path": r["member"], "content": base64.b64encode(r["content"]).decode(), "sha256": hashlib.sha256(r["content"]).hexdigest()} for r in rows]
        return base64.b64encode(gzip.compress(json.dumps(listed).encode(), mtime=0))

    _grouped_files(members, "bundle", "member", make, ".bundle", path)


def summary_json(df: DataFrame, **counters: Column) -> DataFrame:
    """One row, one JSON text of aggregate counters."""
    return df.agg(F.to_json(F.struct(*[c.alias(k) for k, c in counters.items()])).alias("summary"))


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    """(member, sha256) of the data files under a folder."""
    f = read_folder(spark, path)
    return f.select(F.regexp_extract("file_path", r"([^/]+)$", 1).alias("member"), F.sha2("content", 256).alias("sha256"))


def bundle_members(files: DataFrame) -> DataFrame:
    """(file_path, member, content, verified) of bundles: base64 of gzip of a JSON array of {path, content (base64), sha256}.

    A bundle that cannot be opened gives one row with null member and verified false.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                try:
                    for m in json.loads(gzip.decompress(base64.b64decode(content.as_py()))):
                        data = base64.b64decode(m["content"])
                        rows.append((m["path"], data, hashlib.sha256(data).hexdigest() == m["sha256"]))
                except (ValueError, OSError, KeyError, TypeError, EOFError):
                    rows = [(None, None, False)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *(pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.binary(), pa.bool_())))], ["file_path", "member", "content", "verified"])

    return files.select("file_path", "content").mapInArrow(run, "file_path string, member string, content binary, verified boolean")


def discover(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, kind, language, n_bytes): what a project folder holds and how each file would be read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file_path"), F.col("length").alias("n_bytes"))
    low = F.lower("file_path")
    kind = F.when(low.rlike(r"\.partial$"), "partial").when(low.rlike(r"\.csv(\.gz)?$"), "csv").when(low.rlike(r"\.(jsonl|ndjson)(\.gz)?$"), "jsonl").when(low.rlike(r"\.json(\.gz)?$"), "json").when(low.endswith(".zip"), "zip").when(low.endswith(".xlsx"), "xlsx").when(low.endswith(".parquet"), "parquet").when(language_of(F.col("file_path")).isNotNull(), "source").otherwise("other")
    return f.select("file_path", kind.alias("kind"), language_of(F.col("file_path")).alias("language"), "n_bytes")


def row_range(df: DataFrame, order: list[str], skip: int, take: int) -> DataFrame:
    """Rows skip + 1 to skip + take in a total order."""
    return df.orderBy(*order).offset(skip).limit(take)
