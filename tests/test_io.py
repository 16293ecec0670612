"""Sources, sinks and streams on files of the test's own."""

from __future__ import annotations

import gzip
import hashlib
import io
import zipfile

from pyspark.sql import functions as F

from weftline.sources import files as S
from weftline.streaming import evidence as T


def test_csv_and_aliases(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id, Lang,code\n1,go , x\n2,py\n", encoding="utf-8")
    df = S.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "go", "x"), ("2", "py", "")]
    got = S.resolve_aliases(df, {"language": ["language_id", "lang"], "text": ["source", "code"], "none": ["nope"]})
    assert [tuple(r) for r in got.orderBy("language").collect()] == [("go", "x", None), ("py", None, None)]
    (tmp_path / "b.csv").write_text("p;q\n1;2\n")
    assert S.read_sniffed(spark, str(tmp_path / "b.csv")).columns == ["p", "q"]
    assert S.read_optional(spark, str(tmp_path / "none.csv"), ["x"]).count() == 0
    assert S.rename_synonyms(df, {"ID": "case_id"}).columns == ["case_id", "lang", "code"]


def test_jsonl_and_zip(spark, tmp_path):
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        f.write('{"id": 1, "t": "a"}\n\nbroken{\n{"id": 2}\n')
    assert [tuple(r) for r in S.read_jsonl(spark, str(tmp_path / "r.jsonl.gz"), "id long, t string").orderBy("id").collect()] == [(1, "a"), (2, None)]
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("m/x_matrix.csv", "a,b\n")
        z.writestr("other.txt", "no")
    (tmp_path / "z").mkdir()
    (tmp_path / "z/a.zip").write_bytes(b.getvalue())
    (tmp_path / "z/b.zip").write_bytes(b"not a zip")
    m = S.zip_members(S.read_folder(spark, str(tmp_path / "z"), "*.zip"), "_matrix.csv")
    assert [r.member for r in m.collect()] == ["m/x_matrix.csv"]
    good, bad = hashlib.sha256(b"a,b\n").hexdigest(), "0" * 64
    manifest = spark.createDataFrame([("m/x_matrix.csv", good), ("gone", bad)], "member string, sha256 string")
    assert [r.member for r in S.checksum_faults(m, manifest).collect()] == ["gone"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(10, "b"), (9, "a")], "id long, t string")
    S.write_sorted_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*.csv")))
    assert [x for x in text.splitlines() if x != "id,t"] == ["10,b", "9,a"]
    out = str(tmp_path / "append")
    assert S.append_new(df, "id", out) == 2 and S.append_new(df.union(df.selectExpr("id + 5", "t")), "id", out) == 2
    assert S.append_new(spark.createDataFrame([(None, "n"), (10, "b")], "id long, t string"), "id", out) == 0 and spark.read.parquet(out).count() == 4
    S.replace_table(df, str(tmp_path / "now"))
    S.replace_table(df.filter("id = 9"), str(tmp_path / "now"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "now")).collect()] == [9] and [p.name for p in tmp_path.glob("now*")] == ["now"]
    S.write_by_family(df.withColumn("kind", F.when(F.col("id") == 9, " A/b ")), "kind", str(tmp_path / "family"))
    assert sorted(p.name for p in (tmp_path / "family").glob("family=*")) == ["family=a_b", "family=unknown"]
    assert S.summary_json(df, n=F.count(F.lit(1))).first()[0] == '{"n":2}'


def test_streams(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "k string, at timestamp"
    add = lambda rows, n: spark.createDataFrame(rows, "k string").selectExpr("k", "timestamp'2024-01-01 00:00:00' AS at").coalesce(1).write.mode("append").parquet(src)  # noqa: E731, ARG005
    add([("a",), ("b",), ("a",)], 1)
    run = lambda: T.run_counts(T.folder_stream(spark, src, schema), ["k"], str(tmp_path / "counts"), str(tmp_path / "ck")).awaitTermination()
    run()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "counts")).collect()} == {("a", 2), ("b", 1)}
    dd = lambda: T.run_dedup(T.folder_stream(spark, src, schema), "k", str(tmp_path / "dd"), str(tmp_path / "ck2"), "at").awaitTermination()
    dd()
    add([("a",), ("c",)], 2)
    dd()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "dd")).collect()) == ["a", "b", "c"]
    for _ in range(2):
        T.run_resumable(T.folder_stream(spark, src, schema), "k", lambda d: d.select("k", F.upper("k").alias("u")), str(tmp_path / "res"), str(tmp_path / "ck3")).awaitTermination()
    assert sorted(r.u for r in spark.read.parquet(str(tmp_path / "res")).collect()) == ["A", "B", "C"]
