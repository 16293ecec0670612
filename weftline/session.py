"""Session defaults and tables written between the steps of an iterative job.

Steps that cut lineage write Parquet into the folder named by ``spark.checkpoint.dir``,
which every executor shares, so a lost executor costs a re-read and never the job.
"""

from __future__ import annotations

import atexit
import math
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()
_OPEN: list[Staging] = []


def build_session(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow on; ``conf`` overrides."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once per application, unless they find it by path or folder already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root:
        return
    _SHIPPED.add(sc.applicationId)
    folder = tempfile.mkdtemp(prefix="weftline-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "weftline_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(os.path.join(root, "weftline")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), root))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all runs on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes inside drop the shuffle files of their plan once they are done, as only their result is read again."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)


class Staging:
    """Tables of one run of an operator: written once, read back, dropped when superseded."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._forget)
        self._n = 0
        _OPEN.append(self)

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back: later steps do not run it again."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        with tidy_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            if t is not None and (path := getattr(t, "_staged_at", None)):
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    def close(self) -> None:
        """Delete all that this run has written; what reads it must be done."""
        self._delete(self.root)
        atexit.unregister(self._forget)

    def _forget(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the JVM may be gone at exit
            pass


def release_staged(spark: SparkSession) -> None:
    """Delete the staged tables of all results so far; call it when they have been read."""
    for st in [s for s in _OPEN if s.spark.sparkContext is spark.sparkContext]:
        st.close()
        _OPEN.remove(st)


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """Number of partitions that hold ``per_part`` rows each."""
    return max(least, math.ceil(rows / max(1, per_part)))


def clean_key(c: str | F.Column) -> F.Column:
    """A text key without outer white space of any kind; blank becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""), F.lit(""))


def whole_number(c: str | F.Column) -> F.Column:
    """Text as a 64-bit whole number, whatever its zeros and blanks; null if it is none."""
    t = clean_key(c)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))
