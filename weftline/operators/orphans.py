"""References to records that do not exist, by compressed bitmaps.

1. References are reduced to (key, period) and parents to distinct lifetimes before anything is
   shuffled, so a key that holds a third of all rows becomes a few rows.
2. Both are laid out by key range (a hash of the key). Within a range the keys are
   dictionary-encoded as integers, and one compressed bitmap per period is built of the keys
   referenced, of those alive during all of the period and of those alive at some time in it.
3. referenced AND-NOT alive-at-some-time leaves certain orphans; referenced AND alive-at-some-time
   AND-NOT alive-throughout leaves the keys whose references must be compared with the exact times.
4. The surviving bits are decoded to (key, period) and joined to the reference rows; survivors of
   the second kind bring the lifetimes that cover a part of the period, and the exact times decide.

Defined results
* a null key is no reference; a reference whose time is null is an orphan only if its key names
  no record at all (its period is null);
* a parent exists from ``born`` until just before ``ended``; a null ``ended`` never comes, a null
  ``born`` means since ever; a lifetime that ends before it begins is empty; lifetimes may overlap;
* the same reference delivered twice counts once: rows are distinct;
* empty tables: without parents every reference is an orphan, without references there is none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import Staging, parts_for

SURVIVORS = "key string, period int, starts array<bigint>, ends array<bigint>"
FAR = 2**31 - 2
NO_TIME = -(2**31) + 2
EVER, NEVER = -(2**62), 2**62  # microseconds before and after all times
SPARSE = 4096  # a container with fewer members is a sorted list of 16-bit places, as in Roaring bitmaps


class Bitmap:
    """A compressed set of non-negative integers: per 65,536 places a sorted list or packed bits."""

    def __init__(self, parts: dict[int, np.ndarray] | None = None) -> None:
        self.parts = parts or {}

    @classmethod
    def of(cls, places: np.ndarray) -> Bitmap:
        places = np.unique(places.astype(np.int64))
        highs, first = np.unique(places >> 16, return_index=True)
        return cls({int(h): cls._pack(x) for h, x in zip(highs, np.split((places & 0xFFFF).astype(np.uint16), first[1:]))})

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        if len(low) < SPARSE:
            return low
        bits = np.zeros(65536, np.bool_)
        bits[low] = True
        return np.packbits(bits)

    @staticmethod
    def _bits(part: np.ndarray | None) -> np.ndarray:
        if part is None:
            return np.zeros(65536, np.bool_)
        if part.dtype == np.uint8:
            return np.unpackbits(part).astype(np.bool_)
        bits = np.zeros(65536, np.bool_)
        bits[part] = True
        return bits

    def _both(self, other: Bitmap, keep: bool) -> Bitmap:
        out = {}
        for h, a in self.parts.items():
            b = other.parts.get(h)
            if b is None:
                if not keep:
                    out[h] = a
                continue
            if a.dtype == np.uint16 and b.dtype == np.uint16:
                low = a[np.isin(a, b, invert=not keep)]
            else:
                x, y = self._bits(a), self._bits(b)
                low = np.flatnonzero(x & (y if keep else ~y)).astype(np.uint16)
            if len(low):
                out[h] = self._pack(low)
        return Bitmap(out)

    def and_not(self, other: Bitmap) -> Bitmap:
        return self._both(other, keep=False)

    def and_(self, other: Bitmap) -> Bitmap:
        return self._both(other, keep=True)

    def places(self) -> np.ndarray:
        found = [(h << 16) + (np.flatnonzero(self._bits(p)) if p.dtype == np.uint8 else p.astype(np.int64)) for h, p in sorted(self.parts.items())]
        return np.concatenate(found) if found else np.empty(0, np.int64)


def _range_survivors(t: pa.Table) -> pa.Table:
    """One key range: rows (range_id, key, kind, a, b, start, end); kind 0 is a reference of period a, 1 a life
    of periods a to b. Certain orphans come without lifetimes, doubtful keys with those that cover a part of the period."""
    coded = t.column("key").combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kind, a, b, start, end = (t.column(c).to_numpy() for c in ("kind", "a", "b", "start", "end"))
    ref, life = kind == 0, np.flatnonzero(kind == 1)
    life = life[np.argsort(code[life], kind="stable")]
    lc, born, ended, start, end = code[life], a[life], b[life], start[life], end[life]
    ever = Bitmap.of(lc)
    places, periods, spans, counts = [], [], [], []
    for p in np.unique(a[ref]):
        refs = Bitmap.of(code[ref & (a == p)])
        touch = (born <= p) & (ended >= p)
        some = ever if p == NO_TIME else Bitmap.of(lc[touch])
        gone = refs.and_not(some).places()
        doubt = np.empty(0, np.int64)
        if p != NO_TIME:
            doubt = refs.and_(some).and_not(Bitmap.of(lc[(born < p) & (ended > p)])).places()
        part = np.flatnonzero(touch)
        lo, hi = np.searchsorted(lc[part], doubt), np.searchsorted(lc[part], doubt, side="right")
        places += [gone, doubt]
        periods.append(np.full(len(gone) + len(doubt), p, np.int32))
        counts += [np.zeros(len(gone), np.int64), hi - lo]
        spans.append(part[np.concatenate([np.arange(i, j) for i, j in zip(lo, hi)])] if len(doubt) else np.empty(0, np.int64))
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    n, at = join(counts, np.int64), join(spans, np.int64)
    offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v[at])) for v in (start, end)]
    return pa.table({"key": coded.dictionary.take(pa.array(join(places, np.int64))).cast(pa.string()), "period": join(periods, np.int32), "starts": lists[0], "ends": lists[1]})


def _month(c: Column) -> Column:
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def find_orphans(
    refs: DataFrame, parents: DataFrame, *, keys: list[str], ref_at: str, carry: list[str], born: str, ended: str | None = None, keys_per_range: int = 50_000
) -> DataFrame:
    """Rows of ``refs`` whose key names no record of ``parents`` alive at ``ref_at``.

    ``keys`` are the key columns, by the same names on both sides; ``carry`` the columns of ``refs``
    to keep. Result: carry, keys, ``period`` (months since year 0, null without a time), distinct.
    """
    spark = refs.sparkSession
    k = [F.col(c).cast("string") for c in keys]
    text = F.concat_ws("\x1f", *k)
    have = F.lit(True)
    for c in keys:
        have = have & F.col(c).isNotNull()
    r = refs.filter(have).select(
        *[F.col(c) for c in dict.fromkeys([*carry, *keys])], text.alias("__key"), F.col(ref_at).alias("__t"), F.coalesce(_month(F.col(ref_at)), F.lit(NO_TIME)).alias("__p")
    )
    start = F.coalesce(F.unix_micros(F.col(born).cast("timestamp")), F.lit(EVER))
    if ended:
        lives = parents.filter(have).select(text.alias("key"), start.alias("start"), F.coalesce(F.unix_micros(F.col(ended).cast("timestamp")), F.lit(NEVER)).alias("end")).filter("end > start").distinct()
    else:  # without an end only the first beginning counts
        lives = parents.filter(have).groupBy(text.alias("key")).agg(F.min(start).alias("start")).withColumn("end", F.lit(NEVER))
    # A month in which a life begins or ends is not wholly covered.
    lo = F.when(F.col("start") == EVER, NO_TIME).otherwise(_month(F.timestamp_micros("start")))
    hi = F.when(F.col("end") == NEVER, FAR).otherwise(_month(F.timestamp_micros("end")))
    zero = F.lit(0).cast("bigint")
    facts = r.select(F.col("__key").alias("key"), F.lit(0).alias("kind"), F.col("__p").alias("a"), F.lit(0).alias("b"), zero.alias("start"), zero.alias("end")).distinct()
    st = Staging(spark, "orphans")
    facts = st.put(facts.unionByName(lives.select("key", F.lit(1).alias("kind"), lo.alias("a"), hi.alias("b"), "start", "end")))
    ranges = parts_for(facts.count(), keys_per_range)
    ranged = facts.select(F.pmod(F.xxhash64("key"), F.lit(ranges)).alias("range_id"), "*")
    survivors = st.put(ranged.groupBy("range_id").applyInArrow(_range_survivors, SURVIVORS).select(F.col("key").alias("__key"), F.col("period").alias("__p"), "starts", "ends"))
    at = F.unix_micros(F.col("__t").cast("timestamp"))
    alive = F.exists(F.arrays_zip("starts", "ends"), lambda s: (s["starts"] <= at) & (at < s["ends"]))
    found = r.join(survivors, ["__key", "__p"]).filter((F.size("starts") == 0) | ~alive)
    out = list(dict.fromkeys([*carry, *keys]))
    period = F.when(F.col("__p") != NO_TIME, F.col("__p")).alias("period")
    return found.select(*out, period).distinct()


def period_text(months: Column) -> Column:
    """Months since year 0 as ``YYYY-MM``."""
    return F.format_string("%04d-%02d", F.floor(months / 12).cast("int"), (months % 12 + 1).cast("int"))


def orphan_report(orphans: DataFrame, table: str, field: str, period: str) -> DataFrame:
    """Orphans counted per table, field and period."""
    return orphans.groupBy(table, field, period).agg(F.count(F.lit(1)).alias("n_orphans"))
