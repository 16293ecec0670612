"""Mixing sources to target weights by entropy balancing.

For each mix and source the documents' rates are those nearest to one use each (in relative
entropy) whose tokens add up to the source's share of the mix and that stay at or below the
number of repeats allowed. The convex dual has one multiplier per mix and source:

    rate(document) = min(max_repeats, exp(multiplier * tokens / mean tokens of the source))

1. Texts that occur more than once are one text, so no text is used more often than allowed; a text
   of several of a mix's sources counts for the smallest of them (ties by name), under its lowest id.
2. The size of a mix is the largest at which every source can still give its share:
   min over sources of max_repeats * tokens / share. A source without documents can give nothing:
   it is reported with 0 reached, and the other shares keep their proportions.
3. Newton iterations, safeguarded by bisection, run over the histogram (source, tokens of a text):
   each is one distributed aggregation that returns one row per mix and source.
4. Rates become copies: the whole part, and one more for the texts whose hash lies below their
   fraction plus a shift; two passes of bucketed sums set the shift, and further uses of texts that
   may still be repeated close what is missing, until none fits.

Defined results
* names are compared without case, outer blanks, and with blanks and hyphens as underscores;
  a null source belongs to no mix; the same source twice in a mix adds up, with the least repeats;
* a share of 0 or less takes nothing; max_repeats below 1 or null takes nothing;
* null and empty texts have no tokens and are never chosen; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.session import Staging

ROUNDS = 60
BUCKETS = 4096
CLOSE = 1e-9


def source_key(c: Column) -> Column:
    """A source name without regard to case, outer blanks and kind of separator; blank is null."""
    t = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    return F.nullif(F.regexp_replace(t, r"[\s_\-]+", "_"), F.lit(""))


def _hash_unit(*cols: Column) -> Column:
    """A number in [0, 1) from the columns' hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(2**52)) / F.lit(float(2**52))


MIXED = "mix_id, source_key, doc_id, n_tokens, rate, copies"


class Mixer:
    """One run: the usable texts of every mix, the multipliers and the copies."""

    def __init__(self, spark: SparkSession, sized: DataFrame, targets: list[tuple[int, str, float, int]]) -> None:
        """``sized``: doc_id, source_key, text_hash, n_tokens. ``targets``: the collected, normalised mix rows."""
        self.spark, self.st = spark, Staging(spark, "mix")
        self.targets = targets
        wanted = [t for t in targets if t[2] > 0 and t[3] >= 1]
        t = spark.createDataFrame(wanted, "mix_id int, source_key string, share double, most int")
        usable = sized.filter("n_tokens > 0").join(F.broadcast(t.select("source_key").distinct()), "source_key", "left_semi")
        supply = usable.groupBy("source_key").agg(F.sum("n_tokens").alias("supply"))  # one row per named source
        pool = usable.join(F.broadcast(supply), "source_key").join(F.broadcast(t), "source_key")
        one = pool.groupBy("mix_id", "text_hash").agg(F.min(F.struct("supply", "source_key", "doc_id", "n_tokens")).alias("b"))
        self.pool = self.st.put(one.select("mix_id", "text_hash", "b.source_key", "b.doc_id", "b.n_tokens"))
        self.hist = self.st.put(self.pool.groupBy("mix_id", "source_key", "n_tokens").agg(F.count(F.lit(1)).alias("c")))
        self.have = {(r[0], r[1]): (r[2], r[3]) for r in self.hist.groupBy("mix_id", "source_key").agg(F.sum(F.col("n_tokens") * F.col("c")), F.sum("c")).collect()}
        self.goal: dict[tuple[int, str], float] = {}
        self.most = {(m, s): k for m, s, _, k in wanted}
        for mix in {m for m, *_ in wanted}:
            rows = [(s, share, k) for m, s, share, k in wanted if m == mix and (m, s) in self.have]
            if rows:
                whole = sum(share for _, share, _ in rows)
                total = min(k * self.have[mix, s][0] / (share / whole) for s, share, k in rows)
                self.goal.update({(mix, s): total * share / whole for s, share, _ in rows})
        self.multiplier = self._solve()

    def _frame(self, rows: Iterable[tuple], ddl: str) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(list(rows), f"mix_id int, source_key string, {ddl}"))

    def _solve(self) -> dict[tuple[int, str], float]:
        mean = {k: v[0] / v[1] for k, v in self.have.items()}
        at: dict[tuple[int, str], float] = {}
        low, high, open_ = {}, {}, {}
        for k, a in self.goal.items():
            if a >= self.most[k] * self.have[k][0] * (1 - CLOSE):
                at[k] = math.inf  # every text as often as allowed
            else:
                # Where texts are of one size this is the solution already.
                low[k], high[k], open_[k] = -200.0, 200.0, min(max(math.log(a / self.have[k][0]), -199.0), 199.0)
        for _ in range(ROUNDS):
            if not open_:
                break
            f = self._frame([(*k, v, float(self.most[k]), mean[k]) for k, v in open_.items()], "m double, most double, mean double")
            x = self.hist.join(f, ["mix_id", "source_key"])
            z = F.col("m") * F.col("n_tokens") / F.col("mean")
            capped = z >= F.log("most")
            r = F.when(capped, F.col("most")).otherwise(F.exp(F.least(z, F.log("most"))))
            got = x.groupBy("mix_id", "source_key").agg(F.sum(F.col("c") * F.col("n_tokens") * r).alias("g"), F.sum(F.when(~capped, F.col("c") * F.col("n_tokens") * F.col("n_tokens") / F.col("mean") * r).otherwise(0.0)).alias("h"))
            for row in got.collect():
                k = (row[0], row[1])
                miss = row[2] - self.goal[k]
                if abs(miss) <= CLOSE * self.goal[k] or high[k] - low[k] < 1e-13:
                    at[k] = open_.pop(k)
                    continue
                (high if miss > 0 else low)[k] = open_[k]
                step = open_[k] - miss / row[3] if row[3] > 0 else math.nan
                open_[k] = step if low[k] < step < high[k] else (low[k] + high[k]) / 2
        return at | open_

    def copies(self) -> DataFrame:
        """(mix_id, source_key, doc_id, n_tokens, rate, copies) of the texts used at least once."""
        rows = [(*k, min(max(m, -1e300), 1e300), float(self.most[k]), self.have[k][0] / self.have[k][1]) for k, m in self.multiplier.items()]
        x = self.pool.join(self._frame(rows, "m double, most double, mean double"), ["mix_id", "source_key"])
        z = F.col("m") * F.col("n_tokens") / F.col("mean")
        rate = F.when(z >= F.log("most"), F.col("most")).otherwise(F.exp(F.least(z, F.log("most"))))
        x = x.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("int"))
        v = _hash_unit(F.col("text_hash"), F.col("mix_id")) - (F.col("rate") - F.col("whole"))
        x = self.st.put(x.withColumn("v", F.when(F.col("whole") < F.col("most"), v)).select("mix_id", "source_key", "doc_id", "n_tokens", "rate", "whole", "v", F.col("most").cast("int").alias("most")))
        base = {(r[0], r[1]): r[2] for r in x.groupBy("mix_id", "source_key").agg(F.sum(F.col("n_tokens") * F.col("whole"))).collect()}
        span = dict.fromkeys(base, (-1.0, 1.0))
        below = dict(base)
        for _ in range(2):
            f = self._frame([(*k, lo, hi) for k, (lo, hi) in span.items()], "lo double, hi double")
            inside = x.join(f, ["mix_id", "source_key"]).filter((F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi")))
            bucket = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS).cast("int")
            sums: dict[tuple[int, str], list[tuple[int, int]]] = {}
            for r in inside.groupBy("mix_id", "source_key", bucket.alias("b")).agg(F.sum("n_tokens").alias("t")).collect():  # at most BUCKETS rows per mix and source
                sums.setdefault((r[0], r[1]), []).append((r[2], r[3]))
            for k, (lo, hi) in span.items():
                edge = (hi - lo) / BUCKETS
                stop = hi
                for b, t in sorted(sums.get(k, [])):
                    if below[k] + t > self.goal[k]:
                        stop = lo + b * edge
                        break
                    below[k] += t
                span[k] = (stop, stop + edge)
        cut = self._frame([(*k, s[0]) for k, s in span.items()], "cut double")
        y = x.join(cut, ["mix_id", "source_key"])
        uses = F.col("whole") + F.when(F.col("v") < F.col("cut"), 1).otherwise(0)
        y = y.withColumn("uses", uses).withColumn("spare", F.col("most") - F.col("uses"))
        y = y.join(self._frame(self._fill(y.filter("spare > 0"), below), "doc_id bigint, more int"), ["mix_id", "source_key", "doc_id"], "left")
        n = (F.col("uses") + F.coalesce("more", F.lit(0))).alias("copies")
        return y.select("mix_id", "source_key", "doc_id", "n_tokens", "rate", n).filter("copies > 0")

    def _fill(self, spare: DataFrame, below: dict[tuple[int, str], int]) -> list[tuple[int, str, int, int]]:
        """Further uses (mix, source, document, how many) that close what is still missing: the largest texts that
        fit first, each as often as it may still be used, until no usable text fits.

        What is missing is less than one bucket of texts, so only sizes up to that come to the driver: a row per
        mix, source and size, then as many documents as the chosen sizes need.
        """
        gap = {k: int(self.goal[k] - b) for k, b in below.items() if k in self.goal and self.goal[k] - b >= 1}
        if not gap:
            return []
        small = spare.join(self._frame([(*k, v) for k, v in gap.items()], "gap bigint"), ["mix_id", "source_key"]).filter(F.col("n_tokens") <= F.col("gap"))
        sizes: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for r in small.groupBy("mix_id", "source_key", "n_tokens").agg(F.sum("spare").alias("k")).collect():
            sizes.setdefault((r[0], r[1]), []).append((r[2], r[3]))
        want: dict[tuple[int, str, int], int] = {}
        for k, found in sizes.items():
            left = gap[k]
            for size, most in sorted(found, reverse=True):
                if n := min(most, left // size):
                    want[(*k, size)] = n
                    left -= n * size
        if not want:
            return []
        need = self._frame([(*k, n) for k, n in want.items()], "n_tokens bigint, need int")
        w = Window.partitionBy("mix_id", "source_key", "n_tokens").orderBy("doc_id")
        # As many documents of a size as uses are needed are enough, so groups are cut before they are shuffled.
        first = small.join(need, ["mix_id", "source_key", "n_tokens"]).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.lit(max(want.values())))
        late: list[tuple[int, str, int, int]] = []
        for r in first.select("mix_id", "source_key", "n_tokens", "doc_id", "spare").orderBy("mix_id", "source_key", "n_tokens", "doc_id").collect():
            k = (r[0], r[1], r[2])
            if n := min(want[k], r[4]):
                late.append((r[0], r[1], r[3], n))
                want[k] -= n
        return late

    def report(self, copies: DataFrame) -> DataFrame:
        """Every row of every mix: target share (of 1), reached share, tokens and most uses of a text."""
        whole: dict[int, float] = {}
        for m, _, share, _ in self.targets:
            whole[m] = whole.get(m, 0.0) + max(share, 0.0)
        t = self._frame([(m, s, max(share, 0.0) / whole[m] if whole[m] else 0.0, int(k)) for m, s, share, k in self.targets], "target_share double, max_repeats int")
        used = copies.groupBy("mix_id", "source_key").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.count(F.lit(1)).alias("n_texts"), F.max("copies").alias("most_copies"))
        total = used.groupBy("mix_id").agg(F.sum("n_tokens").alias("all_tokens"))
        x = t.join(used, ["mix_id", "source_key"], "left").join(total, "mix_id", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        return x.select("mix_id", "source_key", "target_share", "max_repeats", zero("n_tokens"), zero("n_texts"), zero("most_copies"), F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"))


def mixer(docs: DataFrame, targets: DataFrame, *, doc_id: str, source: str, text_hash: str, n_tokens: str, mix_id: str, source_name: str, share: str, repeats: str) -> Mixer:
    """Set up a run. ``targets`` is collected: one row per mix and source, a bounded table."""
    rows = (
        targets.select(F.col(mix_id).cast("int").alias("m"), source_key(F.col(source_name)).alias("s"), F.coalesce(F.col(share), F.lit(0.0)).alias("w"), F.coalesce(F.col(repeats), F.lit(0)).alias("k"))
        .filter("m IS NOT NULL AND s IS NOT NULL")
        .groupBy("m", "s")
        .agg(F.sum("w"), F.min("k"))
        .collect()
    )
    sized = docs.select(F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("source_key"), F.col(text_hash).alias("text_hash"), F.col(n_tokens).alias("n_tokens")).filter("source_key IS NOT NULL")
    return Mixer(docs.sparkSession, sized, [(r[0], r[1], float(r[2]), int(r[3])) for r in rows])
