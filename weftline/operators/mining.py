"""Association rules, minimal bases, negative rules, concepts and covers over (case, fact) tables.

Counts come from equi-joins on the case, with rare facts removed first: support is anti-monotone, so
that pruning loses no rule. Confidence is a whole percentage, cut off, as the evidence tools count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.relational import numbered, pairs_within
from weftline.session import Staging


def facts_long(df: DataFrame, case: str, columns: dict[str, str]) -> DataFrame:
    """(case_id, fact) with facts ``prefix:value``; nulls and blanks make no fact. columns: prefix -> column."""
    parts = F.array(*[F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(p + ":"), F.trim(F.col(c).cast("string")))) for p, c in columns.items()])
    return df.select(F.col(case).alias("case_id"), F.explode(parts).alias("fact")).filter("fact IS NOT NULL").distinct()


def _frequent(facts: DataFrame, least: int) -> DataFrame:
    n = facts.groupBy("fact").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least)
    return n


def rules_one(facts: DataFrame, min_support: int = 2, min_joint: int = 2) -> DataFrame:
    """antecedent -> consequent with support, joint, confidence_percent, counterexamples."""
    n = _frequent(facts, min(min_support, min_joint))
    f = facts.join(n.select("fact"), "fact", "left_semi")  # a fact of less support is in no rule
    met = pairs_within(f, ["case_id"], "fact").groupBy("fact_a", "fact_b").agg(F.count(F.lit(1)).alias("joint")).filter(F.col("joint") >= min_joint)
    way = lambda a, b: F.struct(F.col(a).alias("antecedent"), F.col(b).alias("consequent"))
    both = met.select(F.explode(F.array(way("fact_a", "fact_b"), way("fact_b", "fact_a"))).alias("r"), "joint").select("r.*", "joint")
    x = both.join(n.filter(F.col("support") >= min_support).withColumnRenamed("fact", "antecedent"), "antecedent")
    return x.select("antecedent", "consequent", "support", "joint", F.expr("joint * 100 div support").alias("confidence_percent"), (F.col("support") - F.col("joint")).alias("counterexamples"))


def rules_two(facts: DataFrame, min_support: int = 4, min_joint: int = 2) -> DataFrame:
    """Two antecedents x < y -> z.

    Facts are numbered in their order; the pairs of a case come from blocks, so that a case with very many facts is
    spread, and are staged once. Only frequent pairs meet the third fact.
    """
    st = Staging(facts.sparkSession, "rules")
    named = st.put(numbered(facts.groupBy("fact").agg(F.count(F.lit(1)).alias("support")), ["fact"], "f").select("fact", "support", F.col("f").cast("bigint").alias("f")))
    coded = st.put(facts.join(named.select("fact", "f"), "fact").select("case_id", "f"))
    often = coded.join(named.filter(F.col("support") >= min_support).select("f"), "f", "left_semi")
    pair = st.put(pairs_within(often, ["case_id"], "f").select("case_id", F.col("f_a").alias("fx"), F.col("f_b").alias("fy")))
    support = pair.groupBy("fx", "fy").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= min_support)
    z = coded.select("case_id", F.col("f").alias("fz"))
    met = pair.join(support, ["fx", "fy"]).join(z, "case_id").filter("fz <> fx AND fz <> fy")
    joint = met.groupBy("fx", "fy", "fz", "support").agg(F.count(F.lit(1)).alias("joint")).filter(F.col("joint") >= min_joint)
    name = lambda k: named.select(F.col("f").alias(f"f{k}"), F.col("fact").alias(k))
    x = joint.join(name("x"), "fx").join(name("y"), "fy").join(name("z"), "fz")
    return x.select("x", "y", "z", "support", "joint", F.expr("joint * 100 div support").alias("confidence_percent"))


def classify_rule(confidence: str, support: str, groups: str) -> F.Column:
    """UNIVERSAL, STRONG or OBSERVED."""
    c, s, g = F.col(confidence), F.col(support), F.col(groups)
    return F.when((c == 100) & (s >= 3) & (g >= 2), "UNIVERSAL").when((c >= 90) & (s >= 3), "STRONG").otherwise("OBSERVED")


def rule_basis(rules: DataFrame) -> DataFrame:
    """One rule per consequent: most support, then the least antecedent, among those without counterexample."""
    w = Window.partitionBy("consequent").orderBy(F.desc("support"), "antecedent")
    return rules.filter("counterexamples = 0").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def negative_rules(facts: DataFrame, least: int = 3) -> DataFrame:
    """Facts a < b of one prefix, each frequent, that never meet."""
    n = _frequent(facts, least).withColumn("prefix", F.substring_index("fact", ":", 1))
    a, b = n.select("prefix", F.col("fact").alias("a"), F.col("support").alias("support_a")), n.select("prefix", F.col("fact").alias("b"), F.col("support").alias("support_b"))
    f = facts.join(n.select("fact"), "fact", "left_semi")
    met = pairs_within(f, ["case_id"], "fact").select(F.col("fact_a").alias("a"), F.col("fact_b").alias("b")).distinct()
    return a.join(b, "prefix").filter("a < b").join(met, ["a", "b"], "left_anti").select("a", "b", "support_a", "support_b")


def rule_violations(basis: DataFrame, facts: DataFrame) -> DataFrame:
    """(antecedent, consequent, case_id): cases with the antecedent but not the consequent."""
    has = facts.select("case_id", F.col("fact").alias("antecedent"))
    hit = basis.select("antecedent", "consequent").join(has, "antecedent")
    return hit.join(facts.select("case_id", F.col("fact").alias("consequent")), ["case_id", "consequent"], "left_anti").select("antecedent", "consequent", "case_id")


def concept_closure(pairs: DataFrame, obj: str, attr: str) -> DataFrame:
    """Per attribute: its extent's size and its intent (attributes common to all objects that have it)."""
    p = pairs.select(F.col(obj).alias("o"), F.col(attr).alias("a")).distinct()
    size = p.groupBy("a").agg(F.count(F.lit(1)).alias("extent_size"))
    met = pairs_within(p, ["o"], "a").groupBy("a_a", "a_b").agg(F.count(F.lit(1)).alias("n"))
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = met.select(F.explode(F.array(way("a_a", "a_b"), way("a_b", "a_a"))).alias("r"), "n").select("r.*", "n")
    common = both.join(size, "a").filter("n = extent_size").select("a", "extent_size", "b").unionByName(size.select("a", "extent_size", F.col("a").alias("b")))
    return common.groupBy("a", "extent_size").agg(F.array_join(F.array_sort(F.collect_list(F.col("b").cast("string"))), ";").alias("intent"))


CHOSEN = "o bigint, n bigint, round int"


def _pieces(ptr: np.ndarray, values: np.ndarray, keys: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, the values of their lists one after another and the lists' lengths, for runs of keys that have about ``most`` values together."""
    n = (ptr[keys + 1] - ptr[keys]).astype(np.int32)
    cuts = np.flatnonzero(np.diff(np.cumsum(n, dtype=np.int64) // most, prepend=-1))
    for i, j in zip(cuts, [*cuts[1:], len(keys)], strict=False):
        k, m = keys[i:j], n[i:j]
        at = np.repeat((ptr[k] - np.cumsum(m, dtype=np.int64) + m).astype(np.int32), m)
        at += np.arange(len(at), dtype=np.int32)
        yield k, values[at], m


def _lists(key: np.ndarray, value: np.ndarray, n_keys: int, step: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """The values of each key one after another (a counting sort in steps, so that little memory is taken besides), and where each key's begin."""
    ptr = np.zeros(n_keys + 1, np.int64)
    np.cumsum(np.bincount(key, minlength=n_keys), out=ptr[1:])
    at, out = ptr[:-1].copy(), np.empty(len(value), np.int32)
    for i in range(0, len(key), step):
        k = key[i : i + step]
        order = np.argsort(k, kind="stable")
        k = k[order]
        begins = np.flatnonzero(np.diff(k, prepend=-1))
        n = np.diff(begins, append=len(k))
        out[np.repeat(at[k[begins]] - begins, n) + np.arange(len(k))] = value[i : i + step][order]
        at[k[begins]] += n
    return ptr, out


def cover_rounds(o: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(object, n_new, round) of all rounds over distinct pairs of whole numbers from 0.

    An object that is not first remembers one attribute and the object before it there; it is looked at again only when
    that attribute is covered or that object falls behind it, as its own count only falls.
    """
    n_o, n_a = int(o.max(initial=-1)) + 1, int(a.max(initial=-1)) + 1
    of_o, attrs = _lists(o, a, n_o)
    of_a, objs = _lists(a, o, n_a)
    n, open_ = np.diff(of_o).astype(np.int32), np.ones(n_a, bool)
    by_attr, by_obj = np.full(n_o, -1, np.int32), np.arange(n_o, dtype=np.int32)
    out, rounds = [], 0
    while True:
        rank = np.arange(n_o - 1, -1, -1)  # greater comes first
        rank += n.astype(np.int64) * n_o
        stale = np.flatnonzero((n > 0) & ((by_attr < 0) | ~open_[by_attr] | (rank[by_obj] <= rank)))
        if not len(stale):
            return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
        rounds += 1
        won = []
        for i in range(0, len(stale), 1 << 18):
            look, done, width = stale[i : i + (1 << 18)], 0, 4
            while len(look):  # the next few attributes of each that is not beaten yet
                size = of_o[look + 1] - of_o[look]
                take = np.minimum(size - done, width)
                who = np.repeat(np.arange(len(look)), take)
                at = attrs[np.repeat(of_o[look] + done - np.cumsum(take) + take, take) + np.arange(len(who))]
                keep = open_[at]
                who, (at, which) = who[keep], np.unique(at[keep], return_inverse=True)
                best = [np.maximum.reduceat(rank[held], np.cumsum(m) - m) for _, held, m in _pieces(of_a, objs, at)]
                first = np.concatenate(best)[which] if best else np.empty(0, np.int64)
                beaten = np.flatnonzero(first > rank[look[who]])
                by_attr[look[who[beaten]]], by_obj[look[who[beaten]]] = at[which[beaten]], n_o - 1 - first[beaten] % n_o
                alive = np.ones(len(look), bool)
                alive[who[beaten]] = False
                over = size <= done + width
                won.append(look[alive & over])
                look = look[alive & ~over]
                done, width = done + width, min(2 * width, max(1, (1 << 21) // max(1, len(look))))
        now = np.sort(np.concatenate(won))
        out.append((now, n[now], np.full(len(now), rounds)))
        for _, gone, _ in _pieces(of_o, attrs, now):
            gone = gone[open_[gone]]  # winners of a round share none
            open_[gone] = False
            for _, held, _ in _pieces(of_a, objs, gone):
                n -= np.bincount(held, minlength=n_o).astype(np.int32)


def _cover_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if parts:
        pairs = [np.concatenate([p[k] for p in parts]) for k in (0, 1)]
        del parts
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cover_rounds(*pairs), (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["o", "n", "round"])


def greedy_cover(pairs: DataFrame, obj: str, attr: str, at_once: int = 40_000_000) -> DataFrame:
    """(object, n_new, round): objects chosen greedily, most newly covered first, ties by the least object, until all is covered.

    A round chooses every object that comes before each other one it shares an uncovered attribute with: these
    choices cannot disturb each other, so the result is that of choosing one at a time. Rounds are jobs, with what is left
    staged, while more than ``at_once`` pairs are left (an object counts as three, an attribute as two); the rounds
    after that are done in one task over whole numbers, of 16 bytes a pair.
    """
    st = Staging(pairs.sparkSession, "cover")
    left = st.put(pairs.select(F.col(obj).alias("o"), F.col(attr).alias("a")).filter("o IS NOT NULL AND a IS NOT NULL").distinct())
    chosen: list[DataFrame] = []
    rounds = 0
    size = lambda *c: left.select(*c).distinct().count()
    fits = lambda: (k := left.count()) <= at_once and k + 3 * size("o") + 2 * size("a") <= at_once
    while not fits():
        rounds += 1
        n = left.groupBy("o").agg((-F.count(F.lit(1))).alias("n"))
        ranked = left.join(n, "o")
        first = ranked.groupBy("a").agg(F.min(F.struct("n", "o")).alias("f"))
        won = ranked.join(first, "a").groupBy("o").agg(F.bool_and(F.col("o") == F.col("f.o")).alias("all"), F.first("n").alias("n")).filter("all")
        now = st.put(won.select(F.col("o").alias(obj), (-F.col("n")).alias("n_new"), F.lit(rounds).alias("round")))
        chosen.append(now)
        covered = left.join(now.select(F.col(obj).alias("o")), "o", "left_semi").select("a")
        after = st.put(left.join(covered.distinct(), "a", "left_anti"))
        st.drop(left)
        left = after
        if len(chosen) > 16:  # many small tables make slow plans
            whole = st.put(reduce(DataFrame.unionByName, chosen))
            st.drop(*chosen)
            chosen = [whole]
    code = lambda c: st.put(numbered(left.select(c).distinct(), [c], "k").select(c, (F.col("k") - 1).cast("int").alias(f"{c}_k")))
    objs = code("o")
    coded = st.put(left.join(objs, "o").join(code("a"), "a").select("o_k", "a_k"))
    last = coded.coalesce(1).mapInArrow(_cover_task, CHOSEN).withColumnRenamed("o", "o_k").join(objs, "o_k")
    return reduce(DataFrame.unionByName, chosen, last.select(F.col("o").alias(obj), F.col("n").alias("n_new"), (F.col("round") + rounds).alias("round")))


def undominated(pairs: DataFrame, obj: str, attr: str) -> DataFrame:
    """Objects whose attributes are no proper part of another's; of equal ones the least object stays."""
    p = pairs.select(F.col(obj).alias("o"), F.col(attr).alias("a")).distinct()
    n = p.groupBy("o").agg(F.count(F.lit(1)).alias("n"))
    both = pairs_within(p, ["a"], "o").groupBy("o_a", "o_b").agg(F.count(F.lit(1)).alias("k"))
    x = both.join(n.select(F.col("o").alias("o_a"), F.col("n").alias("na")), "o_a").join(n.select(F.col("o").alias("o_b"), F.col("n").alias("nb")), "o_b")
    less = F.when((F.col("k") == F.col("na")) & (F.col("nb") > F.col("na")), F.col("o_a")).when(F.col("k") == F.col("nb"), F.col("o_b"))
    return n.join(x.select(less.alias("o")).filter("o IS NOT NULL").distinct(), "o", "left_anti").select(F.col("o").alias(obj))


def smallest_cover(sets: dict[str, frozenset], most_steps: int = 1_000_000) -> list[str]:
    """A smallest choice of sets that covers everything, for a table of a few hundred sets on the driver.

    Reduced first, again and again: a set that is part of another goes, an element that is held wherever another is goes, a set
    that alone holds an element is chosen. What is left is searched by branch and bound; beyond ``most_steps`` branches
    it is refused, never cut.
    """
    left = {k: set(v) for k, v in sets.items() if v}
    chosen: list[str] = []
    changed = True
    while changed and left:
        changed = False
        for k in sorted(left, key=lambda k: (len(left[k]), k), reverse=False):
            if any(left[k] < left[j] or (left[k] == left[j] and j < k) for j in left if j != k):
                del left[k]
                changed = True
        holders: dict = {}
        for k, v in left.items():
            for x in v:
                holders.setdefault(x, set()).add(k)
        keep: list = []
        for x in sorted(holders, key=lambda x: (len(holders[x]), str(x))):
            if not any(holders[y] <= holders[x] for y in keep):
                keep.append(x)
        if len(keep) < len(holders):
            changed = True
            left = {k: v & set(keep) for k, v in left.items()}
        for x in keep:
            if len(holders[x]) == 1 and (k := next(iter(holders[x]))) in left:
                chosen.append(k)
                gone = left.pop(k)
                left = {j: v - gone for j, v in left.items()}
                changed = True
        left = {k: v for k, v in left.items() if v}
    return sorted([*chosen, *_searched({k: frozenset(v) for k, v in left.items()}, most_steps)])


def _searched(sets: dict[str, frozenset], most_steps: int) -> list[str]:
    every = frozenset().union(*sets.values()) if sets else frozenset()
    best: list[str] = []
    todo = set(every)
    while todo:  # greedy upper bound
        k = min(sets, key=lambda k: (-len(sets[k] & todo), k))
        best.append(k)
        todo -= sets[k]
    steps = 0

    def go(open_: frozenset, chosen: list[str]) -> None:
        nonlocal best, steps
        steps += 1
        if steps > most_steps:
            raise RuntimeError("smallest_cover: too many branches")
        if not open_:
            best = list(chosen) if len(chosen) < len(best) else best
            return
        widest = max(len(s & open_) for s in sets.values())
        if len(chosen) + -(-len(open_) // widest) >= len(best):
            return
        rare = min(open_, key=lambda x: (sum(x in s for s in sets.values()), str(x)))
        for k in sorted((k for k, s in sets.items() if rare in s), key=lambda k: (-len(sets[k] & open_), k)):
            go(open_ - sets[k], [*chosen, k])

    go(every, [])
    return best


def rectangles(cells: set[tuple[str, str]]) -> dict[str, frozenset]:
    """The maximal rectangles of a 0/1 matrix: rows that share columns, with all the columns they share."""
    rows: dict[str, set[str]] = {}
    for i, j in cells:
        rows.setdefault(i, set()).add(j)
    intents = {frozenset(c) for c in rows.values()}
    grown = set(intents)
    while grown:
        grown = {a & b for a in grown for b in intents} - intents - {frozenset()}
        intents |= grown
    out = {}
    for c in intents:
        extent = sorted(i for i, have in rows.items() if c <= have)
        out[f"{','.join(extent)} x {','.join(sorted(c))}"] = frozenset((i, j) for i in extent for j in c)
    return out


def rectangle_cover(cells: DataFrame, row: str, col: str) -> DataFrame:
    """(rectangle, n_cells): fewest full rectangles that cover a 0/1 matrix, exactly.

    Rows with equal columns and columns with equal rows are one first; what is left, a few hundred cells at most, is solved on
    the driver.
    """
    spark = cells.sparkSession
    p = cells.select(F.col(row).cast("string").alias("i"), F.col(col).cast("string").alias("j")).filter("i IS NOT NULL AND j IS NOT NULL").distinct()
    for a, b in (("i", "j"), ("j", "i")):
        sig = p.groupBy(a).agg(F.bit_xor(F.xxhash64(b)).alias("x"), F.bit_xor(F.xxhash64(b, F.lit(1))).alias("y"), F.count(F.lit(1)).alias("n"))
        first = sig.groupBy("x", "y", "n").agg(F.min(a).alias(a))
        p = p.join(first.select(a), a, "left_semi")
    few = {(r["i"], r["j"]) for r in p.limit(MOST_CELLS + 1).collect()}
    if len(few) > MOST_CELLS:
        raise ValueError("rectangle_cover: too many different rows and columns")
    found = rectangles(few)
    return spark.createDataFrame([(k, len(found[k])) for k in smallest_cover(found)], "rectangle string, n_cells int")


MOST_CELLS = 2000


def strongest_rules(rules: DataFrame) -> DataFrame:
    """Of rules with the same antecedent and consequent, the one of most support, then most joint."""
    rest = [c for c in rules.columns if c not in ("antecedent", "consequent")]
    best = rules.groupBy("antecedent", "consequent").agg(F.max(F.struct("support", "joint", *[c for c in rest if c not in ("support", "joint")])).alias("b"))
    return best.select("antecedent", "consequent", *[F.col(f"b.{c}").alias(c) for c in rest])
