"""Several values packed in one field: one value per row, with its place.

The dialect of each text (which characters separate, which quote, whether brackets wrap the list) is
chosen by minimum description length. A parse costs the bits of its dialect and the code lengths of its
values; both codes are learned from the whole table, by counts that the executors sum:

1. spelling a value costs the code lengths of its characters and of its end, by what values that are
   quoted and values that are not hold. The characters that separate, quote or wrap are counted apart, so
   a separator left inside a value that is not quoted costs what its rarity there says. First the
   counts come from texts that can be read in one way only, then once more from the parses chosen by
   them;
2. naming a value that was found before costs -log2 of its share and its part of spelling it once. This
   can only turn a choice where a parse that lost holds a known value with such a character in it; those
   texts, and only those, are joined to the counts of all values and chosen anew;
3. each text is read by its cheapest parse, ties by the simpler dialect.

Texts are parsed where they lie: rows are shuffled once, to find each row's latest delivery.

Defined results
* null, blank and bracket-only texts hold no values; empty pieces (quoted ones too) are no values
  and take no place; repeated values count each; positions count from 1;
* a doubled quote inside quotes stands for one; an opening quote that never closes is ordinary text;
* white space outside quotes is trimmed; inside quotes outer white space is trimmed too;
* a text that occurs again in a batch is not parsed again; each row weighs as one in the counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import Staging

#: Characters that may separate, and that may quote.
SEPARATORS = (";", "；", ",", "|", "\n", "\t")
QUOTES = ('"', "'")
BRACKETS = ("[", "]")
MARK = re.compile(r"[;；,|\n\t\"'\[\]]|\s")
#: Classes of characters that the code tells apart: the marks, white space, any other, and the end of a value.
BLANK, OTHER, END = " ", "x", "end"
CLASSES = (*SEPARATORS, *QUOTES, *BRACKETS, BLANK, OTHER, END)
#: Prior counts: before anything is counted, values are mostly made of other characters, and quotes are there
#: for the sake of separators and white space.
PRIOR = {OTHER: 100.0, END: 20.0}
QUOTED_PRIOR = dict.fromkeys((*SEPARATORS, BLANK), 8.0) | PRIOR
LEAST_PRIOR = 0.5
OTHER_BITS = 5.0  # to tell which of the other characters it is


@dataclass(frozen=True)
class Dialect:
    separators: frozenset[str]
    quotes: frozenset[str]
    blank_separates: bool
    brackets: bool

    @property
    def bits(self) -> float:
        return 2.0 * len(self.separators) + 1.0 * len(self.quotes) + 2.0 * self.blank_separates + 1.0 * self.brackets


def dialects_for(text: str, atomic: bool = False) -> list[Dialect]:
    """Dialects made only of characters the text has: each separator alone, and all of them; the same for quotes.

    White space separates only where values are ``atomic``; elsewhere it may belong to a name.
    """
    seps = [c for c in SEPARATORS if c in text]
    seps = sorted(seps, key=lambda c: (-text.count(c), c))
    sets = [frozenset[str]()] + [frozenset(seps[:k]) for k in range(1, len(seps) + 1)] + [frozenset(c) for c in seps[1:]]
    quotes = [frozenset[str]()] + [frozenset(q) for q in QUOTES if q in text] + ([frozenset(QUOTES)] if all(q in text for q in QUOTES) else [])
    blanks = (False, True) if atomic and re.search(r"\s", text.strip()) else (False,)
    t = text.strip()
    wraps = (False, True) if t[:1] == "[" and t[-1:] == "]" else (False,)
    return sorted({Dialect(s, q, b, w) for s in sets for q in quotes for b in blanks for w in wraps}, key=lambda d: (d.bits, sorted(d.separators), sorted(d.quotes)))


@lru_cache(maxsize=1024)
def _splitter(d: Dialect) -> re.Pattern:
    return re.compile("|".join([*map(re.escape, sorted(d.separators)), *([r"\s"] if d.blank_separates else [])]) or r"(?!)")


def parse(text: str, d: Dialect) -> list[tuple[str, bool]]:
    """The values of a text under a dialect, each with whether it was quoted."""
    t = text.strip()
    if d.brackets:
        t = t[1:-1]
    if not d.quotes:
        return [(v, False) for x in _splitter(d).split(t) if (v := x.strip())]
    out: list[tuple[str, bool]] = []
    i, n = 0, len(t)
    while i < n:
        while i < n and (t[i] in d.separators or t[i].isspace()):
            i += 1
        if i >= n:
            break
        if t[i] in d.quotes:
            value, after = _quoted(t, i, d)
            if after >= 0:
                if value.strip():
                    out.append((value.strip(), True))
                i = after
                continue
        j = i
        while j < n and t[j] not in d.separators and not (d.blank_separates and t[j].isspace()):
            j += 1
        if v := t[i:j].strip():
            out.append((v, False))
        i = j
    return out


def _quoted(t: str, i: int, d: Dialect) -> tuple[str, int]:
    """Value and the place after it; the place is -1 if the quote does not close before a separator or the end."""
    q, j, n = t[i], i + 1, len(t)
    got = []
    while j < n:
        if t[j] != q:
            got.append(t[j])
            j += 1
        elif j + 1 < n and t[j + 1] == q:
            got.append(q)
            j += 2
        else:
            k = j + 1
            while k < n and t[k].isspace() and t[k] not in d.separators:
                k += 1
            if k >= n or t[k] in d.separators or (d.blank_separates and k > j + 1):
                return "".join(got), k
            return "", -1
    return "", -1


class Code:
    """Code lengths of values from counts of classes of characters, for values that are quoted and for those that are not."""

    def __init__(self, counts: dict[tuple[bool, str], float] | None = None) -> None:
        self.bits: dict[bool, dict[str, float]] = {}
        for quoted, prior in ((False, PRIOR), (True, QUOTED_PRIOR)):
            n = {k: prior.get(k, LEAST_PRIOR) + (counts or {}).get((quoted, k), 0.0) for k in CLASSES}
            whole = sum(n.values())
            self.bits[quoted] = {k: -math.log2(v / whole) + (OTHER_BITS if k == OTHER else 0.0) for k, v in n.items()}

    def spell(self, value: str, quoted: bool) -> float:
        b = self.bits[quoted]
        marks = MARK.findall(value)
        return b[END] + (len(value) - len(marks)) * b[OTHER] + sum(b.get(m, b[BLANK]) for m in marks)


def parses(text: str, atomic: bool = False, code: Code | None = None) -> list[tuple[float, list[str], list[bool], float]]:
    """Different parses of a text, cheapest first: (bits, values, which are quoted, bits of the dialect alone).

    Each parse has its cheapest dialect; ties go to the simpler dialect.
    """
    spell = (code or Code()).spell
    if not MARK.search(text):
        return [(spell(text, False), [text], [False], 0.0)]
    best: dict[tuple[str, ...], tuple[float, list[bool]]] = {}
    for d in dialects_for(text, atomic):
        values = parse(text, d)
        key = tuple(v for v, _ in values)
        if key not in best or d.bits < best[key][0]:
            best[key] = (d.bits, [q for _, q in values])
    found = [(bits + sum(map(spell, k, q)), list(k), q, bits) for k, (bits, q) in best.items()]
    return sorted(found, key=lambda x: (round(x[0], 6), x[3], x[1]))


def _key(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) - 2**63


COUNTED = "quoted boolean, kind string, n double"


def _counter(atomic: bool, code: Code):  # noqa: ANN202
    """texts -> how often each class of characters stands in the values of the chosen parses, once per partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for text, times in Counter(t for t in b.column(0).to_pylist() if t).items():
                _, values, quoted, _ = parses(text, atomic, code)[0]
                for v, q in zip(values, quoted):
                    marks = MARK.findall(v)
                    n[q, END] += times
                    n[q, OTHER] += times * (len(v) - len(marks))
                    for m in marks:
                        n[q, m if m in CLASSES else BLANK] += times
        cols = [[q for q, _ in n], [k for _, k in n], [float(v) for v in n.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.bool_(), pa.string(), pa.float64()))], ["quoted", "kind", "n"])

    return run


READ = "items array<string>, kept array<bigint>, odd array<bigint>"


def _reader(carried: int, names: list[str], atomic: bool, code: Code):  # noqa: ANN202
    """carried columns and a text -> the cheapest parse; ``kept`` are its values with marks, ``odd`` those of other parses, as hashes."""

    def read(text: str | None) -> tuple[list[str], list[int], list[int]]:
        first, *rest = parses(text, atomic, code) if text else [(0.0, [], [], 0.0)]
        mine = {v for v in first[1] if MARK.search(v)}
        other = {v for p in rest for v in p[1] if MARK.search(v)} - mine
        return first[1], sorted(map(_key, mine)), sorted(map(_key, other))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict = {}
            cols: tuple[list, list, list] = ([], [], [])
            for t in b.column(carried).to_pylist():
                if t not in known:
                    known[t] = read(t)
                for c, v in zip(cols, known[t]):
                    c.append(v)
            kinds = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(carried)), *(pa.array(c, k) for c, k in zip(cols, kinds))], [*names, "items", "kept", "odd"])

    return run


OPEN = "row_id bigint, parse_no int, base double, items array<string>, spelled array<double>"


def _all_parses(atomic: bool, code: Code):  # noqa: ANN202
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, p[3], p[1], [code.spell(v, q) for v, q in zip(p[1], p[2])]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, p in enumerate(parses(t, atomic, code))]
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["row_id", "parse_no", "base", "items", "spelled"])

    return run


def learn_code(texts: DataFrame, atomic: bool = False) -> Code:
    """The code of a column ``text``, from counts over all rows: plain texts first, then the parses these choose."""
    plain = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    one_way = ~plain.rlike("[;；,|\n\t\"'\\[\\]]") & (plain != "")
    blanks = F.length(plain) - F.length(F.regexp_replace(plain, r"\s", ""))
    if atomic:
        one_way = one_way & (blanks == 0)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    n, blank, every = texts.filter(one_way).agg(F.count(F.lit(1)).cast("double"), zero(blanks), zero(F.length(plain))).first()
    first = Code({(False, END): n, (False, BLANK): blank, (False, OTHER): every - blank})
    counted = texts.select("text").mapInArrow(_counter(atomic, first), COUNTED).groupBy("quoted", "kind").agg(F.sum("n").alias("n"))
    return Code({(r["quoted"], r["kind"]): r["n"] for r in counted.collect()})  # a row per class of characters


def _named(read: DataFrame, rows: DataFrame, code: Code, atomic: bool, st: Staging) -> DataFrame:
    """(row_id, items) of the rows where naming known values may turn the choice."""
    kept = read.select(F.explode("kept").alias("h")).distinct()
    doubtful = read.select("row_id", F.explode("odd").alias("h")).join(kept, "h", "left_semi").select("row_id").distinct()
    texts = rows.select("row_id", "text").join(doubtful, "row_id", "left_semi")
    every = st.put(texts.mapInArrow(_all_parses(atomic, code), OPEN))
    part = every.select("row_id", "parse_no", F.explode(F.arrays_zip("items", "spelled")).alias("v")).select("row_id", "parse_no", F.col("v.items").alias("item"), "v.spelled")
    seen = read.select(F.explode("items").alias("item"))
    total = seen.count()
    counts = seen.join(part.select("item").distinct(), "item", "left_semi").groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    by_name: Column = -F.log2(F.col("c") / F.lit(float(max(total, 1)))) + F.col("spelled") / F.col("c")
    bits = part.join(counts, "item", "left").groupBy("row_id", "parse_no").agg(F.sum(F.least("spelled", by_name)).alias("bits"))
    cost = every.join(bits, ["row_id", "parse_no"], "left").withColumn("cost", F.round(F.col("base") + F.coalesce("bits", F.lit(0.0)), 6))
    return cost.groupBy("row_id").agg(F.min_by("items", F.struct("cost", "base", "parse_no")).alias("items"))


def split_packed(df: DataFrame, row_id: str, field: str, at: str, atomic: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One value per row: (row_id, carried columns, pos, item), each once however often the row was delivered.

    Of a row delivered more than once the latest by ``at`` counts, ties by the greater text.
    ``atomic`` says that values hold no white space.
    """
    best = F.max(F.struct(F.col(at), F.col(field).alias("text"), *[F.col(c) for c in carry if c != at])).alias("b")
    one = df.filter(F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("row_id")).agg(best)
    st = Staging(df.sparkSession, "packed")
    rows = st.put(one.select("row_id", *[F.col("b")[c].alias(c) for c in carry], "b.text").filter(F.col("text").rlike(r"\S")))
    code = learn_code(rows, atomic)
    names = ["row_id", *carry]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    read = st.put(rows.mapInArrow(_reader(len(names), names, atomic, code), f"{kinds}, {READ}"))
    again = st.put(_named(read, rows.withColumn("row_id", F.col("row_id").cast("bigint")), code, atomic, st)) if read.filter(F.size("odd") > 0).limit(1).count() else None
    st.drop(rows)
    if again is not None and again.limit(1).count():
        turned = again.withColumnRenamed("items", "named")
        read = read.join(turned, "row_id", "left").withColumn("items", F.coalesce("named", "items"))
    return read.select(*names, F.posexplode("items").alias("p", "item")).select(*names, (F.col("p") + 1).cast("int").alias("pos"), "item")
