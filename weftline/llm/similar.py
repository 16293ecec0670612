"""All similar pairs between set-valued records, by multi-index binary sketches.

1. Each record's set is its distinct, trimmed, non-blank values. One pass over the records turns values
   into 64-bit hashes; sets are packed arrays of them from then on, and texts are not read again.
   Equal sets form one class, told apart by 128 bits.
2. Values that only one class holds cannot be shared. A class keeps its other values (its core) and the
   number of those. A core that cannot reach the threshold with any partner is set aside; this test is
   exact. Classes with the same core are sketched once, whoever holds them.
3. One-bit minhashes: for each of m * b hash functions, one bit of the least hash over the core.
   Bits of two sets agree with probability (1 + J) / 2. They are packed into a code of m segments.
4. Pigeonhole join: two cores are candidates if they agree in a whole segment. b follows the number
   of cores; m is set so that a pair at the threshold is missed with probability ``miss`` at most.
   A further short code drops candidates beyond a Hamming radius set from the same binomial law.
5. Candidates are verified on the original sets (value by value, as hashes: a pair is counted wrongly only
   if two different values of its two sets share 64 bits), then expanded to classes by their numbers of
   unshared values, and to records.

The join never pairs records of equal sets or of equal cores: those pairs follow from the counts.
``members`` and ``class_pairs`` are the compact result; ``record_pairs`` expands it.

Words and index entries travel as packed arrays, a row per batch and range of the key, reduced within the
batch first. What one range holds in memory is bounded: by distinct hashes per batch for words, and for
the index by the cores that agree in one segment; among more than ``HOT`` of those the pairs are cut into
pairs of blocks and spread over all executors.

Defined results
* null and empty lists, null and blank members hold no value; sets below ``min_size`` have no pairs;
* repeated deliveries: the latest counts, ties by the hash of the set; a null id is no record;
* similarity is shared / union, compared exactly as integers;
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.relational import pairs_within
from weftline.session import Staging, parts_for

#: Fixed value: white space.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS_PER_RANGE = 1_000_000
ENTRIES_PER_RANGE = 500_000
HOT = 1000  # cores that agree in a segment, beyond which their pairs are shared out

Batches = Iterable[pa.RecordBatch]
Step = Callable[[Batches], Iterator[pa.RecordBatch]]


def segments_for(n: int, num: int, den: int, miss: float) -> tuple[int, int]:
    """Bits per segment and segments for n cores.

    Rows of the index grow by a quarter a bit while comparisons within buckets, and with them unrelated
    candidates, halve: the sum is least where a bucket holds some fifteen unrelated cores.
    """
    b = int(min(30, max(8, math.ceil(math.log2(max(n, 2))) - 4)))
    agree = (1 + num / den) / 2
    return b, math.ceil(math.log(miss) / math.log1p(-(agree**b)))


def radius_for(bits: int, num: int, den: int, miss: float) -> int:
    """The least Hamming radius that a pair at the threshold exceeds with probability ``miss`` at most."""
    p = (1 - num / den) / 2
    tail, r = 1.0, -1
    while tail > miss and r < bits:
        r += 1
        tail -= math.comb(bits, r) * p**r * (1 - p) ** (bits - r)
    return r


def _multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(seed)
    return g.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), g.integers(0, 2**32, n, dtype=np.uint32)


def minhash_bits(values: np.ndarray, starts: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """One-bit minhashes: row per set, column per hash function. ``values`` are 64-bit hashes, ``starts`` where each set begins."""
    v = values.astype(np.uint64)
    v = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (v >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.empty((len(starts), len(mult)), np.uint8)
    for c in range(0, len(mult), 16):
        h = x * mult[None, c : c + 16]
        h += add[None, c : c + 16]
        h ^= h >> np.uint32(15)
        least = np.minimum.reduceat(h, starts, axis=0)
        out[:, c : c + 16] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(20)) & np.uint32(1)
    return out


# ---------------------------------------------------------------- packed arrays


def _packed(counts: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary column: row i holds the next ``counts[i]`` members of ``data``."""
    offsets = np.r_[0, np.cumsum(counts * data.itemsize)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _unpacked(col: pa.Array | pa.ChunkedArray, kind: type | np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Members of all rows of a binary column, and how many each row has."""
    kind = np.dtype(kind)
    parts = col.chunks if isinstance(col, pa.ChunkedArray) else [col]
    sizes = [pc.binary_length(p).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // kind.itemsize for p in parts]
    found = [np.frombuffer(b"".join(x for x in p.to_pylist() if x), kind) if p.null_count else _values(p, kind) for p in parts]
    return np.concatenate([np.empty(0, kind), *found]), np.concatenate([np.empty(0, np.int64), *sizes])


def _values(p: pa.Array, kind: np.dtype) -> np.ndarray:
    offsets = np.frombuffer(p.buffers()[1], np.int32)[p.offset : p.offset + len(p) + 1] if len(p) else np.zeros(1, np.int32)
    return np.frombuffer(p.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind) if offsets[-1] > offsets[0] else np.empty(0, kind)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = x ^ np.uint64(k)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _identity(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each of n sets, whatever the order of its values; ``owner`` ascends."""
    out = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    if len(owner):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        for o, k in zip(out, (0x243F6A8885A308D3, 0x13198A2E03707344)):
            o[owner[first]] = np.add.reduceat(_mix(values, k), first)
    return out[0], out[1]


def _cut(target: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(target, arrays' members of it) for each target that occurs."""
    order = np.argsort(target, kind="stable")
    t = target[order]
    at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.empty(0, np.int64)
    for i, j in zip(at, np.r_[at[1:], len(t)]):
        yield int(t[i]), *(a[order[i:j]] for a in arrays)


def _distinct(*keys: np.ndarray) -> np.ndarray:
    """Places of the first of each different key, in key order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order[new]


# ---------------------------------------------------------------- records to sets of hashes

SETS = "n int, k1 bigint, k2 bigint, hs binary"


def _hasher(fields: list[str], least: int) -> Step:
    """field, record, at, list -> the same with the list as a sorted set of hashes and its identity."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for no, name in enumerate(fields):
                b = whole.filter(pc.equal(whole.column(0), name))
                if not b.num_rows:
                    continue
                coded = pc.utf8_trim(b.column(3).flatten(), characters=BLANKS).dictionary_encode()
                words = coded.dictionary.to_pylist()
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, no) for w in words), np.uint64, len(words))
                filled = np.fromiter(map(bool, words), np.bool_, len(words))
                code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                owner = pc.list_parent_indices(b.column(3)).to_numpy(zero_copy_only=False).astype(np.int64)
                ok = code >= 0
                ok[ok] = filled[code[ok]]
                owner, h = owner[ok], hashes[code[ok]]
                at = _distinct(owner, h)
                owner, h = owner[at], h[at]
                n = np.bincount(owner, minlength=b.num_rows)
                small = n < least
                k1, k2 = _identity(h, owner, b.num_rows)
                h = h[~small[owner]]
                keys = [pa.array(k.view(np.int64), mask=small) for k in (k1, k2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n.astype(np.int32)), *keys, _packed(np.where(small, 0, n), h)], ["field", "record", "at", "n", "k1", "k2", "hs"])

    return run


# ---------------------------------------------------------------- values that only one class holds

PACKED = "part int, field string, a binary, b binary, c binary, d binary"


def _packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (part, field or None, up to four arrays) in the columns of ``PACKED``."""
    cols = list(zip(*[(p, f, *(x.tobytes() for x in arrays), *[None] * (4 - len(arrays))) for p, f, *arrays in rows])) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.string(), *[pa.binary()] * 4))], ["part", "field", "a", "b", "c", "d"])


def _word_ranges(parts: int) -> Step:
    """k1, hs -> values with the least and the greatest class that holds them in the batch, by range of the value."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = _unpacked(b.column(1), np.uint64)
            k = np.repeat(b.column(0).to_numpy(zero_copy_only=False), n)
            if not len(h):
                continue
            h, lo, hi = _extremes(h, k)
            more = lo != hi
            h, k = np.r_[h, h[more]], np.r_[lo, hi[more]]
            yield _packed_rows([(p, None, x, y) for p, x, y in _cut(_part(h, parts), h, k)])

    return run


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)


def _extremes(h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, k = h[order], k[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first], np.minimum.reduceat(k, first), np.maximum.reduceat(k, first)


def _lonely(parts: int) -> Callable[[pa.Table], pa.Table]:
    """The values of one range that only one class holds, by part of the class."""

    def run(t: pa.Table) -> pa.Table:
        h, lo, hi = _extremes(_unpacked(t.column("a"), np.uint64)[0], _unpacked(t.column("b"), np.int64)[0])
        alone = lo == hi
        h, k = h[alone], lo[alone]
        return pa.Table.from_batches([_packed_rows([(p, None, x) for p, x in _cut(_part(k.view(np.uint64), parts), h)])])

    return run


def _class_parts(parts: int) -> Step:
    """field, k1, k2, hs -> the different sets of the batch, by part of the class."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fields = b.column(0).to_pylist()
            k1, k2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            h, n = _unpacked(b.column(3), np.uint64)
            start = _starts(n)
            at = _distinct(k1, k2)
            rows = []
            for p, own in _cut(_part(k1[at].view(np.uint64), parts), at):
                for f in sorted({fields[i] for i in own}):
                    mine = np.array([i for i in own if fields[i] == f])
                    flat = np.concatenate([h[start[i] : start[i] + n[i]] for i in mine])
                    rows.append((p, f, k1[mine], k2[mine], n[mine].astype(np.int32), flat))
            yield _packed_rows(rows)

    return run


CORES = "field string, k1 bigint, k2 bigint, c1 bigint, c2 bigint, own int, n int, core binary"


def _cores(num: int, den: int, least: int) -> Callable[[pa.Table], pa.Table]:
    """Classes of one part with the values that others hold too; those that can reach the threshold."""

    def run(t: pa.Table) -> pa.Table:
        is_class = pc.is_valid(t.column("field"))
        lone = np.sort(_unpacked(t.filter(pc.invert(is_class)).column("a"), np.uint64)[0])
        batches = []
        for name in sorted(set(t.column("field").to_pylist()) - {None}):
            x = t.filter(pc.equal(t.column("field"), name))
            k1, k2, n, h = (_unpacked(x.column(c), kind)[0] for c, kind in zip("abcd", (np.int64, np.int64, np.int32, np.uint64)))
            at = _distinct(k1, k2)
            keep = np.zeros(len(k1), bool)
            keep[at] = True
            h, k1, k2, n = h[np.repeat(keep, n)], k1[keep], k2[keep], n[keep].astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            place = np.searchsorted(lone, h)
            place[place == len(lone)] = 0
            common = lone[place] != h if len(lone) else np.ones(len(h), bool)
            owner, h = owner[common], h[common]
            shared = np.bincount(owner, minlength=len(n))
            # The best partner holds the whole core and nothing else, but at least min_size values.
            alive = (shared > 0) & (shared * den >= (n + np.maximum(shared, least) - shared) * num)
            c1, c2 = _identity(h, owner, len(n))
            h = h[alive[owner]]
            cols = [k1[alive], k2[alive], c1[alive].view(np.int64), c2[alive].view(np.int64), (n - shared)[alive].astype(np.int32), shared[alive].astype(np.int32)]
            batches.append(pa.RecordBatch.from_arrays([pa.array([name] * int(alive.sum()), pa.string()), *map(pa.array, cols), _packed(shared[alive], h)], ["field", "k1", "k2", "c1", "c2", "own", "n", "core"]))
        kinds = (pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary())
        return pa.Table.from_batches(batches, pa.schema(list(zip(["field", "k1", "k2", "c1", "c2", "own", "n", "core"], kinds))))

    return run


# ---------------------------------------------------------------- sketches and candidates

#: A core in the index: identity, short code, size, least number of values that only one holder has.
ENTRY = np.dtype([("c1", np.int64), ("c2", np.int64), ("code", np.uint64), ("size", np.int32), ("least", np.int32)])
INDEX = "part int, width int, cores binary, keys binary"


class Layout:
    """How one field's index is cut: ``wide`` segments a range, or ``pieces`` ranges of keys a segment."""

    def __init__(self, n: int, num: int, den: int, miss: float, first: int, per_range: int) -> None:
        self.b, self.m = segments_for(n, num, den, miss)
        self.wide = max(1, min(self.m, per_range // max(1, n)))
        self.pieces = parts_for(n, per_range)
        self.first = first
        self.end = first + math.ceil(self.m / self.wide) * self.pieces


def _sketcher(layouts: dict[str, Layout], seed: int) -> Step:
    """field, c1, c2, size, least, core -> packed rows of the index."""
    hashing = {f: _multipliers(x.b * x.m + 64, seed) for f, x in layouts.items()}

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for field, lay in layouts.items():
                b = whole.filter(pc.equal(whole.column(0), field))
                for at in range(0, b.num_rows, 2000):
                    part = b.slice(at, 2000)
                    values, n = _unpacked(part.column(5), np.uint64)
                    bits = minhash_bits(values, _starts(n), *hashing[field])
                    entry = np.empty(len(n), ENTRY)
                    for i, c in enumerate(("c1", "c2", "size", "least")):
                        entry[c] = part.column(i + 1).to_numpy(zero_copy_only=False)
                    entry["code"] = np.packbits(bits[:, lay.b * lay.m :], axis=1).view(np.uint64)[:, 0]
                    seg = np.zeros((len(n), lay.m), np.uint32)
                    for i in range(lay.b):
                        seg |= bits[:, i * lay.m : (i + 1) * lay.m].astype(np.uint32) << np.uint32(i)
                    rows = []
                    for k, s in enumerate(range(0, lay.m, lay.wide)):
                        keys = seg[:, s : s + lay.wide]
                        first = lay.first + k * lay.pieces
                        if lay.pieces == 1:
                            rows.append((first, keys.shape[1], entry.tobytes(), np.ascontiguousarray(keys).tobytes()))
                        else:
                            rows += [(first + p, 1, e.tobytes(), x.tobytes()) for p, e, x in _cut((keys[:, 0] % np.uint32(lay.pieces)).astype(np.int32), entry, keys)]
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "width", "cores", "keys"])

    return run


FOUND = "a1 bigint, a2 bigint, b1 bigint, b2 bigint, x binary, y binary"


class Near:
    """Whether two entries can belong to a similar pair: the Hamming radius, and what their sizes allow."""

    def __init__(self, num: int, den: int, radius: int) -> None:
        self.num, self.den, self.radius = num, den, radius

    def codes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x ^ y) <= self.radius

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = self.codes(x["code"], y["code"])
        lo, hi = np.minimum(x["size"], y["size"]).astype(np.int64), np.maximum(x["size"], y["size"]).astype(np.int64)
        # At best all of the smaller core is shared; each side has its least number of own values beside.
        return ok & (lo * self.den >= (hi + x["least"] + y["least"]) * self.num)


def _found(x: np.ndarray, y: np.ndarray, blocks: list[tuple[bytes, bytes]]) -> pa.Table:
    """Pairs with the lesser core first, and block pairs still to be compared."""
    swap = (y["c1"] < x["c1"]) | ((y["c1"] == x["c1"]) & (y["c2"] < x["c2"]))
    a, b = np.where(swap, y, x), np.where(swap, x, y)
    none = [None] * len(blocks)
    cols = [pa.concat_arrays([pa.array(np.ascontiguousarray(c)), pa.array(none, pa.int64())]) for c in (a["c1"], a["c2"], b["c1"], b["c2"])]
    wide = [pa.array([None] * len(x) + [k[i] for k in blocks], pa.binary()) for i in (0, 1)]
    return pa.table(dict(zip(("a1", "a2", "b1", "b2", "x", "y"), [*cols, *wide])))


def _meet(near: Near, hot: int = HOT) -> Callable[[pa.Table], pa.Table]:
    """Pairs of cores of one range that agree in a segment and are near."""

    def run(t: pa.Table) -> pa.Table:
        entry = _unpacked(t.column("cores"), ENTRY)[0]
        width = t.column("width")[0].as_py()
        keys = _unpacked(t.column("keys"), np.uint32)[0].reshape(-1, width)
        n, code = len(entry), entry["code"].copy()
        pairs: list[np.ndarray] = []
        blocks: list[tuple[bytes, bytes]] = []
        for s in range(width):
            order = np.argsort(keys[:, s], kind="stable")
            k = keys[order, s]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[first, n])
            for i in np.flatnonzero(size > hot):
                cut = [entry[order[j : min(j + hot, first[i] + size[i])]].tobytes() for j in range(first[i], first[i] + size[i], hot)]
                blocks += [(cut[p], cut[q]) for p in range(len(cut)) for q in range(p, len(cut))]
            left = np.repeat(np.where(size > hot, 0, first + size - 1), size) - np.arange(n)
            d, at = 1, np.flatnonzero(left >= 1)
            while len(at):
                i, j = order[at], order[at + d]
                ok = near.codes(code[i], code[j])
                i, j = i[ok], j[ok]
                ok = near(entry[i], entry[j])
                i, j = i[ok], j[ok]
                pairs.append(np.minimum(i, j) * n + np.maximum(i, j))
                d += 1
                at = at[left[at] >= d]
        both = np.unique(np.concatenate([np.empty(0, np.int64), *pairs]))
        return _found(entry[both // max(n, 1)], entry[both % max(n, 1)], blocks)

    return run


def _block_pairs(near: Near) -> Step:
    """The pairs of block pairs."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                p, q = np.frombuffer(x, ENTRY), np.frombuffer(y, ENTRY)
                i, j = (g.ravel() for g in np.meshgrid(np.arange(len(p)), np.arange(len(q)), indexing="ij"))
                if x == y:
                    i, j = i[i < j], j[i < j]
                ok = near(p[i], q[j])
                yield from _found(p[i[ok]], q[j[ok]], []).to_batches()

    return run


VERIFIED = "a1 bigint, a2 bigint, b1 bigint, b2 bigint, shared int, joined int"


def _verifier(num: int, den: int) -> Step:
    """a1, a2, b1, b2, own values of each at least, both sets -> the pairs whose sets can be similar, with their counts."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, nx), (y, ny) = (_unpacked(b.column(i), np.uint64) for i in (6, 7))
            row = np.arange(b.num_rows)
            owner, h = np.r_[np.repeat(row, nx), np.repeat(row, ny)], np.r_[x, y]
            order = np.lexsort((h, owner))
            owner, h = owner[order], h[order]
            twice = (owner[1:] == owner[:-1]) & (h[1:] == h[:-1])
            shared = np.bincount(owner[1:][twice], minlength=b.num_rows)
            joined = nx + ny - shared
            least = sum(b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (4, 5))
            ok = shared * den >= (joined + least) * num
            keys = [b.column(i).filter(pa.array(ok)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(shared[ok].astype(np.int32)), pa.array(joined[ok].astype(np.int32))], ["a1", "a2", "b1", "b2", "shared", "joined"])

    return run


class SimilarSets:
    """The classes, cores and pairs of one set-valued column (or several, told apart by ``field``)."""

    def __init__(self, sets: DataFrame, num: int = 3, den: int = 5, min_size: int = 3, miss: float = 0.004, seed: int = 11) -> None:
        """``sets``: field, record (bigint), at, items (strings, as delivered), one row per delivery. Threshold num / den."""
        self.spark, self.st = sets.sparkSession, Staging(sets.sparkSession, "similar")
        self.num, self.den, self.miss, self.seed = num, den, miss, seed
        fields = sorted(r[0] for r in sets.select("field").distinct().collect()) if not hasattr(sets, "_fields") else sets._fields
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sets.select("field", "record", "at").schema)
        hashed = self.st.put(sets.select("field", "record", "at", "items").mapInArrow(_hasher(fields, min_size), f"{kinds}, {SETS}"))
        latest = hashed.groupBy("field", "record").agg(F.max(F.struct("at", "k1", "k2")).alias("b"))
        self.members = latest.select("field", "record", "b.k1", "b.k2").filter("k1 IS NOT NULL")
        big = hashed.filter(F.col("n") >= min_size)
        parts = parts_for(big.agg(F.sum("n")).first()[0] or 0, WORDS_PER_RANGE, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        words = big.select("k1", "hs").mapInArrow(_word_ranges(parts), PACKED)
        lonely = words.groupBy("part").applyInArrow(_lonely(parts), PACKED)
        classes = big.select("field", "k1", "k2", "hs").mapInArrow(_class_parts(parts), PACKED)
        cores = classes.unionByName(lonely).groupBy("part").applyInArrow(_cores(num, den, min_size), CORES)
        self.cores = self.st.put(cores)
        # Classes with equal cores share one sketch; ``own`` is the number of values only this class holds.
        one = self.cores.groupBy("c1", "c2").agg(F.first("field").alias("field"), F.first("n").alias("n"), F.min("own").alias("least"), F.first("core").alias("core"))
        self.unique = self.st.put(one)

    def candidates(self) -> DataFrame:
        """(a1, a2, b1, b2): pairs of different cores whose sketches meet, a < b."""
        layouts: dict[str, Layout] = {}
        first = 0
        for field, n in sorted((r[0], r[1]) for r in self.unique.groupBy("field").count().collect()):  # one row per field
            layouts[field] = Layout(n, self.num, self.den, self.miss / 2, first, ENTRIES_PER_RANGE)
            first = layouts[field].end
        near = Near(self.num, self.den, radius_for(64, self.num, self.den, self.miss / 2))
        index = self.unique.select("field", "c1", "c2", F.col("n").alias("size"), "least", "core").mapInArrow(_sketcher(layouts, self.seed), INDEX)
        met = self.st.put(index.groupBy("part").applyInArrow(_meet(near), FOUND))
        keys = ["a1", "a2", "b1", "b2"]
        found = met.filter("x IS NULL").select(*keys)
        hot = met.filter("x IS NOT NULL")
        if hot.limit(1).count():
            spread = hot.repartition(parts_for(hot.count(), 4, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
            found = found.unionByName(spread.mapInArrow(_block_pairs(near), FOUND).select(*keys))
        return found.distinct()

    def core_pairs(self) -> DataFrame:
        """(a1, a2, b1, b2, shared, joined): pairs of different cores, verified on the sets; joined is the size of their union."""
        side = lambda p: self.unique.select(F.col("c1").alias(f"{p}1"), F.col("c2").alias(f"{p}2"), F.col("least").alias(f"{p}l"), F.col("core").alias(f"{p}s"))
        x = self.candidates().join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"])
        return x.select("a1", "a2", "b1", "b2", "al", "bl", "as", "bs").mapInArrow(_verifier(self.num, self.den), VERIFIED)

    def _groups(self) -> DataFrame:
        """(a1, a2, oa, b1, b2, ob): groups of classes (a core and a number of own values) whose classes are similar."""
        pairs = self.st.put(self.core_pairs())
        groups = self.cores.groupBy("c1", "c2", "own", "n").agg(F.count(F.lit(1)).alias("k"))
        side = lambda p: groups.select(F.col("c1").alias(f"{p}1"), F.col("c2").alias(f"{p}2"), F.col("own").alias(f"o{p}"), F.col("n").alias(f"n{p}"), F.col("k").alias(f"k{p}"))
        ok = lambda shared, joined: shared * self.den >= (joined + F.col("oa") + F.col("ob")) * self.num
        out = ["a1", "a2", "oa", "b1", "b2", "ob"]
        # Between different cores: which numbers of own values still fit.
        across = pairs.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"]).filter(ok(F.col("shared"), F.col("joined"))).select(*out)
        # Within a core: the same, from the counts alone.
        same = side("a").join(side("b"), (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")) & (F.col("oa") <= F.col("ob")) & ok(F.col("na"), F.col("na")))
        within = same.filter((F.col("oa") < F.col("ob")) | (F.col("ka") > 1)).select(*out)
        return across.unionByName(within)

    def _expanded(self, held: DataFrame, carry: list[str]) -> DataFrame:
        """Groups joined to what each side holds; within one group each pair of different classes once."""
        side = lambda p: held.select(F.col("c1").alias(f"{p}1"), F.col("c2").alias(f"{p}2"), F.col("own").alias(f"o{p}"), F.struct("k1", "k2").alias(f"k{p}"), *[F.col(c).alias(f"{c}_{p}") for c in carry])
        x = self._groups().join(side("a"), ["a1", "a2", "oa"]).join(side("b"), ["b1", "b2", "ob"])
        other = (F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2")) | (F.col("oa") != F.col("ob"))
        return x.filter(other | (F.col("ka") < F.col("kb")))

    def class_pairs(self) -> DataFrame:
        """(ka, kb): classes, named by ``k1, k2``, with different sets that are similar."""
        return self._expanded(self.cores.select("c1", "c2", "own", "k1", "k2"), []).select("ka", "kb")

    def _named(self) -> DataFrame:
        """(k1, k2, field, class_id): classes by the least record that holds them now."""
        return self.members.groupBy("k1", "k2").agg(F.first("field").alias("field"), F.min("record").alias("class_id"))

    def representative_pairs(self) -> DataFrame:
        """(field, a, b): pairs of similar classes by their least records, a < b."""
        named = self.st.put(self._named())
        side = lambda p: named.select(F.struct("k1", "k2").alias(f"k{p}"), F.col("field").alias(f"f{p}"), F.col("class_id").alias(f"r{p}"))
        x = self.class_pairs().join(side("a"), "ka").join(side("b"), "kb")
        return x.select(F.col("fa").alias("field"), F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))

    def classes(self) -> DataFrame:
        """(field, record, class_id, n_links): a row per record with a set; links are the other classes similar to its own."""
        pairs = self.st.put(self.class_pairs())
        links = pairs.select(F.explode(F.array("ka", "kb")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n_links")).select("k.k1", "k.k2", "n_links")
        named = self._named().drop("field").join(links, ["k1", "k2"], "left")
        return self.members.join(named, ["k1", "k2"]).select("field", "record", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def record_pairs(self) -> DataFrame:
        """(field, record_a, record_b): all similar pairs of records."""
        held = self.cores.select("c1", "c2", "own", "k1", "k2").join(self.members, ["k1", "k2"])
        x = self._expanded(held, ["record", "field"])
        between = x.select(F.col("field_a").alias("field"), F.least("record_a", "record_b").alias("record_a"), F.greatest("record_a", "record_b").alias("record_b"))
        # Equal sets: every pair of their records, large groups cut into blocks.
        equal = pairs_within(self.members, ["field", "k1", "k2"], "record").select("field", "record_a", "record_b")
        return between.unionByName(equal)


def sets_of(df: DataFrame, record: str, fields: list[str], at: str) -> DataFrame:
    """(field, record, at, items): one row per delivery and field, lists as delivered."""
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("items")) for f in fields]))
    out = df.filter(F.col(record).isNotNull()).select(F.col(record).alias("record"), F.col(at).alias("at"), one.alias("s")).select("s.field", "record", "at", "s.items")
    out._fields = sorted(fields)
    return out
