"""N-gram Jaccard self-join by PartEnum signatures, exact, down to classes of linked documents.

The feature domain is cut into partitions of parts; subsets of a partition's parts are
enumerated, and sets that are similar enough share the content of one subset at least.
Sizes come in bands, with a scheme each. Documents that share a signature are candidates;
sketches that never overstate a difference drop most of them, and the rest are compared
exactly.

Schemes are wide enough that similar sets share SHARED signatures, not one only. Few
documents with a signature are paired at once, and pairs that meet at fewer signatures are
dropped as numbers, before anything else is looked up. Where there are more, each is
paired with the group's first only. A forest of the pairs, the smallest partner of each
document, is compared exactly and joined to components; then the pairs across components
are tested, those of larger groups block by block. So no link is lost, no group is ever
spread out as all its pairs, and of a group of copies few texts are sent.

Defined cases: a null or empty text has no shingles and no links; equal sets are linked;
rows with one id are one document that has the links of all of them; null ids take no part
in naming components: their rows get the component of equal sets, or null; an empty table
gives an empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .common import delete, hash_words, in_buckets, materialise, mix64, path_of, ragged, text_chunks, trimmed, word_codes

#: Ratio of a size band's ends.
BAND = 1.2
#: Up to this many differing features, subsets of half of four parts are enumerated; beyond it, one part of two.
FOUR_PARTS = 24

#: Signatures that similar sets share at least.
SHARED = 2
#: Documents of a signature that are paired with each other at once; more are first paired with one.
FEW = 32
#: Features a subset must have to be told; common lines would share smaller ones.
LEAST = 2
#: Signatures that are dealt out at once.
SIGNED_AT_ONCE = 1_500_000
#: Bytes of sketches that are sent to larger groups at once, or four for each shingle if that is more.
SENT_AT_ONCE = 64 << 20
#: Documents of a larger group that are compared in a task with as many others.
BLOCK = 2048
#: Shingles for each bucket.
BUCKET = 2_000_000
#: Buckets beyond which signatures are made and sent in rounds, each for a range of buckets; texts are read once for each round.
ROUND, ROUNDS = 24, 3
#: Bits that tell signatures of a bucket apart, at least. Unlike signatures that are cut to the same bits add candidates, no more.
TOLD_APART = 38
#: Documents of a signature in a task beyond which they don't all go to its bucket.
MANY = 1024


def shingle_sets(texts: pa.Array, n: int, seen: dict[str, int]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-word shingles; A-Z count as a-z."""
    codes, offsets, distinct = word_codes(pc.ascii_lower(texts))
    h = hash_words(distinct, seen)[codes]
    with np.errstate(over="ignore"):
        roll = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for j in range(n):
            roll = mix64(roll * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(roll)])
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(roll[a : b - n + 1]))
        elif b > a:
            short = np.zeros(1, np.uint64)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    short = mix64(short * np.uint64(0x9E3779B97F4A7C15) + x + np.uint64(b - a))
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@functools.cache
def band_of(size: int) -> int:
    """Number of the size band: bands begin where the one before ended."""
    i, high = 0, 1
    while size > high:
        i, high = i + 1, max(high + 1, int(high * BAND))
    return i


@functools.cache
def band_ends(i: int) -> tuple[int, int]:
    low, high = 1, 1
    for _ in range(i):
        low, high = high + 1, max(high + 1, int(high * BAND))
    return low, high


@functools.cache
def scheme(i: int, num: int, den: int) -> tuple[int, int, int]:
    """For pairs whose larger set is in band i: (partitions, parts of each, deficient partitions allowed).

    With similarity num / den or more, sets of sizes a <= b differ in at most
    (den - num) * (a + b) / (den + num) features, so in at most k over the band. Of the
    partitions, at most k // (parts // 2 + 1) have more than half of their parts differing,
    so the others, spare + SHARED or more, hold a subset of half of the parts that agrees.
    """
    low, high = band_ends(i)
    k = (den - num) * 2 * high // (den + num)
    parts = 4 if k <= FOUR_PARTS else 2
    subsets, smallest = (6 if parts == 4 else 2), max(1, -(-low * num // den))
    best = None
    for spare in range(0, 2 + k // 2):
        n1 = k // (parts // 2 + 1) + SHARED + spare
        # mean number of partitions of the smallest set with a subset below LEAST, and the chance that there are more than `spare`
        cover = smallest / (2 * n1)
        mean = n1 * min(1.0, subsets * math.exp(-cover) * sum(cover**j / math.factorial(j) for j in range(LEAST)))
        tail = 1 - sum(math.exp(-mean + j * math.log(mean) - math.lgamma(j + 1)) for j in range(spare + 1))
        if best is None or tail < best[0]:
            best = (tail, (n1, parts, spare))
        if tail <= 1e-3:
            break
    return best[1]


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """64-bit signatures of a set: two sets that are similar enough share SHARED at least.

    A set takes part in the schemes of its own band and of those up to its largest possible
    partner's. Each part's content is a sum of hashes; a signature is a subset of a
    partition's parts. Subsets below LEAST features say little and are left out: of spare +
    SHARED agreeing partitions, SHARED have no such subset. Where more than `spare` have one, which
    is rare, the guarantee needs them, and they are kept.
    """
    size = len(s)
    if not size:
        return np.zeros(0, np.uint64)
    own, found = band_of(size), []
    sums_to = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(s))))
    for i in range(own, band_of(size * den // num) + 1):
        n1, parts, spare = scheme(i, num, den)
        at = np.append(np.searchsorted(s, cuts(n1 * parts)), size)  # sets are sorted, so a part is a run of them
        sums, sizes = np.diff(sums_to[at]).reshape(n1, parts), np.diff(at).reshape(n1, parts)
        if parts == 2:
            subs, some = sums, sizes >= LEAST
        else:
            subs = np.stack([sums[:, a] + sums[:, b] for a, b in PAIRS], axis=1)
            some = np.stack([sizes[:, a] + sizes[:, b] >= LEAST for a, b in PAIRS], axis=1)
        names_ = names(i, subs.size)
        if (~some).any(axis=1).sum() <= spare:
            found.append(mix64(subs[some] ^ names_[some.ravel()]))
        else:
            found.append(mix64(subs.ravel() ^ names_))
    return np.concatenate(found)


PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


def sketch(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Parities of the set's features by hash slot, as packed bits.

    A feature that only one of two sets has turns one bit, so sketches of one length never
    differ in more bits than their sets differ in features. The length follows the band.
    """
    bits = sketch_bits(band_of(len(s)))
    slots = (mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=bits).astype(np.uint8) & 1)


def sketch_bits(band: int) -> int:
    return max(64, 1 << (band_ends(band)[1] - 1).bit_length())


@functools.lru_cache(512)
def cuts(n: int) -> np.ndarray:
    """Where each of n equal parts of the 64-bit domain begins."""
    return np.array([(j << 64) // n for j in range(n)], np.uint64)


@functools.lru_cache(512)
def names(i: int, n: int) -> np.ndarray:
    """A number of its own for each subset of band i."""
    return mix64(np.arange(n, dtype=np.uint64) + np.uint64((i + 1) << 32))


def cut_text(docs: DataFrame, ident: str, text: str) -> DataFrame:
    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))


def described(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch) of documents; digest and sketch are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in text_chunks(batches):
            sets = shingle_sets(batch.column("text"), n, seen)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([sketch(s, num, den).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "digest", "sketch"],
            )

    return docs.mapInArrow(lambda batches: trimmed(run(batches)), "doc_id long, n_shingles long, digest binary, sketch binary")


SIGNED = np.dtype([("sig", "<u8"), ("doc", "<i8"), ("size", "<i4")])


def signed(docs: DataFrame, n: int, num: int, den: int, buckets: int, low: int = 0, high: int | None = None) -> DataFrame:
    """(bucket, rows): signatures by range, packed; of the buckets low .. high - 1, counted from low. Of equal sets in a task, the first one signs for all.

    Where a task has more than MANY documents for a signature, only its first goes to the
    signature's own bucket, with a negative size as mark. The others go to buckets by their
    id, as pairs with it, so that no bucket has more than MANY rows of a signature from a task.
    """

    high = buckets if high is None else high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        met: set[bytes] = set()
        held, count = [], 0
        for batch in text_chunks(batches):
            for doc, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), n, seen), strict=True):
                if doc is None or not len(s) or (d := xxhash.xxh3_128_digest(s)) in met:
                    continue
                if len(met) < 1_000_000:
                    met.add(d)
                sigs = shortened(signatures(s, num, den), buckets)
                if high - low < buckets:
                    to = sig_bucket(sigs, buckets)
                    sigs = sigs[(to >= low) & (to < high)]
                rows = np.empty(len(sigs), SIGNED)
                rows["sig"], rows["doc"], rows["size"] = sigs, doc, len(s)
                held.append(rows)
                count += len(rows)
            if count > SIGNED_AT_ONCE:
                yield from dealt(np.concatenate(held), buckets, low, high)
                held, count = [], 0
        if count:
            yield from dealt(np.concatenate(held), buckets, low, high)

    return docs.mapInArrow(lambda batches: trimmed(run(batches)), "bucket int, kind int, rows binary")


def packed(bucket: np.ndarray, kind: int, rows: np.ndarray, pack) -> pa.RecordBatch:
    """Rows by bucket."""
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    cut = [pack(rows[a:z]) for a, z in zip(at, np.append(at[1:], len(rows)), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array([kind] * len(at), pa.int32()), pa.array(cut, pa.binary())], ["bucket", "kind", "rows"])


def byte_planes(x: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones: sorted numbers compress so."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def pack_signed(rows: np.ndarray) -> bytes:
    """Rows sorted by signature; each document's id and size once, with its number in the rows."""
    docs, first, which = np.unique(rows["doc"], return_index=True, return_inverse=True)
    width = 2 if len(docs) <= 1 << 16 else 4
    head = np.array([len(rows), len(docs), width], "<u4").tobytes()
    return head + byte_planes(docs.astype("<i8")) + rows["size"][first].astype("<i4").tobytes() + byte_planes(np.ascontiguousarray(rows["sig"])) + which.astype(f"<u{width}").tobytes() + np.packbits(rows["size"] < 0).tobytes()


def unpack_signed(data: bytes) -> np.ndarray:
    n, d, width = (int(v) for v in np.frombuffer(data, "<u4", 3))
    plane = lambda k, at, kind: np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * k, at).reshape(8, k).T).view(kind).ravel()
    out = np.empty(n, SIGNED)
    which = np.frombuffer(data, f"<u{width}", n, 12 + 12 * d + 8 * n)
    out["sig"], out["doc"] = plane(n, 12 + 12 * d, "<u8"), plane(d, 12, "<i8")[which]
    out["size"] = np.abs(np.frombuffer(data, "<i4", d, 12 + 8 * d))[which]
    marked = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, 12 + 12 * d + (8 + width) * n), count=n).astype(bool)
    out["size"][marked] *= -1
    return out


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(values)))


def shortened(sigs: np.ndarray, buckets: int) -> np.ndarray:
    """Signatures with as many leading bytes as tell those of a bucket apart, the rest zero, which takes no room once compressed."""
    drop = max(0, 64 - 8 * -(-(TOLD_APART + buckets.bit_length()) // 8))
    return sigs >> np.uint64(drop) << np.uint64(drop)


def dealt(rows: np.ndarray, buckets: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    rows = rows[np.lexsort((rows["doc"], rows["sig"]))]
    at, length = runs(rows["sig"])
    many = np.repeat(length > MANY, length)
    if many.any():
        first = np.zeros(len(rows), bool)
        first[at] = True
        led = rows[many & ~first]
        pairs = np.empty(len(led), PAIRED)
        pairs["sig"], pairs["b"] = led["sig"], led["doc"]
        pairs["a"] = np.repeat(rows["doc"][at], length)[many & ~first]
        to = (mix64(led["doc"].astype(np.uint64)) % np.uint64(high - low)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        yield packed(to[order], 1, pairs[order], lambda rows: rows.tobytes())
        rows["size"][many & first] *= -1
        rows = rows[~many | first]
    yield packed(sig_bucket(rows["sig"], buckets) - low, 0, rows, pack_signed)


PAIRED = np.dtype([("sig", "<u8"), ("a", "<i8"), ("b", "<i8")])


def matched(packs: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """(sig, a, b, n, group): pairs a < b that meet at n signatures; rows of `group` pack members of larger groups.

    Of groups beyond a BLOCK, pairs have the sig, and (sig, a, a) tells its first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if kind:
                    p = np.frombuffer(data, PAIRED)
                    yield pairs_batch(p["a"], p["b"], p["sig"])
                else:
                    held.append(unpack_signed(data))
        if not held:
            return
        rows = np.concatenate(held)
        del held
        rows = rows[np.lexsort((rows["doc"], rows["sig"]))]
        at, length = runs(rows["sig"])
        marked = np.add.reduceat(rows["size"] < 0, at) > 0
        doc, size = rows["doc"], np.abs(rows["size"])
        large = marked | (length > FEW)
        wide = marked | (length > BLOCK)
        for a, n in zip(at[wide], length[wide], strict=True):
            yield pairs_batch(np.repeat(doc[a], n), doc[a : a + n], np.repeat(rows["sig"][a], n))
        found = []
        mid = large & ~wide
        if mid.any():
            i, n = ragged(at[mid], length[mid]), length[mid]
            members = np.empty(len(i), MEMBER)
            members["sig"], members["doc"] = rows["sig"][i], doc[i]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.int32()), pa.array([members.tobytes()], pa.binary())], ["sig", "a", "b", "n", "group"])
            one, many = np.repeat(at[mid], n), i
            found.append(pairs_of(one[fits(size, one, many, num, den)], many[fits(size, one, many, num, den)], doc))
        for step in range(1, FEW):  # in small groups, each with the one `step` further on
            i = np.repeat(at[~large & (length > step)], (length - step)[~large & (length > step)])
            if not len(i):
                break
            i = i + (np.arange(len(i)) - np.repeat(np.cumsum(length[~large & (length > step)] - step) - (length[~large & (length > step)] - step), (length - step)[~large & (length > step)]))
            j = i + step
            fit = fits(size, i, j, num, den)
            found.append(pairs_of(i[fit], j[fit], doc))
        if found:
            pairs, times = counted(np.concatenate(found))
            yield pairs_batch(pairs["a"], pairs["b"], None, times)

    return in_buckets(packs, buckets).mapInArrow(lambda batches: trimmed(run(batches)), "sig long, a long, b long, n int, group binary")


PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])


def fits(size: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    x, y = size[i].astype(np.int64), size[j].astype(np.int64)
    return (x * den >= y * num) & (y * den >= x * num)


def pairs_of(i: np.ndarray, j: np.ndarray, doc: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), PAIR)
    out["a"], out["b"] = doc[i], doc[j]
    return out[out["a"] < out["b"]]


def counted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and how often each stands."""
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    new = np.append(True, (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])) if len(pairs) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return pairs[at], np.diff(np.append(at, len(pairs)))


MEMBER = np.dtype([("sig", "<u8"), ("doc", "<i8")])


def pairs_batch(a: np.ndarray, b: np.ndarray, sig: np.ndarray | None, n: np.ndarray | None = None) -> pa.RecordBatch:
    named = pa.nulls(len(a), pa.int64()) if sig is None else pa.array(sig.view(np.int64) if sig.flags.c_contiguous else sig.copy().view(np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([named, pa.array(np.ascontiguousarray(a), pa.int64()), pa.array(np.ascontiguousarray(b), pa.int64()), pa.array(np.ones(len(a), np.int32) if n is None else n.astype(np.int32)), pa.nulls(len(a), pa.binary())], ["sig", "a", "b", "n", "group"])


def folded(x: bytes, to: int) -> int:
    """A sketch as a number, shortened to `to` bytes."""
    v, n = int.from_bytes(x, "little"), len(x)
    while n > to:
        n //= 2
        v = (v >> (8 * n)) ^ (v & ((1 << (8 * n)) - 1))
    return v


def may_link(x: bytes, nx: int, y: bytes, ny: int, num: int, den: int) -> bool:
    """False only if the sets certainly aren't similar enough."""
    if nx * den < ny * num or ny * den < nx * num:
        return False
    to = min(len(x), len(y))
    return (folded(x, to) ^ folded(y, to)).bit_count() * (den + num) <= (den - num) * (nx + ny)


def sketched(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that their sketches don't rule out."""
    side = lambda c: rows.where("sketch IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link(x, nx, y, ny, num, den) for x, nx, y, ny in zip(*(batch.column(c).to_pylist() for c in ("sa", "na", "sb", "nb")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough, compared exactly from the whole texts."""
    side = lambda c: docs.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for whole in batches:
            for batch in text_chunks(iter([whole]), "tb"):
                left, which = [], []
                for a in batch.column("a").to_pylist():  # rows of one a come together
                    if not left or left[-1] != a:
                        left.append(a)
                    which.append(len(left) - 1)
                starts = [which.index(i) for i in range(len(left))]
                sa = shingle_sets(batch.column("ta").take(pa.array(starts)), n, seen)
                sb = shingle_sets(batch.column("tb"), n, seen)
                keep = []
                for i, y in zip(which, sb, strict=True):
                    x = sa[i]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def across(groups: DataFrame, labels: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) within large groups (sig, doc_id), across components, that sketches don't rule out.

    Groups that lie in one component are done. The others are dealt into blocks by hash and
    each pair of blocks is compared in a task of its own.
    """
    own = groups.join(labels, "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).select("sig", "doc_id", "c")
    open_ = own.groupBy("sig").agg(F.count(F.lit(1)).alias("g"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("sig", F.ceil(F.col("g") / BLOCK).cast("int").alias("nb"))
    held = own.join(open_, "sig").withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int"))
    wide = held.where("nb > 1").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("sig", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "doc_id", "c")
    held = held.where("nb = 1").select("sig", "i", F.col("i").alias("hi"), "i", "doc_id", "c").toDF("sig", "lo", "hi", "i", "doc_id", "c").unionAll(wide)
    held = held.join(rows.where("sketch IS NOT NULL").select("doc_id", F.col("n_shingles").alias("size"), "sketch"), "doc_id")

    def compare(key, table):
        lo, hi = key[1].as_py(), key[2].as_py()
        i, doc, c, size = (table.column(x).to_numpy() for x in ("i", "doc_id", "c", "size"))
        raw = table.column("sketch").to_pylist()
        bits = folded_rows(raw, min(map(len, raw)))
        found = [np.zeros(0, PAIR)]
        if lo == hi:
            found += differing(doc, c, size, np.full(len(doc), len(doc)), bits, num, den)
        else:
            far = np.flatnonzero(i == hi)
            for p in np.flatnonzero(i == lo).tolist():
                q = far[(c[far] != c[p]) & (size[far] * den >= size[p] * num) & (size[p] * den >= size[far] * num)]
                if len(q):
                    q = q[np.bitwise_count(bits[q] ^ bits[p]).sum(axis=1, dtype=np.int64) * (den + num) <= (den - num) * (size[q] + size[p])]
                    out = np.empty(len(q), PAIR)
                    out["a"], out["b"] = np.minimum(doc[q], doc[p]), np.maximum(doc[q], doc[p])
                    found.append(out)
        both = np.concatenate(found)
        return pa.table({k: np.ascontiguousarray(both[k]) for k in ("a", "b")}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return held.groupBy("sig", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def folded_rows(raw: list[bytes], to: int) -> np.ndarray:
    """Sketches as rows of numbers, shortened to `to` bytes each."""
    out = np.empty((len(raw), to), np.uint8)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    for n in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == n)
        rows = np.frombuffer(b"".join([raw[i] for i in own.tolist()]), np.uint8).reshape(-1, n)
        while n > to:
            n //= 2
            rows = rows[:, :n] ^ rows[:, n:]
        out[own] = rows
    return out.view(np.uint64)


def differing(*given) -> Iterator[np.ndarray]:
    """The pairs of `apart`."""
    return (pairs for pairs, _ in apart(*given))


def apart(doc: np.ndarray, comp: np.ndarray, size: np.ndarray, ends: np.ndarray, bits: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs across components, within groups, that sketches don't rule out, and how far their sketches are apart.

    Members of a group follow each other; `ends` tells where each member's group ends.
    Some PAIRS_AT_ONCE are looked at in one step, whatever groups they belong to.
    """
    first = np.arange(len(doc))
    left = ends - first - 1
    total = np.cumsum(left)
    a = 0
    while a < len(doc):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS_AT_ONCE, side="right")))
        for off in range(0, int(left[a]) if z == a + 1 else 1, PAIRS_AT_ONCE):  # one member may have more partners than that
            n = left[a:z] if z > a + 1 else np.minimum(left[a:z] - off, PAIRS_AT_ONCE)
            i, j = np.repeat(first[a:z], n), ragged(first[a:z] + 1 + off, n)
            x, y = size[i], size[j]
            keep = np.flatnonzero((comp[i] != comp[j]) & (x * den >= y * num) & (y * den >= x * num))
            if len(keep):
                i, j = i[keep], j[keep]
                bits_off, both = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64), size[i] + size[j]
                near = bits_off * (den + num) <= (den - num) * both
                out = np.empty(int(near.sum()), PAIR)
                out["a"], out["b"] = np.minimum(doc[i[near]], doc[j[near]]), np.maximum(doc[i[near]], doc[j[near]])
                yield out, bits_off[near] / both[near]
        a = z


#: Pairs that are looked at in one step.
PAIRS_AT_ONCE = 100_000


def sig_bucket(sigs: np.ndarray, buckets: int) -> np.ndarray:
    return ((sigs >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def nearest_forest(pairs: np.ndarray, far: np.ndarray, comp_of: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs, taken from the nearest on, those that join components which the ones before leave apart."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    order, keep = np.lexsort((pairs["b"], pairs["a"], far)), []
    for i, a, b in zip(order.tolist(), pairs["a"][order].tolist(), pairs["b"][order].tolist(), strict=True):
        x, y = top(comp_of[a]), top(comp_of[b])
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(i)
    return pairs[keep], far[keep]


def across_packed(groups: DataFrame, labels: DataFrame, rows: DataFrame, buckets: int, num: int, den: int, low: int, high: int, one: bool) -> DataFrame:
    """Like `across`, for groups of a BLOCK at most whose signatures' buckets are in low .. high - 1.

    Their members go by id to labels and sketches, then by signature; a document's sketch goes to a
    bucket of signatures once, however many of them it has there. With `one`, a bucket tells only a forest
    of its pairs, the nearest by sketch, that joins all the components that its pairs join, and, packed in
    `group`, the members that are in any of its pairs: no others need be looked at again.
    """
    info = rows.where("sketch IS NOT NULL AND doc_id IS NOT NULL").join(labels, "doc_id", "left").select(F.pmod("doc_id", F.lit(buckets)).cast("int").alias("bucket"), F.lit(0).alias("kind"), "doc_id", F.coalesce("component", "doc_id").alias("c"), F.col("n_shingles").alias("size"), F.col("sketch").alias("data"))
    schema = "bucket int, kind int, doc_id long, c long, size long, data binary"

    def by_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("group").to_pylist():
                members = np.frombuffer(data, MEMBER)
                at = sig_bucket(members["sig"], buckets)
                members = members[(at >= low) & (at < high)]
                members = members[np.argsort(np.mod(members["doc"], buckets), kind="stable")]
                at, n = runs(np.mod(members["doc"], buckets))
                cut = [members[a : a + k].tobytes() for a, k in zip(at, n, strict=True)]
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.mod(members["doc"], buckets)[at], pa.int32()), pa.array([1] * len(at), pa.int32()), none, none, none, pa.array(cut, pa.binary())], ["bucket", "kind", "doc_id", "c", "size", "data"])

    def by_sig(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, comps, sizes, sketches = [], [], [], []
        order = known = None
        for batch in batches:
            for kind, d, c, n, data in zip(*(batch.column(x).to_pylist() for x in ("kind", "doc_id", "c", "size", "data")), strict=True):
                if not kind:
                    ids.append(d)
                    comps.append(c)
                    sizes.append(n)
                    sketches.append(data)
                    continue
                if order is None:
                    order = np.argsort(np.array(ids, np.int64), kind="stable")
                    known = np.array(ids, np.int64)[order]
                members = np.frombuffer(data, MEMBER)
                to = sig_bucket(members["sig"], buckets)
                by = np.argsort(to, kind="stable")
                at, length = runs(to[by])
                cut = []
                for a, k in zip(at, length, strict=True):
                    part = members[by[a : a + k]]
                    docs, which = np.unique(part["doc"], return_inverse=True)
                    w = order[np.searchsorted(known, docs)].tolist()
                    told, of = np.empty(len(docs), TOLD), np.empty(k, SIG_OF)
                    told["doc"], told["comp"], told["size"], told["bytes"] = docs, [comps[i] for i in w], [sizes[i] for i in w], [len(sketches[i]) for i in w]
                    of["sig"], of["which"] = part["sig"], which
                    cut.append(np.array([k, len(docs)], "<u4").tobytes() + of.tobytes() + told.tobytes() + b"".join(sketches[i] for i in w))
                yield pa.RecordBatch.from_arrays([pa.array(to[by][at], pa.int32()), pa.array(cut, pa.binary())], ["bucket", "data"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, raw, sigs, which, n = [], [], [], [], 0
        for batch in batches:
            for data in batch.column("data").to_pylist():
                k, d = (int(v) for v in np.frombuffer(data, "<u4", 2))
                of = np.frombuffer(data, SIG_OF, k, 8)
                t = np.frombuffer(data, TOLD, d, 8 + k * SIG_OF.itemsize)
                ends = 8 + k * SIG_OF.itemsize + d * TOLD.itemsize + np.cumsum(t["bytes"], dtype=np.int64)
                told.append(t)
                raw += [data[z - b : z] for z, b in zip(ends.tolist(), t["bytes"].tolist(), strict=True)]
                sigs.append(of["sig"])
                which.append(of["which"].astype(np.int64) + n)
                n += d
        if not told:
            return
        t, sig, which = np.concatenate(told), np.concatenate(sigs), np.concatenate(which)
        order = np.lexsort((t["doc"][which], sig))
        sig, which = sig[order], which[order]
        comp, size, length_of = t["comp"][which], t["size"][which], t["bytes"][which]
        at, length = runs(sig)
        mixed = np.minimum.reduceat(comp, at) < np.maximum.reduceat(comp, at)
        shortest = np.minimum.reduceat(length_of, at)
        found, fars, held = [np.zeros(0, PAIR)], [np.zeros(0)], 0
        met_docs = [np.zeros(0, np.int64)]
        comp_of = dict(zip(t["doc"].tolist(), t["comp"].tolist(), strict=True)) if one else {}
        for to in np.unique(shortest[mixed]).tolist():
            own = mixed & (shortest == to)
            members = ragged(at[own], length[own])
            ends = np.repeat(np.cumsum(length[own]), length[own])
            docs, of = np.unique(which[members], return_inverse=True)
            bits = folded_rows([raw[i] for i in docs.tolist()], to)[of]
            for pairs, far in apart(t["doc"][which[members]], comp[members], size[members].astype(np.int64), ends, bits, num, den):
                found.append(pairs)
                fars.append(far)
                held += len(pairs)
                if one:
                    met_docs.append(np.unique([pairs["a"], pairs["b"]]))
                if held > 500_000:
                    kept, far = nearest_forest(np.concatenate(found), np.concatenate(fars), comp_of) if one else (counted(np.concatenate(found))[0], np.zeros(0))
                    found, fars, held = [kept], [far], 0
        both = nearest_forest(np.concatenate(found), np.concatenate(fars), comp_of)[0] if one else counted(np.concatenate(found))[0]
        yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(both[c]), pa.int64()) for c in ("a", "b")], pa.nulls(len(both), pa.binary())], ["a", "b", "group"])
        again = np.repeat(mixed, length) & np.isin(t["doc"][which], np.concatenate(met_docs))
        if again.any():
            members = np.empty(int(again.sum()), MEMBER)
            members["sig"], members["doc"] = sig[again], t["doc"][which[again]]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 2, pa.array([members.tobytes()], pa.binary())], ["a", "b", "group"])

    met = in_buckets(groups.select("group").mapInArrow(lambda batches: trimmed(by_doc(batches)), schema).unionAll(info), buckets)
    told = met.sortWithinPartitions("kind").mapInArrow(lambda batches: trimmed(by_sig(batches)), "bucket int, data binary")
    return in_buckets(told, buckets).mapInArrow(lambda batches: trimmed(compare(batches)), "a long, b long, group binary")


TOLD = np.dtype([("doc", "<i8"), ("comp", "<i8"), ("size", "<i4"), ("bytes", "<i4")])
SIG_OF = np.dtype([("sig", "<u8"), ("which", "<u4")])


def linked_classes(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`.

    Documents link when num / den of their sets' union or more is shared; the component is
    the smallest id reachable by links. Ids move as numbers, signatures once, and texts only
    to be compared with candidates.
    """
    own = cut_text(docs, ident, text)
    rows = materialise(described(own, n, num, den), "described")
    passing = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        """Like materialise, until the classes are found."""
        passing.append(materialise(df, name))
        return passing[-1]

    total, sketched_bytes, described_rows = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.coalesce(F.sum(F.length("sketch")), F.lit(0)), F.count("sketch")).first()
    buckets = max(8, int(total // BUCKET))
    rounds = min(ROUNDS, 1 + buckets // ROUND)
    ends = [buckets * i // rounds for i in range(rounds + 1)]
    union = functools.partial(functools.reduce, DataFrame.unionAll)
    found = union([kept(matched(signed(own, n, num, den, buckets, low, high), high - low, num, den), "matched") for low, high in itertools.pairwise(ends)])
    dealt_to = F.pmod(F.xxhash64("a", F.lit(1)), F.lit(rounds))
    met = lambda i: found.where("a < b").where(dealt_to == i).groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= SHARED).select("a", "b")
    near = union([kept(sketched(met(i), rows, num, den), "near") for i in range(rounds)])
    forest = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    named = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("named"))
    same = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").join(named, "digest").where("doc_id > named").select(F.col("doc_id").alias("a"), F.col("named").alias("b"))
    links = kept(verified(forest, own, n, num, den).unionAll(same), "links")
    labels = components(links, "a", "b")
    tried = forest
    packs = found.where("group IS NOT NULL").select("group")
    wide = found.where("sig IS NOT NULL")
    groups = wide.select("sig", F.col("a").alias("doc_id")).unionAll(wide.select("sig", F.col("b").alias("doc_id"))).distinct()
    label = lambda c: labels.select(F.col("doc_id").alias(c), F.col("component").alias(f"c{c}"))
    unlike = F.coalesce("ca", "a") != F.coalesce("cb", "b")
    left = lambda pairs: pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").where(unlike).select("a", "b")
    for one in (True, False):
        members = packs.agg(F.coalesce(F.sum(F.length("group")), F.lit(0))).first()[0] // MEMBER.itemsize
        sent = members * (SIG_OF.itemsize + TOLD.itemsize + sketched_bytes // max(1, described_rows))
        steps = min(buckets, 1 + int(sent // max(SENT_AT_ONCE, 4 * total))) if members else 0
        parts = [kept(across_packed(packs, labels, rows, buckets, num, den, buckets * i // steps, buckets * (i + 1) // steps, one), "across") for i in range(steps)]
        said = union(parts) if parts else found.select("a", "b", "group").limit(0)
        packs = said.where("group IS NOT NULL").select("group")
        open_ = said.where("a < b").select("a", "b").distinct()
        if one:
            open_ = open_.unionAll(left(near).groupBy("b").agg(F.max("a").alias("a")).select("a", "b")).distinct()
        else:
            open_ = open_.unionAll(left(near)).unionAll(across(groups, labels, rows, num, den)).distinct()
        open_ = kept(open_.join(tried, ["a", "b"], "left_anti"), "open")
        more = kept(verified(open_, own, n, num, den), "more-links")
        tried = tried.unionAll(open_)
        if not more.isEmpty():
            links = links.unionAll(more)
            labels = components(links, "a", "b")
    for table in passing:
        delete(own.sparkSession, path_of(table))
    of_class = named.join(labels, named["named"] == labels["doc_id"], "left").select("digest", F.coalesce("component", "named").alias("component"))
    return rows.join(of_class, "digest", "left").select(F.col("doc_id").alias(ident), "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
