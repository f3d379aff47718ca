"""Removal of byte strings that an earlier document also has, by suffix arrays of candidate strings.

A byte goes if a 50-byte window over it also starts in a document with a smaller id.

1. Of every window, the smallest hash among its 20-byte pieces is its anchor, so equal
   windows have equal anchors. Consecutive windows of one anchor are its context. Anchors
   and contexts travel as hashes, packed by bucket.
2. Where documents share an anchor, equal contexts of all but the smallest id go whole;
   equal means by hash, 40 bits of the anchor and 56 of the context's bytes. Contexts
   that differ, which is where repeats begin and end, are sent as strings if another
   document's has the same 15 bytes before the anchor, or after it: a window reaches as
   far on one side at least, so others have no window in common. Short anchors meet by
   chance, the more of them the more text there is; those of 35 bytes hardly do.
3. Strings of one anchor are put into one text and its suffixes ordered (suffix_array).
   Windows that are equal are neighbours in that order; the smallest id keeps its own.
   A text of many strings is ordered by doubling, as far as a window reaches.
4. Removed runs meet their texts again.

Of equal contexts only the smallest id of a task travels to their anchor. Anchors that have
many unlike contexts within a task travel by context instead, and their strings by window,
each already reduced to the smallest id of the task; so no key gathers rows in one place
with its frequency.

Defined cases: a null text is empty, and nothing is removed from texts below 50 bytes; a
row without id is never earlier or later than another and stays whole; rows with one id
are not earlier than each other; an empty table gives an empty result; further columns of
the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, in_buckets, mix64, ragged, release, small_batches, text_bytes, text_chunks, trimmed
from .suffix_array import ordered_to, suffix_arrays

WINDOW, PIECE = 50, 20
#: A window has so many bytes before its anchor, or so many after it.
SIDE = (WINDOW - PIECE) // 2
#: Unlike contexts of an anchor, of those dealt out at once, beyond which it is frequent.
FEW = 32
#: Text of suffix arrays that are built at once.
SORTED_BYTES = 512 << 10
#: Strings of a key, beyond which its suffixes are ordered at once, as far as a window reaches, and not group by group.
MANY = 48
#: Text whose windows are hashed at once; numpy holds some 150 bytes for each of its bytes. Longer texts are cut there.
HASHED_BYTES = 192 << 10
#: Contexts that are dealt out at once, and text for which a bucket is made.
DEALT_ROWS, BUCKET_BYTES = 800_000, 16 << 20
#: Strings, with what is told of them, and cuts that a task holds before it deals them out.
HELD_BYTES, HELD_CUTS = 16 << 20, 400_000

BYTE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B))
ANCHORED = np.dtype([("k", "<u8"), ("c", "<u8"), ("doc", "<i8")])
FATED = np.dtype([("doc", "<i8"), ("key", "<u8"), ("fate", "u1")])
CUT = np.dtype([("uid", "<i8"), ("start", "<i4"), ("end", "<i4")])
STRING = np.dtype([("key", "<u8"), ("doc", "<i8"), ("uid", "<i8"), ("start", "<i4"), ("size", "<i4")])
#: What becomes of a document's contexts: removed whole, compared as strings, compared window by window.
WHOLE, COMPARED, BY_WINDOW = 1, 2, 3


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        t = left * np.uint64(0x9E3779B97F4A7C15) + right
    t ^= t >> np.uint64(29)
    return t


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each begins, and the end."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return whole, at - at[0]


def contexts(x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of all windows: text number, first and last window, hash of the anchor (40 bits) and of the context (56 bits,
    of which 8 tell the bytes before the anchor and 8 those after it, as `side` has them).

    `w` has the hash of the window at every byte of `x`.
    """
    n = len(x)
    none = {f: np.zeros(0, np.int64) for f in ("text", "first", "last")} | {f: np.zeros(0, np.uint64) for f in ("k", "c", "w")}
    if n < WINDOW:
        return none
    h = BYTE[x]
    h4 = joined_hash(h2[:-2], h2[2:]) if len(h2 := joined_hash(h[:-1], h[1:])) > 2 else h2
    h8 = joined_hash(h4[:-4], h4[4:])
    h16 = joined_hash(h8[:-8], h8[8:])
    piece = mix64(joined_hash(h16[:-4], h4[16:]))
    h32 = joined_hash(h16[:-16], h16[16:])
    w = joined_hash(h32[:-18], h32[18:])
    low, at = piece, np.arange(len(piece), dtype=np.int32)
    for step in (1, 2, 4, 8, WINDOW - PIECE - 15):
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
    at = at[: n - WINDOW + 1]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(at)]
    fits = np.arange(len(at)) + WINDOW <= bounds[text + 1]
    new = np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (fits[1:] != fits[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    keep = fits[first]
    first, last = first[keep], last[keep]
    q = at[first]
    with np.errstate(over="ignore"):
        c = mix64(joined_hash(joined_hash(w[first], w[last]), ((q - first) * 64 + (last - first)).astype(np.uint64))) >> np.uint64(24)
    c |= side(h8, q - SIDE, q - SIDE >= first) << np.uint64(40) | side(h8, q + PIECE, q + PIECE + SIDE <= last + WINDOW) << np.uint64(48)
    # the anchor's lower bits: it is the smallest of many hashes, so most have the same upper ones
    return {"text": text[first], "first": first, "last": last, "k": piece[q] & np.uint64((1 << 40) - 1), "c": c, "w": w}


def side(h8: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Of SIDE bytes from each place, 8 bits that aren't 0, or 0 where a context doesn't reach that far."""
    at = np.where(there, at, 0)
    return np.where(there, mix64(joined_hash(h8[at], h8[at + SIDE - 8])) % np.uint64(255) + np.uint64(1), np.uint64(0))


def sides(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return c >> np.uint64(40) & np.uint64(255), c >> np.uint64(48)


def in_parts(x: np.ndarray, bounds: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """`contexts` of some texts after others, HASHED_BYTES at a time, with places as they are in `x`.

    A text that is longer is cut at multiples of that, so always alike; parts overlap by a
    window less a byte, so each window is in one part, and a context across a cut is two.
    """
    n = np.maximum(1, -(-np.maximum(0, np.diff(bounds) - WINDOW + 1) // HASHED_BYTES))
    text = np.repeat(np.arange(len(n)), n)
    start = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * HASHED_BYTES
    end = np.minimum(start + HASHED_BYTES + WINDOW - 1, bounds[text + 1])
    size = end - start
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), HASHED_BYTES + WINDOW, side="right")) + at)
        part = x[start[at] : end[at]] if to == at + 1 else x[ragged(start[at:to], size[at:to])]
        inner = np.concatenate(([0], np.cumsum(size[at:to])))
        found = contexts(part, inner)
        shift = (start[at:to] - inner[:-1])[found["text"]]
        yield found | {"text": text[at:to][found["text"]], "first": found["first"] + shift, "last": found["last"] + shift, "within": found["first"]}
        at = to


def key_of(k: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix64(mix64(k) + c) >> np.uint64(8)


def planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, each byte's plane by itself: sorted numbers compress so."""
    return values.view(np.uint8).reshape(len(values), -1)[:, :width].T.tobytes()


def from_planes(data: bytes, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view(np.uint64).ravel()


def pack_docs(doc: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A head and the distinct ids as steps from one to the next, and each row's number among them."""
    docs, which = np.unique(doc, return_inverse=True)
    width = 2 if len(docs) <= 1 << 16 else 4
    head = np.array([len(doc), len(docs), width], "<u4").tobytes()
    return head + planes(np.diff(docs.astype("<i8"), prepend=0).view(np.uint64), 8), which.astype(f"<u{width}")


def unpack_docs(data: bytes) -> tuple[int, np.ndarray, int, int]:
    """Rows, ids, the width of their numbers, and where the rest begins."""
    n, d, width = (int(v) for v in np.frombuffer(data, "<u4", 3))
    return n, np.cumsum(from_planes(data, d, 8, 12).view(np.int64)), width, 12 + 8 * d


def pack_anchors(rows: np.ndarray) -> bytes:
    """Rows in the order of their anchors, which are packed as steps."""
    head, which = pack_docs(rows["doc"])
    return head + planes(np.diff(rows["k"], prepend=np.uint64(0)), 5) + planes(np.ascontiguousarray(rows["c"]), 7) + which.tobytes()


def unpack_anchors(data: bytes) -> np.ndarray:
    n, docs, width, at = unpack_docs(data)
    out = np.empty(n, ANCHORED)
    out["k"], out["c"] = np.cumsum(from_planes(data, n, 5, at)), from_planes(data, n, 7, at + 5 * n)
    out["doc"] = docs[np.frombuffer(data, f"<u{width}", n, at + 12 * n)]
    return out


def pack_fates(rows: np.ndarray) -> bytes:
    rows = rows[np.argsort(rows["doc"], kind="stable")]  # the ids' numbers are runs then
    head, which = pack_docs(rows["doc"])
    return head + planes(np.ascontiguousarray(rows["key"]), 7) + planes(which.astype(np.uint64), which.itemsize) + rows["fate"].tobytes()


def unpack_fates(data: bytes) -> np.ndarray:
    n, docs, width, at = unpack_docs(data)
    out = np.empty(n, FATED)
    out["key"], out["fate"] = from_planes(data, n, 7, at), np.frombuffer(data, np.uint8, n, at + (7 + width) * n)
    out["doc"] = docs[from_planes(data, n, width, at + 7 * n).astype(np.int64)]
    return out


def by_bucket(to: np.ndarray, rows: np.ndarray, kind: int, pack=lambda rows: rows.tobytes()) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    order = np.argsort(to, kind="stable")
    to, rows = to[order], rows[order]
    at = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    cut = [pack(rows[a:z]) for a, z in zip(at, np.append(at[1:], len(rows)), strict=True)]
    yield packs(to[at], kind, cut)


def packs(to: np.ndarray, kind: int, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(to), pa.int32()), pa.array([kind] * len(data), pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "data"])


PACKS = "bucket int, kind int, data binary"


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(doc ^ (doc >> 15) ^ (doc >> 31), buckets)


def doc_bucket_column(doc: Column, buckets: int) -> Column:
    return F.pmod(doc.bitwiseXOR(F.shiftright(doc, 15)).bitwiseXOR(F.shiftright(doc, 31)), F.lit(buckets)).cast("int")


def dealt_anchors(rows: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each context the smallest id only: kind 0 by anchor; of frequent anchors kind 2 by context, and kind 3 by anchor,
    a row that tells the rest that it is frequent. Kind 1 by id: larger ids, whose fate is known."""
    rows = rows[np.lexsort((rows["doc"], rows["c"], rows["k"]))]
    head = np.append(True, (rows["k"][1:] != rows["k"][:-1]) | (rows["c"][1:] != rows["c"][:-1]))
    first = rows[head]
    known = fated(rows[rows["doc"] > first["doc"][np.cumsum(head) - 1]], WHOLE)
    yield from by_bucket(doc_bucket(known["doc"], buckets), known, 1, pack_fates)
    new = np.append(True, first["k"][1:] != first["k"][:-1])
    number = np.cumsum(new) - 1
    frequent = np.bincount(number)[number] > FEW
    rare, mark, often = first[~frequent], first[new & frequent], first[frequent]
    by_anchor = lambda rows: (rows["k"] * np.uint64(buckets) >> np.uint64(40)).astype(np.int64)  # noqa: E731  by range, so that steps are small
    yield from by_bucket(by_anchor(rare), rare, 0, pack_anchors)
    yield from by_bucket(by_anchor(mark), mark, 3, pack_anchors)
    yield from by_bucket((mix64(key_of(often["k"], often["c"])) % np.uint64(buckets)).astype(np.int64), often, 2, pack_anchors)


def fated(rows: np.ndarray, fate: int) -> np.ndarray:
    out = np.empty(len(rows), FATED)
    out["doc"], out["key"], out["fate"] = rows["doc"], key_of(rows["k"], rows["c"]), fate
    return out[np.append(True, (out["key"][1:] != out["key"][:-1]) | (out["doc"][1:] != out["doc"][:-1]))] if len(out) else out


def anchors(texts: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in text_chunks(batches, most=HASHED_BYTES):
            x, bounds = bytes_of(batch.column("text"))
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for found in in_parts(x, bounds):
                rows = np.empty(len(found["k"]), ANCHORED)
                rows["k"], rows["c"], rows["doc"] = found["k"], found["c"], docs[found["text"]]
                held.append(rows)
                size += len(rows)
                if size > DEALT_ROWS:
                    yield from dealt_anchors(np.concatenate(held), buckets)
                    held, size = [], 0
        if held:
            yield from dealt_anchors(np.concatenate(held), buckets)

    return texts.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(lambda batches: trimmed(run(batches)), PACKS)


def decided(rows: np.ndarray, marked: np.ndarray, by_window: bool, doc_buckets: int) -> Iterator[pa.RecordBatch]:
    """Fates of a bucket's contexts: the smallest id's are compared where another document's has its anchor and the bytes
    on a side of it, the others go whole."""
    rows = rows[np.lexsort((rows["doc"], rows["c"], rows["k"]))]
    k_new = np.append(True, rows["k"][1:] != rows["k"][:-1])
    c_new = k_new | np.append(True, rows["c"][1:] != rows["c"][:-1])
    later = rows["doc"] > rows["doc"][np.flatnonzero(c_new)][np.cumsum(c_new) - 1]
    single = np.isin(rows["k"], marked) if len(marked) and not by_window else np.full(len(rows), by_window)
    alike = np.zeros(len(rows), bool)
    # one anchor's first rows of a context; those of one context are of one id, so that two ids are two contexts
    rows_n = np.diff(np.append(np.flatnonzero(k_new), len(rows)))
    left = np.flatnonzero(~later & ~single & np.repeat(rows_n > 1, rows_n))
    for tag in sides(rows["c"][left]):
        met = left[tag > 0]
        alike[met[shared(rows["k"][met], tag[tag > 0], rows["doc"][met])]] = True
    out = np.concatenate([fated(rows[which], fate) for which, fate in ((later, WHOLE), (~later & single, BY_WINDOW), (alike, COMPARED))])
    yield from by_bucket(doc_bucket(out["doc"], doc_buckets), out, 0, pack_fates)


def shared(k: np.ndarray, tag: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether rows of several documents have a row's (k, tag)."""
    out = np.zeros(len(k), bool)
    if len(k):
        order = np.lexsort((tag, k))
        k, tag, doc = k[order], tag[order], doc[order]
        new = np.append(True, (k[1:] != k[:-1]) | (tag[1:] != tag[:-1]))
        at = np.flatnonzero(new)
        out[order] = (np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at))[np.cumsum(new) - 1]
    return out


def fates(dealt: DataFrame, buckets: int, doc_buckets: int) -> DataFrame:
    """What becomes of contexts whose anchor several documents have, packed by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list[bytes]]] = {}
        for batch in batches:
            for bucket, kind, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "data")), strict=True):
                if kind == 1:
                    yield packs([bucket], 0, [data])  # they are of one bucket of documents already
                else:
                    held.setdefault(bucket, {0: [], 2: [], 3: []})[kind].append(data)
        while held:  # a bucket at a time, whatever else came to this task
            packs_of = held.popitem()[1]
            marked = np.unique(np.concatenate([unpack_anchors(d)["k"] for d in packs_of[3]])) if packs_of[3] else np.zeros(0, np.uint64)
            for kind in (0, 2):
                if packs_of[kind]:
                    rows = np.concatenate([unpack_anchors(d) for d in packs_of.pop(kind)])
                    yield from decided(rows, marked, kind == 2, doc_buckets)

    return in_buckets(dealt, buckets).mapInArrow(lambda batches: trimmed(run(batches)), PACKS)


def squeezed(texts: DataFrame, bucket: Column) -> DataFrame:
    """(bucket, kind, doc_id, uid, data): texts packed for the way, to meet packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in text_chunks(batches):
            data = [press.compress(t.encode("utf-8", "surrogatepass")) if t is not None else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array([9] * batch.num_rows, pa.int32()), batch.column("doc_id"), batch.column("uid"), pa.array(data, pa.binary())], ["bucket", "kind", "doc_id", "uid", "data"])

    return texts.select(F.coalesce(bucket, F.lit(0)).alias("bucket"), "doc_id", "uid", "text").mapInArrow(lambda batches: trimmed(run(batches)), "bucket int, kind int, doc_id long, uid long, data binary")


def meeting(found: DataFrame, texts: DataFrame, buckets: int) -> DataFrame:
    """Packs and texts of each bucket in one partition, in any order."""
    return in_buckets(found.select("bucket", "kind", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("uid"), "data").unionAll(texts), buckets)


def unsqueezed(batches: Iterator[pa.RecordBatch], packs_to: list[bytes], most: int = HASHED_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, list[int | None], list[int]]]:
    """Puts all packs into `packs_to`, then yields texts' bytes, bounds, ids and uids, some at a time.

    A partition's texts are held compressed meanwhile, some MB as buckets go; sorting them in the JVM takes more.
    """
    unpress, held = zstandard.ZstdDecompressor(), []
    for batch in batches:
        for kind, *row in zip(*(batch.column(c).to_pylist() for c in ("kind", "data", "doc_id", "uid")), strict=True):
            if kind == 9:
                held.append(row)
            else:
                packs_to.append(row[0])
    held.reverse()
    while held:
        data, ids, uids, size = [], [], [], 0
        while held and size <= most:
            d, i, u = held.pop()
            data.append(unpress.decompress(d) if d is not None else b"")
            ids.append(i)
            uids.append(u)
            size += len(data[-1])
        yield np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), ids, uids


def candidates(met: DataFrame, buckets: int, uid_buckets: int) -> DataFrame:
    """Cuts (kind 0, by uid) and strings (kind 1, by anchor or by window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fate_packs: list[bytes] = []
        names = fate = None
        gone, gone_n, held, held_size = [], 0, {COMPARED: [], BY_WINDOW: []}, 0

        def strings() -> Iterator[pa.RecordBatch]:
            """What is held, dealt out; of windows the smallest id's only."""
            rows, data = merged(held[BY_WINDOW])
            kept_, later = smallest(rows)
            gone.append((rows["uid"][later], rows["start"][later], rows["start"][later] + WINDOW))
            yield from dealt_strings(*merged([*held[COMPARED], (rows[kept_], data.reshape(-1, WINDOW)[kept_].ravel())]), buckets)
            held[COMPARED], held[BY_WINDOW] = [], []

        for x, bounds, ids, uids in unsqueezed(batches, fate_packs):
            if names is None:
                rows = np.concatenate([unpack_fates(d) for d in fate_packs]) if fate_packs else np.zeros(0, FATED)
                fate_packs.clear()
                names = mix64(rows["doc"].astype(np.uint64)) ^ rows["key"]
                order = np.lexsort((rows["fate"], names))
                names, fate = names[order], rows["fate"][order]
                del rows, order
            if not len(names):
                continue
            every_id, every_doc, every_uid = np.array([i is not None for i in ids], bool), np.array([0 if i is None else i for i in ids], np.int64), np.array(uids, np.int64)
            for found in in_parts(x, bounds):
                has_id, doc, uid = every_id[found["text"]], every_doc[found["text"]], every_uid[found["text"]]
                own = mix64(doc.astype(np.uint64)) ^ key_of(found["k"], found["c"])
                at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                mine = np.where((names[at] == own) & has_id, fate[at], 0)
                start = found["first"] - bounds[found["text"]]
                size = found["last"] - found["first"] + WINDOW
                whole = mine == WHOLE
                gone.append((uid[whole], start[whole], (start + size)[whole]))
                which = np.flatnonzero(mine == COMPARED)
                held[COMPARED].append(string_rows(x, mix64(found["k"][which]), doc[which], uid[which], found["first"][which], start[which], size[which]))
                which = np.flatnonzero(mine == BY_WINDOW)  # a string for each window
                count = found["last"][which] - found["first"][which] + 1
                p, w = ragged(found["first"][which], count), found["w"][ragged(found["within"][which], count)]
                which = np.repeat(which, count)
                rows, data = string_rows(x, mix64(w), doc[which], uid[which], p, p - bounds[found["text"][which]], np.full(len(p), WINDOW))
                kept_, later = smallest(rows)
                gone.append((rows["uid"][later], rows["start"][later], rows["start"][later] + WINDOW))
                held[BY_WINDOW].append((rows[kept_], data.reshape(-1, WINDOW)[kept_].ravel()))
                held_size += sum(r.nbytes + d.nbytes for r, d in (held[COMPARED][-1], held[BY_WINDOW][-1]))
                gone_n += int(whole.sum()) + len(later)
                if held_size > HELD_BYTES:
                    yield from strings()
                    held_size = 0
                if gone_n > HELD_CUTS:
                    yield from cuts(*map(np.concatenate, zip(*gone, strict=True)), uid_buckets)
                    gone, gone_n = [], 0
        yield from strings()
        yield from cuts(*map(np.concatenate, zip(*gone, strict=True)), uid_buckets)

    return met.mapInArrow(lambda batches: trimmed(run(batches)), PACKS)


def string_rows(x: np.ndarray, key: np.ndarray, doc: np.ndarray, uid: np.ndarray, place: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is told of strings, and their bytes, which begin at `place` in `x`."""
    rows = np.empty(len(key), STRING)
    rows["key"], rows["doc"], rows["uid"], rows["start"], rows["size"] = key, doc, uid, start, size
    return rows, x[ragged(place, size)]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate([r for r, _ in parts]), np.concatenate([d for _, d in parts])) if parts else (np.zeros(0, STRING), np.zeros(0, np.uint8))


def smallest(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are of the smallest id of their key, and which are not."""
    order = np.lexsort((rows["doc"], rows["key"]))
    key, doc = rows["key"][order], rows["doc"][order]
    head = np.append(True, key[1:] != key[:-1])[: len(key)]
    later = doc > doc[head][np.cumsum(head) - 1]
    return order[~later], order[later]


def dealt_strings(rows: np.ndarray, data: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    to = (rows["key"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    size = rows["size"].astype(np.int64)
    at = np.cumsum(size) - size
    order = np.lexsort((rows["key"], to))
    heads = np.flatnonzero(np.append(True, to[order][1:] != to[order][:-1]))
    out = [np.uint32(len(part)).tobytes() + rows[part].tobytes() + data[ragged(at[part], size[part])].tobytes() for part in np.split(order, heads[1:])]
    yield packs(to[order][heads].astype(np.int64), 1, out)


def cuts(uid: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Removed runs by uid, those that touch made one."""
    if not len(uid):
        return
    order = np.lexsort((start, uid))
    uid, start, end = uid[order], start[order], end[order]
    new = np.append(True, (uid[1:] != uid[:-1]) | (start[1:] > end[:-1]))
    at = np.flatnonzero(new)
    rows = np.empty(len(at), CUT)
    rows["uid"], rows["start"], rows["end"] = uid[at], start[at], np.maximum.reduceat(end, at)
    yield from by_bucket(np.mod(rows["uid"], buckets), rows, 0)


def compared(strings: DataFrame, buckets: int, uid_buckets: int) -> DataFrame:
    """Cuts from strings of one anchor (or one window), by suffix arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, data = [], []
        for batch in batches:
            for d in batch.column("data").to_pylist():
                n = int(np.frombuffer(d, "<u4", 1)[0])
                rows.append(np.frombuffer(d, STRING, n, 4))
                data.append(d[4 + n * STRING.itemsize :])
        if rows:
            for uid, start, end in repeats(np.concatenate(rows), np.frombuffer(b"".join(data), np.uint8)):
                yield from cuts(uid, start, end, uid_buckets)

    return in_buckets(strings, buckets).mapInArrow(lambda batches: trimmed(run(batches)), PACKS)


def repeats(rows: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(uid, start, end) of windows that a smaller id's string of the same key has.

    Equal strings are entered once, with their smallest id; the others go whole.
    """
    size = rows["size"].astype(np.int64)
    at = np.cumsum(size) - size
    name = np.array([hash(x[a : a + n].tobytes()) for a, n in zip(at, size, strict=True)], np.int64)
    order = np.lexsort((rows["doc"], name, rows["key"]))
    key, name, doc = rows["key"][order], name[order], rows["doc"][order]
    head = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))
    string = np.cumsum(head) - 1
    later = doc > doc[head][string]
    r = rows[order]
    yield r["uid"][later], r["start"][later], r["start"][later] + r["size"][later]
    one, s_key, s_doc = order[head], key[head], doc[head]
    k_head = np.append(True, s_key[1:] != s_key[:-1])
    lane = np.cumsum(k_head) - 1
    lane_n = np.bincount(lane)
    bytes_n = np.bincount(lane, size[one] + 1).astype(np.int64) + 1
    first_of = np.flatnonzero(k_head)
    todo = np.flatnonzero(lane_n > 1)
    todo = todo[np.lexsort((bytes_n[todo], lane_n[todo] > MANY))]
    gone_string, gone_at = [], []
    total = np.cumsum(bytes_n[todo])
    while len(todo):  # lanes of about one length at a time
        n = max(1, int(np.searchsorted(total - (total[0] - bytes_n[todo[0]]), SORTED_BYTES)))
        many = lane_n[todo[:n]] > MANY  # those come last
        n = n if many[0] else int(n - many.sum())
        part, todo, total = todo[:n], todo[n:], total[n:]
        members = ragged(first_of[part], lane_n[part])
        length = size[one[members]]
        bounds = np.concatenate(([0], np.cumsum(bytes_n[part])))
        ends = np.repeat(bounds[:-1], lane_n[part]) + (np.cumsum(length + 1) - np.repeat(np.cumsum(np.bincount(np.repeat(np.arange(len(part)), lane_n[part]), length + 1)) - np.bincount(np.repeat(np.arange(len(part)), lane_n[part]), length + 1), lane_n[part]).astype(np.int64))
        starts = ends - length - 1
        text = np.ones(bounds[-1], np.int16)  # 1 ends a string, 0 a text
        text[bounds[1:] - 1] = 0
        text[ragged(starts, length)] = x[ragged(at[one[members]], length)].astype(np.int16) + 2
        of = np.full(bounds[-1], -1, np.int64)
        windows = length - WINDOW + 1
        places = ragged(starts, windows)
        of[places] = np.repeat(np.arange(len(members)), windows)
        sa = ordered_to(text, bounds, WINDOW) if many[0] else suffix_arrays(text, bounds)
        sa = sa[of[sa] >= 0]
        same = np.zeros(len(sa), bool)
        span = np.arange(WINDOW)
        for a in range(1, len(sa), 40_000):
            z = min(len(sa), a + 40_000)
            same[a:z] = (text[sa[a:z, None] + span] == text[sa[a - 1 : z - 1, None] + span]).all(axis=1)
        same &= np.append(False, np.searchsorted(bounds, sa[1:], side="right") == np.searchsorted(bounds, sa[:-1], side="right")) if len(sa) else same
        if not len(sa):
            continue
        heads = np.flatnonzero(~same)
        d = s_doc[members[of[sa]]]
        least = np.minimum.reduceat(d, heads)[np.cumsum(~same) - 1]
        gone = sa[d > least]
        gone_string.append(members[of[gone]])
        gone_at.append(gone - starts[of[gone]])
    if not gone_string:
        return
    gs, ga = np.concatenate(gone_string), np.concatenate(gone_at)
    # every row of the string with its smallest id loses these windows
    keep = np.flatnonzero(~later)
    rows_of = np.bincount(string[keep], minlength=len(one))
    first_row = np.cumsum(rows_of) - rows_of
    count = rows_of[gs]
    which = keep[ragged(first_row[gs], count)]
    begin = r["start"][which] + np.repeat(ga, count)
    yield r["uid"][which], begin, begin + WINDOW


def kept(met: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) from texts and their cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_packs: list[bytes] = []
        table = None
        for x, bounds, ids, uids in unsqueezed(batches, cut_packs):
            if table is None:
                table = np.concatenate([np.frombuffer(d, CUT) for d in cut_packs]) if cut_packs else np.zeros(0, CUT)
                table = table[np.lexsort((table["start"], table["uid"]))]
            out: dict[str, list] = {"doc_id": ids, "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            low, high = np.searchsorted(table["uid"], uids, "left"), np.searchsorted(table["uid"], uids, "right")
            for i in range(len(ids)):
                body = x[bounds[i] : bounds[i + 1]]
                mine = table[low[i] : high[i]] if ids[i] is not None else table[:0]
                sha, at, spans, removed = hashlib.sha256(), 0, 0, 0
                if len(mine):
                    reach = np.maximum.accumulate(mine["end"])
                    new = np.flatnonzero(np.append(True, mine["start"][1:] > reach[:-1]))
                    for a, z in zip(mine["start"][new].tolist(), reach[np.append(new[1:], len(mine)) - 1].tolist(), strict=True):
                        sha.update(body[at:a])
                        at, spans, removed = z, spans + 1, removed + z - a
                sha.update(body[at:])
                for c, v in (("n_bytes", len(body)), ("n_removed", removed), ("n_spans", spans), ("kept_sha256", sha.hexdigest())):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    return met.mapInArrow(lambda batches: trimmed(run(batches)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of `docs`."""
    own = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    named = own.where("doc_id IS NOT NULL")
    buckets = max(9, text_bytes(own) // BUCKET_BYTES) | 1
    fated_ = fates(anchors(named, buckets), buckets, buckets)
    texts = squeezed(named, doc_bucket_column(F.col("doc_id"), buckets))
    with small_batches(docs.sparkSession):
        found = checkpointed(candidates(meeting(fated_, texts, buckets), buckets, buckets))
    del fated_, texts
    release(docs.sparkSession)
    more = compared(found.where("kind = 1"), buckets, buckets)
    again = squeezed(named, F.pmod("uid", F.lit(buckets)).cast("int"))
    # rows without id meet nothing: they are read where they lie
    whole = squeezed(own.where("doc_id IS NULL"), F.lit(0))
    return kept(meeting(found.where("kind = 0").unionAll(more), again, buckets)).unionAll(kept(whole.select("bucket", "kind", "doc_id", "uid", "data")))
