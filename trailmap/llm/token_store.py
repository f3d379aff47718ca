"""Token ids in sorted-string-table shards: written by range of ids, looked up by binary search.

A shard holds documents in ascending order of their key. File layout, all numbers little-endian:

    block*     entries, then a crc32 of them (4 bytes)
    entry      varint shared, varint unshared, varint ids; the key's unshared bytes; the ids as uint16 or, if the writer is told so, uint32
    index      for each block: u64 offset, u32 length, u32 entries, u64 ids before it in the shard, u16 key length, first key
    bloom      bits of a Bloom filter over the keys
    footer     u64 index offset, u64 index length, u64 bloom offset, u64 bloom bits, u64 entries, u64 ids, u32 bytes an id, u32 crc32 of index and bloom, MAGIC

Keys are prefix-compressed against the entry before them and whole at a block's start, so
a reader needs the footer, the sparse index and one block to find a document. A key is a
flag byte (0 for null) and the id as 8 big-endian bytes with the sign turned, so that byte
order is number order with null first.

Defined cases: a null or empty text has only the end id; equal ids stay apart as entries
of their own, ordered by a hash of the text; an empty table has no shard and gives an empty result;
further columns of the input are not looked at.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import coded_words, ragged, text_chunks, trimmed, work_dir

MAGIC = b"TRAILSST"
FOOTER = struct.Struct("<QQQQQQII8s")
INDEX = struct.Struct("<QIIQH")
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_PROBES = 10, 7
#: Text that is encoded at once, and words that go to the model as one text.
CODED_BYTES, JOINED = 8 << 20, 1024


def key_of(ident: int | None) -> bytes:
    return b"\0" if ident is None else b"\1" + struct.pack(">Q", (ident + (1 << 63)) & ((1 << 64) - 1))


def ident_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Writes one shard from documents in ascending key order; holds a block, the sparse index and 9 bytes a key."""

    def __init__(self, out, width: int = 2, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.at = self.ids = self.entries = 0
        self.index, self.keys, self.block, self.size, self.last, self.began = [], [], [], 0, b"", None

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        if not self.block:
            self.began = (key, self.ids)
            shared = 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        entry = varint(shared) + varint(len(key) - shared) + varint(len(ids)) + key[shared:] + ids.astype(f"<u{self.width}").tobytes()
        self.block.append(entry)
        self.size += len(entry)
        self.keys.append(key)
        self.last = key
        self.ids += len(ids)
        self.entries += 1
        if self.size >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = b"".join(self.block)
            data += struct.pack("<I", zlib.crc32(data))
            self.out.write(data)
            key, before = self.began
            self.index.append(INDEX.pack(self.at, len(data), len(self.block), before, len(key)) + key)
            self.at += len(data)
            self.block, self.size = [], 0

    def finish(self) -> None:
        self.flush()
        index, bits = b"".join(self.index), max(64, (self.entries * BLOOM_BITS + 7) // 8 * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index + bytes(bloom))
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.entries, self.ids, self.width, zlib.crc32(index + bytes(bloom)), MAGIC))


class ShardReader:
    """Reads a shard from a seekable file: one document by key, or all in order, a block at a time."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - FOOTER.size)
        at, length, bloom_at, self.bits, self.entries, self.ids, self.width, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(at)
        tail = file.read(length + self.bits // 8)
        if zlib.crc32(tail) != crc or bloom_at != at + length:
            raise ValueError("the shard's index is damaged")
        self.bloom, self.blocks, self.firsts, p = tail[length:], [], [], 0
        while p < length:
            offset, size_, entries, before, n = INDEX.unpack_from(tail, p)
            p += INDEX.size
            self.blocks.append((offset, size_, before))
            self.firsts.append(tail[p : p + n])
            p += n

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, size, _ = self.blocks[i]
        self.file.seek(offset)
        data = self.file.read(size)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        at, key = 0, b""
        while at < size - 4:
            shared, at = read_varint(data, at)
            unshared, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, np.frombuffer(data, f"<u{self.width}", n, at).astype("<u4")
            at += self.width * n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def get(self, ident: int | None) -> list[np.ndarray]:
        """The ids of all documents with this id; the Bloom filter spares most reads for absent ones."""
        key = key_of(ident)
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, self.bits)):
            return []
        found, i = [], max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.blocks) and self.firsts[i] <= key:
            found += [ids for k, ids in self.block(i) if k == key]
            i += 1
        return found


# fixed values: the form of tokenizer file for which a text's ids are those of its words
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
WORD_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
WORD_END = "</w>"

#: A word of Latin letters with marks after it: it is cut between the two, lower case is one character for one, and its letters are NFC.
LETTERS_AND_MARKS = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


def byte_letters() -> dict[int, str]:
    """Letters beyond ASCII as the characters that stand for their bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return {c: "".join(stands[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordEncoder:
    """Ids of whole texts, encoding each distinct word of a call once.

    A vocabulary of words (WORD_NORMALIZER, WORD_SPLIT, WORD_BYTES) drops white space and no
    token crosses it, so a text's ids are those of its words in order. Letters and the
    marks after them are pieces of their own there, so words that differ in case or marks
    share their letters' ids; letters go to the same model many at a time without the
    steps that would leave them as they are. All other words go through the whole
    tokenizer, and with any other kind of file, whole texts do.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        model = spec["model"]
        self.by_words = spec["normalizer"] == WORD_NORMALIZER and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [WORD_SPLIT, WORD_BYTES]} and model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END and not model["continuing_subword_prefix"] and not model["dropout"] and not model["unk_token"]
        if self.by_words:
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(WORD_END)]] = True
            self.letters = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))
            self.shown = byte_letters()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one text's after another's, and how many each has."""
        out, sizes = [np.zeros(0, self.dtype)], []
        for at in range(0, len(texts), 10_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + 10_000], add_special_tokens=False)]
            sizes += map(len, found)
            out.append(np.fromiter(itertools.chain.from_iterable(found), self.dtype))
        return np.concatenate(out), np.array(sizes, np.int64)

    def of_stems(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Like `encode`, for words of lower-case letters: the last token of each ends a word."""
        cuts = np.minimum(np.arange(0, len(stems) + JOINED, JOINED), len(stems)).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), stems), " ").to_pylist()
        found = self.letters.encode_batch_fast([x if x.isascii() else x.translate(self.shown) for x in lines], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, self.dtype), *(np.array(e.ids, self.dtype) for e in found)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(stems):
            return self.encode(stems.to_pylist())
        return ids, np.diff(ends, prepend=0)

    def of_words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Like `encode`, for words without white space."""
        cut = pc.extract_regex(distinct, LETTERS_AND_MARKS)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        stem, marks = (pc.struct_field(cut.drop_null(), f).dictionary_encode() for f in ("stem", "marks"))
        low = pc.utf8_lower(stem.dictionary).dictionary_encode()
        parts = [self.of_stems(low.dictionary), self.encode(marks.dictionary.to_pylist()), self.encode(distinct.filter(pa.array(~plain)).to_pylist())]
        pool, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        starts = np.cumsum(sizes) - sizes
        first, second = np.zeros(len(distinct), np.int64), np.full(len(distinct), len(sizes), np.int64)  # no second part
        first[plain] = low.indices.to_numpy()[stem.indices.to_numpy()]
        second[plain] = len(low.dictionary) + marks.indices.to_numpy()
        first[~plain] = len(low.dictionary) + len(marks.dictionary) + np.arange(len(distinct) - plain.sum())
        both = np.stack([first, second], axis=1)
        starts, sizes = np.append(starts, 0)[both], np.append(sizes, 0)[both]
        return pool[ragged(starts.ravel(), sizes.ravel())], sizes.sum(axis=1)

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by `end_id`, and where each text's begin (one entry more)."""
        if self.by_words:
            codes, offsets, distinct = coded_words(texts)
            flat, sizes = self.of_words(distinct)
        else:
            flat, sizes = self.encode(pc.fill_null(texts, "").to_pylist())
            codes, offsets = np.arange(len(texts)), np.arange(len(texts) + 1)
        n = len(sizes)
        sizes, flat = np.append(sizes, 1), np.append(flat, self.dtype(end_id))
        starts = np.cumsum(sizes) - sizes
        with_end = np.insert(codes, offsets[1:], n)
        counts = sizes[with_end]
        ids = flat[ragged(starts[with_end], counts)]
        bounds = np.concatenate(([0], np.cumsum(counts)))[offsets + np.arange(len(offsets))]
        return ids, bounds


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One for a worker process; it keeps the vocabulary, and nothing of the texts."""
    return WordEncoder(path)


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards under `out` and returns a row for each: shard, path, low, n_docs, n_ids (lazy: an action writes).

    Documents are dealt by range of id (and of a hash of the text, so that an id at very many
    rows, or none, fills no single shard), sorted where they land and streamed into files. A
    file gets its name only when it is whole, and a repeated task writes the same bytes.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer)
        task = TaskContext.get()
        fs, folder = pafs.FileSystem.from_uri(out)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/shard-{task.partitionId():06d}.sst"
        hidden = f"{folder}/.{task.partitionId():06d}-{task.taskAttemptId()}"
        low, writer = None, None
        with fs.open_output_stream(hidden) as stream:
            for batch in text_chunks(batches, most=CODED_BYTES):
                ids, bounds = encode(batch.column("text"), end_id)
                for i, x in enumerate(batch.column("ident").to_pylist()):
                    if writer is None:
                        low, writer = key_of(x), ShardWriter(stream, np.dtype(encode.dtype).itemsize)
                    writer.add(key_of(x), ids[bounds[i] : bounds[i + 1]])
            if writer is not None:
                writer.finish()
        if writer is None:
            fs.delete_file(hidden)
            return
        if fs.get_file_info(name).type != pafs.FileType.NotFound:
            fs.delete_file(name)
        fs.move(hidden, name)
        yield pa.RecordBatch.from_pydict({"path": [name], "low": [low], "n_docs": [writer.entries], "n_ids": [writer.ids]})

    rows = docs.select(F.col(ident).cast("long").alias("ident"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("ident", "hash").sortWithinPartitions("ident", "hash", "text").select("ident", "text")
    return ordered.mapInArrow(lambda batches: trimmed(write(batches)), "path string, low binary, n_docs long, n_ids long")


def read_shards(spark: SparkSession, out: str, shards: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of shards given as (path, ids before it)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(path) as file:
                    found: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                    for key, ids in ShardReader(file, file.size()):
                        for c, v in zip(found, (ident_of(key), start, len(ids), zlib.crc32(ids)), strict=True):
                            found[c].append(v)
                        start += len(ids)
                        if len(found["start"]) >= 10_000:
                            yield pa.RecordBatch.from_pydict(found, schema)
                            found = {c: [] for c in found}
                    yield pa.RecordBatch.from_pydict(found, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    listed = spark.createDataFrame(shards, "path string, start long")
    return listed.repartition(max(1, min(len(shards), 10_000))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 1, ident: str = "doc_id", text: str = "text", out: str | None = None) -> DataFrame:
    """Writes all documents, then reads the shards back: (doc_id, start, n_tokens, ids_crc32).

    The driver gets a row for each shard, with which it lines the shards up.
    """
    spark = docs.sparkSession
    out = out or work_dir(spark, "tokens")
    start, shards = 0, []
    for r in sorted(write_shards(docs, out, tokenizer, end_id, ident, text).collect(), key=lambda r: (bytes(r["low"]), r["path"])):
        shards.append((r["path"], start))
        start += r["n_ids"]
    return read_shards(spark, out, shards)
