"""Token ids in sorted-string-table shards.

Documents are encoded with a tokenizer file, dealt out by ranges of their identifier and written, in ascending order,
to one shard for each range. A shard holds prefix-compressed blocks of (key, ids), a sparse index with the last key of
each block, a Bloom filter, a description and a footer; a lookup reads footer, filter, index and one block.

Shard layout: blocks | index | filter | description | footer. A stored block is a crc32, then zstd of entries
(shared key bytes, further key bytes, value bytes as varints; key rest; value), offsets of the restart entries, whose
keys are whole, and their number. Keys are 8 bytes, ascending like the identifiers; a null identifier is the empty key
and comes first. Values are ids of 2 or 4 bytes, little-endian, as the vocabulary needs.

Cases: a null or empty text has only the end id; rows with the same identifier all stay, ordered by a hash of the text;
an empty table makes no shards and an empty result; further columns of the input are ignored.

Shards are written by a temporary name and moved, so that a repeated task leaves whole files only. The shared folder is
reached through pyarrow's file systems (file, s3, gs; hdfs where libhdfs is installed).
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept, shared_dir
from .pretokens import Cache, quiet_collector
from .token_counts import byte_letters

MAGIC = b"SILSST01"
FOOTER = struct.Struct("<QIQIQI8s")
BLOCK_BYTES = 64 << 10
RESTART = 16
BITS_PER_KEY, PROBES = 10, 7
END_ID = 1
#: Array codes of unsigned integers by their bytes.
_CODES = {2: "H", 4: "I"}


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Bloom:
    """A Bloom filter over keys, with double hashing."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _hashes(key: bytes) -> tuple[int, int]:
        h = xxhash.xxh64_intdigest(key)
        return h & 0xFFFFFFFF, h >> 32 | 1

    @classmethod
    def of(cls, keys: list[bytes]) -> Bloom:
        size = max(64, len(keys) * BITS_PER_KEY + 7 & ~7)
        bits = np.zeros(size, dtype=bool)
        if keys:
            h = np.array([cls._hashes(k) for k in keys], dtype=np.uint64)
            for i in range(PROBES):
                bits[(h[:, 0] + np.uint64(i) * h[:, 1]) % np.uint64(size)] = True
        return cls(bits)

    def may_hold(self, key: bytes) -> bool:
        a, b = self._hashes(key)
        return all(self.bits[(a + i * b) % len(self.bits)] for i in range(PROBES))


class ShardWriter:
    """Writes entries, given in key order, to a stream."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.n_tokens = self.n_docs = 0
        self._begin()

    def _begin(self) -> None:
        self.parts: list[bytes] = []
        self.size = self.entries = 0
        self.restarts: list[int] = []
        self.last = b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.entries % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.parts += (entry, value)
        self.size += len(entry) + len(value)
        self.entries += 1
        self.last = key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.n_docs += 1
        self.n_tokens += len(value) // self.width
        if self.size >= BLOCK_BYTES:
            self._end_block()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _end_block(self) -> None:
        if not self.entries:
            return
        raw = b"".join(self.parts) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        packed = self.pack(raw)
        self.index.append((self.last, *self._put(struct.pack("<I", zlib.crc32(packed)) + packed)))
        self._begin()

    def close(self) -> None:
        self._end_block()
        index = self._put(b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QI", at, size) for k, at, size in self.index))
        bloom = self._put(np.packbits(Bloom.of(self.keys).bits).tobytes())
        about = self._put(json.dumps({"width": self.width, "n_docs": self.n_docs, "n_tokens": self.n_tokens}).encode())
        self._put(FOOTER.pack(*index, *bloom, *about, MAGIC))


class ShardError(ValueError):
    """A damaged shard."""


class Shard:
    """Reader of one shard."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        if size < FOOTER.size:
            raise ShardError(uri)
        index_at, index_n, bloom_at, bloom_n, about_at, about_n, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ShardError(uri)
        about = json.loads(self._read(about_at, about_n))
        self.width, self.n_docs, self.n_tokens = about["width"], about["n_docs"], about["n_tokens"]
        self.bloom = Bloom(np.unpackbits(np.frombuffer(self._read(bloom_at, bloom_n), np.uint8)).astype(bool))
        raw, at = self._read(index_at, index_n), 0
        self.last_keys: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        while at < len(raw):
            n = raw[at]
            self.last_keys.append(raw[at + 1 : at + 1 + n])
            self.blocks.append(struct.unpack_from("<QI", raw, at + 1 + n))
            at += 13 + n

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        raw = self._read(*self.blocks[k])
        if zlib.crc32(raw[4:]) != struct.unpack_from("<I", raw)[0]:
            raise ShardError(f"checksum of block {k}")
        data = zstandard.ZstdDecompressor().decompress(raw[4:])
        n = struct.unpack_from("<I", data, len(data) - 4)[0]
        end = len(data) - 4 - 4 * n
        return data[:end], list(struct.unpack_from(f"<{n}I", data, end))

    def _entries(self, data: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, value in self._entries(self._block(k)[0], 0):
                yield id_of(key), np.frombuffer(value, f"<u{self.width}")

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this identifier: filter, search in the index, search among restart entries."""
        key = key_of(doc_id)
        if not self.bloom.may_hold(key):
            return []
        out = []
        for k in range(bisect.bisect_left(self.last_keys, key), len(self.blocks)):
            data, restarts = self._block(k)
            r = max(0, bisect.bisect_left(restarts, key, key=lambda at: next(self._entries(data, at))[0]) - 1)
            for found, value in self._entries(data, restarts[r]):
                if found > key:
                    return out
                if found == key:
                    out.append(np.frombuffer(value, f"<u{self.width}"))
        return out


#: Characters whose lower case, normal form and kind are the same by any version of Unicode, and so in Python and in the
#: library: printable ASCII, Latin-1 letters and Latin Extended-A without the dotted capital I.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
#: The letters among them: a run of letters is one word.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
#: The tokenizer's split pattern on such characters in lower case.
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^0-9a-z\u00df-\u00f6\u00f8-\u017f]+").findall
#: The normalizer and splitter of a tokenizer file for which ``_SPLIT`` and cutting at white space stand.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


class Encoder:
    """Ids of whole texts by a tokenizer file.

    A file with exactly the settings ``_KNOWN`` drops white space and never looks across it, so the library encodes each
    run between white space alike wherever it stands, and each distinct run is encoded once. Runs of plain characters
    are lower-cased and split here and only their distinct words go through the library's model; other runs go through
    the library's normalizer and splitter as well. Texts with a special token's string, or with separators that only
    Python takes for white space, go to the library whole, as all texts do with any other file.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = all(spec.get(k) == v for k, v in _KNOWN.items())
        self.letters = str.maketrans({chr(b): letter for letter, b in byte_letters().items()})
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.end = np.array([end_id], f"<u{self.width}").tobytes()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] + [chr(c) for c in range(0x1C, 0x20)]
        self.words = Cache(self._word)
        self.runs = Cache(self._run)

    def release(self) -> None:
        """Gives up the caches, whose functions hold on to the encoder."""
        self.words.clear()
        self.runs.clear()

    def _word(self, word: str) -> bytes:
        """The ids of a plain word, from the library's model."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array(_CODES[self.width], [t.id for t in self.model.tokenize(word)]).tobytes()

    def _run(self, run: str) -> bytes:
        """The ids of a run between white space."""
        if _LETTERS(run):
            return self.words[run.lower()]
        if _PLAIN(run):
            return b"".join([self.words[w] for w in _SPLIT(run.lower())])
        return self._library([run])[0]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(_CODES[self.width], e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.plain:
            return [ids + self.end for ids in self._library(texts)]
        ids, special = self.runs.__getitem__, self.special
        return [self._library([x])[0] + self.end if any(s in x for s in special) else b"".join(map(ids, x.split())) + self.end for x in texts]


def encoder(path: str, end_id: int) -> Encoder:
    """The encoder of a file, kept while the worker needs it; it uses one thread, as its task does."""

    def build() -> Encoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made = Encoder(path, end_id)
        quiet_collector()
        return made

    return kept(("encoder", path, end_id), build)


@dataclass(frozen=True)
class ShardInfo:
    """One written shard; ``start`` counts the ids of all shards before it."""

    uri: str
    n_docs: int
    n_tokens: int
    start: int


def write_shards(docs: DataFrame, path: str, target: str, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> list[ShardInfo]:
    """Writes the shards below ``target``; the driver gets one row for each shard."""
    bounded_batches(docs.sparkSession)
    tie = F.xxhash64(F.col(text))
    dealt = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("x"), tie.alias("tie")).repartitionByRange("k", "tie").sortWithinPartitions("k", "tie")
    fs, root = pafs.FileSystem.from_uri(target)
    fs.create_dir(root, recursive=True)

    def run(batches):
        encode = encoder(path, end_id)
        part, fs, root, temporary, writer, out = TaskContext.get().partitionId(), None, "", "", None, None
        for batch in batches:
            keys, texts = batch.column("k").to_pylist(), [x or "" for x in batch.column("x").to_pylist()]
            if keys and writer is None:
                fs, root = pafs.FileSystem.from_uri(target)
                temporary = f"{root}/.{part:06d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(temporary)
                writer = ShardWriter(out, encode.width)
            for k, ids in zip(keys, encode.encode(texts), strict=True):
                writer.add(key_of(k), ids)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(temporary, f"{root}/part-{part:06d}.sst")
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]})

    found, start = [], 0
    for row in sorted(dealt.select("k", "x").mapInArrow(run, "part long, n_docs long, n_tokens long").collect()):
        found.append(ShardInfo(f"{target}/part-{row.part:06d}.sst", row.n_docs, row.n_tokens, start))
        start += row.n_tokens
    return found


def read_shards(spark, shards: list[ShardInfo], key: str = "doc_id") -> DataFrame:
    """A row for each stored document: identifier, start, n_tokens, ids_crc32. One task reads one shard, block by block."""
    schema = f"{key} long, start long, n_tokens long, ids_crc32 long"
    listed = spark.createDataFrame([(s.uri, s.start) for s in shards], "uri string, start long")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows = []
                for doc_id, ids in Shard(uri):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

    return listed.repartition(max(1, len(shards))).mapInArrow(run, schema)


def token_shards(docs: DataFrame, path: str, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes the shards to the shared folder and returns what they hold."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, path, shared_dir(spark, "shards"), end_id, text, key), key)
