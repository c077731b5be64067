"""Token ids of documents in sorted string tables: prefix-compressed blocks, sparse index, Bloom filter, footer."""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyloom.llm.common import bounded_batches, settled, shared_folder, shuffle_width, texts
from keyloom.session import importable

MAGIC = b"KLSST\x00\x01\n"
FOOTER = struct.Struct("<QQQQQQI8s")  # index at, length; filter at, length; documents; ids; crc32 of index and filter; magic
BLOCK_BYTES = 1 << 16
RESTART = 16
BITS_PER_KEY, PROBES = 10, 7
MANIFEST = "path string, first_key binary, n_docs long, n_ids long, n_bytes long"

# Fixed value: the published pre-tokenization pattern of byte-level BPE vocabularies of this kind.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Fixed value: the ASCII signs.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE uses for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of texts by a byte-level BPE vocabulary; words that come again are looked up.

    Where each blank or newline stands alone between two words, the pre-tokenizer ends a piece before it, and a
    blank belongs to the piece after it. So such a text is cut by str.split, which knows all white space that the pattern
    knows; each word is encoded once by the library's model and kept, `limit` words at most, and half as many with
    signs at their end. Other texts are cut by the pattern. A text that holds one of the tokenizer's added
    tokens is encoded by the library as a whole, which knows that token; so are all texts where the file's steps are others than
    a byte-level pre-tokenizer of this pattern before a BPE model.
    """

    def __init__(self, path: str, limit: int = 800_000) -> None:
        tokenizer = Tokenizer.from_file(path)
        self.tokenizer, self.model = tokenizer, tokenizer.model
        names = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.by_word = self._is_plain(tokenizer)
        self.dtype = np.dtype("<u2") if tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.letters = {b: c for b, c in enumerate(_byte_letters()) if chr(b) != c}
        self.code, self.blank = "H" if self.dtype.itemsize == 2 else "I", self.letters[32]
        self.limit, self.signed = limit, 0
        self.words: dict[str, bytes] = {}  # after a blank
        self.pieces: dict[str, bytes] = {}  # as they stand
        self.newline = self.piece("\n") if self.by_word else b""

    @staticmethod
    def _is_plain(tokenizer: Tokenizer) -> bool:
        """Whether the file has the steps that words may be cut and looked up for."""
        made = json.loads(tokenizer.to_str())
        before, model = made["pre_tokenizer"] or {}, made["model"]
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        return bool(plain and made["normalizer"] is None and not made.get("truncation") and model["type"] == "BPE" and not any(map(model.get, odd)))

    def piece(self, piece: str) -> bytes:
        """Ids of what the pre-tokenizer gives as one piece."""
        return self.model_ids(piece.encode("utf-8", "replace").decode("latin-1").translate(self.letters))

    def model_ids(self, letters: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word without white space after a blank."""
        if (found := self.words.get(word)) is not None:
            return found
        if word.isalpha():
            found = self.model_ids(self.blank + word) if word.isascii() else self.piece(f" {word}")
            keep = len(self.words) - self.signed < self.limit
        else:
            stem = word.rstrip(SIGNS)
            found = self.word(stem) + self.plain(word[len(stem) :]) if stem.isalpha() else self.plain(f" {word}")
            keep = self.signed < self.limit // 2
            self.signed += keep
        if keep:
            self.words[word] = found
        return found

    def plain(self, text: str) -> bytes:
        """Ids of any text, by the pattern."""
        out = []
        for piece in PIECES.findall(text):
            found = self.pieces.get(piece)
            if found is None:
                found = self.piece(piece)
                if len(self.pieces) < self.limit // 4:
                    self.pieces[piece] = found
            out.append(found)
        return b"".join(out)

    def __call__(self, text: str) -> bytes:
        if not self.by_word or (self.added and self.added.search(text)):
            known = text.encode("utf-8", "replace").decode()
            return array(self.code, self.tokenizer.encode(known, add_special_tokens=False).ids).tobytes()
        words, starts, at = text.split(), [], 0
        for line in text.split("\n"):
            starts.append(at)
            at += line.count(" ") + 1
        if at != len(words) or len("".join(words)) + at - 1 != len(text):  # white space of other kinds or in runs
            return self.plain(text)
        found = list(map(self.words.get, words))
        for start in starts:
            first = self.plain(words[start])
            found[start] = self.newline + first if start else first
        if None in found:
            found = [self.word(w) if f is None else f for f, w in zip(found, words, strict=True)]
        return b"".join(found)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary and Python worker, so that words stay known between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


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
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def table_key(doc_id: int | None, repeat: int = 0) -> bytes:
    """Order-preserving bytes: null first, then ids ascending; rows that repeat an id are told apart by `repeat`."""
    return struct.pack(">BQI", doc_id is not None, (doc_id or 0) + (1 << 63), repeat)


def key_id(key: bytes) -> int | None:
    known, biased, _ = struct.unpack(">BQI", key)
    return biased - (1 << 63) if known else None


def probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each 64-bit key in a filter of `bits` bits, PROBES for each."""
    h = keys.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return (low[:, None] + high[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


def filter_key(doc_id: int | None) -> int:
    return (1 << 63) + 1 if doc_id is None else doc_id % (1 << 64)


class TableWriter:
    """Writes one table; entries come in ascending key order."""

    def __init__(self, sink, width: int) -> None:
        self.sink, self.at = sink, 0
        self.block, self.size, self.last, self.count, self.n_ids = [], 0, b"", 0, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.ids: list[int] = []
        self.width, self.squeeze = width, zstandard.ZstdCompressor(level=1)
        self._put(MAGIC + bytes([width]))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, repeat: int, value: bytes) -> None:
        key = table_key(doc_id, repeat)
        same = 0
        if self.count % RESTART:
            same = next((k for k, (a, b) in enumerate(zip(key, self.last, strict=True)) if a != b), len(key))
        entry = varint(same) + varint(len(key) - same) + varint(len(value)) + key[same:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.last, self.count = key, self.count + 1
        self.n_ids += len(value) // self.width
        self.ids.append(filter_key(doc_id))
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.squeeze.compress(b"".join(self.block))
            self.index.append((self.last, self.at, len(data)))
            self._put(data)
            self.block, self.size, self.count = [], 0, 0

    def close(self) -> None:
        self._flush()
        index = b"".join(key + struct.pack("<QQ", at, n) for key, at, n in self.index)
        bits = max(64, -(-len(self.ids) * BITS_PER_KEY // 64) * 64)
        marks = np.zeros(bits, bool)
        for k in range(0, len(self.ids), 1 << 16):
            marks[probes(np.array(self.ids[k : k + (1 << 16)], np.uint64), bits)] = True
        bloom = np.packbits(marks).tobytes()
        index_at = self.at
        self._put(index)
        self._put(bloom)
        check = zlib.crc32(bloom, zlib.crc32(index))
        self._put(FOOTER.pack(index_at, len(index), index_at + len(index), len(bloom), len(self.ids), self.n_ids, check, MAGIC))


class TokenTable:
    """Reads one table: lookups by binary search over the sparse index, or all entries in order."""

    def __init__(self, uri: str) -> None:
        system, path = pafs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        index_at, index_n, bloom_at, bloom_n, self.n_docs, self.n_ids, check, magic = FOOTER.unpack(
            self.file.read_at(FOOTER.size, size - FOOTER.size)
        )
        head = self.file.read_at(len(MAGIC) + 1, 0)
        whole = magic == MAGIC and head[:-1] == MAGIC and bloom_at + bloom_n + FOOTER.size == size
        index, self.bloom = (self.file.read_at(index_n, index_at), self.file.read_at(bloom_n, bloom_at)) if whole else (b"", b"")
        if not whole or check != zlib.crc32(self.bloom, zlib.crc32(index)):
            raise ValueError(f"{uri} is no whole token table")
        self.dtype = np.dtype(f"<u{head[-1]}")
        step = len(table_key(0)) + 16
        entries = [index[k : k + step] for k in range(0, len(index), step)]
        self.index = [(e[:-16], *struct.unpack("<QQ", e[-16:])) for e in entries]
        self.expand = zstandard.ZstdDecompressor()

    def __enter__(self) -> TokenTable:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, n = self.index[k]
        data, pos, key = self.expand.decompress(self.file.read_at(n, at)), 0, b""
        while pos < len(data):
            same, pos = read_varint(data, pos)
            rest, pos = read_varint(data, pos)
            size, pos = read_varint(data, pos)
            key = key[:same] + data[pos : pos + rest]
            yield key, data[pos + rest : pos + rest + size]
            pos += rest + size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, value in self.block(k):
                yield key_id(key), np.frombuffer(value, self.dtype)

    def may_hold(self, doc_id: int | None) -> bool:
        at = probes(np.array([filter_key(doc_id)], np.uint64), len(self.bloom) * 8)[0]
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in map(int, at))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row with this doc_id; none where there is no such row."""
        if not self.may_hold(doc_id):
            return []
        want, low, high = table_key(doc_id), 0, len(self.index)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.index[middle][0] < want else (low, middle)
        found = []
        for k in range(low, len(self.index)):
            for key, value in self.block(k):
                if key[:9] == want[:9]:
                    found.append(np.frombuffer(value, self.dtype))
                elif key > want:
                    return found
        return found


def write_tables(docs: DataFrame, vocabulary: str, end_id: int | None = 2, folder: str | None = None) -> DataFrame:
    """Encode all documents and write them as token tables in ascending doc_id order; returns the tables' manifest.

    Ranges of ids make the tables, so their key ranges don't overlap. Each task writes a file of its own name
    (a task that is run again writes another), and the manifest, a reliable checkpoint, names the files that count. Null texts are
    empty; null ids come first; rows that repeat an id are all kept, ordered by text. end_id is put after each document's
    ids unless None. vocabulary: a path that exists on every executor.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    target = f"{folder or shared_folder(spark)}/token-tables-{uuid.uuid4().hex}"
    rows = texts(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = b"" if end_id is None else np.array([end_id], encode.dtype).tobytes()
        system, base = pafs.FileSystem.from_uri(target)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.sst"
        writer, previous, repeat, first = None, object(), 0, b""
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                doc_id = ids[k].as_py()
                if writer is None:
                    system.create_dir(base, recursive=True)
                    writer, first = TableWriter(system.open_output_stream(f"{base}/{name}"), encode.dtype.itemsize), table_key(doc_id)
                repeat = repeat + 1 if doc_id == previous else 0
                previous = doc_id
                writer.add(doc_id, repeat, encode(column[k].as_py()) + end)
        if writer is not None:
            writer.close()
            writer.sink.close()
            yield pa.RecordBatch.from_pydict(
                {"path": [f"{target}/{name}"], "first_key": [first], "n_docs": [len(writer.ids)], "n_ids": [writer.n_ids], "n_bytes": [writer.at]}
            )

    return settled(rows.mapInArrow(write, MANIFEST))


def remove_strays(manifest: DataFrame, folder: str) -> int:
    """Delete the files of a folder of tables that the manifest doesn't name: those of attempts that failed. Returns how many."""
    named = {r.path.rsplit("/", 1)[-1] for r in manifest.select("path").toLocalIterator()}
    system, base = pafs.FileSystem.from_uri(folder)
    strays = [f.path for f in system.get_file_info(pafs.FileSelector(base)) if f.base_name not in named]
    for path in strays:
        system.delete_file(path)
    return len(strays)


def read_tables(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files that the manifest names.

    start counts the ids of all documents before it. No documents give no rows.
    """
    importable(manifest.sparkSession)
    before = Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with TokenTable(path) as table:
                    out: list[tuple] = []
                    for doc_id, ids in table:
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out) == 4096:
                            yield _digests(out)
                            out = []
                    yield _digests(out)

    tasks = max(2, shuffle_width(manifest.sparkSession))
    return placed.repartition(tasks, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], list(names))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
