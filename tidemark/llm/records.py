"""Token ids in length-delimited binary records.

Documents are tokenized and written in ascending id order, one shard per range
partition.  A shard is a sequence of records

    length u64 | masked checksum of the length u32 | body | masked checksum of the body u32

(little-endian; checksum: CRC-32, rotated right by 15 bits plus a constant, so
that a checksum stored in checked data doesn't check itself).  The body is

    flags u8 (bit 0: null id, bit 1: ids of 4 bytes, else of 2) | id i64 | number of ids u32 | ids

A second file per shard holds one (offset u64, ids before it u64) pair for each
record and the masked checksum of them all, so that a reader can fetch records
in any order without scanning the shard.

Shards have names of their own for every task attempt, and only the manifest
(a DataFrame of the attempts that succeeded) says which belong to the output:
a lost executor leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ._common import rows_by_size, shuffle_partitions, utf8

_HEAD = struct.Struct("<QI")
_BODY = struct.Struct("<BqI")
_SUM = struct.Struct("<I")
_NULL_ID, _WIDE = 1, 2
MANIFEST = "shard int, data string, index string, records bigint, tokens bigint"
#: Words in a generation of a worker's memory of encodings.
CACHE_WORDS = 150_000


#: Bytes of text that are encoded together, about.
BATCH = 2 << 20


class CorruptRecord(ValueError):
    pass


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    size = struct.pack("<Q", len(body))
    return b"".join((size, _SUM.pack(masked_crc(size)), body, _SUM.pack(masked_crc(body))))


def unframe(buffer: bytes, at: int = 0) -> tuple[bytes, int]:
    """The body of the record at ``at``, and where the next one starts."""
    if len(buffer) < at + _HEAD.size:
        raise CorruptRecord("cut off in a length")
    size, check = _HEAD.unpack_from(buffer, at)
    if masked_crc(buffer[at: at + 8]) != check:
        raise CorruptRecord("length checksum differs")
    start = at + _HEAD.size
    body = buffer[start: start + size]
    if len(buffer) < start + size + _SUM.size:
        raise CorruptRecord("cut off in a body")
    if masked_crc(body) != _SUM.unpack_from(buffer, start + size)[0]:
        raise CorruptRecord("body checksum differs")
    return body, start + size + _SUM.size


def pack_body(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    flags = _NULL_ID * (doc_id is None) | _WIDE * wide
    return _BODY.pack(flags, doc_id or 0, len(ids) // (4 if wide else 2)) + ids


def unpack_body(body: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id, n = _BODY.unpack_from(body)
    ids = np.frombuffer(body, "<u4" if flags & _WIDE else "<u2", n, _BODY.size)
    return None if flags & _NULL_ID else doc_id, ids.astype("<u4")


def pack_index(offsets: array, before: array) -> bytes:
    table = np.column_stack([np.frombuffer(offsets, np.int64), np.frombuffer(before, np.int64)]).astype("<u8").tobytes()
    return table + _SUM.pack(masked_crc(table))


def unpack_index(raw: bytes) -> np.ndarray:
    if len(raw) < 4 or masked_crc(raw[:-4]) != _SUM.unpack(raw[-4:])[0]:
        raise CorruptRecord("offset index checksum differs")
    return np.frombuffer(raw[:-4], "<u8").reshape(-1, 2).astype(np.int64)


class Remembered:
    """Codes by key in two generations of about ``size``: what is used again
    moves on to the new one, the rest goes with the old."""

    def __init__(self, size: int, code):
        self.size, self.code = size, code
        self.new: dict = {}
        self.old: dict = {}

    def get(self, keys: list) -> list[bytes]:
        out = list(map(self.new.get, keys))
        if None not in out:
            return out
        holes = [i for i, c in enumerate(out) if c is None]
        missing = [keys[i] for i in holes]
        codes = list(map(self.old.get, missing))
        unknown = list(dict.fromkeys([k for k, c in zip(missing, codes) if c is None]))
        coded = {}
        for at in range(0, len(unknown), 4096):
            part = unknown[at: at + 4096]
            coded.update(zip(part, self.code(part)))
        if len(self.new) + len(missing) > self.size:
            self.old, self.new = self.new, {}
        new = self.new
        for i, k, c in zip(holes, missing, codes):
            out[i] = new[k] = coded[k] if c is None else c
        return out


class WordEncoder:
    """Encodes texts with a tokenizer whose pre-tokens never span white space
    (one that drops it), one white-space separated word at a time, so that a
    word's ids are looked up after its first use.

    A tokenizer that lower-cases, splits by a pattern and then maps bytes gets
    a shorter way for texts of Latin letters below U+0180 without special
    tokens: lower-casing and the pattern are applied here, and it encodes
    single pieces.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.wide = self.tok.get_vocab_size() > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        self.end = np.array([end_id], self.kind).tobytes()
        self.words = Remembered(CACHE_WORDS, lambda ws: self._codes(self.tok, [w.decode("utf-8", "replace") for w in ws]))
        pattern = _split_pattern(path)
        self.short = pattern is not None
        if self.short:
            self.pattern = regex.compile(pattern + "|\n")
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = None
            self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.plain_words = Remembered(CACHE_WORDS, self._plain_codes)

    def _codes(self, tok, texts: list[str]) -> list[bytes]:
        coded = tok.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}{'I' if self.wide else 'H'}", *ids) for ids in [c.ids for c in coded]]

    def _plain_codes(self, words: list[str]) -> list[bytes]:
        if all(map(str.isalpha, words)):
            return self._codes(self.bare, words)
        found = self.pattern.findall("\n".join(words) + "\n")
        codes = iter(self._codes(self.bare, [p for p in found if p != "\n"]))
        out, own = [], []
        for piece in found:
            if piece != "\n":
                own.append(next(codes))
            else:  # the end of a word
                out.append(b"".join(own) if len(own) > 1 else own[0] if own else b"")
                own = []
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text and the end id, little-endian."""
        return self.encode_many(pa.array([text], pa.string()))[0]

    def encode_many(self, texts: pa.Array) -> list[bytes]:
        """The same for each of many texts.  The words of all plain ones are
        split and made distinct by Arrow, looked up once, and laid out again
        with NumPy; only distinct words become Python objects."""
        texts = texts.fill_null("")
        plain = np.zeros(len(texts), bool)
        if self.short:
            special = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, _NOT_PLAIN))
            plain = ~special.to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        if plain.any():
            for k, code in zip(np.flatnonzero(plain), self._plain_texts(texts.filter(pa.array(plain)))):
                out[k] = code
        for k in np.flatnonzero(~plain):
            # bytes.split() cuts at ASCII white space; any other stays inside a word for the tokenizer.
            out[k] = b"".join(self.words.get(utf8(texts[int(k)].as_py()).split())) + self.end
        return out

    def _plain_texts(self, texts: pa.Array) -> Iterator[bytes]:
        # A space more between a letter and a mark: the pattern splits there anyway, and fewer words differ.
        apart = pc.replace_substring_regex(pc.utf8_lower(texts), r"(\pL)([^\s\pL\pN])", r"\1 \2")
        lists = pc.ascii_split_whitespace(apart)
        words = lists.flatten().dictionary_encode()
        codes = self.plain_words.get(words.dictionary.to_pylist())
        width = 4 if self.wide else 2
        size = np.fromiter(map(len, codes), np.int64, len(codes)) // width
        start = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(codes), self.kind)
        which = words.indices.to_numpy()
        per_word = size[which]
        after = np.cumsum(per_word)
        flat = ids[np.repeat(start[which] - (after - per_word), per_word) + np.arange(int(after[-1]) if len(after) else 0)]
        ends = np.concatenate([[0], after])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        for a, b in zip(ends[:-1], ends[1:]):
            yield flat[a:b].tobytes() + self.end


#: Beyond these characters (and for the letter whose lower case leaves them, and
#: for what Python alone or the tokenizer alone splits at) the tokenizer does all the work.
_NOT_PLAIN = "[^\\x00-\\x1B\\x20-\\x{84}\\x{86}-\\x{9F}\\x{A1}-\\x{012F}\\x{0131}-\\x{017F}]"


def _split_pattern(path: str) -> str | None:
    """The split pattern of a tokenizers file of the kind NFC, lower case,
    pattern, byte level; None for any other."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"]:
        return None
    split, level = pre
    if not split.get("invert") or split.get("behavior") != "Removed" or level.get("use_regex") or level.get("add_prefix_space"):
        return None
    return split["pattern"].get("Regex")


@lru_cache(maxsize=2)
def _encoder(path: str, end_id: int) -> WordEncoder:
    return WordEncoder(path, end_id)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id",
                  text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode every text (null: empty), append ``end_id`` and write the records
    under ``out_dir``, a folder that all executors share.  Returns the manifest.

    Ids ascend over the shards, null ids first; rows with equal ids stand by a
    hash of the text, and many of them are spread over shards by it (only rows
    equal in id and text stay together).  ``tokenizer`` is the path of a tokenizers file on every machine.  An
    empty table gives no shard.
    """
    n = shards or shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    laid = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, F.col("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        coder = _encoder(tokenizer, end_id)
        out, offsets, before, offset, total = None, array("q"), array("q"), 0, 0
        for b in rows_by_size(batches, 1, BATCH):
            if out is None:
                store, top = _open(out_dir)
                store.create_dir(top, recursive=True)
                name = f"{top}/shard-{shard:06d}-{uuid.uuid4().hex}"
                out = store.open_output_stream(f"{name}.rec", buffer_size=1 << 20)
            for key, ids in zip(b.column(0).to_pylist(), coder.encode_many(b.column(1))):
                record = frame(pack_body(key, ids, coder.wide))
                out.write(record)
                offsets.append(offset)
                before.append(total)
                offset += len(record)
                total += len(ids) // (4 if coder.wide else 2)
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{name}.idx") as index:
            index.write(pack_index(offsets, before))
        base = out_dir.rstrip("/") + name[len(top):]
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([f"{base}.rec"]), pa.array([f"{base}.idx"]),
             pa.array([len(offsets)], pa.int64()), pa.array([total], pa.int64())],
            names=["shard", "data", "index", "records", "tokens"])

    return materialize(laid.mapInArrow(run, MANIFEST), "records-manifest")


class ShardReader:
    """Random access to a shard by its offset index; every checksum is verified."""

    def __init__(self, data: str, index: str):
        store, at = _open(index)
        with store.open_input_stream(at) as f:
            self.places = unpack_index(f.read())
        store, at = _open(data)
        self.file = store.open_input_file(at)
        self.size = self.file.size()

    def __len__(self) -> int:
        return len(self.places)

    def record(self, k: int) -> tuple[int | None, int, np.ndarray]:
        """(id, ids of the shard before it, ids) of the k-th record."""
        at = int(self.places[k, 0])
        end = int(self.places[k + 1, 0]) if k + 1 < len(self) else self.size
        self.file.seek(at)
        body, stop = unframe(self.file.read(end - at))
        if stop != end - at:
            raise CorruptRecord("a record doesn't end where the next one starts")
        doc_id, ids = unpack_body(body)
        return doc_id, int(self.places[k, 1]), ids


def read_records(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """The records of a manifest's shards, one task per shard: doc_id, start
    (ids of all records before it), n_tokens and ids, or with ``digest`` their
    unsigned crc32 (as little-endian 32-bit integers) instead of ids."""
    # One row per shard: the running sum is over as many rows as there were write tasks.
    base = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = shuffle_partitions(manifest.sparkSession)
    todo = manifest.select("shard", "data", "index", base.alias("base")).repartitionByRange(n, "shard")
    last = ("ids_crc32", "bigint", pa.int64()) if digest else ("ids", "array<bigint>", pa.list_(pa.int64()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                shard = ShardReader(row["data"], row["index"])
                for at in range(0, len(shard), 512):
                    got = [shard.record(k) for k in range(at, min(at + 512, len(shard)))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g[0] for g in got], pa.int64()), pa.array([row["base"] + g[1] for g in got], pa.int64()),
                         pa.array([len(g[2]) for g in got], pa.int64()),
                         pa.array([zlib.crc32(g[2].tobytes()) if digest else g[2].astype(np.int64) for g in got], last[2])],
                        names=["doc_id", "start", "n_tokens", last[0]])

    return todo.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {last[0]} {last[1]}")
