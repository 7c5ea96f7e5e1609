"""Operators 1 and 8: token counts, and token ids in compressed files with random access."""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import few_smallest, parts, slices
from panelkit.llm.units import Encoder, TokenCounter, kept, single_token_strings
from panelkit.sources.io import materialize, new_path


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokens of every whole text: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Strings of the vocabulary that are one token alone are proven on the driver, once, and sent
    to the workers (bounded by the vocabulary). Workers count pre-tokens among them as one and
    merge only the rest. No shuffle. Null and empty texts have 0 tokens; repeated rows stay; an
    empty table gives no rows; other columns are not read."""
    spark = docs.sparkSession
    single = spark.sparkContext.broadcast(single_token_strings(tokenizer))

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = kept(TokenCounter, tokenizer, single.value)
        for texts in batches:
            yield pa.array([n for some in slices(texts) for n in counter.counts(some.to_pylist())], pa.int64())

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(
        F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens")
    )
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


# ---- operator 8 -------------------------------------------------------------------------------

MAGIC = b"TOKZ0001"
TAIL = "<QQ32s8s"
FRAMES = "key long, missing boolean, n_tokens long, frame binary"


def train_dictionary(
    docs: DataFrame, tokenizer: str, size: int = 65536, sample_docs: int = 2000, sample_ids: int = 20000,
    id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
) -> bytes:
    """A zstandard dictionary of at most ``size`` bytes from serialized id arrays.

    Trained on at most ``sample_docs`` documents, those with the smallest hash of their id, and of
    each the id array up to ``sample_ids`` ids: a bound on what the driver holds, which changes
    file sizes only. With too few documents to train on it is empty and frames use none.

    The cut in the order of hashes is found from ids alone, so hardly more texts are moved than the sample's."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("place"))
    chosen = few_smallest(rows, "place", sample_docs).orderBy("place", "key", F.xxhash64("text")).limit(sample_docs)

    def serialized(batches):
        enc = kept(Encoder, tokenizer)
        for b in batches:
            ids = [_narrow(i + struct.pack("<I", end_id), enc)[: sample_ids * 2] for i in enc.ids(b["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    samples = [bytes(r.ids) for r in chosen.mapInArrow(serialized, "ids binary").collect()]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # samples too small or too alike to train on
        return b""


def _narrow(ids: bytes, enc: Encoder) -> bytes:
    """Serialized form of an id array: 16-bit ids where the vocabulary allows, else 32-bit."""
    small = enc.tokenizer.get_vocab_size() <= 65536
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if small else ids


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 0, level: int = 3,
) -> DataFrame:
    """Write the ids of all documents, each with ``end_id``, in ascending id order; return the
    manifest (one row per file: shard, path, number of documents and ids, first and last key).

    A file holds one zstandard frame per document and, behind them, an index: keys, frame offsets,
    numbers of ids and the SHA-256 of the shared dictionary, which lies in the folder too. A task
    names its file after the attempt and the manifest lists finished files only, so a repeated
    task leaves at most an unlisted file. Null keys come first; equal keys go by content. An empty
    table gives no file."""
    spark = docs.sparkSession
    words = train_dictionary(docs, tokenizer, id_col=id_col, text_col=text_col, end_id=end_id)
    digest = hashlib.sha256(words).digest()
    _put(f"{folder}/dictionary-{digest.hex()}.zdict", words)
    shared = spark.sparkContext.broadcast(words)
    end = struct.pack("<I", end_id)

    def encode(batches):
        enc = kept(Encoder, tokenizer)
        wide = enc.tokenizer.get_vocab_size() > 65536
        words = _dictionary(shared.value)
        if words:
            words.precompute_compress(level=level)  # else every frame would digest the dictionary anew
        press = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=True)
        for b in (some for whole in batches for some in slices(whole)):
            ids = [i + end for i in enc.ids(b["text"].to_pylist())]
            frames = [press.compress(_narrow(i, enc) if not wide else i) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    b["key"].cast(pa.int64()), b["missing"],
                    pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(frames, pa.binary()),
                ],
                ["key", "missing", "n_tokens", "frame"],
            )

    key = F.col(id_col).cast("long")
    narrow = docs.select(
        F.coalesce(key, F.lit(-(2**63))).alias("key"), key.isNull().alias("missing"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    # Written once: the range partitioning below looks at its input twice.
    frames = materialize(narrow.mapInArrow(encode, FRAMES))

    def write(batches):
        body, keys, missing, sizes, lengths = None, [], [], [], []
        for b in batches:
            if body is None:
                path = f"{folder}/{uuid.uuid4().hex}.tokz"
                body = _open(path, "w")
                body.write(MAGIC)
            for f in b["frame"].to_pylist():
                body.write(f)
                lengths.append(len(f))
            keys.append(b["key"].to_numpy())
            missing.append(b["missing"].to_numpy(zero_copy_only=False))
            sizes.append(b["n_tokens"].to_numpy())
        if body is None:
            return
        k, m, s = (np.concatenate(x) for x in (keys, missing, sizes))
        offsets = np.concatenate([[len(MAGIC)], len(MAGIC) + np.cumsum(lengths, dtype="int64")])
        index = b"".join(
            (k.astype("<i8").tobytes(), np.packbits(m).tobytes(), s.astype("<i8").tobytes(), offsets.astype("<i8").tobytes())
        )
        body.write(index)
        body.write(struct.pack(TAIL, len(k), len(index), digest, MAGIC))
        body.close()
        from pyspark import TaskContext

        yield pa.RecordBatch.from_pylist(
            [{"shard": TaskContext.get().partitionId(), "path": path, "n_docs": len(k),
              "n_ids": int(s.sum()), "first_key": int(k[0]), "last_key": int(k[-1])}]
        )

    order = [F.col("missing").desc(), F.col("key"), F.xxhash64("frame"), F.monotonically_increasing_id()]
    manifest = (
        frames.repartitionByRange(parts(spark), *order)
        .sortWithinPartitions(F.col("missing").desc(), "key", F.xxhash64("frame"))
        .mapInArrow(write, "shard long, path string, n_docs long, n_ids long, first_key long, last_key long")
    )
    done = materialize(manifest)
    rows = [r.asDict() for r in done.orderBy("shard").collect()]  # one row per file
    _put(f"{folder}/manifest.json", json.dumps({"tokenizer": tokenizer, "files": rows}).encode())
    return done


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Read token files back: ``key``, ``start`` (ids of all documents before), ``n_tokens`` and
    ``ids_crc32`` of every document, each frame decompressed. Tasks take a file each."""
    return _read(spark, folder, _checked, "key long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The id arrays themselves: ``key``, ``start``, ``ids``."""
    return _read(spark, folder, _arrays, "key long, start long, ids array<long>")


def _read(spark: SparkSession, folder: str, rows, schema: str) -> DataFrame:
    files = json.loads(_get(f"{folder}/manifest.json"))["files"]
    before, todo = 0, []
    for f in files:
        todo.append((f["path"], before))
        before += f["n_ids"]
    listed = spark.createDataFrame(todo or [("", 0)], "path string, before long").filter("path <> ''")

    def read(batches):
        for b in batches:
            for path, start in zip(b["path"].to_pylist(), b["before"].to_pylist()):
                yield from rows(TokenFile(path), start)

    return listed.repartition(max(1, len(todo))).mapInArrow(read, schema)


def _checked(file: TokenFile, start: int, some: int = 1000):
    for at in range(0, len(file.keys), some):
        span = range(at, min(at + some, len(file.keys)))
        sums = [zlib.crc32(file.ids(i).astype("<u4").tobytes()) for i in span]
        yield _batch(file, start, span, sums, "ids_crc32", pa.int64(), sizes=True)


def _arrays(file: TokenFile, start: int, some: int = 200):
    for at in range(0, len(file.keys), some):
        span = range(at, min(at + some, len(file.keys)))
        yield _batch(file, start, span, [file.ids(i).astype("int64") for i in span], "ids", pa.list_(pa.int64()))


def _batch(file, start, span, values, name, kind, sizes=False):
    keys = pa.array([file.key(i) for i in span], pa.int64())
    starts = pa.array([start + int(file.starts[i]) for i in span], pa.int64())
    counts = [pa.array([int(file.sizes[i]) for i in span], pa.int64())] if sizes else []
    return pa.RecordBatch.from_arrays(
        [keys, starts, *counts, pa.array(values, kind)], ["key", "start", *["n_tokens"] * sizes, name]
    )


class TokenFile:
    """One token file: its index is read at once, a document's frame only when asked for."""

    def __init__(self, path: str):
        self.path = path
        system, inside = fs.FileSystem.from_uri(_uri(path))
        self.body = system.open_input_file(inside)
        end = self.body.size()
        tail = struct.calcsize(TAIL)
        n, size, self.digest, magic = struct.unpack(TAIL, self.body.read_at(tail, end - tail))
        if magic != MAGIC:
            raise ValueError(f"{path} is no complete token file")
        raw = self.body.read_at(size, end - tail - size)
        at = n * 8
        self.keys = np.frombuffer(raw[:at], "<i8")
        self.missing = np.unpackbits(np.frombuffer(raw[at : at + -(-n // 8)], "u1"))[:n].astype(bool)
        at += -(-n // 8)
        self.sizes = np.frombuffer(raw[at : at + n * 8], "<i8")
        self.offsets = np.frombuffer(raw[at + n * 8 :], "<i8")
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        words = _get(f"{path.rpartition('/')[0]}/dictionary-{self.digest.hex()}.zdict")
        if hashlib.sha256(words).digest() != self.digest:
            raise ValueError(f"{path}: the dictionary has another hash than the file names")
        self.press = zstandard.ZstdDecompressor(dict_data=_dictionary(words))

    def key(self, i: int) -> int | None:
        return None if self.missing[i] else int(self.keys[i])

    def ids(self, i: int) -> np.ndarray:
        frame = self.body.read_at(int(self.offsets[i + 1] - self.offsets[i]), int(self.offsets[i]))
        raw = self.press.decompress(frame)
        return np.frombuffer(raw, f"<u{len(raw) // int(self.sizes[i])}")


def read_document(folder: str, key: int) -> np.ndarray | None:
    """Ids of one document: the manifest names the file, its index the frame. None if unknown."""
    files = json.loads(_get(f"{folder}/manifest.json"))["files"]
    at = bisect.bisect_left([f["last_key"] for f in files], key)
    if at == len(files):
        return None
    file = TokenFile(files[at]["path"])
    i = int(np.searchsorted(file.keys, key))
    while i < len(file.keys) and file.keys[i] == key and file.missing[i]:
        i += 1
    return file.ids(i) if i < len(file.keys) and file.keys[i] == key else None


def _dictionary(words: bytes):
    return zstandard.ZstdCompressionDict(words) if words else None


def _uri(path: str) -> str:
    """file:/x, as Spark may write it, is file:///x to Arrow."""
    path = path.replace("file:///", "/", 1) if path.startswith("file:///") else path
    return path.replace("file:", "", 1) if path.startswith("file:") else path


def _open(path: str, mode: str):
    system, inside = fs.FileSystem.from_uri(_uri(path))
    if mode == "w":
        system.create_dir(inside.rpartition("/")[0], recursive=True)
        return system.open_output_stream(inside)
    return system.open_input_file(inside)


def _put(path: str, data: bytes) -> None:
    with _open(path, "w") as f:
        f.write(data)


def _get(path: str) -> bytes:
    with _open(path, "r") as f:
        return f.read()


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files in the shared folder."""
    return new_path(spark, "tokens")
