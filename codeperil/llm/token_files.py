"""Token ids as Arrow IPC files of fixed-size-list batches.

A set is a folder of pairs of files, one pair for each range of identifiers: ``part-00007.arrow`` holds the token
stream of its documents cut into sequences of `length` ids, with a mask of the same shape, one byte an id (0 behind
the end of the stream, else 1); ``part-00007.docs.arrow`` holds each document's identifier, first position and number of
ids. Both are Arrow files with a footer, uncompressed, so a reader can map them and take any sequence with its mask, or
any document's ids, without a copy. All batches but the last have BATCH sequences, so sequence n is in batch n // BATCH.
Ids are stored in 16 bits where the vocabulary allows, else in 32.

Texts are encoded where they are read; the ids, packed, go to the file of their range of identifiers and are sorted
there, so files follow each other in that order. Ranges are cut at quantiles of the identifiers; one that is as frequent
as several ranges together is dealt over them. A file is written under another name and moved into place: a task that
runs again replaces its file by the same bytes.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, shared_path, ship
from .words import WordEncoder, encoder_of

MANIFEST = "part int, n_docs long, n_tokens long, n_sequences long"
#: Sequences in a record batch.
BATCH = 512
#: Bytes of text that are encoded at once, and documents whose ids are unpacked at once.
CHUNK = 500_000
AT_ONCE = 256


@dataclass(frozen=True)
class TokenSet:
    """What write_token_files leaves: the folder, the files in order with the ids before each, and the sequence length."""

    folder: str
    length: int
    parts: tuple[tuple[int, int, int], ...]  # part, first id's place in the whole, number of ids

    @property
    def n_tokens(self) -> int:
        return sum(n for _, _, n in self.parts)


def encoded_batches(batches: Iterator[pa.RecordBatch], encoder: WordEncoder) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the ids of their column "text", CHUNK bytes or one text at a time."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else []
        first, held = 0, 0
        for n in range(len(texts) + 1):
            if n == len(texts) or (held and held + sizes[n] > CHUNK):
                if n > first:
                    part = batch.slice(first, n - first)
                    yield part, encoder.encode_arrow(texts.slice(first, n - first))
                first, held = n, 0
            if n < len(texts):
                held += sizes[n]
        give_back()


def open_folder(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder's URI or plain path."""
    return pyarrow.fs.FileSystem.from_uri(folder) if ":" in folder else (pyarrow.fs.LocalFileSystem(), os.path.abspath(folder))


def id_bits(encoder: WordEncoder, end_id: int) -> int:
    """16 or 32: what the vocabulary and the end id need."""
    return 16 if max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 32


def sequence_schema(length: int, bits: int) -> pa.Schema:
    ids = pa.uint16() if bits == 16 else pa.uint32()
    return pa.schema([pa.field("ids", pa.list_(ids, length), False), pa.field("mask", pa.list_(pa.uint8(), length), False)])


class _Writer:
    """Writes one pair of files."""

    def __init__(self, folder: str, part: int, schema: pa.Schema, length: int):
        self.fs, path = open_folder(folder)
        self.fs.create_dir(path, recursive=True)
        self.names = [f"{path}/part-{part:05d}.arrow", f"{path}/part-{part:05d}.docs.arrow"]
        mark = uuid.uuid4().hex
        self.hidden = [f"{path}/.{mark}.{n}" for n in range(2)]
        self.docs_schema = pa.schema([pa.field("doc_id", pa.int64()), pa.field("begin", pa.int64(), False), pa.field("n_tokens", pa.int64(), False)])
        self.streams = [self.fs.open_output_stream(x) for x in self.hidden]
        self.files = [pa.ipc.new_file(self.streams[0], schema), pa.ipc.new_file(self.streams[1], self.docs_schema)]
        self.schema, self.length = schema, length
        self.kind = schema.field("ids").type.value_type.to_pandas_dtype()
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = self.n_sequences = 0

    def add(self, doc_ids: pa.Array, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        begin = self.n_tokens + np.cumsum(sizes) - sizes
        self.files[1].write_batch(pa.record_batch([doc_ids.cast(pa.int64()), pa.array(begin), pa.array(sizes)], schema=self.docs_schema))
        self.n_docs += len(ids)
        self.n_tokens += int(sizes.sum())
        self.held += ids
        self.n_held += int(sizes.sum())
        step = BATCH * self.length
        if self.n_held >= step:
            stream = np.concatenate(self.held)
            whole = len(stream) // step * step
            for a in range(0, whole, step):
                self._batch(stream[a : a + step], step)
            self.held, self.n_held = [stream[whole:].copy()], len(stream) - whole

    def _batch(self, stream: np.ndarray, real: int) -> None:
        mask = np.zeros(len(stream), np.uint8)
        mask[:real] = 1
        part = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (stream, mask)]
        self.files[0].write_batch(pa.record_batch(part, schema=self.schema))
        self.n_sequences += len(stream) // self.length

    def close(self) -> tuple[int, int, int]:
        if self.n_held:
            padded = np.zeros(-(-self.n_held // self.length) * self.length, self.kind)
            padded[: self.n_held] = np.concatenate(self.held)
            self._batch(padded, self.n_held)
        for file, stream in zip(self.files, self.streams, strict=True):
            file.close()
            stream.close()
        for hidden, name in zip(self.hidden, self.names, strict=True):
            self.fs.move(hidden, name)
        return self.n_docs, self.n_tokens, self.n_sequences


def part_bounds(keys: DataFrame, column: str, parts: int) -> np.ndarray:
    """Quantiles that cut the column's values into `parts` ranges: parts - 1 values."""
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    got = keys.agg(F.percentile_approx(column, shares, max(10_000, 20 * parts)).alias("cuts")).first()["cuts"] if parts > 1 else []
    return np.array(got or [], np.int64)


def write_token_files(docs: DataFrame, tokenizer_json: str, folder: str | None = None, end_id: int = 2, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> TokenSet:
    """Encode every whole text, append `end_id` and write the ids in ascending order of identifiers.

    A null text counts as empty (one id, the end). Identifiers are whole numbers or their digits as strings. Null
    identifiers come first; repeated identifiers follow each other in any order. An empty table gives a set without
    files. Other columns are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or shared_path(spark, "tokens")
    least = F.lit(-(1 << 63))  # null identifiers come first
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), least).alias("key"), F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = spark.sparkContext.broadcast((tokenizer_json, part_bounds(rows.select("key"), "key", parts)))  # one vocabulary file and a number for each file

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, bounds = held.value
        encoder, codec = encoder_of(text), pa.Codec("zstd", compression_level=1)
        kind = np.uint16 if id_bits(encoder, end_id) == 16 else np.uint32
        end = np.array([end_id], kind)
        for batch, ids in encoded_batches(batches, encoder):
            keys, uids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            low, high = (np.searchsorted(bounds, keys, side) for side in ("left", "right"))
            part = (low + uids % (high - low + 1)).astype(np.int32)  # a key that is several bounds is dealt over their ranges
            whole = [np.concatenate([x.astype(kind), end]) for x in ids]
            packed = pa.array([codec.compress(x.tobytes(), asbytes=True) for x in whole], pa.binary())
            sizes = pa.array([x.nbytes for x in whole], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column(0), batch.column(1), batch.column(2), sizes, packed], ["part", "key", "uid", "doc_id", "n_bytes", "packed"])

    dealt = rows.mapInArrow(encode, "part int, key long, uid long, doc_id long, n_bytes long, packed binary")
    dealt = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "key", "uid").drop("key", "uid")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = id_bits(encoder_of(held.value[0]), end_id)
        codec, writer, own = pa.Codec("zstd"), None, None

        def manifest() -> pa.RecordBatch:
            n_docs, n_tokens, n_sequences = writer.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([own], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens], "n_sequences": [n_sequences]})

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if own != numbers[a]:
                    if writer is not None:
                        yield manifest()
                    own = int(numbers[a])
                    writer = _Writer(folder, own, sequence_schema(length, bits), length)
                for at in range(a, b, AT_ONCE):
                    some = batch.slice(at, min(AT_ONCE, b - at))
                    sizes = some.column(2).to_pylist()
                    ids = [np.frombuffer(codec.decompress(x.as_buffer(), decompressed_size=n), writer.kind) for x, n in zip(some.column(3), sizes, strict=True)]
                    writer.add(some.column(1), ids)
        if writer is not None:
            yield manifest()

    counts = sorted((r.part, r.n_tokens) for r in dealt.mapInArrow(write, MANIFEST).collect())  # a row for each file
    held.unpersist()
    parts, before = [], 0
    for part, n in counts:
        parts.append((part, before, n))
        before += n
    return TokenSet(folder, length, tuple(parts))


def open_part(folder: str, part: int) -> tuple[pa.ipc.RecordBatchFileReader, pa.Table]:
    """A part's sequences, opened for random access (mapped if the file is local), and its documents."""
    fs, path = open_folder(folder)

    def source(name: str):
        return pa.memory_map(name) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(name)

    return pa.ipc.open_file(source(f"{path}/part-{part:05d}.arrow")), pa.ipc.open_file(source(f"{path}/part-{part:05d}.docs.arrow")).read_all()


def sequence(folder: str, part: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the mask of a part's sequence number n, both views of the file."""
    reader, _ = open_part(folder, part)
    batch = reader.get_batch(n // BATCH)
    ids, mask = (c.slice(n % BATCH, 1).flatten().to_numpy(zero_copy_only=True) for c in batch.columns)
    return ids, mask


def _stream(reader: pa.ipc.RecordBatchFileReader, begin: int, end: int, length: int) -> np.ndarray:
    """Ids begin to end of a part's stream."""
    out, step = [], BATCH * length
    while begin < end:
        values = reader.get_batch(begin // step).column(0).flatten().to_numpy(zero_copy_only=True)
        first = begin // step * step
        out.append(values[begin - first : end - first])
        begin = first + step
    return out[0] if len(out) == 1 else np.concatenate(out)


def read_documents(spark: SparkSession, tokens: TokenSet) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not tokens.parts:
        return spark.createDataFrame([], schema)
    ship(spark)
    folder, length = tokens.folder, tokens.length

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, docs = open_part(folder, part)
                for some in docs.to_batches(max_chunksize=10_000):
                    begin, n = some.column(1).to_numpy(), some.column(2).to_numpy()
                    crc = [zlib.crc32(_stream(reader, int(b), int(b + c), length).astype("<u4").tobytes()) for b, c in zip(begin, n, strict=True)]
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(before + begin), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(p, b) for p, b, _ in tokens.parts], "part int, before long")
    return files.repartition(min(len(tokens.parts), 10_000), "part").mapInArrow(read, schema)
