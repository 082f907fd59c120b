"""Token ids in binary shards: frequency-ranked, byte-aligned variable-length codes.

A shard is a run of blocks. A block is, all little-endian:

    magic 4 bytes | documents u4 | tokens u8 | control bytes u8 | data bytes u8
    document ids i8 x documents (the smallest i8 stands for null)
    token counts u4 x documents
    control bytes: two bits for each token, four tokens to a byte, low bits first: code length less 1
    data bytes: each token's frequency rank in 1 to 4 bytes

Rank 0 is the most frequent id, so common ids take one byte. ``ranks.bin`` beside
the shards holds the id of each rank as u4, and ``manifest.json`` the shards in
order with their documents and tokens.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch, rows_of
from .tokens import word_ids

MAGIC = b"CFT1"
_HEAD = struct.Struct("<4sIQQQ")
_NULL_ID = -(1 << 63)
#: For each control byte, the four code lengths it holds.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
_IDS = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("ids", pa.binary())])
_COUNT = pa.schema([("token", pa.int32()), ("n", pa.int64())])
_SHARD = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
_READ = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned ranks below 2**32."""
    r = ranks.astype("<u4")
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` ranks, by table lookup on whole control bytes."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def _block(ids: list, counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    doc_ids = np.array([_NULL_ID if i is None else i for i in ids], "<i8")
    head = _HEAD.pack(MAGIC, len(ids), len(ranks), len(control), len(data))
    return b"".join([head, doc_ids.tobytes(), np.array(counts, "<u4").tobytes(), control, data])


def blocks(f) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(document ids, token counts, ranks) of each block of an open shard."""
    while head := f.read(_HEAD.size):
        magic, n_docs, n_tokens, n_control, n_data = _HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        ids = [None if i == _NULL_ID else i for i in np.frombuffer(f.read(8 * n_docs), "<i8").tolist()]
        counts = np.frombuffer(f.read(4 * n_docs), "<u4")
        yield ids, counts, decode_ranks(f.read(n_control), f.read(n_data), n_tokens)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and path of a folder that Spark knows too; s3a and s3n are names that only Spark gives to s3."""
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def _publish(uri: str, chunks: Iterable[bytes]) -> int:
    """Write under a name of its own, then move into place: a rerun task leaves one whole file."""
    fs, path = _open(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own, size = f"{path}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(own) as f:
        for c in chunks:
            size += f.write(c)
    try:
        fs.move(own, path)
    except OSError:  # some stores don't move onto a file; a former try's holds the same bytes
        fs.delete_file(path)
        fs.move(own, path)
    return size


def tokenize(docs: DataFrame, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tie, ids): each row's token ids as little-endian bytes; ``tie`` orders rows of one id by their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out, size = word_ids(tokenizer), [], 0
        end = b"" if end_id is None else np.array([end_id], words.dtype).tobytes()
        for row in rows_of(batches, "id", "tie", "body", size=128):
            out.append((row[0], row[1], words.raw(row[2]) + end))
            size += len(out[-1][2])
            if size > 8 << 20:
                yield batch(_IDS, **dict(zip(("id", "tie", "ids"), zip(*out, strict=True), strict=True)))
                out, size = [], 0
        if out:
            yield batch(_IDS, **dict(zip(("id", "tie", "ids"), zip(*out, strict=True), strict=True)))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("tie"), F.col(text_col).cast("binary").alias("body"))
    return rows.mapInArrow(run, "id long, tie long, ids binary")


def rank_ids(ids: DataFrame, dtype: str) -> np.ndarray:
    """The ids by falling frequency (ties to the smaller): one count for each vocabulary entry reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for (raw,) in rows_of(batches, "ids"):
            c = np.bincount(np.frombuffer(raw, dtype))
            if len(c) > len(total):
                c[: len(total)] += total
                total = c
            else:
                total[: len(c)] += c
        seen = np.flatnonzero(total)
        yield batch(_COUNT, token=seen, n=total[seen])

    counts = ids.select("ids").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return np.array([r["token"] for r in sorted(counts, key=lambda r: (-r["n"], r["token"]))], "<u4")


def write_tokens(
    spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 20_000, block_tokens: int = 1 << 18
) -> list[dict]:
    """Write every text's ids to ``folder`` in ascending id order (nulls first, ties by text) and return the manifest.

    Texts are encoded once into a scratch table; ranks come from counts over all
    of it; shards are ranges of ids, so reading them in order gives the order of
    documents. Null texts are empty. An empty table gives an empty manifest.
    """
    scratch = Scratch(spark, "tokens")
    dtype = word_ids(tokenizer).dtype.str
    ids = scratch.table(tokenize(docs, tokenizer, end_id, id_col, text_col), "ids")
    order = rank_ids(ids, dtype)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, "<u4")
    rank_of[order] = np.arange(len(order))
    known = spark.sparkContext.broadcast(rank_of)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen, ranks = TaskContext.get().partitionId(), [0, 0], known.value

        def chunks() -> Iterator[bytes]:
            names, counts, parts, size = [], [], [], 0
            for i, raw in rows_of(batches, "id", "ids"):
                got = np.frombuffer(raw, dtype)
                names.append(i)
                counts.append(len(got))
                parts.append(got)
                size += len(got)
                if size >= block_tokens:
                    yield _block(names, counts, ranks[np.concatenate(parts)])
                    seen[0], seen[1] = seen[0] + len(names), seen[1] + size
                    names, counts, parts, size = [], [], [], 0
            if names:
                yield _block(names, counts, ranks[np.concatenate(parts)])
                seen[0], seen[1] = seen[0] + len(names), seen[1] + size

        path = f"{folder}/shard-{shard:06d}.cft"
        size = _publish(path, chunks())
        yield batch(_SHARD, shard=[shard], path=[path], docs=[seen[0]], tokens=[seen[1]], bytes=[size])

    n = max(1, -(-ids.count() // shard_rows))
    shards = ids.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "ids").mapInArrow(run, "shard int, path string, docs long, tokens long, bytes long")
    manifest, start = [], 0
    for r in sorted(shards.collect(), key=lambda r: r["shard"]):
        if r["docs"]:
            manifest.append(r.asDict() | {"start": start})
            start += r["tokens"]
    _publish(f"{folder}/ranks.bin", [order.tobytes()])
    _publish(f"{folder}/manifest.json", [json.dumps(manifest).encode()])
    scratch.drop(ids)
    known.unpersist()
    return manifest


def read_tokens(spark: SparkSession, folder: str, digest_only: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids) of each document from the files; ids are little-endian u4 bytes.

    ``digest_only`` gives ids_crc32 (unsigned, of those bytes) in place of ids.
    """
    fs, path = _open(folder)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        manifest = json.loads(f.read())
    with fs.open_input_stream(f"{path}/ranks.bin") as f:
        order = np.frombuffer(f.read(), "<u4")
    last, kind = ("ids_crc32", "long") if digest_only else ("ids", "binary")
    schema = pa.schema([*list(_READ)[:3], (last, pa.int64() if digest_only else pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start in rows_of(batches, "path", "start"):
            fs, at = _open(path)
            with fs.open_input_stream(at) as f:
                for ids, counts, ranks in blocks(f):
                    tokens = order[ranks]
                    ends = np.cumsum(counts, dtype=np.int64)
                    begins = ends - counts
                    cut = [tokens[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    if digest_only:
                        cut = [zlib.crc32(c) for c in cut]
                    yield batch(schema, id=ids, start=begins + start, n_tokens=counts.astype(np.int64), **{last: cut})
                    start += int(ends[-1]) if len(ends) else 0

    shards = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")
    return shards.repartition(max(1, len(manifest))).mapInArrow(run, f"id long, start long, n_tokens long, {last} {kind}")
