"""Best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch, rows_of, with_bytes
from .tokens import word_ids

_LEN = pa.schema([("id", pa.int64()), ("n", pa.int64())])
_OUT = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("bin", pa.int64()), ("capacity", pa.int32()), ("at", pa.int32())])


def sequence_cost(capacity: int) -> float:
    """The default cost of a sequence: its tokens, and attention that grows with their square."""
    return capacity * (1 + capacity / 65536) + 32


def token_lengths(docs: DataFrame, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n): tokens of each whole text, the end id counted; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out = word_ids(tokenizer), []
        for i, body in rows_of(batches, "id", "body", size=128):
            out.append((i, words.count(body) + (end_id is not None)))
            if len(out) == 8192:
                yield batch(_LEN, **dict(zip(_LEN.names, zip(*out, strict=True), strict=True)))
                out = []
        if out:
            yield batch(_LEN, **dict(zip(_LEN.names, zip(*out, strict=True), strict=True)))

    return with_bytes(docs, id_col, text_col).withColumn("id", F.col("id").cast("long")).mapInArrow(run, "id long, n long")


def pack(lengths: Sequence[int], capacities: Sequence[int], cost: Callable[[int], float] = sequence_cost) -> list[tuple[int, int, int]]:
    """(bin, capacity, offset) of each length, none above the largest capacity.

    Longest first, each goes to the open bin with the least room that holds it.
    Where none does, a bin opens at the permitted size with the least cost for
    each token that can still fill it: the tokens left bound what a large bin can
    hold, so sizes are chosen with one another in view. At the end each bin
    shrinks to the smallest size that holds its contents.
    """
    sizes = sorted(set(capacities))
    costs = [cost(c) for c in sizes]
    left = sum(lengths)
    room_of: list[int] = []  # tokens put into each bin
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    open_at: dict[int, list[int]] = {}  # room left -> bins
    rooms = 0  # bit r is set if a bin with r tokens of room is open
    capacity: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = rooms >> n
        if fits and n:
            room = n + (fits & -fits).bit_length() - 1
            stack = open_at[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        elif not n and room_of:
            placed[i] = (0, 0)  # nothing to place
            continue
        else:
            best = min((c for c in range(len(sizes)) if sizes[c] >= n), key=lambda c: (costs[c] / max(1, min(sizes[c], left)), sizes[c]))
            b, room = len(room_of), sizes[best]
            room_of.append(0)
            capacity.append(sizes[best])
        placed[i] = (b, room_of[b])
        room_of[b] += n
        left -= n
        room -= n
        if room:
            open_at.setdefault(room, []).append(b)
            rooms |= 1 << room
    final = [min((c for c in sizes if c >= used), default=capacity[b]) for b, used in enumerate(room_of)]
    return [(b, final[b], at) for b, at in placed]


def best_fit(spark: SparkSession, lengths: DataFrame, capacities: Sequence[int] = (512, 1024, 2048, 4096, 8192), shard_rows: int = 50_000, cost: Callable[[int], float] = sequence_cost) -> DataFrame:
    """Pack (id, row, n) rows, n tokens each, into sequences; ``row`` tells rows of one id apart.

    Returns (id, row, piece, start, length, bin, capacity, at): one row for each
    piece. A document longer than the largest capacity is cut into full sequences
    and a rest. Rows are dealt by hash to shards of about ``shard_rows`` rows that
    are packed on their own (a shard leaves at most a few bins part empty), so no
    task grows with the input. Repeated rows are packed each; rows of no tokens
    and an empty table take no bin.
    """
    top = max(capacities)
    n_shards = max(1, -(-lengths.count() // shard_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for shard, *row in rows_of(batches, "shard", "n", "row", "id", size=4096):
            by.setdefault(shard, []).append(row)
        for shard, rows in sorted(by.items()):
            out, sizes = [], []
            for n, row, i in sorted(rows, key=lambda r: r[:2]):
                for piece, start in enumerate(range(0, n, top)):
                    sizes.append(min(top, n - start))
                    out.append((i, row, piece, start, sizes[-1]))
            done = [(*o, (shard << 32) + b, c, at) for o, (b, c, at) in zip(out, pack(sizes, capacities, cost), strict=True)]
            for at in range(0, len(done), 16384):
                yield batch(_OUT, **dict(zip(_OUT.names, zip(*done[at : at + 16384], strict=True), strict=True)))

    rows = lengths.where("n > 0").withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int"))
    return rows.repartition(n_shards, "shard").mapInArrow(run, "id long, row long, piece int, start long, length long, bin long, capacity int, at int")


def pack_documents(
    spark: SparkSession, docs: DataFrame, tokenizer: str, capacities: Sequence[int] = (512, 1024, 2048, 4096, 8192), end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Best-fit packing of whole texts by their token counts; see ``best_fit``.

    Rows get their ``row`` by id and length, those alike in both numbered, so the
    result doesn't hang on how the table is dealt out. A null or empty text is its end
    id alone, or takes no bin without one; repeated rows are packed each; an empty
    table gives no rows.
    """
    scratch = Scratch(spark, "packing")
    alike = scratch.table(token_lengths(docs, tokenizer, end_id, id_col, text_col), "lengths").groupBy("id", "n").agg(F.count("*").alias("rows"))
    rows = alike.select("id", "n", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("i"))
    return best_fit(spark, scratch.table(rows.select("id", "n", F.xxhash64("id", "n", "i").alias("row")), "rows"), capacities)
