"""Packing token sequences by shortest-pack-first over the length histogram.

A document's ids (with an end id) are cut into pieces of at most ``LENGTH``; only their lengths are
counted. The histogram, of at most ``LENGTH`` entries whatever the corpus, is packed on the driver:
lengths go from the longest down, each into the open packing patterns with most room (the shortest
packs), whole counts of a pattern at a time; where none has room, new packs are opened. Once the
open packs have room for all tokens that are left, no pack is opened any more: a piece that fits
nowhere is cut to the room there is and its rest is placed in turn, so that in the end less than one
sequence is padding. The patterns are then joined back to the pieces by rank: a piece is the r-th of
its length, and the ranks of a length are dealt to pattern slots in intervals.

Ranks need no sort of the corpus: each task that writes the tokenised table numbers its pieces by
length, and the counts of the tasks before it (tasks x lengths, added up by a window per length)
offset those numbers. Ids are written once as compressed binary and read back for the cut.

Defined results: a null text counts as empty and is the end id alone; repeated rows are packed like
others; a null id is carried on; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import WordIds, made
from .common import map_texts, scratch_path, ship, stored

LENGTH = 4096
END_ID = 2


class Plan:
    """Intervals of ranks per length: (first rank, count, offset in the piece, part length, first sequence, offset in the sequence)."""

    def __init__(self) -> None:
        self.parts: dict[int, list[tuple[int, int, int, int, int, int]]] = defaultdict(list)
        self.sequences = 0

    def arrays(self) -> dict[int, np.ndarray]:
        return {k: np.array(sorted(v), np.int64) for k, v in self.parts.items()}


def pack(histogram: dict[int, int], length: int = LENGTH) -> Plan:
    """Shortest-pack-first over a histogram of lengths up to ``length``.

    A run is (origin length, first rank, count, offset in the piece): pieces that were cut go on as
    runs of a shorter length. An open pattern is a range of sequences with the same room.
    """
    plan = Plan()
    runs: dict[int, list[tuple[int, int, int, int]]] = {n: [(n, 0, c, 0)] for n, c in histogram.items() if c}
    waiting = [-n for n in runs]
    heapq.heapify(waiting)
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, count)
    rooms: list[int] = []  # of open patterns, greatest first
    left, room_total = sum(n * c for n, c in histogram.items()), 0

    def reopen(room: int, first: int, count: int) -> None:
        if room:
            if not open_[room]:
                heapq.heappush(rooms, -room)
            open_[room].append((first, count))

    while waiting:
        n = -heapq.heappop(waiting)
        for origin, rank, count, offset in runs.pop(n):
            while count:
                while rooms and not open_[-rooms[0]]:
                    heapq.heappop(rooms)
                room = -rooms[0] if rooms else 0
                if room >= n or room and room_total >= left:
                    part = min(n, room)
                    first, packs = open_[room].pop()
                    take = min(count, packs)
                    if packs > take:
                        open_[room].append((first + take, packs - take))
                    offset_in = length - room
                    room_total -= take * part
                else:
                    # So many new packs that the room covers what is then left, and no more.
                    part, first, room = n, plan.sequences, length
                    take = max(1, min(count, -(-(left - room_total) // length)))
                    plan.sequences += take
                    offset_in = 0
                    room_total += take * (length - part)
                plan.parts[origin].append((rank, take, offset, part, first, offset_in))
                left -= take * part
                reopen(room - part, first, take)
                if part < n:  # the rest of the cut pieces is a shorter length
                    rest = n - part
                    if rest not in runs:
                        runs[rest] = []
                        heapq.heappush(waiting, -rest)
                    runs[rest].append((origin, rank, take, offset + part))
                rank, count = rank + take, count - take
    return plan


def tokenised(docs: DataFrame, tokenizer: str, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document, written once to the shared folder: doc_id, ids (little-endian unsigned 32-bit, with the end id),
    part (the writing task), rest (ids after the full pieces), and its running numbers in that task: rest_local among
    equal rests, full_local among full pieces.
    """
    tail = np.array([end_id], np.uint32)
    rests: dict[int, int] = defaultdict(int)
    fulls = [0]

    def run(texts: list[str]) -> dict[str, list]:  # a task has its own copy of the counters
        out: dict[str, list] = {"ids": [], "rest": [], "rest_local": [], "full": [], "full_local": []}
        for x in made(WordIds, tokenizer).encode(texts):
            full, rest = divmod(len(x) + 1, length)
            values = (np.concatenate([x, tail]).astype("<u4").tobytes(), rest, rests[rest], full, fulls[0])
            for c, v in zip(out, values, strict=True):
                out[c].append(v)
            rests[rest] += 1
            fulls[0] += full
        return out

    spark = docs.sparkSession
    rows = map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, "ids binary, rest int, rest_local long, full long, full_local long")
    rows = rows.withColumn("part", F.spark_partition_id())
    path = scratch_path(spark, "tokens")
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _cut(parts: dict[int, np.ndarray], length: int):
    """Pieces of each document by its pieces' ranks: full pieces have consecutive ranks, the rest has one."""

    cache: dict[int, tuple] = {}

    def run(batches):
        import pyarrow as pa

        columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            out: dict[str, list] = {c: [] for c in columns}
            source: list[int] = []
            full, rest = batch.column("full_rank").to_pylist(), batch.column("rest_rank").to_pylist()
            for i, raw in enumerate(batch.column("ids").to_pylist()):
                view, total = memoryview(raw), len(raw) // 4
                for at in range(0, total, length):
                    n = min(length, total - at)
                    rank = full[i] + at // length if n == length else rest[i]
                    if n not in cache:
                        cache[n] = _index(parts[n])
                    for first, _, offset, part, sequence, offset_in in _lookup(cache[n], rank):
                        start = at + offset
                        source.append(i)
                        for c, v in zip(columns, (start, part, zlib.crc32(view[4 * start : 4 * (start + part)]), total, sequence + rank - first, offset_in), strict=True):
                            out[c].append(v)
            ids = batch.column("doc_id").take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(out[c], pa.int64()) for c in columns)], names=["doc_id", *columns])

    return run


def _index(rows: np.ndarray) -> tuple[np.ndarray, list[list[tuple]]]:
    """Rank borders of a length, and the parts of the pieces between two borders."""
    borders = np.unique(np.concatenate([rows[:, 0], rows[:, 0] + rows[:, 1]]))
    held: list[list[tuple]] = [[] for _ in borders]
    for row in rows:
        for b in range(np.searchsorted(borders, row[0]), np.searchsorted(borders, row[0] + row[1])):
            held[b].append(tuple(int(x) for x in row))
    return borders, [sorted(h, key=lambda r: r[2]) for h in held]


def _lookup(index: tuple, rank: int) -> list[tuple]:
    borders, held = index
    return held[int(np.searchsorted(borders, rank, side="right")) - 1]


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    tokens = tokenised(docs, tokenizer, length, end_id, id_col, text_col)
    # One row per (task, length of the rest): how many rests, and full pieces of those documents.
    counted = stored(tokens.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("rests"), F.sum("full").alias("full")), "lengths")
    histogram = {r[0]: r[1] for r in counted.where("rest > 0").groupBy("rest").agg(F.sum("rests")).collect()}  # fewer than ``length`` rows
    histogram[length] = counted.agg(F.sum("full")).first()[0] or 0
    plan = pack(histogram, length)
    earlier = lambda w: w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    fulls = counted.groupBy("part").agg(F.sum("full").alias("full")).select("part", F.coalesce(F.sum("full").over(earlier(Window.partitionBy())), F.lit(0)).alias("full_before"))
    rest_before = F.coalesce(F.sum("rests").over(earlier(Window.partitionBy("rest"))), F.lit(0))
    # One row per task, of at most ``length`` entries: adaptive execution broadcasts them while they are small.
    entries = F.map_from_entries(F.collect_list(F.struct("rest", "rest_before")))
    offsets = counted.select("part", "rest", rest_before.alias("rest_before")).groupBy("part").agg(entries.alias("rests_before")).join(fulls, "part")
    rest_rank = F.element_at("rests_before", F.col("rest")) + F.col("rest_local")
    ranked = tokens.join(offsets, "part").select("doc_id", "ids", rest_rank.alias("rest_rank"), (F.col("full_before") + F.col("full_local")).alias("full_rank"))
    kind = tokens.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(_cut(plan.arrays(), length), schema)


def padding(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row: sequences, tokens and padded places (a sequence at a power of two needs none)."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1)
    return per.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(power == 0, 0).otherwise(length - F.col("n"))).alias("padding"))
