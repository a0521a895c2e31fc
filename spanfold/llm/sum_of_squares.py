"""Packing documents into fixed-length sequences by the sum-of-squares rule.

N(g) counts the open sequences with g tokens of room.  A piece goes where the
sum of N(g)^2 comes out smallest: into an open sequence with enough room or into
a new one (ties: the smallest room).  Documents longer than a sequence are cut
into full pieces and a last, shorter one.  Each task packs the documents it
reads; what is still open at its end is dissolved and packed again, largest
piece first, into the tightest room.  Pieces of sequences that still leave room
go to a second round, which packs those of many tasks in the same way.  A task
holds piece rows only, never ids: those of its open sequences, or about
``ROUND_PIECES`` in the second round.

Cases: null or empty text is the end id alone; repeated rows are packed each;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import ID, SLICE_BYTES, TEXT, default_tokenizer, slices
from .word_ids import WordIds


#: Pieces that a task of the second round packs, about.
ROUND_PIECES = 100_000


class SumOfSquares:
    """Open sequences by room; ``place`` returns sequences that are full."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int, item) -> list | None:
        """Put ``item`` of ``size`` into a sequence; the sequence's items if that is now full."""
        cap, count = self.capacity, self.count
        if size == cap:
            return [(item, size)]
        rooms = np.flatnonzero(count[size:cap]) + size
        best, room = 2 * int(count[cap - size]) + 1, cap
        if len(rooms):
            after = rooms - size
            change = np.where(after > 0, 2 * count[after] + 1, 0) - 2 * count[rooms] + 1
            k = int(np.argmin(change))
            if change[k] <= best:
                room = int(rooms[k])
        if room == cap:
            seq = []
        else:
            seq = self.open[room].pop()
            count[room] -= 1
        seq.append((item, size))
        left = room - size
        if not left:
            return seq
        self.open[left].append(seq)
        count[left] += 1
        return None

    def close(self) -> list[tuple]:
        """The (item, size) of all sequences still open, which are dissolved."""
        left = [x for seqs in self.open for seq in seqs for x in seq]
        self.__init__(self.capacity)
        return left


def largest_first(items: list[tuple], capacity: int) -> Iterator[tuple[list, int]]:
    """(sequence, room) of (item, size) packed largest first, each into the tightest sequence with room."""
    rooms: list[int] = []                            # ascending, one for each open sequence
    held: dict[int, list[list]] = {}
    for item in sorted(items, key=lambda x: -x[1]):
        size = item[1]
        k = bisect_left(rooms, size)
        if k < len(rooms):
            old = rooms.pop(k)
            seq = held[old].pop()
        else:
            old, seq = capacity, []
        seq.append(item)
        if old == size:
            yield seq, 0
        else:
            insort(rooms, old - size)
            held.setdefault(old - size, []).append(seq)
    for room, seqs in held.items():
        for seq in seqs:
            yield seq, room


def pack(docs: DataFrame, length: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = tokenizer or default_tokenizer("word_bpe_49k.json")
    kind = docs.schema[ID].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def batch(rows: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], doc_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

    def placed(rows: list[tuple], seq: list, number: int) -> None:
        offset = 0
        for item, size in seq:
            rows.append((*item, number, offset))
            offset += size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = WordIds.shared(path), SumOfSquares(length)
        number, rows, doc_type = TaskContext.get().partitionId() << 40, [], None
        for part, _ in slices(batches, limit=SLICE_BYTES // 2):
            doc_type = part.schema.field("doc_id").type
            ids, sizes = words.encode_column(part.column("text"), end_id)
            ids, at = ids.astype("<u4", copy=False), 0
            for doc, size in zip(part.column("doc_id").to_pylist(), sizes.tolist()):
                for piece, start in enumerate(range(0, size, length)):
                    n = min(length, size - start)
                    full = packer.place(n, (doc, piece, start, n, zlib.crc32(ids[at + start:at + start + n])))
                    if full:
                        placed(rows, full, number)
                        number += 1
                at += size
            if len(rows) > 5000:
                yield batch(rows, doc_type)
        # the open sequences' pieces, largest first; those that still leave room go to the second round
        open_row = 0
        for seq, room in largest_first(packer.close(), length):
            if room <= length // 1024:
                placed(rows, seq, number)
                number += 1
            else:
                for item, _ in seq:
                    rows.append((*item, None, (number & ~((1 << 40) - 1)) + open_row))
                    open_row += 1
        if rows:
            yield batch(rows, doc_type)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, doc_type = [], None
        for b in batches:
            doc_type = b.schema.field("doc_id").type
            items += [(r[:5], r[3]) for r in zip(*(b.column(c).to_pylist() for c in names[:5]))]
        rows, number = [], -1 - (TaskContext.get().partitionId() << 40)
        for seq, _ in largest_first(items, length):
            placed(rows, seq, number)
            number -= 1
        if rows:
            yield batch(rows, doc_type)

    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:])
    spark, out = docs.sparkSession, scratch_path(docs.sparkSession, "packed-pieces")
    docs.select(F.col(ID).alias("doc_id"), F.col(TEXT).alias("text")).mapInArrow(run, schema).write.parquet(out)
    rows = spark.read.schema(schema).parquet(out)
    rest = rows.where("sequence_id IS NULL")
    # offset numbers the pieces handed over: they are dealt evenly, whatever their ids
    groups = max(1, -(-rest.count() // ROUND_PIECES))
    second = rest.repartition(groups, F.xxhash64("offset")).mapInArrow(again, schema)
    return rows.where("sequence_id IS NOT NULL").unionByName(second).withColumn("piece", F.col("piece").cast("int"))
