"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text processed between two hand-overs to Arrow, in bytes: bounds a worker's memory.
SLICE_BYTES = 4 << 20

#: Columns of the documents table that the operators read.
ID, TEXT, LANG, HOST = "doc_id", "text", "lang", "source"


_held: dict = {}


def worker_cache(name, make: Callable):
    """What ``make`` returned when this worker process first asked for ``name``.

    Later tasks find it again.  A worker holds one such cache: asking for another
    frees the one before, so operators run in turn do not add up their memory.
    """
    if name not in _held:
        if _held:
            _held.clear()
            give_back()
        _held[name] = make()
    return _held[name]


def free_caches() -> None:
    """For a task without a cache: frees what another operator's tasks left in this worker."""
    if _held:
        _held.clear()
        give_back()


def give_back() -> None:
    """Returns freed memory of this process to the system, where its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def default_tokenizer(name: str) -> str:
    """Place of a public tokenizer file; a path can be given instead."""
    import public_tokenizers
    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """The tokenizer as the library loads it, without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut Arrow batches into runs of rows of at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                part = batch.slice(start, i - start)
                yield part, col.slice(start, i - start).to_pylist()
                start, total = i, 0
            total += size
        yield batch.slice(start), col.slice(start).to_pylist()


def key_part(col: str | Column) -> Column:
    """A key column as a string in which null has a value of its own (joins on it match nulls)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
