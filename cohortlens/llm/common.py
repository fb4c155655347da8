"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_base

#: Bytes of text that a task holds decoded at once (a single longer text is held alone).
SLICE_BYTES = 6 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder the cluster names in spark.checkpoint.dir.

    Only where that is unset (local tests) a temporary folder of this machine is taken.
    """
    base = shared_base(spark)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back: runs a job.

    Later branches read the table, so nothing is computed twice and a lost executor costs no earlier stage.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """Column of texts, null as empty, as one 64-bit-offset string array."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).fill_null("")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a non-null large_string array; offsets start at 0."""
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[off[0]:off[-1]] if len(texts) else np.zeros(0, np.uint8)
    return off - (off[0] if len(off) else 0), data


def text_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in order, number of words of each text), split at ASCII white space; lower: A-Z made a-z."""
    offsets, data = text_bytes(texts)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    if lower:
        data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    before = np.empty(len(data), bool)
    before[:1], before[1:] = True, gap[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = True, gap[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(before & ~gap), np.flatnonzero(after & ~gap) + 1
    # a word and the gap after it are neighbours in the buffer: keep every second of the elements between the bounds
    bounds = np.empty(2 * len(starts) + 1, np.int64)
    bounds[0:-1:2], bounds[1::2] = starts, ends
    bounds[-1] = ends[-1] if len(ends) else 0
    both = pa.LargeStringArray.from_buffers(2 * len(starts), pa.py_buffer(bounds), pa.py_buffer(data.tobytes()))
    words = both.take(pa.array(np.arange(0, 2 * len(starts), 2)))
    at = np.searchsorted(starts, offsets)
    return words, np.diff(at)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of all stretches one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together have about ``most`` bytes; every row is in one, a longer text alone."""
    if not len(texts):
        return
    off, _ = text_bytes(texts)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(off, off[start] + most, side="right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield start, end
        start = end


def per_text(fn: Callable[[pa.Array], dict[str, pa.Array]], text: str, keep: list[str], added: list[tuple[str, pa.DataType]],
             most: int = SLICE_BYTES):
    """Function for mapInArrow: for each batch the columns ``keep`` and what ``fn`` makes of slices of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, text)
            for a, b in slices(texts, most):
                made = fn(texts.slice(a, b - a))
                part = batch.slice(a, b - a)
                cols = [part.column(part.schema.get_field_index(k)) for k in keep]
                cols += [made[k].cast(kind) if made[k].type != kind else made[k] for k, kind in added]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *(k for k, _ in added)])

    return run


def columns_of(df: DataFrame) -> list:
    """All columns of ``df`` whatever is in their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` (in any case) has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def file_system_path(folder: str):
    """(pyarrow file system, path in it) of a folder named by a URI; executors reach the shared store by it."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(folder)


