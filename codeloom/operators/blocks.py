"""Steps over blocks: each block of a table is one row of packed numbers, and blocks send each other packed messages.

A step is called once per block with all that was sent to it and yields what it sends. Numbers travel as one binary value
for each pair of blocks, so a number costs some bytes in a shuffle and no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, functions as F

#: What a step yields: block, block it comes from, kind, a number of the step's choice, packed data.
SENT = "dst INT, src INT, kind STRING, n BIGINT, data BINARY"
Sent = tuple[int, int, str, int, bytes]


class Inbox:
    """What was sent to one block, by kind."""

    def __init__(self, block: int, t: pa.Table):
        self.block, self._by = block, {}
        for src, kind, n, data in zip(*(t.column(c).to_pylist() if c != "data" else t.column(c) for c in ("src", "kind", "n", "data"))):
            self._by.setdefault(kind, []).append((src, n, data.as_buffer()))
        for got in self._by.values():
            got.sort(key=lambda x: x[0])

    def numbers(self, kind: str, width: int) -> np.ndarray:
        """(width, rows), in order of the sending block."""
        got = [np.frombuffer(d, np.int64).reshape(width, -1) for _, _, d in self._by.get(kind, []) if len(d)]
        return np.concatenate(got, axis=1) if got else np.empty((width, 0), np.int64)

    def senders(self, kind: str, width: int) -> np.ndarray:
        """The sending block of each row of numbers()."""
        got = [np.full(len(d) // (8 * width), src, np.int64) for src, _, d in self._by.get(kind, [])]
        return np.concatenate(got) if got else np.empty(0, np.int64)

    def tables(self, kind: str) -> list[tuple[int, pa.Table]]:
        return [(src, pa.ipc.open_stream(d).read_all()) for src, _, d in self._by.get(kind, [])]


def numbers(src: int, dst: int, kind: str, *columns: np.ndarray) -> Sent:
    return dst, src, kind, len(columns[0]), np.stack([np.asarray(c, np.int64) for c in columns]).tobytes()


def packed(src: int, dst: int, kind: str, t: pa.Table) -> Sent:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return dst, src, kind, t.num_rows, sink.getvalue().to_pybytes()


def split(dst: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows for each block that gets any."""
    order = np.argsort(dst, kind="stable")
    to, at = np.unique(dst[order], return_index=True)
    yield from zip(to.tolist(), np.split(order, at[1:]))


def scatter(src: int, dst: np.ndarray, kind: str, *columns: np.ndarray) -> Iterator[Sent]:
    all_ = np.stack([np.asarray(c, np.int64) for c in columns])
    for to, rows in split(dst):
        yield to, src, kind, len(rows), all_[:, rows].tobytes()


def sent(messages: Iterable[Sent]) -> pa.Table:
    columns = list(zip(*messages)) or [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary()))], names=["dst", "src", "kind", "n", "data"])


def inbox(t: pa.Table) -> Inbox:
    return Inbox(t.column("dst")[0].as_py(), t)


def grouped(df: DataFrame, blocks: int) -> GroupedData:
    return df.repartitionById(blocks, F.col("dst")).groupBy("dst")


def together(blocks: int, *inputs: DataFrame) -> GroupedData:
    return grouped(reduce(DataFrame.unionByName, [i.select("dst", "src", "kind", "n", "data") for i in inputs]), blocks)


def step(f: Callable[[Inbox], Iterable[Sent]], blocks: int, *inputs: DataFrame) -> DataFrame:
    """f for each block that anything in inputs was sent to."""
    return together(blocks, *inputs).applyInArrow(lambda t: sent(f(inbox(t))), SENT)
