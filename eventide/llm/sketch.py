"""Count-min sketches of a whole table, built per partition and merged by Spark.

The sketch has two rows of counters. Only one question is asked of it: may an item occur twice or
more? So a counter saturates at two, and the merged sketch is one bit per counter. Its size follows
the number of items up to ``MAX_BITS`` in all (128 MB), which bounds what is broadcast; beyond that
it lets more single items through, and never hides a repeated one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F

MAX_BITS = 1 << 30
ROWS = 2
_FLUSH = 1 << 20


def row_bits(items: int) -> int:
    """Logarithm of the counters per row: four or more per item, as far as the bound allows."""
    most = (MAX_BITS // ROWS).bit_length() - 1
    return min(most, max(16, (4 * max(1, items) - 1).bit_length()))


def counters(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each identifier in either row."""
    return tuple(_row_counters(ids, bits, row) for row in range(ROWS))


def _row_counters(ids: np.ndarray, bits: int, row: int) -> np.ndarray:
    places = ids >> np.uint64(64 - bits) if row else ids & np.uint64((1 << bits) - 1)
    return places.view(np.int64)


def _encode(ids: np.ndarray, bits: int) -> Iterator[dict]:
    """Partition sketch, sparse: for each block of counters, how many entries every run of 256
    counters holds, and their low bytes. An entry stands twice if it was counted twice or more."""
    block = min(bits, 23)
    for row in range(ROWS):
        places = _row_counters(ids, bits, row)  # one row at a time: a task holds both its Python and its JVM's memory
        places.sort()
        third = np.zeros(len(places), bool)
        third[2:] = places[2:] == places[:-2]
        places = places[~third]
        cuts = np.searchsorted(places, np.arange((1 << (bits - block)) + 1) << block)
        for k in np.flatnonzero(np.diff(cuts)):
            part = places[cuts[k] : cuts[k + 1]] & ((1 << block) - 1)
            many = np.bincount(part >> 8, minlength=1 << (block - 8)).astype(np.uint16)
            yield {"slot": (row << (bits - block)) + int(k), "many": pa.compress(many.tobytes(), "zstd", asbytes=True), "low": (part & 255).astype(np.uint8).tobytes()}


def _partition_sketches(ids_of: Callable, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        schema = pa.schema([("slot", pa.int32()), ("many", pa.binary()), ("low", pa.binary())])

        def flush() -> Iterator[pa.RecordBatch]:
            rows, ids = [], np.concatenate(held)
            held.clear()
            for row in _encode(ids, bits):
                rows.append(row)
                if len(rows) == 16:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for ids in ids_of(batch):
                held.append(ids)
                n += len(ids)
                if n >= _FLUSH:
                    yield from flush()
                    n = 0
        if n:
            yield from flush()

    return run


def _merge(bits: int) -> Callable:
    """Streams partition sketches in order of their slot; one block of counters is held at a time."""
    block = min(bits, 23)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, count = None, None

        def done() -> pa.RecordBatch:
            packed = np.packbits(count >= 2, bitorder="little").tobytes()
            return pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int32()), "bits": pa.array([packed], pa.binary())})

        for batch in batches:
            for k, many, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != slot:
                    if slot is not None:
                        yield done()
                    slot, count = k, np.zeros(1 << block, np.uint8)
                many = np.frombuffer(pa.decompress(many, 2 << (block - 8), "zstd"), np.uint16)
                places = (np.repeat(np.arange(len(many)) << 8, many)) + np.frombuffer(low, np.uint8)
                again = np.zeros(len(places), bool)
                again[1:] = places[1:] == places[:-1]
                once, twice = places[~again], places[again]
                count[once] = np.minimum(count[once] + 1, 2)
                count[twice] = 2
        if slot is not None:
            yield done()

    return run


def repeated_bits(rows: DataFrame, ids_of: Callable, items: int) -> tuple[Broadcast, int]:
    """Merged sketch of the identifiers that ``ids_of`` yields per Arrow batch; broadcast, with the
    logarithm of its row length."""
    bits = row_bits(items)
    block = min(bits, 23)
    parts = rows.mapInArrow(_partition_sketches(ids_of, bits), "slot int, many binary, low binary")
    merged = parts.repartition("slot").sortWithinPartitions("slot").mapInArrow(_merge(bits), "slot int, bits binary")
    whole = np.zeros((ROWS << bits) >> 3, np.uint8)
    for row in merged.toLocalIterator():
        at = (row.slot << block) >> 3
        whole[at : at + (1 << block >> 3)] = np.frombuffer(row.bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast((pa.compress(whole, "zstd", asbytes=True), len(whole))), bits


def read(shared: Broadcast) -> np.ndarray:
    """The sketch in a task: it travels and waits compressed, as few of its bits are set."""
    packed, size = shared.value
    return np.frombuffer(pa.decompress(packed, size, "zstd"), np.uint8)


def may_repeat(sketch: np.ndarray, ids: np.ndarray, bits: int) -> np.ndarray:
    """False only for identifiers that certainly occur once."""
    out = np.ones(len(ids), bool)
    for row, places in enumerate(counters(ids, bits)):
        places += row << bits
        out &= (sketch[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
    return out
