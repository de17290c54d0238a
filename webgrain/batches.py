"""Arrow batches worked on in pieces, so that what a Python worker holds doesn't grow with a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

#: Bytes of a piece, if it has more than one row.
PIECE = 1 << 19


def pieces(batch, size: int = PIECE) -> Iterator:
    """A batch cut into halves until each has at most ``size`` bytes or one row; nothing is copied."""
    if batch.num_rows < 2 or batch.nbytes <= size:
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), size)
    yield from pieces(batch.slice(half), size)


def by_pieces(df: DataFrame, schema: str, apply: Callable, size: int = PIECE) -> DataFrame:
    """``mapInArrow`` by pieces: ``apply`` makes one record batch of a piece. Memory that Arrow no longer uses is given back after each batch."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for piece in pieces(batch, size):
                yield apply(piece)
            del batch
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
