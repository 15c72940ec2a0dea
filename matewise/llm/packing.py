"""Sum-of-squares packing of documents into sequences of bounded length.

Within a packing group, pieces come longest first.  A piece goes to the open bin for
which the sum over residual gaps of (open bins with that gap) squared becomes smallest,
the smaller gap winning ties; a new bin is opened only where no open one has room.
Bins without a gap are closed and count nothing.

Groups hold about ``group_rows`` pieces by a hash of the piece, so that a task packs a
bounded number; at that size a group wastes a few bins in thousands.  Lengths travel,
ids do not.

Edge cases: a null or empty text is the end id alone; repeated rows and rows without an id are packed each;
an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .tokens import cut_pieces


def sum_of_squares(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece, for pieces in the order given."""
    open_bins: list[list[int]] = [[] for _ in range(most + 1)]
    count = np.zeros(most + 1, dtype=np.int64)
    bins, offsets, n_bins, never = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0, 1 << 40
    for i, size in enumerate(lengths.tolist()):
        if not 0 < size <= most:
            raise ValueError("a piece must be between 1 and the sequence length")
        after = count[: most + 1 - size].copy()
        after[0] = 0
        here = count[size:]
        cost = np.where(here > 0, after - here + 1, never)
        cost[-1] = never - 1
        gap = int(np.argmin(cost)) + size
        if gap == most:
            b, n_bins = n_bins, n_bins + 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        if gap > size:
            open_bins[gap - size].append(b)
            count[gap - size] += 1
        bins[i], offsets[i] = b, most - gap
    return bins, offsets


def pack(
    docs: DataFrame,
    path: str,
    most: int = 2048,
    end_id: int = 0,
    group_rows: int = 16_384,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stash(cut_pieces(docs, path, most, end_id, id_col, text_col), "pieces")
    groups = max(1, round(pieces.count() / group_rows))
    id_type = pieces.schema["id"].dataType.simpleString()

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
        bins, offsets = sum_of_squares(table.column("length").to_numpy(), most)
        group = table.column("group").to_numpy().astype(np.int64)
        out = table.drop_columns(["row", "group"])
        return out.append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    return (
        pieces.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
        .groupBy("group")
        .applyInArrow(
            place,
            f"id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
        )
    )
