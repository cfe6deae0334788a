"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths.

Items go in falling order of length. Each is put into the open bin whose free room is the least that holds it. If
none does, a bin is opened whose size is the cheapest per token it can still be filled with, counting a fixed cost
for each sequence and an attention cost that grows with the square of its length. When all are placed, every bin is
downsized to the least permitted length that holds its contents.

Items are dealt to packing groups of about `group_rows` by a hash of the row's place in the table, so any table is packed in
parallel and no group grows with it; a fuller bin than one group can make would have to cross groups, which costs
less than one bin a group and size. A document longer than the largest size is split into pieces of that size and
a rest; nothing is ever truncated.

Defined results: a null or empty text has length 1, its end-of-text token; repeated rows are packed as often as they
come; an empty table gives no rows. The result has its own columns only.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import cut

SIZES = (512, 1024, 2048, 4096, 8192)
OUT = "doc_id long, piece int, start long, length int, bin string, bin_offset int, capacity int"


def words_and_end(text: str = "text") -> Column:
    """A text's length in whitespace-separated words, plus one for its end-of-text token."""
    body = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return (F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit(""))) + F.when(body == "", 0).otherwise(1) + 1).cast("long")


def tokens_and_end(n_tokens: str = "n_tokens") -> Column:
    """A text's length in tokens, as `token_counts` gives it, plus its end-of-text token."""
    return F.col(n_tokens) + 1


def least_cost_size(length: int, waiting: int, sizes: Sequence[int], overhead: int, attention: int) -> int:
    """The permitted size that costs least per token, were it filled from what still waits; of equal ones the largest."""
    return min((s for s in sizes if s >= length), key=lambda s: ((s + overhead + s * s / attention) / min(s, length + waiting), -s))


def best_fit(lengths: Sequence[int], sizes: Sequence[int] = SIZES, overhead: int = 64, attention: int = 65536) -> tuple[list[int], list[int], list[int]]:
    """For lengths in falling order: each one's bin, its offset there, and each bin's capacity."""
    rooms: list[list[int]] = [[] for _ in range(max(sizes) + 1)]
    mask = 0  # bit r: some open bin has r tokens of room
    where, offset, used, opened = [], [], [], []
    waiting = sum(lengths)
    for n in lengths:
        waiting -= n
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            b, room = len(used), least_cost_size(n, waiting, sizes, overhead, attention)
            used.append(0)
            opened.append(room)
        where.append(b)
        offset.append(used[b])
        used[b] += n
        if room > n:
            rooms[room - n].append(b)
            mask |= 1 << (room - n)
    return where, offset, [min(s for s in sizes if s >= u) for u in used]


def pack(docs: DataFrame, length: Column, sizes: Sequence[int] = SIZES, group_rows: int = 20_000, doc_id: str = "doc_id", overhead: int = 64, attention: int = 65536) -> DataFrame:
    """doc_id, piece, start (in the document), length, bin, bin_offset and capacity of every piece of every row."""
    top = max(sizes)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.greatest(length, F.lit(1)).cast("long").alias("n"))
    rows = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {top} as int)"))).alias("piece"))
    rows = cut(rows.select("doc_id", "piece", (F.col("piece").cast("long") * top).alias("start"), F.least(F.col("n") - F.col("piece") * top, F.lit(top)).cast("int").alias("length"), F.monotonically_increasing_id().alias("_row")))
    groups = max(1, -(-rows.count() // group_rows))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "_row"], ascending=[False, True, True, True], kind="stable")
        where, offset, capacity = best_fit(pdf["length"].tolist(), sizes, overhead, attention)
        group = pdf["_group"].iloc[0]
        return pdf.assign(bin=[f"{group}-{b}" for b in where], bin_offset=offset, capacity=[capacity[b] for b in where])[["doc_id", "piece", "start", "length", "bin", "bin_offset", "capacity"]].astype({"doc_id": "Int64"})

    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int"))
    return dealt.groupBy("_group").applyInPandas(place, OUT)
