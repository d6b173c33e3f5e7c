"""Best-fit packing of token sequences in bulk-synchronous rounds.

Pieces are range-sorted by length over the cluster, which gives every piece a rank among those of its
length.  Gaps are kept as runs: sequences with the same free room and consecutive numbers.  Round by round,
from the longest length down, all pieces of a length are matched at once: the successor sweep goes over the
runs in ascending room from the smallest that holds the length, each sequence takes as many as fit, and the
pieces' ranks decide who goes where, so no two contend for a place.  Then the gaps are updated and the next
length follows.  That is best-fit decreasing, exactly.

Lengths are whole numbers up to the capacity, so the rounds work on at most ``capacity`` counts and a few
runs for each, at any corpus size; what grows with the corpus (sorting, ranking, placing) is distributed.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import bounded_batches, tidy, written
from docspark.llm.tokens import encoder
from docspark.operators.numbering import number_rows

CAPACITY = 1024
END_ID = 2


def plan_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces of each length.

    A row (length, first, n, per_sequence, sequence, offset) places the pieces ranked first..first+n-1 of
    that length: rank r goes to sequence ``sequence + (r - first) // per_sequence``, at ``offset`` plus
    length times ``(r - first) % per_sequence``.
    """
    gaps: dict[int, deque[tuple[int, int]]] = {}
    rooms: list[int] = []
    plan, opened = [], 0

    def free(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in gaps:
                gaps[room] = deque()
                bisect.insort(rooms, room)
            gaps[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = gaps[room].popleft()
                if not gaps[room]:
                    del gaps[room]
                    rooms.pop(at)
            else:
                room, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = room // length
            whole = min(n, left // each)
            if whole:
                plan.append((length, rank, whole * each, each, first, capacity - room))
                free(room - each * length, first, whole)
            rank, left = rank + whole * each, left - whole * each
            if whole < n and left:
                part = min(left, each)
                plan.append((length, rank, part, part, first + whole, capacity - room))
                free(room - part * length, first + whole, 1)
                rank, left, whole = rank + part, left - part, whole + 1
            free(room, first + whole, n - whole)
    return plan


def pack(pieces: DataFrame, keys: list[str], length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` (long) and ``offset`` (long, gapless from 0 in a sequence).

    ``pieces`` must be written data, as it is read more than once.  ``keys`` order pieces of equal length.
    Lengths must lie in 1..capacity; a null or other length is an error, an empty table gives no rows.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # at most ``capacity`` rows
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    before, total = {}, 0
    for n in sorted(counts):
        before[n] = total
        total += counts[n]
    plan = [(n, before[n] + first, before[n] + first + k, *rest) for n, first, k, *rest in plan_rounds(counts, capacity)]
    places = spark.createDataFrame(plan, "_length long, _first long, _end long, _each long, _sequence long, _offset long")
    ranked = number_rows(pieces, [length_col, *keys], "packing-ranks")
    nth = F.col("row_number") - F.col("_first")
    # the plan's size depends on the capacity alone, so it is safe to send to every task
    return (
        ranked.join(
            F.broadcast(places),
            (F.col(length_col) == F.col("_length")) & (F.col("row_number") >= F.col("_first")) & (F.col("row_number") < F.col("_end")),
        )
        .withColumn("sequence_id", F.col("_sequence") + F.floor(nth / F.col("_each")))
        .withColumn("offset", F.col("_offset") + F.col("_length") * F.pmod(nth, F.col("_each")))
        .drop("row_number", "_length", "_first", "_end", "_each", "_sequence", "_offset")
    )


def token_pieces(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """Pieces of every text's ids, each at most ``capacity`` long: id, piece, start, length, ids_crc32 (and ids).

    A text's ids are followed by ``end_id``.  Only texts with more ids than ``capacity`` are cut; their first
    piece takes the remainder, the others are full.  A null text counts as empty: one piece of the end id.
    """
    bounded_batches(df.sparkSession)
    slim = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        encode = encoder(tokenizer, True)
        for batch in batches:
            ids, bounds = encode.arrays(batch.column(1))
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4", copy=False)  # the end id follows each text
            first = bounds[:-1] + np.arange(batch.num_rows)
            n = np.diff(bounds) + 1
            pieces = -(-n // capacity)
            who = np.repeat(np.arange(batch.num_rows), pieces)
            k = np.arange(len(who)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            rest = n - (pieces - 1) * capacity  # of a text's ids, what its first piece takes
            start = np.where(k == 0, 0, rest[who] + (k - 1) * capacity)
            length = np.where(k == 0, rest[who], capacity)
            at = first[who] + start
            raw = memoryview(ids).cast("B")
            parts = [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), (at + length).tolist())]
            arrays = [batch.column(0).take(pa.array(who)), pa.array(k, pa.int32()), pa.array(start), pa.array(length)]
            arrays.append(pa.array(list(map(zlib.crc32, parts)), pa.int64()))
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(list(map(bytes, parts)), pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = dict(slim.dtypes)["_id"]
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return slim.mapInArrow(tidy(cut), schema)


def pack_documents(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Every document's pieces with their places in sequences of at most ``capacity`` ids.

    Result: ``<id_col>``, piece, start, length, ids_crc32, sequence_id, offset.  Repeated rows are packed each;
    null ids are kept; an empty table gives no rows; other columns are not read.
    """
    pieces = written(token_pieces(df, tokenizer, id_col, text_col, capacity, end_id), "packing-pieces")
    packed = pack(pieces, ["_id", "piece"], "length", capacity)
    names = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return packed.select(F.col("_id").alias(id_col), *names)


def sequences(packed: DataFrame, pieces_with_ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: sequence_id, ``ids`` (array of int) and the pieces' lengths.

    ``pieces_with_ids`` comes from ``token_pieces(..., with_ids=True)`` over unique ids.  A group is one
    sequence, so it is bounded by the capacity.
    """
    full = packed.join(pieces_with_ids.select(F.col("_id").alias(id_col), "piece", "ids"), [id_col, "piece"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    got = full.groupBy("sequence_id").agg(ordered.alias("parts"))
    hexes = F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")
    ints = F.transform(
        F.sequence(F.lit(0), (F.length("h") / 8 - 1).cast("int")),
        lambda i: F.conv(F.concat(*[F.substr("h", i * 8 + at, F.lit(2)) for at in (7, 5, 3, 1)]), 16, 10).cast("int"),
    )
    return got.withColumn("h", hexes).select(
        "sequence_id", ints.alias("ids"), F.transform("parts", lambda p: p["length"]).alias("lengths")
    )
