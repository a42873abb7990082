"""Operator 4: best-fit packing of tokenized documents, two at a time (best-two-fit).

Documents are tokenized in place and only those longer than a sequence are cut. How
pieces are packed depends on their lengths alone, so the plan is made on the counts of
lengths (at most as many as a sequence has tokens, whatever the corpus): a sequence is
filled greedily with the longest pieces that fit; then its smallest piece is exchanged
for two unpacked ones that fill the wider gap more tightly; the pattern found is used
as often as the counts allow. Pieces take their places by rank within their length:
ranks come from counts per task and length, never from ordering all pieces of a length.

Defined cases: null or empty text is the end id alone; repeated rows are packed as
documents of their own; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._shared import written
from .encoding import encoder
from .tokens import tokenizer_path

#: Fixed values of the contract.
TOKENIZER, END, ROOM = "word_bpe_49k.json", 1, 4096


def plan_patterns(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """counts[n]: pieces of length n, for n up to the room of a sequence. Patterns, as
    ([(length, how many)], sequences of that kind); together they use every piece once."""
    room, left, out = len(counts) - 1, counts.astype(np.int64).copy(), []
    while (lengths := np.flatnonzero(left)).size:
        used: dict[int, int] = {}

        def add(n: int, times: int = 1) -> None:
            used[n] = used.get(n, 0) + times
            left[n] -= times
            if not used[n]:
                del used[n]

        add(int(lengths[-1]))
        gap = room - int(lengths[-1])
        while gap and (fits := np.flatnonzero(left[: gap + 1])).size:
            n = int(fits[-1])
            times = min(int(left[n]), gap // n)
            add(n, times)
            gap -= n * times
        if gap and sum(used.values()) > 1:
            small = min(used)
            wider = gap + small
            found = np.flatnonzero(left[:wider])
            if found.size:
                under = np.maximum.accumulate(np.where(left[: wider + 1] > 0, np.arange(wider + 1), 0))
                other = under[np.minimum(wider - found, found)]
                alone = (other == found) & (left[found] < 2)
                other = np.where(alone, under[np.maximum(found - 1, 0)], other)
                total = np.where(other > 0, found + other, 0)
                i = int(total.argmax())
                if total[i] > small:
                    add(small, -1)
                    add(int(found[i]))
                    add(int(other[i]))
        # left is now what one sequence leaves; as many more as it still holds
        more = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * more
        out.append((sorted(used.items(), reverse=True), more + 1))
    return out


def _layout(patterns, room: int) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, pieces in a sequence, first sequence, first offset), by rank."""
    seen, rows, sequence = np.zeros(room + 1, np.int64), {}, 0
    for pattern, times in patterns:
        offset = 0
        for n, k in pattern:
            rows.setdefault(n, []).append((int(seen[n]), k, sequence, offset))
            seen[n] += k * times
            offset += n * k
        sequence += times
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def _pieces(tokenizer: str, cut: str, end: int, room: int, with_ids: bool):
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, encode, seen = TaskContext.get().partitionId(), encoder(tokenizer, cut), np.zeros(room + 1, np.int64)
        for b in batches:
            texts = b["text"].tolist()
            for lo in range(0, len(texts), 1024):
                rows = []
                for doc, ids in zip(b["doc_id"].iloc[lo : lo + 1024], encode.encode([x if isinstance(x, str) else None for x in texts[lo : lo + 1024]], end)):
                    for i, at in enumerate(range(0, len(ids), room)):
                        one = ids[at : at + room].astype("<u4").tobytes()
                        n = len(one) // 4
                        rows.append((None if pd.isna(doc) else int(doc), i, at, n, zlib.crc32(one), part, int(seen[n]), one if with_ids else None))
                        seen[n] += 1
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"])
                yield out.astype({"doc_id": "Int64"})

    return pieces


def _placed(layout: dict[int, np.ndarray]):
    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            lengths, ranks = b["length"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            order = np.argsort(lengths, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(some):
                    n = int(lengths[some[0]])
                    rows = layout[n]
                    row = rows[np.searchsorted(rows[:, 0], ranks[some], "right") - 1]
                    local = ranks[some] - row[:, 0]
                    sequence[some], offset[some] = row[:, 2] + local // row[:, 1], row[:, 3] + local % row[:, 1] * n
            yield b.drop(columns=["rank"]).assign(sequence_id=sequence, offset=offset)

    return placed


def pack_documents(docs: DataFrame, *, tokenizer: str, cut: str = "drop", end: int = END, room: int = ROOM, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, 32-bit
    little-endian, if asked for)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long, ids binary"
    pieces = rows.mapInPandas(_pieces(tokenizer, cut, end, room, with_ids), schema)
    pieces = written(pieces if with_ids else pieces.drop("ids"), "pieces")
    each = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(room + 1, np.int64)
    for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most a row for each length
        counts[r["length"]] = r["n"]
    layout = _layout(plan_patterns(counts), room)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    each = each.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(each, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before")).drop("part", "nth", "before")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + ("ids binary, " if with_ids else "") + "sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInPandas(_placed(layout), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer=tokenizer_path(TOKENIZER))
