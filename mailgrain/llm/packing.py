"""Best-fit packing of whole corpora, planned on the length histogram (best two fit).

Documents become pieces of at most `capacity` tokens; only longer documents are cut. How pieces are put together
depends on their lengths alone, so the plan is made from the counts of pieces per length: at most `capacity` numbers,
whatever the corpus. The plan fills a sequence greedily with the longest lengths that still fit, then drops its
shortest piece if two unpacked ones fill the widened gap more tightly, and repeats that sequence as often as the
counts allow. Every step of the plan uses up at least one length, so it has a few thousand steps at most.

Pieces take their places by rank within their length. Ranks are counted in salted groups (length, salt), so a length
that a third of all pieces share is ranked by many tasks, and only small per-group counts are summed across them.

Null text is empty: one piece that holds the end id alone. Rows with the same id are packed each on its own. Other
columns are ignored; an empty table gives an empty result.
"""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, written
from .encoding import encoder, vocabulary


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32), one row per piece; ids themselves are not kept."""

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = memoryview(enc.ids(text.as_py() or "") + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield arrow_rows([id_col, "piece", "start", "length", "ids_crc32"], [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()],
                             [b.column(0).take(pa.array(rows, pa.int64())), piece, start, length, crc])

    kept = docs.select(id_col, text_col)
    return kept.mapInArrow(run, f"`{id_col}` {dict(kept.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict, capacity: int):
    """[({length: copies}, times)]: how many sequences of which lengths use up `counts` (length -> pieces)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    places = np.arange(capacity + 1)

    def fitting():
        """For each gap the longest length left that fits it (0: none)."""
        return np.maximum.accumulate(np.where(left > 0, places, 0))

    out, best = [], fitting()
    while best[capacity]:
        used, gap = Counter(), capacity
        while gap and best[gap]:
            length = int(best[gap])
            n = min(int(left[length]), gap // length)
            used[length] += n
            left[length] -= n
            gap -= n * length
            if not left[length]:
                best = fitting()
        if gap and sum(used.values()) > 1:  # widen the gap by the shortest piece and look for two that fill it better
            short = min(used)
            wide = gap + short
            partner = best[np.maximum(wide - places[1:wide], 0)]
            first = places[1:wide]
            alone = (partner == first) & (left[first] < 2)
            partner = np.where(alone, best[np.maximum(first - 1, 0)], partner)
            sums = np.where((left[first] > 0) & (partner > 0), first + partner, 0)
            if len(sums) and sums.max() > short:
                a = int(first[sums.argmax()])
                b = int(partner[sums.argmax()])
                used[short] -= 1
                left[short] += 1
                for x in (a, b):
                    used[x] += 1
                    left[x] -= 1
                used = +used
        times = 1 + min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * (times - 1)
        best = fitting()
        out.append((dict(used), times))
    return out


def _runs(steps):
    """Arrays sorted by (length, first rank): length, first rank, copies, first sequence, offset of the first copy."""
    taken, rows, sequence = Counter(), [], 0
    for used, times in steps:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, taken[length], n, sequence, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(parts: DataFrame, capacity: int = 4096, id_col: str = "doc_id", salts: int = 64) -> DataFrame:
    """`parts` (as from `pieces`) with sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = parts.sparkSession.sparkContext.broadcast(_runs(plan(counts, capacity)))
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "__salt").count()
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "__salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__salt").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = salted.withColumn("__rank", F.row_number().over(inside)).join(groups, ["length", "__salt"]).select(
        *parts.columns, (F.col("__before") + F.col("__rank") - 1).alias("__rank"))

    def place(batches):
        table = runs.value
        width = np.int64(1) << 44
        keys = table[:, 0] * width + table[:, 1]
        for b in batches:
            rank, length = b.column("__rank").to_numpy(), b.column("length").to_numpy()
            _, first, n, sequence, offset = table[np.searchsorted(keys, length * width + rank, "right") - 1].T
            at = rank - first
            yield arrow_rows([*b.schema.names[:-1], "sequence_id", "offset"], [*(f.type for f in list(b.schema)[:-1]), pa.int64(), pa.int64()],
                             [*b.columns[:-1], sequence + at // n, offset + at % n * length])

    schema = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack `docs`: one row per piece."""
    tokenizer = tokenizer or vocabulary("word_bpe_49k.json")
    return pack(written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity, id_col)
