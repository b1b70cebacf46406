"""Packing of documents into sequences of fixed length, by bin completion.

How many pieces have which length is all that packing depends on, and there are
at most ``capacity`` lengths.  So the search runs over this histogram, whose
size does not grow with the corpus, and yields *patterns*: a multiset of lengths
that fills one sequence, and how often it is used.  Pieces get their places from
their rank among the pieces of equal length, which is counted per task and
joined, so no length is ever gathered in one task.

The search takes the largest length that is left, enumerates the fillings of
the room beside it that no other filling dominates, best first, and prunes by
the waste that a better solution may still have.  The incumbent at its start is
the complete solution of best fit decreasing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmill.llm.bpe import codec
from cellmill.llm.common import text_of, written
from cellmill.llm.splits import spread

Pattern = tuple[tuple[int, ...], int]


def best_fit(room: int, lengths: list[int], left: dict[int, int]) -> tuple[int, ...]:
    """The largest that fits, again and again.  lengths ascend."""
    out, used = [], Counter()
    while room > 0 and (i := bisect_right(lengths, room)):
        while i and left[lengths[i - 1]] - used[lengths[i - 1]] <= 0:
            i -= 1
        if not i:
            break
        take = lengths[i - 1]
        out.append(take)
        used[take] += 1
        room -= take
    return tuple(out)


def fillings(room: int, lengths: list[int], left: dict[int, int], most: int = 4, nodes: int = 4000, spent: list[int] | None = None) -> list[tuple[int, ...]]:
    """Undominated fillings of the room, least waste first, then fewest and largest pieces.

    A filling that leaves room for another available piece is dominated by the one with that piece; one whose waste
    allows exchanging a piece for a longer one is dominated by the exchange.  Branches that cannot beat the waste of the
    ``most``-th best so far are pruned, and of equal ones a few are held; after ``nodes`` branches the search keeps what it
    has.  spent, if given, counts branches over many calls.
    """
    found = {best_fit(room, lengths, left)}
    bound = room - sum(next(iter(found)))
    budget = [nodes]

    def extend(chosen: tuple[int, ...], room_left: int, top: int, used: Counter) -> None:
        nonlocal bound
        i = bisect_right(lengths, min(top, room_left)) - 1
        if len(chosen) >= 1 and (i < 0 or room_left <= bound) and (room_left < bound or len(found) < 4 * most):
            found.add(chosen)
            bound = min(bound, room_left) if len(found) >= most else bound
        while i >= 0 and budget[0] > 0:
            take = lengths[i]
            if left[take] - used[take] > 0:
                budget[0] -= 1
                used[take] += 1
                extend((*chosen, take), room_left - take, take, used)
                used[take] -= 1
                if room_left == take or (bound == 0 and len(found) >= most):
                    return
            i -= 1

    if bound or most > 1:
        extend((), room, room, Counter())
    if spent is not None:
        spent[0] += nodes - budget[0]

    def undominated(f: tuple[int, ...]) -> bool:
        waste, used = room - sum(f), Counter(f)
        if waste < 0:
            return False
        spare = lambda x: left[x] - used[x] > 0
        if any(spare(x) for x in lengths[: bisect_right(lengths, waste)]):
            return False
        return not any(spare(x) for own in used for x in lengths[bisect_right(lengths, own) : bisect_right(lengths, own + waste)])

    ordered = sorted(found, key=lambda f: (room - sum(f), len(f), [-x for x in f]))
    return list(islice(filter(undominated, ordered), most)) or ordered[:most]


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit of all pieces, longest first: each goes to the fullest sequence that has room for it.

    Sequences of equal content are one group, so that the work depends on the lengths, not on the pieces.
    """
    groups: dict[int, dict[tuple[int, ...], int]] = {}  # by the room that is left
    for x in sorted(histogram, reverse=True):
        n, room = histogram[x], x
        rooms = sorted(r for r in groups if r >= x)
        while n > 0:
            room = rooms.pop(0) if rooms else capacity
            most = room // x  # a sequence that took one is the fullest for the next
            here = groups.pop(room, {}) if room < capacity else {(): n}
            for content, times in here.items():
                full = min(n // most, times)
                last = n - full * most if full < times and n - full * most < most else 0
                n -= full * most + last
                for k, count in ((most, full), (last, 1 if last else 0), (0, times - full - (1 if last else 0))):
                    if count > 0 and (content or k):
                        at = groups.setdefault(room - k * x, {})
                        at[(*content, *[x] * k)] = at.get((*content, *[x] * k), 0) + count
    return [(content, times) for room in sorted(groups) for content, times in groups[room].items()]


def complete(histogram: dict[int, int], capacity: int, tries: int = 200, wide: int = 3, nodes: int = 1_000_000) -> list[Pattern]:
    """Patterns that use up the histogram in as few sequences as the search finds, at most those of best fit decreasing.

    A limited-discrepancy search: every level may take another than its closest filling (the best ``wide`` count);
    solutions with fewer such choices come first, and among them those that depart at the deepest level, since waste
    arises at the end.  tries: how many descents it makes beyond the first; it ends before when a solution meets the
    lower bound ceil(total / capacity), or when it has taken ``nodes`` branches and levels.  All of this depends on the
    number of lengths, at most the capacity, and not on the number of pieces.
    """
    whole = {k: v for k, v in histogram.items() if v > 0}
    if any(k > capacity or k <= 0 for k in whole):
        raise ValueError("lengths must be between 1 and the capacity")
    total = sum(k * v for k, v in whole.items())
    least = -(-total // capacity)
    best = best_fit_decreasing(whole, capacity)
    fewest = sum(times for _, times in best)

    spent = [0]

    def options(left: dict[int, int], lengths: list[int], most: int) -> list[tuple[int, ...]]:
        """lengths: those of which some are left, ascending."""
        top = lengths[-1]
        left[top] -= 1
        got = fillings(capacity - top, lengths if left[top] else lengths[:-1], left, most=most, spent=spent)
        left[top] += 1
        spent[0] += 1
        return [(top, *f) for f in got]

    def use(left: dict[int, int], lengths: list[int], pattern: tuple[int, ...]) -> Pattern:
        need = Counter(pattern)
        times = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del lengths[bisect_left(lengths, x)]
        return pattern, times

    def there(left: dict[int, int]) -> list[int]:
        return sorted(x for x, n in left.items() if n > 0)

    def descend(path: list[Pattern], left: dict[int, int]) -> None:
        """By closest fillings to a solution, which is kept if it is the best, or to where none can be better."""
        nonlocal best, fewest
        waste = sum((capacity - sum(p)) * times for p, times in path)
        lengths = there(left)
        while lengths:
            if waste > (fewest - 1) * capacity - total or spent[0] > nodes:
                return
            path.append(use(left, lengths, options(left, lengths, 1)[0]))
            waste += (capacity - sum(path[-1][0])) * path[-1][1]
        if (used := sum(times for _, times in path)) < fewest:
            best, fewest = list(path), used

    # (choices made, -level to depart at, number of the descent): each level of a descent below its own departure
    made: list[tuple[list[Pattern], dict[int, int], int]] = []
    waiting: list[tuple[int, int, int]] = []

    def follow(path: list[Pattern], left: dict[int, int], base: int, choices: int) -> None:
        descend(path, left)
        if len(path) > base:
            made.append((path, left, base))
            heappush(waiting, (choices, 1 - len(path), len(made) - 1))

    if fewest > least:
        follow([], dict(whole), 0, 1)
    while fewest > least and tries > 0 and waiting and spent[0] <= nodes:
        choices, level, number = heappop(waiting)
        path, rest, base = made[number]
        level = -level
        if level > base:
            heappush(waiting, (choices, 1 - level, number))
        left = dict(rest)
        for pattern, times in path[level:]:
            for x in pattern:
                left[x] += times
        for pattern in options(left, there(left), wide):
            if pattern != path[level][0] and tries > 0 and fewest > least:
                tries -= 1
                other = dict(left)
                follow([*path[:level], use(other, there(other), pattern)], other, level + 1, choices + 1)
    return best


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): the pieces of a length with these ranks lie at this offset of
    consecutive sequences."""
    out, sequence, used = [], 0, Counter()
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            out.append((x, used[x], used[x] + times, sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return out


def token_pieces(
    df: DataFrame,
    path: str,
    pattern: str,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    added: bool = True,
    ids: bool = False,
) -> DataFrame:
    """The pieces of each document: id_col, piece, start, length, ids_crc32, with ids also ids (binary: each a
    little-endian unsigned 32-bit integer), and the place of the row in its task (_part, _rank among the task's pieces of this length).

    A document that is longer than the capacity is cut from its end, so that all pieces but the first are full.  added:
    strings of the vocabulary's added tokens become their ids.  Null text counts as empty: the end id alone.  Ids may be
    null or repeat; an empty table has no pieces; a very long text is held as a whole with its ids.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part, seen = codec(path, pattern, added), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in rows:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                flat, edges = c.encode_batch(some.column(1).to_pylist(), end_id)
                n = np.diff(edges)
                pieces = (n - 1) // capacity + 1
                row = np.repeat(np.arange(len(n)), pieces)
                piece = spread(np.zeros(len(n), np.int64), pieces)
                first = n - (pieces - 1) * capacity
                start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[row])
                order = np.argsort(length, kind="stable")
                rank = np.empty(len(row), np.int64)
                kinds, counts = np.unique(length, return_counts=True)
                rank[order] = spread(seen[kinds], counts)
                seen[kinds] += counts
                begin = edges[row] + start
                raw = memoryview(flat.astype("<u4", copy=False).tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                columns = [some.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start), pa.array(length)]
                columns += [pa.array(crc, pa.int64()), *([pa.array([raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)], pa.binary())] if ids else [])]
                columns += [pa.array(np.full(len(row), part, np.int32)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * ids, "_part", "_rank"])

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long," + " ids binary," * ids + " _part int, _rank long"
    return df.select(F.col(id_col), text_of(df, text_col).alias("_text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = 2048, tries: int = 200) -> DataFrame:
    """Adds sequence_id and offset to pieces with columns length, _part and _rank (see token_pieces).

    pieces is written once: ranks count rows of a task, and must not be made anew when an executor is lost.
    The histogram has at most ``capacity`` rows and the list of places is of that order; both pass through the driver.
    The first rank of each length in each task grows with the number of tasks: it is joined by a shuffle, of which a
    reader holds its share as a hash table.  An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    counts = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    counts = written(counts, "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = places(complete(histogram, capacity, tries))
    where = spark.createDataFrame(plan, "_length long, _lo long, _hi long, _sequence long, offset long")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = pieces.join(bases.hint("shuffle_hash"), ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    found = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    placed = ranked.join(F.broadcast(where), found)  # as many rows as lengths and patterns, whatever the corpus
    return placed.withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_lo")).select(
        *[c for c in pieces.columns if not c.startswith("_")], "sequence_id", "offset"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary) of each sequence: the ids of its pieces in the order of their places.  packed must have the
    column ids (see token_pieces).  A sequence is at most the capacity long, whatever the corpus."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(pieces, F.lit(b""), lambda all_, x: F.concat(all_, x["ids"])).alias("ids"))
