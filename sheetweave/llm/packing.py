"""Best-fit packing of token sequences by linear grouping.

Only lengths decide where a document can go, and there are no more lengths than tokens in a sequence. So the plan is
made on counts of lengths: large lengths are sorted into groups of equal cardinality and rounded up to their group's
largest; a linear programme over configurations of these few sizes, solved by column generation, says how many
sequences of each configuration to fill; actual lengths are put in the places of their group; what rounding down the
solution leaves over, and then the small lengths, go where they fit best. Documents then take the planned places by
their number among all documents of their length, which tasks count for themselves and add up: no task sees a
length's documents together.

Defined results: null text is empty, one piece of the end id; rows of one id are packed one by one; other columns are
ignored; an empty table gives no rows. A document of several sequences' length fills whole sequences with all pieces
but the last.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stash

#: Large lengths are over this part of a sequence; groups they form at most; rounds of column generation at most.
SMALL, GROUPS, ROUNDS = 1 / 8, 64, 1_000


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes within the capacity of the largest value: how many of each."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    smallest = int(sizes.min())
    for room in range(smallest, capacity + 1):
        fits = sizes <= room
        gains = np.where(fits, best[np.maximum(room - sizes, 0)] + values, 0.0)
        k = int(gains.argmax())
        if gains[k] > best[room - 1]:
            best[room], choice[room] = gains[k], k
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room >= smallest:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """A basic solution of: least sequences that hold `demand` items of each size. Revised simplex from one-size configurations."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse, amounts = np.diag(1 / basis.diagonal()), demand / basis.diagonal()
    for _ in range(ROUNDS):
        prices = inverse.sum(0)
        column = _best_configuration(sizes, prices, capacity)
        if prices @ column <= 1 + 1e-7:
            break
        change = inverse @ column
        ratio = np.where(change > 1e-9, amounts / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        amounts = amounts - ratio[out] * change
        amounts[out] = ratio[out]
        amounts = np.maximum(amounts, 0)
        basis[:, out] = column
        row = inverse[out] / change[out]
        inverse = inverse - np.outer(change, row)
        inverse[out] = row
    return [(basis[:, j].astype(np.int64), float(amounts[j])) for j in range(n)]


class Sequences:
    """Sequences not yet closed: how many hold the same lengths, by the room they leave."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room = capacity, defaultdict(list)
        self.rooms = np.zeros(capacity + 1, bool)

    def add(self, content: tuple[int, ...], number: int) -> None:
        if number:
            room = self.capacity - sum(content)
            self.by_room[room].append((content, number))
            self.rooms[room] = True

    def place(self, length: int, number: int) -> None:
        """Each item into the sequence with the least room that holds it, or a new one."""
        while number:
            fitting = np.flatnonzero(self.rooms[length:])
            if len(fitting):
                room = length + int(fitting[0])
                content, have = self.by_room[room].pop()
                self.rooms[room] = bool(self.by_room[room])
            else:
                room, content, have = self.capacity, (), number
            each = room // length  # best fit goes on with the sequence it has just used while the next item fits
            full, rest = divmod(number, each)
            full = min(full, have)
            self.add(content + (length,) * each, full)
            number -= full * each
            if full < have and content:
                self.add(content, have - full - (number > 0))
                if number:
                    self.add(content + (length,) * number, 1)
                    number = 0
            elif number and not content:
                self.add((length,) * number, 1)
                number = 0

    def all(self):
        return [entry for room in sorted(self.by_room) for entry in self.by_room[room]]


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences): every length as often as counted."""
    sequences = Sequences(capacity)
    left = {x: c for x, c in sorted(counts.items(), reverse=True) if c}
    sequences.add((capacity,), left.pop(capacity, 0))
    large = [(x, c) for x, c in left.items() if x > capacity * SMALL]
    total = sum(c for _, c in large)
    if total:
        # groups of equal cardinality, a length split between two where need be
        cells: list[list[list[int]]] = [[]]
        size, room = -(-total // groups), -(-total // groups)
        for x, c in large:
            while c:
                take = min(c, room)
                cells[-1].append([x, take])
                c, room = c - take, room - take
                if not room:
                    cells.append([])
                    room = size
        cells = [g for g in cells if g]
        # neighbours rounded to the same length are one size
        merged: list[list[list[int]]] = []
        for g in cells:
            if merged and merged[-1][0][0] == g[0][0]:
                merged[-1] += g
            else:
                merged.append(g)
        tops = np.array([g[0][0] for g in merged])
        wanted = np.array([sum(c for _, c in g) for g in merged], float)
        for config, amount in sorted(configurations(tops, wanted, capacity), key=lambda p: (-p[1], p[0].tolist())):
            number = int(amount + 1e-6)
            places = [k for k in range(len(tops)) for _ in range(config[k])]
            number = min([number, *(sum(c for _, c in merged[k]) // int(config[k]) for k in set(places))]) if places else 0
            if not number:
                continue
            runs = [_take(merged[k], number) for k in places]
            at = 0
            while at < number:  # sequences whose places all hold the same lengths
                step = min(r[0][1] for r in runs)
                sequences.add(tuple(r[0][0] for r in runs), step)
                for r in runs:
                    r[0][1] -= step
                    if not r[0][1]:
                        r.pop(0)
                at += step
        rest: dict[int, int] = defaultdict(int)
        for g in merged:
            for x, c in g:
                rest[x] += c
        for x in sorted(rest, reverse=True):
            sequences.place(x, rest[x])
    for x, c in left.items():
        if x <= capacity * SMALL:
            sequences.place(x, c)
    return sequences.all()


def _take(group: list[list[int]], number: int) -> list[list[int]]:
    """The group's first `number` items as runs of (length, count), taken out of it."""
    taken = []
    while number:
        x, c = group[0]
        use = min(c, number)
        taken.append([x, use])
        number -= use
        if use == c:
            group.pop(0)
        else:
            group[0][1] -= use
    return taken


def places(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Runs (length, first number, how many, first sequence, offset), sorted: an item's number among its length gives its place."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for content, number in planned:
        offset = 0
        for length in sorted(content, reverse=True):
            rows.append((length, used[length], number, sequence, offset))
            used[length] += number
            offset += length
        sequence += number
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def tokenize(documents: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, number): number counts the pieces of a length within the part. A stashed table."""

    def cut(batches):
        from .tokenization import BatchEncoder

        encoder, part, seen = BatchEncoder(tokenizer, spaced=False), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys = batch.column("doc_id")
            for first, last, flat, per in encoder.slices(batch.column("text")):
                row, piece, start, length, crc = [], [], [], [], []
                at = 0
                for i, n in enumerate(per.tolist()):
                    ids = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for k in range(0, n + 1, capacity):
                        own = ids[k : k + capacity]
                        row.append(first + i)
                        piece.append(k // capacity)
                        start.append(k)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                number = []
                for n in length:
                    number.append(int(seen[n]))
                    seen[n] += 1
                yield pa.RecordBatch.from_pydict({"doc_id": keys.take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array([part] * len(row), pa.int32()), "number": pa.array(number, pa.int64())})
        encoder.close()

    bound_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stash(texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"), "pack-pieces")


def pack(documents: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    spark = documents.sparkSession
    pieces = tokenize(documents, tokenizer, capacity, end_id)
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part")  # a row for each part
    before = stash(counted.withColumn("before", F.sum("n").over(earlier) - F.col("n")), "pack-counts")
    totals = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    runs = places(plan(totals, capacity))
    sent = spark.sparkContext.broadcast(runs)  # bounded by lengths and groups, whatever the corpus

    def settle(batches):
        table = sent.value
        keys = (table[:, 0] << 44) | table[:, 1]
        for batch in batches:
            length, number = np.asarray(batch.column("length")), np.asarray(batch.column("number")) + np.asarray(batch.column("before"))
            at = np.searchsorted(keys, (length << 44) | number, "right") - 1
            batch = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(table[at, 3] + number - table[at, 1]), pa.array(table[at, 4])], [*batch.schema.names, "sequence_id", "offset"])

    placed = pieces.join(before.select("part", "length", "before"), ["part", "length"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "number", "before").mapInArrow(settle, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
