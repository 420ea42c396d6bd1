"""Katz backoff language model of words, of any order: Good-Turing counts, exactly normalised backoff, evaluated
recursively token by token.

Documents are read once into chunks of some million tokens. Order by order a chunk asks for what it lacks: first the
corpus counts of its distinct words, by hash bucket, then those of its distinct word pairs, then triples, by bucket of
their contexts (all words but the last). Each bucket merges the chunks' own counts into its part of the model's tables
and answers every chunk in the order it asked, so that neither tokens nor documents travel, and a word or n-gram costs
at most an entry per chunk, however frequent. Contexts of more than `hot` occurrences spread over several buckets.

The model: P(w|h) = d(r) r / base(h) for an n-gram h w seen r > 0 times, else alpha(h) P(w|h') where h' is h without its
first word; P(w) = d(c) c / N for a known word; unknown words are one class that gets what the discounts leave. base(h)
is the count of h, and alpha(h) makes the probabilities after h sum to 1. A context without leftover mass (no follower
seen few times) gets one more pseudo occurrence. Every context of training takes part, those that occur once too; after
others, and where a document has fewer words before, P(w|h) = P(w|h'). Every document starts after, and ends with, the
end token.

A context that is in training once and nowhere else has one follower, which no other chunk can ask for: buckets say so
in their replies, and its n-grams, of this and of higher orders, are counted, scored and written by the chunk itself,
the last with the scores: they never travel.

The tables, written in the shared folder and kept, for each order: `grams` with the n-grams and their counts, `weights`
with the contexts, their bases and alphas, and `alone` with the n-grams of contexts that occur once in all. The first
two are partitioned by bucket, the last by chunk; numbers are compressed byte planes, which model_rows() spells out as
rows.

Defined results: null text is empty and scores its end token; documents of one id share their side of the split;
rows are scored one by one, repeated ones too; a null id counts as the text "" for the split; without training rows
every token is of the unknown class, probability 1; other columns are ignored. Words are told apart by 64-bit hashes
(for 10 million words, a chance of 3 in a million that any two are confused).
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, fresh_path, stash
from .tokenization import own_rows, release

#: Words of the longest n-grams, and training occurrences from which a context takes part: all that there are.
ORDER, LEAST_CONTEXT = 3, 1
#: Bytes of text in a chunk, and bytes of text a bucket of the model stands for.
CHUNK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 8_000_000, 8_000_000, 64
#: With it, a job's shuffle files go when the job ends; here every job's result is written, and the orders' add up else.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Counts up to this are discounted. Contexts beyond HOT occurrences are dealt over buckets; at most HOT_ROWS are so.
MOST_DISCOUNTED, HOT, HOT_ROWS = 5, 2_000_000, 50_000
END_HASH = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xFF51AFD7ED558CCD)


@cache
def _codec():
    """A process's compressor and decompressor; worker processes have one thread."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray, kind=np.uint64) -> bytes:
    """Numbers as compressed byte planes; of whole numbers, planes that are zero throughout are left out. The first byte
    says how many there are."""
    raw = np.ascontiguousarray(values, kind)
    if not len(raw):
        return b""
    width = raw.itemsize if raw.dtype.kind == "f" else max(1, -(-int(raw.max()).bit_length() // 8))
    return bytes([width]) + _codec()[0].compress(np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), -1)[:, :width].T))


def unpack(blob: bytes, kind=np.uint64) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    planes = np.frombuffer(_codec()[1].decompress(memoryview(blob)[1:], max_output_size=1 << 31), np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.reshape(-1).view(kind)


def rising(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def risen(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def pack_columns(columns: list[np.ndarray]) -> list[bytes]:
    """Columns of sorted rows: the first one rises, the others as they are."""
    return [rising(columns[0]), *map(pack, columns[1:])]


def unpack_columns(blobs: list[bytes]) -> list[np.ndarray]:
    return [risen(blobs[0]), *map(unpack, blobs[1:])]


def fused(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The columns in as few 64-bit numbers as hold them, in the same order of rows."""
    out, width = [], 65
    for c in columns:
        bits = int(c.max()).bit_length() if len(c) else 0
        if width + bits <= 64:
            out[-1] = (out[-1] << np.uint64(bits)) | c
            width += bits
        else:
            out.append(c)
            width = bits
    return out


def distinct_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct row stands, in sorted order of rows; each row's number among them)."""
    keys = fused(columns)
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def times(numbers: np.ndarray, n: int) -> np.ndarray:
    """How often 0 to n - 1 are among whole numbers."""
    return np.bincount(numbers, minlength=n)


def run_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def held_out(doc_id, modulus: int, remainder: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == remainder


def discounts(seen: np.ndarray) -> np.ndarray:
    """d(1) to d(k) from the numbers of items seen 1 to k + 1 times: Good-Turing where it gives 0 < d < 1 throughout,
    for the largest k that does; else Good-Turing on a line through the logarithms of what was seen, where it falls by a
    power over 1 (documents that occur twice leave no other, d(1) would be 1); else absolute discounting by
    n1 / (n1 + 2 n2), 1/2 where n1 is 0."""
    n = [float(x) for x in seen]
    for k in range(MOST_DISCOUNTED, 0, -1):
        if all(n[: k + 1]):
            over = (k + 1) * n[k] / n[0]
            d = [((r + 1) * n[r] / (r * n[r - 1]) - over) / (1 - over) if over != 1 else 1.0 for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return np.array(d + [1.0] * (MOST_DISCOUNTED - k))
    some = np.flatnonzero(seen > 0)
    if len(some) > 1 and n[0] and (slope := np.polyfit(np.log(some + 1), np.log(np.asarray(seen)[some]), 1)[0]) < -1:
        return (1 + 1 / np.arange(1, MOST_DISCOUNTED + 1)) ** (slope + 1)
    cut = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return np.array([(r - min(cut, 0.999)) / r for r in range(1, MOST_DISCOUNTED + 1)])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(r) r of counts r."""
    small = np.clip(counts, 1, MOST_DISCOUNTED).astype(int) - 1
    return np.where(counts <= MOST_DISCOUNTED, d[small], 1.0) * counts


class Unigrams:
    """P(w) by count, and what unknown words get."""

    def __init__(self, seen: np.ndarray, total: int):
        self.d, self.total = discounts(seen), total
        left = float((seen[:MOST_DISCOUNTED] * np.arange(1, MOST_DISCOUNTED + 1) * (1 - self.d)).sum())
        self.base = total if left > 0 or not total else total + 1
        self.unknown = (left if left > 0 else 1.0) / self.base if total else 1.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts.astype(float), self.d) / max(1, self.base), self.unknown)


#: Of a context: its followers seen 1 to k times, the occurrences of those seen more often, its followers' lower P in sum.
N_STATS = MOST_DISCOUNTED + 2


def backoff(stats: np.ndarray, counts: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base, alpha) of contexts from rows of statistics and their counts; 1 and 1 of a context that was not seen."""
    small = stats[:, :MOST_DISCOUNTED]
    left = (small * np.arange(1, MOST_DISCOUNTED + 1) * (1 - d)).sum(1)
    base = np.where(left > 0, counts, counts + 1)
    left = np.where(left > 0, left, 1.0)
    seen = counts > 0
    return np.where(seen, base, 1), np.where(seen, left / np.maximum(base, 1) / np.maximum(1 - stats[:, -1], 1e-300), 1.0)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct tokens, rising; a token's place among them; tokens per text), ends included."""
    import xxhash

    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    bounds = np.asarray(parts.offsets).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    distinct, index = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in distinct), np.uint64, len(distinct))
    real = np.fromiter(map(bool, distinct), bool, len(distinct))[index] if distinct else np.zeros(0, bool)
    counts = np.diff(np.concatenate([[0], np.cumsum(real)])[bounds - bounds[0]])
    hashes, back = np.unique(np.concatenate([hashes, [END_HASH]]), return_inverse=True)
    ends = np.cumsum(counts + 1) - 1
    tokens = np.full(int((counts + 1).sum()), back[-1], np.int64)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = back[index[real]]
    used = np.zeros(len(hashes), bool)
    used[tokens] = True
    return hashes[used], (np.cumsum(used) - 1)[tokens], counts + 1


def _read_chunks(documents: DataFrame, bits: int, modulus: int, remainder: int, chunk_bytes: int) -> DataFrame:
    """Of each chunk a row `own`, its documents and its tokens as places among its words, and rows `asks`, its words with
    their training counts, one for each bucket."""
    schema = "part string, chunk long, ids array<long>, lengths array<long>, tokens binary, bucket int, hashes binary, counts binary"

    def chunk_of(number: int, ids: list, texts: pa.Array):
        hashes, tokens, lengths = _words(texts)
        training = np.repeat([not held_out(i, modulus, remainder) for i in ids], lengths)
        counts = np.bincount(tokens[training], minlength=len(hashes))
        edges = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        asks = [{"part": "asks", "chunk": number, "bucket": b, "hashes": rising(hashes[a:e]), "counts": pack(counts[a:e], np.uint32)} for b, (a, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > a]
        row = {"part": "own", "chunk": number, "ids": ids, "lengths": lengths.tolist(), "tokens": pack(tokens, np.uint32)}
        return pa.RecordBatch.from_pylist([row, *asks], arrow)

    binary = pa.binary()
    arrow = pa.schema([("part", pa.string()), ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("tokens", binary), ("bucket", pa.int32()), ("hashes", binary), ("counts", binary)])

    def read(batches):
        number, ids, texts, size = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            column = batch.column("text")
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))
            at = 0
            while at < len(column):
                done = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, done + chunk_bytes - size, "right")))
                ids += batch.column("doc_id")[at:end].to_pylist()
                texts.append(own_rows(column, at, end))
                size, at = size + int(sizes[end - 1] - done), end
                if size >= chunk_bytes * 0.9 or at < len(column):
                    yield chunk_of(number, ids, pa.concat_arrays(texts))
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield chunk_of(number, ids, pa.concat_arrays(texts))
        release()

    bound_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(read, schema)


#: What a bucket says: its part of a table, or its reply to a chunk, as arrays of compressed numbers.
SAID = "part string, chunk long, bucket int, blobs array<binary>, stats array<double>"
SAID_ARROW = pa.schema([("part", pa.string()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("blobs", pa.list_(pa.binary())), ("stats", pa.list_(pa.float64()))])


def _times_seen(counts: np.ndarray) -> np.ndarray:
    return np.bincount(counts[(counts > 0) & (counts <= MOST_DISCOUNTED + 1)].astype(int) - 1, minlength=MOST_DISCOUNTED + 1).astype(float)


def _merge_words(bits: int):
    """One bucket of the word table (hashes, counts, ids; totals), and each chunk's (ids, counts) as asked.

    Ids are dealt by falling count, so that frequent words have small ones."""

    def merge(asked: pa.Table) -> pa.Table:
        bucket = asked["bucket"][0].as_py()
        asks = [risen(x.as_py()) for x in asked["hashes"]]
        hashes, back = np.unique(np.concatenate(asks), return_inverse=True)
        counts = np.zeros(len(hashes), np.int64)
        np.add.at(counts, back, np.concatenate([unpack(x.as_py(), np.uint32) for x in asked["counts"]]).astype(np.int64))
        order = np.lexsort((hashes, -counts))
        ids = np.empty(len(hashes), np.uint64)
        ids[order] = (np.arange(len(hashes), dtype=np.uint64) << np.uint64(bits)) + np.uint64(bucket)
        known = counts > 0
        rows = [{"part": "grams", "chunk": -1, "bucket": bucket, "blobs": [rising(hashes[known]), pack(ids[known]), pack(counts[known])], "stats": [float(counts.sum()), float(known.sum()), *_times_seen(counts)]}]
        at = 0
        for chunk, ask in zip(asked["chunk"].to_pylist(), asks, strict=True):
            mine = back[at : at + len(ask)]
            at += len(ask)
            rows.append({"part": "reply", "chunk": chunk, "bucket": bucket, "blobs": [pack(ids[mine]), pack(counts[mine])], "stats": None})
        return pa.Table.from_pylist(rows, SAID_ARROW)

    return merge


@dataclass
class _Level:
    """A chunk's distinct n-grams in the order asked: by bucket, then by key. `of` is each token's n-gram, -1 without one;
    `after` tells tokens after a context that occurs once in all, `alone` those whose own n-gram does."""

    of: np.ndarray
    after: np.ndarray
    keys: list[np.ndarray]
    own: np.ndarray
    often: np.ndarray
    context: np.ndarray
    below: np.ndarray
    edges: np.ndarray
    hot: np.ndarray
    seen: np.ndarray | None = None
    alone: np.ndarray | None = None
    base: np.ndarray | None = None
    alpha: np.ndarray | None = None


class _Chunk:
    """A chunk with what the buckets have told it: word ids and counts, then order by order its n-grams' counts.

    The n-gram of a token consists of it and the n - 1 tokens before; before a document's first token stands the end."""

    def __init__(self, row: dict, told: list[dict], buckets: int, hot: int, modulus: int, remainder: int):
        replies = sorted((r for r in told if r["part"] == "reply"), key=lambda r: r["bucket"])
        ids = np.concatenate([unpack(r["blobs"][0]) for r in replies])
        counts = np.concatenate([unpack(r["blobs"][1]) for r in replies]).astype(np.int64)
        # words are numbered in the order of their ids, so that rows of numbers sort as rows of ids do
        order = np.argsort(ids)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.ids, self.counts = ids[order], counts[order]
        self.tokens, self.lengths = number[unpack(row["tokens"], np.uint32)], np.array(row["lengths"])
        self.doc_ids, self.number, self.buckets, self.hot = row["ids"], row["chunk"], buckets, hot
        self.held = np.array([held_out(i, modulus, remainder) for i in row["ids"]])
        self.training = np.repeat(~self.held, self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.lengths)
        # each document's last token is the end, as is what stands before its first
        self.before = np.concatenate([[self.tokens[self.starts[0] + self.lengths[0] - 1]], self.tokens[:-1]])
        self.levels: list[_Level] = []

    def ask(self, order: int) -> _Level:
        """The distinct n-grams of an order (2 and up) after those of the order below are known."""
        after = np.zeros(len(self.tokens), bool)
        if order == 2:
            at, outer = np.arange(len(self.tokens)), self.before
            heads, count_of = [self.ids], self.counts
        else:
            last = self.levels[-1]
            at = np.flatnonzero(self.place >= order - 2)
            after[at] = last.alone[at - 1]
            at = at[(last.of[at - 1] >= 0) & ~after[at]]
            at = at[last.seen[last.of[at - 1]] >= LEAST_CONTEXT]
            outer = last.of[at - 1]
            heads, count_of = last.keys, last.seen
        mixed = np.zeros(len(count_of), np.uint64)
        for k in heads:
            mixed = (mixed ^ k) * MIX
            mixed ^= mixed >> np.uint64(33)
        mixed >>= np.uint64(8)
        deal = (1 + count_of // self.hot).astype(np.uint64)
        bucket = mixed[outer]
        if (deal > 1).any():
            bucket += (((self.ids * MIX) >> np.uint64(33))[self.tokens[at]]) % deal[outer]
        words = [*(self.before[at - k].astype(np.uint64) for k in range(order - 2, -1, -1)), self.tokens[at].astype(np.uint64)]
        first, back = distinct_rows([bucket % np.uint64(self.buckets), *words])
        spot, bucket = at[first], bucket[first] % np.uint64(self.buckets)
        own, often = times(back[self.training[at]], len(first)), times(back, len(first))
        below = self.counts[self.tokens[spot]] if order == 2 else last.seen[last.of[spot]]
        of = np.full(len(self.tokens), -1, np.int64)
        of[at] = back
        edges = np.searchsorted(bucket, np.arange(self.buckets + 1, dtype=np.uint64))
        outer = outer[first]
        return _Level(of, after, [self.ids[w[first]] for w in words], own, often, count_of[outer], below, edges, deal[outer] > 1)

    def hear(self, order: int, told: list[dict], hot: dict) -> None:
        """The order's counts, and the bases and alphas of contexts that need any."""
        level = self.ask(order)
        replies, weights = (sorted((r for r in told if r["part"] == f"{part}-{order}"), key=lambda r: r["bucket"]) for part in ("reply", "weight"))
        said = np.concatenate([unpack(r["blobs"][0], np.uint32) for r in replies] + [np.zeros(0, np.uint32)]).astype(np.int64)
        level.seen = said - (said > 1)
        level.alone, has = level.after.copy(), np.flatnonzero(level.of >= 0)
        level.alone[has] = ((said == 1) & (level.often == 1))[level.of[has]]
        level.base, level.alpha = level.context.astype(float), np.ones(len(level.seen))
        at = 0
        for r, size in zip(weights, np.diff(level.edges)[np.diff(level.edges) > 0].tolist(), strict=True):
            need = np.cumsum(unpack(r["blobs"][0], np.uint32), dtype=np.int64)
            level.base[at + need], level.alpha[at + need] = unpack(r["blobs"][1], np.float64), unpack(r["blobs"][2], np.float64)
            at += size
        if level.hot.any():  # a hot context's followers are in several buckets: its sums were put together
            at = np.flatnonzero(level.hot)
            contexts = [k[at] for k in level.keys[:-1]]
            first, back = distinct_rows(contexts)
            weights = np.array([hot[(order, *(int(k[i]) for k in contexts))] for i in first.tolist()])
            level.base[at], level.alpha[at] = weights[back].T
        self.levels.append(level)

    def probabilities(self, order: int, unigrams: Unigrams, d: dict) -> np.ndarray:
        """P of every token after the order - 1 tokens before it: what was seen is discounted, the rest backs off."""
        if order == 1:
            return unigrams.p(self.counts)[self.tokens]
        lower = self.probabilities(order - 1, unigrams, d)
        level = self.levels[order - 2]
        at = np.flatnonzero(level.of >= 0)
        gram = level.of[at]
        seen = level.seen[gram]
        out = lower.copy()
        out[at] = np.where(seen > 0, discounted(seen, d[order]) / np.maximum(level.base[gram], 1), level.alpha[gram] * lower[at])
        out[level.after] = d[order][0]
        return out

    def alone(self, order: int) -> list[bytes]:
        """The n-grams after contexts that occur once: word ids of the text they cover, which of them end an n-gram, and
        of each the count and the base that its probability after the shorter context has."""
        at, last = np.flatnonzero(self.levels[order - 2].after), self.levels[order - 3]
        # a token's words are those up to its place here, where the end stands before the first
        words = np.concatenate([self.before[:1], self.tokens])
        covered, ends = np.zeros(len(words), bool), np.zeros(len(words), bool)
        for k in range(order):
            covered[at + 1 - k] = True
        ends[at + 1] = True
        below, base = np.ones(len(at), np.int64), np.ones(len(at), np.int64)
        gram = last.of[at]
        asked = np.flatnonzero(gram >= 0)
        below[asked], base[asked] = last.seen[gram[asked]], last.base[gram[asked]]
        return [pack(self.ids[words[covered]]), pack(ends[covered], np.uint8), pack(below, np.uint32), pack(base)]


def _ask(order: int, split: tuple, hot_weights: dict):
    """A chunk's asks for an order, when it knows all orders below."""

    def ask(chunks: pa.Table, told: pa.Table) -> pa.Table:
        rows, answers = [], told.to_pylist()
        for row in chunks.to_pylist():
            chunk = _Chunk(row, answers, *split)
            for lower in range(2, order):
                chunk.hear(lower, answers, hot_weights)
            level = chunk.ask(order)
            # what the context of the lower order counts as, for the lower probability of what follows
            if level.after.any():
                rows.append({"bucket": -1 - (chunk.number ^ chunk.number >> 24) % chunk.buckets, "chunk": chunk.number, "blobs": [pack(level.after.sum(keepdims=True))]})
            base = chunk.levels[-1].base[chunk.levels[-1].of] if order > 2 and len(level.own) else None
            if base is not None:
                first = np.zeros(len(level.own), np.int64)
                has = np.flatnonzero(level.of >= 0)
                first[level.of[has]] = has
                base = base[first]
            for b, (a, e) in enumerate(zip(level.edges[:-1], level.edges[1:], strict=True)):
                if e > a:
                    below = np.where(level.own[a:e] > 0, level.below[a:e], 0)
                    # what is of a context is told once a context
                    each = a + run_starts([k[a:e] for k in level.keys[:-1]])
                    contexts = [*pack_columns([k[each] for k in level.keys[:-1]]), pack(np.diff(np.append(each, e)), np.uint32), pack(level.context[each]), pack(base[each].astype(np.uint64)) if order > 2 else b"", pack(level.hot[each], np.uint8)]
                    blobs = [*contexts, pack(level.keys[-1][a:e]), pack(level.own[a:e], np.uint32), pack(below)]
                    rows.append({"bucket": b, "chunk": row["chunk"], "blobs": blobs})
        return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("blobs", pa.list_(pa.binary()))]))

    return ask


def _merge(order: int, unigrams: Unigrams, lower_d: np.ndarray | None):
    """One bucket of an order's n-grams and counts, the statistics of its contexts, and each chunk's counts as asked."""

    def merge(asked: pa.Table) -> pa.Table:
        bucket = asked["bucket"][0].as_py()
        asks = [x.as_py() for x in asked["blobs"]]
        if bucket < 0:  # contexts that occur once: counted as their chunks have them
            once = float(sum(int(unpack(x[0])[0]) for x in asks))
            return pa.Table.from_pylist([{"part": "once", "chunk": -1, "bucket": bucket, "blobs": None, "stats": [once, *[0.0] * MOST_DISCOUNTED]}], SAID_ARROW)
        n = order - 1
        contexts = [np.concatenate(c) for c in zip(*(unpack_columns(x[:n]) for x in asks), strict=True)]
        followers, context, hot = (np.concatenate([unpack(x[n + i], kind) for x in asks]).astype(np.int64) for i, kind in ((0, np.uint32), (1, np.uint64), (3, np.uint8)))
        last = [unpack(x[n + 4]) for x in asks]
        own, below = (np.concatenate([unpack(x[n + i], kind) for x in asks]).astype(np.int64) for i, kind in ((5, np.uint32), (6, np.uint64)))
        first, of_context = distinct_rows(contexts)
        contexts, context, hot = [c[first] for c in contexts], context[first], hot[first].astype(bool)
        words = np.concatenate(last)
        of_gram = np.repeat(of_context, followers)
        heads, back = distinct_rows([of_gram.astype(np.uint64), words])
        group = of_gram[heads]
        keys = [*(c[group] for c in contexts), words[heads]]
        seen = np.bincount(back, own, len(heads)).astype(np.int64)
        lower = np.zeros(len(heads), np.int64)
        np.maximum.at(lower, back, below)
        known = seen > 0
        if order == 2:
            share = unigrams.p(lower)
        else:
            base = np.concatenate([unpack(x[n + 2]) for x in asks]).astype(float)[first]
            share = discounted(lower, lower_d) / np.maximum(base[group], 1)
        stats = np.zeros((len(first), N_STATS))
        capped = np.minimum(seen[known], MOST_DISCOUNTED + 1) - 1
        stats[:, :-1] = np.bincount(group[known] * (N_STATS - 1) + capped, np.where(seen[known] > MOST_DISCOUNTED, seen[known], 1), len(first) * (N_STATS - 1)).reshape(len(first), -1)
        stats[:, -1] = np.bincount(group[known], share[known], len(first))
        table = [*pack_columns([k[known] for k in keys]), pack(seen[known])]
        summed = [*pack_columns(contexts), pack(context), pack(hot, np.uint8), *(pack(stats[:, i], np.float64) for i in range(N_STATS))]
        rows = [{"part": "grams", "chunk": -1, "bucket": bucket, "blobs": table, "stats": _times_seen(seen).tolist()}, {"part": "contexts", "chunk": -1, "bucket": bucket, "blobs": summed, "stats": None}]
        for i in np.flatnonzero(hot).tolist():
            rows.append({"part": "hot", "chunk": -1, "bucket": bucket, "blobs": [np.array([*(c[i] for c in contexts), context[i]], np.uint64).tobytes()], "stats": stats[i].tolist()})
        # a context seen with a follower that was seen once leaves mass; without one, that depends on the discounts
        hot = hot[group]
        unsure = (stats[:, 0] == 0)[group] & ~hot
        # 1 says that an n-gram was seen once and asked for by one chunk; all other counts are told as one more
        said = seen + ((seen > 1) | ((seen == 1) & (times(back, len(heads)) > 1)))
        at = 0
        for chunk, part in zip(asked["chunk"].to_pylist(), last, strict=True):
            mine = back[at : at + len(part)]
            at += len(part)
            need = np.flatnonzero(((seen[mine] == 0) | unsure[mine]) & ~hot[mine])
            rows.append({"part": f"reply-{order}", "chunk": chunk, "bucket": bucket, "blobs": [pack(said[mine], np.uint32)], "stats": None})
            rows.append({"part": "need", "chunk": chunk, "bucket": bucket, "blobs": [pack(np.diff(need, prepend=0), np.uint32), pack(group[mine[need]], np.uint32)], "stats": None})
        return pa.Table.from_pylist(rows, SAID_ARROW)

    return merge


def _weigh(order: int, d: np.ndarray, hot_weights: dict):
    """From a bucket's contexts and what chunks need of them: the `weights` table's row, and the chunks' bases and alphas."""

    def weigh(said: pa.Table) -> pa.Table:
        rows = said.to_pylist()
        blobs = next(r["blobs"] for r in rows if r["part"] == "contexts")
        keys, n = unpack_columns(blobs[: order - 1]), order - 1
        count, hot = unpack(blobs[n]).astype(float), unpack(blobs[n + 1], np.uint8).astype(bool)
        stats = np.stack([unpack(x, np.float64) for x in blobs[n + 2 :]], 1)
        base, alpha = backoff(stats, count, d)
        for i in np.flatnonzero(hot).tolist():
            base[i], alpha[i] = hot_weights[(order, *(int(k[i]) for k in keys))]
        bucket = rows[0]["bucket"]
        out = [{"part": f"weights-{order}", "chunk": -1, "bucket": bucket, "blobs": [*blobs[: order - 1], pack(base, np.float64), pack(alpha, np.float64)], "stats": None}]
        for r in rows:
            if r["part"] == "need":
                need, at = r["blobs"]
                at = unpack(at, np.uint32).astype(np.int64)
                out.append({"part": f"weight-{order}", "chunk": r["chunk"], "bucket": bucket, "blobs": [need, pack(base[at], np.float64), pack(alpha[at], np.float64)], "stats": None})
        return pa.Table.from_pylist(out, SAID_ARROW)

    return weigh


#: What a chunk says at last: of its documents the scores, and of an order the n-grams after contexts that occur once.
SCORED = "part string, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, chunk long, blobs array<binary>"


def _score(split: tuple, orders: int, unigrams: Unigrams, types: int, d: dict, hot_weights: dict):
    names = pa.schema([("part", pa.string()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("chunk", pa.int64()), ("blobs", pa.list_(pa.binary()))])

    def score(chunks: pa.Table, told: pa.Table) -> pa.Table:
        out, answers = [], told.to_pylist()
        for row in chunks.to_pylist():
            c = _Chunk(row, answers, *split)
            for order in range(2, orders + 1):
                c.hear(order, answers, hot_weights)
            logs = np.log10(c.probabilities(orders, unigrams, d))
            words, starts, total = c.counts[c.tokens], c.starts, unigrams.total
            n, nulls = len(starts), lambda i: pa.nulls(len(starts), names.types[i])  # noqa: E731, B023
            out.append(pa.Table.from_arrays([pa.array(["scores"] * n), pa.array(row["ids"], pa.int64()), pa.array(c.held), pa.array(c.lengths), pa.array(np.add.reduceat((words > 0).astype(np.int64), starts)), pa.array(np.full(len(starts), total)), pa.array(np.add.reduceat(np.log10((words + 1) / (total + types + 1)), starts)), pa.array(np.add.reduceat(logs, starts)), nulls(8), nulls(9)], schema=names))
            alone = [{"part": f"alone-{order}", "chunk": c.number, "blobs": c.alone(order)} for order in range(3, orders + 1) if c.levels[order - 2].after.any()]
            out.append(pa.Table.from_pylist(alone, names))
        return pa.concat_tables(out) if out else names.empty_table()

    return score


@dataclass
class KatzModel:
    """`words` (bucket; hashes, ids, counts), and of each order from 2: `grams` (bucket; n-grams' word ids, counts),
    `weights` (bucket; contexts' word ids, bases, alphas) and `alone` (chunk; as _Chunk.alone has them), as written
    tables; discounts by order."""

    words: DataFrame
    grams: dict[int, DataFrame]
    weights: dict[int, DataFrame]
    alone: dict[int, DataFrame]
    discounts: dict[int, np.ndarray]


def model_rows(model: KatzModel, order: int) -> DataFrame:
    """(context array<long>, word, count, p, alpha) of an order's n-grams, one row each: p as the model has it, alpha that
    of the context."""
    d, n, below_d = model.discounts[order], order, model.discounts.get(order - 1)
    arrow = pa.schema([("context", pa.list_(pa.int64())), ("word", pa.int64()), ("count", pa.int64()), ("p", pa.float64()), ("alpha", pa.float64())])

    def spell_alone(batches):
        for batch in batches:
            for ids, ends, below, base in batch.column(0).to_pylist():
                ids, at = unpack(ids).tolist(), np.flatnonzero(unpack(ends, np.uint8))
                lower = discounted(unpack(below, np.uint32).astype(np.int64), below_d) / unpack(base)
                alpha = (1 - d[0]) / np.maximum(1 - lower, 1e-300)
                yield pa.RecordBatch.from_pylist([{"context": ids[i - n + 1 : i], "word": ids[i], "count": 1, "p": d[0], "alpha": a} for i, a in zip(at.tolist(), alpha.tolist(), strict=True)], arrow)

    def spell(grams: pa.Table, weights: pa.Table) -> pa.Table:
        held: dict = {}
        for r in weights.to_pylist():
            *keys, base, alpha = r["blobs"]
            for *k, b, a in zip(*(x.tolist() for x in unpack_columns(keys)), unpack(base, np.float64).tolist(), unpack(alpha, np.float64).tolist(), strict=True):
                held[tuple(k)] = (b, a)
        rows = []
        for r in grams.to_pylist():
            counts = unpack(r["blobs"][n]).astype(np.int64)
            for *k, w, c, x in zip(*(x.tolist() for x in unpack_columns(r["blobs"][:n])), counts.tolist(), discounted(counts, d).tolist(), strict=True):
                rows.append({"context": k, "word": w, "count": c, "p": x / held[tuple(k)][0], "alpha": held[tuple(k)][1]})
        return pa.Table.from_pylist(rows, arrow)

    schema = "context array<long>, word long, count long, p double, alpha double"
    asked = model.grams[order].groupBy("bucket").cogroup(model.weights[order].groupBy("bucket")).applyInArrow(spell, schema)
    return asked.unionByName(model.alone[order].select("blobs").mapInArrow(spell_alone, schema))


def train_and_score(documents: DataFrame, modulus: int = 7, remainder: int = 2, order: int = ORDER, hot: int = HOT, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, KatzModel]:
    """((doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document, the model).

    The model learns from documents whose crc32(doc_id as text) mod `modulus` is not `remainder`.
    """
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 1 << (-(-size // BUCKET_BYTES) - 1).bit_length() if size else 0)
    bits = buckets.bit_length() - 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"sheetweave_katz_{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        # bucketed by chunk, so that joins with replies move the replies alone; the files are in the shared folder
        _read_chunks(documents, bits, modulus, remainder, chunk_bytes).write.partitionBy("part").bucketBy(parts, "chunk").option("compression", "none").option("path", fresh_path(spark, "katz-chunks")).saveAsTable(name)
        chunks = spark.table(name)
        asks = chunks.where("part = 'asks'").select("bucket", "chunk", "hashes", "counts")
        words = stash(asks.groupBy("bucket").applyInArrow(_merge_words(bits), SAID), "katz-words", "part")
        total, types, *seen = _summed(words, MOST_DISCOUNTED + 3)
        unigrams = Unigrams(np.array(seen), int(total))
        hot = max(hot, int(total) // HOT_ROWS)
        discard(chunks, "part=asks")
        own = chunks.where("part = 'own'").select("chunk", "ids", "lengths", "tokens")
        split = (buckets, hot, modulus, remainder)
        told = words.where("part = 'reply'")
        model, hot_weights = KatzModel(words.where("part = 'grams'"), {}, {}, {}, {}), {}
        for n in range(2, order + 1):
            asked = own.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_ask(n, split, hot_weights), "bucket int, chunk long, blobs array<binary>")
            merged = stash(asked.groupBy("bucket").applyInArrow(_merge(n, unigrams, model.discounts.get(n - 1)), SAID), f"katz-merged-{n}", "part")
            model.discounts[n] = discounts(np.array(_summed(merged, MOST_DISCOUNTED + 1)))
            hot_weights = hot_weights | _hot(merged, n, model.discounts[n])
            weighed = stash(merged.where("part in ('contexts', 'need')").groupBy("bucket").applyInArrow(_weigh(n, model.discounts[n], hot_weights), SAID), f"katz-weights-{n}", "part")
            model.grams[n], model.weights[n] = merged.where("part = 'grams'"), weighed.where(f"part = 'weights-{n}'")
            discard(merged, "part=contexts", "part=need")
            told = told.unionByName(merged.where(f"part = 'reply-{n}'")).unionByName(weighed.where(f"part = 'weight-{n}'"))
        scored = own.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_score(split, order, unigrams, int(types), model.discounts, hot_weights), SCORED)
        written = stash(scored, "katz-scores", "part")
        result = written.where("part = 'scores'").drop("part", "chunk", "blobs")
        model.alone |= {n: written.where(f"part = 'alone-{n}'").select("chunk", "blobs") for n in range(2, order + 1)}
        discard(chunks)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.conf.set(CLEANUP, kept)
    return result, model


def _summed(said: DataFrame, n: int) -> list[float]:
    return [float(x or 0) for x in said.where("part in ('grams', 'once')").select(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(n))).first()]


def _hot(merged: DataFrame, order: int, d: np.ndarray) -> dict:
    """(base, alpha) of contexts that several buckets share, from their sums: HOT_ROWS at most."""
    sums = merged.where("part = 'hot'").groupBy(F.col("blobs")[0].alias("key")).agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(N_STATS)))
    out = {}
    for row in sums.collect():
        *key, count = np.frombuffer(bytes(row[0]), np.uint64).tolist()
        base, alpha = backoff(np.array([row[1:]]), np.array([float(count)]), d)
        out[(order, *key)] = (float(base[0]), float(alpha[0]))
    return out


def katz_scores(documents: DataFrame, **options) -> DataFrame:
    """The scores of train_and_score()."""
    return train_and_score(documents, **options)[0]
