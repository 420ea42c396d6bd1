"""Token-id store: raw ids in shards, and a minimal perfect hash index from document keys to their place in a shard.

A key is (doc_id, copy): rows of one id are copies 0, 1, ... in the order in which they are stored. A shard file
(numbers little-endian) holds, in this order:
  header   magic b"SWIDS002", then three 64-bit numbers: documents, ids, bytes per id (2 where the vocabulary fits,
           else 4)
  payload  the ids of all documents, in order of doc_id, nothing between
The index is dealt to files by a hash of the key, some INDEX_KEYS keys each. An index file holds:
  header   magic b"SWIDX002", then 64-bit numbers: keys, seed, levels
  levels   64-bit numbers: the words of each level
  words    64-bit words: the levels' bits one after another; a key has the bit of its own in the first level in which no
           other key of the file hashes to the same bit, so that each key has a bit and each bit one key
  ranks    32-bit numbers: bits set before each word
  slots    by the rank of a key's bit: a 64-bit fingerprint, shard, first id in the shard and number of ids
Looking a key up reads the header, a word and a rank for each level up to its own (1.6 on average), one slot, and the
range of its ids: a constant number of reads, whatever the size of the file. A stored fingerprint tells keys that are
not there.

Defined results: null text is empty and consists of the end id; documents are in order of doc_id (null first), equal
ids by their text's hash; repeated rows are stored as often as they stand; other columns are ignored; an empty table
gives no shards and an index without files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path, join_lookup, stash, with_rank

SHARD_MAGIC, INDEX_MAGIC = b"SWIDS002", b"SWIDX002"
#: Both headers: the magic and three numbers.
HEADER, HEADER_BYTES = "<8s3q", 32
SLOT = np.dtype([("print", "<u8"), ("shard", "<i8"), ("at", "<i8"), ("n", "<i8")])
#: Ids in a shard before a new one begins; keys of an index file; ids read at a time.
SHARD_IDS, INDEX_KEYS, READ_IDS = 2_000_000, 200_000, 1_000_000
#: Bits of a level for each key that is left, levels at most before another seed is tried.
SPARE, LEVELS = 2, 64
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(ids: np.ndarray, copies: np.ndarray, salt: int) -> np.ndarray:
    """64 well-spread bits of each key under a salt; copies count from 0, an id that is null has copies below 0."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    for more in (copies.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0)):
        x = (x ^ (x >> np.uint64(30))) * _C1
        x = (x ^ (x >> np.uint64(27))) * _C2
        x = x ^ (x >> np.uint64(31)) ^ more
    return x


def _bits(ids: np.ndarray, copies: np.ndarray, seed: int, level: int, words: int) -> np.ndarray:
    return (_mix(ids, copies, seed * LEVELS + level) % np.uint64(words * 64)).astype(np.int64)


def build_levels(ids: np.ndarray, copies: np.ndarray) -> tuple[int, list[np.ndarray], np.ndarray]:
    """(seed, words of each level, rank of each key): distinct keys get the ranks 0 to n - 1, each once.

    In a level every key that is left hashes to a bit; bits that one key hashes to are set and settle that key, the
    others stay empty and their keys go on to the next level.
    """
    for seed in range(1, 1_000):
        left, levels, spot = np.arange(len(ids)), [], np.zeros(len(ids), np.int64)
        before = 0
        while len(left) and len(levels) < LEVELS:
            words = -(-SPARE * len(left) // 64)
            at = _bits(ids[left], copies[left], seed, len(levels), words)
            alone = np.bincount(at, minlength=words * 64) == 1
            settled = alone[at]
            spot[left[settled]] = before + at[settled]
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left, before = left[~settled], before + words * 64
        if not len(left):
            return seed, levels, np.argsort(np.argsort(spot))
    raise ValueError("no perfect hash: are the keys distinct?")


def index_bytes(ids: np.ndarray, copies: np.ndarray, shard: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
    """An index file of distinct keys."""
    seed, levels, rank = build_levels(ids, copies)
    words = np.concatenate([*levels, np.zeros(0, "<u8")])
    set_ = np.bitwise_count(words).astype(np.int64)
    slots = np.zeros(len(ids), SLOT)
    slots["print"][rank] = _mix(ids, copies, -seed)
    slots["shard"][rank], slots["at"][rank], slots["n"][rank] = shard, at, n
    sizes = np.array([len(x) for x in levels], "<i8")
    return struct.pack(HEADER, INDEX_MAGIC, len(ids), seed, len(levels)) + sizes.tobytes() + words.tobytes() + (np.cumsum(set_) - set_).astype("<u4").tobytes() + slots.tobytes()


class Index:
    """An index file, of which only what a key needs is read: `read` gives the bytes (offset, length) of the file."""

    def __init__(self, read):
        self.read = read
        magic, self.keys, self.seed, n = struct.unpack(HEADER, read(0, HEADER_BYTES))
        if magic != INDEX_MAGIC:
            raise ValueError("not an index of token ids")
        self.sizes = np.frombuffer(read(HEADER_BYTES, 8 * n), "<i8")
        self.words = HEADER_BYTES + 8 * n
        self.ranks = self.words + 8 * int(self.sizes.sum())
        self.slots = self.ranks + 4 * int(self.sizes.sum())

    def find(self, doc_id: int, copy: int) -> tuple[int, int, int] | None:
        """(shard, first id, number of ids) of a key, None where it is not stored."""
        ids, copies = np.array([doc_id]), np.array([copy])
        before = 0
        for level, size in enumerate(self.sizes.tolist()):
            at = int(_bits(ids, copies, self.seed, level, size)[0])
            word = before + at // 64
            bits = int.from_bytes(self.read(self.words + 8 * word, 8), "little")
            if bits >> at % 64 & 1:
                rank = int.from_bytes(self.read(self.ranks + 4 * word, 4), "little") + (bits & ((1 << at % 64) - 1)).bit_count()
                slot = np.frombuffer(self.read(self.slots + SLOT.itemsize * rank, SLOT.itemsize), SLOT)[0]
                return (int(slot["shard"]), int(slot["at"]), int(slot["n"])) if slot["print"] == _mix(ids, copies, -self.seed)[0] else None
            before += size
        return None

    def find_all(self, ids: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """The slots of many keys at once; `n` is -1 where a key is not stored."""
        total = int(self.sizes.sum())
        words = np.frombuffer(self.read(self.words, 8 * total), "<u8")
        ranks = np.frombuffer(self.read(self.ranks, 4 * total), "<u4")
        slots = np.frombuffer(self.read(self.slots, SLOT.itemsize * self.keys), SLOT)
        out = np.zeros(len(ids), SLOT)
        out["n"] = -1
        left, before = np.arange(len(ids)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _bits(ids[left], copies[left], self.seed, level, size)
            word, bit = before + at // 64, (at % 64).astype(np.uint64)
            hit = (words[word] >> bit & np.uint64(1)).astype(bool)
            rank = ranks[word[hit]] + np.bitwise_count(words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            found, mine = slots[rank], left[hit]
            same = found["print"] == _mix(ids[mine], copies[mine], -self.seed)
            out[mine[same]] = found[same]
            left, before = left[~hit], before + size
        return out


def _open(path: str):
    """(file system, path) of a URI on any store pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI: a path without a scheme is meant as Spark means it, on its default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri


@dataclass
class TokenStore:
    """`shards` (shard, path, start, documents, ids): start counts the ids of all shards before. `index` (bucket, path).
    Both are written tables of n_shards and n_buckets rows."""

    shards: DataFrame
    index: DataFrame
    n_shards: int
    n_buckets: int

    def document(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        """The ids of one document by a constant number of reads, None where its key is not stored."""
        key, own = (0, -1 - copy) if doc_id is None else (doc_id, copy)
        row = self.index.where(F.col("bucket") == _bucket(F.lit(key).cast("long"), F.lit(own).cast("long"), self.n_buckets)).first() if self.n_buckets else None
        if row is None:
            return None
        with _reader(row["path"]) as file:
            place = Index(lambda at, n: file.read_at(n, at)).find(key, own)
        if place is None:
            return None
        shard, at, n = place
        with _reader(self.shards.where(F.col("shard") == shard).first()["path"]) as file:
            width = _id_bytes(file)
            return np.frombuffer(file.read_at(n * width, HEADER_BYTES + at * width), f"<u{width}")


def _reader(path: str):
    system, own = _open(path)
    return system.open_input_file(own)


def _id_bytes(file) -> int:
    magic, _, _, width = struct.unpack(HEADER, file.read_at(HEADER_BYTES, 0))
    if magic != SHARD_MAGIC:
        raise ValueError("not a shard of token ids")
    return width


def _bucket(doc_id, copy, n: int):
    return F.pmod(F.xxhash64(doc_id, copy), F.lit(max(n, 1)).cast("long"))


def write_shards(documents: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """(doc_id, part, shard, path, place, at, n) of every document, a written table: encode every text, append the end
    id, write shards of the partitions of a range of doc_ids.

    Tasks write under names of their own attempt and only committed tasks' names reach the table, so a lost executor's
    files are never read.
    """

    def write(batches):
        from .tokenization import BatchEncoder

        encoder = BatchEncoder(tokenizer, spaced=True)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        part, number, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex[:12]
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        keys, counts, tokens, held = [], [], [], 0

        def flush():
            path = f"{folder}/shard-{part:06d}-{number:06d}-{attempt}.ids"
            flat, n, ids = np.concatenate(tokens), np.concatenate(counts), pa.concat_arrays(keys)
            with system.open_output_stream(_open(path)[1]) as out:
                out.write(struct.pack(HEADER, SHARD_MAGIC, len(n), len(flat), width))
                out.write(flat.astype(f"<u{width}"))
            same = lambda value, kind: pa.array(np.full(len(n), value), kind)
            columns = [ids, same(part, pa.int64()), same((part << 24) + number, pa.int64()), pa.array([path] * len(n), pa.string()), pa.array(np.arange(len(n))), pa.array(np.cumsum(n) - n), pa.array(n)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "shard", "path", "place", "at", "n"])

        for batch in batches:
            for first, last, flat, per in encoder.slices(batch.column("text")):
                ends = np.cumsum(per + 1)
                with_end = np.full(len(flat) + len(per), end_id, flat.dtype)
                inner = np.ones(len(with_end), bool)
                inner[ends - 1] = False
                with_end[inner] = flat
                keys.append(batch.column("doc_id")[first:last])
                counts.append((per + 1).astype(np.int64))
                tokens.append(with_end)
                held += len(with_end)
                if held >= SHARD_IDS:
                    yield flush()
                    number, keys, counts, tokens, held = number + 1, [], [], [], 0
        if keys:
            yield flush()
        encoder.close()

    bound_batches(documents.sparkSession)
    order = ["doc_id", "tie"]
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    sorted_ = texts.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return stash(sorted_.mapInArrow(write, "doc_id long, part long, shard long, path string, place long, at long, n long"), "token-entries")


def shard_table(entries: DataFrame) -> DataFrame:
    """(shard, path, start, documents, ids): start is the sum over earlier shards of the partition, and over earlier
    partitions, of which the driver holds one number each."""
    shards = stash(entries.groupBy("part", "shard").agg(F.first("path").alias("path"), F.count("*").alias("documents"), F.sum("n").alias("ids")), "token-shards")
    offsets, total = [], 0
    for row in shards.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect():  # a row for each partition
        offsets.append((row["part"], total))
        total += row["ids"]
    before = entries.sparkSession.createDataFrame(offsets or [(0, 0)], "part long, before long")
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("ids")
    return stash(shards.withColumn("inside", inside).join(F.broadcast(before), "part").select("shard", "path", (F.col("before") + F.col("inside")).alias("start"), "documents", "ids"), "token-manifest")


def keyed(rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, copy, ...) with the key's two numbers: a null id is 0 with copies below 0."""
    none = F.col("doc_id").isNull()
    return rows.withColumn("key", F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn("own", F.when(none, -1 - F.col("copy")).otherwise(F.col("copy")).cast("long"))


def write_index(entries: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """((bucket, path) of the index files, a written table; how many)."""
    several = stash(entries.groupBy("doc_id").agg(F.count("*").alias("copies")).where("copies > 1").select(F.col("doc_id").alias("id")), "token-several")
    same = entries.doc_id.eqNullSafe(several.id)
    rows = entries.select("doc_id", "shard", "place", "at", "n")
    if several.isEmpty():
        numbered = rows.withColumn("copy", F.lit(0).cast("long"))
    else:
        numbered = rows.join(several, same, "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(with_rank(rows.join(several, same, "left_semi"), ["shard", "place"], "token-copies", "copy", ["doc_id"]))
    n = -(-entries.count() // INDEX_KEYS)
    dealt = keyed(numbered).select(_bucket(F.col("key"), F.col("own"), n).alias("bucket"), "key", "own", "shard", "at", "n")

    def write(batches):
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        attempt = uuid.uuid4().hex[:12]

        def flush(bucket, parts):
            ids, copies, shard, at, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            path = f"{folder}/index-{bucket:08d}-{attempt}.mph"
            with system.open_output_stream(_open(path)[1]) as out:
                out.write(index_bytes(ids, copies, shard, at, count))
            return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "path": pa.array([path], pa.string())})

        for bucket, parts in runs(batches, "bucket", ("key", "own", "shard", "at", "n")):
            yield flush(bucket, parts)

    files = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(write, "bucket long, path string")
    return stash(files, "token-index"), n


def runs(batches, key: str, columns: tuple):
    """(key, parts) of sorted batches: the columns' arrays of all rows of a key, part by part."""
    held, parts = None, []
    for batch in batches:
        keys = np.asarray(batch.column(key))
        if not len(keys):
            continue
        arrays = [np.asarray(batch.column(c)) for c in columns]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if held is not None and held != keys[a]:
                yield held, parts
                parts = []
            held = int(keys[a])
            parts.append([x[a:b].copy() for x in arrays])
    if held is not None:
        yield held, parts


def write_store(documents: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> TokenStore:
    spark = documents.sparkSession
    folder = qualified(spark, folder or fresh_path(spark, "token-store"))
    entries = write_shards(documents, tokenizer, end_id, folder)
    shards = shard_table(entries)
    index, n = write_index(entries, folder)
    return TokenStore(shards, index, shards.count(), n)


def keys_of(documents: DataFrame) -> DataFrame:
    """(doc_id, copy) of all rows of documents."""
    counted = documents.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))


def look_up(store: TokenStore, keys: DataFrame) -> DataFrame:
    """(doc_id, copy, shard, at, n) of keys (doc_id, copy) by the index; n is -1 where a key is not stored."""
    dealt = keyed(keys.select("doc_id", "copy")).withColumn("bucket", _bucket(F.col("key"), F.col("own"), store.n_buckets)).repartition("bucket")
    placed = join_lookup(dealt, store.index, "bucket", store.n_buckets).sortWithinPartitions("bucket")

    def find(batches):
        held, index = None, None
        for batch in batches:
            buckets, paths = np.asarray(batch.column("bucket")), batch.column("path")
            ids, copies = np.asarray(batch.column("key")), np.asarray(batch.column("own"))
            starts = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)]]) if len(buckets) else [0]
            out = [np.zeros(0, SLOT)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if held != buckets[a]:
                    held, path = buckets[a], paths[int(a)].as_py()
                    with _reader(path) as file:
                        data = file.read_at(file.size(), 0)
                    index = Index(lambda at, n, data=data: data[at : at + n])
                out.append(index.find_all(ids[a:b], copies[a:b]))
            slots = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), *(pa.array(np.ascontiguousarray(slots[c])) for c in ("shard", "at", "n"))], ["doc_id", "copy", "shard", "at", "n"])

    return placed.select("doc_id", "copy", "bucket", "key", "own", "path").mapInArrow(find, "doc_id long, copy long, shard long, at long, n long")


def read_documents(store: TokenStore, keys: DataFrame) -> DataFrame:
    """(doc_id, copy, start, n_tokens, ids_crc32) of the stored documents of keys (doc_id, copy): found by the index, their
    ids read from the ranges it gives. Keys that are not stored have no row."""
    found = look_up(store, keys).where("n >= 0").repartition("shard")
    placed = join_lookup(found, store.shards.select("shard", "path", "start"), "shard", store.n_shards, "inner").sortWithinPartitions("shard", "at")

    def read(batches):
        path, file, width = None, None, 0
        try:
            for batch in batches:
                paths, at, n = batch.column("path").to_pylist(), np.asarray(batch.column("at")), np.asarray(batch.column("n"))
                crc, i = np.zeros(len(at), np.int64), 0
                while i < len(at):
                    if paths[i] != path:
                        if file is not None:
                            file.close()
                        path, file = paths[i], _reader(paths[i])
                        width = _id_bytes(file)
                    # documents that lie one after another are read at once
                    j = i + 1
                    while j < len(at) and paths[j] == path and at[j] <= at[j - 1] + n[j - 1] and at[j] + n[j] - at[i] <= READ_IDS:
                        j += 1
                    data = file.read_at(int(at[j - 1] + n[j - 1] - at[i]) * width, HEADER_BYTES + int(at[i]) * width)
                    ids = np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()
                    for k in range(i, j):
                        a = 4 * int(at[k] - at[i])
                        crc[k] = zlib.crc32(ids[a : a + 4 * int(n[k])])
                    i = j
                start = np.asarray(batch.column("start")) + at
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(start), batch.column("n"), pa.array(crc)], ["doc_id", "copy", "start", "n_tokens", "ids_crc32"])
        finally:
            if file is not None:
                file.close()

    return placed.select("doc_id", "copy", "path", "start", "at", "n").mapInArrow(read, "doc_id long, copy long, start long, n_tokens long, ids_crc32 long")
