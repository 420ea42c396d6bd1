"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints at 3 or fewer differing bits have a 32-bit half in which they differ by 1 bit at most, half the radius:
one's half lies within the ball of radius 1 around the other's. So every distinct fingerprint emits each half and its
32 one-bit variants; the shuffle on variants brings such pairs together, where the distance over all 64 bits is
verified. A bucket of variants never emits its pairs: it emits the links of a spanning forest, found by growing
components from unreached members, and beyond BUCKET members it is first divided by equal bytes of the other half.

Defined results: lower-cased A-Z; words and shingles as given by the parameters, repeats included; fewer words than a
shingle are one shingle; no word, or null text, is fingerprint 0, linked like any other; repeated rows and ids get the
same component; null ids never name a component (null where all its ids are); other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import BROADCAST_NUMBERS, bound_batches, join_lookup, number_rows, own_columns, stash, texts_of, without_rows

#: Differing bits up to which fingerprints link, and members from which a bucket is divided further.
RADIUS, BUCKET = 3, 4096
#: Shingles turned to bits at a time.
SLICE = 200_000


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """64 bits: each set where over half the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for a in range(0, n, SLICE):
        part = words[a : min(n, a + SLICE) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        hashes = np.fromiter((xxh64_intdigest(g, seed) for g in grams), np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def hashed(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(found.view(np.int64))})

    bound_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(hashed, "doc_id long, fp long")


def forest(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what is connected by distances up to the radius: grown from each member to all unreached ones."""
    left, links = np.arange(1, len(prints)), []
    frontier = [0] if len(prints) else []
    while frontier:
        node = frontier.pop()
        near = np.bitwise_count(prints[left] ^ prints[node]) <= radius
        reached = left[near]
        links += [(node, int(x)) for x in reached]
        frontier += reached.tolist()
        left = left[~near]
        if not frontier and len(left):
            frontier, left = [int(left[0])], left[1:]
    return links


def bucket_links(prints: np.ndarray, own: np.ndarray, radius: int = RADIUS, limit: int = BUCKET, byte: int = 0) -> list[tuple[int, int]]:
    """Links among a bucket's distinct fingerprints; `own` marks those whose own half is the bucket's.

    A larger bucket is divided by each byte: fingerprints within the radius agree in one of any radius + 1 bytes, so
    dividing by the eight bytes in turn keeps every link, and divided buckets are divided again while that helps.
    """
    if not own.any() or len(prints) < 2:
        return []
    if len(prints) <= limit or byte > 3:
        return forest(prints, radius)
    links: list[tuple[int, int]] = []
    view = prints.view(np.uint8).reshape(-1, 8)
    for column in _free_bytes(view):
        order = np.argsort(view[:, column], kind="stable")
        cuts = np.flatnonzero(np.diff(view[order, column])) + 1
        for members in np.split(order, cuts):
            if len(members) == len(prints):  # this byte says nothing
                return forest(prints, radius)
            links += [(int(members[a]), int(members[b])) for a, b in bucket_links(prints[members], own[members], radius, limit, byte + 1)]
    return links


def _free_bytes(view: np.ndarray) -> list[int]:
    """The four bytes that differ most: within the radius two fingerprints agree in one of any four bytes."""
    varied = [-(len(np.unique(view[:, c]))) for c in range(8)]
    return sorted(sorted(range(8), key=lambda c: (varied[c], c))[:4])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) fingerprints within the radius, enough of them to connect all that are connected."""
    if radius > 3:
        raise ValueError("halves with one-bit variants reach 3 differing bits")
    half = lambda side: F.shiftrightunsigned("fp", 32) if side else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))

    def ball(side):
        variants = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i).bitwiseXOR(half(side)))
        keys = F.concat(F.array(half(side)), variants)
        return F.transform(keys, lambda k: k + (F.lit(side).cast("long") * (1 << 32)))

    emitted = distinct.select("fp", F.explode(F.concat(ball(0), ball(1))).alias("variant"))
    dealt = emitted.repartition("variant").sortWithinPartitions("variant")

    def collide(batches):
        key, held = None, []

        def solve(variant, prints):
            prints = np.unique(prints)
            side = variant >> 32
            halves = (prints >> np.uint64(32)) if side else prints & np.uint64(0xFFFFFFFF)
            found = bucket_links(prints, halves == np.uint64(variant & 0xFFFFFFFF), radius)
            if found:
                a, b = np.array(found).T
                yield prints[a], prints[b]

        def linked(found):
            return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate([x for x, _ in found]).view(np.int64)), "b": pa.array(np.concatenate([y for _, y in found]).view(np.int64))})

        for batch in batches:
            keys, prints = np.asarray(batch.column("variant")), np.asarray(batch.column("fp")).view(np.uint64)
            if len(keys) == 0:
                continue
            starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            found = []
            for i, (start, end) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                # a run of equal variants may come from the batch before or go on in the next one
                if i == 0 and key == keys[0]:
                    held.append(prints[:end].copy())
                else:
                    if i < 2 and key is not None and sum(map(len, held)) > 1:
                        found += solve(key, np.concatenate(held))
                    key, held = int(keys[start]), None
                    if end == len(keys):
                        held = [prints[start:end].copy()]
                    elif end - start > 1:
                        found += solve(key, prints[start:end])
                if i == 0 and held is not None and len(starts) > 2:
                    found += solve(key, np.concatenate(held)) if sum(map(len, held)) > 1 else []
                    key, held = None, []
                held = held or []
            if found:
                yield linked(found)
        if held and (found := [*solve(key, np.concatenate(held))]):
            yield linked(found)

    return dealt.mapInArrow(collide, "a long, b long").distinct()


def near_groups(documents: DataFrame, shingle: int = 5, radius: int = RADIUS, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id reachable over links."""
    prints = stash(fingerprints(documents, shingle, seed), "simhash-prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(distinct.select("fp"), radius), lambda df: stash(df, "simhash-components"))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stash(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-named")
    component = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(component, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by similarity: candidates by the same balls, beyond their reach by shared shingles and fingerprints of
# 128 bits; shingles decide


#: Bits of a wide fingerprint.
WIDE = 128
#: One in so many texts tells which shingles are common; common shingles known at most; texts with a shingle, by this
#: sample, from which all of them are candidates together.
SAMPLED, COMMON, HOT_KEY = 16, 500_000, 4_096
#: Members up to which a bucket's pairs are compared at once; larger ones grow a forest.
SMALL_RUN = 8
#: Rows, and shingles of them, that a task verifies together.
CELL_ROWS, CELL_SHINGLES = 4_096, 20_000_000
#: Links a task holds before it joins them.
MOST_LINKS = 1_000_000


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 of the text's shingles, repeats included; a lone 0 without a word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
    return np.fromiter((xxh64_intdigest(g, 42) for g in grams), np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct XXH64 of the text's shingles; a lone 0 without a word."""
    return np.unique(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """fingerprint() of shingles that are hashed already."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), SLICE):
        total += np.unpackbits(hashes[a : a + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def prefix(grams: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a sorted set of which sets of this Jaccard similarity share one: all but as many as they must
    share, and one. Any order that holds for all sets will do; here the rarest come first, so that few sets meet.
    `common` are the sorted shingles known to be common, `counts` how common."""
    length = len(grams) - int(np.ceil(similarity * len(grams) - 1e-9)) + 1
    if len(common) == 0:
        return grams[:length]
    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
    return grams[np.argsort(np.where(common[at] == grams, counts[at], 0), kind="stable")[:length]]


def common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts), sorted, of the shingles most common in a sample of the texts, COMMON at most."""

    def grams(batches):
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["gram"])

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text")
    counted = sample.mapInArrow(grams, "gram long").groupBy("gram").count().where("count > 2").orderBy(F.desc("count"), "gram").limit(COMMON).toArrow()
    found, counts = np.asarray(counted["gram"]).view(np.uint64), np.asarray(counted["count"])
    order = np.argsort(found)
    return found[order], counts[order]


def wide_fingerprint(text: str | None, shingle: int) -> tuple[int, int]:
    """128 bits: majority of the distinct shingles' XXH64 and of a second hash made from it. Repeated lines count once,
    and where a bit has as many votes for as against it, the smallest hash decides, so that short texts do not lean
    to zeros."""
    return _wide(shingle_set(text, shingle))


def _wide(first: np.ndarray) -> tuple[int, int]:
    if not first.any():  # no word
        return 0, 0
    mixed = (first ^ (first >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    both = np.stack([first, mixed ^ (mixed >> np.uint64(33))], 1)
    total = np.zeros(WIDE, np.int64)
    for a in range(0, len(both), SLICE):
        total += np.unpackbits(both[a : a + SLICE].view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(0, dtype=np.int64)
    tie = np.unpackbits(both[0].view(np.uint8), bitorder="little").astype(bool)
    low, high = np.packbits(np.where(total * 2 == len(first), tie, total * 2 > len(first)), bitorder="little").view("<u8")
    return int(low), int(high)


def radius_of(similarity: float) -> int:
    """Differing bits of 128 within which all pairs of this Jaccard similarity lie but one in a million: five deviations
    above the mean. Whether such a pair is similar is for its shingles to say.

    Jaccard s is cosine 2 s / (1 + s) between equally long sets; a bit differs with a chance of angle / pi.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(WIDE * share + 5 * np.sqrt(WIDE * share * (1 - share)))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1)


def wide_forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """As forest(), over rows of two 64-bit halves."""
    left, links, frontier = np.arange(1, len(prints)), [], [0]
    while frontier:
        node = frontier.pop()
        near = _distances(prints[left], prints[node]) <= radius
        links += [(node, int(x)) for x in left[near]]
        frontier += left[near].tolist()
        left = left[~near]
        if not frontier and len(left):
            frontier, left = [int(left[0])], left[1:]
    return links


def run_links(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of linked members of runs of equal keys, enough to connect each run's linked members."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    sizes = np.diff(starts)
    small = np.repeat(sizes <= SMALL_RUN, sizes)
    out = []
    for shift in range(1, SMALL_RUN):
        at = np.flatnonzero(small[:-shift] & (keys[:-shift] == keys[shift:])) if len(keys) > shift else np.zeros(0, np.int64)
        at = at[_distances(prints[at], prints[at + shift]) <= radius]
        out.append((at, at + shift))
    for r in np.flatnonzero(sizes > SMALL_RUN):
        a = starts[r]
        members, first = np.unique(prints[a : starts[r + 1]], axis=0, return_index=True)
        found = np.array(wide_forest(members, radius), np.int64).reshape(-1, 2)
        out.append((a + first[found[:, 0]], a + first[found[:, 1]]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def stars(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of the components of links (rows of two fingerprints): each node but the smallest with the smallest."""
    nodes, back = np.unique(np.concatenate([pairs[:, :2], pairs[:, 2:]]), axis=0, return_inverse=True)
    a, b = back.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def meeting_links(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b) as hexadecimal fingerprints: what links within the radius connect among fingerprints (key, low, high) that
    share a key.

    A large group of copies meets under many keys, each time in other parts; every task joins what it has found and
    hands on a star for each component, so that the group's edges stay few.
    """

    def collide(batches):
        names = lambda x: pa.array([f"{int(h):016x}{int(w):016x}" for w, h in x], pa.string())
        rest_keys, rest = np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)

        found, size = [], 0

        def contract():
            """The task's links so far as one star for each of its components."""
            nodes, roots = stars(np.concatenate([*found, np.zeros((0, 4), np.uint64)]))
            return np.concatenate([nodes, roots], 1)

        for batch in batches:
            keys = np.concatenate([rest_keys, np.asarray(batch.column("key"))])
            prints = np.concatenate([rest, np.stack([np.asarray(batch.column("low")), np.asarray(batch.column("high"))], 1).view(np.uint64)])
            # the last run may go on in the next batch
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            rest_keys, rest = keys[cut:], prints[cut:]
            if cut:
                a, b = run_links(keys[:cut], prints[:cut], radius)
                found.append(np.concatenate([prints[a], prints[b]], 1))
                size += len(a)
            if size > MOST_LINKS:
                found = [contract()]
                size = len(found[0])
        if len(rest_keys):
            a, b = run_links(rest_keys, rest, radius)
            found.append(np.concatenate([rest[a], rest[b]], 1))
        pairs = contract()
        if len(pairs):
            yield pa.RecordBatch.from_arrays([names(pairs[:, :2]), names(pairs[:, 2:])], ["a", "b"])

    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(collide, "a string, b string").distinct()


def jaccard_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect what is connected by pairs of sets (sorted, distinct) of this Jaccard similarity, no others.

    Only sets that share an element of their prefixes, rarest elements first, are compared, and only while unconnected.
    """
    sizes = np.array([len(x) for x in sets])
    _, tokens, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    parts = np.split(rank[tokens], np.cumsum(sizes)[:-1])
    lengths = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    keys = np.concatenate([np.sort(x)[:n] for x, n in zip(parts, lengths, strict=True)])
    owners = np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], owners[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    mark, parent, links = np.zeros(len(counts), bool), list(range(len(sets))), []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in np.flatnonzero(np.diff(starts) > 1):
        members = owners[starts[r] : starts[r + 1]]
        roots = np.array([root(x) for x in members.tolist()])
        for h in range(len(members) - 1):
            if (roots == roots[0]).all():
                break
            head = members[h]
            at = h + 1 + np.flatnonzero(roots[h + 1 :] != roots[h])
            at = at[np.minimum(sizes[members[at]], sizes[head]) >= similarity * np.maximum(sizes[members[at]], sizes[head]) - 1e-9]
            if len(at) == 0:
                continue
            mark[parts[head]] = True
            shared = np.add.reduceat(mark[np.concatenate([parts[x] for x in members[at]])], np.concatenate([[0], np.cumsum(sizes[members[at]])[:-1]]), dtype=np.int64)
            mark[parts[head]] = False
            for x in at[shared >= similarity * (sizes[members[at]] + sizes[head] - shared) - 1e-9].tolist():
                if roots[x] != roots[h]:
                    links.append((int(head), int(members[x])))
                    parent[roots[x]] = roots[h]
                    roots[roots == roots[x]] = roots[h]
    return links


def verified_links(texts: DataFrame, members: DataFrame, n: int, shingle: int, similarity: float) -> DataFrame:
    """(a, b) rows of this Jaccard similarity of their shingles, enough to connect all that are connected within each
    cell of `members` (row, cell), a written table of n rows. Written, too."""

    def verify(batches):
        key, rows, sets = None, [], []

        def solve():
            found = np.array(rows, np.int64)[np.array(jaccard_links(sets, similarity) if len(sets) > 1 else [], np.int64).reshape(-1, 2)]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))], ["a", "b"])

        for batch in batches:
            for row, text, own in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "cell")), strict=True):
                if own != key:
                    if len(sets) > 1:
                        yield solve()
                    key, rows, sets = own, [], []
                rows.append(row)
                sets.append(shingle_set(text, shingle))
        if len(sets) > 1:
            yield solve()

    few = n <= BROADCAST_NUMBERS
    dealt = texts.select("row", "text").join(F.broadcast(members) if few else members, "row").select("row", "text", "cell")
    return stash(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(verify, "a long, b long").distinct(), "simhash-links")


def cells_of(members: DataFrame) -> DataFrame:
    """(row, size, class, parts, part): rows of a class (row, size, class) dealt to as many parts as CELL_ROWS and
    CELL_SHINGLES ask for. Written."""
    whole = members.groupBy("class").agg(F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum("size") / CELL_SHINGLES)).alias("parts"))
    dealt = members.join(stash(whole, "simhash-classes"), "class")
    return stash(dealt.select("row", "size", "class", "parts", F.pmod(F.xxhash64("row", "class"), F.col("parts")).alias("part")), "simhash-cells")


def similar_links(texts: DataFrame, members: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b) rows of this similarity that connect all that are connected within each class of `members` (row, size,
    class), however large: no task sees more than a part of a class.

    Parts are verified by themselves. In a class of several parts one row of each cluster found stands for it, and
    these are dealt and verified again while their number falls by half. Of a large group of copies that leaves one
    cluster; every row outside of the largest is at last verified, in blocks, against all rows of the class. So each
    pair is compared in some task or already connected.
    """
    cell = F.xxhash64("class", "part")
    cells = cells_of(members)
    links = verified_links(texts, cells.select("row", cell.alias("cell")), cells.count(), shingle, similarity)
    large = stash(cells.where("parts > 1"), "simhash-large")
    left = large.count()
    if not left:
        return links
    cut = lambda df: stash(df, "simhash-clusters")
    while True:
        roots = connected_components(links, cut)
        clusters = stash(large.join(roots, large.row == roots.node, "left").select("row", "size", "class", "parts", "part", F.coalesce("root", "row").alias("root")), "simhash-clusters")
        standing = stash(clusters.groupBy("class", "root").agg(F.min_by("row", F.struct("size", "row")).alias("row"), F.min("size").alias("size"), F.count("*").alias("n")), "simhash-standing")
        n = standing.count()
        if n == standing.select("class").distinct().count() or 2 * n > left:
            break
        left = n
        again = cells_of(standing.select("row", "size", "class"))
        links = stash(links.unionByName(verified_links(texts, again.select("row", cell.alias("cell")), n, shingle, similarity)).distinct(), "simhash-links")
    most = standing.groupBy("class").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    outside = stash(clusters.join(stash(most, "simhash-largest"), "class").where("root <> largest").select("row", "size", "class", "parts"), "simhash-outside")
    if outside.isEmpty():
        return links
    asked = cells_of(outside.select("row", "size", "class")).select("row", "class", F.col("part").alias("block"), F.col("parts").alias("blocks"))
    blocks = asked.select("class", "blocks").distinct()
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    sides = asked.join(large.select("class", "parts").distinct(), "class").select("row", "class", "block", F.explode(every).alias("part"))
    sides = sides.unionByName(large.join(blocks, "class").select("row", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "part"))
    met = stash(sides.select("row", F.xxhash64("class", "block", "part").alias("cell")).distinct(), "simhash-met")
    return stash(links.unionByName(verified_links(texts, met, met.count(), shingle, similarity)).distinct(), "simhash-links")


def ball_links(named: DataFrame) -> DataFrame:
    """(a, b) names that links() of their fingerprints connect, of (fp, name): each name with the least of its component."""
    roots = connected_components(links(named.select("fp").distinct()), lambda df: stash(df, "simhash-components"))
    rooted = stash(named.distinct().join(roots, named.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("key"), F.col("name").alias("a")), "simhash-balls")
    least = stash(rooted.groupBy("key").agg(F.min("a").alias("b"), F.max("a").alias("most")).where("b <> most").drop("most"), "simhash-least")
    return join_lookup(rooted, least, "key", least.count(), "inner").where("a <> b").select("a", "b").distinct()


def similar_rows(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(row, doc_id, root) of every row of a written table (row, doc_id, text): rows connected by pairs of this Jaccard
    similarity have the same root, the row of one of them.

    Candidates are rows that the balls around their fingerprints of 64 bits connect. Pairs of this similarity may lie
    beyond RADIUS bits, so that rows are candidates, too, that share a shingle of their prefixes, which no pair of this
    similarity fails to do, however many rows there are, and whose wide fingerprints are within radius_of(similarity);
    where a shingle is in the prefixes of more than HOT_KEY texts by the sample, all of them are candidates together, for
    which a running minimum is enough.
    Groups of candidates are dealt to classes of adjacent lengths, and pairs in them count if their shingles say so.
    """
    bound_batches(texts.sparkSession)
    common, counts = common_shingles(texts, shingle)
    hot = common[counts * SAMPLED > HOT_KEY]

    def hashed(batches):
        for batch in batches:
            sets, narrow = [], np.empty(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column("text")):
                hashes = shingle_hashes(text.as_py(), shingle)
                narrow[i] = majority(hashes)
                sets.append(np.unique(hashes))
            found = np.array([_wide(x) for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
            keys = [prefix(x, similarity, common, counts) for x in sets]
            shared = [np.isin(x, hot) for x in keys]
            lists = [pa.array([x[chosen(y)].view(np.int64) for x, y in zip(keys, shared, strict=True)], pa.list_(pa.int64())) for chosen in (np.logical_not, np.asarray)]
            sizes = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1])), pa.array(narrow.view(np.int64)), sizes, *lists], ["row", "doc_id", "low", "high", "fp", "size", "keys", "hot"])

    prints = stash(texts.select("row", "doc_id", "text").mapInArrow(hashed, "row long, doc_id long, low long, high long, fp long, size long, keys array<long>, hot array<long>"), "simhash-wide")
    name = F.lower(F.concat(F.lpad(F.hex("high"), 16, "0"), F.lpad(F.hex("low"), 16, "0")))
    edges = ball_links(prints.select("fp", name.alias("name")))
    edges = edges.unionByName(meeting_links(prints.select(F.explode("keys").alias("key"), "low", "high"), radius_of(similarity)))
    if len(hot):
        many = prints.select(F.explode("hot").alias("key"), name.alias("a"))
        least = stash(many.groupBy("key").agg(F.min("a").alias("b")), "simhash-hot")
        edges = edges.unionByName(many.join(least, "key").select("a", "b").distinct())
    roots = connected_components(edges, lambda df: stash(df, "simhash-components"))
    loose = prints.select("row", "size", name.alias("node")).join(roots, "node", "left").select("row", "size", F.coalesce("root", "node").alias("group"))
    groups = stash(loose.groupBy("group").agg(F.count("*").alias("rows"), F.sum("size").alias("shingles")).where("rows > 1"), "simhash-groups")
    # sizes of similar sets are in the same class or in adjacent ones: in a large group a row is dealt to its own and the next
    own = F.floor(F.log("size") / -float(np.log(similarity)) + 1e-9)
    whole = (F.col("rows") <= CELL_ROWS) & (F.col("shingles") <= CELL_SHINGLES)
    members = loose.join(groups, "group").select("row", "size", "group", F.explode(F.when(whole, F.array(F.lit(-1).cast("long"))).otherwise(F.array(own, own + 1))).alias("length"))
    members = stash(members.select("row", "size", F.xxhash64("group", "length").alias("class")), "simhash-members")
    near = similar_links(texts, members, shingle, similarity)
    joined = connected_components(near, lambda df: stash(df, "simhash-verified"))
    return stash(prints.select("row", "doc_id").join(joined.select(F.col("node").alias("row"), "root"), "row", "left").select("row", "doc_id", F.coalesce("root", "row").alias("root")), "simhash-rows")


def similar_groups(documents: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row: component_id is the smallest doc_id of those connected by similar pairs."""
    rows = similar_rows(texts_of(number_rows(documents.select("doc_id", "text"), "simhash-numbered")), shingle, similarity)
    return rows.join(stash(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "simhash-named"), "root").select("doc_id", "component_id")


def drop_near_copies(documents: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each component the row with the smallest doc_id (null last; among rows of one id, one of them), with all its
    columns, whatever these are called. Rows are told apart by numbers of their own, so ids may be null or repeated.
    Chains count: a row that is similar to one that goes, goes too, even where it is less similar to the one that stays."""
    numbered = number_rows(documents, "simhash-numbered")
    rows = similar_rows(texts_of(numbered), shingle, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    # components of one row, which are most, need no grouping: their root is the row
    shared = rows.where("root <> row").select("root").distinct()
    members = stash(rows.join(stash(shared, "simhash-shared"), "root"), "simhash-copies")
    kept = stash(members.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias("row")), "simhash-kept")
    gone = stash(members.join(kept, "row", "left_anti").select("row"), "simhash-gone")
    return own_columns(without_rows(numbered, gone), documents.columns)
