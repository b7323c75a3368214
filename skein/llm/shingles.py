"""Near duplicates by whole sets of word shingles: pigeonhole blocks of the set, then the exact distance.

A set of shingle hashes is a fingerprint of 2^64 bits, and its Hamming distance to another is the number of shingles that
only one of them holds. Two sets of n shingles in all and of Jaccard similarity t are (1 - t) / (1 + t) * n bits apart.
So sets are put in classes by size, of which similar sets are in the same or in neighbouring ones; for each class the bits
are dealt to more blocks than similar sets have differences, and similar sets share the content of a block. Sets that
share a block are compared with the least set of the block, then, unless these links join all of them already, with each
other, in tiles of bounded size.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import BROADCAST_IDS, connected_components, cut, released, slices, spanning_links

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)
SKETCH = 512  # bits of the shortest sketch
SAMPLE = 50_000  # documents in which very common blocks are looked for
HOT = 20_000  # blocks of more sets are split over tasks


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The XXH64 (seed 42) of each shingle of a text, repeats included; fewer words are one shingle, none none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    stops = np.cumsum(size + 1) - 1
    n, whole, digest = max(1, len(parts) - words + 1), b" ".join(parts), xxhash.xxh64_intdigest
    begin, end = (stops - size)[:n].tolist(), stops[min(words, len(parts)) - 1 :].tolist()
    return np.fromiter((digest(whole[s:e], 42) for s, e in zip(begin, end)), np.uint64, n)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes, unsigned: the bits that more than half of them have; 0 of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX2
    return (x ^ (x >> np.uint64(27))) * MIX


@functools.cache
def size_classes(similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least size, blocks, empty blocks that are allowed) of each class.

    Class c serves pairs of its own sets and of its own with those of the class before. They differ in at most d bits, so
    of d + 1 + k blocks k + 1 agree, and one that isn't empty does unless both sets leave more than k of them empty. That
    many are three standard deviations more than expected of the smallest sets in question.
    """
    low, blocks, spare, least = [1], [], [], 1
    while low[-1] < 1 << 40:
        most = int(low[-1] / similarity + 1e-9)
        d, k = int((1 - similarity) / (1 + similarity) * 2 * most + 1e-9), 0
        for _ in range(50):
            empty = (d + 1 + k) * (1 - 1 / (d + 1 + k)) ** least
            k, before = int(np.ceil(empty + 3 * np.sqrt(empty))) if d else 0, k
            if k <= before:
                break
        blocks.append(d + 1 + k)
        spare.append(k)
        least = low[-1]
        low.append(most + 1)
    return np.array(low[:-1]), np.array(blocks), np.array(spare)


def block_keys(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the blocks of each set in its own class and in the next; sets with too many empty ones have single shingles, too.

    Similar sets that both have too many empty blocks share one of the first shingles of each: of all shingles in the order
    of their hashes, similar sets hold at least ``similarity`` of either in common.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    low, blocks, spare = size_classes(similarity)
    x, rows = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), size)
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, content, own = _mixed(x + MIX) >> np.uint64(16), _mixed(x), np.searchsorted(low, size, side="right") - 1
    thin = np.zeros(len(sets), bool)
    out_rows, out_keys = [], []
    for c in (own, own + 1):
        c = np.maximum(c, 0)
        n = np.where(size > 0, blocks[c], 0)
        first = np.cumsum(n) - n
        at = first[rows] + (place % n[rows].astype(np.uint64)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        row = rows[order][starts]
        name = c[row].astype(np.uint64) * np.uint64(1 << 40) + (at[order][starts] - first[row]).astype(np.uint64)
        out_keys.append(_mixed(np.add.reduceat(content[order], starts) ^ _mixed(name * MIX + MIX2)))
        out_rows.append(row)
        thin |= n - np.bincount(row, minlength=len(sets)) > spare[c]
    for row in np.flatnonzero(thin).tolist():
        some = sets[row][: size[row] - int(np.ceil(similarity * size[row] - 1e-9)) + 1]
        out_keys.append(_mixed(some * MIX2 + MIX))
        out_rows.append(np.full(len(some), row))
    return np.concatenate(out_rows), np.concatenate(out_keys)


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles by remainder: they differ in no more places than the sets have differences.

    A sketch has as many bits as the next power of two holds shingles; the two halves of a longer one make a shorter one.
    """
    bits = max(SKETCH, 1 << max(0, len(own) - 1).bit_length())
    return np.packbits((np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").view("<u8")


def sketch_distance(a: np.ndarray, b: np.ndarray) -> int:
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _named(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)


def _read(words: int):
    """(doc_id, text) to (doc_id, node, size, sketch, fp); ``fp`` is the SimHash of the set."""

    def run(batches):
        for batch in slices(batches, text=1):
            sets = [shingle_set(x, words) for x in batch.column(1).to_pylist()]
            sketches = pa.array([sketch(x).tobytes() for x in sets], pa.binary())
            fps = pa.array(np.array([majority(x) for x in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_named(sets)), pa.array([len(x) for x in sets], pa.int64()), sketches, fps], ["doc_id", "node", "size", "sketch", "fp"])

    return run


def _sets(words: int):
    """(text) to (node, set)."""

    def run(batches):
        for batch in slices(batches, text=0):
            sets = [shingle_set(x, words) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(_named(sets)), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "set"])

    return run


def _keys(words: int, similarity: float, hot):
    """(text) to (key, node, salt); ``hot`` holds the very common keys, sorted, whose rows go to tasks by salt."""

    def run(batches):
        common, seen = hot.value[0] if hot else np.zeros(0, np.int64), set()
        for batch in slices(batches, text=0):
            sets = [shingle_set(x, words) for x in batch.column(0).to_pylist()]
            nodes, new = _named(sets), []
            for k, node in enumerate(nodes.tolist()):
                if node not in seen:
                    new.append(k)
                    if len(seen) < 200_000:
                        seen.add(node)  # spares copies within a task, no more than that
            rows, keys = block_keys([sets[k] for k in new], similarity)
            keys, node = keys.view(np.int64), nodes[new][rows]
            salt = np.where(_within(common, keys), (_mixed(node.view(np.uint64)) >> np.uint64(40)).astype(np.int32) + 1, 0) if len(common) else np.zeros(len(keys), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node), pa.array(salt, pa.int32())], ["key", "node", "salt"])

    return run


def _within(common: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return common[np.minimum(np.searchsorted(common, keys), len(common) - 1)] == keys


def _shared(hot):
    """(key, node, salt), sorted by key and node, to (key, leader, node) of all keys with several nodes, without repeats.

    Rows of a key are never held together: its first node is the leader and waits for a second one.
    """

    def run(batches):
        common, leaders = hot.value if hot else (np.zeros(0, np.int64),) * 2
        key, node = None, None  # the last row
        leader, told = None, True
        for batch in batches:
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            fresh_row = np.r_[(key is None) or keys[0] != key or nodes[0] != node, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])]
            keys, nodes = keys[fresh_row], nodes[fresh_row]
            if not len(keys):
                continue
            if key is not None and keys[0] == key and not told:  # the waiting leader and whoever follows
                keys, nodes = np.r_[key, keys], np.r_[leader, nodes]
            goes_on = key is not None and keys[0] == key and told
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            lead, several = nodes[starts].copy(), sizes > 1
            if goes_on:
                lead[0], several[0] = leader, True
            if len(common):
                is_hot = _within(common, keys[starts])
                lead[is_hot] = leaders[np.searchsorted(common, keys[starts][is_hot])]
                several |= is_hot
            leader, told, key, node = lead[-1], bool(several[-1]), keys[-1], nodes[-1]
            stay = np.repeat(several, sizes)
            if stay.any():
                yield pa.RecordBatch.from_arrays([pa.array(keys[stay]), pa.array(np.repeat(lead, sizes)[stay]), pa.array(nodes[stay])], ["key", "leader", "node"])

    return run


def _verify(similarity: float):
    def run(batches):
        for batch in slices(batches, rows=4096, chars=8_000_000, text=2):
            a, b = ([np.frombuffer(x, "<u8") for x in batch.column(k).to_pylist()] for k in (2, 3))
            good = pa.array([similar(x, y, similarity) for x, y in zip(a, b)], pa.bool_())
            yield batch.select([0, 1]).filter(good).rename_columns(["src", "dst"])

    return run


def _groups_of(batches, columns: int, text: int | None = None):
    """From batches sorted by the first column, lists of the columns of whole runs of it; only the last run waits."""
    held = [[] for _ in range(columns)]
    for batch in slices(batches, rows=4096, chars=8_000_000, text=text):
        for k in range(columns):
            held[k] += batch.column(k).to_pylist()
        if held[0] and held[0][0] != held[0][-1]:
            end = held[0].index(held[0][-1])
            yield [x[:end] for x in held]
            held = [x[end:] for x in held]
    if held[0]:
        yield held


def _pairs(tile: np.ndarray):
    """(a, shift): rows a and a + shift are of one tile; each pair of a tile comes once."""
    cuts = np.flatnonzero(tile[1:] != tile[:-1]) + 1
    stops = np.repeat(np.r_[cuts, len(tile)], np.diff(np.r_[0, cuts, len(tile)]))
    a, shift = np.arange(len(tile)), 1
    while len(a := a[a + shift < stops[a]]):
        yield a, shift
        shift += 1


def _near(a: np.ndarray, b: np.ndarray, size: np.ndarray, odd: list[np.ndarray], apart: float) -> np.ndarray:
    """Where rows a and b may be similar."""
    most = apart * (size[a] + size[b]) + 1e-9
    near = np.abs(size[a] - size[b]) <= most
    for k in np.flatnonzero(near).tolist():
        near[k] = sketch_distance(odd[a[k]], odd[b[k]]) <= most[k]
    return near


def _maybe(similarity: float):
    """(leader, node, size, sketch, size, sketch) to the (leader, node) that may be similar."""
    apart = (1 - similarity) / (1 + similarity)

    def run(batches):
        for batch in slices(batches, rows=4096, chars=8_000_000, text=3):
            a, b = ([np.frombuffer(x, "<u8") for x in batch.column(k).to_pylist()] for k in (3, 5))
            size = np.r_[batch.column(2).to_numpy(), batch.column(4).to_numpy()]
            n = len(a)
            good = _near(np.arange(n), np.arange(n, 2 * n), size, a + b, apart)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _candidates(similarity: float):
    """(tile, node, label, size, sketch) sorted by tile to the (tile, node, label) that may have a similar set of another label."""
    apart = (1 - similarity) / (1 + similarity)

    def run(batches):
        for tile, node, label, size, odd in _groups_of(batches, 5, text=4):
            tile, node, label, size = (np.array(x, np.int64) for x in (tile, node, label, size))
            odd, stay = [np.frombuffer(x, "<u8") for x in odd], np.zeros(len(tile), bool)
            for a, shift in _pairs(tile):
                a = a[(label[a] != label[a + shift]) & ~(stay[a] & stay[a + shift])]
                a = a[_near(a, a + shift, size, odd, apart)]
                stay[a] = stay[a + shift] = True
            yield pa.RecordBatch.from_arrays([pa.array(v[stay]) for v in (tile, node, label)], ["tile", "node", "label"])

    return run


def _links(similarity: float):
    """(tile, label, set) sorted by tile to links between labels that span the groups of similar sets."""
    apart = (1 - similarity) / (1 + similarity)

    def run(batches):
        for tile, label, sets in _groups_of(batches, 3, text=2):
            tile, label = np.array(tile, np.int64), np.array(label, np.int64)
            sets = [np.frombuffer(x, "<u8") for x in sets]
            size, odd = np.fromiter(map(len, sets), np.int64, len(sets)), [sketch(x) for x in sets]
            labels, of = np.unique(label, return_inverse=True)
            joined, found = np.arange(len(labels)), [np.zeros(0, np.int64)] * 2
            for a, shift in _pairs(tile):
                a = a[joined[of[a]] != joined[of[a + shift]]]  # what is linked already needs no comparison
                a = a[_near(a, a + shift, size, odd, apart)]
                a = np.array([k for k in a.tolist() if similar(sets[k], sets[k + shift], similarity)], np.int64)
                if len(a):
                    found = [np.r_[found[0], of[a]], np.r_[found[1], of[a + shift]]]
                    joined = np.arange(len(labels))
                    moved, to = spanning_links(len(labels), *found)
                    joined[moved] = to
            x, y = spanning_links(len(labels), *found)
            yield pa.RecordBatch.from_arrays([pa.array(labels[x]), pa.array(labels[y])], ["src", "dst"])

    return run


def _common_keys(source: DataFrame, words: int, similarity: float, n: int):
    """The very common keys and a node of each, from a sample by hash: they only tell how rows are dealt to tasks."""
    one_of = max(16, n // SAMPLE)
    drawn = source.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(one_of)) == 0).select("text")
    keys = drawn.mapInArrow(released(_keys(words, similarity, None)), "key long, node long, salt int")
    found = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where(F.col("n") > max(8, HOT // one_of)).orderBy("key").toPandas()
    return source.sparkSession.sparkContext.broadcast((found["key"].to_numpy(np.int64), found["leader"].to_numpy(np.int64))) if len(found) else None


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, tile: int = 1024, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, component_id): groups of texts that are linked by pairs of Jaccard similarity ``similarity`` or more.

    The sets are those of the shingles of ``words`` words, whole texts, A-Z lower-cased. No pair is missed, up to
    collisions of 64-bit hashes. Equal sets are one node, whatever the number of copies, and so are all texts without
    words, nulls included. ``near`` gives further pairs (leader, node) of sets (node, fp) to be verified, those whose
    fingerprints are near; the blocks of the whole sets find those pairs that it doesn't. Rows of null id belong to no group. Repeated rows come back repeated; an empty table gives no
    rows; columns other than the two named are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = cut(source.mapInArrow(released(_read(words)), "doc_id long, node long, size long, sketch binary, fp long"))
    nodes = cut(found.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("size", "sketch", "fp")]))
    known = source.where("doc_id is not null")
    hot = _common_keys(known, words, similarity, found.count())
    keys = known.select("text").mapInArrow(released(_keys(words, similarity, hot)), "key long, node long, salt int")
    members = keys.repartition("key", "salt").sortWithinPartitions("key", "node").select("key", "node").mapInArrow(released(_shared(hot)), "key long, leader long, node long")
    members = cut(members)

    def sets_of(rows: DataFrame) -> DataFrame:
        wanted = cut(rows.join(nodes, "node").select("least").distinct())
        few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        texts = known.join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("least"), "left_semi").select("text")
        return texts.mapInArrow(released(_sets(words)), "node long, set binary").groupBy("node").agg(F.any_value("set").alias("set"))

    # every member with the leader of its key
    at = lambda side: nodes.select(F.col("node").alias(side), F.col("size").alias(f"{side}_size"), F.col("sketch").alias(f"{side}_sketch"))
    pairs = members.where("node <> leader").select("leader", "node")
    if near:
        pairs = pairs.unionByName(near(nodes.select("node", "fp")))
    pairs = pairs.distinct().join(at("node"), "node").join(at("leader"), "leader")
    pairs = pairs.select("leader", "node", "leader_size", "leader_sketch", "node_size", "node_sketch")
    pairs = cut(pairs.mapInArrow(released(_maybe(similarity)), "leader long, node long"))
    sets = cut(sets_of(pairs.select("node").union(pairs.select("leader")).distinct()))
    both = pairs.join(sets.withColumnRenamed("set", "own"), "node").join(sets.select(F.col("node").alias("leader"), F.col("set").alias("other")), "leader").select("leader", "node", "own", "other")
    links = cut(both.mapInArrow(released(_verify(similarity)), "src long, dst long"))
    joined = connected_components(links).withColumnRenamed("component", "label")

    # keys whose members aren't all linked by that: all pairs of different labels
    labelled = members.join(joined, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    open_ = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("n > 2 and low < high")
    rows = labelled.join(open_.select("key", F.ceil(F.col("n") / tile).cast("int").alias("parts")), "key").join(nodes.select("node", "size", "sketch"), "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "node", "label", "size", "sketch")
    rows = cut(rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(released(_candidates(similarity)), "tile long, node long, label long"))
    alike = rows.groupBy("tile").agg(F.count("*").alias("n"), F.bit_xor("node").alias("a"), F.bit_xor(F.xxhash64("node")).alias("b"))
    rows = cut(rows.join(alike.groupBy("n", "a", "b").agg(F.min("tile").alias("tile")).select("tile"), "tile", "left_semi"))  # of tiles of the same sets one
    more = rows.join(sets_of(rows.select("node").distinct()), "node").select("tile", "label", "set")
    more = more.repartition("tile").sortWithinPartitions("tile").mapInArrow(released(_links(similarity)), "src long, dst long")
    groups = connected_components(joined.select(F.col("node").alias("src"), F.col("label").alias("dst")).unionByName(more))

    named = cut(nodes.join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("group")))
    lowest = named.groupBy("group").agg(F.min("least").alias("component_id"))
    return found.select("doc_id", "node").join(named.join(lowest, "group").select("node", "component_id"), "node", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
