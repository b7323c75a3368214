"""Line dedup by a segment-partition edit join.

Every line of at least ``least`` characters is an occurrence; equal lines (without outer white space) are one node. To find
lines within ``edits`` edits of each other, a line is cut into edits + 1 segments: of two such lines the shorter has at
least one segment that the longer holds unchanged, within a window of places that the lengths and the segment's number
leave. Segments are index keys, the substrings of those windows probe keys; both are hashes of (length of the indexed line,
number of the segment, characters). Lines that share a key are compared in tiles of bounded size by a banded bit-parallel
edit distance. Of each group of linked lines the first occurrence by (document, line) stays.

Keys and occurrences are many and most of them meet nothing, so they go through shuffles as blocks (``blocks``), and only
what met another becomes rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skein.llm import blocks
from skein.llm.common import BROADCAST_IDS, connected_components, cut, released, slices, spanning_links, table, unused

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
SAMPLE = 50_000  # documents in which very common keys are looked for
HOT = 20_000  # keys of more rows are split over tasks
HELD = 1_000_000  # values that a task holds to make blocks of
WHOLE = 4_000_000  # rows of a bucket that are looked at together


def node_of(line: str) -> tuple[int, int]:
    """128 bits of a line as two longs; the first, even, names it among candidates."""
    digest = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
    a, b = np.frombuffer(digest, "<i8").tolist()
    return a & ~1, b


def digests(lines: list[str]) -> np.ndarray:
    """``node_of`` of each line as two columns."""
    data = b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines])
    out = np.frombuffer(data, "<i8").reshape(-1, 2).copy()
    out[:, 0] &= ~1
    return out


def windows(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of all probes but those that repeat the line's own index keys."""
    out = []
    for delta in range(edits + 1):
        for i in range(1, edits + 2):
            low, high = max(1 - i, delta - (edits + 1 - i)), min(i - 1, delta + (edits + 1 - i))
            out += [(delta, i, shift) for shift in range(low, high + 1) if delta or shift]
    return out


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.up, self.down = (np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(2 * n, b)]) for b in (BASE, inverse))
        return self.up[:n], self.down[:n]


def signatures(lines: list[str], nodes: np.ndarray, edits: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(key, node with the lowest bit set on index keys) for all segments and probes of the lines."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    up, down = powers.of(len(chars) + 1)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars + np.uint64(1)) * up[1:], out=sums[1:])
    first = np.cumsum(size) - size
    keys, owners = [], []

    def put(length: np.ndarray, i: int, shift: int, index: bool) -> None:
        short = length // (edits + 1)
        longer = edits + 1 - length % (edits + 1)  # segments from this one on have a character more
        at = (i - 1) * short + np.maximum(0, i - 1 - longer) + shift
        wide = short + (i > longer)
        fits = (at >= 0) & (at + wide <= size) & (short > 0)
        s = (first + at)[fits]
        code = (sums[s + wide[fits]] - sums[s]) * down[s]
        code ^= (length[fits].astype(np.uint64) * np.uint64(edits + 2) + np.uint64(i)) * MIX2
        code ^= code >> np.uint64(30)
        code *= MIX
        code ^= code >> np.uint64(27)
        code *= MIX2
        keys.append((code ^ (code >> np.uint64(31))).view(np.int64))
        owners.append(nodes[fits] | int(index))

    for i in range(1, edits + 2):
        put(size, i, 0, True)
    for delta, i, shift in windows(edits):
        put(size - delta, i, shift, False)
    return np.concatenate(keys), np.concatenate(owners)


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]], edits: int) -> np.ndarray:
    """min(distance, edits + 1) of each pair of character arrays, all pairs side by side.

    Column by column of the distance matrix, a word holds the vertical differences of the 2 * edits + 1 diagonals of the
    band; they move down by one row a column.
    """
    out = np.zeros(len(pairs), np.int64)
    trimmed = []
    for k, (a, b) in enumerate(pairs):
        m = min(len(a), len(b))
        same = a[:m] == b[:m]
        head = m if same.all() else int(np.argmin(same))
        tail_same = a[len(a) - (m - head) :][::-1] == b[len(b) - (m - head) :][::-1]
        tail = m - head if tail_same.all() else int(np.argmin(tail_same))
        a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        if abs(len(a) - len(b)) > edits:
            out[k] = edits + 1
        elif not len(a) or not len(b):
            out[k] = min(edits + 1, len(a) + len(b))
        else:
            trimmed.append((k, a, b) if len(a) <= len(b) else (k, b, a))
    trimmed.sort(key=lambda x: len(x[2]))
    for at in range(0, len(trimmed), 4096):
        part = trimmed[at : at + 4096]
        out[[k for k, _, _ in part]] = _banded([a for _, a, _ in part], [b for _, _, b in part], edits)
    return out


def _banded(rows: list[np.ndarray], columns: list[np.ndarray], edits: int) -> np.ndarray:
    """The same for pairs whose first side isn't the longer, by at most ``edits``.

    In column j, bit t stands for row j - edits + t. Rows above the first are as if the distance rose away from it, rows
    below the band as if it rose by one a row; neither shortens a way inside the band. The distance only grows along a
    diagonal, by one wherever bit t of d0 is not set, so the diagonal of the last cell gives the result.
    """
    band, n = 2 * edits + 1, len(rows)
    la, lb = (np.array([len(x) for x in side]) for side in (rows, columns))
    a = np.full((n, int(lb.max()) + 2 * band), -1, np.int64)  # row r at a[:, r - 1 + edits]; nothing equals the padding
    b = np.full((n, int(lb.max())), -2, np.int64)
    for k, (x, y) in enumerate(zip(rows, columns)):
        a[k, edits : edits + len(x)] = x
        b[k, : len(y)] = y
    full, top, one = np.uint64((1 << band) - 1), np.uint64(1 << (band - 1)), np.uint64(1)
    above = np.uint64((1 << edits) - 1)
    vn, vp = np.full(n, above), np.full(n, full ^ above)
    diagonal, dist = (la - lb + edits).astype(np.uint64), lb - la
    final, alive = np.full(n, edits + 1), np.arange(n)
    for j in range(1, int(lb.max()) + 1):
        column, eq = b[alive, j - 1], np.zeros(len(alive), np.uint64)
        for t in range(band):
            eq |= (a[alive, j - 1 + t] == column).astype(np.uint64) << np.uint64(t)
        d0 = (((((eq & vp) + vp) ^ vp) | eq) | vn) & full
        hp, hn = vn | (~(d0 | vp) & full), d0 & vp
        vp = ((hn | ~((d0 >> one) | hp)) & full) | top
        vn = (d0 >> one) & hp & ~top
        dist = dist + (((d0 >> diagonal) & one) == 0)
        ended = lb[alive] == j
        if ended.any() or dist.max() > edits:
            final[alive[ended]] = np.minimum(dist[ended], edits + 1)
            stay = ~ended & (dist <= edits)
            alive, vp, vn, diagonal, dist = alive[stay], vp[stay], vn[stay], diagonal[stay], dist[stay]
            if not len(alive):
                break
    return final


def occurrences(docs: DataFrame, buckets: int, least: int, id_col: str, text_col: str) -> DataFrame:
    """Blocks of (a, b, doc_id, line_no) in this order, by ``a``, of every line of at least ``least`` characters without outer white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches, text=1):
            docs, numbers, lines = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, line in enumerate(text.split("\n") if text else ()):
                    if len(line := line.strip()) >= least:
                        docs.append(doc_id)
                        numbers.append(k)
                        lines.append(line)
            held.append(np.stack([*digests(lines).T, np.array(docs, np.int64), np.array(numbers, np.int64)]))
            n += 4 * len(lines)
            if n >= HELD:
                yield _in_order(held, buckets)
                held, n = [], 0
        if n:
            yield _in_order(held, buckets)

    return _texts(docs, id_col, text_col).mapInArrow(released(run), blocks.SCHEMA)


def _in_order(held: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    rows = np.concatenate(held, axis=1)
    rows = rows[:, np.lexsort(rows[::-1])]
    return blocks.blocks(list(rows), blocks.bucket_of(rows[0], buckets), 1)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _lines_of(batch: pa.RecordBatch, least: int) -> dict[int, str]:
    """The distinct lines of a batch (column 1) by node."""
    lines = [x for x in {line.strip() for text in batch.column(1).to_pylist() if text for line in text.split("\n")} if len(x) >= least]
    return dict(zip(digests(lines)[:, 0].tolist(), lines))


def _signed(batches: Iterator[pa.RecordBatch], edits: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The signatures of all lines of (doc_id, text), some at a time."""
    powers, seen = Powers(), set()
    for batch in slices(batches, text=1):
        lines = {a: x for a, x in _lines_of(batch, least).items() if a not in seen}
        if lines:
            if len(seen) < 200_000:
                seen.update(lines)  # spares repeats of a common line, no more than that
            yield signatures(list(lines.values()), np.array(list(lines), np.int64), edits, powers)


def _sign(edits: int, least: int, buckets: int, common):
    """(doc_id, text) to blocks of (key, owner) of all lines, by key; rows of the keys in ``common`` go by owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in _signed(batches, edits, least):
            held.append(part)
            n += 2 * len(part[0])
            if n >= HELD:
                yield block(held)
                held, n = [], 0
        if held:
            yield block(held)

    def block(held: list) -> pa.RecordBatch:
        keys, owners = (np.concatenate(x) for x in zip(*held))
        by = keys if common is None else np.where(_within(common.value, keys), owners, keys)
        return blocks.blocks([keys, owners], blocks.bucket_of(by & ~1, buckets))

    return run


def _within(common: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are in ``common``, sorted."""
    if not len(common):
        return np.zeros(len(keys), bool)
    return common[np.minimum(np.searchsorted(common, keys), len(common) - 1)] == keys


def common_keys(docs: DataFrame, edits: int, least: int):
    """The keys that very many lines have, from a sample by hash; they only tell how rows are dealt to tasks."""
    one_of = max(16, docs.count() // SAMPLE)
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(one_of)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _ in _signed(batches, edits, least):
            yield pa.RecordBatch.from_arrays([pa.array(keys)], ["key"])

    counted = drawn.mapInArrow(released(run), "key long").groupBy("key").agg(F.count("*").alias("n"))
    found = counted.where(F.col("n") > max(8, HOT // one_of)).toArrow()["key"].to_numpy()
    return docs.sparkSession.sparkContext.broadcast(np.sort(found)) if len(found) else None


def near_keys(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """(key, node) for the keys that several different lines share; ``docs``: (doc_id, text)."""
    common, buckets = common_keys(docs, edits, least), blocks.bucket_count(docs.sparkSession)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows whose key has more than one node or is common. Of a very large bucket only keys of one node so far are held."""
        known = common.value if common else np.zeros(0, np.int64)
        of, held, n, most, passed = None, [], 0, WHOLE, known
        for bucket, _, rows in blocks.read(batches, 2):
            if bucket != of:
                if held:
                    yield _several(held, passed)[0]
                of, held, n, most, passed = bucket, [], 0, WHOLE, known
            held.append(rows)
            n += rows.shape[1]
            if n > most:
                found, rest = _several(held, passed)
                yield found
                passed = np.union1d(passed, found.column(0).to_numpy())
                held, n = [rest], rest.shape[1]
                most = max(WHOLE, 2 * n)
        if held:
            yield _several(held, passed)[0]

    signed = docs.mapInArrow(released(_sign(edits, least, buckets, common)), blocks.SCHEMA)
    rows = blocks.deal(signed, buckets).mapInArrow(released(shared), "key long, owner long")
    rows = rows.groupBy("key", F.col("owner").bitwiseAND(-2).alias("node")).agg(F.max(F.col("owner").bitwiseAND(1)).alias("index"))
    rows = cut(rows)
    good = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("index").alias("any")).where("n > 1 and any = 1")
    return rows.join(good.select("key", "n"), "key").select("key", "node", "n")


def _several(held: list[np.ndarray], passed: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose key has more than one node or is in ``passed``, and one for each other key."""
    keys, owners = np.concatenate(held, axis=1)
    order = np.argsort(keys)
    keys, owners = keys[order], owners[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    low, high = np.minimum.reduceat(owners, starts), np.maximum.reduceat(owners, starts)
    several = (low >> 1 != high >> 1) | _within(passed, keys[starts])
    stay = np.repeat(several, np.diff(np.r_[starts, len(keys)]))
    found = pa.RecordBatch.from_arrays([pa.array(keys[stay]), pa.array(owners[stay])], ["key", "owner"])
    return found, np.stack([keys[starts][~several], high[~several]])


def near_lines(docs: DataFrame, edits: int = 2, least: int = 20, tile: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (src, dst) between nodes of different lines that span every group at ``edits`` edits or fewer.

    Null and empty texts have no lines; repeated rows and lines count once; an empty table gives no rows; columns other than
    the two named are ignored; lines are compared whole, however long.
    """
    texts = _texts(docs, id_col, text_col)
    members = cut(near_keys(texts, edits, least))
    wanted = cut(members.select("node").distinct())

    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    known = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow()["node"].to_numpy())) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=1):
            lines = _lines_of(batch, least)
            if known:
                stay = _within(known.value, np.array(list(lines), np.int64))
                lines = dict(compress(lines.items(), stay.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(lines), pa.int64()), pa.array(list(lines.values()), pa.string())], ["a", "line"])

    lines = texts.mapInArrow(released(run), "a long, line string")
    if not few:
        lines = lines.join(wanted, F.col("a") == F.col("node"), "left_semi")
    lines = lines.groupBy("a").agg(F.min("line").alias("line"))
    rows = members.withColumn("parts", F.ceil(F.col("n") / tile).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "node")
    rows = rows.join(lines, rows["node"] == lines["a"]).select("tile", "node", "line")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(released(_verify(edits)), "src long, dst long")


def _verify(edits: int):
    def links(group: list, nodes: list, lines: list) -> pa.RecordBatch:
        chars = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in lines]
        size, group = np.fromiter(map(len, chars), np.int64, len(chars)), np.array(group)
        order = np.lexsort((size, group))
        left, shift = np.arange(len(order) - 1), 1
        g, s = group[order], size[order]
        found = [np.zeros(0, np.int64)] * 2
        joined = np.arange(len(order))
        while len(left):  # pairs at this distance in order of length, while the lengths are near
            left = left[(g[left] == g[left + shift]) & (s[left + shift] - s[left] <= edits)]
            open_ = left[joined[order[left]] != joined[order[left + shift]]]
            if len(open_):
                i, j = order[open_], order[open_ + shift]
                near = edit_distances([(chars[x], chars[y]) for x, y in zip(i.tolist(), j.tolist())], edits) <= edits
                found = [np.r_[found[0], i[near]], np.r_[found[1], j[near]]]
                moved, to = spanning_links(len(order), *found)
                joined[moved] = to  # pairs that are linked already need no comparison
            shift += 1
            left = left[left + shift < len(order)]
        x, y = spanning_links(len(order), *found)
        nodes = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[y])], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, lines = [], [], []
        for batch in slices(batches, rows=4096, text=2):
            group += batch.column(0).to_pylist()
            nodes += batch.column(1).to_pylist()
            lines += batch.column(2).to_pylist()
            if not group:
                continue
            end = group.index(group[-1])
            if end:
                yield links(group[:end], nodes[:end], lines[:end])
                group, nodes, lines = group[end:], nodes[end:], lines[end:]
        if group:
            yield links(group, nodes, lines)

    return run


def repeated_lines(docs: DataFrame, edits: int = 2, least: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, a): the lines to remove, all but the first of each group of equal and near lines; rows without an id take no part."""
    docs = docs.where(F.col(id_col).cast("long").isNotNull())
    buckets = blocks.bucket_count(docs.sparkSession)
    every = cut(occurrences(docs, buckets, least, id_col, text_col))
    groups = connected_components(near_lines(docs, edits, least, id_col=id_col, text_col=text_col))
    counted = every.mapInArrow(released(_counted), blocks.SCHEMA).unionByName(blocks.packed(groups.select("node", "component"), buckets))
    lines = cut(blocks.deal(counted, buckets).mapInArrow(released(_repeated), "a long, b long, doc_id long, line_no long, linked boolean, c long, d long"))
    first = lines.groupBy("linked", "c", "d").agg(F.min(F.struct("doc_id", "line_no")).alias("kept"))
    known = lines.drop("doc_id", "line_no").join(first, ["linked", "c", "d"]).select("a", "b", "kept.doc_id", "kept.line_no")
    return blocks.deal(every.unionByName(blocks.packed(known, buckets)), buckets).mapInArrow(released(_but_first), "doc_id long, line_no long, a long")


def _runs(rows: np.ndarray) -> np.ndarray:
    """Where the pairs in the first two columns change."""
    a, b = rows[:2]
    return np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of occurrences to (a, b, first doc_id, its line_no, number), one for each line of a block."""
    for batch in batches:
        found, of = [np.zeros((5, 0), np.int64)], [np.zeros(0, np.int32)]
        for bucket, _, rows in blocks.read([batch], 0, 4):
            starts = _runs(rows)
            found.append(np.concatenate([rows[:, starts], np.diff(np.r_[starts, rows.shape[1]])[None]]))
            of.append(np.full(len(starts), bucket, np.int32))
        yield blocks.blocks(list(np.concatenate(found, axis=1)), np.concatenate(of), 1)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the groups (kind 0) and counted lines (kind 1) of each bucket, the lines that occur again or are linked, with the name (linked, c, d) of their group."""
    for _, (groups, rows) in _by_bucket(blocks.read(batches, 2, 5)):
        if not rows:
            continue
        rows = np.concatenate(rows, axis=1)
        rows = rows[:, np.lexsort(rows[3::-1])]
        starts = _runs(rows)
        a, b, doc, line = rows[:4, starts]
        node, component = np.concatenate([*groups, np.zeros((2, 0), np.int64)], axis=1)
        order = np.argsort(node)
        linked = _within(node[order], a)
        c, d = a.copy(), np.where(linked, 0, b)
        c[linked] = component[order][np.searchsorted(node[order], a[linked])]
        stay = linked | (np.add.reduceat(rows[4], starts) > 1)
        yield pa.RecordBatch.from_arrays([pa.array(x[stay]) for x in (a, b, doc, line, linked, c, d)], ["a", "b", "doc_id", "line_no", "linked", "c", "d"])


def _by_bucket(found: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, tuple[list, list]]]:
    """Each bucket with its blocks of kind 0 and 1."""
    for bucket, part in groupby(found, key=lambda x: x[0]):
        sides = [], []
        for _, kind, rows in part:
            sides[kind].append(rows)
        yield bucket, sides


def _but_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the known lines (kind 0: a, b, place that stays) of each bucket and its occurrences (kind 1), the occurrences of known lines elsewhere.

    Occurrences pass some blocks at a time, so a line that is everywhere takes no more memory than others.
    """
    for _, part in groupby(blocks.read(batches, 4, 4), key=lambda x: x[0]):
        known, held, n = [np.zeros((4, 0), np.int64)], [], 0
        for _, kind, rows in part:
            (held if kind else known).append(rows)
            n += kind * rows.shape[1]
            if n >= HELD // 4:
                known = [np.concatenate(known, axis=1)]
                yield _elsewhere(known[0], np.concatenate(held, axis=1))
                held, n = [], 0
        if held:
            yield _elsewhere(np.concatenate(known, axis=1), np.concatenate(held, axis=1))


def _elsewhere(known: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    known = known[:, np.argsort(known[0])]
    rows = rows[:, _within(known[0], rows[0])]
    at, end = (np.searchsorted(known[0], rows[0], side) for side in ("left", "right"))
    gone = np.zeros(rows.shape[1], bool)
    while (left := at < end).any():  # more than one round only where lines share ``a``
        a, b, doc, line = known[:, np.minimum(at, known.shape[1] - 1)]
        gone |= left & (b == rows[1]) & ((doc != rows[2]) | (line != rows[3]))
        at = at + 1
    return pa.RecordBatch.from_arrays([pa.array(rows[k][gone]) for k in (2, 3, 0)], ["doc_id", "line_no", "a"])


def dedup_lines(docs: DataFrame, edits: int = 2, least: int = 20, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the repeated lines taken out of the texts; all rows and other columns stay.

    ``count_col`` names a column that is set to the length of the text.

    A line counts without outer white space. Lines of fewer than ``least`` characters always stay. The texts of rows without
    an id stay and make no other line a repeated one. Null texts stay null; a text all of whose lines go becomes empty. Rows that repeat an id are taken
    for one document: their equal lines at equal places stay or go together. Links are transitive. An empty table gives
    no rows.
    """
    gone = repeated_lines(docs, edits, least, id_col, text_col)
    of, numbers = unused(docs, "gone_of"), unused(docs, "gone_lines")
    gone = gone.groupBy(F.col("doc_id").alias(of)).agg(F.collect_set(F.struct("line_no", "a")).alias(numbers))

    at, schema = docs.columns.index(text_col), StructType([StructField(f.name, StringType()) if f.name == text_col else f for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=at):
            out = [_without(text, numbers) if numbers and text else text for text, numbers in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    rows = docs.withColumn(text_col, F.col(text_col).cast("string"))
    joined = rows.join(gone.hint("shuffle_hash"), rows[id_col].cast("long") == F.col(of), "left").drop(of)
    out = joined.mapInArrow(released(run), schema)
    if count_col and count_col in docs.columns:
        out = out.withColumn(count_col, F.coalesce(F.length(text_col), F.col(count_col)).cast(docs.schema[count_col].dataType))
    return out


def _without(text: str, numbers: list[dict]) -> str:
    drop = {(x["line_no"], x["a"]) for x in numbers}
    at = {k for k, _ in drop}
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in at or (k, node_of(x.strip())[0]) not in drop)


def line_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_kept, text_sha256) for every row: its lines before and after, and what the text then is.

    Null and empty texts, before or after, have no lines; the digest of a null text is null.
    """
    lines = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size(F.split("text", "\n")))
    found = dedup_lines(docs.select("doc_id", "text", lines.alias("n_lines")))
    return found.select("doc_id", "n_lines", lines.alias("n_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"))
