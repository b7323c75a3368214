"""Hierarchical multi-length packing of documents into sequences.

A document's ids are cut into whole windows of the longest context size and a rest. Rests go to tiers by size; each tier
opens windows of its own size, fills their gaps with the largest rests of shorter tiers that fit, and closes what is left
with the front of the next shorter rest. Full windows of a short tier need no padding, being a power of two long. What
remains of a bucket is strung together, cut into windows, and only its last piece is padded. Sequences of a tier are dealt
to step groups of equal token budgets, by falling cost in snake order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import released, slices, table
from skein.llm.tokens import default_path, tokens

TIERS = (1024, 512, 256, 128)
RUN, RUNS = 4096, 1 << 14  # whole windows of a group, groups of an input partition
NUMBERS = 24  # bits that number the sequences of a bucket
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, tier int, step_group long"
NAMES = [part.split()[0].strip("`") for part in PIECE.split(",")]


class Pool:
    """Rests by length; finding the largest that fits is one step on a bit set."""

    def __init__(self, longest: int):
        self.by_length: list[list] = [[] for _ in range(longest + 1)]
        self.set = 0

    def add(self, length: int, item) -> None:
        self.by_length[length].append(item)
        self.set |= 1 << length

    def pop(self, length: int):
        items = self.by_length[length]
        item = items.pop()
        if not items:
            self.set &= ~(1 << length)
        return item

    def largest(self, most: int) -> int:
        """The largest length up to ``most``, 0 if there is none."""
        return (self.set & ((2 << most) - 1)).bit_length() - 1 if most > 0 and self.set & ((2 << most) - 1) else 0

    def smallest(self, least: int, most: int) -> int:
        above = (self.set & ((2 << most) - 1)) >> least
        return least + (above & -above).bit_length() - 1 if above else 0


def pack_rests(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (tier, [(item, start, length)...]) for rests of the given lengths, all below ``tiers[0]``.

    All sequences but the last few of the call are exactly as long as a tier.
    """
    pool = Pool(tiers[0])
    for item in sorted(range(len(lengths)), key=lambda k: -k):
        if lengths[item]:
            pool.add(lengths[item], (item, 0))
    done, left = [], []
    for at, tier in enumerate(tiers):
        shorter = tier // 2 if at + 1 < len(tiers) else tier
        below = shorter if at + 1 < len(tiers) else 0
        while (length := pool.largest(tier)) > below:
            item, start = pool.pop(length)
            sequence, gap = [(item, start, length)], tier - length
            while gap:
                if fit := pool.largest(min(gap, shorter)):
                    item, start = pool.pop(fit)
                    sequence.append((item, start, fit))
                    gap -= fit
                elif longer := pool.smallest(gap + 1, shorter):
                    item, start = pool.pop(longer)
                    sequence.append((item, start, gap))
                    pool.add(longer - gap, (item, start + gap))
                    gap = 0
                else:
                    break
            if gap:
                left += sequence
            else:
                done.append((tier, sequence))
    total, at, used = sum(x[2] for x in left), 0, 0
    while total:
        tier = next((t for t in tiers if t <= total), tiers[0])  # a last piece below the shortest tier is padded
        sequence, gap = [], min(tier, total)
        total -= gap
        while gap:
            item, start, length = left[at]
            take = min(gap, length - used)
            sequence.append((item, start + used, take))
            gap, used = gap - take, used + take
            if used == length:
                at, used = at + 1, 0
        done.append((tier, sequence))
    return done


def deal_steps(sequences: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int) -> list[int]:
    """A step group for each sequence: groups of a tier hold about ``step_tokens`` tokens and costs (sum of squares) alike."""
    groups, first = [0] * len(sequences), 0
    for tier in sorted({t for t, _ in sequences}, reverse=True):
        own = [k for k, (t, _) in enumerate(sequences) if t == tier]
        own.sort(key=lambda k: (-sum(x[2] ** 2 for x in sequences[k][1]), k))
        n = -(-len(own) * tier // step_tokens)
        for place, k in enumerate(own):
            lap, spot = divmod(place, n)
            groups[k] = first + (spot if lap % 2 == 0 else n - 1 - spot)
        first += n
    return groups


def pieces(docs: DataFrame, path: str, end_id: int, window: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Whole windows and rests of every document with a bucket; rests carry their ids.

    Rests go to ``buckets`` by their place in the input, whole windows, which need no partner, in runs to buckets below zero.
    """
    small = tokens(path).size <= 1 << 16

    def run(batches):
        encode, part, no, whole = tokens(path).ids, TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches, text=1):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text), end_id).astype("<u4")
                for start in range(0, len(ids), window):
                    own = ids[start : start + window]
                    full = len(own) == window
                    rows.append((doc_id, start, len(own), zlib.crc32(own.tobytes()), len(ids), None if full else own.astype("<u2" if small else "<u4").tobytes(), no, -1 - (part * RUNS + whole // RUN) if full else None))
                    no, whole = no + 1, whole + full
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "no", "run", "part"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(rows), pa.int32())], names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut_up = source.mapInArrow(released(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, no long, run long, part int")
    return cut_up.withColumn("bucket", F.coalesce("run", F.pmod(F.xxhash64("part", "no"), F.lit(buckets)))).drop("run")


def pack(docs: DataFrame, path: str | None = None, end_id: int = 0, tiers: tuple[int, ...] = TIERS, per_bucket: int = 4096, step_tokens: int = 16384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    Every id of every document lies in exactly one piece; a document's ids end with ``end_id``, so null and empty texts
    have one. A sequence is as long as its tier, but for at most one padded sequence a bucket of about ``per_bucket``
    documents' rests; whole windows of long documents are sequences of their own and never more than a run in a task's
    group. Buckets go by place in the input, not by value, so repeated rows spread. Step groups are numbered within a
    bucket: the pair (bucket, group) is one long. Columns other than the two named are ignored. An empty table gives no
    rows.
    """
    window, path = tiers[0], path or default_path()
    kind = "<u2" if tokens(path).size <= 1 << 16 else "<u4"
    buckets = max(1, -(-docs.count() // per_bucket))  # a document has one rest at most

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("part", "ascending"), ("no", "ascending")])
        first, size, crcs = (group.column(c).to_numpy() for c in ("start", "length", "ids_crc32"))
        ids, full = group.column("ids"), size == window
        rests = np.flatnonzero(~full)
        whole = [(window, [(k, 0, window)]) for k in np.flatnonzero(full).tolist()]
        packed = [(t, [(int(rests[k]), s, n) for k, s, n in sequence]) for t, sequence in pack_rests(size[rests].tolist(), tiers)]
        every = whole + packed
        groups, base = deal_steps(every, step_tokens), group.column("bucket")[0].as_py() << NUMBERS
        rows = []
        for k, (tier, sequence) in enumerate(every):
            offset = 0
            for item, start, length in sequence:
                crc = int(crcs[item]) if length == size[item] else zlib.crc32(np.frombuffer(ids[item].as_py(), kind)[start : start + length].astype("<u4").tobytes())
                rows.append((item, int(start + first[item]), int(length), crc, base + k, offset, tier, base + groups[k]))
                offset += int(length)
        items, *columns = zip(*rows)
        of = group.select(["doc_id", "doc_tokens"]).take(pa.array(items))
        starts, lengths, crc32s, sequences, offsets, tiers_of, steps = (pa.array(c, pa.int64()) for c in columns)
        return pa.Table.from_arrays([of.column(0), starts, lengths, crc32s, of.column(1), sequences, offsets, tiers_of.cast(pa.int32()), steps], names=NAMES)

    found = pieces(docs, path, end_id, window, buckets, id_col, text_col)
    return found.groupBy("bucket").applyInArrow(run, PIECE)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
