"""Byte-level BPE by folding ranked merges over the distinct words of a table.

Texts are split into words by the tokenizer's pattern, and each distinct word of an input partition is encoded once, so
nothing is shuffled. A fold keeps the ids of a word and, for each neighbouring pair, the rank of what the pair would make;
it merges the leftmost pair of the lowest rank until no pair makes a token. Ranks come from a literal map from pairs of ids,
laid out as arrays so that a lookup is three reads. Decoding joins the pieces of the ids.

``encode`` folds with Spark's higher-order functions. They take about 16 microseconds a word, too much for large tables, so
``encode_digest`` folds many words side by side in numpy, by the same rule and map.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import released, slices, table
from skein.llm.tokens import SPLIT, default_path, read_file

NONE = 2**31 - 1  # no merge
PLACE = 31  # bits for a place in a word, as many as an array can have


@functools.cache
def ranks_of(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, read_file(path).splitlines()) if a}


@functools.cache
def pieces_of(path: str) -> list[bytes]:
    ranks = ranks_of(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, k in ranks.items():
        out[k] = piece
    return out


@functools.cache
def pair_table(path: str) -> tuple[list[int], list[int], list[int]]:
    """(offsets, lefts, ranks): every pair of tokens that makes a token, as a sparse matrix with its rows laid over each other.

    The rank of a pair stands at offsets[left] + right, if ``lefts`` has the left token there. Long rows go to the
    first place where they fit, then short ones to the first place of a fixed random sequence.
    """
    ranks = ranks_of(path)
    size = max(ranks.values()) + 1
    rows: dict[int, list[tuple[int, int]]] = {}
    for t, rank in ranks.items():
        for k in range(1, len(t)):
            if t[:k] in ranks and t[k:] in ranks:
                rows.setdefault(ranks[t[:k]], []).append((ranks[t[k:]], rank))
    total = sum(map(len, rows.values()))
    used = np.zeros(4 * (size + total), bool)
    lefts, made, offsets = np.full(len(used), -1), np.full(len(used), NONE), np.full(size, -2 * len(used))
    draw, end = np.random.default_rng(0), size + 2 * total
    for left in sorted(rows, key=lambda x: (-len(rows[x]), x)):
        rights, values = np.array(sorted(rows[left])).T
        shape = rights - rights[0]
        start, spots = 0, np.zeros(0, np.int64)
        while not len(spots):
            if len(rights) > 8:
                spots, start = start + np.flatnonzero(~used[start : start + 4096]), start + 4096
            else:
                spots = draw.integers(0, end - size, 64)
            for k in range(0, len(shape), 16):  # most places fail within the first few
                spots = spots[~used[spots[:, None] + shape[k : k + 16]].any(axis=1)]
        at = int(spots[0]) - rights[0]
        offsets[left] = at
        used[at + rights], lefts[at + rights], made[at + rights] = True, left, values
    end = int(np.flatnonzero(used)[-1]) + 1 if total else 0
    return offsets.tolist(), lefts[:end].tolist(), made[:end].tolist()


def literal(numbers: list[int]) -> Column:
    """A literal array of ints; the optimizer folds the text into one value."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_words(words: Column, path: str) -> Column:
    """array<array<int>> of ids for an array of words, each an array of its bytes (0 to 255).

    The state of a fold is an array of longs: the rank of what a token makes with the next one, then its own id.
    """
    ranks = ranks_of(path)
    offsets, lefts, made = pair_table(path)
    width = max(8, max(ranks.values()).bit_length())
    mask = (1 << width) - 1
    single = literal([ranks[bytes([b])] for b in range(256)])

    def with_table(table: Column) -> Column:
        def entry(own: Column, after: Column) -> Column:
            at = F.get(table["offsets"], own) + after
            rank = F.when(F.get(table["lefts"], at) == own, F.get(table["ranks"], at)).otherwise(F.lit(NONE))
            return F.shiftleft(rank.cast("bigint"), width).bitwiseOR(own)

        def id_at(state: Column, at: Column) -> Column:
            return F.get(state, at).bitwiseAND(mask).cast("int")

        def merge(state: Column, low: Column, at: Column) -> Column:
            fewer = F.filter(state, lambda _, i: i != at + 1)
            return F.transform(fewer, lambda x, i: F.when(i == at, entry(low, id_at(state, at + 2))).when(i == at - 1, entry(id_at(state, at - 1), low)).otherwise(x))

        def step(state: Column, _: Column) -> Column:
            lowest = F.array_min(F.transform(state, lambda x, i: F.shiftleft(F.shiftright(x, width), PLACE).bitwiseOR(i)))  # of the lowest rank, the leftmost
            merged = lambda low: bound(low.bitwiseAND((1 << PLACE) - 1).cast("int"), lambda at: merge(state, F.shiftright(low, PLACE).cast("int"), at))
            return bound(lowest, lambda low: F.when(low >= NONE << PLACE, state).otherwise(merged(low)))

        def fold(word: Column) -> Column:
            ids = F.transform(word, lambda b: F.get(single, b.cast("int")))
            start = bound(ids, lambda ids: F.transform(ids, lambda x, i: entry(x, F.get(ids, i + 1))))
            rounds = F.sequence(F.lit(1), F.greatest(F.size(word) - 1, F.lit(1)))
            folded = F.when(F.size(word) < 2, start).otherwise(F.aggregate(rounds, start, step))
            return F.transform(folded, lambda x: x.bitwiseAND(mask).cast("int"))

        return F.transform(words, fold)

    named = {"offsets": offsets, "lefts": lefts, "ranks": made}
    return bound(F.struct(*[literal(v).alias(k) for k, v in named.items()]), with_table)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold for one long word, with a heap of pairs instead of a scan a round."""
    import heapq

    n = len(word)
    stop, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[word[k : k + 2]], k, k + 2) for k in range(n - 1) if word[k : k + 2] in ranks]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, at, end = heapq.heappop(heap)
        after = right[at]
        if gone[at] or after >= n or stop[after] != end or stop[at] != after:
            continue
        gone[after], stop[at], right[at] = 1, end, right[after]
        if right[at] < n:
            left[right[at]] = at
        for first, last in ((left[at], end), (at, stop[right[at]] if right[at] < n else 0)):
            if first >= 0 and last and (rank := ranks.get(word[first:last])) is not None:
                heapq.heappush(heap, (rank, first, last))
    return [ranks[word[k : stop[k]]] for k in range(n) if not gone[k]]


def fold_batch(words: list[bytes], single: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, how many each has): the fold of many short words, side by side.

    Words are the rows of a matrix of ids beside one of the ranks of neighbouring pairs; each round merges the leftmost
    pair of the lowest rank of every row that has one.
    """
    offsets, lefts, ranks = table

    def rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = offsets[left] + right
        known = (right >= 0) & (at >= 0) & (at < len(lefts))
        at = np.where(known, at, 0)
        return np.where(known & (lefts[at] == left), ranks[at], NONE)

    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts, flat = np.cumsum(sizes) - sizes, single[np.frombuffer(b"".join(words), np.uint8)]
    counts, out = np.zeros(len(words), np.int64), np.full(len(flat), -1, np.int32)  # a word's ids need no more room than its bytes
    order = np.argsort(sizes, kind="stable")
    for at in range(0, len(order), 8192):
        rows = order[at : at + 8192]
        wide = max(1, int(sizes[rows[-1]]))
        cells = np.arange(wide)
        inside = cells < sizes[rows, None]
        ids = np.where(inside, np.append(flat, single[:1])[np.minimum(starts[rows, None] + cells, len(flat))], -1)
        near = np.full(ids.shape, NONE, np.int32)
        near[:, :-1] = rank(ids[:, :-1], ids[:, 1:])
        near[ids < 0] = NONE
        while len(rows):
            first = near.argmin(axis=1)
            low = near[np.arange(len(rows)), first]
            done = low == NONE
            if done.any():
                own, ended = ids[done], rows[done]
                full = own >= 0
                counts[ended] = full.sum(axis=1)
                out[(starts[ended, None] + cells[: own.shape[1]])[full]] = own[full]
                rows, ids, near, first, low = rows[~done], ids[~done], near[~done], first[~done], low[~done]
                if not len(rows):
                    break
            line, cells = np.arange(len(rows)), np.arange(ids.shape[1])
            take = np.minimum(cells[:-1] + (cells[:-1] > first[:, None]), ids.shape[1] - 1)
            ids, near = np.take_along_axis(ids, take, 1), np.take_along_axis(near, take, 1)
            ids[line, first] = low
            after = np.where(first + 1 < ids.shape[1], ids[line, np.minimum(first + 1, ids.shape[1] - 1)], -1)
            near[line, first] = rank(low, after)
            has = first > 0
            near[line[has], first[has] - 1] = rank(ids[line[has], first[has] - 1], low[has])
    return out[out >= 0], counts


class Places(dict):
    """A place for each word, given when it is first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(path: str, pattern: str, dictionary: int, long_word: int):
    """mapInArrow body: rows (doc_id, text) to one row a document; each distinct word of a partition is folded once.

    The dictionary starts anew when it has more than ``dictionary`` words. Decoding joins the pieces of the ids.
    """
    table = tuple(np.array(x, np.int32) for x in pair_table(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pieces = ranks_of(path), pieces_of(path)
        texts_of, single = [str(k) for k in range(len(pieces))], np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        find, places, names, sizes, decoded = regex.compile(pattern).findall, Places(), [], [], []
        for batch in slices(batches, text=1):
            if len(places) > dictionary:
                places, names, sizes, decoded = Places(), [], [], []
            had, wheres = len(places), []
            for text in batch.column(1).to_pylist():
                wheres.append(list(map(places.__getitem__, find(text))) if text else [])
            new = [w.encode() for w in itertools.islice(places, had, None)]
            flat, counts = fold_batch([b"" if len(w) > long_word else w for w in new], single, table) if new else ([], [])
            flat, at = list(flat), 0
            for word, n in zip(new, counts):
                ids = flat[at : at + n] if n else merge_long(word, ranks)
                at += n
                names.append(" ".join([texts_of[i] for i in ids]))
                sizes.append(len(ids))
                decoded.append(b"".join([pieces[i] for i in ids]))
            n_of, rows = np.array(sizes, np.int64), []
            for own in wheres:
                ids = hashlib.sha256(" ".join([names[w] for w in own]).encode()).hexdigest()
                rows.append((int(n_of[own].sum()) if own else 0, ids, hashlib.sha256(b"".join([decoded[w] for w in own])).hexdigest()))
            n, ids, back = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digest(docs: DataFrame, path: str | None = None, pattern: str = SPLIT, dictionary: int = 300_000, long_word: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, over whole texts.

    Null and empty texts have no ids (the digests are of nothing). Words of more than ``long_word`` bytes are merged with
    a heap instead, by the same rule. Repeated rows come back repeated; an empty table gives no rows.
    """
    path = path or default_path("byte_bpe_50k.tiktoken")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(released(digest(path, pattern, dictionary, long_word)), DIGEST)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) with the fold in Spark's higher-order functions over the distinct words of a row; null texts have no ids."""
    path = path or default_path("byte_bpe_50k.tiktoken")

    def words(frames):
        find = regex.compile(SPLIT).findall
        for frame in frames:
            found = [find(t or "") for t in frame.pop("text")]
            known = [{w: k for k, w in enumerate(dict.fromkeys(words))} for words in found]
            frame["words"] = [[list(w.encode()) for w in words] for words in known]
            frame["places"] = [[of[w] for w in words] for words, of in zip(found, known)]
            yield frame

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(released(words), "doc_id string, words array<array<smallint>>, places array<int>")
    return rows.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), bound(fold_words(F.col("words"), path), lambda folded: F.flatten(F.transform("places", lambda k: F.get(folded, k)))).alias("ids"))


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes of an array of ids, by joining the pieces."""
    pieces = literal_pieces(path or default_path("byte_bpe_50k.tiktoken"))
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def literal_pieces(path: str) -> Column:
    return F.split(F.lit(",".join(p.hex() for p in pieces_of(path))), ",")


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"))
