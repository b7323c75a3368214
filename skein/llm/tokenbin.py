"""Training-order materialisation of token sequences.

Every sequence has an index: its input partition and its place there. A keyed Feistel network permutes the indexes: on the
smallest even number of bits that holds them all, walking along its cycle until a value below their number appears. A
sequence's slot in training order is the number of sequences whose image is smaller. Images are spread evenly, so tasks take
ranges of them, sort their own, and write them as shards: files of ``per_shard`` records of one stride, the last of a range
shorter. How many records each range has is known when all are written and kept beside them, so slot s lies at a place that a
reader finds without an index of the records, and it resumes at any slot. Nothing but the shuffle holds the ids in between.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import released, shared_dir, slices, table
from skein.llm.tokens import default_path, tokens
from skein.plans.lineage import one_machine

END = 50256
PARTS, PLACES = 1 << 24, 3 << 37  # input partitions, and sequences of one, that an index has room for
NO_ID = -(1 << 63)
RANGE_BYTES = 256 << 20  # of records that one task writes, at most
DIGEST = "slot long, shard string, byte_offset long, doc_id long, start long, length long, record_crc32 long"


def round_keys(key: str, rounds: int) -> list[np.uint64]:
    return [np.uint64(int.from_bytes(hashlib.sha256(f"{key}/{k}".encode()).digest()[:8], "little")) for k in range(rounds)]


def feistel(index: np.ndarray, n: int, key: str, rounds: int = 6) -> np.ndarray:
    """The slots of ``index`` (values below ``n``) under the permutation of 0..n-1 that ``key`` names."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift, keys = np.uint64((1 << half) - 1), np.uint64(half), round_keys(key, rounds)
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> shift, out[walking] & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            left, right = right, left ^ (mixed & mask)
        out[walking] = (left << shift) | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, path: str, key: str, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(image, doc_id, start, n, ids): the ids of each document and ``end_id``, cut into windows; ids as stored, unpadded."""
    kind = "<u2" if tokens(path).size <= 1 << 16 else "<u4"

    def run(batches):
        encode, part, no = tokens(path).ids, TaskContext.get().partitionId(), 0
        if part >= PARTS:
            raise ValueError(f"more than {PARTS} partitions")
        for batch in slices(batches, text=1):
            doc, start, size, own = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text), end_id).astype(kind)
                for s in range(0, len(ids), length):
                    piece = ids[s : s + length]
                    doc.append(doc_id)
                    start.append(s)
                    size.append(len(piece))
                    own.append(piece.tobytes())
            images = feistel(part * PLACES + np.arange(no, no + len(doc)), PARTS * PLACES, key)
            no += len(doc)
            yield pa.RecordBatch.from_arrays([pa.array(images), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(own, pa.binary())], ["image", "doc_id", "start", "n", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(run), "image long, doc_id long, start long, n long, ids binary")


def write_order(docs: DataFrame, out: str, path: str | None = None, key: str = "epoch-0", length: int = 512, per_shard: int = 4096, end_id: int = END, pad_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Write the sequences of ``docs`` in training order to the folder ``out``; return what ``order.json`` holds.

    ``out`` is a folder that pyarrow and every executor can reach: an address, or a plain path in local mode. A shard is
    ``shard-RRRRRR-KKKKKK.bin``, the K-th of range R, records of ``length`` ids padded with ``pad_id``, and beside it the same
    name with ``.idx``, for each record doc_id, start and length as three 64-bit numbers. A file appears under its name only
    when it is whole, so a task that runs again replaces it by the same bytes; ``order.json`` is written last.

    Null and empty texts are one sequence of ``end_id``; texts count whole; repeated rows are sequences of their own; a
    null id is written as the least long; an empty table gives a description and no shards; columns other than the two
    named are ignored. The order depends on ``key`` and on how the input is split, so ``docs`` should be read from files or
    a checkpoint: then a task that runs again finds the same rows.
    """
    path, spark = path or default_path(), docs.sparkSession
    width = 2 if tokens(path).size <= 1 << 16 else 4
    fs, base = _files(out)
    if "://" not in out and not out.startswith("file:") and not one_machine(spark):
        raise ValueError(f"{out} is a path on each executor's own disk; name a shared folder by its address")
    fs.create_dir(base, recursive=True)
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("bytes")).first()
    about_bytes = (size["n"] + (size["bytes"] or 0) // (4 * length)) * length * width  # four bytes make an id, or so
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), about_bytes // RANGE_BYTES)
    placed = sequences(docs, path, key, length, end_id, id_col, text_col)
    target = F.least((F.col("image") * (ranges / (PARTS * PLACES))).cast("int"), F.lit(ranges - 1))  # rises with the image
    rows = placed.repartitionById(ranges, target).sortWithinPartitions("image")
    pad = pad_id.to_bytes(width, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _files(out)
        part, no, shard = TaskContext.get().partitionId(), 0, None
        for batch in slices(batches, rows=2048):
            about = np.stack([pc.fill_null(batch.column(k), NO_ID).to_numpy(zero_copy_only=False) for k in (1, 2, 3)], axis=1).astype("<i8")
            for k, ids in enumerate(batch.column(4).to_pylist()):
                if no % per_shard == 0:
                    if shard:
                        shard.finish()
                    shard = Shard(fs, base, part, no // per_shard)
                shard.add(ids + pad * (length - len(ids) // width), about[k].tobytes())
                no += 1
        if shard:
            shard.finish()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([no])], ["range", "n"])

    written = rows.mapInArrow(released(write), "range long, n long").collect()  # a row a range
    counts = [0] * ranges
    for r in written:
        counts[r["range"]] = r["n"]
    about = {"sequences": sum(counts), "length": length, "bytes_per_id": width, "per_shard": per_shard, "ranges": counts}
    with fs.open_output_stream(f"{base}/order.json") as f:
        f.write(json.dumps(about).encode())
    return about


def shard_name(part: int, number: int) -> str:
    return f"shard-{part:06d}-{number:06d}"


class Shard:
    """A shard and its index under other names until both are whole."""

    def __init__(self, fs: pafs.FileSystem, base: str, part: int, number: int):
        self.fs, task, name = fs, TaskContext.get().taskAttemptId(), shard_name(part, number)
        self.names = [(f"{base}/_partial-{task}-{name}.{x}", f"{base}/{name}.{x}") for x in ("bin", "idx")]
        self.streams = [fs.open_output_stream(own) for own, _ in self.names]

    def add(self, record: bytes, about: bytes) -> None:
        self.streams[0].write(record)
        self.streams[1].write(about)

    def finish(self) -> None:
        for stream, (own, name) in zip(self.streams, self.names):
            stream.close()
            if self.fs.get_file_info(name).type != pafs.FileType.NotFound:  # of a task that was lost later; some stores don't replace
                self.fs.delete_file(name)
            self.fs.move(own, name)


def _files(out: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(out) if "://" in out or out.startswith("file:") else (pafs.LocalFileSystem(), out)


def read_about(out: str) -> dict:
    fs, base = _files(out)
    with fs.open_input_stream(f"{base}/order.json") as f:
        return json.loads(f.read())


def read_order(out: str, slot: int = 0, rows: int = 64) -> Iterator[np.ndarray]:
    """Batches of at most ``rows`` sequences in training order from ``slot`` on, read front to back."""
    fs, base = _files(out)
    about = read_about(out)
    stride, kind, per_shard = about["length"] * about["bytes_per_id"], f"<u{about['bytes_per_id']}", about["per_shard"]
    for part, count in enumerate(about["ranges"]):
        if slot >= count:
            slot -= count
            continue
        for number in range(slot // per_shard, -(-count // per_shard)):
            with fs.open_input_file(f"{base}/{shard_name(part, number)}.bin") as f:
                f.seek(slot % per_shard * stride)
                while data := f.read(rows * stride):
                    yield np.frombuffer(data, kind).reshape(-1, about["length"])
            slot = 0
        slot = 0


def written_records(spark: SparkSession, out: str) -> DataFrame:
    """What lies in the shards of ``out``, read front to back: a row a sequence, with the CRC-32 of its padded record."""
    about = read_about(out)
    stride, per_shard = about["length"] * about["bytes_per_id"], about["per_shard"]
    counts = np.array(about["ranges"], np.int64)
    before = np.cumsum(counts) - counts

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _files(out)
        for part in (x for batch in batches for x in batch.column(0).to_pylist()):
            for number in range(-(-int(counts[part]) // per_shard)):
                name, first = shard_name(part, number), 0
                with fs.open_input_stream(f"{base}/{name}.bin") as data, fs.open_input_stream(f"{base}/{name}.idx") as index:
                    while own := data.read(1024 * stride):
                        n = len(own) // stride
                        of = np.frombuffer(index.read(24 * n), "<i8").reshape(n, 3)
                        places = np.arange(first, first + n)
                        crcs = [zlib.crc32(own[k : k + stride]) for k in range(0, len(own), stride)]
                        ids = pa.array(of[:, 0], mask=of[:, 0] == NO_ID)
                        columns = [pa.array(before[part] + number * per_shard + places), pa.array([name] * n), pa.array(places * stride), ids, pa.array(of[:, 1]), pa.array(of[:, 2]), pa.array(crcs, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in DIGEST.split(", ")])
                        first += n

    return spark.range(0, len(counts), 1, max(1, min(len(counts), 10_000))).mapInArrow(released(read), DIGEST)


def op3_token_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the shards that it writes to a new folder in the shared one; the folder stays, the result reads it."""
    out = f"{shared_dir(spark)}/token-order-{uuid4().hex}"
    write_order(table(spark, sf_dir, "documents"), out)
    return written_records(spark, out)
