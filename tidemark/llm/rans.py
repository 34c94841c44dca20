"""Token-id files coded by a static range asymmetric numeral system.

Format.  A token file is a folder of three Parquet tables in the shared folder:
``table`` (one row: the shared frequency table, 2^20 in total, one entry per id),
``blocks`` (part, block, first, doc_ids, lens, payload) and ``parts`` (part, n_ids).
Documents stand in ascending doc_id order by part, block and place.  ``payload`` is
self-contained: a header (magic, crc32 of the table, number of segments, crc32 of the rest)
and segments of at most 2^16 ids.  Each segment is a checkpoint: its own number of ids,
number of words, crc32 of its ids, the states of 1024 interleaved lanes and the 32-bit
words, so that segments decode independently and in parallel.  A block ends with a document.

Counts for the table cover all documents; only one row per id of the vocabulary comes to the
driver.  Every step is a narrow map over Arrow batches but for one range partitioning by
doc_id, so a lost executor costs a recomputation of its tasks alone.

Defined cases: null or empty text is the end id alone; rows with equal doc_id follow each other
in any order; a null doc_id sorts first; an empty table gives an empty file; other columns are
ignored; a wrong checksum raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, new_path, partitions_for, texts, written
from tidemark.llm.tokenizers_fast import word_bpe

END_ID, SCALE, LANES, SEGMENT, BLOCK = 1, 20, 1024, 1 << 16, 1 << 16
RANGE = 1 << 27  # ids of a range, one file each
_LOW = np.uint64(1 << 31)
_HEAD, _SEGMENT = struct.Struct("<4sIII"), struct.Struct("<III")


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2^scale: at least 1 for each id that occurs, 0 for the rest."""
    total, want = int(counts.sum()), 1 << scale
    if not total:
        return counts.astype(np.uint32)
    if int((counts > 0).sum()) > want:
        raise ValueError("more ids than the scale has places")
    freq = np.where(counts > 0, np.maximum(1, counts.astype(object) * want // total).astype(np.int64), 0)
    order = np.argsort(-freq, kind="stable")
    rest = want - int(freq.sum())
    freq[order[0]] += max(rest, 0)
    for i in order:  # too many forced ones: the most frequent give way
        if rest >= 0:
            break
        less = min(-rest, int(freq[i]) // 2)
        freq[i] -= less
        rest += less
    return freq.astype(np.uint32)


class Table:
    def __init__(self, raw: bytes):
        self.crc = zlib.crc32(raw)
        freq = np.frombuffer(raw, dtype="<u4")
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.most = int(np.argmax(freq)) if len(freq) else 0
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


@lru_cache(maxsize=4)
def table(raw: bytes) -> Table:
    return Table(raw)


def encode_segment(ids: np.ndarray, t: Table) -> bytes:
    """ids (uint32, at most SEGMENT) as one checkpointed segment."""
    n = len(ids)
    rows = -(-n // LANES)
    padded = np.full(rows * LANES, t.most, dtype=np.int64)
    padded[:n] = ids
    grid = padded.reshape(rows, LANES)
    freq, cum = t.freq[grid], t.cum[grid]
    if not freq.all():
        raise ValueError("an id has no frequency")
    limit = freq << np.uint64(63 - SCALE)
    x, out = np.full(LANES, _LOW, dtype=np.uint64), []
    scale, half = np.uint64(SCALE), np.uint64(32)
    for r in range(rows - 1, -1, -1):
        over = x >= limit[r]
        out.append(x[over].astype("<u4"))
        x = np.where(over, x >> half, x)
        q, rest = np.divmod(x, freq[r])
        x = (q << scale) + rest + cum[r]
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    return _SEGMENT.pack(n, len(words), zlib.crc32(ids.astype("<u4").tobytes())) + x.astype("<u8").tobytes() + words.tobytes()


def decode_segment(data: memoryview, at: int, t: Table) -> tuple[np.ndarray, int]:
    n, n_words, crc = _SEGMENT.unpack_from(data, at)
    at += _SEGMENT.size
    x = np.frombuffer(data, "<u8", LANES, at).astype(np.uint64)
    at += 8 * LANES
    words = np.frombuffer(data, "<u4", n_words, at).astype(np.uint64)
    rows, used = -(-n // LANES), 0
    ids = np.empty((rows, LANES), dtype=np.uint32)
    mask, scale, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for r in range(rows):
        place = x & mask
        s = t.symbol[place]
        ids[r] = s
        x = t.freq[s] * (x >> scale) + place - t.cum[s]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << half) | words[used : used + len(low)]
        used += len(low)
    found = ids.reshape(-1)[:n].astype("<u4")
    if used != n_words or zlib.crc32(found.tobytes()) != crc:
        raise ValueError("a segment's checksum is wrong")
    return found, at + 4 * n_words


def encode_block(ids: np.ndarray, t: Table) -> bytes:
    parts = [encode_segment(ids[lo : lo + SEGMENT], t) for lo in range(0, len(ids), SEGMENT)]
    body = b"".join(parts)
    return _HEAD.pack(b"TRNS", t.crc, len(parts), zlib.crc32(body)) + body


def decode_block(payload: bytes, t: Table) -> np.ndarray:
    magic, of_table, n, crc = _HEAD.unpack_from(payload)
    data = memoryview(payload)
    if magic != b"TRNS" or of_table != t.crc or zlib.crc32(data[_HEAD.size :]) != crc:
        raise ValueError("not a block of this table, or damaged")
    at, out = _HEAD.size, []
    for _ in range(n):
        ids, at = decode_segment(data, at, t)
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def _tokens(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = word_bpe(path)
        end = np.array([end_id], dtype=engine.dtype).tobytes()
        for batch in batches:
            ids = [engine.encode(x.as_py()) + end for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _counts(dtype: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype)
            total += np.bincount(ids, minlength=size)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int64()), pa.array(total[have])], ["id", "n"])

    return run


_BLOCKS = "part int, block int, first long, doc_ids array<long>, lens array<long>, payload binary"


def _blocks(raw_table: bytes, dtype: str):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part = table(raw_table), TaskContext.get().partitionId()
        block = first = size = 0
        names, lens, have = [], [], []

        def made() -> pa.RecordBatch:
            ids = np.concatenate(have).astype("<u4")
            row = [[part], [block], [first], [names], [lens], [encode_block(ids, t)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(x.as_py(), dtype)
                names.append(doc_id)
                lens.append(len(ids))
                have.append(ids)
                size += len(ids)
                if size >= BLOCK:
                    yield made()
                    block, first, size = block + 1, first + size, 0
                    names, lens, have = [], [], []
        if names:
            yield made()

    return run


def write_token_file(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Write the token file of ``docs`` and return its folder."""
    spark = docs.sparkSession
    source = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    path = path or new_path(spark, "tokens")
    engine = word_bpe(source)
    dtype, size = engine.dtype.str, max(engine.tok.get_vocab_size(), end_id + 1)
    ids = written(texts(docs, id_col, text_col).mapInArrow(_tokens(source, end_id), "doc_id long, ids binary"), "ids")
    counts = np.zeros(size, dtype=np.int64)
    for row in ids.mapInArrow(_counts(dtype, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row per id
        counts[row["id"]] = row["n"]
    raw = scaled(counts).astype("<u4").tobytes()
    spark.createDataFrame([(bytearray(raw),)], "freq binary").coalesce(1).write.parquet(f"{path}/table")
    ranges = max(partitions_for(spark), -(-int(counts.sum()) // RANGE))  # by the counted ids; the rows of one id may fill several
    tie = F.xxhash64("ids").alias("tie")
    ordered = ids.withColumn("tie", tie).repartitionByRange(ranges, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ordered.mapInArrow(_blocks(raw, dtype), _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum(F.expr("aggregate(lens, 0L, (a, x) -> a + x)")).alias("n_ids"))
    parts.coalesce(1).write.parquet(f"{path}/parts")
    return path


def _decoded(raw_table: bytes, offsets: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(raw_table)
        for batch in batches:
            names, starts, ns, crcs = [], [], [], []
            for row in batch.to_pylist():
                data = memoryview(decode_block(row["payload"], t).tobytes())
                at, base = 0, offsets[row["part"]] + row["first"]
                for doc_id, n in zip(row["doc_ids"], row["lens"]):
                    names.append(doc_id)
                    starts.append(base + at)
                    ns.append(n)
                    crcs.append(zlib.crc32(data[4 * at : 4 * (at + n)]))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (names, starts, ns, crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files alone."""
    raw = bytes(spark.read.parquet(f"{path}/table").first()["freq"])
    parts = sorted((r["part"], r["n_ids"]) for r in spark.read.schema("part int, n_ids long").parquet(f"{path}/parts").collect())  # one row per file
    offsets = dict(zip([p for p, _ in parts], accumulate([n for _, n in parts], initial=0)))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    return blocks.mapInArrow(_decoded(raw, offsets), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_rans_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_file(spark, write_token_file(documents(spark, sf_dir)))
