"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of length n belongs to the reciprocal class k = capacity // n and takes one of the k
equal slots of a bin; a bin of class k is closed with exactly k pieces.  Each worker fills its
own bins, so the main path has no shuffle.  A document is cut where that saves padding: full
sequences first, and then, as long as the rest would waste more than ``waste`` of its slot, a
piece that fills a slot of the next class exactly.  Rests of up to 32 tokens fit their slot
exactly and are never cut.

What is left in a worker's open bins (less than k pieces of class k) meets that of up to
``merge`` other workers: there bins are filled by class again, and the last open bins, whose
size no longer depends on the input, are packed first-fit decreasing.

Defined cases: null or empty text is the end id alone; equal rows are packed each; a null
doc_id is packed like any other; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, texts, written
from tidemark.llm.tokenizers_fast import byte_bpe

CAPACITY, END_ID = 1024, 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, klass int, worker int"
#: Sequence ids: the worker's number (or, for merged rests, its group's) above these bits.
SEQUENCE_BITS = 36


def cuts(n: int, capacity: int = CAPACITY, waste: float = 1 / 32) -> list[tuple[int, int]]:
    """(length, class) of each piece of a document of n tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        if slot - rest <= slot * waste:
            out.append((rest, k))
            break
        piece = capacity // (k + 1)
        out.append((piece, k + 1))
        rest -= piece
    return out


class _Bins:
    """Open bins by class; ``put`` returns a bin's pieces when it is full."""

    def __init__(self):
        self.open = defaultdict(list)

    def put(self, klass: int, piece) -> list | None:
        have = self.open[klass]
        have.append(piece)
        if len(have) < klass:
            return None
        return self.open.pop(klass)


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "klass", "worker"]
    kinds = [pa.int64()] * 7 + [pa.int32()] * 2
    cols = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


def _laid(pieces: list[tuple], sequence: int, klass: int, worker: int) -> list[tuple]:
    out, at = [], 0
    for p in pieces:
        out.append((*p[:5], sequence, at, klass, worker))
        at += p[2]
    return out


def packer(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker = byte_bpe(path).encode_ordinary, TaskContext.get().partitionId()
        bins, closed = _Bins(), worker << SEQUENCE_BITS
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py())
                ids.append(end_id)
                raw, start, n = np.array(ids, dtype="<u4").tobytes(), 0, len(ids)
                for length, klass in cuts(n, capacity):
                    crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                    if full := bins.put(klass, (doc_id, start, length, crc, n)):
                        rows += _laid(full, closed, klass, worker)
                        closed += 1
                    start += length
            if rows:
                yield _frame(rows)
        yield _frame([(*p, None, None, klass, worker) for klass, have in bins.open.items() for p in have])

    return run


def _merge(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """The rests of a group of workers: by class, then first-fit decreasing."""
    sequence = (1 << 62) + (int(group["g"].iloc[0]) << SEQUENCE_BITS)
    out, last, bins = [], [], _Bins()
    rows = group.sort_values(["klass", "worker", "doc_id", "start"])
    for p in rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "klass"]].astype(object).itertuples(index=False):
        if full := bins.put(p[5], tuple(p[:5])):
            out += _laid(full, sequence, p[5], -1)
            sequence += 1
    left = sorted((p for have in bins.open.values() for p in have), key=lambda p: -p[2])
    open_bins: list[list] = []
    for p in left:
        for b in open_bins:
            if b[0] + p[2] <= capacity:
                b[0] += p[2]
                b[1].append(p)
                break
        else:
            open_bins.append([p[2], [p]])
    for _, have in open_bins:
        last += _laid(have, sequence, 0, -1)
        sequence += 1
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "klass", "worker"]
    return pd.DataFrame(out + last, columns=names).astype({n: "Int64" for n in names[:7]})


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    merge: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    pieces = written(texts(docs, id_col, text_col).mapInArrow(packer(path, capacity, end_id), PIECES), "pieces")
    rests = pieces.where("sequence_id IS NULL").withColumn("g", F.floor(F.col("worker") / merge).cast("long"))
    merged = rests.groupBy("g").applyInPandas(lambda pdf: _merge(pdf, capacity), PIECES)
    return pieces.where("sequence_id IS NOT NULL").unionByName(merged).drop("klass", "worker")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
