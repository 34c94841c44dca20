"""Texts as media: whole texts stored as lossless WebP pixels, read back and described.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the red, green, blue and
alpha samples of an image 16 pixels wide.  Images of more than 256 rows are stored as a WebP file
with one frame for each strip of 256 rows, so that a very long text is many small streams.  The
files are written as a table in the shared folder and read back from there; both steps are narrow
maps over Arrow batches without a shuffle.

Defined cases: null or empty text is 64 zero bytes; equal texts give equal files, whatever else is in
the batch; any bytes can be stored (content without a fitting code set is written with 8-bit codes); an
empty table gives none; other columns are ignored; a damaged file raises.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import webp
from tidemark.llm.common import documents, texts, written

UNIT, WIDTH, ROWS, TOGETHER = 64, 16, 256, 2 << 20
_SWAP = [2, 1, 0, 3]  # samples stand as R, G, B, A in the payload and as B, G, R, A in a pixel's bytes


def payload(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % UNIT if raw else UNIT)


def strips(data: bytes) -> list[np.ndarray]:
    """argb images of at most ROWS rows."""
    pixels = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, 4)[:, _SWAP]).view(np.uint32).reshape(-1, WIDTH)
    return [pixels[lo : lo + ROWS] for lo in range(0, len(pixels), ROWS)]


def _batches(items: list, sizes: list[int]) -> Iterator[list]:
    """Runs of items of TOGETHER bytes or one item more."""
    run, size = [], 0
    for item, n in zip(items, sizes):
        run.append(item)
        size += n
        if size >= TOGETHER:
            yield run
            run, size = [], 0
    if run:
        yield run


def store(payloads: list[bytes]) -> list[bytes]:
    """A WebP file for each payload."""
    out = []
    for run in _batches(payloads, [len(x) for x in payloads]):
        images = [strips(x) for x in run]
        streams = iter(webp.encode_many([s for x in images for s in x]))
        out += [webp.wrap([next(streams) for _ in x], WIDTH, [len(s) for s in x]) for x in images]
    return out


def load(files: list[bytes]) -> list[bytes]:
    """The payload of each file."""
    out = []
    for run in _batches(files, [2 * len(x) for x in files]):
        streams = [webp.unwrap(x) for x in run]
        images = iter(webp.decode_many([s for x in streams for s in x]))
        for x in streams:
            pixels = np.concatenate([next(images).reshape(-1) for _ in x])
            out.append(np.ascontiguousarray(pixels.view(np.uint8).reshape(-1, 4)[:, _SWAP]).tobytes())
    return out


def feature(data: bytes) -> str:
    """Rows, sum of samples, samples that aren't zero, those of 128 or more, distinct ones, and neighbours in a row that are equal."""
    x = np.frombuffer(data, np.uint8)
    count = np.bincount(x, minlength=256)
    same = int((x.reshape(-1, UNIT)[:, 4:] == x.reshape(-1, UNIT)[:, :-4]).sum())
    return f"rows={len(x) // UNIT};sum={int((count * np.arange(256)).sum())};nonzero={len(x) - int(count[0])};high={int(count[128:].sum())};distinct={int((count > 0).sum())};equal={same}"


def _stores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws = [x.as_py().encode("utf-8") for x in batch.column("text")]
        files = store([payload(x) for x in raws])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in raws], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = batch.column("media").to_pylist()
        back = load(files)
        columns = [
            batch.column("doc_id"),
            batch.column("n_bytes"),
            pa.array([len(x) for x in back], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in back]),
            pa.array([zlib.crc32(x[-UNIT:]) for x in back], pa.int64()),
            pa.array([len(x) for x in files], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in files]),
            pa.array([feature(x) for x in back]),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a WebP file."""
    return texts(docs, id_col, text_col).mapInArrow(_stores, "doc_id long, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of (doc_id, n_bytes, media), from the pixels read back."""
    return media.mapInArrow(_loads, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(written(media_column(documents(spark, sf_dir)), "media"))
