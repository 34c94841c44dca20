"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has 64 bits: bit b is 1 where more than half of the XXH64 values
(seed 42) of its 3-word shingles have bit b set.  Two fingerprints are linked at Hamming
distance 2 or less.

Covering tables for radius r = 2: each bit position i gets a non-zero vector m(i) of r + 1 = 3
bits, and each of the 2^3 - 1 = 7 non-zero vectors v gives a mask that keeps the bits with
<m(i), v> = 1.  The at most two differing bits span at most two dimensions, so some v is
orthogonal to both and that table's masked values are equal: every pair within the radius
collides in some table, with certainty.

Fingerprints that share a bucket are verified without forming the bucket's pairs: within the
bucket each is filed under itself and its neighbours by one of the bits that the table's mask
leaves out, as the others are equal there.  Two members meet in such a cell exactly if they differ
in at most two bits, so each cell links its members to its smallest one.  A table's cell belongs to
one bucket only.  The work is linear in the members, whatever the size of a bucket.

Defined cases: null or empty text has fingerprint zero and is linked like any other; fewer
than three words make one shingle of the whole sequence; repeated shingles count again;
a null doc_id takes no part in links and keeps a null component; repeated rows stay repeated;
columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, documents, texts, written
from tidemark.llm.components import components

BITS, RADIUS, SEED = 64, 2, 42


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask (unsigned) per non-zero vector of radius + 1 bits."""
    full = 1 << (radius + 1)
    marks = [1 + i % (full - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (marks[i] & v).bit_count() % 2) for v in range(1, full)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, width: int = 3, block: int = 1 << 16) -> int:
    """The unsigned 64-bit SimHash of a text; memory is bounded by ``block`` shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.zeros(len(words), dtype=np.int64)
    np.cumsum(lens[:-1] + 1, out=starts[1:])
    ends = (starts + lens)[min(width, len(words)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for lo in range(0, n, block):
        hi = min(n, lo + block)
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.fromiter(map(fingerprint, batch.column("text").to_pylist()), dtype=np.uint64, count=len(batch))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long."""
    return texts(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between the node ids of (fp, node), fp unique, at distance 2 or less."""
    masks = covering_masks()
    tables = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "bucket")
    filed = fps.select("fp", "node", tables)
    shared = filed.groupBy("t", "bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("t", "bucket")
    members = cut(filed.join(shared, ["t", "bucket"]).select("t", "fp", "node"))
    left_out = F.array(*[F.array(*[F.lit(f).cast("long") for f in (0, *(_signed(1 << i) for i in range(BITS) if not m >> i & 1))]) for m in masks])
    cells = members.select("t", "fp", "node", F.explode(F.element_at(left_out, F.col("t") + 1)).alias("flip")).select("t", "node", F.col("fp").bitwiseXOR(F.col("flip")).alias("cell"))
    least = cells.groupBy("t", "cell").agg(F.min("node").alias("a"), F.max("node").alias("hi")).where("a < hi").select("t", "cell", "a")
    return cells.join(least, ["t", "cell"]).where("node > a").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the least doc_id reachable."""
    fps = written(fingerprints(docs, id_col, text_col), "simhash")
    nodes = fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"))
    found = components(links(nodes))
    labels = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(labels, "fp", "left").select("doc_id", "fp", F.expr("IF(doc_id IS NULL, NULL, component_id)").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the least doc_id."""
    gone = near_duplicates(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("_tm_gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("_tm_gone"), "left_anti")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
