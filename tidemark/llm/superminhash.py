"""Near-duplicates by SuperMinHash signatures, banding, verification on full sets and union-find grouping.

A document is its set of distinct 4-word shingles (64-bit hashes; fewer words: the whole sequence as
one).  Two documents are linked at a Jaccard similarity of 0.8 or more.

Signatures: an element's values are not independent, as in plain MinHash: step j of a random
permutation of the m slots, drawn for each element, puts j plus a random fraction into the slot that
it deals out.  An element's ranks over the slots are thus a permutation, which lowers the estimate's
variance for sets of any size.  Once every slot of a set holds less than j + 1, no later step can
change one and the set is done: a set of n elements takes about m ln(m) / n steps.  Steps run over
the elements of many documents at once.

Bands: 50 bands of 5 rows; a pair at similarity 0.8 shares none with probability (1 - 0.8^5)^50 =
2e-9, at 0.9 1e-19.  Equal sets are one node and are never compared.

Verification, which never forms the pairs of a bucket:

1.  Each bucket is a star: its members meet the member that shares most buckets with others, the
    most central text.  Pairs are verified on their full sets in the JVM, each once, and components
    formed.  Groups of copies of one text end here, whatever their size.
2.  Buckets in which more than one component is left are compared in blocks, without their centres.
    A cluster of such buckets is taken whole where that copies fewer sets than bucket by bucket.
    A block pair is one task: it counts the shared shingles of all pairs at once as a product of
    membership matrices and hands on at most one link for each two components.  No pair of a bucket
    is left untested unless its ends are already in one component, so no link is lost.

Components settle by alternating stars over distributed edges (``components``); a document's class is
the smallest doc_id reachable.

Defined cases: null, empty or blank texts have no shingles and are linked with nothing: each is its
own class; rows that repeat are one node; texts under one doc_id are linked with each other; rows
without an id take no part in links and have a null class; an empty table gives none; columns besides
id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, documents, texts, written
from tidemark.llm.components import components

WIDTH, BANDS, ROWS, SHARE, BLOCK = 4, 50, 5, 80, 256
SLOTS = BANDS * ROWS
_ELEMENTS, _SLAB = 1 << 17, 4096
_U = np.uint64
_PRINT = "doc_id long, n long, hi long, lo long, buckets array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer over 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes in ascending order; only A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=_U, count=len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, _U)
    for i in range(width):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` (at most 256) values, step and fraction in one number, for each set that isn't empty."""
    sig = np.full((len(sets), slots), np.iinfo(np.uint64).max, _U)
    todo = [(i, s[lo : lo + _ELEMENTS]) for i, s in enumerate(sets) for lo in range(0, len(s), _ELEMENTS)]
    at = 0
    while at < len(todo):
        end, size = at, 0
        while end < len(todo) and (end == at or size + len(todo[end][1]) <= _ELEMENTS):
            size += len(todo[end][1])
            end += 1
        _sign([i for i, _ in todo[at:end]], [s for _, s in todo[at:end]], sig)
        at = end
    return sig


def _sign(owners: list[int], parts: list[np.ndarray], sig: np.ndarray) -> None:
    """Lower the signatures of ``owners`` by the elements of their parts, until no later step can change them."""
    slots, flat = sig.shape[1], sig.reshape(-1)
    h, owner = np.concatenate(parts), np.repeat(np.array(owners, np.int64), [len(p) for p in parts])
    row, mine = np.arange(len(h)), np.unique(owner)
    deal = np.empty((len(h), slots), np.uint8)  # of each element, what is left of its permutation
    deal[:] = np.arange(slots, dtype=np.uint8)
    for j in range(slots):
        x = _mix(h + _U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        k = j + (((x & _U(0xFFFFFFFF)) * _U(slots - j)) >> _U(32)).astype(np.int64)
        slot = deal[row, k]
        deal[row, k] = deal[row, j]
        np.minimum.at(flat, owner * slots + slot, (_U(j) << _U(32)) | (x >> _U(32)))
        open_ = np.zeros(len(sig), bool)
        open_[mine] = sig[mine].max(axis=1) >= _U(j + 1) << _U(32)
        left = open_[owner]
        if not left.all():
            h, owner, row = h[left], owner[left], row[left]
            mine = mine[open_[mine]]
            if not len(mine):
                return


def buckets(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One number for each band of each signature; the band is part of it."""
    rows = sig.reshape(len(sig), bands, -1)
    out = np.broadcast_to(np.arange(bands, dtype=_U), rows.shape[:2]).copy()
    for i in range(rows.shape[2]):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + rows[:, :, i])
    return out


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, len(whole), 256):  # sets of few documents at once
            batch = whole.slice(lo, 256)
            sets = [shingle_set(t.as_py()) for t in batch.column("text")]
            ids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            halves = np.frombuffer(b"".join(ids), "<i8").reshape(-1, 2)
            keys = buckets(signatures(sets)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
            columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), lists]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PRINT.split(", ")])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            found = [shingle_set(t.as_py()).view(np.int64) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between components of the rows of a block pair: one for each two components that a pair at the threshold joins."""
    sets, comp, block = pdf["shingles"].tolist(), pdf["comp"].to_numpy(), pdf["block"].to_numpy()
    sizes = np.array([len(s) for s in sets], np.int64)
    owner, values = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    _, at, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[at] > 1
    owner, at = owner[shared], np.unique(at[shared], return_inverse=True)[1] if shared.any() else at[shared]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, int(at.max(initial=-1)) + 1, _SLAB):
        a, b = np.searchsorted(at, [lo, lo + _SLAB])
        member = np.zeros((len(sets), _SLAB), np.float32)
        member[owner[a:b], at[a:b] - lo] = 1
        both += member @ member.T  # whole numbers of at most _SLAB: exact
    union = sizes[:, None] + sizes[None, :] - both
    ok = (100 * both >= SHARE * union) & (comp[:, None] < comp[None, :])
    if pdf["i"].iat[0] != pdf["j"].iat[0]:
        ok &= block[:, None] != block[None, :]
    x, y = np.nonzero(ok)
    return pd.DataFrame({"a": comp[x], "b": comp[y]}).drop_duplicates()


def _clusters(rows: DataFrame) -> DataFrame:
    """(grp, node, comp, size) of rows (bucket, node, comp): to be compared within grp, a bucket or a whole cluster of buckets, whichever copies fewer sets."""
    over = W.partitionBy("bucket")
    rows = cut(rows.withColumns({"g": F.count("*").over(over), "head": F.min("node").over(over)}))
    named = components(rows.select("head", "node"), "head", "node")
    rows = cut(rows.join(named, "node", "left").withColumn("cluster", F.coalesce("component", "node")).drop("component", "head"))
    copies = lambda n: F.col(n) * F.ceil(F.col(n) / BLOCK)
    members = rows.select("cluster", "node", "comp").distinct()
    cost = rows.groupBy("cluster").agg(F.sum(copies("g")).alias("apart")).join(members.groupBy("cluster").agg(F.count("*").alias("size")), "cluster")
    whole = cost.withColumn("whole", copies("size") <= F.col("apart")).select("cluster", "size", "whole")
    one = members.join(whole.where("whole"), "cluster").select(F.xxhash64(F.lit("cluster"), "cluster").alias("grp"), "node", "comp", "size")
    many = rows.join(whole.where("NOT whole"), "cluster").select(F.col("bucket").alias("grp"), "node", "comp", F.col("g").alias("size"))
    return one.unionByName(many)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    rows = texts(docs, id_col, text_col)
    prints = written(rows.mapInArrow(_prints, _PRINT), "superminhash")
    known = prints.where("doc_id IS NOT NULL AND n > 0")
    nodes = known.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.any_value("buckets").alias("buckets"))
    filed = nodes.select("node", F.explode("buckets").alias("bucket"))
    common = filed.groupBy("bucket").agg(F.count("*").alias("g"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket", "g")
    shared = cut(filed.join(common, "bucket").select("bucket", "node", "g"))
    # 1. stars around the most central member of each bucket
    central = shared.groupBy("node").agg(F.sum("g").alias("weight"))
    centres = shared.join(central, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("centre"))
    starred = cut(shared.join(centres, "bucket"))
    pairs = starred.where("node <> centre").select("centre", "node").distinct()
    wanted = shared.select(F.col("node").alias("doc_id")).distinct()
    sets = written(rows.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "node long, shingles array<long>").where(F.size("shingles") > 0), "shingle-sets")
    met = pairs.join(sets, "node").withColumnRenamed("shingles", "own").join(sets.withColumnRenamed("node", "centre"), "centre")
    met = met.withColumn("both", F.size(F.array_intersect("own", "shingles")))
    links = met.where(100 * F.col("both") >= SHARE * (F.size("own") + F.size("shingles") - F.col("both"))).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    place = known.join(nodes.select("hi", "lo", "node"), ["hi", "lo"]).select("doc_id", "node").withColumn("a", F.min("node").over(W.partitionBy("doc_id")))
    links = links.unionByName(place.where("a <> node").select("a", F.col("node").alias("b")))  # texts under one id
    first = components(cut(links))
    # 2. what is left in buckets of more than one component, without the centres, which have met everyone
    rest = starred.where("g > 2 AND node <> centre").select("bucket", "node").join(first, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp"))
    open_ = rest.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("bucket")
    groups = _clusters(rest.join(open_, "bucket"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = groups.withColumns({"block": F.pmod(F.xxhash64("node"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    dealt = dealt.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp")
    more = dealt.join(sets, "node").groupBy("grp", "i", "j").applyInPandas(_linked, "a long, b long")
    last = components(cut(more).unionByName(first.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    named = nodes.select("hi", "lo", "node").join(last, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("class"))
    out = prints.join(named, ["hi", "lo"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op12_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP12_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')))) AS s FROM worded WHERE len(w) > 0
),
nodes AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM sets GROUP BY s),
items AS (SELECT node, n, unnest(s) AS x FROM nodes),
pairs AS (
  SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT node AS node, node AS other FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
class AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id LEFT JOIN nodes n ON n.s = s.s LEFT JOIN class c ON c.node = n.node
"""
