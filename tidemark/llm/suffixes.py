"""Removal of long repeats by bucket-pointer refinement of suffixes, sorted to a fixed depth.

A byte goes if a string of ``length`` (50) bytes that covers it also starts in a document with a
smaller doc_id.  Suffixes need sorting to that depth only, and only where a repeat is possible:

1. Texts are dealt once to chunks of bounded size by a hash of doc_id (one exchange, reused).
   In each window of 50 bytes the 24-gram with the least hash is its anchor, chosen by content
   alone, so equal windows have equal anchors.  Each chunk sends each anchor's bucket once.
2. Buckets (initial q-gram buckets) that hold one document only are final and are dropped here.
3. For the others the chunk cuts out the contexts of their windows; equal contexts of a chunk go
   as one.  Whole copies of a document are found by their SHA-256 and need no contexts.
4. Within each bucket suffixes are refined: buckets of 8 bytes, then sorted by the pair of bucket
   pointers at offsets 0 and 8 (16 bytes), 0 and 16 (32 bytes), 0 and 18 (50 bytes); every round
   reuses the pointers that the round before has updated.  A window goes if its final bucket
   has a document with a smaller id.
5. Intervals return to the chunks, which cut the bytes.

Nothing is compared pair by pair; a bucket that more than ``hot`` chunks share is split further by
the windows' whole content before it is refined, so that no group grows with a hot passage's
contexts.  A chunk is the most that one Python worker holds; its size follows the counted bytes (8 MB
up to 128 GB, then 1 / 16384 of them, 256 MB at most), as fragments grow with the square of their number.

Defined cases: null or empty text has no bytes; texts shorter than 50 bytes lose nothing; a null
doc_id takes no part, neither as a copy nor as an original; rows with an equal doc_id don't remove
each other's bytes; equal texts keep the one with the smallest id; an empty table gives none.
In the text output a character goes only if all its bytes do.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, partitions_for, texts

LENGTH, GRAM, CHUNK, MOST_CHUNKS, MOST_CHUNK, HOT = 50, 24, 8 << 20, 1 << 14, 256 << 20, 512
_SPAN = LENGTH - GRAM + 1  # grams in a window
_BITS = 20
_PIECE = (1 << _BITS) - 64
_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD))


def _wide(buffer: bytes, n: int) -> np.ndarray:
    """The 8-byte words at each of the first n positions, without a copy."""
    return np.ndarray((n,), dtype="<u8", buffer=buffer, strides=(1,))


def anchors(buffer: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts joined to one buffer (at most 2^20 bytes) that end at ``ends``: runs of windows with one anchor,
    as (44-bit anchor hash, first window, number of windows)."""
    n = len(buffer) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none
    grams = len(buffer) - GRAM + 1
    h = _wide(buffer, grams) * _M1
    h ^= h >> np.uint64(29)
    h += _wide(buffer[8:], grams) * _M2
    h ^= h >> np.uint64(31)
    h *= _M3
    h += _wide(buffer[16:], grams) * _M4
    h ^= h >> np.uint64(32)
    h *= _M2
    low = np.uint64((1 << _BITS) - 1)
    h = (h & ~low) | np.arange(grams, dtype=np.uint64)
    m, width = h, 1
    while width * 2 <= _SPAN:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[:n], m[_SPAN - width : _SPAN - width + n])
    valid = np.ones(n, dtype=bool)
    for e in ends[:-1]:  # no window crosses the end of a text
        valid[max(0, e - LENGTH + 1) : e] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return none.astype(np.uint64), none, none
    own = m[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return own[first] >> np.uint64(_BITS), at[first], np.diff(np.append(first, len(at)))


def _runs(raws: list[bytes]):
    """(text number, hash, first window in the text, windows) of all texts, piece by piece."""
    batch, size = [], 0

    def flush():
        lens = np.array([len(b) for _, _, b in batch])
        ends = np.cumsum(lens)
        h, at, n = anchors(b"".join(b for _, _, b in batch), ends)
        which = np.searchsorted(ends, at, side="right")
        text = np.array([i for i, _, _ in batch])[which]
        base = np.array([o for _, o, _ in batch]) - (ends - lens)
        return text, h, at + base[which], n

    for i, raw in enumerate(raws):
        if len(raw) < LENGTH:
            continue
        for lo in range(0, len(raw) - LENGTH + 1, _PIECE - LENGTH + 1):
            piece = raw[lo : lo + _PIECE]
            if size + len(piece) > _PIECE:
                yield flush()
                batch, size = [], 0
            batch.append((i, lo, piece))
            size += len(piece)
    if batch:
        yield flush()


def _bucketed(h: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | rest of the hash."""
    b = h % np.uint64(buckets)
    return (b << np.uint64(32)) | ((h // np.uint64(buckets)) & np.uint64(0xFFFFFFFF))


def _raws(table: pa.Table, column: str) -> list[bytes]:
    return [x or b"" for x in table.column(column).to_pylist()]


def _sends(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Of a chunk: each anchor once, told apart by whether two documents of the chunk have it."""

    def run(table: pa.Table) -> pa.Table:
        p, docs, raws = table.column("_tm_p")[0].as_py(), table.column("_tm_id").to_numpy(), _raws(table, "_tm_raw")
        keys, owners = [], []
        for text, h, _, _ in _runs(raws):
            keys.append(_bucketed(h, buckets))
            owners.append(docs[text])
        rows: dict[str, list] = {"b": [], "p": [], "one": [], "many": []}
        if keys:
            k, o = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(k, kind="stable")
            k, o = k[order], o[order]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            many = np.maximum.reduceat(o, first) != np.minimum.reduceat(o, first)
            k = k[first]
            b = (k >> np.uint64(32)).astype(np.int64)
            rest = (k & np.uint64(0xFFFFFFFF)).astype("<u4")
            cut = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            for lo, hi in zip(cut, np.append(cut[1:], len(b))):
                m = many[lo:hi]
                rows["b"].append(int(b[lo]))
                rows["p"].append(p)
                rows["one"].append(rest[lo:hi][~m].tobytes())
                rows["many"].append(rest[lo:hi][m].tobytes())
        return pa.table([pa.array(rows["b"], pa.int64()), pa.array(rows["p"], pa.int64()), pa.array(rows["one"], pa.binary()), pa.array(rows["many"], pa.binary())], ["b", "p", "one", "many"])

    return run


def _shares(hot: int) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket: the anchors that two documents have, for each chunk; those of over ``hot`` chunks apart."""

    def run(table: pa.Table) -> pa.Table:
        b, ps = table.column("b")[0].as_py(), table.column("p").to_numpy()
        rest, chunk, many = [], [], []
        for i, (one, two) in enumerate(zip(table.column("one").to_pylist(), table.column("many").to_pylist())):
            for raw, flag in ((one, False), (two, True)):
                x = np.frombuffer(raw, "<u4")
                rest.append(x)
                chunk.append(np.full(len(x), i, dtype=np.int32))
                many.append(np.full(len(x), flag))
        r, c, m = np.concatenate(rest), np.concatenate(chunk), np.concatenate(many)
        order = np.argsort(r, kind="stable")
        r, c, m = r[order], c[order], m[order]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(r)))
        shared = (n > 1) | (np.logical_or.reduceat(m, first) if len(r) else np.zeros(0, bool))
        keep = np.repeat(shared, n)
        warm = np.repeat(n > hot, n)[keep]
        r, c = r[keep], c[keep]
        order = np.argsort(c, kind="stable")
        r, c, warm = r[order], c[order], warm[order]
        ids = (np.uint64(b) << np.uint64(32)) | r.astype(np.uint64)
        cut = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else []
        out: list[list] = [[], [], []]
        for lo, hi in zip(cut, np.append(cut[1:], len(c)) if len(c) else []):
            out[0].append(int(ps[c[lo]]))
            out[1].append(ids[lo:hi].tobytes())
            out[2].append(ids[lo:hi][warm[lo:hi]].tobytes())
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["p", "shared", "warm"])

    return run


def _ordinals(docs: list[int], raws: list[bytes]) -> list[int]:
    """Numbers that tell the different texts of one doc_id apart: 0 for nearly all. A chunk has all rows of an id."""
    marks, of = [xxhash.xxh64_intdigest(x) for x in raws], defaultdict(set)
    for d, m in zip(docs, marks):
        of[d].add(m)
    place = {(d, m): k for d, ms in of.items() for k, m in enumerate(sorted(ms))}
    return [place[x] for x in zip(docs, marks)]


_CONTEXT = [("g", pa.int64()), ("key", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("p", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("context", pa.binary())]


def _contexts(buckets: int, groups: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a chunk: the contexts of windows whose anchor is shared.  A row without context says that its windows are
    settled already."""

    def run(table: pa.Table, side: pa.Table) -> pa.Table:
        rows: list[list] = [[] for _ in _CONTEXT]
        if not len(table):
            return pa.table([pa.array(r, t) for r, (_, t) in zip(rows, _CONTEXT)], [n for n, _ in _CONTEXT])
        p = table.column("_tm_p")[0].as_py()
        docs, raws = table.column("_tm_id").to_numpy().copy(), _raws(table, "_tm_raw")
        copies = defaultdict(set)
        for doc, sha in zip(side.column("copy").to_pylist(), side.column("sha").to_pylist()):
            if doc is not None:
                copies[doc].add(sha)
        shared = np.sort(np.frombuffer(b"".join(x for x in side.column("shared").to_pylist() if x), "<u8"))
        warm = set(np.frombuffer(b"".join(x for x in side.column("warm").to_pylist() if x), "<u8").tolist())
        order = np.argsort(docs, kind="stable")  # the smallest document of a chunk comes first
        docs, raws = docs[order], [raws[i] for i in order]
        marks = _ordinals(docs.tolist(), raws)
        seen: dict = {}

        def row(key: int, i: int, first: int, n: int, context: bytes | None) -> None:
            group = (int(docs[i]) if context is None else key) % groups  # what is settled needs no group and is spread
            for column, value in zip(rows, (group, key >> 1, int(docs[i]), marks[i], p, first, n, context)):
                column.append(value)

        # an id may have other texts besides the copied one
        whole = [len(x) >= LENGTH and d in copies and hashlib.sha256(x).hexdigest() in copies[d] for d, x in zip(docs.tolist(), raws)]
        for i in np.flatnonzero(whole):
            row(0, i, 0, len(raws[i]) - LENGTH + 1, None)
        for text, h, first, n in _runs([b"" if w else x for w, x in zip(whole, raws)] if len(shared) else []):
            keys = _bucketed(h, buckets)
            place = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
            for j in np.flatnonzero(shared[place] == keys).tolist():
                i, lo, count, key = int(text[j]), int(first[j]), int(n[j]), int(keys[j])
                context = raws[i][lo : lo + count + LENGTH - 1]
                have = seen.setdefault((key, context), docs[i])
                if have != docs[i]:  # a smaller document of this chunk has all these windows
                    row(key, i, lo, count, None)
                elif key in warm:
                    for w in range(count):
                        window = context[w : w + LENGTH]
                        known = seen.setdefault(window, docs[i]) != docs[i]
                        row(xxhash.xxh64_intdigest(window), i, lo + w, 1, None if known else window)
                else:
                    row(key, i, lo, count, context)
        return pa.table([pa.array(r, t) for r, (_, t) in zip(rows, _CONTEXT)], [n for n, _ in _CONTEXT])

    return run


def _pointers(values: np.ndarray) -> np.ndarray:
    """Bucket pointers: the rank of each value among the distinct ones."""
    return np.unique(values, return_inverse=True)[1].astype(np.uint64)


def refine(contexts: list[bytes], counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each window of each context in order: whether a smaller document has the same 50 bytes."""
    buffer = b"".join(contexts)
    lens = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    starts = np.repeat(np.cumsum(lens) - lens - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    owner = np.repeat(docs, counts)
    n = len(buffer)
    p8 = _pointers(_wide(buffer + b"\0" * 8, n))
    half = np.uint64(32)
    p16 = _pointers((p8[: n - 8] << half) | p8[8:])
    p32 = _pointers((p16[: n - 24] << half) | p16[16:])
    p50 = _pointers((p32[starts] << half) | p32[starts + 18]).astype(np.int64)
    least = np.full(int(p50.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, p50, owner)
    return owner > least[p50]


def _equal(rows: list[int], contexts: list, keys: np.ndarray, docs: np.ndarray) -> tuple[list[int], list[int]]:
    """Of rows by bucket and document: those whose whole context a smaller document has, and those of buckets in which
    different contexts remain, which alone need refining."""
    keys, docs = keys.tolist(), docs.tolist()
    settled, rest, bucket, first, key = [], [], [], {}, None
    for i in [*rows, None]:
        if i is None or keys[i] != key:
            if len(first) > 1:
                rest += bucket
            if i is None:
                break
            key, bucket, first = keys[i], [], {}
        if first.setdefault(contexts[i], docs[i]) < docs[i]:
            settled.append(i)
        else:
            bucket.append(i)
    return settled, rest


_FOUND = [("p", pa.int64()), ("doc", pa.binary()), ("mark", pa.binary()), ("first", pa.binary()), ("n", pa.binary())]


def _refines(limit: int = 1 << 21) -> Callable[[pa.Table], pa.Table]:
    """Of a group of buckets: runs of windows to remove, for each chunk."""

    def run(table: pa.Table) -> pa.Table:
        done = pc.is_null(table.column("context")).to_numpy()
        cols = {c: table.column(c).to_numpy() for c in ("key", "doc", "mark", "p", "first", "n")}
        out = [[cols[c][done]] for c in ("p", "doc", "mark", "first", "n")]
        contexts = table.column("context").to_pylist()
        open_ = np.flatnonzero(~done)
        open_ = open_[np.lexsort((cols["doc"][open_], cols["key"][open_]))]
        settled, rest = _equal(open_.tolist(), contexts, cols["key"], cols["doc"])
        for o, c in zip(out, ("p", "doc", "mark", "first", "n")):
            o.append(cols[c][settled])
        open_ = np.array(rest, dtype=np.int64)
        key = cols["key"][open_]
        edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)
        at = 0
        while at < len(edges) - 1:  # whole buckets together, up to a limit of bytes
            stop, size = at, 0
            while stop < len(edges) - 1 and (stop == at or size < limit):
                size += sum(len(contexts[i]) for i in open_[edges[stop] : edges[stop + 1]])
                stop += 1
            rows = open_[edges[at] : edges[stop]]
            at = stop
            if len(np.unique(cols["doc"][rows])) < 2:
                continue
            counts = cols["n"][rows]
            hit = refine([contexts[i] for i in rows], counts, cols["doc"][rows])
            which = np.repeat(np.arange(len(rows)), counts)
            first = cols["first"][rows][which] + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
            new = hit.copy()
            new[1:] &= ~(hit[:-1] & (which[1:] == which[:-1]))
            begin = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            n = np.bincount(run_of[hit], minlength=len(begin)) if len(begin) else np.zeros(0, np.int64)
            row = rows[which[begin]]
            for o, c in zip(out, (cols["p"][row], cols["doc"][row], cols["mark"][row], first[begin], n)):
                o.append(c)
        p, doc, mark, first, n = (np.concatenate(o).astype("<i8") for o in out)
        order = np.argsort(p, kind="stable")
        p = p[order]
        cut = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.zeros(0, np.int64)
        packed: list[list] = [[] for _ in _FOUND]
        for lo, hi in zip(cut, np.append(cut[1:], len(p))):
            packed[0].append(int(p[lo]))
            for o, c in zip(packed[1:], (doc, mark, first, n)):
                o.append(c[order[lo:hi]].tobytes())
        return pa.table([pa.array(r, t) for r, (_, t) in zip(packed, _FOUND)], [name for name, _ in _FOUND])

    return run


def _covers(found: pa.Table) -> dict:
    """(doc, mark) -> [(first byte, end)] of removed bytes."""
    out = defaultdict(list)
    cols = [np.frombuffer(b"".join(found.column(c).to_pylist()), "<i8").tolist() for c in ("doc", "mark", "first", "n")]
    for doc, mark, first, n in zip(*cols):
        out[doc, mark].append((first, first + n - 1 + LENGTH))
    return out


def removed(raw: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
    """Mask of removed bytes."""
    edge = np.zeros(len(raw) + 1, dtype=np.int32)
    for lo, hi in spans:
        edge[lo] += 1
        edge[hi] -= 1
    return np.cumsum(edge[:-1]) > 0


def whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The mask without characters of which some bytes stay."""
    if not len(raw):
        return gone
    lead = (raw & 0xC0) != 0x80
    lead[0] = True
    first = np.flatnonzero(lead)
    every = np.logical_and.reduceat(gone, first)
    return np.repeat(every, np.diff(np.append(first, len(raw))))


def _report(table: pa.Table, found: pa.Table) -> pa.Table:
    covers = _covers(found)
    rows: list[list] = [[], [], [], [], []]
    docs, raws = table.column("_tm_id").to_pylist(), _raws(table, "_tm_raw")
    for doc, raw, mark in zip(docs, raws, _ordinals(docs, raws)):
        spans = covers.get((doc, mark), [])
        gone = removed(raw, spans)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
        for column, value in zip(rows, (doc, len(raw), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest())):
            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(r, t) for r, t in zip(rows, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept_texts(columns: list[str], text_col: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The rows of a chunk as they came but for the removed characters."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        covers, out = _covers(found), []
        docs, raws = table.column("_tm_id").to_pylist(), _raws(table, "_tm_raw")
        for doc, raw, mark in zip(docs, raws, _ordinals(docs, raws)):
            if spans := covers.get((doc, mark)):
                data = np.frombuffer(raw, np.uint8)
                raw = data[~whole_characters(data, removed(raw, spans))].tobytes()
            out.append(raw.decode("utf-8", "replace"))
        return pa.table([pa.array(out, pa.string()) if c == text_col else table.column(c) for c in columns], columns)

    return run


def _plan(docs: DataFrame, id_col: str, text_col: str, chunk: int | None, hot: int) -> tuple[DataFrame, DataFrame]:
    """(rows with an id dealt to chunks, their texts as bytes; runs of windows to remove for each chunk).

    ``dealt`` is used three times with all its columns, so that Spark reuses one exchange."""
    rest = [F.col(c) for c in docs.columns if c != text_col]
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(*rest, F.col(id_col).cast("long").alias("_tm_id"), raw.alias("_tm_raw")).where("_tm_id IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("_tm_raw"))).first()[0] or 0
    parts = partitions_for(docs.sparkSession)
    chunk = chunk or min(MOST_CHUNK, max(CHUNK, total // MOST_CHUNKS))
    chunks = max(parts, -(-total // chunk))
    buckets, groups = max(parts, chunks // 4), max(parts, 2 * chunks)
    dealt = rows.withColumn("_tm_p", F.pmod(F.xxhash64("_tm_id"), F.lit(chunks)))
    sent = dealt.groupBy("_tm_p").applyInArrow(_sends(buckets), "b long, p long, one binary, many binary")
    shared = sent.groupBy("b").applyInArrow(_shares(hot), "p long, shared binary, warm binary")
    digests = dealt.select("_tm_id", "_tm_p", F.sha2("_tm_raw", 256).alias("sha"))
    least = digests.groupBy("sha").agg(F.min("_tm_id").alias("least"), F.max("_tm_id").alias("most")).where("least < most").select("sha", "least")
    copies = digests.join(least, "sha").where("_tm_id > least").select(F.col("_tm_p").alias("p"), F.col("_tm_id").alias("copy"), "sha")
    none = F.lit(None).cast("binary")
    side = shared.withColumns({"copy": F.lit(None).cast("long"), "sha": F.lit(None).cast("string")}).unionByName(copies.select("p", none.alias("shared"), none.alias("warm"), "copy", "sha"))
    contexts = dealt.groupBy("_tm_p").cogroup(side.groupBy("p")).applyInArrow(_contexts(buckets, groups), "g long, key long, doc long, mark long, p long, first long, n long, context binary")
    found = contexts.groupBy("g").applyInArrow(_refines(), "p long, doc binary, mark binary, first binary, n binary")
    return dealt, found


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    docs = texts(docs, id_col, text_col)
    dealt, found = _plan(docs, "doc_id", "text", chunk, hot)
    out = dealt.groupBy("_tm_p").cogroup(found.groupBy("p")).applyInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    unnamed = docs.where("doc_id IS NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return out.unionByName(unnamed)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int | None = None, hot: int = HOT) -> DataFrame:
    """``docs`` with the repeated passages cut out of the texts, whole characters only."""
    dealt, found = _plan(docs, id_col, text_col, chunk, hot)
    kept = dealt.groupBy("_tm_p").cogroup(found.groupBy("p")).applyInArrow(_kept_texts(docs.columns, text_col), docs.schema)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))
