"""Ranked lexical search by an Aho-Corasick document scan: no index of the documents is built.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z alone in
lower case.  All terms of the items go into one automaton.  Each is guarded by a blank on either
side, and so is every term of a text, whose other characters are blanks: a match is a whole term, and
the matches of a text, counted, are its term frequencies.

The work is two scans.  The first passes every whole text through the automaton and writes, per
document, its number of terms and the counts of those that items ask for.  Totals over that table
(documents, terms, and documents per term) give the integer weights.  The second adds up the scores
from the counts: a task holds the k best documents of each item, passes its blocks of documents by
them and hands on at most k rows per item; a last ranking keeps the k best of those.

What is broadcast are the items' terms.  Items are searched in groups of about ``MOST_TERMS`` terms
in all, so neither a task nor the driver holds more, however many items there are; each group scans
the documents anew.  An item itself is held whole.

Defined cases: null texts have no terms; texts without terms are no documents of the counts; rows
that repeat an id are separate documents; rows without an id count, but are never ranked; rows that
repeat an item id are one item with the terms of all; items without an id or terms give no rows;
ties go to the smaller doc_id; an empty table on either side gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import documents, written

K, MOST_TERMS, CELLS, PENDING = 10, 50_000, 1 << 20, 1 << 18
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a UTF-8 text: A-Z become small letters, other ASCII characters that are neither letters nor digits blanks.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_HITS = "doc_id long, n long, terms array<int>, tfs array<long>"
_BEST = "item int, doc_id long, score long"


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Of terms between guards; the value of each is its place in the list."""
    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        found.add_word(f" {term} ", i)
    found.make_automaton()
    return found


def count_terms(text: str, scan: ahocorasick.Automaton) -> tuple[int, Counter]:
    """The number of all terms of a text, and how often each of the automaton's occurs."""
    plain = text.encode("utf-8", "replace").translate(_NORMAL)
    return len(plain.split()), Counter(map(itemgetter(1), scan.iter(f" {plain.decode()} ")))


def _scan(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = automaton(broadcast.value)
        for batch in batches:
            ns, terms, tfs = [], [], []
            for text in batch.column("text"):  # one text at a time
                n, found = count_terms(text.as_py(), scan)
                ns.append(n)
                terms.append(list(found.keys()))
                tfs.append(list(found.values()))
            columns = [batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _HITS.split(", ")])

    return run


class Best:
    """The k best (score, doc_id) of each item over blocks of documents."""

    def __init__(self, items: int, k: int):
        self.k, self.pending = k, 0
        self.floor = np.ones(items, np.int64)  # scores below can't enter any more; one above zero is the least
        self.kept = [tuple(np.zeros(0, np.int64) for _ in range(3))]

    def add(self, item: np.ndarray, doc_id: np.ndarray, score: np.ndarray) -> None:
        self.kept.append((item, doc_id, score))
        self.pending += len(item)
        if self.pending >= PENDING:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, doc_id, score = (np.concatenate(x) for x in zip(*self.kept))
        order = np.lexsort((doc_id, -score, item))
        item, doc_id, score = item[order], doc_id[order], score[order]
        starts = np.searchsorted(item, item, side="left")
        place = np.arange(len(item)) - starts
        full = place == self.k - 1
        self.floor[item[full]] = score[full]
        top = place < self.k
        self.kept, self.pending = [(item[top], doc_id[top], score[top])], 0
        return self.kept[0]


def _score(weights: np.ndarray, starts: np.ndarray, owners: np.ndarray, items: int, k: int):
    """Over rows (doc_id, m, terms, tfs): the k best documents of each item.  ``owners[starts[t]:starts[t + 1]]`` are the items of term t."""
    rows = max(1, CELLS // max(1, items))  # documents whose scores for all items are held at once

    def block(ids, m, lengths, terms, tfs, best: Best) -> None:
        doc = np.repeat(np.arange(len(ids)), lengths)
        share = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
        times = starts[terms + 1] - starts[terms]
        at = np.repeat(starts[terms] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        cell = np.repeat(doc * items, times) + owners[at]
        shares, total = np.repeat(share, times), np.zeros(len(ids) * items, np.int64)
        np.add.at(total, cell, shares)
        d, i = np.nonzero(total.reshape(len(ids), items) >= best.floor)
        best.add(i, ids[d], total[d * items + i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, k)
        for whole in batches:
            for lo in range(0, len(whole), rows):
                part = whole.slice(lo, rows)
                terms, tfs = part.column("terms"), part.column("tfs")
                block(part.column("doc_id").to_numpy(), part.column("m").to_numpy(), terms.value_lengths().to_numpy(), terms.flatten().to_numpy(), tfs.flatten().to_numpy(), best)
        item, doc_id, score = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], [c.split()[0] for c in _BEST.split(", ")])

    return run


def _terms(text) -> F.Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))


def search(docs: DataFrame, items: DataFrame, k: int = K, most_terms: int = MOST_TERMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above zero for each item."""
    spark = docs.sparkSession
    asked = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.explode(_terms(F.col(item_text))).alias("term")).distinct()
    groups = max(1, -(-asked.count() // most_terms))  # one number
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = spark.createDataFrame([], f"doc_id long, score long, item_id {dict(asked.dtypes)['item_id']}")
    best = reduce(DataFrame.unionByName, [_search_group(spark, texts, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g), k) for g in range(groups)], none)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_group(spark: SparkSession, texts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    rows = asked.collect()  # about MOST_TERMS
    if not rows:
        return asked.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"), "item_id").limit(0)
    terms = sorted({r.term for r in rows})
    ids = sorted({r.item_id for r in rows})
    term_at, item_at = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(ids)}
    owners: list[list[int]] = [[] for _ in terms]
    for r in rows:
        owners[term_at[r.term]].append(item_at[r.item_id])
    starts = np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64)
    hits = written(texts.mapInArrow(_scan(spark.sparkContext.broadcast(terms)), _HITS), "term-hits")
    n_docs, n_terms = hits.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = hits.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()  # a number for each term at most
    df = np.zeros(len(terms), np.int64)
    for r in held:
        df[r.t] = r.df
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    m = F.expr(f"CAST(100 - 90 + ((CAST(90 AS DECIMAL(4,0)) * CAST(n AS DECIMAL(15,0)) * CAST({n_docs} AS DECIMAL(15,0))) div {max(1, n_terms)}) AS BIGINT)")  # the product may pass 64 bits
    ranked = hits.where("doc_id IS NOT NULL AND size(terms) > 0").select("doc_id", m.alias("m"), "terms", "tfs")
    best = ranked.mapInArrow(_score(weights, starts, np.array([i for x in owners for i in x], np.int64), len(ids), k), _BEST)
    names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {dict(asked.dtypes)['item_id']}")  # as many as items in a group
    return best.join(F.broadcast(names), "item").drop("item")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH asked AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark WHERE item_id IS NOT NULL),
docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS_SQL} AS terms FROM documents),
sized AS (SELECT row, doc_id, len(terms) AS n FROM docs),
total AS (SELECT count(*) FILTER (WHERE n > 0) AS docs, coalesce(sum(n), 0)::BIGINT AS terms FROM sized),
hits AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) JOIN (SELECT DISTINCT term FROM asked) USING (term) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * max(t.docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM hits, total t GROUP BY term),
share AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * t.docs) // t.terms))) AS part
  FROM hits JOIN weight USING (term) JOIN sized USING (row), total t
),
scores AS (SELECT item_id, row, doc_id, CAST(sum(part) AS BIGINT) AS score FROM share JOIN asked USING (term) WHERE doc_id IS NOT NULL GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
