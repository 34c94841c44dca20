"""Ranked lexical search against a plain loop over documents and items."""

import math
import re
from collections import Counter

from tidemark.llm import lexical

SF = "/root/testdata/sf0.001"
TERM = re.compile(lexical.TERM)
DOCS = "doc_id long, text string, item_id string, term string, n int, score string"


def _terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def _ranked(docs, items, k=10):
    """docs: (doc_id, text) rows; items: (item_id, text) rows."""
    docs = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for i, text in items:
        if i is not None:
            wanted.setdefault(i, set()).update(_terms(text))
    out = []
    for item, terms in wanted.items():
        found = []
        for doc_id, c in docs:
            if doc_id is None:
                continue
            m = 10 + 90 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, doc_id))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


def _got(df):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_whole_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = _ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert _got(lexical.op11_lexical_search(spark, SF)) == want
    assert _got(lexical.search(docs, items, most_terms=100)) == want  # several groups of items


def test_odd_cases(spark):
    rows = [
        (1, "Alpha beta, ALPHA-gamma"), (2, "alpha"), (2, "alpha"), (3, None), (4, ""), (5, " \n.,"), (None, "alpha beta"), (6, "Ärger ärger 汉字 x汉字 alphabet"),
        (7, "beta " * 30000 + "gamma"), (8, "a\u0000b beta\u007fgamma"), (9, "gamma gamma"), (10, "gamma gamma"),
    ]
    items = [(1, "alpha"), (2, "Beta gamma beta"), (3, None), (4, "..."), (5, "Ärger 汉字 nothing"), (None, "alpha"), (6, "gamma"), (6, "beta"), (7, "a b")]
    docs = spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in rows], DOCS)
    asked = spark.createDataFrame([(i, t, 1, "s") for i, t in items], "item_id long, text string, doc_id int, rank string")
    assert _got(lexical.search(docs, asked)) == _ranked(rows, items)
    assert _got(lexical.search(docs, asked, k=1, most_terms=2)) == _ranked(rows, items, 1)
    none = docs.where("doc_id = -1")
    assert lexical.search(none, asked).count() == 0
    assert lexical.search(docs, asked.where("item_id = -1")).count() == 0


def test_blocks_and_ties_keep_the_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PENDING", 3)
    best = lexical.Best(2, 2)
    import numpy as np

    for ids in ([5, 9], [3, 8], [1, 2]):
        best.add(np.array([0, 0]), np.array(ids), np.array([7, 7]))
        best.add(np.array([1, 1]), np.array(ids), np.array([ids[0], ids[1]]))
    item, doc_id, score = best.settle()
    assert list(zip(item.tolist(), doc_id.tolist(), score.tolist())) == [(0, 1, 7), (0, 2, 7), (1, 9, 9), (1, 8, 8)]
