"""Phrase collocations against counting phrase by phrase."""

import random
import re
from collections import Counter

import numpy as np

from tidemark.llm import collocations

SF = "/root/testdata/sf0.001"


def _expected(rows, least=10, top=2000):
    """rows: (lang, text)."""
    langs = {}
    for lang, text in rows:
        f = langs.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            f.update(tuple(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in langs.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found, longest = [], {}
        for q, b in f.items():
            if len(q) == 3 and b >= least:
                for part in (q[:2], q[1:]):
                    longest[part] = max(b, longest.get(part, 0))
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and 100 * longest.get(p, 0) >= 50 * a:
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, l, x, n, -s) for r, (s, a, p, l, x) in enumerate(sorted(found)[:top])]  # noqa: E741
    return sorted(out)


def _got(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = _expected([(r.lang, r.text) for r in docs.collect()])
    assert len(want) > 50
    assert _got(collocations.op13_collocations(spark, SF)) == want


def test_many_shards_and_parts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PART", 300)
    monkeypatch.setattr(collocations, "_SLICE", 50)
    rng = random.Random(7)
    words = [rng.choice("abcäé汉") + str(i) for i in range(40)]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words[: rng.choice((5, 40))]) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ",", "? "]) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    df = spark.createDataFrame([(t, lang, 1, "x") for lang, t in rows], "text string, lang string, n int, phrase string").repartition(5)
    for least in (2, 10):
        assert _got(collocations.collocations(df, least=least, top=50, size=100)) == _expected(rows, least, 50)


def test_odd_cases(spark):
    rows = [
        ("en", None), ("en", ""), (None, " \n\t.,"), ("en", "one"), ("en", "same words here. same words here; SAME WORDS HERE\u0000 x" * 12), ("x", "word " * 30000), ("x", "no.punctuation,at:all!here?" * 20),
        ("en", "Ärger ärger ärger " * 15), ("en", "a b c d " * 11), ("en", "a b a b a b a b a b a b a b a b a b a b a b"),
    ]
    df = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
    assert _got(collocations.collocations(df)) == _expected(rows)
    assert collocations.collocations(df.where("lang = 'none'")).count() == 0
    assert collocations.collocations(df.where("text = ''")).count() == 0


def test_intervals_agree_in_both_directions():
    rng = np.random.default_rng(2)
    text = np.concatenate([[0], rng.integers(0, 5, 400), [0]]).astype(np.int32)
    forward, backward = collocations.Index(text), collocations.Index(text[::-1])
    words = np.arange(1, 5)
    b, a, start, size, smaller = forward.extend(forward.first[words], np.diff(forward.first)[words])
    want = Counter(zip(text[:-1].tolist(), text[1:].tolist()))
    assert {(int(x), int(words[y])): int(n) for x, y, n in zip(a, b, size)} == {k: v for k, v in want.items() if 0 not in k}
    b2, c, _, n2, _ = backward.extend(forward.first[words[b]] + smaller, size)  # to the right of each pair
    triples = Counter(zip(text[:-2].tolist(), text[1:-1].tolist(), text[2:].tolist()))
    assert {(int(a[i]), int(words[b[i]]), int(x)): int(n) for i, x, n in zip(b2, c, n2)} == {k: v for k, v in triples.items() if 0 not in k}
    again = forward.extend(start, size)  # to the left of each pair
    assert {(int(x), int(a[i]), int(words[b[i]])): int(n) for i, x, n in zip(again[0], again[1], again[3])} == {k: v for k, v in triples.items() if 0 not in k}
