"""SuperMinHash near-duplicates against a loop over all pairs."""

import random
import re

import numpy as np

from tidemark.llm import superminhash

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _set(text):
    ws = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))) if ws else frozenset()


def _expected(rows):
    """(doc_id, shingles, class) of rows (doc_id, text), ids not null; texts of one id are linked."""
    sets = [_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    full = [i for i, s in enumerate(sets) if s]
    for n, i in enumerate(full):
        for j in full[:n]:
            a, b = len(sets[i]), len(sets[j])
            if rows[i][0] == rows[j][0] or 100 * min(a, b) >= 80 * max(a, b) and 100 * (both := len(sets[i] & sets[j])) >= 80 * (a + b - both):
                up[find(i)] = find(j)
    least = {}
    for i in full:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def _got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in superminhash.near_duplicates(df).collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert _got(docs) == _expected([(r.doc_id, r.text) for r in docs.collect()])


def test_a_large_group_of_near_copies_chains_and_short_texts(spark, monkeypatch):
    monkeypatch.setattr(superminhash, "BLOCK", 64)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base, rows = [word() for _ in range(150)], []
    for i in range(400):  # some are within the threshold of the base, others of a neighbour only or of nothing
        near = list(base)
        for _ in range(rng.randint(0, 9)):
            near[rng.randrange(150)] = word()
        rows.append((1000 - i, " ".join(near)))
    chain = [word() for _ in range(80)]
    for i in range(40):  # each within the threshold of the one before, the ends far apart
        chain = [*chain[2:], word(), word()]
        rows.append((2000 + (i * 7) % 40, " ".join(chain)))
    rows += [(3000 + i, " ".join(base[: 1 + i % 6]).upper()) for i in range(30)]
    rows += [(4000, "word " * 5000), (4001, "word " * 4000), (4002, " ".join(word() for _ in range(30000)))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, component string")
    want = _expected(rows)
    assert len({c for d, _, c in want if d <= 1000}) > 20  # many stay apart
    assert _got(df) == want


def test_odd_cases(spark):
    same = "these are the words of a text that stands in several rows"
    rows = [(5, same), (6, same), (6, same), (6, "other words that have nothing to do with it at all"), (3, "OTHER words that have nothing to do with it at all"), (7, ""), (8, None), (9, " \n\t "), (10, "Ä b"), (11, "ä b"), (12, "Ä B"), (13, "x y")]
    df = spark.createDataFrame([(*r, 1, 2) for r in [*rows, (None, same), (None, None)]], "doc_id long, text string, n int, bucket int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in superminhash.near_duplicates(df.where("doc_id IS NOT NULL")).collect())
    assert got == _expected(rows)
    assert sorted(((r.n_shingles, r.component_id) for r in superminhash.near_duplicates(df).where("doc_id IS NULL").collect()), reverse=True) == [(9, None), (0, None)]
    assert superminhash.near_duplicates(df.where("doc_id = -1")).count() == 0


def _plain_signature(elements, slots):
    """The method step by step for one element after the other."""
    sig = [None] * slots
    for e in elements:
        left = list(range(slots))
        for j in range(slots):
            x = int(superminhash._mix(np.array([(int(e) + (j + 1) * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0])
            k = j + ((x & 0xFFFFFFFF) * (slots - j) >> 32)
            left[j], left[k] = left[k], left[j]
            value = (j << 32) | (x >> 32)
            sig[left[j]] = value if sig[left[j]] is None else min(sig[left[j]], value)
    return sig


def test_signatures_equal_the_plain_method_whatever_the_blocks(monkeypatch):
    sets = [superminhash.shingle_set(" ".join(map(str, range(lo, hi)))) for lo, hi in ((0, 3), (0, 60), (30, 90), (5, 400), (7, 8))]
    want = [_plain_signature(s, 50) for s in sets]
    assert superminhash.signatures(sets, 50).tolist() == want
    monkeypatch.setattr(superminhash, "_ELEMENTS", 37)
    assert superminhash.signatures(sets, 50).tolist() == want


def test_estimates_vary_less_than_those_of_independent_values():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(300):
        both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (40, 10, 10))
        x, y = superminhash.signatures([np.concatenate([both, a]), np.concatenate([both, b])], 250)
        errors.append((x == y).mean() - 40 / 60)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.8 * (2 / 3) * (1 / 3) / 250
