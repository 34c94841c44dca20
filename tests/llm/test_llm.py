"""Each operator against brute force, a library or an exact round trip, and on the odd cases."""

import base64
import collections
import functools
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import components, licenses, media, packing, pii, quality, queries, rans, sentencepieces, simhash, suffixes, tokenizers_fast, topk, webp

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score string, slot string, p string, h string, n int"
LONG = "lorem ipsum dolor " * 4000
ODD = [
    (1, None, "en"), (2, "", "en"), (3, "a", None), (4, "same text that is repeated word for word in other rows of this small table", "en"), (5, "same text that is repeated word for word in other rows of this small table", "en"),
    (5, "same text that is repeated word for word in other rows of this small table", "en"), (6, LONG, "en"), (7, LONG + "end", "xx"), (None, "no id here but me@example.com", None), (8, "mail me@example.com or +1 (988) 555-2485 from 10.0.0.1 with 4337166598464399", "en"),
    (9, "汉字 emoji 😀 ＠ combining é and \u0000 control", "zh"), (10, " \n\t ", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, "s", "x", "y", "z", 1) for i, t, lang in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("doc_id = -1")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


# --- op1


def _top(vectors, k=5, every=50):
    ok = {i: np.floor(256 * np.array(v, dtype=np.float64)).astype(int) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for q in (i for i in ok if i % every == 0):
        found = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q)[:k]
        out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(found)}
    return out


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, 40) / 4]) for i in range(400)] + [(900, None), (901, [None] * 40), (902, [float("nan")] * 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("slot", F.lit("x"))
    got = topk.top_k(df, df.where("vec_id % 50 = 0"))
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got.collect()} == _top(rows)


def test_topk_with_many_query_groups_and_repeats(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(9000, 8)) * 2.0 ** -np.arange(8)
    rows = [(50 * i if i < 4500 else 50 * i + 1, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [rows[0], rows[0], (50, [9.0] * 8), (7, [2.0**60] * 8), (9, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), held=8192).toPandas()  # 64 queries of 16 bytes are a block
    ok = rows[:-2]
    ids, cells = np.array([i for i, _ in ok]), np.floor(256 * np.array([v for _, v in ok])).astype(int)
    asked = {(i, tuple(c)) for i, c in zip(ids.tolist(), cells.tolist()) if i % 50 == 0}
    assert len(asked) == 4501 and len(got) == 5 * len(asked)
    want = []
    for i, c in asked:
        score = cells @ np.array(c)
        best = [int(j) for j in np.lexsort((ids, -score))[:20] if ids[j] != i][:5]
        want += [(i, r + 1, int(ids[j]), int(score[j])) for r, j in enumerate(best)]
    assert sorted(zip(got.query_id, got["rank"], got.vec_id, got.score)) == sorted(want)


def test_topk_thresholds_outlast_many_query_blocks():
    rng = np.random.default_rng(6)
    cells = np.floor(2000 * rng.normal(size=(64, 6000)) * 2.0 ** -(np.arange(64) / 4)[:, None]).astype("<i8")
    row = lambda asks, lo, hi: {"tile": 0, "asks": asks, "dims": 64, "n": hi - lo, "width": 8, "ids": np.arange(lo, hi).astype("<i8").tobytes(), "names": np.arange(lo, hi).astype("<i8").tobytes(), "cells": np.ascontiguousarray(cells[:, lo:hi]).tobytes()}
    made, kept = topk.Best, []
    topk.Best = lambda side, k: kept.append(made(side, k)) or kept[-1]
    try:
        rows = [row(True, lo, lo + 64) for lo in range(0, 4800, 64)] + [row(False, lo, lo + 500) for lo in range(0, 6000, 500)]
        found = list(topk._search(5)([pa.RecordBatch.from_pylist(rows)]))
    finally:
        topk.Best = made
    assert len(kept) == 75 and sum(b.compacted for b in kept) > 0.3 * 75 * 6000 and sum(map(len, found)) == 5 * 4800


def test_topk_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (7, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in topk.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 7)]
    none = df.where("vec_id < 0")
    assert topk.top_k(none, none).count() == 0


def test_branch_and_bound_prunes_and_stays_exact():
    rng = np.random.default_rng(4)
    cells = rng.integers(-200, 200, (64, 500))
    cells[:, 20:] //= 20
    ids = np.arange(500)
    side = lambda c, i: topk._Side(*c.shape, i.astype("<i8").tobytes(), c.astype("<i8").tobytes())
    best = topk.Best(side(cells[:, :4], ids[:4]), 5)
    for lo in range(0, 500, 100):
        best.meet(side(cells[:, lo : lo + 100], ids[lo : lo + 100]))
    score = cells.T @ cells
    for q in range(4):
        want = sorted((-int(score[q, i]), int(i)) for i in ids if i != q)[:5]
        assert list(zip((-best.scores[q]).tolist(), best.ids[q].tolist())) == want


# --- op2


def _licences(text):
    """[(license, part, start, end)] by plain sets over every window."""
    ws, out = licenses.plain_words(text), []
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    longest = {}
    for body in licenses.TEMPLATES.values():
        n = len(licenses.plain_words(body))
        longest[licenses.window_size(n)] = max(n, longest.get(licenses.window_size(n), 0))
    for name, body in licenses.TEMPLATES.items():
        t = licenses.plain_words(body)
        want, size = set(shingles(t)), licenses.window_size(len(t))
        stride, found = max(1, size - math.ceil(1.25 * longest[size]) + 1), set()
        for p in range(0, max(1, len(ws)), stride):
            own = shingles(ws[p : p + size])
            c = len(set(own) & want) / len(want)
            if c >= 0.8:
                at = [p + i for i, s in enumerate(own) if s in want]
                found.add((c, at[0], at[-1] + 5))
        begun, ended = {}, {}
        for c, p, q in found:  # the best of each beginning, then of each end
            begun[p] = max((c, -q), begun.get(p, (0, 0)))
        for p, (c, q) in begun.items():
            ended[-q] = max((c, p), ended.get(-q, (0, 0)))
        last = 0
        for q, (_, p) in sorted(ended.items()):
            if p >= last:
                last = q
                licence, _, part = name.partition("#")
                out.append((licence, part or "notice", p, q))
    return out


def _found_licences(df):
    return {(r.doc_id, r.license, r.part, r.start_word, r.end_word) for r in licenses.scan(df).collect()}


def test_licenses(docs, texts):
    got = _found_licences(docs)
    assert got == {(i, *m) for i, t in texts.items() for m in _licences(t)} and got


def test_licenses_whole_texts_with_changes(spark, odd, empty):
    rng, rows = random.Random(8), []
    for k, (name, body) in enumerate(licenses.TEMPLATES.items()):
        ws = body.split()
        for turn in range(4):
            own, spread = list(ws), len(ws) // 40 + (len(ws) > 14)
            for i in range(spread * (turn > 0)):  # few words changed, dropped or put in
                at = rng.randrange(len(own))
                own[at : at + (turn != 3)] = [] if turn == 2 else [f"word{i}"]
            rows.append((4 * k + turn, " ".join([*(f"w{rng.randrange(9)}" for _ in range(rng.randrange(40))), *own, *(f"w{rng.randrange(9)}" for _ in range(30))])))
    got = _found_licences(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == {(i, *m) for i, t in rows for m in _licences(t)}
    assert {i for i, *_ in got} >= {4 * k for k in range(len(licenses.TEMPLATES))}
    assert len({i for i, *_ in got}) > 0.7 * len(rows)
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0


def test_licenses_with_inserted_words(spark):
    text = "x To the extent possible under law, the author has waived once more all copyright and related or indeed neighboring rights to that work. y"
    ws = licenses.plain_words(licenses.TEMPLATES["MIT#grant"])
    rows = [(1, text), (2, " ".join(["one"] * 9 + ws[:11] + ["one", "two", "three"] + ws[11:50] + ["four"] * 5 + ws[50:]))]
    got = _found_licences(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == {(i, *m) for i, t in rows for m in _licences(t)} and (2, "MIT", "grant", 9, 9 + len(ws) + 8) in got


def test_licenses_in_a_megabyte_of_repeated_notices(spark):
    notice, other = "Licensed under CC BY-NC 4.0. ", licenses.TEMPLATES["MIT#notice"] + " "
    rows = [(1, notice * 300), (2, other * 60 + notice * 60), (3, ("word " * 3 + notice) * 100)]
    got = _found_licences(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == {(i, *m) for i, t in rows for m in _licences(t)}
    assert sum(x[:2] == (1, "CC-BY-NC-4.0") for x in got) == 300
    began = time.monotonic()
    long = licenses.scan(spark.createDataFrame([(1, notice * 35_000)], "doc_id long, text string")).collect()
    assert [(r.start_word, r.end_word) for r in sorted(long, key=lambda r: r.start_word)] == [(5 * i, 5 * i + 5) for i in range(35_000)]
    assert time.monotonic() - began < 60  # a quarter of it on an idle machine


# --- op3


def _check_media(rows, source):
    want = collections.Counter((i, len((t or "").encode())) for i, t in source)
    assert collections.Counter((r.doc_id, r.n_bytes) for r in rows) == want
    by_id = dict(source)
    for r in rows:
        data = media.payload((by_id[r.doc_id] or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        file = media.store([data])[0]  # alone: the file depends on the text only
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(file), hashlib.sha256(file).hexdigest(), media.feature(data))


def test_media(docs, odd, empty):
    few = docs.where("doc_id < 60")
    _check_media(media.describe(media.media_column(few)).collect(), [(r.doc_id, r.text) for r in few.collect()])
    _check_media(media.describe(media.media_column(odd)).collect(), [(i, t) for i, t, _ in ODD])
    assert media.describe(media.media_column(empty)).count() == 0


def test_webp_transforms():
    rng = np.random.default_rng(1)
    for k in range(12):
        h, w = rng.integers(1, 40, 2)
        image = rng.integers(0, 2**32, (h, w), dtype=np.uint32) if k % 3 else rng.integers(0, 5, (h, w)).astype(np.uint32) * np.uint32(0x01020304)
        size = int(rng.integers(2, 5))
        tiles = (webp._tiles(h, size), webp._tiles(w, size))
        modes = (rng.integers(0, 14, tiles).astype(np.uint32) << 8) | np.uint32(0xFF000000)
        elements = rng.integers(0, 2**24, tiles).astype(np.uint32) | np.uint32(0xFF000000)
        chains = [(), (("green",),), (("predictor", size, modes),), (("cross", size, elements),), (("predictor", size, modes), ("cross", size, elements), ("green",))]
        for chain in chains + ([(("palette",),)] if k % 3 == 0 else []):
            stream = webp.encode(image, transforms=chain)
            assert (webp.decode(stream) == image).all() and (webp.decode_many([stream])[0] == image).all()


def test_webp_of_another_encoder():
    """The smallest file that is commonly used to detect lossless support; another encoder wrote it."""
    file = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    image = webp.decode(webp.unwrap(file)[0])
    assert image.shape == (1, 1) and int(image[0, 0]) >> 24 in (0, 255)


def test_webp_damage():
    stream = webp.encode(np.arange(600, dtype=np.uint32).reshape(20, 30))
    with pytest.raises(ValueError):
        webp.decode(stream[: len(stream) // 2])
    with pytest.raises(ValueError):
        webp.decode(b"\x00" + stream[1:])
    with pytest.raises(ValueError):
        webp.unwrap(b"no file")


# --- op4

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _passes(kind, match):
    d = re.sub("[^0-9]", "", match)
    luhn = sum(v - 9 * (v > 9) for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0 if d else False
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in match.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def _base(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if _passes(k, m.group(0))]


TRICKY = [
    "a@b.c.@d.e x@y@z.w q@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255", "4337 1665 9846 4399 4337-1665-9846-4399 43371665984643990000", "+1 2 3 +49 (0) 89 123456. +123456789)", "😀 me@x.org 😀 10.0.0.1", "a" * 5000 + "@b.c",
    "1" * 5000, "1 " * 3000, ".".join(["1"] * 3000), "a." * 2000 + "@" + "b." * 2000 + "c", " ".join(f"u{i}@x.org" for i in range(700)),
]


def test_pii_base(spark, docs, texts, odd):
    rows = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for df, source in ((docs, texts), (rows, dict(enumerate(TRICKY))), (odd, {i: t for i, t, _ in ODD})):
        found = pii.find(df).collect()
        assert len(found) == df.count()
        for r in found:
            assert [(s.kind, s.start, s.stop) for s in r.base] == _base(source[r.doc_id])


@pytest.mark.parametrize("run", ["1", "12.", "+1", "a", "a.", "a@", "1 ", "(1", "4 - ", "a1", " "])
def test_pii_takes_a_megabyte_of_one_run(spark, run):
    text = run * (1_000_000 // len(run)) + " me@x.org"
    n = len(text)
    ips = [("ip", 12 * k, 12 * k + 11) for k in range(333_333 // 4)] if run == "12." else []
    rows = spark.createDataFrame([(1, text), (2, text + " card 4337166598464399")], "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.base] for r in pii.find(rows).collect()}
    assert found == {1: [("email", n - 8, n), *ips], 2: [("email", n - 8, n), *ips, ("card", n + 6, n + 22)]}


CANDIDATE = r"(?<![A-Za-z0-9@._+/=-])(?:(?=(?:[A-Za-z@._+/=-]*[0-9]){4})[A-Za-z0-9@._+/=-]{6,}(?![A-Za-z0-9@._+/=-])|\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}(?![A-Za-z0-9@_+/=]|[ ().-]{0,2}[0-9]))"


def _seen(text):
    """(kind, start, stop, instance, patterns) of a text, by plain steps."""
    out = []
    for kind, pattern in [*BASE.items(), ("candidate", CANDIDATE)]:
        found, last = list(re.finditer(pattern, text)), 0
        for k, m in enumerate(found):
            words = lambda t: [re.sub("[0-9]+", "0", w.lower()) for w in re.findall(r"[^ \t\n\x0b\f\r]+", t)]
            before = words(text[last : m.start()])[-2:]
            after = words(text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)])
            last = m.end()
            patterns = ["L:" + " ".join(before)] if before else []
            patterns += [f"B:{before[-1]} _ {after[0]}"] if before and after else []
            if kind == "candidate" or _passes(kind, m.group(0)):
                out.append((kind, m.start(), m.end(), m.group(0).lower(), patterns))
    return out


def _bootstrapped(texts, rounds=3, least=3, smooth=1.0, confidence=0.8):
    """{id: added spans} by dictionaries."""
    seen = {i: _seen(t) for i, t in texts.items()}
    n, seed = collections.Counter(), {}
    for kind, _, _, instance, patterns in (o for found in seen.values() for o in found):
        for p in patterns:
            n[p, instance] += 1
            if kind != "candidate":
                seed[p, instance] = max(kind, seed.get((p, instance), ""))
    ready = collections.Counter((p, kind) for (p, _), kind in seed.items())
    ready = {k for k, c in ready.items() if c >= least}
    sure = {p for p, _ in ready}
    n = {k: c for k, c in n.items() if k[0] in sure}
    first = {(i, kind): 1.0 for (p, i), kind in seed.items() if p in sure}
    total, marks = collections.Counter(), first
    for (p, _), c in n.items():
        total[p] += c
    for _ in range(rounds):
        scores, weight, mass = collections.Counter(), collections.Counter(), collections.Counter()
        for (p, i), c in n.items():
            for kind in BASE:
                if (p, kind) in ready and (i, kind) in marks:
                    scores[p, kind] += c * marks[i, kind] / (total[p] + smooth)
        for (p, i), c in n.items():
            for kind in BASE:
                if (p, kind) in scores:
                    weight[i, kind] += c
                    mass[i, kind] += c * scores[p, kind]
        marks = {k: max(first.get(k, 0.0), mass[k] / weight[k] if k in weight else 0.0) for k in set(first) | set(weight)}
    out = {}
    for i, found in seen.items():
        base, added = [o for o in found if o[0] != "candidate"], []
        for _, start, stop, _, patterns in (o for o in found if o[0] == "candidate"):
            best = max(((scores[p, k], k) for p in patterns for k in BASE if scores.get((p, k), 0) >= confidence), default=None)
            if best and not any(b[1] < stop and start < b[2] for b in base):
                added.append((best[1], start, stop))
        out[i] = sorted(added)
    return out


def _planted():
    """Seeds and, where patterns of theirs stand, identifiers of other shapes: {id: text}, {id: (kind, start, stop)}."""
    rng, texts, planted = random.Random(11), {}, {}
    word = lambda: rng.choice("river stone amber cloud winter market letter window garden bridge".split())
    frames = {"email": ["please write to {} soon", "my mail is {} or so"], "phone": ["you can call {} today", "the number is {} here"], "ip": ["seen from host {} twice"]}
    shapes = {"email": lambda: f"user{rng.randrange(9999)}@mail{rng.randrange(99)}.org", "phone": lambda: f"+49 {rng.randrange(100, 999)} {rng.randrange(10**5, 10**6)}", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4))}
    other = {"email": lambda: f"acct-{rng.randrange(10**5, 10**6)}/" + "x" * rng.choice([1, 80]), "phone": lambda: rng.choice(["({}) {}-{}", "{} {} {}", "{}-{}-{}"]).format(rng.randrange(100, 999), rng.randrange(100, 999), rng.randrange(1000, 9999)), "ip": lambda: f"node{rng.randrange(10**4, 10**5)}.rack"}
    for i in range(600):
        kind = rng.choice(list(frames))
        left, right = rng.choice(frames[kind]).split("{}")
        what = other[kind]() if i % 10 == 0 else shapes[kind]()
        start = " ".join(word() for _ in range(rng.randrange(1, 6))) + " " + left
        texts[i] = start + what + right + " " + word()
        if i % 10 == 0:
            planted[i] = (kind, len(start), len(start) + len(what))
    for i in range(600, 700):
        texts[i] = f"{word()} in the year {rng.randrange(1000, 2000)} lot {rng.randrange(10**6, 10**7)} was {word()}"
    return texts, planted


def test_pii_recall_and_scores_against_brute_force(spark, texts):
    planted_texts, planted = _planted()
    for source in (planted_texts, texts):
        rows = spark.createDataFrame(list(source.items()), "doc_id long, text string")
        got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.added] for r in pii.find(rows).collect()}
        assert got == _bootstrapped(source)
        if source is planted_texts:
            hit = sum(span in got[i] for i, span in planted.items())
            assert hit >= 0.9 * len(planted) and sum(map(len, got.values())) == hit  # nothing else is taken


def test_pii_candidates_do_not_hang_on_other_text(spark):
    rows = [(i, f"x{i} y{i} please write to user{i}@mail.example.org now z{i}") for i in range(30)]
    rows += [(100, "please write to A1B2C3D4A1B2"), (101, "please write to A1B2C3D4A1B2 or 1234"), (102, "please write to " + "k" * 80 + "1234")]
    found = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.added] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100] == found[101] == [("email", 16, 28)] and found[102] == [("email", 16, 100)]


def test_op4_query_strings(spark, texts):
    want = {}
    for i, t in texts.items():
        base, every = _base(t), _base(t) + _bootstrapped_sf()[i]
        order = list(BASE)
        line = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order.index(s[0]), s[1])))
        want[i] = (*(sum(s[0] == k for s in base) for k in order), hashlib.sha256(line(base).encode()).hexdigest(), line(every))
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in pii.op4_pii(spark, SF).collect()}
    assert got == want


@functools.lru_cache(maxsize=1)
def _bootstrapped_sf():
    return _bootstrapped({r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()})


def test_pii_discovers_by_context(spark):
    rows = [(i, f"x{i} y{i} please write to user{i}@mail.example.org now z{i}") for i in range(30)] + [(100, "w w please write to ACC-99812-X now v"), (101, "the number 123456 is free")]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, rows[30][1][s.start : s.stop]) for s in found[100].added] == [("email", "ACC-99812-X")]
    assert not found[101].added and not found[0].added
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100] == "w w please write to <EMAIL> now v" and out[3] == "x3 y3 please write to <EMAIL> now z3"


def test_pii_redacts_and_keeps_the_rest(odd, empty):
    out = pii.redact(odd)
    assert out.columns == odd.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[8] == "mail <EMAIL> or <PHONE> from <IP> with <CARD>" and got[1] is None and got[None] == "no id here but <EMAIL>"
    assert out.count() == odd.count() and pii.redact(empty).count() == 0


def _redact(text, spans):
    out, at = "", 0
    for start, stop, kind in spans:
        if start >= at:
            out += text[at:start] + f"<{kind.upper()}>"
        at = max(at, stop)
    return out + text[at:]


def test_pii_overlaps_and_redaction_against_brute_force(spark):
    """Spans that touch, nest, repeat, cross chunks and blocks, and stand at both ends."""
    rng, rows = random.Random(5), []
    for i in range(60):
        text = "".join(rng.choice("ab é😀\n") for _ in range(rng.choice([1, 40, 1023, 1024, 1025, 5000])))
        spans = []
        for _ in range(rng.choice([1, 2, 63, 64, 65, 129, 400])):
            start = rng.randrange(len(text))
            spans.append((start, min(len(text), start + rng.choice([1, 2, 9, 30, 2100])), rng.choice(pii.KINDS)))
        spans += [(0, 1, "ip"), (len(text) - 1, len(text), "ip")] if i % 2 else spans[:1]
        rows.append((i, text, sorted(spans), [(k, a, b) for a, b, k in spans if rng.random() < 0.5], [(k, a, b) for a, b, k in spans if rng.random() < 0.5]))
    span = "array<struct<kind:string,start:bigint,stop:bigint>>"
    df = spark.createDataFrame(rows, f"i int, text string, spans array<struct<start:bigint,stop:bigint,kind:string>>, base {span}, added {span}")
    got = df.select("i", pii._redacted(F.col("text"), F.col("spans")).alias("text"), pii._apart(F.col("added"), F.col("base")).alias("added")).collect()
    for r, (_, text, spans, base, added) in zip(sorted(got), rows, strict=True):
        assert r.text == _redact(text, spans)
        assert [tuple(s) for s in r.added] == sorted(s for s in added if not any(b[1] < s[2] and s[1] < b[2] for b in base))


def test_pii_takes_tens_of_thousands_of_spans_in_a_text(spark):
    pieces = [f"write to u{i}@mail.example.org or write to ACC-{10000 + i}-X now\n" for i in range(16_000)]
    rows = spark.createDataFrame([(1, "".join(pieces)), (2, "plain"), (3, None)], "doc_id long, text string")
    started = time.time()
    out = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert time.time() - started < 90
    assert out == {1: "write to <EMAIL> or write to <EMAIL> now\n" * 16_000, 2: "plain", 3: None}


# --- op5


def _print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def _classes(prints):
    """prints: {id: fingerprint}; the least id reachable over links of two bits or less."""
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash(docs, texts):
    prints = {i: _print(t) for i, t in texts.items()}
    want = _classes(prints)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in got} == {i: (prints[i], want[i]) for i in prints}


def test_simhash_equals_spark_hash(spark):
    row = spark.sql("select xxhash64('one two three') as h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


def test_covering_masks_leave_no_pair():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            d = 1 << i | 1 << j
            assert any(not d & m for m in masks)


def test_links_of_near_fingerprints(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(15)]
    prints = {}
    for b in base:
        for _ in range(12):
            prints[len(prints)] = b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))})
    unique = {v: k for k, v in reversed(prints.items())}
    df = spark.createDataFrame([(v - (v >> 63 << 64), k) for v, k in unique.items()], "fp long, node long")
    found = {r.node: r.component for r in components.components(simhash.links(df)).collect()}
    want = {k: v for k, v in _classes({k: v for v, k in unique.items()}).items()}
    assert {k: found.get(k, k) for k in want} == want


def test_simhash_odd(odd, empty):
    got = collections.defaultdict(set)
    for r in simhash.near_duplicates(odd).collect():
        got[r.doc_id].add(r.component_id)
    assert got[1] == got[2] == got[10] == {1} and got[4] == got[5] == {4} and got[None] == {None}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 3, 4, None}


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert set(got[i] for i in range(201)) == {0} and set(got[1000 + i] for i in range(300)) == {1000}


# --- op6


def _check_packed(rows, source, capacity=1024):
    tok = tokenizers_fast.library(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in source}
    cover, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
        cover[r.doc_id].append((r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    copies = collections.Counter(i for i, _ in source)
    for i, spans in cover.items():
        assert sum(n for _, n in spans) == copies[i] * len(ids[i])
    assert set(cover) == set(ids)
    for spans in bins.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    return sum(map(len, ids.values())), len(bins)


def test_packing(docs, texts, odd, empty):
    tokens, sequences = _check_packed(packing.pack(docs).collect(), list(texts.items()))
    assert sequences * 1024 <= 1.05 * tokens + 1024
    _check_packed(packing.pack(odd).collect(), [(i, t) for i, t, _ in ODD])
    assert packing.pack(empty).count() == 0


def test_cuts_fill_slots():
    for n in range(1, 3000):
        pieces = packing.cuts(n)
        assert sum(p for p, _ in pieces) == n and all(0 < p <= 1024 // k for p, k in pieces)


# --- op7


def test_rans(spark, docs, texts, odd, empty):
    tok = tokenizers_fast.library(public_tokenizers.path("word_bpe_49k.json"))

    def check(df, source):
        source = sorted(source, key=lambda x: (x[0] is not None, x[0] or 0))
        ids = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for _, t in source]
        starts = np.cumsum([0, *map(len, ids)])[:-1]
        want = collections.Counter((i, int(s), len(x), zlib.crc32(x.tobytes())) for (i, _), s, x in zip(source, starts, ids))
        got = rans.read_token_file(spark, rans.write_token_file(df))
        assert collections.Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == want

    check(docs, texts.items())
    check(odd, [(i, t) for i, t, _ in ODD])
    check(empty, [])


def test_rans_blocks_and_damage():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 150_000), 49_000).astype("<u4")
    t = rans.table(rans.scaled(np.bincount(ids, minlength=49_408)).astype("<u4").tobytes())
    assert int(t.freq.sum()) == 1 << rans.SCALE
    block = rans.encode_block(ids, t)
    assert (rans.decode_block(block, t) == ids).all() and len(block) < 1.8 * len(ids)
    damaged = bytearray(block)
    damaged[len(block) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(damaged), t)


def test_word_bpe_equals_library():
    w, rng = tokenizers_fast.word_bpe(public_tokenizers.path("word_bpe_49k.json")), random.Random(2)
    pool = "aeiourstnlßéüñ ÀÉ  \n'.,;!?-_()0123456789“”–¿×x漢İσΣ \x1c"
    cases = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + ["don't we'll I'VE", "", "<|endoftext|>"]
    assert [np.frombuffer(w.encode(c), w.dtype).tolist() for c in cases] == [e.ids for e in w.tok.encode_batch(cases, add_special_tokens=False)]


def test_byte_bpe_equals_library():
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    pool = "aeiou rstn  \n\t'.,!0123éü漢😀 　<|endoftext|>"
    cases = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    own = tokenizers_fast.byte_bpe(path)
    assert [own.encode_ordinary(c) for c in cases] == [e.ids for e in tokenizers_fast.library(path).encode_batch(cases, add_special_tokens=False)]


@pytest.mark.parametrize("run", [" ", "\n", " \n\t", "a", "1", "."])
def test_three_megabytes_of_one_run_equal_library(run):
    path, text = public_tokenizers.path("byte_bpe_50k.json"), "start " + run * (3_000_000 // len(run)) + " end"
    assert tokenizers_fast.byte_bpe(path).encode_ordinary(text) == tokenizers_fast.library(path).encode(text, add_special_tokens=False).ids


def test_added_tokens_equal_the_untouched_library(spark):
    names, rng = ("byte_bpe_50k.json", "word_bpe_49k.json"), random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "a", " b", "\n", "é", "don't", "漢"]
    cases = ["<|endoftext|>", "one <|endoftext|> two<|startoftext|>"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(500)]
    byte, word = (Tokenizer.from_file(public_tokenizers.path(n)) for n in names)
    ids = [[e.ids for e in t.encode_batch(cases, add_special_tokens=False)] for t in (byte, word)]
    assert ids[0][0] == [50256] and ids[1][0] == [49407]
    own = tokenizers_fast.byte_bpe(public_tokenizers.path(names[0]))
    assert [own.encode_ordinary(c) for c in cases] == ids[0]
    w = tokenizers_fast.word_bpe(public_tokenizers.path(names[1]))
    assert [np.frombuffer(w.encode(c), w.dtype).tolist() for c in cases] == ids[1]
    df = spark.createDataFrame(list(enumerate(cases[:2])), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in rans.read_token_file(spark, rans.write_token_file(df)).collect()}
    assert got == {i: len(x) + 1 for i, x in enumerate(ids[1][:2])}
    assert {r.doc_id: r.doc_tokens for r in packing.pack(df).collect()} == {i: len(x) + 1 for i, x in enumerate(ids[0][:2])}


# --- op8


def _removed(source, length=50):
    """source: [(id, bytes)]"""
    least = {}
    for i, raw in source:
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, raw in source:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if least[raw[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return collections.Counter(out)


def _suffix_rows(df, **kw):
    return collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.report(df, **kw).collect())


def test_suffixes(docs, texts):
    assert _suffix_rows(docs) == _removed([(i, t.encode()) for i, t in texts.items()])


def test_suffixes_hot_passage_and_small_chunks(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "éps", "zeta"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    passage = text(40)
    rows = [(i, text(rng.randrange(30)) + " " + passage[rng.randrange(60) :] + " " + text(rng.randrange(30))) for i in range(60)] + [(60 + i, "ab" * rng.randrange(60)) for i in range(8)] + [(70, "x" * 300), (71, "x" * 300), (72, "x" * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _removed([(i, t.encode()) for i, t in rows])
    assert _suffix_rows(df) == want
    assert _suffix_rows(df, chunk=1 << 10, hot=3) == want


def test_suffixes_odd(odd, empty):
    own = [(i, (t or "").encode()) for i, t, _ in ODD if i is not None]
    want = _removed(own)
    want[None, len(ODD[8][1].encode()), 0, 0, hashlib.sha256(ODD[8][1].encode()).hexdigest()] += 1
    assert _suffix_rows(odd) == want
    assert suffixes.report(empty).count() == 0 and suffixes.remove(empty).count() == 0
    out = suffixes.remove(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert [r.text for r in out.where("doc_id = 9").collect()] == [ODD[10][1]]


def test_suffixes_one_id_with_a_copied_and_a_unique_text(spark):
    copied, unique = " ".join(f"copied{i}" for i in range(12)), " ".join(f"unique{i}" for i in range(12))
    rows = [(1, copied), (2, copied), (2, unique), (3, "before " + unique + " after")]
    got = _suffix_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == _removed([(i, t.encode()) for i, t in rows])


def test_whole_characters_only():
    raw = np.frombuffer("aé漢b".encode(), np.uint8)
    gone = np.array([0, 0, 1, 1, 1, 1, 0], bool)
    assert raw[~suffixes.whole_characters(raw, gone)].tobytes().decode() == "aéb"


# --- op9


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.7)).all() and rows.score.between(0, 1).all()
    test = rows[rows.held_out]
    assert len(test) > 50 and (test.predicted == test.quality).mean() > 0.97


def test_quality_scores_against_brute_force(spark, docs, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    x = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    sets = [np.array([x[r.doc_id] for r in labels.collect() if r.quality == c and r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]) for c in (0, 1)]
    cov = [np.cov(s.T, bias=True) for s in sets]
    pooled = sum(len(s) * c for s, c in zip(sets, cov)) / sum(map(len, sets))
    target = 0.5 * pooled + 0.5 * np.diag(np.diag(pooled) + 1e-6)
    mix = [0.95 * c + 0.05 * target + 1e-9 * np.eye(len(c)) for c in cov]
    prior = np.log((len(sets[1]) + 1) / (len(sets[0]) + 1))
    density = lambda v, c: -0.5 * ((v - sets[c].mean(axis=0)) @ np.linalg.solve(mix[c], v - sets[c].mean(axis=0)) + np.linalg.slogdet(mix[c])[1])
    for r in quality.classify(docs, labels).collect():
        t = np.clip(density(x[r.doc_id], 1) - density(x[r.doc_id], 0) + prior, -700, 700)
        assert abs(r.score - 1 / (1 + np.exp(-t))) < 1e-5
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}


def test_quality_odd(spark, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(odd, labels)
    assert got.count() == odd.count() and got.where("score IS NULL OR score < 0 OR score > 1 OR isnan(score)").count() == 0
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(odd, labels.where("doc_id < 0")).count() == odd.count()  # nothing to learn from
    assert quality.keep_good(odd, labels).columns == odd.columns


# --- op10


def test_sentencepiece_equals_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    c, rng = sentencepieces.codec(path), random.Random(1)
    model = sentencepieces.SentencePieceProcessor(model_file=path)
    pool = "aeiou tnshrd  \n\t.,!?'\"-()[]{}0123456789ABCéüñ漢字かな한국어▁​́😀<s>"
    pieces = [model.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    cases = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 10))) for _ in range(6000)]
    cases += ["", " ", "  ", "\0a", "a" * 5000, " a", "a ", "<s>", "<unk>", "ﬁ", LONG[:9000]]
    for text in cases:
        ids = np.frombuffer(c.encode(text), "<u4").tolist()
        assert ids == model.encode(text)
        assert c.decode(ids) == model.decode(ids)
    for _ in range(2000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(rng.randint(0, 8))]
        assert c.decode([i for i in ids if i]) == model.decode([i for i in ids if i])


def test_sentencepiece_frames(odd, empty):
    encoded = sentencepieces.encode(odd)
    back = collections.Counter((r.doc_id, r.text) for r in sentencepieces.decode(encoded).collect())
    assert back == collections.Counter((i, t or "") for i, t, _ in ODD)
    assert sentencepieces.encode(empty).count() == 0


# --- all


def test_release_deletes_what_was_written(spark, odd):
    from tidemark.llm import common

    found = common.written(odd, "x")
    assert found.count() == odd.count()
    assert common.release(spark) >= 1 and common.release(spark) == 0


def test_every_operator_is_registered():
    names = {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES}
    assert names == {str(n) for n in range(1, 14)}


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, corpus_pipeline.written(stage(spark, rows, SF), name)
        assert rows.columns == columns
        old, new = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in rows.collect()}
        if name == "quality":
            bad = {r.doc_id for r in quality.classify(before, labels).where("predicted = 0").collect()}
            assert set(new) == set(old) - bad and bad
        elif name == "near_duplicates":
            assert set(new) == set(_classes({i: _print(t) for i, t in old.items()}).values())
        elif name == "repeated_passages":
            want = {k[0]: k[2] for k in _removed([(i, t.encode()) for i, t in old.items()])}
            assert all((new[i] == old[i]) == (want[i] == 0) or want[i] < 4 for i in old)
        else:
            assert not any(_base(t) for t in new.values()) and all(new[i] == t for i, t in old.items() if not _base(t))
    _check_packed(corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect(), list(new.items()))


def test_run_gives_the_last_stage(spark):
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, SF).columns)


