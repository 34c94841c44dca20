"""Phrase collocations by FM-indexes of shards, extended in both directions and summed across shards.

Texts are cut into pieces at punctuation and line ends and those into words.  A shard holds the
pieces of some documents of one language, at most ``SHARD`` words or one piece, as word ids with a
separator between pieces.  Its FM-index has, for the text and for the text read backwards, the order
of all suffixes by their first three symbols, the Burrows-Wheeler column and the last-to-first
mapping; a phrase is an interval of either order.  Extending all intervals of a level to the left (in
the one) or to the right (in the other) gives the next longer phrases, their counts and their places
in both orders at once.

Counts add up across shards, so no shard can tell alone what is frequent.  Levels take turns:

1.  Words: shards deal their distinct words and counts to parts by hash.  A part sums, numbers the
    words that are frequent and answers each shard with their numbers.  Other words are separators
    from here on, as a frequent phrase has frequent words only.
2.  Word pairs, by extension to the left: dealt to parts as packed, sorted numbers, summed, and
    answered by one bit for each pair.
3.  Triples: only the frequent pairs' intervals are extended, to the right, and a triple is handed
    on only if its second pair is frequent as well; their sums are a plain grouping.

A part holds about 2^20 dealt entries whatever the size of the corpus, a task one shard.

Scores are integer divisions of decimals with 38 digits, so they are exact for counts up to 10^15.

Defined cases: null texts are empty; a null language is ``und``; pieces without words and words
without neighbours give no phrases; rows that repeat count again; equal scores and counts are ordered
by the phrase's bytes; an empty table gives none; columns besides text and language are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import documents, partitions_for, written

LEAST, TOP, INSIDE = 10, 2000, 50
SHARD, PART, _SLICE = 1 << 21, 1 << 20, 1 << 22
_PLAIN = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_SHARD = "shard long, lang string, n long, symbols binary, words array<binary>, counts array<long>"
_DEALT = "part int, shard long, lang string, places array<int>, words array<binary>, counts array<long>"
_NAMED = "shard long, places array<int>, ids array<int>, lang string, word binary, f long, id int"
_PAIRS = "part int, shard long, keys binary, counts binary"
_FREQUENT = "shard long, part int, bits binary, pair long, f long"
_TRIPLES = "pair long, third long, n long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _planes(x: np.ndarray) -> bytes:
    """The numbers' bytes, all lowest ones first: high ones are mostly zero and pack well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(planes: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def _slices(text: str | None) -> Iterator[bytes]:
    """A text in small letters with line feeds between pieces and blanks between words, cut at blanks or line feeds."""
    plain, at = (text or "").encode("utf-8", "replace").lower().translate(_PLAIN), 0
    while at < len(plain):
        end = at + _SLICE
        if end < len(plain):
            cuts = [c for c in (plain.find(b" ", end), plain.find(b"\n", end)) if c >= 0]
            end = min(cuts, default=len(plain))
        yield plain[at:end]
        at = end


class _Ids(dict):
    """Numbers for words as they come; 0 is the end of a piece, -1 no word."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


class _Builder:
    """The shard of one language that is open in a task."""

    def __init__(self):
        self.ids, self.parts, self.size = _Ids(), [np.zeros(1, np.int32)], 0

    def add(self, text: str | None) -> None:
        for plain in _slices(text):
            words = plain.replace(b"\n", b" \n ").split(b" ")
            found = np.fromiter(map(self.ids.__getitem__, words), np.int32, count=len(words))
            found = found[found >= 0]
            self.parts.append(found[(found > 0) | (np.concatenate([[0], found[:-1]]) > 0)])  # no separator after another
            self.size += len(found)
        self.parts.append(np.zeros(1, np.int32))

    def row(self) -> tuple:
        """n, symbols, words and counts; the more frequent a word, the smaller its number."""
        text = np.concatenate(self.parts)
        words = [w for w in self.ids if w not in (b"\n", b"")]
        counts = np.bincount(text, minlength=len(words) + 1)[1:]
        order = np.argsort(-counts, kind="stable")
        rank = np.zeros(len(words) + 1, np.int32)
        rank[order + 1] = np.arange(1, len(words) + 1)
        return int(counts.sum()), _planes(rank[text]), [words[i] for i in order], counts[order]


def _build(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_, held = TaskContext.get().partitionId() << 32, {}, 0

        def made(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            n, symbols, words, counts = open_.pop(lang).row()
            row = [[number], [lang], [n], [symbols], [words], [counts]]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], _names(_SHARD))

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                shard = open_.setdefault(lang.as_py(), _Builder())
                before = shard.size
                shard.add(text.as_py())
                held += shard.size - before + 1
                if held >= size:
                    for x in list(open_):
                        yield made(x)
                    held = 0
        for x in list(open_):
            yield made(x)

    return run


def _deal_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                words, counts = batch.column("words")[i].values, batch.column("counts")[i].values.to_numpy()
                if not len(words):
                    continue
                part = np.fromiter((zlib.crc32(w) % parts for w in words.to_pylist()), np.int64, count=len(words))
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                filled = np.flatnonzero(np.diff(ends))
                offsets = pa.array(np.append(ends[filled], len(words)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(order + 1, pa.int32()), words.take(pa.array(order)), pa.array(counts[order]))]
                one = lambda c: pa.array([batch.column(c)[i].as_py()] * len(filled), batch.column(c).type)
                yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), one("shard"), one("lang"), *lists], _names(_DEALT))

    return run


def _name_words(parts: int, least: int):
    """Over a part's words of all shards: numbers for the frequent ones, to each shard and as the vocabulary."""

    def run(table: pa.Table) -> pa.Table:
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.binary(), pa.int64(), pa.int32())
        out, number = [], 0
        for lang in sorted(set(table.column("lang").to_pylist())):
            rows = table.filter(pc.equal(table.column("lang"), lang))
            column = lambda c: rows.column(c).combine_chunks()  # noqa: E731, B023
            coded = column("words").flatten().dictionary_encode()
            at, words = coded.indices.to_numpy(), coded.dictionary
            totals = np.zeros(len(words), np.int64)
            np.add.at(totals, at, column("counts").flatten().to_numpy())
            kept = np.flatnonzero(totals >= least)
            ids = np.zeros(len(words), np.int64)
            ids[kept] = (number + np.arange(1, len(kept) + 1)) * parts + table.column("part")[0].as_py()
            number += len(kept)
            if number * parts + parts >= 1 << 31:
                raise ValueError("more frequent words than 31 bits can number")
            empty = pa.nulls(len(kept), kinds[1])
            vocabulary = [pa.nulls(len(kept), kinds[0]), empty, empty, pa.array([lang] * len(kept)), words.take(pa.array(kept)), pa.array(totals[kept]), pa.array(ids[kept], pa.int32())]
            out.append(pa.Table.from_arrays(vocabulary, _names(_NAMED)))
            places, ends = column("places").flatten().to_numpy(), np.cumsum(column("places").value_lengths().to_numpy())
            for shard, lo, hi in zip(column("shard").to_pylist(), np.append(0, ends[:-1]), ends):
                named = ids[at[lo:hi]]
                answer = [[shard], [places[lo:hi][named > 0]], [named[named > 0]], [None], [None], [None], [None]]
                out.append(pa.Table.from_arrays([pa.array(x, t) for x, t in zip(answer, kinds)], _names(_NAMED)))
        return pa.concat_tables(out)

    return run


class Index:
    """One direction of an FM-index for phrases of at most three symbols; the text begins and ends with 0."""

    def __init__(self, text: np.ndarray):
        self.span = int(text.max(initial=0)) + 1
        t0 = text.astype(np.int64)
        t1, t2 = np.append(t0[1:], 0), np.append(t0[2:], [0, 0])
        if self.span < 1 << 21:
            order = np.argsort((t0 * self.span + t1) * self.span + t2, kind="stable")
        else:
            order = np.lexsort((t2, t1, t0))
        self.bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.span))])
        self.to_first = np.empty(len(text), np.int64)
        self.to_first[np.argsort(self.bwt, kind="stable")] = np.arange(len(text))

    def extend(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each interval and each symbol before its suffixes: (interval, symbol, start, size, how many symbols before the
        interval's suffixes are smaller), for symbols that are no separator."""
        begins = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(starts)), sizes)
        at = np.repeat(starts - begins, sizes) + np.arange(len(owner))
        key = owner * self.span + self.bwt[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        interval, symbol = key[heads] // self.span, key[heads] % self.span
        size = np.diff(np.append(heads, len(key)))
        found = (interval, symbol, self.to_first[at[order[heads]]], size, heads - begins[interval])
        return tuple(x[symbol > 0] for x in found)


class Shard:
    """A shard's text over the numbers of frequent words, and its word pairs in a fixed order by part and key."""

    def __init__(self, symbols: bytes, places: np.ndarray, ids: np.ndarray, parts: int):
        text = _numbers(symbols, np.int32)
        self.ids = np.zeros(int(text.max(initial=0)) + 1, np.int64)
        self.ids[places] = ids
        self.text = np.where(self.ids[text] > 0, text, 0)
        forward = Index(self.text)
        words = np.flatnonzero(np.diff(forward.first)[1:]) + 1
        b, a, _, self.sizes, smaller = forward.extend(forward.first[words], np.diff(forward.first)[words])
        self.a, self.b = a, words[b]
        self.backward = forward.first[self.b] + smaller  # where the pair stands in the order of the text read backwards
        self.keys = self.ids[self.a] << 32 | self.ids[self.b]
        self.part = ((self.keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
        self.order = np.lexsort((self.keys, self.part))
        self.ends = np.searchsorted(self.part[self.order], np.arange(parts + 1))

    def dealt(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for part in np.flatnonzero(np.diff(self.ends)):
            at = self.order[self.ends[part] : self.ends[part + 1]]
            yield int(part), self.keys[at], self.sizes[at]

    def triples(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, third, count) of the frequent pairs, extended to the right by words with which the second is frequent."""
        kept = np.zeros(len(self.keys), bool)
        for part, bits in answers.items():
            at = self.order[self.ends[part] : self.ends[part + 1]]
            kept[at] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)
        at = np.flatnonzero(kept)
        pair, c, _, size, _ = Index(self.text[::-1]).extend(self.backward[at], self.sizes[at])
        pair, second = at[pair], self.ids[self.b[at[pair]]] << 32 | self.ids[c]
        ok = np.isin(second, self.keys[at])
        return self.keys[pair[ok]], self.ids[c[ok]], size[ok]


def _joined(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    flat = lambda c: np.concatenate([np.zeros(0, np.int32), *[x.flatten().to_numpy() for x in answers.column(c).chunks]])
    return flat("places"), flat("ids")


def _deal_pairs(parts: int):
    def run(shard: pa.Table, named: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(shard):
            own = Shard(shard.column("symbols")[0].as_py(), *_joined(named), parts)
            rows = [(part, shard.column("shard")[0].as_py(), _planes(np.diff(keys, prepend=0)), _planes(n)) for part, keys, n in own.dealt()]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], _names(_PAIRS))

    return run


def _sum_pairs(least: int):
    def run(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_numbers(x, np.int64)) for x in table.column("keys").to_pylist()]
        pairs, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(len(pairs), np.int64)
        np.add.at(totals, at, np.concatenate([_numbers(x, np.int64) for x in table.column("counts").to_pylist()]))
        kept = totals >= least
        bits = [np.packbits(x).tobytes() for x in np.split(kept[at], np.cumsum([len(x) for x in keys])[:-1])]
        n, m = len(bits), int(kept.sum())
        columns = [
            pa.concat_arrays([table.column("shard").combine_chunks(), pa.nulls(m, pa.int64())]), pa.concat_arrays([table.column("part").combine_chunks(), pa.nulls(m, pa.int32())]),
            pa.array([*bits, *[None] * m], pa.binary()), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(pairs[kept])]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(totals[kept])]),
        ]
        return pa.Table.from_arrays(columns, _names(_FREQUENT))

    return run


def _extend_pairs(parts: int):
    def run(shard: pa.Table, answers: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64),) * 3
        if len(shard):
            bits = {p: b for p, b in zip(answers.column("part").to_pylist(), answers.column("bits").to_pylist()) if b is not None}
            found = Shard(shard.column("symbols")[0].as_py(), *_joined(answers), parts).triples(bits)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in found], _names(_TRIPLES))

    return run


def counts(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text", size: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables of what occurs ``least`` times: words (lang, word, f, id), pairs (pair, f) and triples (pair, third, f), by ids; and (lang, n), all words."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    shards = written(rows.mapInArrow(_build(size), _SHARD), "phrase-shards")
    total = shards.agg(F.sum("n")).first()[0] or 0  # one number
    parts = max(partitions_for(docs.sparkSession), -(-total // PART))
    dealt = shards.select("shard", "lang", "words", "counts").mapInArrow(_deal_words(parts), _DEALT)
    named = written(dealt.groupBy("part").applyInArrow(_name_words(parts, least), _NAMED), "phrase-words")
    answers = named.where("shard IS NOT NULL").select("shard", "places", "ids")
    symbols = shards.select("shard", "symbols")
    dealt = symbols.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_deal_pairs(parts), _PAIRS)
    frequent = written(dealt.groupBy("part").applyInArrow(_sum_pairs(least), _FREQUENT), "phrase-pairs")
    marks = frequent.where("shard IS NOT NULL").select("shard", "part", "bits")
    both = answers.unionByName(marks, allowMissingColumns=True)
    triples = symbols.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(_extend_pairs(parts), _TRIPLES)
    triples = written(triples.groupBy("pair", "third").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "phrase-triples")
    words = named.where("id IS NOT NULL").select("lang", F.col("word").cast("string").alias("word"), "f", F.col("id").cast("long").alias("id"))
    return words, frequent.where("pair IS NOT NULL").select("pair", "f"), triples, shards.groupBy("lang").agg(F.sum("n").alias("n"))


def _score(a: str, l: str, r: str) -> F.Column:  # noqa: E741
    wide = "CAST({} AS DECIMAL(15,0))".format
    return F.expr(f"CAST((CAST(1000000 AS DECIMAL(7,0)) * {wide(a)} * {wide(a)}) div ({wide(l)} * {wide(r)}) AS BIGINT)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE, lang_col: str = "lang", text_col: str = "text", size: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two or three words by their lowest-scoring cut."""
    words, pairs, triples, totals = counts(docs, least, lang_col, text_col, size)
    one = lambda i, *more: words.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"word{i}"), F.col("f").alias(f"f{i}"), *more)
    second = F.shiftleft(F.col("pair").bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(F.col("third"))
    triples = triples.withColumn("second", second)
    longer = triples.select(F.explode(F.array("pair", "second")).alias("pair"), "f").groupBy("pair").agg(F.max("f").alias("longer"))
    split = lambda df: df.withColumns({"w1": F.shiftright("pair", 32), "w2": F.col("pair").bitwiseAND(F.lit(0x7FFFFFFF))})
    two = split(pairs.join(longer, "pair", "left").where(f"longer IS NULL OR 100 * longer < {inside} * f"))
    two = two.join(one(1, "lang"), "w1").join(one(2), "w2")
    two = two.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r")).withColumn("score", _score("a", "l", "r"))
    three = split(triples).withColumn("w3", F.col("third")).join(one(1, "lang"), "w1").join(one(2), "w2").join(one(3), "w3")
    three = three.join(pairs.withColumnRenamed("f", "f12"), "pair").join(pairs.select(F.col("pair").alias("second"), F.col("f").alias("f23")), "second")
    three = three.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), F.col("f").alias("a"), "f1", "f23", "f12", "f3").withColumns({"s1": _score("a", "f1", "f23"), "s2": _score("a", "f12", "f3")})
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", "phrase", "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM pieces CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k
),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ') AND l.k = c.cut
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ') AND r.k = c.k - c.cut
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3
),
longest AS (SELECT lang, phrase, max(a) AS longer FROM held GROUP BY ALL),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM best b LEFT JOIN longest h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.longer IS NULL OR 100 * h.longer < 50 * a
)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""
