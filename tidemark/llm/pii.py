"""Personal data by patterns, and by contextual extraction bootstrapped from them.

Base spans are the leftmost non-overlapping matches per kind (email, ip, card, phone) that pass
their check.  They seed the bootstrap: every seed and every identifier-like candidate is an
instance, the words around it are its lexical patterns.  A candidate is a whole token of six
characters or more with four digits or more, or else digit groups of seven digits or more that are
joined by spaces, dots, hyphens or parentheses.  Patterns are the two words before an instance, and
the word before together with the word after it; words are whole, whatever their length, in lower
case and with digits masked, and reach back to the last instance of the same kind.

Spark scores the bipartite graph of patterns and instances for a few rounds: a pattern's score for
a kind is the weighted mean of its instances' scores (smoothed), an instance's score is that of its
patterns.  Patterns of high confidence and enough distinct seeds then mark the unseen identifiers
that stand in them.

Everything is DataFrame and SQL functions.  Spans are found row by row in one scan, without a
shuffle: matches and the pieces between them give offsets in code points, summed in blocks so that
a text with many matches costs no quadratic copying.  Only occurrences (not texts) are shuffled,
counted per (pattern, instance, kind) before that, so a frequent pattern is one row per instance
and task.

The regular expressions are possessive forms of the stated ones: their parts are disjoint, so they
match the same, without backtracking or deep recursion; each starts only where its run starts, so
the work stays linear in a text that is one long run.

What added spans overlap, and what redaction puts in place of spans, goes by the greatest end so far
of the spans in order, again in blocks; redacted texts are put together from chunks of ``CHUNK``
characters, so that both stay linear in the spans of a text.

Defined cases: null or empty text has no spans and the checksum of the empty string; equal rows
give equal rows; a null doc_id is kept; an empty table gives none; other columns are ignored by the
operator and passed on by ``redact``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, documents, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TOKEN = "A-Za-z0-9@._+/=-"
_FOUR = "(?:[A-Za-z@._+/=-]*+[0-9]){4}"
_SEVEN = r"[0-9](?:[\x20().-]{0,2}+[0-9]){6}"
CANDIDATE = rf"(?<![{_TOKEN}])(?:(?={_FOUR})[{_TOKEN}]{{6,}}+|\(?+(?={_SEVEN})[0-9](?:[\x20().-]{{0,2}}+[0-9])++(?![A-Za-z0-9@_+/=]))"
#: What every text with a candidate holds: four digits within a token, or seven within digit groups.
_HAS_CANDIDATE = rf"[0-9](?:[A-Za-z@._+/=-]*+[0-9]){{3}}|{_SEVEN}"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPAN = "struct<kind:string,start:bigint,stop:bigint,match:string,lhs:string,rhs:string>"
STEP = 64
CHUNK = 1024


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda span: _valid(kind, span["match"])


def _possible(kind: str, text: Column) -> Column:
    """A cheap necessary condition: most texts end here."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike(_HAS_CANDIDATE if kind == "candidate" else "[0-9]")


def _found(df: DataFrame, kinds: dict[str, str], text: str) -> DataFrame:
    """Adds m_<kind> (matches in order) and p_<kind> (the pieces between them)."""
    none, t = F.array().cast("array<string>"), F.col(text)
    matches = {f"m_{k}": F.when(_possible(k, t), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for k, p in kinds.items()}
    pieces = {f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split(t, p, -1)).otherwise(none) for k, p in kinds.items()}
    return df.withColumns(matches).withColumns(pieces)


def _spans(kind: str, context: bool) -> Column:
    """Spans from m_<kind> and p_<kind>: running lengths in blocks of STEP matches."""
    m, p = f"m_{kind}", f"p_{kind}"
    before = rf"reverse(regexp_extract(reverse(element_at({p}, i)), r'^(\s*+\S*+\s*+\S*+)', 1))"
    words = (before, rf"regexp_extract(element_at({p}, i + 1), r'^\s*+(\S*+)', 1)") if context else ("''", "''")
    own = f"b * {STEP} + 1"
    size = f"aggregate(slice({{c}}, CAST({own} AS INT), {STEP}), 0L, (a, x) -> a + length(x))"
    return F.expr(f"""
      CASE WHEN size({m}) = 0 THEN CAST(array() AS array<{_SPAN}>) ELSE
      flatten(flatten(transform(array(transform(sequence(0, (size({m}) - 1) div {STEP}), b -> {size.format(c=p)} + {size.format(c=m)})), sizes ->
        transform(sequence(0, (size({m}) - 1) div {STEP}), b ->
          aggregate(
            sequence(CAST({own} AS INT), CAST(least(size({m}), (b + 1) * {STEP}) AS INT)),
            named_struct('at', aggregate(slice(sizes, 1, CAST(b AS INT)), 0L, (a, x) -> a + x), 'out', CAST(array() AS array<{_SPAN}>)),
            (s, i) -> named_struct(
              'at', s.at + length(element_at({p}, i)) + length(element_at({m}, i)),
              'out', array_append(s.out, named_struct('kind', '{kind}', 'start', s.at + length(element_at({p}, i)), 'stop', s.at + length(element_at({p}, i)) + length(element_at({m}, i)), 'match', element_at({m}, i), 'lhs', {words[0]}, 'rhs', {words[1]})))
          ).out)))) END""")


def base_spans(df: DataFrame, text: str, context: bool = False) -> DataFrame:
    """Adds base_<kind>: the valid spans of each kind, by start."""
    found = _found(df, PATTERNS, text).withColumns({f"base_{k}": _spans(k, context) for k in KINDS})
    found = found.withColumns({f"base_{k}": F.filter(f"base_{k}", _checked(k)) for k in KINDS if k != "email"})
    return found.drop(*[f"{c}_{k}" for c in "mp" for k in KINDS])


def _occurrence(span: Column) -> Column:
    """kind, start, stop, instance and its patterns, of a span with its words before and after."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]+", "0"), r"\s+", " "))
    before, after = plain(span["lhs"]), plain(span["rhs"])
    one = F.substring_index(before, " ", -1)
    patterns = F.array(F.when(before != "", F.concat(F.lit("L:"), before)), F.when((one != "") & (after != ""), F.concat(F.lit("B:"), one, F.lit(" _ "), after)))
    return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["stop"].alias("stop"), F.lower(span["match"]).alias("instance"), F.array_compact(patterns).alias("patterns"))


def scanned(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """key..., n_<kind>, base (spans by kind, then start) and seen (occurrences; kind 'candidate' for what isn't a seed), in one scan."""
    found = _found(base_spans(df, text, context=True), {"candidate": CANDIDATE}, text).withColumn("candidates", _spans("candidate", True))
    base = F.concat(*[F.col(f"base_{k}") for k in KINDS])
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    found = found.select(*key, *counts, base.alias("base"), F.concat(base, "candidates").alias("spans"))
    bare = F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["stop"]))
    return found.select(*key, *[f"n_{k}" for k in KINDS], bare.alias("base"), F.transform("spans", _occurrence).alias("seen"))


def occurrences(scan: DataFrame, key: list[str]) -> DataFrame:
    """One row per occurrence: key..., kind, start, stop, instance, patterns."""
    return scan.where(F.size("seen") > 0).select(*key, F.explode("seen").alias("s")).select(*key, "s.*")


def score_patterns(occ: DataFrame, rounds: int = 3, least_seeds: int = 3, smooth: float = 1.0) -> DataFrame:
    """(pattern, kind, score) for patterns with at least ``least_seeds`` distinct seed instances of that kind."""
    edges = occ.select(F.explode("patterns").alias("pattern"), "instance", "kind").groupBy("pattern", "instance").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("kind") != "candidate", F.col("kind"))).alias("seed")
    )
    edges = written(edges, "pii-edges")
    seeds = edges.where("seed IS NOT NULL")
    ready = seeds.groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least_seeds)
    edges = cut(edges.join(ready.select("pattern").distinct(), "pattern", "left_semi"))  # other patterns can never be used
    seeds = edges.where("seed IS NOT NULL").select("instance", F.col("seed").alias("kind")).distinct()
    total = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    marks = seeds.withColumn("mark", F.lit(1.0))
    for turn in range(rounds):
        hits = edges.join(marks, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("mark")).alias("hits"))
        scores = cut(hits.join(total, "pattern").join(ready, ["pattern", "kind"]).select("pattern", "kind", (F.col("hits") / (F.col("total") + smooth)).alias("score")))
        if turn + 1 == rounds:
            return scores
        mean = edges.join(scores, "pattern").groupBy("instance", "kind").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("mark"))
        marks = cut(mean.unionByName(seeds.withColumn("mark", F.lit(1.0))).groupBy("instance", "kind").agg(F.max("mark").alias("mark")))
    return edges.select("pattern", F.lit("").alias("kind"), F.lit(0.0).alias("score")).limit(0)


def discover(occ: DataFrame, key: list[str], scores: DataFrame, confidence: float = 0.8) -> DataFrame:
    """key..., kind, start, stop of candidates that stand in a pattern of high confidence."""
    sure = scores.where(F.col("score") >= confidence)
    tokens = occ.where("kind = 'candidate'").select(*key, "start", "stop", F.explode("patterns").alias("pattern"))
    best = tokens.join(sure, "pattern").groupBy(*key, "start", "stop").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    return best.select(*key, "kind", "start", "stop")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confidence: float = 0.8, rounds: int = 3) -> DataFrame:
    """(doc_id, h, base array<span>, added array<span>) per row; h tells rows of one doc_id apart by their text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    key = ["doc_id", "h"]
    scan = written(scanned(rows, key, "text"), "pii-scan")
    # the span checks belong to the row that is scanned; only (doc_id, h) leave it
    occ = occurrences(scan, key)
    added = discover(occ, key, score_patterns(occ, rounds), confidence)
    added = added.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("kind", "start", "stop"))).alias("added"))
    base = scan.drop("seen")
    out = base.join(added.withColumnRenamed("doc_id", "d").withColumnRenamed("h", "g"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left").drop("d", "g")
    own = F.coalesce(F.col("added"), F.array().cast("array<struct<kind:string,start:bigint,stop:bigint>>"))
    return out.withColumn("added", F.when((F.size(own) > 0) & (F.size("base") > 0), _apart(own, F.col("base"))).otherwise(own))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _most_before(values: Column) -> Column:
    """For each of some longs above 0 the greatest before it (0 for the first), in blocks of STEP."""
    most = lambda c: F.coalesce(F.array_max(c), F.lit(0).cast("long"))
    blocks = lambda v: F.sequence(F.lit(0), ((F.size(v) - 1) / STEP).cast("int"))

    def block(of: Column, below: Column) -> Column:
        return F.transform(of, lambda _, i: F.greatest(below, most(F.slice(of, 1, i))))

    def every(v: Column, tops: Column) -> Column:
        return F.flatten(F.transform(blocks(v), lambda b: _let(F.slice(v, b * STEP + 1, STEP), lambda of: _let(most(F.slice(tops, 1, b)), lambda below: block(of, below)))))

    tops = lambda v: F.transform(blocks(v), lambda b: most(F.slice(v, b * STEP + 1, STEP)))
    return _let(values, lambda v: F.when(F.size(v) > 0, _let(tops(v), lambda top: every(v, top))).otherwise(v))


def _apart(added: Column, base: Column) -> Column:
    """The added spans that overlap no base span: no base span that starts before their end reaches beyond their start."""
    mark = lambda turn, at: lambda s: F.struct(s[at].alias("at"), F.lit(turn).alias("turn"), s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))
    order = F.array_sort(F.concat(F.transform(added, mark(0, "stop")), F.transform(base, mark(1, "start"))))

    def kept(marks: Column) -> Column:
        reach = _most_before(F.transform(marks, lambda s: F.when(s["turn"] == 1, s["stop"]).otherwise(F.lit(0).cast("long"))))
        free = F.filter(F.arrays_zip(marks.alias("s"), reach.alias("reach")), lambda z: (z["s"]["turn"] == 0) & (z["reach"] <= z["s"]["start"]))
        return F.array_sort(F.transform(free, lambda z: F.struct(z["s"]["kind"].alias("kind"), z["s"]["start"].alias("start"), z["s"]["stop"].alias("stop"))))

    return _let(order, kept)


def _between(chunks: Column, start: Column, stop: Column) -> Column:
    """The characters from ``start`` to before ``stop`` of a text in chunks of CHUNK."""
    chunk = lambda at: F.floor(at / CHUNK).cast("int")
    first, last, at = chunk(start), chunk(stop - 1), (start % CHUNK + 1).cast("int")
    head, tail = F.element_at(chunks, first + 1), F.element_at(chunks, last + 1)
    across = F.concat(F.substring(head, at, CHUNK), F.array_join(F.slice(chunks, first + 2, last - first - 1), ""), F.substring(tail, F.lit(1), ((stop - 1) % CHUNK + 1).cast("int")))
    return F.when(stop <= start, "").when(first == last, F.substring(head, at, (stop - start).cast("int"))).otherwise(across)


def _redacted(text: Column, spans: Column) -> Column:
    """``text`` with the spans, in order of start, stop and kind, replaced; spans that overlap become one, of the first one's kind."""

    def whole(chunks: Column) -> Column:
        done = _most_before(F.transform(spans, lambda s: s["stop"]))
        parts = F.zip_with(spans, done, lambda s, at: F.when(s["start"] >= at, F.concat(_between(chunks, at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(""))
        rest = _between(chunks, F.array_max(F.transform(spans, lambda s: s["stop"])), F.length(text).cast("long"))
        return F.concat(F.array_join(parts, ""), rest)

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0)), whole)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; overlapping spans become one."""
    spans = find(docs, id_col, text_col).where("size(base) + size(added) > 0").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], s["stop"], s["kind"]))).alias("_s")).distinct()
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.join(spans, docs[id_col].eqNullSafe(F.col("_d")) & (h == F.col("_h")), "left")
    text = F.when(F.col("_s").isNull(), F.col(text_col)).otherwise(_redacted(F.col(text_col), F.col("_s")))
    return joined.withColumn(text_col, text).select(*docs.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    order = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(order, s["kind"]).alias("o"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(every).alias("spans"))
