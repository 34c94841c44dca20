"""Scalar functions over strings, labels and paths, all as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import BOTS

KEY = r"\b[A-Z][A-Z0-9]+-\d+\b"
BUG_WORDS = ("bug", "regression", "hotfix", "defect")


def issue_keys(*columns: Column) -> Column:
    """Distinct issue keys over several columns, in first-seen order."""
    found = [F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(KEY), F.lit(0)) for c in columns]
    return F.array_distinct(F.flatten(F.array(*found)))


def links(text: Column, hints: tuple[str, ...]) -> Column:
    """Distinct URLs that hold a hint, and repository paths to plans."""
    urls = F.transform(F.regexp_extract_all(text, F.lit(r"https?://\S+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", ""))
    hint = "|".join(re.escape(h) for h in hints)
    refs = F.regexp_extract_all(text, F.lit(r"(?:implementation|discovery)/[\w./-]+\.md"), F.lit(0))
    return F.array_union(F.filter(urls, lambda u: F.lower(u).rlike(hint)), refs)


def substantive(comment: Column, hints: tuple[str, ...]) -> Column:
    """A code fence, a document link, or 200 bytes and more."""
    return F.contains(comment, F.lit("```")) | (F.size(links(comment, hints)) > 0) | (F.octet_length(F.trim(comment)) >= 200)


def spawned(link_type: Column, direction: Column, phrase: Column) -> Column:
    """Whether a link leads to follow-up work: a subtask, or outward with a phrase of creation."""
    return (F.lower(link_type) == "subtask") | ((F.lower(direction) == "outward") & F.lower(phrase).rlike("created|clone|split"))


def is_bug(issue_type: Column, labels: Column) -> Column:
    words = F.array(*[F.lit(w) for w in BUG_WORDS])
    return F.array_contains(words, F.lower(F.trim(issue_type))) | F.exists(labels, lambda x: F.array_contains(words, F.lower(F.trim(x))))


def is_spike(issue_type: Column, labels: Column, summary: Column) -> Column:
    return (F.lower(F.trim(issue_type)) == "spike") | F.exists(labels, lambda x: F.lower(F.trim(x)).isin("spike", "investigate")) | summary.rlike(r"(?i)\bspike\b")


def disciplines(labels: Column) -> Column:
    low = F.transform(labels, lambda x: F.lower(F.trim(x)))
    have = lambda name, *words: F.when(reduce(Column.__or__, [F.array_contains(low, w) for w in words]), F.lit(name))
    return F.array_compact(F.array(have("FE", "fe", "frontend"), have("BE", "be", "backend"), have("DevOps", "devops")))


def has_tag(labels: Column, tag: str = "claudegen") -> Column:
    return F.exists(labels, lambda x: F.regexp_replace(F.lower(x), r"[_\-. ]", "") == tag)


def extension(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    return F.when(F.contains(base, F.lit(".")), F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))).otherwise("")


def top_dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.element_at(F.split(path, "/"), 1)).otherwise("")


def dir_at_depth(path: Column, depth: int) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.least(F.lit(depth), F.size(parts) - 1)), "/")


def migration_dir(path: Column) -> Column:
    """The path down to its migration segment, or the parent of a script under resources."""
    seg = F.regexp_extract(path, r"^((?:.*/)?(?:db/changelog|migrations|liquibase|flyway))/", 1)
    sql = F.when(path.rlike(r"(^|/)resources/") & (extension(path) == "sql"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise("")
    return F.when(seg != "", seg).otherwise(sql)


def is_test_file(path: Column) -> Column:
    return path.rlike(r"(^|/)(tests?|__tests__|spec|e2e)/") | path.rlike(r"(_test\.[A-Za-z]+|\.(test|spec)\.[A-Za-z]+|Tests?\.(java|kt|scala))$")


def is_resource_file(path: Column) -> Column:
    return extension(path).isin("json", "yaml", "yml", "xml", "md", "txt", "csv", "properties", "lock", "svg", "png", "toml", "ini")


def glob_regex(pattern: str) -> str:
    """A path pattern whose * doesn't cross a slash, on the base name or the whole path; */seg/* means the segment anywhere."""
    p = pattern.lower()
    if m := re.fullmatch(r"\*/([^*?\[]+)/\*", p):
        return rf"(?:.*/|^){re.escape(m[1])}/.*"
    body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in p)
    return rf"(?:.*/)?{body}" if "/" not in p else body


def matches_generated(path: Column, patterns: tuple[str, ...]) -> Column:
    """One compiled alternation, whatever the number of patterns."""
    return F.lower(path).rlike("^(?:" + "|".join(glob_regex(p) for p in patterns) + ")$") if patterns else F.lit(False)


def doublestar_regex(glob: str) -> str:
    """A glob whose ** spans segments; without a wildcard, its segments anywhere in the path."""
    if not re.search(r"[*?\[]", glob):
        return rf"(?:^|/){re.escape(glob.strip('/'))}(?:/|$)"
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"^{out}$"


def first_glob(path: Column, globs: tuple[str, ...]) -> Column:
    """The first matching glob in the order given, or null."""
    return F.coalesce(*[F.when(path.rlike(doublestar_regex(g)), F.lit(g)) for g in globs], F.lit(None).cast("string"))


def bot_regex(patterns: tuple[str, ...] = BOTS) -> str:
    def one(p: str) -> str:
        p = p.lower()
        return (".*" if p.startswith("*") else "") + re.escape(p.strip("*")) + (".*" if p.endswith("*") and len(p) > 1 else "")

    return "^(?:" + "|".join(one(p) for p in dict.fromkeys(patterns)) + ")$"


def is_bot(login: Column, patterns: tuple[str, ...] = BOTS) -> Column:
    return F.lower(login).rlike(bot_regex(patterns))


def family_stem(path: Column, most: int = 4) -> Column:
    """A path with its base name's short alphanumeric tokens masked, or null if none is."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    name = F.regexp_replace(base, r"\.[^.]*$", "")
    short = lambda t: (F.length(t) <= most) & t.rlike("^[A-Za-z0-9]+$")
    tokens = F.split(name, r"[-_.]")
    masked = F.array_join(F.transform(tokens, lambda t: F.when(short(t), F.lit("#")).otherwise(t)), "-")
    folder = F.regexp_extract(path, r"^(.*/)?", 0)
    return F.when(F.exists(tokens, short), F.concat(folder, masked, F.lit("."), extension(path)))


def seed_term(folder: Column, terms: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(F.lower(folder), r"[/\-_.]+"), F.array(*[F.lit(t) for t in terms]))


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def browse_url(base: Column, key: Column) -> Column:
    return F.when((base == "") | (key == ""), F.lit("")).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/browse/"), key))


def parse_time(s: Column) -> Column:
    """Four layouts in turn; what fits none is null."""
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss.SSSZ", "yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX")])


def score_comment(points: Column, was: Column, hardest: Column, drivers: Column, signals: Column) -> Column:
    others = F.slice(F.filter(drivers, lambda d: d != hardest), 1, 3)
    return F.concat_ws("\n", F.concat(F.lit("Estimate: "), points.cast("string"), F.when(was.isNotNull(), F.concat(F.lit(" (was "), was.cast("string"), F.lit(")"))).otherwise("")), F.concat(F.lit("Hardest: "), hardest), F.when(F.size(others) > 0, F.concat(F.lit("Also: "), F.array_join(others, "; "))), F.concat(F.lit("Signals: "), signals))
