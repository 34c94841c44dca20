"""The corpus over the given tables: views whose text means the same in Spark SQL and in DuckDB.

Each view is one SELECT over tables or earlier views in braces; ``frame`` gives it as a DataFrame
and ``ctes`` as the WITH list of an oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "roster_dev": """
        SELECT s_suppkey AS dev_ord, 'dev' || CAST(s_suppkey AS VARCHAR(20)) AS dev, s_name AS display_name,
               'acct' || CAST(s_suppkey AS VARCHAR(20)) AS account,
               CASE s_nationkey % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'dev' WHEN 2 THEN 'lead' WHEN 3 THEN 'qa' ELSE 'devops' END AS role
        FROM {supplier} WHERE s_suppkey % 10 <> 9""",
    "roster_login": """
        SELECT dev, 'dev' || CAST(dev_ord AS VARCHAR(20)) AS login FROM {roster_dev}
        UNION ALL SELECT dev, 'alt' || CAST(dev_ord AS VARCHAR(20)) AS login FROM {roster_dev} WHERE dev_ord % 3 = 0""",
    "issues": """
        SELECT 'ORD-' || CAST(o_orderkey AS VARCHAR(20)) AS issue_key, o_orderkey AS issue_ord, o_orderdate AS created,
               o_orderdate + (o_orderkey % 45) * INTERVAL '1' DAY AS updated,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + (o_orderkey % 60 + 1) * INTERVAL '1' DAY END AS resolved,
               'acct' || CAST(o_custkey % 100 AS VARCHAR(20)) AS assignee, 'acct' || CAST((o_custkey + 7) % 100 AS VARCHAR(20)) AS reporter,
               CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'EPIC-' || CAST(o_custkey % 40 AS VARCHAR(20)) END AS epic_key,
               CAST(CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 5 ELSE 8 END AS DOUBLE) AS story_points,
               CASE WHEN o_orderkey % 35 = 10 THEN 'Epic' WHEN o_orderkey % 7 = 0 THEN 'Bug' WHEN o_orderkey % 7 = 2 THEN 'Task' WHEN o_orderkey % 7 = 3 THEN 'Spike' WHEN o_orderkey % 7 = 4 THEN 'Defect' ELSE 'Story' END AS issue_type,
               CASE WHEN o_orderkey % 9 = 0 THEN 'claude-gen' WHEN o_orderkey % 9 = 1 THEN 'Claude_Gen' WHEN o_orderkey % 9 = 2 THEN 'FE' WHEN o_orderkey % 9 = 3 THEN 'backend' WHEN o_orderkey % 9 = 4 THEN 'DevOps' WHEN o_orderkey % 9 = 5 THEN 'regression' ELSE 'misc' END AS label,
               CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'In Progress' ELSE 'To Do' END AS status
        FROM {orders}""",
    "changelog": """
        SELECT DISTINCT 'ORD-' || CAST(l_orderkey AS VARCHAR(20)) AS issue_key, l_shipdate + l_linenumber * INTERVAL '1' HOUR AS at,
               l_partkey * 10 + l_linenumber AS ord, 'acct' || CAST(l_suppkey AS VARCHAR(20)) AS author,
               CASE l_linenumber % 7 WHEN 1 THEN 'To Do' WHEN 2 THEN 'In Progress' WHEN 3 THEN 'Code Review' WHEN 4 THEN 'Ready QA' WHEN 5 THEN 'In QA' WHEN 6 THEN 'In Progress' ELSE 'Done' END AS to_status,
               CASE l_partkey % 6 WHEN 1 THEN 'To Do' WHEN 2 THEN 'In Progress' WHEN 3 THEN 'Code Review' WHEN 4 THEN 'Ready QA' WHEN 5 THEN 'In QA' ELSE 'Done' END AS from_status
        FROM {lineitem}""",
    "prs": """
        SELECT l_orderkey * 10000 + l_suppkey AS pr_number, 'org/r' || CAST(l_suppkey % 8 AS VARCHAR(20)) AS repo,
               'dev' || CAST(l_suppkey AS VARCHAR(20)) AS author, 'ORD-' || CAST(l_orderkey AS VARCHAR(20)) AS issue_key,
               MIN(l_shipdate) AS created, CASE WHEN MIN(l_linestatus) = 'F' THEN MAX(l_shipdate) + INTERVAL '1' DAY END AS merged,
               CAST(SUM(l_quantity) AS BIGINT) * 10 AS additions, CAST(SUM(l_linenumber) AS BIGINT) * 5 AS deletions,
               CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS inline_comments,
               CAST(SUM(CASE WHEN l_returnflag = 'R' AND l_linenumber > 5 THEN 1 ELSE 0 END) AS BIGINT) AS deep_threads,
               CASE l_orderkey % 9 WHEN 0 THEN 'Promote develop' WHEN 1 THEN 'Merge to main' ELSE 'Order work' END AS title,
               CASE l_suppkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'release/1' WHEN 2 THEN 'develop' ELSE 'feature/a' END AS branch,
               CASE l_suppkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'topic' ELSE 'release/2' END AS base_branch
        FROM {lineitem} GROUP BY l_orderkey, l_suppkey""",
    "pr_keys": """
        SELECT DISTINCT l_orderkey * 10000 + l_suppkey AS pr_number, 'org/r' || CAST(l_suppkey % 8 AS VARCHAR(20)) AS repo, 'ORD-' || CAST(l_orderkey AS VARCHAR(20)) AS issue_key FROM {lineitem} WHERE l_suppkey % 11 <> 0
        UNION ALL SELECT DISTINCT l_orderkey * 10000 + l_suppkey AS pr_number, 'org/r' || CAST(l_suppkey % 8 AS VARCHAR(20)) AS repo, 'ord-' || CAST(l_orderkey + 1 AS VARCHAR(20)) AS issue_key FROM {lineitem} WHERE l_suppkey % 5 = 0""",
    "comments": """
        SELECT 'ORD-' || CAST(l_orderkey AS VARCHAR(20)) AS issue_key, l_shipdate - INTERVAL '3' DAY AS at,
               CASE WHEN l_partkey % 3 = 0 THEN 'see https://docs.google.com/d/' || CAST(l_partkey % 20 AS VARCHAR(20)) WHEN l_partkey % 7 = 0 THEN 'plan in discovery/p' || CAST(l_partkey % 5 AS VARCHAR(20)) || '.md' ELSE 'ok' END AS body
        FROM {lineitem} WHERE l_returnflag = 'A'""",
    "issue_links": """
        SELECT 'ORD-' || CAST(l_orderkey AS VARCHAR(20)) AS issue_key, CASE WHEN l_linenumber % 2 = 0 THEN 'ORD-' ELSE 'ord-' END || CAST(l_partkey % 50 AS VARCHAR(20)) AS counterpart,
               CASE l_linenumber % 4 WHEN 0 THEN 'subtask' WHEN 1 THEN 'Defect' ELSE 'Relates' END AS link_type, CASE WHEN l_partkey % 2 = 0 THEN 'outward' ELSE 'inward' END AS direction,
               CASE l_linenumber % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'Clones' ELSE 'relates to' END AS phrase
        FROM {lineitem} WHERE l_returnflag = 'R'""",
    "pr_files": """
        SELECT l_orderkey * 10000 + l_suppkey AS pr_number, 'org/r' || CAST(l_suppkey % 8 AS VARCHAR(20)) AS repo,
               LOWER(REPLACE(p_type, ' ', '/')) || '/' || LOWER(REPLACE(p_brand, '#', '')) || '/' || REPLACE(p_name, ' ', '-') ||
               CASE p_size % 7 WHEN 0 THEN '.go' WHEN 1 THEN '.ts' WHEN 2 THEN '.json' WHEN 3 THEN '.lock' WHEN 4 THEN '.md' WHEN 5 THEN '.sql' ELSE '_test.go' END AS path,
               MAX(CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'removed' ELSE 'modified' END) AS status,
               CAST(SUM(l_quantity) AS BIGINT) AS additions, CAST(SUM(l_linenumber) AS BIGINT) AS deletions
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "pr_commits": """
        SELECT DISTINCT l_orderkey * 10000 + l_suppkey AS pr_number, 'org/r' || CAST(l_suppkey % 8 AS VARCHAR(20)) AS repo, 's' || CAST(l_partkey AS VARCHAR(20)) AS sha,
               CASE WHEN l_partkey % 11 = 0 THEN '' ELSE 'dev' || CAST((l_suppkey + l_partkey % 3) % 100 AS VARCHAR(20)) END AS author,
               CASE WHEN l_linenumber % 5 = 0 THEN 2 ELSE 1 END AS parent_count
        FROM {lineitem}""",
    "commits": """
        SELECT DISTINCT 'c' || CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_partkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) || '-' || CAST(l_suppkey AS VARCHAR(20)) || '-' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20)) AS sha,
               'org/r' || CAST(l_suppkey % 8 AS VARCHAR(20)) AS repo, 'dev' || CAST(l_suppkey AS VARCHAR(20)) AS author, l_shipdate AS committed,
               'ORD-' || CAST(l_orderkey AS VARCHAR(20)) AS issue_key
        FROM {lineitem}""",
    "reviews": """
        SELECT DISTINCT l_orderkey * 10000 + l_suppkey AS pr_number, 'org/r' || CAST(l_suppkey % 8 AS VARCHAR(20)) AS repo,
               CASE WHEN l_partkey % 13 = 0 THEN 'renovate[bot]' ELSE 'dev' || CAST((l_suppkey + 3) % 100 AS VARCHAR(20)) END AS reviewer,
               CASE l_linenumber % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'CHANGES_REQUESTED' ELSE 'COMMENTED' END AS state,
               l_shipdate + INTERVAL '5' HOUR AS submitted, l_partkey AS review_ord
        FROM {lineitem} WHERE l_returnflag = 'R'""",
}
#: Forms of a view for Spark alone: the rows that a view counts apart, told apart by the numbers that they are made of instead of
#: by the strings made of those; the least or greatest string by its place in their order, as Spark hashes groups with numbers
#: but sorts those with strings; and what a view is grouped from, for operators that group by more or by less.
FORMS = {
    "prs": VIEWS["prs"].replace("MIN(l_linestatus) = 'F'", "MIN(CASE WHEN l_linestatus < 'F' THEN 0 WHEN l_linestatus = 'F' THEN 1 WHEN l_linestatus > 'F' THEN 2 END) = 1"),
    "pr_files": VIEWS["pr_files"].replace(
        "MAX(CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'removed' ELSE 'modified' END)",
        "CASE MAX(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 2 ELSE 1 END) WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'removed' END",
    ),
    "commits": re.sub(
        r"SELECT DISTINCT (.*)FROM \{lineitem\}",
        r"""SELECT \1FROM (
            SELECT DISTINCT l_orderkey, l_suppkey, l_shipdate, CASE WHEN named THEN l_partkey END AS l_partkey, CASE WHEN named THEN l_linenumber END AS l_linenumber
            FROM (SELECT *, l_orderkey IS NOT NULL AND l_suppkey IS NOT NULL AND l_partkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_shipdate IS NOT NULL AS named FROM {lineitem}))""",
        VIEWS["commits"],
        flags=re.DOTALL,
    ),
    "moves": VIEWS["changelog"].replace("SELECT DISTINCT", "SELECT"),  # for distinct counts, to which repeated rows are nothing
    "file_lines": """
        SELECT l_orderkey * 10000 + l_suppkey AS pr_number, 'org/r' || CAST(l_suppkey % 8 AS VARCHAR(20)) AS repo, l_partkey AS file,
               COALESCE(l_returnflag = 'A', FALSE) AS added, l_quantity AS additions, l_linenumber AS deletions
        FROM {lineitem}""",
    "file_paths": re.sub(r".*AS repo,\s*(.*?) AS path,.*", r"SELECT p_partkey AS file, \1 AS path FROM {part}", VIEWS["pr_files"], flags=re.DOTALL),
}
#: Forms whose table is dealt by what a key of the view is made of, before its rows are grouped: what travels are the numbers of
#: the table, and groups, windows and joins by that key need no other exchange.  Rows of
#: keys may repeat.
NUMBER = "'org/r' || CAST(l_suppkey % 8 AS VARCHAR(20)), l_orderkey * 10000 + l_suppkey"
TICKET = "'ORD-' || CAST({}_orderkey AS VARCHAR(20))"


def _dealt(text: str, table: str, keys: str) -> str:
    return text.replace(f"{{{table}}}", f"(SELECT * FROM {{{table}}} DISTRIBUTE BY {keys})")


FORMS |= {
    "number_prs": _dealt(FORMS["prs"].replace("GROUP BY l_orderkey, l_suppkey", f"GROUP BY l_orderkey, l_suppkey, {NUMBER}"), "lineitem", NUMBER),
    "number_reviews": _dealt(VIEWS["reviews"], "lineitem", NUMBER),
    "number_keys": _dealt(
        """
        SELECT l_orderkey * 10000 + l_suppkey AS pr_number, 'org/r' || CAST(l_suppkey % 8 AS VARCHAR(20)) AS repo,
               EXPLODE(ARRAY_COMPACT(ARRAY(CASE WHEN l_suppkey % 11 <> 0 THEN 'ORD-' || CAST(l_orderkey AS VARCHAR(20)) END, CASE WHEN l_suppkey % 5 = 0 THEN 'ord-' || CAST(l_orderkey + 1 AS VARCHAR(20)) END))) AS issue_key
        FROM {lineitem}""",
        "lineitem",
        NUMBER,
    ),
    "ticket_issues": _dealt(VIEWS["issues"], "orders", TICKET.format("o")),
    "ticket_moves": _dealt(VIEWS["changelog"], "lineitem", TICKET.format("l")),
    "ticket_prs": _dealt(FORMS["prs"].replace("GROUP BY l_orderkey, l_suppkey", f"GROUP BY l_orderkey, l_suppkey, {TICKET.format('l')}"), "lineitem", TICKET.format("l")),
    "ticket_pushes": _dealt(VIEWS["commits"].replace("SELECT DISTINCT", "SELECT"), "lineitem", TICKET.format("l")),  # for times of commits, to which repeated rows are nothing
    "ticket_commits": _dealt(
        FORMS["commits"].replace(f"{TICKET.format('l')} AS issue_key", "issue_key").replace("SELECT DISTINCT l_orderkey", f"SELECT DISTINCT {TICKET.format('l')} AS issue_key, l_orderkey"), "lineitem", TICKET.format("l")
    ),
    "ticket_keys": " UNION ALL ".join(
        f"""
        SELECT l_orderkey * 10000 + l_suppkey AS pr_number, 'org/r' || CAST(l_suppkey % 8 AS VARCHAR(20)) AS repo, {key} AS issue_key FROM (SELECT * FROM {{lineitem}} DISTRIBUTE BY {key}) WHERE {which}"""
        for key, which in ((TICKET.format("l"), "l_suppkey % 11 <> 0"), ("'ORD-' || CAST(l_orderkey + 1 AS VARCHAR(20))", "l_suppkey % 5 = 0"))
    ),  # in upper case
    "ticket_comments": _dealt(VIEWS["comments"], "lineitem", TICKET.format("l")),
    "ticket_links": _dealt(VIEWS["issue_links"], "lineitem", TICKET.format("l")),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view of the corpus, in Spark's form if it has one."""
    text = FORMS.get(name) or VIEWS.get(name)
    if text is None:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(text, **{n: frame(spark, sf_dir, n) for n in _needs(text)})


def oracle(text: str) -> str:
    """DuckDB SQL of a query in which tables and views stand in braces."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _needs(VIEWS[name]):
            if n in VIEWS:
                visit(n)
        if name not in order:
            order.append(name)

    for n in _needs(text):
        if n in VIEWS:
            visit(n)
    # DuckDB reserves "at"
    plain = lambda s: re.sub(r'(?<![\w"])at(?![\w"])', '"at"', re.sub(r"\{(\w+)\}", r"\1", s))
    ctes = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(text).strip()
    if not ctes:
        return body
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
