"""Queries on content: text functions, decoding, identity, fields, cells and increments, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import DOC_HINTS, GENERATED_PATHS, RISK_GLOBS, SEED_TERMS
from tidemark.functions import calendar as cal
from tidemark.functions import text as tx
from tidemark.operators import fields, people
from tidemark.plans.activity import NOISE, D, n
from tidemark.sources import corpus_files, decode

#: Raw tracker JSON made from orders, as text that means the same in both engines.
RAW_ISSUE = """'{"key":"ORD-' || CAST(o_orderkey AS VARCHAR(20)) || '","fields":{"summary":"Order ' || o_orderpriority || '","status":{"name":"' || o_orderstatus || '"},"issuetype":{"name":"Story"},"created":"1998-0' || CAST(o_orderkey % 9 + 1 AS VARCHAR(2)) || '-11T08:30:00.000+0000","updated":"1999-01-01T00:00:00.000+0000",' ||
  CASE WHEN o_orderkey % 3 = 0 THEN '"assignee":{"accountId":"acct' || CAST(o_custkey % 100 AS VARCHAR(20)) || '"},' ELSE '' END || '"customfield_1":' || CAST(o_orderkey % 8 AS VARCHAR(2)) || ',"labels":["a","b' || CAST(o_orderkey % 4 AS VARCHAR(2)) || '"],"subtasks":[{"key":"ORD-1"}],"issuelinks":[{"type":{"name":"Relates","outward":"relates to","inward":"is related"},"' ||
  CASE WHEN o_orderkey % 2 = 0 THEN 'outwardIssue' ELSE 'inwardIssue' END || '":{"key":"ORD-2"}}]},"changelog":{"histories":[{"created":"1999-02-02T02:02:02.000+0000","author":{"accountId":"x"},"items":[{"field":"status","fromString":"To Do","toString":"Done"},{"field":"rank","fromString":"1","toString":"2"}]}]}}'"""


RAW_REQUEST = """'{"number":' || CAST(o_orderkey AS VARCHAR(20)) || ',"title":"fix ABC-' || CAST(o_custkey AS VARCHAR(20)) || '","body":"see ORD-' || CAST(o_orderkey AS VARCHAR(20)) || '","state":"closed","user":{"login":"dev' || CAST(o_custkey % 9 AS VARCHAR(20)) || '"},"head":{"ref":"f/x"},"base":{"ref":"main"},"created_at":"1998-01-0' || CAST(o_orderkey % 9 + 1 AS VARCHAR(2)) ||
  'T08:30:00.000+0000",' || CASE WHEN o_orderkey % 2 = 0 THEN '"merged_at":"1999-01-02T00:00:00.000+0000",' ELSE '' END || '"additions":' || CAST(o_custkey AS VARCHAR(20)) || ',"deletions":1,"review_comments":' || CAST(o_orderkey % 4 AS VARCHAR(2)) || ',"url":"https://api.example.com/repos/org/r' || CAST(o_orderkey % 3 AS VARCHAR(2)) || '/pulls/1"}'"""
RAW_COMMIT = """'{"sha":"s' || CAST(o_orderkey AS VARCHAR(20)) || '","url":"https://api.example.com/repos/org/r' || CAST(o_orderkey % 3 AS VARCHAR(2)) || '/commits/1","author":{"login":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'dev' || CAST(o_custkey AS VARCHAR(20)) ELSE '' END || '"},"commit":{"message":"ORD-' || CAST(o_orderkey AS VARCHAR(20)) || ' done","author":{"name":"Name ' || CAST(o_custkey AS VARCHAR(20)) ||
  '","date":"1998-0' || CAST(o_orderkey % 9 + 1 AS VARCHAR(2)) || '-11T08:30:00.000+0000"}},"parents":[{"sha":"a"}' || CASE WHEN o_orderkey % 2 = 1 THEN ',{"sha":"b"}' ELSE '' END || ']}'"""
RAW_REVIEW = """'{"user":{"login":"dev' || CAST(o_custkey % 9 AS VARCHAR(20)) || '"},"state":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'APPROVED' ELSE 'COMMENTED' END || '","pull_request_url":"https://api.example.com/repos/org/r' || CAST(o_orderkey % 3 AS VARCHAR(2)) || '/pulls/' || CAST(o_orderkey AS VARCHAR(20)) || '"' ||
  CASE WHEN o_orderkey % 4 <> 0 THEN ',"submitted_at":"1998-02-0' || CAST(o_orderkey % 9 + 1 AS VARCHAR(2)) || 'T00:00:00.000+0000"' ELSE '' END || '}'"""


def _raw(t):
    return t("orders").select("o_orderkey", F.expr(RAW_ISSUE).alias("raw"))


def rich_text(t):
    """Documents as rich-text trees, flattened again: what comes out is the trimmed text of the paragraphs."""
    tree = F.to_json(F.struct(F.lit("doc").alias("type"), F.array(F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))).alias("content")))
    flat = t("conversations").select("conv_id", "turn", decode.flatten_rich_text(tree).alias("f"))
    return flat.groupBy("conv_id").agg(F.sum(F.length("f.text")).alias("chars"), F.sum(F.size("f.urls")).cast("long").alias("urls"))


def manifest(t):
    cells = t("orders").select(F.concat(F.lit("P"), F.col("o_custkey") % 5).alias("scope"), cal.month_key("o_orderdate").alias("month"))
    return corpus_files.cell_manifest(cells, "issues")


def stale(t):
    cells = manifest(t).withColumn("pulled_at", F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1) + F.expr("make_dt_interval(0)") - F.when(F.substring("month", 7, 1) == "5", F.expr("INTERVAL '2' DAY")).otherwise(F.expr("INTERVAL '-2' DAY")))
    grid = manifest(t).select("scope", "month").unionByName(manifest(t).select("scope", F.lit("2003-01").alias("month")).distinct())
    return corpus_files.stale_cells(grid, cells, F.lit("2001-08-03").cast("date")).groupBy("month").agg(F.sum(F.col("stale").cast("long")).alias("stale"))


def carried(t):
    old = t("orders").where("o_orderkey % 4 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit("1990-01-01").cast("timestamp_ntz")).otherwise(F.col("o_orderdate")).alias("updated"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("detail"))
    fresh = t("orders").select("o_orderkey", F.col("o_orderdate").alias("updated"), F.lit(None).cast("string").alias("detail"))
    return corpus_files.carry_forward(old, fresh, "o_orderkey", ["detail"]).groupBy("detail").agg(F.count("*").alias("n")).fillna("", ["detail"])


def identity_candidates(t):
    logins = t("customer").select(F.lower(F.concat(F.substring("c_mktsegment", 1, 1), F.substring_index("c_name", "#", -1))).alias("login"))
    names = t("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("account"), F.concat(F.initcap("c_mktsegment"), F.lit(" "), F.substring_index("c_name", "#", -1)).alias("name"))
    return people.candidates(logins, names).select("login", "account", F.round("score", D).alias("score"), n("rank"))


def raw_profile(t):
    rows = _raw(t).select(F.col("o_orderkey").alias("key"), F.get_json_object("raw", "$.fields").alias("j"))
    return fields.profile(fields.raw_fields(rows, "key", "j"))


#: Parts as fields of a catalog whose names come again, and lineitems as the records that hold and can set them.
CATALOG = """SELECT 'f' || CAST(p_partkey AS VARCHAR(20)) AS field_id, p_partkey AS ord, CASE p_partkey % 40 WHEN 7 THEN ' Story Points' WHEN 9 THEN 'Story point estimate' WHEN 11 THEN 'Release Description' WHEN 13 THEN 'Description' WHEN 17 THEN 'Points of interest' ELSE p_name END AS name FROM {part}"""
HELD = "SELECT 'f' || CAST(l_partkey AS VARCHAR(20)) AS field_id, count(*) AS sampled, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS populated FROM {lineitem} GROUP BY l_partkey"
SETTABLE = "SELECT 'f' || CAST(l_partkey AS VARCHAR(20)) AS field_id, count(*) AS n FROM {lineitem} WHERE l_linenumber > 3 GROUP BY l_partkey"


def field_mappings(t):
    sql = lambda text, *names: t("region").sparkSession.sql(text, **{x: t(x) for x in names})
    catalog = sql(CATALOG, "part")
    found = fields.mappings(sql(HELD, "lineitem"), catalog, sql(SETTABLE, "lineitem").join(catalog.select("field_id", "name"), "field_id"))
    return found.select("role", "field_id", F.trim("name").alias("name"), n("populated"), n("sampled"), n("settable"), "warning")


FIELD_MAPPINGS_SQL = f"""WITH ca AS ({CATALOG}), he AS ({HELD}), se AS ({SETTABLE}),
  a AS (SELECT 'story_points' AS role, field_id, name FROM se JOIN ca USING (field_id) WHERE lower(trim(name)) IN ('story points', 'story point estimate') ORDER BY n DESC, name, field_id LIMIT 1),
  d AS (SELECT 'description' AS role, field_id, name FROM he JOIN ca USING (field_id) WHERE contains(lower(name), 'description') ORDER BY populated DESC, name, field_id LIMIT 1),
  al AS (SELECT * FROM a UNION ALL SELECT * FROM d UNION ALL SELECT 'epic_link', 'parent', 'Parent')
  SELECT role, field_id, trim(name) AS name, coalesce(populated, 0) AS populated, coalesce(sampled, 0) AS sampled, coalesce(n, 0) AS settable, false AS warning FROM al LEFT JOIN he USING (field_id) LEFT JOIN se USING (field_id)"""


QUERIES = {
    "text_issue_keys": (
        lambda t: t("orders").select(F.explode(tx.issue_keys(F.concat(F.lit("fix ABC-"), F.col("o_custkey").cast("string"), F.lit(": x")), F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string"), F.lit(" ABC-"), F.col("o_custkey").cast("string")))).alias("issue_key")).groupBy("issue_key").agg(F.count("*").alias("n")),
        "SELECT k AS issue_key, count(*) AS n FROM (SELECT 'ABC-' || o_custkey AS k FROM {orders} UNION ALL SELECT 'ORD-' || o_orderkey FROM {orders}) GROUP BY 1",
    ),
    "text_links": (
        lambda t: t("pages").select("page_id", F.size(tx.links(F.concat(F.col("url"), F.lit(" "), F.coalesce("html", F.lit(""))), ("example",))).cast("long").alias("links")).agg(F.sum("links").alias("links"), F.count("*").alias("pages")),
        r"""WITH p AS (SELECT page_id, url || ' ' || coalesce(html, '') AS s FROM {pages}),
            u AS (SELECT page_id, unnest(list_transform(regexp_extract_all(s, 'https?://\S+'), lambda x: regexp_replace(x, '[.,;:!?)]+$', ''))) AS link FROM p),
            k AS (SELECT page_id, link FROM u WHERE regexp_matches(lower(link), 'example') UNION SELECT page_id, unnest(regexp_extract_all(s, '(?:implementation|discovery)/[\w./-]+\.md')) FROM p)
            SELECT CAST((SELECT count(*) FROM k) AS BIGINT) AS links, count(*) AS pages FROM p""",
    ),
    "text_substantive": (
        lambda t: t("conversations").groupBy("role").agg(F.sum(tx.substantive(F.col("text"), DOC_HINTS).cast("long")).alias("n")),
        "SELECT role, CAST(sum(CASE WHEN contains(text, '```') OR strlen(trim(text)) >= 200 OR len(list_filter(regexp_extract_all(text, 'https?://\\S+'), lambda u: regexp_matches(lower(u), 'confluence|docs\\.google|notion|example\\.com'))) > 0 OR regexp_matches(text, '(implementation|discovery)/[\\w./-]+\\.md') THEN 1 ELSE 0 END) AS BIGINT) AS n FROM {conversations} GROUP BY role",
    ),
    "text_kinds": (
        lambda t: t("issues").groupBy("issue_type", "label", tx.is_bug(F.col("issue_type"), F.array("label")).alias("bug"), tx.is_spike(F.col("issue_type"), F.array("label"), F.col("issue_key")).alias("spike"), F.array_join(tx.disciplines(F.array("label")), ",").alias("disciplines"), tx.has_tag(F.array("label")).alias("tagged")).agg(F.count("*").alias("n")),
        """SELECT issue_type, label, lower(issue_type) IN ('bug','regression','hotfix','defect') OR lower(label) IN ('bug','regression','hotfix','defect') AS bug, lower(issue_type) = 'spike' AS spike,
             CASE label WHEN 'FE' THEN 'FE' WHEN 'backend' THEN 'BE' WHEN 'DevOps' THEN 'DevOps' ELSE '' END AS disciplines, label IN ('claude-gen', 'Claude_Gen') AS tagged, count(*) AS n FROM {issues} GROUP BY ALL""",
    ),
    "text_paths": (
        lambda t: t("pr_files").select("path").distinct().select("path", tx.extension(F.col("path")).alias("ext"), tx.top_dir(F.col("path")).alias("top"), tx.dir_at_depth(F.col("path"), 2).alias("dir"), tx.is_test_file(F.col("path")).alias("test"), tx.is_resource_file(F.col("path")).alias("resource"), tx.matches_generated(F.col("path"), GENERATED_PATHS).alias("generated"), F.coalesce(tx.first_glob(F.col("path"), RISK_GLOBS["high"]), F.lit("")).alias("glob"), tx.seed_term(F.col("path"), SEED_TERMS).alias("seed"), tx.slugify(F.col("path")).alias("slug")),
        rf"""WITH p AS (SELECT DISTINCT path FROM {{pr_files}}) SELECT path, lower(regexp_extract(path, '\.([^./]*)$', 1)) AS ext, split_part(path, '/', 1) AS top, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS dir, regexp_matches(path, '_test\.[A-Za-z]+$') AS test,
             lower(regexp_extract(path, '\.([^./]*)$', 1)) IN ('json','lock','md') AS resource, {NOISE} AS generated, CASE WHEN path LIKE 'promo/%' THEN '**/promo/**' ELSE '' END AS glob, false AS seed, regexp_replace(regexp_replace(path, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM p""",
    ),
    "text_bots": (
        lambda t: t("reviews").groupBy("reviewer").agg(F.max(tx.is_bot(F.col("reviewer"))).alias("bot")),
        "SELECT reviewer, bool_or(reviewer LIKE '%[bot]') AS bot FROM {reviews} GROUP BY 1",
    ),
    "text_comment": (
        lambda t: t("orders").select("o_orderkey", tx.score_comment(F.col("o_orderkey") % 8, F.when(F.col("o_orderkey") % 2 == 0, F.lit(3)), F.col("o_orderpriority"), F.array("o_orderpriority", F.lit("x"), F.lit("y"), F.lit("z"), F.lit("w")), F.col("o_orderstatus")).alias("comment")),
        "SELECT o_orderkey, 'Estimate: ' || (o_orderkey % 8) || CASE WHEN o_orderkey % 2 = 0 THEN ' (was 3)' ELSE '' END || chr(10) || 'Hardest: ' || o_orderpriority || chr(10) || 'Also: x; y; z' || chr(10) || 'Signals: ' || o_orderstatus AS comment FROM {orders}",
    ),
    "decode_issues": (
        lambda t: decode.decode_issues(_raw(t)).select("issue_key", "summary", "status", F.date_format("created", "yyyy-MM-dd HH:mm").alias("created"), "assignee", "story_points", F.array_join("labels", ",").alias("labels")),
        "SELECT 'ORD-' || o_orderkey AS issue_key, 'Order ' || o_orderpriority AS summary, o_orderstatus AS status, '1998-0' || (o_orderkey % 9 + 1) || '-11 08:30' AS created, CASE WHEN o_orderkey % 3 = 0 THEN 'acct' || (o_custkey % 100) ELSE '' END AS assignee, CAST(o_orderkey % 8 AS DOUBLE) AS story_points, 'a,b' || (o_orderkey % 4) AS labels FROM {orders}",
    ),
    "decode_relations": (
        lambda t: decode.decode_relations(_raw(t)).groupBy("counterpart", "link_type", "direction", "phrase", n("ord")).agg(F.count("*").alias("n")),
        """SELECT 'ORD-1' AS counterpart, 'subtask' AS link_type, 'outward' AS direction, 'subtask' AS phrase, CAST(0 AS BIGINT) AS ord, count(*) AS n FROM {orders}
           UNION ALL SELECT 'ORD-2', 'Relates', CASE WHEN o_orderkey % 2 = 0 THEN 'outward' ELSE 'inward' END, CASE WHEN o_orderkey % 2 = 0 THEN 'relates to' ELSE 'is related' END, 1, count(*) FROM {orders} GROUP BY 1, 2, 3, 4""",
    ),
    "decode_changelog": (
        lambda t: decode.decode_changelog(_raw(t)).groupBy("from_status", "to_status", "author").agg(F.count("*").alias("n")),
        "SELECT 'To Do' AS from_status, 'Done' AS to_status, 'x' AS author, count(*) AS n FROM {orders}",
    ),
    "decode_rich_text": (rich_text, "SELECT conv_id, CAST(sum(length(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'))) AS BIGINT) AS chars, CAST(sum(len(list_distinct(regexp_extract_all(text, 'https?://[^\\s<>\"]+')))) AS BIGINT) AS urls FROM {conversations} GROUP BY 1".replace("{{3,}}", "{3,}")),
    "identity_scan": (
        lambda t: people.unmapped(people.scan_identities(t("prs"), t("commits"), t("reviews"), t("issues")), t("roster_dev"), t("roster_login")),
        """SELECT 'login' AS kind, x AS identity FROM (SELECT author AS x FROM {prs} UNION SELECT author FROM {commits} UNION SELECT reviewer FROM {reviews}) WHERE x NOT LIKE '%[bot]' AND x NOT IN (SELECT login FROM {roster_login})
           UNION ALL SELECT 'account', x FROM (SELECT assignee AS x FROM {issues} UNION SELECT reporter FROM {issues}) WHERE x NOT IN (SELECT account FROM {roster_dev})""",
    ),
    "identity_candidates": (identity_candidates, None),
    "identity_merge": (
        lambda t: people.merge_roster(t("supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("account"), F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("login"), F.lit(0).alias("ord")), t("supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("account"), F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("login"), F.lit(0).alias("ord"))).select("account", F.array_join("logins", ",").alias("logins"), "outcome"),
        "SELECT s_suppkey AS account, CASE WHEN s_suppkey % 3 = 0 THEN 'b' || s_suppkey WHEN s_suppkey % 2 = 0 THEN 'a' || s_suppkey || ',b' || s_suppkey ELSE 'a' || s_suppkey END AS logins, CASE WHEN s_suppkey % 3 = 0 THEN 'appended' WHEN s_suppkey % 2 = 0 THEN 'extended' ELSE 'kept' END AS outcome FROM {supplier} WHERE s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0",
    ),
    "identity_aliases": (
        lambda t: people.mint_aliases(t("customer").select(F.col("c_name").alias("name")), t("customer").where("c_custkey % 3 = 0").select(F.col("c_name").alias("name"), F.concat(F.lit("Person "), (F.col("c_custkey") + 5).cast("string")).alias("alias"))),
        """WITH o AS (SELECT c_name AS name, 'Person ' || (c_custkey + 5) AS alias FROM {customer} WHERE c_custkey % 3 = 0), b AS (SELECT coalesce(max(c_custkey + 5), 0) AS base FROM {customer} WHERE c_custkey % 3 = 0),
           k AS (SELECT DISTINCT c_name AS name FROM {customer} WHERE c_name NOT IN (SELECT name FROM o))
           SELECT name, alias FROM o UNION ALL SELECT name, 'Person ' || (row_number() OVER (ORDER BY substr(md5(name), 1, 2), name) + base) FROM k CROSS JOIN b""",
    ),
    "identity_scrub": (
        lambda t: people.scrub(t("prs").select("repo", "author", "branch"), people.mint_aliases(t("prs").select(F.col("repo").alias("name")), t("prs").select(F.col("repo").alias("name"), F.lit("").alias("alias")).limit(0), "Project"), ["repo"], ["author"]).groupBy("repo", "author", "branch").agg(F.count("*").alias("n")),
        "WITH k AS (SELECT repo, 'Project ' || row_number() OVER (ORDER BY substr(md5(repo), 1, 2), repo) AS alias FROM (SELECT DISTINCT repo FROM {prs})) SELECT alias AS repo, '' AS author, branch, count(*) AS n FROM {prs} JOIN k USING (repo) GROUP BY 1, 3",
    ),
    "browse_urls": (
        lambda t: t("orders").select(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("key"), F.when(F.col("o_orderkey") % 2 == 0, "https://track.example.com/").otherwise("").alias("base")).select("key", tx.browse_url(F.col("base"), F.col("key")).alias("url")),
        "SELECT 'ORD-' || o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'https://track.example.com/browse/ORD-' || o_orderkey ELSE '' END AS url FROM {orders}",
    ),
    "decode_requests": (
        lambda t: decode.decode_requests(t("orders").select(F.expr(RAW_REQUEST).alias("raw"))).select("pr_number", "repo", "state", "author", F.date_format("created", "yyyy-MM-dd").alias("created"), F.date_format("merged", "yyyy-MM-dd").alias("merged"), "additions", "inline_comments", F.array_join("issue_keys", ",").alias("issue_keys")),
        """SELECT o_orderkey AS pr_number, 'org/r' || (o_orderkey % 3) AS repo, CASE WHEN o_orderkey % 2 = 0 THEN 'merged' ELSE 'closed' END AS state, 'dev' || (o_custkey % 9) AS author, '1998-01-0' || (o_orderkey % 9 + 1) AS created, CASE WHEN o_orderkey % 2 = 0 THEN '1999-01-02' END AS merged,
             o_custkey AS additions, o_orderkey % 4 AS inline_comments, 'ABC-' || o_custkey || ',ORD-' || o_orderkey AS issue_keys FROM {orders}""",
    ),
    "decode_commits": (
        lambda t: decode.decode_commits(t("orders").select(F.expr(RAW_COMMIT).alias("raw"))).select("sha", "repo", "author", F.date_format("committed", "yyyy-MM-dd HH:mm").alias("committed"), n("parent_count"), F.array_join("issue_keys", ",").alias("issue_keys")),
        "SELECT 's' || o_orderkey AS sha, 'org/r' || (o_orderkey % 3) AS repo, CASE WHEN o_orderkey % 2 = 0 THEN 'dev' || o_custkey ELSE 'Name ' || o_custkey END AS author, '1998-0' || (o_orderkey % 9 + 1) || '-11 08:30' AS committed, CAST(1 + o_orderkey % 2 AS BIGINT) AS parent_count, 'ORD-' || o_orderkey AS issue_keys FROM {orders}",
    ),
    "decode_reviews": (
        lambda t: decode.decode_reviews(t("orders").select(F.expr(RAW_REVIEW).alias("raw"))).select("repo", "pr_number", "reviewer", "state", F.date_format("submitted", "yyyy-MM-dd").alias("submitted")),
        "SELECT 'org/r' || (o_orderkey % 3) AS repo, o_orderkey AS pr_number, 'dev' || (o_custkey % 9) AS reviewer, CASE WHEN o_orderkey % 2 = 0 THEN 'APPROVED' ELSE 'COMMENTED' END AS state, '1998-02-0' || (o_orderkey % 9 + 1) AS submitted FROM {orders} WHERE o_orderkey % 4 <> 0",
    ),
    "field_proposals": (
        lambda t: fields.proposals(raw_profile(t), t("region").limit(0).select(F.col("r_name").alias("field_id"), F.col("r_name").alias("name"), F.col("r_name").alias("kind")).unionByName(t("region").sparkSession.sql("SELECT 'customfield_1' AS field_id, 'Story Points' AS name, 'number' AS kind UNION ALL SELECT 'summary', 'Description text', 'string'"))).select("role", "field_id"),
        "SELECT 'story_points' AS role, 'customfield_1' AS field_id UNION ALL SELECT 'description', 'summary'",
    ),
    "field_profile": (
        raw_profile,
        """WITH k(field_id, shape) AS (VALUES ('assignee', 'object' || chr(123) || 'accountId' || chr(125)), ('created', 'string'), ('customfield_1', 'number'), ('issuelinks', 'array[1]'), ('issuetype', 'object' || chr(123) || 'name' || chr(125)), ('labels', 'array[2]'), ('status', 'object' || chr(123) || 'name' || chr(125)), ('subtasks', 'array[1]'), ('summary', 'string'), ('updated', 'string'))
           SELECT field_id, count(*) AS sampled, CAST(sum(CASE WHEN field_id = 'customfield_1' AND o_orderkey % 8 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS populated, shape
           FROM {orders} CROSS JOIN k WHERE field_id <> 'assignee' OR o_orderkey % 3 = 0 GROUP BY field_id, shape""",
    ),
    "field_mappings": (field_mappings, FIELD_MAPPINGS_SQL),
    "cell_manifest": (manifest, "SELECT 'issues' AS source, 'P' || (o_custkey % 5) AS scope, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS records FROM {orders} GROUP BY 2, 3"),
    "cell_bounds": (
        lambda t: corpus_files.month_bounds(manifest(t)),
        "SELECT 'issues' AS source, strftime(min(o_orderdate), '%Y-%m') AS first_month, strftime(max(o_orderdate), '%Y-%m') AS last_month, count(*) AS records FROM {orders}",
    ),
    "cell_stale": (
        stale,
        """WITH k AS (SELECT DISTINCT 'P' || (o_custkey % 5) AS scope, strftime(o_orderdate, '%Y-%m') AS month FROM {orders}), g AS (SELECT scope, month, true AS have FROM k UNION ALL SELECT DISTINCT scope, '2003-01', false FROM k)
           SELECT month, CAST(sum(CASE WHEN NOT have OR month = '2001-08' OR substr(month, 7, 1) = '5' OR month = '2001-07' THEN 1 ELSE 0 END) AS BIGINT) AS stale FROM g GROUP BY 1""",
    ),
    "cell_carry_forward": (
        carried,
        "SELECT coalesce(CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN o_orderpriority END, '') AS detail, count(*) AS n FROM {orders} GROUP BY 1",
    ),
    "cell_needs_detail": (
        lambda t: corpus_files.needs_detail(t("issues").select(F.lit("P").alias("scope"), cal.month_key("updated").alias("month"), "resolved"), "resolved"),
        "SELECT 'P' AS scope, strftime(updated, '%Y-%m') AS month, CAST(sum(CASE WHEN resolved IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, count(*) AS records FROM {issues} GROUP BY 2",
    ),
    "cell_integrity": (
        lambda t: corpus_files.integrity(manifest(t).where("month <> '1998-03'"), manifest(t).where("month <> '1998-04'").withColumn("records", F.when(F.col("month") == "1998-05", F.col("records") + 1).otherwise(F.col("records")))),
        "SELECT DISTINCT 'P' || (o_custkey % 5) AS scope, strftime(o_orderdate, '%Y-%m') AS month, CASE strftime(o_orderdate, '%Y-%m') WHEN '1998-03' THEN 'unlisted' WHEN '1998-04' THEN 'missing' ELSE 'miscounted' END AS problem FROM {orders} WHERE strftime(o_orderdate, '%Y-%m') IN ('1998-03','1998-04','1998-05')",
    ),
    "week_counts": (
        lambda t: t("events").groupBy(F.date_format(cal.week_start("ts"), "yyyy-MM-dd").alias("week"), "user_id").agg(F.count("*").alias("n")),
        "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, user_id, count(*) AS n FROM {events} GROUP BY 1, 2",
    ),
}
