"""Raw tracker and code-host JSON to columns, and rich-text trees to plain text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import issue_keys, parse_time

ISSUE = """struct<key:string,fields:struct<summary:string,status:struct<name:string>,issuetype:struct<name:string>,created:string,updated:string,resolutiondate:string,
    assignee:struct<accountId:string>,reporter:struct<accountId:string>,parent:struct<key:string>,labels:array<string>,components:array<struct<name:string>>,
    issuelinks:array<struct<type:struct<name:string,outward:string,inward:string>,outwardIssue:struct<key:string>,inwardIssue:struct<key:string>>>,subtasks:array<struct<key:string>>>,
    changelog:struct<histories:array<struct<created:string,author:struct<accountId:string>,items:array<struct<field:string,fromString:string,toString:string>>>>>>"""
REQUEST = """struct<number:long,title:string,body:string,state:string,user:struct<login:string>,head:struct<ref:string>,base:struct<ref:string>,
    created_at:string,merged_at:string,additions:long,deletions:long,review_comments:long,url:string>"""

COMMIT = "struct<sha:string,url:string,author:struct<login:string>,commit:struct<message:string,author:struct<name:string,date:string>>,parents:array<struct<sha:string>>>"
REVIEW = "struct<user:struct<login:string>,state:string,pull_request_url:string,submitted_at:string>"
FILES = "struct<key:string,fields:struct<attachment:array<struct<filename:string,mimeType:string,size:long>>,fixVersions:array<struct<name:string>>>>"


def _repo(url: Column) -> Column:
    return F.regexp_extract(url, r"repos/([^/]+/[^/]+)/", 1)


def decode_issues(raw: DataFrame, column: str = "raw", points_field: str = "customfield_1", epic_field: str = "customfield_2") -> DataFrame:
    r = F.from_json(column, ISSUE)
    f = r["fields"]
    none = F.array().cast("array<string>")
    return raw.select(
        r["key"].alias("issue_key"), f["summary"].alias("summary"), f["status"]["name"].alias("status"), f["issuetype"]["name"].alias("issue_type"),
        parse_time(f["created"]).alias("created"), parse_time(f["updated"]).alias("updated"), parse_time(f["resolutiondate"]).alias("resolved"),
        F.coalesce(f["assignee"]["accountId"], F.lit("")).alias("assignee"), F.coalesce(f["reporter"]["accountId"], F.lit("")).alias("reporter"),
        F.get_json_object(column, f"$.fields.{points_field}").cast("double").alias("story_points"),
        F.coalesce(F.get_json_object(column, f"$.fields.{epic_field}"), f["parent"]["key"], F.lit("")).alias("epic_key"),
        F.coalesce(f["labels"], none).alias("labels"), F.coalesce(F.transform(f["components"], lambda x: x["name"]), none).alias("components"),
    )


def decode_relations(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(issue_key, counterpart, link_type, direction, phrase): subtasks, then links, the outward side first."""
    r = F.from_json(column, ISSUE)
    kind = "array<struct<counterpart:string,link_type:string,direction:string,phrase:string>>"
    tasks = F.transform(r["fields"]["subtasks"], lambda x: F.struct(x["key"], F.lit("subtask"), F.lit("outward"), F.lit("subtask"))).cast(kind)
    out = lambda x: x["outwardIssue"]["key"].isNotNull()
    links = F.transform(
        r["fields"]["issuelinks"],
        lambda x: F.struct(F.coalesce(x["outwardIssue"]["key"], x["inwardIssue"]["key"]), x["type"]["name"], F.when(out(x), "outward").otherwise("inward"), F.when(out(x), x["type"]["outward"]).otherwise(x["type"]["inward"])),
    ).cast(kind)
    both = F.concat(F.coalesce(tasks, F.array().cast(kind)), F.coalesce(links, F.array().cast(kind)))
    return raw.select(r["key"].alias("issue_key"), F.posexplode(both).alias("ord", "l")).select("issue_key", "ord", "l.*")


def decode_changelog(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(issue_key, at, author, from_status, to_status): history items of the status field."""
    r = F.from_json(column, ISSUE)
    h = raw.select(r["key"].alias("issue_key"), F.explode(r["changelog"]["histories"]).alias("h"))
    items = h.select("issue_key", parse_time(F.col("h.created")).alias("at"), F.col("h.author.accountId").alias("author"), F.explode("h.items").alias("i"))
    return items.where("i.field = 'status'").select("issue_key", "at", "author", F.col("i.fromString").alias("from_status"), F.col("i.toString").alias("to_status"))


def decode_requests(raw: DataFrame, column: str = "raw") -> DataFrame:
    r = F.from_json(column, REQUEST)
    merged = parse_time(r["merged_at"])
    return raw.select(
        r["number"].alias("pr_number"), F.regexp_extract(r["url"], r"repos/([^/]+/[^/]+)/", 1).alias("repo"), r["title"].alias("title"),
        F.when(merged.isNotNull(), "merged").otherwise(r["state"]).alias("state"), r["user"]["login"].alias("author"), r["head"]["ref"].alias("branch"), r["base"]["ref"].alias("base_branch"),
        parse_time(r["created_at"]).alias("created"), merged.alias("merged"), r["additions"].alias("additions"), r["deletions"].alias("deletions"),
        F.coalesce(r["review_comments"], F.lit(0)).alias("inline_comments"), issue_keys(r["title"], r["body"], r["head"]["ref"]).alias("issue_keys"),
    )


def decode_commits(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(sha, repo, author, committed, parent_count, message, issue_keys): the linked login, else the name in the commit."""
    r = F.from_json(column, COMMIT)
    return raw.select(
        r["sha"].alias("sha"), _repo(r["url"]).alias("repo"), F.coalesce(commit_author(r["author"]["login"], r["commit"]["author"]["name"]), F.lit("")).alias("author"),
        parse_time(r["commit"]["author"]["date"]).alias("committed"), F.coalesce(F.size(r["parents"]), F.lit(0)).alias("parent_count"), r["commit"]["message"].alias("message"), issue_keys(r["commit"]["message"]).alias("issue_keys"),
    )


def decode_reviews(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(repo, pr_number, reviewer, state, submitted); reviews that were never submitted drop out."""
    r = F.from_json(column, REVIEW)
    rows = raw.select(
        _repo(r["pull_request_url"]).alias("repo"), F.regexp_extract(r["pull_request_url"], r"/(\d+)$", 1).cast("long").alias("pr_number"), F.coalesce(r["user"]["login"], F.lit("")).alias("reviewer"),
        r["state"].alias("state"), parse_time(r["submitted_at"]).alias("submitted"),
    )
    return rows.where("submitted IS NOT NULL")


def decode_attachments(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(issue_key, ord, filename, mime_type, size) of an issue's attachments; one without any has no rows."""
    r = F.from_json(column, FILES)
    return raw.select(r["key"].alias("issue_key"), F.posexplode(r["fields"]["attachment"]).alias("ord", "a")).select("issue_key", "ord", F.col("a.filename").alias("filename"), F.col("a.mimeType").alias("mime_type"), F.col("a.size").alias("size"))


def fix_versions(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(issue_key, fix_versions): their names in order, an empty array for none."""
    r = F.from_json(column, FILES)
    return raw.select(r["key"].alias("issue_key"), F.coalesce(F.transform(r["fields"]["fixVersions"], lambda x: x["name"]), F.array().cast("array<string>")).alias("fix_versions"))


def commit_author(login: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(login, F.lit("")), name)


_BLOCK = {"paragraph", "heading", "listItem", "codeBlock", "blockquote", "rule", "tableRow", "panel"}
_URL = re.compile(r"https?://[^\s<>\"]+")


def plain_text(tree: str | None) -> tuple[str, list[str]]:
    """A document tree's text and the distinct URLs in it, in order; trees of any depth, as nodes wait on a stack.

    What is no JSON, or nests too deeply for its parser, is no tree: it has no text, like null."""
    try:
        stack: list = [json.loads(tree)] if tree else []
    except (ValueError, RecursionError):
        return "", []
    out, urls = [], []
    while stack:
        node = stack.pop()
        if isinstance(node, str):  # what follows a block's content
            out.append(node)
        elif isinstance(node, list):
            stack.extend(reversed([x for x in node if isinstance(x, (list, dict))]))
        elif isinstance(node, dict):
            kind, attrs = node.get("type"), node.get("attrs") or {}
            if kind == "text":
                text = node.get("text") or ""
                out.append(text)
                urls.extend((m.get("attrs") or {}).get("href", "") for m in node.get("marks") or [] if m.get("type") == "link")
                urls.extend(u.rstrip(".,;:!?") for u in _URL.findall(text))
            elif kind == "hardBreak":
                out.append("\n")
            elif kind in ("mention", "emoji"):
                out.append(attrs.get("text") or attrs.get("shortName") or "")
            elif kind in ("inlineCard", "blockCard", "embedCard"):
                out.append(attrs.get("url") or "")
                urls.append(attrs.get("url") or "")
            if kind in _BLOCK:
                stack.append("\n")
            stack.append(node.get("content") or [])
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip(), [u for u in dict.fromkeys(urls) if u]


def _flatten(trees: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in trees:
        rows = [plain_text(t) for t in batch]
        yield pd.DataFrame({"text": [t for t, _ in rows], "urls": [u for _, u in rows]})


def flatten_rich_text(tree: Column) -> Column:
    """struct<text, urls> of document trees, in Arrow batches: built-in functions don't recurse."""
    return F.pandas_udf(_flatten, "struct<text:string,urls:array<string>>")(tree)
