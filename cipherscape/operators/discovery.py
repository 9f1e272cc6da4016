"""Discovery: which files are read, and why others are not."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FILE_BYTES = 5 * 1024 * 1024
PROBE_BYTES = 8192


def component_order(path: Column) -> Column:
    """Paths compare part by part, so 'a/b' comes before 'a-b'."""
    return F.split(path, "/")


def skip_reason(path: Column, size: Column, content: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """The first reason that holds, else null; cheap tests come first."""
    name = F.element_at(F.split(path, "/"), -1)
    return (
        F.when(F.array_contains(F.split(path, "/"), ".git"), "IGNORED_PATH")
        .when(~(F.endswith(name, F.lit(".py")) & (F.length(name) > 3)), "UNSUPPORTED_LANGUAGE")
        .when(size > max_bytes, "TOO_LARGE")
        .when(is_binary(content), "BINARY_FILE")
        .when(~F.is_valid_utf8(content.cast("string")), "INVALID_ENCODING")
    )


def is_binary(content: Column) -> Column:
    """A NUL byte near the start."""
    return F.contains(F.substring(content, 1, PROBE_BYTES), F.lit(b"\x00"))


def classify(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """One row for each file: language, is_binary, is_supported, skip_reason; nothing is dropped."""
    reason = skip_reason(F.col("path"), F.col("size"), F.col("content"), max_bytes)
    found = files.withColumn("skip_reason", reason)
    return found.select(
        "snapshot_id", "path", F.when(F.coalesce(~F.col("skip_reason").isin("IGNORED_PATH", "UNSUPPORTED_LANGUAGE"), F.lit(True)), "python").alias("language"),
        "size", F.coalesce(F.col("skip_reason") == "BINARY_FILE", F.lit(False)).alias("is_binary"), F.col("skip_reason").isNull().alias("is_supported"), "skip_reason",
    )


def supported(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Source rows that go on to the parser, with their bytes."""
    reason = skip_reason(F.col("path"), F.col("size"), F.col("content"), max_bytes)
    return files.filter(reason.isNull()).withColumn("language", F.lit("python"))


def summary(discovered: DataFrame) -> DataFrame:
    """A row for each snapshot: total, analyzed, skipped, and a map of skip reasons to counts."""
    each = discovered.groupBy("snapshot_id", "skip_reason").agg(F.count("*").alias("n"))
    entry = F.struct("skip_reason", "n")
    return each.groupBy("snapshot_id").agg(
        F.sum("n").alias("total_files"), F.sum(F.when(F.col("skip_reason").isNull(), F.col("n")).otherwise(0)).alias("analyzed_files"),
        F.sum(F.when(F.col("skip_reason").isNotNull(), F.col("n")).otherwise(0)).alias("skipped_files"),
        F.map_from_entries(F.array_sort(F.filter(F.collect_list(entry), lambda e: e["skip_reason"].isNotNull()))).alias("skipped_reasons"),
    )


def content_hash(files: DataFrame) -> DataFrame:
    """(snapshot_id, content_hash, file_count): SHA-256 over each path and the SHA-256 of its bytes, in component order.

    A snapshot's paths and digests meet in one group, as one digest over all of
    them needs; 20,000 files are about 3 MB.
    """
    part = F.struct(component_order(F.col("path")).alias("o"), F.concat(F.col("path"), F.lit("\x00"), F.sha2("content", 256), F.lit("\n")).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "")
    return files.groupBy("snapshot_id").agg(F.sha2(joined, 256).alias("content_hash"), F.count("*").alias("file_count"))


# -- references -------------------------------------------------------------------


def commit_sha(text: Column) -> Column:
    """A commit id, trimmed and in lower case; null when it is none (7 to 40 hex digits)."""
    clean = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(clean.rlike("^[0-9a-f]{7,40}$"), clean)


def is_full_sha(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{40}$")


def extends(resolved: Column, requested: Column) -> Column:
    """A resolved commit must start with the requested one."""
    return F.startswith(resolved, commit_sha(requested))


# The shape of the host's names.
_OWNER, _NAME = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?", r"[A-Za-z0-9._-]{1,100}"


def repository_columns(url: Column) -> Column:
    """(provider, owner, name, canonical_url) of a repository address, or null.

    https, the one known host, two path segments, an optional '.git', and no
    credentials, port, query or fragment.
    """
    clean = F.regexp_replace(url, r"^\s+|\s+$", "")
    pattern = f"^(?i:https)://(?i:github\\.com)/+({_OWNER})/+({_NAME}?)(?:\\.git)?/*$"
    owner, name = F.regexp_extract(clean, pattern, 1), F.regexp_extract(clean, pattern, 2)
    found = F.struct(F.lit("github").alias("provider"), owner.alias("owner"), name.alias("name"), F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name).alias("canonical_url"))
    return F.when(clean.rlike(pattern) & ~name.isin("", ".", "..", ".git"), found)


def parse_repository(url: str) -> tuple[str, str]:
    """(owner, name) on the driver; ValueError for anything else."""
    parts = urlsplit(url.strip())
    match = re.fullmatch(rf"/+({_OWNER})/+({_NAME}?)(?:\.git)?/*", parts.path)
    plain = parts.scheme == "https" and parts.netloc.lower() == "github.com" and not parts.query and not parts.fragment
    if not plain or match is None or match[2] in ("", ".", "..", ".git"):
        raise ValueError("INVALID_REPOSITORY_URL")
    return match[1], match[2]


def resolved(refs: DataFrame, commits: DataFrame, repository: str) -> DataFrame:
    """``refs`` (repository, ref) with ``sha``, the one commit of the repository that the reference begins, and else ``problem``: INVALID, NOT_FOUND or AMBIGUOUS.

    A full reference is taken as it is.  A short one has seven digits at least, and they are the key of the join.
    """
    asked = refs.withColumn("_want", commit_sha(F.col("ref"))).withColumn("_row", F.monotonically_increasing_id())
    known = commits.select(F.col(repository).alias("_repo"), F.lower("sha").alias("_sha")).distinct()
    short = asked.filter(~is_full_sha(F.col("_want"))).select(F.col("_row").alias("_id"), F.col(repository).alias("_r"), F.col("_want").alias("_short"))
    near = (F.col("_r") == F.col("_repo")) & (F.substring("_short", 1, 7) == F.substring("_sha", 1, 7)) & F.expr("startswith(_sha, _short)")
    found = short.join(known, near).groupBy("_id").agg(F.count("*").alias("_n"), F.min("_sha").alias("_one"))
    rows = asked.join(found, F.col("_row") == F.col("_id"), "left")
    full = F.coalesce(is_full_sha(F.col("_want")), F.lit(False))
    sha = F.when(full, F.col("_want")).when(F.col("_n") == 1, F.col("_one"))
    problem = F.when(F.col("_want").isNull(), "INVALID").when(full | (F.col("_n") == 1), None).when(F.col("_n").isNull(), "NOT_FOUND").otherwise("AMBIGUOUS")
    return rows.select(*refs.columns, sha.alias("sha"), problem.alias("problem"))
