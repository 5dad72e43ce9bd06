"""Columns derived from file paths and repository URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """Last path segment, trailing slashes ignored; '' gives '.', only slashes give '/'."""
    stripped = F.rtrim(path, F.lit("/"))
    return (
        F.when(path == "", F.lit("."))
        .when(stripped == "", F.lit("/"))
        .otherwise(F.substring_index(stripped, "/", -1))
    )


def extension(path: Column) -> Column:
    """Text after the last dot of the last segment ('' without one); case is kept."""
    last = F.substring_index(path, "/", -1)
    return F.when(F.instr(last, ".") > 0, F.substring_index(last, ".", -1)).otherwise(F.lit(""))


def bare_extension(ext: Column) -> Column:
    """A catalogue extension without its optional leading dot."""
    return F.regexp_replace(ext, r"^\.", "")


def rooted_path(path: Column) -> Column:
    """Exactly one leading slash more than the path has after dropping at most one."""
    return F.concat(F.lit("/"), F.regexp_replace(path, "^/", ""))


def with_path_columns(files: DataFrame) -> DataFrame:
    """Add the path-derived columns extractors route on. Only ``path`` is read for them."""
    path = F.col("path")
    return files.withColumns(
        {
            "base_name": base_name(path),
            "ext": extension(path),
            "rooted_path": rooted_path(path),
            "lower_path": F.lower(path),
        }
    )


def repo_name_from_url(url: Column) -> Column:
    """struct(repo_name, error): SSH URLs keep ``owner/name``, HTTP URLs only the last segment."""
    ssh_parts = F.split(url, ":")
    ssh = url.startswith("git@")
    http = url.startswith("https://") | url.startswith("http://")
    drop_git = lambda c: F.regexp_replace(c, r"\.git\z", "")
    name = (
        F.when(ssh & (F.size(ssh_parts) == 2), drop_git(F.get(ssh_parts, F.lit(1))))
        .when(ssh, F.lit(None).cast("string"))
        .when(http, drop_git(F.substring_index(url, "/", -1)))
    )
    error = F.when(ssh & (F.size(ssh_parts) != 2), F.lit("unexpected repository URL format")).when(
        ~ssh & ~http, F.lit("unsupported repository URL format")
    )
    return F.struct(name.alias("repo_name"), error.alias("error"))


def flat_repo_name(full_name: Column) -> Column:
    return F.translate(full_name, "/", "_")


def url_key(url: Column) -> Column:
    """Lower-case key for a base URL: schemes removed wherever they occur, '/' and ':' to '_'."""
    bare = F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.lower(F.translate(bare, "/:", "__"))
