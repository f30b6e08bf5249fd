"""A folder of source files as a table: walk, ignore rules, languages and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import settle

#: Suffixes and their languages.
LANGUAGES = {
    "python": "py", "javascript": "js jsx mjs cjs", "typescript": "ts tsx mts cts", "csharp": "cs", "go": "go", "java": "java", "rust": "rs", "markdown": "md mdx rst", "text": "txt",
}
#: What is left out without any rule.
IGNORED = [
    ".git/", ".hg/", ".svn/", ".venv/", "venv/", "env/", "__pycache__/", ".pytest_cache/", ".mypy_cache/", ".ruff_cache/", "node_modules/", "dist/", "build/",
    "*.egg-info/", ".tox/", ".idea/", ".vscode/", ".claude/", ".codex/", ".gemini/", ".cursor/", ".github/", ".planning/",
]


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name, suffixes in LANGUAGES.items():
        out = F.when(suffix.isin(suffixes.split()), name).otherwise(out)
    return F.when(path.rlike(r"\.d\.(ts|mts|cts)$"), None).otherwise(out)


def ignore_pattern(line: str) -> str | None:
    """A regular expression over relative paths for one ignore rule; blank lines and comments have none."""
    rule = line.strip()
    if not rule or rule.startswith("#"):
        return None
    folder, anchored = rule.endswith("/"), "/" in rule.strip("/") or rule.startswith("/")
    parts = []
    for token in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", rule.strip("/")):
        parts.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token))
    return ("^" if anchored else "(?:^|/)") + "".join(parts) + ("/" if folder else "(?:/|$)")


def ignored(path: Column, rules: list[str]) -> Column:
    """The last rule that matches decides; a rule that starts with ! takes a path back in."""
    out = F.lit(False)
    for rule in [*IGNORED, *rules]:
        back = rule.strip().startswith("!")
        if pattern := ignore_pattern(rule.strip().lstrip("!") if back else rule):
            out = F.when(path.rlike(pattern), not back).otherwise(out)
    return out


def listed(spark: SparkSession, uri: str, rules: list[str]) -> DataFrame:
    """(path) of all files below a folder that are not ignored, level by level: each folder is listed in a task of its own.

    Ignored folders are not gone into, unless a rule takes paths back in.
    """
    prune = not any(rule.strip().startswith("!") for rule in rules)

    def below(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, at = pafs.FileSystem.from_uri(uri)
        for frame in frames:
            for path in frame["path"]:
                found = own.get_file_info(pafs.FileSelector(f"{at}/{path}".rstrip("/")))
                yield pd.DataFrame({"path": [f.path[len(at) :].lstrip("/") for f in found], "is_file": [f.is_file for f in found]}).astype({"path": object, "is_file": bool})

    folders, files = spark.createDataFrame([("",)], "path string"), None
    count = 1
    while count:
        found = settle(_spread(folders, count).mapInPandas(below, "path string, is_file boolean"), "listing")
        here = found.filter("is_file").select("path")
        files = here if files is None else files.union(here)
        folders = found.filter("NOT is_file").select("path")
        if prune:
            folders = folders.filter(~ignored(F.concat("path", F.lit("/")), rules))
        count = folders.count()
    return files.filter(~ignored(F.col("path"), rules))


def _spread(paths: DataFrame, count: int) -> DataFrame:
    """Paths over as many tasks as they are worth: each has work behind it that its size does not show."""
    usual = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.repartitionByRange(max(1, min(count, max(usual, count // 100))), "path")


def root_rules(spark: SparkSession, root: str) -> list[str]:
    """The lines of the .gitignore at a root; none if there is no such file."""
    fs, base = pafs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
    if fs.get_file_info(f"{base}/.gitignore").type != pafs.FileType.File:
        return []
    with fs.open_input_stream(f"{base}/.gitignore") as source:
        return source.read().decode(errors="replace").splitlines()


def walk(spark: SparkSession, root: str, repo_id: str, rules: list[str] | None = None) -> DataFrame:
    """(repo_id, path, language, content, valid) of the files of known languages; what is no UTF-8 has valid = false.

    ``rules`` are the root's own .gitignore unless given. Names are listed by ``pyarrow.fs``, since Spark's own
    listing hides those that begin with ``_`` (``__init__.py``) and its readers skip files of no bytes. Tasks list
    the folders and read the files that stay.
    """
    uri = root if "://" in root else f"file://{root}"
    rules = root_rules(spark, root) if rules is None else rules

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, at = pafs.FileSystem.from_uri(uri)
        for frame in frames:
            for path, lang in zip(frame["path"], frame["language"], strict=True):
                with own.open_input_stream(f"{at}/{path}") as source:
                    raw = source.read()
                try:
                    text, valid = raw.decode(), True
                except UnicodeDecodeError:
                    text, valid = None, False
                yield pd.DataFrame({"path": [path], "language": [lang], "content": [text], "valid": [valid]})

    kept = listed(spark, uri, rules).withColumn("language", language(F.col("path"))).filter("language IS NOT NULL")
    files = _spread(kept, kept.count()).mapInPandas(read, "path string, language string, content string, valid boolean")
    return files.select(F.lit(repo_id).alias("repo_id"), "path", "language", "content", "valid")
