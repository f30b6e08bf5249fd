"""Paths, names and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders in which changes mean nothing.
IGNORED_PARTS = [".git", "node_modules", "dist", "build", "target", ".venv", "venv", "__pycache__", ".next", ".mypy_cache", ".pytest_cache"]


def module_name(path: Column) -> Column:
    """Dotted name of a path: the suffix goes, and a package's own file stands for its folder, but at the root."""
    dotted = lambda p: F.replace(p, F.lit("/"), F.lit("."))
    bare = F.regexp_replace(path, r"\.[^./]+$", "")
    own = (path.endswith(".py") & bare.endswith("/__init__")) | (path.rlike(r"\.(js|jsx|ts|tsx|mjs|cjs)$") & bare.endswith("/index")) | (path.endswith(".rs") & bare.endswith("/mod"))
    return dotted(F.when(own, F.regexp_replace(bare, "/[^/]+$", "")).otherwise(bare))


def is_doc(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|rst|txt)$")


def is_relevant(path: Column) -> Column:
    """No part of the path is one that changes without meaning."""
    return ~F.arrays_overlap(F.split(F.translate(path, "\\", "/"), "/"), F.array(*map(F.lit, IGNORED_PARTS)))


def normal_url(url: Column) -> Column:
    """host/owner/name in lower case: scheme, user, closing slashes and .git go; colons are slashes, several one."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^(https?|ssh)://", ""), r"^[^@/]+@", "")
    out = F.regexp_replace(F.translate(out, ":", "/"), "/+", "/")
    return F.regexp_replace(F.regexp_replace(out, "/+$", ""), r"\.git$", "")


def slug(title: Column) -> Column:
    """A title as part of a name: runs of other than a-z and 0-9 are one dash; nothing left is ``section``."""
    dashed = F.btrim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(dashed == "", "section").otherwise(dashed)


def first_paragraph(text: Column) -> Column:
    """The text up to its first blank line; texts that cannot have one are not searched for it."""
    bare = F.ltrim(text, F.lit(" \t\n\x0b\f\r"))
    may = F.lit(False)
    for space in "\n \t\r\x0b\f":
        may = may | F.contains(bare, F.lit("\n" + space))
    return F.trim(F.when(may, F.split(bare, r"\n\s*\n", 2)[0]).otherwise(bare))


def one_line(text: Column, most: int = 200) -> Column:
    """The first line that is not blank."""
    return F.substring(F.trim(F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0))), 1, most)


def snippet(text: Column, lines: int = 40) -> tuple[Column, Column]:
    parts = F.split(text, "\n")
    return F.array_join(F.slice(parts, 1, lines), "\n"), F.size(parts) > lines
