"""Source text to units: Python by its own syntax tree, documents by headings, others by declarations.

Each parser is a small function of one file's text; Spark spreads the files.
"""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import settle

UNITS = "repo_id string, path string, kind string, name string, qualified_name string, parent string, line_start int, line_end int, docstring string, imports array<string>, calls array<string>, bases array<string>"


def module_name(path: str) -> str:
    stem = posixpath.splitext(path)[0]
    own = {".py": "__init__", ".rs": "mod"}.get(posixpath.splitext(path)[1], "index")
    parts = stem.split("/")
    return ".".join(parts[:-1] if len(parts) > 1 and parts[-1] == own else parts)


def _unit(kind, name, qname, parent, start, end, doc=None, imports=(), calls=(), bases=()) -> dict:
    return {"kind": kind, "name": name, "qualified_name": qname, "parent": parent, "line_start": start, "line_end": end, "docstring": doc, "imports": sorted(set(imports)), "calls": sorted(set(calls)), "bases": sorted(set(bases))}


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def parse_python(path: str, text: str) -> list[dict]:
    tree, module = ast.parse(text), module_name(path)
    imports = []
    for node in tree.body:
        if isinstance(node, ast.Import):
            imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append("." * node.level + (node.module or ""))
    out: list[dict] = []

    def visit(body: list[ast.stmt], parent: str, inside: str) -> None:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                calls = [c for n in ast.walk(node) if isinstance(n, ast.Call) and (c := _dotted(n.func))]
                out.append(_unit("method" if inside == "class" else "function", node.name, f"{parent}.{node.name}", parent, node.lineno, node.end_lineno, ast.get_docstring(node), calls=calls))
            elif isinstance(node, ast.ClassDef):
                out.append(_unit("class", node.name, f"{parent}.{node.name}", parent, node.lineno, node.end_lineno, ast.get_docstring(node), bases=[b for x in node.bases if (b := _dotted(x))]))
                visit(node.body, f"{parent}.{node.name}", "class")
            elif isinstance(node, ast.Assign | ast.AnnAssign):
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(target, ast.Name) and re.fullmatch(r"[A-Z][A-Z0-9_]*", target.id):
                        out.append(_unit("constant", target.id, f"{parent}.{target.id}", parent, node.lineno, node.end_lineno))

    visit(tree.body, module, "module")
    head = _unit("module", module.rsplit(".", 1)[-1], module, None, 1, text.count("\n") + 1, ast.get_docstring(tree), imports=imports)
    return [head, *sorted(out, key=lambda u: (u["line_start"], u["name"]))]


HEADING, LINK = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$"), re.compile(r"\[[^\]]*\]\(([^)\s]+)")


def _slug(title: str) -> str:
    return re.sub(r"[\s_]+", "-", re.sub(r"[^\w\s-]", "", title.lower()).strip()) or "section"


def _links(path: str, text: str) -> list[str]:
    found = []
    for target in LINK.findall(text):
        target = target.split("#")[0]
        if target and not re.match(r"[a-z][a-z0-9+.-]*:", target, re.I):
            full = posixpath.normpath(posixpath.join(posixpath.dirname(path), target))
            if not full.startswith("..") and full != path and re.search(r"\.(md|rst|txt|py|js|ts|cs|go|java|rs)$", full):
                found.append(module_name(full))
    return found


def _first_paragraph(text: str) -> str | None:
    return next((p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()), None)


def parse_document(path: str, text: str) -> list[dict]:
    """Headings outside fences start sections, named by the slugs above them; equal names get #2, #3 ..."""
    module, lines = module_name(path), text.split("\n")
    heads, fence = [], None
    for i, line in enumerate(lines):
        mark = re.match(r"\s{0,3}(```|~~~)", line)
        if mark:
            fence = None if fence == mark[1] else fence or mark[1]
        elif fence is None and (m := HEADING.match(line)):
            heads.append((i, len(m[1]), m[2]))
    out, chain, seen = [], [], {}
    for k, (i, level, title) in enumerate(heads):
        end = heads[k + 1][0] if k + 1 < len(heads) else len(lines)
        chain = [c for c in chain if c[0] < level]
        parent = ".".join([module, *(c[1] for c in chain)])
        name = f"{parent}.{_slug(title)}"
        seen[name] = seen.get(name, 0) + 1
        chain.append((level, _slug(title)))
        body = "\n".join(lines[i + 1 : end])
        out.append(_unit("section", title, name + (f"#{seen[name]}" if seen[name] > 1 else ""), parent, i + 1, end, _first_paragraph(body), imports=_links(path, body)))
    before = "\n".join(lines[: heads[0][0]] if heads else lines)
    return [_unit("module", module.rsplit(".", 1)[-1], module, None, 1, len(lines), _first_paragraph(before), imports=_links(path, before)), *out]


def parse_text(path: str, text: str) -> list[dict]:
    module = module_name(path)
    return [_unit("module", module.rsplit(".", 1)[-1], module, None, 1, text.count("\n") + 1, _first_paragraph(text))]


#: Declarations by language: (kind, expression with the group ``name``). An approximation by lines where no syntax tree is at hand.
DECLARATIONS = {
    "javascript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)(?:\s+extends\s+(?P<base>[\w.]+))?"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(?P<name>\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("constant", r"^\s*(?:export\s+)?const\s+(?P<name>[A-Z][A-Z0-9_]*)\s*[:=]")],
    "csharp": [("class", r"^\s*(?:(?:public|internal|private|protected|abstract|sealed|static|partial)\s+)*(?:class|struct|interface|record|enum)\s+(?P<name>\w+)(?:\s*:\s*(?P<base>[\w.<>]+))?"), ("constant", r"^\s*(?:\w+\s+)*(?:const|static\s+readonly)\s+[\w<>\[\]]+\s+(?P<name>\w+)\s*="), ("method", r"^\s*(?:(?:public|internal|private|protected|static|virtual|override|async|abstract)\s+)+[\w<>\[\],]+\s+(?P<name>\w+)\s*\(")],
    "go": [("class", r"^type\s+(?P<name>\w+)\s+(?:struct|interface)\b"), ("method", r"^func\s+\(\s*\w*\s*\*?(?P<parent>\w+)[^)]*\)\s*(?P<name>\w+)\s*\("), ("function", r"^func\s+(?P<name>\w+)\s*[\(\[]"), ("constant", r"^const\s+(?P<name>\w+)\b")],
    "java": [("class", r"^\s*(?:(?:public|private|protected|abstract|final|static)\s+)*(?:class|interface|enum|record)\s+(?P<name>\w+)(?:\s+extends\s+(?P<base>[\w.]+))?"), ("constant", r"^\s*(?:(?:public|private|protected)\s+)?static\s+final\s+[\w<>\[\]]+\s+(?P<name>[A-Z][A-Z0-9_]*)\s*="), ("method", r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\],\s]*?(?P<name>\w+)\s*\([^;]*$")],
    "rust": [("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(?P<name>\w+)"), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(?P<name>\w+)"), ("constant", r"^\s*(?:pub\s+)?(?:const|static)\s+(?P<name>[A-Z][A-Z0-9_]*)\s*:")],
}
DECLARATIONS["typescript"] = DECLARATIONS["javascript"]
IMPORTS = {"javascript": r"(?:from\s+|require\(\s*|^import\s+)['\"]([^'\"]+)['\"]", "csharp": r"^\s*using\s+([\w.]+)\s*;", "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$", "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)"}
IMPORTS["typescript"] = IMPORTS["javascript"]
_COMPILED = {k: [(kind, re.compile(p)) for kind, p in v] for k, v in DECLARATIONS.items()}


def parse_declarations(path: str, text: str, language: str) -> list[dict]:
    """Declarations by line; what lies deeper than a class and within its braces is its member."""
    module, out, depth, open_classes = module_name(path), [], 0, []
    for i, line in enumerate(text.split("\n"), 1):
        bare = re.sub(r"//.*$|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", "", line)
        for kind, pattern in _COMPILED[language]:
            if m := pattern.match(line):
                groups = m.groupdict()
                owner = groups.get("parent") or (open_classes[-1][1] if open_classes else None)
                parent = f"{module}.{owner}" if owner else module
                if kind == "function" and owner:
                    kind = "method"
                out.append(_unit(kind, m["name"], f"{parent}.{m['name']}", parent, i, i, bases=[groups["base"]] if groups.get("base") else []))
                if kind == "class":
                    open_classes.append((depth, m["name"]))
                break
        if language == "rust" and (m := re.match(r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)", line)):
            open_classes.append((depth, m[1]))
        depth += bare.count("{") - bare.count("}")
        while open_classes and depth <= open_classes[-1][0] and ("}" in bare or ";" in bare):
            open_classes.pop()
    imports = re.findall(IMPORTS[language], text, re.M)
    return [_unit("module", module.rsplit(".", 1)[-1], module, None, 1, text.count("\n") + 1, imports=imports), *out]


def parse(path: str, text: str, language: str) -> list[dict]:
    if language == "python":
        return parse_python(path, text)
    if language == "markdown":
        return parse_document(path, text)
    return parse_declarations(path, text, language) if language in _COMPILED else parse_text(path, text)


def units(files: DataFrame, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(units, failed files) of (repo_id, path, language, content); a file that does not parse fails alone. With a ``label``, what is parsed is written, so that the two do not parse each for itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in (UNITS + ", error string").replace("array<string>", "x").split(", ")]
        for frame in frames:
            rows = []
            for f in frame.itertuples(index=False):
                try:
                    if f.content is None:
                        raise ValueError("not UTF-8")
                    rows += [{"repo_id": f.repo_id, "path": f.path, **u} for u in parse(f.path, f.content, f.language)]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append({"repo_id": f.repo_id, "path": f.path, "error": str(e)})
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None) if rows else pd.DataFrame(columns=names)

    parsed = files.select("repo_id", "path", "language", "content").mapInPandas(run, UNITS + ", error string")
    parsed = settle(parsed, label) if label else parsed
    return parsed.filter("error is null").drop("error"), parsed.filter("error is not null").select("repo_id", "path", "error")


def call_edges(units: DataFrame) -> DataFrame:
    """(src, dst, kind): calls, imports and bases resolved by name, in the module first for undotted names, else external."""
    targets = {"CALLS": ("calls", ["function", "method"]), "IMPORTS": ("imports", ["module"]), "INHERITS": ("bases", ["class"])}
    out = None
    for edge, (column, kinds) in targets.items():
        known = units.filter(F.col("kind").isin(kinds)).select("repo_id", F.col("qualified_name").alias("target")).distinct()
        module = F.coalesce(F.when(F.col("kind") != "module", F.col("module")), F.col("qualified_name"))
        modules = units.filter("kind = 'module'").select("repo_id", "path", F.col("qualified_name").alias("module"))
        asked = units.join(modules, ["repo_id", "path"]).select("repo_id", F.col("qualified_name").alias("src"), module.alias("module"), F.explode(column).alias("name"))
        local = F.when(~F.col("name").contains("."), F.concat_ws(".", "module", "name"))
        first = known.withColumnRenamed("target", "direct")
        second = known.withColumnRenamed("target", "near")
        met = asked.withColumn("direct", F.col("name")).join(first.withColumn("has_direct", F.lit(True)), ["repo_id", "direct"], "left").withColumn("near", local).join(second.withColumn("has_near", F.lit(True)), ["repo_id", "near"], "left")
        dst = F.when(F.col("has_direct"), F.col("direct")).when(F.col("has_near"), F.col("near")).otherwise(F.concat(F.lit("external:"), "name"))
        rows = met.select("repo_id", "src", F.lit(edge).alias("kind"), dst.alias("dst")).filter("src <> dst").distinct()
        out = rows if out is None else out.union(rows)
    return out
