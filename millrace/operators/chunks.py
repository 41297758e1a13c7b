"""Cutting texts and code into chunks, sections and symbols (RG2 to RG11)."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import spread

CHUNK = "chunk long, start_at long, text string"


def by_text(df: DataFrame, key: str, text: str, cut: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``cut`` makes of each text, in Arrow batches; null and empty texts give none."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, *(f.strip().split()[0] for f in schema.split(","))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *r) for k, t in zip(b[key], b[text]) for r in cut(t)], columns=names)

    src = df.select(key, text).where(F.col(text).isNotNull() & (F.col(text) != ""))
    return spread(src).mapInPandas(run, f"`{key}` {kind}, {schema}")


def sentence_chunks(text: str, size: int = 512, overlap: int = 50) -> list[tuple[int, int, str]]:
    """RG2: whole sentences up to ``size`` characters; the next chunk begins with the last ``overlap`` of the one before."""
    out: list[tuple[int, int, str]] = []
    own: list[str] = []
    n = start = 0
    for s in re.split(r"(?<=[.!?])\s+", text):
        if own and n + len(s) > size:
            whole = " ".join(own)
            out.append((len(out), start, whole))
            tail = whole[-overlap:]
            own, n, start = [tail, s], len(tail) + len(s), start + len(tail)
        else:
            own.append(s)
            n += len(s)
    return [*out, (len(out), start, " ".join(own))] if own else out


def window_chunks(text: str, size: int = 512, overlap: int = 50, least: int = 50) -> list[tuple[int, int, str]]:
    """RG5: windows of characters that end at a sentence where they can; each goes on at least one character."""
    out: list[tuple[int, int, str]] = []
    start = 0
    while start < len(text):
        end = start + size
        if end >= len(text):
            out.append((len(out), start, text[start:]))
            break
        parts = re.split(r"(?<=[.!?])\s+", text[start:end])
        if len(parts) > 1 and sum(len(p) + 1 for p in parts[:-1]) >= least:
            end = start + sum(len(p) + 1 for p in parts[:-1])
        piece = text[start:end].strip()
        if len(piece) >= least:
            out.append((len(out), start, piece))
        start = max(start + 1, end - overlap)
    return out


def paragraph_chunks(c: Column) -> Column:
    """RG3: struct start_at, text of the paragraphs between empty lines; starts add up lengths and two characters each."""
    paras = F.filter(F.transform(F.split(c, "\n\n", -1), lambda p: F.regexp_replace(p, "^\\s+|\\s+$", "")), lambda p: p != "")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start_at:bigint,text:string>>").alias("out"))
    return F.aggregate(paras, zero, lambda a, p: F.struct((a["at"] + F.length(p) + 2).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start_at"), p.alias("text")))).alias("out")), lambda a: a["out"])


def code_chunks(c: Column) -> Column:
    """RG4: blocks of lines, each but the first beginning with a definition or a decorator."""
    marked = F.regexp_replace(c, "\\n(?=[^\\S\\n]*(?:(?:async[^\\S\\n]+)?(?:def|class)[^\\S\\n]+\\w|@(?:property|staticmethod|classmethod)))", "\x1e")
    return F.split(marked, "\x1e", -1)


def sections(text: str) -> list[tuple[int, int, str, str]]:
    """RG6: section, level, title and body of a Markdown text; what is before the first heading is section 0 of level 0."""
    out: list[list] = [[0, 0, "", []]]
    fenced = False
    for line in text.split("\n"):
        fenced ^= line.lstrip().startswith("```")
        m = None if fenced else re.match(r"(#{1,6}) +(.*)", line)
        if m:
            out.append([len(out), len(m[1]), m[2], []])
        else:
            out[-1][3].append(line)
    return [(i, level, title, "\n".join(body)) for i, level, title, body in out if level or any(x.strip() for x in body)]


def symbols(text: str) -> list[tuple[str, str, int, int, str]]:
    """RG7, RG8: kind, name, first and last line, and parent of the functions and classes of Python code; none if it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []

    def walk(node: ast.AST, parent: str) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                out.append(("class" if isinstance(x, ast.ClassDef) else "function", x.name, x.lineno, x.end_lineno or x.lineno, parent))
                walk(x, x.name)
            else:
                walk(x, parent)

    walk(tree, "")
    return out


def usages(text: str) -> list[tuple[str, int, str]]:
    """RG11: name, line and use (definition, call, reference) in Python code."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    called = {id(x.func) for x in ast.walk(tree) if isinstance(x, ast.Call)}
    out = []
    for x in ast.walk(tree):
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append((x.name, x.lineno, "definition"))
        elif isinstance(x, ast.Name):
            out.append((x.id, x.lineno, "call" if id(x) in called else "reference"))
        elif isinstance(x, ast.Attribute):
            out.append((x.attr, x.lineno, "call" if id(x) in called else "reference"))
    return out


# Function heads by language; the first group that matched is the name.
FUNCTIONS = {
    "python": r"def\s+(\w+)\s*\([^)]*\)\s*(?:->\s*[\w\[\],\s]+)?:",
    "javascript": r"(?:function\s+(\w+)|const\s+(\w+)\s*=\s*(?:async\s*)?\(|(\w+)\s*\([^)]*\)\s*(?:=>))",
    "java": r"(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\],\s]+\s+(\w+)\s*\(",
    "go": r"func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(",
    "rust": r"fn\s+(\w+)\s*\(",
}


def functions_in(lang: str) -> Callable[[str], list[tuple[str, int]]]:
    """CD5, RG9: name and offset of the functions of a text in a language."""
    rx = re.compile(FUNCTIONS[lang])
    return lambda text: [(next((g for g in m.groups() if g), "anonymous"), m.start()) for m in rx.finditer(text)]
