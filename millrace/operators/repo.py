"""Files of repositories: imports, dependencies, contexts, order, reports (CD1 to CD8)."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import materialize

# Import statements by language, and files that mark the root of a repository.
IMPORTS = {
    "python": r"(?:from\s+(\S+)\s+import|import\s+(\S+))", "javascript": r"(?:import\s+.*?from\s+['\"]([^'\"]+)['\"]|require\(['\"]([^'\"]+)['\"]\))",
    "java": r"import\s+([\w.]+)", "go": r"import\s+(?:\"([^\"]+)\"|\w+\s+\"([^\"]+)\")", "rust": r"use\s+([\w:]+)",
}
MARKERS = [".git", "package.json", "setup.py", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "CMakeLists.txt"]


def imports(c: Column, lang: Column) -> Column:
    """CD1: what a text imports, by the patterns of its language."""
    out = F.array().cast("array<string>")
    for name, p in IMPORTS.items():
        n = p.replace("(?:", "").replace("\\(", "").count("(")
        found = F.regexp_extract_all(c, F.lit(p), F.lit(1))
        for i in range(2, n + 1):  # the first group that isn't empty
            found = F.zip_with(found, F.regexp_extract_all(c, F.lit(p), F.lit(i)), lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b))
        out = F.when(lang == name, found).otherwise(out)
    return out


def resolve(files: DataFrame, found: DataFrame) -> DataFrame:
    """CD2: repo, src, dst, place: each import of a file (repo, path, place, module) with the first path of its repository, in
    order, that holds the module as a path or its last segment.

    Paths are cut into all their suffixes of letters only once a repository, so an import is met by equality of its key with
    a piece of a path rather than by comparing it with every path.
    """
    paths = files.select("repo", F.col("path").alias("dst"))
    # pieces of a path between separators, and its ends from each separator on
    piece = F.array_distinct(F.concat(F.split("dst", "[/.]"), F.split("dst", "/")))
    index = paths.select("repo", "dst", F.explode(piece).alias("piece")).where("piece <> ''").groupBy("repo", "piece").agg(F.min("dst").alias("dst"))
    last = F.element_at(F.split(F.regexp_replace("module", "[.:]+", "/"), "/"), -1)
    want = found.select("repo", F.col("path").alias("src"), "place", last.alias("piece"))
    return want.join(index, ["repo", "piece"]).select("repo", "src", "dst", "place")


def contexts(files: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """CD3: repo, context, place, path: files of a repository in order, each unseen one with what it depends on, breadth first.

    A task holds the paths (not the texts) of one repository.
    """
    both = files.select("repo", "path", F.lit(None).cast("string").alias("dst"), F.lit(-1).alias("place")).unionByName(edges.select("repo", F.col("src").alias("path"), "dst", F.col("place").cast("int").alias("place")))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        paths = sorted(pdf.path[pdf.dst.isna()].unique())
        deps: dict[str, list[str]] = {}
        for p, d in pdf[pdf.dst.notna()].sort_values(["path", "place"])[["path", "dst"]].itertuples(index=False):
            deps.setdefault(p, []).append(d)
        seen: set[str] = set()
        out, n = [], 0
        for p in paths:
            if p in seen:
                continue
            queue, own = deque([p]), []
            while queue and len(own) < most:
                x = queue.popleft()
                if x not in seen:
                    seen.add(x)
                    own.append(x)
                    queue.extend(d for d in deps.get(x, ()) if d not in seen)
            out += [(pdf.repo.iloc[0], n, i, x) for i, x in enumerate(own)]
            n += 1
        return pd.DataFrame(out, columns=["repo", "context", "place", "path"])

    return both.groupBy("repo").applyInPandas(walk, "repo string, context int, place int, path string")


def with_header(path: Column, lang: Column, content: Column) -> Column:
    """CD4."""
    return F.concat(F.lit("<|file_start|> "), path, F.lit(" <|language|> "), F.coalesce(lang, F.lit("unknown")), F.lit("\n"), content, F.lit("\n<|file_end|>"))


def two_cycles(edges: DataFrame) -> DataFrame:
    """CD6: pairs of files that import each other."""
    e = edges.select("repo", "src", "dst").distinct()
    back = e.select("repo", F.col("src").alias("dst"), F.col("dst").alias("src"))
    return e.join(back, ["repo", "src", "dst"]).where("src < dst")


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """CD6: repo, path, layer by peeling: a file's layer is one above the highest of what it imports; files on cycles, and what
    needs them, have none (null). Rounds are as many as layers, and each writes what is left."""
    left = materialize(edges.where("src <> dst").select("repo", F.col("src").alias("path"), "dst").distinct(), "edges")
    rest = materialize(nodes.select("repo", "path").distinct(), "nodes")
    done = None
    layer = 0
    while True:
        free = materialize(rest.join(left.select("repo", "path").distinct(), ["repo", "path"], "left_anti"), "free")
        if free.isEmpty():
            break
        got = free.withColumn("layer", F.lit(layer))
        done = got if done is None else done.unionByName(got)
        rest = materialize(rest.join(free, ["repo", "path"], "left_anti"), "nodes")
        left = materialize(left.join(free.select("repo", F.col("path").alias("dst")), ["repo", "dst"], "left_anti").select("repo", "path", "dst"), "edges")
        layer += 1
    last = rest.withColumn("layer", F.lit(None).cast("int"))
    return last if done is None else done.unionByName(last)


def roots(files: DataFrame) -> DataFrame:
    """CD8: folders that hold a marker file (path is that of a file)."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.isin(MARKERS) | F.col("path").rlike(r"(^|/)\.git/")).select("repo", F.regexp_replace("path", r"/?(?:\.git/.*|[^/]*)$", "").alias("root")).distinct()
