"""Manifests of data sets, their stages and totals, and reports as files (MF1, AG9, VA4, SNK5, SNK6)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Stages in their order, and thresholds: a number is the most, a pair the least and the most.
STAGES = ["raw", "cleaned", "processed", "tokenized", "sharded", "ready"]


def manifest_hash(manifest: dict) -> str:
    """The first 16 hex digits of the MD5 of the fields that identify a manifest."""
    own = {k: manifest.get(k) for k in ("name", "version", "stage", "created_at", "source_paths", "processing_steps")}
    return hashlib.md5(json.dumps(own, sort_keys=True).encode()).hexdigest()[:16]


def chain_breaks(manifest: dict) -> list[str]:
    """Stages that a manifest has without the stage before, and steps whose input isn't the output before."""
    done = [s for s in STAGES if s in manifest.get("stages", {})]
    out = [f"{s} without {STAGES[i - 1]}" for s in done for i in [STAGES.index(s)] if i and STAGES[i - 1] not in done]
    steps = manifest.get("processing_steps", [])
    return out + [f"step {i} doesn't follow" for i in range(1, len(steps)) if steps[i].get("input_hash") != steps[i - 1].get("output_hash")]


def stale(manifest: dict, known_hash: str) -> bool:
    """Whether what was cached for a manifest no longer holds."""
    return manifest_hash(manifest) != known_hash


def write_manifest(spark: SparkSession, manifest: dict, folder: str) -> None:
    """SNK5: one JSON document under name/version."""
    df = spark.createDataFrame([(json.dumps({**manifest, "hash": manifest_hash(manifest)}, sort_keys=True),)], "value string")
    df.coalesce(1).write.mode("overwrite").text(f"{folder}/name={manifest['name']}/version={manifest['version']}")


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """name, version, stage, hash, records and bytes of each manifest under a folder."""
    x = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.trim("value").alias("m"))
    return x.select(*(F.get_json_object("m", f"$.{k}").alias(k) for k in ("name", "version", "stage", "hash")), *(F.get_json_object("m", f"$.statistics.{k}").cast("long").alias(k) for k in ("records", "bytes")))


def totals(manifests: DataFrame) -> DataFrame:
    """AG9: data sets, records and bytes by stage and in all (stage null)."""
    return manifests.rollup("stage").agg(F.count("*").alias("datasets"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))


def check_thresholds(stats: DataFrame, limits: dict[str, float | tuple[float, float]]) -> DataFrame:
    """VA4: metric, value and finding (above, below) of the columns of a one-row frame that break their limits."""
    rows = []
    for m, lim in limits.items():
        if m in stats.columns:
            lo, hi = lim if isinstance(lim, tuple) else (None, lim)
            v = F.col(m).cast("double")
            rows.append(F.struct(F.lit(m).alias("metric"), v.alias("value"), F.when(v > hi, "above").when(F.lit(lo).isNotNull() & (v < F.lit(lo)), "below").alias("finding")))
    return stats.select(F.inline(F.array(*rows))).where("finding is not null")


def render(rows: list[dict], form: str, title: str = "Report") -> str:
    """SNK6: a small report as json, markdown or html."""
    if form == "json":
        return json.dumps({"title": title, "rows": rows}, indent=2, default=str)
    heads = list(rows[0]) if rows else []
    if form == "markdown":
        lines = [f"# {title}", "", "| " + " | ".join(heads) + " |", "|" + " - |" * len(heads)]
        return "\n".join(lines + ["| " + " | ".join(str(r[h]).replace("|", "\\|") for h in heads) + " |" for r in rows])
    from html import escape

    body = "".join("<tr>" + "".join(f"<td>{escape(str(r[h]))}</td>" for h in heads) + "</tr>" for r in rows)
    return f"<html><body><h1>{escape(title)}</h1><table><tr>{''.join(f'<th>{escape(h)}</th>' for h in heads)}</tr>{body}</table></body></html>"


def write_report(summary: DataFrame, folder: str, title: str = "Report", most: int = 10_000) -> None:
    """SNK6: an aggregated frame as report.json, report.md and report.html; larger frames are no reports."""
    rows = [r.asDict(recursive=True) for r in summary.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError("aggregate first: a report holds few rows")
    spark = summary.sparkSession
    for form in ("json", "markdown", "html"):
        spark.createDataFrame([(render(rows, form, title),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{form}")
