"""Sharded JSONL data sets: writing, discovery, reading, checks and statistics (SRC1 to SRC4, SNK1, SNK2, SNK7, AG7, VA1, VA2)."""

from __future__ import annotations

import hashlib


import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.rank import ranked

SHARD_NAME = r"_shard_(\d+)\.jsonl(?:\.gz)?$"


def _files(spark: SparkSession, folder: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def with_shards(df: DataFrame, order: list[str], per_shard: int | None = None, shards: int | None = None) -> DataFrame:
    """Adds shard: runs of ``per_shard`` rows in order (SNK1), or ``shards`` equal runs of which the last takes the rest (SNK2)."""
    x = ranked(df, order, "_rank")
    if per_shard:
        return x.withColumn("shard", F.expr(f"int(_rank div {per_shard})"))
    size = max(1, df.count() // shards)
    return x.withColumn("shard", F.least(F.expr(f"int(_rank div {size})"), F.lit(shards - 1)))


def write_shards(df: DataFrame, folder: str, name: str, order: list[str], per_shard: int = 100_000, compress: bool = True, shards: int | None = None) -> DataFrame:
    """SNK1, SNK2: files ``name_shard_00000.jsonl[.gz]`` of at most ``per_shard`` records; columns that begin with __ are left out.

    Tasks write a shard each; the driver renames files (names only). Returns shard, path, records and sha256 of the lines.
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if not c.startswith("__")]
    x = with_shards(df, order, None if shards else per_shard, shards)
    lines = x.select("shard", "_rank", F.to_json(F.struct(*keep)).alias("value"))
    raw = f"{folder}/_{name}_raw"
    lines.repartition("shard").sortWithinPartitions("shard", "_rank").select("shard", "value").write.mode("overwrite").partitionBy("shard").option("compression", "gzip" if compress else "none").text(raw)
    fs, path = _files(spark, folder)
    for part in fs.listStatus(path(raw)):
        own = part.getPath().getName()
        if own.startswith("shard="):
            data = [f.getPath() for f in fs.listStatus(part.getPath()) if f.getPath().getName().startswith("part-")]
            if len(data) != 1:
                raise ValueError(f"shard {own} has {len(data)} files")
            to = path(f"{folder}/{name}_shard_{int(own[6:]):05d}.jsonl{'.gz' if compress else ''}")
            fs.delete(to, False)
            fs.rename(data[0], to)
    fs.delete(path(raw), True)
    return checksums(read_lines(spark, folder, name))


def discover(spark: SparkSession, folder: str, name: str = "*") -> list[tuple[int, str]]:
    """SRC3: (index, path) of a data set's shards by index; files with other names are skipped."""
    import re

    fs, path = _files(spark, folder)
    found = fs.globStatus(path(f"{folder}/{name}_shard_*.jsonl*")) or []
    hits = ((re.search(SHARD_NAME, f.getPath().getName()), f.getPath().toString()) for f in found)
    return sorted((int(m[1]), p) for m, p in hits if m)


def is_continuous(indices: list[int]) -> bool:
    """SRC4: the indices are 0 to n - 1."""
    return sorted(indices) == list(range(len(indices)))


def read_lines(spark: SparkSession, folder: str, name: str = "*") -> DataFrame:
    """shard, line_no and line of all shards. Lines are numbered inside of their file, which gzip keeps in one piece."""
    files = [p for _, p in discover(spark, folder, name)]
    if not files:
        return spark.createDataFrame([], "shard int, line_no long, line string")
    x = spark.read.option("wholetext", "false").text(files).select(F.regexp_extract(F.input_file_name(), SHARD_NAME, 1).cast("int").alias("shard"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    first = x.groupBy("shard").agg(F.min("_id").alias("_first"))
    return x.join(F.broadcast(first), "shard").select("shard", (F.col("_id") - F.col("_first")).alias("line_no"), "line")  # shards are at most as many as files


def read_shards(spark: SparkSession, folder: str, schema: str, name: str = "*", seed: int | None = None) -> DataFrame:
    """SRC1, SRC2: records in shard order (of a seeded shuffle of the shards, if asked): place, shard and the fields.

    Blank and malformed lines are skipped; gzip is undone by the scan.
    """
    files = discover(spark, folder, name)
    if seed is not None:
        files.sort(key=lambda f: hashlib.md5(f"{f[0]}|{seed}".encode()).hexdigest())
    if not files:
        return spark.createDataFrame([], f"place int, shard int, {schema}")
    place = F.create_map(*[F.lit(v) for at, (i, _) in enumerate(files) for v in (i, at)])
    lines = spark.read.text([p for _, p in files]).select("value", F.regexp_extract(F.input_file_name(), SHARD_NAME, 1).cast("int").alias("shard")).where(F.try_parse_json("value").isNotNull())
    return lines.select(place[F.col("shard")].alias("place"), "shard", F.from_json("value", schema).alias("r")).select("place", "shard", "r.*")


def checksums(lines: DataFrame) -> DataFrame:
    """shard, records and the SHA-256 of its lines in order, each with its line end. A task holds one shard, which the writer bounds."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hashlib.sha256()
        for x in pdf.sort_values("line_no")["line"]:
            h.update(x.encode() + b"\n")
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "records": [len(pdf)], "sha256": [h.hexdigest()]})

    return lines.groupBy("shard").applyInPandas(one, "shard int, records long, sha256 string")


def validate_checksums(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """VA2: shard and status (ok, mismatch, missing, unexpected) against expected shard, sha256."""
    x = checksums(lines).join(expected.select("shard", F.col("sha256").alias("want")), "shard", "full_outer")
    return x.select("shard", F.when(F.col("want").isNull(), "unexpected").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("want"), "ok").otherwise("mismatch").alias("status"))


def statistics(spark: SparkSession, folder: str, name: str = "*") -> DataFrame:
    """AG7: per shard its file size (a listing), lines and records (a scan)."""
    fs, path = _files(spark, folder)
    sizes = spark.createDataFrame([(i, fs.getFileStatus(path(p)).getLen()) for i, p in discover(spark, folder, name)], "shard int, bytes long")
    x = read_lines(spark, folder, name)
    seen = x.groupBy("shard").agg(F.count("*").alias("lines"), F.sum((F.trim("line") != "").cast("long")).alias("records"), F.sum(F.octet_length("line") + 1).alias("text_bytes"))
    return sizes.join(seen, "shard", "left").fillna(0)


def validate_jsonl(lines: DataFrame, required: list[str] | None = None, least: int = 10, most: int = 1_000_000) -> DataFrame:
    """VA1: shard, line_no, finding, severity of every line that isn't well (shard null and line 0: of the whole input).

    The finding is the first that holds: blank, bad_json, not_object, missing (a required field), short, long.
    """
    required = required or ["text"]
    v = F.try_parse_json("line")
    kind = F.schema_of_variant(v)
    text = F.get_json_object("line", f"$.{required[0]}")
    missing = F.lit(False)
    for f in required:
        missing = missing | F.get_json_object("line", f"$.{f}").isNull()
    finding = (
        F.when(F.trim("line") == "", "blank").when(v.isNull(), "bad_json").when(~kind.startswith("OBJECT"), "not_object").when(missing, "missing").when(F.length(text) < least, "short").when(F.length(text) > most, "long")
    )
    x = lines.select("shard", "line_no", finding.alias("finding")).where("finding is not null")
    severity = F.when(F.col("finding").isin("blank", "short"), "warning").when(F.col("finding") == "long", "info").otherwise("error")
    whole = lines.agg(F.count("*").alias("n"), F.sum((~F.coalesce(finding, F.lit("")).isin("blank", "bad_json", "not_object")).cast("long")).alias("good"))
    empty = whole.where("n = 0 or good = 0").select(F.lit(None).cast("int").alias("shard"), F.lit(0).cast("long").alias("line_no"), F.when(F.col("n") == 0, "empty").otherwise("no_valid").alias("finding"), F.lit("error").alias("severity"))
    return x.withColumn("severity", severity).unionByName(empty)


def write_text_lines(lines: DataFrame, folder: str) -> None:
    """A column ``value`` as text files."""
    lines.select("value").write.mode("overwrite").text(folder)


