"""Scans of text corpora, code folders, repositories, dumps and metric logs (SRC5 to SRC15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SUFFIXES = [".txt", ".py", ".md", ".yml", ".yaml"]


def _glob(suffixes: list[str]) -> str:
    return "*{" + ",".join(suffixes) + "}"


def json_line_text(line: Column) -> Column:
    """The text of a JSONL line: its field text, content or code, a string literal itself, or the raw line if it is no JSON."""
    v = F.try_parse_json(line)
    field = F.coalesce(*(F.nullif(F.get_json_object(line, f"$.{k}"), F.lit("")) for k in ("text", "content", "code")))
    return F.when(v.isNull(), line).when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")).otherwise(field)


def text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """SRC5: path, line_no (of JSONL lines; 0 for whole files) and text of a file or folder, recursively; blank ones are left out."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(TEXT_SUFFIXES)).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.lit(0).cast("long").alias("line_no"), F.col("value").alias("text"))
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl*").text(folder).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line_no"), json_line_text(F.col("value")).alias("text"))
    return whole.unionByName(lines).where(F.col("text").rlike(r"\S"))


def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    """SRC6: JSON arrays, JSON lines and Parquet files under a folder as one frame; fields that a file lacks are null."""
    def under(glob: str):
        return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)

    def inferred(load) -> DataFrame | None:
        try:
            df = load()
        except Exception as e:  # no file of this kind, so no schema
            if "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return df if df.columns else None

    # a .json file is one array, or lines; which, its first sign tells
    kinds = under("*.json{,.gz}").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.ltrim(F.substring("value", 1, 1000)).startswith("[").alias("array")).collect()  # names only
    arrays, lines = [k.path for k in kinds if k["array"]], [k.path for k in kinds if not k["array"]]
    loads = [lambda: under("*.jsonl*").json(folder), lambda: under("*.parquet").parquet(folder)]
    loads += [lambda: spark.read.json(lines)] if lines else []
    loads += [lambda: spark.read.option("multiLine", "true").json(arrays)] if arrays else []
    found = [x for x in map(inferred, loads) if x is not None]
    if not found:
        raise ValueError(f"no records under {folder}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def training_texts(spark: SparkSession, folder: str) -> DataFrame:
    """SRC7: texts that a vocabulary is counted on: text or content of JSONL lines, else one text a line."""
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("line"))
    field = F.coalesce(F.nullif(F.get_json_object("line", "$.text"), F.lit("")), F.get_json_object("line", "$.content"))
    return lines.select("name", F.when(F.col("name").rlike(r"\.jsonl(\.gz)?$"), field).otherwise(F.col("line")).alias("text")).where("trim(text) <> ''")


def code_files(spark: SparkSession, folder: str, suffixes: list[str]) -> DataFrame:
    """SRC8: path and content of the files with one of the suffixes."""
    x = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(suffixes)).text(folder, wholetext=True)
    return x.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def repo_documents(spark: SparkSession, folder: str, include: list[str] | None = None, exclude: list[str] | None = None, most: int = 512 * 1024) -> DataFrame:
    """SRC9: path, content and sha256 of files of valid UTF-8 up to ``most`` bytes, in included folders and without excluded path parts."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= most)
    rel = F.regexp_replace(F.col("path"), "^.*?" + folder.rstrip("/").split("/")[-1] + "/", "")
    x = x.select(rel.alias("path"), "content").where(F.is_valid_utf8("content"))
    if include:
        x = x.where(F.substring_index("path", "/", 1).isin(include))
    if exclude:
        x = x.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, exclude))))
    return x.select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("content"))


def wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: title and text of the pages of an XML dump, without special pages and redirects."""
    x = spark.read.format("xml").option("rowTag", "page").schema("title string, redirect string, revision struct<text:string>").load(path)
    x = x.select("title", "redirect", F.col("revision.text").alias("text")).where("text is not null and redirect is null")
    return x.where(~F.col("title").rlike("^(?:Special|Talk|User|File|Template|Category|Help|Wikipedia|MediaWiki|Portal):") & ~F.col("text").rlike("(?i)^\\s*#redirect")).select("title", "text")


def acquired(df: DataFrame, text: str, least: int, most: int, marks: tuple[str, ...] = ("<|file", "<|repository")) -> DataFrame:
    """SRC11: what of a source is taken: lengths within bounds and none of the marks."""
    x = df.where(F.length(text).between(least, most))
    for m in marks:
        x = x.where(~F.col(text).contains(m))
    return x


def with_defaults(df: DataFrame, **columns: tuple[str, object]) -> DataFrame:
    """SRC13: named columns from others, with defaults for nulls."""
    return df.select(*(F.coalesce(F.col(c), F.lit(v)).alias(n) for n, (c, v) in columns.items()))


def metric_log(spark: SparkSession, folder: str, schema: str, fmt: str = "json") -> DataFrame:
    """SRC14, SRC15: a metric log of CSV or JSON lines."""
    r = spark.read.schema(schema)
    return r.option("header", "true").csv(folder) if fmt == "csv" else r.json(folder)


def last_steps(log: DataFrame, n: int, step: str = "step") -> DataFrame:
    """The last n entries by step."""
    return log.orderBy(F.desc(step)).limit(n)


def best_step(log: DataFrame, loss: str = "loss", step: str = "step") -> DataFrame:
    """The entry of the least loss, the first of equals."""
    return log.agg(F.min_by(F.struct(*log.columns), F.struct(loss, step)).alias("x")).select("x.*")
