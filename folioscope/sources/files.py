"""Readers and writers: JSON lines, CSV, binary files, manifests, DDL."""

from __future__ import annotations

import fnmatch
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines with an explicit schema. Strict reading fails on a bad line; else bad lines are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def validate_jsonl(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """One row: lines, lines that are no JSON object, and lines without a required key."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", "map<string,string>").alias("m"), F.col("value").rlike(r"^\s*\{").alias("object"))
    lacks = reduce(lambda a, b: a | b, (~F.array_contains(F.map_keys("m"), k) for k in required), F.lit(False))
    bad = F.col("m").isNull() | ~F.col("object")
    return parsed.agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"), F.count_if(~bad & lacks).alias("n_incomplete"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header line per part; nested columns must be flattened before."""
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def with_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns under their first existing alias that has a value: ``{"text": ["text", "expected", "label"]}``."""
    pick = lambda names: F.coalesce(*(F.col(n) for n in names if n in df.columns), F.lit(None))
    return df.select(*(pick(names).alias(name) for name, names in aliases.items()))


def list_files(spark: SparkSession, folder: str, suffixes: list[str], exclude: list[str] | None = None) -> DataFrame:
    """``path, length, modificationTime`` of the files below a folder, without reading them; patterns exclude names and folders."""
    pattern = "*.{" + ",".join(s.lstrip(".") for s in suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")
    for p in exclude or []:
        files = files.where(~F.col("path").rlike(r"(?:^|/)" + fnmatch.translate(p).replace(r"\Z", "").replace(r"\z", "") + r"(?:/|$)"))
    return files.orderBy(F.lower("path"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``path, kind, bytes, sha256`` of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kind = F.when(F.col("path").rlike(r"\.jsonl?$"), "json").when(F.col("path").rlike(r"\.csv$"), "csv").when(F.col("path").rlike(r"\.parquet$"), "parquet").otherwise("other")
    return files.select("path", kind.alias("kind"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def stale(spark: SparkSession, source: str, recorded: DataFrame) -> bool:
    """Whether files of ``source`` differ in path, size or time from ``recorded`` (path, length, modificationTime)."""
    now = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("path", "length", "modificationTime")
    return not (now.exceptAll(recorded).isEmpty() and recorded.exceptAll(now).isEmpty())


_SQL = {"string": "TEXT", "bigint": "BIGINT", "int": "INT", "double": "DOUBLE PRECISION", "float": "REAL", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMPTZ", "timestamp_ntz": "TIMESTAMP"}


def create_table(df: DataFrame, name: str) -> str:
    """DDL for the columns of a flat DataFrame."""
    quoted = lambda s: '"' + s.replace('"', '""') + '"'
    columns = ",\n".join(f"  {quoted(c)} {_SQL.get(t, 'TEXT')}" for c, t in df.dtypes)
    return f"CREATE TABLE {quoted(name)} (\n{columns}\n);"


def provenance(entities: DataFrame, activity: str, agent: str) -> Column | DataFrame:
    """One JSON document per entity ``(path, sha256, bytes)``: what was made by which activity on whose behalf."""
    return entities.select(
        F.to_json(F.struct(
            F.struct(F.concat(F.lit("entity:"), "path").alias("id"), "sha256", "bytes").alias("entity"),
            F.struct(F.lit(f"activity:{activity}").alias("id")).alias("wasGeneratedBy"), F.struct(F.lit(f"agent:{agent}").alias("id")).alias("wasAttributedTo"),
        )).alias("json")
    )


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Struct fields as columns of their own, at every depth."""

    def leaves(schema: T.StructType, prefix: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema.fields:
            at = (*prefix, f.name)
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, at)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in at)).alias(separator.join(at)))
        return out

    return df.select(*leaves(df.schema, ()))


def bundle(cells: DataFrame) -> str:
    """Manifest of a retrieval bundle as JSON: counts over the cells and one example."""
    row = cells.agg(F.count("*").alias("cell_count"), F.count_distinct("doc_key").alias("documents"), F.count_distinct("doc_key", "page").alias("page_sections"), F.count_distinct("doc_key", "page", "table_index").alias("table_sections")).first()
    return json.dumps(row.asDict(), sort_keys=True)
