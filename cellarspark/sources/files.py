"""Sources and sinks beside the Parquet tables: CSV catalogs, JSON records, keyed caches, image folders, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from cellarspark.operators.index import first_rows
from cellarspark.operators.lookup_cache import upsert
from cellarspark.sources.tables import cell

#: columns of a product catalog; all text, '' where missing
CATALOG = ("slug", "name", "winery", "grape", "color", "category", "region", "description", "image", "taste", "sugar", "food")


def read_catalog(spark: SparkSession, path: str, headers: dict[str, str]) -> DataFrame:
    """A catalog from CSV with a header: `headers` maps the file's names to the engine's; absent columns are '', the first row of each slug counts.

    The schema is text throughout, so nothing is inferred. Row order is the order in the file for files read in one piece, and
    by file and place within it otherwise.
    """
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).csv(path)
    named = raw.select(*[F.col(f"`{c}`").alias(headers.get(c.lstrip("﻿"), c.lstrip("﻿"))) for c in raw.columns])
    cols = [cell(c).alias(c) if c in named.columns else F.lit("").alias(c) for c in CATALOG]
    return first_rows(named.select(F.monotonically_increasing_id().alias("row_idx"), *cols), "slug", "row_idx")


def json_lines(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file has one record a line: its first character that is no blank opens no array, and its first line ends
    the record that it opens."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value")).first()
    return first is not None and not first[0].startswith("[") and first[0].endswith("}")


def read_json_records(spark: SparkSession, path: str, schema: t.StructType | str, lines: bool | None = None, broken: bool = False) -> DataFrame:
    """Records of a JSON array or of lines (found out from the file unless `lines` tells); fields that do not fit are NULL.

    Broken records are left out; with `broken` they are what comes out instead, as `record`, so that none is lost unseen.
    An empty file has no records.
    """
    schema = t._parse_datatype_string(schema) if isinstance(schema, str) else schema
    by_line = json_lines(spark, path) if lines is None else lines
    text = spark.read.text(path, wholetext=not by_line).where(F.trim("value") != "")
    if by_line:
        full = t.StructType([*schema.fields, t.StructField("__broken", t.StringType())])
        read = text.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}).alias("r"))
        whole = F.col("r").isNotNull() & F.col("r.__broken").isNull()
        rows = read.where(whole).select(*[F.col(f"r.`{f.name}`") for f in schema.fields])
    else:
        read = text.select("value", F.from_json("value", t.ArrayType(schema)).alias("r"))
        whole = F.col("r").isNotNull()
        rows = read.where(whole).select(F.explode("r").alias("r")).select("r.*")
    return read.where(~whole).select(F.col("value").alias("record")) if broken else rows


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, path, length, content) of the images of a folder tree; the slug is the file's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,webp,bmp,JPG,JPEG,PNG}").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_extract("path", "([^/]+)\\.[^.]+$", 1).alias("slug"), "path", "length", "content")


def profile_files(files: DataFrame) -> DataFrame:
    """(extension, files, bytes_min, bytes_max, bytes_mean) of a file listing."""
    ext = F.lower(F.regexp_extract("path", "\\.([^.]+)$", 1))
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("files"), F.min("length").alias("bytes_min"), F.max("length").alias("bytes_max"), F.avg("length").alias("bytes_mean"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, slug, embedding) of stored vectors, NULL and empty ones left out."""
    return spark.read.parquet(path).where(F.size("embedding") > 0)


def write_vectors(df: DataFrame, path: str) -> None:
    """Store unit vectors with their keys; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when(norm > 0, F.transform("embedding", lambda x: (x / norm).cast("float"))).otherwise(F.col("embedding"))
    df.withColumn("embedding", unit).write.mode("overwrite").parquet(path)


def write_cache(cache: DataFrame, fresh: DataFrame, path: str) -> None:
    """The cache with new entries, the last of each key, written to a new place."""
    upsert(cache, fresh, "cache_key", "cached_at", "cache_id").write.mode("errorifexists").parquet(path)


def public_json(result: DataFrame) -> DataFrame:
    """(request, body): one JSON document a request; confidence is 1 for codes, absent cells are left out."""
    sure = F.when(F.col("method").isin("barcode", "qr", "code") & (F.col("status") == "found"), F.lit(1.0)).otherwise(F.col("confidence"))
    keep = [c for c in result.columns if c not in ("request", "confidence")]
    return result.select("request", F.to_json(F.struct(*keep, sure.alias("confidence"))).alias("body"))


def public_view(result: DataFrame, cells: list[str], empty: str = "") -> DataFrame:
    """One answer a request: a found one shows its card's cells and slug, any other none of them, only its candidates."""
    found = F.col("status") == "found"
    status = F.when(found, "found").when(F.col("status") == "not_in_catalog", "not_in_catalog").otherwise("not_found")
    shown = [F.when(found, F.coalesce(c, F.lit(empty))).otherwise(F.lit(empty)).alias(c) for c in cells]
    return result.select("request", status.alias("status"), F.when(found, F.col("slug")).alias("slug"), F.round(F.coalesce("confidence", F.lit(0.0)), 4).alias("confidence"), *shown)
