"""Readers of tables, annotations, listings and text. All return DataFrames; none reads files on the driver except to sniff a kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])
ANNOTATION = T.StructType([T.StructField("id", T.StringType()), T.StructField("image", T.StringType()), T.StructField("conversations", T.ArrayType(TURN))])


def csv_inferred(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def csv_strings(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """All columns as text; a byte order mark is taken off."""
    reader = spark.read.option("header", True)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("enforceSchema", False)
    return reader.csv(path)


def csv_any_encoding(spark: SparkSession, path: str, fallback: str = "ISO-8859-1") -> DataFrame:
    """UTF-8, or the fallback encoding where UTF-8 leaves replacement characters."""
    df = csv_strings(spark, path)
    odd = F.lit(False)
    for c in df.columns:
        odd = odd | F.coalesce(F.col(f"`{c}`").contains("�"), F.lit(False)) | F.lit("�" in c)
    if df.filter(odd).limit(1).count() or any("�" in c for c in df.columns):
        return spark.read.option("header", True).option("encoding", fallback).csv(path)
    return df


def csv_safe(spark: SparkSession, path: str, most_rows: int | None = None, seed: int = 42) -> DataFrame | None:
    """Without rows and then columns that are all null; at most so many rows by hash order; None if unreadable or empty."""
    from ..operators.sampling import sample_rows

    try:
        df = csv_inferred(spark, path).dropna("all")
        counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).collect()[0] if df.columns else None
    except Exception as e:  # any reader error means the file is skipped, and why is told
        import warnings

        warnings.warn(f"{path} skipped: {e}", stacklevel=2)
        return None
    if counts is None or not any(counts):
        return None
    df = df.select([f"`{c}`" for c in df.columns if counts[c]])
    return df if most_rows is None else sample_rows(df, most_rows, df.columns, seed)


def json_array(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Files whose root is a list of records, or one record; a directory or list of files is a union."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_array_parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of a list that writers.to_json_array wrote, read in as many parts as its files give; a line that is no record is an error."""
    lines = spark.read.option("pathGlobFilter", "part-*").text(path).filter("value NOT IN (']', '[]')")
    whole = F.when(F.col("value").rlike(r"^[\[,]\{"), F.expr("substring(value, 2)")).otherwise(F.raise_error(F.concat(F.lit("no record: "), "value")))
    return lines.select(F.from_json(whole, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """One record a line; blank and malformed lines are left out."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    df = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return df.filter("_bad IS NULL").drop("_bad")


def json_or_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """By the first character that isn't white space."""
    head = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    return json_array(spark, path, schema) if head and head[0][0].lstrip().startswith("[") else jsonl(spark, path, schema)


def jsonl_or_raw(spark: SparkSession, path: str, change) -> DataFrame:
    """Lines with a change on their JSON text; lines that are no JSON object or list pass as they are.

    The parser takes a value and overlooks what follows it, so a line must also
    end as it begins.
    """
    raw = spark.read.text(path)
    is_json = F.col("value").rlike(r"^\s*(?:\{.*\}|\[.*\])\s*$") & F.try_parse_json("value").isNotNull()
    return raw.withColumn("value", F.when(is_json, F.coalesce(change(F.col("value")), F.col("value"))).otherwise(F.col("value")))


def json_union(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Records of all files, ordered by file."""
    df = spark.read.schema(schema).option("multiLine", True).json(paths)
    return df.select(*df.columns, F.col("_metadata.file_path").alias("source_file")).orderBy("source_file")


def csv_positional_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of all files under the first one's header, by place; further columns of the others are cut off."""
    first, *rest = [csv_strings(spark, p) for p in paths]
    for df in rest:
        first = first.union(df.select(*df.columns[: len(first.columns)]))
    return first


def listing(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, stem, ext and length of files; the contents aren't read."""
    from ..functions.strings import extension, stem

    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(folder)
    return df.select("path", F.substring_index("path", "/", -1).alias("name"), stem(F.col("path")).alias("stem"), F.lower(extension(F.col("path"))).alias("ext"), "length")


def annotation_files(spark: SparkSession, folders: list[str], explicit: list[str], recursive: bool = False) -> DataFrame:
    """Paths of annotation files of folders and of explicit ones, distinct and in order."""
    out = spark.createDataFrame([(p,) for p in explicit], "path string")
    for f in folders:
        for pattern in ("*.json", "*.jsonl"):
            out = out.union(listing(spark, f, pattern, recursive).select("path"))
    return out.distinct().orderBy("path")


def sidecar_title(sidecar: DataFrame) -> DataFrame:
    """Adds shown: the title, or the name where the title is empty; a blank one becomes null and doesn't fall through."""
    t = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.col("title")).otherwise(F.col("name"))
    return sidecar.withColumn("shown", F.nullif(F.trim(t), F.lit("")))


def nested_source(top: str, field: str) -> Column:
    """A field at the top level, else of the first of `sources`, else of the first of `source`."""
    return F.coalesce(F.col(top), F.get("sources", 0)[field], F.get("source", 0)[field])


def first_sidecar(files: DataFrame, candidates: list[DataFrame]) -> DataFrame:
    """Each file with the first row of the first candidate sidecar (columns folder, first, second) of its folder, joined as an address."""
    every = None
    for k, c in enumerate(candidates):
        one = c.withColumn("_p", F.lit(k))
        every = one if every is None else every.unionByName(one)
    best = every.groupBy(F.col("folder").alias("_f")).agg(F.min_by(F.struct("first", "second"), F.struct("_p", "first", "second")).alias("_r"))
    return files.join(best, files["folder"] == best["_f"], "left").withColumn("url", F.concat_ws("/", "_r.first", "_r.second")).drop("_f", "_r")


def annotation_names(df: DataFrame, path: str = "path") -> DataFrame:
    """base, model and questions of names like annotations_<base>[_questions].json."""
    pattern = r"^annotations_(.+?)(_questions)?\.json$"
    name = F.substring_index(path, "/", -1)
    return df.withColumn("base", F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))).withColumn("questions", F.regexp_extract(name, pattern, 2) != "").filter("base IS NOT NULL")


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """key and value of lines with an equals sign; blank lines and comments are left out."""
    t = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' AND NOT startswith(v, '#') AND contains(v, '=')")
    return t.select(F.trim(F.substring_index("v", "=", 1)).alias("key"), F.trim(F.regexp_replace("v", "^[^=]*=", "")).alias("value"))


def corpus_paragraphs(spark: SparkSession, path: str, least: int = 15, most: int = 50) -> DataFrame:
    """Paragraphs of so many words of whole text files."""
    from ..functions.layout import paragraphs

    t = spark.read.text(path, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("source_file"), F.posexplode(paragraphs(F.col("value"), least, most)).alias("pos", "paragraph"))


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """Distinct addresses of a sitemap file, in order."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.posexplode(F.array_distinct(F.transform(F.regexp_extract_all("value", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1), lambda u: F.trim(u)))).alias("pos", "url"))
