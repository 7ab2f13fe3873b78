"""Scans of files and databases, always with declared types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tabular import conform


def csv(spark: SparkSession, path: str, schema: dict[str, str], required: tuple[str, ...] = (), sep: str = ",") -> DataFrame:
    """A CSV file with header: names trimmed and in lower case, a byte order mark dropped, values typed."""
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    return conform(raw, schema, required)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_documents(spark: SparkSession, path: str, schema: str, root: str | None = None) -> DataFrame:
    """A file that is one array, or an object that holds it under `root`."""
    if root is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    d = spark.read.schema(f"`{root}` array<struct<{schema}>>").option("multiLine", True).json(path)
    return d.select(F.explode(root).alias("d")).select("d.*")


def text_files(spark: SparkSession, folder: str, ids: DataFrame, id_: str = "doc_id") -> DataFrame:
    """(ids' columns, text) of files named after an id; text is null where the file is missing."""
    files = spark.read.option("wholetext", True).text(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("_stem"), F.col("value").alias("text"))
    return ids.join(files, F.col(id_).cast("string") == F.col("_stem"), "left").drop("_stem")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def database(spark: SparkSession, url: str, table: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """A table over JDBC; filters and columns go to the database."""
    d = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()
    return d.select(*columns) if columns else d


def by_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed: a semi join, which the planner broadcasts when the list is small."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def unprocessed(df: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Rows that no line of an append log has yet."""
    return df.join(log.select(key).distinct(), key, "left_anti")


def marc_records(spark: SparkSession, path: str) -> DataFrame:
    """(record) of an ISO 2709 file, split at the record terminator; fragments below a leader's length are left out."""
    return spark.read.option("lineSep", "\x1d").text(path).select(F.col("value").alias("record")).where(F.length(F.trim("record")) >= 24)


def marc_fields(record: Column) -> Column:
    """map(tag, array of contents) of an ISO 2709 record, from the directory in its leader. Offsets count bytes,
    so the record is taken apart as binary."""
    raw = F.encode(record, "UTF-8")
    base = F.substring(record, 13, 5).try_cast("int")
    entries = F.when(base > 36, F.transform(F.sequence(F.lit(25), base - 12, F.lit(12)), lambda i: F.struct(
        F.substring(record, i, F.lit(3)).alias("tag"), F.substring(record, i + 3, F.lit(4)).try_cast("int").alias("n"), F.substring(record, i + 7, F.lit(5)).try_cast("int").alias("at"))))
    good = F.filter(F.coalesce(entries, F.array().cast("array<struct<tag:string,n:int,at:int>>")), lambda e: e["tag"].rlike("^[0-9A-Za-z]{3}$") & e["n"].isNotNull() & e["at"].isNotNull())
    fields = F.transform(good, lambda e: F.struct(e["tag"].alias("tag"), F.regexp_replace(F.decode(F.substring(raw, base + e["at"] + 1, e["n"]), "UTF-8"), "[\x1e]", "").alias("value")))
    tags = F.array_distinct(F.transform(fields, lambda f: f["tag"]))
    return F.map_from_arrays(tags, F.transform(tags, lambda t: F.transform(F.filter(fields, lambda f: f["tag"] == t), lambda f: f["value"])))


def subfields(value: Column) -> Column:
    """array of struct(code, text) of a field."""
    every = F.split(value, "\x1f")
    parts = F.slice(every, F.lit(2), F.greatest(F.lit(0), F.size(every) - 1))
    return F.transform(F.filter(parts, lambda p: F.length(p) > 0), lambda p: F.struct(F.substring(p, 1, 1).alias("code"), F.trim(p.substr(F.lit(2), F.length(p))).alias("text")))


def person(value: Column) -> Column:
    """Entry element, rest of name and additions of a name field: the first a, b and f, in this order."""
    s = subfields(value)
    first = lambda c: F.get(F.filter(s, lambda x: x["code"] == c), F.lit(0))["text"]
    return F.concat_ws(" ", first("a"), first("b"), first("f"))
