"""Scans with declared schemas, JSON lines, record flattening, version de-duplication and harmonised unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes NULL."""
    real = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in real else F.col(c) for c in df.columns])


def read_table(spark: SparkSession, path, schema: str | T.StructType, columns: Sequence[str] | None = None,
               where: Column | None = None, form: str | None = None) -> DataFrame:
    """Scan parquet or delimited files (globs, gz) under a declared schema.

    Columns of the schema that the files lack come back NULL.  ``columns`` and ``where``
    reach the scan as pruning and pushed filters.
    """
    first = path if isinstance(path, str) else path[0]
    form = form or ("parquet" if first.rstrip("/").endswith("parquet") else "tsv" if ".tsv" in first else "csv")
    reader = spark.read.schema(schema)
    if form == "parquet":
        df = reader.parquet(*([path] if isinstance(path, str) else path))
    else:
        df = reader.option("header", True).option("sep", "\t" if form == "tsv" else ",").option("enforceSchema", False).csv(path)
    if where is not None:
        df = df.filter(where)
    return nan_to_null(df.select(*columns) if columns else df)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write parquet, or gzipped csv / tsv with a header, so that ``read_table`` reads the same rows; nothing is overwritten."""
    writer = df.write.mode("errorifexists")
    if form == "parquet":
        writer.parquet(path)
    else:
        writer.option("header", True).option("sep", "\t" if form == "tsv" else ",").option("compression", "gzip").csv(path)


def read_csv_by_name(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Delimited files whose header may lack or reorder columns: read as strings by name, cast, missing ones NULL."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    have = {c.lower(): c for c in raw.columns}
    return nan_to_null(raw.select(*[
        (F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields]))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per line; lines that do not parse are kept in ``_corrupt``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def parse_jsonl(df: DataFrame, line: str, schema: str) -> DataFrame:
    """The same for lines already held in a column."""
    rec = F.from_json(line, f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return df.withColumn("_r", rec).select(*[c for c in df.columns if c != line], "_r.*")


def decode(code: Column, labels: Mapping[str, str], default: str = "unknown") -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(table[code.cast("string")], F.lit(default))


# Report codes.
SEX_LABELS = {"1": "male", "2": "female"}
ROLE_LABELS = {"1": "suspect", "2": "concomitant", "3": "interacting"}
AGE_UNIT_YEARS = {"800": 10.0, "801": 1.0, "802": 1 / 12, "803": 7 / 365.25, "804": 1 / 365.25, "805": 1 / (24 * 365.25)}


def flatten_reports(df: DataFrame, keep: Sequence[str] = (), patient: str = "patient") -> DataFrame:
    """Nested drug reports to one flat row each.

    Drug names are the harmonised ones, else the verbatim product, upper-cased and trimmed;
    lists are distinct and sorted, one per role; unknown codes decode to ``unknown``.
    """
    def names(d):
        listed = F.filter(F.coalesce(d["generic_name"], F.array().cast("array<string>")), lambda x: x.isNotNull())
        given = F.when(F.size(listed) > 0, listed).when(d["product"].isNotNull(), F.array(d["product"]))
        return F.transform(F.coalesce(given, F.array().cast("array<string>")), lambda x: F.trim(F.upper(x)))

    drugs = F.coalesce(F.col(f"{patient}.drug"), F.array())

    def role(code):
        mine = drugs if code is None else F.filter(drugs, lambda d: d["role"].cast("string") == code)
        return F.array_sort(F.array_distinct(F.flatten(F.transform(mine, names))))

    terms = F.transform(F.coalesce(F.col(f"{patient}.reaction"), F.array()), lambda r: r["term"])
    return df.select(*keep, decode(F.col(f"{patient}.sex"), SEX_LABELS).alias("sex"), role(None).alias("drugs"),
                     *[role(c).alias(n) for c, n in ROLE_LABELS.items()],
                     F.array_sort(F.array_distinct(F.filter(terms, lambda x: x.isNotNull() & (x != "")))).alias("reactions"))


def flatten_devices(df: DataFrame, keep: Sequence[str] = (), device: str = "device", texts: str = "texts") -> DataFrame:
    """Nested device reports to one flat row: first device only, narratives joined by kind of text."""
    first = F.get(F.col(device), 0)

    def said(pattern):
        mine = F.filter(F.coalesce(F.col(texts), F.array()), lambda x: F.lower(x["kind"]).rlike(pattern))
        return F.trim(F.array_join(F.transform(mine, lambda x: x["text"]), " "))

    return df.select(*keep, first["brand"].alias("brand"), first["code"].alias("code"), F.size(F.coalesce(F.col(device), F.array())).alias("n_devices"),
                     said("^description").alias("narrative"), said("manufacturer").alias("manufacturer_narrative"))


def explode_pairs(reports: DataFrame, key: Sequence[str], left: str, right: str, outer: bool = False) -> DataFrame:
    """One row per distinct (report, left item, right item); reports lacking a side drop out or stay with NULL.

    Items are made distinct inside each report's lists, so no shuffle is needed.
    """
    ex = F.explode_outer if outer else F.explode
    d = reports.select(*key, F.array_distinct(left).alias("_l"), F.array_distinct(right).alias("_r"))
    return d.select(*key, "_r", ex("_l").alias(left)).select(*key, left, ex("_r").alias(right))


def dedupe_latest(df: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """All rows of the highest numeric version of each key (a version that is no number counts 0), exact duplicates dropped.

    The top version per key is a partial aggregate; rows of a hot key are never sorted together.
    """
    v = F.coalesce(F.col(version).try_cast("bigint"), F.lit(0))
    top = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(F.max(v).alias("_top"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key] + [v == F.col("_top")]
    return df.join(top, on, "left_semi").distinct()


def latest_row(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order`` (which must be total)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def read_corpus(spark: SparkSession, paths: Sequence[str], schema: str | T.StructType, pattern: str, form: str = "parquet",
                tag: str = "dataset") -> DataFrame:
    """Many per-dataset tables as one, each row tagged with the name parsed from its file path."""
    df = spark.read.format(form).schema(schema).option("header", True).load(list(paths))
    return df.select("*", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias(tag))


def write_manifest(df: DataFrame, path: str, ids: Sequence[str], split: str = "split") -> None:
    """Record ids under their split label, so later runs reuse the same assignment."""
    df.select(*ids, split).write.mode("errorifexists").partitionBy(split).parquet(path)


def read_manifest(spark: SparkSession, path: str, ids: str, split: str = "split") -> DataFrame:
    """A manifest written by ``write_manifest``; ``ids`` declares its columns, a filter on ``split`` reads only that folder."""
    return spark.read.schema(f"{ids}, {split} STRING").parquet(path)


def concat_harmonized(frames: Sequence[DataFrame], schema: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """Union of adapter outputs under one schema; columns a frame lacks are NULL, rows without the required values drop out."""
    missing = [c for c in required if any(c not in f.columns for f in frames)]
    if missing:
        raise ValueError(f"an adapter lacks the required columns {missing}")
    cast = [f.select(*[F.col(c).cast(k).alias(c) if c in f.columns else F.lit(None).cast(k).alias(c) for c, k in schema.items()]) for f in frames]
    return reduce(DataFrame.unionByName, cast).dropna(subset=list(required))
