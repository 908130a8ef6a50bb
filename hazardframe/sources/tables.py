"""Table sources and sinks: clinical and feature tables, image manifests, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, NumericType, StringType, StructField, StructType

from hazardframe.functions.scalar import clean
from hazardframe.operators.ordered import match
from hazardframe.session import cut_lineage

CLINICAL_SCHEMA = StructType([
    StructField("PatientID", StringType()), StructField("age", DoubleType()),
    StructField("clinical.T.Stage", IntegerType()), StructField("Clinical.N.Stage", IntegerType()),
    StructField("Clinical.M.Stage", IntegerType()), StructField("Overall.Stage", StringType()),
    StructField("Histology", StringType()), StructField("gender", StringType()),
    StructField("Survival.time", IntegerType()), StructField("deadstatus.event", IntegerType()),
])


def quoted(name: str) -> str:
    """Column reference that survives dots in the name."""
    return "`" + name.replace("`", "``") + "`"


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, fmt: str | None = None) -> DataFrame:
    """Read parquet or CSV (by suffix unless ``fmt`` is given); ``NA`` and NaN become null."""
    fmt = fmt or ("csv" if path.rstrip("/").lower().endswith((".csv", ".csv.gz")) else "parquet")
    if fmt == "csv":
        reader = spark.read.option("header", True).option("nullValue", "NA")
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    else:
        df = (spark.read.schema(schema) if schema else spark.read).format(fmt).load(path)
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.select(*[clean(F.col(quoted(c))).alias(c) if kinds[c] in ("double", "float") else F.col(quoted(c))
                       for c in df.columns])


def read_clinical(spark: SparkSession, path: str, schema: StructType | None = CLINICAL_SCHEMA,
                  fmt: str | None = None) -> DataFrame:
    return read_table(spark, path, schema, fmt)


def read_features(spark: SparkSession, path: str, schema: StructType | None = None, fmt: str | None = None) -> DataFrame:
    return read_table(spark, path, schema, fmt)


def select_complete_subjects(df: DataFrame, id_col: str, kind_col: str, required: list[str], n: int) -> DataFrame:
    """All rows of the first ``n`` subjects (id order) that have every required kind.

    A ``n`` above the number of complete subjects takes them all; no complete subject is an error.
    """
    complete = (df.where(F.col(kind_col).isin(required)).groupBy(id_col)
                .agg(F.countDistinct(kind_col).alias("__k")).where(F.col("__k") == len(set(required)))
                .select(id_col))
    chosen = cut_lineage(complete.orderBy(id_col).limit(n))
    if chosen.isEmpty():
        raise ValueError(f"no subject has every kind of record in {sorted(required)}")
    return df.join(chosen, id_col, "left_semi")


def subjects_with_all(df: DataFrame, id_col: str, kind_col: str, required: list[str]) -> DataFrame:
    """Ids that occur with each of the kinds, as a set intersection."""
    first, *rest = [df.where(F.col(kind_col) == k).select(id_col) for k in required]
    for other in rest:
        first = first.intersect(other)
    return first.distinct()


def regroup_manifest(files: DataFrame, folder: str, path: str, id_col: str, kind_col: str) -> tuple[DataFrame, DataFrame]:
    """Give every file of a folder the subject and kind of the folder's first file.

    Returns ``(files, rejects)``: folders whose first file has no subject or kind are kept aside with a reason.
    """
    heads = files.groupBy(folder).agg(F.min_by(F.struct(F.col(id_col), F.col(kind_col)), path).alias("__head"))
    tagged = match(files.select(folder, path), heads, [folder])
    good = F.col(f"__head.{id_col}").isNotNull() & F.col(f"__head.{kind_col}").isNotNull()
    placed = tagged.where(good).select(F.col(f"__head.{id_col}").alias(id_col),
                                       F.col(f"__head.{kind_col}").alias(kind_col), folder, path)
    rejects = tagged.where(~good).groupBy(folder).agg(F.count("*").alias("n_files")).withColumn(
        "reason", F.lit("first file has no subject or kind"))
    return placed, rejects


def write_manifest(placed: DataFrame, path: str, id_col: str, kind_col: str) -> None:
    placed.write.mode("overwrite").partitionBy(id_col, kind_col).parquet(path)


def complete_pairs(files: DataFrame, id_col: str, kind_col: str, image: str = "image",
                   label: str = "label") -> DataFrame:
    """One row per subject with a status: ``ok`` or why it is skipped."""
    has = lambda k: F.max(F.when(F.col(kind_col) == k, 1).otherwise(0))
    status = (F.when((F.col("__i") == 1) & (F.col("__l") == 1), "ok")
              .when(F.col("__i") == 1, "label missing").when(F.col("__l") == 1, "image missing")
              .otherwise("image and label missing"))
    return files.groupBy(id_col).agg(has(image).alias("__i"), has(label).alias("__l")).select(
        id_col, status.alias("status"))


def pending_only(df: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """Rows whose subject is not in the output yet."""
    return df.join(done.select(id_col).distinct(), id_col, "left_anti")


def validate_images(meta: DataFrame, strict: bool = False) -> DataFrame:
    """Status per image from ``has_label``, ``n_rois``, ``has_target``, ``image_size`` and ``mask_size``.

    With ``strict`` a size mismatch raises and names one offending image.
    """
    status = (F.when(~F.col("has_label"), "no label file").when(F.col("n_rois") == 0, "no region in the label file")
              .when(~F.col("has_target"), "target region missing")
              .when(F.col("image_size") != F.col("mask_size"), "size mismatch").otherwise("ok"))
    out = meta.withColumn("status", status)
    if strict:
        bad = out.where(F.col("status") == "size mismatch").limit(1).collect()
        if bad:
            raise ValueError(f"Mask size {bad[0]['mask_size']} does not match image size {bad[0]['image_size']}.")
    return out


def features_long_to_wide(long: DataFrame, id_col: str, feature: str = "feature", value: str = "value",
                          names: list[str] | None = None) -> DataFrame:
    """One row per subject, id first. Without ``names`` the distinct feature names (a short list) are used."""
    if names is None:
        names = [r[0] for r in long.select(feature).distinct().orderBy(feature).collect()]
        if not names:
            raise ValueError("No features to write.")
    wide = long.groupBy(id_col).pivot(feature, names).agg(F.first(value))
    return wide.select(id_col, *[F.col(quoted(n)) for n in names])


def drop_prefixed(df: DataFrame, prefix: str = "diagnostics_") -> DataFrame:
    return df.select(*[F.col(quoted(c)) for c in df.columns if not c.startswith(prefix)])


def rounded(df: DataFrame, digits: int) -> DataFrame:
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.round(F.col(quoted(c)), digits).alias(c) if c in floats else F.col(quoted(c))
                       for c in df.columns])


def write_report(df: DataFrame, path: str, digits: int = 2, fmt: str = "csv") -> None:
    """Write a result with a fixed number of decimals: four for features and classes, two for the rest."""
    writer = rounded(df, digits).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def cohort_differences(features: DataFrame, manifest: DataFrame, id_col: str) -> DataFrame:
    """Subjects that are in only one of the two tables."""
    a = features.select(id_col).distinct().withColumn("in_features", F.lit(True))
    b = manifest.select(id_col).distinct().withColumn("in_manifest", F.lit(True))
    return (a.join(b, id_col, "full_outer").where("in_features IS NULL OR in_manifest IS NULL")
            .select(id_col, F.coalesce("in_features", F.lit(False)).alias("in_features"),
                    F.coalesce("in_manifest", F.lit(False)).alias("in_manifest")))


def require_cohort_match(features: DataFrame, manifest: DataFrame, id_col: str) -> None:
    """Stop when stored features belong to another set of subjects."""
    n = cohort_differences(features, manifest, id_col).count()
    if n:
        raise ValueError(f"Stored features are outdated: {n} subjects differ from the manifest.")


def numeric_features(df: DataFrame, exclude: list[str]) -> list[str]:
    """Names of numeric columns, without the id, time and event columns (absent names are ignored)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]
