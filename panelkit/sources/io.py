"""Reading and writing panels, prediction tables and run results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions.contract import clean_numbers, null_if_nan, require_columns

TIMES = ("timestamp_ntz", "timestamp")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's ``spark.checkpoint.dir``. Where that is unset
    a new temporary folder is set for it, if the session runs on one machine; elsewhere executors
    would write to disks of their own, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="panelkit-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder once and read them back.

    Readers see only the columns they need and the planner knows the table's real size."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def form_of(spark: SparkSession, path: str) -> str:
    """``csv`` if the path names CSV files or a folder that holds some, else ``parquet``."""
    if path.rstrip("/*").endswith((".csv", ".csv.gz")):
        return "csv"
    # Names only: the files' content is not read.
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv*").load(path)
    return "csv" if names.select("path").limit(1).count() else "parquet"


def _scan(
    spark: SparkSession, path: str | Sequence[str], names: Iterable[str], form: str | None = None
) -> DataFrame:
    """CSV is read as text under its own header, Parquet as it is. Without ``form`` the files' names tell."""
    first = path if isinstance(path, str) else path[0]
    if (form or form_of(spark, first)) == "csv":
        return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return spark.read.parquet(*([path] if isinstance(path, str) else path)).select(
        *[c for c in names]
    )


def coerce(c: Column | str, kind: str) -> Column:
    """Cast that turns unreadable values (and NaN) into NULL."""
    c = F.col(c) if isinstance(c, str) else c
    if kind in ("double", "float"):
        return null_if_nan(c.try_cast(kind))
    if kind in ("bigint", "long", "int"):
        # Whole numbers may be written with a decimal point.
        return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint")).cast(kind)
    return c.try_cast(kind)


def read_panel(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: Mapping[str, str],
    strict_ts: bool = True,
    form: str | None = None,
) -> DataFrame:
    """Panel with a declared schema (name -> type). Numbers and text are coerced; timestamps
    raise on an unreadable value if ``strict_ts``, else become NULL."""
    raw = require_columns(_scan(spark, path, schema, form), schema)
    made = []
    for name, kind in schema.items():
        value = coerce(name, kind)
        if kind in TIMES and strict_ts:
            broken = F.concat(F.lit(f"unreadable timestamp in {name}: "), F.col(name).cast("string"))
            value = F.when(
                F.col(name).isNotNull() & value.isNull(), F.raise_error(broken).cast(kind)
            ).otherwise(value)
        made.append(value.alias(name))
    return raw.select(*made)


def coerce_predictions(
    df: DataFrame, dedupe: bool = False, key: str = "id", value: str = "target"
) -> DataFrame:
    """(id BIGINT, target DOUBLE) without unreadable rows; mean per repeated id on request."""
    require_columns(df, [key, value])
    out = df.select(coerce(key, "bigint").alias("id"), coerce(value, "double").alias("target"))
    out = out.dropna(subset=["id", "target"])
    return out.groupBy("id").agg(F.avg("target").alias("target")) if dedupe else out


def read_predictions(
    spark: SparkSession, path: str | Sequence[str], dedupe: bool = False, form: str | None = None
) -> DataFrame:
    """Prediction tables as written by ``write_predictions`` or by hand, CSV or Parquet."""
    return coerce_predictions(_scan(spark, path, ["id", "target"], form), dedupe)


def read_many_predictions(spark: SparkSession, path: str, label: str = r"run=([^/]+)") -> DataFrame:
    """All prediction files under a pattern as (run, id, target); the run is the first group of
    ``label`` in the file's path."""
    raw = spark.read.option("header", True).csv(path).withColumn("__file", F.input_file_name())
    return raw.select(
        F.regexp_extract("__file", label, 1).alias("run"),
        coerce("id", "bigint").alias("id"),
        coerce("target", "double").alias("target"),
    ).dropna()


def predictions_wide(long: DataFrame, runs: Sequence[str]) -> DataFrame:
    """One column per named run; ids as rows."""
    return long.groupBy("id").pivot("run", list(runs)).agg(F.avg("target"))


def read_oof(
    spark: SparkSession, path: str | Sequence[str], mapping: Mapping[str, str], form: str | None = None
) -> DataFrame:
    """Out-of-fold table with columns renamed by ``mapping`` (new name -> stored name)."""
    raw = require_columns(_scan(spark, path, mapping.values(), form), mapping.values())
    return clean_numbers(raw.select(*[F.col(old).alias(new) for new, old in mapping.items()]))


def complete_predictions(pred: DataFrame, expected: DataFrame) -> DataFrame:
    """Predictions of exactly the expected ids; fails if any is missing."""
    missing = expected.join(pred.filter(F.col("target").isNotNull()), "id", "left_anti")
    n = missing.agg(F.count(F.lit(1))).first()[0]
    if n:
        raise ValueError(f"{n} expected ids have no prediction")
    return expected.select("id").join(pred.select("id", "target"), "id", "left")


def write_predictions(
    pred: DataFrame, expected: DataFrame, path: str, form: str = "csv"
) -> None:
    """Write ``id,target`` for the expected ids as CSV (with header) or Parquet."""
    out = complete_predictions(pred, expected)
    writer = out.write.mode("errorifexists")
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def run_leaderboard(folds: DataFrame) -> DataFrame:
    """From (run, fold, rmse, val_rows): row-weighted mean fold rmse per run, its rank position
    flag and fold count. Folds without rows count only where a run has no others."""
    ok = F.col("rmse").isNotNull()
    w = F.when(ok & (F.col("val_rows") > 0), F.col("val_rows"))
    per_run = folds.groupBy("run").agg(
        F.count_if(ok).alias("n_folds"),
        F.coalesce(
            F.try_divide(F.sum(F.col("rmse") * w), F.sum(w)), F.avg("rmse")
        ).alias("cv_rmse"),
    )
    scored = F.when(F.col("cv_rmse").isNotNull(), F.struct("cv_rmse", "run"))
    best = per_run.agg(F.min_by("run", scored).alias("b"))
    return per_run.withColumn("is_best", (F.col("run") == best.scalar()).cast("int"))


__all__ = [
    "coerce_predictions",
    "complete_predictions",
    "materialize",
    "new_path",
    "predictions_wide",
    "read_many_predictions",
    "read_oof",
    "read_panel",
    "read_predictions",
    "run_leaderboard",
    "shared_dir",
    "write_predictions",
]
