"""Reading contest files, ledgers of runs, and idempotent writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of slot files; anything else in the folder, backups too, is not read.
SLOT_FILE = r"^slot_[^/\\]+\.json$"
ERROR_CHARS = 1000


def json_round_trip(nested: DataFrame) -> DataFrame:
    """Nested rows as the JSON reader sees them: text, parsed with the declared schema."""
    schema = T.StructType(nested.schema.fields)
    return nested.select(F.from_json(F.to_json(F.struct(*nested.columns)), schema).alias("r")).select("r.*")


def read_records(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Contest records of the slot files in a folder, with the file's name; the schema is declared, never inferred."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "slot_*.json").json(folder)
    return rows.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).where(F.col("file").rlike(SLOT_FILE))


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(file, sha) of each slot file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "slot_*.json").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha")).where(F.col("file").rlike(SLOT_FILE))


def to_ingest(hashes: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Files whose content no successful run has read; a failed run is tried again, ``force`` reads all."""
    if force:
        return hashes
    done = ledger.where("error is null").select("file", "sha").distinct()
    return hashes.join(done, ["file", "sha"], "left_anti")


def ledger_rows(runs: DataFrame) -> DataFrame:
    """Ledger rows with the error cut to ERROR_CHARS characters."""
    return runs.withColumn("error", F.substring("error", 1, ERROR_CHARS))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Old and new rows; of each key the one with the largest ``order`` stays, of those a new one before an old one, then the greatest
    by a hash of its content, so that the result does not depend on chance. Null is a key like any other."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.col(order).desc(), F.col("_new").desc(), F.xxhash64(*old.columns).desc())
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write rows so that only the partitions they have are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def slot_files(names: DataFrame, column: str = "file") -> DataFrame:
    """The rows whose file name is that of a slot file."""
    return names.where(F.col(column).rlike(SLOT_FILE))


def record_run(root: str, run_id: int, tables: dict[str, DataFrame], settings: dict[str, float]) -> None:
    """Write the tables of an aggregation run, all or none: the tables go to folders of the run, and its ledger rows (run_id, name,
    rows, settings), which make it visible, are written last and by one write. A run that breaks off leaves no ledger rows and is never read."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        path = f"{root}/runs/{run_id}/{name}"
        df.write.mode("overwrite").parquet(path)
        rows.append((run_id, name, spark.read.parquet(path).count(), {k: float(v) for k, v in settings.items()}))
    spark.createDataFrame(rows, "run_id long, name string, rows long, settings map<string,double>").coalesce(1).write.mode("append").parquet(f"{root}/ledger")


def run_table(spark: SparkSession, root: str, name: str, run_id: int | None = None) -> DataFrame:
    """A table of a finished run, the latest unless one is named; an unfinished run is an error."""
    done = spark.read.parquet(f"{root}/ledger").where(F.col("name") == name)
    found = done.agg(F.max("run_id")).first()[0] if run_id is None else done.where(F.col("run_id") == run_id).agg(F.max("run_id")).first()[0]
    if found is None:
        raise ValueError(f"no finished run has {name}")
    return spark.read.parquet(f"{root}/runs/{found}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir). A session of one machine that names none gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/work/{name}-{uuid.uuid4().hex}"
