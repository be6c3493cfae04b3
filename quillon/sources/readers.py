"""Readers: CSV with line breaks in fields, Markdown folders, SQLite tables."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of the schema from a CSV with header, by name; doubled quotes and line breaks in fields.

    Other columns of the file, such as an unnamed index, are left out; a column that it lacks is null.
    """
    header = spark.read.csv(path, header=True, multiLine=True, escape='"').columns
    named = [c for c in header if not c.startswith("Unnamed")]
    wanted = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema)}
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', schema=", ".join(f"`{c}` {wanted.get(c, 'string')}" for c in header), mode="PERMISSIVE")
    df = df.select(*[F.col(f"`{c}`") for c in named if c in wanted], *[F.lit(None).cast(t).alias(c) for c, t in wanted.items() if c not in named]).select(*[f"`{c}`" for c in wanted])
    return df


def read_csv_folder(spark: SparkSession, pattern: str, schema: str, prefix: str = "") -> DataFrame:
    """CSV files by pattern with `file_key`, the name without extension and prefix; unreadable files are skipped."""
    df = spark.read.option("ignoreCorruptFiles", True).csv(pattern, header=True, multiLine=True, escape='"', schema=schema)
    return df.withColumn("file_key", F.regexp_replace(F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", ""), f"^{prefix}", ""))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(guide_id, text, lang) of each .md file; the language is the end of the id."""
    df = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1).alias("guide_id"), F.col("value").alias("text"))
    return df.withColumn("lang", F.right("guide_id", F.lit(3)))


def read_files(spark: SparkSession, path: str, kind: str = "application/pdf") -> DataFrame:
    """(name, status, length): `success` for files that begin as PDF, else `error`."""
    df = spark.read.format("binaryFile").load(path)
    good = F.substring(F.col("content"), 1, 4) == F.lit(b"%PDF")
    return df.select(F.col("_metadata.file_name").alias("name"), F.when(good | F.lit(kind != "application/pdf"), "success").otherwise("error").alias("status"), "length")


class _Slice(InputPartition):
    def __init__(self, low: int, high: int | None) -> None:
        super().__init__((low, high))
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, options
        self.where: list[tuple[str, list]] = []

    def partitions(self) -> list[_Slice]:
        n = int(self.options.get("partitions", 4))
        with sqlite3.connect(self.options["path"]) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.options["table"]}"').fetchone()
        if low is None:
            return [_Slice(0, 0)]
        step = max(1, -(-(high - low + 1) // n))
        return [_Slice(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part: _Slice) -> Iterator[tuple]:
        columns = ", ".join(f'"{f.name}"' for f in self.schema)
        with sqlite3.connect(self.options["path"]) as db:
            told = "".join(f' AND "{name}" IN ({", ".join("?" * len(values))})' for name, values in self.where)
            yield from db.execute(f'SELECT {columns} FROM "{self.options["table"]}" WHERE rowid >= ? AND rowid < ?{told}', (part.low, part.high, *(v for _, values in self.where for v in values)))


class _PushingReader(_SqliteReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality with a value and membership in a list go to the database, others are left to Spark."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and all(isinstance(v, str | int | float) for v in values):
                self.where.append((f.attribute[0], values))
            else:
                yield f


class SqliteSource(DataSource):
    """spark.read.format("sqlite").option("path", ...).option("table", ...): slices of rowid in parallel.

    With option("pushdown", "true"), which needs spark.sql.python.filterPushdown.enabled, lookups by value run in the
    database; read_sqlite() sets both.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        kinds = {"INT": LongType(), "REAL": DoubleType(), "DOUB": DoubleType(), "FLOA": DoubleType()}
        with sqlite3.connect(self.options["path"]) as db:
            info = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        return StructType([StructField(c[1], kinds.get((c[2] or "").upper()[:4].replace("INTE", "INT"), StringType())) for c in info])

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = _PushingReader if self.options.get("pushdown", "false") == "true" else _SqliteReader
        return kind(schema, dict(self.options))


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    """A table of an SQLite file; comparisons with a value or a list of values run in the database."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions).option("pushdown", "true").load()


def load_csv_tables(spark: SparkSession, folder: str, schema: str, prefix: str = "e_") -> list[str]:
    """Each CSV file of the folder as a table of its name, replaced; gives the names."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*.csv").load(folder).select("path").collect()  # file names only
    names = []
    for row in rows:
        name = row["path"].rsplit("/", 1)[1][:-4]
        read_csv(spark, row["path"], schema).write.mode("overwrite").saveAsTable(name)
        names.append(name)
    return sorted(names)


def discover(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Parquet data partitioned as `key=value/`, or else with the folder's name of each file as key."""
    df = spark.read.option("basePath", folder).parquet(folder)
    return df if key in df.columns else df.withColumn(key, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def existing_or_base(spark: SparkSession, result: str, base: str) -> DataFrame:
    """The table at result if it can be read, else that at base."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(result)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(result if there else base)


def batch_results(requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """Requests (request_id, ...) with the response of a batch job's JSON lines (value); lines that can't be read are skipped."""
    parsed = predictions.select(F.from_json("value", "request_id string, response string").alias("p")).where("p.request_id IS NOT NULL")
    once = parsed.groupBy(F.col("p.request_id").alias("request_id")).agg(F.max("p.response").alias("response"))
    return requests.join(once, requests["request_id"].cast("string") == once["request_id"], "left").drop(once["request_id"])
