"""Readers and writers."""

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream of its files."""
    return spark.readStream.schema(table(spark, folder, name).schema).option("pathGlobFilter", f"{name}.parquet*").parquet(folder)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. A session of one machine that names none, as in tests, gets a
    temporary folder; a cluster without one is an error, as its executors share no local folder."""
    if not (named := spark.conf.get("spark.checkpoint.dir", None)):
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="serialis-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in a folder of its own below the shared one, which goes when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/serialis-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(jvm_path)
    files.deleteOnExit(jvm_path)  # only of what exists
    return f"{folder}/table"


def kept_table(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, *old: DataFrame) -> DataFrame:
    """kept_table of df; kept tables that it was made of and that nothing else needs go then."""
    new = kept_table(df)
    for folder in {f.rpartition("/")[0] for table in old for f in table.inputFiles()}:
        remove(df.sparkSession, folder)
    return new


def record_start(spark: SparkSession, path: str) -> str | None:
    """How each record of a JSON array begins: its brace and first key, as the first one is written. None: no record."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(at).isDirectory():
        inside = [x.getPath() for x in files.listStatus(at) if x.getLen() and x.getPath().getName()[0] not in "._"]
        if not inside:
            return None
        at = inside[0]
    stream = files.open(at)
    try:
        head = spark._jvm.org.apache.commons.io.IOUtils.toString(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, 65_536), "UTF-8")
    finally:
        stream.close()
    found = re.match(r'\ufeff?\s*\[\s*(\{\s*"[^"\\]*"\s*:)', head)
    return found and found[1]


def dump(spark: SparkSession, path: str, model: str, fields: StructType, defaults: dict | None = None) -> DataFrame:
    """One model's rows (pk, fields) of a JSON dump, an array of {model, pk, fields} in any order of keys;
    absent fields get their default. A folder is as many dumps as it has files, all written alike.

    The array is no file of lines, but its records all begin alike, so what begins the first one is the
    separator: Spark cuts the file into byte ranges and each task reads the records that begin in its own,
    whatever line breaks there are. Text in a record can't hold the separator, as its quotes would be escaped;
    a nested object that begins so is an error, as is any record that can't be read. An empty array has no rows.
    """
    schema = StructType().add("model", "string").add("pk", "long").add("fields", fields).add("__bad", "string")
    if not (start := record_start(spark, path)):
        return spark.createDataFrame([], StructType().add("pk", "long").add("fields", fields)).select("pk", "fields.*")
    pieces = spark.read.option("lineSep", start).text(path).where(~F.col("value").rlike(r"\A\x{FEFF}?\s*\[?\s*\z"))
    record = F.from_json(F.concat(F.lit(start), F.regexp_replace("value", r"[\s,\]]*\z", "")), schema, {"columnNameOfCorruptRecord": "__bad"})
    bad = F.raise_error(F.concat(F.lit(f"a record of {path} can't be read: "), F.substring("r.__bad", 1, 200)))
    rows = pieces.select(record.alias("r")).where(F.when(F.col("r.__bad").isNotNull(), bad.cast("boolean")).otherwise(F.col("r.model") == model))
    return rows.select("r.pk", "r.fields.*").fillna(defaults or {})


def _array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's records as lines of one array."""
    before, rows = "[", 0
    for batch in batches:
        lines = []
        for text in batch.column(0).to_pylist():
            lines.append(before + text)
            before = ","
        rows += len(lines)
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])


def write_dump(records: DataFrame, value: str, path: str) -> None:
    """Write records, as JSON text that all begins alike, as a folder of dumps, an array in each file."""
    records.select(value).mapInArrow(_array, "value string").write.text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of the files below a folder; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")


def error_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, errors): log files with an error line or a traceback, named as `files` names them."""
    from serialis.functions.text import is_error_line

    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:///", "file:/").alias("file"), "value")
    return lines.where(is_error_line(F.col("value"))).groupBy("file").agg(F.count(F.lit(1)).alias("errors"))


def endpoints(spark: SparkSession, *paths: str, pattern: str = r"(\d{1,3}(?:\.\d{1,3}){3}:\d{2,5})") -> DataFrame:
    """(endpoint): all distinct host:port in text, XML or gzip files, without the local host's."""
    lines = spark.read.text(list(paths))
    found = lines.select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1))).alias("endpoint"))
    return found.where(~F.col("endpoint").startswith("127.")).distinct()


def snapshot(df: DataFrame, path: str, kind: str = "json") -> None:
    """A compressed copy of a table as json, csv or parquet."""
    df.write.mode("overwrite").option("compression", "gzip").format(kind).save(path)


def refresh(df: DataFrame, path: str, *partitions: str) -> None:
    """Rewrite a derived table; with partitions only those that df has are replaced."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def rendered_log(time: Column, level: Column, text: Column) -> Column:
    return F.concat_ws(" ", F.date_format(time, "yyyy-MM-dd HH:mm:ss"), level, text)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if there is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def set_times(spark: SparkSession, times: dict[str, int]) -> None:
    """Set when the files of each folder were last changed, in milliseconds."""
    for folder, millis in times.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for x in system.listStatus(at):
            system.setTimes(x.getPath(), millis, -1)
