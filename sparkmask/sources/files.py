"""Files as tables: csv, parquet, json, orc on any store that Spark reads; Arrow IPC by Python workers; value lists."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MaskError
from ..functions import words

FORMATS = ("csv", "parquet", "json", "orc")


def location(end: dict) -> str:
    if end.get("type") == "s3":
        return f"s3a://{end['bucket']}/{end['key']}"
    if end.get("type") == "gcs":
        return f"gs://{end['bucket']}/{end['object']}"
    if not end.get("path"):
        raise MaskError("source_path_missing")
    return end["path"]


def read_source(spark: SparkSession, end: dict) -> DataFrame:
    """CSV columns are texts, so that leading zeros of keys survive; schema or inferSchema in options change that."""
    kind, o = end.get("format", "parquet"), dict(end.get("options") or {})
    if end.get("type") == "s3":
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for k, name in (("endpoint", "fs.s3a.endpoint"), ("region", "fs.s3a.endpoint.region")):
            if end.get(k):
                conf.set(name, end[k])
    if kind == "ipc":
        return read_ipc(spark, location(end))
    if kind not in FORMATS:
        raise MaskError("source_format_unknown", kind)
    schema = o.pop("schema", None)
    reader = spark.read.options(**({"header": "true"} | o if kind == "csv" else o))
    if schema:
        reader = reader.schema(schema)
    return getattr(reader, kind)(location(end))


def write_target(df: DataFrame, end: dict, mode: str = "overwrite") -> None:
    kind, o = end.get("format", "parquet"), dict(end.get("options") or {})
    if kind not in FORMATS:
        raise MaskError("target_format_unknown", kind)
    by = o.pop("partition_by", [])
    writer = df.write.mode(o.pop("mode", mode)).options(**({"header": "true"} | o if kind == "csv" else o))
    if by:
        writer = writer.partitionBy(*by)
    getattr(writer, kind)(location(end))


def read_ipc(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files (or streams): listed and read as binary files, decoded by the workers, one file at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path)
    head = files.select("content").first()
    if head is None:
        raise MaskError("source_empty", path)

    def opened(content: bytes):
        try:
            return pa.ipc.open_file(content)
        except pa.ArrowInvalid:
            return pa.ipc.open_stream(content)

    schema = from_arrow_schema(opened(bytes(head["content"])).schema)

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                reader = opened(content)
                yield from (reader.get_batch(i) for i in range(reader.num_record_batches)) if hasattr(reader, "num_record_batches") else reader

    return files.select("content").mapInArrow(run, schema)


def register_views(spark: SparkSession, paths: dict[str, str]) -> None:
    for name, path in paths.items():
        spark.read.parquet(path).createOrReplaceTempView(name)


def load_value_lists(folder: str) -> list[str]:
    """Every <name>.txt (a value a line) and <name>.json (a list) of a folder becomes the provider custom.<name>."""
    out = []
    for f in sorted(Path(folder).iterdir()):
        if f.suffix == ".txt":
            values = [x.strip() for x in f.read_text(encoding="utf-8").splitlines() if x.strip()]
        elif f.suffix == ".json":
            values = json.loads(f.read_text(encoding="utf-8"))
        else:
            continue
        if not isinstance(values, list) or not values:
            raise MaskError("value_list_invalid", str(f))
        words.register_provider(f.stem, [str(v) for v in values])
        out.append(f"custom.{f.stem}")
    return out


def with_source_file(df: DataFrame, into: str = "source_file") -> DataFrame:
    return df.withColumn(into, F.input_file_name())
