"""Vault of masked values, and unmasking: what a cipher can't invert is looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MaskError
from ..functions.fpe import fpe_column
from .strategies import Context, cipher


def entries(source: DataFrame, output: DataFrame, key: list[str], column: str, namespace: str) -> DataFrame:
    """(namespace, masked, source) of a column, of masked values that stand for one source value only."""
    pairs = source.select(*key, F.col(column).cast("string").alias("source")).join(output.select(*key, F.col(column).cast("string").alias("masked")), key)
    return unambiguous(pairs.where("source is not null and masked is not null").select(F.lit(namespace).alias("namespace"), "masked", "source"))


def unambiguous(pairs: DataFrame) -> DataFrame:
    per = pairs.groupBy("namespace", "masked").agg(F.min("source").alias("source"), F.max("source").alias("_last"))
    return per.where("source = _last").drop("_last")


def sealed(pairs: DataFrame, key: bytes) -> DataFrame:
    """The vault for storage: sources are encrypted (AES-GCM); namespace and masked value stay readable for the join."""
    if len(key) not in (16, 24, 32):
        raise MaskError("vault_key_length", str(len(key)))
    return pairs.select("namespace", "masked", F.aes_encrypt(F.col("source").cast("binary"), F.lit(key)).alias("sealed"))


def opened(vault: DataFrame, key: bytes) -> DataFrame:
    return vault.select("namespace", "masked", F.aes_decrypt("sealed", F.lit(key)).cast("string").alias("source"))


def write(pairs: DataFrame, path: str, key: bytes) -> None:
    sealed(pairs, key).write.mode("overwrite").partitionBy("namespace").parquet(path)


def load(spark, path: str, key: bytes) -> DataFrame:
    return opened(spark.read.parquet(path), key)


def unmask(df: DataFrame, columns: dict[str, Context], strategies: dict[str, str], vault: DataFrame | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns restored where possible, and a status for each: inverted, vault or irreversible."""
    status = {}
    for c, ctx in columns.items():
        s = strategies[c]
        if s == "passthrough":
            status[c] = "unchanged"
        elif s == "fpe":
            df = df.withColumn(c, fpe_column(F.col(c), cipher(ctx), -1))
            status[c] = "inverted"
        elif vault is not None and ctx.namespace is not None:
            own = vault.where(F.col("namespace") == ctx.namespace).select(F.col("masked").alias("_m"), F.col("source").alias("_s"))
            joined = df.join(own, F.col(c).cast("string") == F.col("_m"), "left")
            df = joined.select(*[F.coalesce(F.col("_s"), F.col(c).cast("string")).alias(c) if x == c else F.col(x) for x in df.columns])
            status[c] = "vault"
        else:
            status[c] = "irreversible"
    return df, status
