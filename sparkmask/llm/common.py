"""Helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of (long, long) rows may be broadcast: at most 32 MB.
BROADCAST_ROWS = 1_000_000
#: Entries that a worker keeps in one of its word caches.
CACHE_ENTRIES = 300_000
#: Bytes of text that the pipeline's stages hold in memory at a time, with up to 50 bytes of what they make of each.
PORTION = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none (tests on one machine), one is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkmask-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def importable(spark: SparkSession) -> SparkSession:
    """spark, whose Python workers find this package where the driver has it; clusters use --py-files or an install."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default, made for short rows
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


class Scratch:
    """Tables written to the shared folder, to cut lineage so that a lost executor costs a re-read only."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, label: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{label}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None = None) -> None:
        """Deletes a written table that no later plan reads, or all of them and the shuffle files that no plan needs any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path if df is not None else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        if df is None:
            gc.collect()
            self.spark._jvm.System.gc()  # Spark removes the shuffle files of collected plans


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def in_few(df: DataFrame, rows: int, each: int = 20_000, least: int = 1) -> DataFrame:
    """df of `rows` small rows at most, in no more tasks than that takes: many tiny tasks cost more in shuffles than their rows do."""
    return df.coalesce(max(least, -(-rows // each)))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows that it has at most `rows` rows; else df, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def crc_of_id(col: Column) -> Column:
    """crc32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def give_back() -> None:
    """Returns a worker's free memory to the system: workers live on, and the next stage's would stand beside it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


#: What the operator at work keeps in this worker from task to task.
KEPT: list[dict] = []


def alone(own: dict | None = None) -> None:
    """Called by an operator's tasks: drops what other operators keep in this worker, which outlives their stages, beside its own."""
    for other in KEPT:
        if other is not own:
            other.clear()
    KEPT[:] = [] if own is None else [own]


def portions(batch: pa.RecordBatch, column: str = "text", size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of `size` bytes of a string column together, or of one row: what one pass holds in memory."""
    at = np.concatenate([[0], np.cumsum(byte_lengths(batch.column(column)))])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def byte_lengths(texts: pa.Array) -> np.ndarray:
    """Of each text, the bytes; a null has none."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


#: Bytes after a translation that lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Of a load of eight bytes, the first n.
FIRST = np.array([2 ** (8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes up to which a word is hashed in step with the others.
SHORT = 512


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of the texts of an Arrow string array, all at once: 64-bit hashes, and where each text's begin.

    `raw` are the texts' bytes, `off` where each text's begin, `starts` and `lens` the words' places there; the words of
    text i are those from at[i] to at[i + 1]. Words of up to eight bytes never collide with one of the same length.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.empty(0, np.uint8)
        self.off = off - off[0]
        n = len(raw)
        self.raw = raw
        black = np.zeros(n + 1, bool)
        black[:n] = ~BLANK[raw]
        cut = np.zeros(n + 1, bool)
        cut[self.off] = True
        first, last = black.copy(), black[:n].copy()
        first[1:] &= ~black[:-1] | cut[1:]
        last &= ~black[1:] | cut[1:]
        self.starts = np.flatnonzero(first)
        self.lens = np.flatnonzero(last) + 1 - self.starts
        self.at = np.searchsorted(self.starts, self.off)

    def hashed(self, translation: np.ndarray | None = None) -> np.ndarray:
        """Hashes of all words, whose bytes are translated first."""
        raw = np.zeros(len(self.raw) + 8, np.uint8)
        raw[: len(self.raw)] = self.raw if translation is None else translation[self.raw]
        load = np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))
        starts, lens = self.starts, self.lens
        h = mix((load[starts] & FIRST[np.minimum(lens, 8)]) ^ (lens.astype(np.uint64) * GOLDEN))
        at, k = np.flatnonzero((lens > 8) & (lens <= SHORT)), 8
        while len(at):
            h[at] = mix(h[at] * GOLDEN ^ (load[starts[at] + k] & FIRST[np.minimum(lens[at] - k, 8)]))
            k += 8
            at = at[lens[at] > k]
        for i in np.flatnonzero(lens > SHORT).tolist():
            h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + lens[i]].tobytes())
        return h

    def each(self, translation: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """The hashes of each text's words."""
        h = self.hashed(translation)
        for lo, hi in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True):
            yield h[lo:hi]


def lower_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a UTF-8 text after lower-casing A-Z: what bytes.lower and bytes.split do."""
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads low and high bits (the murmur finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Unrelated odd multipliers, one for each position of a window: related ones would let windows of repeated words collide.
MULTIPLIERS = mix(np.arange(1, 33, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the windows of `size` word hashes; none if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n] * MULTIPLIERS[0]
    for j in range(1, size):
        total += words[j : j + n] * MULTIPLIERS[j]
    return mix(total)


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the windows; of fewer words, the whole sequence as one; of none, empty."""
    if len(words) >= size:
        return np.unique(window_hashes(words, size))
    return mix(window_hashes(words, len(words)) + np.uint64(len(words))) if len(words) else words


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; SPARKMASK_TOKENIZERS names another folder that has such files."""
    folder = os.environ.get("SPARKMASK_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
