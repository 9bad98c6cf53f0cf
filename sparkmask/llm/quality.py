"""Quality rules: counts within a text, and lines that many documents of a host repeat.

Across documents, a line is normalised (lower case, runs of white space as one space, digits as 0) and
hashed. For each host (`source`) and line, distinct documents are counted by family: the least hash of the
eight-word windows that start in a document's own lines, which near copies mostly share. Own are lines that fewer
than `families` documents of the host have (exact copies are one document), unless they are an edit: if such a
frequent line fills most of the places between two given lines, what else stands there is an edit of it.
Documents without own lines, as near copies of one text, are one family. Boilerplate so never decides the
family, however much of a document it is. A line is above the limit
if it occurs in at least `families` families of the host, and these make up at least half of the distinct documents
that have it; lines that only one document and its many copies repeat are so not taken for boilerplate
(removing copies is another operator's work). Lines above the limit are removed, and a document is rejected
if fewer than `least_words` words remain, or less than `least_share` of its words. Text that hardly repeats across
documents is thus left alone.

Lines are counted by partial aggregations on (host, line, document) and (host, place, line), so a line that all
documents of a host have is no single task's work until it is summed. Frequent lines, places and families are
broadcast only where a count shows that they are few.

Defined cases: a null text has no words and fails the base rules; a null host is a host of its own;
repeated rows count once across documents and are all returned; an empty table gives no rows; other
columns pass through the filter and are ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import BLANK, GOLDEN, LOWER, PORTION, Scratch, Words, alone, bounded, give_back, mix, portions, signed, table, window_hashes

WINDOW = 8
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: Bytes that begin a character other than a blank.
BEGINS = ~BLANK & ((np.arange(256) < 0x80) | (np.arange(256) >= 0xC0))
#: A line's words are normalised: lower case, digits as 0.
NORMAL = LOWER.copy()
NORMAL[48:58] = 48

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a window of eight that occurs twice or more in the text."""
    w = window_hashes(hashes, WINDOW)
    if len(w) < 2 or (np.diff(np.sort(w)) != 0).all():
        return 0
    _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def in_order(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash for each run of hashes from one of `starts` to the next, which depends on their order."""
    if not len(starts):
        return np.empty(0, np.uint64)
    place = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    return mix(np.add.reduceat(mix(h + (place + 1).astype(np.uint64) * GOLDEN), starts))


class Measured:
    """Of the texts of an Arrow array: base counts, a hash of each text's words, and its distinct normalised lines.

    A line has its hash, words (of all its occurrences), place (a hash of the lines before and after it) and least window
    (the least hash of the windows of eight words that start in it; without one, the line's own hash).
    """

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        raw, at, off = words.raw, words.at, words.off
        count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])
        self.n_words, self.word_chars, self.n_symbols = np.diff(at), count(BEGINS[raw]), count(SYMBOL[raw])
        self.n_dup_lines = [repeated_lines(raw[lo:hi].tobytes()) for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        own, normal = words.hashed(), words.hashed(NORMAL)
        row = np.searchsorted(np.flatnonzero(raw == 10), words.starts)  # newlines before each word
        new = np.ones(len(own), bool)
        new[1:] = row[1:] != row[:-1]
        new[at[:-1][at[:-1] < len(own)]] = True
        starts = np.flatnonzero(new)
        keys = in_order(normal, starts)
        sizes = np.diff(np.append(starts, len(own)))
        first = np.searchsorted(starts, at)  # of each text, its first line
        self.n_repeat_words, self.copy, self.lines = [], [], []
        for i in range(len(texts)):
            lo, hi = at[i], at[i + 1]
            hashes = own[lo:hi]
            self.n_repeat_words.append(repeated_words(hashes))
            self.copy.append(int(in_order(hashes, np.zeros(1, np.int64))[0]) if hi > lo else 0)
            self.lines.append(self.of(keys[first[i] : first[i + 1]], sizes[first[i] : first[i + 1]], starts[first[i] : first[i + 1]] - lo, hashes))

    @staticmethod
    def of(keys: np.ndarray, sizes: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, words, place, least window) of the distinct lines of a text, by the first occurrence of each."""
        if not len(keys):
            return keys, sizes, keys, keys
        w = window_hashes(hashes, WINDOW)
        inside = int(np.searchsorted(starts, len(w)))  # lines in which a window starts
        least = keys.copy()
        if inside:
            least[:inside] = np.minimum.reduceat(w, starts[:inside])
        around = np.concatenate([np.zeros(1, np.uint64), keys, np.zeros(1, np.uint64)])
        place = mix(around[:-2] * GOLDEN + mix(around[2:]))
        distinct, at, which = np.unique(keys, return_index=True, return_inverse=True)
        return distinct, np.bincount(which, sizes).astype(np.int64), place[at], least[at]


def to_signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def content_key(doc_id, host, text: bytes | None) -> int:
    """64 bits that tell rows of different id, host or text apart; repeated rows have one key."""
    return to_signed(xxhash.xxh3_64_intdigest(repr((doc_id, host, text is None)).encode() + (text or b"")))


def with_key(docs: DataFrame, into: str) -> DataFrame:
    """All columns of docs and the content key of doc_id, source and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([content_key(*r) for r in rows], pa.int64())], [*batch.schema.names, into])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, LongType())]))


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document: its base counts, a key of its content, and its lines as arrays."""
    alone()
    for batch in (p for b in batches for p in portions(b, size=PORTION)):
        ids, hosts, texts = (batch.column(c) for c in ("doc_id", "source", "text"))
        m = Measured(texts)
        key = [content_key(*r) for r in zip(ids.to_pylist(), hosts.to_pylist(), texts.cast(pa.large_binary()).to_pylist(), strict=True)]
        base = [pa.array(x, pa.int64()) for x in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)]
        lines = [lists([signed(x) if x.dtype == np.uint64 else x for x in column]) for column in zip(*m.lines, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [ids, hosts, *base, pa.array(list(map(to_signed, m.copy)), pa.int64()), pa.array(key, pa.int64()), *lines],
            ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "copy", "key", "lines", "words", "place", "least"],
        )
    give_back()


def lists(parts: list[np.ndarray]) -> pa.Array:
    """An array of lists of longs."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts).astype(np.int64)))


def both(a: str, b: str, *columns: str) -> Column:
    """Equality of columns of the aliases a and b, where nulls are equal."""
    each = [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]
    return reduce(and_, each)


def common_lines(made: DataFrame, scratch: Scratch, families: int) -> DataFrame:
    """(host, line) of the lines above the limit."""
    line = made.select("host", "copy", F.explode(F.arrays_zip("lines", "place", "least")).alias("l")).select("host", "copy", F.col("l.lines").alias("line"), F.col("l.place").alias("place"), F.col("l.least").alias("least"))
    once = scratch.write(line.groupBy("host", "line", "copy").agg(F.min("place").alias("place"), F.min("least").alias("least")), "lines")
    often = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= families).select("host", "line")
    often = bounded(scratch.write(often.withColumn("often", F.lit(True)), "often"))
    rows = once.alias("l").join(often.alias("o"), both("l", "o", "host", "line"), "left").select("l.*", F.coalesce("o.often", F.lit(False)).alias("often"))
    at = rows.groupBy("host", "place", "line").agg(F.count(F.lit(1)).alias("n"), F.max("often").alias("often"))
    fixed = at.groupBy("host", "place").agg(F.sum("n").alias("n"), F.max(F.when(F.col("often"), F.col("n"))).alias("most")).where(2 * F.col("most") >= F.col("n")).select("host", "place")
    fixed = bounded(scratch.write(fixed, "fixed"))
    own = rows.where("not often").alias("l").join(fixed.alias("f"), both("l", "f", "host", "place"), "left_anti")
    family = bounded(scratch.write(own.groupBy("host", "copy").agg(F.min("least").alias("family")), "families"))
    by_family = rows.where("often").alias("l").join(family.alias("f"), both("l", "f", "host", "copy"), "left").groupBy("l.host", "l.line", "f.family").agg(F.count(F.lit(1)).alias("n"))
    return by_family.groupBy("host", "line").agg(F.count(F.lit(1)).alias("f"), F.sum("n").alias("n")).where((F.col("f") >= families) & (2 * F.col("f") >= F.col("n"))).select("host", "line")


def judged(docs: DataFrame, families: int = 20, least_words: int = 10, least_share: float = 0.3) -> DataFrame:
    """A row per document: doc_id, key, the base counts, base_failed, n_kept_words and kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    made = scratch.write(rows.mapInArrow(measured, f"doc_id long, host string, {BASE}, copy long, key long, lines array<long>, words array<long>, place array<long>, least array<long>"), "measured")
    line = made.select("host", "key", F.explode(F.arrays_zip("lines", "words")).alias("l")).select("host", "key", F.col("l.lines").alias("line"), F.col("l.words").alias("words"))
    common = common_lines(made, scratch, families)
    common = bounded(scratch.write(common, "common"))
    hit = line.alias("l").join(common.alias("c"), F.col("l.host").eqNullSafe(F.col("c.host")) & (F.col("l.line") == F.col("c.line"))).select("l.key", "l.line", "l.words")
    lost = hit.distinct().groupBy("key").agg(F.sum("words").alias("lost"))
    out = made.drop("lines", "words", "place", "least", "host", "copy").join(lost, "key", "left").withColumn("n_kept_words", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    depleted = (F.col("lost").isNotNull()) & ((F.col("n_kept_words") < least_words) | (F.col("n_kept_words") < least_share * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")
