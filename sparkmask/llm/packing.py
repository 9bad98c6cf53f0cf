"""Pattern packing of tokenised documents by non-negative least squares.

Documents longer than a sequence are cut into full pieces, the first of which may be shorter. The number
of pieces of each length is all that packing needs: the driver gets that histogram (as many rows as a
sequence has tokens, whatever the corpus), puts lengths into `bins` classes, enumerates the patterns of up
to `parts` classes that fill a sequence, fits how often each is used by non-negative least squares on the
class counts, rounds down, and takes concrete lengths for the patterns, the longest of a class first. What
remains, and room that patterns leave, is settled by best fit on the counts: longest piece first, into the
least room that holds it.

The result is a table of runs: so many sequences in a row with the same lengths at the same offsets. A
piece finds its place by its length and its rank among the pieces of that length. Ranks come from a
window over (length, cell) with cells of bounded size, so a length that a third of all pieces have is
spread over many tasks.

Defined cases: a null text is empty, which is the one token 0; repeated rows are packed as often as they
occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, alone, give_back, table, tokenizer_file

END = np.zeros(1, "<u4").tobytes()


#: Files that hold the same vocabulary as ranks, for a faster library with the same ids.
RANKS = {"byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}


#: A space beside a blank of any kind.
TOUCHING = re.compile(r" \s|\s ")
#: Words whose ids a task remembers: about 150 bytes each.
KNOWN = 200_000


class Ids(dict):
    """Token ids (little-endian bytes) of a word with the space before it, remembered up to a bound."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file(name))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if name in RANKS:
            import base64

            import tiktoken
            from public_tokenizers import PATTERN

            with open(tokenizer_file(RANKS[name]), "rb") as f:
                ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN:
            self.clear()
        value = self[word] = self.of(" " + word)
        return value

    def whole(self, text: str) -> bytes:
        """Ids of a text. The tokenizer splits before a space that stands between two other characters than blanks,
        so words are encoded one by one; where a space touches a blank of any kind, the text goes through whole."""
        if TOUCHING.search(text):
            return self.of(text)
        first, *rest = text.split(" ")
        return self.of(first) + b"".join(map(self.__getitem__, rest))


#: Tokenizers of this process, loaded once for all tasks of a worker.
IDS: dict[str, Ids] = {}


def tokenised(tokenizer: str, most: int):
    """(doc_id, text) -> a row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(IDS)
        ids = IDS[tokenizer] if tokenizer in IDS else IDS.setdefault(tokenizer, Ids(tokenizer))
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = memoryview((ids.whole(text) if text else b"") + END)
                n = len(raw) // 4
                at = 0
                for i in range(-(-n // most)):
                    end = at + ((n - 1) % most + 1 if i == 0 else most)
                    doc.append(doc_id)
                    piece.append(i)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(raw[4 * at : 4 * end]))
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        ids.clear()
        give_back()

    return run


def patterns(bins: int, parts: int) -> list[tuple[int, ...]]:
    """Descending tuples of two to `parts` classes whose sum is `bins`: sequences that are full if lengths are their class's most."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0 and len(head) > 1:
            out.append(head)
        elif left and len(head) < parts:
            for c in range(min(left, most), 0, -1):
                if c * (parts - len(head)) >= left:
                    grow((*head, c), left - c, c)

    grow((), bins, bins - 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 300) -> np.ndarray:
    """x >= 0 of least |a x - b|, by accelerated projected gradients (the patterns' matrix is small and well scaled)."""
    gram, target = a.T @ a, a.T @ b
    rate = 1 / max(np.linalg.norm(gram, 2), 1e-9)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * (gram @ y - target))
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / u * (new - x)
        x, t = new, u
    return x


class Left:
    """How many pieces of each length are still to be placed, with the longest of at most some length."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v}
        self.lengths = sorted(self.n)

    def longest(self, most: int) -> int | None:
        i = bisect.bisect_right(self.lengths, most)
        return self.lengths[i - 1] if i else None

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))


def plan(counts: dict[int, int], most: int, bins: int = 64, parts: int = 3, short: int | None = None) -> list[tuple[int, list[int]]]:
    """(sequences, lengths in them) that use every piece of the histogram once.

    Patterns are fitted to the pieces longer than `short` (a quarter of a sequence unless told otherwise); the short ones
    are held back to fill what patterns leave open. A pattern's parts are the longest pieces of its classes, but for its last
    part the longest piece that fits.
    """
    left = Left(counts)
    short = most // 4 if short is None else short
    runs: list[tuple[int, list[int]]] = []
    if most in left.n:
        runs.append((left.n[most], [most]))
        left.take(most, left.n[most])
    if not left.n:
        return runs
    smallest = left.lengths[0]
    width = -(-most // bins)
    full = most // width  # classes that fill a sequence even if all their lengths are the class's most
    open_by_room: dict[int, list[tuple[int, list[int]]]] = {}
    rooms: list[int] = []  # keys of it, sorted

    def close(n: int, lengths: list[int]) -> None:
        room = most - sum(lengths)
        if room < smallest:
            runs.append((n, lengths))
            return
        if room not in open_by_room:
            open_by_room[room] = []
            bisect.insort(rooms, room)
        open_by_room[room].append((n, lengths))

    want = np.zeros(full + 2)
    for n, k in left.n.items():
        if n > short:
            want[-(-n // width)] += k
    found = [p for p in patterns(full, parts) if all(want[c] for c in p)]
    if found:
        a = np.zeros((full + 2, len(found)))
        for j, p in enumerate(found):
            for c in p:
                a[c, j] += 1
        scale = want.max()
        times = nnls(a, want / scale) * scale
        for j in np.argsort(-times, kind="stable").tolist():
            p, again = found[j], int(times[j])
            while again > 0 and (lengths := concrete(p, left, most, width, short)):
                take = min(again, *(left.n[n] // k for n, k in Counter(lengths).items()))
                for n in lengths:
                    left.take(n, take)
                close(take, lengths)
                again -= take
    while left.lengths:
        n = left.lengths[-1]
        i = bisect.bisect_left(rooms, n)
        if i == len(rooms):  # no room: sequences of this length alone, to be filled
            k = max(1, min(most // n, left.n[n]))
            take = left.n[n] // k
            left.take(n, take * k)
            close(take, [n] * k)
            continue
        have, lengths = open_by_room[rooms[i]].pop()
        take = min(have, left.n[n])
        if take < have:
            open_by_room[rooms[i]].append((have - take, lengths))
        elif not open_by_room[rooms[i]]:
            del open_by_room[rooms.pop(i)]
        left.take(n, take)
        close(take, [*lengths, n])
    return runs + [x for xs in open_by_room.values() for x in xs]


def concrete(pattern: tuple[int, ...], left: Left, most: int, width: int, short: int) -> list[int] | None:
    """Lengths for a pattern: the longest pieces of its classes, and for the last part the longest long one that fits."""
    lengths: list[int] = []
    used: Counter = Counter()
    room = most
    for i, c in enumerate(pattern):
        top = room if i == len(pattern) - 1 else min(room, c * width)
        n = left.longest(top)
        while n is not None and left.n[n] <= used[n]:
            n = left.longest(n - 1)
        if n is None or n <= short or (i < len(pattern) - 1 and n <= (c - 1) * width):
            return None
        lengths.append(n)
        used[n] += 1
        room -= n
    return lengths


def places(runs: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its intervals, first sequence of each, offset of each."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    seq = 0
    for n, lengths in runs:
        at = 0
        for x in lengths:
            out[x].append((rank[x], seq, at))
            rank[x] += n
            at += x
        seq += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def placed(where: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            seq, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                first, base, off = where[n]
                i = np.searchsorted(first, rank[at], side="right") - 1
                seq[at] = base[i] + rank[at] - first[i]
                offset[at] = off[i]
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(seq), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, most: int = 2048, tokenizer: str = "byte_bpe_50k.json", cell_rows: int = 100_000) -> DataFrame:
    """The pieces of docs (doc_id, text, ...): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "pack")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.write(rows.mapInArrow(tokenised(tokenizer, most), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `most` rows at most
    where = places(plan(counts, most))
    cells = max(1, -(-max(counts.values(), default=1) // cell_rows))
    celled = pieces.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells)))
    ahead = celled.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_cell")) - F.col("_n")).drop("_n")
    ranked = celled.withColumn("_own", F.row_number().over(Window.partitionBy("length", "_cell").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(ahead, ["length", "_cell"]) if cells > 1 else ranked.withColumn("_before", F.lit(0))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_own")).cast("long").alias("_rank"))
    return ranked.mapInArrow(placed(where), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
