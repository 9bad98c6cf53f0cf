"""Brown class-based bigrams: exchange clustering of words, class transitions and word emissions.

P(word | previous) = P(class of word | class of previous) * P(word | its class). All words of the training documents are
counted. Clustering has two steps. The `top` most frequent words are clustered by exchange: one word at a
time moves to the class that raises the likelihood of their bigrams most, in sweeps until few move; that runs on the driver on
a matrix of (top + 1)^2 counts. Then every other word of the `head` most frequent takes the class that its neighbours
make most likely: the classes before and after each of its occurrences are counted over the whole corpus in Spark,
and words are assigned on the executors. The number of classes follows the vocabulary: four times its fourth root.
Rarer words and words never seen share the class that has the most words.

Emissions use every word's own count, also of rare words: (c + 0.1) / (N_class + 0.1 * (V_class + 1)), where the last one is
the share of words never seen. Transitions are smoothed towards the classes' frequencies. Both
sum to one, so a text's score is a proper log10 probability.

The `head` words are broadcast as three arrays (17 bytes a word); a text's other words, each of them rare, are joined with the
table of counts. So what is broadcast is bounded whatever the vocabulary, and what is shuffled is a small part of the tokens.

Defined cases: a null or blank text is the end token alone; without training rows N = V = 0 and the base
score is 0 by its formula; repeated rows are counted and scored as often as they occur; a null doc_id has
the empty text as its id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, Words, crc_of_id, portions, signed, table

END = np.uint64(0x0E2D0E2D0E2D0E2D)
ADD = 0.1
#: Bytes of text that a task counts at a time.
PORTION = 12_000_000
#: A neighbour whose class isn't known yet.
OPEN = 255


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts of a batch, one after the other: word hashes with END after each text; tokens a text."""
    words = Words(batch.column("text"))
    sizes = np.diff(words.at) + 1
    out = np.full(int(sizes.sum()), END, np.uint64)
    mine = np.ones(len(out), bool)
    mine[np.cumsum(sizes) - 1] = False
    out[mine] = words.hashed(LOWER)
    return out, sizes


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> (word, n)."""
    for batch in (p for b in batches for p in portions(b, size=PORTION)):
        words, n = np.unique(tokens(batch)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(n)], ["word", "n"])


def found(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index of each hash in sorted words, or -1."""
    if not len(words):
        return np.full(len(hashes), -1)
    i = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[i] == hashes, i, -1)


def bigrams(top: np.ndarray):
    """text -> (pair, n) of neighbouring words of `top` (sorted hashes) and END, whose number is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b, size=PORTION)):
            h, _ = tokens(batch)
            u = np.where(h == END, len(top), found(top, h))
            before = np.concatenate([[len(top)], u[:-1]])
            both = (u >= 0) & (before >= 0)
            pair, n = np.unique(before[both] * (len(top) + 1) + u[both], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    return run


def arrays(df: DataFrame) -> list[np.ndarray]:
    """The columns of a bounded frame of numbers, by Arrow."""
    t = df.toArrow()
    return [c.combine_chunks().to_numpy(zero_copy_only=False) if t.num_rows else np.empty(0, np.int64) for c in t.columns]


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """Class of each unit (the last unit, END, alone in the last class) by exchange clustering on unit bigram counts."""
    n = len(counts)
    weight = counts.sum(axis=0) + counts.sum(axis=1)
    order = np.argsort(-weight, kind="stable")
    order = order[order != n - 1]
    cls = np.full(n, classes, np.int64)
    cls[order] = np.minimum(np.arange(len(order)), classes - 1) if len(order) <= classes else np.arange(len(order)) % classes
    k = classes + 1
    own = np.eye(k)[cls]
    left, right = counts @ own, counts.T @ own  # left[u, c]: u before class c; right[u, c]: class c before u
    pairs = own.T @ left
    for _ in range(sweeps):
        moved = 0
        for u in order.tolist():
            if not weight[u]:
                continue
            a, self_n = cls[u], counts[u, u]
            out, into = left[u].copy(), right[u].copy()
            # without u: its counts towards its own class include itself
            out[a] -= self_n
            into[a] -= self_n
            pairs[a] -= out
            pairs[:, a] -= into
            pairs[a, a] -= self_n
            rows, cols = pairs.sum(axis=1), pairs.sum(axis=0)
            more = pairs + out[None, :]
            gain = (xlogx(more) - xlogx(pairs)).sum(axis=1) + (xlogx(pairs + into[:, None]) - xlogx(pairs)).sum(axis=0)
            d = np.arange(k)
            both = pairs[d, d] + out + into + self_n
            gain += xlogx(both) - xlogx(pairs[d, d] + out) - xlogx(pairs[d, d] + into) + xlogx(pairs[d, d])
            gain -= xlogx(rows + out.sum() + self_n) - xlogx(rows) + xlogx(cols + into.sum() + self_n) - xlogx(cols)
            gain[classes] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            pairs[b] += out
            pairs[:, b] += into
            pairs[b, b] += self_n
            if b != a:
                moved += 1
                cls[u] = b
                left[:, a] -= counts[:, u]
                left[:, b] += counts[:, u]
                right[:, a] -= counts[u]
                right[:, b] += counts[u]
        if moved < len(order) // 200 + 1:
            break
    return cls


class Head:
    """The most frequent words: sorted hashes, counts and classes; of all others the class is `rest`."""

    def __init__(self, words: np.ndarray, n: np.ndarray, cls: np.ndarray, end: int, rest: int = OPEN):
        self.words, self.n, self.cls, self.end, self.rest = words, n, cls.astype(np.uint8), end, rest

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index or -1, class) of each hash."""
        i = found(self.words, h)
        return i, np.where(h == END, self.end, np.where(i >= 0, self.cls[i] if len(self.cls) else self.rest, self.rest))


def neighbours(shared):
    """text -> (k, n): head words without a class with the classes around them, k = (index * 256 + before) * 256 + after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        for batch in (p for b in batches for p in portions(b, size=PORTION)):
            h, _ = tokens(batch)
            i, c = head.of(h)
            before, after = np.concatenate([[head.end], c[:-1]]), np.append(c[1:], head.end)
            at = np.flatnonzero((i >= 0) & (c == OPEN) & (h != END) & ((before != OPEN) | (after != OPEN)))
            k, n = np.unique((i[at] * 256 + before[at]) * 256 + after[at], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], ["k", "n"])

    return run


def likeliest(step: np.ndarray, size: np.ndarray):
    """(i, around, n) -> (i, class): of each word, given how often which classes stand around it, the class of the greatest likelihood.

    With classes a before and b after it, an occurrence in class c has the logarithm step[a, c] + step[c, b] - ln size[c]. Of
    equal ones, the first class.
    """
    k = len(size)
    before = np.vstack([step[:, :k], np.zeros((1, k))]).astype(np.float32)
    after = np.vstack([step[:k].T, np.zeros((1, k))]).astype(np.float32)
    rare = np.log(np.maximum(size, 1)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                lengths = [len(x) for x in part.column("around").to_pylist()]
                around = np.concatenate([np.asarray(x) for x in part.column("around").to_pylist()]).astype(np.int64)
                n = np.concatenate([np.asarray(x) for x in part.column("n").to_pylist()]).astype(np.float32)
                gain = np.zeros((len(lengths), k), np.float32)
                word = np.repeat(np.arange(len(lengths)), lengths)
                for at in range(0, len(around), 100_000):
                    x = slice(at, at + 100_000)
                    a, b = around[x] // 256, around[x] % 256
                    value = before[np.minimum(a, len(before) - 1)] + after[np.minimum(b, len(after) - 1)] - rare
                    value *= n[x, None]
                    first = np.flatnonzero(np.diff(word[x], prepend=-1))
                    gain[word[x][first]] += np.add.reduceat(value, first)
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(gain.argmax(axis=1).astype(np.int32))], ["i", "class"])

    return run


def transitions(shared, k: int):
    """text -> (pair, n) of neighbouring classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in (p for b in batches for p in portions(b, size=PORTION)):
            c = shared.value.of(tokens(batch)[0])[1]
            total += np.bincount(np.concatenate([[k - 1], c[:-1]]) * k + c, minlength=k * k)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["pair", "n"])

    return run


def log_steps(pairs: np.ndarray, n_class: np.ndarray) -> np.ndarray:
    """Logarithms (base 10) of the class transitions, smoothed towards the classes' frequencies."""
    k = len(pairs)
    share = (n_class + 1) / (n_class.sum() + k)
    return np.log10((pairs + k * share[None, :]) / (pairs.sum(axis=1, keepdims=True) + k))


class Model:
    """What a worker needs: log10 transitions and emission denominators. The last class is END's."""

    def __init__(self, pairs: np.ndarray, n_class: np.ndarray, v_class: np.ndarray, rest: int, n: int, v: int):
        self.n, self.v, self.rest = n, v, rest
        self.step = log_steps(pairs, n_class)
        unseen = (np.arange(len(pairs)) == rest) | (v_class == 0)
        self.below = np.log10(n_class + ADD * (v_class + unseen))

    def local(self, c: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each text, the log10 of all its transitions and emission denominators."""
        before = np.concatenate([[len(self.step) - 1], c[:-1]])
        return np.add.reduceat(self.step[before, c] - self.below[c], np.concatenate([[0], np.cumsum(sizes)[:-1]]))


def scored(model: Model, shared):
    """(doc_id, text) -> scores by the broadcast head, and the words that it lacks, with how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        for batch in (p for b in batches for p in portions(b)):
            h, sizes = tokens(batch)
            i, cls = head.of(h)
            local = model.local(cls, sizes)
            c = np.where(i >= 0, head.n[i] if len(head.n) else 0, 0)
            at = np.concatenate([[0], np.cumsum(sizes)])
            known = np.add.reduceat((c > 0).astype(np.int64), at[:-1])
            logs = np.add.reduceat(np.where(c > 0, np.log10(c + ADD), 0.0), at[:-1])
            rest = [np.unique(h[lo:hi][c[lo:hi] == 0], return_counts=True) for lo, hi in zip(at, at[1:], strict=False)]
            columns = [batch.column("doc_id"), pa.array(sizes), pa.array(local), pa.array(known), pa.array(logs), pa.array([signed(w) for w, _ in rest], pa.list_(pa.int64())), pa.array([k for _, k in rest], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "local", "head_known", "head_logs", "words", "times"])

    return run


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the words above a count that `most` words at most are above."""
    band = F.floor(8 * F.log2(F.col("n").cast("double")))  # a few hundred bands
    bands = sorted(((r["band"], r["v"]) for r in counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("v")).collect()), reverse=True)
    total, least = 0, None
    for b, v in bands:
        total += v
        if total > most:
            break
        least = b
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    words, n = arrays(counts.where(band >= least).select("word", "n"))  # `most` rows at most
    words = words.astype(np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], n[order].astype(np.int64)


def clustered(rows: DataFrame, top: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the top words and, last, of END; counts of the pairs of classes among them."""
    pair, n = arrays(rows.mapInArrow(bigrams(top), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))  # (top + 1)^2 rows at most
    matrix = np.zeros((len(top) + 1) ** 2)
    matrix[pair.astype(np.int64)] = n
    matrix = matrix.reshape(len(top) + 1, len(top) + 1)
    cls = exchange(matrix, classes)
    own = np.eye(classes + 1)[cls]
    return cls, own.T @ matrix @ own


def fit(docs: DataFrame, train: Column, scratch: Scratch, top: int, classes: int | None, head: int) -> tuple[Model, DataFrame, Head]:
    """The model of the rows of docs for which `train` holds, the counts of their words (word, n), and the head."""
    spark = docs.sparkSession
    rows = docs.where(train).select("text")
    counts = scratch.write(rows.mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    classes = classes or int(min(128, max(8, round(4 * total["v"] ** 0.25))))
    end = int(END.astype(np.int64))
    first, _ = arrays(counts.where(F.col("word") != end).orderBy(F.col("n").desc(), "word").limit(top).select("word", "n"))  # `top` rows
    first = np.sort(first.astype(np.int64).view(np.uint64))
    cls, pairs = clustered(rows, first, classes)
    words, n = frequent(counts, head)
    known = np.full(len(words), OPEN)
    at = found(first, words)
    known[at >= 0] = cls[:-1][at[at >= 0]]
    known[words == END] = classes
    if (known == OPEN).any():
        size = pairs.sum(axis=0)
        shared = spark.sparkContext.broadcast(Head(words, n, known, classes))
        k = rows.mapInArrow(neighbours(shared), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
        each = k.groupBy(F.shiftright("k", 16).alias("i")).agg(F.collect_list(F.struct((F.col("k").bitwiseAND(65535)).cast("int").alias("around"), "n")).alias("x"))  # 65,536 at most
        i, c = arrays(each.select("i", "x.around", "x.n").mapInArrow(likeliest(np.log(10) * log_steps(pairs, size), size[:classes]), "i long, class int"))  # `head` rows at most
        known[i.astype(np.int64)] = c
        shared.unpersist()
    held = np.bincount(known[known < classes], minlength=classes + 1) if len(known) else np.zeros(classes + 1, np.int64)
    rest = int(np.argmax(held[:classes]))
    known[known == OPEN] = rest  # among words of open class only
    n_class, v_class = np.bincount(known, n, classes + 1), np.bincount(known, minlength=classes + 1).astype(float)
    n_class[rest] += total["n"] - n.sum()
    v_class[rest] += total["v"] - len(words)
    if total["v"] and END not in words:  # END is rarer than the head's words
        own = int(counts.where(F.col("word") == end).first()["n"])
        n_class[rest], v_class[rest], n_class[classes], v_class[classes] = n_class[rest] - own, v_class[rest] - 1, own, 1
    most = Head(words, n, known, classes, rest)
    shared = spark.sparkContext.broadcast(most)
    pair, times = arrays(rows.mapInArrow(transitions(shared, classes + 1), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))  # classes^2 rows at most
    shared.unpersist()
    pairs = np.zeros((classes + 1) ** 2)
    pairs[pair.astype(np.int64)] = times
    return Model(pairs.reshape(classes + 1, classes + 1), n_class, v_class, rest, int(total["n"]), int(total["v"])), counts, most


def class_scores(docs: DataFrame, train: Column, top: int = 1500, classes: int | None = None, head: int = 400_000) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text, ...)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "classes")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model, counts, most = fit(docs, train, scratch, top, classes, head)
    shared = spark.sparkContext.broadcast(most)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.mapInArrow(scored(model, shared), f"doc_id {kind}, n_tokens long, local double, head_known long, head_logs double, words array<long>, times array<long>")
    rows = scratch.write(rows.withColumn("_row", F.monotonically_increasing_id()), "texts")
    each = rows.select("_row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("_row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    sums = each.join(counts, "word", "left").groupBy("_row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("logs"))
    out = rows.drop("words", "times").join(sums, "_row", "left").withColumn("logs", F.col("head_logs") + F.coalesce("logs", F.lit(0.0)))
    below = float(np.log10(model.n + ADD * (model.v + 1)))
    known = (F.col("head_known") + F.coalesce("known", F.lit(0))).cast("long")
    return out.select("doc_id", "n_tokens", known.alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * below).alias("base_score"), (F.col("logs") + F.col("local")).alias("score"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.pmod(crc_of_id(F.col("doc_id")), F.lit(10)) != 0
    out = class_scores(table(spark, sf_dir, "documents"), train)
    return out.select("doc_id", (~train).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
