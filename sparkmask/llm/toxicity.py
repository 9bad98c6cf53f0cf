"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around the hits.

The lexicon is learnt: terms that labelled toxic documents use significantly more often than other labelled
ones, by the log odds of document frequencies. A word of a text hits a term if it equals it, or if it lies
within one edit (two for terms of ten letters and more). Every term of five letters or more has misspellings.
They are found by walking the trie of all terms with the states of the Levenshtein automata of all words of many
texts at once, forward and backward. Words within reach of a term that labelled clean documents use are known to be innocent and don't hit.

Each hit's context decides how it counts: hits between quotation marks, or with a word of report close by in
front, are quoted, others are used. A logistic model on the logarithms of the summed weights of used, quoted
and misspelled hits, their number of different terms and their density gives the score.

Only labels of training rows are learnt from (callers say which), and only a bounded sample of these: the
`sample` rows of least hash, of which seven tenths give the lexicon and the rest the model. Scores use the
text alone.

Defined cases: null text is empty and has the score of a text without hits; without labels of both kinds
all scores are 0; repeated labels of one document count as their largest; repeated rows are each scored;
a null doc_id is scored too; extra columns pass through or are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, alone, crc_of_id, give_back, portions, table

TOKEN = re.compile(r"[\w@$]+")
QUOTES = re.compile(r"[\"“”„«»‘’]")
REPORT = re.compile(r"\b(?:said|says|wrote|quote[ds]?|called|calling|word|term|dit|écrit|sagte|schrieb|dijo|escribió)\b")
AROUND = 48
#: Words of each of the two generations that a worker remembers, about 150 bytes each; a portion with more is the younger alone.
KNOWN = 100_000
#: Words that one walk of the tries looks up: their states take up to 500 bytes each.
WALK = 40_000
#: Letters of text whose words stand in memory together, about 30 bytes for each.
LETTERS = 2_000_000
NO_HIT = (0.0, False)
FEATURES = 7


def stem(word: str) -> str | None:
    """The first letters of a long word, starred: endings vary."""
    return word[:5] + "*" if len(word) >= 7 else None


class Trie:
    """Terms of one reach, and the walk of many words' Levenshtein automata over them at once.

    A word's automaton has read d letters of a term; its state is the band of edit distances between these and the word's
    first d - k .. d + k letters. The states of all words that are still within reach of a node's prefix are one
    array, and a step to a child moves them together. Words leave a branch when no distance in their band is within
    reach, or when their length can't match a term below.

    Of k edits, a term's first half has k // 2 at most, or its second half has none. So two walks find all: one over the terms
    with k // 2 edits up to their middle, and one `backward`, over reversed terms and words, with none up to it.
    """

    def __init__(self, terms: list[str], reach: int, backward: bool = False):
        self.reach, self.backward = reach, backward
        self.early = 0 if backward else reach // 2
        self.root: dict = {}
        self.longest = max(map(len, terms), default=0)
        self.shortest = min(map(len, terms), default=0)
        for term in sorted(terms):
            node = self.root
            for c in term[::-1] if backward else term:
                node = node.setdefault(c, {})
            node[""] = term
        self.spans: dict[int, tuple[int, int]] = {}
        self.measure(self.root, 0)

    def measure(self, node: dict, depth: int) -> tuple[int, int]:
        """Least and most letters of the terms below a node."""
        below = [(depth, depth)] if "" in node else []
        below += [self.measure(child, depth + 1) for c, child in node.items() if c]
        found = (min(lo for lo, _ in below), max(hi for _, hi in below)) if below else (0, 0)
        self.spans[id(node)] = found
        return found

    def near(self, words: list[str]) -> Iterator[tuple[str, str]]:
        """(word, term) of all pairs within reach that this walk finds."""
        k = self.reach
        words = [w for w in words if self.shortest - k <= len(w) <= self.longest + k]
        if not words or not self.root:
            return
        lens = np.array([len(w) for w in words])
        letters = np.full((len(words), self.longest + 3 * k + 1), -1, np.int32)  # column k + i: letter i
        letters[:, k : k + self.longest + k] = np.array([w[::-1] for w in words] if self.backward else words, f"<U{self.longest + k}").view(np.int32).reshape(len(words), -1)
        letters[letters == 0] = -1
        far = k + 2
        start = np.full((len(words), 2 * k + 1), far, np.int8)
        start[:, k:] = np.arange(k + 1)
        stack = [(self.root, 0, np.arange(len(words)), start)]
        while stack:
            node, d, alive, state = stack.pop()
            if "" in node:
                at = lens[alive] - d + k
                inside = (at >= 0) & (at <= 2 * k)
                for i in alive[inside][state[inside, at[inside]] <= k].tolist():
                    yield words[i], node[""]
            for c, child in node.items():
                if not c:
                    continue
                lo, hi = self.spans[id(child)]
                middle = -(-lo // 2) if self.backward else lo // 2
                most = self.early if d < middle else k
                fits = (lens[alive] >= lo - k) & (lens[alive] <= hi + k)
                if most == 0:  # no edit so far
                    fits &= letters[alive, k + d] == ord(c)
                rows, old = alive[fits], state[fits]
                if not len(rows):
                    continue
                new = old + (letters[rows, d : d + 2 * k + 1] != ord(c))
                new[:, :-1] = np.minimum(new[:, :-1], old[:, 1:] + 1)
                for t in range(1, 2 * k + 1):
                    new[:, t] = np.minimum(new[:, t], new[:, t - 1] + 1)
                np.minimum(new, far, out=new)
                within = new.min(axis=1) <= most
                if within.any():
                    stack.append((child, d + 1, rows[within], new[within].astype(np.int8)))


class Lexicon:
    """Weighted terms, with lookup of words within an edit distance: all terms of `shortest` letters and more have misspellings."""

    def __init__(self, weights: dict[str, float], innocent: frozenset[str] = frozenset(), shortest: int = 5):
        self.weights, self.innocent, self.shortest = weights, innocent, shortest
        plain = [t for t in weights if len(t) >= shortest and t[-1] != "*"]
        self.tries = [Trie([t for t in plain if self.reach(len(t)) == k], k, backward) for k in (1, 2) for backward in (False, True)]
        self.known: dict[str, tuple[float, bool]] = {}
        self.earlier: dict[str, tuple[float, bool]] = {}

    def __reduce__(self):
        return lexicon_of, (self.weights, self.innocent, self.shortest)

    @staticmethod
    def reach(length: int) -> int:
        return 2 if length >= 10 else 1

    def near(self, words: list[str]) -> dict[str, str]:
        """The term that each misspelt word stands for: the heaviest within reach, of equal ones the first by the alphabet."""
        found: dict[str, str] = {}
        weights = self.weights
        words = [w for w in words if w not in self.innocent]
        for lo in range(0, len(words), WALK):
            for trie in self.tries:
                for word, term in trie.near(words[lo : lo + WALK]):
                    best = found.get(word)
                    if best is None or (-weights[term], term) < (-weights[best], best):
                        found[word] = term
        return found

    def fuzzy(self, word: str) -> str | None:
        return self.near([word]).get(word)

    def learn(self, words: set[str]) -> None:
        """Looks words up, many in one walk. Words of the generation before are known still, and those met again stay known."""
        if len(self.known) + len(words) > KNOWN:
            self.known, self.earlier = {}, self.known if len(self.known) <= KNOWN else {}
        rest = []
        for word in words:
            if word in self.known:
                continue
            if word in self.earlier:
                self.known[word] = self.earlier[word]
            elif (w := max((self.weights[x] for x in (word, stem(word)) if x in self.weights), default=0.0)) > 0:
                self.known[word] = (w, True)
            else:
                self.known[word] = NO_HIT
                rest.append(word)
        for word, term in self.near(sorted(rest)).items():
            self.known[word] = (self.weights[term] / 2, False)

    def hit(self, word: str) -> tuple[float, bool]:
        """(weight, whether spelled as a term); weight 0 if it hits nothing."""
        if word not in self.known:
            self.learn({word})
        return self.known[word]

    def all_features(self, texts: list[str | None], letters: int = LETTERS) -> list[list[float]]:
        """The features of texts, whose words are looked up for about so many letters of text at a time."""
        out: list[list[float]] = []
        lo = 0
        while lo < len(texts):
            part, size = [], 0
            while lo < len(texts) and (not part or size < letters):
                low = (texts[lo] or "").lower()
                words = TOKEN.findall(low)
                part.append((low, len(words), set(words)))
                size += len(low)
                lo += 1
            every = set().union(*(x for _, _, x in part))
            self.learn(every)
            hitting = {w for w in every if self.known[w][0]}
            out += [self.features(low, n_words, distinct & hitting) for low, n_words, distinct in part]
        return out

    def features(self, low: str, n_words: int, hits: set[str]) -> list[float]:
        """The features of a lower-cased text whose distinct words that hit are given."""
        if not hits:
            return [1.0, *[0.0] * (FEATURES - 1)]
        used = quoted = wrong = 0.0
        n = 0
        for m in re.finditer(rf"(?<![\w@$])(?:{'|'.join(map(re.escape, sorted(hits)))})(?![\w@$])", low):
            n += 1
            weight, exact = self.known[m.group()]
            before, after = low[max(0, m.start() - AROUND) : m.start()], low[m.end() : m.end() + AROUND]
            line = before.rpartition("\n")[2]
            if (len(QUOTES.findall(line)) % 2 and QUOTES.search(after)) or REPORT.search(line[-24:]):
                quoted += weight
            elif exact:
                used += weight
            else:
                wrong += weight
        return [1.0, np.log1p(used), np.log1p(quoted), np.log1p(wrong), np.log1p(sum(self.known[w][0] for w in hits)), float(np.log1p(len(hits))), min(1.0, 20 * n / max(1, n_words))]


#: The lexicon of this process: the tasks of a worker share it, and the words that it knows.
LEXICONS: dict[tuple, Lexicon] = {}


def lexicon_of(weights: dict[str, float], innocent: frozenset[str], shortest: int) -> Lexicon:
    alone(LEXICONS)
    key = (tuple(weights.items()), innocent, shortest)
    if key not in LEXICONS:
        LEXICONS.clear()
        LEXICONS[key] = Lexicon(weights, innocent, shortest)
    return LEXICONS[key]


class Model:
    def __init__(self, lexicon: Lexicon | None, weights: list[float]):
        self.lexicon, self.weights = lexicon, np.array(weights)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.lexicon is None:
            return np.zeros(len(texts))
        x = np.array(self.lexicon.all_features(texts)).reshape(len(texts), FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method; `ridge` keeps separable cases finite."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def count_words(pick, lexicon: Lexicon | None = None):
    """(toxic, text) -> (word, pos, neg): in how many documents of each kind, for the words of it that pick(words) keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in (p for b in batches for p in portions(b, size=LETTERS)):
            sets = [set(TOKEN.findall((text or "").lower())) for text in batch.column("text").to_pylist()]
            if lexicon is not None:
                lexicon.learn(set().union(*sets))
            for toxic, words in zip(batch.column("toxic").to_pylist(), sets, strict=True):
                counts[toxic].update(pick(words | {x for w in words if (x := stem(w))}))
        words = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], ["word", "pos", "neg"])
        give_back()

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = 20_000, terms: int = 20_000, least: int = 3, g2: float = 12.0) -> Model:
    """A model from labels (doc_id, toxic) of the docs (doc_id, text) for which `train`, a column of labels, holds."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = labels.where(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = rows.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h").limit(sample)  # at most `sample` rows of three numbers
    rows = scratch.write(rows, "labels")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = scratch.write(text.join(F.broadcast(rows), "doc_id").withColumn("part", F.pmod("_h", F.lit(10))).select("toxic", "part", "text"), "sample")
    for_terms, for_model = seen.where("part < 7"), seen.where("part >= 7")
    n = {r["toxic"]: r["n"] for r in for_terms.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Model(None, [])

    def counted(rows: DataFrame, pick, least: int = 1, learn: Lexicon | None = None) -> list:
        return rows.select("toxic", "text").mapInArrow(count_words(pick, learn), "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= least).collect()

    def odds(pos: int, neg: int) -> tuple[float, float]:
        """Log odds of the document frequencies, and twice the log likelihood ratio of their difference."""
        w = float(np.log((pos + 0.5) / (n[1] + 1)) - np.log((neg + 0.5) / (n[0] + 1)))
        rate = (pos + neg) / (n[0] + n[1])
        parts = [(pos, n[1] * rate), (neg, n[0] * rate), (n[1] - pos, n[1] * (1 - rate)), (n[0] - neg, n[0] * (1 - rate))]
        return w, 2 * sum(o * float(np.log(o / e)) for o, e in parts if o > 0 and e > 0)

    candidates = {r["word"]: r["pos"] for r in counted(for_terms.where("toxic = 1"), lambda words: words, least)}  # words of the sample's toxic rows
    negative = {r["word"]: r["neg"] for r in counted(for_terms.where("toxic = 0"), candidates.keys().__and__)}
    rated = {w: odds(p, negative.get(w, 0)) for w, p in candidates.items()}
    chosen = sorted(((s, w) for w, (o, s) in rated.items() if s >= g2 and o >= 1.5), reverse=True)[:terms]
    if not chosen:
        return Model(None, [])
    weights = {w: rated[w][0] for _, w in chosen}
    bare = Lexicon(weights)
    close = counted(for_terms, lambda words: {w for w in words if w[-1] != "*" and bare.hit(w)[0] > 0 and not bare.hit(w)[1]}, learn=bare)
    innocent = frozenset(r["word"] for r in close if r["neg"] and odds(r["pos"], r["neg"])[0] < 1.5)
    lexicon = Lexicon(weights, innocent)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(lexicon.all_features(batch.column("text").to_pylist()), pa.list_(pa.float64()))], ["toxic", "x"])
        give_back()

    got = for_model.select("toxic", "text").mapInArrow(featured, "toxic int, x array<double>").groupBy("toxic", "x").agg(F.count(F.lit(1)).alias("n")).collect()  # of the bounded sample
    if len({r["toxic"] for r in got}) < 2:
        got = for_terms.select("toxic", "text").mapInArrow(featured, "toxic int, x array<double>").groupBy("toxic", "x").agg(F.count(F.lit(1)).alias("n")).collect()
    x = np.repeat(np.array([r["x"] for r in got]), [r["n"] for r in got], axis=0)
    y = np.repeat(np.array([r["toxic"] for r in got], float), [r["n"] for r in got])
    return Model(lexicon, logistic(x, y).tolist())


def with_scores(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """All columns of docs and the score of `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(batch.column("text").to_pylist()), pa.float64())], [*batch.schema.names, into])
        give_back()

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, DoubleType())]))


def training(col: str = "doc_id") -> Column:
    return F.pmod(crc_of_id(F.col(col)), F.lit(5)) != 0


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), training())
    out = with_scores(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).drop("text")
    return out.select("doc_id", (~training()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
