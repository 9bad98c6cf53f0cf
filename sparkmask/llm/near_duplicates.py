"""MinHash near-duplicates by a chosen-path set similarity join.

A document is the set of its distinct five-word shingles (64-bit hashes of lower-cased words). Sets that
are equal become one at once. The others carry 128 minwise tokens and are dealt down independent trees:
a node with few documents is compared exhaustively, a larger one branches by a minwise token that its level
of its tree selects, so similar documents tend to stay together and unlike ones part. A pair of
similarity s stays together for d levels of a tree with probability s^d, so a document whose paths end after
d1, d2, ... levels misses it in all trees with (1 - s^d1)(1 - s^d2)... These odds are kept for each document: 12 trees
miss a pair at exactly 0.75 once in 10^7 if they end at level 1, and in 20,000 at level 2; documents for
which the odds are above `miss`, as their nodes branch deeper, are dealt down more trees until they aren't. On
the last level, nodes don't branch but are compared like dense ones.

Comparison has two steps. In a leaf, minwise tokens estimate each pair (128 tokens; a pair at 0.75 falls
below 0.58 less than once in 10^5), which leaves small groups of candidates; equal groups from several
trees become one. Then the members' full sets are built again from their texts and compared exactly.
Within a group, documents that links already connect are not compared again, so a group of n copies
costs about n comparisons and gives n - 1 edges. Trees run in rounds: what one round has connected
is left out of the next, so a large group of copies is not met once per tree.

Nodes that stay large however they branch (many near copies of one text share most tokens) are dealt into blocks of at
most `leaf` documents, each with the same few pivots; blocks are compared like leaves. Then documents of
the node that aren't yet connected to its largest component are compared, block by block, with all of
the node. Every task therefore holds two blocks at most, and nothing is capped or sampled.

Defined cases: null, empty or blank texts have an empty set and link to nothing; fewer than five words are
one shingle, the whole sequence; repeated rows of one doc_id count once; a null doc_id is returned with
its set size, null component and kept true; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, MULTIPLIERS, PORTION, Scratch, Words, alone, bounded, give_back, in_few, lower_words, mix, portions, shingle_set, table
from .components import components

TOKENS = 128
SEEDS = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * MULTIPLIERS[0])
FLIPS = (SEEDS >> np.uint64(32)).astype(np.uint32)[:, None]
ODD = ((mix(SEEDS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]

#: Takes a token to its mark, one byte: what leaves compare, a quarter of the tokens' bytes.
GOLDEN_HALF = np.uint32(0x9E3779B1)


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The least of each of TOKENS hash functions over the upper halves of a set's hashes."""
    half = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(TOKENS, 2**32 - 1, np.uint32)
    for at in range(0, len(half), 2048):
        part = half[None, at : at + 2048] ^ FLIPS
        part *= ODD
        np.minimum(least, part.min(axis=1), out=least)
    return least


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone()
    for batch in (p for b in batches for p in portions(b, size=PORTION)):
        size, one, two, tokens, marks = [], [], [], [], []
        for words in Words(batch.column("text")).each(LOWER):
            s = shingle_set(words)
            size.append(len(s))
            one.append(int(signed_sum(s)))
            two.append(int(signed_sum(mix(s ^ SEEDS[0]))))
            least = minwise(s) if len(s) else None
            tokens.append(None if least is None else least.tobytes())
            marks.append(None if least is None else (least * GOLDEN_HALF >> np.uint32(24)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(tokens, pa.binary()), pa.array(marks, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "tokens", "marks"])
    give_back()


def signed_sum(x: np.ndarray) -> np.int64:
    return x.sum(dtype=np.uint64).astype(np.int64) if len(x) else np.int64(0)


class Links:
    """Union-find over 0 .. n-1 that starts from given group numbers."""

    def __init__(self, groups: np.ndarray):
        _, first, inverse = np.unique(groups, return_index=True, return_inverse=True)
        self.root = first[inverse]

    def join(self, a: int, b: int) -> bool:
        x, y = self.root[a], self.root[b]
        if x == y:
            return False
        self.root[self.root == max(x, y)] = min(x, y)
        return True


def by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows of one key, from batches that are sorted by it. A run is one leaf: two blocks at most."""
    kept: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        part = pa.Table.from_batches([batch])
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if kept and keys[lo] != last:
                yield pa.concat_tables(kept)
                kept = []
            kept.append(part.slice(lo, hi - lo))
            last = keys[lo]
    if kept:
        yield pa.concat_tables(kept)


#: Share of its parent's documents from which a large node counts as dense.
DENSE = 0.6
PAIRS = {m: np.triu_indices(m, 1) for m in range(2, 33)}


def candidates(least: float):
    """From leaves (node, doc, comp, marks): (sub, doc), the documents of each connected set of candidate pairs."""

    def groups(doc: np.ndarray, comp: np.ndarray, marks: np.ndarray, pairs) -> Iterator[np.ndarray]:
        a, b = pairs
        near = ((marks[a] == marks[b]).sum(axis=1) >= least * TOKENS) & (comp[a] != comp[b])
        if near.any():
            links = Links(np.arange(len(doc)))
            touched = np.zeros(len(doc), bool)
            for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                links.join(x, y)
                touched[x] = touched[y] = True
            for root in np.unique(links.root[touched]):
                yield np.sort(doc[(links.root == root) & touched])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, doc = [], []
        for leaf in by_group(batches, "node"):
            if leaf.num_rows < 2:
                continue
            d, c = (leaf.column(x).to_numpy() for x in ("doc", "comp"))
            t = np.frombuffer(b"".join(leaf.column("marks").to_pylist()), np.uint8).reshape(len(d), TOKENS)
            m = len(d)
            pairs = PAIRS[m] if m in PAIRS else np.triu_indices(m, 1)
            for members in groups(d, c, t, pairs):
                sub += [int(signed_sum(mix(members.astype(np.uint64) + SEEDS[1])))] * len(members)
                doc += members.tolist()
            if len(doc) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(sub, pa.int64()), pa.array(doc, pa.int64())], ["sub", "doc"])
                sub, doc = [], []
        yield pa.RecordBatch.from_arrays([pa.array(sub, pa.int64()), pa.array(doc, pa.int64())], ["sub", "doc"])
        give_back()

    return run


def set_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (p for b in batches for p in portions(b, size=PORTION)):
        sets = [shingle_set(words).tobytes() for words in Words(batch.column("text")).each(LOWER)]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("comp"), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["doc", "comp", "set"])
    give_back()


def links_of(doc: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that connect what is similar: 100 * intersection >= percent * union, on full sets.

    A document is compared with those after it that it isn't connected to yet. Edges lead from components
    (`comp`) to that of the first document which they are now connected to.
    """
    size = np.array([len(s) for s in sets])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    links = Links(comp)
    first = links.root.copy()
    flag = np.zeros(len(values), bool)
    for i in range(len(doc) - 1):
        other = i + 1 + np.flatnonzero(links.root[i + 1 :] != links.root[i])
        other = other[(100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i]))]
        if not len(other):
            continue
        mine = inverse[at[i] : at[i + 1]]
        flag[mine] = True
        for j in other.tolist():
            both = int(np.count_nonzero(flag[inverse[at[j] : at[j + 1]]]))
            if 100 * both >= percent * (size[i] + size[j] - both):
                links.join(i, j)
        flag[mine] = False
    moved = np.flatnonzero((links.root != first) & (first == np.arange(len(doc))))
    return [(int(comp[i]), int(comp[links.root[i]])) for i in moved]


def confirm(percent: int):
    """From groups (sub, doc, comp, set): links (a, b) of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, "sub"):
            sets = [np.frombuffer(s, np.uint64) for s in group.column("set").to_pylist()]
            found = links_of(group.column("doc").to_numpy(), group.column("comp").to_numpy(), sets, percent) if len(sets) > 1 else []
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        give_back()

    return run


class Join:
    """One run of the similarity join over representatives `reps` (doc, tokens) and `docs` (doc_id, text)."""

    def __init__(self, docs: DataFrame, reps: DataFrame, scratch: Scratch, percent: int, leaf: int, depth: int):
        self.docs, self.reps, self.scratch, self.percent, self.leaf, self.depth = docs, reps, scratch, percent, leaf, depth
        #: (doc, w) for each level that a document's path branched at: by how much that raises the logarithm of its odds to be missed.
        self.branched: list[DataFrame] = []
        #: Representatives, and rows that they take in the trees of a round.
        self.n = self.rows = reps.count()
        #: What a round writes, and drops in the end.
        self.step = scratch
        #: The documents that trees still take; None for all.
        self.open: DataFrame | None = None
        self.least = percent / 100 - 4.45 * (percent / 100 * (1 - percent / 100) / TOKENS) ** 0.5


    def paths(self, trees: range) -> DataFrame:
        """(doc, comp, t, k1 .. k<depth>): a document's node at each level of each tree, by the tokens that the level selects."""
        token = lambda i: F.expr(f"substring(tokens, {4 * i + 1}, 4)")
        chosen = {t: [(t + 41 * level) % TOKENS for level in range(self.depth)] for t in trees}
        each = [F.struct(F.lit(t).alias("t"), *[F.xxhash64(F.lit(t), *map(token, chosen[t][: level + 1])).alias(f"k{level + 1}") for level in range(self.depth)]) for t in trees]
        reps = self.reps if self.open is None else self.reps.join(bounded(self.open), "doc", "left_semi")
        self.rows = self.n * len(trees)
        return in_few(reps, self.n, least=12).select("doc", "comp", F.explode(F.array(*each)).alias("k")).select("doc", "comp", "k.*")

    def odds(self, level: int) -> float:
        """The logarithm of the odds that a tree whose path ends at a level misses a pair of least similarity."""
        return math.log(1 - (self.percent / 100) ** level)

    def short(self, trees: int, miss: float) -> tuple[DataFrame, int]:
        """The documents whose odds to be missed by all trees so far are above `miss`, and how many trees they lack if further ones are as deep."""
        rows = self.branched[0] if len(self.branched) == 1 else reduce(DataFrame.unionByName, self.branched)
        total = rows.groupBy("doc").agg(F.sum("w").alias("w"))
        total = self.scratch.write(total, "branched")
        self.branched = [total]
        open_ = total.withColumn("w", F.col("w") + trees * self.odds(1)).where(F.col("w") > math.log(miss))
        more = open_.agg(F.max(F.ceil(math.log(miss) * trees / F.col("w"))).alias("m")).first()["m"]
        return open_.select("doc"), (int(more) - trees if more else 0)

    @staticmethod
    def sizes(rows: DataFrame, node: str) -> DataFrame:
        """(node, n) of the nodes that hold documents which aren't all connected, and how many they hold."""
        n = rows.groupBy(F.col(node).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        return n.where("lo < hi").select("node", "n")

    def leaves(self, trees: range) -> tuple[DataFrame, DataFrame | None]:
        """(node, doc) of leaves with two documents at least, and of dense nodes.

        A node above `leaf` documents branches, unless most of its parent's documents came along: these are
        alike, and no number of further tokens would part them. Nodes whose documents links connect already are left out.
        Below the first level, two levels are counted at a time, for the documents of large nodes only.
        """
        at = self.paths(trees)
        counts = self.step.write(in_few(self.sizes(at, "k1"), self.rows), "nodes")
        small = in_few(at.join(counts.where(F.col("n") <= self.leaf).select("node"), F.col("k1") == F.col("node")).select("node", "doc"), self.rows)
        large = counts.where(F.col("n") > self.leaf).withColumnRenamed("node", "_node")
        if large.isEmpty():
            return small, None
        at = self.step.write(at.join(bounded(large), F.col("k1") == F.col("_node")).drop("_node"), "large")
        if self.depth == 1:
            return small, at.select(F.col("k1").alias("node"), "doc")
        ends: list[DataFrame] = []
        for level in range(2, self.depth + 1, 2):
            keys = [f"k{i}" for i in range(level, self.depth + 1)]
            deep = at.select("doc", "comp", "t", "n", *keys[2:], F.posexplode(F.array(*keys[:2])).alias("i", "node"))
            inner = self.sizes(deep, "node").withColumnRenamed("n", "m")
            path = deep.join(inner, "node", "left").groupBy("doc", "t").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), *[F.first(k).alias(k) for k in keys[2:]], F.sort_array(F.collect_list(F.struct("i", "node", "m"))).alias("p"))  # two of them
            last = f"x.m is null or x.m <= {self.leaf} or i + {level} = {self.depth} or x.m > {DENSE} * if(i = 0, n, p[i - 1].m)"
            path = path.withColumn("end", F.expr(f"get(filter(p, (x, i) -> {last}), 0)")).withColumn("n", F.element_at("p", -1)["m"]).drop("p")
            path = self.step.write(in_few(path, self.rows), "paths")
            ends.append(path.where("end is not null").select("doc", (F.col("end.i") + level).alias("level"), "end.node", "end.m"))
            at = path.where("end is null")
            if level + 2 > self.depth or at.isEmpty():
                break
        found = reduce(DataFrame.unionByName, ends)
        gain = F.element_at(F.array(*[F.lit(self.odds(level) - self.odds(1)) for level in range(2, self.depth + 1)]), F.col("level") - 1)
        self.branched.append(self.scratch.write(in_few(found.groupBy("doc").agg(F.sum(gain).alias("w")), self.rows), "branched"))
        small = small.unionByName(found.where(F.col("m") <= self.leaf).select("node", "doc"))
        dense = found.where(F.col("m") > self.leaf).select("node", "doc")
        return small, None if dense.isEmpty() else dense

    def blocks(self, dense: DataFrame) -> DataFrame:
        """(node, doc) of the dense nodes' blocks, each with the node's pivots: the documents of least hash by four hashes."""
        least = [F.min(F.struct(F.xxhash64("doc", F.lit(i)).alias("h"), "doc"))["doc"] for i in range(4)]
        n = dense.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.array(*least).alias("pivots"))
        n = n.withColumn("b", F.ceil(F.col("n") / (self.leaf - 4)).cast("int")).withColumn("pivots", F.array_distinct("pivots"))
        dealt = dense.join(F.broadcast(n.select("node", "b")) if n.limit(10_001).count() <= 10_000 else n.select("node", "b"), "node").select(F.expr("xxhash64(node, pmod(xxhash64(doc, 7), b))").alias("node"), "doc")
        pivots = n.select("node", "pivots", F.explode(F.expr("sequence(0, b - 1)")).alias("i")).select(F.expr("xxhash64(node, cast(i as bigint))").alias("node"), F.explode("pivots").alias("doc"))
        return dealt.unionByName(pivots).distinct()

    def compare(self, leaves: DataFrame) -> DataFrame:
        """Links (a, b) of components among the documents of each leaf (node, doc)."""
        rows = leaves.select("node", "doc").join(self.reps, "doc").select("node", "doc", "comp", "marks")
        rows = in_few(rows, self.rows, least=12).repartition("node").sortWithinPartitions("node", "doc")
        sub = in_few(in_few(rows.mapInArrow(candidates(self.least), "sub long, doc long"), self.rows, least=12).distinct(), self.rows)
        return self.exact(self.step.write(sub, "sub"))

    def exact(self, sub: DataFrame) -> DataFrame:
        """Links among the documents of each group (sub, doc), on full sets built again from the texts."""
        members = self.step.write(in_few(self.reps.select("doc", "comp").join(sub.select("doc").distinct(), "doc"), self.n), "members")
        text = self.docs.join(bounded(members), self.docs["doc_id"] == members["doc"]).select("doc", "comp", "text").dropDuplicates(["doc"])
        sets = text.mapInArrow(set_bytes, "doc long, comp long, set binary")
        rows = sub.join(sets, "doc").select("sub", "doc", "comp", "set")
        found = rows.repartition("sub").sortWithinPartitions("sub", "doc").mapInArrow(confirm(self.percent), "a long, b long")
        return in_few(found, self.rows, least=12)

    def rest(self, dense: DataFrame) -> DataFrame | None:
        """Groups (sub, doc): each block (of two leaves' size) of a dense node with each block of its documents outside its largest component."""
        rows = dense.select("node", "doc").join(self.reps.select("doc", "comp"), "doc")
        most = rows.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.max_by("comp", F.struct("n", F.col("comp"))).alias("most"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("r"))
        block = 2 * self.leaf
        most = most.where("r > 0").select("node", "most", F.ceil(F.col("n") / block).cast("int").alias("b"), F.ceil(F.col("r") / block).cast("int").alias("rb"))
        if most.isEmpty():
            return None
        rows = rows.join(bounded(most), "node")
        inner = rows.withColumn("i", F.expr("pmod(xxhash64(doc, 11), b)")).withColumn("j", F.explode(F.expr("sequence(0L, cast(rb - 1 as bigint))")))
        outside = rows.where("comp <> most").withColumn("j", F.expr("pmod(xxhash64(doc, 13), rb)")).withColumn("i", F.explode(F.expr("sequence(0L, cast(b - 1 as bigint))")))
        return inner.unionByName(outside).select(F.xxhash64("node", "i", "j").alias("sub"), "doc").distinct()

    def settle(self, links: DataFrame) -> None:
        """Documents of components that links connect are of one component from now on."""
        root = components(links, self.step)
        known = self.reps.join(bounded(root), F.col("comp") == F.col("node"), "left")
        before, self.reps = self.reps, self.scratch.write(in_few(known, self.n, least=12).select("doc", "tokens", "marks", F.coalesce("root", "comp").alias("comp")), "reps")
        if hasattr(before, "_scratch_path"):
            self.scratch.drop(before)

    def run(self, trees: int, first: int, miss: float) -> DataFrame:
        """(doc, comp) of all representatives: the least document that links reach."""
        parts = [range(first), range(first, trees)]
        while parts:
            part = parts.pop(0)
            self.step = Scratch(self.scratch.spark, "round")
            leaves, dense = self.leaves(part)
            if dense is not None:
                leaves = leaves.unionByName(self.blocks(dense))
            new = self.step.write(self.compare(leaves), "links")
            if not new.isEmpty():
                self.settle(new)
            if dense is not None and (rest := self.rest(dense)) is not None:
                more = self.step.write(self.exact(self.step.write(rest, "rest")), "links")
                if not more.isEmpty():
                    self.settle(more)
            leaves = dense = new = rest = more = None
            self.step.drop()
            if not parts and self.branched:
                self.open, more = self.short(part.stop, miss)
                if more > 0:
                    parts = [range(part.stop, part.stop + more)]
        return self.reps.select("doc", "comp")


def near_duplicates(docs: DataFrame, percent: int = 75, trees: int = 12, first: int = 3, leaf: int = 256, depth: int = 6, miss: float = 1e-4) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text, ...)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = scratch.write(docs.mapInArrow(sketch, "doc_id long, n_shingles long, h1 long, h2 long, tokens binary, marks binary"), "sketch")
    full = made.where("n_shingles > 0 and doc_id is not null")
    equal = scratch.write(full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("doc"), F.min(F.struct("tokens", "marks")).alias("m")), "reps")
    comp = Join(docs, equal.select("doc", "m.tokens", "m.marks", F.col("doc").alias("comp")), scratch, percent, leaf, depth).run(trees, first, miss)
    named = equal.join(comp, "doc").select("h1", "h2", "n_shingles", F.col("comp").alias("component_id"))
    out = made.drop("tokens", "marks").join(named, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(component))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple[int, str | None]], percent: int = 75) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component_id) by comparing all pairs, for small tests."""
    sets = {}
    for doc_id, text in rows:
        w = lower_words((text or "").encode())
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}
