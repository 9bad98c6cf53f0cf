"""Winnowing fingerprints of texts (native: DataFrame functions only, nothing in Python).

A text's grams are windows of `gram` tokens; tokens are runs of non-space characters of the lower-cased
text, at most 16 characters each, so a text without spaces has grams too. Each gram is hashed (32 bits
kept), and of every `window` consecutive grams the least hash is chosen, the rightmost of equal ones.
Two texts that share window + gram - 1 consecutive tokens therefore share a fingerprint, and positions
(token indexes) of the chosen grams say where. Hash and position travel as one long,
hash * 2^31 + (2^31 - 1 - position), so that one `least` finds the minimum with rightmost ties; the
minimum of `window` (a power of two) values takes log2(window) passes of pairwise least.

Defined cases: null is the empty text; a text without tokens has the empty fingerprint; a text with fewer
tokens than a gram has one hash, of all its tokens; fewer grams than a window give their one minimum.
Likeness is the Jaccard index of the hash sets; of two empty ones 1, of one empty one 0.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, table

TOKEN = r"[^\\x20\\x09-\\x0D]{1,16}"
LEAST_ID = -(2**63)


def with_fingerprint(rows: DataFrame, text: str, into: str, gram: int = 3, window: int = 8) -> DataFrame:
    """rows with `into`: array<long> of the chosen grams in order of position, each hash * 2^31 + 2^31 - 1 - position."""
    steps = int(math.log2(window))
    if 2**steps != window:
        raise ValueError("window is a power of two")
    t = f"_{into}_t"
    at = ", ".join(f"{t}[i + {j}]" for j in range(gram))
    out = rows.withColumn(t, F.expr(f"transform(regexp_extract_all(lower({text}), '{TOKEN}', 0), x -> xxhash64(x))"))
    pack = "shiftleft({} & 4294967295L, 31) + (2147483647L - {})"
    short = f"if(size({t}) = 0, array(), array({pack.format(f'xxhash64({t})', 0)}))"
    out = out.withColumn(into, F.expr(f"if(size({t}) >= {gram}, transform(sequence(0, size({t}) - {gram}), i -> {pack.format(f'xxhash64({at})', 'i')}), {short})")).drop(t)
    for s in range(steps):
        out = out.withColumn(into, F.expr(f"transform({into}, (x, i) -> least(x, get({into}, i + {2**s})))"))
    whole = F.greatest(F.lit(1), F.size(into) - (window - 1))
    return out.withColumn(into, F.array_distinct(F.slice(into, 1, whole)))


def hashes(chosen: str) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.expr(f"array_distinct(transform({chosen}, x -> shiftright(x, 31)))")


def positions(chosen: str) -> Column:
    return F.expr(f"transform({chosen}, x -> cast(2147483647L - (x & 2147483647L) as int))")


def as_text(chosen: str) -> Column:
    """The hashes in order of position, eight hexadecimal digits each."""
    return F.expr(f"concat_ws('', transform({chosen}, x -> lpad(lower(hex(shiftright(x, 31))), 8, '0')))")


def likeness(a: str, b: str) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def in_turn(ids: DataFrame, key: str, wide: int = 65536) -> DataFrame:
    """Distinct keys with `following`: the next lower one, and after the lowest the highest.

    Two levels, so that no task sees more than `wide` keys or one key in `wide`.
    """
    ids = ids.withColumn("_wide", F.floor(F.col(key) / wide))
    tops = ids.groupBy("_wide").agg(F.max(key).alias("_top"))
    order = Window.orderBy(F.col("_wide").desc())
    tops = tops.withColumn("_below", F.coalesce(F.lead("_top").over(order), F.first("_top").over(order))).drop("_top")
    inner = ids.withColumn("_next", F.lead(key).over(Window.partitionBy("_wide").orderBy(F.col(key).desc())))
    return inner.join(tops, "_wide").select(key, F.coalesce("_next", "_below").alias("following"))


def fingerprint_neighbours(rows: DataFrame, gram: int = 3, window: int = 8, bucket: int = 1024) -> DataFrame:
    """rows (doc_id, text) with each text's fingerprint, its edited text's and the likeness to that and to the next row.

    The next row is that with the next lower doc_id, after the lowest the highest; null ids are lowest,
    and rows of one id follow each other by a hash of their text. Rows move once, to buckets of
    `bucket` ids; the first row of the next bucket reaches a bucket's last one by a join on buckets.
    """
    base = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(LEAST_ID)))
    base = base.withColumn("_bucket", F.floor(F.col("_id") / bucket)).withColumn("_tie", F.xxhash64("text")).withColumn("n_chars", F.length("text").cast("long"))
    heads = base.groupBy("_bucket").agg(F.max(F.struct("_id", "_tie")).alias("_m")).select("_bucket", "_m.*")
    head = bounded(heads.select("_id", "_tie")).alias("h")
    first = base.join(head, ["_id", "_tie"], "left_semi").dropDuplicates(["_bucket"]).select("_bucket", F.col("text").alias("_head"))
    first = with_fingerprint(first, "_head", "_head_chosen", gram, window).select("_bucket", "_head", hashes("_head_chosen").alias("_head_hashes"))
    turn = in_turn(heads.select("_bucket"), "_bucket").alias("t")
    edge = turn.join(first.withColumnRenamed("_bucket", "following"), "following").drop("following")
    order = Window.partitionBy("_bucket").orderBy(F.col("_id").desc(), F.col("_tie").desc())
    out = base.withColumn("_next", F.lead("text").over(order)).withColumn("_inner", F.lead(F.lit(1)).over(order))
    edge = F.broadcast(edge) if heads.limit(20_001).count() <= 20_000 else edge
    out = out.join(edge, "_bucket")
    n = F.floor(F.col("n_chars") / 3).cast("int")
    out = out.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - n), F.substring(F.coalesce("_next", "_head"), F.lit(1), n))).drop("_next", "_head")
    out = out.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    out = with_fingerprint(with_fingerprint(out, "text", "_chosen", gram, window).drop("text"), "edited", "_edited_chosen", gram, window).drop("edited")
    out = out.withColumn("_own", hashes("_chosen")).withColumn("_other", hashes("_edited_chosen"))
    out = out.withColumn("_next_hashes", F.when(F.col("_inner").isNull(), F.col("_head_hashes")).otherwise(F.lead("_own").over(order)))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text("_chosen").alias("fingerprint"), as_text("_edited_chosen").alias("edited_fingerprint"),
        likeness("_own", "_other").cast("double").alias("near_edited"), likeness("_own", "_next_hashes").cast("double").alias("near_next"), positions("_chosen").alias("positions"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple[int, str]], gram: int = 3, window: int = 8, digest=None) -> list[dict]:
    """What the operator should return, by loops over Python strings, for small tests. digest: hash of a tuple of tokens."""
    digest = digest or (lambda x: hash(x) & 0xFFFFFFFF)

    def chosen(text: str) -> list[tuple[int, int]]:
        import re

        tokens = re.findall(r"[^\x20\x09-\x0D]{1,16}", text.lower())
        grams = [digest(tuple(tokens[i : i + gram])) for i in range(len(tokens) - gram + 1)] or [digest(tuple(tokens))] * bool(tokens)
        picks = []
        for i in range(max(1, len(grams) - window + 1) if grams else 0):
            part = grams[i : i + window]
            j = max(k for k, v in enumerate(part) if v == min(part))
            if (i + j, part[j]) not in picks[-1:]:
                picks.append((i + j, part[j]))
        return list(dict.fromkeys(picks))

    rows, out = sorted(rows, reverse=True), []
    near = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for i, (doc_id, text) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + nxt[:n]
        a, b, c = ({v for _, v in chosen(x)} for x in (text, edited, nxt))
        out.append({"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "near_edited": near(a, b), "near_next": near(a, c), "positions": [p for p, _ in chosen(text)]})
    return out
