"""The registered queries on the smallest tables: columns and types of the contract, and rows by brute force."""

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkmask.llm import near_duplicates, queries, sharding
from sparkmask.llm.common import tokenizer_file

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_minhash_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op3_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4_pack_sequences": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op5_winnowing": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op6_ring_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op7_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_extract_html": "page_id bigint, url string, text string, n_chars bigint",
    "op9_class_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def rows(spark):
    """Of each query, its rows; each runs once."""
    done = {}

    def of(name):
        if name not in done:
            df = queries.queries()[name](spark, SF)
            types = dict(df.dtypes)
            for column in COLUMNS[name].split(", "):
                c, kind = column.split(" ")
                assert types.get(c) == kind, (name, c, types.get(c))
            done[name] = df.collect()
        return done[name]

    return of


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize("name", [n for n in COLUMNS if n != "op8_extract_html" and n != "op4_pack_sequences"])
def test_a_row_for_each_document(rows, texts, name):
    assert Counter(r.doc_id for r in rows(name)) == Counter(texts.keys())


def test_near_duplicates(rows, texts):
    want = near_duplicates.brute_force(list(texts.items()))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows("op2_minhash_dedup")} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows("op2_minhash_dedup"))


def test_quality(rows, texts):
    for r in rows("op3_quality_rules"):
        w, lines = words(texts[r.doc_id]), [x for x in texts[r.doc_id].split("\n") if words(x)]
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", texts[r.doc_id])), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_packing(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in rows("op4_pack_sequences"):
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for doc_id, mine in pieces.items():
        ids = [*t.encode(texts[doc_id], add_special_tokens=False).ids, 0]
        raw, at = struct.pack(f"<{len(ids)}I", *ids), 0
        for i, r in enumerate(sorted(mine, key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (i, at, zlib.crc32(raw[4 * at : 4 * (at + r.length)])) and (i == 0 or r.length == 2048)
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_fingerprints(rows, texts):
    order = sorted(texts, reverse=True)
    got, prints = {r.doc_id: r for r in rows("op5_winnowing")}, {}
    for i, doc_id in enumerate(order):
        text, following, r = texts[doc_id], texts[order[(i + 1) % len(order)]], got[doc_id]
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and prints.setdefault(text, r.fingerprint) == r.fingerprint


def ring_walk(placed, shards):
    """Of (key, shard), the share on its own shard; each arc's rows must be where walks clockwise, row by row, end."""
    points = sharding.ring_points(shards, 64)
    where, total = [p for p, _ in points], len(placed)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    arcs, got = Counter(), Counter()
    for key, shard in placed:
        arc = bisect_left(where, xxhash.xxh64_intdigest(str(key).encode(), 42) % 2**32) % len(points)
        arcs[arc] += 1
        got[arc, shard] += 1
    waiting, want, steps = sorted(arcs.elements()), Counter(), 0
    while waiting:  # all that wait go on by one point, in ring order
        stay = []
        for arc in waiting:
            s = points[(arc + steps) % len(points)][1]
            if room[s]:
                room[s] -= 1
                want[arc, s] += 1
            else:
                stay.append(arc)
        waiting, steps = stay, steps + 1
    assert got == want
    return sum(n for (arc, s), n in got.items() if s == points[arc][1]) / total


def test_shards(spark, rows, texts):
    got = rows("op6_ring_shards")
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    for shard in range(24):
        mine = sorted(r.slot for r in got if r.shard == shard)
        assert mine == list(range(len(mine)))
    assert ring_walk([(r.doc_id, r.shard) for r in got], 24) > 0.5
    hot = spark.range(900).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("k"), "id")
    assert ring_walk([(r.k, r.shard) for r in sharding.assign_shards(hot, "k", 5).collect()], 5) < 0.9  # a third of the rows have one key


def test_toxicity(spark, rows):
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in rows("op7_toxicity"):
        assert r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert label.keys() & {r.doc_id for r in rows("op7_toxicity")}


def test_pages(spark, rows):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    got = rows("op8_extract_html")
    assert {r.page_id: r.url for r in got} == pages and len(got) == len(pages)
    for r in got:
        assert r.n_chars == len(r.text) and not re.search(r"[ \t\r]{2}|^\s|\s$| \n|\n |\n\n", r.text)


def test_language_model(rows, texts):
    tokens = {i: [*words(lower(t)), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if remainder(i, 10) for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in rows("op9_class_lm"):
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(r.doc_id, 10) == 0, len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) and r.score < 0
