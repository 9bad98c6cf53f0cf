"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text is cut where a piece can't reach across: before each run of word marks (U+2581, which stand for
spaces). The distinct marked words that a worker hasn't met are sorted, which is a depth-first walk of their
trie; forward results of a prefix are kept on a stack and serve every word that continues it.

The forward pass is a Viterbi pass whose transitions follow the model's kind. For a unigram model the
best score of a prefix is the best of its last pieces plus the score before. The public model is a BPE
model, whose scores are merge ranks: a sum of them doesn't give its segmentation, so there a step from piece a to
piece b is allowed if and only if BPE splits the string a + b into just these two (looked up once per pair).
A prefix then has exactly one last piece, which is the one of its BPE encoding. Both passes extend
prefixes only, so both share them. Characters without a piece become byte pieces, as in the library.

Decoding joins the pieces' bytes and drops the mark before the first word.

Defined cases: null and the empty text have no ids and decode to the empty text; U+2581 in a text is a
space, as in the library, so such texts don't come back unchanged; repeated rows are each encoded; an
empty table gives no rows; other columns are ignored. Models that normalise (NFKC, folding of spaces)
are refused, since decoding couldn't return the text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, table, tokenizer_file

MARK = "▁"
#: Words whose ids a worker remembers: about 220 bytes each.
KNOWN_WORDS = 1_500_000
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Pairs(dict):
    """Whether BPE leaves a + b as the pieces a and b, remembered up to a bound."""

    def __init__(self, merged):
        self.merged = merged

    def __missing__(self, key: tuple[str, str]) -> bool:
        if len(self) >= 4 * CACHE_ENTRIES:
            self.clear()
        value = self[key] = self.merged(key[0] + key[1]) == [*key]
        return value


class Pieces:
    """A SentencePiece model's pieces, with the forward pass over sorted words."""

    def __init__(self, file: str, unigram: bool | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=file)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.unigram = unigram if unigram is not None else not all(s == int(s) for s in self.score.values())
        probe = "a  b"
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("the model normalises spaces")
        self.pairs = Pairs(self.merged)
        self.words: dict[str, bytes] = {}
        self.packed = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.bytes_of = [b""] * n
        for piece, i in self.ids.items():
            self.bytes_of[i] = piece.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        if self.unknown >= 0:
            self.bytes_of[self.unknown] = " ⁇ ".encode()
        usable = {p for p in self.ids if self.unigram or len(p) == 1 or self.merged(p) == [p]}
        self.use(usable)

    def use(self, usable: set[str]) -> None:
        """Sets the pieces that a segmentation may hold, and which lengths end in each pair of characters."""
        self.usable, self.longest = usable, max(map(len, usable))
        ends: dict[str, set[int]] = {}
        for p in usable:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.ends = {pair: (*sorted(lengths, reverse=True), 1) for pair, lengths in ends.items()}

    def merged(self, text: str) -> list[str]:
        """BPE by definition, for the short strings of pairs: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((s, -i) for i in range(len(parts) - 1) if (s := self.score.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def forward(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, pieces) of sorted words; last[i] (and best[i]) of a prefix are kept while words share it."""
        last: list[str] = [""]
        best: list[float] = [0.0]
        before = ""
        usable, score, ends, known, unigram = self.usable, self.score, self.ends, self.pairs, self.unigram
        single = (1,)
        for word in words:
            same = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], best[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                found, value = word[i - 1], best[i - 1] - 20.0 if unigram else 0.0
                for n in ends.get(word[i - 2 : i], single) if i > 1 else single:
                    at = i - n
                    if at < 0 or (piece := word[at:i]) not in usable:
                        continue
                    if unigram:
                        if best[at] + score[piece] > value:
                            found, value = piece, best[at] + score[piece]
                    elif not at or known[last[at], piece]:
                        found = piece
                        break
                last.append(found)
                best.append(value)
            pieces, i = [], len(word)
            while i:
                pieces.append(last[i])
                i -= len(last[i])
            yield word, pieces[::-1]
            before = word

    def learn(self, words: set[str]) -> None:
        packed = self.packed
        for word, pieces in self.forward(sorted(words)):
            self.words[word] = b"".join([packed.get(p) or self.pack(p) for p in pieces])

    def pack(self, piece: str) -> bytes:
        """The ids of a character without a piece: those of its bytes."""
        ids = [self.byte[b] for b in piece.encode()] if self.byte else [self.unknown]
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.words
        new = {w for words in cut for w in words if w not in known}
        if len(known) + len(new) > KNOWN_WORDS and known:
            known.clear()
            new = {w for words in cut for w in words}
        self.learn(new)
        return [b"".join(map(self.words.__getitem__, words)) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").removeprefix(" ")


MODELS: dict[str, Pieces] = {}


def model(name: str) -> Pieces:
    if name not in MODELS:
        MODELS[name] = Pieces(tokenizer_file(name))
    return MODELS[name]


def portions(batch: pa.RecordBatch, chars: int = 2_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of so many characters together: what the words of one pass may take in memory."""
    part: list[str | None] = []
    size = first = 0
    for i, text in enumerate(batch.column("text").to_pylist()):
        part.append(text)
        size += len(text or "")
        if size >= chars:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and ids (array of ints) of each row of docs (doc_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(name)
        for batch in batches:
            for first, part in portions(batch):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in m.encode(part)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(part)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and text of each row of encoded (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(name)
        for batch in batches:
            out = [m.decode(np.array(x or [], np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def digests(docs: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip: decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(name)
        for batch in batches:
            for first, part in portions(batch):
                raw = m.encode(part)
                same = [m.decode(np.frombuffer(x, "<u4")) == (t or "") for x, t in zip(raw, part, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(part)), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(list(map(zlib.crc32, raw)), pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_ids long, ids_crc32 long, round_trip boolean")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
