"""Encoding of a corpus with a public byte-level BPE vocabulary, through a sentencepiece model written from that vocabulary.

The model is serialised directly from the ranks: every token's bytes are mapped to printable characters, one per byte, its
score is the negative rank, and normalisation is the identity, so sentencepiece merges exactly what the ranks say. Texts are
cut into pre-tokens by the vocabulary's pattern, each pre-token is encoded on its own, and decoding is the inverse mapping.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; set LOOMWRIGHT_TOKENIZERS or pass a path.
FOLDER = os.environ.get("LOOMWRIGHT_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: Pre-token pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose ids a worker remembers, and their greatest length in characters.
MEMORY, MEMORY_CHARS = 200_000, 40


def byte_characters() -> list[str]:
    """The character for each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from a rank file (base64 and rank on each line); ranks must be 0..n-1."""
    with open(path, "rb") as f:
        pairs = [(int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip())]
    pairs.sort()
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"ranks of {path} are not 0..{len(pairs) - 1}")
    return [t for _, t in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    """A protobuf field: bytes with their length, or a varint."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece, never produced, comes last."""
    chars = byte_characters()
    pieces = []
    for rank, token in enumerate(tokens):
        text = "".join(chars[b] for b in token).encode()
        pieces.append(_field(1, _field(1, text) + b"\x15" + struct.pack("<f", -float(rank))))
    pieces.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2)))
    size = len(pieces)
    # trainer: model type BPE, vocabulary size, ids of the unknown and of no other control piece
    absent = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, size) + _field(40, size - 1) + b"".join(_field(n, absent) for n in (41, 42, 43))
    # normaliser: identity, no dummy prefix, white space neither removed nor escaped
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to ids and decodes them; empty and null texts have no ids."""

    def __init__(self, model: bytes, pattern: str = PATTERN) -> None:
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        chars = byte_characters()
        self.to_chars = {b: c for b, c in enumerate(chars)}
        self.to_byte = {c: b for b, c in enumerate(chars)}
        self.known: dict[str, np.ndarray] = {}
        self.plain = str.maketrans({chr(b): chars[b] for b in range(128)})

    def _mapped(self, token: str) -> str:
        return token.translate(self.plain) if token.isascii() else token.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_chars)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        tokens: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = self.split(text)
                counts[i] = len(own)
                tokens += own
        if not tokens:
            return np.empty(0, np.int32), counts
        known = self.known
        fresh = list({t for t in tokens if t not in known})
        if fresh:
            coded = self.pieces.encode([self._mapped(t) for t in fresh], num_threads=1)
            known.update((t, np.array(c, np.int32)) for t, c in zip(fresh, coded))
        parts = [known[t] for t in tokens]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.concatenate([[0], np.cumsum(counts)])
        ids = np.concatenate(parts)
        long = [t for t in fresh if len(t) > MEMORY_CHARS]
        for t in long:
            del known[t]
        if len(known) > MEMORY:
            known.clear()
        return ids, ends[at[1:]] - ends[at[:-1]]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the bytes of their pieces, as UTF-8."""
        return bytes(self.to_byte[c] for i in ids for c in self.pieces.id_to_piece(int(i))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(model: bytes) -> Codec:
    return Codec(model)


def load_model(path: str | None = None) -> bytes:
    """The serialised model of a rank file, by default byte_bpe_50k: about a megabyte, whatever the corpus."""
    return serialise_model(read_ranks(path or os.path.join(FOLDER, BYTE_BPE_50K)))


#: Characters of text encoded at once.
CHUNK_CHARS = 4_000_000


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held > CHUNK_CHARS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_corpus(docs: DataFrame, text: str = "text", *, keep: list[str] = ("doc_id",), path: str | None = None, ids: bool = True, counts: bool = False) -> DataFrame:
    """``keep`` columns with ``ids`` (array<int>) and/or ``n_tokens`` of ``text``; one row per input row, no shuffle.

    No special tokens: text that looks like one is ordinary text. Defined cases: an empty or null text has an empty list and
    0 tokens; texts of any length are encoded whole; repeated rows stay; a null key stays null; an empty table gives no row;
    only ``keep`` and ``text`` are read, so clashing names can only come from ``keep``, which may not hold the result's names.
    """
    new = [n for n, wanted in (("ids", ids), ("n_tokens", counts)) if wanted]
    if set(new) & set(keep):
        raise ValueError(f"keep must not contain {new}")
    sent = docs.sparkSession.sparkContext.broadcast(load_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for s, e in _chunks(texts := column.to_pylist()):
                flat, n = codec.encode(texts[s:e])
                cols = [batch.column(i).slice(s, e - s) for i in range(len(keep))]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat)))
                if counts:
                    cols.append(pa.array(n))
                yield pa.RecordBatch.from_arrays(cols, [*keep, *new])

    types = dict(docs.dtypes)
    kept = ", ".join(f"`{c}` {types[c]}" for c in keep)
    extra = {"ids": "ids array<int>", "n_tokens": "n_tokens bigint"}
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, ", ".join([kept, *[extra[n] for n in new]]))


def decode_corpus(coded: DataFrame, ids: str = "ids", *, keep: list[str] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep`` columns with the ``text`` of ``ids``; null ids give a null text, an empty list an empty one."""
    sent = coded.sparkSession.sparkContext.broadcast(load_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    types = dict(coded.dtypes)
    return coded.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in keep], "text string"]))
