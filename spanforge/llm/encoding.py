"""Encoding of texts with a public byte-level vocabulary, carried by a sentencepiece model.

The vocabulary file gives each byte string a rank. Every byte is mapped to a printable
character, each entry becomes a piece scored by its negative rank, and the model is
serialised directly: BPE with identity normalisation, so that piece ids are the ranks. A text
is cut into pre-tokens by the vocabulary's pattern; each is encoded by itself.
"""

from __future__ import annotations

import base64
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: fixed values: the pre-token pattern that belongs to the vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WHITE = r"[ \t\n\r\f\v]"
#: the same for texts that are all ASCII
ASCII_PATTERN = PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^ \t\n\r\f\vA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\s+(?!\S)", _WHITE + r"+(?![^ \t\n\r\f\v])").replace(r"|\s+", "|" + _WHITE + "+")
CACHED = 400_000  # pre-tokens a worker remembers
CACHED_CHARS = 48


def byte_alphabet() -> str:
    """The character of each byte: printable ones keep theirs, the others follow from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return "".join(chr(b if b in keep else next(other)) for b in range(256))


def _field(number: int, value: bytes | int | float | bool) -> bytes:
    """One protocol-buffer field."""

    def varint(n: int) -> bytes:
        n &= (1 << 64) - 1
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
        return bytes(out)

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(int(value))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the id after them is unknown."""
    letters = byte_alphabet()
    entries = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in entries] != list(range(len(entries))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    pieces = b"".join(_field(1, _field(1, "".join(letters[b] for b in token).encode()) + _field(2, -float(rank))) for token, rank in entries)
    pieces += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    unknown = len(entries)
    trainer = _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return pieces + _field(2, trainer) + _field(3, normalizer)


class Encoder(dict):
    """Ids of a pre-token; common ones are remembered up to a bound."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.letters = {b: c for b, c in enumerate(byte_alphabet())}
        self.bytes = {ord(c): b for b, c in self.letters.items()}
        self.split = regex.compile(PATTERN).findall
        self.split_ascii = re.compile(ASCII_PATTERN).findall

    def __missing__(self, word: str) -> list[int]:
        ids = self.model.encode(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters))
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        words = self.split_ascii(text) if text.isascii() else self.split(text)
        return list(chain.from_iterable(map(self.__getitem__, words)))

    def decode(self, ids: list[int]) -> str:
        """The text whose ids these are."""
        word = "".join(map(self.model.id_to_piece, ids))
        return bytes(self.bytes[ord(c)] for c in word).decode("utf-8", "surrogatepass")


def encode_documents(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids ARRAY<INT>: the token ids of each whole text, without special tokens; their
    strings in a text are plain text. Null and empty texts give an empty list. Repeated rows
    stay repeated, other columns are left behind. The model has the fixed size of its
    vocabulary and is sent to the executors once. No shuffle."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(serialise(read_ranks(f"{tokenizers}/{vocabulary}")))

    def run(batches):
        encoder = Encoder(model.value)
        for b in batches:
            lists = [encoder.encode(t) if t else [] for t in b.column("text").to_pylist()]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            ids = np.fromiter(chain.from_iterable(lists), np.int32, ends[-1])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text of encoded documents (doc_id, ids): the inverse of encode_documents, but that
    a null text comes back empty. Null ids give an empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(serialise(read_ranks(f"{tokenizers}/{vocabulary}")))

    def run(batches):
        encoder = Encoder(model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([encoder.decode(x) if x else "" for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
