"""Byte-level BPE through a sentencepiece model serialised straight from a rank file.

The rank file's tokens are written as the pieces of a sentencepiece BPE model: bytes are mapped
one to one to printable code points, a piece's score is its negative rank, and normalisation is
the identity.  sentencepiece then merges exactly as rank order demands.  Each match of the
pre-token pattern is encoded separately; a match that is itself a token takes its rank at once.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.llm.base import map_texts, table

#: Pre-tokens remembered by a worker; beyond it the memory starts anew, so a worker stays bounded.
CACHE_ENTRIES = 150_000
#: Longest pre-token, in bytes, that is worth remembering.
CACHE_BYTES = 64


def byte_alphabet() -> list[str]:
    """One printable code point for each byte: itself where printable, else from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + payload


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _sized(number: int, payload: bytes) -> bytes:
    return _field(number, 2, _varint(len(payload)) + payload)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; the unknown piece takes the id after the last."""
    alphabet = byte_alphabet()
    size = max(ranks.values()) + 1
    by_rank: list[bytes | None] = [None] * size
    for token, rank in ranks.items():
        by_rank[rank] = token
    out = bytearray()
    for rank, token in enumerate(by_rank):
        piece = f"<unused{rank}>" if token is None else "".join(alphabet[b] for b in token)
        unused = _field(3, 0, _varint(5)) if token is None else b""
        out += _sized(1, _sized(1, piece.encode()) + _field(2, 5, struct.pack("<f", -float(rank))) + unused)
    out += _sized(1, _sized(1, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2)))
    trainer = (
        _field(3, 0, _varint(2))  # BPE
        + _field(4, 0, _varint(size + 1))
        + _field(24, 0, _varint(0))  # escape white space in training: unused here
        + _field(40, 0, _varint(size))  # unk id
        + _field(41, 0, _varint(-1))
        + _field(42, 0, _varint(-1))
        + _field(43, 0, _varint(-1))
    )
    normalizer = _sized(1, b"identity") + _field(3, 0, _varint(0)) + _field(4, 0, _varint(0)) + _field(5, 0, _varint(0))
    return bytes(out) + _sized(2, trainer) + _sized(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        alphabet = byte_alphabet()
        self.to_piece = {i: c for i, c in enumerate(alphabet)}
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.known: dict[str, bytes] = {}

    def _ids(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(raw)
        if rank is not None:
            return struct.pack("<I", rank)
        ids = self.model.encode(raw.decode("latin-1").translate(self.to_piece), out_type=int, num_threads=1)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        words = self.split(text)
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self._ids(w)
                if len(w) <= CACHE_BYTES:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Inverse mapping of the pieces, gathered for all ids at once."""
        return self.bytes_of(np.frombuffer(ids, "<u4"))

    def bytes_of(self, ids: np.ndarray, step: int = 1 << 18) -> bytes:
        parts = []
        for i in range(0, len(ids), step):
            part = ids[i : i + step]
            n = self.lengths[part]
            ends = np.cumsum(n)
            at = np.arange(int(ends[-1])) + np.repeat(self.starts[part] - (ends - n), n)
            parts.append(self.bytes[at].tobytes())
        return b"".join(parts)


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """The worker's codec for a rank file; built once a process."""
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(path, pattern)
    return _LOADED[key]


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids binary`` (uint32 little-endian), for every row; a null text encodes as empty.

    Repeated rows and ties stay as they are; an empty table gives no rows; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return map_texts(src, run, f"id {src.schema['id'].dataType.simpleString()}, ids binary").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, decoded binary``: the bytes that the ids stand for; null ids decode as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            out = [bpe.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "decoded"])

    src = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return map_texts(src, run, f"id {src.schema['id'].dataType.simpleString()}, decoded binary").withColumnRenamed("id", id_col)


def roundtrip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: ``id, n_tokens, ids_sha256, decoded_sha256`` and, if asked, ``ids`` (null text: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            counts, ids_hex, text_hex, kept = [], [], [], []
            for k in range(batch.num_rows):
                ids = bpe.encode(batch.column(1)[k].as_py() or "")
                counts.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string()), *([pa.array(kept, pa.binary())] if with_ids else [])],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])],
            )

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    return map_texts(src, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids).withColumnRenamed("id", id_col)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return roundtrip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
