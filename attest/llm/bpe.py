"""Byte-level BPE through a sentencepiece model that is written directly from a rank file.

Each byte is mapped to one letter, each vocabulary entry becomes a piece of such letters, and its score is its
negative rank, so that the model's best-scored merge is the merge of lowest rank. Normalisation is the identity
and no white space is added or escaped. A text is cut by the tokenizer's pattern first; a cut piece that is
itself an entry is that entry, any other goes through the model. Decoding maps ids back to bytes.

Defined results: null and empty texts have no ids and decode to no bytes; ids outside the vocabulary are an
error; special tokens are ordinary text; texts of any length are encoded whole; other columns pass through.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
# Cut pieces kept per Python worker: when there are more after a group of texts, the store starts anew.
KEPT_PIECES = 300_000
# Texts are cut in groups of about so many code points, and what is new in a group goes to the model at once.
GROUP = 1 << 20


def letters(data: bytes) -> str:
    """One letter per byte, U+0100 to U+01FF, none of them white space."""
    wide = bytearray(b"\x01" * (2 * len(data)))
    wide[1::2] = data
    return wide.decode("utf-16-be")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def field(number: int, value: int | bytes | float) -> bytes:
    """One field of a protocol buffer: bytes, a float, or a small whole number."""
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised model whose piece number is the rank; the last piece is the unknown, which no byte can reach."""
    # Field numbers and enum values of the public model format: pieces (1: piece, 2: score, 3: type), trainer
    # (3: model type, 4: vocabulary size, 40: unknown, 41-43: none), normaliser (1: name, 3-5: white space).
    none = (1 << 64) - 1
    ordered = sorted(ranks, key=ranks.get)
    if [ranks[x] for x in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must run from 0 without a gap")
    pieces = [field(1, field(1, letters(x).encode()) + field(2, float(-rank)) + field(3, 1)) for rank, x in enumerate(ordered)]
    pieces.append(field(1, field(1, b"<unk>") + field(2, 0.0) + field(3, 2)))
    trainer = field(3, 2) + field(4, len(ordered) + 1) + field(40, len(ordered)) + field(41, none) + field(42, none) + field(43, none)
    normaliser = field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 0)
    return b"".join(pieces) + field(2, trainer) + field(3, normaliser)


class Coder:
    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece
        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.bytes_of = sorted(self.ranks, key=self.ranks.get)
        self.decimals = [str(i) for i in range(len(self.ranks))]
        # Cut piece: its ids, and the same in decimals with a space between.
        self.kept: dict[str, tuple[list[int], str]] = {}

    def grouped(self, texts: Iterable[str]) -> Iterator[list[list[tuple[list[int], str]]]]:
        """For each group of texts, for each text, its cut pieces as ids and as decimals."""
        group, size = [], 0
        for text in texts:
            group.append(self.find(text))
            size += len(text)
            if size >= GROUP:
                yield self.looked_up(group)
                group, size = [], 0
        yield self.looked_up(group)

    def looked_up(self, group: list[list[str]]) -> list[list[tuple[list[int], str]]]:
        if len(self.kept) > KEPT_PIECES:
            self.kept = {}
        new = [cut for cut in set().union(*group) if cut not in self.kept]
        data = [cut.encode() for cut in new]
        whole = [self.ranks.get(d) for d in data]
        rest = [letters(d) for d, rank in zip(data, whole) if rank is None]
        merged, decimal = iter(self.model.encode(rest, num_threads=1) if rest else []), self.decimals.__getitem__
        for cut, rank in zip(new, whole):
            ids = [rank] if rank is not None else next(merged)
            self.kept[cut] = ids, " ".join(map(decimal, ids))
        return [[*map(self.kept.__getitem__, cuts)] for cuts in group]

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        for group in self.grouped(texts):
            for found in group:
                yield list(itertools.chain.from_iterable([ids for ids, _ in found]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def summaries(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, and SHA-256 of their decimals joined by one space and of the bytes they decode to."""
        for group in self.grouped(texts):
            for found in group:
                ids = list(itertools.chain.from_iterable([x for x, _ in found]))
                decimals = " ".join([x for _, x in found])
                yield len(ids), hashlib.sha256(decimals.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


@functools.cache
def coder(path: str, pattern: str) -> Coder:
    """One per Python worker."""
    return Coder(path, pattern)


def lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)], dtype=np.int64)
    return pa.LargeListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *values])).cast(pa.list_(pa.int32()))


def ids(text: Column, path: str = RANKS, pattern: str = PATTERN) -> Column:
    """The ids of a text, as array<int>."""
    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = (x.as_py() or "" for x in batch)
            yield lists([np.array(ids, dtype=np.int32) for ids in coder(path, pattern).encode(texts)])
    return encode(text)


def decoded(ids: Column, path: str = RANKS, pattern: str = PATTERN) -> Column:
    """The bytes of a list of ids."""
    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            one = coder(path, pattern).decode
            yield pa.array([one(x.as_py() or []) for x in batch], pa.binary())
    return decode(ids)


def digests(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of ``docs``: texts are encoded and their ids decoded in one
    pass, so that the ids of a text, which take more room than the text, stay where they are made."""
    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = (x.as_py() or "" for x in batch)
            columns = list(zip(*coder(path, pattern).summaries(texts))) or [[], [], []]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))],
                                             names=["n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select("doc_id", digest(F.col("text")).alias("s")).select("doc_id", "s.*")
