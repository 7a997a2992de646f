"""Alignment of two tokenizers over the same texts, by products of sparse incidence matrices.

Both tokenizers cut the bytes of space + text into tokens. With token-byte incidence matrices A and B, built by hand row
by row, the row products A·Bᵀ give the overlap links: which tokens share bytes, and how many. Where an A token and a B
token of a link end together a group ends. The product of the group-incidence matrices (A ids x groups, groups x B ids)
then gives the shared-group links as counts per pair of ids, so that a group of many tokens costs its distinct ids, not
its pairs of occurrences.

A text is cut into segments at spaces that follow a character other than white space: no token of either tokenizer
crosses such a place (no B piece holds a space after another character, and A's pattern starts anew there), so
segments are encoded and aligned once per Python worker and texts are put together from them by one more product,
texts x segments times segments x pairs.

How often a pair of ids is linked in the corpus: texts' distinct pairs are counted with a map-side sum. The pairs
with the highest counts, at most ``HOT_PAIRS``, are read by every task; a text's other pairs are joined with their
counts by a shuffle, where no pair is frequent.

Defined results: texts that are null or empty, or whose tokens of either side don't spell space + text (U+2581, which B
takes for a space), have no tokens: zeros, empty lists, and '' as digest. Repeated rows and rows without an id are
texts of their own and count each. An empty table gives an empty result; other columns are ignored. A text's distinct pairs
are held by one task.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import scratch
from . import sparse
from .archives import opened
from .common import materialised
from .sparse import Rows, bounds

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
# Segments kept per Python worker; when there are more after a group of texts, the store starts anew.
KEPT_SEGMENTS = 200_000
# Texts are worked on in groups of about so many code points.
GROUP = 1 << 20
# Pairs of ids whose counts every task reads: 17 bytes each.
HOT_PAIRS = 1 << 20
# A space after one of these does not start a segment: all that any version of Unicode calls white space.
BLANKS = " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u2060\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x2010)))
BLANK_THEN_SPACE = [blank + " " for blank in BLANKS]
SEGMENT = re.compile(f" ( *(?:[^ ]*[{re.escape(BLANKS[1:])}] +)*[^ ]*)")
# New segments go to the tokenizers joined to texts of about so many code points.
JOINED = 1 << 14


def segments(text: str) -> list[str]:
    """The segments of space + text, each without the space it starts with; none for an empty text."""
    if not text:
        return []
    if any(x in text for x in BLANK_THEN_SPACE) or text[0] == " " or text[-1] == " ":
        return SEGMENT.findall(" " + text)
    return text.split(" ")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the others
    follow from U+0100 on, in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Tokens:
    """Ids of many texts one after the other: ``ids[starts[i]:starts[i + 1]]`` are those of text i."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.ids, self.starts, self.by_id = ids, starts, lengths
        self.lengths = lengths[ids]
        self.ends = np.cumsum(self.lengths)

    @classmethod
    def of(cls, lists: list[list[int]], lengths: np.ndarray) -> "Tokens":
        starts = bounds([len(x) for x in lists])
        return cls(np.fromiter(itertools.chain.from_iterable(lists), np.int64, starts[-1]), starts, lengths)

    @classmethod
    def chained(cls, parts: list["Tokens"]) -> "Tokens":
        return cls(np.concatenate([p.ids for p in parts]), bounds(np.concatenate([np.diff(p.starts) for p in parts])), parts[0].by_id)

    def picked(self, texts: np.ndarray) -> "Tokens":
        """The tokens of the texts of these numbers, in this order."""
        sizes = np.diff(self.starts)[texts]
        return Tokens(self.ids[sparse.spread(self.starts[texts], sizes)], bounds(sizes), self.by_id)

    def text_of_tokens(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


class Pair:
    """The two tokenizers and what their tokens spell."""

    def __init__(self, byte_level: str, pieces: str):
        import os

        import sentencepiece
        # Spark gives a task one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = byte_letters()
        names = {i: name for name, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_a = [bytes(letters[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.bytes_b = [self.spelt(i) for i in range(self.b.get_piece_size())]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("\u2581")

    def spelt(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("\u2581", " ").encode()

    def encode(self, texts: list[str]) -> tuple[Tokens, Tokens]:
        """Tokens of space + text for each text. A text that either side doesn't spell has no tokens."""
        data = [b" " + text.encode() for text in texts]
        a = [e.ids for e in self.a.encode_batch([" " + text for text in texts], add_special_tokens=False)]
        # B adds the space by itself, but not to an empty text.
        b = [ids or [self.space] for ids in self.b.encode(texts, num_threads=1)]
        for side, spelt in ((a, self.bytes_a), (b, self.bytes_b)):
            for i, ids in enumerate(side):
                if b"".join(map(spelt.__getitem__, ids)) != data[i]:
                    a[i] = b[i] = []
        return Tokens.of(a, self.lengths_a), Tokens.of(b, self.lengths_b)

    def encode_segments(self, texts: list[str]) -> tuple[Tokens, Tokens]:
        """The same for segments, which are joined to longer texts first: a tokenizer's cost a call is high. Segments that end in
        white space, which would run into the next, go alone, and so do those of a joined text that isn't spelt."""
        ended = [bool(text) and text[-1] not in BLANKS for text in texts]
        order = sorted(range(len(texts)), key=lambda i: not ended[i])
        texts = [texts[i] for i in order]
        n, sizes = sum(ended), np.cumsum([len(text) for text in texts[:sum(ended)]]) // JOINED
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), n] if n else [0]
        parts = [self.joined(texts[i:j]) for i, j in zip(cuts, cuts[1:])]
        if n < len(texts):
            parts.append(self.encode(texts[n:]))
        back = np.argsort(order)
        return tuple(Tokens.chained([part[side] for part in parts]).picked(back) for side in (0, 1))

    def joined(self, texts: list[str]) -> tuple[Tokens, Tokens]:
        whole = " ".join(texts)
        data, ends = (" " + whole).encode(), np.cumsum([len(text.encode()) + 1 for text in texts])
        sides = []
        for ids, lengths, spelt in ((self.a.encode(" " + whole, add_special_tokens=False).ids, self.lengths_a, self.bytes_a),
                                    (self.b.encode(whole, num_threads=1), self.lengths_b, self.bytes_b)):
            if b"".join(map(spelt.__getitem__, ids)) != data:
                return self.encode(texts)
            ids = np.array(ids, np.int64)
            token_ends = np.cumsum(lengths[ids])
            places = np.searchsorted(token_ends, ends)
            if not np.array_equal(token_ends[places], ends):
                return self.encode(texts)
            sides.append(Tokens(ids, np.concatenate([[0], places + 1]), lengths))
        return sides[0], sides[1]


def overlap_links(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, shared bytes) of all tokens that share bytes, in order: A·Bᵀ over the bytes of all texts."""
    n_bytes = int(a.ends[-1]) if len(a.ends) else 0
    ones = np.ones(n_bytes, np.int64)
    token_bytes = Rows(bounds(a.lengths), np.arange(n_bytes), ones)
    byte_tokens = Rows(np.arange(n_bytes + 1), np.repeat(np.arange(len(b.ids)), b.lengths), ones)
    links = sparse.product(token_bytes, byte_tokens, len(b.ids))
    return links.row_of_entries(), links.columns, links.values


class Aligned:
    """Texts side by side: ``group_a`` and ``group_b`` number the group of each token over all texts."""

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        self.links = overlap_links(a, b)
        row, column, _ = self.links
        together = a.ends[row] == b.ends[column]
        group = np.cumsum(together) - together
        # A token's links lie in one group; its last link names it.
        self.group_a, self.group_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
        self.group_a[row], self.group_b[column] = group, group
        self.n_groups = int(together.sum())
        self.size_a, self.size_b = (np.bincount(g, minlength=self.n_groups) for g in (self.group_a, self.group_b))
        # The text of a group, from its first token.
        self.text_of_group = np.zeros(self.n_groups, np.int64)
        self.text_of_group[self.group_a] = a.text_of_tokens()

    def pair_counts(self, n_b_ids: int) -> tuple[Rows, np.ndarray, np.ndarray]:
        """Linked occurrences per (text and A id) x B id, and the text and the A id of each row: the product of
        the group-incidence matrices."""
        keys, row = np.unique(self.a.text_of_tokens() * np.int64(1 << 31) + self.a.ids, return_inverse=True)
        ids_groups = sparse.incidence(row.ravel(), self.group_a, len(keys))
        groups_ids = sparse.incidence(self.group_b, self.b.ids, self.n_groups)
        text, a_id = np.divmod(keys, 1 << 31)
        return sparse.product(ids_groups, groups_ids, n_b_ids), text, a_id

    def spelling(self, decimals: "Decimals") -> list[str]:
        """Per text ``a1,a2|b1;a3|b2,b3``: the ids of its groups in order."""
        n_a, n_b, g_a, g_b = len(self.a.ids), len(self.b.ids), self.group_a, self.group_b
        out = np.empty(n_a + n_b, dtype=object)
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[:len(g)] for g in (g_a, g_b))
        b_before, a_through = np.cumsum(self.size_b) - self.size_b, np.cumsum(self.size_a)
        out[np.arange(n_a) + b_before[g_a]] = np.where(last_a, decimals.bar[self.a.ids], decimals.comma[self.a.ids])
        out[np.arange(n_b) + a_through[g_b]] = np.where(last_b, decimals.semicolon[self.b.ids], decimals.comma[self.b.ids])
        cut = (self.a.starts + self.b.starts).tolist()
        parts = out.tolist()
        return ["".join(parts[i:j])[:-1] for i, j in zip(cut, cut[1:])]


class Decimals:
    def __init__(self, n: int):
        self.comma, self.bar, self.semicolon = (np.array([f"{i}{mark}" for i in range(n)], dtype=object) for mark in ",|;")


class Segments:
    """Segments that were aligned before: counts, the spelling of the groups, and linked pairs row by row."""

    def __init__(self, pair: Pair):
        self.pair, self.decimals, self.n_b_ids = pair, Decimals(max(len(pair.bytes_a), len(pair.bytes_b))), len(pair.bytes_b)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.spelling: list[str] = []
        # n_a, n_b, n_groups, n_links per segment; a segment that isn't spelt has no tokens.
        self.counts, self.pairs = np.zeros((0, 4), np.int64), Rows(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, new: list[str]) -> None:
        aligned = Aligned(*self.pair.encode_segments(new))
        pairs, text, a_id = aligned.pair_counts(self.n_b_ids)
        codes = a_id[pairs.row_of_entries()] * self.n_b_ids + pairs.columns
        per_text = np.bincount(text[pairs.row_of_entries()], minlength=len(new))
        links = np.bincount(aligned.text_of_group, aligned.size_a * aligned.size_b, len(new)).astype(np.int64)
        counts = np.stack([np.diff(aligned.a.starts), np.diff(aligned.b.starts), np.bincount(aligned.text_of_group, minlength=len(new)), links], axis=1)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.spelling.extend(aligned.spelling(self.decimals))
        self.counts = np.concatenate([self.counts, counts])
        self.pairs = Rows(np.concatenate([self.pairs.starts, self.pairs.starts[-1] + np.cumsum(per_text)]),
                          np.concatenate([self.pairs.columns, codes]), np.concatenate([self.pairs.values, pairs.values]))

    def texts(self, group: list[str]) -> tuple[np.ndarray, list[str], Rows]:
        """Per text of a group: (n_a, n_b, n_groups, n_links), digest of the groups, and linked pairs with their counts."""
        if len(self.place) > KEPT_SEGMENTS:
            self.clear()
        cut = [segments(text) for text in group]
        new = [s for s in set().union(*cut) if s not in self.place]
        if new:
            self.add(sorted(new))
        named = [[*map(self.place.__getitem__, x)] for x in cut]
        starts = bounds([len(x) for x in named])
        places = np.fromiter(itertools.chain.from_iterable(named), np.int64, starts[-1])
        spelt = sparse.sums((self.counts[places, 0] == 0).astype(np.int64), starts) == 0
        there = np.repeat(spelt, np.diff(starts))
        of_texts = Rows(bounds(np.where(spelt, np.diff(starts), 0)), places[there], np.ones(int(there.sum()), np.int64))
        counts = np.stack([sparse.sums(self.counts[of_texts.columns, c], of_texts.starts) for c in range(4)], axis=1)
        digests = [hashlib.sha256(";".join(map(self.spelling.__getitem__, x)).encode()).hexdigest() if ok and x else "" for ok, x in zip(spelt, named)]
        return counts, digests, sparse.product(of_texts, self.pairs, len(self.pair.bytes_a) * self.n_b_ids)


@functools.cache
def pair_of(byte_level: str, pieces: str) -> Pair:
    """One per Python worker."""
    return Pair(byte_level, pieces)


@functools.cache
def segments_of(byte_level: str, pieces: str) -> Segments:
    return Segments(pair_of(byte_level, pieces))


def groups_of(texts: Iterable[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def lists(rows: Rows, values: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(rows.starts), pa.array(values)).cast(pa.list_(pa.int64()))


def aligned(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """(doc_id, a, b, a_group, b_group, overlaps) per row of ``docs``: ids of both tokenizers, the group of each token, from
    0, and overlap links (place in a, place in b, shared bytes). Texts are encoded whole, one by one."""
    schema = "doc_id bigint, a array<bigint>, b array<bigint>, a_group array<bigint>, b_group array<bigint>, overlaps array<struct<a:bigint,b:bigint,bytes:bigint>>"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(byte_level, pieces)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                found = Aligned(*pair.encode([text.as_py()] if text.as_py() else []))
                columns = [found.a.ids, found.b.ids, found.group_a, found.group_b]
                links = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in found.links], names=["a", "b", "bytes"])
                whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), *[whole(pa.array(c)) for c in columns], whole(links)],
                                                 names=["doc_id", "a", "b", "a_group", "b_group", "overlaps"])
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(align, schema)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
SUMMARY = f"row bigint, doc_id bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, groups_sha256 string"


def linked(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """Per row of ``docs``: a number of its own, doc_id, the counts and the digest of its groups, and its distinct linked pairs of
    ids, as A id times the number of B ids plus B id, with their numbers of links. To be written before it is read twice."""
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = segments_of(byte_level, pieces)
        for batch in batches:
            at = 0
            for group in groups_of(x.as_py() or "" for x in batch.column(2)):
                counts, digests, pairs = store.texts(group)
                keys = batch.slice(at, len(group))
                at += len(group)
                yield pa.RecordBatch.from_arrays(
                    [keys.column(0), keys.column(1), *[pa.array(counts[:, c]) for c in range(4)], pa.array(digests, pa.string()),
                     lists(pairs, pairs.columns), lists(pairs, pairs.values)],
                    names=["row", "doc_id", *COUNTS, "groups_sha256", "pairs", "links"])
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return numbered.mapInArrow(link, f"{SUMMARY}, pairs array<bigint>, links array<bigint>")


def pair_counts(links: DataFrame, n_b_ids: int) -> DataFrame:
    """(pair, n, best): how many texts hold a pair, and whether no other pair of its A id is held by more."""
    counted = materialised(links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    a_id = F.floor(F.col("pair") / n_b_ids)
    highest = counted.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("highest"))
    # At most one row per entry of A's vocabulary.
    return counted.join(F.broadcast(highest), a_id == F.col("a_id")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def hot_bound(counts: DataFrame, limit: int = HOT_PAIRS) -> int:
    """The least count from which on there are at most ``limit`` pairs, to within an eighth."""
    step = F.floor(F.log2("n") * 8)
    sizes = counts.groupBy(step.cast("int").alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    room, bound = limit, None
    for row in sizes:
        room -= row["pairs"]
        if room < 0:
            break
        bound = row["least"]
    return bound if bound is not None else 1 << 62


@functools.lru_cache(1)
def hot_table(folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in order with their counts and marks; one per Python worker."""
    import pyarrow.parquet as pq
    system, path = opened(folder)
    table = pq.read_table(path, filesystem=system).sort_by("pair")
    return table["pair"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy().astype(np.int64)


def with_hot_counts(links: DataFrame, folder: str) -> DataFrame:
    """The summary of each row with the links that are best and the sum of counts over the hot pairs, and its other pairs."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = hot_table(folder)
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("links")
            codes, links = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            starts = bounds(pairs.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(keys, codes), max(len(keys) - 1, 0))
            hot = keys[at] == codes if len(keys) else np.zeros(len(codes), bool)
            at = at[hot]
            hot_links = links[hot]
            totals = []
            for values in (hot_links * best[at], hot_links * n[at]):
                whole = np.zeros(len(codes), np.int64)
                whole[hot] = values
                totals.append(pa.array(sparse.sums(whole, starts)))
            cold = Rows(bounds(sparse.sums((~hot).astype(np.int64), starts)), codes[~hot], links[~hot])
            out = [batch.column(c) for c in ("row", "doc_id", *COUNTS, "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*out, *totals, lists(cold, cold.columns), lists(cold, cold.values)],
                                             names=["row", "doc_id", *COUNTS, "groups_sha256", "n_best", "count_sum", "pairs", "links"])
    return links.mapInArrow(score, f"{SUMMARY}, n_best bigint, count_sum bigint, pairs array<bigint>, links array<bigint>")


def summaries(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of ``docs``."""
    n_b_ids = len(pair_of(byte_level, pieces).bytes_b)
    links = materialised(linked(docs, byte_level, pieces), "linked")
    counts = materialised(pair_counts(links, n_b_ids), "pairs")
    bound = hot_bound(counts, hot_pairs)
    materialised(counts.filter(F.col("n") >= bound), "hot-pairs")
    folder = scratch()[-1]
    scored = materialised(with_hot_counts(links, folder), "scored")
    cold = scored.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", "x.pairs", "x.links")
    more = cold.join(counts.filter(F.col("n") < bound), F.col("pairs") == F.col("pair")).groupBy("row").agg(
        F.sum(F.col("links") * F.col("best").cast("bigint")).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    added = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return scored.drop("pairs", "links").join(more, "row", "left").select(
        "doc_id", *COUNTS, added("n_best", "more_best"), added("count_sum", "more_sum"), "groups_sha256")
