"""Operator 13: tokens of two tokenizers aligned by pointer jumping.

Both tokenizers cut the same bytes. Every token points to the farthest-right token of the other tokenizer that
overlaps it; of two that end at the same byte, the first tokenizer's points to itself. Doubling all successors at
once, until none changes, leads each token to the terminal token of its group, which labels the group. A text is cut
at single spaces between visible characters, where both tokenizers always start a token, and each distinct piece is
encoded and aligned once a worker.
"""

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, slices, table
from .packing import text_parts

#: Links of the most frequent id pairs, so many at most, are counted beside the documents; all others by a join.
HOT_PAIRS = 500_000
#: A worker remembers pieces of about so many links, and counts about so many id pairs before it hands them on.
CACHED_LINKS, COUNTED_PAIRS = 1_500_000, 500_000
#: Pieces encoded, and bytes of texts aligned, at a time.
LEARNT, TEXT_BYTES = 8192, 2 << 20
#: Rows whose links are counted at a time.
COUNTED_ROWS = 1000
#: A single space between two of these characters starts a token in both tokenizers.
CUT = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def successors(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For each token (those of A, then those of B): the farthest-right token that overlaps it, of equal ends A's."""
    to_b = np.searchsorted(ends_b, ends_a)  # B's token that holds the last byte of A's
    own = np.arange(len(ends_a))
    return np.concatenate([np.where(ends_b[to_b] > ends_a, len(ends_a) + to_b, own), np.searchsorted(ends_a, ends_b)])


def terminals(successor: np.ndarray) -> np.ndarray:
    """The end of each token's chain: successors of successors, until they stay."""
    while True:
        further = successor[successor]
        if (further == successor).all():
            return successor
        successor = further


class Aligner:
    """Groups and links of texts, from remembered ones of pieces."""

    def __init__(self, path_a: str, path_b: str, cached_links: int = CACHED_LINKS) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        alphabet, vocabulary = byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = alphabet.keys() >= set(token)
            self.bytes_a[i] = bytes(map(alphabet.__getitem__, token)) if known else token.encode()
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # an id and what follows it in the groups' text; the last of a piece ends a line
        self.names = [f"{i}{mark}" for i in range(len(self.bytes_a)) for mark in ",|"] + [f"{i}{mark}" for i in range(len(self.bytes_b)) for mark in ",;\n"]
        self.room = cached_links
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []  # of each piece
        self.counts = np.zeros((0, 5), np.int64)  # of each piece: tokens of A and B, groups, start and number of its links; zeros where the tokens don't give back its bytes
        self.links, self.used = np.zeros(0, self.code_type), 0

    def tokens(self, pieces: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """A's and B's ids of all pieces with how many each piece has, and whether both give back a space and the piece."""
        a = [e.ids for e in self.a.encode_batch_fast([f" {p}" for p in pieces], add_special_tokens=False)]
        b = self.b.encode(pieces, num_threads=1) if pieces else []
        found = [(np.fromiter(chain.from_iterable(x), np.int64), np.array(list(map(len, x)), np.int64)) for x in (a, b)]
        sizes = np.array(list(map(len, map(str.encode, pieces))), np.int64) + 1
        raw = "".join(f" {p}" for p in pieces).encode()
        ends, good = sizes.cumsum(), np.ones(len(pieces), bool)
        for (ids, n), known, known_sizes in zip(found, (self.bytes_a, self.bytes_b), (self.sizes_a, self.sizes_b), strict=True):
            got = np.concatenate([[0], known_sizes[ids].cumsum()])[n.cumsum()]
            parts = list(map(known.__getitem__, ids.tolist()))
            if (got == ends).all() and b"".join(parts) == raw:
                continue
            at = n.cumsum().tolist()  # else one by one
            good &= [b"".join(parts[i:j]) == raw[k:m] for i, j, k, m in zip([0, *at], at, [0, *ends.tolist()], ends.tolist(), strict=False)]
        return found, good

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), LEARNT):
            self._learn_some(pieces[at : at + LEARNT])

    def _learn_some(self, pieces: list[str]) -> None:
        found, good = self.tokens(pieces)
        (ids_a, n_a), (ids_b, n_b) = ((ids[np.repeat(good, n)], n[good]) for ids, n in found)
        ends_a, ends_b = self.sizes_a[ids_a].cumsum(), self.sizes_b[ids_b].cumsum()
        closes = np.concatenate([[0], ends_a])[n_a.cumsum()]  # the byte after each piece
        last = np.unique(terminals(successors(ends_a, ends_b)))  # a terminal token a group, in order: A's, as A wins ties
        group_ends = ends_a[last]
        cuts = np.union1d(ends_a, ends_b)  # between two cuts one token of each: a link
        links = ids_a[np.searchsorted(ends_a, cuts)].astype(np.uint64) * np.uint64(len(self.bytes_b)) + ids_b[np.searchsorted(ends_b, cuts)].astype(np.uint64)
        links = links.astype(self.code_type)
        group_at, link_at = (np.concatenate([[0], np.searchsorted(e, closes, "right")]) for e in (group_ends, cuts))
        counts, groups = np.zeros((len(pieces), 5), np.int64), [""] * len(pieces)
        counts[good] = np.stack([n_a, n_b, np.diff(group_at), self.used + link_at[:-1], np.diff(link_at)], 1)
        for i, shown in zip(np.flatnonzero(good).tolist(), self._shown(ids_a, ids_b, *(np.searchsorted(e, group_ends, "right") for e in (ends_a, ends_b)), group_at[1:] - 1), strict=True):
            groups[i] = shown
        self.known |= zip(pieces, range(len(self.groups), len(self.groups) + len(pieces)), strict=True)
        self.counts, self.links = _grown(self.counts, len(self.groups), counts), _grown(self.links, self.used, links)
        self.used += len(links)
        self.groups += groups

    def _shown(self, ids_a: np.ndarray, ids_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, closing: np.ndarray) -> list[str]:
        """The groups of each piece as text; in_a, in_b: where in the ids each group ends, closing: each piece's last group."""
        if not len(closing):
            return []
        first_a, first_b = np.concatenate([[0], in_a[:-1]]), np.concatenate([[0], in_b[:-1]])
        parts = np.zeros(len(ids_a) + len(ids_b), np.int64)
        mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        mark_a[in_a - 1], mark_b[in_b - 1] = 1, 1
        mark_b[in_b[closing] - 1] = 2
        parts[np.arange(len(ids_a)) + np.repeat(first_b, in_a - first_a)] = 2 * ids_a + mark_a
        parts[np.arange(len(ids_b)) + np.repeat(in_a, in_b - first_b)] = 2 * len(self.bytes_a) + 3 * ids_b + mark_b
        return "".join(map(self.names.__getitem__, parts.tolist())).split("\n")[:-1]

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, bytes]]:
        """(n_a, n_b, n_groups, n_links, digest of the groups, links as id of A x size of B + id of B) of each text."""
        if self.used > self.room:
            self._forget()
        cut = [CUT.split(t) if t else [] for t in texts]
        self._learn(list(set(chain.from_iterable(cut)).difference(self.known)))
        for text, pieces in zip(texts, cut, strict=True):
            rows = list(map(self.known.__getitem__, pieces))
            counts = self.counts[rows]
            if not counts[:, 0].all():  # bytes that one piece's tokens lose, another's might add: then the whole text decides
                if text not in self.known:
                    self._learn([text])
                rows = [self.known[text]]
                counts = self.counts[rows]
            n_a, n_b, n_groups, _, n_links = counts.sum(0).tolist()
            if not n_a:
                yield 0, 0, 0, 0, "", b""
                continue
            groups = map(self.groups.__getitem__, rows)
            starts, sizes = counts[:, 3], counts[:, 4]
            at = np.repeat(starts - (sizes.cumsum() - sizes), sizes) + np.arange(n_links)
            yield n_a, n_b, n_groups, n_links, hashlib.sha256(";".join(groups).encode()).hexdigest(), self.links[at].tobytes()

    @property
    def code_type(self) -> str:
        return code_type(len(self.bytes_a), len(self.bytes_b))


def _grown(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """`held`, of which `used` count, with `more` after these; room grows by half."""
    if used + len(more) > len(held):
        held = np.concatenate([held[:used], np.zeros((used // 2 + len(more), *held.shape[1:]), held.dtype)])
    held[used : used + len(more)] = more
    return held


def code_type(size_a: int, size_b: int) -> str:
    return "<u4" if size_a * size_b <= 1 << 32 else "<u8"


@cache
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process and two tokenizers."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Aligner(path_a, path_b)


def _column(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All links of a batch, and how many each row has."""
    blobs = batch.column(batch.schema.get_field_index("links")).to_pylist()
    links = np.frombuffer(b"".join(blobs), kind).astype(np.int64)
    return links, np.array(list(map(len, blobs)), np.int64) // np.dtype(kind).itemsize


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(code), np.int64)
    np.add.at(total, inverse, np.concatenate(counts))
    return code, total


def pair_counts(aligned: DataFrame, kind: str) -> DataFrame:
    """(code, n): in how many rows each id pair is linked; workers count before they hand on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _merged(codes, counts)], ["code", "n"])

        for batch in slices(batches, COUNTED_ROWS):
            links, sizes = _column(batch, kind)
            if not len(links):
                continue
            code, inverse = np.unique(links, return_inverse=True)
            row = np.repeat(np.arange(len(sizes)), sizes)
            once = np.unique(row * len(code) + inverse) % len(code)  # each pair once a row
            codes.append(code)
            counts.append(np.bincount(once, minlength=len(code)))
            held += len(code)
            if held > COUNTED_PAIRS:
                merged = _merged(codes, counts)
                codes, counts, held = [merged[0]], [merged[1]], len(merged[0])
                if held > COUNTED_PAIRS // 2:
                    yield out()
                    codes, counts, held = [], [], 0
        if codes:
            yield out()

    return aligned.select("links").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A (a byte-level tokenizer's file) encodes a space and the text, B (a sentencepiece model that adds the space) the
    text. Groups are the parts between bytes where tokens of both end; links are all pairs of overlapping tokens. An id
    pair's count: how many rows of `docs` have it linked. n_best: links whose count is the highest of their A id, ties
    included; count_sum: the counts of all links added up. groups_sha256: of `a1,a2|b1;a3|b2,b3`. Null and empty texts,
    and those whose tokens don't give back the text's bytes, have zeros and an empty digest. Repeated rows count each.
    Long texts are encoded whole, a part of a batch at a time. Other columns are ignored; an empty table gives an empty
    result.
    """
    path_a, path_b = (own or default for own, default in zip((tokenizer_a, tokenizer_b), default_tokenizers(), strict=True))
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            for part in text_parts(batch, TEXT_BYTES):
                found = list(aligner.align(part.column(1).to_pylist()))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                columns = [pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = "n_a long, n_b long, n_groups long, n_links long"
    aligned = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {longs}, groups_sha256 string, links binary")
    aligned = saved(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    return _counted(aligned, path_a, path_b)


def _counted(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    spark, (size_a, size_b) = aligned.sparkSession, vocabulary_sizes(path_a, path_b)
    kind = code_type(size_a, size_b)
    pairs = saved(pair_counts(aligned, kind), "pairs").withColumn("a", F.expr(f"code div {size_b}"))
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))  # as many rows as A has ids
    pairs = saved(pairs.join(F.broadcast(most), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "best")
    sizes = {r["bits"]: r["count"] for r in pairs.groupBy(F.length(F.bin("n")).alias("bits")).count().collect()}  # 64 rows at most
    least, n_hot = 64, 0
    while least > 0 and n_hot + sizes.get(least, 0) <= HOT_PAIRS:
        n_hot += sizes.get(least, 0)
        least -= 1
    frequent = F.length(F.bin("n")) > least
    hot = pairs.where(frequent).toPandas().sort_values("code")  # HOT_PAIRS rows at most
    hot = spark.sparkContext.broadcast(tuple(hot[c].to_numpy(t) for c, t in (("code", np.int64), ("n", np.int64), ("best", bool))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = hot.value
        for batch in slices(batches, COUNTED_ROWS):
            links, sizes = _column(batch, kind)
            at = np.minimum(np.searchsorted(codes, links), max(0, len(codes) - 1))
            found = codes[at] == links if len(codes) else np.zeros(len(links), bool)
            value, wins = np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
            value[found], wins[found] = counts[at[found]], best[at[found]]
            ends = sizes.cumsum()
            sums = [np.diff(np.concatenate([[0], x.cumsum()])[ends], prepend=0) for x in (wins, value)]
            missed = np.concatenate([[0], (~found).cumsum()])[ends]
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], missed]), pa.int32()), pa.array(links[~found]))
            row = batch.schema.get_field_index("links")
            columns = [c for i, c in enumerate(batch.columns) if i != row]
            names = [n for n in batch.schema.names if n != "links"]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sums), rest], [*names, "n_best", "count_sum", "rest"])

    shape = ", ".join(f"`{n}` {t}" for n, t in aligned.dtypes if n != "links")
    done = aligned.mapInArrow(run, f"{shape}, n_best long, count_sum long, rest array<long>")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not least:
        return done.select(out)
    # each pair that is left has at most two of HOT_PAIRS of all counts: no key is frequent
    done = saved(done, "counted")
    cold = done.select("row", F.explode("rest").alias("code")).join(pairs.where(~frequent), "code")
    cold = cold.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("best").cast("long")).alias("more_best"))
    joined = done.join(cold, "row", "left")
    add = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}
    return joined.withColumns(add).select(out)


@cache
def vocabulary_sizes(path_a: str, path_b: str) -> tuple[int, int]:
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a).get_vocab(with_added_tokens=True)
    return max(a.values()) + 1, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op13_token_alignment": query}
ORACLE_SQL: dict[str, str] = {}
