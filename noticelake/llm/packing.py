"""Operator 10: documents packed into token sequences by cutting-stock column generation.

Each document's ids are cut at multiples of the sequence length; what remains is shorter than a sequence.
The histogram of those lengths, in classes of a few tokens, is a cutting-stock problem: a linear program
over patterns (how many pieces of each class share a sequence), whose columns a knapsack dynamic program
prices. The rounded patterns make slots, and the pieces, ranked within their class, take them. Only the
histogram, one row a length, reaches the driver.
"""

import json
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, table

SEQUENCE = 2048
END_ID = 1
#: Tokens in a length class: a sequence loses half of it a piece on average.
STEP = 8
#: Ranks within a class are counted in so many parts at least, and so many pieces a part on average at most,
#: so a frequent length isn't one task's work.
RANK_PARTS, RANK_PIECES = 256, 100_000
#: A worker remembers the ids of about so many words, then starts anew.
CACHED_WORDS = 600_000
#: Bytes of text encoded at a time.
PART_BYTES = 8 << 20
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: The linear program ends within this share of the best, or after so many rounds.
CLOSE, MAX_ROUNDS = 0.001, 400


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts, from remembered ids of words.

    The tokenizer replaces white space, lower-cases, and cuts texts into runs of letters, single digits and
    runs of other characters; none of its ids spans two of them. So a text's ids are those of its words, one
    after another, and a word's are those of its runs. Words are taken apart only where the tokenizer itself
    shows that each character beyond ASCII stays a letter; any other word is encoded whole, as it stands. A
    tokenizer of another make (`splits_at_blanks` is false) encodes whole texts.
    """

    #: The tokenizer's own runs, in a word whose A-Z are lower-cased and whose characters beyond ASCII are letters.
    RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\U0010ffff]+|[0-9]|[^\x09-\x0d\x20a-z0-9\x80-\U0010ffff]+")

    def __init__(self, path: str, cached_words: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.lean, self.room = Tokenizer.from_file(path), Tokenizer.from_file(path), cached_words
        with open(path, encoding="utf-8") as file:
            self.by_words = splits_at_blanks(json.load(file))
        # encodes runs that are parted by spaces, lower-cased and normalised already
        self.lean.normalizer = None
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(tokens.values()) + 1, bool)
        self.ends_word[[i for token, i in tokens.items() if token.endswith("</w>")]] = True
        self.simple, self.odd = set(map(chr, range(128))), set()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # word or run: its row in `spans`
        self.ids, self.used, self.spans = np.zeros(1024, "<u4"), 0, np.zeros((0, 2), np.int64)

    def _keep(self, words: Iterable[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(ids), "<u4")])
        self.ids[self.used : self.used + len(ids)] = ids
        self.known |= zip(words, range(len(self.spans), len(self.spans) + len(sizes)))
        self.spans = np.concatenate([self.spans, np.stack([self.used + sizes.cumsum() - sizes, sizes], 1)])
        self.used += len(ids)

    def _is_simple(self, word: str) -> bool:
        """Whether the tokenizer takes all characters beyond ASCII for nothing but letters."""
        if not self.simple.issuperset(word):
            for c in set(word) - self.simple - self.odd:
                cut = [self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(t)) for t in (f"a{c}a.", f"{c}.")]
                alone = all(len(parts) == 2 and parts[1][0] == "." for parts in cut)  # no digit (first), no mark (second)
                (self.simple if alone else self.odd).add(c)
            if not self.simple.issuperset(word):
                return False
        return unicodedata.is_normalized("NFC", word)

    def _runs(self, word: str) -> str | list[str]:
        """The one run that a word is, or its runs, A-Z lower-cased; none if it must be encoded whole."""
        if word.isascii():
            if word.isalpha():
                return word.lower()
            return [] if "<|" in word else self.RUNS.findall(word.lower())
        if "<|" in word or not self._is_simple(word):
            return []
        low = word if word.islower() else word.translate(LOWER)
        return low if low.isalpha() else self.RUNS.findall(low)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts in one array, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), "<u4"), np.array(list(map(len, found)), np.int64)

    def _learn(self, runs: list[str]) -> None:
        packs = [" ".join(runs[at : at + 256]) for at in range(0, len(runs), 256)]  # many runs in one call
        packs = [p if p.isascii() else self.tokenizer.normalizer.normalize_str(p) for p in packs]
        found = self.lean.encode_batch_fast(packs, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1  # each run ends with an id that ends a word
        if len(ends) != len(runs) or (len(ends) and ends[-1] != len(ids)):
            raise ValueError("the tokenizer took a run apart")
        self._keep(runs, ids, np.diff(ends, prepend=0))

    def _rows(self, words: list[str]) -> np.ndarray:
        """The row in `spans` of each of the distinct words."""
        rows = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(rows < 0)
        new = [words[i] for i in at.tolist()]
        split = list(map(self._runs, new))
        whole = [w for w, runs in zip(new, split, strict=True) if not runs]
        self._keep(whole, *self._plain(whole))
        runs, n = [], []
        for word, parts in zip(new, split, strict=True):
            if type(parts) is str:
                runs.append(parts)
                n.append(1)
            else:
                runs += parts or [word]
                n.append(len(parts) or 1)
        self._learn(list(set(runs).difference(self.known)))
        row, n = np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs)), np.array(n, np.int64)
        one = n == 1
        rows[at[one]] = row[(n.cumsum() - n)[one]]
        rows[at[~one]] = np.arange(len(self.spans), len(self.spans) + (~one).sum())
        spans = self.spans[row[np.repeat(~one, n)]]
        ends = np.r_[0, spans[:, 1].cumsum()][n[~one].cumsum()]
        self._keep(compress(new, ~one), self._gathered(spans), np.diff(ends, prepend=0))
        self.known |= zip(compress(new, one), rows[at[one]].tolist(), strict=True)
        return rows

    def _gathered(self, spans: np.ndarray) -> np.ndarray:
        """The ids of spans (start, length), one after another."""
        before = spans[:, 1].cumsum() - spans[:, 1]
        at = np.repeat(spans[:, 0] - before, spans[:, 1])
        at += np.arange(len(at))
        return self.ids[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts (strings, no nulls) in one array, and where in it each text's end."""
        if not self.by_words:
            ids, sizes = self._plain(texts.to_pylist())
            return ids, sizes.cumsum()
        if len(self.known) > self.room:
            self._forget()
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        rows = self._rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        spans = self.spans[rows[coded.indices.to_numpy()]]
        ends = np.r_[0, spans[:, 1].cumsum()]
        return self._gathered(spans), ends[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]


def splits_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer file describes the steps that `WordEncoder` relies on."""
    steps = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    runs = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
    cut = [{"type": "Split", "pattern": runs, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    model, special = spec.get("model") or {}, spec.get("added_tokens") or []
    marks = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]) for t in special)
    plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    return plain and marks and spec.get("normalizer") == {"type": "Sequence", "normalizers": steps} and spec.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": cut}


def text_parts(batch: pa.RecordBatch, part_bytes: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about so many bytes of text, of one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + part_bytes, "right")))
        yield batch.slice(at, end - at)
        at = end


@cache
def _encoder(path: str) -> WordEncoder:
    """One for each worker process and tokenizer."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each row's ids, cut at multiples of `sequence`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for part in text_parts(batch):
                ids, ends = encoder.encode(pc.fill_null(part.column(1), "").cast(pa.string()))
                ids = np.insert(ids, ends, END_ID).astype("<u4", copy=False)
                ends = ends + np.arange(1, len(ends) + 1)
                tokens = np.diff(ends, prepend=0)
                n = -(-tokens // sequence)
                row = np.repeat(np.arange(len(n)), n)
                start = (np.arange(len(row)) - np.repeat(n.cumsum() - n, n)) * sequence
                length = np.minimum(tokens[row] - start, sequence)
                at = (ends - tokens)[row] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [part.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens[row]))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:  # pieces follow one another in `ids`
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[at, len(ids)].astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *fields]))


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes, within `room` in all, of the largest total value: an unbounded knapsack."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        fit = np.searchsorted(sizes, c, "right")
        if fit:
            worth = best[c - sizes[:fit]] + values[:fit]
            i = int(worth.argmax())
            if worth[i] > best[c] + 1e-12:
                best[c], pick[c] = worth[i], i
    counts, c = np.zeros(len(sizes)), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[room]), counts


def first_basis(need: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """As many patterns as sizes: each is filled largest first, and used until one of its sizes is met."""
    left, open_, basis = need.copy(), np.ones(len(sizes), bool), np.zeros((len(sizes), len(sizes)))
    for turn in range(len(sizes)):
        free = room
        for i in np.flatnonzero(open_)[::-1]:
            basis[i, turn] = fit = min(free // sizes[i], max(1, np.ceil(left[i])))
            free -= fit * sizes[i]
        used = np.flatnonzero(basis[:, turn])
        copies = left[used] / basis[used, turn]
        left[used] -= copies.min() * basis[used, turn]
        open_[used[copies.argmin()]] = False
    return basis


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan elimination, in one thread: a few hundred rows, often beside busy tasks."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        swap = i + int(np.abs(both[i:, i]).argmax())
        both[[i, swap]] = both[[swap, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        both -= factor[:, None] * both[i]
    return both[:, n:]


def cutting_stock(demand: dict[int, int], room: int, max_rounds: int = MAX_ROUNDS) -> list[tuple[dict[int, int], int]]:
    """[(pattern: size -> count, copies)] that offers at least `demand` (size -> count) in few bins of `room`."""
    sizes = np.array(sorted(s for s, n in demand.items() if n), int)
    if not len(sizes):
        return []
    need = np.array([demand[s] for s in sizes], float)
    basis = first_basis(need, sizes, room)
    inverse, cost = _inverse(basis), np.ones(len(sizes))
    x = (inverse * need).sum(1)
    for turn in range(max_rounds):
        dual = (cost[:, None] * inverse).sum(0)
        if (spare := int(dual.argmin())) >= 0 and dual[spare] < -1e-9:  # a size may be offered more often than needed
            column, price = -np.eye(len(sizes))[spare], 0.0
        else:
            value, column = best_pattern(np.maximum(dual, 0), sizes, room)
            price = 1.0
            if value <= 1 + CLOSE:  # the sum of x is then within this share of the least
                break
        way = (inverse * column).sum(1)
        up = way > 1e-9
        if not up.any():
            break
        leave = int(np.where(up, x / np.where(up, way, 1), np.inf).argmin())
        basis[:, leave], cost[leave] = column, price
        if turn % 50 == 49:
            inverse = _inverse(basis)
        else:
            row = inverse[leave] / way[leave]
            inverse = inverse - np.outer(way, row)
            inverse[leave] = row
        x = np.maximum((inverse * need).sum(1), 0)
    x = np.where(cost > 0, x, 0)
    whole = np.floor(x + 1e-9)
    rest = np.maximum(np.rint(need - (np.maximum(basis, 0) * whole).sum(1)), 0).astype(int)
    found = [({int(s): int(c) for s, c in zip(sizes, basis[:, i], strict=True) if c > 0}, int(n)) for i, n in enumerate(whole) if n]
    bins: list[tuple[int, Counter]] = []
    for s, n in sorted(zip(sizes.tolist(), rest.tolist(), strict=True), reverse=True):  # first fit, largest first
        for _ in range(n):
            at = next((i for i, (free, _) in enumerate(bins) if free >= s), None)
            if at is None:
                bins.append((room, Counter()))
                at = len(bins) - 1
            bins[at] = (bins[at][0] - s, bins[at][1] + Counter([s]))
    return found + [(dict(pattern), 1) for _, pattern in bins]


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """size -> rows (first rank, first sequence, pieces in a sequence), by rank: who takes which sequence."""
    taken, rows, sequence = Counter(), {}, 0
    for pattern, copies in patterns:
        for s, count in pattern.items():
            rows.setdefault(s, []).append((taken[s], sequence, count))
            taken[s] += count * copies
        sequence += copies
    return {s: np.array(r, np.int64) for s, r in rows.items()}


def assign(cut: DataFrame, sequence: int = SEQUENCE, step: int = STEP) -> DataFrame:
    """The pieces `cut` (a stored table with length, at most `sequence`) with sequence_id and offset."""
    step = step if sequence % step == 0 else 1
    size = F.ceil(F.col("length") / step).cast("int")
    counts = {r["size"]: r["count"] for r in cut.groupBy(size.alias("size")).count().collect()}  # sequence / step rows at most
    full = sequence // step
    patterns = cutting_stock({s: n for s, n in counts.items() if s < full}, full)
    where = slots(patterns + [({full: 1}, counts.get(full, 0))])
    key = [c for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens") if c in cut.columns]
    parts = {s: max(RANK_PARTS, n // RANK_PIECES) for s, n in counts.items()}
    many = F.element_at(F.create_map(*[F.lit(x) for item in parts.items() for x in item]), F.col("size")) if parts else F.lit(1)
    rows = cut.withColumn("size", size).withColumn("part", F.pmod(F.xxhash64(*key), many).cast("int"))
    before = rows.groupBy("size", "part").count()  # as many rows as parts: one for RANK_PIECES pieces, and 66,000
    before = before.withColumn("before", F.sum("count").over(W.partitionBy("size").orderBy("part")) - F.col("count"))
    ranked = rows.join(F.broadcast(before.select("size", "part", "before")), ["size", "part"])
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("size", "part").orderBy(*key)) - 1 + F.col("before"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rank = (batch.column(c).to_numpy() for c in ("size", "rank"))
            out = np.zeros(len(rank), np.int64)
            for s in np.unique(sizes):
                mine = sizes == s
                at = np.searchsorted(where[s][:, 0], rank[mine], "right") - 1
                first, start, count = where[s][at].T
                out[mine] = start + (rank[mine] - first) // count
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "sequence_id"])

    placed = ranked.drop("part", "before").mapInArrow(
        place, T.StructType([*ranked.drop("part", "before").schema.fields, T.StructField("sequence_id", T.LongType())])
    )
    inside = W.partitionBy("sequence_id").orderBy(F.desc("size"), "rank")
    offset = F.sum("length").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("length")
    return placed.withColumn("offset", offset).drop("size", "rank")


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, step: int = STEP, with_ids: bool = False) -> DataFrame:
    """One row per piece of `docs` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    A document's ids are its text's, then END_ID; a null or empty text has that one alone. Each id lies in
    one piece, and a piece in one sequence of at most `sequence` tokens, its offset following the piece
    before. Repeated rows are packed each; other columns are ignored; an empty table gives no piece.
    """
    return assign(saved(pieces(docs, tokenizer or default_tokenizer(), sequence, with_ids), "pieces"), sequence, step)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": query}
ORACLE_SQL: dict[str, str] = {}
