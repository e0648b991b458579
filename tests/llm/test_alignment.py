"""Token alignment against loops over bytes and tokens."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noticelake.llm import alignment, common

from ..oracle import DATA

CLASH = ["n_a", "links", "row", "code", "n", "best", "rest", "groups_sha256"]
EDGE = [
    None, "", " ", "  two  spaces ", "a", "a b", "Same text, twice over.", "Same text, twice over.", "tab\tand\nlines\r\n and more", "ÀÉ straße naïve ɏ x", "日本語のテキスト と 空白", "<|endoftext|> in <|endoftext|>text",
    "▁ of B", "a ▁b", "ﬁ ligature ①", "\x00 \x01null", "　wide  blank", "don't 's 123 4567.89", "emoji 👩‍👩‍👧 x", "x" * 3000, "word " * 4000, "é combining ́", "a  b   c", "</s> <unk> <0x41>",
]


def slow(texts):
    path_a, path_b = alignment.default_tokenizers()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    shown = {i: bytes(alphabet[c] for c in t) for t, i in a.get_vocab().items() if set(t) <= set(alphabet)}
    rows = []
    for text in texts:
        if not text:
            rows.append(None)
            continue
        ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        parts_a = [shown[i] for i in ids_a]
        parts_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if not b"".join(parts_a) == b"".join(parts_b) == f" {text}".encode():
            rows.append(None)
            continue
        at_a, at_b = ([i for i, p in enumerate(parts) for _ in p] for parts in (parts_a, parts_b))  # the token of each byte
        links = sorted(set(zip(at_a, at_b, strict=True)))
        groups, group = [], (set(), set())
        for at, (i, j) in enumerate(zip(at_a, at_b, strict=True)):
            group[0].add(i), group[1].add(j)
            if at + 1 == len(at_a) or (at_a[at + 1] != i and at_b[at + 1] != j):
                groups.append(group)
                group = (set(), set())
        text = ";".join("|".join(",".join(str(ids[i]) for i in sorted(side)) for side, ids in zip(g, (ids_a, ids_b), strict=True)) for g in groups)
        rows.append((len(ids_a), len(ids_b), len(groups), hashlib.sha256(text.encode()).hexdigest(), [(ids_a[i], ids_b[j]) for i, j in links]))
    counts = Counter(p for r in rows if r for p in set(r[4]))
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(most.get(i, 0), n)
    for r in rows:
        if not r:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            yield r[0], r[1], r[2], len(r[4]), sum(counts[p] == most[p[0]] for p in r[4]), sum(counts[p] for p in r[4]), r[3]


OUT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize(("hot", "counted"), [(500_000, 1_000_000), (20, 50), (0, 50)])
def test_alignment(spark, monkeypatch, hot, counted):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    monkeypatch.setattr(alignment, "COUNTED_PAIRS", counted)
    rng = random.Random(4)
    alphabet = "ab  \n'.1éß日▁Á 😀"
    texts = EDGE + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(80)]
    ids = [None, *range(len(texts) - 1)]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH}).repartition(5)
    found = sorted((str(r["doc_id"]), *(r[c] for c in OUT)) for r in alignment.align(df).collect())
    assert found == sorted((str(i), *row) for i, row in zip(ids, slow(texts), strict=True))


def test_query_against_loops(spark):
    rows = common.table(spark, DATA, "documents").select("doc_id", "text").collect()
    found = sorted((r["doc_id"], *(r[c] for c in OUT)) for r in alignment.query(spark, DATA).collect())
    assert found == sorted((r["doc_id"], *row) for r, row in zip(rows, slow([r["text"] for r in rows]), strict=True))
    assert sum(r[3] for r in found) > 10_000


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_terminals():
    import numpy as np

    ends_a, ends_b = np.array([2, 3, 7, 9, 12]), np.array([1, 5, 9, 10, 11, 12])
    ends = alignment.terminals(alignment.successors(ends_a, ends_b))
    assert ends.tolist() == [3, 3, 3, 3, 4, 3, 3, 3, 4, 4, 4]


def test_cache_starts_anew():
    aligner = alignment.Aligner(*alignment.default_tokenizers(), cached_links=5)
    first = [list(aligner.align([t])) for t in EDGE]
    assert first == [list(aligner.align([t])) for t in EDGE]
    whole = alignment.Aligner(*alignment.default_tokenizers())
    assert [r for rows in first for r in rows] == list(whole.align(EDGE))
