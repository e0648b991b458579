"""Each operator on small tables: nulls, empty and long texts, repeats, ties, clashing columns; brute force where SQL can't tell."""

import gzip
import hashlib
import io
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noticelake.llm import ann, common, components, decontaminate, ftrl, langid, license_scan, line_dedup, packing, quality, simhash, url_filter, warc

from ..oracle import DATA, check

CLASH = ["did", "h", "w", "fp", "rank", "count", "size", "part", "key", "word", "node", "score", "labels", "n_lines", "block", "h1", "raw", "tok", "pos"]


def docs(spark, texts, ids=None, extra=True):
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in CLASH}) if extra else df


EDGE = [None, "", "   \n\n ", "one", "a b", "A  b", "x " * 20000, "é́ ΑΣ <|endoftext|> \x01 \x1c", "same text here", "same text here", "ALL RIGHTS reserved\nCC by"]


@pytest.mark.parametrize("name", ["op2_warc", "op4_line_dedup", "op6_decontaminate", "op7_url_filter", "op9_license_scan"])
def test_against_sql(spark, name):
    from noticelake import llm

    queries, sql = llm.gather()
    check(spark, queries[name], sql[name])


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(ids, fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices(["on", "er", "The", "queaux", "zu"], k=60)) for _ in range(25)]
    near = [t.replace("zu", "ZU") + " on" * (i % 3) for i, t in enumerate(base)]
    texts = EDGE + base + near + base[:3]
    ids = [None, *range(100, 100 + len(texts) - 1)]
    found = simhash.near_duplicates(docs(spark, texts, ids)).collect()
    fps = [slow_fingerprint(t) for t in texts]
    expected = sorted(zip(map(str, ids), [f"{f:016x}" for f in fps], slow_components(ids, fps), strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in found) == expected
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n", [300, 10**6, 10**10])
def test_links_of_every_plan(spark, n):
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 150, dtype=np.uint64) * np.uint64(2)
    for i in range(75):
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(1, 6), replace=False).astype(np.uint64))
        fps[75 + i] = fps[i] ^ flips
    fps = np.unique(fps)
    plan = simhash.search_plan(fps, n)
    assert sum(t + 1 for _, t in plan) == simhash.RADIUS + 1
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    if sum(len(g) ** t for g, t in plan) > 2000:
        plan = simhash.search_plan(fps, 10**6)
    found = {frozenset((r["a"], r["b"])) for r in simhash.links(df, plan).collect()}
    signed = fps.view(np.int64).tolist()
    assert found == {frozenset((signed[i], signed[j])) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3}


def test_allocation_is_the_least():
    costs = np.array([[5.0, 9, 20, 50], [1, 30, 60, 99], [7, 8, 9, 10]])
    from itertools import product

    least = min(sum(costs[i][t] for i, t in enumerate(ts) if t >= 0) for ts in product(range(-1, 4), repeat=3) if sum(t + 1 for t in ts) == 4)
    assert simhash.allocate(costs, 3)[0] == least


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 201), (200, 202), (200, 203)]
    df = spark.createDataFrame(chain, "a long, b long")
    roots = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert all(roots[i] == 0 for i in range(41)) and roots[101] == 100 and roots[203] == 200
    assert components.components(df.limit(0)).count() == 0


def test_warc(spark):
    big = "é" * 200
    rows = [(3, "u3", big), (1, "u1", big), (1, "u1", big), (None, None, big), (2, "http://x/\n", "small"), (4, "u4", "small"), (5, None, None), (6, "u", ""), (7, "u", "y" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "payload", "least", "n")})
    manifest = warc.write_warc(pages, common.work_dir(spark, "warc"), archive_bytes=400)
    assert manifest.agg(F.sum("n")).first()[0] == len(rows)
    found = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], bytes(r["payload"]).decode() if r["payload"] is not None else None) for r in warc.read_warc(manifest).collect()), key=str)
    response = lambda p, t: (p, "response", None, len((t or "").encode()), t or "")
    assert found == sorted([(3, "revisit", 1, 400, None), response(1, big), response(1, big), (None, "revisit", 1, 400, None), response(2, "small"), response(4, "small"), response(5, None), response(6, ""), response(7, "y" * 300000)], key=str)
    assert warc.read_warc(warc.write_warc(pages.limit(0), common.work_dir(spark, "warc"))).count() == 0


def test_warc_framing():
    block = bytes(range(256)) * 999
    data = warc.record([("WARC-Type", "response"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")], block)
    assert gzip.decompress(data).endswith(block + b"\r\n\r\n")
    assert [b for _, b in warc.records(io.BytesIO(data + warc.record([("WARC-Type", "x")], b"")))] == [block, b""]
    for bad in (data[:-9], data[:50], warc.record([("WARC-Block-Digest", "sha256:00")], b"a"), gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"), gzip.compress(b"HTTP/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(io.BytesIO(bad)))


def test_line_dedup(spark):
    texts = ["Shared line one\nown a\nshort", " \tshared LINE one \nown b\nshort\nshared line one", None, "", "own b\n", "Shared line one"]
    df = docs(spark, texts, [5, 7, 8, None, 9, None])
    got = {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_shared_lines(df).collect()}
    assert got == {(5, "Shared line one\nown a\nshort", 3, 0), (7, "own b\nshort", 4, 2), (8, "", 1, 0), (None, "", 1, 0), (9, "own b\n", 2, 0), (None, "", 1, 1)}
    assert line_dedup.drop_shared_lines(df.limit(0)).count() == 0
    twice = docs(spark, ["a line of text"] * 2, [1, 1])
    assert [r["n_dropped"] for r in line_dedup.drop_shared_lines(twice).collect()] == [0, 0]


@pytest.mark.parametrize("hot_keys", [1000, 1])
def test_line_dedup_against_a_loop(spark, monkeypatch, hot_keys):
    """Frequent lines apart and not, other thresholds, helper names as columns, a long text."""
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    rng = random.Random(11)
    lines = [f"line number {i} of the text" for i in range(12)] + ["short", "", "  LINE number 3 of the text\t"]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(1, 9))) for _ in range(40)] + ["\n".join(["line number 1 of the text", "own"] * 3000)]
    ids = [rng.randint(0, 25) for _ in texts]
    df = docs(spark, texts, ids).withColumns({c: F.lit(c) for c in ("__did", "__lost", "did", "version", "lost", "lines", "first", "key")})
    for least in (2, 4):
        holders = {}
        for d, t in zip(ids, texts, strict=True):
            for line in t.split("\n"):
                if len(k := line.strip(" \t").lower()) >= 10:
                    holders.setdefault(k, set()).add(d)
        lost = lambda d, x: len(h := holders.get(x.strip(" \t").lower(), ())) >= least and d > min(h)
        wanted = sorted((d, "\n".join(x for x in t.split("\n") if not lost(d, x))) for d, t in zip(ids, texts, strict=True))
        got = line_dedup.drop_shared_lines(df, min_documents=least)
        assert got.columns == [c for c in df.columns if c not in ("text", "n_lines")] + ["text", "n_lines", "n_dropped"]
        rows = got.collect()
        assert sorted((r["doc_id"], r["text"]) for r in rows) == wanted and all(r["did"] == "did" and r["__lost"] == "__lost" for r in rows)


@pytest.mark.parametrize("hot_keys", [1000, 2])
def test_hubs_and_frequent_payloads(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    monkeypatch.setattr(warc, "HOT_KEYS", hot_keys)
    star = [(0 if i % 2 else 500, i) for i in range(1, 300)] + [(500, 600), (600, 0)]
    roots = components.components(spark.createDataFrame(star, "a long, b long")).collect()
    assert {r["root"] for r in roots} == {0} and len(roots) == 302
    html = ["y" * 150] * 40 + ["z" * 120] * 2 + ["short"] * 30 + [None] * 3
    pages = spark.createDataFrame([(100 - i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in warc.plan_revisits(pages).collect()}
    assert len(got) == 75 and got[61] is None and got[59] is None and got[60] == 59
    assert all(got[i] == 61 for i in range(62, 101)) and all(got[i] is None for i in range(26, 59))


def test_url_filter_in_shards(spark):
    """Many shards looked up in several passes; helper names as columns stay."""
    rows = spark.range(4000).select(F.concat(F.lit("k"), F.col("id") % 3000).alias("key"), "id").withColumns({c: F.lit(c) for c in ("h1", "h2", "shard", "is_listed")})
    listed = spark.range(0, 9000, 3).select(F.concat(F.lit("k"), "id").alias("key"))
    for lookup_bytes in (1, 700, 1 << 20):
        found = url_filter.mark_listed(rows, listed, 400, lookup_bytes).collect()
        assert len(found) == 4000 and all(r["is_listed"] == (int(r["key"][1:]) % 3 == 0) for r in found)
        assert all(r["h1"] == "h1" and r["h2"] == "h2" and r["shard"] == "shard" for r in found)


def test_ftrl_step_equals_a_loop():
    """One weight at a time, as the update is written down."""
    rng = np.random.default_rng(4)
    model = ftrl.FTRL(6, 3, l1=0.05)
    z, n = np.zeros((6, 3)), np.zeros((6, 3))
    for _ in range(40):
        at, values, target = rng.permutation(6)[:3], rng.normal(size=3), np.eye(3)[rng.integers(3)]
        w = np.zeros((6, 3))
        for i in range(6):
            for c in range(3):
                if abs(z[i, c]) > model.l1:
                    w[i, c] = -(z[i, c] - np.sign(z[i, c]) * model.l1) / ((model.beta + n[i, c] ** 0.5) / model.alpha + model.l2)
        scores = [sum(v * w[i, c] for i, v in zip(at, values, strict=True)) for c in range(3)]
        p = [np.exp(s) / sum(np.exp(x) for x in scores) for s in scores]
        for i, v in zip(at, values, strict=True):
            for c in range(3):
                g = v * (p[c] - target[c])
                z[i, c] += g - ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / model.alpha * w[i, c]
                n[i, c] += g * g
        model.learn(at, values, target)
        assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_letters():
    assert not any(map(langid.has_letter, [None, "", "½", "12 ³", "Ⅷ 7", "...", "\u0301"])) and all(map(langid.has_letter, ["a", "½ é", "語", "ª"]))


def _tables(spark):
    return [{r[0]: r for r in spark.read.parquet(f"{DATA}/{t}.parquet").collect()} for t in ("documents", "labels")]


def test_registered_queries(spark):
    """The columns of the queries that have no SQL, row by row against plain loops over the tables."""
    documents, _ = _tables(spark)
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in documents}
    found = {r["doc_id"]: r for r in simhash.query(spark, DATA).collect()}
    fps = [slow_fingerprint(r["text"]) for r in documents.values()]
    least = slow_components(list(documents), fps)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in found.items()} == {d: (f"{f:016x}", c) for d, f, c in zip(documents, fps, least, strict=True)}
    found = {r["doc_id"]: r for r in langid.query(spark, DATA).collect()}
    model = langid.train(langid.learnable(spark.read.parquet(f"{DATA}/documents.parquet")))
    for d, row in documents.items():
        r, counts = found[d], {}
        text = (row["text"] or "").lower()
        at, n = langid.ngram_counts(row["text"] or "")
        assert n.sum() == sum(max(0, len(text) - k + 1) for k in langid.NGRAMS)
        for i, c in zip(at.tolist(), n.tolist(), strict=True):
            counts[i] = (1 + np.log(c)) * model.idf[i]
        length = sum(v * v for v in counts.values()) ** 0.5
        scores = [sum(v / length * float(model.weights[i, c]) for i, v in counts.items()) / model.temperature for c in range(len(model.languages))]
        p = [1 / sum(np.exp(x - s) for x in scores) for s in scores]
        assert r["held_out"] == held[d] and abs(r["score"] - max(p)) < 1e-4 and p[model.languages.index(r["lang_pred"])] > max(p) - 1e-4
    found = {r["doc_id"]: r for r in quality.query(spark, DATA).collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    weights = quality.train(quality.training_rows(spark.read.parquet(f"{DATA}/documents.parquet"), labels))
    for d, row in documents.items():
        at, values = quality.features(row["text"])
        score = 1 / (1 + np.exp(-sum(v * float(weights[i]) for i, v in zip(at.tolist(), values.tolist(), strict=True))))
        assert found[d]["held_out"] == held[d] and abs(found[d]["score"] - score) < 1e-4 and found[d]["predicted"] == int(found[d]["score"] >= 0.7)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    n_tokens = {d: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for d, r in documents.items()}
    pieces = packing.query(spark, DATA).collect()
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(pieces[0].asDict())
    assert all(r["doc_tokens"] == n_tokens[r["doc_id"]] for r in pieces) and sum(r["length"] for r in pieces) == sum(n_tokens.values())


def test_nearest_query(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect() if r["embedding"] is not None}
    fine = {i: v for i, v in rows.items() if np.isfinite(v).all() and v.any()}
    ids, x = np.array(sorted(fine)), np.stack([fine[i] / np.sqrt(fine[i] @ fine[i]) for i in sorted(fine)])
    found = {}
    for r in ann.query(spark, DATA).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {int(i) for i in ids if i % 50 == 0}
    for q, got in found.items():
        s = np.round(x @ x[int(np.flatnonzero(ids == q)[0])], 10)
        s[ids == q] = -9
        best = np.lexsort((ids, -s))[:5]
        assert [v for _, v, _ in sorted(got)] == ids[best].tolist() and np.allclose([c for _, _, c in sorted(got)], s[best])


BENCH = "Anna Bell bought 12 kg of apples in Paris and gave 12 of them to Anna near the old mill."
SHORT = "What is the capital city of France"
DIGITS = "12 34 56 78 90 11 13 15 17"
ITEMS = [(1, BENCH), (2, None), (3, "too short"), (4, ""), (1, BENCH), (5, SHORT), (6, DIGITS), (7, "How far is seven km plus 5%")]


def test_decontamination(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(9))
    renamed = BENCH.replace("Anna Bell", "Carla").replace("Anna", "Carla").replace("12", "77").replace("Paris", "New York").replace("kg", "lb")
    inconsistent = "we saw that Carla Bell bought 12 kg of apples in Paris and gave 13 of them to Anna near the"
    texts = [
        "x y z. " + BENCH, "He said:\n" + renamed, inconsistent, "nothing at all of the kind is written in this text", None, "", "A B C D E F G H I J K L M N O P Q",
        f"He asked: {SHORT}? No.", "so what is the capital city of Spain now", "What is the capital city", "a table 1 2 3 4 5 6 7 8 9 0", f"and {DIGITS} too", "too short", "how far is 12 miles plus nine percent",
        "long " * 30000 + SHORT + " long" * 30000,
    ]
    rows = decontaminate.contaminated(docs(spark, texts), bench).collect()
    found = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_exact"]) for r in rows}
    assert found[0, 1] == (12, 13) and found[1, 1] == (12, 0)
    assert 0 < found.pop((2, 1))[0] < 12
    assert {k: v for k, v in found.items() if k[1] != 1} == {(7, 5): (1, 1), (8, 5): (1, 0), (11, 6): (0, 2), (12, 3): (0, 1), (13, 7): (1, 0), (14, 5): (1, 1)}
    assert set(found) - {(0, 1), (1, 1)} == {(7, 5), (8, 5), (11, 6), (12, 3), (13, 7), (14, 5)}
    left = {r["doc_id"] for r in decontaminate.clean_documents(docs(spark, texts).withColumn("bad", F.lit(1)), bench).collect()}
    assert left == set(range(15)) - {0, 1, 2, 7, 8, 11, 12, 13, 14}
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0 == decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count()


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination_drops_no_item(spark, monkeypatch, limit):
    """Items of one or two words, items of few words but numbers, copies in another case."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    long = "Alice walked 3 miles to Denver on Monday and then New York City was far away"
    slots = "Anna 12 Paris met 7 Bell 3 London 5 Rome 6"  # no window of it has four words
    items = ["Why?", "Define entropy", "What is 12 + 7?", "Compute 15 minus 4", long, slots, "Is 5 more than 5?", "?!", "Paris 1900 Rome"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = {
        "He left. Why? Nobody knows.": {0}, "That is why we left": set(), "Define entropy": {1}, "DEFINE ENTROPY! And more": {1}, "We define entropy as disorder": set(),
        "What is 15 + 8?": {2}, "what is 8 + 8?": set(), "Please: Compute 19 minus 6.": {3}, long.lower(): {4}, "so " + long.upper() + " again": {4},
        "Carla 90 Madrid met 4 Berg 2 Oslo 8 Bern 1": {5}, "Carla 90 Madrid met 4 Berg": set(), "is 6 more than 6": {6}, "is 6 more than 7": set(), "Oslo 1950 Bern": set(), "in paris 1900 rome": {8}, "?!": set(),
    }
    found = decontaminate.contaminated(docs(spark, list(texts)), bench).collect()
    assert {t: {r["item_id"] for r in found if r["doc_id"] == i} for i, t in enumerate(texts)} == texts


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination_against_sql(spark, tmp_path, monkeypatch, limit):
    """Broadcast and shuffled windows, items of all lengths, against the query's SQL."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    rng = random.Random(6)
    words = ["the", "sum", "of", "Anna", "Bell", "Paris", "12", "7", "seven", "kg", "km", "is", "What", "and", "1,5", "Über", "$", "%"]
    items = [(i, t) for i, (_, t) in enumerate([*ITEMS, (0, "Why?"), (0, "Define entropy"), (0, "What is 12 + 7?")])] + [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 14)))) for i in range(40)]
    texts = [*(t for t in EDGE if len(t or "") < 999), *(" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60))]
    for i in range(60):
        new = [rng.choice(words) if rng.random() < 0.1 else w for w in str(items[i % len(items)][1]).split(" ")]
        texts.append("so " + " ".join(new) + rng.choice([".", " " + BENCH, ""]))
        texts.append(rng.choice([str.upper, str.lower])(rng.choice(["", "x. "]) + " ".join(new)))
    docs(spark, texts, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = db.sql(decontaminate.ORACLE_SQL["op6_decontaminate"])
    got = decontaminate.query(spark, str(tmp_path)).select(*found.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))
    assert len(got) > 50


def test_url_filter(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/x?y", "http://example.com/de/1", "http://myexample.com/de/1", "http://net", "http://x.net/", "http://x.org/fr/#a", "http://x.org/de/", "http://l/1?utm_source=a", "http://l/1", "http://l/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit(1) for c in ("key", "h1", "h2", "host", "path", "rule")})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.tracked_keys(pages)).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("a.example.net", "/en/x", "example.net/en/", "allow"), 3: ("example.com", "/de/1", "example.com/de/", "block"),
        4: ("myexample.com", "/de/1", None, "allow"), 5: ("net", "", None, "allow"), 6: ("x.net", "/", "net/", "block"), 7: ("x.org", "/fr/", "org/fr/", "allow"), 8: ("x.org", "/de/", None, "allow"),
        9: ("l", "/1", None, "block"), 10: ("l", "/1", None, "block"), 11: ("l", "/1", None, "block"),
    }
    assert url_filter.judge(pages.limit(0), url_filter.tracked_keys(pages)).count() == 0


@pytest.mark.parametrize("shard_keys", [10**6, 150])
def test_cascade_is_exact(spark, shard_keys):
    rows = spark.range(3000).select(F.concat(F.lit("k"), F.col("id") % 2500).alias("key"), "id")
    listed = spark.range(0, 2500, 7).select(F.concat(F.lit("k"), "id").alias("key")).union(spark.createDataFrame([("absent",), (None,), ("",)], "key string"))
    found = url_filter.mark_listed(rows, listed, shard_keys).collect()
    assert len(found) == 3000 and all(r["is_listed"] == (int(r["key"][1:]) % 7 == 0) for r in found)


def test_licenses(spark):
    mit = "permission IS hereby granted, free of charge to any person obtaining copies of this software and associated documentation files (x)"
    texts = ["All rights\nreserved. CC-BY cc by", "cc", None, "", "...", mit, "apache", "a general, public license! General public", "x\n" + mit + "\ncc by"]
    got = [r for r in sorted(license_scan.scan(docs(spark, texts)).collect(), key=lambda r: r["doc_id"])]
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["labels"], got[0]["score"]) == (7, 3, 0, 5, "cc-by,reserved", 1.0)
    assert [got[i]["labels"] for i in (1, 2, 3, 4, 6)] == [""] * 5 and got[2]["n_words"] == 0 and got[2]["first_word"] is None
    assert got[5]["labels"] == "mit" and got[5]["base_labels"] == "" and 0.8 <= got[5]["score"] < 1
    assert got[7]["labels"] == "gpl" and got[8]["labels"] == "cc-by,mit"
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_license_windows(spark):
    """Notices over lines, in comments and long lines; words of a notice far apart are none."""
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    mit = "/* Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated documentation\n * files (the"
    one_a_line = "Released\r\nunder\r\nthe\r\nMIT\r\nLicense"
    far = "released " + "x " * 30 + "under the " + "y " * 30 + "mit license"
    texts = [bsd, mit, one_a_line, far, "word " * 3000 + bsd + " word" * 3000, far + "\n" + bsd + " " + one_a_line, "the MIT " * 5000, "under the MIT License"]
    got = [(r["labels"], r["score"]) for r in sorted(license_scan.scan(docs(spark, texts)).collect(), key=lambda r: r["doc_id"])]
    assert got == [("bsd", 1.0), ("mit", 1.0), ("mit", 1.0), ("", 0.0), ("bsd", 1.0), ("bsd,mit", 1.0), ("", 0.0), ("mit", 0.8)]


def test_license_relatives(spark):
    texts = [
        "Licensed under CC BY 4.0", "Released under the GNU General Public License, version 2", "it was released under the license of the city",
        "This work is licensed under the GNU General Public License, version 3", "This work is licensed under the GNU Lesser General Public License, version 3",
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under the Apache License, Version 1.1", "Licensed under the Apache License,\n# Version 2.0 (the",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License",
    ]
    got = [r["labels"] for r in sorted(license_scan.scan(docs(spark, texts)).collect(), key=lambda r: r["doc_id"])]
    assert got == ["cc-by", "gpl", "", "gpl,gpl-3.0", "gpl", "cc-by,cc-by-nc-4.0", "cc-by", "", "apache-2.0", ""]
    with pytest.raises(ValueError):
        license_scan.scan(docs(spark, texts), templates=[license_scan.Template("x", "some words", ("other",))])


def test_license_windows_against_sql(spark, tmp_path):
    """The query and its SQL over wrapped, repeated, long and related notices."""
    rng = random.Random(8)
    notices = [w for t in license_scan.TEMPLATES for w in [t.text] * 2]
    texts = [*EDGE]
    for _ in range(150):
        parts = rng.choice(notices).split(" ")
        parts = [rng.choice(["xx", "version", "license", "3", "nc"]) if rng.random() < 0.12 else p for p in parts if rng.random() > 0.08]
        filler = " ".join(rng.choices(["the", "work", "a", "license", "of", "mit", "is"], k=rng.randint(0, 60)))
        texts.append(filler + "\n" + rng.choice(["\n", " ", "\r\n * "]).join(parts) + " " + filler)
    docs(spark, texts, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = db.sql(license_scan.ORACLE_SQL["op9_license_scan"])
    got = license_scan.query(spark, str(tmp_path)).select(*found.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))
    assert sum(r["labels"] != r["base_labels"] for r in got) > 30


def test_language(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(langid.learnable(df))
    told = langid.identify(df.withColumn("score", F.lit(1)), model).where(common.held_out(F.col("doc_id")))
    r = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score").alias("least")).first()
    assert r["right"] > 0.95 and 0 < r["least"] <= 1
    edge = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.identify(docs(spark, [*EDGE, "123 ..."]), model).collect()}
    assert all(edge[i] == ("und", 0.0) for i in (0, 1, 2, 11)) and edge[3][0] != "und"
    kept = langid.reject(docs(spark, EDGE), model)
    assert set(kept.columns) == {"doc_id", "text", *CLASH} and {x["doc_id"] for x in kept.collect()} == set(range(3, 11))
    nothing = langid.train(df.limit(0))
    assert {x["lang_pred"] for x in langid.identify(docs(spark, EDGE), nothing).collect()} == {"und"}
    assert langid.identify(docs(spark, []), model).count() == 0


def test_quality(spark):
    df, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    weights = quality.train(quality.training_rows(df, labels))
    held = quality.rate(df, weights).join(labels, "doc_id").where(common.held_out(F.col("doc_id"))).toPandas()
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    edge = quality.rate(docs(spark, EDGE), weights).collect()
    assert len(edge) == len(EDGE) and all(0 <= r["score"] <= 1 for r in edge)
    assert quality.rate(docs(spark, []), weights).count() == 0
    assert len(quality.train(quality.training_rows(df, labels.limit(0)))) == quality.FEATURES


def test_ftrl_and_temperature():
    rng = np.random.default_rng(0)
    xs = [(np.array([0, 1 + int(y), 3 + i % 5]), np.ones(3)) for i, y in enumerate(rng.integers(0, 3, 300))]
    y = np.array([x[0][1] - 1 for x in xs])
    w = ftrl.FTRL(8, 3).fit(xs, np.eye(3)[y], 3)
    scores = np.array([v @ w[a] for a, v in xs])
    assert (scores.argmax(1) == y).all()
    logits = rng.normal(size=(4000, 3))
    drawn = (ftrl.softmax(logits).cumsum(1) > rng.random((4000, 1))).argmax(1)
    assert abs(ftrl.temperature(logits * 5, drawn) - 5) < 0.8 and ftrl.temperature(logits[:0], drawn[:0]) == 1.0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[300:330] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [1.0, None] * 12), (1004, [1.0]), (None, [1.0] * 24), (1005, [float("inf")] * 24), rows[3]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("rep", "label", "n", "score", "q")})
    found = ann.nearest(df, df.where("vec_id % 50 = 0 OR vec_id >= 1000 OR vec_id = 7")).collect()
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    hits = 0
    asked = sorted({*range(0, 600, 50), 7})
    assert {r["query_id"] for r in found} == set(asked)
    for q in asked:
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        s = u @ u[q]
        s[q] = -9
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(abs(s[r["vec_id"]] - r["score"]) < 1e-9 for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(np.lexsort((np.arange(600), -np.round(s, 9)))[:5].tolist()))
        if q == 7:
            assert [r["vec_id"] for r in mine] == [300, 301, 302, 303, 304]
    assert hits / (5 * len(asked)) >= 0.9
    few = ann.nearest(df.where("vec_id < 3"), df.where("vec_id = 0")).collect()
    assert len(few) == 2
    assert ann.nearest(df.limit(0), df).count() == 0


def test_neighbours_in_dense_groups(spark):
    """Groups of more than CANDIDATES vectors that are close but unequal, or multiples of one vector."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2400, 64))
    x[:800] = x[0] + 0.3 * rng.normal(size=(800, 64))
    x[800:1200] = x[800] * rng.permutation(np.arange(1, 401))[:, None]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    asked = [*range(0, 2400, 60), 850, 1199]
    found = ann.nearest(df, df.where(F.col("vec_id").isin(asked))).collect()
    for q in asked:
        s = np.round(u @ u[q], 9)
        s[q] = -9
        wanted = np.lexsort((np.arange(2400), -s))[:5].tolist()
        got = [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])]
        if 800 <= q < 1200:  # multiples, rounded: their cosines differ in the last places only, and aren't rounded
            assert len({*got}) == 5 and (s[got] == 1.0).all()
        else:
            assert got == wanted


def test_neighbours_of_an_id_with_several_vectors(spark):
    """The vector of the smallest direction counts, for queries and candidates."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    x[1:9] = x[0] + 0.01 * rng.normal(size=(8, 8))
    ids = [0] * 7 + list(range(7, 40))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    turned = x.astype(float) / np.abs(x.astype(float)).max(1, keepdims=True)
    own = min(range(7), key=lambda i: tuple(turned[i]))
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    wanted = sorted(range(7, 40), key=lambda b: (-round(float(u[own] @ u[b]), 9), b))[:5]
    found = ann.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == wanted and [r["rank"] for r in found] == [1, 2, 3, 4, 5]


def test_anisotropic_codes_keep_large_products():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    errors = []
    for weight in (1.0, ann.eta(16, 0.5)):
        book = ann.fit(x[:1500])
        book.weight = weight
        _, _, left = book.residuals(x[:1500])
        for _ in range(3):
            book.refit(x[:1500], left, book.encode(x[:1500], left))
        cell, scale, left = book.residuals(x[1500:])
        back = book.cells[cell] + scale[:, None] * book.decode(book.encode(x[1500:], left)).reshape(1500, -1)
        errors.append((((x[1500:] - back) * x[1500:]).sum(1) ** 2).mean())
    assert errors[1] < errors[0]


def test_packing(spark):
    rng = random.Random(4)
    texts = EDGE + [" ".join(rng.choices(["onblé", "Er,", "it's", "12", "queaux&&&"], k=rng.randint(1, 900))) for _ in range(150)]
    ids = [None, *range(1, len(texts))]
    rows = packing.pack(docs(spark, texts, ids), with_ids=True).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    wanted = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4") for d, t in zip(ids, texts, strict=True)}
    pieces, sequences = {}, {}
    for r in rows:
        own = wanted[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"] and len(wanted[r["doc_id"]]) == r["doc_tokens"] and own.tolist() == r["ids"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {d: sum(n for _, n in p) for d, p in pieces.items()} == {d: len(w) for d, w in wanted.items()}
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    total = sum(map(len, wanted.values()))
    assert len(sequences) * 2048 < total * 1.1
    assert packing.pack(docs(spark, [])).count() == 0


def test_cutting_stock():
    rng = np.random.default_rng(0)
    demand = {int(s): int(n) for s, n in zip(range(1, 65), rng.integers(0, 50, 64), strict=True)}
    found = packing.cutting_stock(demand, 64)
    offered = {s: sum(p.get(s, 0) * n for p, n in found) for s in demand}
    assert all(offered[s] >= n for s, n in demand.items()) and all(sum(s * c for s, c in p.items()) <= 64 for p, _ in found)
    assert sum(n for _, n in found) <= sum(s * n for s, n in demand.items()) / 64 * 1.04 + 2
    assert packing.cutting_stock({}, 64) == []
    # three of 22 leave 30 of 96: only mixed patterns fill the room, which the first basis doesn't have
    assert sum(n for _, n in packing.cutting_stock({48: 10, 32: 30, 16: 20, 96: 1}, 96)) == 1 + (480 + 960 + 320 + 95) // 96
    value, counts = packing.best_pattern(np.array([0.4, 0.7]), np.array([3, 5]), 11)
    assert value == pytest.approx(1.5) and counts.tolist() == [2, 1]


def _same_ids(encoder, texts):
    ids, ends = encoder.encode(pa.array(texts))
    wanted = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return [t for t, a, b, w in zip(texts, [0, *ends[:-1]], ends, wanted, strict=True) if ids[a:b].tolist() != w.ids]


def test_encoder_equals_tokenizer():
    encoder = packing.WordEncoder(packing.default_tokenizer(), cached_words=50)
    assert encoder.by_words
    rng = random.Random(1)
    small = ["".join(rng.choice("aB'sS.,!1٣é́İΣ \n\x1c<|>Å…ज़") for _ in range(rng.randint(0, 25))) for _ in range(800)] + ["a<|endoftext|>b", "'s'T 've", ""]
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    wild = ["".join(rng.choice(every) if rng.random() < 0.3 else rng.choice("ab .,'S1J") for _ in range(12)) for _ in range(4000)]
    for texts in (small, small, wild):
        for at in range(0, len(texts), 100):
            assert not _same_ids(encoder, texts[at : at + 100])


def test_encoder_beside_every_character():
    """Each character of Unicode (of the large scripts, some) after and before letters, digits and marks."""
    encoder = packing.WordEncoder(packing.default_tokenizer())
    some = [chr(c) for c in [*range(0x3400), *range(0x3400, 0xD800, 97), *range(0xE000, 0x20000, 3), *range(0x20000, 0x110000, 9973)]]
    assert not _same_ids(encoder, [f"a{c}. {c}-1 J{c}'s 1{c}{c}x h{c}" for c in some])
    for text in ("ज़.", "ड़-", "ਲ਼-", "שׁ."):
        assert not _same_ids(encoder, [text])


def test_other_tokenizers_encode_whole_texts(spark):
    path = packing.default_tokenizer().replace("word_bpe_49k", "byte_bpe_50k")
    texts = ["It's  two words,\n12 é", None, "", "x" * 5000]
    rows = packing.pack(docs(spark, texts), tokenizer=path).collect()
    tokenizer = Tokenizer.from_file(path)
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_padding(spark):
    rows = spark.range(30000).select(F.col("id").alias("doc_id"), F.lit(0).alias("start"), F.when(F.col("id") % 3 == 0, 2048).otherwise(1 + F.pmod(F.xxhash64("id"), F.lit(2048))).alias("length"))
    found = packing.assign(common.saved(rows, "lengths"))
    r = found.agg(F.countDistinct("sequence_id").alias("n"), F.sum("length").alias("tokens"), F.count("*").alias("pieces")).first()
    assert r["pieces"] == 30000 and r["n"] * 2048 <= r["tokens"] * 1.01
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("l")).where("l > 2048").count() == 0


def shard_of(x):
    book = ann.fit(ann.unit(x[:: max(1, len(x) // 4096)]))
    codes, *others = book.coded(ann.unit(x.astype(float)))
    return ann.Shard(book, np.arange(len(x)), x, ann.packed(codes), *others)


@pytest.mark.parametrize(("n", "dim", "near"), [(20000, 64, 0), (20000, 64, 6000), (4000, 192, 0)])
def test_short_lists_hold_the_neighbours(n, dim, near):
    """Few exact cosines and recall over 0.9, without any structure or with a group of close vectors; all of them by the exact way."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, dim))
    x[:near] = x[0] + 0.05 * rng.normal(size=(near, dim))
    shard = shard_of(x.astype(np.float32))
    u = ann.unit(shard.x.astype(float))
    asked = range(0, n, n // 40)
    queries = shard.x[list(asked)].astype(float)
    wanted = [np.lexsort((shard.ids, -(u @ u[q])))[:6].tolist() for q in asked]
    found, taken = shard.search(queries, 6, ann.share(ann.CANDIDATES, n, 1))
    assert taken <= 0.08 * n * len(asked)
    assert sum(len({*w} & {*at.tolist()}) for w, (at, _) in zip(wanted, found, strict=True)) >= 0.9 * 6 * len(asked)
    assert [sorted(at.tolist()) for at, _ in shard.search(queries, 6, 6, exact=True)[0]] == [sorted(w) for w in wanted]


def test_neighbours_by_unrounded_cosines_in_each_dimension(spark):
    rows = [(0, [1.0, 1e-7, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 2e-8, 0.0]), (3, [1e200, 0.0, 3e200]), (4, [1.0, 2.0]), (5, [2.0, 1.0]), (6, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for exact in (False, True):
        found = {}
        for r in ann.nearest(df, df, exact=exact).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert [v for v, _ in found[0]] == [2, 1, 3] and abs(found[1][-1][1] - 0.1**0.5) < 1e-12
        assert [v for v, _ in found[4]] == [5] and abs(found[5][0][1] - 0.8) < 1e-12 and 6 not in found


def test_neighbours_with_hot_directions_and_many_shards(spark, monkeypatch):
    """A third of the rows have one direction; shards and hot keys are small."""
    monkeypatch.setattr(ann, "SHARD_ROWS", 40)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[:200] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(7)
    u = ann.unit(x.astype(float))
    found = {}
    for r in ann.nearest(df, df.where("vec_id % 5 = 0"), candidates=600).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert len(found) == 120
    for q, got in found.items():
        s = np.round(u @ u[q], 12)
        s[q] = -9
        assert got == np.lexsort((np.arange(600), -s))[:5].tolist()
