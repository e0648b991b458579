"""Operator 6: documents that hold benchmark passages, also in other case, or with other numbers, names or units.

With DataFrame functions only. Numbers, names and units become typed placeholders, windows of the
resulting template tokens are hashed and joined, and in each found pair the filled slots must match one
to one: what is equal on one side is equal on the other. Beside them, windows of the lower-cased words are
hashed, so that no copy is lost by its case. An item shorter than a window is looked for as a whole: its
first search is by three of its tokens, so each place of a text has the same hashes whatever the items' lengths.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, saved, table

WINDOW = 8
#: Whole items are found by so many tokens of theirs, if they are shorter than a window. Items of fewer words are no
#: passages: they must be a sentence.
SHORT = 3
#: A window with fewer words that are no placeholders is no template by itself; see `benchmark_windows`.
MIN_LITERALS = 4
#: What ends a sentence.
SENTENCE_ENDS = r"[.!?…;:。！？\r\n]+"
#: A text is hashed at every third place only, by two tokens less than a window: each window has one such place.
STRIDE = 3
#: Hashes of benchmark windows are broadcast up to so many; beyond, both sides are shuffled by hash.
BROADCAST_WINDOWS = 200_000
#: Symbols that are read as words.
SYMBOLS = (("%", "percent"), ("€", "euros"), ("$", "dollars"), ("£", "pounds"), ("°", "degrees"))
UNITS = (
    "mm cm m km mg g kg t ml l s ms min h mph kmh in ft lb oz c f usd eur gbp percent dollars euros pounds cents degrees metres meters kilometres kilometers centimetres centimeters "
    "miles mile feet foot inches inch yards grams kilograms tons litres liters gallons hour hours minute minutes second seconds day days week weeks month months year years"
).split()
#: Stand before their number.
CURRENCIES = ("dollars", "euros", "pounds", "usd", "eur", "gbp")
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()
#: Words that no capital makes a name, since sentences start with them.
COMMON = (
    "a about after all although an and another any are as at be because before both but by can consider could did do does each either every few find for from give given "
    "had has have he her here his how however i if in is it its let many may might more most my no nor not now of on once only or other our over she should show since so "
    "some such suppose than that the their them then there these they this those though through thus to under until us was we were what when where whether which while who "
    "whom whose why will with without would yes you your le la les un une des de du et il elle est que qui dans pour der die das ein eine und ist wer wie was wo el los las y en es"
).split()
_SLOTS = ("<num>", "<name>", "<unit>")


def _joined_numbers(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\p{N})[.,](\p{N})", "$1_$2")
    for symbol, word in SYMBOLS:
        t = F.replace(t, F.lit(symbol), F.lit(f" {word} "))
    return t


def _words(t: Column) -> Column:
    return F.filter(F.split(t, r"[^\p{L}\p{N}_]+", -1), lambda x: x != "")


def raw_tokens(text: Column) -> Column:
    """Words and numbers of a text, in order; 1,5 and 1.5 are one number each."""
    return _words(_joined_numbers(text))


def _brief_sentences(text: Column) -> Column:
    """The sentences of fewer than SHORT words, each as its lower-cased words."""
    parts = F.transform(F.split(_joined_numbers(text), SENTENCE_ENDS, -1), lambda s: F.transform(_words(s), F.lower))
    return F.filter(parts, lambda w: (F.size(w) > 0) & (F.size(w) < SHORT))


def _template(raw: Column) -> Column:
    """The kind of each token, or the token in lower case; names that follow a name are <more>."""

    def number(x: Column) -> Column:
        return ((x >= "0") & (x < ":")) | F.lower(x).isin(*NUMBERS)

    def unit(i: Column) -> Column:
        low = F.lower(F.get(raw, i))
        return low.isin(*UNITS) & (((i > 0) & number(F.get(raw, i - 1))) | (low.isin(*CURRENCIES) & number(F.get(raw, i + 1))))

    def named(x: Column) -> Column:
        low = F.lower(x)
        return (low != x) & ~low.isin(*COMMON)

    def kind(x: Column, i: Column) -> Column:
        low, before = F.lower(x), F.get(raw, i - 1)
        plain = (x >= ":") & (low == x) & ~x.isin(*NUMBERS, *UNITS)  # most words: nothing else is asked about them
        follows = (i > 0) & named(before) & ~number(before) & ~F.coalesce(unit(i - 1), F.lit(False))
        name = F.when(F.coalesce(follows, F.lit(False)), "<more>").otherwise("<name>")
        return F.when(plain, x).when(number(x), "<num>").when(unit(i), "<unit>").when(named(x), name).otherwise(low)

    return F.transform(raw, kind)


def _tokens(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, low, raw, tok): the lower-cased words; the tokens and their template, a run of names as one of each."""
    rows = df.select(*keys, raw_tokens(F.col("text")).alias("r")).withColumn("k", _template(F.col("r")))
    starts = F.filter(F.sequence(F.lit(0), F.size("k") - 1), lambda i: F.get("k", i) != "<more>")

    def joined(at: Column) -> Column:
        def token(p: Column, j: Column) -> Column:
            n = F.coalesce(F.get(at, j + 1), F.size("r")) - p
            return F.when(n == 1, F.get("r", p)).otherwise(F.array_join(F.slice("r", p + 1, n), "_"))

        return F.transform(at, token)

    whole = F.get(F.transform(F.array(starts), joined), 0)  # binds `starts`, or each run would find them anew
    return rows.select(*keys, F.transform("r", F.lower).alias("low"), F.when(F.array_contains("k", "<more>"), whole).otherwise(F.col("r")).alias("raw"), F.array_remove("k", "<more>").alias("tok"))


def _searched(window: int) -> list[tuple[int, str, int, int]]:
    """(section, column, tokens of a hash, places from one to the next) of the ways to find an item."""
    step, few = min(STRIDE, window), min(SHORT, window)
    return [(0, "tok", window - step + 1, step), (1, "tok", few, 1), (2, "low", window - step + 1, step), (3, "low", few, 1)]


def _hash(section: int, *tokens: Column) -> Column:
    """The same for an array and for its elements."""
    return F.xxhash64(F.lit(section), *tokens)


def _windows(rows: DataFrame, ways: list[tuple[int, str, int, int]]) -> DataFrame:
    """rows (low, raw, tok) and one row a place and way: place, h. Places of one way follow those of the way before.

    The hashes are a column before they are exploded: the explosion then compiles together with the join
    that follows, and the arrays beside it aren't copied for each window. The outer form keeps Spark from
    filtering by the array's size, which would compute it twice.
    """

    def hashes(section: int, name: str, n: int, step: int) -> Column:
        at = F.sequence(F.lit(0), F.size(name) - n, F.lit(step))
        every = F.transform(at, lambda i: _hash(section, *[F.get(name, i + k) for k in range(n)]))
        return F.when(F.size(name) >= n, every).otherwise(F.array().cast("array<bigint>"))

    hashed = rows.withColumn("hs", F.concat(*[hashes(*way) for way in ways]))
    return hashed.select(*rows.columns, F.posexplode_outer("hs").alias("place", "h")).where(F.col("h").isNotNull())


def _start(ways: list[tuple[int, str, int, int]]) -> Column:
    """Where the `n` tokens to compare start in a text, by the place of the hash and where (`at`) they have it."""
    before, start = F.lit(0), F.lit(None).cast("int")
    for section, name, n, step in ways:
        start = F.when(F.col("section") == section, (F.col("place") - before) * step - F.col("at")).otherwise(start)
        before = before + F.when(F.size(name) >= n, F.floor((F.size(name) - n) / step).cast("int") + 1).otherwise(0)
    return start


def _same_slots(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """Equal templates, and slots of one kind equal within `a` exactly where they are equal within `b`."""
    at = F.sequence(F.lit(0), F.size(ta) - 1)

    def agrees(i: Column) -> Column:
        return F.forall(at, lambda j: (F.get(ta, i) != F.get(ta, j)) | ((F.get(a, i) == F.get(a, j)) == (F.get(b, i) == F.get(b, j))))

    return (ta == tb) & F.forall(at, lambda i: ~F.get(ta, i).isin(*_SLOTS) | agrees(i))


def _literals(tok: Column) -> Column:
    return F.filter(tok, lambda x: ~x.isin(*_SLOTS))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, min_literals: int = MIN_LITERALS) -> DataFrame:
    """(item_id, section, at, n, whole, h, b_raw, b_tok): the distinct token runs that show an item.

    Templates: the windows with at least `min_literals` words that are no placeholders; without one, the whole item, if it
    has any such word. Words: all windows, or the whole item if it is shorter. Items of fewer than SHORT words have section 4
    and nothing to search by. `whole` is the hash of a run; `h` that of the `section`'s number of tokens of it, from `at`. They are
    of the window (or the few tokens) with the most letters, as it is the rarest, one row for each place that a text may be hashed at.
    """

    def runs(name: str) -> Column:
        n = F.least(F.size(name), F.lit(window))
        cut = F.transform(F.sequence(F.lit(0), F.size(name) - n), lambda i: F.struct(F.slice(name, i + 1, n).alias("b_tok"), (F.slice("raw", i + 1, n) if name == "tok" else none).alias("b_raw")))
        return F.when(F.size(name) >= SHORT, cut)

    none = F.array().cast("array<string>")
    rows = _tokens(benchmark, "item_id")
    strong = F.filter(runs("tok"), lambda w: F.size(_literals(w["b_tok"])) >= min_literals)
    one = F.array(F.struct(F.col("tok").alias("b_tok"), F.col("raw").alias("b_raw")))
    template = F.when(F.size(strong) > 0, strong).when((F.size("tok") >= SHORT) & (F.size(_literals(F.col("tok"))) > 0), one)
    cut = rows.select("item_id", F.explode(template).alias("w"), F.lit(0).alias("by"))
    cut = cut.unionByName(rows.select("item_id", F.explode(runs("low")).alias("w"), F.lit(2).alias("by"))).select("item_id", "w.*", "by").distinct()
    size = F.when(F.size("b_tok") >= window, window).otherwise(min(SHORT, window))
    letters = F.transform(F.sequence(F.lit(0), F.size("b_tok") - size), lambda i: F.struct(F.length(F.array_join(_literals(F.slice("b_tok", i + 1, size)), "")).alias("letters"), (-i).alias("at")))
    section = F.col("by") + F.when(F.size("b_tok") >= window, 0).otherwise(1)
    cut = cut.select("item_id", section.alias("section"), (-F.array_max(letters)["at"]).alias("best"), F.size("b_tok").alias("n"), "b_raw", "b_tok")
    steps = F.when(F.col("section").isin(0, 2), min(STRIDE, window)).otherwise(1)
    cut = cut.select("*", F.explode(F.sequence("best", F.col("best") + steps - 1)).alias("at"))
    h = F.coalesce(*[F.when(F.col("section") == k, _hash(k, F.slice("b_tok", F.col("at") + 1, n))) for k, _, n, _ in _searched(window)])
    cut = cut.select("item_id", "section", "at", "n", F.xxhash64("b_tok").alias("whole"), h.alias("h"), "b_raw", "b_tok")
    brief = rows.where((F.size("low") > 0) & (F.size("low") < SHORT)).select("item_id", F.lit(4).alias("section"), F.lit(0).alias("at"), F.size("low").alias("n"), F.xxhash64("low").alias("whole"), F.lit(None).cast("long").alias("h"), none.alias("b_raw"), F.col("low").alias("b_tok"))
    return cut.unionByName(brief.distinct())


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_literals: int = MIN_LITERALS) -> DataFrame:
    """(doc_id, item_id, n_windows, n_exact) for every document and benchmark item with a passage in common.

    n_windows: places in the document where a template of the item stands with consistent slots; n_exact: places where
    its words stand, in any case. Templates are windows with at least `min_literals` words that are no placeholders; an item
    that has none is one template as a whole. Words are windows or, of a shorter item, all of it. An item of fewer than SHORT
    words is found where it is a sentence; one of placeholders alone, by its words only. Null and empty texts match nothing,
    nor do items without a word. A text's length doesn't matter. A place that several windows of an item match counts once,
    as does one that several rows of a doc_id have; a null doc_id or item_id is a value like any other; other columns are
    ignored; empty tables give an empty result.
    """
    bench = saved(benchmark_windows(benchmark, window, min_literals), "benchmark")
    counts = {r["section"]: r["count"] for r in bench.groupBy("section").count().collect()}  # 5 rows at most
    ways = [way for way in _searched(window) if way[0] in counts] or _searched(window)[:1]
    small = sum(counts.values()) <= BROADCAST_WINDOWS
    hint = F.broadcast if small else (lambda df: df)
    keys = hint(bench.where(F.col("section") < 4).select("h", "section", "at", "n", "whole").distinct())
    if small:
        found = _windows(_tokens(docs, "doc_id"), ways).join(keys, "h")
    else:  # hashes meet alone; then the texts that have some are read again
        met = _windows(_tokens(docs, "doc_id"), ways).select("doc_id", "place", "h").join(keys, "h")
        hits = saved(met.groupBy(F.col("doc_id").alias("hit")).agg(F.collect_set(F.struct("place", "section", "at", "n", "whole")).alias("places")), "hits")
        again = docs.select("doc_id", "text").join(hits, F.col("doc_id").eqNullSafe(F.col("hit")))
        found = _tokens(again, "doc_id", "places").withColumn("p", F.explode("places")).select("doc_id", "low", "raw", "tok", "p.*")
    found = found.withColumn("start", _start(ways)).where(F.col("start") >= 0)
    first, none = F.greatest(F.col("start"), F.lit(0)) + 1, F.array().cast("array<string>")
    run = F.when(F.col("section") < 2, F.slice("tok", first, F.col("n"))).otherwise(F.slice("low", first, F.col("n")))
    slots = F.when(F.col("section") < 2, F.slice("raw", first, F.col("n"))).otherwise(none)
    found = found.select("doc_id", F.col("start").alias("place"), "section", "n", "whole", slots.alias("d_raw"), run.alias("d_tok"))
    found = found.where(F.xxhash64("d_tok") == F.col("whole"))
    if 4 in counts:
        brief = docs.select("doc_id", F.posexplode(_brief_sentences(F.col("text"))).alias("place", "d_tok")).withColumn("whole", F.xxhash64("d_tok"))
        brief = brief.join(hint(bench.where(F.col("section") == 4).select("section", "n", "whole").distinct()), "whole")
        found = found.unionByName(brief.withColumn("d_raw", none))
    found = saved(found, "windows")  # apart, so that the join compares hashes alone
    pairs = found.join(hint(bench.select("item_id", "section", "n", "whole", "b_raw", "b_tok").distinct()), ["section", "n", "whole"])
    same = _same_slots(F.col("d_raw"), F.col("b_raw"), F.col("d_tok"), F.col("b_tok"))
    pairs = pairs.where(F.when(F.col("section") < 2, same).otherwise(F.col("d_tok") == F.col("b_tok")))
    places = pairs.select("doc_id", "item_id", "place", (F.col("section") < 2).alias("template")).distinct()
    return places.groupBy("doc_id", "item_id").agg(F.count_if("template").alias("n_windows"), F.count_if(~F.col("template")).alias("n_exact"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_literals: int = MIN_LITERALS) -> DataFrame:
    """The rows of `docs`, all their columns, that hold no benchmark passage; see `contaminated`."""
    bad = contaminated(docs, benchmark, window, min_literals).select("doc_id").distinct()
    bad_id = free_name("bad", docs.columns)
    return docs.join(bad.select(F.col("doc_id").alias(bad_id)), docs["doc_id"].eqNullSafe(F.col(bad_id)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _quoted(words: tuple[str, ...] | list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _symbols_sql() -> str:
    t = r"regexp_replace(coalesce(text, ''), '(\p{N})[.,](\p{N})', '\1_\2', 'g')"
    for symbol, word in SYMBOLS:
        t = f"replace({t}, '{symbol}', ' {word} ')"
    return t


#: {docs}: a table with doc_id and text.
CONTAMINATED_SQL = (
    r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, text FROM {docs} UNION ALL SELECT 'b', item_id, text FROM benchmark),
r AS (SELECT side, id, row_number() OVER () AS rid, list_filter(regexp_split_to_array({symbols}, '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS raw FROM t),
u AS (
  SELECT side, id, rid, i, x, lower(x) AS low, (x >= '0' AND x < ':') OR lower(x) IN {numbers} AS num
  FROM (SELECT side, id, rid, unnest(raw) AS x, generate_subscripts(raw, 1) AS i FROM r)),
k AS (
  SELECT *, CASE WHEN num THEN '<num>'
         WHEN low IN {units} AND (coalesce(lag(num) OVER o, FALSE) OR (low IN {currencies} AND coalesce(lead(num) OVER o, FALSE))) THEN '<unit>'
         WHEN low <> x AND low NOT IN {common} THEN '<name>' ELSE low END AS k
  FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT *, CASE WHEN k = '<name>' AND coalesce(lag(k) OVER (PARTITION BY rid ORDER BY i), '') = '<name>' THEN 0 ELSE 1 END AS starts FROM k),
g AS (SELECT *, sum(starts) OVER (PARTITION BY rid ORDER BY i) AS at_token FROM c),
y AS (SELECT side, id, rid, at_token, string_agg(x, '_' ORDER BY i) AS x, min(k) AS k FROM g GROUP BY side, id, rid, at_token),
n AS (SELECT side, id, rid, list(x ORDER BY at_token) AS raw, list(k ORDER BY at_token) AS tok FROM y GROUP BY side, id, rid),
z AS (  -- the windows of each item with four words or more, or the whole item
  SELECT id, len(tok) AS m, least(len(tok), 8) AS n, unnest(range(1, len(tok) - least(len(tok), 8) + 2)) AS pos, raw, tok
  FROM n WHERE side = 'b' AND len(tok) >= 3),
s AS (SELECT id, m, raw AS all_raw, tok AS all_tok, raw[pos:pos+n-1] AS raw, tok[pos:pos+n-1] AS tok, len(list_filter(tok[pos:pos+n-1], lambda x: x NOT IN {slots})) >= 4 AS strong FROM z),
b AS (
  SELECT DISTINCT id, raw, tok, len(tok) AS n FROM s WHERE strong
  UNION
  SELECT id, any_value(all_raw), any_value(all_tok), any_value(m) FROM s GROUP BY id
  HAVING NOT bool_or(strong) AND len(list_filter(any_value(all_tok), lambda x: x NOT IN {slots})) > 0),
q AS (SELECT DISTINCT n FROM b),
w AS (
  SELECT id, n, pos, raw[pos:pos+n-1] AS raw, tok[pos:pos+n-1] AS tok
  FROM (SELECT n.*, q.n, unnest(range(1, len(tok) - q.n + 2)) AS pos FROM n, q WHERE len(tok) >= q.n AND side = 'd')),
p AS (SELECT w.id AS doc_id, b.id AS item_id, w.n, w.pos, w.raw AS raw, b.raw AS b_raw, b.tok AS tok FROM w JOIN b ON w.tok = b.tok AND w.n = b.n),
m AS (
  SELECT DISTINCT doc_id, item_id, pos, TRUE AS template FROM p
  WHERE len(list_filter(range(0, n * n), lambda z: tok[z // n + 1] IN {slots} AND tok[z // n + 1] = tok[z % n + 1]
        AND (raw[z // n + 1] = raw[z % n + 1]) <> (b_raw[z // n + 1] = b_raw[z % n + 1]))) = 0),
l AS (SELECT side, id, list_transform(raw, lambda x: lower(x)) AS low FROM r),
bl AS (
  SELECT DISTINCT id, n, low[pos:pos+n-1] AS low
  FROM (SELECT id, low, least(len(low), 8) AS n, unnest(range(1, len(low) - least(len(low), 8) + 2)) AS pos FROM l WHERE side = 'b' AND len(low) >= 3)),
dl AS (
  SELECT id, v.n, pos, low[pos:pos+v.n-1] AS low
  FROM (SELECT l.*, v.n, unnest(range(1, len(low) - v.n + 2)) AS pos FROM l, (SELECT DISTINCT n FROM bl) AS v WHERE len(low) >= v.n AND side = 'd') AS v),
x AS (SELECT DISTINCT dl.id AS doc_id, bl.id AS item_id, pos, FALSE AS template FROM dl JOIN bl ON dl.low = bl.low AND dl.n = bl.n),
bs AS (SELECT id, low FROM l WHERE side = 'b' AND len(low) IN (1, 2)),
ds AS (
  SELECT id, generate_subscripts(part, 1) AS pos, unnest(part) AS low
  FROM (SELECT id, list_filter(list_transform(regexp_split_to_array({symbols}, '{ends}'), lambda s: list_transform(list_filter(regexp_split_to_array(s, '[^\p{L}\p{N}_]+'), lambda x: x <> ''), lambda x: lower(x))), lambda y: len(y) IN (1, 2)) AS part
        FROM (SELECT doc_id AS id, text FROM {docs}))),
y2 AS (SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, pos, FALSE AS template FROM ds JOIN bs ON ds.low = bs.low)
SELECT doc_id, item_id, CAST(count(*) FILTER (template) AS BIGINT) AS n_windows, CAST(count(*) FILTER (NOT template) AS BIGINT) AS n_exact
FROM (SELECT * FROM m UNION ALL SELECT * FROM x UNION ALL SELECT * FROM y2) GROUP BY 1, 2
""".replace("{symbols}", _symbols_sql())
    .replace("{ends}", SENTENCE_ENDS)
    .replace("{slots}", _quoted(_SLOTS))
    .replace("{numbers}", _quoted(NUMBERS))
    .replace("{units}", _quoted(UNITS))
    .replace("{currencies}", _quoted(CURRENCIES))
    .replace("{common}", _quoted(COMMON))
)

QUERIES = {"op6_decontaminate": query}
ORACLE_SQL = {"op6_decontaminate": CONTAMINATED_SQL.replace("{docs}", "documents")}
