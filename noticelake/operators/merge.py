"""One row a key: merging observations, states of several devices, and details."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed_values import DATE_SOURCE_RANK, LIST_PAGE, NO_CATEGORY
from ..functions.text import canonical_json, display_date, empty_as_null, is_mojibake, normalize_keyword, normalize_url, parse_timestamp
from .quality import first_by


def date_rank(source: Column, unknown: str) -> Column:
    """The trust of a date's provenance; an unknown one counts as `unknown`."""
    table = F.create_map(*[F.lit(x) for pair in DATE_SOURCE_RANK.items() for x in pair])
    return F.coalesce(F.element_at(table, source), F.lit(DATE_SOURCE_RANK[unknown]))


def with_source_rank(items: DataFrame, sources: DataFrame) -> DataFrame:
    """`items` (source_url) with source_rank: configured pages by position, then others by category number, then url.

    sources: url, rank. Only their normalised urls are compared.
    """
    known = sources.groupBy(normalize_url(F.col("url")).alias("__url")).agg(F.min("rank").alias("__rank"))
    number = F.regexp_extract("__url", LIST_PAGE, 2).try_cast("int")
    ranked = items.withColumn("__url", normalize_url(F.coalesce("source_url", F.lit("")))).join(known, "__url", "left")
    configured = F.col("__rank").isNotNull()
    rank = F.struct(
        F.when(configured, 0).otherwise(1).alias("kind"),
        F.when(configured, F.col("__rank")).otherwise(F.coalesce(number, F.lit(NO_CATEGORY))).alias("place"),
        F.col("__url").alias("url"),
    )
    return ranked.withColumn("source_rank", rank).drop("__url", "__rank")


def canonical_source(items: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """The observation from the best-ranked source page of each key; of equal rank the earliest (seq)."""
    return first_by(items, keys, F.col("source_rank"), F.col("seq"))


def best_date(items: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """(keys, date, date_source): the date of the most trusted provenance, null without any.

    Of equal trust the date of the row with the best source_rank wins, then the earliest (seq).
    """
    dated = items.where(empty_as_null(F.col("date")).isNotNull()).withColumn("__trust", date_rank(F.col("date_source"), "list"))
    best = first_by(dated, keys, F.desc("__trust"), F.col("source_rank"), F.col("seq")).select(*keys, "date", "date_source")
    return items.select(*keys).distinct().join(best, list(keys), "left")


def collect(items: DataFrame, sources: DataFrame) -> DataFrame:
    """A run's observations merged: the best source's row, with the best date. One shuffle, by id."""
    return collect_ranked(with_source_rank(items, sources)).select(*items.columns)


def collect_ranked(ranked: DataFrame) -> DataFrame:
    """`collect` of rows that have their source_rank, which is left out."""
    columns = [c for c in ranked.columns if c != "source_rank"]
    trust = F.when(empty_as_null(F.col("date")).isNotNull(), date_rank(F.col("date_source"), "list"))
    by_id = W.partitionBy("id")
    ranked = ranked.withColumn("__n", F.row_number().over(by_id.orderBy("source_rank", "seq")))
    order = F.struct(trust.alias("t"), (-F.col("__n")).alias("n"))
    value = F.when(trust.isNotNull(), F.struct("date", "date_source"))
    best = ranked.groupBy("id").agg(
        F.min_by(F.struct(*[c for c in columns if c not in ("id", "date", "date_source")]), "__n").alias("r"),
        F.max_by(value, F.when(trust.isNotNull(), order)).alias("d"),
    )
    return best.select("id", "r.*", "d.date", "d.date_source").select(*columns)


def merged_title(old: Column, new: Column, authoritative: bool) -> Column:
    """A damaged title never replaces a clean one; a clean authoritative one replaces; else only an empty one is filled."""
    old_, new_ = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    fills = F.when(old_ == "", new).otherwise(old)
    takes = F.when(~is_mojibake(new_), new).otherwise(fills) if authoritative else fills
    return F.when(new_ == "", old).when(is_mojibake(new_) & ~is_mojibake(old_), old).otherwise(takes)


def merged_date(old: Column, old_source: Column, new: Column, new_source: Column) -> Column:
    """struct(date, date_source): a strictly more trusted date replaces; a stored date without source counts as persisted."""
    had, has = empty_as_null(old).isNotNull(), empty_as_null(new).isNotNull()
    old_rank = date_rank(empty_as_null(old_source), "persisted")
    takes = has & (~had | (date_rank(empty_as_null(new_source), "list") > old_rank))
    source = F.coalesce(empty_as_null(new_source), F.lit("list"))
    return F.struct(F.when(takes, new).otherwise(old).alias("date"), F.when(takes, source).otherwise(old_source).alias("date_source"))


def new_items(collected: DataFrame, known: DataFrame, key: str | Sequence[str] = "id") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return collected.join(known.select(*keys), keys, "left_anti")


def merge_with_existing(existing: DataFrame, collected: DataFrame, own: Sequence[str] = ()) -> DataFrame:
    """Known ids updated in place, unknown ones added. Both: id, title, date, date_source, source_category, snippet, first_seen,
    and columns of their `own`, of which the stored value stays unless it is null.
    """
    e, c = existing.alias("e"), collected.alias("c")
    both = e.join(c, F.col("e.id") == F.col("c.id"), "full")
    known, seen = F.col("e.id").isNotNull(), F.col("c.id").isNotNull()
    date = merged_date(F.col("e.date"), F.col("e.date_source"), F.col("c.date"), F.col("c.date_source"))
    return both.select(
        F.coalesce("e.id", "c.id").alias("id"),
        F.when(known & seen, merged_title(F.col("e.title"), F.col("c.title"), False)).when(known, F.col("e.title")).otherwise(F.col("c.title")).alias("title"),
        F.when(known & seen, date["date"]).when(known, F.col("e.date")).otherwise(F.col("c.date")).alias("date"),
        F.when(known & seen, date["date_source"]).when(known, F.col("e.date_source")).otherwise(F.col("c.date_source")).alias("date_source"),
        F.coalesce(empty_as_null(F.col("e.source_category")), F.col("c.source_category")).alias("source_category"),
        F.when(known, F.col("e.snippet")).otherwise(F.col("c.snippet")).alias("snippet"),
        F.when(known, F.col("e.first_seen")).otherwise(F.col("c.first_seen")).alias("first_seen"),
        (~known).alias("is_new"),
        *[F.coalesce(f"e.{x}", f"c.{x}").alias(x) for x in own],
    )


def apply_detail(items: DataFrame, details: DataFrame, authoritative: bool = True) -> DataFrame:
    """`items` (url, title, snippet, date, date_source, snippet_tried, date_tried) with what article pages say (url, title,
    snippet, date, date_source). What is still empty after a visit is marked as tried.
    """
    d = details.select("url", *[F.col(c).alias(f"__{c}") for c in ("title", "snippet", "date", "date_source")], F.lit(True).alias("__seen"))
    seen = F.coalesce("__seen", F.lit(False))
    date = merged_date(F.col("date"), F.col("date_source"), F.col("__date"), F.col("__date_source"))
    snippet = F.coalesce(empty_as_null(F.col("snippet")), empty_as_null(F.col("__snippet")))
    out = items.join(d, "url", "left").withColumns({
        "title": F.when(seen, merged_title(F.col("title"), F.col("__title"), authoritative)).otherwise(F.col("title")),
        "__d": F.when(seen, date).otherwise(F.struct("date", "date_source")),
        "__s": snippet,
    })
    return out.select(
        *[c for c in items.columns if c not in ("snippet", "date", "date_source", "snippet_tried", "date_tried")],
        F.col("__s").alias("snippet"), "__d.date", "__d.date_source",
        (F.coalesce("snippet_tried", F.lit(False)) | (seen & F.col("__s").isNull())).alias("snippet_tried"),
        (F.coalesce("date_tried", F.lit(False)) | (seen & empty_as_null(F.col("__d.date")).isNull())).alias("date_tried"),
    )


def split_recent(items: DataFrame, cutoff: str) -> DataFrame:
    """`items` with tier: recent from the cutoff on, else archive; rows without any date are archived."""
    day = display_date(F.col("date").cast("string"), F.col("first_seen"))
    return items.withColumn("tier", F.when(day >= cutoff, "recent").otherwise("archive"))


def adopt_archive(recent: DataFrame, archive: DataFrame) -> DataFrame:
    """Recent rows and those archived rows whose id isn't among them."""
    return recent.unionByName(archive.join(recent.select("id"), "id", "left_anti"), allowMissingColumns=True)


def lww_merge(rows: DataFrame, keys: Sequence[str], ts: str = "updated_at", deleted: str | None = "deleted_at", payload: Sequence[str] = ()) -> DataFrame:
    """Last writer wins: a valid time beats an invalid one, then the later, then the deleted, then the larger JSON.

    Commutative, associative and idempotent: any order and grouping of the same rows gives the same result.
    `ts` is text (parsed) or a timestamp.
    """
    when = F.col(ts)
    if dict(rows.dtypes)[ts] == "string":
        when = parse_timestamp(when)
    gone = F.col(deleted).isNotNull() if deleted else F.lit(False)
    text = canonical_json(**{c: F.col(c) for c in (payload or rows.columns)})
    return first_by(rows, keys, F.desc(when.isNotNull()), F.desc(when), F.desc(gone), F.desc(text))


def merge_subscriptions(rows: DataFrame) -> DataFrame:
    """`lww_merge` by owner and normalised keyword; tombstones stay."""
    keyed = rows.withColumn("normalized_keyword", normalize_keyword(F.coalesce(empty_as_null(F.col("normalized_keyword")), F.col("keyword"))))
    return lww_merge(keyed.where(F.col("normalized_keyword") != ""), ["user_id", "normalized_keyword"])


def merge_reads(rows: DataFrame) -> DataFrame:
    return lww_merge(rows, ["user_id", "announcement_id"], "read_at", None)


def merge_preferences(rows: DataFrame) -> DataFrame:
    """One document an owner; what is no JSON object becomes an empty one of version 1."""
    fine = F.try_parse_json("preferences").isNotNull() & F.trim("preferences").startswith("{") & F.col("schema_version").isNotNull()
    clean = rows.withColumns({
        "schema_version": F.when(fine, F.col("schema_version")).otherwise(1),
        "preferences": F.when(fine, F.col("preferences")).otherwise(F.lit("{}")),
    })
    return lww_merge(clean, ["user_id"], "updated_at", None)


def merge_account(local: tuple[DataFrame, DataFrame, DataFrame], remote: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Subscriptions, reads and preferences of both sides, merged."""
    merges = (merge_subscriptions, merge_reads, merge_preferences)
    return tuple(f(a.unionByName(b, allowMissingColumns=True)) for f, a, b in zip(merges, local, remote, strict=True))


def adopt_baseline_once(baseline: DataFrame, logins: DataFrame) -> DataFrame:
    """Anonymous rows (device, ...) with the account of the device's first login (device, account, login_at)."""
    first = first_by(logins, ["device"], F.col("login_at"), F.col("account"))
    return baseline.join(first.select("device", "account"), "device")


def outbox_prefix(attempts: DataFrame, account: str = "account_id", seq: str = "seq", failed: str = "failed") -> DataFrame:
    """Attempts before each account's first failure: those are acknowledged."""
    first = attempts.groupBy(account).agg(F.min(F.when(F.col(failed), F.col(seq))).alias("__stop"))
    return attempts.join(first, account).where(F.col("__stop").isNull() | (F.col(seq) < F.col("__stop"))).drop("__stop")


def outbox_pending(enqueued: DataFrame, acks: DataFrame) -> DataFrame:
    """Enqueued mutations (account_id, seq, id) without an ack (account_id, id), each id once, at its first place."""
    return first_by(enqueued, ["account_id", "id"], F.col("seq")).join(acks.select("account_id", "id").distinct(), ["account_id", "id"], "left_anti")


def require_owner(rows: DataFrame, owner: str | Column, column: str = "account_id") -> DataFrame:
    """The rows, which all must be the owner's (one for all, or a column): a foreign one fails the job when it is read."""
    same = F.col(column).eqNullSafe(F.lit(owner))
    return rows.where(F.assert_true(same, F.lit("a row belongs to another owner")).isNull())


def legacy_outbox(logs: DataFrame) -> DataFrame:
    """Rows (log, owner, account_id) of the logs that name an owner whom all their rows name too."""
    agreed = logs.groupBy("log").agg(F.bool_and(F.coalesce(F.col("account_id") == F.col("owner"), F.lit(False))).alias("ok")).where("ok")
    return logs.join(agreed.select("log"), "log", "left_semi")


def pagination_stop(pages: DataFrame, cutoff: str) -> DataFrame:
    """(category, page_no, reason): where walking a category's pages ends. pages: category, page_no, ids, dates.

    reason: empty (no ids), repeated (all ids on earlier pages) or before cutoff (the newest date is older;
    the page itself still counts). Pages without dates go on. Categories that never stop have no row.
    """
    entries = pages.select("category", "page_no", F.explode("ids").alias("id"))
    first = entries.groupBy("category", "id").agg(F.min("page_no").alias("page_no"))
    fresh = first.groupBy("category", "page_no").agg(F.count("*").alias("fresh"))
    newest = F.array_max(F.filter("dates", lambda d: d != ""))
    reason = (
        F.when(F.size("ids") == 0, "empty").when(F.coalesce("fresh", F.lit(0)) == 0, "repeated").when(newest < cutoff, "before cutoff")
    )
    told = pages.join(fresh, ["category", "page_no"], "left").withColumn("reason", reason).where(F.col("reason").isNotNull())
    return told.groupBy("category").agg(F.min_by(F.struct("page_no", "reason"), "page_no").alias("s")).select("category", "s.page_no", "s.reason")


def pagination_stop_previous(pages: DataFrame, ceiling: int = 20) -> DataFrame:
    """(category, page_no, reason) where repeated means: the same ids as the page before; `ceiling` pages at most."""
    ids = F.array_sort("ids")
    before = F.lag(ids).over(W.partitionBy("category").orderBy("page_no"))
    reason = (
        F.when(F.size("ids") == 0, "empty").when(ids == before, "repeated").when(F.col("page_no") >= ceiling, "ceiling")
    )
    told = pages.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return told.groupBy("category").agg(F.min_by(F.struct("page_no", "reason"), "page_no").alias("s")).select("category", "s.page_no", "s.reason")


def dedupe_by_id(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    return first_by(rows, [key], F.col(order))


def candidate_priority(candidates: DataFrame) -> DataFrame:
    """One row a url: of the earliest discovery stage, then the first found (stage, seq)."""
    return first_by(candidates, ["url"], F.col("stage"), F.col("seq"))


def upsert_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows, and old ones whose key they don't have. Repeated keys within `new` keep one row, the largest by JSON."""
    one = first_by(new, keys, F.desc(canonical_json(**{c: F.col(c) for c in new.columns})))
    return old.join(one.select(*keys), list(keys), "left_anti").unionByName(one, allowMissingColumns=True)


def delete_by_key(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*keys), list(keys), "left_anti")


def tombstone(rows: DataFrame, mutations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deletions as rows with deleted_at, merged by last writer."""
    return lww_merge(rows.unionByName(mutations, allowMissingColumns=True), keys)


def add_unique_keyword(old: DataFrame, new: DataFrame) -> DataFrame:
    """(subscriber, keyword) of `old`, and of `new` what is neither blank nor there already."""
    fresh = new.withColumn("keyword", F.trim("keyword")).where("keyword <> ''").dropDuplicates(["subscriber", "keyword"])
    return old.unionByName(fresh.join(old, ["subscriber", "keyword"], "left_anti"), allowMissingColumns=True)


def project_subscriptions(merged: DataFrame, local: DataFrame, now: Column) -> DataFrame:
    """What a client shows of merged subscriptions (normalized_keyword, keyword, id, deleted_at): no tombstones; a known keyword
    keeps its local id and created_at (normalized_keyword, id, created_at), a new one starts now.
    """
    known = local.select("normalized_keyword", F.col("id").alias("__id"), F.col("created_at").alias("__at"))
    live = merged.where("deleted_at IS NULL").join(known, "normalized_keyword", "left")
    return live.select("normalized_keyword", "keyword", F.coalesce("__id", "id").alias("id"), F.coalesce("__at", now).alias("created_at"))
