"""URL filters: dated list entries become validity intervals, joined as of each capture's fetch time.

A list is a log of dated entries ``(rule, action, listed_at)``: ``add`` puts a rule in force from that
moment, ``remove`` ends it. Rules are host suffixes (``example.com`` covers its subdomains) or host
and path prefixes (``example.com/ads``) of any depth; hosts match in any case, paths in their own. Rules
and URLs are brought to one form by the same code: no scheme, user, port, query or fragment, no dot at the
host's end, no empty steps. Intervals are cut at time-bucket borders, so that the
as-of join is an equality on (rule, bucket) with a range test inside; a hot host splits over its
buckets and AQE splits what is still hot. A list of unknown size is never broadcast by force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31 00:00:00"


_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"


def host(url: Column) -> Column:
    """Lower-case host of a URL without user, port and final dots; null if there is none."""
    found = F.lower(F.rtrim(F.regexp_extract(url, _AUTHORITY + r"(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(".")))
    return F.when(found != "", found)


def steps(url: Column) -> Column:
    """The steps of a URL's path that aren't empty."""
    return F.filter(F.split(F.regexp_extract(url, _AUTHORITY + r"[^/?#]*/([^?#]*)", 1), "/"), lambda s: s != "")


def normal_rule(rule: Column) -> Column:
    """A rule in the form of ``rule_keys``, however it is spelled; null if it names no host."""
    bare = F.trim(rule)
    url = F.when(bare.rlike(_AUTHORITY), bare).otherwise(F.concat(F.lit("//"), bare))
    return F.concat(host(url), F.array_join(F.transform(steps(url), lambda s: F.concat(F.lit("/"), s)), ""))


def unusable(entries: DataFrame) -> DataFrame:
    """``rule, entries``: rules that name no host, with the number of their entries."""
    return entries.where(F.col("rule").isNotNull() & normal_rule(F.col("rule")).isNull()).groupBy("rule").agg(F.count(F.lit(1)).alias("entries"))


def intervals(entries: DataFrame, strict: bool = True) -> DataFrame:
    """``rule, category, valid_from, valid_to`` (end exclusive) from ``rule, category, action, listed_at``.

    Entries of one rule and category follow each other by time; at equal times ``remove`` comes
    before ``add``. A repeated ``add`` continues the interval; a ``remove`` of nothing is ignored.
    Entries with a null rule or time are ignored; a null category counts as ``listed``. Spellings of
    one rule are one rule (``normal_rule``). A rule without a host is an error as it is read, or,
    without ``strict``, ignored and counted by ``unusable``.
    """
    normal = normal_rule(F.col("rule"))
    if strict:
        normal = F.when(normal.isNull(), F.raise_error(F.concat(F.lit("a rule without a host: "), "rule")).cast("string")).otherwise(normal)
    clean = (
        entries.where("rule IS NOT NULL AND listed_at IS NOT NULL")
        .select(normal.alias("rule"), F.coalesce("category", F.lit("listed")).alias("category"), (F.col("action") == "add").alias("on"), "listed_at")
        .where("rule IS NOT NULL")
    )
    # the last state at each moment, then only changes of state
    state = clean.groupBy("rule", "category", "listed_at").agg(F.max("on").alias("on"))
    order = Window.partitionBy("rule", "category").orderBy("listed_at")
    changes = state.withColumn("before", F.lag("on").over(order)).where("NOT (on <=> coalesce(before, false))")
    closed = changes.withColumn("valid_to", F.coalesce(F.lead("listed_at").over(order), F.to_timestamp(F.lit(FOREVER))))
    return closed.where("on").select("rule", "category", F.col("listed_at").alias("valid_from"), "valid_to")


def rule_keys(url: Column, deepest: Column | None = None) -> Column:
    """All rules that could cover a URL: its host's suffixes, each alone and with path prefixes, of
    every length or of up to ``deepest`` steps."""
    name = host(url)
    labels = F.split(name, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    path = steps(url)
    most = F.size(path) if deepest is None else F.least(F.size(path), deepest)
    prefixes = F.transform(F.sequence(F.lit(0), most), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(path, F.lit(1), k), "/"))))
    return F.when(name.isNotNull(), F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))))


def evaluate(captures: DataFrame, valid: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", bucket_days: int = 30) -> DataFrame:
    """Per capture: ``<id_col>, fetched_at, blocked, rule, categories``.

    ``rule`` is the longest rule in force at fetch time (ties: the smallest), ``categories`` all
    categories in force, sorted and comma-joined. Path rules reach as deep as the list has them. Captures
    without a host or a time match nothing; equal captures are looked up once and each row gets the
    answer, also where ids repeat or are null; an empty list blocks nothing, an empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    day = lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / (86_400 * bucket_days))
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(time_col).cast("timestamp").alias("_at"))
    seen = rows.select("_url", "_at").distinct()
    deepest = valid.agg(F.coalesce(F.max(F.size(F.split("rule", "/")) - 1), F.lit(0)).alias("deepest"))
    asked = seen.crossJoin(F.broadcast(deepest)).select("_url", "_at", day(F.col("_at")).alias("bucket"), F.explode(rule_keys(F.col("_url"), F.col("deepest"))).alias("rule"))
    # most keys of a capture are on no list: they go before anything is shuffled by time, if Spark can broadcast the rules
    asked = asked.join(valid.select("rule").distinct(), "rule", "left_semi")
    horizon = captures.agg(F.max(F.col(time_col).cast("timestamp")).alias("last"))
    span = valid.join(F.broadcast(horizon), F.col("valid_from") <= F.col("last")).select(
        "rule", "category", "valid_from", "valid_to", F.explode(F.sequence(day(F.col("valid_from")), day(F.least("valid_to", "last")))).alias("bucket")
    )
    hits = asked.join(span, ["rule", "bucket"]).where("_at >= valid_from AND _at < valid_to")
    best = hits.groupBy("_url", "_at").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule")).alias("best"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    s, b = rows.alias("s"), best.alias("b")
    return s.join(b, (F.col("s._url") == F.col("b._url")) & (F.col("s._at") == F.col("b._at")), "left").select(
        F.col("s._id").alias(id_col),
        F.col("s._at").alias("fetched_at"),
        F.col("b.best").isNotNull().alias("blocked"),
        F.coalesce(F.col("b.best.rule"), F.lit("")).alias("rule"),
        F.coalesce(F.col("b.categories"), F.lit("")).alias("categories"),
    )
