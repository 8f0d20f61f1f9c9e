"""Sources and sinks: delimited text under two null regimes, scores, entities, documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchrank.functions.text import clean_text, display_text
from matchrank.operators.ranking import place
from matchrank.sources.contracts import ContractError, require_columns, require_complete, require_rows, require_unique

ITEMS = T.StructType([T.StructField(c, T.StringType()) for c in ("item_id", "title", "category", "brand", "gender", "age_group", "attributes")])
TERMS = T.StructType([T.StructField(c, T.StringType()) for c in ("term_id", "query")])
PAIRS = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "term_id", "item_id")])
# fixed value: what the inferring regime reads as missing
NA_STRINGS = ("", "#N/A", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "<NA>", "#NA", "-NaN", "-nan", "#N/A N/A", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, blanks: bool = True) -> DataFrame:
    """All-string CSV. ``blanks``: missing is the empty string; else NA strings become null."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    if blanks:
        return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])
    return df.select(*[F.when(~F.col(c).isin(*NA_STRINGS), F.col(c)).alias(c) for c in df.columns])


def positive_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct (term, item) whose label isn't 0; tables without a label are all positive; none left is an error."""
    require_columns(pairs, "term_id", "item_id")
    kept = pairs.where(F.col("label").cast("string") != "0") if "label" in pairs.columns else pairs
    if kept.limit(1).count() == 0:
        raise ContractError("no positive pairs")
    return kept.select("term_id", "item_id").distinct()


def score_table(df: DataFrame, column: str | None = None) -> DataFrame:
    """``id, term_id, score`` as double; the column is ``prob``, else ``score``, unless named."""
    column = column or next((c for c in ("prob", "score") if c in df.columns), None)
    if column is None:
        raise ContractError("neither prob nor score")
    out = require_columns(df, "id", "term_id").select("id", "term_id", F.col(column).try_cast("double").alias("score"))
    return require_unique(require_complete(out, "score"), "id")


def parse_component(spec: str) -> tuple[str, str, str]:
    """``NAME=PATH:COLUMN`` to its three parts."""
    name, eq, rest = spec.partition("=")
    path, colon, column = rest.rpartition(":")
    if not (name and eq and path and colon and column):
        raise ContractError(f"not NAME=PATH:COLUMN: {spec}")
    return name, path, column


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``ids``."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """A row-limited scan: the first ``n`` rows in an explicit order, as files have none."""
    return df.orderBy(*order).limit(n)


def first_seen(df: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """The first ``n`` values of ``key`` by where they first appear."""
    return df.groupBy(key).agg(F.min(at).alias("first_at")).orderBy("first_at", key).limit(n)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns that are missing are added with their default; nulls and unreadable numbers become it."""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double") if isinstance(v, float) else F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def zip_by_position(a: DataFrame, b: DataFrame, a_order: str, b_order: str, columns: list[str]) -> DataFrame:
    """``a`` with columns of ``b`` at equal positions in the two orders; unequal lengths are an error.

    The orders are explicit, as tables have no row numbers; a join on an id is better where there is one.
    """
    left, right = place(a, F.col(a_order).asc(), out="_p"), place(b.select(b_order, *columns), F.col(b_order).asc(), out="_p").drop(b_order)
    if (n := left.count()) != (m := right.count()):
        raise ContractError(f"{n} rows against {m}")
    return left.join(right, "_p").drop("_p")


def enrich_audit(rows: DataFrame, terms: DataFrame, items: DataFrame, band: str, bucket: str, score: str) -> DataFrame:
    """Sampled rows with query and item fields, left where unknown, by band, bucket, then best score."""
    found = rows.join(terms.select("term_id", "query"), "term_id", "left").join(items, "item_id", "left")
    return found.orderBy(F.col(band).asc(), F.col(bucket).asc(), F.col(score).desc(), "term_id", "item_id")


def file_audit(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``table_name, file_name, rows, megabytes`` of Parquet tables; sizes come with the scan."""
    parts = [spark.read.parquet(p).select(F.lit(t).alias("table_name"), "_metadata.file_name", "_metadata.file_size") for t, p in paths.items()]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.groupBy("table_name", "file_name").agg(F.count(F.lit(1)).alias("rows"), (F.first("file_size") / 1e6).alias("megabytes"))


def in_order_of(df: DataFrame, ids: DataFrame, key: str, order: str) -> DataFrame:
    """The table's rows in the given order of ids; an id without a row is an error."""
    out = ids.select(key, order).join(df, key, "left")
    if ids.join(df, key, "left_anti").limit(1).count():
        raise ContractError(f"some {key} have no row")
    return out.orderBy(order)


def debug_catalog(items: DataFrame, order: str, first: int, always: DataFrame) -> DataFrame:
    """The first items in order and all that ``always`` names, once each."""
    head = items.orderBy(order).limit(first).select("item_id")
    return only_ids(items.dropDuplicates(["item_id"]), head.unionByName(always.select("item_id")), "item_id")


def first_ids(items: DataFrame, order: str, n: int) -> DataFrame:
    return items.orderBy(order).limit(n).select("item_id")


def entity_texts(df: DataFrame, key: str, text: Column | None = None, ids: DataFrame | None = None) -> DataFrame:
    """``entity_id, text`` of terms (by query) or items (by display text)."""
    rows = only_ids(df, ids, key) if ids is not None else df
    text = text if text is not None else (clean_text(F.col("query")) if "query" in df.columns else display_text())
    return rows.select(F.col(key).alias("entity_id"), text.alias("text"))


def blank_audit(df: DataFrame, table: str) -> DataFrame:
    """Per column: rows and blank or null values, in one pass."""
    cols = df.columns
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), 1).otherwise(0)).alias(f"b{k}") for k, c in enumerate(cols)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"b{k}").cast("long").alias("blank")) for k, c in enumerate(cols)])).alias("x")
    return sums.select("n", rows).select(F.lit(table).alias("table_name"), "x.column_name", F.col("n").alias("rows"), F.coalesce("x.blank", F.lit(0).cast("long")).alias("blank"))


def table_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_scores_csv(df: DataFrame, path: str, digits: int = 6, columns: tuple[str, ...] = ("score",)) -> None:
    """CSV with fixed decimals in the named columns."""
    df.select(*[F.format_string(f"%.{digits}f", F.col(c).cast("double")).alias(c) if c in columns else F.col(c) for c in df.columns]).write.csv(path, header=True, mode="overwrite")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="overwrite", ignoreNullFields=False)


def json_document(df: DataFrame) -> DataFrame:
    """A table's rows as JSON texts."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_json_document(df: DataFrame, path: str) -> None:
    """A one-row table as one JSON text in one file."""
    require_rows(df, 1)
    json_document(df).coalesce(1).write.mode("overwrite").text(path)


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("x")).select("x.*")
