"""Exact duplicates: a 128-bit content hash groups texts, bytes decide inside each group.

Native throughout. One aggregation keyed by (md5, sha-256, text) does both steps: Spark compares
the hash first and then the text's bytes, so a hash collision makes two groups, never one, and
copies collapse on the map side, so a text with a billion copies crosses the network once per map
task. What returns to the rows is a narrow table joined on the digests; AQE splits its hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digests(text: Column) -> tuple[Column, Column]:
    """128-bit content hash and sha-256 of a text, both binary."""
    return F.unhex(F.md5(text)), F.unhex(F.sha2(text, 256))


def _keyed(docs: DataFrame, text: str) -> tuple[Column, Column, Column]:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return (whole, *digests(whole))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per different text: ``content_hash, sha, keep_id, group_size``.

    ``keep`` is ``"min"`` or ``"max"``: the id that stays. Null texts count as empty. Two texts that
    share the md5 make two groups. Two texts that shared both digests would still be two groups here,
    but ``mark_duplicates``, which joins on the digests, would answer their rows twice; none are known.
    """
    whole, h, sha = _keyed(docs, text_col)
    pick = {"min": F.min, "max": F.max}[keep]
    return (
        docs.select(h.alias("content_hash"), sha.alias("sha"), whole.alias("_text"), F.col(id_col).alias("_id"))
        .groupBy("content_hash", "sha", "_text")
        .agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .drop("_text")
    )


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Each row's group: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty, so null and empty texts are copies of each other. A null id never
    wins against another id; a group of null ids alone has a null ``keep_id`` and ``kept`` true.
    Rows that repeat both id and text all carry the same answer. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    groups = duplicate_groups(docs, id_col, text_col, keep)
    _, h, sha = _keyed(docs, text_col)
    rows = docs.select(F.col(id_col).alias("_id"), h.alias("content_hash"), sha.alias("sha"))
    return rows.join(groups, ["content_hash", "sha"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows that stay, one per different text, with all their columns in one shuffle.

    Null text counts as empty and comes back as the kept row had it. Where rows repeat both id and
    text, one of them stays.
    """
    whole, h, _ = _keyed(docs, text_col)
    rest = [c for c in docs.columns if c != text_col]
    pick = {"min": F.min_by, "max": F.max_by}[keep]
    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(text_col).isNull().alias("was_null"))
    out = (
        docs.select(h.alias("_h"), whole.alias("_text"), F.col(id_col).alias("_id"), kept.alias("_row"))
        .groupBy("_h", "_text")
        .agg(F.coalesce(pick("_row", "_id"), F.first("_row")).alias("_row"))
    )
    back = {c: F.col("_row")[f"c{i}"] for i, c in enumerate(rest)}
    back[text_col] = F.when(~F.col("_row")["was_null"], F.col("_text"))
    return out.select(*[back[c].alias(c) for c in docs.columns])
