"""Near copies by the Jaccard similarity of their word-shingle sets: what SimHash's radius can't reach.

Texts at Jaccard 0.8 differ in about 10 of 64 SimHash bits, a radius at which a pigeonhole grid has
a single block of a few bits left and finds everything. So what the grid links within its radius (``near``
of ``classes``) comes first, and what lies beyond comes from MinHash: 24 bands of 5 minima, which a
pair at similarity s shares with probability 1 - (1 - s^5)^24, 0.9999 at 0.8. Fingerprints of 64 bits
then drop pairs far beyond 0.8. The sets themselves decide on both.

Copies of a set collapse first. A band's bucket never gives pairs, only links from its members to one
of them; where verified links leave a bucket in several classes, further rounds link it from other
members, chosen by a hash anew in each bucket, until rounds find nothing. So a bucket costs its size, however large a family is. Shingles stand
for their XXH64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchrank.llm.arrow import per_document, text_rows
from matchrank.llm.components import components
from matchrank.llm.storage import delete, materialize, path_of

SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Differing fingerprint bits beyond which a pair isn't looked at: at 0.8 they are 9.7 with a deviation of 2.9.
FAR_BITS = 22
#: So many rounds in a row must find nothing before they end.
QUIET = 2
_SLACK = 1e-9
_RANDOM = np.random.default_rng(20240607)
_MIX = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]
_ODD = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int, digest: Callable[[bytes, int], int]) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; a shorter text is one shingle."""
    parts = text.encode().lower().split()  # as in simhash.fingerprint
    if not parts:
        return np.empty(0, "<u8")
    size = min(words, len(parts))
    grams = map(b" ".join, zip(*(parts[k:] for k in range(size)), strict=False))
    return np.unique(np.fromiter((digest(g, 42) for g in grams), "<u8", len(parts) - size + 1))


def bands(s: np.ndarray) -> np.ndarray:
    """A hash of each band's minima; no shingles give no bands."""
    if not len(s):
        return np.empty(0, "<i8")
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        mixed = (s[at : at + 2048] ^ _MIX) * _ODD
        np.minimum(least, (mixed ^ (mixed >> np.uint64(31))).min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ least[k::ROWS]) * _FOLD
        out ^= out >> np.uint64(29)
    return out.view("<i8")


def _fingerprint(s: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 15):
        some = s[at : at + (1 << 15)]
        ones += np.unpackbits(some.view("u1").reshape(len(some), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<i8")[0])


def described(rows: DataFrame, words: int) -> DataFrame:
    """``doc_id, key, n, fp, bands``: the set's md5, its size, its SimHash and its bands."""

    def make():
        from xxhash import xxh64_intdigest

        def work(ids, texts):
            sets = [shingles(t, words, xxh64_intdigest) for t in texts]
            return {
                "doc_id": ids,
                "key": [hashlib.md5(s.tobytes(), usedforsecurity=False).digest() for s in sets],
                "n": [len(s) for s in sets],
                "fp": [_fingerprint(s) for s in sets],
                "bands": [bands(s) for s in sets],
            }

        return work

    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
    return per_document(rows, make, schema, "doc_id long, key binary, n int, fp long, bands array<long>")


def _alike(x: bytes, y: bytes, similarity: float) -> bool:
    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= similarity * (len(x) + len(y) - shared) - _SLACK


def _sets(rows: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``doc_id, of``: the sets of the rows that ``ids`` names, as bytes."""

    def make():
        from xxhash import xxh64_intdigest

        return lambda ids, texts: {"doc_id": ids, "of": [shingles(t, words, xxh64_intdigest).tobytes() for t in texts]}

    schema = pa.schema([("doc_id", pa.int64()), ("of", pa.binary())])
    return per_document(rows.join(ids, "doc_id", "left_semi"), make, schema, "doc_id long, of binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose sets have a Jaccard similarity of ``similarity`` or more."""
    of = lambda c: sets.select(F.col("doc_id").alias(c), F.col("of").alias(f"of_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_alike(x.as_py(), y.as_py(), similarity) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b")
    return materialize(both.mapInArrow(run, "a long, b long").distinct(), "similar-links")


def _possible(similarity: float) -> F.Column:
    """Whether sizes and fingerprints of a member and its bucket's centre allow the similarity."""
    n, m = F.col("n"), F.col("centre.n")
    return (F.least(n, m) >= F.greatest(n, m) * similarity - _SLACK) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("centre.fp"))) <= FAR_BITS)


def classes(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", spent: list[str] | None = None, near: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> DataFrame:
    """Per row with an id ``doc_id, component_id``, the least id that similar texts lead to.

    ``near`` maps nodes ``fp, rep`` of different fingerprints to links ``a, b`` (``simhash.links``) and adds the paths of tables
    that these read to its second argument. Its links, and those of sets with equal fingerprints, are verified first.

    Null text counts as empty; texts without words are alike. Rows that repeat an id are one document
    of several texts, similar to what any of them is similar to. An empty table gives no rows. ``spent`` receives the paths
    of tables that the result reads and nothing needs after it.
    """
    spark, spent = docs.sparkSession, [] if spent is None else spent
    rows = text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id IS NOT NULL")
    every = materialize(described(rows, words), "similar-described")
    reps = every.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    own = materialize(reps, "similar-reps")
    spread = own.select("rep", "n", "fp", F.explode("bands").alias("bucket"))
    several = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    members = materialize(spread.join(several.hint("merge"), "bucket"), "similar-buckets")
    wanted, close, used = members.select(F.col("rep").alias("doc_id")), None, []
    if near is not None:
        nodes = materialize(own.where("n > 0").groupBy("fp").agg(F.min("rep").alias("rep")), "similar-nodes")
        equal = own.where("n > 0").select("fp", F.col("rep").alias("b")).join(nodes.withColumnRenamed("rep", "a"), "fp").where("a <> b").select("a", "b")
        close = materialize(near(nodes, used).unionByName(equal), "similar-close")
        for path in (*used, path_of(nodes)):
            delete(spark, path)
        wanted = wanted.unionByName(close.select(F.explode(F.array("a", "b")).alias("doc_id")))
    sets = materialize(_sets(rows, wanted.distinct(), words), "similar-sets")
    edges, found, k, quiet = None, None, 0, 0
    if close is not None:
        edges = verified(close, sets, similarity)
        used = [path_of(close)]
        found = materialize(components(edges, spent=used), "similar-classes")
        for path in used:
            delete(spark, path)
    while quiet < QUIET:
        # from the least members first, which gives each pair once; then only in buckets of several classes
        now = members.withColumn("class", F.col("rep"))
        if found is not None:
            now = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("class", F.coalesce("component", "rep")).drop("component")
        order = F.col("rep") if k == 0 else F.xxhash64("bucket", "rep", F.lit(k))
        centres = now.groupBy("bucket").agg(F.min(F.struct(order.alias("order"), "rep", "n", "fp", "class")).alias("centre"), (F.min("class") < F.max("class")).alias("mixed")).where("mixed")
        asked = now.join(centres, "bucket").where((F.col("class") != F.col("centre.class")) & _possible(similarity))
        pairs = materialize(asked.select(F.least("rep", "centre.rep").alias("a"), F.greatest("rep", "centre.rep").alias("b")).distinct(), "similar-pairs")
        links = verified(pairs, sets, similarity)
        quiet = 0 if links.limit(1).count() else quiet + 1
        if not quiet:
            old = [path_of(x) for x in (edges, found) if x is not None]
            edges = materialize(links if edges is None else edges.unionByName(links), "similar-edges")
            found = materialize(components(edges, spent=old), "similar-classes")
            for path in old:
                delete(spark, path)
        for path in (path_of(pairs), path_of(links)):
            delete(spark, path)
        k += 1
    for used in (members, sets, edges):
        if used is not None:
            delete(spark, path_of(used))
    spent += [path_of(x) for x in (every, own, found) if x is not None]
    of_key = own.select("key", "rep")
    if found is not None:
        of_key = of_key.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("rep"))
    return every.select("doc_id", "key").join(of_key, "key").select("doc_id", F.col("rep").alias("component_id"))
