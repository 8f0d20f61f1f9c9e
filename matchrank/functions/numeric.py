"""Numeric, vector and hashing functions as column expressions."""

from __future__ import annotations

import hashlib
import itertools
import json
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product of two numeric arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length; the zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct-token arrays; two empty ones count as equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def macro_f1(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Mean of both classes' F1; an empty denominator counts as 0."""
    half = lambda hit: F.when(2 * hit + fp + fn == 0, 0.0).otherwise(2 * hit / (2 * hit + fp + fn))
    return 0.5 * (half(tp) + half(tn))


def budget(rows: Column, rate: Column) -> Column:
    """Rows times rate, halves to even."""
    return F.bround(rows * rate).cast("long")


def sublinear_tf(tf: Column) -> Column:
    return 1 + F.log(tf.cast("double"))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def mix(word: Column, char: Column, share: float = 0.65) -> Column:
    return share * word + (1 - share) * char


def stable_hash(*parts: Column | str) -> Column:
    """SHA-256 hex of the parts joined by the unit separator: the order that stands for a shuffle."""
    return F.sha2(F.concat_ws("\x1f", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def stable_seed(*parts: Column | str) -> Column:
    """The first eight bytes of that hash, little-endian, as a decimal."""
    h = stable_hash(*parts)
    swapped = F.concat(*[F.substring(h, 2 * k + 1, 2) for k in range(7, -1, -1)])
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def simplex_weights(names: list[str], step: float) -> list[dict[str, float]]:
    """All weightings in multiples of ``step`` that sum to 1."""
    units = round(1 / step)
    cuts = (c for c in itertools.product(range(units + 1), repeat=len(names)) if sum(c) == units)
    return [dict(zip(names, (u / units for u in c), strict=True)) for c in cuts]


def file_fingerprint(path: str | Path, sample: int | None = 1 << 20) -> dict:
    """Size, time and SHA-256 of a driver-side file: its ends, or all of it if ``sample`` is None."""
    p = Path(path)
    size, h = p.stat().st_size, hashlib.sha256()
    with p.open("rb") as f:
        if sample is None:
            while block := f.read(1 << 20):
                h.update(block)
        else:
            h.update(f.read(sample))
            if size > sample:
                f.seek(max(sample, size - sample))
                h.update(f.read(sample))
    return {"size": size, "mtime_ns": p.stat().st_mtime_ns, "sha256": h.hexdigest()}


def canonical_fingerprint(value: object) -> str:
    """SHA-256 of the JSON form with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def canonical_hash(*names: str) -> Column:
    """``canonical_fingerprint`` of a row's named columns, as a column."""
    return F.sha2(F.to_json(F.struct(*sorted(names))), 256)
