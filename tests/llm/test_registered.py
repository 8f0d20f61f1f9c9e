"""The registered queries themselves: against SQL where there is some, against plain Python where not."""

import glob
import hashlib
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from matchrank.llm import queries

tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _run(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    rows = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(str).to_numpy().tolist()))
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


def test_op1_counts_and_verdicts(spark, texts):
    got = _run(spark, "op1_quality")
    for i, t in texts.items():
        w = re.findall(WORD, t)
        windows = defaultdict(list)
        for k in range(len(w) - 2):
            windows[tuple(w[k : k + 3])].append(k)
        repeated = {k + j for v in windows.values() if len(v) > 1 for k in v for j in range(3)}
        lines, dup = set(), 0
        for line in t.split("\n"):
            if re.search(WORD, line):
                dup += line in lines
                lines.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (r.kept and r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q and not got[i].base_failed]
    assert sum(got[i].kept for i in good) >= 0.95 * len(good)


def test_op2_equals_the_library(spark, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = _run(spark, "op2_sentencepiece")
    for i, t in texts.items():
        ids = lib.encode(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))


def _ids(t):
    from tokenizers import Tokenizer

    _ids.lib = getattr(_ids, "lib", None) or Tokenizer.from_file(BPE)
    return [*_ids.lib.encode(t, add_special_tokens=False).ids, 0]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3_reads_back_what_was_written(spark, texts):
    got, start = _run(spark, "op3_token_files"), 0
    for i, t in sorted(texts.items()):
        ids = _ids(t)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), _crc(ids))
        start += len(ids)


def test_op4_classes(spark, texts):
    import xxhash

    prints = {}
    for i, t in texts.items():
        w = re.findall(WORD, lower(t))
        grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        bits = np.zeros(64, int)
        for g in grams:
            h = xxhash.xxh64_intdigest(g.encode(), 42)
            bits += np.array([h >> b & 1 for b in range(64)])
        prints[i] = sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))
    root = {i: i for i in prints}
    for _ in prints:
        new = {a: min(root[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4) for a in prints}
        if new == root:
            break
        root = new
    got = _run(spark, "op4_simhash")
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}


def test_op7_base_fields(spark, texts):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    got = _run(spark, "op7_licenses")
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        hits = [(k, lab) for p, lab in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert {x for _, x in hits} <= set(r.labels.split(",")) and 0 <= r.score <= 1


ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = {"assign": (ASSIGN, lambda m: len(m[2]) >= 12), "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16)}


def test_op8_base_fields(spark, texts):
    got = queries.QUERIES["op8_secrets"](spark, SF)
    assert got.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    got = {r.doc_id: r for r in got.collect()}
    for i, t in texts.items():
        found = sorted((m.start(), k, name, m.end()) for k, (name, (p, ok)) in enumerate(SECRETS.items()) for m in re.finditer(p, t) if ok(m))
        listed = [f"{n}:{s}:{e}" for s, _, n, e in found]
        assert got[i].base_sha256 == sha(",".join(listed)) and set(listed) <= set(got[i].spans.split(",")) | {""}
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(x[2] == k for x in found) for k in SECRETS]


def _luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


_digits = lambda s: re.sub(r"[^0-9]", "", s)
PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(_digits(s)) <= 19 and _luhn(_digits(s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(_digits(s)) <= 15),
}


def test_op10_base_fields_and_scores(spark, texts):
    got = _run(spark, "op10_pii")
    for i, t in texts.items():
        found = [(k, m.start(), m.end()) for k, (p, ok) in PERSONAL.items() for m in re.finditer(p, t) if ok(m[0])]
        listed = [f"{k}:{s}:{e}" for k, s, e in found]
        assert got[i].base_sha256 == sha(",".join(listed)) and set(listed) <= set(got[i].spans.split(",")) | {""}
        assert [got[i][f"n_{k}"] for k in PERSONAL] == [sum(x[0] == k for x in found) for k in PERSONAL]
        spans, scores = (list(filter(None, got[i][c].split(","))) for c in ("spans", "scores"))
        assert len(spans) == len(scores) and all(0 <= float(s) <= 1 for s in scores)
        assert all(float(s) >= 0.5 for x, s in zip(spans, scores, strict=True) if x.split(":")[0] not in PERSONAL)


def test_op9_pieces(spark, texts):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in queries.QUERIES["op9_packing"](spark, SF).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, parts in by_doc.items():
        ids, at = _ids(texts[i]), 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == _crc(ids[at : at + p.length]) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    ends = []
    for k in sorted(by_sequence):
        at = 0
        for p in sorted(by_sequence[k], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        ends.append(at)
    assert set(ends[:-1]) <= {1024} and ends[-1] <= 1024


def test_pipeline_against_plain_steps(spark, texts):
    """What each filtering stage keeps, by all pairs and plain rules; the last stage packs the rest whole."""
    verdict = _run(spark, "op1_quality")
    kept = {i: t for i, t in texts.items() if verdict[i].kept}
    first = {}
    for i in sorted(kept):
        first.setdefault(kept[i], i)
    kept = {i: kept[i] for i in first.values()}
    sets = {}
    for i, t in kept.items():
        w = lower(t).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    root = {i: i for i in kept}
    for _ in kept:
        new = {a: min(root[b] for b in kept if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])) for a in kept}
        if new == root:
            break
        root = new
    rows = queries.QUERIES["pipeline"](spark, SF).collect()
    assert {r.doc_id for r in rows} == {i for i in kept if root[i] == i}
    clean = {i for i in kept if root[i] == i and not any(ok(m[0]) for p, ok in PERSONAL.values() for m in re.finditer(p, kept[i]))}
    for i in list(clean)[:50]:
        assert next(r.doc_tokens for r in rows if r.doc_id == i) == len(_ids(kept[i]))
