import hashlib
import io
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchrank.llm import bytebpe, packing, pieces, token_files

tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def _texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_byte_bpe_equals_the_library():
    lib, own = _library(), bytebpe.encoder(BPE)
    rng = random.Random(5)
    texts = ["", "<|endoftext|>", "a<|endoftext|> b", "\U0001f600 \U00012345 ՘ x", "   \n\n x ", "it's 12 '' 's"]
    texts += ["".join(rng.choice("abcé \n\t'12!?sd中") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    texts += [chr(c) + "a" + chr(c) for c in range(0x20, 0x3000, 7)]
    for t in texts:
        assert np.frombuffer(own.encode(t), own.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_pieces_equal_the_library(docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in pieces.encode_documents(docs, PIECES).collect()}
    for i, t in _texts(docs).items():
        ids = lib.encode(t)
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == sha(",".join(map(str, ids))) and got[i].decoded_sha256 == sha(lib.decode(ids))
    assert pieces.encode_documents(empty, PIECES).count() == 0


def test_token_files_round_trip(docs, empty):
    lib = _library()
    want = {i: [*lib.encode(t, add_special_tokens=False).ids, 0] for i, t in _texts(docs).items()}
    manifest = token_files.write_token_files(docs, BPE, docs_per_file=4)
    rows = {r.doc_id: r for r in token_files.read_token_files(manifest, with_ids=True).collect()}
    start = 0
    for i in sorted(want):
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32, rows[i].ids) == (start, len(want[i]), _crc(want[i]), want[i])
        start += len(want[i])
    some = [r for r in manifest.collect() if r.n_docs > 1][0]
    first = min(i for i in want if rows[i].start >= some.first_start)
    assert token_files.read_documents(some.file, [first]) == {first: [want[first]]}
    empty_manifest = token_files.write_token_files(empty, BPE)
    assert token_files.read_token_files(empty_manifest).count() == 0


def test_frames_are_independent_and_checked():
    out = io.BytesIO()
    writer = token_files.Writer(out, frame_bytes=64)
    docs = {k: list(range(k, k + 3 * k)) for k in range(1, 12)}
    for k, ids in docs.items():
        writer.add(k, np.array(ids, "<u4").tobytes())
    assert writer.close() == (11, sum(map(len, docs.values())))
    raw = bytearray(out.getvalue())
    reader = token_files.Reader(io.BytesIO(raw))
    read = []
    plain = reader.frame
    reader.frame = lambda k: read.append(k) or plain(k)
    assert np.frombuffer(reader.ids(2), "<u4").tolist() == docs[3] and len(read) <= 2
    assert all(np.frombuffer(reader.ids(p), "<u4").tolist() == ids for p, ids in enumerate(docs.values()))
    raw[20] ^= 1
    with pytest.raises(Exception):  # noqa: B017, PT011
        token_files.Reader(io.BytesIO(raw)).frame(0)


def test_packing_places_every_id_once(docs, empty):
    lib = _library()
    want = {i: [*lib.encode(t, add_special_tokens=False).ids, 0] for i, t in _texts(docs).items()}
    rows = packing.pack(docs, BPE, length=64, with_ids=True, smallest=2000, largest=2000).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for i, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.ids == want[i][at : at + p.length] and p.ids_crc32 == _crc(p.ids) and p.doc_tokens == len(want[i])
            at += p.length
        assert at == len(want[i])
    sizes = []
    for _, parts in sorted(by_sequence.items()):
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    assert set(sizes[:-1]) <= {64} and sizes[-1] <= 64
    assert packing.pack(empty, BPE).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_index_steps_to_neighbouring_cells(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = packing.hilbert_index(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_hilbert_keys_follow_directions():
    same = packing.hilbert_keys(np.array([[1.0, 2, 3, 4], [2.0, 4, 6, 8], [0, 0, 0, 0]]))
    assert same[0] == same[1]


def test_stretches_hold_equal_bytes_and_deal_hot_cells(spark):
    """A third of the rows are one text: its cell is dealt over several stretches, order stays inside."""
    rows = [(k, "same text again " * 20 if k % 3 == 0 else f"text {k} of its own " * (1 + k % 40)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = packing.stretches(df, smallest=40_000, largest=40_000)
    held = packing.with_keys(df, cut=cut).groupBy("stretch").agg(F.sum(F.length("text") + 64).alias("n")).collect()
    assert max(r.stretch for r in held) < cut.count and (cut.several > 1).any()
    assert max(r.n for r in held) < 3 * 40_000
    pieces = packing.pack(df, BPE, smallest=40_000, largest=40_000).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert len(pieces) == 3000 and all(r.n == r.all for r in pieces)
