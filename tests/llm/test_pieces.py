import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from concord.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def unigram():
    """The library's own lattice over the same pieces and scores."""
    m = pb.ModelProto()
    with open(PATH, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def plain(text):
    return [j for w in pieces.split(text) for k in pieces.viterbi(w, PATH) for j in ([k] if k >= 0 else [3 + b for b in chr(-k).encode()])]


def test_viterbi_is_the_librarys():
    rng, sp = random.Random(1), unigram()
    for _ in range(500):
        word = "".join(rng.choice("theandüéing") for _ in range(rng.randint(1, 14)))
        assert pieces.viterbi("▁" + word, PATH) == sp.nbest_encode_as_ids(word, 1)[0]


def test_encode_and_decode(documents):
    rng = random.Random(2)
    rows = [(k, " ".join("".join(rng.choice("theandü\n漢𝒳") for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(0, 30)))) for k in range(80)]
    rows += [(100, None), (101, ""), (102, "  two  spaces "), (103, "q" * 700 + " x"), (3, rows[3][1]), (None, "▁ itself")]
    got = pieces.encoded(documents(rows, number=1, packed="x"), PATH)
    ids = sorted([(r["doc_id"], r["ids"]) for r in got.collect()], key=str)
    assert ids == sorted([(i, plain(t or "")) for i, t in rows], key=str)
    texts = sorted([tuple(r) for r in pieces.decoded(got, PATH).collect()], key=str)
    assert texts == sorted([(i, (t or "").replace("▁", " ")) for i, t in rows], key=str)
    small = pieces.encoded(documents(rows), PATH, chunk=200)
    assert sorted([(r["doc_id"], r["ids"]) for r in small.collect()], key=str) == ids
    told = {(r["doc_id"], r["n_pieces"], r["ids_crc32"]) for r in pieces.report(documents(rows), PATH).collect() if r["round_trip"] or r["doc_id"] is None}
    assert told == {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids}


def test_long_segments(documents):
    rng = random.Random(5)
    rows = [(1, "the" * 30_000), (2, "".join(rng.choice("theandi") for _ in range(2_000))), (3, " " * 5000 + "x"), (4, "漢" * 700 + "\n" * 300)]
    assert {r["doc_id"]: r["ids"] for r in pieces.encoded(documents(rows), PATH).collect()} == {i: plain(t) for i, t in rows}


def test_segments_part_where_no_piece_reaches():
    rng, of = random.Random(3), pieces.lattice_of(PATH)
    all_, kept = {t for _, t, _ in pieces.model(PATH)[0]}, {t for _, t, _ in of.pieces}
    assert kept < all_ and {t for t in all_ if len(t) == 1} <= kept
    texts = ["".join(rng.choice("the andüé.,$\n漢9Q") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    found = pieces.segments(texts, PATH)
    assert found.text == "".join("▁" + t.replace(" ", "▁") for t in texts if t)
    cuts, ends = set(found.begin.tolist()), np.cumsum([0, *(len(t) + 1 if t else 0 for t in texts)])
    assert set(ends.tolist()) <= cuts and found.begin[found.first].tolist() == ends.tolist()
    for a, b in zip(found.begin, found.begin[1:]):
        most = pieces.bounds(found.index[a:b], np.arange(b - a, 0, -1), PATH)
        for i in range(a, b):
            for j in range(i + 1, min(b, i + 16) + 1):
                assert found.text[i:j] not in kept or j - i <= most[i - a]
    for t in texts:  # pieces that stay out are on no best path
        assert all(k < 0 or pieces.model(PATH)[2][k] in kept for w in pieces.split(t) for k in pieces.viterbi(w, PATH))


def test_documents_follow_their_segments_in_small_rows(documents):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("theandü漢 ") for _ in range(20_000))) for k in range(60)] + [(60, None)]
    docs = documents(rows).coalesce(1)
    sizes = [r["n"] for r in pieces._chunks(docs, PATH, 64 << 20).where("packed is not null").select(F.length("packed").alias("n")).collect()]
    assert len(sizes) >= 4 and max(sizes) <= 2 * pieces._SLICE  # else each later batch zeroes as much
    assert pieces._chunks(docs, PATH, 64 << 20).where("number = 0").count() == 1
    assert pieces._chunks(docs, PATH, 2 << 20).where("number = 0").count() > 1  # by what is held of distinct segments
    for chunk in (64 << 20, 500_000):  # segments of former slices, and chunks that begin anew
        assert {r["doc_id"]: r["ids"] for r in pieces.encoded(docs, PATH, chunk=chunk).collect()} == {i: plain(t or "") for i, t in rows}


def test_lacking_segments_are_told():
    codes = pieces._Codes(PATH)
    codes.n = 3
    with pytest.raises(RuntimeError, match="numbered"):
        codes.add(np.array([4, 5]), None, None)


def test_no_rows(documents):
    assert pieces.report(documents([(1, "x")]).limit(0), PATH).count() == 0
