import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from concord.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = packing.Encoder(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t 'aB9é漢.<|endoftxt>"), st.characters(codec="utf-8")), max_size=60))
def test_ids_are_the_tokenizers(text):
    assert ENCODER.fast is not None
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_long_runs_are_the_tokenizers():
    for text in (" " * 200_000 + "a", "\n" * 200_000, " \n" * 100_000 + "x", "a" * 200_000, "=-" * 100_000, "x" + " " * 999 + "y"):
        assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500)))
def test_patterns_hold_the_histogram(histogram):
    found = defaultdict(int)
    for pattern, count in packing.shortest_pack_first(histogram, 64):
        assert sum(pattern) <= 64
        for x in pattern:
            found[x] += count
    assert found == histogram


def test_pack(documents):
    rows = [(k, "some words and more " * (k % 37)) for k in range(300)] + [(400, None), (401, ""), (402, "long text, " * 3000), (3, "twice"), (3, "twice"), (None, "no id")]
    got = packing.pack(documents(rows, length="mine"), PATH, size=128).collect()
    expected = []
    for i, t in rows:
        ids = np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(i, a, len(ids[a : a + 128]), zlib.crc32(ids[a : a + 128].tobytes()), len(ids)) for a in range(0, len(ids), 128)]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(expected, key=str)
    packs = defaultdict(list)
    for r in got:
        packs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(packs) == list(range(len(packs)))
    for p in packs.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 128
    assert sum(r["length"] for r in got) > 0.9 * 128 * len(packs)


def test_no_rows(documents):
    assert packing.pack(documents([(1, "x")]).limit(0), PATH).count() == 0
