import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from framewright.llm import token_store
from framewright.llm.range_coder import HEADER, SLOT_BITS, Model, decode_block, encode_block

PATH = public_tokenizers.path("word_bpe_49k.json")
#: CRC-32 of the block that the coder's first form made.
GOLDEN = 4294087967


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=2000), st.integers(0, 3))
def test_blocks_round_trip(ids, power):
    ids = np.array(ids * 4**power, np.int64)
    assert (decode_block(encode_block(ids, 301)) == ids).all()


@pytest.mark.parametrize("kind", ["zeros", "uniform", "zipf"])
def test_large_blocks_round_trip_and_shrink(kind):
    rng = np.random.default_rng(4)
    n = 300_000
    ids = {"zeros": np.zeros(n, int), "uniform": rng.integers(0, 49408, n), "zipf": rng.zipf(1.4, n) % 49408}[kind]
    data = encode_block(ids, 49408)
    assert (decode_block(data) == ids).all()
    assert len(data) < {"zeros": 0.1, "uniform": 2.2, "zipf": 1.2}[kind] * n


def test_a_context_is_one_place_and_the_format_stays():
    rng = np.random.default_rng(7)
    data = encode_block(rng.zipf(1.3, 50_000) % 49408, 49408)
    assert zlib.crc32(data) == GOLDEN
    model = Model(49408)
    tables = [v for v in vars(model).values() if isinstance(v, np.ndarray) and len(v) == 1 << SLOT_BITS]
    assert len(tables) == 1


def test_damage_is_noticed():
    data = bytearray(encode_block(np.arange(1000) % 50, 50))
    data[HEADER.size + 30] ^= 1
    with pytest.raises(ValueError):
        decode_block(bytes(data))


def test_store_against_the_library(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 500)
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    rng = random.Random(2)
    texts = {i: rng.choice([None, "", "<|endoftext|> Hello", "Ünï ﬁ!", "one two's\n3", "long word " * 3000]) for i in range(200)}
    rows = [(i, x, 0) for i, x in texts.items()] + [(None, "null id", 0)]
    rng.shuffle(rows)
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, part int"), f"{tmp_path}/s", PATH, 2)
    got = token_store.read_tokens(spark, f"{tmp_path}/s").collect()
    assert len(got) == 201
    at = 0
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id)):
        want = t.encode("null id" if r.doc_id is None else texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids) == (at, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)


def test_empty_store(spark, tmp_path):
    token_store.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e", PATH, 2)
    assert token_store.read_tokens(spark, f"{tmp_path}/e").count() == 0
