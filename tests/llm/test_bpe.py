import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from framewright.llm import bpe
from framewright.llm.bpe import Encoder, bpe_encode, vocabulary, words_of
from framewright.llm.token_store import library_encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
NASTY = [
    None, "", " \t\n", "Hello's WORLD 'sthe it's 12345 ...!!!", "<|endoftext|≯ a<|startoftext|>b <|endoftext|", "éÅ İstanbul ΣΑΣ ﬁ  x　y \x1c z\x85",
    "a" * 5000 + " aaa aaaa", "\U0001f600\U0001f600 日本語 العر", "a\x00b ﻿c", "=" * 300, "'LL 'S's'd", "word " * 50_000,
]


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_and_decoding_match_the_library(spark):
    t = library()
    docs = spark.createDataFrame([(i, x, "old") for i, x in enumerate(NASTY)], "doc_id long, text string, ids string")
    out = bpe_encode(docs, PATH, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"))
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"]
    rows = out.collect()
    assert len(rows) == len(NASTY)
    for r in rows:
        want = t.encode(NASTY[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.decoded == t.decode(want, skip_special_tokens=False)
        assert r.ids_sha256 == sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(r.decoded.encode()).hexdigest()


def test_random_letters_exercise_the_pair_tests():
    v, t, rng = vocabulary(PATH), library(), random.Random(3)
    words = ["".join(rng.choice("abcehilnorst") for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    offsets, ids = Encoder(v).encode(pa.array(words))
    assert offsets[-1] == len(ids)
    for k, w in enumerate(words):
        assert t.encode(w, add_special_tokens=False).ids == ids[offsets[k] : offsets[k + 1]].tolist()


def same_as_library(texts):
    want = [e.ids for e in library().encode_batch([x or "" for x in texts], add_special_tokens=False)]
    for encoder in (Encoder(vocabulary(PATH)), library_encoder(PATH)):
        offsets, ids = encoder.encode(pa.array(texts, pa.string()))
        got = [ids[a:b].tolist() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        assert [x for x, a, b in zip(texts, got, want) if a != b] == []


def test_every_code_point_of_the_first_two_planes():
    """Letters, marks and digits that Python's own Unicode tables don't know yet included."""
    same_as_library([f"a{chr(c)}b A{chr(c)}'s {chr(c)}" for c in range(0x20000) if not 0xD800 <= c < 0xE000])


def test_mixtures_of_odd_characters():
    rng = random.Random(1)
    parts = [
        "'", "'s", "'RE", "'ll", "'d", "a", "m", "re", "B", "é", "É", "ß", "ſ", "İ", "ŉ", "Σ", "日", "\u0301", "\U0001f4a9", " ", "\n", "\x85", "\xa0", "\x1c", "\x00", "1", "²", ".", "!",
        "<|", "<|endoftext|>", "<|startoftext|>", "<|STARTOFTEXT|>",
    ]
    same_as_library(["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(20_000)] + [None, ""])


def test_repeated_rows_null_ids_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y"), (1, "a b", "x", "y"), (None, "c", None, None)], "doc_id long, text string, c0 string, ids_sha256 string")
    rows = bpe_encode(docs, PATH, ("n_tokens", "ids_sha256")).collect()
    assert [(r.doc_id, r.c0, r.n_tokens) for r in sorted(rows, key=lambda r: r.doc_id or 0)] == [(None, None, 1), (1, "x", 2), (1, "x", 2)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_encode(docs, PATH).count() == 0


def test_words_of_slices_of_a_column():
    texts = pa.array(["Zero é", " A b\tÀ c ", None, "", "LAST one"])
    for start in range(5):
        words, codes, offsets = words_of(texts[start:], lower=True)
        got = [[words[i].as_py() for i in codes[a:b]] for a, b in zip(offsets, offsets[1:])]
        assert got == [["zero", "é"], ["a", "b", "À", "c"], [], [], ["last", "one"]][start:]


def test_known_pieces_are_looked_up_once():
    class Counting(dict):
        asked = 0

        def get(self, *key):
            Counting.asked += 1
            return super().get(*key)

        def __getitem__(self, key):
            Counting.asked += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            Counting.asked += 1
            return super().__contains__(key)

    cache = bpe.Encoder(bpe.vocabulary(PATH))
    texts = pa.array(["one two's three", "two Œuvre <|endoftext|>"])
    want = cache.encode(texts)
    cache.known = Counting(cache.known)
    got = cache.encode(texts)
    assert [x.tolist() for x in got] == [x.tolist() for x in want]
    assert Counting.asked == len(cache.known)


@pytest.mark.parametrize("text", ["plain 'll don't 7x", "é À\xa0ÿ µ's\x85x", "œ Œ's “x” ſ İ", "a<|b <|endoftext|> ß", "漢字 😀'd"])
def test_pieces_do_not_depend_on_what_else_is_in_the_chunk(text):
    alone, _ = bpe.pieces_of(pa.array([text]))
    for other in ("a", "ÿ", "Œ", "漢", "<|x"):
        both, bounds = bpe.pieces_of(pa.array([other, text, None]))
        assert both.dictionary_decode()[bounds[1] : bounds[2]].to_pylist() == alone.dictionary_decode().to_pylist()


def test_known_pieces_are_bounded_in_bytes():
    cache = Encoder(vocabulary(PATH), lambda pieces: (np.ones(len(pieces), np.int64), np.full(len(pieces), 7, np.int32)))
    for k in range(50):
        cache.encode(pa.array([chr(97 + k % 26) * (100_000 + 26 * k + j) for j in range(10)]))
    assert sum(map(len, cache.known)) < 40 << 20


def test_pieces_that_come_back_stay_known_and_ids_stay_right():
    asked = Counter()
    v = vocabulary(PATH)

    def encode_pieces(pieces):
        asked.update(pieces)
        return v.encode_pieces(pieces)

    t, cache = library(), Encoder(v, encode_pieces, room=100_000)
    for k in range(40):
        texts = ["the same Œuvre again", *(f"w{'abcdefghij'[j % 10] * 3}{chr(97 + j // 10)}{chr(97 + k % 26)}{'xyz'[k % 3]}" for j in range(200)), None]
        offsets, ids = cache.encode(pa.array(texts))
        got = [ids[a:b].tolist() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert len(cache.known) < 900
    assert asked[b"same"] == asked[b"again"] == 1
    assert len(asked) > 5000
