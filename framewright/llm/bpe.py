"""BPE encoding by dynamic programming over prefixes, and decoding.

Texts are cut into the vocabulary's pieces, each distinct piece of a partition is encoded once, and ids are gathered back
per document, so that the work a piece needs doesn't depend on how often it occurs. Cutting runs over the code points of a
chunk at once; words with code points beyond Latin Extended-A take their pieces from the library's own normaliser and splitter. For every prefix of a piece, a suffix
automaton (the vocabulary's tokens, read backwards) yields the tokens that the prefix ends with. Exactly one of them is
compatible with the unique last token of the shorter prefix that remains; it is stored, and the ids of the piece are
read off by back-pointers. Two tokens are compatible if undoing their merges, newest first, never meets a boundary pair
that would have merged earlier. The automaton walks and pair tests of all pieces of a chunk run together in numpy.

It is a map over documents: nothing shuffles. Memory per task is bounded by ENCODE_BYTES of text (or one document) with
its working arrays, and by ROOM bytes of known pieces.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
#: Text that is encoded together: working arrays take about 40 times as much.
ENCODE_BYTES = 1 << 20
#: Bytes that an encoder's known pieces may take before it forgets; PIECE_BYTES are those of a piece besides its text and ids.
ROOM = 32 << 20
PIECE_BYTES = 160
#: Kinds of code points that tell pieces apart; ODD ones are left to the library's own rules.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
#: Code points from here on are ODD.
PLAIN = 0x180
#: White space below PLAIN, and the endings that an apostrophe keeps, of the vocabulary's splitter.
SPACES = "\t\n\v\f\r \x85\xa0"
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Table:
    """Non-negative int64 keys to int32 values by open addressing, looked up for whole arrays; -1 where missing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(len(keys) * 6).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # of keys at one slot the last stays; the others go on
            placed = self.keys[at] == keys[left]
            self.values[at[placed]] = values[left[placed]]
            at, left = (at[~placed] + 1) & self.mask, left[~placed]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.nonzero((there != keys) & (there != -1))[0]
        while len(left):
            at_left = (at[left] + 1) & self.mask
            at[left] = at_left
            there = self.keys[at_left]
            hit = there == keys[left]
            out[left[hit]] = self.values[at_left[hit]]
            left = left[~hit & (there != -1)]
        return out


class Vocabulary:
    """A BPE vocabulary with word ends, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids, self.end = model["vocab"], model["end_of_word_suffix"]
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.order = np.zeros(size, np.int64)  # 0: a base symbol
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        for rank, (a, b) in enumerate(pairs):
            t = ids[a + b]
            if self.order[t]:
                raise ValueError(f"two merges make {a + b!r}")
            self.left[t], self.right[t], self.order[t] = ids[a], ids[b], rank + 1
        made = np.nonzero(self.order)[0]
        self.size = size
        self.pair_order = Table(self.left[made] * size + self.right[made], self.order[made].astype(np.int32))
        self._automaton(ids)
        self.path, self._rules = path, None
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _automaton(self, ids: dict[str, int]) -> None:
        """States of the tokens read backwards; symbol 256 is the word end."""
        symbol = {c: b for b, c in enumerate(byte_letters())}
        edges: dict[tuple[int, int], int] = {}
        accepts = [-1]
        for token, i in ids.items():
            ended = token.endswith(self.end) and token != self.end
            letters = [symbol[c] for c in (token.removesuffix(self.end) if ended else token)]
            state = 0
            for s in [256] * ended + letters[::-1]:
                key = (state, s)
                if key not in edges:
                    edges[key] = len(accepts)
                    accepts.append(-1)
                state = edges[key]
            accepts[state] = i
        keys = np.array([a * 257 + s for a, s in edges], np.int64)
        self.step = Table(keys, np.array(list(edges.values()), np.int32))
        self.accepts = np.array(accepts, np.int64)
        self.end_state = edges.get((0, 256), 0)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges of the texts of a[k] and b[k], side by side, end in just these two tokens."""
        good = self.pair_order(a * self.size + b) < 0
        at = np.nonzero(good)[0]
        x, y = a[at], b[at]
        while len(at):
            ox, oy = self.order[x], self.order[y]
            of_b = oy >= ox  # undo the newer merge; of equal ones the right one, as the left one was first
            limit = np.maximum(ox, oy)
            more = limit > 0
            at, x, y, of_b, limit = at[more], x[more], y[more], of_b[more], limit[more]
            x, y = np.where(of_b, x, self.right[x]), np.where(of_b, self.left[y], y)
            m = self.pair_order(x * self.size + y)
            bad = (m >= 0) & (m < limit + of_b)
            good[at[bad]] = False
            at, x, y = at[~bad], x[~bad], y[~bad]
        return good

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids): the tokens of every non-empty piece, one after another."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        text = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        last = np.full(len(text), -1, np.int64)  # the last token of the prefix that ends at this byte
        active = np.argsort(sizes, kind="stable")[::-1]
        for i in range(1, int(sizes.max(initial=0)) + 1):
            active = active[: np.searchsorted(-sizes[active], -i, side="right")]
            self._prefix(active, i, sizes, starts, text, last)
        # back-pointers: a token's length leads to the prefix before it
        lengths = self._lengths()
        counts = np.zeros(len(pieces), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        which, at, step = np.arange(len(pieces)), starts + sizes, 0
        while len(which):
            token = last[at - 1]
            found.append((which, np.full(len(which), step), token))
            counts[which] += 1
            at = at - lengths[token]
            more = at > starts[which]
            which, at, step = which[more], at[more], step + 1
        first = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.int32)
        for which, step, token in found:
            ids[first[which] + counts[which] - 1 - step] = token
        return counts, ids

    def _prefix(self, words, i, sizes, starts, text, last) -> None:
        """Stores the last token of the prefix of i bytes of each of these words."""
        ended = sizes[words] == i
        state = np.where(ended, self.end_state, 0)
        for length in range(1, i + 1):
            state = self.step(state * 257 + text[starts[words] + i - length]).astype(np.int64)
            alive = state >= 0
            words, state = words[alive], state[alive]
            if not len(words):
                return
            token = self.accepts[state]
            can = np.nonzero(token >= 0)[0]
            if length < i:
                before = last[starts[words[can]] + i - length - 1]
                can, before = can[before >= 0], before[before >= 0]
                can = can[self.compatible(before, token[can])]
            last[starts[words[can]] + i - 1] = token[can]
            keep = np.ones(len(words), bool)
            keep[can] = False
            words, state = words[keep], state[keep]

    def _lengths(self) -> np.ndarray:
        if not hasattr(self, "_sizes"):
            self._sizes = np.array([len(t.removesuffix(self.end)) if t != self.end else len(t) for t in self.tokens], np.int64)
        return self._sizes

    def odd_pieces(self, word: str) -> list[bytes | int]:
        """Pieces, or special ids, of a word with odd code points or special tokens, by the library's normaliser and splitter."""
        if self._rules is None:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(self.path)
            self._rules = library.normalizer, library.pre_tokenizer, {c: b for b, c in enumerate(byte_letters())}
        normalizer, splitter, byte = self._rules
        found: list[bytes | int] = []
        for part in self.special_split.split(word) if self.special_split else [word]:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                found += [bytes(byte[c] for c in piece) for piece, _ in splitter.pre_tokenize_str(normalizer.normalize_str(part))]
        return found


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(kind, lower case) of every code point below PLAIN; the last entry stands for all others."""
    kind, lower = np.full(PLAIN + 1, ODD, np.uint8), np.arange(PLAIN + 1, dtype=np.uint32)
    for c in range(PLAIN):
        small = chr(c).lower()
        if len(small) == 1:
            lower[c] = ord(small)
            kind[c] = SPACE if chr(c) in SPACES else {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], OTHER)
    return kind, lower


KIND, LOWER = _tables()
#: The same for bytes.translate: code points below 256, whose lower case is there, too.
BYTES = KIND[:256].tobytes(), LOWER[:256].astype(np.uint8).tobytes()


def pieces_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(pieces, offsets): what the vocabulary's normaliser and splitter make of whole texts; text k has pieces offsets[k]:offsets[k+1].

    A word with a code point from PLAIN on, or with the beginning of a special token, is one piece: a space, which no
    other piece has, and the word as it stands.
    """
    joined = "\n".join(["", *pc.fill_null(texts, "").to_pylist(), ""])
    try:
        low, wide = joined.encode("latin-1"), np.zeros(0, np.int64)
        code = np.frombuffer(low, np.uint8)
    except UnicodeEncodeError:
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        low, wide = code.astype(np.uint8).tobytes(), np.nonzero(code > 0xFF)[0]
    kind, text = (np.frombuffer(bytearray(low).translate(t), np.uint8) for t in BYTES)
    odd = wide
    if len(wide):  # code points that no byte holds
        small = np.minimum(code[wide], PLAIN)
        kind[wide] = KIND[small]
        odd = wide[kind[wide] == ODD]
        text = text.astype(np.uint32)
        text[wide] = np.where(kind[wide] == ODD, code[wide], LOWER[small])
    if "<|" in joined:
        odd = np.concatenate([odd, np.nonzero((code[:-1] == ord("<")) & (code[1:] == ord("|")))[0]])
    begins = kind == DIGIT
    begins[0] = True
    begins[1:] |= kind[1:] != kind[:-1]
    keep = kind != SPACE
    quote = np.nonzero(text == ord("'"))[0]
    quote = quote[begins[quote] & (kind[quote + 1] == LETTER)]
    for ending in ENDINGS:
        at = quote
        for j, c in enumerate(ending):
            at = at[text[at + 1 + j] == ord(c)]
        begins[at + 1] = False
        after = at + 1 + len(ending)
        begins[after[kind[after] == LETTER]] = True
    if len(odd):
        word = np.cumsum(kind == SPACE)
        of_odd = np.zeros(int(word[-1]) + 1, bool)
        of_odd[word[odd]] = True
        inside = of_odd[word] & keep
        heads = np.nonzero(inside[1:] & ~inside[:-1])[0]  # the space before the word
        begins[inside], begins[heads], keep[heads] = False, True, True
        text[inside] = code[inside]
        text[heads] = ord(" ")
    begins &= keep
    kept = text[keep]
    first = np.nonzero(begins[keep])[0]
    size = 1 + (kept >= 0x80).view(np.uint8)
    if len(wide):
        size += (kept >= 0x800).view(np.uint8) + (kept >= 0x10000).view(np.uint8)
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    offsets = np.append(ends[first], ends[-1])
    data = kept.tobytes().decode("utf-32-le" if len(wide) else "latin-1").encode()
    pieces = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
    return pieces.dictionary_encode(), np.searchsorted(np.nonzero(begins)[0], bounds)


class Encoder:
    """Ids of whole texts; each distinct piece is encoded once while it is known, and known ones take about ``room`` bytes."""

    def __init__(self, vocab: Vocabulary, encode_pieces=None, room: int = ROOM):
        self.vocab, self.encode_pieces, self.room = vocab, encode_pieces or vocab.encode_pieces, room
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.counts, self.ids, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.sizes, self.again = np.zeros(0, np.int64), np.zeros(0, bool)  # bytes of memory; met since learnt or last kept

    def _forget(self) -> None:
        """Keeps the pieces that were met again, if they leave half of the room; else none."""
        kept = np.nonzero(self.again)[0]
        if self.sizes[kept].sum() > self.room // 2:
            self._reset()
            return
        self.known = dict(zip(itertools.compress(self.known, self.again.tolist()), range(len(kept))))
        self.counts, self.sizes, self.again = self.counts[kept], self.sizes[kept], np.zeros(len(kept), bool)
        self.ids = self.ids[ragged(self.starts[kept], self.counts)]
        self.starts = np.cumsum(self.counts) - self.counts

    def _learn(self, pieces: list[bytes]) -> None:
        plain = [p for p in pieces if p[:1] != b" "]
        odd = [(p, self.vocab.odd_pieces(p[1:].decode())) for p in pieces if p[:1] == b" "]
        parts = {q for _, found in odd for q in found if isinstance(q, bytes)} - {*plain}
        counts, ids = self.encode_pieces([*plain, *parts])
        if odd:
            ends = np.cumsum(counts)
            known = {p: ids[e - n : e] for p, e, n in zip([*plain, *parts], ends.tolist(), counts.tolist())}
            counts = counts[: len(plain)]
            made = [np.concatenate([known[q] if isinstance(q, bytes) else np.array([q], np.int32) for q in found] or [np.zeros(0, np.int32)]) for _, found in odd]
            ids = np.concatenate([ids[: counts.sum()], *made])
            counts = np.concatenate([counts, [len(m) for m in made]]).astype(np.int64)
        learnt = [*plain, *(p for p, _ in odd)]
        self.known.update(zip(learnt, range(len(self.known), len(self.known) + len(learnt))))
        sizes = np.fromiter(map(len, learnt), np.int64, len(learnt)) + 4 * counts + PIECE_BYTES
        self.sizes, self.again = np.concatenate([self.sizes, sizes]), np.concatenate([self.again, np.zeros(len(learnt), bool)])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids.astype(np.int32)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of whole texts: ids[offsets[k]:offsets[k+1]] are those of text k."""
        pieces, bounds = pieces_of(texts)
        distinct = pieces.dictionary.to_pylist()
        if self.sizes.sum() > self.room:
            self._forget()
        rows = np.fromiter(map(self.known.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        unknown = np.nonzero(rows < 0)[0]
        self.again[rows[rows >= 0]] = True
        if len(unknown):
            new = [distinct[k] for k in unknown.tolist()]
            self._learn(new)
            rows[unknown] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        rows = rows[pieces.indices.to_numpy()]
        counts = self.counts[rows]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ends[bounds], self.ids[ragged(self.starts[rows], counts)]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(key: tuple, make) -> Encoder:
    """A worker's encoder for ``key``: later tasks of the same worker find the pieces of earlier ones."""
    if key not in _ENCODERS:
        _ENCODERS[key] = make()
    return _ENCODERS[key]


def release_memory() -> None:
    """Gives back what ended tasks hold in this worker: caches, Arrow's pool and the allocator's free pages."""
    _ENCODERS.clear()
    _LOADED.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def tidy(task):
    """``task`` for mapInArrow, with the worker's memory given back before and after it."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // size
        cuts = [0, *(np.nonzero(np.diff(group))[0] + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def words_of(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, codes, offsets): runs without ASCII white space of whole texts, A-Z in lower case if asked.

    Text k has the words ``codes[offsets[k]:offsets[k+1]]``; null texts have none. Words are distinct before they are
    put in lower case.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten().dictionary_encode()
    offsets = split.offsets.to_numpy().astype(np.int64)
    codes, offsets = flat.indices.to_numpy().astype(np.int64), offsets - offsets[0]
    empty = pc.index(flat.dictionary, "").as_py()  # before, after and instead of words
    if empty >= 0:
        real = codes != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return pc.ascii_lower(flat.dictionary) if lower else flat.dictionary, codes, offsets


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, loaded once a worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def decode(tokens: pa.Array, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Per list of ids, their tokens joined by one space (the vocabulary has no decoder of its own)."""
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pc.take(tokens, pa.array(ids)))
    return pc.binary_join(lists, " ")


RESULTS = {
    "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(),
}


def bpe_encode(docs: DataFrame, path: str, results: tuple[str, ...] = ("n_tokens", "ids"), text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with the ``results`` of encoding each whole text, and decoding its ids.

    Results: n_tokens, ids, decoded (ids read back as text), ids_sha256 (of decimal ids joined by a space) and
    decoded_sha256. ``path``: a BPE vocabulary file with word ends, readable by every executor. Null texts count as empty
    and give no ids. Rows aren't merged or dropped; an empty table gives an empty result. Columns of ``docs`` named like a
    result are replaced.
    """
    carried = [c for c in (docs.columns if columns is None else columns) if c not in results]
    plain = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(carried)], docs[text_col].alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        cache = encoder((path, "own"), lambda: Encoder(v))
        decimals, tokens = pa.array(map(str, range(v.size))), pa.array(v.tokens)
        for batch in chunks(batches, size=ENCODE_BYTES):
            offsets, ids = cache.encode(batch.column("text"))
            made: dict[str, pa.Array] = {"n_tokens": pa.array(np.diff(offsets))}
            if "ids" in results:
                made["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            if "ids_sha256" in results:
                made["ids_sha256"] = digests(decode(decimals, offsets, ids))
            if {"decoded", "decoded_sha256"} & {*results}:
                made["decoded"] = decode(tokens, offsets, ids)
                made["decoded_sha256"] = digests(made["decoded"])
            arrays = [batch.column(k) for k in range(len(carried))] + [made[r].cast(RESULTS[r]) for r in results]
            yield pa.RecordBatch.from_arrays(arrays, names=[*[f"c{k}" for k in range(len(carried))], *results])

    kinds = {"n_tokens": "long", "ids": "array<int>"}
    fields = [f"c{k} {kind}" for k, (_, kind) in enumerate(plain.dtypes[:-1])] + [f"{r} {kinds.get(r, 'string')}" for r in results]
    out = plain.mapInArrow(encode, ", ".join(fields))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carried)], *results)


def digests(texts: pa.Array) -> pa.Array:
    return pa.array([sha256(t.as_buffer()).hexdigest() for t in texts], pa.string())


def op2_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"), columns=["doc_id"])
