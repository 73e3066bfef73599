"""Token-id files: texts encoded with the tokenizers library, written as checksummed blocks in ascending id order.

A store is a folder of Parquet files with one row per block: part, block (within the part), ids_before (within the
part), n_docs, n_ids, docs (the block's document table) and data (the coded ids, see range_coder). Parts follow the
order of document ids, blocks the order within a part, and no document is cut, so any block can be read alone.

Scale: one range shuffle of the texts orders them; a task holds one block's documents at a time. What goes to the
driver is one count per part.
"""

from __future__ import annotations

import itertools
import operator
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.bpe import Encoder, byte_letters, chunks, encoder, tidy, vocabulary
from framewright.llm.common import shared_dir
from framewright.llm.range_coder import decode_block, encode_block

#: A block closes at the first document end beyond this many ids.
BLOCK_IDS = 1 << 20
#: Bytes that known pieces may take: the library's model asks more time for a piece than a look-up does.
ROOM = 160 << 20
#: Pieces whose tokens the library's model holds as objects at once.
ASKED = 4096
ID = operator.attrgetter("id")


def library_encoder(path: str) -> Encoder:
    """An encoder of whole texts whose ids are the tokenizers library's: its model encodes each distinct piece.

    The library's own pass over whole texts takes about four times the time budget of this operator; its normaliser and
    splitter look at no more than a word, so they are run for odd words only (see bpe.pieces_of) and restated for others.
    """
    from tokenizers import Tokenizer

    tokenize = Tokenizer.from_file(path).model.tokenize
    letters = np.array([ord(c) for c in byte_letters()], np.uint32)

    def encode_pieces(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        spelt = letters[np.frombuffer(b"".join(pieces), np.uint8)].tobytes().decode("utf-32-le")
        ends = list(itertools.accumulate(map(len, pieces), initial=0))
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for a in range(0, len(pieces), ASKED):
            found = [tokenize(spelt[i:j]) for i, j in itertools.pairwise(ends[a : a + ASKED + 1])]
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(map(ID, itertools.chain.from_iterable(found)), np.int32, int(counts[-1].sum())))
        return np.concatenate(counts), np.concatenate(ids)

    return Encoder(vocabulary(path), encode_pieces, ROOM)


BLOCK_SCHEMA = "part int, block int, ids_before long, n_docs int, n_ids long, docs binary, data binary"
_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("ids_before", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("docs", pa.binary()), ("data", pa.binary())])


def _table(doc_ids: pa.Array, counts: np.ndarray) -> bytes:
    """The block's documents: ids, whether each is null, and how many token ids each has."""
    null = pc.is_null(doc_ids).to_numpy(zero_copy_only=False)
    plain = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False)
    return zlib.compress(plain.astype("<i8").tobytes() + null.astype("u1").tobytes() + counts.astype("<i8").tobytes(), 1)


def _documents(docs: bytes, n: int) -> tuple[pa.Array, np.ndarray]:
    raw = zlib.decompress(docs)
    null = np.frombuffer(raw, "u1", n, 8 * n).astype(bool)
    return pa.array(np.frombuffer(raw, "<i8", n), mask=null), np.frombuffer(raw, "<i8", n, 9 * n)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the store of ``docs`` at ``path``: each whole text's ids and ``end_id``, in ascending id order.

    Null texts count as empty (the end id alone); null ids come first; rows of equal ids go by text. An empty table
    writes an empty store.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = encoder((tokenizer, "library"), lambda: library_encoder(tokenizer))
        alphabet = cache.vocab.size
        block, before, part = 0, 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal block, before, held
            names = pa.concat_arrays([h[0] for h in held])
            counts, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            row = [part, block, before, len(counts), len(ids), _table(names, counts), encode_block(ids, max(alphabet, end_id + 1))]
            block, before, held = block + 1, before + len(ids), []
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)

        for batch in chunks(batches):
            part = batch.column("part")[0].as_py()
            offsets, ids = cache.encode(batch.column("text"))
            counts = np.diff(offsets) + 1
            ids = np.insert(ids, offsets[1:], end_id)
            held.append((batch.column("doc_id"), counts, ids))
            if sum(len(h[2]) for h in held) >= BLOCK_IDS:
                yield close()
        if held:
            yield close()

    ordered.mapInArrow(encode, BLOCK_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of the store: doc_id, start, n_tokens, ids_crc32 and, if asked, ids (array). Checksums are verified."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    parts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base = spark.createDataFrame(
        [(p, int(s)) for (p, n), s in zip(parts, np.cumsum([0] + [n for _, n in parts]))], "part int, base long"
    )
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["data"])
                names, counts = _documents(row["docs"], row["n_docs"])
                if counts.sum() != len(ids):
                    raise ValueError("damaged block")
                ends = np.cumsum(counts)
                view = memoryview(ids.astype("<u4")).cast("B")
                crcs = [zlib.crc32(view[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                out = [names, pa.array(ends - counts + (row["base"] + row["ids_before"])), pa.array(counts), pa.array(crcs, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return blocks.join(F.broadcast(base), "part").mapInArrow(tidy(decode), kind)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, path, with_ids=False)
