"""Quality classifier: an interpolated modified Kneser-Ney n-gram model per language, trained on trusted text.

Grams are ORDER bytes of UTF-8. Tasks count the distinct grams of what they read; the counts of all trusted documents
are added up, and the continuation counts of every lower order, the context totals and the discounts follow from them by
grouping. The distinct grams of all documents are then joined with these count tables, order by order, which gives each
of them its probability. A document's perplexity is the mean over its bytes, its peak the mean over its least likely word,
which a few bad words in a long text raise as well as in a short one. A document is rejected if either lies above its
language's quantile of the same figure over trusted documents that were held out of training.

Scale: per byte only tasks work; what is shuffled are distinct grams per task. The joined table is broadcast for scoring
while it has at most MAX_TABLE_ROWS rows (96 MB, held once a worker as sorted arrays). A larger model stays in shards, and
blocks of documents ask it for their grams by a join, with the same results. That way always would cost more disk than this
operator may take (its texts once to the store and once through a shuffle), so the small model has the short way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.bpe import chunks, tidy
from framewright.llm.common import stored
from framewright.llm.minhash import MAX_BROADCAST_IDS

ORDER = 5
QUANTILE = 0.995
#: The table of probabilities is broadcast up to so many rows (12 bytes each) and languages.
MAX_TABLE_ROWS, MAX_LANGS = 8_000_000, 1000
#: Accuracy of the quantile sketch: ranks are right within one in so many.
SKETCH = 10_000
#: One in so many trusted documents is held out of training; the thresholds come from them.
HELD_OUT = 5
GRAM_BITS = 8 * ORDER
#: A counting task sends what it holds beyond so many distinct grams of chunks (16 bytes each).
HELD_ROWS = 2_000_000
#: Bytes of text at a time; a byte takes about 50 bytes of working memory.
CHUNK = 2 << 20
#: Bytes of text that ask a sharded model together.
BLOCK = 8 << 20
#: Bytes of a word with its separator: shorter ones have no peak of their own, longer runs are judged in pieces.
LEAST_WORD, LONGEST_WORD = 4, 24


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(grams, offsets): for each byte of each text the gram that ends there, zeros before the text's start."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    first = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset] if len(texts) else 0
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first : first + offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    out = data.astype(np.int64)
    for back in range(1, ORDER):
        before = np.zeros(len(data), np.int64)
        before[back:] = data[: max(0, len(data) - back)]
        for t in range(back):  # these bytes belong to the text before
            at = offsets[:-1][sizes > t] + t
            before[at] = 0
        out |= before << (8 * back)
    return out, offsets


def doc_scores(key: np.ndarray, offsets: np.ndarray, logp: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(perplexity, peak) of each text, from its bytes' grams and their logarithms of probability; null where it has none."""
    sizes = np.diff(offsets)
    sums = np.add.reduceat(np.append(logp, 0.0), offsets[:-1]) if len(sizes) else np.zeros(0)
    perplexity = pa.array(np.exp(-sums / np.maximum(sizes, 1)), mask=sizes == 0)
    last = key & 0xFF
    space = (last == 32) | ((last >= 9) & (last <= 13))
    begins = np.zeros(len(key), bool)
    begins[1:] = space[:-1]
    begins[offsets[:-1][sizes > 0]] = True
    at = np.arange(len(key))
    begins |= (at - np.maximum.accumulate(np.where(begins, at, 0))) % LONGEST_WORD == 0
    word = np.nonzero(begins)[0]
    length = np.diff(np.append(word, len(key)))
    mean = -(np.add.reduceat(logp, word) if len(word) else np.zeros(0)) / length
    worst = np.full(len(sizes), -np.inf)
    np.maximum.at(worst, np.searchsorted(offsets, word[length >= LEAST_WORD], "right") - 1, mean[length >= LEAST_WORD])
    none = np.isinf(worst)
    return perplexity, pa.array(np.exp(np.where(none, 0.0, worst)), mask=none)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): grams of rows (lang, text), counted per task and chunk; add them up by (lang, gram)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows = 0

        def send() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in chunks(batches, size=CHUNK):
            langs = pc.fill_null(batch.column("lang"), "").dictionary_encode()
            keys, offsets = grams(batch.column("text"))
            which = np.repeat(langs.indices.to_numpy().astype(np.int64), np.diff(offsets))
            both, n = np.unique(keys | which << GRAM_BITS, return_counts=True)
            cuts = np.searchsorted(both, np.arange(len(langs.dictionary) + 1) << GRAM_BITS)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                part = slice(cuts[k], cuts[k + 1])
                held.setdefault(lang, []).append((both[part] & (1 << GRAM_BITS) - 1, n[part]))
            rows += len(both)
            if rows > HELD_ROWS:
                yield from send()
                rows = 0
        yield from send()

    return docs.select("lang", "text").mapInArrow(tidy(count), "lang string, gram long, n long")


def count_tables(trusted: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Per order k: counts (lang, gram, c), continuation counts below ORDER; contexts (lang, context, total, gamma, d1-d3)."""
    tables = {}
    counts = stored(gram_counts(trusted).groupBy("lang", "gram").agg(F.sum("n").alias("c")), "grams")
    for k in range(ORDER, 0, -1):
        of_counts = [F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

        def discount(i: int, y=y):
            value = i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
            usable = (F.col("n1") > 0) & (F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0)
            return F.when(usable, F.greatest(F.least(value, F.lit(float(i))), F.lit(0.05))).otherwise(F.lit(0.5 + 0.25 * i)).alias(f"d{i}")

        discounts = counts.groupBy("lang").agg(*of_counts).select("lang", *[discount(i) for i in (1, 2, 3)])
        contexts = counts.groupBy("lang", F.shiftright("gram", 8).alias("context")).agg(
            F.sum("c").cast("double").alias("total"), *[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2)], F.count_if(F.col("c") > 2).alias("n3")
        )
        contexts = contexts.join(discounts, "lang").select(
            "lang", "context", "total", ((F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")).alias("gamma"), "d1", "d2", "d3"
        )
        tables[k] = counts, stored(contexts, f"contexts{k}")
        if k > 1:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
            counts = stored(counts.groupBy("lang", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("c")), f"grams{k - 1}")
    return tables


def gram_probabilities(wanted: DataFrame, tables: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(lang, gram, logp) of the grams ``wanted`` (lang, gram): natural logarithms of interpolated probabilities."""
    out = wanted.select("lang", "gram", F.lit(1 / 256).alias("p"))
    for k in range(1, ORDER + 1):
        counts, contexts = tables[k]
        out = out.withColumn("part", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).withColumn("context", F.shiftright("part", 8))
        out = out.join(counts.withColumnRenamed("gram", "part"), ["lang", "part"], "left").join(contexts, ["lang", "context"], "left")
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        seen = F.coalesce(F.greatest(F.col("c") - cut, F.lit(0.0)) / F.col("total"), F.lit(0.0))
        out = out.select("lang", "gram", F.when(F.col("total").isNull(), F.col("p")).otherwise(seen + F.col("gamma") * F.col("p")).alias("p"))
    return out.select("lang", "gram", F.log("p").alias("logp"))


def perplexities(docs: DataFrame, table: DataFrame, max_table_rows: int = MAX_TABLE_ROWS) -> DataFrame:
    """(id, lang, trusted, perplexity, peak) of rows (id, lang, trusted, text); null for texts without bytes (or words)."""
    langs = [r["lang"] for r in table.select("lang").distinct().limit(MAX_LANGS + 1).collect()]
    if len(langs) > MAX_LANGS or table.count() > max_table_rows:
        return _blocked_perplexities(docs, table)
    code = F.element_at(F.create_map(*[F.lit(x) for k, lang in enumerate(langs) for x in (lang, k << GRAM_BITS)]), F.col("lang")) if langs else F.lit(0)
    rows = table.select(F.col("gram").bitwiseOR(code).alias("key"), F.col("logp").cast("float").alias("logp")).toArrow()
    keys = rows.column("key").to_numpy()
    order = np.argsort(keys)
    model = docs.sparkSession.sparkContext.broadcast((langs, keys[order], rows.column("logp").to_numpy()[order]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, logp = model.value  # loaded once a worker
        for batch in chunks(batches, size=CHUNK):
            yield _scored(batch, names, known, logp)

    return docs.select("id", "lang", "trusted", "text").mapInArrow(tidy(score), SCORED)


SCORED = "id long, lang string, trusted boolean, perplexity double, peak double"


def _scored(rows: pa.RecordBatch | pa.Table, langs: list[str], known: np.ndarray, logp: np.ndarray) -> pa.RecordBatch:
    """SCORED columns of rows (id, lang, trusted, text), from sorted keys (gram, with its language's index above) and their logarithms."""
    lang = pc.fill_null(rows.column("lang"), "")
    at = pc.fill_null(pc.index_in(lang, value_set=pa.array(langs, pa.string())), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    key, offsets = grams(rows.column("text"))
    own, which = np.unique(key | np.repeat(at, np.diff(offsets)) << GRAM_BITS, return_inverse=True)
    made = doc_scores(key, offsets, logp[np.searchsorted(known, own)].astype(np.float64)[which])
    return pa.RecordBatch.from_arrays([rows.column("id"), lang, rows.column("trusted"), *made], names=["id", "lang", "trusted", "perplexity", "peak"])


def _blocked_perplexities(docs: DataFrame, table: DataFrame) -> DataFrame:
    """The same with the model in shards: each block of documents asks for its distinct grams, and is scored where the answers meet it.

    A block has about BLOCK bytes of text (or one document), packed; a gram has a row a block, whatever its share of the text.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = number = 0
        part = 0

        def send() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(whole)
            block = part << 24 | number
            langs = pc.fill_null(whole.column("lang"), "").dictionary_encode()
            key, offsets = grams(whole.column("text"))
            which = np.repeat(langs.indices.to_numpy().astype(np.int64), np.diff(offsets))
            both = np.unique(key | which << GRAM_BITS)
            cuts = np.searchsorted(both, np.arange(len(langs.dictionary) + 1) << GRAM_BITS)
            asked = [both[a:b] & (1 << GRAM_BITS) - 1 for a, b in zip(cuts, cuts[1:])]
            n = 1 + len(asked)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.int64()), pa.array([sink.getvalue().to_pybytes()] + [None] * len(asked), pa.binary()), pa.array([None, *langs.dictionary.to_pylist()], pa.string()), pa.array([None, *asked], pa.list_(pa.int64()))],
                names=["block", "data", "lang", "grams"],
            )

        for batch in chunks(batches, size=BLOCK):
            part = batch.column("part")[0].as_py()
            held.append(batch.drop_columns(["part"]))
            size += batch.nbytes
            if size >= BLOCK:
                yield from send()
                held, size, number = [], 0, number + 1
        if held:
            yield from send()

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        langs = answers.column("lang").unique().to_pylist()
        at = pc.index_in(answers.column("lang"), value_set=pa.array(langs, pa.string())).to_numpy().astype(np.int64)
        known = answers.column("gram").to_numpy() | at << GRAM_BITS
        order = np.argsort(known)
        known, logp = known[order], answers.column("logp").to_numpy().astype(np.float32)[order]
        out = []
        for data in block.column("data"):
            for batch in pa.ipc.open_stream(data.as_buffer()):
                out += [_scored(part, langs, known, logp) for part in chunks(iter([batch]), size=CHUNK)]
        return pa.Table.from_batches(out)

    rows = docs.select("id", "lang", "trusted", "text", F.spark_partition_id().alias("part"))
    blocks = stored(rows.mapInArrow(tidy(pack), "block long, data binary, lang string, grams array<long>"), "blocks")
    asked = blocks.filter("grams is not null").select("block", "lang", F.explode("grams").alias("gram"))
    answers = asked.join(table, ["lang", "gram"]).select("block", "lang", "gram", "logp")
    packed = blocks.filter("data is not null").select(F.col("block").alias("of"), "data")
    return packed.groupBy("of").cogroup(answers.groupBy("block")).applyInArrow(score, SCORED)


def quality(
    docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    max_table_rows: int = MAX_TABLE_ROWS,
) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, peak, peak_threshold, accepted) per row of ``docs``; ``trusted_ids`` (doc_id) names trusted documents.

    Each language (null: one of its own, the empty name) has its own model and thresholds: the ``quantile`` of the
    perplexities and of the peaks of its held-out trusted documents (of all trusted ones where none is held out); which
    are held out follows from their ids. A document is rejected if its perplexity or its peak is above its threshold.
    The peak is the perplexity of the worst word (of LEAST_WORD bytes or more, with its separator; runs beyond
    LONGEST_WORD bytes in pieces). Texts without bytes have no perplexity, texts without such words no peak, and a
    language without trusted text has no thresholds; what is missing rejects nothing. Ids that are null or
    occur nowhere are not trusted; repeated rows have equal results. Other columns don't matter; an empty table gives an
    empty result.
    """
    ids = stored(trusted_ids.select(F.col("doc_id").cast("long").alias("_trusted")).filter("_trusted is not null").distinct(), "trusted")
    side = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang"), docs[text_col].alias("text"))
    rows = rows.join(side, rows["id"] == ids["_trusted"], "left").select("id", "lang", "text", F.col("_trusted").isNotNull().alias("trusted"))
    held_out = F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) == 0
    tables = count_tables(rows.filter(F.col("trusted") & ~held_out))
    wanted = gram_counts(rows).select("lang", "gram").distinct()
    table = stored(gram_probabilities(wanted, tables), "logp")
    scored = stored(perplexities(rows, table, max_table_rows), "perplexities")
    limit = lambda value: F.percentile_approx(value, F.lit(quantile), F.lit(SKETCH))
    limits = scored.filter("trusted").groupBy("lang").agg(
        *[F.coalesce(limit(F.when(held_out, F.col(c))), limit(F.col(c))).alias(name) for c, name in (("perplexity", "threshold"), ("peak", "peak_threshold"))]
    )
    fits = [F.coalesce(F.col(c) <= F.col(name), F.lit(True)) for c, name in (("perplexity", "threshold"), ("peak", "peak_threshold"))]
    return scored.join(F.broadcast(limits), "lang", "left").select(
        F.col("id").alias("doc_id"), "lang", "perplexity", "threshold", "peak", "peak_threshold", (fits[0] & fits[1]).alias("accepted")
    )


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def drop_rejected(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without rejected documents; columns unchanged; rows with a null id stay."""
    gone = stored(quality(docs, trusted_ids, id_col=id_col, **options).filter(~F.col("accepted")).select(F.col("doc_id").alias("_rejected")).distinct(), "rejected")
    few = gone.count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col] == gone["_rejected"], "left_anti")


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs, trusted_documents(spark.read.parquet(f"{sf_dir}/labels.parquet")))
