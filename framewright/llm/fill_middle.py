"""Fill-in-the-middle training texts: a text is cut at two units and written prefix, suffix, middle or suffix, prefix, middle.

A unit is a run without white space together with the white space before it; white space at the end is a unit of its own.
The units of a text form an indexable skip list: the lowest lane links every unit to the next, each express lane links
every FAN-th node of the lane below, and a link carries its width in units and in code points. A cut is given as a rank
in units; descending from the highest lane, a link is taken while its width in units doesn't pass the rank, and the
widths in code points add up to the place of the cut. A descent takes less than FAN links a lane, whatever the length of
the text. The lists of all texts of a chunk are built and descended together in numpy; the map needs no shuffle, and a
task holds one chunk (or one text) at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.bpe import chunks, tidy
from framewright.llm.common import renamed

FAN = 8
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


class SkipLists:
    """Indexable skip lists of several texts: ``counts`` units in each, ``points`` code points in every unit, text by text."""

    def __init__(self, counts: np.ndarray, points: np.ndarray):
        self.lanes = []  # from the lowest: links a list, first link of each list, width in units and in code points of each link
        units = np.ones(len(points), np.int64)
        while True:
            first = np.cumsum(counts) - counts
            self.lanes.append((counts, first, units, points))
            if counts.max(initial=0) <= FAN:
                break
            fewer = -(-counts // FAN)
            own = np.repeat(np.arange(len(counts)), fewer)
            begins = first[own] + FAN * (np.arange(len(own)) - np.repeat(np.cumsum(fewer) - fewer, fewer))
            units, points = np.add.reduceat(units, begins), np.add.reduceat(points, begins)
            counts = fewer

    def reach(self, ranks: np.ndarray) -> np.ndarray:
        """The code points before unit ``ranks[k]`` of list k, for every list; a rank is at most the number of units."""
        passed, at = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        place = np.zeros(len(ranks), np.int64)
        for counts, first, units, points in reversed(self.lanes):
            at *= FAN  # down: the same node on the lane below
            for _ in range(FAN):
                left = np.nonzero(at < counts)[0]
                link = first[left] + at[left]
                fits = passed[left] + units[link] <= ranks[left]
                on, link = left[fits], link[fits]
                if not len(on):
                    break
                passed[on] += units[link]
                place[on] += points[link]
                at[on] += 1
        return place


def units_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(units a text, code points of every unit) of texts without nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    begins = offsets[:-1] - offsets[0]
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    start = np.zeros(len(raw) + 1, bool)
    start[1:-1] = blank[1:] & ~blank[:-1] if len(raw) else False
    start[begins] = True
    start = start[: len(raw)]  # empty texts at the end begin behind it
    filled = np.diff(offsets) > 0
    counts = np.zeros(len(begins), np.int64)
    if len(raw):
        counts[filled] = np.add.reduceat(start, begins[filled], dtype=np.int64)
        points = np.add.reduceat((raw & 0xC0) != 0x80, np.nonzero(start)[0], dtype=np.int64)
    else:
        points = np.empty(0, np.int64)
    return counts, points


def _draws(seed: int, ident: Column) -> list[Column]:
    """Four unsigned 32-bit integers of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80,
    marks: tuple[str, str, str] = MARKS, columns: list[str] | None = None,
) -> DataFrame:
    """Rows of ``docs`` (``columns`` of it, all by default) with n units, form, prefix_chars, middle_chars and output.

    Both cuts, and whether and how a text is cut, follow from ``seed`` and the id: of 100 texts ``rate`` are cut, of 100
    of these ``spm_rate`` are written suffix first (spm), the others prefix first (psm). An empty or null text, and a
    text that holds one of ``marks``, stays as it is (plain; null becomes empty), without character counts. Rows
    repeated with the same id and text give the same result, a null id counts as the empty string; an empty table gives
    an empty result. Columns of ``docs`` named like the added ones are replaced by them; other names don't matter.
    """
    carried = [c for c in (docs.columns if columns is None else columns) if c not in ADDED]
    h = _draws(seed, docs[id_col])
    plain, back = renamed(docs, carried, text=F.coalesce(docs[text_col], F.lit("")), h1=h[0], h2=h[1], cut=h[2] % 100 < rate, spm=h[3] % 100 < spm_rate)
    p, s, m = marks

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column("text")
            counts, points = units_of(texts)
            lists = SkipLists(counts, points)
            ranks = [batch.column(c).to_numpy(zero_copy_only=False) % (counts + 1) for c in ("h1", "h2")]
            ends = lists.reach(np.minimum(*ranks)), lists.reach(np.maximum(*ranks))
            marked = pc.match_substring(texts, p)
            for mark in (s, m):
                marked = pc.or_(marked, pc.match_substring(texts, mark))
            go = batch.column("cut").to_numpy(zero_copy_only=False) & (counts > 0) & ~marked.to_numpy(zero_copy_only=False)
            spm = batch.column("spm").to_numpy(zero_copy_only=False)
            out = texts.to_pylist()
            for k in np.nonzero(go)[0].tolist():
                text, a, b = out[k], int(ends[0][k]), int(ends[1][k])
                out[k] = f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}" if spm[k] else f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"
            form = np.where(go, np.where(spm, "spm", "psm"), "plain")
            added = [pa.array(counts), pa.array(form, pa.string()), pa.array(ends[0], mask=~go), pa.array(ends[1] - ends[0], mask=~go), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in back], *added], names=[*back, *ADDED])

    kinds = [f"{k} {plain.schema[k].dataType.simpleString()}" for k in back]
    done = plain.mapInArrow(tidy(cut), ", ".join([*kinds, "n long, form string, prefix_chars long, middle_chars long, output string"]))
    return done.select(*[F.col(k).alias(c) for k, c in back.items()], *ADDED)


def original(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` from; null for an unknown form or an output without its marks."""
    p, s, m = marks
    quoted = {mark: "\\Q" + mark + "\\E" for mark in marks}

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        head = F.split(F.substring(output, F.lit(len(first) + 1), F.length(output)), quoted[second], 2)
        tail = F.split(F.get(head, F.lit(1)), quoted[m], 2)
        return tuple(F.get(*at) for at in ((head, F.lit(0)), (tail, F.lit(0)), (tail, F.lit(1))))

    a, b, middle = parts(p, s)
    psm = F.when(output.startswith(p), F.concat(a, middle, b))
    a, b, middle = parts(s, p)
    spm = F.when(output.startswith(s), F.concat(b, middle, a))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = fill_in_middle(docs, columns=["doc_id"])
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(original(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
 e AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
   t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 AS plain, CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 AS spm FROM d),
 f AS (SELECT doc_id, n, t, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, array_to_string(u[1:least(c1, c2)], '') AS a,
   array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS b, array_to_string(u[greatest(c1, c2) + 1:], '') AS c FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM f
"""
