"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control, in built-in SQL functions.

Base kinds (assign, access, hex) come from patterns. The method looks at every other long token: it infers an encoding
(hex, base32, lower, base36, base62, base64), and tests the token's symbols for uniformity (chi-squared), for runs
around the middle of the alphabet, and for serial correlation. A token that fails a test isn't random. For the others
the p-value says how likely text of that encoding and length would look as uniform as this. Benjamini-Hochberg control
runs within each stratum of encoding and length class, over counts in fixed p-value bins, so that neither a sort of all
tokens nor a collection of them is needed: the tables that reach the driver have at most strata x bins rows.

Positions are code points. All scanning is per row, and done once: its spans and verdicts are stored, the bin counts, which
alone shuffle, and the result are made of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import renamed, stored

#: Fixed patterns of the base scan.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Equivalent gates and patterns that skip matches too short to count: the runs are maximal, so the spans are the same.
ACCESS_LONG = r"AKIA[A-Z0-9]{14,}"
HEX_LONG = r"[0-9a-f]{16,}"
ASSIGN_GATE = r"(?i)(?:passw|secret|token|api)"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encoding: full-match regex, alphabet, and k * sum(p^2) - 1 of text written in it (how far text is from uniform).
ENCODINGS = {
    "hex": (r"[0-9a-f]+|[0-9A-F]+", DIGITS + "abcdef", 1.0),
    "base32": (r"[A-Z2-7]+", UPPER + "234567", 1.1),
    "lower": (r"[a-z]+", LOWER, 0.7),
    "base36": (r"[0-9a-z]+", DIGITS + LOWER, 1.4),
    "base62": (r"[0-9A-Za-z]+", DIGITS + UPPER + LOWER, 3.1),
    "base64": (r"[0-9A-Za-z+/_-]+", UPPER + LOWER + DIGITS + "+/", 3.2),
}
LENGTHS = (20, 32, 48, 64, 128, 1 << 30)
BINS, BINS_A_DECADE = 200, 10
#: Two-sided normal limit of each test of the battery (about 0.001).
Z_LIMIT = 3.29

SPANS = "array<struct<start:int,stop:int,token:string>>"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, regex: str, group: int = 0) -> Column:
    """Leftmost matches, not overlapping: array of (start, stop, token), token being the group's text."""
    gaps = F.transform(F.split(text, regex, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.length)
    tokens = F.regexp_extract_all(text, F.lit(regex), F.lit(group))
    steps = F.zip_with(gaps, sizes, lambda g, s: F.struct(g.alias("gap"), s.alias("size")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        one = F.array(F.struct(begin.alias("start"), (begin + x["size"]).alias("stop")))
        return F.struct(
            (begin + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(x["size"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"),
        )

    places = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.zip_with(places, tokens, lambda p, t: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), t.alias("token")))


def base_spans(text: Column) -> Column:
    """array of (start, kind index, stop) of the base kinds, in order."""

    def kind(number: int, gate: Column, found: Column) -> Column:
        named = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["stop"].alias("stop")))
        return F.when(gate, named).otherwise(F.array().cast("array<struct<start:int,kind:int,stop:int>>"))

    assign = F.filter(_spans(text, ASSIGN, 2), lambda s: F.length(s["token"]) >= 12)
    return F.array_sort(F.concat(
        kind(0, F.rlike(text, F.lit(ASSIGN_GATE)), assign),
        kind(1, F.contains(text, F.lit("AKIA")), _spans(text, ACCESS_LONG)),
        kind(2, F.rlike(text, F.lit(HEX_LONG)), _spans(text, HEX_LONG)),
    ))


def normal_cdf(z: Column) -> Column:
    """Logistic approximation of the normal distribution, within 0.0002."""
    x = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    return 1 / (1 + F.exp(-(1.5976 * x + 0.07056 * x * x * x)))


def battery(token: Column) -> Column:
    """struct<stratum, bin> of one token: its encoding and length class, and its p-value's bin (0: not random)."""
    name = F.lit(None).cast("string")
    for encoding, (regex, _, _) in reversed(ENCODINGS.items()):
        name = F.when(F.rlike(token, F.lit(f"^(?:{regex})$")), F.lit(encoding)).otherwise(name)

    def judged(encoding: Column) -> Column:
        alphabet, text_excess = F.lit(None).cast("string"), F.lit(None).cast("double")
        for label, (_, letters, excess) in ENCODINGS.items():
            alphabet = F.when(encoding == label, F.lit(letters)).otherwise(alphabet)
            text_excess = F.when(encoding == label, F.lit(excess)).otherwise(text_excess)
        body = F.when(encoding == "hex", F.lower(token)).when(encoding == "base64", F.translate(token, "-_", "+/")).otherwise(token)
        values = F.transform(F.split(body, ""), lambda c: (F.call_function("instr", alphabet, c) - 1).cast("double"))
        inputs = F.struct(
            body.alias("body"), F.length(body).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k"),
            text_excess.alias("excess"), values.alias("values"),
        )
        return _let(inputs, lambda t: _verdict(encoding, t))

    return _let(name, judged)


def _verdict(encoding: Column, t: Column) -> Column:
    n, k = t["n"], t["k"]
    symbols = F.array_distinct(F.split(t["body"], ""))
    squares = F.aggregate(
        symbols, F.lit(0.0), lambda acc, c: acc + F.pow((n - F.length(F.replace(t["body"], c, F.lit("")))), F.lit(2.0))
    )
    chi = k * squares / n - n
    df = k - 1
    z_uniform = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    high = F.filter(t["values"], lambda v: v >= k / 2)
    turns = F.aggregate(
        F.zip_with(t["values"], F.slice(t["values"], 2, F.size(t["values"])), lambda a, b: (a >= k / 2) != (b >= k / 2)),
        F.lit(0.0), lambda acc, x: acc + F.when(x, 1.0).otherwise(0.0),
    )
    n1 = F.size(high).cast("double")
    n2 = n - n1
    expected = 2 * n1 * n2 / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    z_runs = F.when(variance > 0, F.abs((turns + 1 - expected) / F.sqrt(variance))).otherwise(99.0)
    middle = (k - 1) / 2
    product = F.aggregate(
        F.zip_with(t["values"], F.slice(t["values"], 2, F.size(t["values"])), lambda a, b: (a - middle) * (b - middle)),
        F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)),
    )
    z_serial = F.abs(product / ((k * k - 1) / 12 * F.sqrt(n - 1)))
    random = (z_uniform <= Z_LIMIT) & (z_runs <= Z_LIMIT) & (z_serial <= Z_LIMIT)
    # of text in this encoding, chi-squared is about noncentral with n * excess; a small p says: too uniform for text
    as_text = normal_cdf((chi - df - n * t["excess"]) / F.sqrt(2 * df + 4 * n * t["excess"]))
    level = F.least(F.floor(-F.log10(as_text) * BINS_A_DECADE), F.lit(BINS)).cast("int")
    length_class = F.lit(len(LENGTHS))
    for number, most in reversed(list(enumerate(LENGTHS))):
        length_class = F.when(n <= most, F.lit(number)).otherwise(length_class)
    return F.struct(
        F.concat_ws(":", encoding, length_class.cast("string")).alias("stratum"),
        F.when(random, level).otherwise(0).alias("bin"),
    )


def _candidates(text: Column) -> Column:
    """Long tokens with their battery results: array of (start, stop, verdict)."""
    judged = F.transform(_spans(text, TOKEN), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), battery(s["token"]).alias("verdict")))
    return F.when(F.rlike(text, F.lit(TOKEN)), judged).otherwise(F.array().cast("array<struct<start:int,stop:int,verdict:struct<stratum:string,bin:int>>>"))


def discovery_levels(verdicts: DataFrame, rate: float) -> dict[str, int]:
    """Least bin accepted per stratum by Benjamini-Hochberg at ``rate``, from (stratum, bin) rows.

    The counts have at most len(ENCODINGS) * (len(LENGTHS) + 1) * (BINS + 1) rows, whatever the input's size.
    """
    counts: dict[str, dict[int, int]] = {}
    for row in verdicts.groupBy("stratum", "bin").count().collect():
        counts.setdefault(row["stratum"], {})[row["bin"]] = row["count"]
    levels = {}
    for stratum, of in counts.items():
        total, above, best = sum(of.values()), 0, None
        for level in sorted(of, reverse=True):
            above += of[level]
            if level and 10 ** (-level / BINS_A_DECADE) <= rate * above / total:
                best = level
        if best is not None:
            levels[stratum] = best
    return levels


def secret_scan(docs: DataFrame, text_col: str = "text", rate: float = 0.05, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with base and secrets: arrays of (start, kind, stop), by start, then kind.

    kind is an index into KINDS; positions are code points, stop exclusive. base has the pattern kinds; secrets has them
    and the random tokens that lie in no base span, at a false-discovery rate of ``rate`` within each stratum. Null texts
    count as empty; rows aren't merged, dropped or reordered; an empty table gives an empty result. Columns of ``docs``
    named base or secrets are replaced; other names don't matter.
    """
    carried = [c for c in (docs.columns if columns is None else columns) if c not in ("base", "secrets")]
    rows, back = renamed(docs, carried, text=F.coalesce(docs[text_col], F.lit("")))
    judged = stored(rows.select(*back, base_spans(F.col("text")).alias("base"), _candidates(F.col("text")).alias("tokens")), "verdicts")
    levels = discovery_levels(judged.select(F.explode("tokens.verdict").alias("v")).select("v.*"), rate)
    accepted = F.map_from_arrays(
        F.array(*[F.lit(s) for s in levels]).cast("array<string>"), F.array(*[F.lit(b) for b in levels.values()]).cast("array<int>")
    )
    base = F.col("base")
    random = F.filter("tokens", lambda c: (c["verdict"]["bin"] >= F.element_at(accepted, c["verdict"]["stratum"])) & ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (b["stop"] >= c["stop"])))
    added = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["stop"].alias("stop")))
    return judged.select(*[F.col(k).alias(c) for k, c in back.items()], "base", F.array_sort(F.concat(base, added)).alias("secrets"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))


def _counts() -> list[Column]:
    kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return [kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = secret_scan(docs, columns=["doc_id"])
    return found.select("doc_id", *_counts(), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def secret_base(spark, sf_dir: str) -> DataFrame:
    """The columns of op8_secret_scan that its tests don't change, which SQL can say."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", base_spans(F.coalesce("text", F.lit(""))).alias("base"))
    return found.select("doc_id", *_counts(), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"))


_ASSIGN_SQL = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
BASE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 k AS (SELECT doc_id, 0 AS kind, 12 AS least, string_split_regex(t, '{_ASSIGN_SQL}') AS gaps, regexp_extract_all(t, '{_ASSIGN_SQL}') AS hits, regexp_extract_all(t, '{_ASSIGN_SQL}', 2) AS body FROM d
   UNION ALL SELECT doc_id, 1, 18, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
   UNION ALL SELECT doc_id, 2, 16, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM d),
 n AS (SELECT doc_id, kind, least, unnest(gaps[: len(hits)]) AS gap, unnest(hits) AS hit, unnest(body) AS body, unnest(range(len(hits))) AS i FROM k),
 s AS (SELECT doc_id, kind, least, length(body) AS size, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop, length(hit) AS whole FROM n),
 f AS (SELECT doc_id, kind, stop - whole AS start, stop FROM s WHERE size >= least)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind), '')) AS base_sha256
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id
"""
