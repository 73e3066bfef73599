import re

from framewright.llm.license_rules import build_rules
from framewright.llm.license_scan import BASE, license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    None, "", "---", "MIT", "The MIT\tlicense, mit--LICENSE", "Licensed under CC BY-NC 4.0.", "cc by cc by CC/BY",
    "This work is licensed under the GNU General Public License, version 3.", "über apache licenses Apache  License",
    "Licensed under the Apache License, Version 2.0.\nAll rights reserved", "x " * 30_000 + "mit license",
    "SPDX-License-Identifier: MIT", "ccby apachelicense", "mit license " * 500,
]


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = [(label, i, i + len(p)) for phrase, label in BASE for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    spans = []
    joined = " " + " ".join(words) + " "
    for rule, label, priority, _, _, regex, score in build_rules():
        for m in re.finditer(f" ({regex})(?= )", joined):
            start = joined[: m.start()].count(" ")
            spans.append((start, start + m[1].count(" ") + 1, priority, rule, label, score))
    kept = [
        d for d in spans
        if not any(
            e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2]
            and ((e[0], e[1]) != (d[0], d[1]) or (-e[2], e[3]) < (-d[2], d[3])) for e in spans
        )
    ] if len(spans) < 200 else None
    return len(words), sorted(base), kept


def test_rules_are_many_and_prefiltered():
    rules = build_rules()
    assert len(rules) > 300 and [r[0] for r in rules] == list(range(len(rules)))
    for *_, keyword, literal, regex, score in rules:
        assert keyword in literal.split(" ") and 0 < score <= 1 and re.compile(regex)


def test_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        n, base, kept = brute(text)
        assert rows[i].n_words == n, text
        assert sorted(tuple(b) for b in rows[i].base) == base
        assert rows[i].base_labels == sorted({b[0] for b in base})
        if kept is not None:
            assert sorted((d.start, d.stop, d.priority, d.rule) for d in rows[i].detections) == sorted(d[:4] for d in kept), text
            assert rows[i].labels == sorted({b[0] for b in base} | {d[4] for d in kept})
            assert rows[i].score == max((d[5] for d in kept), default=0.0)


def test_common_phrasings(spark):
    texts = {
        "Apache License v2.0": "apache-2.0", "GNU General Public License v3": "gpl-3", "under GPLv3 or later": "gpl-3", "LGPLv2.1": "lgpl-2.1", "GPL v2": "gpl-2", "GPL version 2": "gpl-2",
        "Mozilla Public License, v. 2.0": "mpl-2.0", "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa", "CC0 1.0": "cc0", "the Unlicense": "unlicense",
        "New BSD License": "bsd-3-clause", "https://www.apache.org/licenses/LICENSE-2.0": "apache-2.0", "Copyright 2020 Someone": "copyright", "AGPL-3.0-only": "agpl-3",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.text: r.labels for r in license_scan(docs).collect()}
    assert {t: label for t, label in texts.items() if label not in rows[t]} == {}, rows


def test_clashing_columns_repeated_rows_and_empty_table(spark):
    names = ["_words", "words", "keys", "found", "left", "c0", "_kept"]
    docs = spark.createDataFrame([(1, "mit license", 5, *names)] * 2 + [(None, None, 5, *names)], ["doc_id", "text", "score", *names])
    rows = license_scan(docs).collect()
    assert sorted(r.labels for r in rows) == [[], ["mit"], ["mit"]] and all(r[n] == n for r in rows for n in names)
    assert license_scan(docs.limit(0)).count() == 0
