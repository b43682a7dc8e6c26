"""Line dedup, decontamination, language ID, token counts, licences: hand-made rows and plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from conftest import tuples

from relimpute.llm import decontaminate, language_id, licenses, line_dedup, token_counts

DOCS = "doc_id bigint, text string, n bigint, word string"


def docs(spark, rows):
    """Rows (doc_id, text) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)


def test_line_dedup_matches_plain_python(spark):
    rng = random.Random(3)
    common = ["Same line", " same LINE\t", "Échec", "échec", ""]
    rows = [(i, "\n".join(rng.choice([*common, f"own {i} {rng.random()}"]) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    rows += [(900, None), (901, ""), (902, "x " * 50_000)]
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(blank))
    held = {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k] = held.get(k, 0) + 1
    want = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or held[key(x)] < 10]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = line_dedup.line_dedup_digest(docs(spark, rows))
    assert tuples(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)
    assert any(w[2] for w in want)


def test_line_dedup_repeated_rows_and_ids(spark):
    # Ten rows of one document are one document; ten rows without doc_id are ten.
    rows = [(1, "a\nb")] * 10 + [(1, f"b\n{i}") for i in range(5)] + [(None, "c\nd")] * 9 + [(2, "c\na"), (3, "d")]
    got = line_dedup.line_dedup(docs(spark, rows), keep=["word"])
    want = [(1, "a\nb", "x")] * 10 + [(1, f"b\n{i}", "x") for i in range(5)] + [(None, "", "x")] * 9 + [(2, "a", "x"), (3, "", "x")]
    assert tuples(got, "doc_id", "text", "word") == sorted(want, key=repr)
    assert line_dedup.line_dedup(docs(spark, [])).collect() == []


def occurrences(rows, items, size=10):
    split = lambda text: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for i, text in rows:
        w, hit, found = split(text), set(), set()
        for window, owners in windows.items():
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    found |= owners
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontaminate_matches_plain_python(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("a b c Über d e f2 g h".split())
    items = [(1, " ".join(word() for _ in range(14))), (2, "only, three Words"), (10, " ".join(word() for _ in range(30))), (3, ""), (4, None), (5, "!!!")]
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(30)]
    rows += [(100, items[0][1].upper().replace(" ", "--")), (101, f"x {items[2][1]} y {items[2][1]}"), (102, None), (103, ""), (104, "ONLY three\nwords only three words"), (105, "z " * 30_000 + items[0][1])]
    got = decontaminate.decontaminate_digest(docs(spark, rows), spark.createDataFrame(items + items[:2], "item_id bigint, text string"))
    assert tuples(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(occurrences(rows, items), key=repr)


def test_decontaminate_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert tuples(decontaminate.decontaminate(docs(spark, [(1, "a b"), (None, "c")]), none), "doc_id", "n_words", "n_hit", "contaminated") == [(1, 2, 0, False), (None, 1, 0, False)]
    some = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontaminate.decontaminate(docs(spark, []), some).collect() == []
    kept = decontaminate.clean_documents(docs(spark, [(1, "x a b c"), (1, "other"), (None, "a b c"), (2, None)]), some)
    assert tuples(kept, "doc_id", "text") == [(1, "other"), (2, None)]


LETTERS = {"en": "the of and ing tion er", "de": "sch ung ein der keit ge", "fr": "eau le oi re que ment"}


def sentences(rng, lang, n):
    parts = LETTERS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_id_held_out_accuracy_and_mixtures(spark):
    rng = random.Random(1)
    rows = [(i, sentences(rng, lang, rng.randint(15, 60)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(1000, None, "en"), (1001, "123 ... !", "en"), (1002, "", None), (1003, sentences(rng, "en", 80) + " " + sentences(rng, "fr", 80), None), (1004, sentences(rng, "de", 20_000), None), (None, sentences(rng, "de", 30), None)]
    got = {r["doc_id"]: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows[:180] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows[:180])
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1001]["score"] == 0
    mixed = {x["lang"]: x["share"] for x in got[1003]["languages"]}
    assert set(mixed) == {"en", "fr"} and 0.3 < mixed["en"] < 0.7
    assert got[1004]["lang_pred"] == got[None]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_without_anything_to_learn(spark):
    frame = spark.createDataFrame([(1, "abc", None), (1, "abc", None)], "doc_id bigint, text string, lang string")
    assert tuples(language_id.language_id(frame), "doc_id", "lang_pred", "score") == [(1, "und", 0.0)] * 2
    assert language_id.language_id(frame.limit(0)).collect() == []
    kept = language_id.with_language(spark.createDataFrame([(1, "abc", "en"), (2, "12", "en"), (3, None, "en"), (1, "7", "en")], "doc_id bigint, text string, lang string"))
    assert (1, "abc") in tuples(kept, "doc_id", "text") and 3 not in [r[0] for r in kept.collect()]


def greedy(word, pieces):
    n = 0
    while word:
        piece = max((p for p in pieces if word.startswith(p)), key=len, default=None)
        if piece is None:
            return 1
        word, n = word[len(piece) :], n + 1
    return n


@pytest.mark.parametrize("seed", range(4))
def test_automaton_counts_as_the_greedy_cut(seed):
    rng = random.Random(seed)
    some = lambda n: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, n)))
    pieces = {some(5) for _ in range(12)} | ({b"a", b"b", b"c"} if seed % 2 else set())
    automaton = token_counts.Automaton(pieces)
    for _ in range(800):
        word = some(14)
        assert automaton.count(word) == greedy(word, pieces), (word, pieces)
    assert automaton.count(b"") == 0


def test_token_counts_rows(spark):
    import public_tokenizers as P

    rows = [(1, "the  of\tthe\n"), (2, None), (2, None), (3, ""), (None, "é😀 word " * 20_000)]
    got = token_counts.token_counts(docs(spark, rows), P.path("byte_bpe_50k.tiktoken"))
    found = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in got.collect()}
    assert found[1] == (3, 3) and found[2] == (0, 0) and found[3] == (0, 0) and got.count() == 5
    import base64

    pieces = {base64.b64decode(x.split()[0]) for x in open(P.path("byte_bpe_50k.tiktoken"), "rb")}
    one = sum(greedy(w, [p for p in pieces if p in w]) for w in (" é😀".encode(), b" word"))
    assert found[None] == (40_000, 20_000 * one)


def cosine(line, template, idf, other):
    def vector(text):
        out = {}
        for w in re.split("[^0-9A-Za-z]+", text.lower()):
            if w:
                out[w] = out.get(w, 0) + idf.get(w, other)
        return out

    a, b = vector(line), vector(template)
    length = lambda v: sum(x * x for x in v.values()) ** 0.5
    return sum(x * b.get(w, 0) for w, x in a.items()) / length(a) / length(b) if a else 0


def test_license_scan_own_inherited_and_none(spark):
    import math

    rows = [
        (1, "intro\nLicensed under the Apache license, version 2.0\nmore text here", "a/b/x.txt"),
        (2, "Released under the MIT License.", "a/LICENSE"),
        (3, "nothing", "a/b/c/y.txt"),
        (4, "no licence words of any kind", "z/y.txt"),
        (5, None, "a/q.txt"),
        (6, "", None),
        (7, "This work is licensed under the GNU General Public License, version 3", "a/b/c/d/COPYING"),
        (8, "text", "a/b/c/d/e.txt"),
        (8, "text", "a/b/c/d/e.txt"),
        (9, "a licensed plumber released the public version of the work\n" * 3000, "q/r"),
        (10, "top", "top.txt"),
    ]
    frame = spark.createDataFrame([(*r, 0.0, "w") for r in rows], "doc_id bigint, text string, path string, score double, word string")
    got = tuples(licenses.license_scan(frame), "doc_id", "license", "origin", "folder")
    want = [(1, "Apache-2.0", "own", None), (2, "MIT", "own", None), (3, "MIT", "inherited", "a"), (4, None, "none", None), (5, "MIT", "inherited", "a"), (6, None, "none", None), (7, "GPL-3.0", "own", None), (8, "GPL-3.0", "inherited", "a/b/c/d"), (8, "GPL-3.0", "inherited", "a/b/c/d"), (9, None, "none", None), (10, None, "none", None)]
    assert got == sorted(want, key=repr)
    words = lambda t: {w for w in re.split("[^0-9A-Za-z]+", t.lower()) if w}
    many = len(licenses.TEMPLATES)
    df = {}
    for _, t in licenses.TEMPLATES:
        for w in words(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(1 + many / n) for w, n in df.items()}
    best = {i: max(cosine(line, t, idf, math.log(1 + many)) for line in (text or "").split("\n") for _, t in licenses.TEMPLATES) for i, text, _ in rows}
    scores = {r["doc_id"]: r["score"] for r in licenses.license_scan(frame).where("origin = 'own'").collect()}
    assert {i for i, s in best.items() if s >= 0.7} == set(scores)
    assert all(abs(scores[i] - best[i]) < 1e-6 for i in scores)


def test_license_scan_empty(spark):
    frame = spark.createDataFrame([(1, "MIT License", "a/b")], "doc_id bigint, text string, path string")
    none = spark.createDataFrame([], "license string, text string")
    assert tuples(licenses.license_scan(frame, none), "doc_id", "license", "origin") == [(1, None, "none")]
    assert licenses.license_scan(frame.limit(0)).collect() == []


def test_license_scan_headers_files_and_variants(spark):
    from relimpute.llm.licence_templates import whole_texts

    whole = dict(whole_texts())
    by = "Copyright (c) 2019 Some One\n\n"
    code = "\n\ndef f(x):\n    return alpha + beta * gamma\n" * 5
    stated = [
        ("Apache-2.0", "Apache License\nVersion 2.0, January 2004"),
        ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3"),
        ("MIT", "MIT License"),
        ("MIT", "# SPDX-License-Identifier: MIT" + code),
        ("LGPL-2.1", "/* This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.\n */" + code),
        ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
        ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
        ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
        ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
        ("BSD-2-Clause", by + whole["BSD-2-Clause"] + code),
        ("BSD-3-Clause", by + whole["BSD-3-Clause"] + code),
        ("ISC", by + whole["ISC"]),
        *((x, whole[x]) for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Apache-2.0")),
    ]
    rows = [(i, text, f"p{i}/text.txt") for i, (_, text) in enumerate(stated)] + [(100, "code only", "p12/src/a.py"), (101, "code only", "p9/src/a.py"), (102, "The public version of the general work is free.\nPlease read the terms under this section.", "q/a"), (103, "mit\nwas anderes", "q/b")]
    out = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string, path string")).collect()}
    assert [(i, out[i]["license"]) for i in range(len(stated))] == [(i, x) for i, (x, _) in enumerate(stated)]
    assert (out[100]["license"], out[100]["origin"], out[101]["origin"], out[102]["origin"], out[103]["origin"]) == ("GPL-2.0", "inherited", "none", "none", "none")
