"""Jaccard join, vectors, packing, language model, toxicity, components and the pipeline against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from conftest import tuples
from pyspark.sql import functions as F

import corpus_pipeline
from relimpute.llm import components, decontaminate, jaccard, language_id, language_model, line_dedup, packing, toxicity, vector_dedup
from relimpute.llm.words import BLANK, word_hashes

DOCS = "doc_id bigint, text string, n bigint, key string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def reach(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = ["a b  a", None, "", "Ab aB\tab\x0bé", " x", "a"]
    h, at = word_hashes(pa.array(texts))
    assert list(np.diff(at)) == [3, 0, 0, 4, 1, 1]
    assert h[0] == h[2] == h[8] and h[0] != h[1] and h[3] == h[4] == h[5] != h[6]
    sliced, at = word_hashes(pa.array(texts).slice(3, 2))
    assert list(sliced) == list(h[3:8]) and list(at) == [0, 4, 5]
    assert BLANK.sum() == 6


def shingles(text, k=5):
    w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", low(text)) if x]
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def near_copies(seed, n):
    rng = random.Random(seed)
    rows, passage = [], " ".join(f"p{i}" for i in range(60))
    for _ in range(n):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 60))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            mine = list(words)
            for _ in range(rng.randint(0, 3)):
                mine[rng.randrange(len(mine))] = f"z{rng.randint(0, 9)}"
            rows.append((len(rows), " ".join(mine) + (" " + passage if rng.random() < 0.4 else "")))
    return rows


@pytest.mark.parametrize("block, key_bits", [(jaccard.BLOCK, 64), (3, 64), (jaccard.BLOCK, 4)])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, block, key_bits):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(block, 60)
    chain = [f"c{i}" for i in range(60)]
    # Each differs from the next by a little, the ends by much.
    rows += [(2000 + j, " ".join(f"d{i}" if i < 2 * j else w for i, w in enumerate(chain))) for j in range(20)]
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "ONE\ttwo"), (5004, "v " * 40_000)]
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = reach(ids, links)
    got = jaccard.jaccard_join(docs(spark, rows), key_bits=key_bits)
    assert tuples(got, "doc_id", "n_shingles", "component_id") == sorted(((i, len(sets[i]), root[i]) for i in ids), key=repr)
    assert len(links) > 30 and root[2019] == 2000


def test_jaccard_bitmaps_beside_small_sets():
    """A small set in the same square doesn't make the bitmaps of large ones useless, and no possible partner is lost."""
    rng = np.random.default_rng(6)
    big = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    near = np.r_[big[:2700], rng.integers(0, 1 << 63, 200).astype(np.uint64)]
    sets = [np.unique(x) for x in (big[:3], big, near, rng.integers(0, 1 << 63, 3000).astype(np.uint64), big[:2], big[:2300])]
    n, bits = [len(x) for x in sets], [jaccard.bitmap(x) for x in sets]
    may = jaccard.may_link(n, bits, n, bits, 75)
    linked = np.array([[100 * (both := len(np.intersect1d(x, y))) >= 75 * (len(x) + len(y) - both) for y in sets] for x in sets])
    assert may[linked].all()
    assert not may[1, 3] and not may[3, 2] and may[1, 2]


@pytest.mark.parametrize("block", [jaccard.BLOCK, 16])
def test_jaccard_blocks_send_forests(spark, monkeypatch, block):
    """Of a run whose sets are close to each other in all pairs, fewer links leave the tiles than rows went in."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    taken_in, sent = [], []

    def counted(tiles, whole, percent, inner=jaccard.decided):
        taken_in.append(tiles.count())
        links = inner(tiles, whole, percent)
        sent.append(links.count())
        return links

    monkeypatch.setattr(jaccard, "decided", counted)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:100] + [f"x{i}"] + base[100:])) for i in range(80)]
    # Near the threshold, below it: every pair has to be looked at, none links.
    rows += [(100 + i, " ".join(w if j % 60 else f"y{i}-{j}" for j, w in enumerate(base[:120]))) for i in range(60)]
    rows += [(200 + i, " ".join([f"q{j}" for j in range(70)] + [f"r{i}-{j}" for j in range(15)])) for i in range(60)]
    got = dict(tuples(jaccard.jaccard_join(docs(spark, rows)), "doc_id", "component_id"))
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert got == reach(ids, links)
    assert len(links) > 80 * 79 / 2 and all(s < t or s == t == 0 for s, t in zip(sent, taken_in, strict=True)) and sum(sent) < 4 * len(rows)


def test_pipeline_stages_keep_clashing_columns(spark):
    names = ["_id", "_gone", "_key", "own_key", "REJECTED", "hit_id", "again_key", "nth_row"]
    table = spark.createDataFrame([(1, "a b c d e f", *names), (2, "A b c d e f", *names), (3, "x y z", *names), (3, "x y z", *names), (4, "1 2", *names)], ["doc_id", "text", *names])
    table = table.withColumn("lang", F.lit("en"))
    items = spark.createDataFrame([("i", "x y z")], ["item_id", "text"])
    for got, left in ((language_id.with_language(table), [1, 2, 3, 3]), (jaccard.one_per_component(table), [1, 3, 4]), (decontaminate.clean_documents(table, items), [1, 2, 4])):
        assert got.columns == table.columns
        assert sorted(r["doc_id"] for r in got.collect()) == left


def test_jaccard_join_ids_and_empty(spark):
    rows = [(7, "a b c"), (7, "a b c"), (None, "a b c"), (3, "A B C"), (None, "")]
    got = jaccard.jaccard_join(docs(spark, rows))
    assert tuples(got, "doc_id", "component_id") == sorted([(7, 3), (7, 3), (None, 3), (3, 3), (None, None)], key=repr)
    assert jaccard.jaccard_join(docs(spark, [])).collect() == []
    kept = jaccard.one_per_component(docs(spark, rows[1:]))
    assert [r for r in tuples(kept, "doc_id") if r[0]] == [(3,)]


def test_one_per_component_keeps_one_row_of_each(spark):
    same, own = "a b c d e f g", "q r s t u v w"
    rows = [(1, same), (1, same), (5, same.upper()), (5, own), (None, "x y z"), (None, "x y z"), (None, "X y z"), (None, same), (8, "k l m"), (None, "k l m"), (9, ""), (9, ""), (None, None)]
    kept = jaccard.one_per_component(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "n", "key"]
    got = [(i, low(t)) for i, t in tuples(kept, "doc_id", "text")]
    assert sorted(got, key=repr) == sorted([(1, same), (5, own), (None, "x y z"), (8, "k l m"), (9, ""), (9, ""), (None, "")], key=repr)


@pytest.mark.parametrize("together", [components.TOGETHER, 5])
def test_components_with_and_without_rounds(spark, monkeypatch, together):
    monkeypatch.setattr(components, "TOGETHER", together)
    rng = random.Random(together)
    links = [(rng.randint(-30, 30), rng.randint(-30, 30)) for _ in range(25)] + [(100 + i, 101 + i) for i in range(12)] + [(500, 600 + i) for i in range(20)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert tuples(got, "node", "root") == sorted(reach(nodes, links).items(), key=repr)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def vectors(seed, n, dims=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        v = rng.normal(size=dims)
        rows += [v + rng.normal(size=dims) * rng.choice([0, 0.05, 0.12, 0.3]) for _ in range(rng.choice([1, 1, 3, 8]))]
    return [[float(np.float32(x)) for x in v] for v in rows]


def linked(rows, least=0.9):
    good = {i: np.array(v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    cos = lambda a, b: len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least
    return [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if cos(good[a], good[b])]


def test_vector_dedup_matches_brute_force(spark):
    rows = list(enumerate(vectors(1, 60)))
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [math.nan] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (1007, [math.inf] * 16)]
    links = linked(rows)
    degree = Counter(x for link in links for x in link)
    root = reach([i for i, _ in rows], links)
    want = sorted(((i, degree[i], root[i], root[i] == i) for i, _ in rows), key=repr)
    for kind in ("float", "double"):
        frame = spark.createDataFrame([(*r, 1, "b") for r in rows], f"vec_id bigint, embedding array<{kind}>, n bigint, b string")
        assert tuples(vector_dedup.vector_dedup(frame), "vec_id", "n_links", "component_id", "kept") == want
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert vector_dedup.vector_dedup(empty).collect() == []


def test_vector_dedup_of_huge_and_tiny_numbers_and_rows_without_id(spark):
    rows = [(1, [3e200, 4e200]), (2, [3.0, 4.0]), (3, [3e-200, 4e-200]), (4, [-3e200, 1e200]), (None, [0.0, 0.0]), (None, None)]
    got = tuples(vector_dedup.vector_dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (None, 0, None, True), (None, 0, None, True)], key=repr)


def test_vector_dedup_recall_in_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rows = list(enumerate(vectors(2, 300)))
    rows += [(5000 + i, rows[0][1]) for i in range(40)]
    links = linked(rows)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: r for r in vector_dedup.vector_dedup(frame, cells=40).collect()}
    degree = Counter(x for link in links for x in link)
    assert all(got[i]["n_links"] <= degree[i] for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * sum(degree.values())


def test_packing_keeps_every_id(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "Haus", "naïve", "x1\n", "<|endoftext|>", "  "]) for _ in range(rng.randint(0, 900)))) for i in range(150)]
    rows += [(900, None), (901, ""), (None, "é " * 9000), (7, rows[7][1])]
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append([*plain.encode(t or "", add_special_tokens=False).ids, 1])
    got = packing.pack(docs(spark, rows), P.path("byte_bpe_50k.tiktoken"), capacity=512, keep_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, wants in ids.items():
        assert sorted(x for r in by_doc[i] for x in r["ids"]) == sorted(x for w in wants for x in w)
        for start in {r["start"] for r in by_doc[i]}:
            assert any(r["ids"] == w[start : start + r["length"]] and r["doc_tokens"] == len(w) for r in by_doc[i] if r["start"] == start for w in wants)
    for parts in by_sequence.values():
        end = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 512
    assert sum(r["length"] for r in got) >= 0.97 * 512 * len(by_sequence)
    assert packing.pack(docs(spark, []), P.path("byte_bpe_50k.tiktoken")).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_rounded_patterns_use_up_the_demand(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(1, 257), 60, replace=False))
    demand = rng.integers(1, 400, 60)
    used, total = np.zeros(60, int), 0
    for times, held in packing.rounded(sizes, demand, 256):
        assert sum(sizes[k] * n for k, n in held.items()) <= 256
        for k, n in held.items():
            used[k] += times * n
        total += times
    assert (used == demand).all()
    # Demand times any feasible dual is a bound from below: the linear program is within its gap of the best whole solution.
    basis, uses = packing.solve(sizes, demand.astype(float), 256)
    worth = np.linalg.solve(basis.T, np.ones(60))
    bound = demand @ worth / max(1, packing.best_pattern(worth, sizes, 256)[0])
    assert np.allclose(basis @ uses, demand) and total <= 1.01 * bound + 3


def kneser_ney(train, texts):
    tokens = lambda t: [*[w for w in re.split("[ \t\n\x0b\x0c\r]+", low(t)) if w], "</s>"]
    words, pairs = Counter(), Counter()
    for t in train:
        w = tokens(t)
        words.update(w)
        pairs.update(zip(["<s>", *w], w, strict=False))

    def discount(counts):
        n = Counter(counts)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k / 2, 0), k) for k in (1, 2, 3)]

    after = Counter(b for _, b in pairs)
    d2, d1 = discount(pairs.values()), discount(after.values())
    sums, spare = Counter(), Counter()
    for (a, _), n in pairs.items():
        sums[a] += n
        spare[a] += d2[min(n, 3)]
    types, total, v = len(pairs), sum(words.values()), len(words)
    left = sum(d1[min(n, 3)] for n in after.values())
    out = []
    for t in texts:
        w, score, base = tokens(t), 0.0, 0.0
        for a, b in zip(["<s>", *w], w, strict=False):
            p = (max(after[b] - d1[min(after[b], 3)], 0) + left / (v + 1)) / types if types else 1 / (v + 1)
            if sums[a]:
                p = (max(pairs[a, b] - d2[min(pairs[a, b], 3)], 0) + spare[a] * p) / sums[a]
            score += math.log10(p)
            base += math.log10((words[b] + 1) / (total + v + 1))
        out.append((len(w), sum(words[x] > 0 for x in w), total, base, score))
    return out


@pytest.mark.parametrize("shard", [language_model.SHARD, 200])
def test_lm_scores_match_plain_kneser_ney(spark, monkeypatch, shard):
    monkeypatch.setattr(language_model, "SHARD", shard)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["the", "The", "Of", *[f"w{j}" for j in range(60)]], [30, 5, 9, *[60 / (j + 1) for j in range(60)]], k=rng.randint(0, 40)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "unseen words only"), (503, "the of " * 20_000), (None, "the w1")]
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    want = kneser_ney(train, [t for _, t in rows])
    got = {r["doc_id"]: r for r in language_model.lm_scores(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for (i, _), (n, known, total, base, score) in zip(rows, want, strict=True):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


def test_lm_without_training_text(spark):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = language_model.lm_scores(docs(spark, [(only, "a b")])).collect()
    assert [(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(True, 3, 0, 0, 0.0, 0.0)]
    assert language_model.lm_scores(docs(spark, [])).collect() == []


def test_toxicity_held_out_and_nothing_to_learn(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rng.randint(0, 80)}" for _ in range(rng.randint(20, 60))]
        bad = rng.random() < 0.2
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Vile,", "nasty!", "rotten"])
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(bad), bad))
        rows[-1] = (*rows[-1], bad)
    frame = docs(spark, [r[:2] for r in rows] + [(9000, None), (9001, ""), (9002, "vile " * 50_000), (9003, "w1 w2"), (9003, "w1 w2")])
    marks = spark.createDataFrame([(i, t, "x") for i, t, _ in labels] + [(None, 1, "x"), (77_777, 1, "x"), (5, None, "x")], "doc_id bigint, toxic int, text string")
    got = toxicity.toxicity(frame, marks)
    out = got.collect()
    score = {r["doc_id"]: r for r in out}
    assert len(out) == 605 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(score[r[0]]["held_out"] for r in held)
    right = sum(score[r[0]]["predicted"] == int(r[2]) for r in held) / len(held)
    assert right >= 0.95 and score[9002]["predicted"] == 1 and score[9000]["score"] == score[9001]["score"] < 0.5
    none = toxicity.toxicity(frame, marks.where("toxic = 0"))
    assert {r["score"] for r in none.collect()} == {0.0}
    assert toxicity.toxicity(frame.limit(0), marks).collect() == []


def test_pipeline_takes_effect(spark, tmp_path):
    rng = random.Random(6)
    item = " ".join(f"b{i}x" for i in range(20))
    rows = []
    for i in range(40):
        own = "\n".join(" ".join(f"{rng.choice('abcdefg')}{rng.randint(0, 500)}q" for _ in range(12)) for _ in range(4))
        rows.append((i, own + ("\nshared boiler plate" if i < 15 else ""), "en", "s", len(own)))
    rows += [(100, rows[20][1], "en", "s", 1), (101, item.upper() + " and more", "en", "s", 1), (102, "12 34", "en", "s", 1), (103, None, "en", "s", 1)]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, after = [n for n, _ in corpus_pipeline.STAGES], frame
    assert names == ["language_id", "line_dedup", "jaccard_join", "decontamination", "packing"]
    gone = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, after = after, stage(spark, after, str(tmp_path))
        assert after.columns == frame.columns
        gone.append({r[0] for r in before.select("doc_id").collect()} - {r[0] for r in after.select("doc_id").collect()})
    assert gone == [{102, 103}, set(), {100}, {101}]
    assert not after.where("text LIKE '%boiler%'").count() and after.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r[0] for r in packed.select("doc_id").collect()} == set(range(40))


def test_queries_register_all_operators():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert {"op2_line_dedup", "op5_vector_dedup", "op6_jaccard_join", "op7_decontamination"} <= set(__spark_entry__.oracle_sql())
    assert decontaminate.SQL and line_dedup.SQL
