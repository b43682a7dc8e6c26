"""Conversation repair, hard negatives and nearest neighbours against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from conftest import tuples

from relimpute.llm import conversation_repair, cross_polytope, hard_negatives
from relimpute.llm.conversation_repair import EDITS, conversation_repair as repaired, damaged, digest, repair, repaired_turns

TURNS = "turn bigint, conv_id bigint, text string, role string, fault int, gone string"
VECTORS = "vec_id bigint, embedding array<double>, label int, anchor string, place int"
BLANK = " \t\n\x0b\x0c\r"


def turns(spark, rows):
    return spark.createDataFrame([(t, c, x, r, 9, "x") for c, t, r, x in rows], TURNS)


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        cut = text.rstrip(BLANK)
        out.append(1 if not cut else 2 if (role, text) in seen else 3 if cut[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def fits(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return not initials or (len(rest) > 0 and len(rest) % 2 == 0 and all(c == "ua"[i % 2] for i, c in enumerate(rest)))


def all_repairs(rows, marks):
    """Every way to edit a short conversation with up to two insertions at a place: (cost, audit, lines)."""
    inserts = [("", 0, []), ("I", 2, ["user"]), ("I", 2, ["assistant"]), ("II", 4, ["user", "assistant"]), ("II", 4, ["assistant", "user"])]
    ways = [(0, "", ())]
    for (_, role, text), fault in zip([*rows, (None, None, None)], [*marks, None], strict=True):
        ways = [(c + p, a + w, (*lines, *((r, "") for r in new))) for c, a, lines in ways for w, p, new in inserts]
        if role is None:
            break
        own = [("D", 3, None)]
        if fault not in (1, 2):
            own += [("K", int(fault == 3), role)] + [("R", 2 + int(fault == 3), r) for r in ("user", "assistant")]
        ways = [(c + p, a + w, lines if r is None else (*lines, (r, text))) for c, a, lines in ways for w, p, r in own]
    # A row with an empty role fits nowhere.
    return min((c, a, lines) for c, a, lines in ways if fits("".join(r[:1] or "-" for r, _ in lines)))


def expected(rows):
    """The summary of (turn, role, text) rows in order."""
    marks = faults(rows)
    cost, audit, lines = all_repairs(rows, marks) if rows else (0, "", ())
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    return (gaps, marks.count(1), marks.count(2), marks.count(3), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def random_turns(seed, conversations=150):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["Yes.", "No", "Why?\n", " \t", "", None, "Ä.", "é"]
    return [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in range(conversations) for _ in range(4 if c < 8 else rng.randint(1, 3))]


def in_order(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))


@pytest.mark.parametrize("held", [1 << 16, 2])
def test_repair_matches_every_possible_edit(spark, monkeypatch, held):
    # With two rows held, conversations of three and more go through files.
    monkeypatch.setattr(conversation_repair, "HELD_ROWS", held)
    rows = random_turns(5)
    got = {int(r[0]): r[1:] for r in tuples(digest(repair(turns(spark, rows))), "conv", *SUMMARY)}
    for c in range(150):
        assert got[c] == expected(in_order([r[1:] for r in rows if r[0] == c])), c


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_conversation_repair_damages_first(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for c in range(150) for t in range(2)]
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (None, 2, "assistant", "Ho.")]
    after = damage(rows)
    got = {r[0]: r[1:] for r in tuples(repaired(turns(spark, rows)), "conv_id", *SUMMARY)}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        assert got[c] == expected(in_order([r[1:] for r in after if r[0] == c])), c
    assert damaged(turns(spark, rows)).where("NOT gone").count() == len(after)


def test_a_conversation_that_lost_all_rows(spark):
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = tuples(repaired(turns(spark, [(c, 0, "user", "Hi.")])))
    assert got == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert tuples(repaired(turns(spark, []))) == []


def test_giant_conversation_streams_through_files(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "HELD_ROWS", 500)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(20_000)] + [(2, 0, "user", "x" * 300_000 + "!")]
    # A copy far away, and a hole.
    rows[15_000] = (1, 15_000, *rows[10][2:])
    del rows[7_000]
    edits = repair(turns(spark, rows))
    summary = {r["conv"]: r for r in edits.where("seq = -1").collect()}
    assert (summary["1"]["gaps"], summary["1"]["duplicate"], summary["1"]["cost"]) == (1, 1, 7)
    assert summary["1"]["audit"] == "K" * 7_000 + "I" + "K" * 7_999 + "DI" + "K" * 4_999
    assert summary["2"]["audit"] == "KI"
    kept = [(r["seq"], r["role"], r["text"]) for r in repaired_turns(edits).where("conv = '1'").collect()]
    kept.sort()
    assert fits("".join(r[:1] for _, r, _ in kept)) and len(kept) == 20_000
    want = "\n".join(f"{r}:{x}" for _, r, x in kept)
    assert {r["conv"]: r["repaired_sha256"] for r in digest(edits).collect()}["1"] == hashlib.sha256(want.encode()).hexdigest()
    assert EDITS.startswith("conv string")


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "x", 1) for i, v, y in rows], VECTORS)


def mined(rows, every=50, positives=5, negatives=3, low=50, high=95):
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, y in rows:
        if i % every:
            continue
        scores = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, z) for j, w, z in rows if j != i and len(w) == len(v)]
        ordered = sorted(scores, key=lambda x: (-x[0], x[1]))
        for s, j, _ in [x for x in ordered if x[2] == y][:positives]:
            fit = [x for x in ordered if x[2] != y and low * s <= 100 * x[0] <= high * s][:negatives]
            out += [(i, j, r + 1, n, s, t) for r, (t, n, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_match_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("FILE", 4), ("TILE", 3), ("SLAB", 16)):
            monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    # A third of all rows are copies, some scores are zero or negative, two rows repeat, ids have gaps.
    rows = [(int(i), (rng.integers(-2, 3, 4) / 4).tolist(), int(i) % 3) for i in rng.permutation(400)[:240]]
    rows += [(1000 + i, [0.5, 0.5, 0.25, 0.0], i % 2) for i in range(120)] + [(7, [1.0, 0.0, 0.0, 0.0], 0)] * 2
    rows += [(50_000, [1.0, 0.0], 0), (50_001, [2.0, 0.5], 0), (50_002, [1.5, 9.0], 1)]
    rows += [(None, [1, 1, 1, 1], 0), (600, None, 0), (601, [1, None, 1, 1], 0), (602, [1, math.nan, 0, 0], 1), (603, [math.inf, 0, 0, 0], 1), (650, [1, 1, 1, 1], None), (651, [], 1)]
    got = sorted(tuples(hard_negatives.hard_negatives(vectors(spark, rows).repartition(3), every=10)))
    assert got == mined(rows, every=10) and len(got) > 100


def test_hard_negatives_of_huge_numbers_and_of_nothing(spark):
    rows = [(0, [3e12, 1.0], 0), (1, [2e12, 5.0], 0), (2, [1.5e12, 1.0], 1), (3, [1e300, 0.0], 1), (4, [1e7, -1e12], 1)]
    assert tuples(hard_negatives.hard_negatives(vectors(spark, rows))) == mined(rows)
    rows = [(0, [3e4, 1.0], 0), (1, [2e4, 5.0], 0), (2, [1.5e4 + 1 / 256, 1.0], 1), (5, [1.2e4, 0], 1)]
    got = tuples(hard_negatives.hard_negatives(vectors(spark, rows)))
    assert got == mined(rows) and len(got) == 2
    assert tuples(hard_negatives.hard_negatives(vectors(spark, []))) == []
    assert tuples(hard_negatives.hard_negatives(vectors(spark, [(1, [1, 2], 0), (3, [1, 2], 1)]))) == []


def neighbours(rows, every, k):
    rows = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in rows:
        if i % every == 0:
            near = [(-float(np.dot(v / 2, w / 2)) / (np.linalg.norm(v / 2) * np.linalg.norm(w / 2)), j) for j, w in rows if j != i and len(w) == len(v)]
            out[i] = [j for _, j in sorted((round(s, 12), j) for s, j in near)[:k]]
    return out


def test_nearest_recall_against_brute_force(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 64))
    rows = [(i, (centres[i % 40] * (i % 3) / 2 + rng.normal(size=64)).tolist(), 0) for i in range(2500)]
    want = neighbours(rows, 20, 5)
    got = {}
    for q, rank, i, score in tuples(cross_polytope.nearest(vectors(spark, rows), every=20, k=5)):
        got.setdefault(q, []).append((rank, i))
        v, w = np.array(rows[q][1]), np.array(rows[i][1])
        assert score == pytest.approx(v @ w / np.linalg.norm(v) / np.linalg.norm(w), abs=1e-14)
    assert sum(len({i for _, i in got[q]} & set(want[q])) for q in want) >= 0.95 * 5 * len(want)
    # Two polytopes: 128 x 128 cells a table.
    more = {}
    for q, _, i, _ in tuples(cross_polytope.nearest(vectors(spark, rows), every=20, k=5, polytopes=2, probes=400)):
        more.setdefault(q, set()).add(i)
    assert sum(len(more[q] & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_nearest_is_exact_with_all_cells_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "ROWS", 7)
    monkeypatch.setattr(cross_polytope, "QUERIES", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 5).tolist(), 0) for i in range(120)]
    # A third are copies of one vector, some at other lengths; one row repeats; huge and tiny numbers.
    rows += [(200 + i, [1, 2, 0, 0, 1], 0) for i in range(60)] + [(400 + i, [1e200, 2e200, 0, 0, 1e200], 0) for i in range(8)] + [(410, [1e-200, 0, 0, 1e-200, 0], 0)]
    rows += [(5, rows[5][1], 0), (500, [1, 0], 0), (501, [0, 1], 0), (510, [3], 0), (None, [1, 2, 0, 0, 1], 0), (520, None, 0), (530, [0] * 5, 0), (540, [1, None, 0, 0, 0], 0), (550, [math.nan] * 5, 0), (560, [], 0)]
    # Powers of two scale exactly, so that copies at other lengths are ties in double precision too.
    got = {}
    for q, rank, i, _ in tuples(cross_polytope.nearest(vectors(spark, rows).repartition(3), every=10, k=5, tables=1, probes=16)):
        got.setdefault(q, []).append((rank, i))
    plain = [r for n, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:n]}]
    plain = [(i, [x / 1e200 for x in v] if v and max(map(abs, [x or 0 for x in v])) >= 1e199 else [x * 1e200 for x in v] if i == 410 else v, y) for i, v, y in plain]
    want = neighbours(plain, 10, 5)
    assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in want.items() if x}
    by_id = {i: np.array(v) for i, v, _ in plain if v and None not in v}
    near = lambda q, i: by_id[q] @ by_id[i] / np.linalg.norm(by_id[q]) / np.linalg.norm(by_id[i])
    for q, found in got.items():
        assert [r for r, _ in sorted(found)] == list(range(1, len(found) + 1))
        assert [near(q, i) for _, i in sorted(found)] == pytest.approx([near(q, i) for i in want[q]], abs=1e-12)
    assert [i for _, i in sorted(got[200])] == [201, 202, 203, 204, 205]


def test_nearest_of_nothing(spark):
    assert tuples(cross_polytope.nearest(vectors(spark, []))) == []
    assert tuples(cross_polytope.nearest(vectors(spark, [(1, [1.0], 0), (50, [0.0], 0)]))) == []
    assert tuples(cross_polytope.nearest(vectors(spark, [(50, [1.0, 1.0], 0)]))) == []


def test_hadamard_keeps_lengths_and_cells_are_the_nearest_axes():
    x = cross_polytope.unit(np.random.default_rng(0).normal(size=(50, 6)))
    near = cross_polytope.axes(x, 0, 0, 1)
    assert np.allclose((near[:, :8] ** 2).sum(1), 1) and np.allclose(near[:, :8], -near[:, 8:])
    assert (cross_polytope.cells(x, 0, 1, 1, 1)[:, 0] == near.argmax(1)).all()
    # The best pairs of axes by the sum of both.
    a, b = near, cross_polytope.axes(x, 0, 1, 1)
    sums = (a[:, :, None] + b[:, None, :]).reshape(50, -1)
    assert (np.sort(np.take_along_axis(sums, cross_polytope.cells(x, 0, 2, 9, 1), 1)) == np.sort(np.sort(sums)[:, -9:])).all()
