"""Conversation structure repair: turns sorted inside partitions, a dynamic program carried from batch to batch."""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relimpute.llm import files
from relimpute.llm.tables import shared_folder, taken

BLANKS = " \t\n\x0b\x0c\r"
#: Rows and characters of one conversation that a task holds; more are written to the shared folder in parts of this size.
HELD_ROWS, HELD_CHARS = 1 << 16, 1 << 24
#: Rows of an output batch.
OUT_ROWS = 4096

# What the kept rows spell so far: nothing, an opening system turn, a user turn that waits, a finished exchange.
NOTHING, SYSTEM, WAITING, FINISHED = range(4)
#: State after an inserted turn, or one given a new role: always the turn that may come next.
NEXT = (WAITING, WAITING, FINISHED, WAITING)
ROLE = {WAITING: "user", FINISHED: "assistant"}
#: What can be done at a row: its own edit, with or without an inserted turn before it. Two inserted turns in a row only pay at the end.
WORDS = ("D", "K", "R", "ID", "IK", "IR")
#: Inserted turns that end a conversation.
ENDS = {NOTHING: "", SYSTEM: "II", WAITING: "I", FINISHED: ""}
DELETED = 8

EDITS = (
    "conv string, seq bigint, edit string, no_turn boolean, turn bigint, role string, text string, "
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
)
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def kept_state(state: int, initial: int) -> int | None:
    """State after keeping a turn whose role begins with s, u, a (0, 1, 2) or anything else (3)."""
    if initial == 0:
        return SYSTEM if state == NOTHING else None
    if initial == 1:
        return WAITING if state != WAITING else None
    return FINISHED if initial == 2 and state == WAITING else None


@lru_cache(maxsize=None)
def step(states: tuple, kind: int) -> tuple[tuple, int, bytes]:
    """One row of the program: (states after it, cost that all of them share, four back pointers).

    `states` holds per state None or (cost above the cheapest, place of its edits in ASCII order). The edits of two
    states both end in a row's own letter and cover the same rows, so none begins with the other, and their
    order decides every later tie. Costs differ by a few units only: there are few different `states`, and
    a row is one look-up. A back pointer is 8 * the state before + the word, 255 for a state out of reach.
    """
    best: list[tuple | None] = [None] * 4
    initial, cut = divmod(kind, 2)
    for before, known in enumerate(states):
        if known is None:
            continue
        for code, word in enumerate(WORDS):
            at, cost = before, known[0]
            if word[0] == "I":
                at, cost = NEXT[at], cost + 2
            if word[-1] == "D":
                cost += 3
            elif kind == DELETED:
                continue
            elif word[-1] == "K":
                at = kept_state(at, initial)
                cost += cut
            else:
                at, cost = NEXT[at], cost + 2 + cut
            if at is not None:
                found = (cost, known[1], word, 8 * before + code)
                best[at] = found if best[at] is None else min(best[at], found)
    least = min(b[0] for b in best if b)
    order = sorted((b[1], b[2]) for b in best if b)
    after = tuple(None if b is None else (b[0] - least, order.index((b[1], b[2]))) for b in best)
    return after, least, bytes(255 if b is None else b[3] for b in best)


class Conversation:
    """The rows of one conversation as they stream by, and the program over them."""

    def __init__(self, conv, folder: str):
        self.conv, self.folder = conv, folder
        self.states, self.cost = ((0, 0), None, None, None), 0
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = self.rows = 0
        self.last = self.first_turn = self.last_turn = None
        self.held, self.back, self.chars = [], bytearray(), 0
        self.parts: list[tuple[str, int]] = []

    def add(self, no_turn: bool, turn: int, role: str, text: str, fault: int) -> None:
        if self.last is not None:
            if not fault or fault == 3:
                # Equal rows lie side by side; a copy at a later turn was found by the join.
                fault = 2 if self.last == (no_turn, turn, role, text) else fault
            self.illegal += self.last[2][:1] + role[:1] not in ("su", "ua", "au")
        self.last = (no_turn, turn, role, text)
        self.faults[fault] += 1
        if not no_turn:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        initial = "sua".find(role[0]) if role else 3
        kind = DELETED if fault in (1, 2) else 2 * (initial if initial >= 0 else 3) + (fault == 3)
        self.states, more, back = step(self.states, kind)
        self.cost += more
        self.back += back
        self.held.append((no_turn, turn, role, text))
        self.chars += len(role) + len(text)
        self.rows += 1
        if len(self.held) >= HELD_ROWS or self.chars >= HELD_CHARS:
            self.spill()

    def spill(self) -> None:
        """Rows and back pointers of a giant conversation go to the shared folder; a task that runs again writes its own."""
        name = f"{self.folder}/{uuid.uuid4().hex}"
        files.write_array(f"{name}.back", np.frombuffer(bytes(self.back), np.uint8))
        table = pa.table(dict(zip(("no_turn", "turn", "role", "text"), map(list, zip(*self.held)), strict=True)))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        files.write_array(f"{name}.rows", np.frombuffer(sink.getvalue(), np.uint8))
        self.parts.append((name, len(self.held)))
        self.held, self.back, self.chars = [], bytearray(), 0

    def words(self) -> tuple[int, str, list[bytes], str]:
        """Cost, the end's inserted turns, the word of every row part by part, and the audit: back pointers from last to first."""
        ends = [(known[0] + 2 * len(ENDS[s]), known[1], ENDS[s], s) for s, known in enumerate(self.states) if known is not None]
        more, _, end, state = min(ends)
        found = []
        for part in [None, *reversed(self.parts)]:
            back = self.back if part is None else files.read_array(f"{part[0]}.back", np.uint8)
            n = len(back) // 4
            codes = bytearray(n)
            for i in range(n - 1, -1, -1):
                state, codes[i] = divmod(int(back[4 * i + state]), 8)
            found.append(bytes(codes))
        found.reverse()
        audit = "".join("".join(map(WORDS.__getitem__, codes)) for codes in found) + end
        return self.cost + more, end, found, audit

    def rows_of(self, part: int):
        if part == len(self.parts):
            return self.held
        with pa.ipc.open_stream(pa.py_buffer(files.read_array(f"{self.parts[part][0]}.rows", np.uint8))) as source:
            table = source.read_all()
        return zip(*(table.column(c).to_pylist() for c in table.column_names), strict=True)

    def result(self):
        """First the summary (seq -1), then every edit in order."""
        nothing = (None,) * 7
        cost, end, found, audit = self.words()
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        yield (self.conv, -1, None, None, None, None, None, gaps, *self.faults[1:], self.illegal, cost, audit)
        seq, state = 0, NOTHING
        for part, codes in enumerate(found):
            for code, (no_turn, turn, role, text) in zip(codes, self.rows_of(part), strict=True):
                word = WORDS[code]
                if word[0] == "I":
                    state = NEXT[state]
                    yield (self.conv, seq, "I", True, 0, ROLE[state], "", *nothing)
                    seq += 1
                if word[-1] == "K":
                    state = kept_state(state, "sua".find(role[0]))
                elif word[-1] == "R":
                    state = NEXT[state]
                    role = ROLE[state]
                yield (self.conv, seq, word[-1], no_turn, turn, role, text, *nothing)
                seq += 1
        for _ in end:
            state = NEXT[state]
            yield (self.conv, seq, "I", True, 0, ROLE[state], "", *nothing)
            seq += 1


def frames(rows, columns: list[str]):
    """Rows as pandas frames of bounded length; object columns, so that whole numbers with NULLs stay whole."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == OUT_ROWS:
            yield pd.DataFrame(held, columns=columns, dtype=object)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns, dtype=object)


def last_character(text: Column) -> Column:
    """The last character that is not blank; empty if there is none."""
    return F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1)


def marked(rows: DataFrame) -> DataFrame:
    """Adds `fault`: 1 blank, 2 seen at an earlier turn, 3 truncated, 0 none. Copies within one turn are left to the stream.

    Equal rows of a conversation are found by a 128-bit digest. Its first turns are added up in the tasks; only
    digests that have several turns are joined back, on the digest, so a long conversation spreads over all tasks.
    """
    last = last_character(F.col("text"))
    whole = F.concat(
        F.coalesce(F.concat(F.length("conv").cast("string"), F.lit(":"), "conv"), F.lit("-")), F.lit(":"),
        F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text",
    )
    # Rows that can't repeat anything get a name of their own turn, so that they don't meet in one task.
    own = F.concat_ws("|", F.lit("-"), "conv", F.col("turn").cast("string"))
    able = F.coalesce(~F.col("gone") & (last != ""), F.lit(False))
    rows = rows.withColumn("digest", F.unhex(F.md5(F.when(able, F.concat(F.lit("+"), whole)).otherwise(own))))
    turn = F.when(~F.col("no_turn"), F.col("turn"))
    seen = rows.where(able).groupBy("digest").agg(F.bool_or("no_turn").alias("open"), F.min(turn).alias("first"), F.max(turn).alias("final"))
    seen = seen.where("first < final OR open AND first IS NOT NULL").select("digest", "open", "first")
    again = ~F.col("no_turn") & (F.col("open") | (F.col("turn") > F.col("first")))
    fault = F.when(last == "", 1).when(F.coalesce(again, F.lit(False)), 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return rows.join(seen, "digest", "left").select("conv", "no_turn", "turn", "role", "text", "gone", fault.alias("fault"))


def repair(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None,
) -> DataFrame:
    """The cheapest edits that make every conversation an optional system turn and alternating user and assistant turns.

    Keeping a row costs 0, giving it the role user or assistant 2, deleting it 3, inserting an empty user or assistant turn 2; rows
    without a character that is not blank, and repeats of a role and text seen earlier in the conversation, must be
    deleted; a row that stays although its last such character is not one of .!? adds 1. Of equally cheap edits
    those whose initials D, I, K, R come first in ASCII order are taken.

    Returns edit rows, per conversation in order within one partition: first the summary (seq -1: gaps, blank, duplicate,
    truncated, illegal, cost, audit), then each edit (seq from 0, edit, turn, role, text), deleted rows
    included, roles as they become. `conv` is the id as text.

    Rows are sorted by turn (NULL first), then role and text, so ties have one order and repeated rows are repeats. NULL role or text is
    one space; a row with an empty role can't stay as it is; NULL ids are one conversation. Rows where `gone_col` is true only make their conversation known. Empty
    tables give no rows; other columns are ignored. Texts are never cut.

    A partition is one sorted stream. A task holds one conversation up to 65,536 rows or 16 M characters; beyond that rows and
    back pointers (4 bytes a row) go to files in the shared folder, read once backwards and once forwards, so a
    giant conversation needs no more memory than a byte a row for its audit.
    """
    rows = taken(conversations, conv=id_col, turn=turn_col, role=role_col, text=text_col, **({"gone": gone_col} if gone_col else {}))
    gone = F.coalesce("gone", F.lit(False)) if gone_col else F.lit(False)
    text = lambda c: F.when(~gone, F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    rows = rows.select(
        F.col("conv").cast("string").alias("conv"), (gone | F.col("turn").isNull()).alias("no_turn"),
        F.when(~gone, F.coalesce(F.col("turn").cast("bigint"), F.lit(0))).otherwise(0).cast("bigint").alias("turn"),
        text("role").alias("role"), text("text").alias("text"), gone.alias("gone"),
    )
    folder = f"{shared_folder(conversations.sparkSession)}/llm-conversations-{uuid.uuid4().hex}"
    columns = [c.split(" ")[0] for c in EDITS.split(", ")]

    def run(batches):
        def results():
            current = None
            for batch in batches:
                for conv, no_turn, turn, role, text, gone, fault in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                    if current is None or conv != current.conv:
                        if current is not None:
                            yield from current.result()
                        current = Conversation(conv, folder)
                    if not gone:
                        current.add(no_turn, turn, role, text, fault)
            if current is not None:
                yield from current.result()

        return frames(results(), columns)

    sorted_rows = marked(rows).repartition("conv").sortWithinPartitions("conv", F.desc("no_turn"), "turn", "role", "text")
    return sorted_rows.mapInPandas(run, EDITS)


def repaired_turns(edits: DataFrame) -> DataFrame:
    """The repaired conversations: conv, seq (place of the edit), role, text, turn (NULL for inserted turns)."""
    return edits.where("seq >= 0 AND edit <> 'D'").select("conv", "seq", F.when(~F.col("no_turn"), F.col("turn")).alias("turn"), "role", "text")


def digest(edits: DataFrame) -> DataFrame:
    """One row per conversation: its summary and the SHA-256 of the repaired `role:text` lines.

    `edits` must come straight from `repair`: the lines are hashed as they stream by, in their order.
    """
    columns = ["conv", *COUNTS, "audit", "repaired_sha256"]

    def run(batches):
        def results():
            summary, sha, empty = None, None, True
            for batch in batches:
                for row in zip(*(batch[c].tolist() for c in ("seq", "edit", "role", "text", "conv", *COUNTS, "audit")), strict=True):
                    if row[0] < 0:
                        if summary is not None:
                            yield (*summary, sha.hexdigest())
                        counts = [int(x) for x in row[5:-1]]
                        summary, sha, empty = (row[4], *counts, row[-1]), hashlib.sha256(), True
                    elif row[1] != "D":
                        sha.update(f"{'' if empty else chr(10)}{row[2]}:{row[3]}".encode())
                        empty = False
            if summary is not None:
                yield (*summary, sha.hexdigest())

        return frames(results(), columns)

    return edits.mapInPandas(run, "conv string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows damaged by crc32 of `conv_id:turn` modulo 20 (NULLs: one space).

    0 drops a row (`gone`), 1 empties its text, 2 takes .!? out of it, 3 repeats it, 4 makes it a user turn.
    """
    rows = taken(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = rows.withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(space("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), times.alias("time")).drop("time")


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """Damage the conversations and repair them: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation that lost all its rows has zeros, an empty audit and the hash of nothing. See `damaged` and `repair`.
    """
    kind = conversations.schema["conv_id"].dataType
    found = digest(repair(damaged(conversations), gone_col="gone"))
    return found.select(F.col("conv").cast(kind).alias("conv_id"), *COUNTS, "audit", "repaired_sha256")


SQL = r"""
WITH RECURSIVE k AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
    FROM conversations
), b AS (
    SELECT *, flatten(list_transform(string_split(name, ''), lambda ch: list_transform(range(8), lambda i: (ascii(ch) >> i) & 1))) AS bits FROM k
), d AS (
    SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, bits), lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 20 AS kind FROM b
), e AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM d, range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)
), n AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut
    FROM e
), f AS (
    SELECT *, CASE WHEN cut = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
        WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
    FROM n
), words(word, edit, price) AS (
    VALUES ('D', 'D', 3), ('K', 'K', 0), ('R', 'R', 2), ('ID', 'D', 5), ('IK', 'K', 2), ('IR', 'R', 4)
), moves(word, edit, price, before, mid) AS (
    SELECT word, edit, price, before, CASE WHEN word[1] <> 'I' THEN before WHEN before = 2 THEN 3 ELSE 2 END FROM words, range(4) AS s(before)
), dp AS (
    SELECT conv_id, 0 AS i, 0 AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, i, state, best.cost, best.audit, best.lines FROM (
        SELECT conv_id, i, state, min({'cost': cost, 'audit': audit, 'lines': lines}) AS best FROM (
            SELECT dp.conv_id, f.i, dp.cost + price + CASE WHEN edit <> 'D' AND fault = 3 THEN 1 ELSE 0 END AS cost, dp.audit || word AS audit,
                CASE WHEN edit = 'D' THEN mid WHEN edit = 'R' THEN CASE WHEN mid = 2 THEN 3 ELSE 2 END
                    WHEN left(role, 1) = 's' THEN 1 WHEN left(role, 1) = 'u' THEN 2 ELSE 3 END AS state,
                dp.lines || CASE WHEN word[1] <> 'I' THEN [] WHEN before = 2 THEN ['assistant:'] ELSE ['user:'] END
                    || CASE WHEN edit = 'D' THEN [] WHEN edit = 'K' THEN [role || ':' || text] WHEN mid = 2 THEN ['assistant:' || text] ELSE ['user:' || text] END AS lines
            FROM dp JOIN f ON dp.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = dp.i + 1 JOIN moves ON before = dp.state
            WHERE (edit = 'D' OR fault NOT IN (1, 2)) AND (edit <> 'K' OR left(role, 1) = 's' AND mid = 0 OR left(role, 1) = 'u' AND mid <> 2 OR left(role, 1) = 'a' AND mid = 2)
        ) GROUP BY conv_id, i, state
    )
), ends AS (
    SELECT conv_id, i, min({'cost': cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'audit': audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
        'lines': lines || CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END}) AS best
    FROM dp GROUP BY conv_id, i
), last AS (
    SELECT conv_id, arg_max(best, i) AS best FROM ends GROUP BY conv_id
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
        count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM f GROUP BY conv_id
)
SELECT last.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM last LEFT JOIN counts ON last.conv_id IS NOT DISTINCT FROM counts.conv_id
"""
