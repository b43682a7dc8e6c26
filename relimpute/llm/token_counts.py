"""Token counts: greedy longest-match word pieces, counted by a trie with failure links in linear time."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame

from relimpute.llm.tables import taken

#: Counted words kept in a worker, at most.
REMEMBERED = 400_000

_automata: dict[str, "Automaton"] = {}


class Automaton:
    """Counts the pieces of a word without building them.

    A node stands for a prefix of a piece. Where the text leaves the trie, the failure link leads to the node
    of what remains after the longest pieces of the node's string are taken off, and `popped` says how many those are;
    it is known beforehand for every node, so a word takes a step per byte and no step back.
    """

    def __init__(self, pieces):
        self.step: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                after = self.step[node].get(byte)
                if after is None:
                    after = self.step[node][byte] = len(self.step)
                    self.step.append({})
                    whole.append(False)
                node = after
            if node:
                whole[node] = True
        self.fail: list[int | None] = [None] * len(self.step)
        self.popped = [0] * len(self.step)
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, child in self.step[node].items():
                    below.append(child)
                    if whole[child]:
                        self.fail[child], self.popped[child] = 0, 1
                        continue
                    at, popped = self.fail[node], self.popped[node]
                    while at is not None and byte not in self.step[at]:
                        popped += self.popped[at]
                        at = self.fail[at]
                    if at is not None:
                        self.fail[child], self.popped[child] = self.step[at][byte], popped
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of the word; one (unknown) if pieces can't cover it; none for an empty word."""
        step, fail, popped = self.step, self.fail, self.popped
        node, total = 0, 0
        for byte in word:
            while byte not in step[node]:
                total += popped[node]
                node = fail[node]
                if node is None or (node == 0 and byte not in step[0]):
                    return 1
            node = step[node][byte]
        while node:
            total += popped[node]
            node = fail[node]
            if node is None:
                return 1
        return total

    @staticmethod
    def of(path: str) -> "Automaton":
        """From a file of lines `base64(piece) rank`; built once in a worker."""
        if path not in _automata:
            with open(path, "rb") as lines:
                _automata[path] = Automaton(base64.b64decode(line.split()[0]) for line in lines if line.strip())
        return _automata[path]


class WordCounts(dict):
    """Counts of words met before; words repeat, so most need no walk."""

    def __init__(self, automaton: Automaton, before: bytes):
        super().__init__()
        self.automaton, self.before = automaton, before

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.before + word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", before: str = " ") -> DataFrame:
    """How many word pieces every text has.

    Words are runs of anything but ASCII blanks; `before` is put in front of each, as the vocabulary writes the
    beginning of a word. A word is cut from the left into the longest pieces of the vocabulary; a word that can't be
    covered is one piece. Returns one row per input row: doc_id, n_words, n_tokens. NULL and empty texts have none;
    repeated rows come out as often as they went in; empty tables give empty results; other columns are ignored.

    No exchange: rows are counted where they are read, whole texts at a time, and the vocabulary is a file of fixed size.
    """
    start = before.encode()

    def run(batches):
        counts = WordCounts(Automaton.of(vocabulary), start)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("text"):
                split = text.as_py().encode().split() if text.is_valid else []
                words.append(len(split))
                tokens.append(sum(map(counts.__getitem__, split)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    rows = taken(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_tokens bigint")
