"""Language ID: each document as a mixture of languages, fitted by expectation-maximisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relimpute.llm.tables import crc_fold, stored, taken, unused

BUCKETS = 1 << 15
#: A model holds this many languages at most, so that its size is bounded (8 bytes a bucket and language).
MOST_LANGUAGES = 512
#: Neighbouring trigrams share letters; a text counts as this part of its trigrams.
INDEPENDENT = 1 / 3
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; built once in a worker."""
    if not _letters:
        _letters.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _letters[0]


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the trigrams of a text in lower case; anything but letters is one blank. None without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.where(letter, points, 32)
    points = points[letter | np.r_[False, letter[:-1]]]
    points = np.r_[32, points, 32].astype(np.uint32)
    mixed = (points[:-2] * np.uint32(0x9E3779B1)) ^ (points[1:-1] * np.uint32(0x85EBCA77)) ^ (points[2:] * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int64)


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows (text, lang); a task sends its own sums once."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                grams = trigrams(text.as_py())
                if lang not in sums:
                    if len(sums) >= MOST_LANGUAGES:
                        raise ValueError(f"more than {MOST_LANGUAGES} languages")
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(grams, minlength=BUCKETS)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])

    return rows.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log probability of every bucket in each."""
    counted = stored(gram_counts(rows.where("lang IS NOT NULL AND text IS NOT NULL")), "grams")
    languages = [r["lang"] for r in counted.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = counted.toArrow()
    counts = np.full((len(languages), BUCKETS), 0.5)
    place = {lang: i for i, lang in enumerate(languages)}
    who = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
    if len(who):
        counts[who, table.column("bucket").to_numpy()] += table.column("n").to_numpy()
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True))


def proportions(seen: np.ndarray, weight: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Mixture shares of the rows of `seen` (likelihoods by trigram), and the mixture's likelihood of each trigram."""
    share = np.full(len(seen), 1 / len(seen))
    for _ in range(rounds):
        part = share[:, None] * seen
        new = (part / part.sum(axis=0)) @ weight / weight.sum()
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, share @ seen


def mixture(grams: np.ndarray, model: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Shares of all languages in a text: fitted on all of them, and on the set that a penalised likelihood selects.

    Languages join in the order of their share in the full fit, as long as each raises the log likelihood by more than
    penalty * log(1 + length).
    """
    counts = np.bincount(grams, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    weight = counts[at].astype(float)
    logs = model[:, at]
    seen = np.exp(logs - logs.max(axis=0))
    full, _ = proportions(seen, weight)
    cost = penalty * np.log1p(len(grams) * INDEPENDENT)
    order = np.argsort(-full, kind="stable")
    best = int(np.argmax(logs @ weight))
    order = np.r_[best, order[order != best]]
    reached, chosen = INDEPENDENT * float(np.log(seen[best]) @ weight), np.eye(len(model))[best]
    for k in range(2, len(model) + 1):
        share, likely = proportions(seen[order[:k]], weight)
        value = INDEPENDENT * float(np.log(likely) @ weight)
        if value - reached <= cost:
            break
        reached, chosen = value, np.zeros(len(model))
        chosen[order[:k]] = share
    return full, chosen


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, penalty: float = 1.0) -> DataFrame:
    """Predict the language mixture of every whole text.

    The model counts letter trigrams of all rows with text and lang whose crc32(doc_id as text) modulo `folds` is not
    `held_out`; lang is read there only. Returns one row per input row: doc_id, held_out, lang_pred (the largest
    share of the selected set of languages), score (that language's share when all may take part), languages (all
    with a share in the selected set, as lang and share). NULL texts and texts without a letter, and all texts if
    nothing could be learned, are `und` with score 0 and no languages. Repeated rows come out as often as they went
    in; rows without doc_id count as the empty id; empty tables give empty results; other columns are ignored.

    A task sends sums per language and bucket, so what is exchanged doesn't grow with the text; predicting needs no exchange.
    """
    rows = taken(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("held_out", crc_fold("doc_id", folds) == held_out)
    languages, model = fit(rows.where(~F.col("held_out")).select("text", F.col("lang").cast("string").alias("lang")))

    def run(batches):
        for batch in batches:
            names, scores, mixes = [], [], []
            for text in batch.column("text"):
                grams = trigrams(text.as_py())
                if not len(grams) or not languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    mixes.append([])
                    continue
                full, chosen = mixture(grams, model, penalty)
                top = int(np.argmax(chosen))
                names.append(languages[top])
                scores.append(float(min(max(full[top], 0.0), 1.0)))
                mixes.append([{"lang": languages[i], "share": float(chosen[i])} for i in np.argsort(-chosen, kind="stable") if chosen[i] > 0])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, kind)], names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages array<struct<lang string, share double>>")


def with_language(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose text has a language, with all their columns."""
    (rejected,) = unused(docs, "rejected")
    gone = language_id(docs, id_col=id_col).where(F.col("lang_pred") == UNKNOWN).select(F.col("doc_id").alias(rejected)).distinct()
    # A row is rejected for its text alone: those that share the id of a rejected row but hold letters stay.
    lettered = docs["text"].rlike(r"\p{L}")
    return docs.join(gone, docs[f"`{id_col}`"].eqNullSafe(F.col(rejected)) & ~F.coalesce(lettered, F.lit(False)), "left_anti")
