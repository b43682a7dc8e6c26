"""LM scoring: an interpolated modified Kneser-Ney bigram model over sorted arrays that workers map into memory."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relimpute.llm.files import read_array, write_array
from relimpute.llm.tables import crc_fold, partitions, shared_folder, stored, taken
from relimpute.llm.words import mix, slices, word_hashes

U64 = np.uint64
#: The token after the last word of a text. No word has this hash but by chance.
END = U64(0xE7D0E7D0E7D0E7D1)
#: Word occurrences per shard of the vocabulary and of the word pairs, about.
SHARD = 1 << 22
UNSEEN = np.int64(-1)


@dataclass
class Model:
    """Where the arrays lie, and the few numbers every task needs.

    Words have the rank of their hash as number. `words/<s>` holds the sorted hashes of shard s and `uses/<s>` their
    counts; `firsts` are the numbers at which shards begin. Word pairs are one sorted array per shard of first words,
    but pairs that begin with one of the `hot` words are dealt by the pair.
    """

    folder: str
    firsts: np.ndarray
    shards: int
    tokens: int
    vocabulary: int
    hot: np.ndarray | None = None
    hot_sums: np.ndarray | None = None
    discounts: np.ndarray | None = None
    lower: np.ndarray | None = None
    pairs: int = 0

    def __post_init__(self):
        self._arrays: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_arrays": {}}

    def array(self, name: str, shard: int, dtype) -> np.ndarray:
        key = (name, shard)
        if key not in self._arrays:
            self._arrays[key] = read_array(f"{self.folder}/{name}/{shard:06d}", dtype)
        return self._arrays[key]

    def word_shard(self, hashes: np.ndarray) -> np.ndarray:
        return (((hashes >> U64(32)) * U64(len(self.firsts) - 1)) >> U64(32)).astype(np.int64)

    def pair_shard(self, first: np.ndarray) -> np.ndarray:
        """The shard of pairs by their first word's number: equal ranges."""
        return first * self.shards // max(self.vocabulary + 1, 1)

    def range_of(self, shard: int) -> tuple[int, int]:
        """The numbers whose pairs lie in a shard: from, to."""
        n = self.vocabulary + 1
        return -(-shard * n // self.shards), -(-(shard + 1) * n // self.shards)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of sorted distinct hashes; UNSEEN and 0 for unknown ones."""
        number, uses = np.full(len(hashes), UNSEEN), np.zeros(len(hashes), np.int64)
        for s, part in parts(self.word_shard(hashes)):
            known = self.array("words", s, U64)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[part]), len(known) - 1)
                here = known[at] == hashes[part]
                number[part] = np.where(here, at + self.firsts[s], UNSEEN)
                uses[part] = np.where(here, self.array("uses", s, np.int64)[at], 0)
        return number, uses

    def by_number(self, name: str, number: np.ndarray, columns: int) -> np.ndarray:
        """Rows of a table that is stored in ranges of word numbers; zeros for UNSEEN."""
        out = np.zeros((len(number), columns), np.int64)
        seen = np.flatnonzero(number >= 0)
        for s, part in parts(self.pair_shard(number[seen])):
            part = seen[part]
            out[part] = self.array(name, s, np.int64).reshape(-1, columns)[number[part] - self.range_of(s)[0]]
        return out

    def pair_counts(self, pairs: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pairs."""
        out = np.zeros(len(pairs), np.int64)
        first = (pairs >> U64(32)).astype(np.int64)
        is_hot = found_in(self.hot, first)
        shard = np.where(is_hot, self.shards + (mix(pairs) % U64(self.shards)).astype(np.int64), self.pair_shard(first))
        for s, part in parts(shard):
            known = self.array("pairs", s, U64)
            if len(known):
                at = np.minimum(np.searchsorted(known, pairs[part]), len(known) - 1)
                out[part] = np.where(known[at] == pairs[part], self.array("times", s, np.uint32)[at], 0)
        return out

    def contexts(self, first: np.ndarray) -> np.ndarray:
        """Per first word: how often it stands before another, and after how many words once, twice, more often."""
        out = self.by_number("contexts", first, 4)
        hot = found_in(self.hot, first)
        out[hot] = self.hot_sums[np.searchsorted(self.hot, first[hot])]
        return out


def found_in(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def parts(of: np.ndarray):
    """(value, positions) for every value."""
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(of[part[0]]), part


def discounts(seen: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and more, from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (float(x) for x in seen)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    each = [0.0, *(k - (k + 1) * y * (above / here) if here else k / 2 for k, here, above in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]
    return np.array([min(max(d, 0.0), float(k)) for k, d in enumerate(each)])


def texts_with_ends(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows with END after each row's words, and where each row begins."""
    words, starts = word_hashes(column)
    at = starts + np.arange(len(starts))
    out = np.full(int(at[-1]), END, U64)
    keep = np.ones(len(out), bool)
    keep[at[1:] - 1] = False
    out[keep] = words
    return out, at


def count_words(train: DataFrame) -> DataFrame:
    """word (hash), n over all texts, the end included."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                word, n = np.unique(texts_with_ends(piece.column("text"))[0], return_counts=True)
                yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return train.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def store_words(counts: DataFrame, folder: str, tokens: int) -> Model:
    """Write the vocabulary as sorted shards."""
    spark = counts.sparkSession
    shards = partitions(spark, tokens, SHARD)
    # Hashes in unsigned order: the upper half of the hash, scaled to the number of shards.
    upper = F.shiftrightunsigned("word", 32)
    dealt = counts.withColumn("shard", F.shiftright(upper * shards, 32).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        word, n = table.column("word").to_numpy().view(U64), table.column("n").to_numpy()
        order = np.argsort(word)
        write_array(f"{folder}/words/{s:06d}", word[order])
        write_array(f"{folder}/uses/{s:06d}", n[order].astype(np.int64))
        return pa.table({"shard": pa.array([s], pa.int32()), "words": [len(word)], "tokens": [int(n.sum())]})

    made = stored(dealt.groupBy("shard").applyInArrow(run, "shard int, words bigint, tokens bigint"), "word-shards").collect()
    sizes, total = np.zeros(shards, np.int64), 0
    for row in made:
        sizes[row["shard"]] = row["words"]
        total += row["tokens"]
    for s in np.flatnonzero(sizes == 0):
        write_array(f"{folder}/words/{s:06d}", np.zeros(0, U64))
        write_array(f"{folder}/uses/{s:06d}", np.zeros(0, np.int64))
    if sizes.sum() >= (1 << 32) - 1:
        raise ValueError("more distinct words than 32-bit numbers")
    return Model(folder, np.r_[0, np.cumsum(sizes)], shards, total, int(sizes.sum()))


def packed(values: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return len(values).to_bytes(8, "little") + pa.Codec("zstd").compress(steps.tobytes(), asbytes=True)


def unpacked(data: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.Codec("zstd").decompress(data[8:], n * np.dtype(dtype).itemsize, asbytes=True)
    with np.errstate(over="ignore"):
        return np.cumsum(np.frombuffer(raw, dtype), dtype=dtype)


def token_numbers(model: Model, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, counts and row begins of all tokens of a text column."""
    words, at = texts_with_ends(column)
    distinct, back = np.unique(words, return_inverse=True)
    number, uses = model.numbers(distinct)
    return number[back], uses[back], at


def before_each(model: Model, number: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of the token before each; the one after all words stands for the beginning of a text."""
    before = np.r_[UNSEEN, number[:-1]]
    before[at[:-1]] = model.vocabulary
    return before


def count_pairs(train: DataFrame, model: Model) -> DataFrame:
    """shard, pairs and times, packed: pairs of neighbouring tokens of all texts, summed within a slice."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                number, _, at = token_numbers(model, piece.column("text"))
                first = before_each(model, number, at)
                pair, times = np.unique((first.astype(U64) << U64(32)) | number.astype(U64), return_counts=True)
                first = (pair >> U64(32)).astype(np.int64)
                shard = np.where(found_in(model.hot, first), model.shards + (mix(pair) % U64(model.shards)).astype(np.int64), model.pair_shard(first))
                found = [(s, packed(pair[p]), pa.Codec("zstd").compress(times[p].astype(np.uint32).tobytes(), asbytes=True)) for s, p in parts(shard)]
                yield pa.record_batch([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary())], names=["shard", "pairs", "times"])

    return train.select("text").mapInArrow(run, "shard int, pairs binary, times binary")


def store_pairs(packs: DataFrame, model: Model) -> DataFrame:
    """Write the pairs of a shard, and for its range of first words their sums.

    Returns rows of three kinds: `seconds` of a shard of second words (packed, ascending, one per distinct pair);
    sums of a hot first word; and, with both empty, how many pairs of the shard were seen once to four times.
    """

    def run(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        pair = [unpacked(x.as_py(), U64) for x in table.column("pairs")]
        times = [np.frombuffer(pa.Codec("zstd").decompress(x.as_py(), 4 * len(p), asbytes=True), np.uint32) for x, p in zip(table.column("times"), pair, strict=True)]
        pair, times = np.concatenate(pair), np.concatenate(times)
        order = np.argsort(pair, kind="stable")
        pair, times = pair[order], times[order]
        begin = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        pair, times = pair[begin], np.add.reduceat(times.astype(np.int64), begin)
        write_array(f"{model.folder}/pairs/{s:06d}", pair)
        write_array(f"{model.folder}/times/{s:06d}", np.minimum(times, np.iinfo(np.uint32).max).astype(np.uint32))
        first = (pair >> U64(32)).astype(np.int64)
        columns = np.stack([times, times == 1, times == 2, times > 2], axis=1).astype(np.int64)
        rows: list[tuple] = []
        if s < model.shards:
            low, high = model.range_of(s)
            sums = np.stack([np.bincount(first - low, c, high - low) for c in columns.T], axis=1)
            write_array(f"{model.folder}/contexts/{s:06d}", sums.astype(np.int64))
        else:
            edge = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
            rows += [(None, None, int(f), *map(int, c)) for f, c in zip(first[edge], np.add.reduceat(columns, edge, axis=0), strict=True)]
        second = np.sort((pair & U64(0xFFFFFFFF)).astype(np.int64))
        rows += [(part, packed(second[p].astype(np.uint32)), None, 0, 0, 0, 0) for part, p in parts(model.pair_shard(second))]
        rows.append((None, None, None, *(int((times == k).sum()) for k in (1, 2, 3, 4))))
        a = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("part", "seconds", "hot", "c", "once", "twice", "more"), a, kinds, strict=True)})

    return packs.groupBy("shard").applyInArrow(run, "part int, seconds binary, hot bigint, c bigint, once bigint, twice bigint, more bigint")


def store_seconds(summary: DataFrame, model: Model) -> DataFrame:
    """Write after how many different words each word stands; returns per range how many of those numbers are 0 (not counted) to 4, more, and their sum."""

    def run(table: pa.Table) -> pa.Table:
        s = table.column("part")[0].as_py()
        low, high = model.range_of(s)
        after = np.zeros(high - low, np.int64)
        for x in table.column("seconds"):
            after += np.bincount(unpacked(x.as_py(), np.uint32).astype(np.int64) - low, minlength=high - low)
        write_array(f"{model.folder}/after/{s:06d}", after)
        return pa.table({"part": pa.array([s], pa.int32()), **{f"n{k}": [int((after == k).sum())] for k in (1, 2, 3, 4)}, "more": [int((after > 2).sum())], "total": [int(after.sum())]})

    return summary.where("seconds IS NOT NULL").select("part", "seconds").groupBy("part").applyInArrow(run, "part int, n1 bigint, n2 bigint, n3 bigint, n4 bigint, more bigint, total bigint")


def fit(train: DataFrame) -> Model:
    """The model of all rows of `train` (text), counted by Spark and written into the shared folder.

    Words are counted as rows; pairs are sent as packed arrays, shard by shard, and summed there. A word that
    begins so many pairs that its shard would be too large is dealt by the pair; there are few such words, since
    their uses add up to no more than all.
    """
    spark = train.sparkSession
    folder = f"{shared_folder(spark)}/llm-model-{uuid.uuid4().hex}"
    counts = stored(count_words(train), "words")
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    model = store_words(counts, folder, tokens)
    often = counts.where(F.col("n") * 4 * model.shards > tokens).select("word").toArrow().column("word").to_numpy().view(U64)
    # The beginning of a text, numbered after all words, is as frequent as the end.
    model.hot = np.sort(np.r_[model.numbers(np.sort(often))[0], model.vocabulary]).astype(np.int64)
    packs = count_pairs(train, model)
    summary = stored(store_pairs(packs, model), "pair-shards")
    sums = summary.where("hot IS NOT NULL").groupBy("hot").agg(*[F.sum(c).alias(c) for c in ("c", "once", "twice", "more")]).collect()
    model.hot_sums = np.zeros((len(model.hot), 4), np.int64)
    for row in sums:
        model.hot_sums[np.searchsorted(model.hot, row["hot"])] = [row["c"], row["once"], row["twice"], row["more"]]
    seen = summary.where("hot IS NULL AND part IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("c", "once", "twice", "more")]).first()
    model.discounts = discounts(np.array(seen))
    after = stored(store_seconds(summary, model), "after-shards").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "more", "total")]).first()
    below = discounts(np.array([after[f"n{k}"] for k in (1, 2, 3, 4)]))
    model.pairs = after["total"]
    spare = below[1] * after["n1"] + below[2] * after["n2"] + below[3] * after["more"]
    model.lower = np.r_[below, spare]
    # Shards nobody wrote, since nothing fell into them.
    fill_gaps(model, summary)
    return model


def fill_gaps(model: Model, summary: DataFrame) -> None:
    """Empty arrays for shards without pairs."""
    from pyspark.sql import SparkSession

    def gaps(shard: int) -> None:
        rows = model.range_of(shard)[1] - model.range_of(shard)[0] if shard < model.shards else 0
        for name, dtype, size in (("pairs", U64, 0), ("times", np.uint32, 0), ("contexts", np.int64, 4 * rows), ("after", np.int64, rows)):
            if not exists(f"{model.folder}/{name}/{shard:06d}"):
                write_array(f"{model.folder}/{name}/{shard:06d}", np.zeros(size, dtype))

    def run(batches):
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                gaps(shard)
            yield batch

    spark: SparkSession = summary.sparkSession
    spark.range(2 * model.shards).mapInArrow(run, "id bigint").count()


def exists(uri: str) -> bool:
    try:
        read_array(uri, np.uint8)
    except FileNotFoundError:
        return False
    return True


def token_scores(model: Model, number: np.ndarray, uses: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of every token's probability under the smoothed unigram base and under the model."""
    base = np.log10((uses + 1.0) / (model.tokens + model.vocabulary + 1.0))
    after = model.by_number("after", number, 1)[:, 0]
    if model.pairs:
        even = model.lower[4] / model.pairs / (model.vocabulary + 1.0)
        lower = np.maximum(after - model.lower[np.minimum(after, 3)], 0) / model.pairs + even
    else:
        lower = np.full(len(number), 1 / (model.vocabulary + 1.0))
    first = before_each(model, number, at)
    both = np.flatnonzero((first >= 0) & (number >= 0))
    pair = (first[both].astype(U64) << U64(32)) | number[both].astype(U64)
    distinct, back = np.unique(pair, return_inverse=True)
    times = np.zeros(len(number), np.int64)
    times[both] = model.pair_counts(distinct)[back]
    heads, back = np.unique(first, return_inverse=True)
    sums = model.contexts(heads)[back]
    total = sums[:, 0]
    spare = sums[:, 1:] @ model.discounts[1:]
    known = np.maximum(times - model.discounts[np.minimum(times, 3)], 0)
    chance = np.where(total > 0, (known + spare * lower) / np.maximum(total, 1), lower)
    return base, np.log10(chance)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """Score every whole text by a bigram model of the rows whose crc32(doc_id as text) modulo `folds` is not `held_out`.

    Tokens are the words (runs of anything but ASCII blanks, A-Z in lower case), then one end. The model
    interpolates discounted pair counts with discounted counts of the words a word follows, and those with an even share for
    each word and one for all unknown words. Returns one row per input row: doc_id, held_out, n_tokens, n_known
    (tokens of the training texts), train_tokens, base_score (smoothed unigrams), score, perplexity (of score). NULL and
    empty texts are one end. With no training text everything is unknown: one word is as likely as all. Repeated rows
    count and come out as often as they went in; empty tables give empty results; other columns are ignored.

    The model is a set of sorted arrays in the shared folder (`spark.checkpoint.dir`). Tasks map them, so memory does
    not grow with the model, and look up sorted batches. Scoring needs no exchange.
    """
    rows = taken(docs, doc_id=id_col, text=text_col).withColumn("held_out", crc_fold("doc_id", folds) == held_out)
    model = fit(rows.where(~F.col("held_out")).select("text"))

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                number, uses, at = token_numbers(model, piece.column("text"))
                base, score = token_scores(model, number, uses, at)
                n = np.diff(at)
                sums = [np.add.reduceat(x, at[:-1]) for x in (uses > 0, base, score)]
                yield pa.record_batch(
                    [piece.column("doc_id"), piece.column("held_out"), pa.array(n), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(n), model.tokens)), pa.array(sums[1]), pa.array(sums[2]), pa.array(10.0 ** (-sums[2] / n))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
