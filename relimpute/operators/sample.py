"""Sampling, splits and referentially closed subsets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relimpute.functions.hashing import draw, drawn
from relimpute.functions.ranking import hash_first_n
from relimpute.functions.text import canonical_text
from relimpute.operators import contract
from relimpute.session import cut_lineage
from relimpute.sources.catalog import Catalog


def known_cells(catalog: Catalog, table: str, attributes: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """(qid, attr, truth): n known cells per attribute by lowest draw; all of them when n <= 0."""
    df = catalog.table(table)
    wide = df.select(
        catalog.row_id(table).alias("qid"), *[canonical_text(F.col(a), df.schema[a].dataType).alias(a) for a in attributes]
    )
    cells = wide.unpivot(["qid"], list(attributes), "attr", "truth").where(F.col("truth").isNotNull())
    if n <= 0:
        return cells
    hashed = cells.withColumn("_draw", draw(F.col("qid"), F.col("attr"), seed))
    return hash_first_n(hashed, ["attr"], "_draw", F.lit(n)).select("qid", "attr", "truth")


def missing_cells(catalog: Catalog, table: str, attributes: Sequence[str]) -> DataFrame:
    """(qid, attr) of the null cells, opened row by row."""
    gaps = F.array_compact(F.array(*[F.when(F.col(a).isNull(), F.lit(a)) for a in attributes]))
    return catalog.table(table).select(catalog.row_id(table).alias("qid"), F.explode(gaps).alias("attr"))


def down_sample(df: DataFrame, key: Column, fraction: float, seed: int = 10) -> DataFrame:
    return df.where(drawn(draw(key, "row", seed), fraction))


def split_of(key: Column, shares: Sequence[tuple[str, float]], seed: int = 42) -> Column:
    """The split a key falls in, by cumulative share; the last split takes the rest."""
    hashed = draw(key, "split", seed)
    out, upto = F.lit(shares[-1][0]), sum(s for _, s in shares[:-1])
    for name, share in reversed(shares[:-1]):
        out = F.when(drawn(hashed, upto), name).otherwise(out)
        upto -= share
    return out


SAMPLE_SPLIT = (("train", 0.6), ("valid", 0.2), ("test", 0.2))
# a fifth for testing, a tenth of what remains for validation
ROW_SPLIT = (("train", 0.72), ("valid", 0.08), ("test", 0.2))


def fact_tables(catalog: Catalog) -> list[str]:
    """Tables that reference others and are referenced by none."""
    referenced = {dst for _, _, dst, _ in catalog.edges()}
    return [s.name for s in catalog.specs.values() if s.fks and s.name not in referenced]


def _ordered(catalog: Catalog) -> tuple[list[str], list[str]]:
    """Tables so that referencing ones come first, and the tables on or behind a cycle."""
    waiting = {name: set() for name in catalog.specs}
    for src, _, dst, _ in catalog.edges():
        if src != dst:
            waiting[dst].add(src)
    cyclic = {src for src, _, dst, _ in catalog.edges() if src == dst}
    order: list[str] = []
    while True:
        free = [t for t in waiting if t not in order and t not in cyclic and waiting[t] <= set(order)]
        if not free:
            return order, [t for t in waiting if t not in order]
        order += free


def _keys_once(catalog: Catalog, table: str, df: DataFrame) -> DataFrame:
    """The rows of a sample with several foreign keys, reduced to those and written once for them all."""
    columns = list(catalog.specs[table].fk_columns)
    return cut_lineage(df.select(*columns)) if len(columns) > 1 else df


def _wanted(catalog: Catalog, kept: dict[str, DataFrame], table: str, sources: Sequence[str]) -> DataFrame | None:
    """Distinct key values of `table` that kept rows refer to."""
    parts = None
    for src, column, dst, _ in catalog.edges():
        if dst == table and src in sources and src in kept:
            part = kept[src].where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("_k"))
            parts = part if parts is None else parts.unionByName(part)
    return None if parts is None else parts.distinct()


def _keep(catalog: Catalog, table: str, keys: DataFrame) -> DataFrame:
    return catalog.table(table).withColumn("_id", catalog.row_id(table)).join(
        keys.withColumnRenamed("_k", "_id"), "_id", "left_semi"
    ).drop("_id")


def fk_closure(catalog: Catalog, samples: dict[str, DataFrame], max_rounds: int = 50) -> dict[str, DataFrame]:
    """The samples plus every row they refer to, directly or through other rows.

    Tables are visited from referencing to referenced, so one lazy pass of semi-joins closes an
    acyclic key graph. On a cycle only the keys found last are followed, until none is new.
    """
    order, cyclic = _ordered(catalog)
    reduced = {t: _keys_once(catalog, t, df) for t, df in samples.items()}
    kept = dict(reduced)
    own = {t: df.select(catalog.row_id(t).alias("_k")) for t, df in samples.items()}
    for table in order:
        wanted = _wanted(catalog, kept, table, order)
        if wanted is None:
            continue
        if table in own:
            wanted = wanted.unionByName(own[table]).distinct()
        kept[table] = _keep(catalog, table, wanted)
    if cyclic:
        found: dict[str, DataFrame] = {}
        for table in cyclic:
            wanted = _wanted(catalog, kept, table, order)
            parts = [part for part in (wanted, own.get(table)) if part is not None]
            if parts:
                found[table] = cut_lineage((parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).distinct())
        kept |= {t: _keep(catalog, t, keys) for t, keys in _cyclic_keys(catalog, cyclic, found, max_rounds).items()}
    return {t: samples[t] if df is reduced.get(t) else df for t, df in kept.items()}


def _cyclic_keys(catalog: Catalog, cyclic: Sequence[str], found: dict[str, DataFrame], max_rounds: int) -> dict[str, DataFrame]:
    """All keys of the tables on a cycle that `found` leads to. Each round reads the rows of the newest keys and drops what is known."""
    newest = dict(found)
    for _ in range(max_rounds):
        rows = {t: _keep(catalog, t, keys) for t, keys in newest.items()}
        fresh: dict[str, DataFrame] = {}
        for table in cyclic:
            wanted = _wanted(catalog, rows, table, list(rows))
            if wanted is None:
                continue
            if table in found:
                wanted = wanted.join(found[table], "_k", "left_anti")
            wanted = cut_lineage(wanted)
            if not wanted.isEmpty():
                fresh[table] = wanted
        if not fresh:
            return found
        for table, keys in fresh.items():
            found[table] = cut_lineage(found[table].unionByName(keys)) if table in found else keys
        newest = fresh
    raise RuntimeError("key closure did not settle; raise max_rounds")


def fact_samples(catalog: Catalog, fraction: float = 0.2, seed: int = 10) -> dict[str, DataFrame]:
    """A share of every fact table."""
    return {t: down_sample(catalog.table(t), catalog.row_id(t), fraction, seed) for t in fact_tables(catalog)}


def one_hop_dimensions(catalog: Catalog, samples: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows the samples refer to directly, then tables reached only through an already kept table."""
    kept = {t: _keys_once(catalog, t, df) for t, df in samples.items()}
    facts = list(samples)
    first = {t: _wanted(catalog, kept, t, facts) for t in catalog.specs if t not in samples}
    for table, wanted in first.items():
        if wanted is not None:
            kept[table] = _keep(catalog, table, wanted)
    order = sum(_ordered(catalog), [])
    for table in [t for t in order if t in first and first[t] is None]:
        wanted = _wanted(catalog, kept, table, list(kept))
        if wanted is not None:
            kept[table] = _keep(catalog, table, wanted)
    return {**kept, **samples}


def kept_rows(catalog: Catalog, kept: dict[str, DataFrame]) -> DataFrame:
    """(table, row_id) of all kept rows."""
    parts = None
    for table, df in kept.items():
        part = df.select(F.lit(table).alias("table"), catalog.row_id(table).alias("row_id"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _node(table: str, row: str) -> Column:
    return F.concat(F.col(table), F.lit(":"), F.col(row))


def _keyed(catalog: Catalog, table: str) -> DataFrame:
    """(row_id, _k0, _k1, …): the rows that have a key, and their foreign keys as text."""
    keys = [F.col(c).cast("string").alias(f"_k{i}") for i, (c, _) in enumerate(_foreign(catalog, table))]
    return catalog.table(table).select(catalog.row_id(table).alias("row_id"), *keys).where(F.col("row_id").isNotNull())


def _foreign(catalog: Catalog, table: str) -> list[tuple[str, str]]:
    return [(column, parent) for name, column, parent, _ in catalog.edges() if name == table]


def _parents_first(catalog: Catalog) -> tuple[list[str], set[str]]:
    """The tables that keys name, each after those that its own keys name, and those of them that a chain of keys leads back to."""
    named = {t: [p for _, p in _foreign(catalog, t)] for t in sorted({parent for _, _, parent, _ in catalog.edges()})}
    above = {t: set(ps) for t, ps in named.items()}
    for _ in named:
        above = {t: ps.union(*(above[p] for p in ps)) for t, ps in above.items()}
    return sorted(named, key=lambda t: (t not in above[t], len(above[t]), t)), {t for t in named if t in above[t]}


def _met(rows: DataFrame, i: int, held: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` with what is `held` (row_id, …) of the row that their i-th key names."""
    return rows.join(held.withColumnRenamed("row_id", f"_k{i}"), f"_k{i}", how)


def _hung(catalog: Catalog, table: str, held: dict[str, DataFrame]) -> DataFrame:
    """(row_id, label, refs): every key once, under the label of a row that it names (`refs`: of all), or else its own."""
    rows = _keyed(catalog, table)
    for i, (_, parent) in enumerate(_foreign(catalog, table)):
        rows = _met(rows, i, held[parent].withColumnRenamed("label", f"_r{i}"), "left")
    refs = F.array_compact(F.array(*[f"_r{i}" for i in range(len(_foreign(catalog, table)))]))
    rows = rows.groupBy("row_id").agg(F.array_distinct(F.flatten(F.collect_set(refs))).alias("refs"))
    return rows.select("row_id", F.coalesce(F.array_min("refs"), F.concat(F.lit(f"{table}:"), "row_id")).alias("label"), "refs")


def _telling(catalog: Catalog, table: str, held: dict[str, DataFrame]) -> int:
    """How many of a table's keys, from the first on, tell for all its rows whether they name anything."""
    parents = [parent for _, parent in _foreign(catalog, table)]
    rows = _keyed(catalog, table)
    for i, parent in enumerate(parents[:-1]):
        rows = _met(rows, i, held[parent].select("row_id"), "left_anti")
        if rows.isEmpty():
            return i + 1
    return len(parents)


def _tied(catalog: Catalog, table: str, held: dict[str, DataFrame], first: int) -> Iterator[DataFrame]:
    """(a, b): labels that one row of a table ties, the one that it names by the `first` keys and each further one.

    Keys are brought to their labels after equal pairs are one, the row's own key is not looked at.
    """
    parents = [parent for _, parent in _foreign(catalog, table)]
    rows = _keyed(catalog, table)
    for i, parent in enumerate(parents[:first]):
        met = _met(rows, i, held[parent])
        for j in range(i + 1, len(parents)):
            pairs = met.select(F.col("label").alias("a"), f"_k{j}").distinct()
            yield _met(pairs, j, held[parents[j]]).select("a", F.col("label").alias("b"))
        # rows of which this key names nothing
        rows = _met(rows, i, held[parent].select("row_id"), "left_anti")


def _rooted(frame: DataFrame, groups: DataFrame) -> DataFrame:
    """(row_id, root): the group of every label; labels are few where many rows share one."""
    roots = frame.select("label").distinct().join(groups.select(F.col("node").alias("label"), "root"), "label", "left")
    return frame.join(roots, "label").select("row_id", F.coalesce("root", "label").alias("root"))


def reachable_rows(catalog: Catalog, start: DataFrame) -> DataFrame:
    """(table, row_id) of all rows connected to `start` through keys, followed both ways.

    A row hangs on a row that it names, that one on the next: tables are read parents first and every row is under the label
    of the last one, so that only labels are left to be tied by rows with several keys. They form connected groups by
    contraction. In tables that a chain of keys leads back to every row is its own label, so a chain of a million links takes some
    twenty rounds. Dangling foreign keys name no row. Rows of tables that no key names (the facts) enter no round; keys
    may repeat, and what all rows of one key name hangs together.
    """
    if not catalog.edges():
        return start.select("table", "row_id").distinct()
    order, loops = _parents_first(catalog)
    held: dict[str, DataFrame] = {}
    links: list[DataFrame] = []
    for table in order:
        if table in loops or not _foreign(catalog, table):
            own = F.concat(F.lit(f"{table}:"), "row_id").alias("label")
            held[table] = _keyed(catalog, table).select("row_id").distinct().select("row_id", own)
            continue
        hung = cut_lineage(_hung(catalog, table, held))
        held[table] = hung.select("row_id", "label")
        links.append(hung.where(F.size("refs") > 1).select(F.col("label").alias("a"), F.explode("refs").alias("b")))
    for table in sorted(loops):
        rows = _keyed(catalog, table)
        for i, (_, parent) in enumerate(_foreign(catalog, table)):
            links.append(_met(rows, i, held[parent]).select(F.concat(F.lit(f"{table}:"), "row_id").alias("a"), F.col("label").alias("b")))
    facts = [t for t in catalog.specs if _foreign(catalog, t) and t not in held]
    first = {t: _telling(catalog, t, held) for t in facts}
    for table in facts:
        links.extend(_tied(catalog, table, held, first[table]))
    groups = cut_lineage(contract.connected(_union(links))) if links else None
    rooted = {t: _rooted(frame, groups) if groups is not None else frame.withColumnRenamed("label", "root") for t, frame in held.items()}
    found = {t: frame.select("row_id", F.array("root").alias("roots")) for t, frame in rooted.items()}
    again = []
    for table in facts:
        rows, parts = _keyed(catalog, table), []
        for i, (_, parent) in enumerate(_foreign(catalog, table)[: first[table]]):
            parts.append(_met(rows, i, rooted[parent]).select("row_id", "root"))
            rows = _met(rows, i, rooted[parent].select("row_id"), "left_anti")
        found[table] = cut_lineage(_union(parts).groupBy("row_id").agg(F.sort_array(F.collect_set("root")).alias("roots")))
        again.append(found[table].where(F.size("roots") > 1).select(F.col("roots")[0].alias("a"), F.explode("roots").alias("b")))
    begun = cut_lineage(start.select(F.when(F.col("row_id").isNotNull(), F.col("table")).alias("table"), "row_id").distinct())
    hits = cut_lineage(_union([begun.where(F.col("table") == t).join(rows, "row_id").select("table", "row_id", "roots") for t, rows in found.items()]))
    begins = hits.select(F.explode("roots").alias("node"))
    # keys that repeat in the facts tie groups
    reached = cut_lineage(contract.reached(_union(again), begins) if again else begins.distinct())
    out = [
        rows.select(F.lit(t).alias("table"), "row_id", F.col("roots")[0].alias("node")).join(reached, "node", "left_semi").select("table", "row_id")
        for t, rows in found.items()
    ]
    # rows that are not there or name nothing
    alone = begun.join(hits.select(F.col("table").alias("_t"), F.col("row_id").alias("_r")), (F.col("table") == F.col("_t")) & (F.col("row_id") == F.col("_r")), "left_anti")
    return _union([*out, alone])


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)
