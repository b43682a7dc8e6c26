"""Path instances: rows reached from every query row along meta-paths.

Paths are walked as a prefix tree: a hop shared by several paths is joined once. Instances belong
to (query row, path), not to an attribute, so they are found once for all attributes. Columns
that a query row carries (its missing attributes, say) travel along, which saves the join back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relimpute.functions.hashing import bucket_of
from relimpute.functions.ranking import exact_quantiles, top_k
from relimpute.functions.text import canonical_text, is_value, plain_text, truth_or_null
from relimpute.operators.graph import Edge, MetaPath
from relimpute.session import cut_lineage
from relimpute.sources.catalog import Catalog

GUARD_FACTOR = 20
CHUNK = 1000
#: Candidates of one bundle that a task opens at a time.
OPENED = 1_000_000


def query_rows(catalog: Catalog, table: str, paths: Sequence[MetaPath], asked: dict[str, Column] | None = None) -> DataFrame:
    """`qid`, the columns the first hops join on, and what is asked of a row.

    `asked` maps attributes to a column that is NULL where the row does not ask for the attribute
    (see `known` and `missing`); it travels along as `_t_<attr>`.
    """
    columns = sorted({p.edges[0].src_col for p in paths})
    own = [F.col(c).alias(f"_n_{c}") for c in columns]
    wanted = [e.alias(f"_t_{a}") for a, e in (asked or {}).items()]
    return catalog.table(table).select(catalog.row_id(table).alias("qid"), *wanted, *own)


def known(catalog: Catalog, table: str, attributes: Sequence[str]) -> dict[str, Column]:
    """The text of every known cell."""
    df = catalog.table(table)
    return {a: canonical_text(F.col(a), df.schema[a].dataType) for a in attributes}


def missing(attributes: Sequence[str]) -> dict[str, Column]:
    """An empty text for every null cell."""
    return {a: F.when(F.col(a).isNull(), F.lit("")) for a in attributes}


def _column_type(catalog: Catalog, table: str, column: str) -> T.DataType:
    df = catalog.table(table)
    return df.schema[column].dataType if column in df.columns else T.StringType()


def _native(a: T.DataType, b: T.DataType) -> bool:
    return isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType) or a == b == T.StringType()


def _keys(catalog: Catalog, edge: Edge, left: Column) -> tuple[Column, Column]:
    """Join columns of a hop: native where the types allow it, else the canonical text.

    NULL keys match nothing.
    """
    a = _column_type(catalog, edge.src_table, edge.src_col)
    b = _column_type(catalog, edge.dst_table, edge.dst_col)
    right = F.col(edge.dst_col) if edge.dst_col in catalog.table(edge.dst_table).columns else catalog.row_id(edge.dst_table)
    return (left, right) if _native(a, b) else (canonical_text(left, a), canonical_text(right, b))


def payload_columns(catalog: Catalog, table: str, columns: Sequence[str] | None = None, keys: bool = False, form=canonical_text) -> dict[str, Column]:
    """column -> text of the cells of a row; keys on request, synthetic ids never."""
    df = catalog.table(table)
    own = [c for c in df.columns if keys or c not in catalog.key_columns(table)]
    own = [c for c in own if is_value(df.schema[c].dataType) and (columns is None or c in columns)]
    return {c: form(F.col(c), df.schema[c].dataType) for c in own}


def path_instances(
    catalog: Catalog,
    rows: DataFrame,
    paths: Sequence[MetaPath],
    dedup: str = "row",
    payload: Sequence[str] | bool | None = None,
    keys: bool = False,
    share: bool = True,
    attrs: dict[str, Sequence[str]] | None = None,
    match: bool = False,
) -> DataFrame:
    """(qid, path_id, instance_id, row_ids[, cells][, payload]) of all paths.

    `rows` comes from `query_rows`. Row ids are unique, so an instance can not repeat and the
    default needs no dedup exchange; `dedup='join_key'` keeps one instance per key value at
    every hop. `payload` adds the cells of the last row as they are written, read by the same join
    that found it.

    With `attrs` (path id -> attributes) a row that asks for none of them does not enter the path,
    and `cells` lists the asked ones it serves. With `match` every listed cell has `hits`, the
    payload columns that hold its truth, and the payload itself goes no further.
    """
    carried = [c for c in rows.columns if c.startswith("_t_")]
    found: list[DataFrame] = []

    def walk(df: DataFrame, depth: int, group: list[MetaPath]) -> None:
        for edge in dict.fromkeys(p.edges[depth] for p in group):
            own = [p for p in group if p.edges[depth] == edge]
            ends = [p for p in own if len(p.edges) == depth + 1]
            onward = [p for p in own if len(p.edges) > depth + 1]
            start = df
            if attrs is not None and depth == 0:
                start = _asking(df, {a for p in own for a in attrs[p.path_id]})
            cells = payload_columns(catalog, edge.dst_table, None if payload is True else payload, keys, canonical_text if match else plain_text) if payload and ends else {}
            step = _hop(catalog, start, edge, carried, sorted({p.edges[depth + 1].src_col for p in onward}), cells)
            if dedup == "join_key":
                step = _one_per_key(step)
            step = step.drop("_key")
            branches = len(dict.fromkeys(p.edges[depth + 1] for p in onward)) + bool(ends)
            if share and branches > 1:
                step = step.persist(StorageLevel.MEMORY_AND_DISK)
            for path in ends:
                found.append(_finish(step, path, list(cells), payload, attrs, match))
            if onward:
                walk(step.drop(*[f"_p_{c}" for c in cells]), depth + 1, onward)

    walk(rows.withColumn("_ids", F.array().cast("array<string>")), 0, list(paths))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _asking(df: DataFrame, attributes) -> DataFrame:
    """Rows that ask for one of the attributes."""
    wanted = [F.col(f"_t_{a}").isNotNull() for a in sorted(attributes)]
    condition = wanted[0]
    for c in wanted[1:]:
        condition = condition | c
    return df.where(condition)


def _hop(catalog: Catalog, df: DataFrame, edge: Edge, carried: list[str], onward: list[str], cells: dict[str, Column]) -> DataFrame:
    left, right = _keys(catalog, edge, F.col(f"_n_{edge.src_col}"))
    dst = catalog.table(edge.dst_table)
    fetched = [right.alias("_key"), catalog.row_id(edge.dst_table).alias("_rid")]
    fetched += [(F.col(c) if c in dst.columns else catalog.row_id(edge.dst_table)).alias(f"_m_{c}") for c in onward]
    fetched += [text.alias(f"_p_{c}") for c, text in cells.items()]
    joined = df.withColumn("_left", left).join(dst.select(*fetched), F.col("_left") == F.col("_key"))
    kept = ["qid", *carried, "_key", F.concat("_ids", F.array("_rid")).alias("_ids")]
    kept += [F.col(f"_m_{c}").alias(f"_n_{c}") for c in onward]
    return joined.select(*kept, *[f"_p_{c}" for c in cells])


def _one_per_key(step: DataFrame) -> DataFrame:
    """The row with the lowest (qid, row ids) per join-key value; combined map-side."""
    rest = [c for c in step.columns if c != "_key"]
    lowest = F.min_by(F.struct(*rest), F.struct("qid", "_ids"))
    return step.groupBy("_key").agg(lowest.alias("_row")).select("_key", "_row.*")


def _finish(step: DataFrame, path: MetaPath, cells: list[str], payload, attrs, match: bool) -> DataFrame:
    if attrs is not None:
        step = _asking(step, attrs[path.path_id])
    out = [
        "qid", F.lit(path.path_id).alias("path_id"), F.md5(F.concat_ws(">", "_ids")).alias("instance_id"), F.col("_ids").alias("row_ids"),
    ]
    if attrs is not None:
        out.append(F.array(*[_cell(a, cells if match else None) for a in sorted(attrs[path.path_id])]).alias("cells"))
    if payload and not match:
        entries = [x for c in cells for x in (F.lit(c), F.col(f"_p_{c}"))]
        held = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
        out.append(held.alias("payload"))
    return step.select(*out)


def _cell(attribute: str, payload: list[str] | None) -> Column:
    """(attr, truth[, hits]) of an asked cell, else NULL.

    Payload and truth are here canonical text, where numeric-aware equality is plain equality; the
    tokens for an unknown truth match nothing. `hits` has an entry per payload column, NULL where
    the column does not hold the truth, and is NULL when none does.
    """
    asked = F.col(f"_t_{attribute}")
    fields = [F.lit(attribute).alias("attr"), asked.alias("truth")]
    if payload:
        truth = truth_or_null(asked)
        # arrays, not a test per column: the code of a wide table must stay short enough to be compiled
        held = F.array(*[F.col(f"_p_{c}") for c in payload])
        met = F.zip_with(F.array(*[F.lit(c) for c in payload]), held, lambda c, v: F.when(v == truth, c))
        fields.append(F.when(F.array_contains(held, truth), met).alias("hits"))
    elif payload is not None:
        fields.append(F.lit(None).cast("array<string>").alias("hits"))
    return F.when(asked.isNotNull(), F.struct(*fields))


def instance_counts(catalog: Catalog, table: str, paths: Sequence[MetaPath]) -> DataFrame:
    """(path_id, label, instances, query_rows): exact instance counts without building instances.

    Counts are carried backwards from the goal: each hop joins per-key counts and sums them per
    key of the hop before, so no join multiplies rows.
    """
    size = catalog.table(table).agg(F.count(F.lit(1)).alias("query_rows"))
    parts = None
    for path in paths:
        below = None
        for i in reversed(range(len(path.edges))):
            edge = path.edges[i]
            _, key = _keys(catalog, edge, F.lit(None))
            dst = catalog.table(edge.dst_table)
            if below is None:
                weighed = dst.select(key.alias("_key"), F.lit(1).cast("bigint").alias("_w"))
            else:
                onward, _ = _keys(catalog, path.edges[i + 1], _own_column(catalog, path.edges[i + 1]))
                keyed = dst.select(key.alias("_key"), onward.alias("_on"))
                weighed = keyed.join(below, F.col("_on") == F.col("_k")).select("_key", F.col("_c").alias("_w"))
            below = weighed.groupBy(F.col("_key").alias("_k")).agg(F.sum("_w").alias("_c"))
        first, _ = _keys(catalog, path.edges[0], _own_column(catalog, path.edges[0]))
        start = catalog.table(table).groupBy(first.alias("_on")).agg(F.count(F.lit(1)).alias("_n"))
        total = start.join(below, F.col("_on") == F.col("_k")).agg(
            F.coalesce(F.sum(F.col("_n") * F.col("_c")), F.lit(0)).alias("instances")
        )
        part = total.select(F.lit(path.path_id).alias("path_id"), F.lit(path.label).alias("label"), "instances")
        parts = part if parts is None else parts.unionByName(part)
    return parts.withColumn("query_rows", size.scalar())


def _own_column(catalog: Catalog, edge: Edge) -> Column:
    return F.col(edge.src_col) if edge.src_col in catalog.table(edge.src_table).columns else catalog.row_id(edge.src_table)


def prefix_counts(catalog: Catalog, table: str, paths: Sequence[MetaPath]) -> DataFrame:
    """(label, hops, instances, query_rows): exact instance counts of every prefix of the paths, the paths included.

    Counts are carried forward over the prefix tree, once for all paths: per row of a table the number of instances that end there,
    added up per key of the next hops before they are joined. No join multiplies rows, and what is written per
    inner node is at most a row per combination of its onward keys. Counts are decimals, since
    those of a path that explodes may pass 64 bits; `instances` stops at the largest bigint.
    """
    count = F.sum("_c").cast("decimal(38,0)").alias("_c")
    parts: list[DataFrame] = []

    def walk(state: DataFrame, depth: int, group: list[MetaPath]) -> None:
        for edge in dict.fromkeys(p.edges[depth] for p in group):
            own = [p for p in group if p.edges[depth] == edge]
            onward = [p for p in own if len(p.edges) > depth + 1]
            left, right = _keys(catalog, edge, F.col(f"_n_{edge.src_col}"))
            arriving = state.groupBy(left.alias("_k")).agg(count)
            nexts = sorted({p.edges[depth + 1].src_col for p in onward})
            dst = catalog.table(edge.dst_table)
            cells = [(F.col(c) if c in dst.columns else catalog.row_id(edge.dst_table)).alias(f"_n_{c}") for c in nexts]
            reached = dst.select(right.alias("_key"), *cells).join(arriving, F.col("_key") == F.col("_k"))
            if onward:
                reached = cut_lineage(reached.groupBy(*[f"_n_{c}" for c in nexts]).agg(count))
            label = MetaPath(own[0].edges[: depth + 1]).label
            total = F.least(F.coalesce(F.sum("_c"), F.lit(0)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("bigint")
            parts.append(reached.agg(total.alias("instances")).select(F.lit(label).alias("label"), F.lit(depth + 1).alias("hops"), "instances"))
            if onward:
                walk(reached, depth + 1, onward)

    first = sorted({p.edges[0].src_col for p in paths})
    own = catalog.table(table)
    one = F.lit(1).cast("decimal(38,0)").alias("_c")
    start = own.select(*[(F.col(c) if c in own.columns else catalog.row_id(table)).alias(f"_n_{c}") for c in first], one)
    walk(start, 0, list(paths))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("query_rows", own.agg(F.count(F.lit(1)).alias("n")).scalar())


def guarded(counts: DataFrame, factor: int = GUARD_FACTOR) -> DataFrame:
    """Adds `kept`: a path (or prefix) is left out when it matches more than `factor` rows per query row."""
    return counts.withColumn("kept", F.col("instances") <= factor * F.col("query_rows"))


def guard_paths(catalog: Catalog, table: str, paths: Sequence[MetaPath], factor: int = GUARD_FACTOR) -> list[MetaPath]:
    """The paths of which every prefix passes the guard, so that none explodes half-way and narrows again.

    Paths to keys only can not fan out and are not counted.
    """
    open_ended = [p for p in paths if not p.single_valued]
    if not open_ended:
        return list(paths)
    counted = guarded(prefix_counts(catalog, table, open_ended), factor)
    # schema-sized: a row per prefix that explodes
    dropped = {r["label"] for r in counted.where(~F.col("kept")).collect()}
    return [p for p in paths if not any(MetaPath(p.edges[: i + 1]).label in dropped for i in range(len(p.edges)))]


def grouped_instances(instances: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(qid, path_id, chunk, instances): lists of row-id lists for callers that want nested form.

    A query row with very many instances is split into several lists of about `chunk`.
    """
    sizes = instances.groupBy("qid", "path_id").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_parts"))
    parted = instances.join(sizes, ["qid", "path_id"])
    parted = parted.withColumn("chunk", bucket_of(F.col("instance_id"), F.col("_parts")))
    return parted.groupBy("qid", "path_id", "chunk").agg(F.sort_array(F.collect_list("row_ids")).alias("instances"))


def instances_json(instances: DataFrame, paths: Sequence[MetaPath]) -> DataFrame:
    """(qid, path_id, instance_id, json): `[{"table": ..., "index": ...}, ...]` per instance."""
    tables = F.create_map(*[x for p in paths for x in (F.lit(p.path_id), F.array(*[F.lit(e.dst_table) for e in p.edges]))])
    names = F.element_at(tables, F.col("path_id"))
    nodes = F.zip_with(names, F.col("row_ids"), lambda t, r: F.struct(t.alias("table"), r.alias("index")))
    return instances.select("qid", "path_id", "instance_id", F.to_json(nodes).alias("json"))


def top_instances(instances: DataFrame, paths: Sequence[MetaPath], k: int = 5, sim: str | None = None) -> DataFrame:
    """The `k` most similar instances per query row and path.

    Paths that yield one instance at most pass without an exchange.
    """
    single = [p.path_id for p in paths if p.single_valued]
    many = [p.path_id for p in paths if not p.single_valued]
    if not many:
        return instances
    order = ([F.desc_nulls_last(sim)] if sim else []) + [F.col("instance_id")]
    cut = top_k(instances.where(F.col("path_id").isin(*many)), ["qid", "path_id"], order, k, "_r").drop("_r")
    return cut.unionByName(instances.where(F.col("path_id").isin(*single))) if single else cut


def attribute_paths(spark, by_attribute: dict[str, Sequence[MetaPath]]) -> DataFrame:
    """(attr, path_id), at most ten rows per attribute of the query table."""
    pairs = [(a, p.path_id) for a, paths in by_attribute.items() for p in paths]
    return spark.createDataFrame(pairs, "attr string, path_id string")


def assemble(instances: DataFrame, attr_paths: DataFrame) -> DataFrame:
    """One row per (query cell, instance): the `cells` of an instance met with the paths of their attribute."""
    opened = instances.withColumn("_cell", F.explode("cells")).where(F.col("_cell").isNotNull())
    rest = [c for c in instances.columns if c != "cells"]
    # schema-sized: at most ten paths per attribute
    return opened.select(*rest, "_cell.*").join(F.broadcast(attr_paths), ["attr", "path_id"])


def candidate_cells(candidates: DataFrame) -> DataFrame:
    """The payload of every candidate in long form (…, col, value), nulls left out."""
    rest = [c for c in candidates.columns if c != "payload"]
    return candidates.select(*rest, F.explode("payload").alias("col", "value")).where(F.col("value").isNotNull())


@dataclass
class Shared:
    """Instances found once for all query rows that ask for the same through the same key.

    `members` (qid, ask) has a row per query row and first key; `found` are path instances with the ask as `qid`.
    """

    members: DataFrame
    found: DataFrame


def shared_instances(catalog: Catalog, rows: DataFrame, paths: Sequence[MetaPath], attrs: dict[str, Sequence[str]] | None = None, **options) -> Shared:
    """`path_instances` of the different asks among `rows`: what stands in the first key and in the cells asked for.

    Query rows that meet in a hub share all that lies behind it, so the work grows with the asks and their instances,
    not with query rows times instances.
    """
    members = found = None
    for column in dict.fromkeys(p.edges[0].src_col for p in paths):
        own = [p for p in paths if p.edges[0].src_col == column]
        asked = sorted({a for p in own for a in attrs[p.path_id]}) if attrs is not None else []
        key = [f"_n_{column}", *[f"_t_{a}" for a in asked]]
        # texts of key values are as different as the values; a null is a missing field
        text = F.to_json(F.struct(F.lit(column).alias("_via"), *[F.col(c).cast("string").alias(c) for c in key]))
        asking = (_asking(rows, asked) if asked else rows).where(F.col(key[0]).isNotNull()).select("qid", *key, F.md5(text).alias("ask"))
        asks = asking.select(F.col("ask").alias("qid"), *key).distinct()
        part = path_instances(catalog, asks, own, attrs=attrs, **options)
        found = part if found is None else found.unionByName(part)
        members = asking.select("qid", "ask") if members is None else members.union(asking.select("qid", "ask"))
    return Shared(members, found)


@dataclass
class Bundles:
    """Candidates counted: those of a cell that lie on one path and hold the truth in the same columns are one row.

    `cells` (qid, attr, path_id, truth[, hits], nodes, copies, bundle) stand for `copies` candidates each; `held`
    (bundle, instance_id) names them.
    """

    cells: DataFrame
    held: DataFrame


def bundled(shared: Shared, attr_paths: DataFrame) -> Bundles:
    """The assembled candidates of shared instances, as bundles."""
    found = assemble(shared.found, attr_paths).withColumnRenamed("qid", "ask")
    form = [c for c in ("hits",) if c in found.columns]
    own = ["ask", "attr", "path_id", "truth", *form]
    nodes = (F.size("row_ids") + 1).cast("bigint").alias("nodes")
    found = found.select(*own, nodes, "instance_id", F.md5(F.to_json(F.struct("ask", "attr", "path_id", *form))).alias("bundle"))
    counted = found.groupBy(*own, "nodes", "bundle").agg(F.count(F.lit(1)).alias("copies"))
    return Bundles(shared.members.join(counted, "ask").drop("ask"), found.select("bundle", "instance_id"))


def opened(cells: DataFrame, held: DataFrame) -> DataFrame:
    """A row per candidate: `cells` (qid, bundle, copies, …) with the columns of `held` (bundle, …).

    A bundle that many cells share is opened in parts of about a million candidates; its cells are dealt to the parts, and what it holds is sent to each.
    """
    sizes = cells.groupBy("bundle").agg(F.count(F.lit(1)).alias("_m"), F.max("copies").alias("_c"))
    sizes = sizes.select("bundle", F.least("_m", F.ceil(F.col("_m") * F.col("_c") / OPENED)).cast("int").alias("_parts"))
    dealt = cells.join(sizes, "bundle").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("qid"), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    sent = held.join(sizes, "bundle").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(sent, ["bundle", "_part"]).drop("bundle", "_part", "copies")


def of_members(shared: Shared, found: DataFrame) -> DataFrame:
    """What holds of the shared instances (`found`, with the ask as `qid`), for every query row."""
    held = found.withColumnRenamed("qid", "bundle")
    counted = held.groupBy("bundle").agg(F.count(F.lit(1)).alias("copies"))
    return opened(shared.members.withColumnRenamed("ask", "bundle").join(counted, "bundle"), held)


def tallied(candidates: DataFrame) -> DataFrame:
    """(qid, attr, path_id, hits, copies): candidates of known cells as bundles that name nothing.

    Those of a cell that lie on one path and hold the truth in the same columns are counted where they are found; what
    leaves a task is a row per kind, without ids or digests of what was counted.
    """
    return candidates.groupBy("qid", "attr", "path_id", "hits").agg(F.sum(copies(candidates)).alias("copies"))


def copies(candidates: DataFrame) -> Column:
    """How many candidates a row stands for: a bundle says so, any other row is one."""
    return F.coalesce("copies", F.lit(1)) if "copies" in candidates.columns else F.lit(1)


def merge_paths(candidates: DataFrame) -> DataFrame:
    """(qid, attr, paths, instances): what all paths together yield for a query cell."""
    per_path = candidates.groupBy("qid", "attr", "path_id").agg(F.sum(copies(candidates)).alias("n"))
    return per_path.groupBy("qid", "attr").agg(F.count(F.lit(1)).alias("paths"), F.sum("n").alias("instances"))


def path_complexity(candidates: DataFrame) -> DataFrame:
    """(measure, p, quantile) of paths per cell, instances per path, nodes per instance (query row included)."""
    per_path = candidates.groupBy("qid", "attr", "path_id").agg(F.sum(copies(candidates)).alias("v"))
    per_cell = per_path.groupBy("qid", "attr").agg(F.count(F.lit(1)).alias("v"))
    length = F.col("nodes") if "nodes" in candidates.columns else (F.size("row_ids") + 1).cast("bigint")
    nodes = candidates.select(length.alias("v"), copies(candidates).cast("bigint").alias("n"))
    one = F.lit(1).cast("bigint").alias("n")
    measures = (
        per_cell.select(F.lit("paths").alias("measure"), "v", one)
        .unionByName(per_path.select(F.lit("instances").alias("measure"), "v", one))
        .unionByName(nodes.select(F.lit("nodes").alias("measure"), "v", "n"))
    )
    return exact_quantiles(measures, ["measure"], "v", [0.25, 0.5, 0.75, 0.9], times="n").select("measure", "p", "quantile")
