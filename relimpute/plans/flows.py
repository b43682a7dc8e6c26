"""End-to-end flows: dirty table, discovered paths, induced summary, imputed table, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relimpute.operators import denorm, discover, embed, fallback, graph, induce, inject, instances, metrics, profile, sample, score, vectors, vote
from relimpute.operators.graph import MetaPath
from relimpute.session import cut_lineage
from relimpute.sources import io
from relimpute.sources.catalog import Catalog


@dataclass
class Redundant:
    """A database with copied attributes and a dirty query table."""

    clean: Catalog
    dirty: Catalog
    table: str
    attributes: list[str]


def make_dirty(
    catalog: Catalog, table: str, fraction: float = 0.2, seed: int = 42, min_refs: int = 5, min_ndv: int = 5, min_fill: float = 0.8,
    also: Sequence[str] = (),
) -> Redundant:
    """Denormalise the query table (and the tables in `also`), then null a fraction of its descriptors."""
    hubs = denorm.choose_hubs(catalog, min_refs, min_ndv, min_fill)
    clean = catalog.with_tables(**{t: denorm.denormalize(catalog, t, hubs) for t in (table, *also)})
    attributes = clean.descriptors(table)
    masked = inject.inject_missing(clean.table(table), clean.row_id(table), attributes, fraction, seed)
    return Redundant(clean, clean.with_tables(**{table: masked}), table, attributes)


@dataclass
class Discovery:
    """Where the values of an attribute may be found: along key paths, or else among the rows of related tables."""

    paths: dict[str, list[MetaPath]]
    related: dict[str, list[str]]


def discover_sources(
    dirty: Catalog, table: str, tables: Sequence[str], attributes: Sequence[str], threshold: float = 0.9, limit: int = 10,
    use_lsh: bool = False, guard: bool = False,
) -> Discovery:
    """Meta-paths per attribute, and related tables for the attributes that have none.

    With `guard`, paths that would match far more rows than the query table has are left out; an attribute that
    loses all its paths this way turns to related tables too.
    """
    index = discover.lsh_index(dirty, tables) if use_lsh else discover.containment_index(dirty, tables)
    # column pairs above the threshold, written once: they steer everything after them
    compatible = cut_lineage(discover.compatible_columns(index, threshold))
    edges = [e for e in dirty.edges() if e[0] in tables and e[2] in tables]
    found = graph.enumerate_paths(dirty.spark.createDataFrame(edges, dirty.fk_edges().schema), table)
    chosen = cut_lineage(graph.paths_by_attribute(compatible, found, table, list(attributes), limit))
    # schema-sized: at most `limit` paths per attribute
    rows = chosen.orderBy("attr", "hops", "label").collect()
    by_label = {p.label: p for p in graph.collect_paths(chosen)}
    kept = set(by_label)
    if guard:
        kept = {p.label for p in instances.guard_paths(dirty, table, list(by_label.values()))}
    paths: dict[str, list[MetaPath]] = {}
    for r in rows:
        if r["label"] in kept:
            paths.setdefault(r["attr"], []).append(by_label[r["label"]])
    related: dict[str, list[str]] = {}
    left = [a for a in attributes if a not in paths]
    if left:
        served_ = dirty.spark.createDataFrame([(a,) for a in paths], "attr string")
        # schema-sized: at most `limit` tables per attribute
        for r in graph.fallback_tables(compatible, served_, table, left, limit).orderBy("attr", "rank").collect():
            related.setdefault(r["attr"], []).append(r["related"])
    return Discovery(paths, related)


def discover_paths(
    dirty: Catalog, table: str, tables: Sequence[str], attributes: Sequence[str], threshold: float = 0.9, limit: int = 10,
    use_lsh: bool = False, guard: bool = False,
) -> dict[str, list[MetaPath]]:
    """Only the meta-paths of `discover_sources`."""
    return discover_sources(dirty, table, tables, attributes, threshold, limit, use_lsh, guard).paths


def all_paths(by_attribute: dict[str, Sequence[MetaPath]]) -> list[MetaPath]:
    return list(dict.fromkeys(p for paths in by_attribute.values() for p in paths))


def served(by_attribute: dict[str, Sequence[MetaPath]]) -> dict[str, list[str]]:
    """path id -> attributes it serves."""
    out: dict[str, list[str]] = {}
    for attr, paths in by_attribute.items():
        for p in paths:
            out.setdefault(p.path_id, []).append(attr)
    return out


def asked_vectors(dirty: Catalog, table: str, attributes: Sequence[str], known: bool, embeddings: DataFrame) -> DataFrame:
    """(qid, attr, embedding) of the asked cells, in as many dimensions as the stored embeddings have."""
    # one row
    first = embeddings.select(F.size("embedding").alias("n")).first()
    asked = instances.known(dirty, table, attributes) if known else instances.missing(attributes)
    return embed.query_vectors(dirty, table, asked, first["n"] if first else embed.DIMENSION).select("qid", "attr", "embedding")


def known_rows(dirty: Catalog, table: str, by_attribute: dict[str, Sequence[MetaPath]], n: int = 0) -> DataFrame:
    """Query rows that ask for their known cells: n sampled cells per attribute, or all."""
    attributes = list(by_attribute)
    rows = instances.query_rows(dirty, table, all_paths(by_attribute), instances.known(dirty, table, attributes))
    if n <= 0:
        return rows
    # at most one cell per attribute and row, n rows per attribute
    picked = sample.known_cells(dirty, table, attributes, n)
    truths = [F.max(F.when(F.col("attr") == a, F.col("truth"))).alias(f"_t_{a}") for a in attributes]
    return rows.drop(*[f"_t_{a}" for a in attributes]).join(picked.groupBy("qid").agg(*truths), "qid")


def known_bundles(dirty: Catalog, table: str, by_attribute: dict[str, Sequence[MetaPath]], n: int = 0, keys: bool = False) -> instances.Bundles:
    """`known_candidates` counted: their number is that of query rows times the rows behind a hub, that of bundles is not."""
    rows = known_rows(dirty, table, by_attribute, n)
    shared = instances.shared_instances(dirty, rows, all_paths(by_attribute), served(by_attribute), payload=True, keys=keys, match=True)
    return instances.bundled(shared, instances.attribute_paths(dirty.spark, by_attribute))


def through_hub(dirty: Catalog, table: str, paths: Sequence[MetaPath]) -> bool:
    """Whether some path fans out behind a key that many query rows share."""
    return any(not p.single_valued and p.edges[0].src_col in dirty.specs[table].fk_columns for p in paths)


def known_candidates(
    dirty: Catalog, table: str, by_attribute: dict[str, Sequence[MetaPath]], n: int = 0, k: int | None = None, keys: bool = False,
    embeddings: DataFrame | None = None, queries: DataFrame | None = None,
) -> DataFrame:
    """Candidates of known cells with `hits`, the columns that hold the truth: n sampled cells per attribute, or all.

    Truth and candidate are compared where they meet, so candidate rows are not exchanged.
    """
    rows = known_rows(dirty, table, by_attribute, n)
    return with_similarity(dirty, table, by_attribute, rows, True, k, embeddings, queries, payload=True, keys=keys, match=True)


def with_similarity(
    dirty: Catalog, table: str, by_attribute: dict[str, Sequence[MetaPath]], rows: DataFrame, known: bool, k: int | None, embeddings: DataFrame | None,
    queries: DataFrame | None, named: bool = True, **options,
) -> DataFrame:
    """Candidates of query rows, with their similarities if there are embeddings.

    Then instances behind a hub are found and compared with each other once for all rows that ask for the same, and with the rows
    in blocks: candidates are never written.
    """
    if embeddings is None:
        found = instances.path_instances(dirty, rows, all_paths(by_attribute), attrs=served(by_attribute), **options)
        return instances.assemble(found, instances.attribute_paths(dirty.spark, by_attribute))
    queries = asked_vectors(dirty, table, list(by_attribute), known, embeddings) if queries is None else queries
    parts = []
    for hub in (False, True):
        own = {a: [p for p in paths if through_hub(dirty, table, [p]) == hub] for a, paths in by_attribute.items()}
        own = {a: paths for a, paths in own.items() if paths}
        if not own:
            continue
        paths, goals = all_paths(own), {p.path_id: p.goal for p in all_paths(own)}
        shared = instances.shared_instances(dirty, rows, paths, served(own), **options) if hub else None
        found = shared.found if hub else instances.path_instances(dirty, rows, paths, attrs=served(own), **options)
        cells = instances.assemble(most_similar(own, found, k, embeddings), instances.attribute_paths(dirty.spark, own))
        if hub:
            parts.append(vectors.shared_similarity(shared.members, cells.withColumnRenamed("qid", "ask"), goals, queries, embeddings, named))
        else:
            compared = vectors.asked_similarity(cells, goals, queries, embeddings)
            parts.append(compared if named else compared.drop("row_ids", "instance_id"))
    return together(parts)


def most_similar(by_attribute: dict[str, Sequence[MetaPath]], found: DataFrame, k: int | None, embeddings: DataFrame | None) -> DataFrame:
    """All instances, with their path similarities if there are embeddings.

    With `k`, of those that have a similarity only the k most similar per query row and path, ties
    included; where none is known nothing is left out.
    """
    if embeddings is None:
        return found
    similar = vectors.path_similarity(cut_lineage(found), all_paths(by_attribute), embeddings)
    if k is None:
        return similar
    place = F.rank().over(W.partitionBy("qid", "path_id").orderBy(F.desc_nulls_last("sim")))
    return similar.withColumn("_place", place).where(F.col("sim").isNull() | (F.col("_place") <= k)).drop("_place")


def missing_candidates(
    dirty: Catalog, table: str, by_attribute: dict[str, Sequence[MetaPath]], k: int | None = None, payload: Sequence[str] | bool = True,
    embeddings: DataFrame | None = None, queries: DataFrame | None = None, named: bool = True,
) -> DataFrame:
    """Candidates of the null cells; without `named` those that have similarities name no rows."""
    rows = instances.query_rows(dirty, table, all_paths(by_attribute), instances.missing(list(by_attribute)))
    return with_similarity(dirty, table, by_attribute, rows, False, k, embeddings, queries, named, payload=payload).drop("truth")


def together(parts: Sequence[DataFrame | None]) -> DataFrame | None:
    """Candidates along paths and from related tables as one table."""
    out = None
    for part in parts:
        if part is not None:
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def induced_summary(
    dirty: Catalog, table: str, by_attribute: dict[str, Sequence[MetaPath]], n: int = 0, k: int = 5, related: dict[str, Sequence[str]] | None = None,
    related_n: int = 0, approximate: bool = False,
) -> DataFrame:
    """Which (path, column) reproduce known cells (all, or n sampled per attribute), fixed as a small table.

    Related tables stand in for a path under their own name; they are tried on all known cells too, or on `related_n` sampled ones per attribute.
    """
    along = None
    if by_attribute:
        hub = through_hub(dirty, table, all_paths(by_attribute))
        # the summary asks how many candidates hold the truth where, not which
        along = instances.tallied(known_bundles(dirty, table, by_attribute, n).cells if hub else known_candidates(dirty, table, by_attribute, n))
    beside = fallback.candidates(dirty, table, related, True, related_n, approximate=approximate) if related else None
    found = together([along, beside])
    if found is None:
        return dirty.spark.createDataFrame([], induce.PATH_SUMMARY)
    weighted = score.softmax(score.default_score(found))
    return induce.settle(induce.path_summary(induce.matching_columns(weighted), k))


def scored(
    candidates: DataFrame, by_attribute: dict[str, Sequence[MetaPath]], summary: DataFrame | None, scorer: PipelineModel | None,
    related: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Candidates with the score of the fitted scorer, or else the prior of their path.

    To the scorer a neighbour is a path of one hop whose query similarity is its nearness.
    """
    if scorer is None:
        return score.default_score(candidates, summary)
    hops = {p.path_id: len(p.edges) for p in all_paths(by_attribute)} | {t: 1 for t in fallback.tables_of(related or {})}
    if "near" in candidates.columns:
        known = F.col("query_sim") if "query_sim" in candidates.columns else F.lit(None).cast("double")
        candidates = candidates.withColumn("query_sim", F.coalesce("near", known))
    return score.apply_scorer(scorer, score.scorer_features(candidates, hops, summary))


def train_scorer(
    dirty: Catalog, table: str, by_attribute: dict[str, Sequence[MetaPath]], summary: DataFrame | None = None, n: int = 800,
    embeddings: DataFrame | None = None,
) -> PipelineModel:
    """Fit the scorer on labelled candidates of the training share of sampled known cells."""
    candidates = score.label_candidates(known_candidates(dirty, table, by_attribute, n, embeddings=embeddings))
    share = sample.split_of(F.concat("qid", "attr"), sample.SAMPLE_SPLIT)
    hops = {p.path_id: len(p.edges) for p in all_paths(by_attribute)}
    return score.fit_scorer(cut_lineage(score.scorer_features(candidates.where(share == "train"), hops, summary)))


def impute(
    dirty: Catalog, table: str, by_attribute: dict[str, Sequence[MetaPath]], summary: DataFrame, embeddings: DataFrame | None = None,
    scorer: PipelineModel | None = None, related: dict[str, Sequence[str]] | None = None, approximate: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(imputed table, votes): weigh the candidates of every null cell, vote, write back.

    Every candidate counts; equal values of a cell are added up before they are exchanged. Attributes without a path
    are filled from `related`, the tables that `discover_sources` names for them: the nearest rows are weighed
    and voted on together with the candidates along paths.
    """
    # schema-sized: a handful of (path, column) pairs per attribute
    chosen = summary.select("attr", "path_id", "col").collect()
    kept = {(r["attr"], r["path_id"]) for r in chosen}
    used = {a: [p for p in paths if (a, p.path_id) in kept] for a, paths in by_attribute.items()}
    used = {a: paths for a, paths in used.items() if paths}
    beside = {a: [t for t in tables if (a, t) in kept] for a, tables in (related or {}).items()}
    beside = {a: tables for a, tables in beside.items() if tables}
    if not used and not beside:
        empty = dirty.spark.createDataFrame([], "qid string, attr string, value string, text string, w double, r double")
        return dirty.table(table), empty
    columns = sorted({r["col"] for r in chosen})
    along = missing_candidates(dirty, table, used, payload=columns, embeddings=embeddings, named=False) if used else None
    near = fallback.candidates(dirty, table, beside, payload=columns, approximate=approximate) if beside else None
    voted = vote.counted_votes(scored(together([along, near]), used, summary, scorer, beside), summary)
    return vote.write_back(dirty, table, vote.answers(voted), list(dict.fromkeys([*used, *beside]))), voted


def evaluate(data: Redundant, runs: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """The report of long runs over the evaluable cells."""
    classes = metrics.attribute_classes(data.clean.table(data.table), attributes)
    numeric = [a for a in attributes if classes[a] == "num"]
    cells = metrics.eval_cells(data.dirty, data.clean, data.table, attributes)
    stats = metrics.numeric_stats(data.clean, data.table, numeric)
    return metrics.eval_report(metrics.judged(cells, runs, classes, stats))


def report_tables(data: Redundant, runs: dict[str, DataFrame], attributes: Sequence[str]) -> DataFrame:
    """The report of imputed tables, by method."""
    classes = metrics.attribute_classes(data.clean.table(data.table), attributes)
    stats = metrics.numeric_stats(data.clean, data.table, [a for a in attributes if classes[a] == "num"])
    return metrics.eval_report(metrics.judged_tables(data.dirty, data.clean, data.table, attributes, runs, classes, stats))


def report(data: Redundant, imputed: DataFrame, method: str, attributes: Sequence[str]) -> DataFrame:
    """The report of one imputed table."""
    return report_tables(data, {method: imputed}, attributes)


def report_runs(
    data: Redundant, pattern: str, attributes: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = (), coverage: DataFrame | None = None,
) -> DataFrame:
    """The full report of a folder of run files `..._<method>_<train time>_<test time>.csv`, methods picked or left out.

    Runs may differ in columns and in the form of their keys. With the `coverage` of an induction the report says
    how much of every attribute could be found at all.
    """
    spark, spec = data.clean.spark, data.clean.specs[data.table]
    found = [f for f in io.run_files(spark, pattern) if (not include or f[1] in include) and f[1] not in exclude]
    if not found:
        raise ValueError(f"no runs at {pattern}")
    runs = {method: io.read_run(spark, path, spec) for path, method, _, _ in found}
    if len(runs) < len(found):
        raise ValueError("two runs of one method; pick them by the pattern")
    clean = data.clean.table(data.table)
    classes = metrics.attribute_classes(clean, attributes)
    stats = metrics.numeric_stats(data.clean, data.table, [a for a in attributes if classes[a] == "num"])
    distinct = profile.value_counts(clean, list(attributes)).groupBy(F.col("col").alias("attr")).agg(F.count("value").alias("ndv"))
    times = spark.createDataFrame([f[1:] for f in found], "method string, train_time double, test_time double")
    judged = metrics.judged_tables(data.dirty, data.clean, data.table, attributes, runs, classes, stats)
    return metrics.full_report(judged, stats, distinct, times, coverage)
