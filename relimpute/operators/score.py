"""Candidate weights: softmax, labels, loss and a fitted scorer."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relimpute.operators.instances import copies
from relimpute.session import cut_lineage

FEATURES = ["sim", "query_sim", "prior", "inverse_hops"]
TINY = 1e-10
#: What a neighbour's cosine weighs in its score: a tenth of nearness is worth as much as a whole share of a path.
NEARNESS = 10.0
#: Scores are raised in steps of this size; a cell has one or two.
STEP = 500.0


def softmax(candidates: DataFrame, score: str = "score", weight: str = "weight") -> DataFrame:
    """Weights over all candidates of a query cell, every path together; they sum to one.

    Largest score and sum of a cell come from one aggregate that combines map-side: scores are raised within steps of
    500, which neither overflow nor vanish, and the few steps of a cell are brought to its highest one. Candidates
    are written once, read for the sums, and joined with a row per cell on plain keys, so that a cell that
    holds a third of all candidates is split like any skewed join key. The weight of a bundle is that of one of its candidates.
    """
    rows = cut_lineage(candidates)
    step = F.floor(F.col(score) / STEP)
    steps = rows.where(F.col(score).isNotNull()).groupBy("qid", "attr", step.alias("_s")).agg(F.sum(copies(rows) * F.exp(F.col(score) - step * STEP)).alias("_e"))
    gathered = F.sort_array(F.collect_list(F.struct("_s", "_e"))).alias("_steps")
    top = steps.groupBy(F.col("qid").alias("_q"), F.col("attr").alias("_a")).agg(F.max("_s").alias("_top"), gathered)
    total = F.aggregate("_steps", F.lit(0.0), lambda t, s: t + s["_e"] * F.exp((s["_s"] - F.col("_top")) * STEP))
    top = top.select("_q", "_a", "_top", total.alias("_total"))
    joined = rows.join(top, (F.col("qid") == F.col("_q")) & (F.col("attr") == F.col("_a")))
    return joined.withColumn(weight, F.exp(F.col(score) - F.col("_top") * STEP) / F.col("_total")).select(*rows.columns, weight)


def label_candidates(candidates: DataFrame) -> DataFrame:
    """1 when some cell of the candidate row holds the truth."""
    return candidates.withColumn("label", F.col("hits").isNotNull().cast("int"))


def cell_loss(labelled: DataFrame) -> DataFrame:
    """(qid, attr, loss): -log of the weight on labelled candidates, cells without a label left out."""
    hit = F.sum(F.when(F.col("label") == 1, copies(labelled) * F.col("weight")))
    return labelled.groupBy("qid", "attr").agg(hit.alias("_w")).where(F.col("_w").isNotNull()).select(
        "qid", "attr", (-F.log(F.col("_w") + TINY)).alias("loss")
    )


def marginal_nll(labelled: DataFrame) -> DataFrame:
    """(cells, loss): mean loss over cells with a label, 0 without any."""
    return cell_loss(labelled).agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))


def split_loss(labelled: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, cells, loss) given the split of every cell (qid, attr, split)."""
    joined = cell_loss(labelled).join(splits, ["qid", "attr"])
    return joined.groupBy("split").agg(F.count(F.lit(1)).alias("cells"), F.avg("loss").alias("loss"))


def scorer_features(candidates: DataFrame, hops: dict[str, int], priors: DataFrame | None = None) -> DataFrame:
    """Adds the scorer's features; similarities are taken from the candidates when present."""
    known = candidates.withColumns(
        {c: F.lit(None).cast("double") for c in ("sim", "query_sim") if c not in candidates.columns}
    )
    lengths = F.create_map(*[x for p, n in hops.items() for x in (F.lit(p), F.lit(float(n)))])
    known = known.withColumn("inverse_hops", 1 / F.element_at(lengths, F.col("path_id")))
    if priors is None:
        return known.withColumn("prior", F.lit(0.0))
    # one row per (attribute, kept path)
    share = priors.groupBy("attr", "path_id").agg(F.sum("ratio").alias("prior"))
    joined = known.join(F.broadcast(share), ["attr", "path_id"], "left")
    return joined.withColumn("prior", F.coalesce("prior", F.lit(0.0)))


def fit_scorer(featured: DataFrame, max_iter: int = 20) -> PipelineModel:
    """Logistic regression of the label on the features; a missing similarity reads 0."""
    filled = featured.na.fill(0.0, FEATURES)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=1e-3)
    return Pipeline(stages=[assembler, model]).fit(filled.select(*FEATURES, "label"))


def apply_scorer(model: PipelineModel, featured: DataFrame) -> DataFrame:
    """Adds `score`, the margin of the fitted model."""
    scored = model.transform(featured.na.fill(0.0, FEATURES))
    margin = vector_to_array("rawPrediction")[1].alias("score")
    return scored.select(*featured.columns, margin)


def default_score(candidates: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Without a fitted scorer a candidate scores the share of its path, or 0; a neighbour its nearness (`near`) times ten more."""
    near = NEARNESS * F.coalesce("near", F.lit(0.0)) if "near" in candidates.columns else F.lit(0.0)
    if priors is None:
        return candidates.withColumn("score", near)
    share = priors.groupBy("attr", "path_id").agg(F.sum("ratio").alias("score"))
    joined = candidates.join(F.broadcast(share), ["attr", "path_id"], "left")
    return joined.withColumn("score", F.coalesce("score", F.lit(0.0)) + near)
