"""Models on MLlib: regressors, importances, principal components, a registry."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from . import checkpoints

#: Regressors by key. The Huber loss has the published width.
REGRESSORS = {
    "linear": lambda: LinearRegression(maxIter=50),
    "huber": lambda: LinearRegression(loss="huber", epsilon=3.5, maxIter=50),
    "forest": lambda: RandomForestRegressor(numTrees=20, maxDepth=5, seed=42),
    "boosted": lambda: GBTRegressor(maxIter=10, maxDepth=3, seed=42),
}


#: Trees are grown on distinct vectors of features, not on rows, where there are at most so many and ten rows for each.
VECTORS = 100_000
#: Rows that deal their values among themselves when a feature is permuted, and blocks of them that one task holds.
BLOCK, BLOCKS = 16_384, 16


def few_vectors(df: DataFrame, features: Sequence[str]) -> bool:
    """Whether the rows have few distinct vectors of features, all numbers, so that summing up the rows of each spares most of the work."""
    if not all(isinstance(df.schema[f].dataType, NumericType) for f in features):
        return False
    n, distinct = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*features))).first()
    return distinct <= VECTORS and 0 < 10 * distinct <= n


def _vectors(rows: DataFrame, features: Sequence[str], target: str, weights: Sequence[Column]) -> DataFrame:
    """Each distinct vector once: for each weight the sum over its rows (_w0, ...) and their weighted mean of the target (_y0, ...); stored.

    A tree of least squares needs no more: how far targets vary within a vector is the same for every split. Where all of a vector's rows
    weigh nothing, as a bootstrap sample may have none of them, its target is their plain mean.
    """
    y = F.col(target)
    sums = [c for i, w in enumerate(weights) for c in (F.sum(w).alias(f"_w{i}"), F.coalesce(F.try_divide(F.sum(w * y), F.sum(w)), F.avg(y)).alias(f"_y{i}"))]
    return checkpoints.stored(rows.groupBy(*features).agg(*sums), "vectors")


def _poisson(u: Column) -> Column:
    """The Poisson number of mean one that a uniform number stands for: how often a bootstrap sample has a row."""
    shares = [math.exp(-1) / math.factorial(k) for k in range(17)]
    drawn = F.when(u < shares[0], 0.0)
    for k in range(1, 17):
        drawn = drawn.when(u < sum(shares[: k + 1]), float(k))
    return drawn.otherwise(17.0)


def _grown(df: DataFrame, features: Sequence[str], target: str, kind: str, seed: int | None = None) -> list:
    """The fitted models of a kind on the column ``features``, one for most; their mean predicts.

    Forests and boosted trees see each of few distinct vectors once, with a weight. A forest's tree has its own bootstrap sample of all
    rows: each row's draws for all trees are summed by vector in one pass, then the trees grow one by one.
    """
    model = REGRESSORS[kind]()
    model = model.setSeed(seed) if seed is not None else model
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    if kind not in ("forest", "boosted") or not few_vectors(df, features):
        return [model.setLabelCol(target).fit(assembler.transform(df))]
    # A target that is null or not a number spoils its vector's mean, so that the fit fails as it would on the rows.
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.coalesce(F.col(target).cast("double"), F.lit(math.nan)).alias("_y")).na.drop(subset=list(features))
    if kind == "boosted":
        return [model.setLabelCol("_y0").setWeightCol("_w0").fit(assembler.transform(_vectors(rows, features, "_y", [F.lit(1.0)])))]
    trees, first = model.getNumTrees(), model.getSeed()
    drawn = rows.select("*", *[F.rand(first * 1_000 + t).alias(f"_u{t}") for t in range(trees)])
    vectors = assembler.transform(_vectors(drawn, features, "_y", [_poisson(F.col(f"_u{t}")) for t in range(trees)]))
    one = model.setNumTrees(1).setBootstrap(False).setFeatureSubsetStrategy("onethird")
    return [one.setSeed(first + t).setLabelCol(f"_y{t}").setWeightCol(f"_w{t}").fit(vectors.where(F.col(f"_w{t}") > 0)) for t in range(trees)]


def fit(df: DataFrame, features: Sequence[str], target: str, kind: str = "linear", prediction: str = "prediction") -> PipelineModel:
    models = _grown(df, features, target, kind)
    names = [prediction] if len(models) == 1 else [f"{prediction}_{t}" for t in range(len(models))]
    stages = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"), *[m.setPredictionCol(n) for m, n in zip(models, names)]]
    if len(models) > 1:
        stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(f'`{n}`' for n in names)}), ({' + '.join(f'`{n}`' for n in names)}) / {len(names)} AS `{prediction}` FROM __THIS__"))
    return PipelineModel(stages=stages)


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(df).drop("features")


def importances(df: DataFrame, features: Sequence[str], target: str, kind: str = "forest", seeds: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """(feature, mean, std) of the importances over fits with several seeds."""
    rows = []
    for seed in seeds:
        each = [m.featureImportances.toArray() for m in _grown(df, features, target, kind, seed)]
        whole = float(sum(e.sum() for e in each)) or 1.0
        rows += [(f, float(sum(e[i] for e in each)) / whole) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"))


def principal_components(df: DataFrame, features: Sequence[str], k: int, keep: Sequence[str] = ()) -> DataFrame:
    """Columns pc_1 to pc_k of the assembled features."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip"), PCA(k=k, inputCol="_x", outputCol="_pc")]
    out = Pipeline(stages=stages).fit(df).transform(df).withColumn("_a", vector_to_array("_pc"))
    return out.select(*keep, *[F.col("_a")[i].alias(f"pc_{i + 1}") for i in range(k)])


def with_leaves(df: DataFrame, features: Sequence[str], target: str, kind: str = "forest", column: str = "leaves") -> tuple[DataFrame, list[int]]:
    """``df`` with the leaf that each tree of a fitted forest or boosted model puts a row in, and the trees' numbers of leaves."""
    model = REGRESSORS[kind]().setLabelCol(target).setLeafCol(column)
    data = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(df)
    fitted = model.setFeaturesCol("_x").setPredictionCol("_p").fit(data)
    out = fitted.transform(data).withColumn(column, vector_to_array(column).cast("array<int>")).drop("_x", "_p")
    return out, [(t.numNodes + 1) // 2 for t in fitted.trees]


def leaf_bits(leaves: str, sizes: Sequence[int]) -> Column:
    """One bit for each row and tree: the leaves of all trees laid end to end, as inputs of a second model."""
    starts = F.array(*[F.lit(sum(sizes[:i])) for i in range(len(sizes))])
    return F.zip_with(leaves, starts, lambda leaf, start: (leaf + start).cast("int"))


@dataclass
class Boosted:
    """Trees of AdaBoost.R2 with their weights; a prediction is the weighted median of the trees'."""

    features: list[str]
    trees: list[PipelineModel]
    weights: list[float]

    def predict(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        kept = df.columns
        for i, tree in enumerate(self.trees):
            df = tree.transform(df).withColumnRenamed("_p", f"_p{i}").drop("_x")
        pairs = F.array_sort(F.array(*[F.struct(F.col(f"_p{i}").alias("p"), F.lit(float(w)).alias("w")) for i, w in enumerate(self.weights)]))
        half, kind = sum(self.weights) / 2, "struct<s:double,p:double>"
        walk = F.aggregate(pairs, F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("p")).cast(kind), lambda a, x: F.struct((a["s"] + x["w"]).alias("s"), F.when(a["p"].isNull() & (a["s"] + x["w"] >= half - 1e-12), x["p"]).otherwise(a["p"]).alias("p")).cast(kind))
        return df.select(*kept, walk["p"].alias(prediction))

    def importances(self) -> list[tuple[str, float]]:
        total = sum(self.weights)
        each = [[float(x) * w / total for x in t.stages[-1].featureImportances.toArray()] for t, w in zip(self.trees, self.weights)]
        return [(f, sum(e[i] for e in each)) for i, f in enumerate(self.features)]


def boost(df: DataFrame, features: Sequence[str], target: str, rounds: int = 10, depth: int = 3, seed: int = 42) -> Boosted:
    """AdaBoost.R2: each tree learns from rows weighted by how badly the trees before predicted them; linear loss.

    Row weights are a column that each round but the last rewrites and stores, so no row leaves the executors; a round predicts each
    row once for its errors and once for its new weight. Of few distinct vectors of features each is predicted once a round, and its rows find
    the prediction by a broadcast join; the tree sees the vectors, and weights follow from the rows, which are stored once. It ends early once a tree's
    weighted loss reaches one half, or a tree has no error.
    """
    inputs = [F.col(f).cast("double").alias(f) for f in features]
    rows = df.select(*inputs, F.col(target).cast("double").alias("_y")).na.drop().withColumn("_w", F.lit(1.0))
    rows = checkpoints.stored(rows, "boost-rows")
    few = few_vectors(rows, features)
    trees, weights = [], []
    for r in range(rounds):
        seen, label, weight = rows, "_y", "_w"
        if few:
            seen, label, weight = _vectors(rows, features, "_y", [F.col("_w")]), "_y0", "_w0"
            seen = seen.withColumn("_w0", F.col("_w0") / seen.agg(F.avg("_w0")).first()[0])
        tree = DecisionTreeRegressor(featuresCol="_x", labelCol=label, weightCol=weight, predictionCol="_p", maxDepth=depth, seed=seed + r)
        model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), tree]).fit(seen)
        predicted = rows.join(F.broadcast(model.transform(seen).select(*features, "_p")), list(features)) if few else model.transform(rows)
        errors = predicted.withColumn("_e", F.abs(F.col("_p") - F.col("_y")))
        most, weighted, whole = errors.agg(F.max("_e"), F.sum(F.col("_w") * F.col("_e")), F.sum("_w")).first()
        if not most:
            return Boosted(list(features), [model], [1.0])
        loss = weighted / most / whole
        if loss >= 0.5 and trees:
            break
        beta = loss / max(1 - loss, 1e-12)
        trees.append(model)
        weights.append(max(float(-math.log(max(beta, 1e-300))), 1e-12))
        if loss >= 0.5 or r == rounds - 1:
            break
        rows = errors.withColumn("_w", F.col("_w") * F.pow(F.lit(beta), 1 - F.col("_e") / most)).drop("_x", "_p", "_e")
        if not few:
            rows = checkpoints.stored(rows, "boost-rows")
            rows = rows.withColumn("_w", F.col("_w") / rows.agg(F.avg("_w")).first()[0])
    return Boosted(list(features), trees, weights)


def _dealt_vectors(rows: DataFrame, features: Sequence[str]) -> DataFrame | None:
    """Every vector of features that dealing one of them anew can make, if they are few: each value of a feature beside what goes with any."""
    if not few_vectors(rows, features):
        return None
    vectors = checkpoints.stored(rows.select(*features).distinct(), "vectors")
    others = {f: [g for g in features if g != f] for f in features}
    sizes = vectors.agg(*[F.count_distinct(f) * (F.count_distinct(*others[f]) if others[f] else 1) for f in features]).first()
    if sum(sizes) > VECTORS * len(features):
        return None
    made = [vectors.select(f).distinct().crossJoin(vectors.select(*others[f]).distinct()).select(*features) for f in features]
    return reduce(DataFrame.unionByName, made).distinct()


def permutation_importances(df: DataFrame, features: Sequence[str], target: str, model: PipelineModel, repeats: int = 3, seed: int = 42, prediction: str = "prediction") -> DataFrame:
    """(feature, mean, std): by how much the mean absolute error grows when a feature's values are dealt anew among the rows.

    Rows are dealt at random to blocks of about ``BLOCK`` once, and within a block stand in random order; for each feature and repeat a row takes
    the value of the row some places on in its block, so any other row may be the one, and no row is shuffled or joined for it. If the
    vectors that this can make are few, each is predicted once and rows find theirs by a broadcast join.
    """
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y")).na.drop()
    n = rows.count()
    if n < 2:
        raise ValueError("two rows at least")
    blocks = -(-n // BLOCK)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-blocks // BLOCKS))
    names = [*features, "_y"]
    block = rows.withColumn("_b", F.floor(F.rand(seed) * blocks)).repartition(tasks, "_b").groupBy("_b").agg(F.collect_list(F.struct(*names)).alias("_rows"))
    block = block.select("_b", F.shuffle("_rows", seed).alias("_rows")).select("_b", *[F.col("_rows")[c].alias(c) for c in names])
    block = checkpoints.stored(block, "blocks").withColumn("_n", F.size("_y"))
    trials = [(i, r) for i in range(-1, len(features)) for r in range(repeats if i >= 0 else 1)]
    tried = block.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("r")) for i, r in trials])).alias("_t"))
    tried = tried.withColumn("_by", F.pmod(F.xxhash64(F.lit(seed), "_t.i", "_t.r", "_b"), F.greatest(F.col("_n") - 1, F.lit(1))).cast("int") + 1)
    turned = lambda c: F.concat(F.slice(c, F.col("_by") + 1, F.col("_n")), F.slice(c, F.lit(1), F.col("_by")))
    values = [F.when(F.col("_t.i") == i, turned(f)).otherwise(F.col(f)).alias(f) for i, f in enumerate(features)]
    dealt = tried.select("_t", *values, "_y").select("_t", F.inline(F.arrays_zip(*names)))
    vectors = _dealt_vectors(rows, features)
    told = predict(dealt, model) if vectors is None else dealt.join(F.broadcast(predict(vectors, model)), list(features))
    errors = told.groupBy(F.col("_t.i").alias("i"), F.col("_t.r").alias("r")).agg(F.avg(F.abs(F.col(prediction) - F.col("_y"))).alias("e")).collect()
    base = next(x["e"] for x in errors if x["i"] < 0)
    found = [(features[x["i"]], float(x["e"] - base)) for x in errors if x["i"] >= 0]
    return df.sparkSession.createDataFrame(found, "feature string, grows double").groupBy("feature").agg(F.avg("grows").alias("mean"), F.stddev_pop("grows").alias("std"))


@dataclass
class Registry:
    """Models by seed and run, with the weights and bias of their ensembles."""

    runs: dict[int, dict[int, PipelineModel]] = field(default_factory=dict)
    weights: dict[int, tuple[float, dict[int, float]]] = field(default_factory=dict)

    def register(self, seed: int, run: int, model: PipelineModel) -> None:
        self.runs.setdefault(seed, {})[run] = model

    def unregister(self, seed: int, run: int) -> None:
        self.runs[seed].pop(run)

    def score(self, df: DataFrame, seed: int, prediction: str = "prediction") -> DataFrame:
        """Every run's prediction p{run}, their mean and weighted ensemble."""
        from .score import with_ensembles

        for run, model in sorted(self.runs[seed].items()):
            df = predict(df, model).withColumnRenamed(prediction, f"p{run}")
        bias, weights = self.weights[seed]
        runs = sorted(self.runs[seed])
        return with_ensembles(df, [f"p{r}" for r in runs], [weights[r] for r in runs], bias)


# Published ensemble weights by seed: (bias, weights of runs 1 to 3).
PUBLISHED_WEIGHTS = {
    0: (0.0588261248565978, {1: 0.559624315213197, 2: 0.251527081404306, 3: 0.188149891277597}),
    1: (-0.0545227505521169, {1: 0.449512001190749, 2: 0.239001992586957, 3: 0.31204618371449}),
    2: (-0.0436316354256299, {1: 0.219670255105031, 2: 0.517350768571451, 3: 0.263460622703647}),
    3: (-0.0361396416039597, {1: 0.20720356123352, 2: 0.153259120049858, 3: 0.64005859425584}),
    42: (-0.0247125696039685, {1: 0.577815892234786, 2: 0.344448063591173, 3: 0.0779777829946805}),
}
