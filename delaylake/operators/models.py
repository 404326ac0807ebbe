"""Day split, vocabularies, and boosted models for the delay and its quantiles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from delaylake.functions.temporal import ladder

from .cut import cut, uncut, work_dir

CATEGORIES = ["line_ref", "direction", "stop_ref"]
NUMBERS = [
    "order_no", "dow", "hour", "horizon_sec", "horizon_stops", "current_order", "n_recorded", "current_delay_sec", "delay_trend_sec", "sched_runtime_sec",
    "seg_slack_sec", "stop_recent_delay_sec", "line_recent_delay_sec", "obs_age_sec", "since_last_stop_sec",
]
PARKED = ["fc_air_temp", "fc_precip_mm", "fc_wind_mps", "sx_line_active", "sx_network_active", "headway_ahead_sec", "delay_ahead_sec"]
OFFICIAL = "entur_pred_delay_sec"
LABEL = "label_delay_sec"
LEAST_ROWS = 1000
#: Most trees of a fit; the validation rows decide how many of them there are.
ROUNDS = 2000
PATIENCE = 100
#: Stop and line codes are numbers to a tree: with few bins neighbours in the alphabet cannot be told apart.
BINS = 256
#: Scoring writes its rows after so many trees, as plans must not grow with their number.
TREES_A_PLAN = 50


def feature_names(exclude: tuple[str, ...] = (), parked: bool = False, official: bool = False) -> list[str]:
    """The features to use; the horizon cannot be left out."""
    if "horizon_sec" in exclude:
        raise ValueError("horizon_sec cannot be excluded")
    names = CATEGORIES + NUMBERS + PARKED * parked + [OFFICIAL] * official
    return [n for n in names if n not in exclude]


def day_split(rows: DataFrame, valid_days: int = 1, valid_on: list[str] | None = None, date: str = "operating_date") -> DataFrame:
    """``rows`` with ``is_valid``: the last ``valid_days`` dates, or the named ones; with too few dates the last fifth by time.

    A missing date sorts first. Naming a date that is not there is an error.
    """
    day = F.coalesce(date, F.lit(""))
    dates = [r["d"] for r in rows.select(day.alias("d")).distinct().orderBy("d").collect()]
    if valid_on is not None:
        if missing := sorted(set(valid_on) - set(dates)):
            raise ValueError(f"no rows on {', '.join(missing)}")
        return rows.withColumn("is_valid", day.isin(valid_on))
    if len(dates) > valid_days:
        return rows.withColumn("is_valid", day.isin(dates[-valid_days:]))
    # a quantile of time, found without a sort of all rows in one place
    cut = rows.select(F.percentile_approx(F.unix_micros(F.try_to_timestamp("polled_at")), 0.8, 10_000).alias("c")).first()["c"]
    return rows.withColumn("is_valid", F.unix_micros(F.try_to_timestamp("polled_at")) > F.lit(cut))


def vocabulary(rows: DataFrame, column: str) -> DataFrame:
    """``value, code`` with codes from 1 in sorted order.

    Codes come from positions within range partitions plus the partitions' sizes,
    so no single task sorts everything.
    """
    values = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    # written once: both uses below must see the same partitions
    parts = cut(values.repartitionByRange("value").withColumn("_part", F.spark_partition_id()), "vocabulary")
    sizes = parts.groupBy("_part").count()
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy("a._part").agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("_before"))
    inside = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("value")))
    return inside.join(F.broadcast(before), "_part").select("value", (F.col("_n") + F.col("_before")).cast("long").alias("code"))


def encoded(rows: DataFrame, column: str, words: DataFrame, out: str | None = None) -> DataFrame:
    """``rows`` with the codes of ``column``; null and unseen values are 0."""
    w = words.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    joined = rows.join(w, rows[column] == w["_value"], "left")
    return joined.withColumn(out or column, F.coalesce("_code", F.lit(0)).cast("long")).drop("_value", "_code")


@dataclass
class Fitted:
    """A model with what is needed to apply it: features, vocabularies, where to put the result."""

    features: list[str]
    vocabularies: dict[str, DataFrame]
    stages: list
    base: float = 0.0
    rates: list[float] = field(default_factory=list)
    importances: dict[str, float] = field(default_factory=dict)

    def matrix(self, rows: DataFrame) -> DataFrame:
        return _matrix(rows, self.features, self.vocabularies)

    def predict(self, rows: DataFrame, name: str = "model_pred_delay_sec") -> DataFrame:
        out = self.matrix(rows)
        if self.stages and not self.rates:
            return self.stages[0].transform(out).withColumnRenamed("prediction", name).drop("_x")
        out = out.withColumn(name, F.lit(self.base))
        for tree, (model, values) in enumerate(self.stages):
            out = model.transform(out).drop("prediction")
            out = out.withColumn(name, F.col(name) + _leaf_value(F.col("_leaf"), values) * self.rates[tree]).drop("_leaf")
            if tree % TREES_A_PLAN == TREES_A_PLAN - 1:
                out = cut(out, "scored")
        return out.drop("_x")


def _matrix(rows: DataFrame, features: list[str], words: dict[str, DataFrame]) -> DataFrame:
    out, columns = rows, []
    for f in features:
        if f in words:
            out = encoded(out, f, words[f], f"_code_{f}")
            columns.append(f"_code_{f}")
        else:
            # trees split anywhere, so a value below all others stands for missing
            out = out.withColumn(f"_num_{f}", F.coalesce(F.col(f).cast("double"), F.lit(-1e6)))
            columns.append(f"_num_{f}")
    return VectorAssembler(inputCols=columns, outputCol="_x").transform(out).drop(*columns)


def _both(train: DataFrame, valid: DataFrame | None, features: list[str], words: dict[str, DataFrame]) -> DataFrame:
    """``_x``, label and ``_valid`` of the rows to fit on and of those that only tell when to stop."""
    rows = _matrix(train, features, words).select("_x", LABEL, F.lit(False).alias("_valid"))
    return rows if valid is None else rows.unionByName(_matrix(valid, features, words).select("_x", LABEL, F.lit(True).alias("_valid")))


def fit_point(
    train: DataFrame, features: list[str], rounds: int = ROUNDS, depth: int = 6, rate: float = 0.1, least: int = LEAST_ROWS, seed: int = 7, valid: DataFrame | None = None
) -> Fitted:
    """Boosted trees on the absolute error, up to the first round that makes the error on ``valid`` larger."""
    n = train.count()
    if n < least:
        raise ValueError(f"{n} rows are too few to fit")
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        # lineages of many rounds are cut there
        context.setCheckpointDir(work_dir(train.sparkSession))
    words = {c: cut(vocabulary(train, c), "words") for c in CATEGORIES if c in features}
    stop = {} if valid is None else {"validationIndicatorCol": "_valid", "validationTol": 0.0}
    gbt = GBTRegressor(featuresCol="_x", labelCol=LABEL, lossType="absolute", maxIter=rounds, maxDepth=depth, maxBins=BINS, stepSize=rate, minInstancesPerNode=20, seed=seed, **stop)
    model = gbt.fit(_both(train, valid, features, words))
    shares = dict(zip(features, model.featureImportances.toArray().tolist()))
    return Fitted(features, words, [model], importances=shares)


def _leaf_value(leaf: Column, values: dict[float, float]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(float(x)) for kv in values.items() for x in kv]), leaf), F.lit(0.0))


def fit_quantile(
    train: DataFrame, features: list[str], level: float, rounds: int = ROUNDS, depth: int = 6, rate: float = 0.02, seed: int = 7, valid: DataFrame | None = None, patience: int = PATIENCE
) -> Fitted:
    """Boosted trees on the pinball loss: each tree fits the loss's sign, each leaf takes its residuals' quantile.

    MLlib has no quantile loss. Leaves are few (2 to the depth), their values come
    from one distributed aggregate per tree. With ``valid`` fitting stops after
    ``patience`` rounds without a smaller loss on these rows, and the trees up to
    the smallest loss are kept.
    """
    words = {c: cut(vocabulary(train, c), "words") for c in CATEGORIES if c in features}
    base = train.select(F.percentile_approx(LABEL, level, 10_000)).first()[0]
    rest = F.col(LABEL) - F.col("_f")
    data, last = _both(train, valid, features, words).withColumn("_f", F.lit(float(base))), None
    stages, best, least = [], 0, None
    for r in range(rounds + 1):
        # written each round: trees read it several times, and plans must not grow with the rounds
        data = cut(data.withColumn("_g", F.when(F.col(LABEL) > F.col("_f"), level).otherwise(level - 1.0)), "boosting")
        if last is not None:
            uncut(last)
        last = data
        if valid is not None:
            loss = data.filter("_valid").agg(F.avg(F.greatest(rest * level, rest * (level - 1.0)))).first()[0]
            if loss is not None and (least is None or loss < least):
                best, least = r, loss
            elif loss is not None and r - best >= patience:
                break
        if r == rounds:
            break
        tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_g", maxDepth=depth, maxBins=BINS, minInstancesPerNode=20, leafCol="_leaf", seed=seed + r).fit(data.filter("not _valid"))
        placed = tree.transform(data).drop("prediction")
        values = {x["_leaf"]: float(x["v"]) for x in placed.filter("not _valid").groupBy("_leaf").agg(F.percentile_approx(rest, level, 1000).alias("v")).collect()}
        data = placed.withColumn("_f", F.col("_f") + _leaf_value(F.col("_leaf"), values) * rate).select("_x", LABEL, "_valid", "_f")
        stages.append((tree, values))
    uncut(last)
    if least is not None:
        stages = stages[:best]
    return Fitted(features, words, stages, float(base), [rate] * len(stages))


def fit_quantiles(train: DataFrame, features: list[str], levels: list[float], **options) -> dict[float, Fitted]:
    return {a: fit_quantile(train, features, a, **options) for a in levels}


def with_ladder(rows: DataFrame, fitted: dict[float, Fitted], name: str = "ladder") -> DataFrame:
    """``rows`` with the rising ladder of all fitted quantiles, as calibration reports read it."""
    out, rungs = rows, []
    for level in sorted(fitted):
        rungs.append(f"_q{len(rungs)}")
        out = fitted[level].predict(out, rungs[-1])
    return out.withColumn(name, ladder(*[F.col(r) for r in rungs])).drop(*rungs)


def predict_interval(rows: DataFrame, low: Fitted, high: Fitted) -> DataFrame:
    """``rows`` with ``pred_low_sec <= pred_high_sec``."""
    out = high.predict(low.predict(rows, "_low"), "_high")
    return out.withColumns({"pred_low_sec": F.least("_low", "_high"), "pred_high_sec": F.greatest("_low", "_high")}).drop("_low", "_high")


def save_point(fitted: Fitted, path: str) -> None:
    """Model, vocabularies and the feature list that a reader must use."""
    spark = SparkSession.active()
    PipelineModel([fitted.stages[0]]).write().overwrite().save(f"{path}/model")
    for name, words in fitted.vocabularies.items():
        words.write.mode("overwrite").parquet(f"{path}/vocabulary/{name}")
    spark.createDataFrame([(i, f, float(fitted.importances.get(f, 0.0))) for i, f in enumerate(fitted.features)], "pos int, feature string, share double").write.mode("overwrite").json(f"{path}/meta")


def load_point(spark, path: str) -> Fitted:
    meta = spark.read.schema("pos int, feature string, share double").json(f"{path}/meta").orderBy("pos").collect()
    features = [r["feature"] for r in meta]
    words = {c: spark.read.parquet(f"{path}/vocabulary/{c}") for c in CATEGORIES if c in features}
    return Fitted(features, words, [PipelineModel.load(f"{path}/model").stages[0]], importances={r["feature"]: r["share"] for r in meta})


def save_quantile(fitted: Fitted, path: str) -> None:
    """Trees, leaf values, vocabularies and the feature list of one quantile model."""
    spark = SparkSession.active()
    PipelineModel([tree for tree, _ in fitted.stages]).write().overwrite().save(f"{path}/trees")
    leaves = [(i, float(leaf), float(v)) for i, (_, values) in enumerate(fitted.stages) for leaf, v in values.items()]
    spark.createDataFrame(leaves, "stage int, leaf double, value double").write.mode("overwrite").parquet(f"{path}/leaves")
    for name, words in fitted.vocabularies.items():
        words.write.mode("overwrite").parquet(f"{path}/vocabulary/{name}")
    rate = float(fitted.rates[0]) if fitted.rates else 0.0
    meta = [(i, f, float(fitted.base), rate) for i, f in enumerate(fitted.features)]
    spark.createDataFrame(meta, "pos int, feature string, base double, rate double").write.mode("overwrite").json(f"{path}/meta")


def load_quantile(spark, path: str) -> Fitted:
    meta = spark.read.schema("pos int, feature string, base double, rate double").json(f"{path}/meta").orderBy("pos").collect()
    features = [r["feature"] for r in meta]
    words = {c: spark.read.parquet(f"{path}/vocabulary/{c}") for c in CATEGORIES if c in features}
    values: dict[int, dict[float, float]] = {}
    for r in spark.read.parquet(f"{path}/leaves").collect():
        values.setdefault(r["stage"], {})[r["leaf"]] = r["value"]
    trees = PipelineModel.load(f"{path}/trees").stages
    return Fitted(features, words, [(t, values[i]) for i, t in enumerate(trees)], meta[0]["base"], [meta[0]["rate"]] * len(trees))


def save_ladder(fitted: dict[float, Fitted], path: str) -> None:
    """All quantile models, a folder for each level."""
    for level, model in fitted.items():
        save_quantile(model, f"{path}/level={level}")


def load_ladder(spark, path: str, levels: list[float]) -> dict[float, Fitted]:
    return {level: load_quantile(spark, f"{path}/level={level}") for level in levels}
