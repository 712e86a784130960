"""Features, forecast, risk, opportunity and anomaly jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierworks.functions import half_up
from tierworks.operators.joins import join_group_stats, lookup
from tierworks.operators.profile import union_all
from tierworks.session import cut_lineage


def preflight(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """Rows of each table that exists; a missing one is listed with NULL rows."""
    parts = []
    for t in tables:
        if spark.catalog.tableExists(t):
            n = spark.table(t).agg(F.count(F.lit(1)).alias("row_count"))
            parts.append(n.select(F.lit(t).alias("table_name"), F.lit(True).alias("found"), "row_count"))
        else:
            parts.append(
                spark.range(1).select(
                    F.lit(t).alias("table_name"), F.lit(False).alias("found"), F.lit(None).cast("bigint").alias("row_count")
                )
            )
    return union_all(parts)


def features(recap: DataFrame, calendar: DataFrame, lags: int = 0) -> DataFrame:
    """Year, KPI, value and target without NULLs; with ``lags`` also the gap and the values of earlier years.

    The lag windows run per KPI over one row per year.
    """
    joined = lookup(recap, calendar.select("waktu_id", "tahun"), "waktu_id", "inner")
    out = joined.select("tahun", F.col("iku_kode").alias("iku_code"), "nilai_capaian", "nilai_target").dropna()
    if not lags:
        return out
    by_year = Window.partitionBy("iku_code").orderBy("tahun")
    return out.withColumns(
        {
            "gap": half_up(F.col("nilai_capaian") - F.col("nilai_target"), 4),
            **{f"lag_{i}": F.lag("nilai_capaian", i).over(by_year) for i in range(1, lags + 1)},
        }
    )


def write_features(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def forecast_drift(
    df: DataFrame, year: str, value: str, step: float = 1.5, cap: float = 100.0, horizon: int = 3, first: int | None = None
) -> DataFrame:
    """Mean value of every year, then a forecast from the newest that rises by ``step`` a year up to ``cap``.

    With ``first`` only so many of the oldest years count.
    """
    actual = (
        df.groupBy(F.col(year).cast("int").alias("tahun"))
        .agg((F.sum(F.col(value).cast("decimal(28,4)")).cast("double") / F.count(value)).alias("v"))
    )
    if first is not None:
        actual = actual.orderBy("tahun").limit(first)
    last = actual.agg(F.max("tahun").alias("tahun"), F.max_by("v", "tahun").alias("v")).filter("tahun IS NOT NULL")
    ahead = last.select("tahun", "v", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("i")).select(
        (F.col("tahun") + F.col("i")).alias("tahun"),
        half_up(F.least(F.lit(cap), F.col("v") + F.col("i") * F.lit(step)), 2).alias("nilai_capaian"),
        F.lit(1).alias("is_forecast"),
    )
    return actual.select(
        "tahun", half_up("v", 6).alias("nilai_capaian"), F.lit(0).alias("is_forecast")
    ).unionByName(ahead)


def _trend(x: str, y: str) -> tuple[Column, Column]:
    """Slope and intercept of the least-squares line; a single point gives a flat line."""
    slope = F.regr_slope(F.col(y), F.col(x))
    return F.coalesce(slope, F.lit(0.0)), F.coalesce(F.regr_intercept(F.col(y), F.col(x)), F.avg(y))


def forecast_trend(
    df: DataFrame, by: Sequence[str], year: str, value: str, horizon: int = 3, cap: float | None = None
) -> DataFrame:
    """Least-squares line per group, continued ``horizon`` years, beside the last value as the baseline."""
    rows = df.filter(F.col(value).isNotNull()).select(
        *by, F.col(year).cast("double").alias("x"), F.col(value).cast("double").alias("y")
    )
    slope, intercept = _trend("x", "y")
    lines = rows.groupBy(*by).agg(
        slope.alias("slope"), intercept.alias("intercept"),
        F.max("x").cast("int").alias("last_year"), F.max_by("y", "x").alias("last_value"),
    )
    ahead = lines.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("i"))
    at = (F.col("last_year") + F.col("i")).cast("int")
    line = F.col("intercept") + F.col("slope") * at
    if cap is not None:
        line = F.least(line, F.lit(cap))
    return ahead.select(
        *by, at.alias("tahun"), half_up(line, 4).alias("forecast"), half_up("last_value", 4).alias("naive")
    )


def fit_values(df: DataFrame, by: Sequence[str], year: str, value: str, digits: int = 4) -> DataFrame:
    """Every row with the value its group's line gives for its year."""
    rows = df.filter(F.col(value).isNotNull())
    slope, intercept = _trend("__x", "__y")
    lines = (
        rows.select(*by, F.col(year).cast("double").alias("__x"), F.col(value).cast("double").alias("__y"))
        .groupBy(*by)
        .agg(slope.alias("__slope"), intercept.alias("__intercept"))
    )
    fitted = F.col("__intercept") + F.col("__slope") * F.col(year)
    return lookup(rows, lines, list(by)).withColumn("fitted", half_up(fitted, digits)).drop("__slope", "__intercept")


def _exact_mean(value: Column, digits: int = 4) -> Column:
    total = F.sum(value.cast("decimal(28,8)")).cast("double")
    return half_up(total / F.count(value), digits)


def forecast_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MAPE %, sMAPE % and R2 in one aggregation. Zero actuals are left out of the percentages."""
    rows = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    miss = F.abs(a - p)
    size = F.abs(a) + F.abs(p)

    def total(c: Column) -> Column:
        return F.sum(c.cast("decimal(28,8)")).cast("double")

    n = F.count(F.lit(1))
    spread = total(a * a) - total(a) * total(a) / n
    return rows.groupBy(*by).agg(
        n.alias("n"),
        _exact_mean(miss).alias("mae"),
        half_up(F.sqrt(total(miss * miss) / n), 4).alias("rmse"),
        _exact_mean(F.when(a != 0, miss / F.abs(a) * 100)).alias("mape"),
        _exact_mean(F.when(size != 0, miss * 200 / size)).alias("smape"),
        F.when(spread > 0, half_up(1 - total(miss * miss) / spread, 4)).alias("r2"),
    )


def risk_label(value: Column | str, target: Column | str) -> Column:
    """1 where the target is missed; NULL where either side is unknown."""
    value, target = (F.col(c) if isinstance(c, str) else c for c in (value, target))
    return F.when(value.isNotNull() & target.isNotNull(), (value < target).cast("int"))


def split_by_class(df: DataFrame, key: Sequence[str], train: float = 0.8, seed: int = 42) -> DataFrame:
    """Mark about ``train`` of the rows of every class as training rows, by a hash of the key.

    The draw is uniform and does not look at the class, so each class keeps the share.
    """
    draw = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(10_000))
    return df.withColumn("is_train", draw < int(train * 10_000))


def stratified_split(df: DataFrame, key: Sequence[str], label: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Mark the wanted share of every class, to the row, as training rows: ``is_train``.

    A row's draw is a digest of its key, and a class's rows with the lowest draws are trained on. The draw that bounds
    them is found without sorting: a histogram of the draws' first 16 bits says in which of 65,536 bins it lies, and only the
    rows of that bin are ranked. A NULL label is a class of its own. Keys are unique.
    """
    draw = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    rows = df.withColumn("__draw", draw).withColumn("__class", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")))
    rows = rows.withColumn("__bin", F.substring("__draw", 1, 4))
    bins = rows.groupBy("__class", "__bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("__class").orderBy("__bin")
    reached = bins.select("__class", "__bin", (F.sum("n").over(upto) - F.col("n")).alias("below"), "n", F.sum("n").over(Window.partitionBy("__class")).alias("all"))
    quota = F.expr(f"({round(train * 1000)} * all + 500) DIV 1000")
    bound = cut_lineage(reached.withColumn("wanted", quota - F.col("below")).where("wanted > 0 AND wanted <= n").select("__class", "__bin", "wanted"))
    inside = rows.select("__class", "__bin", "__draw").join(F.broadcast(bound), ["__class", "__bin"])
    ranked = inside.withColumn("at", F.row_number().over(Window.partitionBy("__class").orderBy("__draw"))).where("at = wanted")
    last = cut_lineage(ranked.select("__class", F.col("__draw").alias("__last")))
    marked = rows.join(F.broadcast(last), "__class", "left")
    return marked.withColumn("is_train", F.coalesce(F.col("__draw") <= F.col("__last"), F.lit(False))).select(*df.columns, "is_train")


def _complete(columns: Sequence[str]) -> Column:
    """Whether every one of the columns has a value."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return known


def _vector(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep").transform(df)


def train_risk(df: DataFrame, columns: Sequence[str], label: str, trees: int = 50, seed: int = 42) -> RandomForestClassificationModel:
    """Random forest over the complete training rows (all complete rows if none are marked).

    The forest reads its rows several times: give it a stored feature table.
    """
    rows = df.filter(F.col(label).isNotNull())
    if "is_train" in df.columns:
        rows = rows.filter("is_train")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=trees, seed=seed, maxDepth=5, cacheNodeIds=False
    )
    return forest.fit(_vector(rows.filter(_complete(columns)), columns))


def score_risk(model: RandomForestClassificationModel, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Probability of a miss as a score from 0 to 100, and the class it implies.

    Every row is kept. A row that lacks a feature has no score and no class, and ``unscored`` names the first
    feature it lacks.
    """
    scored = model.transform(_vector(df, columns))
    share = F.element_at(vector_to_array("probability"), 2) if model.numClasses > 1 else F.lit(0.0)
    lacking = F.coalesce(*[F.when(~_complete([c]), F.lit(c)) for c in columns])
    return (
        scored.withColumn("unscored", lacking)
        .withColumn("risk_score", F.when(F.col("unscored").isNull(), F.round(share * 100, 2)))
        .withColumn("prediction", F.when(F.col("unscored").isNull(), F.col("prediction")))
        .drop("features", "rawPrediction")
    )


def class_metrics(scored: DataFrame, label: str) -> dict[str, float]:
    """Accuracy, macro F1, precision, recall and exact ROC-AUC measured on the rows with a label and a score."""
    rows = scored.filter(F.col(label).isNotNull() & F.col("risk_score").isNotNull()).withColumn(label, F.col(label).cast("double"))
    per_class = confusion(rows, label)
    counts = per_class.groupBy("label").agg(
        F.sum("n").alias("actual"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit")
    )
    guessed = per_class.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("guessed"))
    hit, actual, predicted = (F.coalesce(c, F.lit(0)) for c in ("hit", "actual", "guessed"))
    precision = F.when(predicted > 0, hit / predicted).otherwise(0.0)
    recall = F.when(actual > 0, hit / actual).otherwise(0.0)
    f1 = F.when(hit > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    row = (
        counts.join(guessed, "label", "full")
        .agg(
            (F.sum(hit) / F.sum(actual)).alias("accuracy"), F.avg(f1).alias("f1_macro"),
            F.avg(precision).alias("precision"), F.avg(recall).alias("recall"),
        )
        .first()
    )
    auc = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="risk_score", metricName="areaUnderROC", numBins=0)
    return {**{k: float(v) for k, v in row.asDict().items() if v is not None}, "roc_auc": float(auc.evaluate(rows))}


def confusion(scored: DataFrame, label: str) -> DataFrame:
    return scored.groupBy(F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def opportunity(
    df: DataFrame, unit: str, columns: Sequence[str], ks: Sequence[int] = (3, 4, 5), seed: int = 42
) -> tuple[DataFrame, dict[int, float]]:
    """Min-max scaled KPI vectors clustered by k-means; score 100 at the best corner, 0 at the worst.

    Returns the scored units and the silhouette of each number of clusters tried; the best one (of equals the
    smallest) makes the clusters. Units that lack a KPI stay, without a cluster and a score. Scaling, clustering
    and the silhouette each pass over the vectors, so these are computed once and kept in the shared folder.
    """
    units = cut_lineage(df.select(unit, *columns))
    vectors = _vector(units.filter(_complete(columns)), columns, "raw")
    n = vectors.count()
    rest = units.filter(~_complete(columns)).withColumns(
        {"cluster": F.lit(None).cast("int"), "opportunity_score": F.lit(None).cast("double")}
    )
    if not n:
        return rest, {}
    scaled = MinMaxScaler(inputCol="raw", outputCol="features").fit(vectors).transform(vectors)
    quality, best = {}, None
    for k in sorted(ks):
        if k >= n:
            continue
        placed = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(scaled).transform(scaled)
        # without a second cluster there is no silhouette
        found = placed.agg(F.count_distinct("cluster")).first()[0]
        quality[k] = float(ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(placed)) if found > 1 else -1.0
        if best is None or quality[k] > quality[best[0]]:
            best = (k, placed)
    placed = best[1] if best else scaled.withColumn("cluster", F.lit(0))
    gap = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda acc, x: acc + (1 - x) * (1 - x))
    score = half_up(100 * (1 - F.sqrt(gap / len(columns))), 2)
    return placed.select(unit, *columns, "cluster", score.alias("opportunity_score")).unionByName(rest), quality


def anomaly_z(df: DataFrame, metric: str, value: str, limit: float = 3.0) -> DataFrame:
    """Rows with their z-score within the metric and a flag for |z| above the limit.

    The statistics are one row per metric, computed first and joined back to the rows.
    """
    v = F.col(value).cast("double")
    stats = df.groupBy(metric).agg(F.avg(v).alias("__mean"), F.stddev_pop(v).alias("__spread"))
    mean, spread = F.col("__mean"), F.col("__spread")
    z = F.when(spread > 0, (F.col(value) - mean) / spread).otherwise(0.0)
    return (
        join_group_stats(df, stats, [metric])
        .withColumn("z", half_up(z, 4))
        .withColumn("is_anomaly", (F.abs("z") > limit).cast("int"))
        .drop("__mean", "__spread")
    )


def anomaly_residual(df: DataFrame, by: Sequence[str], actual: str, predicted: str, factor: float = 2.0) -> DataFrame:
    """Rows whose residual is beyond ``factor`` times the RMSE of their group."""
    miss = F.col(actual) - F.col(predicted)
    stats = df.groupBy(*by).agg(
        F.sqrt(F.sum((miss * miss).cast("decimal(28,8)")).cast("double") / F.count(miss)).alias("__rmse")
    )
    return (
        lookup(df, stats, list(by))
        .withColumn("residual", half_up(miss, 4))
        .withColumn("rmse", half_up("__rmse", 4))
        .withColumn("is_anomaly", (F.abs(miss) > F.col("__rmse") * factor).cast("int"))
        .drop("__rmse")
    )


def anomaly_summary(flagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    flagged_rows = F.coalesce(F.sum("is_anomaly"), F.lit(0))
    return flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_records"),
        flagged_rows.cast("bigint").alias("anomaly_count"),
        half_up(flagged_rows * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("anomaly_rate_pct"),
    )


def insight_long(
    defaults: DataFrame,
    inference: DataFrame,
    keys: Sequence[str] = ("section", "entity", "metric"),
    updated: Sequence[str] = ("anomaly",),
) -> DataFrame:
    """Inference values over default ones, both as (section, entity, metric, value).

    A section with inferred rows drops all its defaults; in the ``updated`` sections a
    default only yields to the inferred value of the same key.
    """
    by_key = F.col("section").isin(*updated)
    kept = (
        defaults.filter(~by_key)
        .join(inference.select("section").distinct(), "section", "left_anti")
        .unionByName(defaults.filter(by_key).join(inference.select(*keys), list(keys), "left_anti"))
    )
    columns = [*keys, "value"]
    return kept.select(*columns).unionByName(inference.select(*columns))


def catalog_of_models(spark: SparkSession, metrics: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Measured model metrics as (model, metric, value) rows."""
    rows = [(m, k, float(v)) for m, per in metrics.items() for k, v in per.items()]
    return spark.createDataFrame(rows, "model string, metric string, value double")

