"""Model training and scoring on Spark ML."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import clip
from touchline.functions.scoreline import poisson_over
from touchline.operators.aggregates import count_metrics, dispersion, enough_values, probability_metrics
from touchline.operators.ordered import row_positions
from touchline.operators.split import chronological_split
from touchline.plans import boosting
from touchline.plans.serving import different_teams, fixture_features, link_fixtures, with_prediction_markets
from touchline.session import cut_lineage

# Fixed values of the models.
LABELS = ["loss", "draw", "win"]
REGULARISATION_C = 0.5
POISSON_ALPHA = 1.0
BLEND_STEPS = 10
BOOST_ROUNDS, BOOST_DEPTH, BOOST_RATE, BOOST_SAMPLE = 250, 3, 0.04, 0.8
BOOST_STEP = 0.7
OUTCOME_ROUNDS, OUTCOME_RATE, OUTCOME_PENALTY = 350, 0.035, 2.0
LEAST_TRAINING_ROWS = 100
SHOT_LINES = (5.5, 7.5, 9.5, 11.5, 13.5)
COUNT_LINES = (2.5, 3.5, 4.5, 5.5, 6.5)
COUNT_FLOOR = 0.01


def preprocessing(df: DataFrame, features: Sequence[str], indicators: bool = False) -> tuple[DataFrame, list]:
    """M1/M2: median imputation, scaling and one-hot stages for the features.

    Returns the frame with null-safe inputs and the pipeline stages up to
    ``features``. Numeric columns without any value are left out.
    """
    types = dict(df.dtypes)
    categorical = [c for c in features if types[c] in {"string", "boolean"}]
    numeric = enough_values(df, [c for c in features if c not in categorical], 1)
    ready = df.select(
        "*",
        *[F.col(f"`{c}`").cast("double").alias(f"n{i}") for i, c in enumerate(numeric)],
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("unknown")).alias(f"c{i}") for i, c in enumerate(categorical)],
        *([F.col(f"`{c}`").isNull().cast("double").alias(f"m{i}") for i, c in enumerate(numeric)] if indicators else []),
    )
    ns = [f"n{i}" for i in range(len(numeric))]
    cs = [f"c{i}" for i in range(len(categorical))]
    scaled = [f"{n}_i" for n in ns] + ([f"m{i}" for i in range(len(numeric))] if indicators else [])
    stages = [
        Imputer(strategy="median", inputCols=ns, outputCols=[f"{n}_i" for n in ns]),
        VectorAssembler(inputCols=scaled, outputCol="raw_numbers"),
        StandardScaler(inputCol="raw_numbers", outputCol="numbers", withMean=True, withStd=True),
    ]
    parts = ["numbers"]
    if cs:
        stages.append(StringIndexer(inputCols=cs, outputCols=[f"{c}_x" for c in cs], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}_x" for c in cs], outputCols=[f"{c}_v" for c in cs], dropLast=False))
        parts += [f"{c}_v" for c in cs]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return ready, stages


def with_label(df: DataFrame, result: str = "result") -> DataFrame:
    """Outcome label as the index of loss, draw, win."""
    label = F.coalesce(*[F.when(F.col(result) == name, float(i)) for i, name in enumerate(LABELS)])
    return df.withColumn("label", label)


def with_probabilities(scored: DataFrame, prefix: str = "probability_") -> DataFrame:
    p = vector_to_array("probability")
    return scored.select("*", *[p[i].alias(f"{prefix}{name}") for i, name in enumerate(LABELS)])


def fit_outcome(train: DataFrame, features: Sequence[str], rows: int | None = None) -> PipelineModel:
    """M3: multinomial logistic regression; the penalty is 1/(C·n) per row."""
    ready, stages = preprocessing(train, features)
    n = rows if rows is not None else train.count()
    model = LogisticRegression(
        family="multinomial", regParam=1.0 / (REGULARISATION_C * max(n, 1)), elasticNetParam=0.0, maxIter=100,
        standardization=False,  # numbers are scaled already and one-hot columns share their penalty
    )
    return Pipeline(stages=[*stages, model]).fit(with_label(ready))


def score_outcome(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Loss / draw / win probabilities of a table of feature rows."""
    ready, _ = _inputs_only(df, model, features)
    return with_probabilities(model.transform(ready)).select(
        *[F.col(f"`{c}`") for c in df.columns], *[f"probability_{name}" for name in LABELS]
    )


def _inputs_only(df: DataFrame, model: PipelineModel, features: Sequence[str]):
    """Same derived input columns as in training; ``features`` as the model was fitted with."""
    types = dict(df.dtypes)
    categorical = [c for c in features if types[c] in {"string", "boolean"}]
    numeric = [c for c in features if c not in categorical]
    indicators = any(c.startswith("m") for c in model.stages[1].getInputCols())
    ready = df.select(
        "*",
        *[F.col(f"`{c}`").cast("double").alias(f"n{i}") for i, c in enumerate(numeric)],
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("unknown")).alias(f"c{i}") for i, c in enumerate(categorical)],
        *([F.col(f"`{c}`").isNull().cast("double").alias(f"m{i}") for i, c in enumerate(numeric)] if indicators else []),
    )
    return ready, numeric


def outcome_metrics(scored: DataFrame, prefix: str = "probability_", by: Sequence[str] = ()) -> DataFrame:
    return probability_metrics(scored, "result", {name: f"{prefix}{name}" for name in LABELS}, by)


def train_outcome(home_rows: DataFrame, features: Sequence[str]) -> tuple[PipelineModel, DataFrame]:
    """M3: chronological split, fit on train, metrics per split."""
    split = cut_lineage(chronological_split(home_rows))
    usable = enough_values(split.where("split = 'train'"), features, 1)
    model = fit_outcome(split.where("split = 'train'"), usable)
    return model, outcome_metrics(score_outcome(model, split, usable), by=["split"])


def yearly_backtests(
    home_rows: DataFrame, features: Sequence[str], years: Sequence[int], competition: str = "world_cup"
) -> DataFrame:
    """M4: for each year fit on everything earlier and score that year's competition."""
    parts = []
    for year in years:
        start, stop = (F.lit(f"{y}-01-01 00:00:00").cast(home_rows.schema["kickoff_utc"].dataType) for y in (year, year + 1))
        past = home_rows.where(F.col("kickoff_utc") < start)
        n = past.count()
        if n < LEAST_TRAINING_ROWS:
            continue
        usable = enough_values(past, features, 1)
        model = fit_outcome(past, usable, n)
        now = home_rows.where((F.col("kickoff_utc") >= start) & (F.col("kickoff_utc") < stop) & (F.col("competition_type") == competition))
        if now.isEmpty():
            continue
        parts.append(outcome_metrics(score_outcome(model, now, usable)).withColumn("year", F.lit(year)))
    if not parts:  # no year has both a past and a competition
        model_free = home_rows.limit(0).select("*", *[F.lit(0.0).alias(f"probability_{name}") for name in LABELS])
        return outcome_metrics(model_free).withColumn("year", F.lit(0)).limit(0)
    return reduce(DataFrame.unionByName, parts)


def blend_losses(scored: DataFrame, first: str, second: str, steps: int = BLEND_STEPS) -> DataFrame:
    """M5: log loss of every blend weight 0..1, all weights in one pass."""
    def loss(weight: float):
        truth = F.coalesce(
            *[
                F.when(
                    F.col("result") == name,
                    F.col(f"{first}{name}") * weight + F.col(f"{second}{name}") * (1 - weight),
                )
                for name in LABELS
            ]
        )
        return F.avg(-F.ln(F.least(F.greatest(truth, F.lit(1e-12)), F.lit(1.0))))

    weights = [i / steps for i in range(steps + 1)]
    row = scored.agg(*[loss(w).alias(f"w{i}") for i, w in enumerate(weights)])
    return row.select(
        F.inline(F.array(*[F.struct(F.lit(w).alias("weight"), F.col(f"w{i}").alias("log_loss")) for i, w in enumerate(weights)]))
    )


def best_blend(losses: DataFrame) -> DataFrame:
    """M5: weight with the lowest loss, the smallest on ties."""
    return losses.orderBy("log_loss", "weight").limit(1)


def fit_tree_outcome(train: DataFrame, features: Sequence[str], trees: int = 40) -> PipelineModel:
    """Tree-ensemble alternative of the outcome model."""
    ready, stages = preprocessing(train, features)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=5, seed=42)
    return Pipeline(stages=[*stages, forest]).fit(with_label(ready))


def fit_boosted_outcome(train: DataFrame, features: Sequence[str], rounds: int = 20) -> tuple[PipelineModel, dict]:
    """M5: boosted trees, one against the rest for each label: the fitted inputs and a model per label."""
    ready, stages = preprocessing(train, features)
    inputs = Pipeline(stages=stages).fit(ready)
    rows = with_label(inputs.transform(ready)).where("label is not null")
    models = {}
    for i, name in enumerate(LABELS):
        own = rows.select("features", (F.col("label") == i).cast("double").alias("label"))
        models[name] = GBTClassifier(maxIter=rounds, maxDepth=BOOST_DEPTH, stepSize=0.1, subsamplingRate=BOOST_SAMPLE, seed=42).fit(own)
    return inputs, models


def score_boosted(fitted: tuple[PipelineModel, dict], df: DataFrame, features: Sequence[str], prefix: str = "boosted_") -> DataFrame:
    """M5: the three chances, scaled to a sum of one."""
    inputs, models = fitted
    ready, _ = _inputs_only(df, inputs, features)
    rows = inputs.transform(ready)
    for name, model in models.items():
        scored = model.transform(rows)
        rows = scored.select(*rows.columns, vector_to_array("probability")[1].alias(f"_{name}"))
    total = sum((F.col(f"_{name}") for name in LABELS), F.lit(0.0))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_{n}") / total).alias(f"{prefix}{n}") for n in LABELS])


def _arrays(inputs: PipelineModel, ready: DataFrame, columns: Sequence) -> DataFrame:
    return inputs.transform(ready).withColumn("features", vector_to_array("features")).select("features", *columns)


def fit_softmax_outcome(
    train: DataFrame, features: Sequence[str], rounds: int = OUTCOME_ROUNDS, key: Sequence[str] = ("event_id",)
) -> tuple[PipelineModel, boosting.Boosted]:
    """M5: the fitted inputs and boosted trees of the three outcomes under one softmax."""
    ready, stages = preprocessing(train, features)
    inputs = Pipeline(stages=stages).fit(ready)
    settings = boosting.Settings(
        "softmax", len(LABELS), rounds, BOOST_DEPTH, OUTCOME_RATE, BOOST_SAMPLE, BOOST_SAMPLE, OUTCOME_PENALTY
    )
    return inputs, boosting.fit(_arrays(inputs, with_label(ready), ["label", *key]), settings, key=key)


def score_softmax(fitted: tuple[PipelineModel, boosting.Boosted], df: DataFrame, features: Sequence[str], prefix: str = "boosted_") -> DataFrame:
    """M5: the three chances of the boosted trees."""
    inputs, model = fitted
    ready, _ = _inputs_only(df, inputs, features)
    return boosting.predict(_arrays(inputs, ready, [F.col(f"`{c}`") for c in df.columns]), model, [f"{prefix}{n}" for n in LABELS])


def fit_boosted_rate(
    train: DataFrame, features: Sequence[str], target: str, rounds: int = BOOST_ROUNDS, key: Sequence[str] = ("event_id", "team_id")
) -> tuple[PipelineModel, boosting.Boosted]:
    """M7: the fitted inputs and boosted trees with Poisson loss for a count target."""
    ready, stages = preprocessing(train, features, indicators=True)
    inputs = Pipeline(stages=stages).fit(ready)
    settings = boosting.Settings(
        "poisson", 1, rounds, BOOST_DEPTH, BOOST_RATE, BOOST_SAMPLE, BOOST_SAMPLE, most_step=BOOST_STEP
    )
    rows = _arrays(inputs, ready, [F.col(f"`{target}`").alias("label"), *key])
    return inputs, boosting.fit(rows, settings, key=key)


def predict_boosted_rate(
    fitted: tuple[PipelineModel, boosting.Boosted], df: DataFrame, features: Sequence[str], name: str, low: float, high: float | None = None
) -> DataFrame:
    inputs, model = fitted
    ready, _ = _inputs_only(df, inputs, features)
    rows = boosting.predict(_arrays(inputs, ready, [F.col(f"`{c}`") for c in df.columns if c != name]), model, [name])
    return rows.withColumn(name, clip(F.col(name), low, high))


def feature_importances(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Importance of every input of a tree model; a category is ``feature=value``.

    ``features`` are those that the model was fitted with.
    """
    types = dict(df.dtypes)
    categorical = [c for c in features if types[c] in {"string", "boolean"}]
    names = [c for c in features if c not in categorical]
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            for column, labels in zip(categorical, stage.labelsArray, strict=True):
                names += [f"{column}={label}" for label in [*labels, "(other)"]]
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(names, values, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def permutation_importances(
    held_out: DataFrame, score: Callable[[DataFrame], DataFrame], features: Sequence[str], loss: Column,
    key: Sequence[str] = ("event_id",), seed: int = 0,
) -> DataFrame:
    """How much the mean loss on held-out rows grows when one input comes from another row.

    Rows are put in the order of a seeded hash of their key; for each input a shift of its own along that order names the
    row to take it from, so every value is used exactly once. ``score`` sees all inputs' copies and the rows as they are in
    one DataFrame, and ``loss`` is taken over its result. Rows of one key make the order, and so the result, uncertain.
    Fewer than two rows have no other row: their importance is 0. No rows give no result.
    """
    spark = held_out.sparkSession
    seeded = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(f"`{c}`").cast("string") for c in key]))
    rows = cut_lineage(row_positions(held_out.withColumn("_order", seeded), ["_order"], "_at"))
    n = rows.count()
    shifts = [(None, 0)] + [
        (name, 1 + int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:8], 16) % (n - 1) if n > 1 else 0) for name in features
    ]
    copies = F.explode(F.array(*[F.struct(F.lit(c).cast("string").alias("_input"), F.lit(s).cast("long").alias("_shift")) for c, s in shifts]))
    spread = rows.withColumn("_copy", copies).select(
        *[F.col(f"`{c}`") for c in rows.columns], "_copy._input",
        F.when(F.col("_copy._input").isNotNull(), (F.col("_at") - 1 + F.col("_copy._shift")) % max(n, 1) + 1).alias("_from"),
    )
    donors = rows.select(F.col("_at").alias("_from"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(features)]).alias("_donor"))
    mixed = spread.join(donors, "_from", "left").select(
        "_input", *[F.col(f"`{c}`") for c in held_out.columns if c not in features],
        *[F.when(F.col("_input") == c, F.col(f"_donor.c{i}")).otherwise(F.col(f"`{c}`")).alias(c) for i, c in enumerate(features)],
    )
    means = score(mixed).groupBy("_input").agg(F.avg(loss).alias("_loss"))
    base = means.where("_input is null").select(F.col("_loss").alias("loss"))
    names = spark.createDataFrame([(c,) for c in features], "feature string")
    return (
        names.join(means.where("_input is not null"), F.col("feature") == F.col("_input"))
        .join(base)
        .select("feature", "loss", F.col("_loss").alias("permuted_loss"), (F.col("_loss") - F.col("loss")).alias("importance"))
    )


def fit_rate(train: DataFrame, features: Sequence[str], target: str, boosted: bool = False, rounds: int = BOOST_ROUNDS,
    alpha: float = POISSON_ALPHA,
):
    """M6/M7: Poisson regression, or boosted trees, for a count target.

    The penalty stands beside the mean deviance over the rows; Spark divides it by
    the sum of the weights, which is the sum of the target, hence the mean here.
    Spark's boosted trees minimise squared loss.
    """
    ready, stages = preprocessing(train, features, indicators=True)
    if boosted:
        model = GBTRegressor(
            labelCol="target", maxIter=rounds, maxDepth=BOOST_DEPTH, stepSize=BOOST_RATE, subsamplingRate=BOOST_SAMPLE, seed=42
        )
    else:
        mean = train.agg(F.avg(F.col(target).cast("double"))).first()[0] or 1.0
        model = GeneralizedLinearRegression(
            labelCol="target", family="poisson", link="log", regParam=alpha / mean, maxIter=100
        )
    fitted = Pipeline(stages=[*stages, model]).fit(ready.withColumn("target", F.col(target).cast("double")))
    return fitted


def predict_rate(model: PipelineModel, df: DataFrame, features: Sequence[str], name: str, low: float, high: float | None = None):
    ready, _ = _inputs_only(df, model, features)
    scored = model.transform(ready)
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], clip(F.col("prediction"), low, high).alias(name))


def train_scorelines(home_rows: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Expected goals of both sides on the test split, markets and metrics."""
    split = cut_lineage(chronological_split(home_rows))
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    usable = enough_values(train, features, 1)
    out = test
    for target, name in (("goals_for", "home"), ("goals_against", "away")):
        out = predict_rate(fit_rate(train, usable, target), out, usable, f"{name}_xg", 0.05, 6.0)
    metrics = count_metrics(out, "goals_for", "home_xg").withColumn("side", F.lit("home")).unionByName(
        count_metrics(out, "goals_against", "away_xg").withColumn("side", F.lit("away"))
    )
    slim = out.select("event_id", "kickoff_utc", "team_id", "opponent_id", "goals_for", "goals_against", "home_xg", "away_xg")
    return with_prediction_markets(slim, "home_xg", "away_xg", team_lines=(0.5, 1.5, 2.5), top_score=True), metrics


def train_count_market(
    rows: DataFrame, features: Sequence[str], target: str, lines: Sequence[float] = COUNT_LINES, rounds: int = BOOST_ROUNDS
) -> tuple[DataFrame, DataFrame]:
    """M7: Poisson regression against boosted trees with Poisson loss on the test split, the lower MAE wins.

    Returns test predictions with over-line probabilities and one metrics row.
    """
    known = rows.where(F.col(target).isNotNull())
    split = cut_lineage(chronological_split(known))
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    usable = enough_values(train, features, 1)
    both = predict_rate(fit_rate(train, usable, target), test, usable, "poisson_expected", COUNT_FLOOR)
    both = cut_lineage(predict_boosted_rate(fit_boosted_rate(train, usable, target, rounds), both, usable, "boosted_expected", COUNT_FLOOR))
    mae = {
        n: count_metrics(both, target, f"{n}_expected").first()["mae"] for n in ("poisson", "boosted")
    }
    champion = "boosted" if mae["boosted"] < mae["poisson"] else "poisson"
    scored = both.withColumn("expected_count", F.col(f"{champion}_expected"))
    predictions = scored.select(
        "event_id", "team_id", "opponent_id", "kickoff_utc", target, "expected_count",
        *[poisson_over(line, "expected_count").alias(f"prob_over_{str(line).replace('.', '_')}") for line in lines],
    )
    spread = dispersion(train, target).select(F.col("dispersion").alias("negative_binomial_dispersion")).first()[0]
    metrics = count_metrics(scored, target, "expected_count").select(
        "rows", "mae", "poisson_deviance", F.lit(mae["poisson"]).alias("poisson_mae"),
        F.lit(mae["boosted"]).alias("boosted_mae"), F.lit(spread).alias("negative_binomial_dispersion"),
        F.lit(champion).alias("champion"),
    )
    return predictions, metrics


def trainable_targets(master: DataFrame, targets: Sequence[str], least: int = LEAST_TRAINING_ROWS) -> list[str]:
    """M8: targets with enough values to train on."""
    return enough_values(master, [t for t in targets if t in master.columns], least)


def train_all(master: DataFrame, features: Sequence[str], counts: dict[str, Sequence[float]], rounds: int = BOOST_ROUNDS):
    """M8: outcome, scoreline and every count market with enough values."""
    home = master.where((F.col("side") == "home") & F.col("training_eligible"))
    model, outcome = train_outcome(home, features)
    predictions, scorelines = train_scorelines(home, features)
    eligible = master.where("training_eligible")
    markets = {
        t: train_count_market(eligible, features, t, counts[t], rounds) for t in trainable_targets(eligible, list(counts))
    }
    return {"outcome": (model, outcome), "scorelines": (predictions, scorelines), "markets": markets}


def score_fixtures(
    fixture_rows: DataFrame, outcome: PipelineModel, rates: dict[str, PipelineModel], features: Sequence[str], version: str
) -> DataFrame:
    """M9: probabilities, expected goals, markets and model version per fixture."""
    scored = score_outcome(outcome, fixture_rows, features)
    for side in ("home", "away"):
        scored = predict_rate(rates[side], scored, features, f"{side}_rate", 0.05, 6.0)
    return with_prediction_markets(scored, "home_rate", "away_rate").withColumn("model_version", F.lit(version))


def predict_links(
    links: DataFrame,
    payloads: DataFrame,
    cache: DataFrame,
    teams: DataFrame,
    hosts: Sequence[str],
    master: DataFrame,
    outcome: PipelineModel,
    rates: dict[str, PipelineModel],
    features: Sequence[str],
    version: str,
    *,
    newest: str,
    url: str = "url",
) -> tuple[DataFrame, DataFrame]:
    """F17 to M9 in one: match links to predictions; a link that gets none is in the second result with its reason.

    An event is scored once, however many links lead to it. Teams need an earlier match each, and can't meet themselves.
    """
    found, rejected = link_fixtures(links, payloads, cache, teams, hosts, newest=newest, url=url)
    kind = master.schema["kickoff_utc"].dataType
    found = cut_lineage(found.drop("reject_reason").withColumn("kickoff_utc", F.col("kickoff_utc").cast(kind)))
    events = found.drop(url).dropDuplicates(["event_id"])
    rows = cut_lineage(fixture_features(different_teams(events), master, features))
    scored = score_fixtures(rows.where("has_history").drop("has_history"), outcome, rates, features, version)
    known = rows.select("event_id", "has_history")
    unscored = found.select(url, "event_id").join(known, "event_id", "left").where("not coalesce(has_history, false)").select(
        url, "event_id", F.when(F.col("has_history").isNull(), "a team cannot meet itself").otherwise("no earlier match of both teams").alias("reject_reason")
    )
    return found.select(url, "event_id").join(scored, "event_id"), rejected.unionByName(unscored)
