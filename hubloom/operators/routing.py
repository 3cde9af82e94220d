"""Which hub serves an item: a multinomial logistic model of the current routing.

Apart from the price, an item's features depend on its state and group only. So items
are counted per (split, state, group, hub, price), and the fit, its metrics and the
flow matrix run on these counts as weights: the same objective as on the items, on a
table that grows with the number of distinct prices rather than of items.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from hubloom.config import NetworkConfig
from hubloom.operators.costs import known_distance
from hubloom.operators.forecast import assemble, level_index
from hubloom.operators.items import ITEM_KEY
from hubloom.session import materialise, store

# Probabilities are kept this far from 0 and 1 in logarithms (double precision).
EPSILON = 2.0 ** -52

# Items are ordered for the split by a hash of this many bits; its first bits make strips, in
# which items are counted before single ones are looked at.
DRAW_BITS, STRIP_BITS = 60, 16
PROFILE = ["customer_state", "product_group", "hub", "price"]


def split_draw() -> Column:
    """The item's place in the order by which test items are taken: a hash of the item itself.

    The price enters in cents: the textual form of a double differs between engines.
    """
    cents = F.floor(F.col("price") * 100 + F.lit(0.5))
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in ITEM_KEY], cents.cast("string")))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def split_cuts(drawn: DataFrame, config: NetworkConfig) -> DataFrame:
    """Columns hub, cut, taken: test items are those drawn below `cut`, and `taken` of those at it.

    Each hub gives one item in `test_every`, rounded half up. Items are counted by strips of
    the draw; only the strip in which a hub's share is reached is looked at draw by draw, so no
    hub is gathered or sorted. A hub without test items has no row.
    """
    strip = F.shiftright("draw", DRAW_BITS - STRIP_BITS)
    upto = Window.partitionBy("hub").orderBy("strip")
    whole = Window.partitionBy("hub")
    strips = (drawn.groupBy("hub", strip.alias("strip")).agg(F.count("*").alias("n"))
              .withColumn("quota", F.floor(F.sum("n").over(whole) / F.lit(float(config.test_every)) + F.lit(0.5)))
              .withColumn("passed", F.sum("n").over(upto) - F.col("n")))
    last = (strips.where("passed < quota AND quota <= passed + n")
            .select(F.col("hub").alias("of"), F.col("strip").alias("last_strip"), (F.col("quota") - F.col("passed")).alias("need")))
    by_draw = Window.partitionBy("hub").orderBy("draw")
    return (drawn.join(F.broadcast(last), (F.col("hub") == F.col("of")) & (strip == F.col("last_strip")))
            .groupBy("hub", "need", "draw").agg(F.count("*").alias("n"))
            .withColumn("before", F.sum("n").over(by_draw) - F.col("n"))
            .where("before < need AND need <= before + n")
            .select("hub", F.col("draw").alias("cut"), (F.col("need") - F.col("before")).alias("taken")))


def routing_profile(items: DataFrame, config: NetworkConfig) -> DataFrame:
    """Item counts per split, state, group, hub and price; the split is exact within each hub.

    Items drawn alike at a hub's cut are told apart by state, group and price; as only counts
    are wanted, those are divided between the splits without looking at items again.
    """
    drawn = store(items.select(*PROFILE, split_draw().alias("draw")))
    cuts = materialise(split_cuts(drawn, config)).withColumnRenamed("hub", "of")  # a row for each configured hub
    side = (F.when(F.col("draw") < F.col("cut"), "test").when(F.col("draw") == F.col("cut"), "cut").otherwise("train"))
    counted = (drawn.join(F.broadcast(cuts), F.col("hub") == F.col("of"), "left")
               .groupBy(*PROFILE, side.alias("side"), F.when(F.col("draw") == F.col("cut"), F.col("taken")).alias("taken"))
               .agg(F.count("*").alias("n")))
    order = Window.partitionBy("hub").orderBy("customer_state", "product_group", "price")
    at_cut = (counted.where("side = 'cut'").withColumn("before", F.sum("n").over(order) - F.col("n"))
              .withColumn("test", F.greatest(F.least(F.col("taken") - F.col("before"), F.col("n")), F.lit(0)))
              .select(*PROFILE, F.inline(F.array(
                  F.struct(F.lit(True).alias("is_test"), F.col("test").alias("n")),
                  F.struct(F.lit(False).alias("is_test"), (F.col("n") - F.col("test")).alias("n"))))))
    clear = counted.where("side <> 'cut'").select(*PROFILE, (F.col("side") == "test").alias("is_test"), "n")
    return (clear.unionByName(at_cut.where("n > 0")).groupBy("is_test", *PROFILE).agg(F.sum("n").alias("n")))


def distance_columns(config: NetworkConfig) -> list[str]:
    return [f"dist_{hub}" for hub in config.hubs]


def wide_distances(distances: DataFrame, config: NetworkConfig) -> DataFrame:
    """Distances to all hubs per state, in thousands of kilometres."""
    return distances.groupBy("customer_state").agg(*[
        (F.max(F.when(F.col("hub") == hub, F.col("km"))) / F.lit(1000.0)).alias(name)
        for hub, name in zip(config.hubs, distance_columns(config))])


def routing_features(rows: DataFrame, distances: DataFrame, config: NetworkConfig) -> DataFrame:
    """Add the distances to all hubs and the log price; a state without distances is an error."""
    known = {name: known_distance(F.col("customer_state"), F.col(name)) for name in distance_columns(config)}
    return (rows.join(F.broadcast(wide_distances(distances, config)), "customer_state", "left")
            .withColumns(known).withColumn("log_price", F.log1p("price")))


def routing_design(rows: DataFrame, distances: DataFrame, config: NetworkConfig) -> DataFrame:
    """Feature vectors and the hub's class index, labelled so that no class is lost."""
    frame = routing_features(rows, distances, config)
    design = assemble(frame, [*distance_columns(config), "log_price"],
                      {"product_group": tuple(sorted(config.groups)),
                       "customer_state": tuple(sorted(config.states))})
    return design.select("*", level_index("hub", config.hubs, "label"))


@dataclass(frozen=True)
class RoutingModel:
    intercepts: np.ndarray  # by hub; minus infinity for a hub without training items
    coefficients: np.ndarray  # hub x feature, features as in `routing_design`
    steps: int
    scored: DataFrame  # profile rows with `proba`, P(hub) in hub order


@dataclass(frozen=True)
class Cells:
    """The features of each configured (state, group) but for the price, which enters as z = log1p(price)."""

    names: list[tuple[str, str]]
    fixed: np.ndarray  # cell x feature, the last one constant 1; 0 at `z`, nan without distances
    z: int

    @staticmethod
    def of(distances: DataFrame, config: NetworkConfig) -> Cells:
        states, groups, hubs = sorted(config.states), sorted(config.groups), len(config.hubs)
        km = {r["customer_state"]: [r[c] for c in distance_columns(config)] for r in wide_distances(distances, config).collect()}
        names = [(state, group) for state in states for group in groups]
        fixed = np.zeros((len(names), hubs + 1 + len(groups) + len(states) + 1))
        for row, (state, group) in zip(fixed, names):
            row[:hubs] = [np.nan if d is None else d for d in km.get(state, [None] * hubs)]
            row[hubs + 1 + groups.index(group)] = row[hubs + 1 + len(groups) + states.index(state)] = row[-1] = 1.0
        return Cells(names, fixed, hubs)

    def index(self) -> Column:
        """Number of the row's cell, null for others."""
        return F.array_position(F.lit(["|".join(n) for n in self.names]), F.concat_ws("|", "customer_state", "product_group")) - 1

    def scores(self, weights: np.ndarray) -> list[str]:
        """Log of P(hub) of a row, up to a constant, from hub x feature weights, as SQL.

        Weights stand in arrays that are looked up by cell, slopes too: so every step of a fit
        runs the same compiled code.
        """
        def of_cell(values: np.ndarray) -> str:
            return f"get(array({', '.join(f'{float(v)!r}D' for v in values)}), int(cell))"

        bases = self.fixed @ weights.T
        return [f"{of_cell(bases[:, k])} + {of_cell(np.full(len(bases), weights[k, self.z]))} * z" for k in range(len(weights))]


def with_shares(rows: DataFrame, scores: list[str]) -> DataFrame:
    """Add p0, p1, ...: P(hub) of each score, and log_total: the log of the sum of their exponentials."""
    hubs = range(len(scores))
    scored = rows.selectExpr("*", *[f"{score} AS s{k}" for k, score in enumerate(scores)])
    scored = scored.selectExpr("*", f"array_max(array({', '.join(f's{k}' for k in hubs)})) AS top")
    scored = scored.selectExpr("*", *[f"exp(s{k} - top) AS e{k}" for k in hubs])
    scored = scored.selectExpr("*", f"{' + '.join(f'e{k}' for k in hubs)} AS total")
    return scored.selectExpr("*", *[f"e{k} / total AS p{k}" for k in hubs], "ln(total) + top AS log_total")


def newton_sums(train: DataFrame, cells: Cells, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the summed loss at `weights`, from one aggregation by cell.

    Within a cell the features are the cell's plus z along one axis, so sums of n p, of
    n p (1 - q) and of these times z and z^2 give both exactly, whatever the number of rows.
    """
    hubs, size = weights.shape
    pairs = [(a, b) for a in range(hubs) for b in range(a, hubs)]
    own = f"get(array({', '.join(f's{k}' for k in range(hubs))}), int(label))"
    sums = [f"sum(n * (log_total - {own})) AS loss"]
    for k in range(hubs):
        excess = f"n * (p{k} - double(label = {k}))"
        sums += [f"sum({excess}) AS g{k}", f"sum({excess} * z) AS gz{k}"]
    for a, b in pairs:
        curve = f"n * p{a} * ({int(a == b)} - p{b})"
        sums += [f"sum({curve}) AS h{a}_{b}", f"sum({curve} * z) AS hz{a}_{b}", f"sum({curve} * z * z) AS hzz{a}_{b}"]
    by_cell = with_shares(train, cells.scores(weights)).groupBy("cell").agg(*map(F.expr, sums))
    rows = by_cell.collect()  # a row for each configured state and group
    loss = sum(r["loss"] for r in rows)
    gradient, hessian = np.zeros((hubs, size)), np.zeros((hubs, size, hubs, size))
    along = np.zeros(size)
    along[cells.z] = 1.0
    for r in rows:
        x = cells.fixed[r["cell"]]
        for k in range(hubs):
            gradient[k] += r[f"g{k}"] * x + r[f"gz{k}"] * along
        for a, b in pairs:
            block = (r[f"h{a}_{b}"] * np.outer(x, x) + r[f"hz{a}_{b}"] * (np.outer(x, along) + np.outer(along, x))
                     + r[f"hzz{a}_{b}"] * np.outer(along, along))
            hessian[a, :, b] += block
            if a != b:
                hessian[b, :, a] += block.T
    return loss, gradient, hessian


def fit_routing(profile: DataFrame, distances: DataFrame, config: NetworkConfig) -> RoutingModel:
    """Weighted multinomial fit by Newton steps, on the training split.

    Minimises the summed loss times C plus half the squared coefficients, intercepts free. A
    step is one aggregation of `profile`, which should be a written table; a step that would
    raise the objective is halved. A hub without training items has probability 0.
    """
    cells = Cells.of(distances, config)
    rows = profile.withColumns({"cell": cells.index(), "z": F.log1p("price"), "label": level_index("hub", config.hubs, "label")})
    seen = rows.groupBy("cell", "customer_state", F.when(~F.col("is_test"), F.col("label")).alias("label")).agg(F.sum("n").alias("n")).collect()
    unknown = sorted({r["customer_state"] for r in seen if r["cell"] is None or np.isnan(cells.fixed[r["cell"]]).any()})
    if unknown:
        raise ValueError(f"no distance for state {unknown[0]}")
    classes = sorted({int(r["label"]) for r in seen if r["label"] is not None})
    items = sum(r["n"] for r in seen if r["label"] is not None)
    if not items:
        raise ValueError("no training items")
    train = rows.where(~F.col("is_test")).withColumn(
        "label", F.array_position(F.lit([float(c) for c in classes]), F.col("label")) - 1)
    cells = Cells(cells.names, np.nan_to_num(cells.fixed), cells.z)

    size = cells.fixed.shape[1]
    penalty = np.append(np.full(size - 1, 1.0 / config.inverse_l2), 0.0)
    # One constant added to all intercepts changes nothing; this keeps the system regular.
    level = np.zeros((len(classes), size, len(classes), size))
    level[:, -1, :, -1] = items / len(classes)
    weights, step, before, steps = np.zeros((len(classes), size)), None, np.inf, 0
    while True:
        if steps >= config.logistic_max_iter:
            raise RuntimeError(f"the routing fit has not converged in {config.logistic_max_iter} iterations")
        steps += 1
        loss, gradient, hessian = newton_sums(train, cells, weights)
        objective = loss + 0.5 * (penalty * weights ** 2).sum()
        if step is not None and objective > before + 1e-9 * abs(before):
            step = step / 2
            weights = weights + step
            continue
        gradient = gradient + penalty * weights
        system = (hessian + level).reshape(weights.size, weights.size) + np.diag(np.tile(penalty, len(classes)))
        step = np.linalg.solve(system, gradient.ravel()).reshape(weights.shape)
        before, weights = objective, weights - step
        if (gradient * step).sum() <= config.logistic_tol * items:  # what a further step could gain
            break
    fitted = np.zeros((len(config.hubs), size))
    fitted[:, -1] = -np.inf
    fitted[classes] = weights
    proba = F.array(*[F.col(f"p{classes.index(k)}") if k in classes else F.lit(0.0) for k in range(len(config.hubs))])
    scored = with_shares(rows, cells.scores(weights)).select(
        "is_test", "customer_state", "product_group", "hub", "n", F.col("label").cast("int").alias("label"), proba.alias("proba"))
    return RoutingModel(fitted[:, -1], fitted[:, :-1], steps, scored)


def model_flows(scored: DataFrame, config: NetworkConfig) -> DataFrame:
    """Mean predicted probability of each hub per state, over all items."""
    means = F.array(*[F.struct(
        F.lit(hub).alias("hub"),
        (F.sum(F.col("proba")[i] * F.col("n")) / F.sum("n")).alias("p"))
        for i, hub in enumerate(config.hubs)])
    return (scored.groupBy("customer_state").agg(means.alias("hubs"))
            .select("customer_state", F.inline("hubs")))


def _log_loss(p: Column) -> Column:
    return -F.log(F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1.0 - EPSILON)))


def routing_metrics(scored: DataFrame) -> DataFrame:
    """Accuracy and log loss of the model on the test split."""
    predicted = F.array_position("proba", F.array_max("proba")) - 1
    items = F.sum("n")
    return scored.where("is_test").agg(
        items.alias("test_items"),
        (F.sum(F.when(predicted == F.col("label"), F.col("n")).otherwise(0)) / items)
        .alias("accuracy"),
        (F.sum(_log_loss(F.get("proba", F.col("label"))) * F.col("n")) / items).alias("log_loss"))


def hub_split(profile: DataFrame) -> DataFrame:
    return profile.groupBy("hub", "is_test").agg(F.sum("n").alias("items"))


def baseline_metrics(profile: DataFrame, config: NetworkConfig) -> DataFrame:
    """Share of the largest hub in the test split, and the log loss of predicting the
    training shares for every test item."""
    by_hub = profile.groupBy("hub").agg(
        F.sum(F.when(F.col("is_test"), F.col("n")).otherwise(0)).alias("test"),
        F.sum(F.when(F.col("is_test"), 0).otherwise(F.col("n"))).alias("train"))
    train_total = by_hub.agg(F.sum("train")).scalar()
    test_total = F.sum("test")
    return by_hub.withColumn("share", F.col("train") / train_total).agg(
        test_total.alias("test_items"),
        (F.max("test") / test_total).alias("majority_accuracy"),
        (F.sum(F.col("test") * _log_loss(F.col("share"))) / test_total)
        .alias("share_baseline_log_loss"))


def flow_fit(model: DataFrame, empirical: DataFrame) -> DataFrame:
    """Largest difference between model and empirical flow per state."""
    return (model.join(empirical.select("customer_state", "hub", F.col("p").alias("observed")),
                       ["customer_state", "hub"])
            .groupBy("customer_state")
            .agg(F.max(F.abs(F.col("p") - F.col("observed"))).alias("max_abs_diff")))
