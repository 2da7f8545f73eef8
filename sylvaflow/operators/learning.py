"""Exact stratified splits, folds, forests and feature selection."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from math import comb, floor, gcd, sqrt
from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from sylvaflow.operators import forests
from sylvaflow.operators.evaluation import evaluation
from sylvaflow.operators.stages import stored
from sylvaflow.operators.tables import drop_constant, impute_median, small


def chance(key: str, seed: int) -> Column:
    """A pseudo-random order that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def _ranked(frame: DataFrame, label: str, key: str, seed: int, buckets: int = 256) -> DataFrame:
    """frame with _k, the place of each row within its label in chance() order, and _n, its label's rows.

    A label may hold most rows, so it isn't one window: rows are ranked within buckets of the order's first
    two digits, and the sizes of the buckets before, labels x 256 numbers, are added."""
    order = frame.withColumn("_o", chance(key, seed)).withColumn("_bucket", F.substring("_o", 1, 2))
    sizes = order.groupBy(label, "_bucket").agg(F.count("*").alias("_size"))
    line = Window.partitionBy(label).orderBy("_bucket")
    before = sizes.select(F.col(label).alias("_l"), F.col("_bucket").alias("_b"), (F.sum("_size").over(line) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy(label)).alias("_n"))
    place = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_o", key))
    joined = order.withColumn("_r", place).join(before, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("_k", F.col("_r") + F.col("_before")).drop("_o", "_bucket", "_l", "_b", "_before", "_r")


def split_train_test(frame: DataFrame, label: str, key: str, ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """Column `split`: of each label the first bround(n * ratio) rows in chance order are train."""
    out = _ranked(frame, label, key, seed)
    return out.withColumn("split", F.when(F.col("_k") <= F.bround(F.col("_n") * F.lit(ratio)), "train").otherwise("test")).select(*frame.columns, "split")


def split_three(frame: DataFrame, label: str, key: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    out = _ranked(frame, label, key, seed)
    a, b = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(val))
    return out.withColumn("split", F.when(F.col("_k") <= a, "train").when(F.col("_k") <= a + b, "val").otherwise("test")).select(*frame.columns, "split")


def folds(frame: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Column `fold`, 0 .. k - 1, of equal shares of each label."""
    return _ranked(frame, label, key, seed).withColumn("fold", (F.col("_k") - 1) % k).select(*frame.columns, "fold")


def _cores(frame: DataFrame) -> int:
    return frame.sparkSession.sparkContext.defaultParallelism


def _fit(ready: DataFrame, features: list[str], label: str, trees: int, depth: int, seed: int, weighted: bool, cuts: forests.Cuts | None = None, labels: list[str] | None = None) -> forests.Forest:
    """A forest of rows whose features have values and vary."""
    return forests.train(ready, features, label, trees, depth, seed, "_w" if weighted else None, cuts, labels)


def train_forest(frame: DataFrame, features: list[str], label: str, trees: int = 500, depth: int = 12, seed: int = 42, weight: bool = True, parts: int | None = None) -> forests.Forest:
    """Random forest with sqrt(p) features a split and, by default, class weights N / (K n).

    The rows are made once and dealt over all cores, or into `parts`, as constants, medians, weights and the forest
    pass over them."""
    known = stored(frame.select(*dict.fromkeys([label, *features])).repartition(parts or _cores(frame)), "training")
    usable = drop_constant(known, features)
    ready = impute_median(known.filter(F.col(label).isNotNull()), usable)
    if weight:
        counts = ready.groupBy(label).agg(F.count("*").alias("_c"))
        total, k = counts.agg(F.sum("_c"), F.count("*")).first()
        ready = ready.join(small(counts), label).withColumn("_w", F.lit(float(total)) / (F.lit(k) * F.col("_c")))
    return _fit(ready, usable, label, trees, depth, seed, weight)


def predict(model: forests.Forest, frame: DataFrame, keep: list[str]) -> DataFrame:
    """keep, probability (array), predicted label, confidence. Nulls take the batch's medians."""
    missing = [c for c in model.features if c not in frame.columns]
    ready = impute_median(frame.withColumns({c: F.lit(0.0) for c in missing}), model.features)
    out = model.transform(ready, keep)
    name = F.element_at(F.array(*map(F.lit, model.labels)), F.array_position("probability", F.array_max("probability")).cast("int"))
    return out.withColumns({"predicted": name, "confidence": F.array_max("probability")})


def importance(model: forests.Forest) -> list[tuple[str, float]]:
    return sorted(zip(model.features, model.importances()), key=lambda x: (-x[1], x[0]))


def cross_validate(frame: DataFrame, features: list[str], label: str, key: str, k: int = 5, repeats: int = 3, trees: int = 500, seed: int = 42, side: int = 4) -> list[dict]:
    """Scores of each fold of each repeat.

    `side` forests grow side by side, so that the short steps of one fill the waits of others; their trees lie in tables.
    Rows with their folds, and predictions, are made once, as training, medians and scores pass over them."""
    parts = max(1, _cores(frame) // side)
    rows = frame.select(*dict.fromkeys([key, label, *features]))
    dealt = [stored(folds(rows, label, key, k, seed + r), "folds") for r in range(repeats)]

    def scores(r: int, f: int) -> dict:
        model = train_forest(dealt[r].filter(F.col("fold") != f), features, label, trees, seed=seed + r, parts=parts)
        scored = stored(predict(model, dealt[r].filter(F.col("fold") == f), [key, label]), "scored")
        return {"repeat": r, "fold": f, **evaluation(scored, label, "predicted").first().asDict()}

    runs = [(r, f) for r in range(repeats) for f in range(k)]
    with ThreadPoolExecutor(side) as pool:
        return list(pool.map(inheritable_thread_target(frame.sparkSession)(scores), *zip(*runs)))


def _tail(hits: int, runs: int) -> float:
    """Chance of `hits` or more of fair tosses."""
    return sum(comb(runs, i) for i in range(hits, runs + 1)) / 2**runs


def _numbered(frame: DataFrame, key: str, seed: int) -> DataFrame:
    """frame with _i, a number from 0 to the number of rows less 1 in chance order; no task holds the column."""
    return _ranked(frame.withColumn("_all", F.lit(0)), "_all", key, seed).withColumn("_i", F.col("_k").cast("long") - 1).drop("_all", "_k", "_n")


def _bijections(columns: int, n: int, seed: int) -> list[tuple[int, int]]:
    """Factors without a common divisor with n, and shifts: i to (factor * i + shift) modulo n meets each row once."""
    chosen = random.Random(seed)
    most, out = max(1, min(n - 1, (2**62) // max(n, 1))), []
    while len(out) < columns:
        factor = chosen.randint(1, most)
        if gcd(factor, n) == 1:
            out.append((factor, chosen.randrange(n)))
    return out


def with_shadows(numbered: DataFrame, n: int, shadows: list[str], seed: int) -> DataFrame:
    """numbered(_i, ...) with shadow_0, shadow_1 ...: each a copy of a column whose values have changed rows by a
    bijection of its own. Every row sends itself and each copied value to the rows they belong to, so one shuffle
    serves all columns."""
    keyed = _bijections(len(shadows), n, seed)
    rest = [c for c in numbered.columns if c != "_i"]
    none = F.lit(None)
    own = F.struct(F.col("_i").alias("to"), F.lit(-1).alias("j"), F.lit(None).cast("double").alias("v"), F.struct(*rest).alias("row"))
    kind = numbered.select(F.struct(*rest).alias("row")).schema["row"].dataType
    sent = [F.struct(F.pmod(F.col("_i") * factor + shift, F.lit(n)).alias("to"), F.lit(j).alias("j"), F.col(c).cast("double").alias("v"), none.cast(kind).alias("row")) for j, (c, (factor, shift)) in enumerate(zip(shadows, keyed))]
    dealt = numbered.select(F.explode(F.array(own, *sent)).alias("e")).select("e.*")
    met = dealt.repartition(_cores(numbered), "to").groupBy("to").agg(F.first("row", ignorenulls=True).alias("row"), F.sort_array(F.collect_list(F.when(F.col("j") >= 0, F.struct("j", "v")))).alias("s"))
    return met.select("row.*", *(F.col("s")[j]["v"].alias(f"shadow_{j}") for j in range(len(shadows))))


def select_by_shadows(frame: DataFrame, features: list[str], label: str, key: str, runs: int = 100, trees: int = 200, p: float = 0.01, seed: int = 42, depth: int = 8) -> list[tuple[str, str, float]]:
    """(feature, decision, mean importance) by importance, constant features left out.

    In each run a forest sees the features that aren't rejected and as many shadows, five at least. A feature has a
    hit if it beats the best shadow; it is confirmed or rejected once its hits are too many or too few to be chance
    at p over the number of features. Rejected ones drop out of further runs, and runs end when all are decided.
    What is still open is confirmed if its median importance beats the median of the best shadows'. Nulls take the
    median; rows are made and numbered once, a shadow has its column's thresholds, and each run is one shuffle into a
    part for every core, whose rows are written as bytes.
    """
    frame = stored(frame.select(*dict.fromkeys([key, label, *features])), "features")
    usable = drop_constant(frame, features)
    if not usable:
        return []
    ready = impute_median(frame.filter(F.col(label).isNotNull()), usable).select(key, label, *usable)
    numbered = stored(_numbered(ready, key, seed), "numbered")
    n, level = numbered.count(), p / len(usable)
    labels = sorted(r[0] for r in numbered.select(F.col(label).cast("string")).distinct().collect())
    known = forests.thresholds(forests.written(forests.values(numbered, usable, label, None), "values"), frame.sparkSession, usable)
    hits, seen, decided, bars = dict.fromkeys(usable, 0), {c: [] for c in usable}, {}, []
    for run in range(1, runs + 1):
        active = [c for c in usable if decided.get(c) != "rejected"]
        if all(c in decided for c in usable) or not active:
            break
        shadows = [active[k % len(active)] for k in range(max(5, len(active)))]
        both = with_shadows(numbered, n, shadows, seed * 1_000_003 + run)
        cuts = known | {f"shadow_{j}": known[c] for j, c in enumerate(shadows)}
        model = _fit(both, [*active, *(f"shadow_{j}" for j in range(len(shadows)))], label, trees, depth, seed + run, False, cuts, labels)
        scores = dict(importance(model))
        bars.append(max((v for c, v in scores.items() if c.startswith("shadow_")), default=0.0))
        for c in active:
            seen[c].append(scores.get(c, 0.0))
            hits[c] += seen[c][-1] > bars[-1]
            if c not in decided and _tail(hits[c], run) < level:
                decided[c] = "confirmed"
            elif c not in decided and _tail(run - hits[c], run) < level:
                decided[c] = "rejected"
    for c in usable:
        decided.setdefault(c, "confirmed" if seen[c] and median(seen[c]) > median(bars) else "rejected")
    mean = {c: sum(v) / len(v) if v else 0.0 for c, v in seen.items()}
    return sorted(((c, decided[c], mean[c]) for c in usable), key=lambda x: (-x[2], x[0]))


def features_per_split(n: int) -> int:
    return floor(sqrt(n))
