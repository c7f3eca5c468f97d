"""Evaluation.

Every class metric comes from one ``groupBy(y_true, y_pred).count()`` — at most
k² rows however many predictions there are. ROC / AUC group by score first, then
take running sums by the bucketed two-level scheme (no global sort, no single task).
Ratios go through ``try_divide`` (ANSI: 0/0 would throw); ``zero_division=0``
is applied only where the reference applies it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .small import checkpointed

ROWS_PER_BUCKET = 500_000  # distinct scores per window partition of a running total


def _z(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def pair_counts(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    return df.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")) \
        .agg(F.count(F.lit(1)).cast("long").alias("count"))


def macro_f1_of(counts: dict) -> float:
    """E3 from the cells of a confusion table, {(true, predicted): count}; 0 without any."""
    both: dict = {}  # 2 tp + fp + fn of each label
    for pair, n in counts.items():
        for k in pair:
            both[k] = both.get(k, 0) + n
    f1 = [2 * counts.get((k, k), 0) / n if n else 0.0 for k, n in both.items()]
    return sum(sorted(f1)) / len(f1) if f1 else 0.0


def macro_f1_values(df: DataFrame, y_true: str, y_preds: Sequence[str]) -> list[float]:
    """E3 of several prediction columns of one table, in one scan and one shuffle; the cells (at most k² a column)
    reach the driver."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("p")) for i, c in enumerate(y_preds)]))
    cells = df.select(F.col(y_true).cast("string").alias("y"), each.alias("e")).groupBy("e.i", "y", "e.p").agg(F.count(F.lit(1)).alias("n")).collect()
    return [macro_f1_of({(r["y"], r["p"]): r["n"] for r in cells if r["i"] == i}) for i in range(len(y_preds))]


def macro_f1_by(cells: DataFrame, keys: list[str]) -> DataFrame:
    """E3 of many confusion tables at once, from their cells (keys, y_true, y_pred, count)."""
    each = F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.lit(1).alias("side")),
                             F.struct(F.col("y_pred").alias("label"), F.lit(0).alias("side")))).alias("s")
    hit = F.col("y_true").eqNullSafe(F.col("y_pred"))
    long = cells.select(*keys, each, "count", hit.alias("hit"))
    label = long.groupBy(*keys, F.col("s.label").alias("label")).agg(
        F.sum("count").alias("both"), F.sum(F.when(F.col("hit") & (F.col("s.side") == 1), F.col("count")).otherwise(0)).alias("tp"))
    return label.groupBy(*keys).agg(F.avg(_z(F.try_divide(2.0 * F.col("tp"), F.col("both")))).alias("macro_f1"))


def confusion(df: DataFrame, y_true: str, y_pred: str, labels: Sequence | None = None) -> DataFrame:
    """Long confusion table (y_true, y_pred, count) with zero cells filled.

    The k×k grid is generated from one row that holds the k labels, by two generators.
    """
    cnt = checkpointed(pair_counts(df, y_true, y_pred))  # ≤ k² rows; the data is scanned once
    dtype = df.schema[y_true].dataType
    if labels is not None:
        one = df.sparkSession.range(1).select(
            F.array(*[F.struct(F.lit(v).cast(dtype).alias("label")) for v in labels]).alias("all"))
    else:
        seen = cnt.select(F.explode(F.array(F.struct(F.col("y_true").alias("label")),
                                            F.struct(F.col("y_pred").cast(dtype).alias("label")))).alias("s"))
        one = seen.agg(F.sort_array(F.collect_set("s")).alias("all"))
    grid = one.select("all", F.explode("all").alias("t")).select(
        F.col("t.label").alias("g_true"), F.explode("all").alias("p")).select("g_true", F.col("p.label").alias("g_pred"))
    cells = cnt.toDF("c_true", "c_pred", "n")
    cond = F.col("g_true").eqNullSafe(F.col("c_true")) & F.col("g_pred").eqNullSafe(F.col("c_pred"))
    return grid.join(cells, cond, "left").select(F.col("g_true").alias("y_true"), F.col("g_pred").alias("y_pred"),
                                                 F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def confusion_normalized(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Each row divided by its row total (empty row → null, as numpy gives NaN)."""
    c = confusion(df, y_true, y_pred)
    return c.withColumn("share", F.try_divide(F.col("count").cast("double"),
                                              F.sum("count").over(Window.partitionBy("y_true"))))


def per_class(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """tp, fp, fn, support per label of the union — from the k² pair table."""
    cnt = pair_counts(df, y_true, y_pred)
    as_true = cnt.groupBy(F.col("y_true").alias("label")).agg(
        F.sum("count").alias("support"),
        F.sum(F.when(F.col("y_true").eqNullSafe(F.col("y_pred")), F.col("count")).otherwise(0)).alias("tp"))
    as_pred = cnt.groupBy(F.col("y_pred").alias("label")).agg(F.sum("count").alias("n_pred"))
    j = as_true.join(as_pred, as_true["label"].eqNullSafe(as_pred["label"]), "full")
    tp = F.coalesce(F.col("tp"), F.lit(0)).cast("long")
    sup = F.coalesce(F.col("support"), F.lit(0)).cast("long")
    npred = F.coalesce(F.col("n_pred"), F.lit(0)).cast("long")
    return j.select(F.coalesce(as_true["label"], as_pred["label"]).alias("label"),
                    tp.alias("tp"), (npred - tp).alias("fp"), (sup - tp).alias("fn"), sup.alias("support"))


def class_report(df: DataFrame, y_true: str, y_pred: str, with_kind: bool = False) -> DataFrame:
    """Precision, recall, F1, support per class, plus accuracy / macro avg /
    weighted avg rows (``classification_report(zero_division=0)`` layout). ``with_kind`` adds a column that
    tells a class from a summary row, whatever the classes are called."""
    pc = per_class(df, y_true, y_pred)
    tp, fp, fn, sup = (F.col(c) for c in ("tp", "fp", "fn", "support"))
    rows = pc.select(
        F.col("label").cast("string").alias("class"), F.lit("class").alias("kind"),
        _z(F.try_divide(tp, tp + fp)).alias("precision"),
        _z(F.try_divide(tp, tp + fn)).alias("recall"),
        _z(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        sup.alias("support"),
        tp.alias("tp"),
    )
    total = F.sum("support")
    summary = rows.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        _z(F.try_divide(F.sum(F.col("precision") * F.col("support")), total)).alias("wp"),
        _z(F.try_divide(F.sum(F.col("recall") * F.col("support")), total)).alias("wr"),
        _z(F.try_divide(F.sum(F.col("f1") * F.col("support")), total)).alias("wf"),
        total.cast("long").alias("n"),
        _z(F.try_divide(F.sum("tp"), total)).alias("acc"),
    )
    extra = summary.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit("summary").alias("kind"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"), F.col("n").alias("support")),
        *[F.struct(F.lit(name).alias("class"), F.lit("summary").alias("kind"), F.col(p).alias("precision"), F.col(r).alias("recall"),
                   F.col(f).alias("f1"), F.col("n").alias("support"))
          for name, p, r, f in (("macro avg", "mp", "mr", "mf"), ("weighted avg", "wp", "wr", "wf"))],
    )).alias("r")).select("r.*")
    out = rows.drop("tp").unionByName(extra)
    return out if with_kind else out.drop("kind")


def macro_f1(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Mean over the label union of 2tp/(2tp+fp+fn), 0/0 → 0."""
    pc = per_class(df, y_true, y_pred)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return pc.agg(F.avg(_z(F.try_divide(2 * tp, 2 * tp + fp + fn))).alias("macro_f1"),
                  F.count(F.lit(1)).cast("long").alias("n_labels"))


def accuracy(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """E5."""
    hit = F.col(y_true).eqNullSafe(F.col(y_pred)).cast("long")
    return df.agg(F.try_divide(F.sum(hit), F.count(F.lit(1))).alias("accuracy"))


def f1_compare(report_a: DataFrame, report_b: DataFrame, name_a: str = "single_f1",
               name_b: str = "two_stage_f1") -> DataFrame:
    """Per-class F1 of two models side by side, improvement = b − a, by class. The reports are
    ``class_report(…, with_kind=True)``; a null class and one named like a summary row are classes."""
    a = report_a.where("kind = 'class'").select(F.col("class").alias("a_class"), F.lit(1).alias("in_a"), F.col("f1").alias(name_a))
    b = report_b.where("kind = 'class'").select(F.col("class").alias("b_class"), F.col("f1").alias(name_b))
    j = a.join(b, a["a_class"].eqNullSafe(b["b_class"]), "full")
    name = F.when(F.col("in_a") == 1, F.col("a_class")).otherwise(F.col("b_class"))
    return j.select(name.alias("class"), _z(F.col(name_a)).alias(name_a), _z(F.col(name_b)).alias(name_b),
                    (_z(F.col(name_b)) - _z(F.col(name_a))).alias("improvement")).orderBy("class")


# ---------------------------------------------------------------------------
# score-based metrics
# ---------------------------------------------------------------------------

def score_groups(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg) per distinct score — the only input ROC/AUC need."""
    y = F.col(label)
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(y == 1, 0).otherwise(1)).cast("long").alias("neg"))


def running_totals(groups: DataFrame, key: str, values: Sequence[str], descending: bool,
                   rows_per_bucket: int = ROWS_PER_BUCKET, inclusive: bool = True) -> DataFrame:
    """Running sums of ``values`` over ``key`` order, without a single-task window.

    Distinct keys are bucketed at approximate quantiles of the keys themselves
    (one boundary per ``rows_per_bucket`` keys is fetched to the driver), so buckets
    hold about equally many keys however many there are and however skewed the scores;
    bucket totals give offsets, and the window runs inside each bucket. Exact: the buckets are
    monotone in the key, only their sizes are approximate.
    """
    bins = max(2, -(-groups.count() // rows_per_bucket))
    probs = [i / bins for i in range(1, bins)]
    q = groups.agg(F.percentile_approx(F.col(key).cast("double"), probs, 10 * bins).alias("q")).first()["q"]
    from pyspark.ml.feature import Bucketizer
    cuts = sorted(set(float(x) for x in q or () if x == x and abs(x) != float("inf"))) or [0.0]
    # bucket = number of cut points ≤ key, by binary search (NaN keys → last bucket,
    # as Spark orders NaN above every number)
    splits = [float("-inf"), *cuts, float("inf")]
    t = Bucketizer(splits=splits, inputCol="_k", outputCol="_bk", handleInvalid="keep") \
        .transform(groups.withColumn("_k", F.col(key).cast("double")))
    b = F.col("_bk").cast("int")
    if descending:
        b = F.lit(len(splits)) - b
    t = t.withColumn("_b", b).drop("_k", "_bk")
    tot = t.groupBy("_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    wo = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(F.col("_b").alias("_ob"),
                     *[F.coalesce(F.sum(f"_t_{v}").over(wo), F.lit(0)).alias(f"_o_{v}") for v in values])
    j = t.join(off, t["_b"] == off["_ob"], "inner")
    order = F.col(key).desc() if descending else F.col(key).asc()
    wi = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding,
                                                              0 if inclusive else -1)
    return j.select(*groups.columns, *[
        (F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(wi), F.lit(0))).cast("long").alias(f"cum_{v}")
        for v in values])


def roc_points(df: DataFrame, label: str, score: str, drop_intermediate: bool = False) -> DataFrame:
    """One point per distinct score (descending), plus the origin at +inf;
    rate 0/0 (one class absent) → null.

    ``drop_intermediate=True`` keeps, like ``roc_curve``'s default, only the
    first and last thresholds and those where the curve bends (a non-zero second
    difference of tp or fp). Neighbours are found by numbering the thresholds
    (bucketed running count) and equi-joining on index ± 1 — no single-task window.
    """
    g = checkpointed(score_groups(df, label, score))  # read 3×: run the scan/join once
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                F.count(F.lit(1)).alias("K")).first()  # one row
    P, N = F.lit(tot["P"] or 0).cast("double"), F.lit(tot["N"] or 0).cast("double")
    g1 = g.withColumn("one", F.lit(1).cast("long"))
    r = running_totals(g1, "score", ["pos", "neg", "one"], descending=True)
    pts = r.select(F.col("score").alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                   F.col("cum_one").alias("i"))
    if drop_intermediate and (tot["K"] or 0) > 2:
        prev = pts.select((F.col("i") + 1).alias("i"), F.col("tp").alias("tp_p"), F.col("fp").alias("fp_p"))
        nxt = pts.select((F.col("i") - 1).alias("i"), F.col("tp").alias("tp_n"), F.col("fp").alias("fp_n"))
        j = pts.join(prev, "i", "left").join(nxt, "i", "left")
        bend = ((F.col("tp_n") - 2 * F.col("tp") + F.col("tp_p")) != 0) | \
               ((F.col("fp_n") - 2 * F.col("fp") + F.col("fp_p")) != 0)
        pts = j.where(F.col("tp_p").isNull() | F.col("tp_n").isNull() | bend).select("threshold", "tp", "fp", "i")
    pts = pts.drop("i")
    origin = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"),
                                             F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    return pts.unionByName(origin).select(
        "threshold", "tp", "fp",
        F.try_divide(F.col("tp").cast("double"), P).alias("tpr"),
        F.try_divide(F.col("fp").cast("double"), N).alias("fpr"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """AUC with ties counted half = Σ pos(s)·(neg below s + neg(s)/2) / (P·N)."""
    g = checkpointed(score_groups(df, label, score))
    r = running_totals(g, "score", ["neg"], descending=False, inclusive=False)
    return r.agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") + F.col("neg") * F.lit(0.5))),
                     (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"),
        F.sum("pos").cast("long").alias("n_pos"), F.sum("neg").cast("long").alias("n_neg"))


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Precision / recall / F1 of ``score > t`` for each cut, in ONE scan
    (one conditional count per cut), unpivoted to one row per threshold."""
    y, s = F.col(label) == 1, F.col(score)
    aggs = [F.sum(F.when(y, 1).otherwise(0)).cast("long").alias("P")]
    for i, t in enumerate(thresholds):
        aggs += [F.sum(F.when(y & (s > F.lit(t)), 1).otherwise(0)).cast("long").alias(f"tp{i}"),
                 F.sum(F.when(~y & (s > F.lit(t)), 1).otherwise(0)).cast("long").alias(f"fp{i}")]
    wide = df.agg(*aggs)
    long = wide.select("P", F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
        for i, t in enumerate(thresholds)])).alias("r")).select("P", "r.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("P") - F.col("tp")
    return long.select("threshold", "tp", "fp", fn.alias("fn"),
                       _z(F.try_divide(tp.cast("double"), tp + fp)).alias("precision"),
                       _z(F.try_divide(tp.cast("double"), tp + fn)).alias("recall"),
                       _z(F.try_divide(2.0 * tp, 2 * tp + fp + fn)).alias("f1"))


def cascade_sweep(df: DataFrame, y_true: str, score: str, stage2: str, benign: str) -> DataFrame:
    """C3 + E9: (threshold, routed, macro_f1) of a cascade's final labels at every cut there is, exactly.

    A row with ``score`` above the cut gets its ``stage2`` class, any other (null scores too) ``benign``. There is a
    row for every distinct score, and one with a null threshold for a cut below all of them. One aggregate by
    score counts what each score adds to the classes' hits and predictions; running totals over the
    scores (bucketed, no single-task window) give all cuts at once, so the work doesn't grow with
    the number of cuts. Classes come to the driver as column names do: two counters each.
    """
    data = checkpointed(df.select(F.col(y_true).cast("string").alias("y"), F.col(score).cast("double").alias("p"),
                                  F.col(stage2).cast("string").alias("s")))
    supports = {r.y: r["n"] for r in data.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = [*supports, *[r.s for r in data.where("p IS NOT NULL").select("s").distinct().collect() if r.s not in supports]]
    classes += [benign] if benign not in classes else []

    def n(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    counts = {"routed": F.count(F.lit(1)), "was_benign": n(F.col("y").eqNullSafe(F.lit(benign)))}
    for i, c in enumerate(classes):
        told = F.col("s").eqNullSafe(F.lit(c).cast("string"))
        counts |= {f"pred{i}": n(told), f"hit{i}": n(told & F.col("y").eqNullSafe(F.col("s")))}
    aggs = [v.cast("long").alias(k) for k, v in counts.items()]
    groups = checkpointed(data.where("p IS NOT NULL").groupBy("p").agg(*aggs))
    cuts = running_totals(groups, "p", list(counts), descending=True, inclusive=False) \
        .select(F.col("p").alias("threshold"), *[F.col(f"cum_{k}").alias(k) for k in counts])
    lowest = groups.agg(*[F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in counts])
    cuts = cuts.unionByName(lowest.withColumn("threshold", F.lit(None).cast("double")))
    total, macro, labels = sum(supports.values()), F.lit(0.0), F.lit(0)
    for i, c in enumerate(classes):
        pred, hit = F.col(f"pred{i}"), F.col(f"hit{i}")
        if c == benign:  # and all rows that are not routed
            pred = pred + F.lit(total) - F.col("routed")
            hit = hit + F.lit(supports.get(c, 0)) - F.col("was_benign")
        both = pred + F.lit(supports.get(c, 0))
        macro = macro + _z(F.try_divide(2.0 * hit, both))
        labels = labels + F.when(both > 0, 1).otherwise(0)
    return cuts.select("threshold", "routed", _z(F.try_divide(macro, labels)).alias("macro_f1"))


def best_cut(sweep: DataFrame) -> DataFrame:
    """One row (threshold, macro_f1): the cut of the highest macro-F1, of equals the one that routes least."""
    top = sweep.agg(F.min(F.struct((-F.col("macro_f1")).alias("back"), "routed", (-F.col("threshold")).alias("down"))).alias("t"))
    return top.select((-F.col("t.down")).alias("threshold"), (-F.col("t.back")).alias("macro_f1"))
