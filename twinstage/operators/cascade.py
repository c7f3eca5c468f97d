"""The two-stage cascade.

Stage 1 (benign vs attack) scores every row; stage 2 (which attack) runs only
on rows stage 1 routes (p > threshold); all other rows get the benign label.
Cascades of trees are scored in one pass over the table: inside a batch stage 2
sees the routed rows only. Other learners go through a ``filter`` below the
stage-2 projection; stage-1 output is then read by both branches and is
written once to the checkpoint folder between them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import binary_label
from . import scoring
from .clean import filter_attacks
from .metrics import best_cut, cascade_sweep, macro_f1_values
from .models import fit_learner, learner, positive_probability
from .prep import build_preprocessor, reuse_fits
from .small import checkpointed
from .split import fold_rows
from .stats import attach_weights, positive_weight


# ---------------------------------------------------------------------------
# routing (C3, C4) — works for trained and rule-based stages alike
# ---------------------------------------------------------------------------

def route(scored: DataFrame, p_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(routed, rest) by the strict cut ``p > threshold`` (V9); null p is not routed."""
    hit = F.col(p_col) > F.lit(threshold)
    return scored.filter(hit), scored.filter(~F.coalesce(hit, F.lit(False)))


def assemble(routed_pred: DataFrame, rest: DataFrame, pred_col: str, benign: str) -> DataFrame:
    """C4: routed rows keep stage 2's class, every other row is benign."""
    return routed_pred.unionByName(rest.withColumn(pred_col, F.lit(benign)), allowMissingColumns=True)


def rule_cascade(df: DataFrame, score: Column, stage2: Column, threshold: float, benign: str,
                 pred_col: str = "y_pred") -> DataFrame:
    """C3–C4 with expression stages, in ONE pass: ``CASE WHEN p > t THEN stage2
    ELSE benign`` evaluates the stage-2 expression only for routed rows (CASE
    branches are lazy in codegen), so there is no union and no second scan."""
    scored = df.withColumn("p_attack", score)
    routed = F.col("p_attack") > F.lit(threshold)
    return scored.withColumn(pred_col, F.when(F.coalesce(routed, F.lit(False)), stage2).otherwise(F.lit(benign)))


# ---------------------------------------------------------------------------
# trained cascade
# ---------------------------------------------------------------------------

@dataclass
class CascadeSpec:
    num_cols: list[str]
    cat_cols: list[str]
    label_col: str
    benign: str
    stage1: str = "gbt"
    stage2: str = "rf"
    stage1_params: dict = field(default_factory=dict)
    stage2_params: dict = field(default_factory=dict)
    threshold: float = 0.5
    weight_col: str | None = None      # one weight column for both stages and the single stage
    encode: str = "onehot"             # or "index" (M6)
    stage_weights: bool = False        # A6 for stage 1, balanced among the attacks (A4) for stage 2
    seed: int = 42


@dataclass
class TwoStageModel:
    stage1: PipelineModel
    stage2: PipelineModel | None
    attack_labels: list[str]
    spec: CascadeSpec

    def predict(self, df: DataFrame, pred_col: str = "y_pred") -> DataFrame:
        """Final classes and p_attack: trees as flat arrays in one pass (``scoring``), other learners by their
        transformers."""
        if scoring.is_flat(self.stage1) and (self.stage2 is None or scoring.is_flat(self.stage2)):
            return scoring.predict_two_stage(self, df, pred_col)
        return self.transform(df, pred_col)

    def transform(self, df: DataFrame, pred_col: str = "y_pred") -> DataFrame:
        """The same through the library's transformers. Stage 1 runs once per row: its scores are written once
        (checkpoint) and both branches, routed and rest, read them."""
        s = self.spec
        s1 = positive_probability(self.stage1.transform(df), "s1_probability", "p_attack")
        s1 = checkpointed(s1.drop(*[c for c in s1.columns if c.startswith(("s1_", "p1_"))]))
        routed, rest = route(s1, "p_attack", s.threshold)
        if self.stage2 is None:  # no attack class in train: everything is benign
            return rest.unionByName(routed).withColumn(pred_col, F.lit(s.benign))
        pred = self.stage2.transform(routed)
        pred = IndexToString(inputCol="s2_prediction", outputCol=pred_col, labels=self.attack_labels) \
            .transform(pred)
        pred = pred.drop(*[c for c in pred.columns if c.startswith(("s2_", "p2_"))])
        return assemble(pred, rest, pred_col, s.benign)


def fit_preparation(train: DataFrame, spec: CascadeSpec) -> PipelineModel:
    """Fills and encoders of all rows, for the learners that are fitted on the same rows."""
    return build_preprocessor(spec.num_cols, spec.cat_cols, features_col="features", encode=spec.encode, tag="all").fit(train)


def fit_two_stage(train: DataFrame, spec: CascadeSpec, prepared: PipelineModel | None = None) -> TwoStageModel:
    """C1 + C2: stage 1 on all rows (binary label); stage 2 on TRUE attack rows
    only, labels re-indexed among attacks, with its own imputer/encoder. ``prepared``: the
    preparation of ``train`` where it is already fitted (stage 1's; stage 2 fits its own)."""
    y = F.col(spec.label_col)
    t1 = train.withColumn("s1_label", binary_label(y, spec.benign).cast("double"))
    w1 = w2 = spec.weight_col
    if spec.stage_weights:
        w1 = w2 = "stage_weight"
        pos = positive_weight(t1, "s1_label").first()["pos_weight"]
        t1 = t1.withColumn(w1, F.when(F.col("s1_label") == 1, F.lit(float(pos))).otherwise(F.lit(1.0)))
    prep1 = build_preprocessor(spec.num_cols, spec.cat_cols, features_col="s1_features", encode=spec.encode, tag="p1")
    prep1 = prep1 if prepared is None else reuse_fits(prep1, prepared)
    l1 = learner(spec.stage1, "s1_label", "s1_features", w1, spec.seed, prefix="s1_",
                 **spec.stage1_params)
    stage1 = fit_learner(prep1, l1, t1)

    attacks = filter_attacks(train, spec.label_col, spec.benign).withColumn(
        spec.label_col, F.coalesce(y.cast("string"), F.lit("nan")))
    if spec.stage_weights:
        attacks = attach_weights(attacks, spec.label_col, weight_col=w2)
    idx = StringIndexer(inputCol=spec.label_col, outputCol="s2_label", stringOrderType="alphabetAsc").fit(attacks)
    if not idx.labels:
        return TwoStageModel(stage1, None, [], spec)
    prep2 = build_preprocessor(spec.num_cols, spec.cat_cols, features_col="s2_features", encode=spec.encode, tag="p2")
    l2 = learner(spec.stage2, "s2_label", "s2_features", w2, spec.seed, prefix="s2_",
                 **spec.stage2_params)
    stage2 = fit_learner(prep2, l2, attacks, [idx])
    return TwoStageModel(stage1, stage2, list(idx.labels), spec)


def tune_threshold(model: TwoStageModel, validation: DataFrame) -> TwoStageModel:
    """C3 + E9: the model with the routing cut of the highest macro-F1 of its final labels on ``validation`` (rows that
    neither stage was fitted on), found among all cuts. A model without a second stage stays as it is."""
    if model.stage2 is None:
        return model
    everything = TwoStageModel(model.stage1, model.stage2, model.attack_labels, replace(model.spec, threshold=-1.0))
    rows = everything.predict(validation, "_stage2")
    cut = best_cut(cascade_sweep(rows, model.spec.label_col, "p_attack", "_stage2", model.spec.benign)).first().threshold
    return TwoStageModel(model.stage1, model.stage2, model.attack_labels, replace(model.spec, threshold=-1.0 if cut is None else float(cut)))


@dataclass
class SingleStageModel:
    model: PipelineModel
    labels: list[str]

    def predict(self, df: DataFrame, pred_col: str = "y_pred") -> DataFrame:
        if scoring.is_flat(self.model):
            return scoring.predict_single(self, df, pred_col)
        return self.transform(df, pred_col)

    def transform(self, df: DataFrame, pred_col: str = "y_pred") -> DataFrame:
        out = self.model.transform(df)
        out = IndexToString(inputCol="ss_prediction", outputCol=pred_col, labels=self.labels).transform(out)
        return out.drop(*[c for c in out.columns if c.startswith(("ss_", "ps_"))])


def fit_single_stage(train: DataFrame, spec: CascadeSpec, kind: str | None = None, prepared: PipelineModel | None = None,
                     **params) -> SingleStageModel:
    """One multi-class learner on all classes (same prep recipe; ``prepared``: where it is already fitted on ``train``)."""
    t = train.withColumn(spec.label_col, F.coalesce(F.col(spec.label_col).cast("string"), F.lit("nan")))
    idx = StringIndexer(inputCol=spec.label_col, outputCol="ss_label", stringOrderType="alphabetAsc").fit(t)
    prep = build_preprocessor(spec.num_cols, spec.cat_cols, features_col="ss_features", encode=spec.encode, tag="ps")
    prep = prep if prepared is None else reuse_fits(prep, prepared)
    lrn = learner(kind or spec.stage2, "ss_label", "ss_features", spec.weight_col, spec.seed, prefix="ss_",
                  **(params or spec.stage2_params))
    model = fit_learner(prep, lrn, t, [idx])
    return SingleStageModel(model, list(idx.labels))


# ---------------------------------------------------------------------------
# Cross-validated comparison and ablation → scores tables
# ---------------------------------------------------------------------------

def _run_parallel(tasks, parallelism: int) -> list:
    """Run independent fits from a small thread pool (as MLlib's CrossValidator
    does): each fit is a chain of small jobs, so several keep the cluster busy."""
    from concurrent.futures import ThreadPoolExecutor
    if parallelism <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(lambda t: t(), tasks))


def cv_compare(folded: DataFrame, spec: CascadeSpec, dataset: str, fold_col: str = "fold",
               run_col: str | None = "run", single_kind: str | None = None, parallelism: int = 4) -> DataFrame:
    """For each (run, fold), single-stage and two-stage on the SAME split, scored in one scan of its test rows;
    only their confusion cells (k² rows) reach the driver."""
    spark = folded.sparkSession
    keys = folded.select(*([run_col] if run_col else []), fold_col).distinct().collect()
    y = spec.label_col

    def one(run, f):
        def task():
            part = folded.filter(F.col(run_col) == run) if run_col else folded
            train, test = fold_rows(part, f, fold_col)
            prepared = fit_preparation(train, spec)
            single = fit_single_stage(train, spec, single_kind, prepared)
            two = fit_two_stage(train, spec, prepared)
            s_f1, t_f1 = macro_f1_values(two.predict(single.predict(test, "_single"), "_two"), y, ["_single", "_two"])
            return [(dataset, "single_stage", run, f, s_f1), (dataset, "two_stage", run, f, t_f1)]
        return task

    tasks = [one(k[run_col] if run_col else 0, k[fold_col]) for k in sorted(keys, key=lambda r: tuple(r))]
    rows = [r for rs in _run_parallel(tasks, parallelism) for r in rs]
    return spark.createDataFrame(rows, "dataset string, model string, run int, fold int, macro_f1 double")


def ablation(folded: DataFrame, spec: CascadeSpec, groups: dict[str, tuple[list[str], list[str]]],
             dataset: str, fold_col: str = "fold", parallelism: int = 4) -> DataFrame:
    """Cross-validated macro-F1 of one learner per feature-group mode. The preparation of a fold is fitted once, on
    the columns of all modes."""
    spark = folded.sparkSession
    folds = sorted(r[0] for r in folded.select(fold_col).distinct().collect())
    every = CascadeSpec(**{**spec.__dict__, **{k: list(dict.fromkeys(c for g in groups.values() for c in g[i]))
                                               for i, k in enumerate(("num_cols", "cat_cols"))}})
    prepared = dict(zip(folds, _run_parallel([lambda f=f: fit_preparation(fold_rows(folded, f, fold_col)[0], every) for f in folds], parallelism)))

    def one(mode, num, cat, f):
        def task():
            s = CascadeSpec(**{**spec.__dict__, "num_cols": num, "cat_cols": cat})
            train, test = fold_rows(folded, f, fold_col)
            pred = fit_single_stage(train, s, prepared=prepared[f]).predict(test)
            return (dataset, mode, 0, f, macro_f1_values(pred, s.label_col, ["y_pred"])[0])
        return task

    tasks = [one(mode, num, cat, f) for mode, (num, cat) in groups.items() for f in folds]
    rows = _run_parallel(tasks, parallelism)
    return spark.createDataFrame(rows, "dataset string, model string, run int, fold int, macro_f1 double")
