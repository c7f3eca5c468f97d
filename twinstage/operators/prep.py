"""Feature preparation fitted on train only and applied to any table (M1–M6).

MLlib's own ``Imputer`` (median = lower-middle value) and ``StandardScaler``
(sample std) differ from the reference's semantics, so the three numeric
estimators are small ``pyspark.ml`` stages of our own: each fit is ONE aggregate
pass over all columns, each fitted model is a pure projection (codegen). They
are immutable — stage 2 of a cascade fits its own copies.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import medians, modes


class _HasSurrogates(Params):
    surrogates = Param(Params._dummy(), "surrogates", "fitted fill values",
                       typeConverter=TypeConverters.toListString)


def _finite(c: str):
    """The column as a double with NaN and ±inf as null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def _outs(stage) -> list[str]:
    return stage.getOutputCols() if stage.isDefined(stage.outputCols) else stage.getInputCols()


class MedianImputerModel(Model, HasInputCols, HasOutputCols, _HasSurrogates, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, surrogates=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        fills = {}
        for c, o, v in zip(self.getInputCols(), _outs(self), self.getOrDefault(self.surrogates)):
            fills[o] = F.coalesce(_finite(c), F.lit(None if v == "" else float(v)).cast("double"))
        return df.withColumns(fills)


class MedianImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """M1: missing (null, NaN, ±inf) → exact interpolated median of the fitting table, by distributed
    selection at every size; a column without values stays null."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MedianImputerModel:
        cols = self.getInputCols()
        row = medians(df, cols).first() if cols else None
        vals = ["" if row is None or row[c] is None else repr(float(row[c])) for c in cols]
        return MedianImputerModel(inputCols=cols, outputCols=_outs(self), surrogates=vals)


class ModeImputerModel(Model, HasInputCols, HasOutputCols, _HasSurrogates, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, surrogates=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        fills = {}
        for c, o, v in zip(self.getInputCols(), _outs(self), self.getOrDefault(self.surrogates)):
            fills[o] = F.coalesce(F.col(c).cast("string"), F.lit(v))
        return df.withColumns(fills)


class ModeImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """M2: null → most frequent value (ties → smallest), categorical columns as text."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ModeImputerModel:
        cols = self.getInputCols()
        row = modes(df.select(*[F.col(c).cast("string").alias(c) for c in cols]), cols).first() if cols else None
        vals = ["missing" if row is None or row[c] is None else str(row[c]) for c in cols]
        return ModeImputerModel(inputCols=cols, outputCols=_outs(self), surrogates=vals)


class _HasScales(Params):
    means = Param(Params._dummy(), "means", "column means", typeConverter=TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "divisors (pop std, 1 when 0)",
                   typeConverter=TypeConverters.toListFloat)


class PopStandardScalerModel(Model, HasInputCols, HasOutputCols, _HasScales, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, means=None, scales=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        m, s = self.getOrDefault(self.means), self.getOrDefault(self.scales)
        return df.withColumns({o: (_finite(c) - F.lit(mu)) / F.lit(sd)
                               for c, o, mu, sd in zip(self.getInputCols(), _outs(self), m, s)})


class PopStandardScaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """M4: (x − mean) / population std; a constant column divides by 1."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PopStandardScalerModel:
        cols = self.getInputCols()
        aggs = [x for c in cols for x in (F.avg(_finite(c)), F.stddev_pop(_finite(c)))]
        row = df.agg(*aggs).first() if cols else []
        means, scales = [], []
        for i in range(len(cols)):
            mu, sd = row[2 * i], row[2 * i + 1]
            means.append(0.0 if mu is None else float(mu))
            scales.append(1.0 if sd is None or sd == 0 else float(sd))
        return PopStandardScalerModel(inputCols=cols, outputCols=_outs(self), means=means, scales=scales)


def one_hot_stages(cat_cols: list[str], out_cols: list[str] | None = None, tag: str = "oh") -> list:
    """M3: alphabetical index, unseen → the dropped 'keep' slot → all-zero vector."""
    out_cols = out_cols or [f"{tag}_{c}" for c in cat_cols]
    idx = [f"{o}_idx" for o in out_cols]
    return [
        StringIndexer(inputCols=cat_cols, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx, outputCols=out_cols, dropLast=True),  # drops the keep slot
    ]


def build_preprocessor(num_cols: list[str], cat_cols: list[str], scale: bool = False,
                       encode: str = "onehot", features_col: str = "features",
                       tag: str = "pp") -> Pipeline:
    """M5: numeric → median impute (→ scale); categorical → mode impute → one-hot
    (or M6: plain index for tree learners); then one feature vector.

    Every stage writes new ``<tag>_…`` columns, so the raw inputs stay intact and
    two preprocessors (the two stages of a cascade) never see each other's fills.
    """
    stages, inputs = [], []
    if num_cols:
        imp = [f"{tag}_n_{c}" for c in num_cols]
        stages.append(MedianImputer(inputCols=num_cols, outputCols=imp))
        if scale:
            stages.append(PopStandardScaler(inputCols=imp, outputCols=imp))
        inputs += imp
    if cat_cols:
        filled = [f"{tag}_c_{c}" for c in cat_cols]
        stages.append(ModeImputer(inputCols=cat_cols, outputCols=filled))
        if encode == "onehot":
            vec = [f"{tag}_oh_{c}" for c in cat_cols]
            stages += one_hot_stages(filled, vec)
            inputs += vec
        elif encode == "index":
            out = [f"{tag}_ix_{c}" for c in cat_cols]
            stages.append(StringIndexer(inputCols=filled, outputCols=out, handleInvalid="keep",
                                        stringOrderType="alphabetAsc"))
            inputs += out
        else:
            raise ValueError(f"unknown encoding: {encode}")
    stages.append(VectorAssembler(inputCols=inputs, outputCol=features_col, handleInvalid="keep"))
    return Pipeline(stages=stages)


def reuse_fits(prep: Pipeline, fitted: PipelineModel) -> Pipeline:
    """``prep`` with the fills and encodings of ``fitted``, a preprocessor fitted on the same rows whose columns include
    those of ``prep``: a column's median, mode and labels do not depend on the others, so several learners on the same
    rows (and feature groups of them) need one fit."""
    medians_, modes_, labels, raw = {}, {}, {}, {}
    for s in fitted.stages:
        if isinstance(s, MedianImputerModel):
            medians_.update(zip(s.getInputCols(), s.getOrDefault(s.surrogates)))
        elif isinstance(s, ModeImputerModel):
            modes_.update(zip(s.getInputCols(), s.getOrDefault(s.surrogates)))
            raw.update(zip(_outs(s), s.getInputCols()))
        elif isinstance(s, StringIndexerModel):
            labels.update((raw[c], list(x)) for c, x in zip(s.getInputCols(), s.labelsArray))
    stages, filled = [], {}
    for s in prep.getStages():
        if isinstance(s, MedianImputer):
            s = MedianImputerModel(inputCols=s.getInputCols(), outputCols=_outs(s), surrogates=[medians_[c] for c in s.getInputCols()])
        elif isinstance(s, ModeImputer):
            filled.update(zip(_outs(s), s.getInputCols()))
            s = ModeImputerModel(inputCols=s.getInputCols(), outputCols=_outs(s), surrogates=[modes_[c] for c in s.getInputCols()])
        elif isinstance(s, StringIndexer):
            s = StringIndexerModel.from_arrays_of_labels([labels[filled[c]] for c in s.getInputCols()], inputCols=s.getInputCols(),
                                                         outputCols=s.getOutputCols(), handleInvalid="keep")
        stages.append(s)
    return Pipeline(stages=stages)
