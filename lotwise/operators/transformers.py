"""Feature transformers. Fitting measures on the cluster; a fitted step is a plain
SQLTransformer or MLlib model, so whole pipelines can be saved and stay in generated code."""

from __future__ import annotations

import uuid

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from lotwise.functions.numeric import nan_to_null
from lotwise.operators.joins import lookup_join
from lotwise.operators.profile import numeric_columns
from lotwise.operators.quantiles import collect_quantiles, text_modes
from lotwise.session import cut_lineage, shared_folder

SCALERS = ["none", "max_abs", "min_max", "normalizer", "robust", "standard"]


def _number(x: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if x is None else f"{float(x)!r}D"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def replace_columns(exprs: dict[str, str]) -> SQLTransformer:
    """A step that replaces columns by SQL expressions."""
    if not exprs:
        return SQLTransformer(statement="SELECT * FROM __THIS__")
    names = ", ".join(_quoted(c) for c in exprs)
    new = ", ".join(f"{e} AS {_quoted(c)}" for c, e in exprs.items())
    return SQLTransformer(statement=f"SELECT * EXCEPT ({names}), {new} FROM __THIS__")


class _Columns(Estimator, HasInputCols):
    def __init__(self, inputCols: list[str]):
        super().__init__()
        self._set(inputCols=list(inputCols))


class MedianImputer(_Columns):
    """Missing numbers (null, NaN) become the interpolated median seen in fitting."""

    def _fit(self, df: DataFrame) -> SQLTransformer:
        cols = self.getInputCols()
        medians = collect_quantiles(df, cols, [0.5])
        return replace_columns(
            {
                c: f"coalesce(nanvl(CAST({_quoted(c)} AS DOUBLE), NULL), {_number(medians.get(c, [None])[0])})"
                for c in cols
            }
        )


class ModeImputer(_Columns):
    """Missing texts become the most frequent one, the smallest on ties."""

    def _fit(self, df: DataFrame) -> SQLTransformer:
        modes = text_modes(df, self.getInputCols())
        literal = {c: "'" + m.replace("\\", "\\\\").replace("'", "\\'") + "'" for c, m in modes.items()}
        return replace_columns({c: f"coalesce({_quoted(c)}, {m})" for c, m in literal.items()})


class QuantileClipper(_Columns):
    """Values clipped to two fitted quantiles; null stays null."""

    lower = Param(Params._dummy(), "lower", "lower quantile", TypeConverters.toFloat)
    upper = Param(Params._dummy(), "upper", "upper quantile", TypeConverters.toFloat)

    def __init__(self, inputCols: list[str], lower: float = 0.01, upper: float = 0.99):
        super().__init__(inputCols)
        self._set(lower=lower, upper=upper)

    def _fit(self, df: DataFrame) -> SQLTransformer:
        cols = self.getInputCols()
        probs = [self.getOrDefault(self.lower), self.getOrDefault(self.upper)]
        q = collect_quantiles(df, cols, probs)
        return replace_columns(
            {
                c: f"CASE WHEN {_quoted(c)} IS NOT NULL THEN "
                f"least(greatest({_quoted(c)}, {_number(q[c][0])}), {_number(q[c][1])}) END"
                for c in cols
                if c in q
            }
        )


class ColumnScaler(_Columns):
    """none, max_abs, min_max, normalizer (row length 1), robust (median, IQR) or standard (population)."""

    kind = Param(Params._dummy(), "kind", "scaler name", TypeConverters.toString)

    def __init__(self, inputCols: list[str], kind: str = "standard"):
        super().__init__(inputCols)
        if kind not in SCALERS:
            raise ValueError(f"unknown scaler {kind}")
        self._set(kind=kind)

    def _fit(self, df: DataFrame) -> SQLTransformer:
        cols, kind = self.getInputCols(), self.getOrDefault(self.kind)
        if kind == "none":
            return replace_columns({})
        if kind == "normalizer":
            squares = " + ".join(f"{_quoted(c)} * {_quoted(c)}" for c in cols)
            return replace_columns(
                {c: f"coalesce(try_divide({_quoted(c)}, sqrt({squares})), {_quoted(c)})" for c in cols}
            )
        centre, scale = self._spread(df, cols, kind)
        return replace_columns(
            {c: f"({_quoted(c)} - {_number(centre[c])}) / {_number(scale[c] or 1.0)}" for c in cols}
        )

    @staticmethod
    def _spread(df: DataFrame, cols: list[str], kind: str):
        if kind == "robust":
            q = collect_quantiles(df, cols, [0.25, 0.5, 0.75])
            return {c: q[c][1] for c in cols}, {c: q[c][2] - q[c][0] for c in cols}
        measure = {
            "max_abs": lambda x: (F.lit(0.0), F.max(F.abs(x))),
            "min_max": lambda x: (F.min(x), F.max(x) - F.min(x)),
            "standard": lambda x: (F.avg(x), F.stddev_pop(x)),
        }[kind]
        aggs = []
        for i, c in enumerate(cols):
            a, b = measure(nan_to_null(F.col(c).cast("double")))
            aggs += [a.alias(f"a{i}"), b.alias(f"b{i}")]
        row = df.agg(*aggs).first()
        return {c: row[f"a{i}"] for i, c in enumerate(cols)}, {c: row[f"b{i}"] for i, c in enumerate(cols)}


def number_labels(values: DataFrame, col: str, folder: str) -> int:
    """Write (label, slot) of a column of different, non-null texts: slots from 0 in the order of the labels.

    Labels are dealt by ranges and counted within them, so only a row count for each range reaches the driver.
    """
    spark = values.sparkSession
    ranged = values.select(F.col(col).alias("label")).repartitionByRange("label").sortWithinPartitions("label")
    ranged = cut_lineage(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    place, row = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy(place.alias("_range")).agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r["_range"], total))
        total += r["n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "_range int, _start long"))  # a row for each range
    numbered = ranged.withColumn("_range", place).join(offsets, "_range").select("label", (F.col("_start") + row).alias("slot"))
    numbered.write.parquet(folder)
    return total


class TableIndexer(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Slot of a text by a written table of labels; null and unknown texts get the slot past the last."""

    inputCol = Param(Params._dummy(), "inputCol", "text column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "slot column", TypeConverters.toString)
    folder = Param(Params._dummy(), "folder", "table of label and slot", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "number of labels", TypeConverters.toInt)

    def __init__(self, inputCol: str = "", outputCol: str = "", folder: str = "", width: int = 0):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, folder=folder, width=width)

    def labels(self, spark) -> DataFrame:
        return spark.read.schema("label string, slot long").parquet(self.getOrDefault("folder"))

    def _transform(self, df: DataFrame) -> DataFrame:
        col, out = self.getOrDefault("inputCol"), self.getOrDefault("outputCol")
        labels = self.labels(df.sparkSession).select(F.col("label").alias(col), F.col("slot").cast("double").alias("_slot"))
        slot = F.coalesce("_slot", F.lit(float(self.getOrDefault("width"))))
        return lookup_join(df, labels, [col]).select(*[f"`{c}`" for c in df.columns], slot.alias(out))


class SlotEncoder(Model, DefaultParamsReadable, DefaultParamsWritable):
    """One-hot vectors of slots 0 to width - 1; all zeros for the slot past the last.

    MLlib's encoder names every slot in the column's metadata, on the driver; this one notes their number only, so nothing
    on the driver grows with the width. Vectors are read from the text of their stored form.
    """

    inputCol = Param(Params._dummy(), "inputCol", "slot column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "number of slots", TypeConverters.toInt)

    def __init__(self, inputCol: str = "", outputCol: str = "", width: int = 0):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, width=width)

    @property
    def categorySizes(self) -> list[int]:
        """As MLlib's encoder gives it: the slots and the one past the last."""
        return [self.getOrDefault("width") + 1]

    def _transform(self, df: DataFrame) -> DataFrame:
        slot, out, width = (self.getOrDefault(p) for p in ("inputCol", "outputCol", "width"))
        stored = f'{{"v":{{"type":0,"size":{width},"indices":[%s],"values":[%s]}}}}'
        one = F.format_string(stored % ("%d", "1.0"), F.col(slot).cast("long"))
        text = F.when(F.col(slot) < width, one).otherwise(F.lit(stored % ("", "")))
        vector = F.from_json(text, StructType([StructField("v", VectorUDT())]))["v"]
        return df.select("*", vector.alias(out, metadata={"ml_attr": {"num_attrs": width}}))


class DropFirstEncoder(_Columns):
    """One-hot vectors without the alphabetically first value; that one, unknown and null are all zeros.

    The labels of a column with at most `widest` distinct values are part of the fitted step; those of a wider one lie in
    a table below `folder` (by default the shared folder), which the fitted step joins. Slots are the same either way.
    """

    suffix = "_onehot"

    def __init__(self, inputCols: list[str], widest: int = 100_000, folder: str | None = None):
        super().__init__(inputCols)
        self.widest, self.folder = widest, folder

    def _fit(self, df: DataFrame) -> PipelineModel:
        cols, spark = self.getInputCols(), df.sparkSession
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cols])
        values = df.select(F.explode(cells).alias("e")).select("e.*").where("v is not null").distinct()
        sizes = {r["c"]: r["n"] for r in values.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        narrow = [c for c in cols if sizes.get(c, 0) <= self.widest]
        found = values.where(F.col("c").isin(narrow)).collect() if narrow else []  # `widest` texts a column at most
        steps = []
        for c in cols:
            index = f"{c}_index"
            if c not in narrow:
                mine = values.where(F.col("c") == c).select(F.col("v").alias(c))
                rest = mine.where(F.col(c) > F.lit(mine.agg(F.min(c)).first()[0]))
                folder = f"{self.folder.rstrip('/')}/{uuid.uuid4().hex}" if self.folder else shared_folder(spark, "labels")
                width = number_labels(rest, c, folder)
                steps += [TableIndexer(c, index, folder, width), SlotEncoder(index, c + self.suffix, width)]
                continue
            labels = sorted(r["v"] for r in found if r["c"] == c)[1:]
            if not labels:
                continue
            indexer = StringIndexerModel.from_labels(labels, inputCol=c, outputCol=index, handleInvalid="keep")
            coder = OneHotEncoder(inputCol=index, outputCol=c + self.suffix, dropLast=True)
            steps += [indexer, coder.fit(indexer.transform(df.limit(0)))]
        return PipelineModel(steps)


class FeatureAssembler(Estimator):
    """Numeric columns, then the one-hot blocks that exist, in one vector."""

    @keyword_only
    def __init__(self, *, numeric: list[str], text: list[str], outputCol: str = "features"):
        super().__init__()
        self._numeric, self._text, self._out = numeric, text, outputCol

    def _fit(self, df: DataFrame) -> VectorAssembler:
        blocks = [c + DropFirstEncoder.suffix for c in self._text if c + DropFirstEncoder.suffix in df.columns]
        return VectorAssembler(inputCols=[*self._numeric, *blocks], outputCol=self._out, handleInvalid="keep")


def preprocessor(numeric: list[str], text: list[str], scaler: str = "standard") -> Pipeline:
    """median -> clip -> scale beside most frequent -> one-hot, assembled into `features`."""
    steps = [MedianImputer(numeric), QuantileClipper(numeric), ColumnScaler(numeric, scaler)]
    if text:
        steps += [ModeImputer(text), DropFirstEncoder(text)]
    return Pipeline(stages=[*steps, FeatureAssembler(numeric=numeric, text=text)])


def feature_names(model: PipelineModel, numeric: list[str], text: list[str]) -> list[str]:
    """Names of the vector slots: numeric columns, then column_value per one-hot slot."""
    labels: dict[str, list[str]] = {}

    def visit(stage):
        if isinstance(stage, PipelineModel):
            for s in stage.stages:
                visit(s)
        elif isinstance(stage, StringIndexerModel):
            labels[stage.getInputCol()] = list(stage.labels)
        elif isinstance(stage, TableIndexer):
            named = stage.labels(SparkSession.getActiveSession()).orderBy("slot").collect()
            labels[stage.getOrDefault("inputCol")] = [r["label"] for r in named]

    visit(model)
    return [*numeric, *[f"{c}_{v}" for c in text for v in labels.get(c, [])]]


def fill_with_medians(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Numeric columns filled with their own median over the whole table.

    Whole-number columns keep their type: the median is rounded half to even.
    """
    kinds = dict(df.dtypes)
    cols = cols or numeric_columns(df)
    gaps = df.agg(*[F.count_if(nan_to_null(F.col(c).cast("double")).isNull()).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    cols = [c for i, c in enumerate(cols) if gaps[f"_{i}"]]
    if not cols:
        return df
    medians = {c: q[0] for c, q in collect_quantiles(df, cols, [0.5]).items()}
    fills = {}
    for c, m in medians.items():
        if kinds[c] in ("double", "float"):
            fills[c] = F.coalesce(nan_to_null(F.col(c)), F.lit(m).cast(kinds[c]))
        else:
            fills[c] = F.coalesce(F.col(c), F.bround(F.lit(m), 0).cast(kinds[c]))
    return df.withColumns(fills)
