"""The rule features as a stage of an ML pipeline."""

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F

from ..functions.features import feature_names, with_features


class RuleFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the rule feature vector of one schema version."""

    version = Param(Params._dummy(), "version", "feature schema version, 1 to 4", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="rule_features", version=2):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="rule_features", version=2)
        self._set(**self._input_kwargs)

    def getVersion(self):
        return self.getOrDefault(self.version)

    def _transform(self, dataset):
        names = feature_names(self.getVersion())
        rows = with_features(dataset, self.getVersion(), self.getInputCol())
        return rows.select(*dataset.columns, array_to_vector(F.array(*[F.col(n) for n in names])).alias(self.getOutputCol()))
