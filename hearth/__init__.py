"""hearth: household-survey feature, sampling, scoring and evaluation operators on Spark.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, joins, aggregates and windows. Model fitting uses ``pyspark.ml``.
"""

__version__ = "0.1.0"
