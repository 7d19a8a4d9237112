"""rowkin: record linkage and candidate-pair analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
