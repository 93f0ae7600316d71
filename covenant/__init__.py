"""covenant — contract-risk and document-audit analytics on Spark DataFrames.

Every public function takes DataFrames (or a SparkSession plus paths) and
returns a lazy DataFrame; nothing is collected inside an operator.
"""

__version__ = "0.1.0"
