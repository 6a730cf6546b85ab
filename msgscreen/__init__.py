"""msgscreen — Spark-native screening of text-message traffic.

Every operator is a function from DataFrame(s) to DataFrame, built from
``pyspark.sql.functions`` so Catalyst can prune, push down and codegen it.
"""

__version__ = "0.1.0"
