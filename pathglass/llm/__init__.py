"""Operators for preparing language-model training corpora on Spark.

Nothing outside this subpackage imports it; the driver contract module adds
its queries when the subpackage is present.
"""
