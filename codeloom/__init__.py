"""codeloom: a PySpark-native code-lineage analytics engine."""
