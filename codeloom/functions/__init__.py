"""functions of the code-lineage engine."""
