"""operators of the code-lineage engine."""
