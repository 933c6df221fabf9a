"""sources of the code-lineage engine."""
