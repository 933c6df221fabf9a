"""plans of the code-lineage engine."""
