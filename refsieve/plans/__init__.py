"""Query registry and the incremental pipeline."""
