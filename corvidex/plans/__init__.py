"""Plan-level helpers: shared tables that cut lineage, size-checked broadcasts."""
