"""Column-level helpers (all JVM-side expressions)."""
