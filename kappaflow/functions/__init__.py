"""Column-expression helpers (JVM-side, no UDFs)."""
