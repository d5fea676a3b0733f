"""Column-level helpers that stay inside generated JVM code."""
