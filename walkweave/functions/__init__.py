"""Column-level building blocks (JVM-side expressions and a few Arrow helpers)."""
