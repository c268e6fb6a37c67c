"""Column-level building blocks (pure JVM expressions unless noted)."""
