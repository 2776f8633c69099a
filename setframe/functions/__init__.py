"""Column-level building blocks. Everything here stays inside JVM expressions."""
