"""Column-to-column helpers. Everything here is built from JVM-side Spark functions."""
