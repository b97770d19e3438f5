"""Column-level functions, built from JVM expressions where possible."""
