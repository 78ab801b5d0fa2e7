"""Column functions: all are built-in Spark expressions, so they stay inside the JVM."""
