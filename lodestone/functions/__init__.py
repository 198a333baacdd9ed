"""Column functions: expressions that stay inside the JVM."""
