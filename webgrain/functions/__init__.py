"""Column functions: expressions that stay in the JVM, and a few Arrow functions where Spark has none."""
