"""Column builders that stay inside the JVM."""
