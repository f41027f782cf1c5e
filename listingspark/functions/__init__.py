"""Column-level rules, written as built-in expressions so they stay inside the JVM."""
