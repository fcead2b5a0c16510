"""Column expressions: labels, classes, colours, geometry, texts. All run inside the JVM."""
