"""Column expressions; nothing here triggers a shuffle or leaves the JVM."""
