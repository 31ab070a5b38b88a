"""Column-to-column functions; none of them leaves the JVM."""
