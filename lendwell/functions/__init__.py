"""Column-level functions; every one stays inside the JVM."""
