"""Column expressions; all stay inside the JVM except where a docstring says so."""
