"""Column expressions that the operators share. All run in the JVM."""
