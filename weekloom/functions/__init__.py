"""Column expressions used by the operators. Everything here stays inside the JVM."""
