"""Column functions: each is one expression, evaluated in the JVM."""
