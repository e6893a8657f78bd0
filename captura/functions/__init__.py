"""Column -> Column building blocks; everything here stays on the JVM side."""
