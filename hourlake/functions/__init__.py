"""Column -> Column helpers; everything stays on the JVM side."""
