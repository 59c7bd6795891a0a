"""Column -> Column functions. They never shuffle and never leave the JVM."""
