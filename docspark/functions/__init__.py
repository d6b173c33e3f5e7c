"""Column functions: nothing here reads a table, and all but those in ``python_only`` stay in the JVM."""
