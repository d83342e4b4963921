"""Column expressions shared by the operators; all stay inside Spark's code generation or higher-order functions."""
