"""Column expressions: pure functions of columns, no shuffle and no Python at run time."""
