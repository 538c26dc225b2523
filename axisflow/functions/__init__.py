"""Column-level and small table-level building blocks shared by the operators."""
