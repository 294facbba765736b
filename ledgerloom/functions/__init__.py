"""Column builders: no job is run and no Python function reaches an executor."""
