"""Column helpers with the semantics of Python expressions."""
