"""DataFrame -> DataFrame operators, one module per reference area."""
