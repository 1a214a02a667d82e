"""Composed flows (relation features, node features, graph reports, prediction, tests) and the
query registry used by ``__spark_entry__``."""
