"""Column-level helpers (flags, safe ratios, labels)."""

from holdnet.functions.columns import (equals_flag, flag, mean_of, ratio_of_flags, share,
                                       unknown_label, year_prefix)

__all__ = ["equals_flag", "flag", "mean_of", "ratio_of_flags", "share", "unknown_label", "year_prefix"]
