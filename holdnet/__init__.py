"""holdnet: company-relationship graph analytics on Spark.

Every public function takes DataFrames (plus options) and returns a lazy
DataFrame; nothing is collected to the driver except one-row results that a
caller explicitly asks for.
"""

from holdnet.session import build_session, ensure_checkpoint_dir, pin

__all__ = ["build_session", "ensure_checkpoint_dir", "pin"]
