import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from holdnet.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=8, driver_memory="4g", app="holdnet-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted list of tuples of the given columns (all columns if none given)."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()),
                  key=lambda t: tuple((x is None, x if x is not None else 0) for x in t))


REL_SCHEMA = ("nodo_ini string, nodo_fin string, date_year_ini int, date_month_ini int, score_fin double, "
              "rel_id string, grupo_ini string, grupo_fin string, situ_ini string, situ_fin string")
NODE_SCHEMA = "nodo string, grupo string, ind_filial_matriz string, importe double, sector string, tamano string"
