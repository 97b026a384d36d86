import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from innsight.session import local_session

    s = local_session("*", 8, app="innsight-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL


@pytest.fixture()
def scratch(tmp_path_factory):
    """A fresh scratch folder per test (never reused)."""
    return str(tmp_path_factory.mktemp("run"))


def plan_text(df):
    """The formatted physical plan, as ``df.explain("formatted")`` prints it."""
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()
