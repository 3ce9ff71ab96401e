import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from tallyfold import Bounds, Column, Rule, Spec  # noqa: E402
from tallyfold.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def base_spec(**changes) -> Spec:
    """Water drawn in a harbour: how often each hydrant of a berth was opened, and how much it gave."""
    fields = dict(
        name="harbour water",
        columns=(Column("berth", "string"), Column("hydrant", "int"), Column("opened", "int", True),
                 Column("cubic", "float")),
        keys=("berth", "hydrant"), rules=(Rule("cubic", "sum"), Rule("opened", "sum")),
        order=("hydrant", "berth", "cubic", "opened"), sort_by=("hydrant",),
        bounds={"cubic": Bounds(max=900)})
    fields.update(changes)
    return Spec(**fields)


@pytest.fixture
def spec():
    return base_spec()


@pytest.fixture
def folder(tmp_path):
    """Write lists into an input folder: ``folder(**{name: text or bytes})``."""
    path = tmp_path / "in"
    path.mkdir()

    def write(lists: dict) -> str:
        for name, content in lists.items():
            data = content if isinstance(content, bytes) else content.encode("utf-8")
            (path / name).write_bytes(data)
        return str(path)

    return write


def rows(df, *names):
    """Contents as a set of plain tuples (decimals as floats)."""
    from decimal import Decimal
    df = df.select(*names) if names else df
    return [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in df.collect()]
