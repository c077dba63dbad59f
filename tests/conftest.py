from __future__ import annotations

import tempfile

import pytest

from papyra.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp")})
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")
