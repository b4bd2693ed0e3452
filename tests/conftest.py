"""One local session for all tests."""

import pytest

from millrace.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("shared")
    session = local_session(4, 4, spark__checkpoint__dir=str(root), spark__sql__warehouse__dir=str(root / "warehouse"))
    yield session
    session.stop()
