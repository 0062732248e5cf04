import pytest

from loomfield.session import session


@pytest.fixture(scope="session")
def spark():
    return session("tests", cores=8, spark__driver__memory="6g")
