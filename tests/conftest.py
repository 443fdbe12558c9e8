import pytest

from chronolake.session import session


@pytest.fixture(scope="session")
def spark():
    made = session("local[4]", **{"spark__sql__shuffle__partitions": "4", "spark__driver__memory": "6g", "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
