import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]",
        "tests",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


_CAUSES: list[str] = []


@pytest.hookimpl(hookwrapper=True)
def pytest_runtest_makereport(item, call):
    """Keep the engine's innermost causes, which long stacks hide."""
    yield
    if call.excinfo is not None:
        text = str(call.excinfo.value)
        found = [line.strip()[:300] for line in text.splitlines() if line.lstrip().startswith("Caused by") or "Error:" in line[:80]]
        _CAUSES.append(f"{item.nodeid}: " + " | ".join(found[-4:] or [text[:300]]))


def pytest_terminal_summary(terminalreporter):
    for cause in _CAUSES:
        terminalreporter.write_line(f"cause of {cause}")
