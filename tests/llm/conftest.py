import pytest

from hostpulse.llm import common


@pytest.fixture(autouse=True)
def no_waiting(monkeypatch):
    """Small steps leave nothing to wait for."""
    monkeypatch.setattr(common, "RELEASE_S", 0)
