import pytest

pytest.importorskip("lexmill.llm")
