import pytest

from corpuskiln.llm import html_extract


@pytest.fixture(scope="session")
def html_model():
    """The labeller as the query trains it."""
    return html_extract.fit()
