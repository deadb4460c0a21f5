"""Dropped elements of a page never take the text after them."""

import pytest

from corpuskiln.llm.html_blocks import blocks_of


@pytest.mark.parametrize(
    "odd",
    [
        "<svg/>", '<svg viewBox="0 0 1 1" />', "<svg-icon name=x></svg-icon>", "<button-group>", '<iframe src="a" />', "<button>", "<script src=x />", "<title-bar/>",
        "<svg><svg>no</svg>no</svg>", "<svg>no</svg>", "<BUTTON>no</Button >", "<select><option>no</select>", "<object><p>no</p></object>", "<script>no</script >",
    ],
)
def test_text_after_dropped_elements_stays(odd):
    assert [b.text for b in blocks_of(f"<p>before</p>{odd}<p>after</p><p>last</p>")] == ["before", "after", "last"]


def test_an_open_button_does_not_reach_to_the_next_one():
    assert [b.text for b in blocks_of("<button><p>kept</p><button>no</button><p>after</p><script>no")] == ["kept", "after"]
