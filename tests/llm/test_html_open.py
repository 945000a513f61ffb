"""Hidden elements whose end tag is left out."""

import pytest

from cairnflow.llm import html_extract

TEXT = "<article><h1>A title</h1><p>A long paragraph of the page, and its last sentence.</p></article>"


@pytest.mark.parametrize("start", ["<html><head><title>t</title><body>", "<head><meta charset=utf-8>", "<html><head><title>t</title></head><body><svg><path d=x>"])
def test_a_block_ends_an_open_head_or_svg(start):
    page = html_extract.Page(start + TEXT)
    assert [t for _, t in page.segments] == ["A title", "A long paragraph of the page, and its last sentence."]


def test_blocks_inside_hidden_elements_stay_hidden():
    for start in ("<head><noscript><div>no</div></noscript></head><body>", "<body><svg><foreignObject><div>no</div></foreignObject></svg>", "<body><button><div>no</div></button>"):
        assert [t for _, t in html_extract.Page(start + TEXT).segments][0] == "A title"
