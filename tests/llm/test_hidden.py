import pytest

from sedimenta.llm.html_extract import Page


@pytest.mark.parametrize(
    ("attributes", "hidden"),
    [
        ('href="/hidden-gems"', False), ('title="The hidden valley"', False), ('data-hidden="false"', False), ("title='hidden'", False), ("href=/a/hidden", False), ('data-style="display:none"', False), ('data-x="a" class="hidden-gems"', False),
        ("hidden", True), ("HIDDEN", True), ('hidden=""', True), ('title="a" hidden', True), ('title="a"hidden', True), ("href=/a/b hidden", True), ('aria-hidden="true"', True), ('aria-hidden="false"', False), ("style = 'display: none'", True),
    ],
)
def test_only_the_name_hides(attributes, hidden):
    page = Page(f"<body><div {attributes}>Some text</div></body>")
    assert page.hidden[page.tags.index("div")] is hidden
