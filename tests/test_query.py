import pytest

from lumenlex.errors import MaxDepthExceeded, MaxNodesExceeded, ParseError
from lumenlex.plans.query import And, Not, Or, Phrase, Term, boosted, checked, parse


@pytest.mark.parametrize("text", ["", "   ", "title:", "title:new york", "a OR  OR b", "a AND  AND b"])
def test_malformed(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize(
    ("text", "node"),
    [
        ("a", Term("a")),
        ("a b", And((Term("a"), Term("b")))),
        ("a OR b AND c", Or((Term("a"), And((Term("b"), Term("c")))))),
        ("NOT a b", Not((And((Term("a"), Term("b"))),))),
        ("NOT NOT a", Not((Not((Term("a"),)),))),
        ("a NOT b", And((Term("a"), Term("NOT"), Term("b")))),
        ("a or b", And((Term("a"), Term("or"), Term("b")))),
        ("a AND", And((Term("a"), Term("AND")))),
        ("NOT", Term("NOT")),
        ("a OR OR b", Or((Term("a"), And((Term("OR"), Term("b")))))),
        ("x:y:z", Term("y:z", "x")),
        (":y", Term("y", "")),
        ("a b:c", Term("c", "a b")),
        ("a\x1cb", Term("a\x1cb")),
        ("\u3000a\u2003b\x85", And((Term("a"), Term("b")))),
        ("title: rust", Term(" rust", "title")),
    ],
)
def test_grammar(text, node):
    assert parse(text) == node


def test_limits():
    deep = Term("a")
    for _ in range(32):
        deep = ~deep
    with pytest.raises(MaxDepthExceeded):
        checked(deep)
    wide = Or(tuple(Term(str(i)) for i in range(1024)))
    with pytest.raises(MaxNodesExceeded):
        checked(wide)
    assert checked(Or(tuple(Term(str(i)) for i in range(1023))))
    with pytest.raises(MaxNodesExceeded):
        checked(Or(tuple(Term(str(i)) for i in range(400))), fields=2)


def test_building_and_walking():
    node = Term("a") & (Term("b") | ~Term("c"))
    assert [type(n).__name__ for n in node.walk()] == ["And", "Term", "Or", "Term", "Not", "Term"]
    assert node.depth == 4
    assert boosted(Term("a", boost=2.0), 3.0).boost == 6.0
    assert Phrase(("new", "york"), 1).slop == 1
