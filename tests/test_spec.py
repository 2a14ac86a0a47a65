import pytest

from quire.operators.extraction import SURAS, anchor, shadow
from quire.operators.filters import Facets, centuries, ids_of
from quire.operators.geometry import align, ratio
from quire.operators.windows import increasing, page_links
from quire.plans.spec import Query, Term, checked, parsed_term, written_term


@pytest.mark.parametrize(
    "value, term",
    [
        ("+w:fox", Term("fox")),
        ("~p:a%20b", Term("a b", "phrase", op="should")),
        ("-f1d:fox", Term("fox", "fuzzy", 1, "sensitive", "must_not")),
        ("+s:root", Term("root", "stem")),
    ],
)
def test_url_terms_round_trip(value, term):
    assert parsed_term(value) == term and written_term(term) == value


@pytest.mark.parametrize("value", ["fox", "+x:fox", "?w:fox", "+w1:fox", "+w: ", "+sd:x"])
def test_malformed_url_terms(value):
    assert parsed_term(value) is None


@pytest.mark.parametrize(
    "query",
    [
        Query(()),
        Query((Term("a", op="must_not"),)),
        Query((Term("a", fuzziness=1),)),
        Query((Term("a", "fuzzy", 3),)),
        Query((Term("a"),), scope="selected"),
        Query((Term("a"),) * 9),
        Query((Term("a"),), scope="selected", ids=tuple(range(201))),
        Query((Term(" "),)),
        Query((Term("a"),), mode="other"),
    ],
)
def test_refused_queries(query):
    with pytest.raises(ValueError):
        checked(query)


def test_stem_ignores_diacritics():
    assert checked(Query((Term("a", "stem", diacritics="sensitive"),))).terms[0].diacritics == "ignore"


def test_small_parsers():
    assert ids_of(["1", "x", " 7 "]) == [1, 7] and centuries(["0", "3", "21", "20"]) == [3, 20]
    assert page_links(45, 3) == {"count": 45, "next": None, "previous": 2} and page_links(45, 1)["next"] == 2
    with pytest.raises(ValueError, match="unknown"):
        Facets().clauses({"nope": ["x"]})


def test_offsets_with_growing_lower_case():
    text = "İa مُ"
    low, places = shadow(text)
    assert len(low) == len(places) and text[places[low.index("a")]] == "a"
    assert len(SURAS) == 114 and (SURAS[0], SURAS[2], SURAS[113]) == ("الفاتحة", "آل عمران", "الناس")


def test_anchor_tiers():
    pages = {1: "abc. def", 2: "ghi"}
    assert anchor(pages, 1, "def") == (1, 5, 8)
    assert anchor(pages, 1, "ghi") == (2, 0, 3)
    assert anchor(pages, 1, "«ABC»") == (1, 0, 3)
    assert anchor(pages, 1, "zz") is None


def test_alignment_and_subsequence():
    got = align(["one", "two", "three"], ["one", "tw", "o", "three"])
    assert {i: [s.word for s in shares] for i, shares in got.items()} == {0: [0], 1: [1, 2], 2: [3]}
    assert align(["foo", "bar"], ["foobar"]) == {0: [(0, 0.0, 0.5)], 1: [(0, 0.5, 1.0)]}
    assert ratio("abc", "abc") == 1.0
    assert increasing([5, 1, 2, 9, 3]) == [1, 2, 4] and increasing([]) == []
