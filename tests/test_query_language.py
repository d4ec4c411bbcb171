"""The mini-language against its rules: expected expressions are built by rule from generated parts,
and what the parser makes of an expression is compared with an embedded full-text index."""

import random
import sqlite3

import pytest
from hypothesis import given, settings, strategies as st

from scrollmill.plans.query_language import MOST_WIDENED, Node, Phrase, Widening, classify, expression, highlight_terms, lenient, parse, phrases, split, widenable

WORDS = ["moss", "lantern", "gravel", "tide", "orchard", "pebble", "violet", "kiln"]
SIGNS = "-+^():/.,;#'!?~{}[]\\"
OPS = ("AND", "OR", "NOT")


def quoted(text, star=""):
    return '"' + text.replace('"', '""') + '"' + star


literal = st.text(alphabet="abkz" + SIGNS, min_size=1, max_size=8).filter(lambda t: t not in OPS)
term = st.one_of(
    literal.map(lambda t: (t, quoted(t))),
    st.sampled_from(WORDS).map(lambda w: (w + "*", quoted(w, "*"))),
    st.lists(st.sampled_from(WORDS), min_size=1, max_size=3).map(lambda ws: (quoted(" ".join(ws)), quoted(" ".join(ws)))),
    st.lists(st.sampled_from(WORDS), min_size=1, max_size=3).map(lambda ws: (quoted(" ".join(ws), "*"), quoted(" ".join(ws), "*"))),
)


@given(st.lists(term, max_size=6), st.sampled_from([" ", "  ", "\t", " \n "]))
@settings(max_examples=200, deadline=None)
def test_terms_side_by_side_are_each_quoted(terms, gap):
    assert expression(gap + gap.join(t for t, _ in terms) + gap) == " ".join(want for _, want in terms)


@given(st.lists(term, min_size=2, max_size=5), st.data())
@settings(max_examples=150, deadline=None)
def test_an_operator_counts_between_two_terms(terms, data):
    ops = [data.draw(st.sampled_from(("", *OPS))) for _ in terms[1:]]
    typed, want = terms[0]
    for op, (t, w) in zip(ops, terms[1:]):
        typed += f" {op} {t}"
        want += f" {op} {w}" if op else f" {w}"
    assert expression(typed) == want


@pytest.mark.parametrize("op", OPS)
def test_an_operator_elsewhere_is_a_word(op):
    assert expression(op) == quoted(op)
    assert expression(f"{op} moss") == f'{quoted(op)} "moss"'
    assert expression(f"moss {op}") == f'"moss" {quoted(op)}'
    assert expression(f"moss {op.lower()} tide") == f'"moss" {quoted(op.lower())} "tide"'
    # of two operators in a row the first is a word, unless it is AND before NOT
    for other in OPS:
        want = '"moss" NOT "tide"' if (op, other) == ("AND", "NOT") else f'"moss" {quoted(op)} {other} "tide"'
        assert expression(f"moss {op} {other} tide") == want


def test_quotes_that_open_no_phrase():
    for word in WORDS[:3]:
        assert expression(f'{word}"x') == quoted(f'{word}"x')
        assert expression(f'"{word} and more') == quoted(f"{word} and more")
        assert expression(f'"{word}"x') == quoted(f'"{word}"x')
        assert expression(f'"{word} ""two"" end"') == quoted(f'{word} "two" end')
    assert expression("**") == quoted("**") and expression("") == "" and expression("檜 楓*") == '"檜" "楓"*'


def test_every_expression_is_one_the_index_takes():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(text, tokenize='unicode61')")
    texts = [" ".join(random.Random(i).choices(WORDS, k=6)) for i in range(60)]
    db.executemany("insert into t(rowid, text) values (?, ?)", list(enumerate(texts)))

    def holds(tree, words):
        if isinstance(tree, Phrase):
            n = len(tree.tokens)
            fits = lambda a, b, last: a.startswith(b) if last and tree.prefix else a == b
            return n > 0 and any(all(fits(words[i + k], tree.tokens[k], k == n - 1) for k in range(n)) for i in range(len(words) - n + 1))
        parts = [holds(p, words) for p in tree.parts]
        return all(parts) if tree.op == "AND" else any(parts) if tree.op == "OR" else parts[0] and not any(parts[1:])

    rng = random.Random(4)
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 5)):
            word = rng.choice(WORDS)
            parts.append(rng.choice([word, word[:3] + "*", quoted(f"{word} {rng.choice(WORDS)}"), word + "-" + rng.choice(WORDS), rng.choice(OPS), "?!", word + '"']))
        text = expression(" ".join(parts))
        tree = parse(text)
        want = {r[0] for r in db.execute("select rowid from t where t match ?", (text,))}
        assert {i for i, t in enumerate(texts) if tree and holds(tree, t.split())} == want, text


def test_precedence():
    a, b, c = Phrase(("moss",)), Phrase(("tide",)), Phrase(("kiln",))
    text = '"moss" {} "tide" {} "kiln"'
    tight = {"": 3, "NOT": 2, "AND": 1, "OR": 0}
    for one in tight:
        for two in tight:
            x, y = one or "AND", two or "AND"
            got = parse(text.format(one, two))
            if one == two:
                assert got == Node(x, (a, b, c))
            elif tight[one] > tight[two]:
                assert got == Node(y, (Node(x, (a, b)), c))
            else:
                assert got == Node(x, (a, Node(y, (b, c))))
    assert parse('("moss" OR "tide") AND "kiln"*') == Node("AND", (Node("OR", (a, b)), Phrase(("kiln",), True)))
    assert parse('"moss" "..."') == a and parse('"moss" AND "..."') == Node("AND", (a, Phrase(()))) and parse("") is None
    assert phrases(parse('"moss-tide" OR "moss-tide"')) == [Phrase(("moss", "tide"))] * 2


def near(word):
    return [word[::-1]]


def group(word):
    return f'({quoted(word, "*")} OR {quoted(word[::-1])})'


def test_a_retry_widens_bare_words_only():
    for word in WORDS:
        text, widened = lenient(word.capitalize(), near)
        assert text == group(word) and str(widened[0]) == f"{word} → {word[::-1]}, {word}*"
        for other in (quoted(word + " x"), word + "*", word + "-x", word[:3], "9" * len(word), "AND", f"ab NOT {word}"):
            assert lenient(other, near) is None and widenable(other) == []
    # terms beside a group are joined by AND; what NOT rules out stays as it is
    text, _ = lenient('moss "a b" OR tide NOT kiln', near)
    assert text == f'{group("moss")} AND "a b" OR {group("tide")} NOT "kiln"'
    text, _ = lenient("violet pebble", near)
    assert text == f'{group("violet")} AND {group("pebble")}'


def test_a_retry_asks_for_each_word_once_and_for_a_bounded_number():
    asked = []
    many = [f"stem{chr(97 + i)}" for i in range(MOST_WIDENED + 3)]
    text, widened = lenient(" ".join([many[0], *many]), lambda w: asked.append(w) or near(w))
    assert asked == many[:MOST_WIDENED] == [w.typed for w in widened]
    assert text.endswith(" ".join(quoted(w) for w in many[MOST_WIDENED:]))
    # a word that is indexed is kept and does not count
    asked = []
    text, widened = lenient(" ".join(many), lambda w: asked.append(w) or (None if w in many[:2] else near(w)))
    assert asked == many[: MOST_WIDENED + 2] and [w.typed for w in widened] == many[2 : MOST_WIDENED + 2]
    assert text.startswith(f'{quoted(many[0])} {quoted(many[1])} AND {group(many[2])}')
    assert lenient("moss tide", lambda w: None) is None


def test_small_parts():
    assert split('moss "tide kiln" x') == ["moss", '"tide kiln"', "x"] and split(" \n") == []
    assert classify("Moss").word == "moss" and classify("oak").word is None and classify("OR").op
    assert highlight_terms('Moss OR til* "tide Kiln" NEAR') == ["moss", "til*", "tide", "kiln"]
    assert highlight_terms("mos", [Widening("mos", ["moss"])]) == ["mos", "moss", "mos*"]
