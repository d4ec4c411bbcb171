import json

import pytest
from hypothesis import given, settings, strategies as st

from scrollmill.functions import strict_json

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-9999, 9999) | st.text(max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=12
)


@given(VALUES)
@settings(max_examples=60, deadline=None)
def test_deep_parser_agrees(value):
    text = json.dumps(value, indent=1)
    assert strict_json._loads_deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "{", '{"a":1,}', "[1,]", "{'a':1}", '{"a":NaN}', '{"a":1} x', "nul", '{"a" 1}', '"\t"', "01"])
def test_refused(text):
    for parser in (strict_json.loads, strict_json._loads_deep):
        with pytest.raises(ValueError):
            parser(text)


def test_extremes():
    deep = '{"a":' * 50_000 + "1" + "}" * 50_000
    assert isinstance(strict_json.loads_object(deep), dict)
    assert strict_json.loads_object('{"a":' + "9" * 6000 + "}")["a"] > 0
    assert strict_json.loads_object("[1]") is None and strict_json.loads_object(None) is None
    assert strict_json.clean("a\ud800b") == "a�b"
