import pytest

from scrollmill.llm import pii

LEXICON = [("Olana", "given"), ("Torvik", "given"), ("Mark", "given"), ("Kroftby", "family"), ("Stack", "family"), ("Osterby", "family")]


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("mail <a.b+c@mx2.site.example>.", "email", "a.b+c@mx2.site.example"),
        ("at A_B [at] site [dot] test now", "email", "A_B [at] site [dot] test"),
        ("x=joe(at)site.example;", "email", "joe(at)site.example"),
        ("joe at site dot example wrote", "email", "joe at site dot example"),
        ("call (376) 555-0116.", "phone", "(376) 555-0116"),
        ("((376) 555-0116)", "phone", "(376) 555-0116"),
        ("(499 555 0128) at noon", "phone", "499 555 0128"),
        ("fax/+1‑837‑555‑0132;", "phone", "+1‑837‑555‑0132"),
        ("tel. 030/23125103.", "phone", "030/23125103"),
        ("+33 1 99 00 63 60", "phone", "+33 1 99 00 63 60"),
        ("0044 7700 900 400", "phone", "0044 7700 900 400"),
        ("SSN: 885947257, ok", "id_number", "885947257"),
        ("The form holds 815-37-6560.", "id_number", "815-37-6560"),
        ("NI no QQ 48 56 99 B", "id_number", "QQ 48 56 99 B"),
        ("mi DNI es 96729544-A,", "id_number", "96729544-A"),
        ("mi documento de identidad 96729544-A.", "id_number", "96729544-A"),
        ("tax id 56 599 152 551", "id_number", "56 599 152 551"),
        ("driver's licence F160-4737-6153", "id_number", "F160-4737-6153"),
        ("id card LG87Z7919", "id_number", "LG87Z7919"),
        ("at 1093 East Meadow Parkway;", "street_address", "1093 East Meadow Parkway"),
        ("Meet at Saddlegasse 6, 78934 Wick on", "street_address", "Saddlegasse 6, 78934 Wick"),
        ("Calle Easel 20, 2º C.", "street_address", "Calle Easel 20, 2º C"),
        ("12 avenue des Bargegates, 23178 Burgh", "street_address", "12 avenue des Bargegates, 23178 Burgh"),
    ],
)
def test_formed(text, kind, value):
    assert [(k, text[s:e]) for s, e, k in pii.formed(text)] == [(kind, value)]


@pytest.mark.parametrize(
    "text",
    ["git@code.site.example:a/b.git", "Use @rotate above", "Pin dial@2.25.6", "Build 4.555.01.60 passed", "The epoch value 0102251030207 is", "Bytes 874-005-831 differ", "The Harbor Street theme", "on 192.0.2.14"],
)
def test_decoys(text):
    assert pii.formed(text) == []


def _spans(spark, texts):
    items = spark.createDataFrame([("t", i, x, "clash") for i, x in enumerate(texts)], "item_table string, item_id bigint, text string, kind string")
    lexicon = spark.createDataFrame(LEXICON, "token string, name_part string")
    found = pii.spans(items, lexicon)
    return items, found, {(r["item_id"], r["pii_type"], texts[r["item_id"]][r["start_char"] : r["end_char"]]) for r in found.collect()}


def test_names_known_learned_and_small(spark):
    texts = [f"Reviewed-by: {g} {f}." for g, f in [("Olana", "Kroftby"), ("Torvik", "Osterby"), ("Torvik", "Kroftby"), ("Olana", "Osterby")] * 3]
    texts += ["Reviewed-by: Zelka Wexman.", "Reviewed-by: Wexman, Zelka", "Ask Zelka B. Wexman twice", "OLANA KROFTBY", "Dr. T. Kroftby", "torvik osterby wrote", "we mark stack here", "mark stack and mark", "the mark, a stack" + ", the mark, a stack" * 6]
    texts += ["See Merge Stack", None, "", "See Merge Queue", "x " * 200_000 + "Olana Kroftby", "Olana Kroftby"]
    items, found, got = _spans(spark, texts)
    at = len(texts) - 15
    names = {(i, v) for i, k, v in got if k == "person_name"}
    assert {(at, "Zelka Wexman"), (at + 1, "Wexman, Zelka"), (at + 2, "Zelka B. Wexman"), (at + 3, "OLANA KROFTBY"), (at + 4, "T. Kroftby"), (at + 5, "torvik osterby")} <= names
    assert not {v for i, v in names if at + 6 <= i <= at + 12}
    assert (len(texts) - 2, "Olana Kroftby") in names
    out = {r["item_id"]: (r["text"], r["n_replaced"]) for r in pii.redact(items, found).collect()}
    assert out[at + 4] == ("Dr. [PERSON_NAME]", 1) and out[at + 6] == ("we mark stack here", 0) and out[len(texts) - 5][0] is None


def test_small_names_that_stand_in_addresses(spark):
    texts = ["ask olana osterby about it"] + [f"write to olana.osterby@m{i}.example" for i in range(5)]
    assert (0, "person_name", "olana osterby") in _spans(spark, texts)[2]


def test_words_that_are_also_names_need_a_part_that_discloses(spark):
    texts = [f"Reviewed-by: {g} {f}." for g, f in [("Olana", "Kroftby"), ("Torvik", "Osterby")] * 6]
    # `Mark` and `Stack` are names in the lexicon, here mostly words: together no person, with a known family one
    texts += ["Mark the line. Mark it. Stack them. Stack up."] * 20 + ["Mark Stack", "Mark Kroftby"]
    items, found, got = _spans(spark, texts)
    names = {(i, v) for i, k, v in got if k == "person_name" and i >= 12}
    assert names == {(len(texts) - 1, "Mark Kroftby")}
    lexicon = spark.createDataFrame(LEXICON, "token string, name_part string")
    told = {(r["term"], r["part"]): r for r in pii.disclosure(pii.scan(items, lexicon)).collect()}
    assert told["olana", "given"]["share"] == 1 and told["mark", "given"]["share"] < pii.LEAST_SHARE


def test_lone_terms_of_a_person_are_removed_too(spark):
    texts = [f"Reviewed-by: {g} {f}." for g, f in [("Olana", "Kroftby"), ("Torvik", "Osterby")] * 6]
    texts += ["Olana Kroftby came. Kroftby, that is Olana, left; kroftby mail.", "Kroftby alone", "Mark the time: Mark Kroftby said Kroftby's late.", "x", None, "", *["Mark it."] * 5]
    items = spark.createDataFrame([("t", i, x, "clash") for i, x in enumerate(texts)], "item_table string, item_id bigint, text string, kind string")
    lexicon = spark.createDataFrame(LEXICON, "token string, name_part string")
    want = ["[PERSON_NAME] came. [NAME], that is [NAME], left; kroftby mail.", "Kroftby alone", "Mark the time: [PERSON_NAME] said [NAME]'s late.", "x", None, ""]
    for most in (pii.small, lambda df: False):
        pii.small, kept = most, pii.small
        out = {r["item_id"]: r for r in pii.redacted(items, lexicon).collect()}
        pii.small = kept
        assert [out[12 + i]["text"] for i in range(6)] == want and [out[12 + i]["n_terms"] for i in range(4)] == [2, 0, 1, 0]


def test_empty(spark):
    items, found, got = _spans(spark, [None])
    assert got == set() and found.count() == 0
    empty = spark.createDataFrame([], "token string, name_part string")
    assert [r["text"] for r in pii.redacted(items, empty).collect()] == [None]
    assert pii.redacted(items.limit(0), empty).count() == 0
