import random

from scrollmill.llm import leaks
from scrollmill.llm.words import words

SCHEMA_D, SCHEMA_I = "doc_id bigint, text string, item_id bigint", "item_id bigint, item_text string, text string"
NOUNS = [f"{a}{b}" for a in ("bar", "cel", "dri", "fer", "gul", "har") for b in [x + y for x in "bcdfglmnprst" for y in ("ak", "em", "ol", "ut")]]


def items(rng, n=40):
    out = []
    for i in range(n):
        own = [f"Two commits later the {rng.choice(NOUNS)} replaced {rng.choice(NOUNS)} by {rng.choice(NOUNS)} and the {rng.choice(NOUNS)} shrank from {rng.randint(2, 999)} to {rng.randint(2, 999)} entries." for _ in range(4)]
        out.append((i, "Read the text below and answer it in your own words. " + " ".join(own), "clash"))
    return out


def run(spark, docs, tests):
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], SCHEMA_D)
    return {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, spark.createDataFrame(tests, SCHEMA_I)).collect()}


def test_leaks(spark):
    rng = random.Random(5)
    tests = items(rng)
    body = lambda i: tests[i][1].split("words. ")[1]
    sentences = lambda i: body(i).split(". ")
    altered = body(4).split()
    for k in range(3, len(altered), 7):
        altered[k] = "changed"
    wrapped = "".join(w[:2] + "-\n" + w[2:] + " " if len(w) > 8 else f"<em>{w}</em> " for w in body(5).split())
    other = " ".join(s for _, t, _ in items(random.Random(77), 3) for s in t.split("words. ")[1:])
    docs = [
        "noise " * 50 + body(1).upper() + " more", body(1), " ".join(altered), wrapped, ". ".join(reversed(sentences(6))), "x " + ". ".join(sentences(7)[:2]) + " y",
        "He said: " + " ".join(body(8).split()[:14]), other, "Read the text below and answer it in your own words.", None, "", body(1), body(2) + " filler words " * 9 + body(3),
    ]
    assert run(spark, docs, tests) == {(0, 1), (1, 1), (2, 4), (3, 5), (4, 6), (5, 7), (11, 1), (12, 2), (12, 3)}


def test_empty_null_and_blocks(spark, monkeypatch):
    rng = random.Random(6)
    tests = items(rng, 6)
    own = tests[3][1].split("words. ")[1]
    assert run(spark, [own], tests[:0]) == set()
    assert run(spark, [own], [(None, own, ""), (9, None, ""), (10, "", "")]) == set()
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 50)
    assert run(spark, [own, own], tests) == {(0, 3), (1, 3)}
    d = spark.createDataFrame([], SCHEMA_D)
    assert leaks.leaks(d, spark.createDataFrame(tests, SCHEMA_I)).count() == 0


def test_repeated_items_and_variants(spark):
    tests = items(random.Random(7), 30)
    body = lambda i: tests[i][1].split("words. ")[1]
    # item 0 stands under five more ids, twice in other letter case; item 1 in five near-equal forms
    tests += [(100 + k, tests[0][1].upper() if k > 2 else tests[0][1], "clash") for k in range(5)]
    tests += [(200 + k, tests[1][1].replace("Two commits", f"Two patches{k}", 1), "clash") for k in range(5)]
    got = run(spark, [body(0), body(1), body(2), ". ".join(body(1).split(". ")[2:])], tests)
    same, alike = {0, *range(100, 105)}, {1, *range(200, 205)}
    assert got == {(0, i) for i in same} | {(1, i) for i in alike} | {(2, 2)} | {(3, i) for i in alike}


def test_passage_that_three_items_share(spark):
    tests = items(random.Random(8), 30)
    passage = " ".join(tests[5][1].split(". ")[1:4]) + "."
    tests[6], tests[7] = (6, tests[6][1] + " " + passage, "clash"), (7, tests[7][1] + " " + passage, "clash")
    assert {(0, 5), (0, 6), (0, 7)} <= run(spark, [passage], tests)


def test_seeds_of_many_items_start_chains(spark):
    """A passage that several items share, too few for it to be common, is found for each of them."""
    rng = random.Random(12)
    tests = [(i, " ".join(f"{rng.choice(NOUNS)}" for _ in range(40)) + ".", "clash") for i in range(200)]
    passage = " ".join(rng.choice(NOUNS) for _ in range(30)) + "."
    for i in range(4):
        tests[i] = (i, tests[i][1] + " " + passage, "clash")
    assert run(spark, ["before it " + passage], tests) == {(0, i) for i in range(4)}


def test_short_items_word_for_word(spark):
    tests = [(1, "Zebra quartz", ""), (2, "lone", ""), (3, "three small words", ""), *items(random.Random(3), 5)]
    docs = ["a zebra  QUARTZ here", "zebra and quartz", "alone", "lone.", "small words three small", "three small words", ""]
    assert run(spark, docs, tests) == {(0, 1), (3, 2), (5, 3)}


def test_pre_check_loses_no_pair(spark):
    """What is left out before alignment could not have been held: the same rows without that check."""
    rng = random.Random(21)
    tests = items(rng, 12)
    index = next(leaks.blocks(spark.createDataFrame(tests, SCHEMA_I)))
    share = 1 / 3
    pool = [w for _, t, _ in tests for w in words(t)]
    for n in range(60):
        i = rng.randrange(12)
        text = words(tests[i][1])
        at = rng.randrange(len(text) - 20)
        part = [w if rng.random() > 0.2 else rng.choice(pool) for w in text[at : at + rng.randint(10, 60)]]
        code = leaks.codes([*rng.choices(pool, k=10), *part])
        groups = {}
        for d, k, p, m in index.hits(code):
            for dd, kk, pp in zip(d.tolist(), k.tolist(), p.tolist()):
                groups.setdefault(kk, []).append((dd, pp, m))
        plain = {k: h for k, hits in groups.items() if (h := leaks.verify(code, index, k, hits)) >= share * index.n_own[k]}
        kept = {k: leaks.verify(code, index, k, hits, share * index.n_own[k]) for _, k, hits in leaks.grouped(index, code, leaks.np.array([0]), share)}
        assert {k: h for k, h in kept.items() if h >= share * index.n_own[k]} == plain


def test_words():
    assert words("A <b>bo</b>ld [li­nk](http://x) café un-\nder \\u0041\\n&amp; саt") == ["a", "bold", "link", "cafe", "under", "a", "cat"]
