import random

import numpy as np
import pytest

from scrollmill.llm import truncation as x

SCHEMA = "doc_id bigint, text string, source string, kind string, digest string"


def corpus(rng, n):
    nouns = ["ledger", "watermark", "checkpoint", "harbor", "segment", "snapshot"]
    line = lambda: f"The {rng.choice(nouns)} in {rng.choice(nouns)}_{rng.choice(nouns)} is written {rng.choice(['twice', 'quietly', 'late'])} and then read by the {rng.choice(nouns)} after {rng.randint(1, 99)} tries."
    docs = []
    for i in range(n):
        body = " ".join(line() for _ in range(4))
        docs.append([body, f"$ run\n[10:0{i % 9}] INFO {rng.choice(nouns)}: closed\nOK", f"trim {rng.choice(nouns)} in {rng.choice(nouns)}-{rng.choice(nouns)}", body + "\n\n```\nrun(1)\n```", body + " LGTM"][i % 5])
    return docs


def test_signs(spark):
    rng = random.Random(3)
    docs = corpus(rng, 400)
    whole = docs[0]
    cuts = [whole[: whole.rindex("written") + 9], whole[: whole.rindex("by the") + 6], whole[: whole.rindex("check") + 5] if "check" in whole else whole[: whole.rindex("ledger") + 4], whole[:-20] + "…", docs[3][: docs[3].rindex("(1)") + 2]]
    fine = [whole, "ok", None, "  ", whole + " LGTM", docs[1]]
    rows = docs + cuts + fine + [cuts[1]]
    df = spark.createDataFrame([(i, t, [" Logs", "notes", None][i % 3], "clash", "clash") for i, t in enumerate(rows)], SCHEMA)
    found = {r["doc_id"]: r for r in x.truncated(df).collect()}
    n = len(docs)
    flagged = {i for i, r in found.items() if r["is_cut"]}
    assert {n, n + 1, n + 2, n + 3, n + 4, len(rows) - 1} <= flagged
    assert not flagged & {n + 5, n + 9, n + 10} and n + 7 not in found and n + 8 not in found
    assert len([i for i in flagged if i < n]) <= 2
    per = {r["source"]: r for r in x.rates(x.truncated(df)).collect()}
    assert set(per) == {"logs", "notes", None} and sum(r["n_cut"] for r in per.values()) == len(flagged)


def test_near_copies(spark):
    rng = random.Random(4)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + str(rng.randint(1, 999)) for _ in range(200)) + " closing words."
    early = text[: int(len(text) * 0.9)].rsplit(" ", 1)[0]
    rows = [text, early, text[: len(early) + 3], text.replace("alpha", "ALPHA"), "quite another text of some words here", text, None, "one two", ""]
    got = pairs_of(spark, rows)
    assert {a for (a, _), cut in got.items() if cut} == {1, 2}
    empty = spark.createDataFrame([], SCHEMA)
    assert x.truncated(empty).count() == 0 and x.near_copies(empty, x.scan(empty)).count() == 0


def test_aligned_against_brute_similarity():
    a, b = "a b c d e f g h i j", "a b c d e f g h i z k l"
    like, cut = x.aligned(a, b)
    assert abs(like - 5 / 6) < 1e-9 and not cut
    like, cut = x.aligned("a b c d e f g h", "a b c d e f g h i j k l")
    assert like == 1 and cut
    assert not x.aligned("a b c d e f g h", "a b c d e f g h. i j k l")[1]
    assert not x.aligned("a b c d e f g h", "a b c d e f g h\n\ni j k l")[1]
    assert not x.aligned("a b c d e f g h", "a b c d e f g h\nI j k l")[1]
    assert x.aligned("a b c d e f g h", "a b c d e f g h\ni j k l")[1]


@pytest.mark.parametrize("bucket", [256, 1])
def test_recall_of_planted_copies(spark, monkeypatch, bucket):
    """Copies cut at 20 to 95 % of their original, some words altered: 0.9 of them are found as copies."""
    monkeypatch.setattr(x, "BUCKET", bucket)
    rng = random.Random(20)
    letters = "bcdfghklmnprstvz"
    word = lambda: "".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    pool = [word() for _ in range(900)]
    texts, planted = [], []
    for i in range(240):
        words = [rng.choice(pool) for _ in range(rng.randint(110, 500))]
        texts.append(" ".join(words) + ".")
        n = round(len(words) * rng.uniform(0.2, 0.95))
        kept = words[:n]
        if i % 3 == 0:  # altered near-copies: the shingles around stay alike by 0.8
            for at in range(20, n - 10, 60):
                kept[at] = "altered"
        if i % 4 == 1 and len(words[n]) > 3:
            kept = [*kept, words[n][:3]]
        planted.append(len(texts))
        texts.append(" ".join(kept) + ["", " [truncated]", "…"][i % 3])
    texts += [texts[i][:-1] + f" {word()} {word()}." for i in range(0, len(texts), 5)]  # larger buckets
    texts += [" ".join(rng.choice(pool) for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "s", "k", "d") for i, t in enumerate(texts)], SCHEMA)
    by_copy = {r["doc_id"] for r in x.truncated(df).filter("sign = 'copy'").collect()}
    assert len(by_copy & set(planted)) >= 0.9 * len(planted)
    assert by_copy <= set(planted) | set(range(480, len(texts)))
    print("recall", len(by_copy & set(planted)) / len(planted))


def test_words_that_only_begin_longer_ones(spark):
    run = "q" * 20000
    texts = [f"the {run} and harbor stay here number {i} of them." for i in range(5)] + ["then it went to the harb", "it is " + run[:15000]]
    df = spark.createDataFrame([(i, t, "s", "k", "d") for i, t in enumerate(texts)], SCHEMA)
    sign = {r["doc_id"]: r["sign"] for r in x.truncated(df).collect()}
    assert sign[5] == "word" and sign[6] == "word" and sign[0] is None


def numbered(rng, n):
    return [f"{rng.choice(['alpha', 'beta', 'gamma', 'delta'])}{rng.randint(1, 9999)}" for _ in range(n)]


def pairs_of(spark, texts):
    df = spark.createDataFrame([(i, t, "s", "k", "d") for i, t in enumerate(texts)], SCHEMA)
    return {(r["doc_id"], r["longer_id"]): r["is_cut"] for r in x.near_copies(df, x.scan(df)).collect()}


def test_every_text_of_a_bucket(spark, monkeypatch):
    rng = random.Random(8)
    body = numbered(rng, 200)
    # longer versions, each with a word of its own, are in buckets of the cut copy and go on where it ends
    longer = [" ".join([*body[:i], f"other{i}", *body[i + 1 :], *numbered(rng, 75)]) + "." for i in range(30)]
    rows = [" ".join(body[:181]), " ".join(body) + ".", *longer]
    flagged = lambda: {a for (a, _), cut in pairs_of(spark, rows).items() if cut}
    got = pairs_of(spark, rows)
    assert flagged() == {0} and len(got) > 25
    # a bucket too large for all pairs: some stand for the rest
    monkeypatch.setattr(x, "BUCKET", 3)
    assert flagged() == {0} and len(pairs_of(spark, rows)) <= x.BANDS * x.STAND_FOR
    # and with nothing broadcast
    monkeypatch.setattr(x, "small", lambda df: False)
    assert flagged() == {0}
    monkeypatch.setattr(x, "BUCKET", 1024)
    assert pairs_of(spark, rows) == got


def test_marks_do_not_make_a_text_longer(spark):
    whole = " ".join(numbered(random.Random(9), 60))
    assert pairs_of(spark, [whole[:-6] + " [truncated]", whole + " end."])[0, 1]


def test_alignment_has_no_window():
    body = numbered(random.Random(10), 1000)
    whole = " ".join(body) + "."
    ends_early = lambda words: x.aligned(" ".join(words), whole)
    for words in (
        numbered(random.Random(11), 60) + body[:900], body[60:900], body[:300] + numbered(random.Random(12), 80) + body[300:900],
        body[:900] + [body[900][:-2]], body[:897] + ["altered"] + body[898:900], body[:830] + body[896:900],
    ):
        like, cut = ends_early(words)
        assert like >= 0.8 and cut
    for words in (body, body[:900] + ["other", "ending"], numbered(random.Random(11), 60) + body):
        assert not ends_early(words)[1]
    assert not x.aligned(" ".join(body[:900]) + ".", whole)[1]


def brute(texts):
    """All pairs that share a bucket, from the signatures of the texts one by one."""
    salts = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, x.BANDS * x.ROWS, dtype=np.int64).view(np.uint64) | np.uint64(1)
    words = [x._WORDS.findall(x.unmarked(t).lower()) for t in texts]
    steps = [s or [] for s in x.signatures(words, salts)]
    width, out = 1 + x.BANDS, {}
    keys = [{k for i, k in enumerate(s) if i % width} for s in steps]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if texts.index(b) == j and texts.index(a) == i and i != j and x.unmarked(a)[-1] not in x.STOPS and keys[j] & set(steps[i][-x.BANDS :]):
                like, cut = x.aligned(a, b)
                if like >= x.LEAST_SIMILAR:
                    out[i, j] = cut
    return out


@pytest.mark.parametrize("bucket", [256, 7, 2])
def test_no_text_of_a_large_bucket_stands_for_others(spark, monkeypatch, bucket):
    monkeypatch.setattr(x, "BUCKET", bucket)
    rng = random.Random(31)
    body = numbered(rng, 60)
    cut, swapped = body[:50], [*body[:45], "odd", body[46], "even", body[48], body[49]]
    decoy = lambda i: " ".join([*body[:i], f"other{i}", *body[i + 1 : 50]])
    # 40 texts that go on alike, but in a sentence of their own; the last one goes on in the same sentence
    texts = [f"{decoy(i)}. {body[50]} ends it {i}." for i in range(40)] + [" ".join(cut), " ".join(body) + "."]
    got = pairs_of(spark, texts)
    assert got == brute(texts) and {a for (a, _), c in got.items() if c} == {40} and len(got) > 30
    # no three of the copy's last words in a row stand in the original
    texts[40] = " ".join(swapped)
    got = pairs_of(spark, texts)
    assert got == brute(texts) and got[40, 41]
    df = spark.createDataFrame([(i, t, "s", "k", "d") for i, t in enumerate(texts)], SCHEMA)
    assert [r["sign"] for r in x.truncated(df).filter("doc_id = 40").collect()] == ["copy"]


def test_texts_of_the_same_words_go_on_differently(spark):
    body = numbered(random.Random(32), 90)
    # the same words, the longer text with a stop where the copy ends
    texts = [" ".join(body[:40]), " ".join(body[:40]) + ". " + " ".join(body[40:]) + " and more of it.", " ".join(body) + "."]
    assert pairs_of(spark, texts) == brute(texts) == {(0, 1): False, (0, 2): True}


@pytest.mark.parametrize("bucket", [256, 5])
def test_pairs_and_cuts_of_random_families(spark, monkeypatch, bucket):
    monkeypatch.setattr(x, "BUCKET", bucket)
    rng = random.Random(33)
    texts = []
    for _ in range(4):
        body = numbered(rng, 45)
        for _ in range(25):
            words = list(body[: rng.randint(30, 45)])
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(["odd", "even", words[-1][:2]])
            if rng.random() < 0.5:
                words[rng.randint(28, len(words) - 1)] += "."
            texts.append(" ".join(words) + rng.choice(["", "", ".", " [truncated]", words[-1]]))
    texts += texts[:3]
    want = brute(texts)
    df = spark.createDataFrame([(i, t, "s", "k", "d") for i, t in enumerate(texts)], SCHEMA)
    scanned = x.scan(df).cache()
    got = {(r["doc_id"], r["longer_id"]): r["is_cut"] for r in x.near_copies(df, scanned).collect()}
    assert got == want and len(got) > 300
    told = [(r["doc_id"], r["longer_id"], r["is_cut"]) for r in x.near_copies(df, scanned, cut_only=True).collect()]
    assert {a for a, _, _ in told} == {a for (a, _), c in want.items() if c} and all(c and want[a, b] for a, b, c in told)
    # others are looked through a few at a time; nothing hangs on how many
    monkeypatch.setattr(x, "_MOST_AT_ONCE", 50)
    members = [x._Member((1, 0, i, text, 0, 0, 0, *range(x.BANDS))) for i, text in enumerate(texts[:-3])]
    alike = lambda cut_only: {(a.id, b.id): like for a, near in x._alike(members, members, cut_only) for b, like in near}
    each = {(a.id, b.id): x.aligned(a.text, b.text) for a in members for b in members if a is not b}
    assert alike(False) == {p: like for p, (like, _) in each.items() if like >= x.LEAST_SIMILAR}
    assert {p for p, (_, cut) in each.items() if cut} <= set(alike(True)) <= set(alike(False))
