import sqlite3

import pytest
from hypothesis import given, settings, strategies as st

from scrollmill.functions.tokens import edits, token_list
from scrollmill.operators import postings, search
from scrollmill.plans.query_language import Phrase, expression

TEXTS = [
    "alpha beta", "alpha alpha beta", "cobalt-heron nests", "The rate limit is 5. Rate-limit again: rate limit", "gamma", "beta gamma delta", "Résumé of a café visit",
    "naïve Ångström 東京都 日本語", "", None, "alpha beta", "under_score x1 y2", "a b a b a", " ".join(f"w{i}" for i in range(60)) + " needle " + " ".join(f"v{i}" for i in range(60)),
]
QUERIES = [
    "alpha", "alpha beta", "alpha AND beta OR gamma", "beta NOT gamma delta", '"rate limit"', "rate-limit", "resume cafe", "alph*", '"gamma del"*', "a b", '"a b"', "alpha ?!", "alpha AND ?!",
    "?!", "alpha OR ?!", "alpha NOT ?!", "日本語", "angstrom", "alpha alpha", "NOT alpha", "under score", "w1*", "zzz",
]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, i % 2, f"s{i % 3}", i, i % 2, t, "/p", i, 0, 0, 1, "clash") for i, t in enumerate(TEXTS)]
    names = "chunk_id bigint, agent int, native_id string, ordinal bigint, kind int, text string, source_path string, source_file_id bigint, source_generation bigint, source_start bigint, source_end bigint, term string"
    return spark.createDataFrame(rows, names).cache()


@pytest.fixture(scope="module")
def index():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(text, tokenize='unicode61')")
    db.executemany("insert into t(rowid, text) values (?, ?)", list(enumerate(TEXTS)))
    return db


@pytest.mark.parametrize("query", QUERIES)
def test_hits_and_scores_equal_an_independent_index(chunks, index, query):
    text = expression(query)
    want = dict(index.execute("select rowid, bm25(t) from t where t match ?", (text,)).fetchall())
    got = {r["chunk_id"]: r["score"] for r in search.hits(chunks, text).select("chunk_id", "score").collect()}
    assert got == pytest.approx(want, abs=1e-9)


@pytest.fixture(scope="module")
def stored(chunks, tmp_path_factory):
    return postings.build(chunks, str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize("query", QUERIES)
def test_stored_postings_give_the_same(stored, index, query):
    text = expression(query)
    want = dict(index.execute("select rowid, bm25(t) from t where t match ?", (text,)).fetchall())
    got = {r["chunk_id"]: r["score"] for r in search.hits(stored, text).select("chunk_id", "score").collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_stored_postings_empty_and_pruned(spark, chunks, stored, tmp_path):
    empty = postings.build(chunks.limit(0), str(tmp_path / "e"))
    assert search.hits(empty, '"alpha"').count() == 0 and search.search(empty, "alpah").results.count() == 0
    assert {tuple(r) for r in search.vocabulary(stored).collect()} == {tuple(r) for r in search.vocabulary(chunks).collect()}
    plan = search.hits(stored, '"alpha"')._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,alpha)" in plan and "text" not in plan
    first = spark.createDataFrame([(1, "s1", 3), (0, "s1", 2)], "agent int, native_id string, grp int")
    for query in ("alpha", "gama", "alpha*"):
        rows = [[(r["place"], r["chunk_id"], r["grp"]) for r in search.search(c, query, priorities=first).results.orderBy("place").collect()] for c in (chunks, stored)]
        assert rows[0] == rows[1] and rows[0]
    assert search.search(stored, "alpha", priorities=first).per_group() == [(2, 1), (3, 1)]
    shown = stored.with_chunks(search.search(stored, "needle").results).collect()
    assert [r["source_path"] for r in shown] == ["/p"]


@pytest.mark.parametrize("query", ["needle", "alpha", '"rate limit"', "rate again", "gamma"])
def test_snippets_equal_an_independent_index(index, query):
    text = expression(query)
    from scrollmill.plans.query_language import parse, phrases

    for rowid, want in index.execute("select rowid, snippet(t, 0, '', '', ' … ', 24) from t where t match ?", (text,)):
        assert search.snippet(TEXTS[rowid], phrases(parse(text))) == want


def test_vocabulary(chunks, index):
    index.execute("create virtual table if not exists v using fts5vocab(t, row)")
    want = {(t, d, n) for t, d, n in index.execute("select term, doc, cnt from v")}
    assert {tuple(r) for r in search.vocabulary(chunks).collect()} == want


@given(st.text(alphabet="abc", max_size=6), st.text(alphabet="abc", max_size=6))
@settings(max_examples=80, deadline=None)
def test_edits(a, b):
    d = edits(a, b, 99)
    assert d == edits(b, a, 99) and (d == 0) == (a == b) and d >= abs(len(a) - len(b))
    assert edits(a, b, d) == d and (d == 0 or edits(a, b, d - 1) is None)


def test_edits_fixed():
    assert edits("ab", "ba", 2) == 1 and edits("ca", "abc", 3) == 3


def test_retry_priorities_limits(spark, chunks):
    out = search.search(chunks, "gama", limit=10)
    assert [r["chunk_id"] for r in out.results.collect()] == [4, 5] and str(out.widened[0]).startswith("gama → gamma")
    assert search.search(chunks, "gama", fallback=False).results.count() == 0
    assert search.search(chunks, "   ").results.count() == 0 and search.search(chunks, "alpha", limit=0).results.count() == 0
    assert search.search(chunks, "qqqqzz").widened == []
    first = spark.createDataFrame([(1, "s1", 3), (1, "s1", 1), (0, "s1", 2), (0, "zz", 0)], "agent int, native_id string, grp int")
    out = search.search(chunks, "alpha", priorities=first)
    rows = [(r["place"], r["chunk_id"], r["grp"]) for r in out.results.orderBy("place").collect()]
    assert rows[:2] == [(0, 1, 1), (1, 10, 2)] and {r[1] for r in rows} == {0, 1, 10} and out.prioritized == 2
    assert search.hits(chunks.limit(0), '"alpha"').count() == 0
    user = search.hits(chunks, '"alpha"', 0).select("chunk_id", "score").collect()
    both = {r["chunk_id"]: r["score"] for r in search.hits(chunks, '"alpha"').collect()}
    assert {r["chunk_id"] for r in user} == {0, 10} and all(both[r["chunk_id"]] == r["score"] for r in user)


def test_ranges_and_output(spark, chunks):
    assert search.ranges("Café alpha-Beta", ["alpha", "be*"]) == [(6, 11), (12, 16)]
    assert token_list("É́a_b") == ["ea", "b"] and search.frequency(Phrase(("a",)), search.tokens(search.F.lit("a"))) is not None


def test_longer_forms_do_not_displace_near_words(spark):
    forms = [(f"snapshot{i:02d}", 90) for i in range(100)]
    terms = spark.createDataFrame([*forms, ("snapshat", 1), ("snapsh", 2)], "term string, n_chunks bigint")
    assert search.near_words(terms, "snapshot") == ["snapshat", "snapsh"]
    assert search.near_words(terms.union(spark.createDataFrame([("snapshot", 1)], terms.schema)), "snapshot") is None
