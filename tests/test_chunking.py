"""Golden rules and properties of the chunker."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.operators.chunking import check_window, chunk_documents, chunk_spans, clean_text


def test_empty_and_blank():
    assert chunk_spans("") == []
    assert chunk_spans(None) == []
    assert chunk_spans(" \t\n   ") == []


@pytest.mark.parametrize("n,expected", [
    (450, [(0, 500)]),                 # end_char is not clamped to the text length
    (451, [(0, 500), (450, 950)]),     # 451..500 chars leave a tail chunk of 1..50
    (500, [(0, 500), (450, 950)]),
    (501, [(0, 500), (450, 950)]),
])
def test_lengths_without_dots(n, expected):
    spans = [(s, e) for _, s, e in chunk_spans("a" * n)]
    assert spans == expected


def test_tail_chunk_after_full_window():
    # a window that ends 1..50 chars before the end leaves a short tail chunk
    out = chunk_spans("b" * 900)
    assert [(s, e) for _, s, e in out] == [(0, 500), (450, 950)]
    out = chunk_spans("b" * 950)
    assert [(s, e) for _, s, e in out] == [(0, 500), (450, 950), (900, 1400)]
    assert out[-1][0] == "b" * 50
    out = chunk_spans("b" * 951)
    assert [(s, e) for _, s, e in out] == [(0, 500), (450, 950), (900, 1400)]
    assert out[-1][0] == "b" * 51


def test_dot_position_rule():
    # last dot at index 251 (> 250) cuts the window, at 250 it does not
    t = "x" * 251 + "." + "y" * 600
    assert chunk_spans(t)[0][1:] == (0, 252)
    t = "x" * 250 + "." + "y" * 600
    assert chunk_spans(t)[0][1:] == (0, 500)


def test_dot_only_considered_when_text_continues():
    t = "x" * 300 + "." + "y" * 199          # n = 500: window reaches the end, no cut
    assert chunk_spans(t)[0][1:] == (0, 500)


def test_only_dots():
    spans = chunk_spans("." * 1200)
    assert [(s, e) for _, s, e in spans][:2] == [(0, 500), (450, 950)]


def test_unicode_whitespace_and_multibyte():
    t = "é ü\u001cß ç   日本"
    assert clean_text(t) == "é ü ß ç 日本"
    out = chunk_spans(t)
    assert out == [("é ü ß ç 日本", 0, 500)]


def test_offsets_refer_to_cleaned_text():
    t = "  a   b  " + "c" * 600
    clean = clean_text(t)
    for text, s, e in chunk_spans(t):
        assert text == clean[s:e].strip()


def test_window_check():
    with pytest.raises(ValueError):
        check_window(500, 252)
    with pytest.raises(ValueError):
        check_window(0, 0)
    check_window(500, 50)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab. \n é")), min_size=0, max_size=3000))
def test_properties(text):
    spans = chunk_spans(text)
    n = len(clean_text(text))
    if n == 0:
        assert spans == []
        return
    assert spans[0][1] == 0
    for (_, s1, e1), (_, s2, _) in zip(spans, spans[1:]):
        assert s2 == e1 - 50                       # overlap of 50
        assert 252 <= e1 - s1 <= 500               # width bounds for non-final windows
    assert spans[-1][2] >= n                       # the spans cover the text


def test_spark_matches_python(spark):
    rows = [(1, "Hello world. " * 100), (2, ""), (3, "x" * 1001), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.chunk_id, r.text, r.start_char, r.end_char, r.total_chunks)
                 for r in chunk_documents(df).collect())
    want = []
    for d, t in rows:
        sp = chunk_spans(t)
        want += [(d, i, c, s, e, len(sp)) for i, (c, s, e) in enumerate(sp)]
    assert got == sorted(want)


def test_carried_columns_stay_exact_beside_nulls(spark):
    df = spark.createDataFrame([(1, 9007199254740993, "some text. " * 60), (2, None, "short one")], "doc_id long, size long, text string")
    got = {(r.doc_id, r.size) for r in chunk_documents(df).collect()}
    assert got == {(1, 9007199254740993), (2, None)}
