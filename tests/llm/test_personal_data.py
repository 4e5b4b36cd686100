import re

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bioquery.llm import personal_data as pd

ANCHORS = pd.automaton()
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The base spans by regular expressions."""
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pd.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end()))
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab1250 .@+-()9é4", max_size=60))
def test_base_equals_patterns(text):
    assert pd.find(text, ANCHORS)[0] == plain(text)


def test_base_on_documents():
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        assert pd.find(text, ANCHORS)[0] == plain(text)


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("mail jörg@example.de now", "contact:5:20"),
        ("joe (at) example (dot) org", "contact:0:26"),
        ("host 2001:db8::1 up", "address:5:16"),
        ("https://bob:pw1@host/x", "account:8:15"),
        ("IBAN: DE89370400440532013000.", "account:6:28"),
        ("SSN 123-45-6789 ok", "account:4:15"),
        ('token = "24be64439e3e49cf46b2"', "account:9:29"),
    ],
)
def test_added(text, span):
    assert span in pd._joined(pd.find(text, ANCHORS)[1]).split(",")


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 up", "address:5:44"),
        ("token=" + "a1" * 1000, "account:6:2006"),
        ("token=" * 3 + "a1" * 1000, "account:18:2018"),
        ("https://bob:" + "p" * 600 + "@host/x", "account:8:612"),
        ('apiKey="24be64439e3e49cf46b2"', "account:8:28"),
        ("İ SeCrEt: 24be64439e3e49cf46b2", "account:10:30"),
        ("addresses 2001:db8:0:0:0:0:0:1: two", "address:10:30"),
        ("jörg" * 100 + "@" + "bücher." * 50 + "de", "contact:0:753"),
        ("u" * 100 + " (AT) " + "host" * 30 + " (Dot) org", "contact:0:236"),
    ],
)
def test_added_in_full(text, span):
    assert span in pd._joined(pd.find(text, ANCHORS)[1]).split(",")


@pytest.mark.parametrize("text", ["", "Licensed under the Apache License, Version 2.0.", "the token of the account", "a@b", "12:30 :: x"])
def test_clean(text):
    assert pd.find(text, ANCHORS) == ([], [])


def test_table(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "a@b.cd", 6), (None, "", 7)], "doc_id long, text string, spans int")
    rows = pd.scan(df).collect()
    assert [(r.doc_id, r.n_email, r.spans) for r in rows] == [(1, 0, ""), (1, 1, "email:0:6"), (None, 0, "")]
    assert pd.scan(df.limit(0)).count() == 0


def test_time_grows_with_the_text():
    import time

    for part in (":", "a:", "@", "a@", "a(at)", "token=", "1.", "1 ", "+1", "account 1", "https://a@"):
        pd.find(part * 1000, ANCHORS)
        seconds = []
        for n in (20_000, 80_000):
            began = time.perf_counter()
            pd.find(part * n, ANCHORS)
            seconds.append(time.perf_counter() - began)
        assert seconds[1] < 8 * seconds[0] + 0.2, part


def test_repeated_rows_long_text_and_extra_columns(spark):
    long = "word " * 2_000_000 + "a@b.cd"
    df = spark.createDataFrame([(1, "a@b.cd", "x"), (1, "a@b.cd", "x"), (2, long, None)], "doc_id long, text string, n_email string")
    rows = sorted((r.doc_id, r.n_email, r.spans) for r in pd.scan(df).collect())
    assert rows == [(1, 1, "email:0:6")] * 2 + [(2, 1, "email:10000000:10000006")]
