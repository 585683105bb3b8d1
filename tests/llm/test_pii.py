"""Personal data against plain patterns, checksums, context words, odd rows."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rolebook.llm import pii as P
from rolebook.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=3000, deadline=None)
@given(st.text(st.sampled_from("a.%+-@@ 0123456789().é4"), max_size=60))
def test_like_plain(text):
    assert [s for s in P.propose(text) if s[0] != "iban"] == plain(text)


CASES = ["a@b.c.@d.e", "x@@b.c a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.4", "4111 1111-1111 1111", "+1 (988) 555-2485", "+1  2", "4111111111111111 1"]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert [s for s in P.propose(text) if s[0] != "iban"] == plain(text)


def test_iban_and_context():
    text = "é iban DE89 3704 0044 0532 0130 00 AND more"
    (s,) = P.scored(text)
    assert (s["kind"], text[s["start"] : s["end"]], s["score"]) == ("iban", "DE89 3704 0044 0532 0130 00", 1.0)
    assert not P.scored("DE88370400440532013000 ")


def test_context_alone_decides():
    """Numbers without a checksum are spans only where words around them say so."""
    found = lambda t: [(s["kind"], t[s["start"] : s["end"]]) for s in P.scored(t)]
    assert found("account 12345678 is ours") == [("account", "12345678")]
    assert found("the 12345678 Konto") == [("account", "12345678")]
    assert found("we sold 12345678 of them") == []
    assert found("invoice to account 12345678") == []
    assert found("my SSN: 123-45-6789.") == [("national", "123-45-6789")]
    assert found("part 123-45-6789") == [] and found("ssn 000-45-6789") == [] and found("ssn 123-45-67890") == []
    # what another span holds is not added again
    assert found("account card 4111111111111111 x") == [("card", "4111111111111111")]
    assert P.mask("bank account 1234567890, yes") == "bank account [ACCOUNT], yes"
    assert found("account " + "9" * 18) == [] and found("account 1.12345678") == [] and found("account 12345678.5") == []


def test_scores_follow_context():
    assert P.scored("server 1.2.3.4")[0]["score"] > P.scored("so 1.2.3.4")[0]["score"] > P.scored("version 1.2.3.4")[0]["score"]
    assert P.mask("mail a@b.cd, card 4111111111111111.") == "mail [EMAIL], card [CARD]."


def test_long_runs():
    for run in ("a", "1", "1.", "1 ", "+1", "@", "a@"):
        P.scored(run * 200_000)


def test_query(spark, tmp_path):
    rows = [(i, t, "k", 3) for i, t in enumerate([*CASES, "", None, "é a@b.cd"])] + [(None, "a@b.cd", "k", 3), (3, CASES[3], "k", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, kind string, spans int").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op7_pii"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(next(t for i, t, *_ in rows if i == r.doc_id) or "")
        s = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (r.spans, r.base_sha256) == (s, hashlib.sha256(s.encode()).hexdigest())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in want) for x in PLAIN]
    masked = P.masked(spark.createDataFrame([(1, "a@b.cd", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, kind string"))
    assert [tuple(r) for r in masked.orderBy("doc_id").collect()] == [(1, "[EMAIL]", "x"), (2, None, "y"), (3, "", "z")]
