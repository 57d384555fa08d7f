import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from surveil.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            s = m.group()
            digits = re.sub(r"[^0-9]", "", s)
            ok = {"email": True, "ip": all(int(x) <= 255 for x in s.split(".")) if kind == "ip" else False,
                  "card": 16 <= len(digits) <= 19 and P.luhn(digits) if kind == "card" else False,
                  "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0123456789.+-@ ()aZé_\n%", max_size=60))
def test_base_spans_match_plain_patterns(text):
    assert P.base_spans(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "a.b@c.de", "a@b@c.d.", "10.0.0.255", "1.2.3.4.5.6.7.8", "1.2.300.4",
                                 "+49 (30) 1234-567", "é", "0", " ", "-", "x", "..", "@", "+1 2"]), max_size=12))
def test_base_spans_match_on_fragments(parts):
    text = "".join(parts)
    assert P.base_spans(text) == brute(text)


def test_checksums():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")
    assert P.mod97("GB82WEST12345698765432") and not P.mod97("GB82WEST12345698765433")


def test_context_moves_the_score_and_adds_spans():
    plain = P.scored_spans("number 123-45-6789 here")
    near = P.scored_spans("my ssn is 123-45-6789")
    assert plain == [] and [x[:3] for x in near] == [("ssn", 10, 21)]
    assert [x[0] for x in P.scored_spans("pay to GB82 WEST 1234 5698 7654 32 now")] == ["iban"]
    assert P.scored_spans("pay to GB83 WEST 1234 5698 7654 32 now") == []
    a = P.scored_spans("x 4111 1111 1111 1111")[0][3]
    b = P.scored_spans("card 4111 1111 1111 1111")[0][3]
    assert b > a


def test_redact_joins_overlaps():
    assert P.redact("ab 1 cd", [("email", 0, 2), ("ip", 1, 4), ("card", 5, 7)]) == "<EMAIL> <CARD>"


def test_long_adversarial_texts_are_linear():
    for text in ("9" * 200000, "1." * 100000, "a" * 200000 + "@", "a@" * 100000, "+1" + " " * 200000, "1 " * 100000):
        P.scored_spans(text)


def test_query_rows(spark):
    rows = [(1, "a.b@c.de 10.0.0.1 10.0.0.256 card 4111-1111-1111-1111 +49 30 1234567"), (2, None), (3, ""), (None, "x@y.z"),
            (1, "a.b@c.de"), (4, "é x@y.zz")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, spans string")
    got = P.digest(P.find(df)).collect()
    assert [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got] == [
        (1, 1, 1, 1, 1), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (None, 1, 0, 0, 0), (1, 1, 0, 0, 0), (4, 1, 0, 0, 0)]
    for r, (_, text) in zip(got, rows):
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text or ""))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
    red = P.find(df).filter("doc_id = 4").first().redacted
    assert red == "é <EMAIL>"
    assert P.digest(P.find(df.limit(0))).collect() == []
