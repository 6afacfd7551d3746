import hashlib
import random
import re

import numpy as np
import pytest

from pixelloom.llm.secrets import BODY, base_spans, candidates, find_secrets, labelled_findings, long_findings, scan_all, secret_digests, train, window, window_spans


def plain_spans(text):
    """The base patterns as stated, failing matches dropped afterwards."""
    letters = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    out = [("assign", *m.span()) for m in re.finditer(letters + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_spans():
    rng = random.Random(4)
    parts = ["password", "PassWd", "toKen", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "abc", "abcdef", "AKIA", "0123456789abcdef", "Z9" * 8, "é", "\n", "ſecret", "toKen=", "/+_-."]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert base_spans(t) == plain_spans(t), t


def test_network_on_unseen_findings():
    net = train()
    rows = labelled_findings(1500, 77)
    found = net.scores(np.stack([window(t, a, b) for t, a, b, _ in rows])) >= net.threshold
    label = np.array([r[3] for r in rows]) == 1
    assert found[label].mean() > 0.95 and found[~label].mean() < 0.02


def test_whole_candidates_are_scored():
    for n in (16, 40, 41, 48, 1000):
        spans = window_spans(5, 5 + n)
        assert {i for a, b in spans for i in range(a, b)} == set(range(5, 5 + n)) and all(b - a == min(n, BODY) for a, b in spans)
    net, key = train(), "gh" + "p_a8Kd02mQpZ7rT1vX9yB4cE6fG3hJ5kL0"
    path = "files.example.com/bucket/folder/name/other/"
    assert [s[:3] for s in scan_all([f"see {path}{key} now"], net)[0][1]] == [("network", 4, 4 + len(path + key))]
    assert scan_all([f"see {path}thing/page/of/the/site/number12.html now"], net) == [([], [])]
    rows = long_findings(1000, 78)
    found = net.span_scores(r[:3] for r in rows) >= net.threshold
    label = np.array([r[4] > 0 for r in rows])
    assert found[label].mean() > 0.95 and found[~label].mean() < 0.02


def test_what_base_spans_leave_of_a_run():
    net, access, other, hexa = train(), "AKIA" + "IOSFODNN7EXAMPLE", "wJalrXUtnFEMI/K7MDENG/bPx" + "RfiCYzEXAMPLEKEY7", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    key = "gh" + "p_a8Kd02mQpZ7rT1vX9yB4cE6fG3hJ5kL0"
    for kind, one, two in (("access", access, "/" + other), ("hex", hexa, "-" + key)):
        assert [s[:3] for s in scan_all([f"see {one}{two} now"], net)[0][1]] == [(kind, 4, 4 + len(one)), ("network", 4 + len(one), 4 + len(one + two))]
    assert [s[:3] for s in scan_all([f"see {key}.{hexa}_{key[::-1]} now"], net)[0][1]] == [("network", 4, 41), ("hex", 41, 81), ("network", 81, 118)]
    rng = random.Random(6)
    parts = ["token=", "secret: ", access, hexa, key, other, "/", "a.b/", " ", "é"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        base = base_spans(t)
        free = "".join("\n" if any(a <= i < b for _, a, b in base) else c for i, c in enumerate(t))
        want = [m.span() for m in re.finditer("[A-Za-z0-9+/_=.-]{16,}", free) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        assert candidates(t, base) == want, t


def test_query_and_added_spans(spark):
    long = "word " * 40000 + 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (3, long, "x"), (None, "AKIA" + "B2" * 8, None), (4, "auth gh" + "p_a8Kd02mQpZ7rT1vX9yB4cE6fG3hJ5kL0 x", "x"), (5, "see an.de/reou/thing/55 or 152.143.123.131 or und.34@mail7.example.com", "x")]
    got = secret_digests(spark.createDataFrame(rows, "doc_id long, text string, spans string"), train()).collect()
    assert len(got) == 7
    by = {r["doc_id"]: r for r in got}
    assert (by[3]["n_assign"], by[3]["n_hex"], by[None]["n_access"], by[1]["spans"], by[2]["spans"], by[5]["spans"]) == (1, 1, 1, "", "", "")
    assert by[3]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(long)).encode()).hexdigest()
    assert by[4]["spans"].startswith("network:5:")
    spans = find_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string"), train()).filter("doc_id = 4").collect()
    assert [s["secret"] for s in spans] == ["gh" + "p_a8Kd02mQpZ7rT1vX9yB4cE6fG3hJ5kL0"]
    assert secret_digests(spark.createDataFrame([], "doc_id long, text string"), train()).count() == 0


@pytest.mark.parametrize("text", ["", "x"])
def test_nothing_to_find(text):
    assert scan_all([text], train()) == [([], [])]
