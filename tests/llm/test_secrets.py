import hashlib
import re

from docspark.llm.common import table
from docspark.llm.secrets import scan_secrets

PATTERNS = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def brute(text):
    spans, counts = [], []
    for i, (kind, p, group, least) in enumerate(PATTERNS):
        got = [(m.start(), i, m.end(), kind) for m in p.finditer(text or "") if len(m[group]) >= least]
        spans += got
        counts.append(len(got))
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    return (*counts, hashlib.sha256(joined.encode()).hexdigest()), joined


def test_base_spans_match_brute_force(spark, sf):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in scan_secrets(df).collect()}
    hits = 0
    for d in df.collect():
        want, joined = brute(d.text)
        assert tuple(got[d.doc_id][1:5]) == want
        mine = [s for s in got[d.doc_id].spans.split(",") if s and not s.startswith("generic")]
        assert ",".join(mine) == joined
        hits += bool(joined)
    assert len(got) == df.count() and hits > 5


def test_odd_texts(spark, docs):
    texts = [
        None, "", "token=", "secret=token = abcdef", "ü𝄞 TOKEN: 'abcdefg' é PassWd=\"x.y-z/1\" apikey=1234567",
        "AKIA" + "A" * 15, "AKIA" + "A" * 16 + "AKIA", "f" * 23 + "g" + "f" * 24, "token=token=token=abcdef",
        "x" * 50_000 + " password = hunter22", "api_key=AKIA" + "B" * 20 + " " + "0" * 30, "token\n=\nabcdef", "ſecret=abcdefg toKen=abcdefg",
        "token=abcdef " * 500,
    ]
    got = {r.doc_id: r for r in scan_secrets(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want, joined = brute(t)
        assert tuple(got[i][1:5]) == want, t and t[:40]
        assert ",".join(s for s in got[i].spans.split(",") if not s.startswith("generic")) == joined


def test_ownership_tells_examples_from_live(spark, docs):
    shared, own, mixed = "a1" * 16, "b2" * 16, "Zx9" * 12
    rows = [(i, f"key {shared}", f"s{i}") for i in range(4)] + [(9, f"{own} and {mixed}", "s9"), (10, own, "s9"), (11, own, "s9")]
    got = {r.doc_id: r for r in scan_secrets(docs(rows)).collect()}
    assert [f.verdict for f in got[0].found] == ["example"] and got[0].n_example == 1 and got[0].n_live == 0
    assert got[9].n_live == 2 and {f.kind for f in got[9].found} == {"hex", "generic"}
    assert got[10].found[0].n_owners == 1 and got[10].found[0].n_spans == 3
    spread = [(i, mixed, f"s{i}") for i in range(3)]
    assert all(r.spans == "" for r in scan_secrets(docs(spread)).collect())


def test_repeats_nulls_and_empty(spark, docs):
    assert scan_secrets(docs([])).collect() == []
    got = scan_secrets(docs([(1, "token=abcdef", None)] * 3 + [(None, None, None)])).collect()
    assert len(got) == 4 and sorted(r.n_assign for r in got) == [0, 1, 1, 1]


def test_texts_of_very_many_secrets(spark, docs):
    one = ["token=abcdef%d é" % i for i in range(11)] + ["f" * (20 + i) for i in range(9)]
    texts = [" ".join(one[:i]) for i in range(20)] + ["".join(f"{i:032x} pw token=v{i:07d}\n" for i in range(30_000))]
    got = {r.doc_id: r for r in scan_secrets(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want, joined = brute(t)
        assert tuple(got[i][1:5]) == want and got[i].spans == joined
