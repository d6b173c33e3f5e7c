import re
from collections import Counter

import pytest

from docspark.llm.common import table, written
from docspark.llm.quality_rules import beta_prior, document_rules, host_verdicts, measure, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    marked = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


ODD = [
    None, "", "a", "a b c", "a b c a b c", "a\xa0b c d", "x\x1cy z\x85", "a a a a a", "\n\n \na\na\n a\na \r\n", "###<|>&%$*",
    "é𝄞 é𝄞 q é𝄞 é𝄞 q\n" * 40, "w " * 20000, "\v\f\t", "l\nl\nl",
]


@pytest.mark.parametrize("text", ODD)
def test_counts_of_odd_texts(text):
    assert measure(text) == brute(text)


def test_counts_of_the_table(spark, sf):
    df = table(spark, sf, "documents")
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    for d in df.collect():
        want = brute(d.text)
        assert tuple(got[d.doc_id])[1:6] == want
        assert got[d.doc_id].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert got[d.doc_id].kept == (not got[d.doc_id].base_failed and not got[d.doc_id].host_rejected)


GOOD = " ".join(f"word{i}" for i in range(60))


def test_bad_hosts_lose_their_documents(spark, docs):
    rows = [(i, GOOD, f"h{i % 4}") for i in range(80)] + [(100 + i, "bad", "worst") for i in range(30)] + [(200, GOOD, "worst"), (201, "bad", "tiny")]
    got = {r.doc_id: r for r in quality_rules(docs(rows)).collect()}
    assert got[200].host_rejected and not got[200].kept and not got[200].base_failed
    assert got[0].kept and not got[201].kept


def test_small_hosts_are_shrunk(spark, docs):
    rows = [(i, GOOD if i % 10 else "bad", f"h{i % 7}") for i in range(700)] + [(1000, "bad", "one"), (1001, GOOD, "one")]
    rules = written(document_rules(docs(rows), "doc_id", "text", "source"), "t")
    got = {r._host: r for r in host_verdicts(rules).collect()}
    assert got["one"].host_rate < 0.3 and sum(r.n_docs for r in got.values()) == 702


def test_edges(spark, docs):
    assert quality_rules(docs([])).collect() == []
    got = quality_rules(docs([(1, None, None)] * 3 + [(None, GOOD, None)])).collect()
    assert len(got) == 4 and sum(r.kept for r in got) == 1 and all(r.host_rate is None for r in got)
    assert all(r.kept for r in quality_rules(docs([(i, GOOD) for i in range(5)])).collect())
    assert not any(r.kept for r in quality_rules(docs([(i, "x") for i in range(5)])).collect())


def test_prior_finds_the_spread_of_hosts():
    import random

    rng = random.Random(5)
    hosts = []
    for _ in range(4000):
        n, p = rng.randint(5, 80), rng.betavariate(2.0, 6.0)
        hosts.append((n, sum(rng.random() < p for _ in range(n))))
    sums = sum(n for n, _ in hosts), sum(k for _, k in hosts), sum(n * n for n, _ in hosts), sum(k * k / n for n, k in hosts), len(hosts)
    m, s = beta_prior(*sums)
    assert abs(m - 0.25) < 0.02 and 6 < s < 10.5
    assert beta_prior(100, 10, 10000 / 10, 1.0, 10)[1] == 100.0
