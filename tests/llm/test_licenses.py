import random

import pytest

from docspark.llm.common import table
from docspark.llm.licenses import BAND, GRAM, TEMPLATES, WINDOW, TemplateIndex, align, fold, matches, scan_licenses, winnowed
from docspark.llm.words import gram_hashes, word_hashes


def unbanded(text, template):
    """Matched words of the best local alignment, with no band."""
    best, rows = (0, 0), [[(0, 0)] * (len(text) + 1) for _ in range(len(template) + 1)]
    for t in range(1, len(template) + 1):
        for i in range(1, len(text) + 1):
            s, m = rows[t - 1][i - 1]
            same = text[i - 1] == template[t - 1]
            options = [(0, 0), (s + 2, m + 1) if same else (s - 2, m)]
            options += [(s - 1, m) for s, m in (rows[t - 1][i], rows[t][i - 1])]
            rows[t][i] = max(o for o in options if o[0] > 0 or o == (0, 0))
            best = max(best, rows[t][i])
    return best[1]


@pytest.mark.parametrize("seed", range(12))
def test_alignment_matches_one_without_a_band(seed):
    rng = random.Random(seed)
    template = fold(TEMPLATES["apache-2.0"]).split()
    text = list(template)
    for _ in range(rng.randint(0, 5)):
        at = rng.randrange(len(text))
        text[at : at + rng.randint(0, 1)] = [b"odd"] * rng.randint(0, 1)
    before = [b"x%d" % i for i in range(rng.randint(0, 9))]
    got = align(before + text + [b"y"], template, len(before))
    assert got[0] == unbanded(before + text + [b"y"], template)
    assert got[1] >= len(before) and got[2] < len(before) + len(text)


def test_winnowing_keeps_one_of_every_window():
    for name, text in TEMPLATES.items():
        h = gram_hashes(word_hashes([fold(text)])[0], GRAM)
        keep = winnowed(h)
        assert keep.any() and all(keep[i : i + WINDOW].any() for i in range(len(h) - WINDOW + 1))


def test_every_notice_in_the_table_is_found(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    hits = 0
    for d in df.collect():
        want = {n for n, t in TEMPLATES.items() if t in d.text}
        assert want <= set(got[d.doc_id].licenses.split(",")), d.doc_id
        for m in got[d.doc_id].matches:
            hits += 1
            if m.license in want and m.coverage == 1 and d.text.count(TEMPLATES[m.license]) == 1:
                at = d.text.index(TEMPLATES[m.license])
                assert at == m.start and m.end <= at + len(TEMPLATES[m.license])
        if not want and "icense" not in d.text:
            assert got[d.doc_id].n_matches == 0
    assert hits > 10 and len(got) == df.count()


def test_spans_coverage_and_repeats(spark, docs):
    mit = TEMPLATES["mit"]
    half = " ".join(mit.split()[:90])
    changed = mit.replace("Software", "Program").upper()
    texts = ["é𝄞 " + mit + " end", half, changed, mit + "\n\nzz " * 30 + mit, "Released under the\nmit LICENSE", None, "", "license", "w " * 40000]
    got = {r.doc_id: r for r in scan_licenses(docs(list(enumerate(texts)))).collect()}
    assert got[0].licenses == "mit" and got[0].coverage == 1.0 and got[0].spans.startswith(f"mit:3:{2 + len(mit)}")
    assert got[1].n_matches == 0 and got[2].licenses == "mit" and got[2].coverage < 1
    assert got[3].n_matches == 2 and got[4].licenses == "mit-line"
    assert all(got[i].n_matches == 0 and got[i].coverage == 0 and got[i].spans == "" for i in range(5, 9))
    assert scan_licenses(docs([])).collect() == []
    assert len(scan_licenses(docs([(1, mit)] * 3 + [(None, mit)])).collect()) == 4


def test_low_coverage_is_a_parameter():
    index = TemplateIndex({"t": "one two three four five six seven eight"})
    text = "zero one two three four odd odd eight"
    found = index.hits([fold(text)])[0]
    assert matches(text, found, index, 0.9) == [] and matches(text, found, index, 0.5)[0][:2] == ("t", 0.5)
    assert BAND > 2


def test_every_template_is_told_from_its_relatives(spark, docs):
    names = list(TEMPLATES)
    texts = ["aa bb. " + TEMPLATES[n] + " cc" for n in names]
    got = {names[r.doc_id]: r for r in scan_licenses(docs(list(enumerate(texts)))).collect()}
    for n in names:
        inside = {m for m in names if b" ".join(fold(TEMPLATES[m]).split()) in b" ".join(fold(TEMPLATES[n]).split())}
        assert set(got[n].licenses.split(",")) == inside and got[n].coverage == 1


@pytest.mark.parametrize("seed", range(6))
def test_the_scan_matches_brute_force(seed):
    """Every template against every text, without fingerprints, bands or bounds."""
    rng = random.Random(seed)
    chosen = {n: TEMPLATES[n] for n in ("mit-line", "mpl-2.0", "gpl-2.0", "lgpl-2.1", "cc0-1.0", "apache-2.0")}
    index = TemplateIndex(chosen)
    for _ in range(4):
        name = rng.choice(list(chosen))
        said = chosen[name].split()
        for _ in range(rng.randint(0, 3)):
            said[rng.randrange(len(said))] = "odd"
        text = " ".join([*("w%d" % rng.randrange(99) for _ in range(rng.randint(0, 9))), *said, "end"])
        found = index.hits([fold(text)]).get(0, [])
        words = fold(text).split()
        want = {n: unbanded(words, w) / len(w) for n, w in zip(index.names, index.words)}
        want = {n: c for n, c in want.items() if c >= 0.7}
        size = {n: round(c * len(w)) for n, w in zip(index.names, index.words) if (c := want.get(n))}
        # all but the mit-line overlap here: one wins, unless another is there word for word
        best = max(want, key=lambda n: (want[n], size[n]), default=None)
        got = matches(text, found, index, 0.7)
        if name != "mit-line":  # five words with three changed may share no three in a row
            assert {r[0]: r[1] for r in got} == ({best: want[best]} if best else {})


def test_no_window_is_full_in_a_template_of_three_words():
    index = TemplateIndex({"t": "one two three", "u": "six seven eight nine"})
    for head in range(40):
        text = " ".join(["z%d" % i for i in range(head)] + ["one", "two", "three", "and", "six", "seven", "eight", "nine", "y"])
        got = matches(text, index.hits([fold(text)])[0], index, 0.7)
        assert [r[:2] for r in got] == [("t", 1.0), ("u", 1.0)]
