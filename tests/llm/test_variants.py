import random
import zlib
from collections import Counter

import pytest

from docspark.llm import variants
from docspark.llm.common import written
from docspark.llm.variants import Automaton, near_words, spelling_variants


def near(a, b):
    """Whether exactly one insertion, deletion or replacement turns ``a`` into ``b``."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def some_words(seed, n, least=1, most=9, letters="abcé"):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(n)})


@pytest.mark.parametrize("words", [some_words(1, 300), some_words(2, 60, letters="a", most=40), [], ["abc"], ["a", "ab", "abc", "b"]])
def test_an_automaton_numbers_its_words(words):
    a = Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words)))
    assert a.count[a.root] == len(words)
    assert all(a.number(w) == -1 for w in some_words(3, 300) if w not in words) and a.number("") == -1


def test_an_automaton_is_minimal():
    # stems and ends are shared: two states, however many stems there are
    words = sorted(s + e for s in ("lamp", "tank", "rock") for e in ("", "ed", "ing"))
    assert len(Automaton(words).edges) == 3
    assert len(Automaton(["x" * 100_000]).edges) == 2


@pytest.mark.parametrize("seed", range(3))
def test_completion_with_one_error(seed):
    words = some_words(seed, 400, letters="ab")
    a = Automaton(words)
    for w in words + some_words(seed + 9, 50, letters="abx"):
        half = len(w) // 2
        want = {i for i, v in enumerate(words) if v[:half] == w[:half] and near(w, v)}
        assert a.near(w, half) == want


def test_near_words_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(variants, "SHARD_WORDS", 16)  # words with one start fall into several shards
    monkeypatch.setattr(variants, "CHUNK_SHARDS", 2)
    words = some_words(5, 700, 6, 9, "abé") + ["q" * 3000, "q" * 2999, "z" * 2500]
    rows = [(w, i + 5) for i, w in enumerate(words)]
    got = near_words(written(spark.createDataFrame(rows, "word string, n long"), "t")).collect()
    want = {(a, b, n) for a in words for b, n in rows if abs(len(a) - len(b)) < 2 and near(a, b)}
    assert len(got) == len(want) > 1000 and {tuple(r) for r in got} == want


def plain(rows):
    """The result by brute force."""
    n = Counter()
    for who, text in rows:
        run = ""
        for c in (text or "") + " ":
            c = c.lower() if c.isascii() else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            h = zlib.crc32(f"{who}:{run}".encode()) if run and who is not None else 1
            if run and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
            run = ""
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    out = {}
    for w, k in n.items():
        others = sorted((-m, v) for v, m in n.items() if near(w, v))
        form = others[0][1] if others and -others[0][0] >= 5 * k else None
        out[w] = [form, None, k, len(others), n.get(form)]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return sorted((w, *v) for w, v in out.items())


def test_spelling_variants_equal_brute_force(spark, docs):
    rng = random.Random(4)
    names = ["Accomodate", "accommodate", "acommodate", "ÉCOLES", "écoles", "ecoles", "separate", "seperate", "separates", "x÷y×zab", "short"]
    texts = [(i, " ".join(rng.choice(names) for _ in range(60)) + ("-" + names[1] * 2) * (i % 7)) for i in range(80)]
    texts += [(200 + i, "separate, " * 700) for i in range(3)] + [(300, None), (301, ""), (302, " \n\x00"), (None, "separate " * 9), (0, "repeated repeated"), (0, "repeated repeated"), (0, "repeated repeated")]
    got = sorted(tuple(r) for r in spelling_variants(docs(texts)).collect())
    want = plain(texts)
    assert got == want
    forms = {r[0]: r[1:3] for r in got}
    assert forms["seperate"] == ("separate", "separate") and len(want) > 8


def test_forms_are_followed_to_the_last(spark, docs):
    chain = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125}
    texts = [(None, f"{w} " * n) for w, n in chain.items()]
    got = {r.word: (r.form, r.root) for r in spelling_variants(docs(texts)).collect()}
    ends = list(chain)
    assert got == {w: (ends[i + 1] if i < 4 else None, "aabbbb") for i, w in enumerate(ends)}


def test_an_empty_table(spark, docs):
    assert spelling_variants(docs([])).collect() == [] and spelling_variants(docs([(1, None)])).collect() == []


def test_long_texts_count_alike(monkeypatch):
    texts = ["Word wörter über " * 50, "straße, " * 9]
    want = variants._counted(texts, ["1", "2"], 6, 7)
    monkeypatch.setattr(variants, "LONG_TEXT", 10)
    assert variants._counted(texts, ["1", "2"], 6, 7) == want and want
