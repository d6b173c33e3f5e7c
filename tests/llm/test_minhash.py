import hashlib
import random

import numpy as np
import pytest

from docspark.llm.jaccard import member_sets
from docspark.llm.minhash import EMPTY, edited, fingerprints, likeness, permutations, signature


def shingles(text, n=5):
    words = (text or "").lower().split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def plain_groups(rows):
    """The smallest id that each (id, text) reaches over links of 80 in 100."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, least[top(i)]) for i, (d, _) in enumerate(rows))


def some_rows(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.choice([0, 1, 3, 5, 6, 40, 120]))]
        for _ in range(rng.choice([1, 1, 4])):
            rows.append((len(rows) * 3, " ".join(words)))
            words = [w if rng.random() > 0.01 else word() for w in words]
    return rows


def test_permutations_permute():
    a, b = permutations(8)
    assert len(set(a.tolist())) == 8 and (a & 1).all()
    inverse = np.array([pow(int(x), -1, 1 << 32) for x in a], np.uint32)
    x = np.arange(1000, dtype=np.uint32)[:, None]
    assert ((x * a + b - b) * inverse == x).all()


def test_the_likeness_estimates_jaccard():
    rng = np.random.default_rng(3)
    a, b = permutations()
    off = []
    for share in (0.0, 0.2, 0.5, 0.8, 0.95, 1.0):
        for size in (20, 300, 3000):
            both = round(size * share)
            x = rng.integers(0, 1 << 63, 2 * size - both, dtype=np.int64).astype(np.uint64) << np.uint64(1)
            true = both / (2 * size - both)
            off.append(likeness(signature(x[:size], a, b), signature(x[size - both :], a, b)) - true)
    assert max(map(abs, off)) < 0.16 and abs(np.mean(off)) < 0.03
    none = signature(np.zeros(0, np.uint64), a, b)
    assert (none == EMPTY).all() and likeness(none, none) == 1.0


@pytest.mark.parametrize("seed", range(2))
def test_rows_equal_a_plain_version(spark, docs, seed):
    rows = some_rows(seed)
    rng = random.Random(seed)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = {r.doc_id: r for r in fingerprints(docs(shuffled).repartition(5)).collect()}
    assert len(got) == len(rows)
    a, b = permutations()
    mark = lambda t: signature(member_sets([t], 5)[0], a, b)
    for (d, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half, r = len(text) // 2, got[d]
        changed = text[: len(text) - half] + following[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (mark(text).tobytes().hex(), mark(changed).tobytes().hex())
        assert r.near_edited == likeness(mark(text), mark(changed)) and r.near_next == likeness(mark(text), mark(following))
        assert r.n_shingles == len(shingles(text))
    assert sorted((d, r.component_id) for d, r in got.items()) == plain_groups(rows)


def test_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c d e f"), (5, "x" * 50_000), (6, "é𝄞 " * 7), (6, "é𝄞 " * 7), (6, "again"), (7, "one two three four five six " * 900)]
    got = fingerprints(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [by[i][0].component_id for i in (1, 2, 3)] == [1, 2, 3] and by[1][0].n_chars == 0 and by[1][0].fingerprint == "f" * 512
    assert by[1][0].near_next == 1.0  # nothing is as nothing
    assert sorted(r.n_chars for r in by[6]) == [5, 21, 21] and {r.component_id for r in by[6]} == {6}
    assert len({r.fingerprint for r in by[6] if r.n_chars == 21}) == 1
    assert by[5][0].n_chars == 50_000 and by[7][0].n_shingles == 6


def test_one_and_none(spark, docs):
    assert fingerprints(docs([])).collect() == []
    (one,) = fingerprints(docs([(9, "a b c d e f g h")])).collect()
    assert one.near_next == 1.0 and one.component_id == 9
    assert one.edited_sha256 == hashlib.sha256(edited("a b c d e f g h", "a b c d e f g h").encode()).hexdigest()
    with pytest.raises(ValueError):
        fingerprints(docs([]), count=6)


def test_many_near_copies_are_one_group(spark, docs):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:k] + [f"x{i}"] + words[k:])) for i, k in ((i, i % 200) for i in range(300))]
    assert {r.component_id for r in fingerprints(docs(rows)).collect()} == {0}
