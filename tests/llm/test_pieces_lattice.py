import random

import pytest

from docspark.llm import pieces
from docspark.llm.pieces import SPACE, Lattice


def all_paths(scored, byte_score, s):
    """Every segmentation of ``s``, best first, from the pieces themselves."""
    paths = [[(0.0, ())]]
    for j in range(1, len(s) + 1):
        ends = [(i, scored[s[i:j]][1], (scored[s[i:j]][0],)) for i in range(j) if s[i:j] in scored]
        if s[j - 1] not in scored:
            raw = s[j - 1].encode()
            ends.append((j - 1, byte_score * len(raw), tuple(raw)))
        paths.append([(score + more, ids + new) for i, more, new in ends for score, ids in paths[i]])
    return sorted(paths[-1], key=lambda p: -p[0])


def some_pieces(rng):
    words = {"".join(rng.choice("ab" + SPACE) for _ in range(rng.randint(1, 10))) for _ in range(150)} | {"a" * 9, "é"}
    return {p: (300 + i, -float(rng.randint(1, 4000)) / 7) for i, p in enumerate(sorted(words))}


@pytest.mark.parametrize("kept", (0, 3, pieces.ENDINGS))
def test_short_and_long_pieces_against_every_segmentation(monkeypatch, kept):
    monkeypatch.setattr(pieces, "ENDINGS", kept, raising=False)
    for seed in range(12):
        rng = random.Random(seed)
        scored = some_pieces(rng)
        solver = Lattice(scored, list(range(256)))
        for _ in range(12):
            s = "".join(rng.choice("aabbé𝄞" + SPACE) for _ in range(rng.randint(1, 12)))
            want = all_paths(scored, solver.byte_score, s)
            for n in (1, 2, 3, 6, 50):
                got = solver.n_best(s, n)
                assert [x for x, _ in got] == pytest.approx([x for x, _ in want[:n]])
                assert len({tuple(ids) for _, ids in got}) == len(got)
                assert {tuple(ids) for _, ids in got} <= {ids for _, ids in want}
        assert len(solver.endings) <= kept


def test_one_look_up_a_place():
    """A chunk takes one look-up for each of its places, however many pieces end or begin there."""
    solver, asked = Lattice({"a" * k: (k, -float(k)) for k in range(1, pieces.ENDING + 1)}, list(range(256))), []

    class Counted(dict):
        def __missing__(self, end):
            asked.append(end)
            return known[end]

    known, solver.endings = solver.endings, Counted()
    assert len(solver.n_best("a" * 200, 3)) == 3
    assert len(asked) == 200
