"""Notices that follow each other at once are all told."""

import pytest

from docspark.llm.licenses import TEMPLATES, TemplateIndex, fold, matches


@pytest.mark.parametrize("name", list(TEMPLATES))
@pytest.mark.parametrize("n", [2, 3, 9])
def test_copies_back_to_back(name, n):
    index, notice = TemplateIndex({name: TEMPLATES[name]}), TEMPLATES[name]
    text = " ".join([notice] * n)
    got = matches(text, index.hits([fold(text)])[0], index, 0.7)
    assert [m[2] for m in got] == [i * (len(notice) + 1) for i in range(n)] and all(m[1] == 1 for m in got)
