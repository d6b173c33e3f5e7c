"""Limits under one half: a set has tiles in the band of every partner it may link to, whatever was signed before."""

import numpy as np
import pytest

from docspark.llm.jaccard import _Signer
from docspark.llm.words import mix


@pytest.mark.parametrize("num", [40, 30, 20])
def test_the_largest_partner_shares_a_tile(num):
    for n in range(1, 120):
        large = np.sort(mix(np.arange(n * 100 // num, dtype=np.uint64)))
        small = np.sort(mix(np.arange(n, dtype=np.uint64)))
        assert set(_Signer(num, 100).sign(small)) & set(_Signer(num, 100).sign(large)), n
