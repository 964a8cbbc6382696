"""The front-coded merge against a plain sort."""

import random

from ticketflow.llm.lcp_merge import LoserTree, common_prefix, front_code


def test_common_prefix():
    assert common_prefix(b"abcd", b"abxd") == 2
    assert common_prefix(b"ab", b"abcd", 1) == 2
    assert common_prefix(b"", b"x") == 0
    assert common_prefix(b"same", b"same", 4) == 4


def test_merge_equals_sort():
    rng = random.Random(5)
    for runs in (0, 1, 2, 3, 7, 16):
        data = [sorted(bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 40))) for _ in range(runs)]
        got, before = [], b""
        for run, place, string, shared in LoserTree([front_code(r) for r in data]):
            assert data[run][place] == string and shared == common_prefix(before, string)
            got.append(string)
            before = string
        assert got == sorted(s for r in data for s in r)
