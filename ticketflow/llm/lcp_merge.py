"""Sorted, front-coded runs of byte strings, and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that share `known` bytes at least; those are not read again."""
    m = min(len(a), len(b)) - known
    if m <= 0:
        return known + m
    x = int.from_bytes(a[known : known + m]) ^ int.from_bytes(b[known : known + m])
    return known + m - (x.bit_length() + 7) // 8


def front_code(strings: Sequence[bytes]) -> tuple[list[int], list[bytes]]:
    """A sorted run as (bytes shared with the string before, the rest)."""
    shared, rest, before = [], [], b""
    for s in strings:
        n = common_prefix(before, s)
        shared.append(n)
        rest.append(s[n:])
        before = s
    return shared, rest


class LoserTree:
    """Merge of front-coded sorted runs: (run, place in it, string, bytes shared with the string before).

    Each contender carries the length of the prefix that it shares with the last string put out.
    Of two, the one that shares more is the smaller; only with equal lengths are bytes compared, and from that
    length on. So no prefix that is known to be common is compared again.
    """

    def __init__(self, runs: Sequence[tuple[Sequence[int], Sequence[bytes]]]):
        self.runs, self.size = runs, 1
        while self.size < len(runs):
            self.size *= 2
        self.place = [0] * self.size
        self.string: list[bytes | None] = [rest[0] if rest else None for _, rest in runs] + [None] * (self.size - len(runs))
        self.shared = [0] * self.size
        self.loser = [0] * self.size

    def smaller(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        s, t = self.string[a], self.string[b]
        if s is None or t is None:
            return (a, b) if t is None else (b, a)
        if self.shared[a] != self.shared[b]:
            return (a, b) if self.shared[a] > self.shared[b] else (b, a)
        n = common_prefix(s, t, self.shared[a])
        first = n == len(s) if n == len(s) or n == len(t) else s[n] < t[n]
        a, b = (a, b) if first else (b, a)
        self.shared[b] = n
        return a, b

    def begin(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.loser[node] = self.smaller(self.begin(2 * node), self.begin(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[int, int, bytes, int]]:
        winner = self.begin(1) if self.size > 1 else 0
        while (s := self.string[winner]) is not None:
            yield winner, self.place[winner], s, self.shared[winner]
            k = self.place[winner] = self.place[winner] + 1
            shared, rest = self.runs[winner]
            if k < len(rest):
                self.shared[winner], self.string[winner] = shared[k], s[: shared[k]] + rest[k]
            else:
                self.string[winner] = None
            node = (winner + self.size) // 2
            while node:
                winner, self.loser[node] = self.smaller(winner, self.loser[node])
                node //= 2
