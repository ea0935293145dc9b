"""Byte radix tries: terms as paths of bytes, a number for each leaf; merged by prefix ranges, read in UTF-8 order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U4 = "<u4"
#: First bytes of a term that are looked up at once; below them each node branches by one byte.
HEAD = 3


class RadixTrie:
    """Leaves are numbered in the order they come. An edge is [label, leaf or -1, children by their first byte or None]."""

    def __init__(self) -> None:
        self.heads: dict[bytes, list] = {}
        self.size = 0

    def leaf(self, term: bytes) -> int:
        """The leaf of a term, made where there is none."""
        end, head = len(term), term[:HEAD]
        edge = self.heads.get(head)
        if edge is None:
            edge = self.heads[head] = [head, -1, None]
        at = len(head)
        while at < end:
            if edge[2] is None:
                edge[2] = {term[at]: [term[at:], self.size, None]}
                self.size += 1
                return self.size - 1
            below = edge[2].get(term[at])
            if below is None:
                edge[2][term[at]] = [term[at:], self.size, None]
                self.size += 1
                return self.size - 1
            label = below[0]
            if term.startswith(label, at):
                at += len(label)
                edge = below
                continue
            same, most = 1, min(len(label), end - at)
            while same < most and label[same] == term[at + same]:
                same += 1
            # the edge is split where the term leaves it
            below[:] = label[:same], -1, {label[same]: [label[same:], below[1], below[2]]}
            at += same
            edge = below
        if edge[1] < 0:
            edge[1] = self.size
            self.size += 1
        return edge[1]

    def walk(self) -> Iterator[tuple[bytes, int, int]]:
        """Each term, its leaf, and bytes that it shares with the term before, in the order of the terms' bytes."""
        for head in sorted(self.heads):
            shared, stack = 0, [(b"", self.heads[head])]
            while stack:
                above, (label, leaf, below) = stack.pop()
                if len(above) < shared:
                    shared = len(above)
                term = above + label
                if leaf >= 0:
                    yield term, leaf, shared
                    shared = len(term)
                if below:
                    stack.extend([(term, below[b]) for b in sorted(below, reverse=True)])


def packed(terms: list[bytes], shared: list[int]) -> tuple[bytes, bytes, bytes]:
    """Terms as the lengths that they share with the one before, the lengths of what follows, and its bytes. The first is whole."""
    shared = [0, *shared[1:]]
    rest = [t[n:] for t, n in zip(terms, shared)]
    return np.array(shared, U4).tobytes(), np.fromiter(map(len, rest), U4, len(rest)).tobytes(), b"".join(rest)


def unpacked(shared: bytes, lengths: bytes, rest: bytes) -> Iterator[bytes]:
    at, before = 0, b""
    for same, n in zip(np.frombuffer(shared, U4).tolist(), np.frombuffer(lengths, U4).tolist()):
        before = before[:same] + rest[at : at + n]
        at += n
        yield before
