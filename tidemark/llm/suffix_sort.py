"""Deep-shallow sorting of suffixes by their first bytes: multikey quicksort, then blind tries."""

from __future__ import annotations

import numpy as np

#: Bytes that the quicksort compares at a time; bytes that it sorts by before the blind tries take over.
CHAR, SHALLOW = 8, 32


def _chars(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """CHAR bytes from each place, as one big-endian number, so numbers sort as the bytes do."""
    return text[at[:, None] + np.arange(CHAR)].view(">u8").ravel().astype(np.uint64)


def multikey_quicksort(text: np.ndarray, start: np.ndarray, bucket: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): the suffixes by bucket and first ``depth`` bytes; head marks the first of each run of equal ones.

    All runs are parted at once: each takes a pivot character and splits into less, equal and greater; the equal part goes
    on with the next character, the others with this one.
    """
    order = np.argsort(bucket, kind="stable")
    head = np.ones(len(order), dtype=bool)
    head[1:] = bucket[order][1:] != bucket[order][:-1]
    for at in range(0, depth, CHAR):
        run = np.cumsum(head) - 1
        live = np.flatnonzero(np.bincount(run)[run] > 1)
        run, key = run[live], _chars(text, start[order[live]] + at)
        while len(live):
            first = np.flatnonzero(np.diff(run, prepend=-1))
            n = np.diff(np.append(first, len(run)))
            pivot = np.repeat(key[first + n // 2], n)
            part = 3 * np.repeat(np.arange(len(first)), n) + 1 + (key > pivot) - (key < pivot)
            move = np.argsort(part, kind="stable")
            order[live], key, part = order[live[move]], key[move], part[move]
            head[live[np.flatnonzero(np.diff(part, prepend=-1))]] = True
            more = (part % 3 != 1) & (np.bincount(part)[part] > 1)
            live, key, run = live[more], key[more], part[more]
    return order, head


class BlindTrie:
    """Texts of one length. A branch (bytes above it, children by their next byte) does not keep the bytes in between.

    A new text goes down by its own bytes, or any way where they lead nowhere, and is compared with the one leaf that it
    reaches: their first difference is the place of its branch. Leaves list equal texts.
    """

    def __init__(self, texts: list[bytes]):
        self.texts, self.root = texts, [0]
        for k in range(1, len(texts)):
            self._insert(k)

    def _insert(self, k: int) -> None:
        text, node = self.texts[k], self.root
        while type(node) is tuple:
            depth, below = node
            node = below.get(text[depth]) or next(iter(below.values()))
        other = self.texts[node[0]]
        if other == text:
            node.append(k)
            return
        differ = int.from_bytes(other, "big") ^ int.from_bytes(text, "big")
        at = len(text) - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while type(node) is tuple and node[0] < at:
            above, node = node, node[1][text[node[0]]]
        if type(node) is tuple and node[0] == at:
            node[1][text[at]] = [k]
            return
        branch = (at, {other[at]: node, text[at]: [k]})
        if above is None:
            self.root = branch
        else:
            above[1][text[above[0]]] = branch

    def leaves(self):
        """Lists of equal texts, in order."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if type(node) is list:
                yield node
            else:
                todo.extend(node[1][b] for b in sorted(node[1], reverse=True))


def sorted_suffixes(data: bytes, start: np.ndarray, bucket: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): the suffixes that begin at ``start``, by bucket and first ``length`` bytes; head marks runs of equal ones.

    Every suffix has ``length`` bytes. Suffixes whose first bytes agree go into a blind trie, one for each such group.
    """
    text = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(CHAR, dtype=np.uint8)])
    shallow = min(SHALLOW, length // CHAR * CHAR)
    order, head = multikey_quicksort(text, start, bucket, shallow)
    firsts = np.flatnonzero(head)
    ends = np.append(firsts[1:], len(order))
    long = ends - firsts > 1
    for lo, hi in zip(firsts[long].tolist(), ends[long].tolist()):
        own = order[lo:hi]
        texts = [data[p:p + length] for p in start[own].tolist()]
        if texts.count(texts[0]) == len(texts):
            continue
        at, sequence = lo, []
        for leaf in BlindTrie(texts).leaves():
            head[at] = True
            at += len(leaf)
            sequence += leaf
        order[lo:hi] = own[sequence]
    return order, head
