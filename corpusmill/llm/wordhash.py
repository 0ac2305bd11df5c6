"""Words of UTF-8 texts as 64-bit hashes, and a bounded table from hash to row, both in whole arrays.

A word's hash is the sum over its bytes of a random value for the byte times a random odd factor for the place,
taken from one running sum over the buffer, so words cost no Python objects. A second, independent sum stands
for the word itself: where a hash is met again with another second sum, two words share it, and all hashes are
drawn anew. So two words pass for one only if both sums agree, with a chance below 2^-100 for any two words
whatever they are, as factors aren't powers of one another. Results don't depend on the draws."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np

#: Bytes of texts that are hashed at once.
BUFFER = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


class Clash(Exception):
    """Two words share a hash."""


class Hasher:
    def __init__(self):
        self.rng = np.random.default_rng()
        self.values = self._odd(2, 256)
        self.values[:, BLANK] = 0
        self.factors = self._odd(2, 64)

    def _odd(self, *shape: int) -> np.ndarray:
        return self.rng.integers(0, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hashes, second sums) of the words of a buffer that begins and ends with a blank."""
        raw = np.frombuffer(buffer, np.uint8)
        turn = np.flatnonzero(np.diff(BLANK[raw])) + 1
        starts, ends = turn[::2], turn[1::2]
        if not len(starts):
            return starts, ends, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        # The place of each byte in its word; what follows a word up to the next one has value 0.
        sizes = np.diff(np.append(starts, len(raw)))
        place = np.arange(starts[0], len(raw)) - np.repeat(starts, sizes)
        if (longest := int(sizes.max())) > self.factors.shape[1]:
            self.factors = np.concatenate([self.factors, self._odd(2, longest)], axis=1)
        own, first, last = raw[starts[0] :], starts - starts[0], ends - starts[0]
        out, total = [], np.zeros(len(own) + 1, np.uint64)
        for values, factors in zip(self.values, self.factors):
            terms = values.take(own)
            terms *= factors.take(place)
            np.cumsum(terms, out=total[1:])
            out.append(total[last] - total[first])
        return starts, ends, out[0], out[1]


class HashTable:
    """Sorted hashes with a second sum and a row each."""

    def __init__(self):
        self.keys, self.seconds, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray, seconds: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        if (self.seconds[at] != seconds)[known].any():
            raise Clash
        return np.where(known, self.rows[at], -1)

    def add(self, keys: np.ndarray, seconds: np.ndarray, rows: np.ndarray) -> None:
        """keys: sorted, none of them there yet."""
        at = np.searchsorted(self.keys, keys)
        self.keys, self.seconds, self.rows = np.insert(self.keys, at, keys), np.insert(self.seconds, at, seconds), np.insert(self.rows, at, rows)


class Growing:
    """An array that grows at its end without copying each time."""

    def __init__(self, dtype, *width: int):
        self.room, self.n = np.zeros((1 << 12, *width), dtype), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            more = np.zeros((max(len(self.room), len(values)), *self.room.shape[1:]), self.room.dtype)
            self.room = np.concatenate([self.room[: self.n], more])
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + sizes[i] - 1, one range after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class Words(ABC):
    """A worker's bounded memory of words, in two generations: when the table is full it becomes the old one,
    which is asked before a word is worked out again. Subclasses hold a row for each word."""

    def __init__(self, kept: int):
        self.kept = kept
        self.start()

    def start(self) -> None:
        """Forget all words and draw the hashes."""
        self.hasher = Hasher()
        self.old: tuple | None = None
        self.table = HashTable()
        self.clear()

    @abstractmethod
    def clear(self) -> None:
        """Start without rows."""

    @abstractmethod
    def rows(self) -> tuple[np.ndarray, ...]:
        """The rows, as carry() takes them."""

    @abstractmethod
    def carry(self, keys: np.ndarray, seconds: np.ndarray, places: np.ndarray, *rows: np.ndarray) -> None:
        """Keep the rows at places of an old generation under keys."""

    @abstractmethod
    def learn(self, keys: np.ndarray, seconds: np.ndarray, words: list[bytes]) -> None:
        """Work out and keep the rows of new words."""

    def full(self) -> bool:
        return len(self.table) > self.kept

    def register(self, keys: np.ndarray, seconds: np.ndarray, first: int) -> None:
        self.table.add(keys, seconds, first + np.arange(len(keys)))

    def parts(self, raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For texts of about BUFFER bytes at a time, or a single longer one: the row of each word, and where
        in them each text's words begin and the last one's end. Rows hold until the next part is asked for."""
        sizes = np.cumsum([len(r) + 1 for r in raws])
        part = 0
        while part < len(raws):
            stop = max(part + 1, int(np.searchsorted(sizes, (sizes[part - 1] if part else 0) + BUFFER)))
            own = raws[part:stop]
            part = stop
            if self.full():
                self.old = (self.table, self.rows())
                self.table = HashTable()
                self.clear()
            buffer = b"\n" + b"\n".join(own) + b"\n"
            while True:
                starts, ends, hashes, seconds = self.hasher(buffer)
                try:
                    at = self._at(hashes, seconds, buffer, starts, ends)
                    break
                except Clash:
                    self.start()
            yield at, np.searchsorted(starts, np.cumsum([1] + [len(r) + 1 for r in own]))

    def _at(self, hashes: np.ndarray, seconds: np.ndarray, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys, inverse = np.unique(hashes, return_inverse=True)
        where = np.zeros(len(keys), np.int64)
        where[inverse] = np.arange(len(hashes))
        second = seconds[where]
        if (second[inverse] != seconds).any():
            raise Clash
        row = self.table.find(keys, second)
        new = np.flatnonzero(row < 0)
        if len(new):
            if self.old:
                table, rows = self.old
                place = table.find(keys[new], second[new])
                own = new[place >= 0]
                self.carry(keys[own], second[own], place[place >= 0], *rows)
                new = new[place < 0]
            if len(new):
                first = where[new]
                self.learn(keys[new], second[new], [buffer[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            row = self.table.find(keys, second)
        return row[inverse]


class Rows(Words):
    """Words with a row of numbers each, as make(words) computes them."""

    def __init__(self, make: Callable[[list[bytes]], np.ndarray], width: int, kept: int):
        self.make, self.width = make, width
        super().__init__(kept)

    def clear(self) -> None:
        self.values = Growing(float, self.width)

    def rows(self) -> tuple[np.ndarray, ...]:
        return (self.values.all,)

    def keep(self, keys: np.ndarray, seconds: np.ndarray, values: np.ndarray) -> None:
        self.register(keys, seconds, self.values.n)
        self.values.extend(values)

    def carry(self, keys: np.ndarray, seconds: np.ndarray, places: np.ndarray, *rows: np.ndarray) -> None:
        self.keep(keys, seconds, rows[0][places])

    def learn(self, keys: np.ndarray, seconds: np.ndarray, words: list[bytes]) -> None:
        self.keep(keys, seconds, self.make(words))

    def __call__(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some texts at a time, in order: the rows of all their words, and each text's number of words."""
        for at, firsts in self.parts(texts):
            yield self.values.all[at], np.diff(firsts)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each text's rows, which doesn't depend on the texts beside it."""
    out = np.zeros((len(counts), values.shape[1]))
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
    return out
