"""External suffix sorting by induction, carrying common prefixes through the recursion.

Suffixes are induced from the order of the leftmost rising ones (an S-suffix after an
L-suffix): these are named by the text up to the next one, and the text of names is sorted by recursion, which hands
back the order together with the names that neighbours have in common. The order then spreads through
priority queues of (position, common prefix with the one before), which overflow to files.

The text, the rising places, their names, their order and all that is induced lie in files; what is in memory is
bounded by `held` tuples and by blocks. Only a text of names of more than `held` keeps the tuples of one name together
in memory, and a text of at most `held` names is sorted in memory instead of by recursion. Random reads go through the
system's page cache.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18
#: Tuples that a run of a queue of names gives to a window.
WINDOW = 1 << 10
#: Names of a text of names are above this in number, those of bytes are not.
_BYTES = 257
_PAD = np.uint64(0xFFFFFFFFFFFFFFFF)
_FAR = np.int64(1) << np.int64(62)


class Column:
    """An array in a file: appended to, then mapped, which takes the file's name away; its space goes with the array."""

    def __init__(self, folder: str, name: str, dtype):
        self.path, self.dtype, self.size = os.path.join(folder, name), np.dtype(dtype), 0
        self.file = open(self.path, "wb")

    def add(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values, self.dtype))
        self.size += len(values)

    def mapped(self) -> np.ndarray:
        self.file.close()
        out = np.asarray(np.memmap(self.path, self.dtype, "r")) if self.size else np.zeros(0, self.dtype)
        os.unlink(self.path)
        return out


def _room(folder: str, name: str, size: int) -> np.ndarray:
    """Zeros in a file without a name, to be written in any order."""
    path = os.path.join(folder, name)
    out = np.asarray(np.memmap(path, np.int64, "w+", shape=(max(size, 1),)))[:size]
    os.unlink(path)
    return out


class DiskQueue:
    """First-in first-out (position, prefix) tuples per symbol; symbols are taken in order.

    Insertions come in the order of the suffixes, so a symbol's tuples are sorted
    as they lie: with symbols taken upwards or downwards this is the priority queue of the induction.
    """

    def __init__(self, folder: str, name: str, held: int):
        self.path, self.held, self.size = os.path.join(folder, name), held, 0
        self.chunks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.spilled: dict[int, list[tuple[int, int]]] = {}
        self.file = None

    def push(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.chunks.setdefault(symbol, []).append((positions, prefixes))
        self.size += len(positions)
        if self.size > self.held:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = open(self.path, "w+b")
        at = self.file.seek(0, os.SEEK_END)
        for symbol, chunks in self.chunks.items():
            positions, prefixes = _joined(chunks)
            self.file.write(positions.astype(np.int64).tobytes())
            self.file.write(prefixes.astype(np.uint16).tobytes())
            self.spilled.setdefault(symbol, []).append((at, len(positions)))
            at += 10 * len(positions)
        self.chunks.clear()
        self.size = 0

    def symbols(self) -> set[int]:
        return self.chunks.keys() | self.spilled.keys()

    def _read(self, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(at)
        raw = self.file.read(10 * n)
        return np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint16, n, 8 * n)

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The symbol's tuples so far, removed, in blocks; what is pushed meanwhile waits."""
        yield from self._walk(self.spilled.pop(symbol, []), self.chunks.pop(symbol, []), True)

    def walk(self, symbol: int, backward: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The symbol's tuples, kept; backward from the last block, whose inner order stays."""
        yield from self._walk(self.spilled.get(symbol, []), self.chunks.get(symbol, []), False, backward)

    def _walk(self, spilled, chunks, gone: bool, backward: bool = False):
        # Small chunks are read together.
        held: list = []
        size = 0
        parts = [*spilled, *chunks]
        for c in reversed(parts) if backward else parts:
            if isinstance(c[0], int):
                c = self._read(*c)
            elif gone:
                self.size -= len(c[0])
            held.append(c)
            size += len(c[0])
            if size >= BLOCK:
                yield _joined(held[::-1] if backward else held)
                held, size = [], 0
        if held:
            yield _joined(held[::-1] if backward else held)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            os.unlink(self.path)


def _joined(chunks: list) -> tuple[np.ndarray, np.ndarray]:
    return chunks[0] if len(chunks) == 1 else (np.concatenate([c[0] for c in chunks]), np.concatenate([c[1] for c in chunks]))


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low .. high]) of each pair, low <= high, from a table of power-of-two stretches."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    table, k = values, 0
    for k in range(int(level.max(initial=0)) + 1):
        some = np.flatnonzero(level == k)
        out[some] = np.minimum(table[low[some]], table[high[some] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k) or None], table[1 << k :]) if len(table) > 1 << k else table
    return out


class RunQueue:
    """Tuples by (key, age): runs sorted by key, older ones first, merged in geometric sizes; what exceeds `held` is written to files."""

    def __init__(self, folder: str, name: str, held: int):
        self.folder, self.name, self.held, self.files, self.size = folder, name, held, 0, 0
        #: [keys, positions, prefixes, tuples taken, in memory], old before new.
        self.runs: list[list] = []

    def push(self, keys: np.ndarray, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.runs.append([keys, positions, prefixes, 0, True])
        self.size += len(keys)
        while len(self.runs) > 1 and self.runs[-2][4] and len(self.runs[-2][0]) - self.runs[-2][3] <= 2 * len(self.runs[-1][0]):
            self._merge()
        if self.size > self.held:
            while len(self.runs) > 1 and self.runs[-2][4]:
                self._merge()
            *columns, at, _ = self.runs.pop()
            mapped = []
            for k, values in enumerate(columns):
                column = Column(self.folder, f"{self.name}-{self.files}-{k}", values.dtype)
                column.add(values[at:])
                mapped.append(column.mapped())
            self.runs.append([*mapped, 0, False])
            self.files, self.size = self.files + 1, 0

    def _merge(self) -> None:
        new, old = self.runs.pop(), self.runs.pop()
        columns = [np.concatenate([old[k][old[3] :], new[k][new[3] :]]) for k in range(3)]
        order = np.argsort(columns[0], kind="stable")
        self.runs.append([*(c[order] for c in columns), 0, True])

    def bound(self) -> np.int64:
        """A key up to which no run has many more than WINDOW tuples, those of that key aside."""
        return min((run[0][run[3] + WINDOW - 1] for run in self.runs if len(run[0]) - run[3] >= WINDOW), default=_FAR)

    def pop(self, bound: np.int64) -> list[np.ndarray]:
        """The tuples of keys up to bound, removed, by (key, age)."""
        taken, rest = [], []
        for run in self.runs:
            end = int(np.searchsorted(run[0], bound, "right"))
            if end > run[3]:
                taken.append([c[run[3] : end] for c in run[:3]])
                self.size -= (end - run[3]) * run[4]
                run[3] = end
            if end < len(run[0]):
                rest.append(run)
        self.runs = rest
        columns = [np.concatenate([t[k] for t in taken]) for k in range(3)] if taken else [np.zeros(0, t) for t in (np.int64, np.int64, np.uint16)]
        order = np.argsort(columns[0], kind="stable") if len(taken) > 1 else slice(None)
        return [c[order] for c in columns]


class _Inducer:
    """Predecessors of suffixes that are met in order, each with the prefix it has in common with the one before of its symbol."""

    def __init__(self, text: np.ndarray, cap: int, last: np.ndarray):
        self.text, self.cap = text, cap
        #: By symbol, one past the number of the suffix whose predecessor came last; 0 is none.
        self.last = last
        #: low[v]: one past the number of the last suffix met whose common prefix is at most v.
        self.met, self.low = 0, np.zeros(cap + 1, np.int64)

    def follow(self, positions: np.ndarray, prefixes: np.ndarray, symbols: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, positions, prefixes) of the wanted predecessors, in stable order of symbols; symbols: those before the positions."""
        at = np.flatnonzero(wanted)
        symbols = symbols[at]
        order = np.argsort(symbols, kind="stable")
        at, symbols = at[order], symbols[order]
        value = np.zeros(len(at), np.uint16)
        if self.cap:
            prefixes = prefixes.astype(np.int64)
            if len(at):
                first = np.concatenate([[True], symbols[1:] != symbols[:-1]])
                inner = np.flatnonzero(~first)
                common = np.zeros(len(at), np.int64)
                common[inner] = _range_minima(prefixes, at[inner - 1] + 1, at[inner]) + 1
                first = np.flatnonzero(first)
                before = self.last[symbols[first]]
                # A common prefix of at most v lies between if the last such suffix came after `before`.
                past = np.searchsorted(self.low, before, "right")
                up = np.minimum.accumulate(prefixes)[at[first]]
                common[first] = np.where(before > 0, np.minimum(past, up) + 1, 0)
                np.minimum(common, self.cap, out=common)
                value[:] = common
                self.last[symbols[first]] = self.met + at[np.append(first[1:], len(at)) - 1] + 1
            latest = np.zeros(self.cap + 1, np.int64)
            latest[prefixes] = np.arange(self.met + 1, self.met + len(prefixes) + 1)
            self.low = np.maximum.accumulate(np.maximum(self.low, latest))
            self.met += len(prefixes)
        return symbols, positions[at] - 1, value

    def send(self, queue: DiskQueue, positions: np.ndarray, prefixes: np.ndarray, wanted) -> None:
        """Push the predecessors to a queue by symbol."""
        symbols = self.text[np.maximum(positions - 1, 0)]
        symbols, moved, value = self.follow(positions, prefixes, symbols, (positions > 0) & wanted(symbols))
        if len(symbols):
            first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
            for k, e in zip(first.tolist(), [*first[1:].tolist(), len(symbols)]):
                queue.push(int(symbols[k]), moved[k:e], value[k:e])


class _Text:
    """Symbols in a file with the end symbol 0 behind them; narrow ones can be read eight at a time."""

    def __init__(self, symbols: np.ndarray, folder: str, room: int = 0, plus: int = 0):
        self.narrow = symbols.dtype == np.uint8
        out = Column(folder, "text", np.uint8 if self.narrow else np.int64)
        for at in range(0, len(symbols), BLOCK):
            out.add(symbols[at : at + BLOCK] + plus if plus else symbols[at : at + BLOCK])
        # Zeros behind the end let reads of up to `room` symbols run over it.
        out.add(np.zeros(room + 9, out.dtype))
        padded = out.mapped()
        self.symbols = padded[: len(symbols) + 1]
        self.step = 8 if self.narrow else 1
        self.eight = np.ndarray((len(symbols) + room + 2,), "<u8", padded.data, 0, (1,)) if self.narrow else padded

    def words(self, at: np.ndarray) -> np.ndarray:
        """The next eight symbols, or one wide symbol, as a number that orders like them; what is past the end counts as 0."""
        word = self.eight[np.minimum(at, len(self.symbols) - 1)]
        return word.byteswap() if self.narrow else word.astype(np.uint64)

    def stretch_words(self, starts: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
        """Words at k of stretches. One that ends where another goes on is the larger: past its end stands the largest value."""
        word = self.words(starts + k)
        keep = length - k
        short = np.flatnonzero(keep < self.step)
        word[short] |= _PAD >> (8 * keep[short]).astype(np.uint64)
        return word


def _rising(text: np.ndarray, out: Column) -> np.ndarray:
    """Positions of S-suffixes that follow an L-suffix, the end symbol's apart."""
    # The type of a suffix is that of the next unequal pair of symbols; the last is an L-suffix.
    last, up = -1, True
    for a in range(0, len(text) - 1, BLOCK):
        part = text[a : a + BLOCK + 1]
        step = np.flatnonzero(part[1:] != part[:-1])
        if not len(step):
            continue
        rises = part[step + 1] > part[step]
        late = rises & ~np.concatenate([[up], rises[:-1]])
        out.add(np.concatenate([[last], step[:-1] + a])[late] + 1)
        last, up = int(step[-1]) + a, bool(rises[-1])
    return out.mapped()


def _refined(rank: np.ndarray, some: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Split the groups of equal rank among `some` by word; ranks are first places. Returns those still tied."""
    old = rank[some]
    if len(old) and old[0] == old[-1] and (old == old[0]).all():
        order = np.argsort(word)
    elif len(word) and int(word.max()) < 1 << 32:
        order = np.argsort((old.astype(np.uint64) << np.uint64(32)) | word)
    else:
        order = np.lexsort((word, old))
    some, word, old = some[order], word[order], old[order]
    new_group = np.concatenate([[True], old[1:] != old[:-1]])
    new_name = new_group | np.concatenate([[True], word[1:] != word[:-1]])
    place = np.arange(len(some))
    group_at = np.maximum.accumulate(np.where(new_group, place, 0))
    name_at = np.maximum.accumulate(np.where(new_name, place, 0))
    rank[some] = old + (name_at - group_at)
    tied = ~(new_name & np.append(new_name[1:], True))
    return some[tied]


def _names(text: _Text, starts: np.ndarray, length: np.ndarray, depth: int, k: int = 0) -> np.ndarray:
    """Ranks, as first places, of stretches that agree up to k, by `depth` symbols; both ends belong to a stretch."""
    rank = np.zeros(len(starts), np.int64)
    some = np.arange(len(starts))
    while len(some) and k < depth:
        some = _refined(rank, some, text.stretch_words(starts[some], length[some], k))
        k += text.step
        some = some[length[some] >= k]
    return rank


def _dealt_names(text: _Text, starts: np.ndarray, folder: str, held: int, depth: int) -> np.ndarray:
    """Names of more stretches than fit in memory, in a file: dealt by sampled words into files of stretches until they fit."""
    n = len(starts)
    names = _room(folder, "names", n)
    lengths = lambda i: np.where(i + 1 < n, starts[np.minimum(i + 1, n - 1)], len(text.symbols) - 1) - starts[i] + 1
    blocks = lambda column: (column[a : a + BLOCK] if column is not None else np.arange(a, min(a + BLOCK, n)) for a in range(0, len(column) if column is not None else n, BLOCK))
    made = 0
    # (numbers of the stretches, agreed symbols, first name), the whole first.
    todo: list[tuple[np.ndarray | None, int, int]] = [(None, 0, 0)]
    while todo:
        column, k, base = todo.pop()
        size = n if column is None else len(column)
        if k >= depth or all(int(lengths(i).max()) <= k for i in blocks(column)):
            for i in blocks(column):
                names[i] = base
            continue
        if column is not None and size <= held:
            names[column] = base + _names(text, starts[column], lengths(column), depth, k)
            continue
        picked = np.unique(np.linspace(0, size - 1, 4096).astype(np.int64))
        picked = picked if column is None else column[picked]
        words = np.sort(text.stretch_words(starts[picked], lengths(picked), k))
        pieces = min(128, 2 + 4 * size // held)
        seams = np.unique(words[np.linspace(0, len(words) - 1, pieces + 1).astype(np.int64)[:-1] + len(words) // (2 * pieces)])
        # Below the first seam, on it, between it and the next, and so on.
        parts = [Column(folder, f"part-{made}-{p}", np.int64) for p in range(2 * len(seams) + 1)]
        made += 1
        for i in blocks(column):
            word = text.stretch_words(starts[i], lengths(i), k)
            part = np.searchsorted(seams, word, "left") + np.searchsorted(seams, word, "right")
            order = np.argsort(part, kind="stable")
            for p, own in zip(*(lambda u, f: (u, np.split(i[order], f[1:])))(*np.unique(part[order], return_index=True))):
                parts[int(p)].add(own)
        for p, part in enumerate(parts):
            column = part.mapped()
            if part.size:
                todo.append((column, k + text.step if p % 2 else k, base))
                base += part.size
    return names


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a text of first-place ranks that fits in memory, by `depth` symbols at least."""
    rank = names.copy()
    counts = np.bincount(rank, minlength=len(rank))
    some, h = np.flatnonzero(counts[rank] > 1), 1
    while len(some) and h < depth:
        after = some + h
        following = np.where(after < len(rank), rank[np.minimum(after, len(rank) - 1)] + 1, 0)
        some = _refined(rank, some, following.astype(np.uint64))
        h *= 2
    return np.argsort(rank, kind="stable")


def _common(text: _Text, first: np.ndarray, second: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix lengths of the suffix pairs, up to cap, within the text's room; the end symbol ends them."""
    out = np.full(len(first), cap, np.int64)
    # Few pairs at a time: what they read stays in the processor's cache.
    for at in range(0, len(first), 4096):
        a, b = first[at : at + 4096], second[at : at + 4096]
        live = np.arange(at, at + len(a))
        for k in range(0, cap, text.step):
            x, y = text.eight[a + k], text.eight[b + k]
            same = x == y
            if same.all():
                continue
            ended = ~same
            diff = x[ended] ^ y[ended]
            # The lowest byte that differs is the first symbol that does.
            lowest = np.bitwise_count((diff & (~diff + diff.dtype.type(1))) - diff.dtype.type(1)).astype(np.int64) // 8 if text.narrow else 0
            out[live[ended]] = k + lowest
            live, a, b = live[same], a[same], b[same]
            if not len(live):
                break
    return np.minimum(out, cap)


def _ordered(text: _Text, starts: np.ndarray, folder: str, cap: int, held: int, depth: int, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (positions, common prefixes with the one before) of the rising suffixes, in order."""
    n, places = len(starts), None
    if n <= held:
        names = _names(text, starts, np.diff(starts, append=len(text.symbols) - 1) + 1, depth)
        places = _doubled(names, depth // 2 + 1)
    else:
        names = _dealt_names(text, starts, folder, held, depth)
    last = -1
    if places is not None:
        for at in range(0, n, BLOCK):
            own = starts[places[at : at + BLOCK]]
            before = np.concatenate([[own[0] if last < 0 else last], own[:-1]])
            prefixes = _common(text, before, own, cap)
            if last < 0:
                prefixes[0] = 0
            last = own[-1]
            yield own, prefixes
        return
    inner = os.path.join(folder, f"level{level + 1}")
    os.makedirs(inner, exist_ok=True)
    # A name covers two symbols at least.
    for places, alike in sorted_suffixes(names, inner, cap // 2 + 1, held, depth // 2 + 1, level + 1, 1):
        # Names in common cover the text up to the first that differ, which differ within a stretch.
        before = np.concatenate([[max(last, 0)], places[:-1]])
        known, at = last >= 0, lambda i: np.where(i < n, starts[np.minimum(i, n - 1)], len(text.symbols) - 1)
        alike = alike.astype(np.int64)
        own = starts[places]
        prefixes = at(places + alike) - own
        short = np.flatnonzero(prefixes < cap)
        prefixes[short] += _common(text, at(before[short] + alike[short]), at(places[short] + alike[short]), cap)
        if not known:
            prefixes[0] = 0
        last = int(places[-1])
        yield own, np.minimum(prefixes, cap)


def sorted_suffixes(symbols: np.ndarray, folder: str, cap: int = 0, held: int = 1 << 22, depth: int | None = None, level: int = 0, plus: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (positions, common prefixes with the suffix before, up to cap) in suffix order.

    symbols: uint8 in 1..254, or wider integers from 1 (after adding plus) below their number plus 2. Order is by `depth` symbols
    at least (None: wholly), and cap is no more than depth. `held` bounds the tuples in memory; a text of names within it is sorted there, a longer one by recursion.
    """
    depth = len(symbols) + 1 if depth is None else depth
    text = _Text(symbols, folder, cap, plus)
    starts = _rising(text.symbols, Column(folder, "rising", np.int64))
    seeds, prefixes = Column(folder, "seeds", np.int64), Column(folder, "shared", np.uint16)
    if len(starts):
        for own, common in _ordered(text, starts, folder, cap, held, depth, level):
            seeds.add(own)
            prefixes.add(common)
    spread = _spread_bytes if text.narrow else _spread_names
    yield from spread(text, seeds.mapped(), prefixes.mapped(), folder, cap, held)


def _spread_bytes(text: _Text, seeds: np.ndarray, shared: np.ndarray, folder: str, cap: int, held: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the rising ones: symbol by symbol, upwards and downwards."""
    symbols = text.symbols
    measure = lambda a, b: _common(text, a, b, cap)
    counts = np.zeros(_BYTES, np.int64)
    for k in range(0, len(seeds), BLOCK):
        counts += np.bincount(symbols[seeds[k : k + BLOCK]], minlength=_BYTES)
    ends = np.cumsum(counts)

    # Upwards: L-suffixes from what follows them.
    queue, lower = DiskQueue(folder, "queue", held), DiskQueue(folder, "lower", held)
    inducer = _Inducer(symbols, cap, np.zeros(_BYTES, np.int64))
    queue.push(0, np.array([len(symbols) - 1]), np.zeros(1, np.uint16))
    for c in range(_BYTES):
        last = None
        while c in queue.symbols():
            for positions, prefixes in queue.pop(c):
                lower.push(c, positions, prefixes)
                inducer.send(queue, positions, prefixes, lambda s: s >= c)
                last = positions[-1:]
        for k in range(int(ends[c] - counts[c]), int(ends[c]), BLOCK):
            own, prefixes = seeds[k : min(k + BLOCK, ends[c])], shared[k : min(k + BLOCK, ends[c])]
            if k == ends[c] - counts[c]:
                prefixes = prefixes.copy()
                prefixes[:1] = 0 if last is None else measure(last, own[:1])
            inducer.send(queue, own, prefixes, lambda s: s > c)
    queue.close()

    # Downwards: S-suffixes from what follows them.
    queue, upper = DiskQueue(folder, "queue", held), DiskQueue(folder, "upper", held)
    inducer = _Inducer(symbols, cap, np.zeros(_BYTES, np.int64))
    seam: dict[int, int] = {}
    for c in range(_BYTES - 1, -1, -1):
        last = None
        while c in queue.symbols():
            for positions, prefixes in queue.pop(c):
                upper.push(c, positions, prefixes)
                inducer.send(queue, positions, prefixes, lambda s: s <= c)
                last = positions[-1:]
        above = None
        for positions, prefixes in lower.walk(c, backward=True):
            if above is None:
                above = seam[c] = 0 if last is None or not cap else int(measure(positions[-1:], last)[0])
            # Each one's prefix is with the larger one, met before it.
            down = np.append(prefixes[1:], above)[::-1]
            above = int(prefixes[0])
            for k in range(0, len(positions), BLOCK):
                inducer.send(queue, positions[::-1][k : k + BLOCK], down[k : k + BLOCK], lambda s: s < c)
    queue.close()

    for c in sorted(lower.symbols() | upper.symbols()):
        if c:  # the end itself is no suffix
            yield from lower.walk(c)
        # Downward prefixes are with the larger one; upward, with the smaller. The smallest S-suffix follows the largest L-suffix.
        first = seam.get(c, 0)
        for positions, prefixes in upper.walk(c, backward=True):
            yield positions[::-1], np.concatenate([[first], prefixes[:0:-1]]).astype(np.uint16)
            first = int(prefixes[0])
    lower.close()
    upper.close()


class _Sequence:
    """Suffixes and prefixes from files, given out by key: in the order of the file, or backward with each one's prefix with the one after."""

    def __init__(self, symbols: np.ndarray, positions: np.ndarray, prefixes: np.ndarray, sign: int, backward: bool):
        self.symbols, self.positions, self.prefixes, self.sign, self.backward, self.at = symbols, positions, prefixes, sign, backward, 0

    def _slice(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.positions)
        a, b = min(a, n), min(b, n)
        if not self.backward:
            return self.positions[a:b], self.prefixes[a:b]
        prefixes = self.prefixes[n - b + 1 : n - a + 1]
        return self.positions[n - b : n - a][::-1], (prefixes if a else np.append(prefixes, np.uint16(0)))[::-1]

    def _keys(self, positions: np.ndarray) -> np.ndarray:
        return self.symbols[positions].astype(np.int64) * self.sign

    def bound(self) -> np.int64:
        positions, _ = self._slice(self.at + WINDOW - 1, self.at + WINDOW)
        return self._keys(positions)[0] if len(positions) else _FAR

    def pop(self, bound: np.int64) -> list[np.ndarray]:
        taken = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16))]
        while self.at < len(self.positions):
            positions, prefixes = self._slice(self.at, self.at + WINDOW)
            keys = self._keys(positions)
            n = int(np.searchsorted(keys, bound, "right"))
            taken.append((keys[:n], positions[:n], prefixes[:n]))
            self.at += n
            if n < len(keys):
                break
        return [np.concatenate([t[k] for t in taken]) for k in range(3)]


def _seams(text: _Text, keys: np.ndarray, positions: np.ndarray, prefixes: np.ndarray, kinds: np.ndarray, before: tuple, cap: int) -> np.ndarray:
    """Prefixes, with those of the first of kind 1 behind the last of kind 0 of their key measured; before: key, position and kind of what stood before."""
    keys, positions, kinds = (np.concatenate([[b], x]) for b, x in zip(before, (keys, positions, kinds)))
    at = np.flatnonzero((keys[1:] == keys[:-1]) & (kinds[1:] > kinds[:-1]))
    prefixes = prefixes.astype(np.int64)
    prefixes[at] = _common(text, positions[at], positions[at + 1], cap)
    return prefixes


def _spread_names(text: _Text, seeds: np.ndarray, shared: np.ndarray, folder: str, cap: int, held: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the rising ones, for texts of names: upwards, then downwards with the keys' signs turned."""
    def spread(name: str, known: _Sequence, queue: RunQueue) -> tuple[np.ndarray, np.ndarray]:
        symbols, sign = text.symbols, known.sign
        inducer = _Inducer(symbols, cap, _room(folder, f"last-{name}", int(len(symbols)) + 2))
        positions, prefixes = Column(folder, f"{name}-positions", np.int64), Column(folder, f"{name}-prefixes", np.uint16)
        empty = [np.zeros(0, t) for t in (np.int64, np.int64, np.uint16, np.int8)]
        # What is known of the keys up to a bound, in order: key, position, prefix, kind (0 induced, 1 of the sequence).
        window, bound, before = empty, None, (_FAR, 0, 0)
        while True:
            if not len(window[0]):
                bound = min(queue.bound(), known.bound())
                own, other = queue.pop(bound), known.pop(bound)
                kinds = np.repeat(np.array([0, 1], np.int8), [len(own[0]), len(other[0])])
                window = [*(np.concatenate(x) for x in zip(own, other)), kinds]
                if not len(kinds):
                    return positions.mapped(), prefixes.mapped()
                order = np.lexsort((kinds, window[0]))
                window = [c[order] for c in window]
            key, at, common, kind = window
            symbol = symbols[np.maximum(at - 1, 0)]
            preceding = symbol * sign
            wanted = (at > 0) & np.where(kind == 0, preceding >= key, preceding > key)
            # What is induced may belong before the rest of the window: only what stands before all of it is final.
            least = np.concatenate([[_FAR], np.minimum.accumulate(np.where(wanted, preceding, _FAR))[:-1]])
            final = np.where(kind == 0, key <= least, key < least)
            n = len(final) if final.all() else int(np.argmin(final))
            key, at, kind = key[:n], at[:n], kind[:n]
            common = _seams(text, key, at, common[:n], kind, before, cap)
            before = (key[-1], at[-1], kind[-1])
            positions.add(at[kind == 0])
            prefixes.add(common[kind == 0])
            follows, moved, value = inducer.follow(at, common, symbol[:n], wanted[:n])
            window = [c[n:] for c in window]
            follows = follows * sign
            if sign < 0:
                # Ascending keys; the order within a key stays.
                order = np.argsort(follows, kind="stable")
                follows, moved, value = follows[order], moved[order], value[order]
            near = int(np.searchsorted(follows, bound, "right")) if len(window[0]) or len(follows) else 0
            if near < len(follows):
                queue.push(follows[near:], moved[near:], value[near:])
            if near:
                window = [np.concatenate(x) for x in zip(window, (follows[:near], moved[:near], value[:near], np.zeros(near, np.int8)))]
                order = np.lexsort((window[3], window[0]))
                window = [c[order] for c in window]

    queue = RunQueue(folder, "up", held)
    queue.push(np.zeros(1, np.int64), np.array([len(text.symbols) - 1]), np.zeros(1, np.uint16))
    lower = spread("lower", _Sequence(text.symbols, seeds, shared, 1, False), queue)
    upper = spread("upper", _Sequence(text.symbols, *lower, -1, True), RunQueue(folder, "down", held))

    falling, rising = _Sequence(text.symbols, *lower, 1, False), _Sequence(text.symbols, *upper, 1, True)
    before = (_FAR, 0, 0)
    while True:
        bound = min(falling.bound(), rising.bound())
        own, other = falling.pop(bound), rising.pop(bound)
        kinds = np.repeat(np.array([0, 1], np.int8), [len(own[0]), len(other[0])])
        if not len(kinds):
            return
        key, at, common = (np.concatenate(x) for x in zip(own, other))
        order = np.lexsort((kinds, key))
        key, at, common, kinds = key[order], at[order], common[order], kinds[order]
        common = _seams(text, key, at, common, kinds, before, cap)
        before = (key[-1], at[-1], kinds[-1])
        real = key > 0  # the end itself is no suffix
        if real.any():
            yield at[real], common[real].astype(np.uint16)
