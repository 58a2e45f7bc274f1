"""A context-mixing range coder for token ids, many blocks at a time.

Each block starts from an empty model of three orders.  Order 2 and order 1 know, for the last two ids and for
the last one, which id came next and how often in a row; order 0 is a distribution over the block's ids.  The
three are mixed: P(x) = w2 [x is order 2's] + w1 [x is order 1's] + w0 P0(x).  The weights are chosen by how
sure orders 2 and 1 are and whether they agree.  A range coder writes whether the id is one of the two guesses,
by their mixed probabilities, and any other id by P0, in one narrowing of the range.

Guesses follow from the ids before.  When writing, all of a block's are found by sorting its contexts; then its
weights and the counts of order 0, over the ids that weren't guessed, are known and stand in front of it.  Every
id is unguessed where it first comes, so these counts name all ids of the block, and the model works on their
numbers.  What is left to do id by id is to narrow a range.

A block's ids are cut into a few runs of about equal length.  They share its weights and its order 0, but have
orders 1 and 2 and a range of their own, so that a block takes fewer steps.  The steps of a run depend on each
other, those of different runs don't: NumPy takes one step of all runs at once, so thousands of runs share the
cost of each call.  All arithmetic is on integers, so what one machine writes another one reads.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 8192
#: Blocks at a time, and the runs that each is cut into.
LANES, _RUNS = 768, 4
#: Ids are below 2^BITS, blocks no longer than 2^20.
BITS = 28
_LONGEST = 1 << 20
#: Slots of orders 2 and 1 in a run.
_SLOTS, _ONES = 1 << 9, 1 << 10
_HEAD = struct.Struct("<III")
_SHAPE = struct.Struct(f"<III{_RUNS}I")
#: Rows of weights: two confidences from 0 (no guess) to 3, and whether the guesses are alike.
_ROWS = 32
#: Probabilities are out of 2^32 - 1, made of weights of 2^24 each and of 2^16 of order 0; an eighth of order 0's share is left for
#: ids that aren't guesses.
_WHOLE, _UNIT, _SHARE = np.uint64((1 << 32) - 1), 1 << 8, 57_344
#: Where ids begin in order 0 is out of 2^31.
_PLACES, _UP = np.uint64(31), np.uint64((1 << 31) - 1)
#: Steps that are taken from lanes' rows at a time.
_STEPS = 64
#: Ranges below this take in, or give out, a word of 16 bits.
_FULL, _WORD, _HALF = np.uint64(1 << 48), np.uint64(16), np.uint64(32)


class BlockError(ValueError):
    """A block that doesn't hold the ids whose checksum it has."""


def _expected(context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What followed when each id's context came before, 0 if it never did, and how often in a row, up to 3."""
    n = len(ids)
    kind, bits = np.int32 if n <= 1 << 18 else np.int64, (n - 1).bit_length()  # contexts have 12 bits
    keys = context.astype(kind) << bits
    keys += np.arange(n, dtype=kind)
    keys.sort()
    order = (keys & ((1 << bits) - 1)).astype(np.int64)
    keys >>= bits
    followed, guess, sure = ids[order], np.zeros(n, np.int64), np.zeros(n, np.int64)
    again = keys[1:] == keys[:-1]
    guess[order[1:]] = followed[:-1] * again
    # runs of like ids behind one context
    alike = again & (followed[1:] == followed[:-1])
    run = again.astype(np.int64)
    run[1:] += alike[:-1] & again[1:]
    run[2:] += alike[:-2] & alike[1:-1] & again[2:]
    sure[order[1:]] = run
    return guess, sure


def _slot(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The slot of order 2 for two ids."""
    return (last * 0x9E5 + before) & (_SLOTS - 1)


class _Order0:
    """Shares of a block's numbers by their counts; number 0 is none's, with the count 0."""

    def __init__(self, counts: np.ndarray):
        ends, total = np.cumsum(counts), int(counts.sum())
        self.total = total
        ends = -(-(ends << 31) // total)  # rounded up, so that the decoder finds a number by divisions
        self.ends = ends.astype(np.uint32)
        self.p = (counts * _SHARE // total).astype(np.uint16)



def _part(space: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where numbers of order 0 begin and end in a space for all of them, rounded up."""
    begin, end = ends.take(numbers - 1) * space, ends.take(numbers) * space
    begin += _UP
    begin >>= _PLACES
    end += _UP
    end >>= _PLACES
    return begin, end


def _mix(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of orders 2 and 1 out of 2^32, and of order 0 out of 2^16, by row."""
    w2, w1 = (np.ascontiguousarray(w, np.uint64) * np.uint64(_UNIT) for w in weights.T)
    return w2 << 16, w1 << 16, np.uint64(1 << 16) - w2 - w1


class _Encoder:
    """A low end of 64 bits and a range of 48 to 64 bits for each lane; words of 16 bits go out."""

    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        self.words, self.used = np.zeros((lanes, words), np.int32), np.zeros(lanes, np.int64)

    def reserve(self, words: int) -> None:
        """Make room for so many further words of each lane."""
        if self.used.max() + words > self.words.shape[1]:
            self.words = np.pad(self.words, ((0, 0), (0, words + self.words.shape[1] // 4)))

    def put(self, begin: np.ndarray, size: np.ndarray) -> None:
        """Narrow the first ranges to [begin, begin + size) of 2^32."""
        n = len(begin)
        low, width = self.low[:n], self.range[:n]
        part = width >> 32
        skip = begin * part
        np.multiply(size, part, width)
        low += skip
        over = (low < skip).nonzero()[0]
        if len(over):
            self.words[over, self.used[over] - 1] += 1  # settled in finish()
        small = (width < _FULL).nonzero()[0]
        while len(small):
            at, least = self.used.take(small), low.take(small)
            self.words[small, at] = least >> 48
            self.used[small] = at + 1
            low[small] = least << 16
            least = width.take(small) << 16
            width[small] = least
            small = small[least < _FULL]

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(4):
            self.words[every, self.used] = self.low >> 48
            self.used += 1
            self.low = self.low << 16
        for k in range(int(self.used.max()) - 1, 0, -1):
            self.words[:, k - 1] += self.words[:, k] >> 16
        return [(row[:n] & 0xFFFF).astype("<u2").tobytes() for row, n in zip(self.words, self.used)]


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as their lowest bytes, then the next ones; the higher ones are mostly zeros."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


def encode(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """The blocks of a run of ids; give it about block * LANES of them at a time."""
    ids = np.asarray(ids)
    if not len(ids):
        return []
    if ids.min() < 0 or ids.max() >= 1 << BITS:
        raise ValueError("an id is out of range")
    if block > _LONGEST:
        raise ValueError("a block is too long")
    parts = [ids[i : i + block] for i in range(0, len(ids), block)]
    top = int(ids.max()) + 1
    seen, number = (np.zeros(top, bool), np.zeros(top, np.int64)) if top <= 1 << 20 else (None, None)
    sizes = _run_sizes(np.array([len(part) for part in parts]))
    order, longest = np.argsort(-sizes, kind="stable"), int(sizes[0])  # longer runs first, so that lanes end from the back
    lane = np.argsort(order)
    begins, widths = (np.zeros((len(sizes), longest + 16), np.uint32) for _ in range(2))  # rows at distances that caches like
    heads = []
    for i, part in enumerate(parts):
        distinct, model, begin, width = _modelled(part, seen, number)
        heads.append((distinct, model))
        for k in range(i * _RUNS, (i + 1) * _RUNS):
            at = (k - i * _RUNS) * sizes[i * _RUNS]
            begins[lane[k], : sizes[k]], widths[lane[k], : sizes[k]] = begin[at : at + sizes[k]], width[at : at + sizes[k]]
    coder, active = _Encoder(len(sizes), longest * 3 // 4 + 400), _active(sizes, longest)
    for t in range(0, longest, _STEPS):
        coder.reserve(2 * _STEPS + 4)
        begin, width = (x[:, t : min(t + _STEPS, longest)].T.astype(np.uint64, "C") for x in (begins, widths))
        for x, y, n in zip(begin, width, active[t : t + _STEPS]):
            coder.put(x[:n], y[:n])
    coded, out = coder.finish(), []
    for i, (part, (distinct, model)) in enumerate(zip(parts, heads)):
        runs = [coded[k] for k in lane[i * _RUNS : (i + 1) * _RUNS]]
        body = b"".join([model, *runs])
        shape = _SHAPE.pack(distinct, len(model), zlib.crc32(body), *map(len, runs))
        out.append(_HEAD.pack(len(part), len(shape) + len(body), zlib.crc32(part.astype("<u4", copy=False).tobytes())) + shape + body)
    return out


def _run_sizes(sizes: np.ndarray) -> np.ndarray:
    """The lengths of the runs of blocks of these sizes, one block after the other; the last runs may be shorter or empty."""
    each = -(-sizes // _RUNS)
    return np.clip(sizes[:, None] - each[:, None] * np.arange(_RUNS), 0, each[:, None]).ravel()


def _active(sizes: np.ndarray, longest: int) -> list[int]:
    """How many runs are longer than each step's number."""
    return (len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), "right")).tolist()


def _modelled(ids: np.ndarray, seen: np.ndarray | None, number: np.ndarray | None) -> tuple[int, bytes, np.ndarray, np.ndarray]:
    """The number of a block's distinct ids, its model, and where each id begins in what the model expects and how wide it is there.
    seen, number: room for a mark, which is taken back, and a number of each id."""
    if seen is None:
        own, now = np.unique(ids, return_inverse=True)
        now += 1
    else:
        seen[ids] = True
        own = np.flatnonzero(seen)
        seen[own] = False
        number[own] = np.arange(1, len(own) + 1)
        now = number[ids]
    last, before = np.zeros_like(now), np.zeros_like(now)
    each = -(-len(ids) // _RUNS)
    last[1:], before[2:] = now[:-1], now[:-2]
    last[::each], before[::each], before[1::each] = 0, 0, 0
    run = np.arange(len(ids)) // each
    (a, sure2), (b, sure1) = _expected(_slot(last, before) + run * _SLOTS, now), _expected((last & (_ONES - 1)) + run * _ONES, now)
    same = a == b
    row = (sure2 * 4 + sure1) * 2 + same
    outcome = np.where(now == a, 0, np.where(now == b, 1, 2))
    weights = _weights(np.bincount(row * 4 + outcome, minlength=_ROWS * 4).reshape(-1, 4))
    rare = np.flatnonzero(outcome == 2)
    numbers = now[rare]
    counts = np.bincount(numbers, minlength=len(own) + 1)
    order0, (w2, w1, w0) = _Order0(counts), _mix(weights)
    w = w0[row]
    first = order0.p[a] * w + w2[row]
    second = (order0.p[b] * w + w1[row]) * ~same + first
    later = outcome > 0
    begin, size = first * later, np.where(later, second - first, first)
    second = second[rare]
    space = _WHOLE - second
    least, most = _part(space, order0.ends, numbers)
    begin[rare] = second + least
    size[rare] = most - least
    return len(own), zlib.compress(weights.tobytes() + _planes(np.diff(own, prepend=0)) + _planes(counts[1:]), 4), begin, size


def _weights(came: np.ndarray) -> np.ndarray:
    """Each row's weights of orders 2 and 1, by how often they were right; what came is never given none."""
    whole = np.maximum(came[:, :3].sum(1), 1)
    w2, w1 = (np.maximum(came[:, k] * 255 // whole, came[:, k] > 0) for k in (0, 1))
    w2 = np.minimum(w2, 255 - w1)
    return np.stack([w2, w1], 1).astype(np.uint8)


def header(data: bytes) -> tuple[int, int]:
    """The number of ids and of following bytes of a block, from its first HEADER bytes."""
    n, size, _ = _HEAD.unpack(data[:HEADER])
    return n, size


HEADER = _HEAD.size


def _opened(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """A block's weights, distinct ids, their counts and the words of its runs."""
    try:
        distinct, size, crc, *lengths = _SHAPE.unpack_from(block, HEADER)
        if zlib.crc32(memoryview(block)[HEADER + _SHAPE.size :]) != crc:
            raise BlockError("a block is damaged")
        model = zlib.decompress(block[HEADER + _SHAPE.size : HEADER + _SHAPE.size + size])
        weights = np.frombuffer(model[: 2 * _ROWS], np.uint8).reshape(_ROWS, 2)
        ids, counts = (_from_planes(model[2 * _ROWS + k * 4 * distinct : 2 * _ROWS + (k + 1) * 4 * distinct]) for k in (0, 1))
        edges = np.cumsum([HEADER + _SHAPE.size + size, *lengths]).tolist()
        if edges[-1] != len(block):
            raise BlockError("a block's runs are damaged")
        words = [np.frombuffer(block[x:y], "<u2") for x, y in zip(edges, edges[1:])]
    except (struct.error, zlib.error, ValueError) as broken:
        raise BlockError("a block's model is damaged") from broken
    n, ids = _HEAD.unpack(block[:HEADER])[0], np.cumsum(ids)
    if not (len(ids) == len(counts) == distinct > 0 and ids[-1] < 1 << BITS and 0 < counts.min() and counts.sum() <= n <= _LONGEST and weights.sum(1, np.int64).max() < 256):
        raise BlockError("a block's model is damaged")
    return weights, ids, counts, words


def decode(blocks: list[bytes]) -> np.ndarray:
    """The ids of whole blocks of any lengths, one run after the other."""
    if not blocks:
        return np.zeros(0, np.uint32)
    heads = [_HEAD.unpack(b[:HEADER]) for b in blocks]
    weights, known, counted, data = zip(*map(_opened, blocks))
    sizes = _run_sizes(np.array([n for n, _, _ in heads]))
    order = np.argsort(-sizes, kind="stable")  # longer runs first, so that lanes end from the back
    lanes, longest, of, data = len(order), int(sizes[order[0]]), order // _RUNS, [d for runs in data for d in runs]
    # ids are numbers of their block, 0 for none; tables have all blocks' numbers one after the other
    distinct = np.array([len(k) for k in known]) + 1
    kind = np.uint16 if distinct.max() <= 1 << 14 else np.uint32
    starts, models = np.cumsum(distinct) - distinct, [_Order0(np.append(0, c)) for c in counted]
    p0, ends = (np.concatenate([getattr(m, k) for m in models]) for k in ("p", "ends"))
    totals = np.array([m.total for m in models])
    places, slots = np.cumsum(totals) - totals, np.concatenate([np.repeat(np.arange(1, len(c) + 1, dtype=kind), c) for c in counted])
    w2, w1, w0 = _mix(np.concatenate(weights))
    # what orders 2 and 1 expect: a number times 4 plus its confidence, for each slot and for each number
    entries, base2 = np.zeros(lanes * (_SLOTS + _ONES), kind), np.arange(lanes) * (_SLOTS + _ONES)
    base1, starts, totals, places = base2 + _SLOTS, starts[of], totals[of].astype(np.uint64), places[of]
    longest_data = max(map(len, data)) + 5
    words = np.zeros((lanes, longest_data), np.uint16)
    for row, k in zip(words, order):
        row[: len(data[k])] = data[k]
    at, end = np.arange(lanes) * longest_data + 4, np.arange(1, lanes + 1) * longest_data - 1
    code, width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    for k in range(4):
        code = code << 16 | words[:, k]
    words = words.ravel()
    now, before, rows, begins = np.zeros(lanes, kind), np.zeros(lanes, np.int64), of * _ROWS, np.append(starts, starts)
    grid, seen, n = np.zeros((longest, lanes), kind), np.zeros(2 * lanes, np.int64), lanes
    for t, active in enumerate(_active(sizes, longest)):
        if active < n:
            n = active
            code, width, at, end, now, before, rows, base2, base1 = (x[:n] for x in (code, width, at, end, now, before, rows, base2, base1))
            begins, seen = np.append(starts[:n], starts[:n]), np.zeros(2 * n, np.int64)
        last = now.astype(np.int64)
        np.add(_slot(last, before), base2, seen[:n])
        np.add(last & (_ONES - 1), base1, seen[n:])
        before = last
        entry = entries.take(seen)
        guess = entry >> 2
        a, b = guess[:n], guess[n:]
        same = a == b
        row = entry & 3
        row = ((row[:n] << 2 | row[n:]) << 1 | same) + rows
        share = w0.take(row)
        p = p0.take(guess + begins)
        first = p[:n] * share
        first += w2.take(row)
        second = p[n:] * share
        second += w1.take(row)
        second *= ~same
        second += first
        part = width >> _HALF
        begin, width = first * part, second * part
        later, unknown = code >= begin, code >= width
        width = np.where(later, width, begin)
        begin *= later
        width -= begin
        now = np.where(later, b, a)
        rare = unknown.nonzero()[0]
        if len(rare):
            second, unit, place = second.take(rare), part.take(rare), code.take(rare)
            space, total = _WHOLE - second, totals.take(rare)
            place //= unit
            place -= second
            place <<= _PLACES
            place //= space
            place *= total
            place >>= _PLACES
            total -= np.uint64(1)
            place = np.minimum(place, total).view(np.int64)  # a damaged block may lead anywhere
            place += places.take(rare)
            number = slots.take(place)
            least, most = _part(space, ends, number + starts.take(rare))
            most -= least
            least += second
            least *= unit
            most *= unit
            begin[rare], width[rare], now[rare] = least, most, number
        code -= begin
        short = width < _FULL
        while short.any():
            by = short * _WORD
            width <<= by
            code <<= by
            code |= words.take(at) * short
            at += short
            np.minimum(at, end, at)
            short = width < _FULL
        # the numbers that came, with their confidence
        fresh = now << 2
        entry[:n] ^= fresh
        entry[n:] ^= fresh
        alike = entry < 4
        np.minimum(entry, 2, entry)
        entry *= alike
        entry += 1
        entry[:n] += fresh
        entry[n:] += fresh
        entries[seen] = entry
        grid[t, :n] = now
    rows, lane, out = np.ascontiguousarray(grid.T), np.argsort(order), []
    for i, (_, _, crc) in enumerate(heads):
        numbers = np.concatenate([rows[lane[k], : sizes[k]] for k in range(i * _RUNS, (i + 1) * _RUNS)])
        found = known[i].astype("<u4")[numbers.astype(np.int64) - 1]
        if zlib.crc32(found.tobytes()) != crc:
            raise BlockError("a block's checksum doesn't match its ids")
        out.append(found)
    return np.concatenate(out)
