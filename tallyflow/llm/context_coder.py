"""An adaptive context-mixing range coder for token ids, for many blocks side by side.

A block starts with its alphabet, the different ids it holds, in ascending order. From then on an id is its place in the alphabet, and three predictions of
the next place are mixed:

* order 0: a frequency for every place of the alphabet, 1 at first and raised each
  time the place occurs, so a real distribution that adapts from id to id;
* order 1 and order 2: the place that last followed the same place, or the same two,
  with a confidence and a learned probability that such a candidate is right.

The candidates' probabilities are mixed by reliability, and what they leave is
divided by the frequencies of order 0, in the same step of the range coder. The
decoder keeps their running sums in two levels, groups of places and places within
a group. The encoder, which has all places at hand, counts earlier smaller and equal
ones for a run of steps at once.

Blocks know nothing of each other. So many of them are coded in step, one id of
each at a time in numpy, and each can be decoded alone. All values are whole numbers;
those of the range coder are below 2**48 and kept in doubles, in which sums, products
and rounded-down quotients of such numbers are exact and quicker than in 64-bit integers.
The coder writes 24-bit digits; carries are settled at the end.
"""

from __future__ import annotations

import struct

import numpy as np

# A range has at least one digit, at most two. An id leaves at least 6 of 2**24.
DIGIT = 1 << 24
TOP = float(DIGIT * DIGIT)
CHANCE = 1 << 12
# A block is so short that its frequencies fit 16 bits, and a place leaves four bits for a confidence.
MOST_IDS = 2048
PLACE = (1 << 12) - 1
RAISE = 2
LONGEST = ((1 << 16) - 1 - MOST_IDS) // RAISE
# Slots of the table of candidates of a block, for order 1 and for order 2.
SLOTS = 1024
# Steps for which the encoder counts at once.
AT_ONCE = 64
# Up to this id a table by id is quicker than sorting a block.
LARGEST = 1 << 17
HEAD = struct.Struct("<HB")  # ids of the alphabet, and their low bits


class Candidates:
    """Predictions of orders 1 and 2 in each of some blocks, and what is learned from them."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        # Both orders side by side: confidence and place. One more place than any alphabet has: no candidate.
        self.table = np.full(lanes * 2 * SLOTS, MOST_IDS, np.uint16)
        self.slots = np.arange(lanes) * (2 * SLOTS) + np.array([[0], [SLOTS]])
        self.right = np.full(lanes * 2 * 16, 600, np.int16)
        self.rates = (np.arange(lanes) * 2 + np.array([[0], [1]])) * 16
        self.at = np.empty((2, lanes), np.int64)
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)

    def cut(self, n: int) -> None:
        """From now on only the first ``n`` blocks go on."""
        self.lane, self.last, self.before = self.lane[:n], self.last[:n], self.before[:n]
        self.slots, self.rates = self.slots[:, :n].copy(), self.rates[:, :n].copy()
        self.at = np.empty((2, n), np.int64)

    def predict(self) -> None:
        """Candidates of both orders, and the chances out of ``CHANCE`` of the second and of both; 0 for none."""
        np.bitwise_and(self.last, SLOTS - 1, out=self.at[0])
        np.bitwise_and(self.last * 40503 + self.before * 30011 >> 2, SLOTS - 1, out=self.at[1])
        self.at += self.slots
        self.entry = self.table.take(self.at)
        self.seen = self.entry & PLACE
        self.rate_at = self.rates + (self.entry >> 12)
        self.rate = self.right.take(self.rate_at)
        self.some = self.seen < MOST_IDS
        # Squares are below 2**24, so exact in single precision.
        p = np.multiply(self.rate, self.some, dtype=np.float32)
        total = p[0] + p[1]
        total += 1
        p *= p
        p /= total
        q1, q2 = np.ceil(p, out=p)
        self.c1, self.c2 = self.seen
        self.both = q1 + q2
        self.q2 = np.where(self.c1 == self.c2, self.both, q2)

    def split(self, rng: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ranges: that of the order-2 candidate, of both, and one count of order 0."""
        unit = np.floor(rng * (1 / CHANCE))
        one, both = unit * self.q2, unit * self.both
        return one, both, np.floor((rng - both) / total)

    def learn(self, place: np.ndarray) -> None:
        """What came."""
        short, entry = place.astype(np.uint16), self.entry
        hit = self.seen == short
        # An empty slot says nothing about candidates of no confidence.
        change = np.where(hit, np.int16(4000), np.int16(20))
        change -= self.rate
        change *= self.some
        change >>= 4
        self.right[self.rate_at] = self.rate + change
        # A candidate that was right gains confidence, a wrong one loses half of it, or its slot.
        lower = np.where(entry > PLACE, (entry >> 1 & ~np.uint16(PLACE)) | self.seen, short)
        higher = np.maximum(entry, entry + np.uint16(PLACE + 1))  # the highest confidence wraps
        self.table[self.at] = np.where(hit, higher, lower)
        self.before, self.last = self.last, place


class Sums:
    """Running sums of the frequencies of order 0, to find a place by."""

    def __init__(self, alphabets: np.ndarray):
        widest = int(alphabets.max())
        # Eight places to a group, or more where there would be over 64 groups.
        self.bits = max(3, (-(-widest // 64) - 1).bit_length())
        self.width = 1 << self.bits
        self.n = -(-widest // self.width)
        # Starts of groups and the end of the last one; ends of places within their group.
        edges = np.minimum(np.arange(self.n + 1)[:, None] * self.width, alphabets)
        self.groups = edges.astype(np.uint16)
        inside = np.clip(alphabets[:, None] - np.arange(self.n) * self.width, 0, self.width)
        self.places = np.minimum(np.arange(1, self.width + 1), inside.reshape(-1, 1)).astype(np.uint16)
        self.number = np.arange(1, self.n + 1, dtype=np.uint16)[:, None]
        # What an occurrence adds: to all sums that end with it or after it.
        added = np.arange(self.width) >= np.arange(self.width)[:, None]
        self.added = added.astype(np.uint16) * np.uint16(RAISE)
        # A group's sums move as one value; numpy is quickest with 16 bytes, whatever they hold.
        self.rows = self.places.view(np.complex128 if self.width == 8 else f"V{2 * self.width}").ravel()
        self.cut(len(alphabets))

    def cut(self, n: int) -> None:
        self.groups, self.lane = self.groups[:, :n].copy(), np.arange(n)
        self.row, self.flat = self.lane * self.n, self.lane * self.width
        self.below, self.more = np.empty((self.n, n), bool), np.empty((self.n, n), np.uint16)

    def find(self, wanted: np.ndarray, known: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place that a count falls to, or the known one; its start and its size. The place is then raised."""
        np.less_equal(self.groups[1:], wanted, out=self.below)
        group = np.add.reduce(self.below.view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)
        group = np.where(known, place >> self.bits, group)
        before = self.groups.take(group * len(self.lane) + self.lane)
        at = self.row + group
        rows = self.rows.take(at).view(np.uint16).reshape(-1, self.width)
        # Eight comparisons to a word; the product adds up its bytes.
        below = (rows <= (wanted - before)[:, None]).view(np.uint64)
        words = below[:, 0]
        for w in range(1, self.width // 8):
            words = words + below[:, w]
        inside = (words * np.uint64(0x0101010101010101) >> np.uint64(56)).view(np.int64)
        inside = np.where(known, place & (self.width - 1), inside)
        flat = self.flat + inside
        end = rows.take(flat)
        start = rows.take(flat - 1, mode="wrap") * (inside > 0)
        rows += self.added.take(inside, 0)
        self.rows[at] = rows.view(self.rows.dtype).ravel()
        # Wraps to the upper half of the numbers for groups that start later.
        np.subtract(group.astype(np.uint16), self.number, out=self.more)
        np.right_shift(self.more, 15, out=self.more)
        np.multiply(self.more, RAISE, out=self.more)
        self.groups[1:] += self.more
        return (group << self.bits) + inside, before + start, end - start


class Encoder:
    def __init__(self, lanes: int, digits: int):
        self.low, self.range = np.zeros(lanes), np.full(lanes, TOP)
        # A digit before the first takes no carry: the whole stays below 1.
        self.out, self.width = np.zeros(lanes * digits, np.uint32), digits
        self.at = np.arange(lanes) * digits + 1

    def narrow(self, add: np.ndarray, rng: np.ndarray) -> None:
        """Keeps ``rng`` of the range of the first blocks, from ``add`` on."""
        n = len(add)
        low, at = self.low[:n], self.at[:n]
        low += add
        over = np.flatnonzero(low >= TOP)
        if len(over):
            self.out[at[over] - 1] += 1
            low[over] -= TOP
        # The next digit is written in any case, and stays if the range is too small.
        digit = np.floor(low * (1 / DIGIT))
        self.out[at] = digit.astype(np.uint32)
        moved = rng < DIGIT
        at += moved
        by = np.where(moved, float(DIGIT), 1.0)
        digit *= moved
        digit *= DIGIT
        low -= digit
        low *= by
        np.multiply(rng, by, out=self.range[:n])

    def finish(self) -> list[bytes]:
        # The only number with one more digit that is surely in the range.
        digit = np.ceil(self.low * (1 / DIGIT))
        self.out[self.at] = digit.astype(np.uint32)
        ends = self.at + 1 - np.arange(len(self.at)) * self.width
        digits = self.out.reshape(len(ends), -1)[:, : ends.max()].astype("<u4")
        while len(over := np.flatnonzero(digits.ravel() >> 24)):
            digits.ravel()[over] &= DIGIT - 1
            digits.ravel()[over - 1] += 1
        packed = digits.view(np.uint8).reshape(*digits.shape, 4)[:, :, :3]
        return [packed[i, 1:n].tobytes() for i, n in enumerate(ends.tolist())]


class Decoder:
    def __init__(self, payloads: list[bytes]):
        self.width = max(max(len(p) // 3 for p in payloads) + 2, 2)
        digits = np.zeros((len(payloads), self.width, 4), np.uint8)
        for i, p in enumerate(payloads):
            digits[i, : len(p) // 3, :3] = np.frombuffer(p, np.uint8, len(p) // 3 * 3).reshape(-1, 3)
        self.digits = digits.view("<u4").ravel()
        self.at = np.arange(len(payloads)) * self.width
        self.code = self.digits[self.at] * float(DIGIT) + self.digits[self.at + 1]
        self.at += 2
        self.end = np.arange(1, len(payloads) + 1) * self.width - 1
        self.range = np.full(len(payloads), TOP)

    def narrow(self, add: np.ndarray, rng: np.ndarray) -> None:
        n = len(add)
        code, at = self.code[:n], self.at[:n]
        code -= add
        moved = rng < DIGIT
        by = np.where(moved, float(DIGIT), 1.0)
        code *= by
        code += self.digits.take(np.minimum(at, self.end[:n])) * moved
        at += moved
        np.multiply(rng, by, out=self.range[:n])


def packed_alphabet(ids: np.ndarray) -> bytes:
    """Ascending different ids: their low bits side by side, and a bitmap in which the rest is counted in zeros.

    Some two bits an id more than there is to tell.
    """
    n = len(ids)
    low = max(0, (int(ids[-1]) // n).bit_length() - 1)
    tails = (ids[:, None] >> np.arange(low)) & 1
    marks = np.zeros(int(ids[-1] >> low) + n, np.uint8)
    marks[(ids >> low) + np.arange(n)] = 1
    return HEAD.pack(n, low) + np.packbits(tails.astype(np.uint8)).tobytes() + np.packbits(marks).tobytes()


def unpacked_alphabet(payload: bytes) -> tuple[np.ndarray, int]:
    """The ids of a block, and where its digits start."""
    n, low = HEAD.unpack_from(payload)
    at = HEAD.size + (n * low + 7) // 8
    tails = np.unpackbits(np.frombuffer(payload, np.uint8, at - HEAD.size, HEAD.size), count=n * low).reshape(n, low)
    # The bitmap ends with the n-th mark; an id needs two bits there on average, seldom more than 16.
    size = n // 2 + 8
    while True:
        bits = np.unpackbits(np.frombuffer(payload[at : at + size], np.uint8))
        marks = np.flatnonzero(bits)
        if len(marks) >= n or at + size >= len(payload):
            break
        size *= 2
    marks = marks[:n]
    ids = (marks - np.arange(n) << low) + tails @ (1 << np.arange(low))
    return ids, at + int(marks[-1]) // 8 + 1


def counts_so_far(places: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size in order 0 of each of some steps (rows) of blocks (columns).

    ``seen`` has the counts of each block's places before these steps, which are added to it.
    """
    steps, lanes = places.shape
    less = np.zeros((steps, lanes), np.uint8)
    equal = np.zeros((steps, lanes), np.uint8)
    for s in range(steps - 1):
        less[s + 1 :] += (places[s + 1 :] > places[s]).view(np.uint8)
        equal[s + 1 :] += (places[s + 1 :] == places[s]).view(np.uint8)
    at = np.arange(lanes) * seen.shape[1] + places
    size = seen.take(at)
    before = np.cumsum(seen, axis=1, dtype=np.uint16).take(at) - size
    np.add.at(seen.reshape(-1), at.reshape(-1), np.uint16(1))
    return (before + less) * RAISE + places, (size + equal) * RAISE + 1


def alphabet_of(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids of a block in ascending order, and the place of each id."""
    top = int(block.max())
    if top > LARGEST:
        return np.unique(block, return_inverse=True)
    ids = np.sort(block)
    alphabet = ids[np.append(True, ids[1:] != ids[:-1])].astype(np.int64)
    place = np.empty(top + 1, np.uint16)
    place[alphabet] = np.arange(len(alphabet))
    return alphabet, place.take(block)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """One payload for each block of 1 to ``LONGEST`` ids, ``MOST_IDS`` different ones at most."""
    sizes = np.array([len(b) for b in blocks])
    if not 0 < sizes.min() <= sizes.max() <= LONGEST:
        raise ValueError(f"a block has 1 to {LONGEST} ids")
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max())
    places = np.zeros((steps, len(blocks)), np.uint16)
    alphabets = []
    for i, b in enumerate(order):
        alphabet, place = alphabet_of(blocks[b])
        alphabets.append(alphabet)
        places[: sizes[b], i] = place
    widths = np.array([len(a) for a in alphabets])
    if widths.max() > MOST_IDS:
        raise ValueError(f"a block has {MOST_IDS} different ids at most")
    model = Candidates(len(blocks))
    coder = Encoder(len(blocks), steps + 4)
    seen = np.zeros((len(blocks), int(widths.max())), np.uint16)
    alive = np.searchsorted(-sizes[order], -np.arange(steps), side="left")  # blocks longer than each step
    for t in range(steps):
        n = int(alive[t])
        if n < len(model.lane):
            model.cut(n)
        if t % AT_ONCE == 0:
            some = places[t : t + AT_ONCE, :n]
            starts, counts = counts_so_far(some, seen[:n])
            wide = some.astype(np.int64)
        place = wide[t % AT_ONCE, :n]
        model.predict()
        first, second = place == model.c2, place == model.c1
        one, both, rest = model.split(coder.range[:n], widths[:n] + RAISE * t)
        add = np.where(first, 0, np.where(second, one, both + rest * starts[t % AT_ONCE, :n]))
        coder.narrow(add, np.where(first, one, np.where(second, both - one, rest * counts[t % AT_ONCE, :n])))
        model.learn(place)
    payloads: list[bytes] = [b""] * len(blocks)
    for i, digits, alphabet in zip(order, coder.finish(), alphabets):
        payloads[i] = packed_alphabet(alphabet) + digits
    return payloads


def decode_blocks(payloads: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    """The ids of each block."""
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max())
    alphabets, digits = [], []
    for i in order:
        alphabet, at = unpacked_alphabet(payloads[i])
        alphabets.append(alphabet.astype(np.uint32))
        digits.append(payloads[i][at:])
    widths = np.array([len(a) for a in alphabets])
    model, sums, coder = Candidates(len(payloads)), Sums(widths), Decoder(digits)
    places = np.zeros((steps, len(payloads)), np.uint16)
    alive = np.searchsorted(-sizes[order], -np.arange(steps), side="left")
    for t in range(steps):
        n = int(alive[t])
        if n < len(model.lane):
            model.cut(n)
            sums.cut(n)
        model.predict()
        code, rng, total = coder.code[:n], coder.range[:n], widths[:n] + RAISE * t
        one, both, rest = model.split(rng, total)
        first, known = code < one, code < both
        # Where a candidate is right, what is looked up here is not used.
        wanted = np.minimum(np.maximum(code - both, 0) / rest, total - 1).astype(np.uint16)
        candidate = np.where(first, model.c2, model.c1).astype(np.int64)
        place, start, size = sums.find(wanted, known, candidate)
        add = np.where(first, 0, np.where(known, one, both + rest * start))
        coder.narrow(add, np.where(first, one, np.where(known, both - one, rest * size)))
        places[t, :n] = place
        model.learn(place)
    out_ids: list[np.ndarray] = [places[:0, 0]] * len(payloads)
    for i, b in enumerate(order):
        out_ids[b] = alphabets[i][places[: sizes[b], i]]
    return out_ids
