"""An adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

The ids of a segment are cut into blocks of ``BLOCK`` ids.  Every block starts from a fresh model and a fresh
coder, so blocks decode alone, and so many blocks can be coded side by side: each numpy operation below works
on one id of every block at once.

Ids are ranked by frequency in the segment.  The model mixes three predictions of the next one:
- order 2: the id last seen after the same two ids in this block; its share adapts to how often it was right.
- order 1: the frequencies of the ids that follow the last id in the segment (pairs seen LEAST_PAIRS times or more, of the
  HEAD1 most frequent ids).  Its share is the mean of what the segment says of that id and of an adaptive one.
- order 0: the counts of this block so far, added to the segment's frequencies; brought up to date every EPOCH ids.  The
  HEAD0 most frequent ids have counts of their own, the others share those of their rank's power of two, and the bits
  below it follow as they are.  Any number of distinct ids can be coded.
The segment's frequencies are what each block starts from; they are stored once in a segment.

The coder keeps a 64-bit low and range.  A step divides the range into 2**24 parts; ranges under 2**32
are scaled up by moving out the low's upper 32-bit word.  Carries go to the word moved out last, and are
settled at the end of a block.

Segment layout (little-endian): magic ``DSR2``, u32 count of ids, u32 distinct ids, u32 blocks, u32 bytes of tables and
their u32 crc32; the deflated tables (ids by rank, order 0 frequencies, and for each id of order 1 its share, its number
of successors, the successors and their frequencies); for each block u32 words and u32 crc32 of its ids; then the
blocks' words, u32 each.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"DSR2"
BLOCK = 2048
LANES = 4096  # blocks that are coded side by side
HEAD0, HEAD1, LEAST_PAIRS = 1024, 2048, 5
EPOCH, SEEN = 1024, 1024  # the segment's frequencies count as much as SEEN ids
BITS2 = 9
TOTAL = 1 << 24
PARTS0, PARTS1 = 16, 12  # bits of the frequencies' sums
RATE = 5
ROWS = 16  # ids of every block that are modelled at a time; EPOCH is a multiple
PASS = 1 << 22  # a whole number of blocks
DENSE_IDS = 1 << 20  # below, ids are looked up in tables
LEAST, MOST2, MOST1 = TOTAL >> 7, TOTAL - (TOTAL >> 3), TOTAL - (TOTAL >> 5)  # of a share
GAIN2, LOSS1 = (MOST2 - LEAST) >> RATE, (MOST1 - LEAST) >> RATE
U = np.uint64


class CorruptSegment(ValueError):
    pass


def _shared_out(counts: np.ndarray, total: int, whole: int) -> np.ndarray:
    """Whole numbers of at least 1 in proportion to ``counts``, whose sum ``total`` is; at most ``whole`` together."""
    return 1 + counts.astype(np.int64) * (whole - len(counts)) // max(total, 1)


class _Tables:
    """What a segment says of its ids: names by rank, frequencies of order 0 and order 1."""

    def __init__(self, names, prior, shares, sizes, successors, frequencies):
        self.names, self.prior = names, prior.astype(np.int64)
        self.shares, self.sizes, self.successors, self.frequencies = shares, sizes, successors.astype(np.int32), frequencies.astype(np.int32)
        self.head = len(shares)
        self.first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        before = np.cumsum(frequencies, dtype=np.int64) - frequencies
        self.before = (before - np.repeat(before[self.first[:-1][sizes > 0]], sizes[sizes > 0])).astype(np.int32)

    def packed(self) -> np.ndarray:
        """Each pair's successor, place and frequency in one number, and one for no pair."""
        return np.append((self.successors.astype(np.int64) << 32) | (self.before.astype(np.int64) << 16) | self.frequencies, 0)

    @staticmethod
    def n_classes(kinds: int) -> int:
        return kinds if kinds <= HEAD0 else HEAD0 + (kinds - HEAD0).bit_length()

    @classmethod
    def of(cls, ids: np.ndarray):
        """The tables of a segment, the ranks of its ids, and for each id its pair's place in order 1 (-1: none)."""
        if int(ids.max()) < DENSE_IDS:
            counts = np.bincount(ids)
            order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
            places = np.zeros(len(counts), np.int32)
            places[order] = np.arange(len(order), dtype=np.int32)
            names, counts, ranks = order, counts[order], places[ids]
        else:
            names, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            places = np.empty(len(order), np.int32)
            places[order] = np.arange(len(order), dtype=np.int32)
            names, counts, ranks = names[order], counts[order], places[inverse]
        n = cls.n_classes(len(names))
        classes = np.add.reduceat(counts, [*range(min(len(names), HEAD0)), *(HEAD0 - 1 + (1 << j) for j in range(n - min(n, HEAD0)))])
        prior = _shared_out(classes, len(ids), 1 << PARTS0)
        head = min(len(names), HEAD1)
        keys, pairs = np.empty(len(ids), np.int32), np.zeros(head * head + 1, np.int64)
        for at in range(0, len(ids), PASS):
            x = ranks[at : at + PASS]
            last = np.concatenate([ranks[at - 1 : at] if at else x[:1], x[:-1]])
            last[:: BLOCK] = 0  # what comes before a block
            key = last * head + x
            key[(x >= head) | (last >= head)] = head * head
            keys[at : at + PASS] = key
            pairs += np.bincount(key, minlength=head * head + 1)
        pairs = pairs[:-1]
        kept = np.flatnonzero(pairs >= LEAST_PAIRS)
        who, counts1 = kept // head, pairs[kept]
        sizes = np.bincount(who, minlength=head)
        sums = np.bincount(who, counts1, minlength=head).astype(np.int64)
        seen = counts[:head] + 1
        shares = np.where(sizes > 0, np.clip((sums << 12) // seen, 1, MOST1 >> 12), 0)
        frequencies = 1 + counts1 * ((1 << PARTS1) - sizes[who]) // np.maximum(sums[who], 1)
        made = cls(names.astype(np.uint32), prior, shares.astype(np.uint16), sizes.astype(np.int64), kept % head, frequencies)
        places = np.full(head * head + 1, -1, np.int32)
        places[kept] = np.arange(len(kept), dtype=np.int32)
        return made, ranks, places[keys]

    def stored(self) -> bytes:
        arrays = (self.names.astype("<u4"), (self.prior - 1).astype("<u2"), self.shares.astype("<u2"), self.sizes.astype("<u2"))
        arrays += (self.successors.astype("<u2"), (self.frequencies - 1).astype("<u2"))
        return zlib.compress(b"".join(a.tobytes() for a in arrays), 6)

    @classmethod
    def read(cls, stored: bytes, kinds: int):
        raw, at = zlib.decompress(stored), 0

        def array(kind: str, n: int):
            nonlocal at
            got = np.frombuffer(raw, kind, n, at)
            at += got.nbytes
            return got

        head = min(kinds, HEAD1)
        names, prior, shares = array("<u4", kinds), array("<u2", cls.n_classes(kinds)), array("<u2", head)
        sizes = array("<u2", head).astype(np.int64)
        pairs = int(sizes.sum())
        return cls(names, prior.astype(np.int64) + 1, shares, sizes, array("<u2", pairs).astype(np.int64), array("<u2", pairs).astype(np.int64) + 1)


class _Model:
    """The mixing model of some blocks; symbols are ranks."""

    def __init__(self, lanes: int, tables: _Tables):
        self.tables, self.lanes, self.n = tables, lanes, len(tables.prior)
        # half of the share in 4096ths; what has no successors comes out negative
        self.half1 = np.append(np.where(tables.sizes > 0, tables.shares.astype(np.int32) >> 1, -4096), -4096).astype(np.int32)
        self.counts = np.zeros(lanes * self.n, np.int32)
        self.t2 = np.zeros(lanes << BITS2, np.uint16)  # a rank beyond is held as 65535, and so predicts that one
        self.base2 = np.arange(lanes, dtype=np.int64) << BITS2
        self.w2 = np.full(lanes, TOTAL >> 6, np.int32)
        self.w1 = np.full(lanes, TOTAL >> 1, np.int32)
        self.a = np.zeros(lanes, np.int64)
        self.b = np.zeros(lanes, np.int64)
        self.offset = np.arange(lanes, dtype=np.int32) << (PARTS0 + 1)
        self.settle(0)

    def settle(self, seen: int, rows: np.ndarray | None = None) -> None:
        """Order 0 after ``seen`` ids of every block; ``rows`` are those since the last time."""
        lanes, n = self.lanes, self.n
        if rows is not None:
            where = self.classes(rows) + np.arange(rows.shape[1], dtype=np.int64) * n
            self.counts += np.bincount(where.ravel("K"), minlength=lanes * n).astype(np.int32)
        # a sum of 2**PARTS0, of which the prior has as much as SEEN ids
        whole, each = (1 << PARTS0) - n, (1 << PARTS0) // SEEN
        scale = (whole << 10) // ((SEEN + seen) * each)
        prior = (self.tables.prior * scale >> 10).astype(np.int32) + 1
        cum = np.zeros((lanes, n + 1), np.int32)
        np.cumsum((self.counts * np.int32(each * scale) >> 10).reshape(lanes, n) + prior, axis=1, out=cum[:, 1:])
        cum += self.offset[:, None]
        self.cum0 = cum.reshape(-1)

    @staticmethod
    def classes(ranks: np.ndarray) -> np.ndarray:
        """The order 0 classes of ranks: themselves, or HEAD0 and on by the power of two beyond."""
        ranks = ranks.astype(np.int64)
        if ranks.size and int(ranks.max()) >= HEAD0:
            beyond = ranks >= HEAD0
            ranks[beyond] = HEAD0 + np.frexp((ranks[beyond] - HEAD0 + 1).astype(np.float64))[1] - 1
        return ranks

    def predict(self, n: int):
        """Of the first n blocks: order 2's symbol and share, the width of a part of order 1, and what both take."""
        a, m2 = self.a[:n], self.w2[:n]
        self.i2 = ((a * 40503 + self.b[:n]) & ((1 << BITS2) - 1)) + self.base2[:n]
        share = np.maximum(self.half1[a] + (self.w1[:n] >> 13), 0)
        q = ((TOTAL - m2) >> 12) * share >> 12
        return self.t2[self.i2], m2, q, m2 + (q << PARTS1)

    def known(self, x: np.ndarray, none: np.ndarray):
        """Of ids to come, row by row: where order 2 is right, where neither it nor order 1 (``none``: not) is, order 2's
        share, and the width of a part of order 1; the model goes past them."""
        c = len(x)
        a = np.empty((c + 2, self.lanes), np.int64)
        a[0], a[1] = self.b >> 5, self.a
        np.minimum(x, self.tables.head, out=a[2:])
        self.a[:], self.b[:] = a[c + 1], a[c] << 5
        places = a[1:-1] * 40503
        places += a[:-2] << 5
        places &= (1 << BITS2) - 1
        places += self.base2
        held, guess = np.minimum(x, 65535).astype(np.uint16), np.empty(x.shape, np.uint16)
        for i in range(c):
            self.t2.take(places[i], out=guess[i], mode="clip")
            self.t2[places[i]] = held[i]
        same = guess == x
        rest = none & ~same
        m2, m1 = np.empty(x.shape, np.int32), np.empty(x.shape, np.int32)
        w1, w2, less = self.w1, self.w2, np.empty(self.lanes, np.int32)
        gain, loss = same * np.int32(GAIN2), rest * np.int32(LOSS1)
        for i in range(c):
            m2[i], m1[i] = w2, w1
            np.subtract(w2, LEAST, out=less)
            less >>= RATE
            w2 -= less
            w2 += gain[i]
            np.subtract(MOST1, w1, out=less)
            less >>= RATE
            w1 += less
            w1 -= loss[i]
        m1 >>= 13
        m1 += self.half1.take(a[1:-1])
        np.maximum(m1, 0, out=m1)
        q = (TOTAL - m2) >> 12
        q *= m1
        q >>= 12
        return same, rest, m2, q

    def update(self, n: int, x: np.ndarray, hit2: np.ndarray, rest: np.ndarray) -> None:
        """``hit2``: where order 2 was right, ``rest``: where neither was."""
        self.t2[self.i2] = np.minimum(x, 65535)
        w1, w2 = self.w1[:n], self.w2[:n]
        w2 -= (w2 - LEAST) >> RATE  # both stay between their limits
        w2[hit2] += GAIN2
        w1 += (MOST1 - w1) >> RATE
        w1[rest] -= LOSS1
        a = self.a[:n]
        np.left_shift(a, 5, out=self.b[:n])
        np.minimum(x, self.tables.head, out=a, casting="unsafe")

class _Writer:
    """The coders of some blocks."""

    def __init__(self, lanes: int, width: int):
        self.lanes, self.width = lanes, width
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U)
        self.flat = np.zeros(lanes * width, np.uint64)
        self.pos = np.ones(lanes, np.int64) + np.arange(lanes) * width  # word 0 takes no carry and is dropped

    def room(self, steps: int) -> None:
        """Make room for that many steps."""
        lanes, width = self.lanes, self.width
        used = int((self.pos - np.arange(lanes) * width).max())
        if used + steps + 4 > width:
            wide = max(2 * width, used + steps + 4)
            flat = np.zeros((lanes, wide), np.uint64)
            flat[:, :width] = self.flat.reshape(lanes, width)
            self.pos += np.arange(lanes) * (wide - width)
            self.flat, self.width = flat.reshape(-1), wide

    def step(self, start: np.ndarray, part: np.ndarray) -> None:
        """Parts start..start+part-1 of TOTAL (unsigned 64-bit) in the first blocks."""
        low, rng = self.low[: len(start)], self.range[: len(start)]
        rng >>= U(24)
        add = rng * start
        low += add
        carry = (low < add).nonzero()[0]
        if len(carry):
            self.flat[self.pos[carry] - 1] += U(1)
        rng *= part
        out = (rng < U(1 << 32)).nonzero()[0]
        if len(out):
            pos, moved = self.pos.take(out), low.take(out)
            self.flat[pos] = moved >> U(32)
            self.pos[out] = pos + 1
            low[out] = moved << U(32)
            rng[out] = rng.take(out) << U(32)

    def put(self, at: np.ndarray, start: np.ndarray, part: np.ndarray) -> None:
        """Parts start..start+part-1 of TOTAL in the blocks ``at`` (distinct places)."""
        low, rng, pos = self.low[at], self.range[at], self.pos[at]
        unit = rng >> U(24)
        add = unit * start.astype(U)
        low = low + add
        carry = np.flatnonzero(low < add)
        if len(carry):
            self.flat[pos[carry] - 1] += U(1)
        rng = unit * part.astype(U)
        out = np.flatnonzero(rng < U(1 << 32))
        if len(out):
            self.flat[pos[out]] = low[out] >> U(32)
            pos[out] += 1
            low[out] <<= U(32)
            rng[out] <<= U(32)
            self.pos[at] = pos
        self.low[at], self.range[at] = low, rng

    def ended(self) -> list[bytes]:
        """Each block's words."""
        for _ in range(2):
            self.flat[self.pos] = self.low >> U(32)
            self.pos += 1
            self.low <<= U(32)
        words = self.flat.reshape(self.lanes, self.width)
        used = self.pos - np.arange(self.lanes) * self.width
        for j in range(int(used.max()) - 1, 0, -1):
            words[:, j - 1] += words[:, j] >> U(32)
            words[:, j] &= U(0xFFFFFFFF)
        return [words[i, 1 : used[i]].astype("<u4").tobytes() for i in range(self.lanes)]


def _rows(x: np.ndarray, lanes: int) -> np.ndarray:
    """One block a row.  A row is a little longer, as columns of rows a power of two apart share their place in caches."""
    rows = np.zeros((lanes, BLOCK + 16), x.dtype)[:, :BLOCK]
    full = len(x) // BLOCK
    rows[:full] = x[: full * BLOCK].reshape(full, BLOCK)
    if full < lanes:
        rows[full, : len(x) - full * BLOCK] = x[full * BLOCK :]
    return rows


def _encode_blocks(ranks: np.ndarray, places: np.ndarray, tables: _Tables) -> list[bytes]:
    """The words of the blocks of some ids; ``places`` are those of their pairs in order 1, -1 for none."""
    n = len(ranks)
    lanes = -(-n // BLOCK)
    last = n - (lanes - 1) * BLOCK
    steps = BLOCK if lanes > 1 else last
    grid, places = _rows(ranks, lanes), _rows(places, lanes)
    packed = tables.packed()
    model, out = _Model(lanes, tables), _Writer(lanes, steps // 3 + 64)
    lane = np.tile(np.arange(lanes, dtype=np.int32), ROWS)
    for t in range(0, steps, ROWS):
        if t % EPOCH == 0:
            out.room(2 * EPOCH)
            if t:
                model.settle(t, grid[:, t - EPOCH : t].T)
        # of a block that has ended, the last, nothing is put from here on
        x = np.ascontiguousarray(grid[:, t : min(t + ROWS, steps)].T)
        held = packed.take(np.ascontiguousarray(places[:, t : t + len(x)].T))
        none = held == 0
        same, rest, m2, q = model.known(x, none)
        part = q * (held & 0xFFFF).astype(np.int32)
        held >>= 16
        start = q * (held & 0xFFFF).astype(np.int32)
        start += m2
        start[same] = 0
        np.copyto(part, m2, where=same)
        start, part = start.reshape(-1).astype(U), part.reshape(-1).astype(U)
        at = np.flatnonzero(rest)
        symbols, whose = x.reshape(-1).take(at), lane.take(at)
        over = (m2 + (q << PARTS1)).reshape(-1).take(at)
        kinds = model.classes(symbols)
        i = kinds + whose.astype(np.int64) * (model.n + 1)
        m0, low = (TOTAL - over) >> PARTS0, model.cum0.take(i)
        i += 1
        part[at] = (model.cum0.take(i) - low) * m0
        low -= model.offset.take(whose)
        low *= m0
        start[at] = over + low
        far = np.flatnonzero(kinds > HEAD0)
        if t + len(x) > last:
            far = far[(at[far] // lanes < last - t) | (whose[far] < lanes - 1)]
        # the bits below the power of two, in two steps of 16 at most
        bits = kinds[far] - HEAD0
        value = symbols[far].astype(np.int64) - HEAD0 + 1 - (np.int64(1) << bits)
        low = np.minimum(bits, 16)
        below = [(low, value & ((np.int64(1) << low) - 1))]
        if len(far) and int(bits.max()) > 16:
            below.insert(0, (bits - low, value >> low))
        below = [(shown << (24 - few), np.int64(1) << (24 - few)) for few, shown in below]
        where, ends = whose[far], np.searchsorted(at[far], np.arange(len(x) + 1) * lanes)
        for r in range(len(x)):
            k = lanes if t + r < last else lanes - 1
            out.step(start[r * lanes : r * lanes + k], part[r * lanes : r * lanes + k])
            some = slice(ends[r], ends[r + 1])
            if some.start < some.stop:
                for shown, few in below:
                    out.put(where[some], shown[some], few[some])
    return out.ended()


def encode(ids: np.ndarray) -> bytes:
    """A segment that holds ``ids`` (unsigned 32-bit)."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    n = len(ids)
    if not n:
        return MAGIC + struct.pack("<IIIII", 0, 0, 0, 0, 0)
    tables, ranks, places = _Tables.of(ids)
    body = []
    for at in range(0, n, LANES * BLOCK):
        body += _encode_blocks(ranks[at : at + LANES * BLOCK], places[at : at + LANES * BLOCK], tables)
    heads = np.empty((len(body), 2), "<u4")
    raw = memoryview(ids).cast("B")
    heads[:, 0] = [len(b) // 4 for b in body]
    heads[:, 1] = [zlib.crc32(raw[i * 4 * BLOCK : (i + 1) * 4 * BLOCK]) for i in range(len(body))]
    stored = tables.stored()
    sizes = struct.pack("<IIIII", n, len(tables.names), len(body), len(stored), zlib.crc32(stored))
    return b"".join((MAGIC, sizes, stored, heads.tobytes(), *body))


def _decode_blocks(words: np.ndarray, used: np.ndarray, n: int, tables: _Tables, slots: np.ndarray, slot_of: np.ndarray) -> np.ndarray:
    """The ranks of some blocks: ``used`` words each, ``n`` ids together."""
    lanes = len(used)
    last = n - (lanes - 1) * BLOCK
    steps = BLOCK if lanes > 1 else last
    words = np.concatenate([words, np.zeros(4, "<u4")]).astype(U)
    pos = np.cumsum(used) - used
    code = (words[pos] << U(32)) | words[pos + 1]
    pos += 2
    top = len(words) - 1
    rng = np.full(lanes, (1 << 64) - 1, U)
    grid = np.zeros((steps, lanes), np.int32)
    model = _Model(lanes, tables)
    packed = tables.packed()

    def moved(at, now, r) -> None:
        """Words go into those of the blocks ``at`` (None: the first) whose ranges are small."""
        more = (r < U(1 << 32)).nonzero()[0]
        if len(more):
            whose = more if at is None else at[more]
            p = pos.take(whose)
            now[more] = (now.take(more) << U(32)) | words.take(np.minimum(p, top))
            r[more] = r.take(more) << U(32)
            pos[whose] = p + 1

    def take(k, unit, start, part) -> None:
        """What ``start`` and ``part`` say of the first k blocks is taken off."""
        now, r = code[:k], rng[:k]
        now -= unit * start.astype(U)
        np.multiply(unit, part.astype(U), out=r)
        moved(None, now, r)

    def take_at(at, unit, start, part) -> None:
        now, r = code.take(at) - unit * start.astype(U), unit * part.astype(U)
        moved(at, now, r)
        code[at], rng[at] = now, r

    def shown(code, rng):
        unit = rng >> U(24)
        return unit, np.minimum(code // unit, U(TOTAL - 1)).astype(np.int64)

    for t in range(steps):
        k = lanes if t < last else lanes - 1
        if t and t % EPOCH == 0:
            model.settle(t, grid[t - EPOCH : t])
        s2, m2, q, past = model.predict(k)
        unit, value = shown(code[:k], rng[:k])
        part1 = ((value - m2) / np.maximum(q, 1)).astype(np.int64)  # exact: both are small
        np.maximum(part1, 0, out=part1)
        np.minimum(part1, (1 << PARTS1) - 1, out=part1)
        part1 += slot_of.take(model.a[:k])
        held = packed.take(slots.take(part1))
        x, part = (held >> 32).astype(np.int32), q * (held & 0xFFFF)
        held >>= 16
        held &= 0xFFFF
        start = np.multiply(q, held, out=held)
        start += m2
        hit2 = (value < m2).nonzero()[0]
        x[hit2], start[hit2], part[hit2] = s2.take(hit2), 0, m2.take(hit2)
        rest = (value >= past).nonzero()[0]
        if len(rest):
            over, offset, base = past.take(rest), model.offset.take(rest), rest * (model.n + 1)
            m0 = (TOTAL - over) >> PARTS0
            v = ((value.take(rest) - over) / m0).astype(np.int32)  # exact: both are small
            i = model.cum0.searchsorted(v + offset, side="right") - 1
            i = np.minimum(np.maximum(i, base), base + model.n - 1)
            kinds, low = i - base, model.cum0.take(i)
            start[rest] = over + (low - offset) * m0
            i += 1
            part[rest] = (model.cum0.take(i) - low) * m0
            x[rest] = np.minimum(kinds, HEAD0)
        take(k, unit, start, part)
        if len(rest) and int(kinds.max()) > HEAD0:
            far = np.flatnonzero(kinds > HEAD0)
            where, bits = rest[far], kinds[far] - HEAD0
            value = np.int64(1) << bits
            low = np.minimum(bits, 16)
            for few, shift in ((bits - low, low), (low, 0)) if int(bits.max()) > 16 else ((low, 0),):
                unit, v = shown(code.take(where), rng.take(where))
                v >>= 24 - few
                take_at(where, unit, v << (24 - few), np.int64(1) << (24 - few))
                value += v << shift
            x[where] = np.minimum(value + HEAD0 - 1, len(tables.names) - 1)
        grid[t, :k] = x
        model.update(k, x, hit2, rest)
    return grid.T.reshape(-1)[:n]


def decode(segment: bytes) -> np.ndarray:
    """The ids of a segment; ``CorruptSegment`` where a block's checksum, or the layout, does not hold."""
    if segment[:4] != MAGIC or len(segment) < 24:
        raise CorruptSegment("not a segment")
    n, kinds, lanes, stored, crc = struct.unpack_from("<IIIII", segment, 4)
    if not n:
        return np.zeros(0, "<u4")
    at = 24 + stored + 8 * lanes
    if len(segment) < at or lanes != -(-n // BLOCK) or zlib.crc32(segment[24 : 24 + stored]) != crc:
        raise CorruptSegment("cut short")
    tables = _Tables.read(segment[24 : 24 + stored], kinds)
    heads = np.frombuffer(segment, "<u4", 2 * lanes, 24 + stored).reshape(lanes, 2)
    used = heads[:, 0].astype(np.int64)
    if len(segment) != at + 4 * int(used.sum()):
        raise CorruptSegment("cut short")
    words = np.frombuffer(segment, "<u4", offset=at)
    # the pair of each part of order 1, row by row; ids without successors share a row
    sums = np.bincount(np.repeat(np.arange(tables.head), tables.sizes), tables.frequencies, minlength=tables.head).astype(np.int64)
    full = np.flatnonzero(tables.sizes)
    slot_of = np.zeros(tables.head + 1, np.int64)
    slot_of[full] = (np.arange(len(full)) + 1) << PARTS1
    slots = np.zeros((len(full) + 1) << PARTS1, np.int32)
    widths = tables.frequencies.copy()
    if len(full):
        widths[tables.first[1:][full] - 1] += (1 << PARTS1) - sums[full]  # parts that no pair has
        slots[1 << PARTS1 :] = np.repeat(np.arange(len(widths), dtype=np.int32), widths)
    ids, first = [], 0
    for lane in range(0, lanes, LANES):
        some = used[lane : lane + LANES]
        size = min(n - lane * BLOCK, LANES * BLOCK)
        ids.append(tables.names[_decode_blocks(words[first : first + int(some.sum())], some, size, tables, slots, slot_of)])
        first += int(some.sum())
    ids = np.concatenate(ids).astype("<u4")
    raw = memoryview(ids).cast("B")
    for i in range(lanes):
        if zlib.crc32(raw[i * 4 * BLOCK : (i + 1) * 4 * BLOCK]) != heads[i, 1]:
            raise CorruptSegment(f"block {i} fails its checksum")
    return ids
