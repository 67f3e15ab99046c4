"""Models of module content: headers, patterns, samples, and the widths of compressed samples.

Each model is one walk over its symbols with a ``SymbolCoder``, used to encode, to decode and to account.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

import numpy as np

from strandflow.functions.bits import LsbReader, LsbWriter
from strandflow.operators.context import SymbolCoder, composite
from strandflow.sources import tracker

#: Field widths of a cell: sample, period, effect, parameter.
CELL = (("sample", 8), ("period", 12), ("effect", 4), ("param", 8))
ROWS = tracker.ROWS


def split_cell(raw: bytes) -> tuple[int, int, int, int]:
    a, b, c, d = raw
    return a & 0xF0 | c >> 4, (a & 15) << 8 | b, c & 15, d


def join_cell(sample: int, period: int, effect: int, param: int) -> bytes:
    return bytes([sample & 0xF0 | period >> 8, period & 255, (sample & 15) << 4 | effect, param])


def mod_patterns(coder: SymbolCoder, cells: bytes | None, n: int, channels: int) -> bytes:
    """``n`` cells in rows of ``channels``.

    A cell is told to repeat the one above, or its fields are coded: in contexts of the cells above, two and four
    rows above, to the left and at the same place of the pattern before, and of the channel's last note,
    sample and effect parameter.
    """
    out: list[tuple[int, int, int, int]] = []
    none = (0, 0, 0, 0)
    last_note, last_sample = [0] * channels, [0] * channels
    last_param: dict[tuple[int, int], int] = {}

    def back(i: int, n: int) -> tuple[int, int, int, int]:
        return out[i - n] if i >= n else none

    for i in range(n):
        row, ch = divmod(i, channels)
        above, two, four, left, before = (back(i, k) for k in (channels, 2 * channels, 4 * channels, 1, ROWS * channels))
        cell = None if cells is None else split_cell(cells[4 * i : 4 * i + 4])
        place = row % 16
        near = (composite(1, *above), composite(2, *before, ch), composite(3, *two, *four), composite(4, *left, place))
        same = coder.symbol("repeat", None if cell is None else int(cell == above), 1, [*near, composite(5, ch, place), composite(6, *above, *before)], [min(ch, 31)])
        if same:
            got = above
        else:
            fields: list[int] = []
            for k, (name, width) in enumerate(CELL):
                done = composite(k, *fields)
                own = (last_sample[ch], last_note[ch], 0, last_param.get((ch, fields[2]), 0) if k == 3 else 0)[k]
                contexts = [composite(done, own, ch), composite(done, above[k], two[k]), composite(done, before[k], ch), composite(done, left[k], place), composite(done, four[k], own), done]
                fields.append(coder.symbol(name, None if cell is None else cell[k], width, contexts, [min(ch, 31)]))
            got = (fields[0], fields[1], fields[2], fields[3])
        out.append(got)
        if got[1]:
            last_note[ch] = got[1]
        if got[0]:
            last_sample[ch] = got[0]
        if got[3]:
            last_param[ch, got[2]] = got[3]
    return b"".join(join_cell(*c) for c in out)


def pattern_coder(data: bytes | None = None) -> SymbolCoder:
    return SymbolCoder(6, [32], data)


def code_patterns(cells: bytes, channels: int) -> bytes:
    coder = pattern_coder()
    mod_patterns(coder, cells, len(cells) // 4, channels)
    return coder.finish()


def decode_patterns(data: bytes, n: int, channels: int) -> bytes:
    return mod_patterns(pattern_coder(data), None, n, channels)


def events(coder: SymbolCoder, rows: Sequence[tuple] | None, n: int) -> list[tuple]:
    """``n`` pattern events (row, channel, fields: bytes or None, as ``unpack_it``, ``unpack_s3m`` and ``unpack_xm`` give them).

    Rows and channels are coded as steps; which fields there are, as a mask in the contexts of the channel's
    last and the event before; fields in those of the channel's last values of them.
    """
    width = coder.symbol("fields", None if rows is None else (len(rows[0]) - 2 if n else 0), 4, [0, 1, 2, 3])
    out: list[tuple] = []
    last: dict[int, list[int]] = {}
    masks: dict[int, int] = {}
    row = channel = previous = 0
    for i in range(n):
        event = None if rows is None else rows[i]
        step = coder.number("row", None if event is None else event[0] - row, [previous, composite(row % 16), composite(channel), 7])
        row += step
        contexts = [composite(channel, step), composite(step, row % 16), composite(previous), composite(row % 4, channel)]
        channel = coder.symbol("channel", None if event is None else event[1], 7, contexts)
        own, held = last.setdefault(channel, [0] * width), masks.get(channel, 0)
        mask = None if event is None else sum((x is not None) << k for k, x in enumerate(event[2:]))
        mask = coder.symbol("mask", mask, width, [composite(held, channel), composite(previous, held), composite(row % 16, channel), composite(*own)])
        fields: list[int | None] = []
        for k in range(width):
            if mask >> k & 1:
                before = fields[k - 1] if k else 0
                contexts = [composite(k, own[k], channel), composite(k, own[k], before or 0), composite(k, row % 16, channel), composite(k, mask, before or 0)]
                own[k] = coder.symbol(f"field{k}", None if event is None else event[2 + k], 8, contexts)
                fields.append(own[k])
            else:
                fields.append(None)
        masks[channel] = previous = mask
        out.append((row, channel, *fields))
    return out


def pack_events(rows: Sequence[tuple]) -> bytes:
    """Events as the JVM's model takes them: the number of fields, then each row, channel and its fields, -1 for none."""
    out = [len(rows[0]) - 2 if rows else 0]
    for row in rows:
        out += [-1 if x is None else x for x in row]
    return np.array(out, "<i4").tobytes()


def event_coder(data: bytes | None = None) -> SymbolCoder:
    return SymbolCoder(4, [], data)


def records(coder: SymbolCoder, data: bytes | None, count: int, size: int) -> bytes:
    """``count`` records of ``size`` bytes (headers of samples, instruments, songs): a byte in the contexts of its place, of the
    same place in the record before and of the bytes before it in its own."""
    out = bytearray()
    for i in range(count * size):
        at = i % size
        up = out[i - size] if i >= size else 0
        a, b = (out[i - k] if i >= k else 0 for k in (1, 2))
        above = out[i - size + 1] if i >= size and at + 1 < size else 0
        contexts = [composite(at, up), composite(at, a), composite(a, b, up), composite(up, above, a), composite(at), composite(1, a, b)]
        out.append(coder.symbol("record", None if data is None else data[i], 8, contexts, [min(at, 255)]))
    return bytes(out)


def record_coder(data: bytes | None = None) -> SymbolCoder:
    return SymbolCoder(6, [256], data)


#: What the other channel's last step counts at first, in 1/4096: steps of one would take thousands of samples to learn as much.
CROSS = 2048


class SignLms:
    """A predictor whose weights move by the signs of inputs and of the error: whole numbers throughout."""

    def __init__(self, taps: int, shift: int, start: int = 0) -> None:
        self.w, self.past, self.signs = np.zeros(taps, np.int64), np.zeros(taps, np.int64), np.zeros(taps, np.int64)
        self.w[-1:] = start
        self.shift = shift

    def predict(self) -> int:
        return int(self.w @ self.past) >> self.shift

    def update(self, value: int, error: int) -> None:
        if error:
            self.w += self.signs if error > 0 else -self.signs
        self.past[:-1], self.past[-1] = self.past[1:], value
        self.signs[:-1], self.signs[-1] = self.signs[1:], (value > 0) - (value < 0)


def samples(coder: SymbolCoder, values: Sequence[int] | None, n: int, bits: int = 8, reference: Sequence[int] | None = None) -> list[int]:
    """``n`` samples: the last value, then a cascade of sign-LMS predictors over what each leaves, then the residual.

    ``reference``: another channel's samples, of which the one at the same time and those before join the first
    stage. Residuals are coded in the contexts of how large those before were, at two speeds.
    """
    half = 1 << bits - 1
    cascade = [SignLms(32, 12), SignLms(16, 11), SignLms(8, 10)]
    cross = SignLms(4, 12, CROSS) if reference is not None else None
    out: list[int] = []
    fast = slow = last = 0
    for i in range(n):
        base = last
        if cross is not None:
            cross.past[:-1], cross.past[-1] = cross.past[1:], reference[i] - (reference[i - 1] if i else 0)
            np.sign(cross.past, out=cross.signs)
            base += cross.predict()
        steps, guess = [], base
        for stage in cascade:
            p = stage.predict()
            steps.append(p)
            guess += p
        guess = min(half - 1, max(-half, guess))
        residual = None if values is None else values[i] - guess
        contexts = [composite(1, fast.bit_length()), composite(2, slow.bit_length()), composite(3, (fast + slow).bit_length(), guess >> bits - 4), composite(4, fast >> 2)]
        residual = coder.number("residual", residual, contexts, [min(31, fast.bit_length())])
        value = guess + residual
        left = value - base
        if cross is not None and left:
            cross.w += cross.signs if left > 0 else -cross.signs
        for stage, p in zip(cascade, steps, strict=True):
            stage.update(left, left - p)
            left -= p
        size = abs(residual) << 4
        fast += (size - fast) >> 2
        slow += (size - slow) >> 5
        out.append(value)
        last = value
    return out


def sample_coder(data: bytes | None = None) -> SymbolCoder:
    return SymbolCoder(4, [32], data, bits=12)


def code_samples(values: Sequence[int], bits: int = 8, reference: Sequence[int] | None = None) -> bytes:
    coder = sample_coder()
    samples(coder, values, len(values), bits, reference)
    return coder.finish()


def decode_samples(data: bytes, n: int, bits: int = 8, reference: Sequence[int] | None = None) -> list[int]:
    return samples(sample_coder(data), None, n, bits, reference)


# Widths of compressed samples: which of three encoders' habits gives a block's width changes again.


def least_width(d: int, wide: bool) -> int:
    """The fewest bits that hold a difference beside the codes that change the width."""
    bits, spare = (16, 8) if wide else (8, 4)
    for width in range(1, bits + 1):
        half = 1 << width - 1
        if (-half < d < half) if width <= 6 else (-half + spare <= d < half - spare):
            return width
    return bits + 1


def change_cost(width: int, wide: bool) -> int:
    """Bits that a change of the width takes at this width."""
    return width + ((4 if wide else 3) if width <= 6 else 0)


def _runs(widths: list[int], level: int) -> list[tuple[int, int]]:
    out, at = [], 0
    for same, group in groupby(widths, lambda w: w == level):
        n = len(list(group))
        if same:
            out.append((at, at + n))
        at += n
    return out


def short_run_widths(least: list[int], wide: bool) -> list[int]:
    """Runs of a width give way to a neighbour's where they are single, or shorter than a bound and no dearer than the changes."""
    full, bound, low = (17, 33, 4) if wide else (9, 17, 3)
    w = list(least)
    for level in range(1, full):
        for start, end in _runs(w, level):
            if end == len(w) or end - start > bound:
                continue
            before, after = w[start - 1] if start else full, w[end]
            small, large = min(before, after), max(before, after)
            to, other = (small, large) if small > level else (0, 0) if large < level else (large, small)
            cost = to + (low if to <= 5 else 0) + (low if other <= 5 else 0)
            if to and (end - start == 1 or (end - start <= cost and (end - start) * (to - level) <= cost)):
                w[start:end] = [to] * (end - start)
    return w


def saving_widths(least: list[int], wide: bool) -> list[int]:
    """Runs of a width give way to a larger neighbour's where the bits that this adds are fewer than the changes save."""
    full = 17 if wide else 9
    w = list(least)
    for level in range(1, full):
        for start, end in _runs(w, level):
            before, after = w[start - 1] if start else full, w[end] if end < len(w) else 0
            around = [x for x in (before, after) if x > level]
            if not around:
                continue
            to = min(around)
            saved = (change_cost(level, wide) if after else 0) + (change_cost(before, wide) if before == to else 0)
            saved -= change_cost(to, wide) if after and after != to else 0
            if (end - start) * (to - level) < saved:
                w[start:end] = [to] * (end - start)
    return w


def nested_widths(least: list[int], wide: bool) -> list[int]:
    """From the full width down: a stretch that a smaller width holds takes it if its bits with the changes are no more."""
    full = 17 if wide else 9
    out = [0] * len(least)

    def step(width: int) -> int:
        table = (4, 5, 6, 7, 8, 9, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17)  # fixed values: what that encoder counts for a change
        return table[width - 1] + (width <= 6 and wide)

    work = [(full, full, full, full - 1, 0, len(least))]
    while work:
        width, before, after, smaller, start, end = work.pop()
        if smaller < 1:
            out[start:end] = [width] * (end - start)
            continue
        at = start
        while at < end:
            if least[at] > smaller:
                out[at] = width
                at += 1
                continue
            first = at
            while at < end and least[at] <= smaller:
                at += 1
            n = at - first
            left, right = before if first == start else width, after if at == end else width
            take, stay = step(left) + smaller * n, step(left) + width * n
            if left == width:
                stay -= step(left)
            if at < len(least):
                take, stay = take + step(smaller), stay + step(width)
                if right == width:
                    stay -= step(width)
            work.append((smaller if take <= stay else width, left, right, smaller - 1, first, at))
    return out


POLICIES = (short_run_widths, saving_widths, nested_widths)


def differences(block: Sequence[int], wide: bool, twice: bool) -> list[int]:
    """What a block's samples are stored as."""
    half = 1 << (15 if wide else 7)
    out, x0, d0 = [], 0, 0
    for x in block:
        d = (x - x0 + half) % (2 * half) - half
        out.append((d - d0 + half) % (2 * half) - half if twice else d)
        x0, d0 = x, d
    return out


def write_block(block: Sequence[int], widths: list[int], wide: bool, twice: bool) -> bytes:
    """A compressed block with the given width for each value."""
    bits, low = (16, 4) if wide else (8, 3)
    w, now = LsbWriter(), bits + 1
    for d, width in zip(differences(block, wide, twice), widths, strict=True):
        if width != now:
            code = width if width < now else width - 1  # a width doesn't change to itself
            if now <= 6:
                w.write(1 << now - 1, now).write(code - 1, low)
            elif now <= bits:
                w.write((((1 << bits) - 1) >> (bits + 1 - now)) - bits // 2 + code, now)
            else:
                w.write(1 << bits | width - 1, now)
            now = width
        w.write(d % (1 << min(now, bits)), now)
    raw = w.bytes()
    return len(raw).to_bytes(2, "little") + raw


def read_widths(data: bytes, at: int, n: int, wide: bool) -> tuple[list[int], list[int], int]:
    """(values, their widths, where the block ends) of a compressed block of ``n`` values."""
    bits, low = (16, 4) if wide else (8, 3)
    size = int.from_bytes(data[at : at + 2], "little")
    r, width = LsbReader(data[at + 2 : at + 2 + size]), bits + 1
    values, widths = [], []
    while len(values) < n:
        v = r.read(width)
        least = (((1 << bits) - 1) >> (bits + 1 - width)) - bits // 2 if 7 <= width <= bits else 0
        if width < 7 and v == 1 << width - 1:
            new = r.read(low) + 1
        elif 7 <= width <= bits and 0 < v - least <= bits:
            new = v - least
        elif width == bits + 1 and v >> bits:
            width = (v & 255) + 1
            continue
        else:
            values.append(v - (1 << width) if width <= bits and v >> width - 1 else v)
            widths.append(width)
            continue
        width = new if new < width else new + 1
    return values, widths, at + 2 + size


def policy_votes(data: bytes, n: int, wide: bool) -> tuple[int | None, list[int], list[list[int]]]:
    """(the policy that gives most blocks' widths again, its votes and the others', the blocks' widths); None if none gives any."""
    block, bits = (0x4000, 16) if wide else (0x8000, 8)
    votes, found, at = [0] * len(POLICIES), [], 0
    for start in range(0, n, block):
        values, widths, at = read_widths(data, at, min(block, n - start), wide)
        half = 1 << bits - 1
        least = [least_width((v + half) % (2 * half) - half, wide) for v in values]
        for k, policy in enumerate(POLICIES):
            votes[k] += policy(least, wide) == widths
        found.append(widths)
    best = max(range(len(POLICIES)), key=lambda k: (votes[k], -k))
    return (best if votes[best] else None), votes, found


def canonical(data: bytes, n: int, wide: bool, twice: bool) -> tuple[int | None, dict[int, list[int]]]:
    """(policy, {block: widths}) that with the samples give compressed data again; only blocks that the policy doesn't give carry widths."""
    policy, _, found = policy_votes(data, n, wide)
    values = tracker.decompress(data, 0, n, wide, twice)
    block = 0x4000 if wide else 0x8000
    odd = {}
    for k, widths in enumerate(found):
        least = [least_width(d, wide) for d in differences(values[k * block : (k + 1) * block], wide, twice)]
        if policy is None or POLICIES[policy](least, wide) != widths:
            odd[k] = widths
    return policy, odd


def recompress(values: Sequence[int], wide: bool, twice: bool, policy: int | None, odd: dict[int, list[int]] | None = None) -> bytes:
    """Compressed data from samples: blocks by the policy's widths, or by those given."""
    block, out = (0x4000 if wide else 0x8000), b""
    for k, start in enumerate(range(0, len(values), block)):
        part = values[start : start + block]
        least = [least_width(d, wide) for d in differences(part, wide, twice)]
        widths = odd[k] if odd and k in odd else POLICIES[policy or 0](least, wide)
        out += write_block(part, widths, wide, twice)
    return out
