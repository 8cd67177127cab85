"""Blocks of pcapng captures.

A section header block says the byte order of what follows and forgets the interfaces
before; interface blocks number the links and say what their time stamps count; packet
blocks name an interface. A range of a file needs the section and interface blocks before
it: `follow` hands out those it meets, `State` takes them in.
"""

import numpy as np

SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET = 0x0A0D0D0A, 1, 2, 3, 6
# Other block types of the public format description: name resolution, statistics, journal
# export, decryption secrets, custom blocks.
OTHERS = (4, 5, 9, 10, 0x0BAD, 0x40000BAD)
KNOWN = (SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET, *OTHERS)
BYTE_ORDER = 0x1A2B3C4D
MAX_BLOCK = 1 << 24
MAX_RECORD = 1 << 18
READ_BYTES = 4 << 20
RUN = 16


class State:
    """Byte order and interfaces at a place of a file."""

    def __init__(self, blocks=()):
        self.order, self.interfaces = "little", []
        for block in blocks:
            self.take(block)

    def take(self, block):
        """A section or interface block, whole."""
        if block[:4] == b"\x0a\x0d\x0d\x0a":
            self.order = "little" if int.from_bytes(block[8:12], "little") == BYTE_ORDER else "big"
            self.interfaces = []
            return
        number = lambda a, b: int.from_bytes(block[a:b], self.order)
        link, at, per_second, shift = number(8, 10), 16, 1_000_000, 0
        while at + 4 <= len(block) - 4:
            code, length = number(at, at + 2), number(at + 2, at + 4)
            if code == 0:
                break
            value = block[at + 4 : at + 4 + length]
            if code == 9 and value:
                per_second = 2 ** (value[0] & 127) if value[0] & 128 else 10 ** value[0]
            if code == 14 and length == 8:
                shift = int.from_bytes(value, self.order, signed=True)
            at += 4 + length + -length % 4
        self.interfaces.append((link, per_second, shift))

    def micros(self, interface, ticks):
        _, per_second, shift = self.interfaces[interface]
        return shift * 1_000_000 + ticks * 1_000_000 // per_second


def order_at(head):
    """The byte order in which the 12 bytes at a block's begin make sense; None if in neither."""
    if head[:4] == b"\x0a\x0d\x0d\x0a":
        orders = {BYTE_ORDER.to_bytes(4, o): o for o in ("little", "big")}
        return orders.get(head[8:12])
    for order in ("little", "big"):
        kind, length = (int.from_bytes(head[i : i + 4], order) for i in (0, 4))
        if kind in KNOWN and 12 <= length <= MAX_BLOCK and length % 4 == 0:
            return order
    return None


def follow(source, start, end, size, state, met):
    """Follow the blocks from `start`. Yields (bytes, their offset, packets as (frame, bytes
    kept, microseconds, link)) until a block begins at or after `end`, then the offset of that
    block. Section and interface blocks go to `state` and, as they are, to the list `met`."""
    at, want = start, READ_BYTES
    while at < end and at + 12 <= size:
        source.seek(at)
        data = source.read(min(want, size - at))
        ended = len(data) < min(want, size - at)  # of an unzipped file
        place, found = 0, []
        while at + place < end and place + 12 <= len(data):
            order = order_at(data[place : place + 12]) if place == 0 and at == start else state.order
            if data[place : place + 4] == b"\x0a\x0d\x0d\x0a":
                order = order_at(data[place : place + 12])
            kind, length = (int.from_bytes(data[place + i : place + i + 4], order or "little") for i in (0, 4))
            if order is None or not 12 <= length <= MAX_BLOCK or length % 4:
                raise ValueError(f"no capture block at offset {at + place}")
            state.order = order
            if place + length > len(data):
                if at + len(data) < size and not ended:
                    break
                length = len(data) - place  # the file ends inside the block
            block = data[place : place + length]
            if kind in (SECTION, INTERFACE) and length >= 20:
                state.take(block)
                met.append(block)
            elif kind in (PACKET, OLD_PACKET, SIMPLE_PACKET) and length >= 16:
                found.append(_packet(state, kind, block, place, at))
            place += length
        if not place and ended:
            break
        if not place:
            want *= 2  # one block larger than the read
            continue
        yield data, at, [f for f in found if f]
        at += place
    yield None, max(at, start), None


def _packet(state, kind, block, place, at):
    number = lambda a, b: int.from_bytes(block[a:b], state.order)
    if kind == SIMPLE_PACKET:
        interface, ticks, begin = 0, 0, 12
        kept = min(number(8, 12), len(block) - 16)
    elif len(block) < 28:
        return None
    else:
        interface = number(8, 12) if kind == PACKET else number(8, 10)
        ticks, begin = (number(12, 16) << 32) + number(16, 20), 28
        kept = min(number(20, 24), max(0, len(block) - 28))
    if kept > MAX_RECORD:
        raise ValueError(f"capture record of {kept} bytes at offset {at + place}")
    if interface >= len(state.interfaces):
        # A range that was entered in the middle; it is decoded once its interfaces are known.
        return place + begin, kept, 0, -1
    return place + begin, kept, state.micros(interface, ticks), state.interfaces[interface][0]


def guess(source, start, end, size):
    """The first offset in [start, end) that begins a run of plausible blocks. Blocks begin at
    multiples of four, and say their length at both ends."""
    for base in range(start + -start % 4, end, READ_BYTES):
        source.seek(base)
        data = source.read(min(READ_BYTES + MAX_BLOCK, size - base))
        words = len(data) // 4
        raw = {o: np.frombuffer(data, f"{c}u4", words).astype(np.int64) for o, c in (("little", "<"), ("big", ">"))}
        candidates = []
        for order, values in raw.items():
            kinds, lengths = values[:-1], values[1:]
            good = np.isin(kinds, KNOWN) & (lengths >= 12) & (lengths <= MAX_BLOCK) & (lengths % 4 == 0)
            good[min(READ_BYTES, end - base) // 4 + 1 :] = False
            candidates += [(int(p) * 4, order) for p in np.flatnonzero(good)]
        for place, order in sorted(candidates):
            at, run = place, 0
            while run < RUN and at + 12 <= len(data):
                here = order_at(data[at : at + 12]) if data[at : at + 4] == b"\x0a\x0d\x0d\x0a" else order
                length = int.from_bytes(data[at + 4 : at + 8], here or order)
                last = data[at + length - 4 : at + length]
                whole = 12 <= length <= MAX_BLOCK and length % 4 == 0
                if not whole or (len(last) == 4 and last != data[at + 4 : at + 8]):
                    break
                order, at, run = here or order, at + length, run + 1
            if base + place < end and (run == RUN or (run and base + at >= size)):
                return base + place
    return end
