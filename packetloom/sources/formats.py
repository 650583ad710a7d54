"""Record formats of capture files: where records begin, and where the next one does.

A format is made for one file from its first bytes. It knows nothing of Spark: it
looks at a stretch of bytes and answers which record follows which.
"""

from __future__ import annotations

import heapq
import struct
import sys
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle

# executors get this module by value and need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values of the file formats
ETHERNET = 1  # link type
FILE_HEADER, RECORD_HEADER = 24, 16
MAX_CAPTURED = 262144  # longest record a capture may hold
# magic number -> byte order, time units per second
MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET = 0x0A0D0D0A, 1, 2, 3, 6  # block types
SECTION_BYTES = b"\x0a\x0d\x0d\x0a"
BYTE_ORDER = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
MAX_BLOCK = 16 << 20
TIME_RESOLUTION = 9  # option of an interface

HEAD_BYTES = 1 << 16  # enough for the blocks before the first packet
SYNC_RECORDS = 16  # records that must look right in a row before a guess is accepted


def words(raw: np.ndarray, at: np.ndarray, order: str, size: int = 4) -> np.ndarray:
    """Unsigned numbers of ``size`` bytes at the offsets ``at``; bytes past the end repeat the last one."""
    last = len(raw) - 1
    total = np.zeros(len(at), np.int64)
    for i in range(size) if order == ">" else reversed(range(size)):
        total = (total << 8) | raw[np.minimum(at + i, last)]
    return total


@dataclass
class Records:
    """What a batch of records holds: ``ts_us``, and ``captured`` bytes of a frame from offset ``frame`` on."""

    start: np.ndarray
    ts_us: np.ndarray
    captured: np.ndarray
    frame: np.ndarray


@dataclass
class Classic:
    """A file header, then records of a 16-byte header and captured bytes."""

    order: str
    units: int
    path: str = ""
    first: int = FILE_HEADER
    step: int = 1  # offsets at which a record may begin
    longest: int = RECORD_HEADER + MAX_CAPTURED
    _length: struct.Struct = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self._length = struct.Struct(self.order + "I")

    def after(self, data: bytes, at: int) -> int | None:
        """Where the record at ``at`` ends; None if it is cut off or longer than any may be."""
        if at + RECORD_HEADER > len(data):
            return None
        captured = self._length.unpack_from(data, at + 8)[0]
        end = at + RECORD_HEADER + captured
        return end if captured <= MAX_CAPTURED and end <= len(data) else None

    def afters(self, data: bytes, at: np.ndarray) -> np.ndarray:
        """As ``after`` for many offsets; -1 for none."""
        captured = words(np.frombuffer(data, np.uint8), at + 8, self.order)
        end = at + RECORD_HEADER + captured
        good = (captured <= MAX_CAPTURED) & (end <= len(data)) & (at + RECORD_HEADER <= len(data))
        return np.where(good, end, -1)

    def plausible(self, data: bytes, at: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8)
        captured, full = words(raw, at + 8, self.order), words(raw, at + 12, self.order)
        sizes = (captured > 0) & (captured <= MAX_CAPTURED) & (captured <= full) & (full <= 1 << 24)
        return sizes & (words(raw, at + 4, self.order) < self.units)

    def looks_right(self, data: bytes, at: int) -> bool:
        _, fraction, captured, full = struct.unpack_from(self.order + "IIII", data, at)
        return fraction < self.units and captured <= full

    def read(self, data: bytes, starts: np.ndarray, head: bool) -> Records:
        """Decode the records at ``starts``; ``head`` says that the first of them is the first of the file."""
        raw = np.frombuffer(data, np.uint8)
        micros = words(raw, starts + 4, self.order) * 1_000_000 // self.units
        seconds = words(raw, starts, self.order)
        return Records(starts, seconds * 1_000_000 + micros, words(raw, starts + 8, self.order), starts + RECORD_HEADER)


@dataclass
class Blocks:
    """Blocks that begin and end with their length; packets are some of them, interfaces come before the first."""

    order: str
    units: np.ndarray  # time units per second, by interface
    limits: np.ndarray  # most bytes captured, by interface
    path: str = ""
    first: int = 0
    step: int = 4
    longest: int = MAX_BLOCK

    def after(self, data: bytes, at: int) -> int | None:
        end = int(self.afters(data, np.array([at]))[0])
        return None if end < 0 else end

    def afters(self, data: bytes, at: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8)
        length = words(raw, at + 4, self.order)
        end = at + length
        good = (length >= 12) & (length <= MAX_BLOCK) & (length % 4 == 0) & (end <= len(data)) & (at + 12 <= len(data))
        end = np.where(good, end, -1)
        end[good] = np.where(words(raw, end[good] - 4, self.order) == length[good], end[good], -1)
        return end

    def plausible(self, data: bytes, at: np.ndarray) -> np.ndarray:
        return self.afters(data, at) >= 0

    def looks_right(self, data: bytes, at: int) -> bool:
        return self.after(data, at) is not None

    def read(self, data: bytes, starts: np.ndarray, head: bool) -> Records:
        raw = np.frombuffer(data, np.uint8)
        kind = words(raw, starts, self.order)
        packet = np.isin(kind, (OLD_PACKET, SIMPLE_PACKET, PACKET))
        # the description of the file goes up to the first packet
        known = (np.cumsum(packet) == 0) & head & ((kind != SECTION) | (np.arange(len(kind)) == 0))
        if (np.isin(kind, (SECTION, INTERFACE)) & ~known).any():
            raise ValueError(f"{self.path}: sections and interfaces after the first packet are not read")
        starts, kind = starts[packet], kind[packet]
        simple = kind == SIMPLE_PACKET
        interface = np.where(kind == OLD_PACKET, words(raw, starts + 8, self.order, 2), words(raw, starts + 8, self.order))
        interface = np.where(simple, 0, interface)
        if (interface >= len(self.units)).any():
            raise ValueError(f"{self.path}: a packet of an interface that is not described")
        ticks = (words(raw, starts + 12, self.order) << 32) | words(raw, starts + 16, self.order)
        seconds, rest = np.divmod(ticks, self.units[interface])
        # a simple packet has no time
        ts_us = np.where(simple, 0, seconds * 1_000_000 + rest * 1_000_000 // self.units[interface])
        captured = np.where(simple, np.minimum(words(raw, starts + 8, self.order), self.limits[0]), words(raw, starts + 20, self.order))
        frame = starts + np.where(simple, 12, 28)
        ends = starts + words(raw, starts + 4, self.order) - 4
        return Records(starts, ts_us, np.minimum(captured, ends - frame), frame)


def _interfaces(head: bytes, order: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Time units and capture limits of the interfaces before the first packet."""
    units, limits, at = [], [], 0
    number = struct.Struct(order + "II")
    while at + 12 <= len(head):
        kind, length = number.unpack_from(head, at)
        if kind in (OLD_PACKET, SIMPLE_PACKET, PACKET) or length < 12 or length % 4:
            break
        if at + length > len(head):
            raise ValueError(f"{path}: the blocks before the first packet are longer than {HEAD_BYTES} bytes")
        if kind == INTERFACE:
            link, _, limit = struct.unpack_from(order + "HHI", head, at + 8)
            _check_link(link, path)
            ticks, option = 1_000_000, at + 16
            while option + 4 <= at + length - 4:
                code, size = struct.unpack_from(order + "HH", head, option)
                if code == 0:
                    break
                if code == TIME_RESOLUTION and size:
                    power = head[option + 4]
                    ticks = 1 << (power & 127) if power & 128 else 10**power
                option += 4 + (size + 3) // 4 * 4
            units.append(ticks)
            limits.append(limit or MAX_CAPTURED)
        at += length
    return np.array(units, np.int64), np.array(limits, np.int64)


def _check_link(link: int, path: str) -> None:
    if link != ETHERNET:
        raise ValueError(f"{path} has link type {link}; only Ethernet is decoded")


def format_of(head: bytes, path: str) -> Classic | Blocks:
    """The format of the file that begins with ``head`` (``HEAD_BYTES`` of it, or all)."""
    if head[:4] == SECTION_BYTES and head[8:12] in BYTE_ORDER:
        order = BYTE_ORDER[head[8:12]]
        return Blocks(order, *_interfaces(head, order, path), path=path)
    if head[:4] not in MAGIC or len(head) < FILE_HEADER:
        raise ValueError(f"{path} is not a classic capture file, nor one of blocks")
    order, units = MAGIC[head[:4]]
    _check_link(struct.unpack_from(order + "I", head, 20)[0] & 0xFFFF, path)
    return Classic(order, units, path)


def hop(layout: Classic | Blocks, data: bytes, at: int, limit: int) -> tuple[list[int], int, bool]:
    """Record offsets from ``at`` up to ``limit``, the end of the last one, and whether the capture ends there.

    It ends at a record that is cut off or longer than any may be.
    """
    found = []
    while at < limit:
        end = layout.after(data, at)
        if end is None:
            return found, at, True
        found.append(at)
        at = end
    return found, at, False


def guess_start(layout: Classic | Blocks, data: bytes, at: int) -> int | None:
    """Lowest offset from ``at`` on from which a run of records looks right."""
    window = min(len(data) - RECORD_HEADER, at + layout.longest)
    offsets = np.arange(at, window, layout.step)
    if not len(offsets):
        return None
    for begin in offsets[layout.plausible(data, offsets)].tolist():
        where, good = begin, 0
        while good < SYNC_RECORDS and where + RECORD_HEADER <= len(data):
            end = layout.after(data, where)
            if not layout.looks_right(data, where) or end is None and where + layout.longest < len(data):
                break
            if end is None:
                return begin  # as far as the bytes go
            where = end
            good += 1
        else:
            return begin
    return None


def exits(layout: Classic | Blocks, data: bytes, at: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the records lead from every offset at which the first one of a range may begin.

    Returns these offsets; for each of them a place in the two following arrays, or
    -1 where no record can begin; ends (the first record start from ``limit`` on, or
    where the capture ends) and whether the capture ends there. Chains of records
    soon run into one another, so ends are few.
    """
    offsets = np.arange(at, min(limit, at + layout.longest), layout.step)
    if not len(offsets):
        return offsets, offsets, offsets, offsets.astype(bool)
    past = offsets[-1] + layout.step
    goes = layout.afters(data, offsets)
    dead = goes < 0
    goes[dead] = offsets[dead]  # ends where it is
    while True:  # each turn doubles the records that are passed, as long as they begin among the offsets
        inside = goes < past
        further = goes.copy()
        further[inside] = goes[(goes[inside] - at) // layout.step]
        if (further == goes).all():
            break
        goes = further
    leads = np.unique(goes)
    settled = _settle(layout, data, leads[leads >= past].tolist(), limit)
    place = np.searchsorted(leads, goes)
    place[dead] = -1
    ends = [settled.get(x, (x, True)) for x in leads.tolist()]
    return offsets, place, np.array([e for e, _ in ends], np.int64), np.array([o for _, o in ends], bool)


def _settle(layout: Classic | Blocks, data: bytes, starts: list[int], limit: int) -> dict[int, tuple[int, bool]]:
    """Follow several chains to ``limit``, always the one that is furthest behind, so that they meet where they can."""
    heap = sorted(starts)
    chain = {s: s for s in heap}  # place of each live chain -> its start
    joined: dict[int, int] = {}
    ended: dict[int, tuple[int, bool]] = {}
    while heap:
        at = heapq.heappop(heap)
        own = chain.pop(at)
        if at >= limit or not heap:
            _, end, over = hop(layout, data, at, limit)
            ended[own] = end, over
            continue
        end = layout.after(data, at)
        if end is None:
            ended[own] = at, True
        elif end in chain:
            joined[own] = chain[end]
        else:
            chain[end] = own
            heapq.heappush(heap, end)

    def last(start: int) -> tuple[int, bool]:
        while start in joined:
            start = joined[start]
        return ended[start]

    return {s: last(s) for s in starts}
