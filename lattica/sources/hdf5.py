"""HDF5 files as far as particle snapshots use them: superblock 0 or 1, groups by symbol tables, headers of version 1.

Datasets have one dimension of integers or floating numbers and are contiguous, compact or in chunks (deflate, shuffle and
checksums); attributes are such arrays or strings. What a file has beyond that raises Unsupported with its name, and a
file that isn't HDF5 or is cut off raises Damaged. Only headers and the rows asked for are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

# Fixed values of the format.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
SPACE, TYPE, FILL, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, SYMBOLS = 0x01, 0x03, 0x05, 0x08, 0x0B, 0x0C, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
NOWHERE = 2**64 - 1
#: Entries of a node of the trees: half of what symbol nodes, group nodes and chunk nodes hold.
_SYMBOLS, _GROUP, _CHUNK = 32, 16, 32
#: Floating types by size: sign's place, bits, exponent's place and bits, mantissa's bits, bias.
_FLOATS = {4: (31, 32, 23, 8, 23, 127), 8: (63, 64, 52, 11, 52, 1023)}


class Damaged(ValueError):
    """A file that isn't HDF5, or not whole."""


class Unsupported(NotImplementedError):
    """A part of the format that snapshots don't use."""


class Dataset(NamedTuple):
    """A dataset's rows, type and place: (contiguous, address), (compact, bytes) or (chunks, address of the tree, rows of a chunk, filters)."""

    rows: int
    dtype: str
    place: tuple


# Reading -------------------------------------------------------------------------------------------------------------


class Reader:
    """Groups, datasets and attributes of a file, given a function that reads n bytes from an address."""

    def __init__(self, read_at: Callable[[int, int], bytes]):
        self._read_at, self._base, at = read_at, 0, 0
        while (head := read_at(at, 8)) != SIGNATURE:  # user blocks are of 512 bytes, or twice that, and so on
            if len(head) < 8:
                raise Damaged("no HDF5 signature")
            at = 2 * at or 512
        version, offsets, lengths = struct.unpack("<B4xBB", self._bytes(at + 8, 7))
        if version > 1 or (offsets, lengths) != (8, 8):
            raise Unsupported(f"superblock {version} with addresses of {offsets} and {lengths} bytes")
        rest = at + (24 if version == 0 else 28)
        (self._base,) = struct.unpack("<Q", self._bytes(rest, 8))
        self._base = at if self._base == 0 else self._base
        (self.root,) = struct.unpack("<Q", self._read_whole(rest + 40, 8))

    def _read_whole(self, at: int, n: int) -> bytes:
        data = self._read_at(at, n)
        if len(data) != n:
            raise Damaged(f"{n} bytes wanted at {at}, {len(data)} there")
        return data

    def _bytes(self, at: int, n: int) -> bytes:
        return self._read_whole(self._base + at, n)

    def messages(self, header: int) -> list[tuple[int, bytes]]:
        """(type, data) of an object's header messages."""
        version, count, size = struct.unpack("<BxH4xI", self._bytes(header, 12))
        if version != 1:
            raise Unsupported(f"object header {version}")
        found, blocks = [], [(header + 16, size)]
        while blocks and len(found) < count:
            block = self._bytes(*blocks.pop(0))
            at = 0
            while at + 8 <= len(block) and len(found) < count:
                kind, n, flags = struct.unpack_from("<HHB", block, at)
                if flags & 2:
                    raise Unsupported(f"a shared message of type {kind}")
                found.append((kind, block[at + 8 : at + 8 + n]))
                if kind == CONTINUED:
                    blocks.append(struct.unpack("<QQ", found[-1][1][:16]))
                at += 8 + n
        return found

    def _tree(self, at: int, kind: int, key: int, wanted: Callable[[bytes, bytes], bool] = lambda a, b: True) -> Iterator[tuple[bytes, int]]:
        """(key, child) of a tree's lowest nodes, going only into children that are wanted for the keys around them."""
        mark, found, level, used = struct.unpack("<4sBBH", self._bytes(at, 8))
        if mark != b"TREE" or found != kind:
            raise Damaged(f"no tree of kind {kind} at {at}")
        body = self._bytes(at + 24, used * (key + 8) + key)
        for k in range(used):
            here = k * (key + 8)
            low, high = body[here : here + key], body[here + key + 8 : here + 2 * key + 8]
            if wanted(low, high):
                (child,) = struct.unpack_from("<Q", body, here + key)
                if level:
                    yield from self._tree(child, kind, key, wanted)
                else:
                    yield low, child

    def children(self, header: int) -> dict[str, int]:
        """Names in a group and the headers they stand for; none for what isn't a group."""
        table = next((d for kind, d in self.messages(header) if kind == SYMBOLS), None)
        if table is None:
            return {}
        tree, heap = struct.unpack("<QQ", table[:16])
        mark, size, names_at = struct.unpack("<4s4xQ8xQ", self._bytes(heap, 32))
        if mark != b"HEAP":
            raise Damaged(f"no heap at {heap}")
        names, out = self._bytes(names_at, size), {}
        for _, node in self._tree(tree, 0, 8):
            mark, n = struct.unpack("<4s2xH", self._bytes(node, 8))
            if mark != b"SNOD":
                raise Damaged(f"no symbols at {node}")
            for name, target in struct.iter_unpack("<QQ24x", self._bytes(node + 8, 40 * n)):
                out[names[name : names.index(b"\0", name)].decode()] = target
        return out

    def dataset(self, header: int) -> Dataset | None:
        """What a header says of a dataset; None for what isn't one."""
        parts = dict(self.messages(header))
        if LAYOUT not in parts:
            return None
        shape, dtype, layout = _shape(parts[SPACE]), _dtype(parts[TYPE]), parts[LAYOUT]
        if len(shape) != 1 or dtype.kind == "S":
            raise Unsupported(f"a dataset of {len(shape)} dimensions of {dtype}")
        if layout[0] != 3:
            raise Unsupported(f"layout {layout[0]}")
        if layout[1] == 0:
            (n,) = struct.unpack_from("<H", layout, 2)
            place = ("compact", layout[4 : 4 + n])
        elif layout[1] == 1:
            place = ("contiguous", struct.unpack_from("<Q", layout, 2)[0])
        else:
            tree, rows = struct.unpack_from("<QI", layout, 3)
            place = ("chunks", tree, rows, _filters(parts.get(FILTERS)))
        return Dataset(shape[0], dtype.str, place)

    def rows(self, data: Dataset, first: int, last: int) -> np.ndarray:
        """The rows first to last (exclusive) of a dataset; rows of chunks never written are 0."""
        dtype, place = np.dtype(data.dtype), data.place
        if place[0] == "compact":
            return np.frombuffer(place[1], dtype)[first:last]
        if place[0] == "contiguous":
            if place[1] == NOWHERE:
                return np.zeros(last - first, dtype)
            return np.frombuffer(self._bytes(place[1] + first * dtype.itemsize, (last - first) * dtype.itemsize), dtype)
        _, tree, step, filters = place
        out, start = np.zeros(last - first, dtype), lambda key: struct.unpack_from("<Q", key, 8)[0]
        if tree == NOWHERE:
            return out
        for key, at in self._tree(tree, 1, 24, lambda a, b: start(a) < last and (start(b) > first or start(b) <= start(a))):
            size, skipped, begin = struct.unpack("<IIQ", key[:16])
            if begin >= last or begin + step <= first:
                continue
            chunk = np.frombuffer(_unfiltered(self._bytes(at, size), filters, skipped, dtype.itemsize), dtype)
            a, b = max(first, begin), min(last, begin + step)
            out[a - first : b - first] = chunk[a - begin : b - begin]
        return out

    def attributes(self, header: int) -> dict[str, np.ndarray | str]:
        """Names and values of an object's attributes."""
        out = {}
        for kind, data in self.messages(header):
            if kind != ATTRIBUTE:
                continue
            version, *sizes = struct.unpack_from("<BxHHH", data)
            if version > 3:
                raise Unsupported(f"attribute {version}")
            at, parts = 9 if version == 3 else 8, []
            for n in sizes:
                parts.append(data[at : at + n])
                at += -(-n // 8) * 8 if version == 1 else n
            name, dtype, shape = parts[0].split(b"\0")[0].decode(), _dtype(parts[1]), _shape(parts[2])
            n = int(np.prod(shape, dtype=np.int64))
            values = np.frombuffer(data[at : at + n * dtype.itemsize], dtype)
            out[name] = values.tobytes().split(b"\0")[0].decode() if dtype.kind == "S" else values
        return out


def _shape(data: bytes) -> tuple[int, ...]:
    version, rank = data[0], data[1]
    if version not in (1, 2):
        raise Unsupported(f"dataspace {version}")
    return struct.unpack_from(f"<{rank}Q", data, 8 if version == 1 else 4)


def _dtype(data: bytes) -> np.dtype:
    kind, bits, size = data[0] & 15, data[1], struct.unpack_from("<I", data, 4)[0]
    order = ">" if bits & 1 else "<"
    if kind == 0 and size in (1, 2, 4, 8):
        return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
    if kind == 1 and size in _FLOATS:
        return np.dtype(f"{order}f{size}")
    if kind == 3:
        return np.dtype(f"S{size}")
    raise Unsupported(f"type class {kind} of {size} bytes")


def _filters(data: bytes | None) -> tuple[int, ...]:
    """The filters' numbers in the order in which they were applied."""
    if data is None:
        return ()
    version, count = data[0], data[1]
    at, out = 8 if version == 1 else 2, []
    for _ in range(count):
        (number,) = struct.unpack_from("<H", data, at)
        if version == 1 or number >= 256:
            name, values = struct.unpack_from("<HxxH", data, at + 2)
            at += 8
        else:  # known numbers have no name there
            name, (values,) = 0, struct.unpack_from("<H", data, at + 4)
            at += 6
        at += -(-name // 8) * 8 if version == 1 else name
        at += 4 * (values + values % 2 if version == 1 else values)
        out.append(number)
    if set(out) - {DEFLATE, SHUFFLE, CHECKSUM}:
        raise Unsupported(f"filters {out}")
    return tuple(out)


def _unfiltered(data: bytes, filters: tuple[int, ...], skipped: int, width: int) -> bytes:
    for k in reversed(range(len(filters))):
        if skipped >> k & 1:
            continue
        if filters[k] == CHECKSUM:
            data = data[:-4]
        elif filters[k] == DEFLATE:
            try:
                data = zlib.decompress(data)
            except zlib.error as e:
                raise Damaged(f"a chunk: {e}") from e
        else:
            whole = len(data) // width * width
            data = np.frombuffer(data[:whole], np.uint8).reshape(width, -1).T.tobytes() + data[whole:]
    return data


# Writing -------------------------------------------------------------------------------------------------------------


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def _space(n: int) -> bytes:
    return struct.pack("<BBB5xQ", 1, 1, 0, n)


def _type(dtype: np.dtype) -> bytes:
    if dtype.kind == "S":
        return struct.pack("<4BI", 0x13, 0, 0, 0, dtype.itemsize)
    if dtype.kind in "iu":
        return struct.pack("<4BIHH", 0x10, 8 * (dtype.kind == "i"), 0, 0, dtype.itemsize, 0, 8 * dtype.itemsize)
    sign, bits, exponent, width, mantissa, bias = _FLOATS[dtype.itemsize]
    return struct.pack("<4BIHH4BI", 0x11, 0x20, sign, 0, dtype.itemsize, 0, bits, exponent, width, 0, mantissa, bias)


def _attribute(name: str, values: np.ndarray | str) -> tuple[int, bytes]:
    if isinstance(values, str):
        values = np.array([values.encode() + b"\0"], dtype=f"S{len(values.encode()) + 1}")
    data, kind, space = name.encode() + b"\0", _type(values.dtype), _space(len(values))
    return ATTRIBUTE, struct.pack("<BxHHH", 1, len(data), len(kind), len(space)) + _padded(data) + _padded(kind) + _padded(space) + values.tobytes()


class Builder:
    """A file, put together in memory: datasets first, then the groups that name them."""

    def __init__(self):
        self._out = bytearray(96)

    def _put(self, data: bytes) -> int:
        at = len(self._out)
        self._out += _padded(data)
        return at

    def _header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHB3x", kind, len(_padded(data)), 0) + _padded(data) for kind, data in messages)
        return self._put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def _put_tree(self, kind: int, half: int, entries: list[tuple[bytes, int]], end: bytes) -> int:
        """A tree over (key, child), from below; `end` is the key after the last."""
        level, width = 0, len(end)
        while True:
            nodes, size = [], 24 + 2 * half * (width + 8) + width
            first = len(self._out)
            groups = [entries[k : k + 2 * half] for k in range(0, len(entries), 2 * half)] or [[]]
            for k, group in enumerate(groups):
                after = groups[k + 1][0][0] if k + 1 < len(groups) else end
                place = lambda j: first + j * (size + -size % 8) if 0 <= j < len(groups) else NOWHERE  # noqa: B023, E731
                body = b"".join(key + struct.pack("<Q", child) for key, child in group) + after
                nodes.append((group[0][0] if group else end, self._put((struct.pack("<4sBBHQQ", b"TREE", kind, level, len(group), place(k - 1), place(k + 1)) + body).ljust(size, b"\0"))))
            if len(nodes) == 1:
                return nodes[0][1]
            entries, level = nodes, level + 1

    def dataset(self, values: np.ndarray, chunk: int = 0, level: int = 0) -> int:
        """One dimension of numbers: contiguous, or in chunks of that many rows, deflated at a level above 0."""
        values = np.ascontiguousarray(values, values.dtype.newbyteorder("<"))
        width, messages = values.dtype.itemsize, [(SPACE, _space(len(values))), (TYPE, _type(values.dtype)), (FILL, struct.pack("<4BI", 2, 2, 2, 1, 0))]
        if not chunk:
            at = self._put(values.tobytes()) if len(values) else NOWHERE
            return self._header([*messages, (LAYOUT, struct.pack("<BBQQ", 3, 1, at, values.nbytes))])
        key, entries = lambda size, row: struct.pack("<IIQQ", size, 0, row, 0), []
        for row in range(0, len(values), chunk):
            data = np.zeros(chunk, values.dtype)
            data[: len(values) - row] = values[row : row + chunk]
            data = data.tobytes()
            if level:
                data = zlib.compress(np.frombuffer(data, np.uint8).reshape(-1, width).T.tobytes(), level)
            entries.append((key(len(data), row), self._put(data)))
        if level:
            messages.append((FILTERS, struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHI4x", SHUFFLE, 0, 1, 1, width) + struct.pack("<HHHHI4x", DEFLATE, 0, 1, 1, level)))
        tree = self._put_tree(1, _CHUNK, entries, key(0, -(-len(values) // chunk) * chunk)) if entries else NOWHERE
        return self._header([*messages, (LAYOUT, struct.pack("<BBBQII", 3, 2, 2, tree, chunk, width))])

    def group(self, children: dict[str, int], attributes: dict[str, np.ndarray | str]) -> int:
        """A group of named headers."""
        names, places = bytearray(8), {}
        for name in sorted(children, key=str.encode):
            places[name] = len(names)
            names += _padded(name.encode() + b"\0")
        ordered, nodes = list(places), []
        for k in range(0, len(ordered), 2 * _SYMBOLS):
            some = ordered[k : k + 2 * _SYMBOLS]
            rows = b"".join(struct.pack("<QQ24x", places[n], children[n]) for n in some)
            before = struct.pack("<Q", places[ordered[k - 1]] if k else 0)
            nodes.append((before, self._put((struct.pack("<4sBxH", b"SNOD", 1, len(some)) + rows).ljust(8 + 80 * _SYMBOLS, b"\0"))))
        tree = self._put_tree(0, _GROUP, nodes, struct.pack("<Q", places[ordered[-1]] if ordered else 0))
        data = self._put(bytes(names))
        heap = self._put(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(names), 1, data))
        return self._header([(SYMBOLS, struct.pack("<QQ", tree, heap)), *(_attribute(n, v) for n, v in attributes.items())])

    def file(self, root: int) -> bytearray:
        """The whole file, given its root group."""
        head = SIGNATURE + struct.pack("<8BHHI4Q", 0, 0, 0, 0, 0, 8, 8, 0, _SYMBOLS, _GROUP, 0, 0, NOWHERE, len(self._out), NOWHERE)
        self._out[:96] = (head + struct.pack("<QQII16x", 0, root, 0, 0)).ljust(96, b"\0")
        return self._out
