"""Elias-Fano sequences and byte-plane compression for the n-gram trie."""

from __future__ import annotations

import json
import mmap
import os
import tempfile

import numpy as np
import zstandard

U64 = np.uint64
SAMPLE = 4096


def squeeze(values: np.ndarray, sorted_: bool = False) -> bytes:
    """Unsigned integers as compressed byte planes; sorted_ ones as differences."""
    v = np.ascontiguousarray(values).astype("<u8")
    if sorted_ and len(v):
        v = np.diff(v, prepend=U64(0))
    planes = v.view(np.uint8).reshape(-1, 8).T
    used = max((i + 1 for i in range(8) if planes[i].any()), default=0)
    return len(v).to_bytes(8, "little") + bytes([used]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:used]).tobytes())


def unsqueeze(data: bytes, sorted_: bool = False) -> np.ndarray:
    n, used = int.from_bytes(data[:8], "little"), data[8]
    planes = np.zeros((8, n), np.uint8)
    if n and used:
        planes[:used] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=n * used), np.uint8).reshape(used, n)
    v = np.ascontiguousarray(planes.T).view("<u8").reshape(-1)
    return np.cumsum(v, dtype=U64) if sorted_ else v


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """A non-decreasing uint64 sequence: low bits as bit planes, high bits in unary, and the place of every SAMPLE-th one."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
    high = (values >> U64(low_bits)).astype(np.int64) + np.arange(n)
    unary = np.zeros((int(high[-1]) + 1 if n else 0), bool)
    unary[high] = True
    low = [np.packbits(((values >> U64(b)) & U64(1)).astype(bool)) for b in range(low_bits)]
    return {"head": np.array([n, low_bits], np.int64), "low": np.concatenate(low) if low else np.zeros(0, np.uint8), "high": np.packbits(unary), "at": high[::SAMPLE].astype(np.int64)}


class EliasFano:
    """Reads ranges of an encoded sequence; the arrays may be memory maps."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.low_bits = (int(x) for x in parts["head"])
        self.low, self.high, self.at = parts["low"], parts["high"], parts["at"]

    def __len__(self) -> int:
        return self.n

    def decode(self, start: int, stop: int) -> np.ndarray:
        """Values start..stop-1."""
        if stop <= start:
            return np.zeros(0, U64)
        first = start // SAMPLE
        bit = int(self.at[first])
        last = -(-stop // SAMPLE)
        end = int(self.at[last]) if last < len(self.at) else len(self.high) * 8
        byte = bit // 8
        ones = np.flatnonzero(np.unpackbits(self.high[byte : -(-end // 8)])) + byte * 8
        ones = ones[ones >= bit][start - first * SAMPLE : stop - first * SAMPLE]
        value = (ones - np.arange(start, stop)).astype(U64) << U64(self.low_bits)
        width = -(-self.n // 8)
        a, b = start // 8, -(-stop // 8)
        for i in range(self.low_bits):
            value |= np.unpackbits(self.low[i * width + a : i * width + b])[start - a * 8 : stop - a * 8].astype(U64) << U64(i)
        return value

    def at_index(self, index: np.ndarray) -> np.ndarray:
        """Values at rising indices, decoded stretch by stretch."""
        out = np.empty(len(index), U64)
        i, stretch = 0, SAMPLE * 64
        while i < len(index):
            a = int(index[i]) // SAMPLE * SAMPLE
            j = int(np.searchsorted(index, a + stretch))
            block = self.decode(a, min(self.n, a + stretch))
            out[i:j] = block[index[i:j] - a]
            i = j
        return out

    def successor(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rising targets: the index of the first value >= target (n if none), and whether it is equal."""
        index, equal = np.full(len(targets), self.n, np.int64), np.zeros(len(targets), bool)
        i, stretch = 0, SAMPLE * 64
        for a in range(0, self.n, stretch):
            block = self.decode(a, min(self.n, a + stretch))
            j = int(np.searchsorted(targets, block[-1], side="right"))
            if j > i:
                at = np.searchsorted(block, targets[i:j])
                index[i:j], equal[i:j] = at + a, block[at] == targets[i:j]
                i = j
            if i == len(targets):
                break
        return index, equal


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays in one block, each aligned for mapping."""
    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = (a.dtype.str, at, len(a))
        raw += b"\0" * (-len(raw) % 8)
        parts.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def map_block(block: bytes) -> dict[str, np.ndarray]:
    """The arrays of a packed block, memory-mapped from a file of this task's own that has no name any more."""
    fd, path = tempfile.mkstemp(prefix="trie-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(block)
        with open(path, "rb") as f:
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    finally:
        os.unlink(path)
    size = int.from_bytes(view[:8], "little")
    head = json.loads(view[8 : 8 + size])
    return {k: np.frombuffer(view, np.dtype(t), n, 8 + size + at) for k, (t, at, n) in head.items()}
