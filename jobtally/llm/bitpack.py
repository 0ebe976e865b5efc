"""Ids in the fewest bits that hold the vocabulary, in blocks that unpack on their own."""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"JTBITS01"
HEADER = struct.Struct("<8sIIQQ")  # magic, bits per id, ids per block, documents, ids


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` bits each, little end first, padded to a byte."""
    if width % 8 == 0:
        return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : width // 8]).tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    if width % 8 == 0:
        out = np.zeros((count, 4), np.uint8)
        out[:, : width // 8] = np.frombuffer(data, np.uint8, count * width // 8).reshape(count, width // 8)
        return out.view("<u4").ravel()
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little")
    return (bits.reshape(count, width).astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


def shard_bytes(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray, width: int, block: int) -> bytes:
    """A shard file: header, byte offset of each block, documents (id, null flag, first id), blocks."""
    packed = [pack(ids[i : i + block], width) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0] + [len(p) for p in packed]).astype("<u8")
    firsts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    head = HEADER.pack(MAGIC, width, block, len(doc_ids), len(ids))
    return b"".join([head, offsets.tobytes(), doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), firsts.tobytes(), *packed])


class ShardReader:
    """Random access to one shard: any run of ids costs the blocks it touches."""

    def __init__(self, handle):
        self.handle = handle
        magic, self.width, self.block, self.n_docs, self.n_ids = HEADER.unpack(handle.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a bit-packed shard")
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(handle.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(handle.read(8 * self.n_docs), "<i8")
        self.nulls = np.frombuffer(handle.read(self.n_docs), "u1").astype(bool)
        self.firsts = np.frombuffer(handle.read(8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        self.payload = HEADER.size + 8 * (blocks + 1) + 17 * self.n_docs + 8

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.handle.seek(self.payload + int(self.offsets[first]))
        data = self.handle.read(int(self.offsets[last + 1] - self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            count = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(data[self.offsets[b] - self.offsets[first] : self.offsets[b + 1] - self.offsets[first]], count, self.width))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, position: int) -> np.ndarray:
        return self.ids(int(self.firsts[position]), int(self.firsts[position + 1]))
