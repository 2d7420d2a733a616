"""CRC-64/NVME over byte columns.

A CRC register is linear over GF(2). With a zero start value, zero bytes in
front change nothing, so texts of any length can be cut into equal blocks that
are all digested at once, byte position by byte position, and then folded
together pairwise: ``crc(ab) = forward(crc(a), len(b)) ^ crc(b)``. The start
value of all ones is added at the end in the same way.

Linearity also gives the digest of an object that is spread over many rows.
Each chunk is moved back by the offset at which it ends, the chunks are joined
with ``bit_xor`` - an ordinary aggregate with map-side combine, in any order -
and the sum is moved forward by the length of the object.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from vaultlens.functions.text import as_column

# CRC-64/NVME, reflected polynomial, start value and final xor.
POLYNOMIAL = 0x9A6C9329AC4BC9B5
ALL_ONES = 0xFFFFFFFFFFFFFFFF

BLOCK = 256
#: Lengths and offsets are non-negative 64-bit integers.
LENGTH_BITS = 63
#: Bytes digested in one vectorised pass; bounds the memory of a task.
PASS_BYTES = 8 << 20


def _bit_forward(register: int) -> int:
    return (register >> 1) ^ (POLYNOMIAL if register & 1 else 0)


def _bit_back(register: int) -> int:
    if register >> 63:
        return ((register ^ POLYNOMIAL) << 1 | 1) & ALL_ONES
    return register << 1


def _columns(step) -> np.ndarray:
    """Images of the 64 single-bit registers after eight steps (one byte)."""
    images = []
    for bit in range(64):
        register = 1 << bit
        for _ in range(8):
            register = step(register)
        images.append(register)
    return np.array(images, dtype=np.uint64)


def _tabulate(columns: np.ndarray) -> np.ndarray:
    """Operator as 8 tables of 256 entries, one table per register byte."""
    tables = np.zeros((8, 256), dtype=np.uint64)
    values = np.arange(256)
    for byte in range(8):
        for bit in range(8):
            tables[byte][(values >> bit) & 1 == 1] ^= columns[8 * byte + bit]
    return tables


def _apply(tables: np.ndarray, registers: np.ndarray) -> np.ndarray:
    out = np.zeros_like(registers)
    for byte in range(8):
        index = (registers >> np.uint64(8 * byte)) & np.uint64(0xFF)
        out ^= tables[byte][index.astype(np.intp)]
    return out


@lru_cache(maxsize=2)
def _ladder(backward: bool) -> list[np.ndarray]:
    """Operators that move a register by 1, 2, 4, 8 ... bytes."""
    columns = _columns(_bit_back if backward else _bit_forward)
    ladder = []
    for _ in range(LENGTH_BITS):
        tables = _tabulate(columns)
        ladder.append(tables)
        columns = _apply(tables, columns)
    return ladder


@lru_cache(maxsize=1)
def _pair_table() -> np.ndarray:
    """Step over two bytes at once, indexed by the low 16 register bits."""
    low, high = _ladder(False)[1][:2]
    return (high[:, None] ^ low[None, :]).ravel()


def move(registers: np.ndarray, lengths: np.ndarray, backward: bool = False) -> np.ndarray:
    """Move each register by its own number of zero bytes."""
    out = registers.astype(np.uint64, copy=True)
    lengths = lengths.astype(np.int64)
    if lengths.min(initial=0) < 0:
        raise ValueError("a length or offset is negative")
    top = int(lengths.max(initial=0))
    for bit, tables in enumerate(_ladder(backward)):
        if top >> bit == 0:
            break
        chosen = (lengths >> bit) & 1 == 1
        out[chosen] = _apply(tables, out[chosen])
    return out


def _raw_pass(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Zero-start registers of adjacent slices of ``data``."""
    blocks = np.maximum((lengths + BLOCK - 1) // BLOCK, 1)
    first = np.concatenate(([0], np.cumsum(blocks)))
    padded = np.zeros(int(first[-1]) * BLOCK, dtype=np.uint8)
    # Slices sit at the end of their blocks, so padding is in front.
    runs = np.column_stack((blocks * BLOCK - lengths, lengths)).ravel()
    padded[np.repeat(np.tile([False, True], len(blocks)), runs)] = data[starts[0] : starts[-1] + lengths[-1]]

    grid = np.ascontiguousarray(padded.view("<u2").reshape(-1, BLOCK // 2).T)
    table = _pair_table()
    registers = np.zeros(grid.shape[1], dtype=np.uint64)
    for row in grid:
        index = registers.astype(np.uint16) ^ row
        registers >>= np.uint64(16)
        registers ^= table[index]

    # Fold neighbouring blocks of a slice, counted from the back, until each
    # slice has one register left.
    owner = np.repeat(np.arange(len(blocks)), blocks)
    from_back = np.repeat(first[1:] - 1, blocks) - np.arange(len(owner))
    level = BLOCK.bit_length() - 1
    while len(registers) > len(blocks):
        odd = from_back & 1 == 1
        registers = registers.copy()
        # A block at an odd place is directly in front of its even partner.
        registers[np.flatnonzero(odd) + 1] ^= _apply(
            _ladder(False)[level], registers[odd]
        )
        registers, owner, from_back = registers[~odd], owner[~odd], from_back[~odd] >> 1
        level += 1
    return registers


def raw_registers(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Zero-start registers of all values of an Arrow binary array."""
    lengths = np.diff(offsets).astype(np.int64)
    starts = offsets[:-1].astype(np.int64)
    out = np.zeros(len(lengths), dtype=np.uint64)
    # Long values are digested in pieces, short ones many at a time.
    long = lengths > PASS_BYTES
    passes = np.cumsum(np.where(long, 0, np.maximum(lengths, BLOCK))) // PASS_BYTES
    edges = np.flatnonzero((np.diff(passes) > 0) | long[1:] | long[:-1]) + 1
    for first, end in zip([0, *edges.tolist()], [*edges.tolist(), len(lengths)]):
        if first == end:
            continue
        if long[first]:
            out[first] = _raw_long(data, starts[first : first + 1], int(lengths[first]))
        else:
            out[first:end] = _raw_pass(data, starts[first:end], lengths[first:end])
    return out


def _raw_long(data: np.ndarray, start: np.ndarray, length: int) -> np.uint64:
    register = np.zeros(1, dtype=np.uint64)
    for begin in range(0, length, PASS_BYTES):
        size = np.array([min(PASS_BYTES, length - begin)])
        register = move(register, size) ^ _raw_pass(data, start + begin, size)
    return register[0]


def finish(registers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Add the start value and the final xor to zero-start registers."""
    start = np.full(len(registers), ALL_ONES, dtype=np.uint64)
    return registers ^ move(start, lengths) ^ np.uint64(ALL_ONES)


def _buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)
    offsets = offsets[values.offset : values.offset + len(values) + 1]
    body = values.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data, offsets


def _with_nulls(result: np.ndarray, values: pa.Array, kind: pa.DataType) -> pa.Array:
    mask = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
    return pa.array(result.view(np.int64), type=kind, mask=mask)


@F.arrow_udf(LongType())
def _digest(values: pa.Array) -> pa.Array:
    data, offsets = _buffers(values)
    result = finish(raw_registers(data, offsets), np.diff(offsets))
    return _with_nulls(result, values, pa.int64())


@F.arrow_udf(LongType())
def _chunk_share(values: pa.Array, ends: pa.Array) -> pa.Array:
    data, offsets = _buffers(values)
    end = ends.fill_null(0).to_numpy(zero_copy_only=False)
    result = move(raw_registers(data, offsets), end, backward=True)
    return _with_nulls(result, values, pa.int64())


@F.arrow_udf(LongType())
def _finish_shares(shares: pa.Array, lengths: pa.Array) -> pa.Array:
    length = lengths.fill_null(0).to_numpy(zero_copy_only=False)
    register = shares.fill_null(0).to_numpy(zero_copy_only=False)
    result = finish(move(register.view(np.uint64), length), length)
    return _with_nulls(result, shares, pa.int64())


def crc64_register(value: Column | str) -> Column:
    """The digest as a 64-bit integer."""
    return _digest(as_column(value).cast("binary"))


def register_to_base64(register: Column | str) -> Column:
    """Eight bytes, most significant first, as base64."""
    return F.base64(F.unhex(F.lpad(F.hex(as_column(register)), 16, "0")))


def crc64_base64(value: Column | str) -> Column:
    """The digest as a storage service shows it."""
    return register_to_base64(crc64_register(value))


def crc64_of_chunks(
    chunks: DataFrame, keys: list[str], content: str = "content", offset: str = "offset"
) -> DataFrame:
    """Digest of objects given as chunk rows with their byte offset.

    One shuffle on ``keys`` of one small row per object and map task; no task
    ever holds an object, however large it is.
    """
    body = F.col(content).cast("binary")
    end = F.col(offset) + F.octet_length(body)
    per_object = (
        chunks.select(*keys, _chunk_share(body, end).alias("share"), end.alias("end"))
        .groupBy(*keys)
        .agg(F.bit_xor("share").alias("share"), F.max("end").alias("content_length"))
    )
    return per_object.select(
        *keys,
        "content_length",
        register_to_base64(_finish_shares("share", "content_length")).alias("checksum"),
    )
