"""Arrow kernels of the wire codec: each works on one field of a whole batch at a time.

They run inside Spark tasks, called from the column functions in :mod:`wire_codec`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql.pandas.types import to_arrow_type

from merchlake.contracts import (
    CONTRACTS,
    EVENT_FIELDS,
    WIDE_NAME,
    WIRE_HEADER_BYTES,
    base_type,
    is_nullable,
)


class _Cursor:
    """Reads the same field from every row of a batch at once."""

    def __init__(self, values: pa.Array):
        self.count = len(values)
        offsets = np.frombuffer(values.buffers()[1], np.int32)
        offsets = offsets[values.offset : values.offset + self.count + 1].astype(np.int64)
        self.data = np.frombuffer(values.buffers()[2], np.uint8)
        self.pos = offsets[:-1] + WIRE_HEADER_BYTES
        self.end = offsets[1:]
        self.ok = self.pos <= self.end

    def long(self, rows: np.ndarray) -> np.ndarray:
        """Zig-zag variable-length integers; rows cut short or too long turn bad."""
        out = np.zeros(self.count, np.uint64)
        live = np.flatnonzero(rows & self.ok)
        for step in range(10):
            inside = self.pos[live] < self.end[live]
            self.ok[live[~inside]] = False
            live = live[inside]
            if not len(live):
                break
            byte = self.data[self.pos[live]]
            out[live] |= (byte & 0x7F).astype(np.uint64) << np.uint64(7 * step)
            self.pos[live] += 1
            live = live[byte >= 0x80]
        self.ok[live] = False
        sign = np.uint64(0) - (out & np.uint64(1))
        return ((out >> np.uint64(1)) ^ sign).view(np.int64)

    def text(self, rows: np.ndarray) -> pa.Array:
        size = self.long(rows)
        rows = rows & self.ok
        fits = (size >= 0) & (size <= self.end - self.pos)
        self.ok &= fits | ~rows
        rows &= fits
        size = np.where(rows, size, 0)
        start = self.pos.copy()
        self.pos += size
        ends = np.concatenate(([0], np.cumsum(size)))
        picked = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
        data = self.data[picked]
        buffers = [None, pa.py_buffer(_offsets(ends)), pa.py_buffer(data)]
        raw = pa.Array.from_buffers(pa.binary(), self.count, buffers)
        try:
            return _masked(raw, rows).cast(pa.string())
        except pa.ArrowInvalid:
            # Some row is not UTF-8; only then are rows looked at one by one, and of those the ones beyond ASCII.
            high = np.zeros(len(data) + 1, np.int64)
            np.cumsum(data >= 0x80, out=high[1:])
            doubtful = np.flatnonzero(high[ends[1:]] > high[ends[:-1]])
            bad = [i for i in doubtful.tolist() if not _is_utf8(raw[i].as_py())]
            self.ok[bad] = False
            rows[bad] = False
            return _masked(raw, rows).cast(pa.string())


def _offsets(ends: np.ndarray) -> np.ndarray:
    """Ends as the 32-bit offsets of Arrow; a batch beyond them must be split by its reader."""
    if len(ends) and ends[-1] >= 2**31:
        raise OverflowError("a batch of more than 2 GiB: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return ends.astype(np.int32)


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _masked(array: pa.Array, keep: np.ndarray) -> pa.Array:
    if keep.all():
        return array
    return pa.compute.if_else(pa.array(keep), array, pa.nulls(len(array), array.type))


def _decode_batch(values: pa.Array, contract_name: str, out_type: pa.StructType) -> pa.Array:
    cursor = _Cursor(values)
    everything = np.ones(len(values), bool)
    decoded: dict[str, pa.Array] = {}
    for field, ftype in CONTRACTS[contract_name]:
        name = WIDE_NAME.get(field, field)
        if isinstance(ftype, tuple):
            number = cursor.long(everything)
            known = (number >= 0) & (number < len(ftype))
            cursor.ok &= known
            decoded[name] = pa.array(ftype, pa.string()).take(pa.array(np.where(known, number, 0)))
        elif is_nullable(ftype):
            branch = cursor.long(everything)
            cursor.ok &= (branch == 0) | (branch == 1)
            decoded[name] = cursor.text(branch == 1)
        elif base_type(ftype) == "string":
            decoded[name] = cursor.text(everything)
        else:
            number = cursor.long(everything)
            if base_type(ftype) == "int":
                cursor.ok &= (number >= -(2**31)) & (number < 2**31)
                number = np.where(cursor.ok, number, 0).astype(np.int32)
            decoded[name] = pa.array(number)
    columns = [
        decoded[f.name] if f.name in decoded else pa.nulls(len(values), f.type) for f in out_type
    ]
    return pa.StructArray.from_arrays(
        columns, fields=list(out_type), mask=pa.array(~cursor.ok)
    )


def _flat(array) -> pa.Array:
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def _by_writer(writers: pa.Array, out_type: pa.DataType, work) -> pa.Array:
    """Apply ``work`` to the rows of each contract and put the results back in row order.

    Rows without a contract become NULL.
    """
    coded = _flat(writers).dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    pieces, order = [], []
    for code, name in enumerate(coded.dictionary.to_pylist()):
        rows = np.flatnonzero(codes == code)
        pieces.append(work(name, rows))
        order.append(rows)
    rest = np.flatnonzero(codes < 0)
    pieces.append(pa.nulls(len(rest), out_type))
    order.append(rest)
    back = np.argsort(np.concatenate(order), kind="stable")
    return pa.concat_arrays(pieces).take(pa.array(back))


def decode_values(values: pa.Array, writers: pa.Array) -> pa.Array:
    values, out_type = _flat(values).cast(pa.binary()), to_arrow_type(EVENT_FIELDS)
    return _by_writer(
        writers, out_type, lambda name, at: _decode_batch(values.take(pa.array(at)), name, out_type)
    )


def _varint_piece(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zig-zag bytes of all numbers end to end, and how many belong to each."""
    bits = ((number << 1) ^ (number >> 63)).view(np.uint64)
    if not len(bits):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    # As many groups of 7 bits as the largest number has, one for most texts.
    groups = max(1, -(-int(bits.max()).bit_length() // 7))
    if groups == 1:
        return bits.astype(np.uint8), np.ones(len(bits), np.int64)
    shifts = np.arange(groups, dtype=np.uint64) * np.uint64(7)
    rest = bits[:, None] >> shifts
    used = rest != 0
    used[:, 0] = True
    more = np.zeros_like(used)
    more[:, :-1] = used[:, 1:]
    coded = ((rest & np.uint64(0x7F)) | (more.astype(np.uint64) << np.uint64(7))).astype(np.uint8)
    return coded[used], used.sum(axis=1)


def _text_piece(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = text.fill_null("").cast(pa.binary())
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    if raw.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.diff(ends)
    return np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def _join_pieces(pieces: list[tuple[np.ndarray, np.ndarray]], ok: np.ndarray) -> pa.Array:
    """Lay the pieces of every row next to each other."""
    sizes = np.stack([size for _, size in pieces])
    row_ends = np.concatenate(([0], np.cumsum(sizes.sum(axis=0))))
    out = np.empty(row_ends[-1], np.uint8)
    start = row_ends[:-1].copy()
    for data, size in pieces:
        piece_start = np.cumsum(size) - size
        out[np.repeat(start - piece_start, size) + np.arange(len(data))] = data
        start += size
    buffers = [None, pa.py_buffer(_offsets(row_ends)), pa.py_buffer(out)]
    return _masked(pa.Array.from_buffers(pa.binary(), len(ok), buffers), ok)


def _encode_batch(rows: pa.StructArray, ids: np.ndarray, contract_name: str) -> pa.Array:
    ok = np.ones(len(rows), bool)
    head = np.zeros((len(rows), WIRE_HEADER_BYTES), np.uint8)
    for i in range(1, WIRE_HEADER_BYTES):
        head[:, i] = (ids >> (8 * (WIRE_HEADER_BYTES - 1 - i))) & 0xFF
    pieces = [(head.ravel(), np.full(len(rows), WIRE_HEADER_BYTES))]

    def add_text(text: pa.Array) -> None:
        data, size = _text_piece(text)
        pieces.append(_varint_piece(size.astype(np.int64)))
        pieces.append((data, size))

    for field, ftype in CONTRACTS[contract_name]:
        column = rows.field(WIDE_NAME.get(field, field))
        present = column.is_valid().to_numpy(zero_copy_only=False)
        if is_nullable(ftype):
            pieces.append(_varint_piece(present.astype(np.int64)))
            data, size = _text_piece(column)
            prefix, width = _varint_piece(size.astype(np.int64))
            pieces.append((prefix[np.repeat(present, width)], np.where(present, width, 0)))
            pieces.append((data, size))
            continue
        ok &= present
        if isinstance(ftype, tuple):
            number = pa.compute.index_in(column, pa.array(ftype)).fill_null(-1).to_numpy()
            ok &= number >= 0
            pieces.append(_varint_piece(number.astype(np.int64)))
        elif base_type(ftype) == "string":
            add_text(column)
        else:
            pieces.append(_varint_piece(column.fill_null(0).to_numpy().astype(np.int64)))
    return _join_pieces(pieces, ok)


def encode_rows(rows: pa.Array, writers: pa.Array, ids: pa.Array) -> pa.Array:
    rows, numbers = _flat(rows), _flat(ids).to_numpy()
    return _by_writer(
        writers, pa.binary(), lambda name, at: _encode_batch(rows.take(pa.array(at)), numbers[at], name)
    )
