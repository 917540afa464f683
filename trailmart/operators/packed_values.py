"""Split a field that packs several values into one row per value.

The text is scanned as Arrow string buffers: the UTF-8 bytes of a whole batch are decoded
once into code points, and every later step (delimiter masks, quote spans, trimming,
child offsets) is a NumPy operation over the batch. No value becomes a Python string.

Rules
* Delimiters are the signs in ``DELIMITERS``, tab, line break, two or more colons, and a
  hyphen with white space (or an end of the field) on both sides; they may be mixed within one field.
* A quote opens only at the start of a value. The first matching close ends it (in double
  quotes a doubled quote is one quote character). An opening quote without a close is text.
  If text follows a closing quote, the value keeps its quotes and that text.
* Brackets around the whole list are not part of a value, nor is outer white space.
* Empty values do not count, positions start at 0, repeated values stay.

Null, empty and blank fields yield no rows; repeated input rows are split each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.tables import byte_slices

DELIMITERS = "›»>＞→,，、;；|｜/／\t\n\r"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』"}
WRAPS = {"[": "]", "(": ")", "{": "}", "【": "】", "（": "）", "［": "］", "〔": "〕"}
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u000b\u000c\u0085"

_DELIM, _SPACE, _HYPHEN, _COLON = 1, 2, 3, 4
_TABLE = np.zeros(65537, np.uint8)
for _c in DELIMITERS:
    _TABLE[ord(_c)] = _DELIM
for _c in SPACES:
    _TABLE[ord(_c)] = _SPACE
_TABLE[ord("-")] = _HYPHEN
_TABLE[ord(":")] = _COLON
_WHITE = np.zeros(65537, bool)
for _c in SPACES + "\t\n\r":
    _WHITE[ord(_c)] = True


def _decode(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point (beyond the BMP: 65536) and first byte of each character of UTF-8 data."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[start].astype(np.uint32)
    pad = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32) & 0x3F
    b1, b2 = pad[start + 1], pad[start + 2]
    cp = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 0x1F) << 6 | b1, np.where(lead < 0xF0, (lead & 0x0F) << 12 | b1 << 6 | b2, 65536)))
    return cp, start


def _last_true(mask: np.ndarray) -> np.ndarray:
    """For each place, the last place before it (exclusive) where mask holds, else -1."""
    at = np.where(mask, np.arange(len(mask)), -1)
    return np.concatenate([[-1], np.maximum.accumulate(at)[:-1]]) if len(at) else at


def _closers(cp: np.ndarray, row: np.ndarray, openers: np.ndarray, row_end: np.ndarray) -> np.ndarray:
    """The place of each opener's closing quote, or -1."""
    out = np.full(len(openers), -1, np.int64)
    for left, right in QUOTES.items():
        of = np.flatnonzero(cp[openers] == ord(left))
        if not len(of):
            continue
        at = openers[of]
        ends = np.flatnonzero(cp == ord(right))
        if left == '"':
            # runs of quotes: after the opener an even rest of its run is doubled quotes
            gap = (np.diff(ends) > 1) | (np.diff(row[ends]) > 0)
            first, last = ends[np.r_[True, gap]], ends[np.r_[gap, True]]
            own = last[np.searchsorted(first, at, "right") - 1]
            odd = last[(last - first + 1) % 2 == 1]
            k = np.searchsorted(odd, own, "right")
            later = np.r_[odd, len(cp)][k]
            close = np.where((own - at) % 2 == 1, own, later)
        else:
            close = np.r_[ends, len(cp)][np.searchsorted(ends, at, "right")]
        out[of] = np.where(close < row_end[of], close, -1)
    return out


def split_buffers(column: pa.Array) -> pa.ListArray:
    """The list of values of each text of an Arrow string array."""
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    empty = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))
    if not n:
        return empty
    if column.null_count:
        column = pc.fill_null(column, "")
    byte_at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    if byte_at[-1] == byte_at[0]:
        return empty
    data = np.frombuffer(column.buffers()[2], np.uint8)[byte_at[0] : byte_at[-1]]
    cp, start = _decode(data)
    m = len(cp)
    bounds = np.searchsorted(start, byte_at - byte_at[0])  # first character of each row, and the end
    row = np.repeat(np.arange(n), np.diff(bounds))
    kind, white = _TABLE[cp], _WHITE[cp]
    place = np.arange(m)

    delim = kind == _DELIM
    colon = kind == _COLON
    if colon.any():
        pair = colon[:-1] & colon[1:] & (row[:-1] == row[1:])
        delim[:-1] |= pair
        delim[1:] |= pair
    hyphen = np.flatnonzero(kind == _HYPHEN)
    if len(hyphen):
        before = (hyphen == bounds[row[hyphen]]) | white[hyphen - 1]
        after = (hyphen + 1 == bounds[row[hyphen] + 1]) | white[np.minimum(hyphen + 1, m - 1)]
        delim[hyphen[before & after]] = True

    # marks around the whole list behave like delimiters, as empty values do not count
    solid = np.flatnonzero(~white)
    if len(solid):
        lead = solid[np.r_[True, row[solid][1:] != row[solid][:-1]]]
        tail = solid[np.r_[row[solid][1:] != row[solid][:-1], True]]
        for left, right in WRAPS.items():
            both = (cp[lead] == ord(left)) & (cp[tail] == ord(right)) & (lead < tail)
            if both.any():
                used = np.bincount(row[(cp == ord(left)) | (cp == ord(right))], minlength=n)
                both &= used[row[lead]] == 2
                delim[lead[both]] = delim[tail[both]] = True

    # quotes at the start of a value
    blank = white & ~delim
    prior = _last_true(~blank)
    is_open = np.isin(cp, [ord(c) for c in QUOTES])
    at_start = (prior < bounds[row]) | delim[np.maximum(prior, 0)]
    openers = np.flatnonzero(is_open & at_start)
    closers = _closers(cp, row, openers, bounds[row[openers] + 1])
    taken = np.zeros(len(openers), bool)
    cursor, active = bounds[:-1].copy(), np.unique(row[openers]) if len(openers) else np.array([], np.int64)
    while len(active):  # one quoted value of every row a round
        k = np.searchsorted(openers, cursor[active])
        fits = k < len(openers)
        active, k = active[fits], k[fits]
        fits = row[openers[k]] == active
        active, k = active[fits], k[fits]
        closed = closers[k] >= 0
        taken[k[closed]] = True
        cursor[active] = np.where(closed, closers[k], openers[k]) + 1
    opened, closed = openers[taken], closers[taken]
    depth = np.zeros(m + 1, np.int32)
    depth[opened] += 1
    depth[closed + 1] -= 1
    inside = np.cumsum(depth)[:m] > 0
    delim &= ~inside

    # values: between delimiters and row bounds, trimmed
    cuts = np.flatnonzero(delim)
    left = np.concatenate([bounds[:-1], cuts + 1])
    owner = np.concatenate([np.arange(n), row[cuts]])
    order = np.lexsort((left, owner))
    left, owner = left[order], owner[order]
    right = np.where(np.r_[owner[1:] == owner[:-1], False], np.r_[left[1:] - 1, 0], bounds[owner + 1])
    next_solid = np.r_[np.minimum.accumulate(np.where(white, m, place)[::-1])[::-1], m]  # m: none
    last_solid = np.r_[-1, np.maximum.accumulate(np.where(white, -1, place))]  # before place i
    trim = lambda a, b: (np.minimum(next_solid[a], b), np.maximum(last_solid[b] + 1, np.minimum(next_solid[a], b)))
    left, right = trim(left, right)
    close_of = np.full(m + 1, -1, np.int64)
    close_of[opened] = closed
    quoted = (close_of[left] == right - 1) & (right - left >= 2)
    doubled = quoted & (cp[np.minimum(left, m - 1)] == ord('"'))
    inner = trim(np.minimum(left + 1, m), np.minimum(np.maximum(right - 1, left + 1), m))
    left, right = np.where(quoted, inner[0], left), np.where(quoted, inner[1], right)
    keep = right > left
    left, right, owner, doubled = left[keep], right[keep], owner[keep], doubled[keep]

    # characters of the values; of a doubled quote one is left out
    step = np.zeros(m + 1, np.int32)
    np.add.at(step, left, 1)
    np.add.at(step, right, -1)
    used = np.cumsum(step)[:m] > 0
    if doubled.any():
        mark = np.zeros(m + 1, np.int32)
        np.add.at(mark, left[doubled], 1)
        np.add.at(mark, right[doubled], -1)
        quote = np.flatnonzero((np.cumsum(mark)[:m] > 0) & (cp == ord('"')))
        if len(quote):
            head = np.r_[True, np.diff(quote) > 1]
            base = np.maximum.accumulate(np.where(head, np.arange(len(quote)), 0))
            used[quote[(np.arange(len(quote)) - base) % 2 == 1]] = False
    width = np.diff(np.r_[start, len(data)])
    size = np.where(used, width, 0)
    total = np.r_[0, np.cumsum(size)]
    offsets = np.r_[total[left], total[-1]].astype(np.int32)
    body = data[np.repeat(used, width)]
    values = pa.StringArray.from_buffers(len(left), pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes()))
    counts = np.bincount(owner, minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)


def split_packed(df: DataFrame, column: str, keep: Sequence[str], pos: str = "pos", value: str = "segment") -> DataFrame:
    """One row per value of ``column``, with the ``keep`` columns, the position and the value.

    ``keep`` may be any columns of ``df``; the two output names must not be among them.
    The work is a single map over the scan: no shuffle, whatever the skew.
    """
    if {pos, value} & set(keep):
        raise ValueError("an output column has the name of a kept column")
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(pos, T.IntegerType(), False), T.StructField(value, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in byte_slices(whole, whole.num_columns - 1)):
            lists = split_buffers(batch.column(batch.num_columns - 1))
            parent = pc.list_parent_indices(lists)
            at = np.arange(len(parent), dtype=np.int64) - np.asarray(lists.offsets)[np.asarray(parent)]
            columns = [batch.column(i).take(parent) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at.astype(np.int32)), lists.flatten()], names=[*keep, pos, value])

    return df.select(*keep, df[column].alias("__packed")).mapInArrow(run, schema)
