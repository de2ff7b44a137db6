"""Windows of sequences in Arrow tasks: a batch's letters are one array, worked on in spans of bounded size.

A row at a time, Spark's own expressions take microseconds for each window; on arrays these are nanoseconds. Letters are
bytes where a batch is ASCII, else code points; both have the same hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Letters that are worked on at once.
SPAN = 1 << 18
#: The same for counts of k-mers, of which there are few different ones.
COUNT_SPAN = 1 << 22
_N = ord("N")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letter_hashes(codes: np.ndarray) -> np.ndarray:
    return _mixed((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


_BYTES = _letter_hashes(np.arange(256, dtype=np.uint8))


def letters_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all rows, offsets of rows); nulls are empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends, data = column.buffers()[1], column.buffers()[2]
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    codes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    if len(codes) and codes.max() > 127:
        n = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.frombuffer(codes.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(n)])
    return codes, offsets - offsets[0]


def cut(codes: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, pa.Array]:
    """Letters (a row each) and strings of the windows at these places."""
    rows = codes[at[:, None] + np.arange(length)]
    if rows.dtype != np.uint8:
        return rows, pa.array([r.tobytes().decode("utf-32-le") for r in rows], pa.string())
    ends = np.arange(len(at) + 1, dtype=np.int32) * np.int32(length)
    return rows, pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows)))


def strings(codes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of letters as strings."""
    if codes.dtype != np.uint8:
        return pa.array([codes[a:z].tobytes().decode("utf-32-le") for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())
    if len(codes) > np.iinfo(np.int32).max:
        raise ValueError("a batch of over 2 GB; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(codes)))


class Hashes:
    """64-bit hashes of all windows of some letters, by doubling; alike windows have alike ones."""

    def __init__(self, codes: np.ndarray) -> None:
        self.levels = [_BYTES[codes] if codes.dtype == np.uint8 else _letter_hashes(codes)]

    def of(self, k: int) -> np.ndarray:
        top = k.bit_length() - 1
        while len(self.levels) <= top:
            w, h = 1 << (len(self.levels) - 1), self.levels[-1]
            # a polynomial of the letters: each place has a factor of its own
            self.levels.append(h[: max(0, len(h) - w)] * np.uint64(pow(0x9E3779B97F4A7C15, w, 1 << 64)) + h[w:])
        w, h = 1 << top, self.levels[top]
        n = max(0, len(self.levels[0]) - k + 1)
        # hashed by both ends, which overlap
        x = h[:n] * np.uint64(0xD6E8FEB86659FD93) + h[k - w : k - w + n]
        return x ^ (x >> np.uint64(32))


def hash_of(text: str) -> int:
    return int(Hashes(letters_of(pa.array([text]))[0]).of(len(text))[0])


class Wanted:
    """A set of hashes, asked by arrays: first by a table of their leading bits, then exactly."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes.astype(np.uint64))
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes, "table": None}

    def places(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that are in the set."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        bits = min(24, max(12, len(self.hashes).bit_length() + 4))
        key = lambda x: ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)
        if self.table is None:
            self.table = np.zeros(1 << bits, bool)
            self.table[key(self.hashes)] = True
        some = np.flatnonzero(self.table[key(h)])
        at = np.searchsorted(self.hashes, h[some])
        return some[self.hashes[np.minimum(at, len(self.hashes) - 1)] == h[some]]


def _rows_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, "right") - 1


def _batch(b: pa.RecordBatch, keys: Sequence[str], rows: np.ndarray, more: dict[str, pa.Array]) -> pa.RecordBatch:
    idx = pa.array(rows)
    return pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)).take(idx) for c in keys], *more.values()], names=[*keys, *more])


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


_DNA = np.full(256, _N, np.uint8)
_DNA[ord("a") : ord("z") + 1] = np.frombuffer(b"ACGT" * 6 + b"AC", np.uint8)
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"TGCA", np.uint8)


def spelling(keys: Sequence[str], text: str) -> Run:
    """(keys, seq): lower-case texts as ``sequences.dna_of_text`` has them; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, offsets = letters_of(b.column(b.schema.get_field_index(text)))
            blank = np.flatnonzero(codes == ord(" "))
            # a blank behind a full stop in its row ends a sentence, others go
            row = _rows_of(offsets, blank)
            ends = (blank > offsets[row]) & (codes[np.maximum(blank - 1, 0)] == ord(".")) if len(blank) else np.zeros(0, bool)
            gone = blank[~ends]
            dna = np.delete(_DNA[codes if codes.dtype == np.uint8 else np.minimum(codes, 255)], gone)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keys], strings(dna, offsets - np.searchsorted(gone, offsets))], names=[*keys, "seq"])

    return run


def stranded(names: Sequence[str]) -> Run:
    """Rows with rc, once as they are and once with seq reverse-complemented."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("seq")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.zeros(len(b), bool))], names=[*names, "rc"])
            codes, offsets = letters_of(b.column(at))
            turned = codes[::-1]
            turned = _COMPLEMENT[turned] if codes.dtype == np.uint8 else np.where(turned < 256, _COMPLEMENT[np.minimum(turned, 255)], turned)
            seq = strings(turned, offsets[-1] - offsets[::-1])
            if b.column(at).null_count:
                seq = pc.if_else(b.column(at).is_valid().take(pa.array(np.arange(len(b))[::-1].copy())), seq, None)
            other = b.take(pa.array(np.arange(len(b))[::-1].copy()))
            columns = [seq if i == at else c for i, c in enumerate(other.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.ones(len(b), bool))], names=[*names, "rc"])

    return run


def hashing(keys: Sequence[str], text: str) -> Run:
    """(keys, h, k): the hash of each text and its length; null and empty ones have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, offsets = letters_of(b.column(b.schema.get_field_index(text)))
            n = np.diff(offsets)
            for k in np.unique(n[n > 0]).tolist():
                rows = np.flatnonzero(n == k)
                for a in range(0, len(rows), max(1, SPAN // k)):
                    some = rows[a : a + max(1, SPAN // k)]
                    flat = codes[(offsets[some][:, None] + np.arange(k)).ravel()]
                    h = Hashes(flat).of(k)[::k]
                    yield _batch(b, keys, some, {"h": pa.array(h.view(np.int64)), "k": pa.array(np.full(len(some), k, np.int32))})

    return run


def windowing(keys: Sequence[str], blocks: Sequence[tuple[int, int, int]], wanted: Sequence[Wanted] | None, once: bool = False) -> Run:
    """(keys, b, start, window) of all windows whose block is wanted: (length, start, size) of each kind of block b, with its set of hashes.

    With no sets, every window is given for each kind of block. With ``once`` blocks have one length, and a window is
    given once if any of its blocks is wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = max(length for length, _, _ in blocks)
        for b in batches:
            codes, offsets = letters_of(b.column(b.schema.get_field_index("seq")))
            for c in range(0, len(codes), SPAN):
                part = codes[c : c + SPAN + reach - 1]
                hashes = Hashes(part)
                found = []
                for length, a, k in blocks:
                    m = max(0, min(SPAN, len(part) - length + 1))
                    found.append(np.arange(m) if wanted is None or not m else wanted[len(found)].places(hashes.of(k)[a : a + m]))
                for i, at in enumerate([np.unique(np.concatenate(found))] if once else found):
                    length = blocks[i][0]
                    rows = _rows_of(offsets, at + c)
                    inside = at + c + length <= offsets[rows + 1] if len(at) else np.zeros(0, bool)
                    at, rows = at[inside] + c, rows[inside]
                    if len(at):
                        start = pa.array((at - offsets[rows]).astype(np.int32))
                        yield _batch(b, keys, rows, {"b": pa.array(np.full(len(at), i, np.int32)), "start": start, "window": cut(codes, at, length)[1]})

    return run


class Seeds:
    """An index of k-mers of probes in arrays: which places have a probe that may be alike.

    kmer (hash), pos and probe are those of the index's rows. ``equal`` tells, for the lesser length of probe and sequence, how many letters of a probe must be
    those of the sequence where its k-mer is put on a place.
    """

    def __init__(self, kmer: np.ndarray, pos: np.ndarray, probe: pa.Array, equal: Callable[[np.ndarray], np.ndarray]) -> None:
        order = np.argsort(kmer, kind="stable")
        self.kmers, first = np.unique(kmer[order], return_index=True)
        self.ends = np.append(first, len(kmer))
        codes, offsets = letters_of(probe)
        self.sizes, self.width, self.equal = np.diff(offsets)[order], int(np.diff(offsets).max(initial=1)), equal
        # each probe from any letter on is a row of ``width`` letters of this array, with 0 behind its end
        self.letters = np.zeros(len(probe) * 2 * self.width, codes.dtype)
        row = np.repeat(np.arange(len(probe)), np.diff(offsets))
        self.letters[row * 2 * self.width + np.arange(len(codes)) - offsets[row]] = codes
        self.starts, self.pos = order * 2 * self.width, pos[order]

    def alike(self, codes: np.ndarray, offsets: np.ndarray, at: np.ndarray, rows: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Whether places (with the row and the hash of each) have a probe with as many equal letters."""
        out = np.zeros(len(at), bool)
        slot = np.searchsorted(self.kmers, h)
        n = self.ends[slot + 1] - self.ends[slot]
        sums, z = np.cumsum(n), 0
        while z < len(at):
            a = z
            z = max(a + 1, int(np.searchsorted(sums, sums[a] + 16 * SPAN // self.width)))
            place = np.repeat(np.arange(a, z), n[a:z])
            x = np.arange(len(place)) - np.repeat(np.cumsum(n[a:z]) - n[a:z], n[a:z]) + self.ends[slot[place]]
            begin, end = offsets[rows[place]], offsets[rows[place] + 1]
            left = np.maximum(at[place] - self.pos[x], begin)
            over = left - (at[place] - self.pos[x])
            m = np.minimum(self.sizes[x] - over, end - left)
            low, high = int(left.min()), int(min(left.max() + self.width, len(codes)))
            here = np.concatenate([codes[low:high], np.zeros(self.width, codes.dtype)])
            same = np.lib.stride_tricks.sliding_window_view(here, self.width)[left - low] == np.lib.stride_tricks.sliding_window_view(self.letters, self.width)[self.starts[x] + over]
            many = np.count_nonzero(same, axis=1)
            short = np.flatnonzero(m < self.width)
            many[short] = np.count_nonzero(same[short] & (np.arange(self.width) < m[short, None]), axis=1)
            out[place[many >= self.equal(np.minimum(self.sizes[x], end - begin))]] = True
        return out


def seeding(keys: Sequence[str], k: int, reach: int, wanted: Wanted, seeds: Seeds | None = None) -> Run:
    """(keys, i, n, lead, part) of all places i whose k letters are wanted: the letters around these, ``reach`` on both sides or to the row's ends, and its length n.

    With ``seeds`` only places that are ``alike`` to a probe.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 4 * SPAN // (k + 2 * reach))
        for b in batches:
            codes, offsets = letters_of(b.column(b.schema.get_field_index("seq")))
            for c in range(0, len(codes), SPAN):
                letters = codes[c : c + SPAN + k - 1]
                if len(letters) < k:
                    continue
                h = Hashes(letters).of(k)
                at = c + wanted.places(h)
                rows = _rows_of(offsets, at)
                inside = at + k <= offsets[rows + 1] if len(at) else np.zeros(0, bool)
                at, rows = at[inside], rows[inside]
                if seeds is not None and len(at):
                    some = seeds.alike(codes, offsets, at, rows, h[at - c])
                    at, rows = at[some], rows[some]
                for a in range(0, len(at), step):
                    p, r = at[a : a + step], rows[a : a + step]
                    lo = np.maximum(offsets[r], p - reach)
                    ends = np.concatenate([[0], np.cumsum(np.minimum(offsets[r + 1], p + k + reach) - lo)])
                    flat = np.repeat(lo - ends[:-1], np.diff(ends)) + np.arange(ends[-1])
                    numbers = {"i": p - offsets[r], "n": offsets[r + 1] - offsets[r], "lead": p - lo}
                    yield _batch(b, keys, r, {**{x: pa.array(v.astype(np.int32)) for x, v in numbers.items()}, "part": strings(codes[flat], ends)})

    return run


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Letters of each row, with 0 behind its end."""
    codes, offsets = letters_of(column)
    out = np.zeros((len(column), width), codes.dtype)
    n = np.diff(offsets)
    rows = np.repeat(np.arange(len(n)), n)
    out[rows, np.arange(len(codes)) - offsets[rows]] = codes
    return out


def _has_run(rows: np.ndarray, n_run: int) -> np.ndarray:
    is_n, k = rows == _N, rows.shape[1] - n_run + 1
    if k <= 0:
        return np.zeros(len(rows), bool)
    every = is_n[:, :k].copy()
    for i in range(1, n_run):
        every &= is_n[:, i : i + k]
    return every.any(axis=1)


def tiling(keys: Sequence[str], window: int, stride: int, n_run: int, allow_small: int | None, skip: int | None, flanks: bool) -> Run:
    """(keys, kind, pos, seq) as of ``tiling.candidates``."""

    def small(b: pa.RecordBatch, codes: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = np.diff(offsets)
        for i in np.flatnonzero((n < window) & (n > (-1 if skip is None else skip))).tolist():
            if not allow_small:
                if n[i] > 0:
                    raise ValueError("a sequence is shorter than the window")
                continue
            whole = codes[offsets[i] : offsets[i + 1]]
            if n[i] < allow_small or _has_run(whole[None, :], n_run)[0]:
                raise ValueError("a sequence is too short or has a run of N")
            yield _batch(b, keys, np.array([i]), {"kind": pa.array([0], pa.int32()), "pos": pa.array([0], pa.int32()), "seq": cut(codes, offsets[i : i + 1], int(n[i]))[1]})

    def beside_runs(codes: np.ndarray, offsets: np.ndarray, c: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first letter of each run of N from c to end, and behind the last letter."""
        at = c + np.flatnonzero(codes[c:end] == _N)
        if not len(at):
            return at, at
        rows = _rows_of(offsets, at)
        lo, hi = offsets[rows], offsets[rows + 1]
        is_n = lambda p, inside: inside & (codes[np.clip(p, 0, len(codes) - 1)] == _N)
        first, last = ~is_n(at - 1, at > lo), ~is_n(at + 1, at + 1 < hi)
        for i in range(1, n_run):
            first &= is_n(at + i, at + i < hi)
            last &= is_n(at - i, at - i >= lo)
        return at[first], at[last] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index("seq"))
            if skip is None and not allow_small and column.null_count:
                raise ValueError("a sequence is shorter than the window")
            if column.null_count:
                b = b.filter(column.is_valid())
                column = b.column(b.schema.get_field_index("seq"))
            codes, offsets = letters_of(column)
            yield from small(b, codes, offsets)
            sizes = np.diff(offsets)
            fits = (sizes >= window) & (sizes > (-1 if skip is None else skip))
            for c in range(0, len(codes), SPAN):
                end = min(len(codes), c + SPAN)
                p = np.arange(c, end)
                rows = _rows_of(offsets, p[[0, -1]])
                some = np.arange(rows[0], rows[1] + 1)
                row = np.repeat(some, np.minimum(offsets[some + 1], end) - np.maximum(offsets[some], c))
                rel, n = p - offsets[row], sizes[row]
                found = [(0, p[(rel % stride == 0) & (rel + window <= n)]), (1, p[(rel == n - window) & (n % stride != 0)])]
                if flanks:
                    first, behind = beside_runs(codes, offsets, c, end)
                    left = first[first - offsets[_rows_of(offsets, first)] >= window] - window
                    right = behind[behind + window <= offsets[_rows_of(offsets, behind - 1) + 1]] if len(behind) else behind
                    found += [(2, left), (2, right)]
                at = np.concatenate([x for _, x in found])
                kind = np.repeat(np.array([k for k, _ in found], np.int32), [len(x) for _, x in found])
                owner = _rows_of(offsets, at)
                keep = fits[owner]
                at, kind, owner = at[keep], kind[keep], owner[keep]
                if not len(at):
                    continue
                cells, seq = cut(codes, at, window)
                good = ~_has_run(cells, n_run)
                at, kind, owner = at[good], kind[good], owner[good]
                yield _batch(b, keys, owner, {"kind": pa.array(kind), "pos": pa.array((at - offsets[owner]).astype(np.int32)), "seq": seq.filter(pa.array(good))})

    return run


def counting(k: int) -> Run:
    """(kmer, n): counts of all substrings of k letters, for parts of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, offsets = letters_of(b.column(b.schema.get_field_index("seq")))
            for c in range(0, len(codes), COUNT_SPAN):
                part = codes[c : c + COUNT_SPAN + k - 1]
                m = len(part) - k + 1
                if m <= 0:
                    continue
                # places whose k letters don't end within their row
                over = offsets[1:][(offsets[1:] > c) & (offsets[1:] < c + m + k)]
                out = np.zeros(m + 1, np.int64)
                np.add.at(out, np.clip(over - k + 1 - c, 0, m), 1)
                np.add.at(out, np.clip(over - c, 0, m), -1)
                inside = np.cumsum(out[:m]) == 0
                seen = np.unique(part)
                digit = np.searchsorted(seen, part)
                if len(seen) ** k <= 1 << 22:
                    number = np.zeros(m, np.int64)
                    for i in range(k):
                        number = number * len(seen) + digit[i : i + m]
                    counts = np.bincount(number[inside])
                    ids = np.flatnonzero(counts)
                    n = counts[ids]
                    spelt = seen[np.stack([ids // len(seen) ** (k - 1 - i) % len(seen) for i in range(k)], axis=1)]
                else:
                    spelt, n = np.unique(part[np.flatnonzero(inside)[:, None] + np.arange(k)], axis=0, return_counts=True)
                if len(n):
                    yield pa.RecordBatch.from_arrays([cut(spelt.ravel(), np.arange(len(n)) * k, k)[1], pa.array(n.astype(np.int64))], names=["kmer", "n"])

    return run


# Shifts and added constants of MD5's 64 steps.
_TURNS = [x for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in four * 4]
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
#: Windows whose MD5 is computed at once, so that the arrays stay in the cache.
MD5_ROWS = 1 << 16


def md5_numbers(rows: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of each row of at most 55 bytes, as numbers."""
    n, k = rows.shape
    if k > 55:
        raise ValueError("more than one block of MD5")
    padded_ = np.zeros((n, (k + 4) // 4 * 4), np.uint8)
    padded_[:, :k], padded_[:, k] = rows, 0x80
    words = np.ascontiguousarray(padded_.view("<u4").T)
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(n, x, np.uint32) for x in start)
    for i in range(64):
        if i < 16:
            f, word = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, word = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, word = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, word = c ^ (b | ~d), 7 * i % 16
        f += a
        f += np.uint32((_SINES[i] + (8 * k if word == 14 else 0)) % 2**32)
        if word < len(words):
            f += words[word]
        turned = f << np.uint32(_TURNS[i])
        f >>= np.uint32(32 - _TURNS[i])
        turned |= f
        turned += b
        a, b, c, d = d, turned, b, c
    return (a + np.uint32(start[0])).byteswap()


def sketching(keys: Sequence[str], k: int, n: int, a: int, b: int, prime: int) -> Run:
    """(keys, h): the n smallest of (a x + b) mod prime, repeats counted, over each row's windows; x is the first 32 bits of a window's MD5."""

    def hashes(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        cells = codes[at[:, None] + np.arange(k)]
        if cells.dtype == np.uint8 and k <= 55:
            x = md5_numbers(cells)
        else:
            x = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") for t in cut(codes, at, k)[1].to_pylist()], np.int64)
        return (x.astype(np.int64) * a + b) % prime

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offsets = letters_of(batch.column(batch.schema.get_field_index("seq")))
            least = [np.zeros(0, np.int64)] * len(batch)
            for c in range(0, len(codes), MD5_ROWS):
                at = np.arange(c, min(len(codes), c + MD5_ROWS))
                row = _rows_of(offsets, at)
                inside = at + k <= offsets[row + 1]
                at, row = at[inside], row[inside]
                if not len(at):
                    continue
                h = hashes(codes, at)
                cuts = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
                for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    some = np.concatenate([least[row[p]], h[p:q]])
                    least[row[p]] = np.partition(some, n - 1)[:n] if len(some) > n else some
            ends = np.concatenate([[0], np.cumsum([len(x) for x in least])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *map(np.sort, least)])
            yield _batch(batch, keys, np.arange(len(batch)), {"h": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

    return run


_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def xx_of_ints(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of ints that follow what has these hashes."""
    h = (seed + _P5 + np.uint64(4)) ^ (x.astype(np.uint32).astype(np.uint64) * _P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def filled(codes: np.ndarray, offsets: np.ndarray, limit: int, seed: int) -> np.ndarray:
    """Letters in which rows of more than ``limit`` N have seeded bases at N chosen by a hash of seed, row and place, until ``limit`` are left."""
    at = np.flatnonzero(codes == _N)
    row = _rows_of(offsets, at)
    many = np.bincount(row, minlength=len(offsets) - 1)
    at, row = at[many[row] > limit], row[many[row] > limit]
    if not len(at):
        return codes
    some, of = np.unique(row, return_inverse=True)
    data = codes.tobytes()
    size = codes.dtype.itemsize
    texts = [data[size * a : size * z] for a, z in zip(offsets[some].tolist(), offsets[some + 1].tolist(), strict=True)]
    texts = texts if size == 1 else [t.decode("utf-32-le").encode() for t in texts]
    place = at - offsets[row]

    def hashes(start: int) -> np.ndarray:
        first = int(xx_of_ints(np.array([start]), np.array([42], np.uint64))[0])
        return xx_of_ints(place, np.array([xxhash.xxh64_intdigest(t, first) for t in texts], np.uint64)[of])

    order = np.lexsort((place, hashes(seed).view(np.int64), row))
    first = np.searchsorted(row, some)
    fill = order[np.arange(len(order)) - first[of[order]] < (many[row] - limit)[order]]
    out = codes.copy()
    out[at[fill]] = np.frombuffer(b"ATCG", np.uint8)[(hashes(seed + 1)[fill] & np.uint64(3)).astype(np.int64)]
    return out


def expanding(keys: Sequence[str], text: str = "seq", limit: int | None = None, seed: int = 0) -> Run:
    """(keys, text) with every N as each of A T C G: 4 ** n rows for a text with n of them, in parts of bounded size. With ``limit`` texts with more N are ``filled`` first."""
    bases = np.frombuffer(b"ATCG", np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, offsets = letters_of(b.column(b.schema.get_field_index(text)))
            codes = codes if limit is None else filled(codes, offsets, limit, seed)
            sizes = np.diff(offsets)
            is_n = np.concatenate([[0], np.cumsum(codes == _N)])
            many = is_n[offsets[1:]] - is_n[offsets[:-1]]
            for length, n in np.unique(np.stack([sizes, many], axis=1), axis=0).tolist():
                rows = np.flatnonzero((sizes == length) & (many == n))
                most = max(1, 8 * SPAN // max(1, length))
                step = max(1, most >> 2 * n)
                for a in range(0, len(rows), step):
                    some = rows[a : a + step]
                    cells = codes[offsets[some][:, None] + np.arange(length)]
                    at = np.nonzero(cells == _N)[1].reshape(len(some), n)
                    for first in range(0, 4**n, most):
                        combos = np.arange(first, min(4**n, first + most), dtype=object if n > 31 else np.int64)
                        digits = np.stack([(combos >> 2 * (n - 1 - i) & 3).astype(np.int64) for i in range(n)], axis=1) if n else np.zeros((1, 0), np.int64)
                        out = np.repeat(cells[:, None, :], len(combos), axis=1)
                        out[np.arange(len(some))[:, None, None], np.arange(len(combos))[None, :, None], at[:, None, :]] = bases[digits][None, :, :]
                        ends = np.arange(len(some) * len(combos) + 1) * length
                        yield _batch(b, keys, np.repeat(some, len(combos)), {text: strings(out.ravel(), ends)})

    return run
