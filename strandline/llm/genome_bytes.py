"""Array helpers that run inside tasks on batches of FASTA bytes: parsing, winnowing, alignment."""

from __future__ import annotations

import hashlib

import numpy as np

NO_HASH = np.int64(0x7FFFFFFFFFFFFFFF)

# Complement of each IUPAC base letter.
_COMPLEMENT = bytes.maketrans(b"ACGTURYKMBVDHSWN", b"TGCAAYRMKVBHDSWN")

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _i


def parse_batch(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bases of many FASTA texts at once.

    Returns upper-case base bytes of all texts, the offset of each text in them (one more than texts),
    and for every record that has bases its start and its text. Letters of lines that do not begin with
    ``>`` are bases; everything else is dropped.
    """
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(sizes)
    breaks = (raw == 10) | (raw == 13)
    starts = np.empty(len(raw), bool)
    starts[0] = True
    starts[1:] = breaks[:-1]
    first = np.flatnonzero(starts)
    header = raw[first] == 62
    in_header = np.repeat(header, np.diff(np.append(first, len(raw))))
    lower = raw | 32
    keep = (lower >= 97) & (lower <= 122) & ~in_header
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    bases = raw[keep] & 0xDF
    offsets = np.append(0, at[ends])
    heads = np.union1d(first[header], np.append(0, ends[:-1]))
    record_at = np.unique(at[heads])
    record_at = record_at[record_at < len(bases)]
    return bases, offsets, record_at, np.searchsorted(offsets, record_at, side="right") - 1


def reverse_complement(seq: bytes) -> bytes:
    """The other strand, upper case."""
    return seq.translate(_COMPLEMENT)[::-1]


def content_key(bases: np.ndarray, start: int, end: int, record_starts: np.ndarray) -> int:
    """Key of a file's bases that neither order nor strand of its records changes (signed 64 bits)."""
    total = 0
    for a, b in zip(record_starts, np.append(record_starts[1:], end)):
        seq = bases[a:b].tobytes()
        digest = hashlib.blake2b(min(seq, reverse_complement(seq)), digest_size=8).digest()
        total += int.from_bytes(digest, "little")
    total = (total + int(end - start)) & 0xFFFFFFFFFFFFFFFF
    return total - (1 << 64) if total >> 63 else total


def _codes(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-bit codes of every window of k bases, of its reverse complement, and where a window holds only ACGT."""
    c = _CODE[bases]
    bad = np.zeros(len(c) + 1, np.int32)
    np.cumsum(c > 3, out=bad[1:])
    kind = np.uint32 if k <= 16 else np.uint64
    fwd = (c & 3).astype(kind)
    rev = fwd ^ kind(3)
    width, f, r = 1, fwd, rev
    # f covers `width` bases from each place; doubling and adding a remainder reach k
    for bit in bin(k)[3:]:
        f, r = (f[:-width] << kind(2 * width)) | f[width:], (r[width:] << kind(2 * width)) | r[:-width]
        width *= 2
        if bit == "1":
            n = len(f) - 1
            f = (f[:n] << kind(2)) | fwd[width : width + n]
            r = (rev[width : width + n] << kind(2 * width)) | r[:n]
            width += 1
    return f, r, bad[k:] == bad[: len(bad) - k]


def _spaced(bases: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _codes, of the bases at the places of a shape that reads the same from both ends."""
    c = _CODE[bases]
    n, half = len(c) - shape[-1], len(shape) // 2
    digits = (c & 3).astype(np.uint32)
    parts, off = [], np.zeros(n, bool)
    for places in (shape[:half], shape[half:]):
        code = np.zeros(n, np.uint32)
        for p in places:
            code <<= np.uint32(2)
            code |= digits[p : p + n]
        parts.append(code)
    wrong = c > 3
    for p in shape if wrong.any() else ():
        off |= wrong[p : p + n]
    width = 2 * len(shape)
    f = (parts[0].astype(np.uint64) << np.uint64(2 * (len(shape) - half))) | parts[1]
    # the other strand reads the same places backwards: complement all digits and turn their order round
    r = f ^ np.uint64((1 << width) - 1)
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        r = ((r >> np.uint64(bits)) & np.uint64(mask)) | ((r & np.uint64(mask)) << np.uint64(bits))
    return f, r.byteswap() >> np.uint64(64 - width), ~off


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread codes over 63 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return (x >> np.uint64(1)).astype(np.int64)


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best over x[i:i+w] for every i; doubling keeps it at log2(w) passes."""
    width = 1
    while width * 2 <= w:
        x = best(x[:-width], x[width:])
        width *= 2
    if width < w:
        x = best(x[: len(x) - (w - width)], x[w - width :])
    return x


def winnow(bases: np.ndarray, offsets: np.ndarray, seed: int | tuple[int, ...], windows: int | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed strand-neutral seeds of many sequences laid end to end.

    A seed is `seed` bases in a row, or the bases at the places of a shape that reads the same from both ends. Returns
    hash, sequence number, place of the seed in its sequence and whether the other strand's code was the smaller, by
    sequence and place. Of every w neighbouring seeds the smallest hash is chosen, so two sequences with w + span - 1
    equal bases in a row share a choice. w may differ between sequences: what a wide window chooses, a narrow one chooses too.
    """
    none = np.zeros(0, np.int64)
    span = seed if isinstance(seed, int) else seed[-1] + 1
    if len(bases) < span:
        return none, none, none, none.astype(bool)
    f, r, good = _codes(bases, seed) if isinstance(seed, int) else _spaced(bases, seed)
    h = np.where(good, _mix(np.minimum(f, r).astype(np.uint64)) >> 21, NO_HASH)  # 42 bits, as a seed of 20 bases has no more
    every = np.maximum(np.diff(offsets) - span + 1, 0)
    windows = np.broadcast_to(windows, every.shape)
    parts = []
    for w in np.unique(windows[every > 0]):
        files = np.flatnonzero((windows == w) & (every > 0))
        gap, count = int(w) - 1, every[files]
        # files are set w - 1 places apart, so no window spans two of them
        moved = np.append(0, np.cumsum(count + gap))
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        spread = np.full(moved[-1] + gap, NO_HASH)
        spread[inner + np.repeat(moved[:-1] + gap, count)] = h[inner + np.repeat(offsets[:-1][files], count)]
        top = _sliding(_sliding(spread, int(w), np.minimum), int(w), np.maximum)
        chosen = np.flatnonzero((top == spread[gap : gap + len(top)]) & (top != NO_HASH)) + gap
        at = np.searchsorted(moved + gap, chosen, side="right") - 1
        parts.append((spread[chosen], files[at], chosen - (moved + gap)[at]))
    if not parts:
        return none, none, none, none.astype(bool)
    chosen, seq, place = (np.concatenate(x) for x in zip(*parts))
    by = np.lexsort((place, seq))
    chosen, seq, place = chosen[by], seq[by], place[by]
    at = offsets[seq] + place
    return chosen, seq, place, r[at] < f[at]


def _mark(a: np.ndarray, b: np.ndarray, diagonal: int, lo: int, hi: int, hit: np.ndarray, window: int, least: int) -> None:
    """Mark in hit the places of a in [lo, hi) that equal b on this diagonal inside a dense window."""
    lo, hi = max(lo, diagonal, 0), min(hi, len(a), len(b) + diagonal)
    if hi - lo < window:
        return
    same = a[lo:hi] == b[lo - diagonal : hi - diagonal]
    count = np.zeros(len(same) + 1, np.int32)
    np.cumsum(same, out=count[1:])
    dense = (count[window:] - count[:-window]) >= least
    edge = np.zeros(len(same) + 1, np.int32)
    at = np.flatnonzero(dense)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    hit[lo:hi] |= same & (np.cumsum(edge[:-1]) > 0)


def coverage(a: np.ndarray, b: np.ndarray, seed: int | None = None, window: int = 24, least: int = 17, reach: int = 64) -> int:
    """Number of bases of a that also stand in b, base for base, on either strand.

    Exact seeds of 11 bases, and more in files of millions so that chance hits stay in proportion to them, are chained on their diagonals; each chain is extended
    base by base over `reach` bases to both sides, and equal bases count inside windows that are dense in matches.
    """
    seed = seed or min(max(11, int(np.log2(len(b) + 1) / 2) + 1), 16)
    hit = np.zeros(len(a), bool)
    if len(a) < window or len(b) < window:
        return len(a) if a.tobytes() in b.tobytes() or reverse_complement(a.tobytes()) in b.tobytes() else 0
    for flip in (False, True):
        t = np.frombuffer(reverse_complement(b.tobytes()), np.uint8) if flip else b
        fa, _, ga = _codes(a, seed)
        fb, _, gb = _codes(t, seed)
        order = np.argsort(fb, kind="stable")
        order = order[gb[order]]
        keys = fb[order]
        pa = np.flatnonzero(ga)
        left, right = np.searchsorted(keys, fa[pa], "left"), np.searchsorted(keys, fa[pa], "right")
        n = right - left
        if not n.sum():
            continue
        qa = np.repeat(pa, n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        qb = order[np.repeat(left, n) + inner]
        d = qa - qb
        by = np.lexsort((qa, d))
        d, qa = d[by], qa[by]
        # a chain: seeds of one diagonal no more than `reach` apart
        new = np.flatnonzero(np.append(True, (np.diff(d) != 0) | (np.diff(qa) > reach)))
        stop = np.append(new[1:], len(d))
        if n.sum() >= 64:
            several = stop - new > 1
            new, stop = new[several], stop[several]
        for s, e in zip(new, stop):
            _mark(a, t, int(d[s]), int(qa[s]) - reach, int(qa[e - 1]) + seed + reach, hit, window, least)
    return int(hit.sum())
