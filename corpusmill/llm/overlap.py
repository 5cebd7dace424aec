"""Problem 2: the same or nearly the same records across splits.

Distinct folded texts are the records. Suffixes of all records, cut to ``DEPTH`` characters, form a suffix array that is
partitioned by prefix and built twice, each time as far as it is needed:

1. ``_intervals``: suffixes of training records, equal ones collapsed in the map tasks, are merged with those of
   evaluation records. Neighbours and their common prefixes tell of each place of an evaluation record how many training
   suffixes share its next 3, 4, ... ``DEPTH`` characters.
2. ``_windows``: each evaluation record picks its rarest windows: spans of 3 to ``DEPTH`` characters that have no 3-gram
   in common. A similar text lacks so few of the record's distinct 3-grams (``_missing``) that it must hold some of the
   picked windows whole, as each absent 3-gram spoils one window at most; they are picked so that the rarest suffice.
3. ``_spans``: the suffixes that may start with a picked window are sorted with the windows; the interval below a window
   gives the training records that share the span.
4. ``_covered``: spans are merged per pair of records; pairs that share as many windows as a similar text must are
   compared exactly.

There is no limit on pairs, intervals or records: a text of stock phrases only has frequent windows, and all their
suffixes are paired. What the windows are picked by changes the cost, never the result. Prefixes of more than one
suffix in ``HOT`` are spread over several buckets by training record, and go by 5 characters where 3 do not divide them.

Defined cases: null texts and texts under ``min_chars`` folded characters are never cases; null splits count as
neither; repeated rows count once; null signatures match nothing; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from corpusmill.functions.fold import code_points, fold_many, gram_keys, inside, mix64
from corpusmill.llm import runs
from corpusmill.runtime import Stage, shuffle_partitions

DEPTH = 8  # characters of a suffix that count
LENGTHS = range(3, DEPTH + 1)  # lengths of windows
SPARE = 2  # windows that a pair must share beyond the one that is certain
SIZES = 4  # classes of shorter training texts, each with windows of its own
HOT = 2000
CHUNK = 1_000_000  # suffixes that a map task collapses at a time
MAP_BITS = 26  # size at most of the map of picked windows that training suffixes are checked against
EVAL = ("validation", "test")
_NEVER = 31  # code of a length that would run over the end of the text


def _fold(batches, min_chars: int):
    import hashlib

    import pyarrow as pa

    for batch in batches:
        folded = fold_many(batch.column(3).to_pylist())
        keep = [i for i, t in enumerate(folded) if len(t) >= min_chars]
        short = batch.take(pa.array(keep, pa.int64()))
        digests = [hashlib.blake2b(folded[i].encode("utf-8", "surrogatepass"), digest_size=16).digest() for i in keep]
        yield pa.RecordBatch.from_arrays([*(short.column(j) for j in range(3)), pa.array(digests, pa.binary()), pa.array([folded[i] for i in keep], pa.string())], ["id", "split", "sig", "digest", "text"])


def _set(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def _number(batches):
    import pyarrow as pa
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 40
    for batch in batches:
        sizes = pa.array([len(_set(t)) for t in batch.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + batch.num_rows)), *batch.columns, sizes], ["rec", *batch.schema.names, "n"])
        at += batch.num_rows


def _missing(n, m, threshold: float):
    """How many of its n 3-grams a text may lack in one of m 3-grams that is similar to it."""
    return n - np.ceil(threshold / (1 + threshold) * (n + m) - 1e-6).astype(np.int64)


def _edges(n, threshold: float) -> list:
    """The least number of 3-grams of a training text in each class of sizes: at least as large first, then smaller ones."""
    return [np.ceil(n * x - 1e-6).astype(np.int64) for x in np.linspace(1, threshold, SIZES + 1)]


def _prefixes(texts: list[str]):
    """Code points and offsets of texts, and of every place the next ``DEPTH`` characters in two integers that sort as they do."""
    points, offsets = code_points([t + "\0" * DEPTH for t in texts])
    p = np.minimum(points, 0xFFFF).astype(np.uint64)
    n = max(0, len(p) - DEPTH + 1)
    halves = []
    for start in (0, 4):
        k = np.zeros(n, np.uint64)
        for j in range(start, start + 4):
            k = (k << np.uint64(16)) | p[j : n + j]
        halves.append(k)
    return points, offsets, *halves


def _key(k0, k1, length: int) -> np.ndarray:
    """A key of the first ``length`` characters of a suffix."""
    if length <= 4:
        return mix64((k0 >> np.uint64(64 - 16 * length)) + np.uint64(length << 56))
    return mix64(mix64(k0) ^ (k1 >> np.uint64(128 - 16 * length)) ^ np.uint64(length << 56))


def _places(texts: list[str]):
    """Of every place with 3 characters or more: its prefix, the text's index, and the place in the joined texts."""
    points, offsets, k0, k1 = _prefixes(texts)
    at = np.flatnonzero((k0 >> np.uint64(48) != 0) & (k0 & np.uint64(0xFFFF0000) != 0))
    return k0[at], k1[at], np.searchsorted(offsets, at, side="right") - 1, at, points, offsets


def _count_frequent(batches):
    """Keys of 3 and of 5 characters that are frequent in a chunk, with counts; one frequent over all is so in some chunk."""
    import pyarrow as pa

    held, size = [], 0

    def counted():
        k0, k1 = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        for length in (3, 5):
            key, count = np.unique(_key(k0, k1, length), return_counts=True)
            often = count >= max(16, len(k0) / HOT)
            yield pa.RecordBatch.from_arrays([pa.array(key[often].view(np.int64)), pa.array(count[often])], ["key", "n"])

    for batch in batches:
        if batch.num_rows:
            held.append(_places(batch.column(0).to_pylist())[:2])
            size += len(held[-1][0])
            if size > CHUNK:
                yield from counted()
                held, size = [], 0
    if held:
        yield from counted()


class _Hot:
    """The frequent keys and over how many buckets each is spread: a bounded list, sent with the tasks."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, each: int):
        order = np.argsort(keys)
        self.keys, self.counts, self.each = keys[order], counts[order], each

    def count(self, key: np.ndarray) -> np.ndarray:
        """How often a key occurs, 0 for one that is not frequent."""
        if not len(self.keys):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.counts[at], 0)

    def spread(self, key: np.ndarray) -> np.ndarray:
        """Over how many buckets a key is spread."""
        return np.maximum(1, -(-self.count(key) // self.each))


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x + 1.0)).astype(np.int64)


def _blobs(columns, bucket, side: int):
    import pyarrow as pa

    out = list(runs.scatter(columns, bucket))
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([side] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "side", "blob"])


def _gather(batches, widths: list[int]):
    """Of each bucket the columns of each side, whole."""
    blobs: dict[int, list] = {}
    for batch in batches:
        for b, side, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            blobs.setdefault(b, [[] for _ in widths])[side].append(blob)
    while blobs:
        _, sides = blobs.popitem()
        yield [runs.join(parts, width) for parts, width in zip(sides, widths, strict=True)]


def _send_suffixes(batches, buckets: int, hot: _Hot):
    """Training suffixes, equal ones collapsed with their number, and the places of evaluation records that first hold
    their 3-gram; by bucket of the first 3 characters, of 5 where 3 are frequent."""

    def bucket(k0, k1):
        key = _key(k0, k1, 3)
        return runs.bucket_of(np.where(hot.count(key) > 0, _key(k0, k1, 5), key), buckets)

    held, size = [], 0

    def collapsed():
        k0, k1 = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        order = np.lexsort((k1, k0))
        k0, k1 = k0[order], k1[order]
        first = np.flatnonzero(np.r_[True, (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])])
        count = np.diff(np.r_[first, len(k0)]).astype(np.uint64)
        return _blobs([k0[first], k1[first], count], bucket(k0[first], k1[first]), 0)

    for batch in batches:
        if not batch.num_rows:
            continue
        k0, k1, who, at, points, offsets = _places(batch.column(1).to_pylist())
        held_out, train = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        t = np.flatnonzero(train[who])
        held.append((k0[t], k1[t]))
        size += len(t)
        if size > CHUNK:
            yield collapsed()
            held, size = [], 0
        e = np.flatnonzero(held_out[who])
        if len(e):
            gram = gram_keys(points, 3)[at[e]]
            order = np.lexsort((at[e], gram, who[e]))
            g, w = gram[order], who[e][order]
            e = np.sort(e[order[np.r_[True, (g[1:] != g[:-1]) | (w[1:] != w[:-1])]]])
            rec = batch.column(0).to_numpy().astype(np.uint64)[who[e]]
            yield _blobs([k0[e], k1[e], rec, (at[e] - offsets[who[e]]).astype(np.uint64)], bucket(k0[e], k1[e]), 1)
    if size:
        yield collapsed()


def _intervals(batches, back: int, hot: _Hot):
    """Sorts training and evaluation suffixes of each bucket together and gives of each evaluation suffix how many training
    suffixes share its first 3, 4, ... characters, as the bit length of the number; by bucket of the record."""
    for (a0, a1, count), (b0, b1, rec, pos) in _gather(batches, [3, 4]):
        if not len(rec):
            continue
        k0, k1 = np.r_[a0, b0], np.r_[a1, b1]
        weight = np.r_[count.astype(np.float64), np.zeros(len(rec))]
        order = np.lexsort((k1, k0))
        k0, k1, weight = k0[order], k1[order], weight[order]
        mine = np.flatnonzero(order >= len(a0))  # where the evaluation suffixes lie
        source = order[mine] - len(a0)
        total = np.r_[0.0, np.cumsum(weight)]
        codes = np.zeros(len(mine), np.uint64)
        often = _bit_length(hot.count(_key(k0[mine], k1[mine], 3)))  # such suffixes are not all in this bucket
        for i, length in enumerate(LENGTHS):
            key = k0 >> np.uint64(max(0, 64 - 16 * length))
            cut = np.r_[True, key[1:] != key[:-1]]
            if length > 4:
                deep = k1 >> np.uint64(128 - 16 * length)
                cut |= np.r_[True, deep[1:] != deep[:-1]]
            first = np.flatnonzero(cut)
            sums = np.diff(total[np.r_[first, len(k0)]])
            code = np.minimum(_bit_length(sums), _NEVER - 1)[np.cumsum(cut)[mine] - 1]
            if length < 5:
                code = np.maximum(code, often)
            last = (k0[mine] >> np.uint64(64 - 16 * length) if length <= 4 else k1[mine] >> np.uint64(128 - 16 * length)) & np.uint64(0xFFFF)
            codes |= np.where(last == 0, _NEVER, code).astype(np.uint64) << np.uint64(5 * i)
        r, p = rec[source], pos[source]
        for at in range(0, len(r), CHUNK):
            part = slice(at, at + CHUNK)
            yield _blobs([r[part], p[part] << np.uint64(32) | codes[part]], runs.bucket_of(mix64(r[part]), back), 0)


def _chains(ends: np.ndarray, starts: np.ndarray, last: np.ndarray):
    """Steps from each start to the end of the next window, at all starts at once: ``(chain, window's start, its end)``."""
    chain, cur = np.arange(len(starts)), starts
    out = []
    while len(chain):
        step = ends[cur]
        end = step >> 32
        ok = end <= last[chain]
        chain, end = chain[ok], end[ok]
        out.append((chain, step[ok] & 0xFFFFFFFF, end))
        cur = end
    return (np.concatenate([o[i] for o in out]) for i in range(3)) if out else (np.zeros(0, np.int64),) * 3


def _windows(batches, threshold: float):
    """``(rec, n, picks)``: of each evaluation record the windows picked, as place, length and the classes of sizes they serve.

    For growing numbers of training suffixes, windows of at most that number are laid from left to right, the earliest
    end first, which gives as many as there can be. The first number that gives enough for a class decides it, and of its
    windows the rarest are taken.
    """
    import pyarrow as pa

    for ((rec, packed),) in _gather(batches, [2]):
        if not len(rec):
            continue
        order = np.lexsort((packed, rec))
        rec, packed = rec[order], packed[order]
        pos, size = (packed >> np.uint64(32)).astype(np.int64), len(rec)
        codes = [(packed >> np.uint64(5 * i) & np.uint64(31)).astype(np.int64) for i in range(len(LENGTHS))]
        new = np.r_[True, rec[1:] != rec[:-1]]
        starts = np.flatnonzero(new)
        last = np.r_[starts[1:], size]  # one past each record's last place
        n = last - starts
        gap = np.r_[new[1:] | (pos[1:] != pos[:-1] + 1), True]  # a window must not run over such a place
        reach = np.minimum.accumulate(np.where(gap, np.arange(size), size)[::-1])[::-1]
        needed = [np.minimum(n, _missing(n, least, threshold) + 1 + SPARE) for least in _edges(n, threshold)]
        open_ = [np.ones(len(starts), bool) for _ in needed]
        taken: list[tuple] = []
        for code in range(_NEVER):
            left = np.flatnonzero(np.logical_or.reduce(open_))
            if not len(left):
                break
            end = np.full(size + 1, 1 << 30, np.int64)
            index = np.arange(size)
            for i in range(len(LENGTHS) - 1, -1, -1):  # the shortest rare enough
                fits = (codes[i] <= code) & (index + i <= reach)
                end[:size] = np.where(fits, index + i + 1, end[:size])
            ends = np.minimum.accumulate(((end << 32) | np.r_[index, 0])[::-1])[::-1]
            chain, begin, stop = _chains(ends, starts[left], last[left])
            found = np.bincount(chain, minlength=len(left))
            length = stop - begin + 2
            weight = np.choose(length - 3, [c[begin] for c in codes])
            order = np.lexsort((begin, weight, chain))
            chain, begin, length = chain[order], begin[order], length[order]
            rank = np.arange(len(chain)) - np.repeat(np.cumsum(found) - found, found)
            for k, need in enumerate(needed):
                done = open_[k][left] & (found >= need[left])
                use = done[chain] & (rank < need[left][chain])
                taken.append((left[chain[use]], pos[begin[use]], length[use], np.full(int(use.sum()), 1 << k)))
                open_[k][left[done]] = False
        who, place, length, mask = (np.concatenate([t[i] for t in taken]) for i in range(4))
        key = place << 4 | length
        order = np.lexsort((key, who))
        who, key, mask = who[order], key[order], mask[order]
        first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (key[1:] != key[:-1])])
        picks = key[first] << 8 | np.bitwise_or.reduceat(mask, first)
        bounds = np.r_[0, np.cumsum(np.bincount(who[first], minlength=len(starts)))]
        yield pa.RecordBatch.from_arrays([pa.array(rec[starts].astype(np.int64)), pa.array(n), pa.array([picks[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["rec", "n", "picks"])


def _picked(batch):
    """Of the windows picked in a batch of ``(rec, text, n, picks)`` the prefixes, lengths, masks, rows and places."""
    _, offsets, k0, k1 = _prefixes(batch.column(1).to_pylist())
    raw = batch.column(3).to_pylist()
    row = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
    pick = np.frombuffer(b"".join(raw), np.int64)
    at = offsets[row] + (pick >> 12)
    return k0[at], k1[at], pick >> 8 & 15, pick & 255, row, pick >> 12


def _mapped(batches, bits: int):
    """Which cells of the map of windows are set: compressed slices of it."""
    import pyarrow as pa
    import zstandard

    seen = np.zeros(1 << bits, bool)
    for batch in batches:
        if batch.num_rows:
            k0, k1, length, *_ = _picked(batch)
            for x in LENGTHS:
                of = length == x
                seen[(_key(k0[of], k1[of], x) >> np.uint64(64 - bits)).astype(np.int64)] = True
    slices = [zstandard.ZstdCompressor(level=1).compress(s.tobytes()) for s in np.packbits(seen).reshape(64, -1)]
    yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array(slices, pa.binary())], ["slice", "bits"])


def _merged_map(batches):
    import pyarrow as pa
    import zstandard

    merged: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            more = np.frombuffer(zstandard.ZstdDecompressor().decompress(bits), np.uint8)
            merged[at] = more | merged[at] if at in merged else more
    yield pa.RecordBatch.from_arrays([pa.array(list(merged), pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(m.tobytes()) for m in merged.values()], pa.binary())], ["slice", "bits"])


def _send_windows(batches, buckets: int, hot: _Hot):
    for batch in batches:
        if not batch.num_rows:
            continue
        k0, k1, length, mask, row, place = _picked(batch)
        key = _key(k0, k1, 3)
        key = np.where((hot.count(key) > 0) & (length > 4), _key(k0, k1, 5), key)
        times = hot.spread(key)
        at = np.repeat(np.arange(len(key)), times)
        salt = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        rec = batch.column(0).to_numpy().astype(np.uint64)[row]
        info = batch.column(2).to_numpy()[row] << 16 | length << 8 | mask
        yield _blobs([k0[at], k1[at], rec[at], info.astype(np.uint64)[at], place.astype(np.uint64)[at]], runs.bucket_of(key[at] + mix64(salt.astype(np.uint64)) * (salt > 0).astype(np.uint64), buckets), 1)


def _send_matching(batches, buckets: int, hot: _Hot, wanted, size: int):
    """Training suffixes that may start with a picked window."""
    import zstandard

    bits = np.zeros(1 << (size - 3), np.uint8).reshape(64, -1)
    for at, part in wanted.value:
        bits[at] = np.frombuffer(zstandard.ZstdDecompressor().decompress(part), np.uint8)
    bits = bits.ravel()
    for batch in batches:
        if not batch.num_rows:
            continue
        k0, k1, who, *_ = _places(batch.column(1).to_pylist())
        hits = []
        for lengths in ((3, 4), (5, 6, 7, 8)):
            hit = np.zeros(len(k0), bool)
            for x in lengths:
                cell = (_key(k0, k1, x) >> np.uint64(64 - size)).astype(np.int64)
                hit |= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
            hits.append(hit)
        rec, n = batch.column(0).to_numpy().astype(np.uint64), batch.column(2).to_numpy().astype(np.uint64)
        key = _key(k0, k1, 3)
        often = hot.count(key) > 0
        # A frequent 3-gram: short windows meet in its own buckets, longer ones in those of 5 characters.
        for use, keys in ((np.flatnonzero(np.where(often, hits[0], hits[0] | hits[1])), key), (np.flatnonzero(often & hits[1]), None)):
            if len(use):
                own = keys[use] if keys is not None else _key(k0[use], k1[use], 5)
                r = rec[who[use]]
                salt = mix64(r) % hot.spread(own).astype(np.uint64)
                yield _blobs([k0[use], k1[use], r, n[who[use]]], runs.bucket_of(own + mix64(salt) * (salt > 0).astype(np.uint64), buckets), 0)


def _place(k0, k1, q0, q1, after: bool) -> np.ndarray:
    """Where each ``(q0, q1)`` would be inserted in the sorted pairs ``(k0, k1)``, before equal ones or after them."""
    low, high = np.zeros(len(q0), np.int64), np.full(len(q0), len(k0), np.int64)
    while (busy := low < high).any():
        mid = (low + high) >> 1
        at = np.minimum(mid, len(k0) - 1)
        less = (k0[at] < q0) | ((k0[at] == q0) & ((k1[at] <= q1) if after else (k1[at] < q1)))
        low, high = np.where(busy & less, mid + 1, low), np.where(busy & ~less, mid, high)
    return low


def _spans(batches, threshold: float, back: int):
    """The training suffixes of the interval below each window, as ``(e, t, place of the window and need)``: a similar pair
    of such sizes shares ``need`` windows or more. By bucket of the pair."""
    for (k0, k1, t, m), (q0, q1, e, info, place) in _gather(batches, [4, 5]):
        if not len(t) or not len(e):
            continue
        order = np.lexsort((k1, k0))
        k0, k1, t, m = k0[order], k1[order], t[order], m[order].astype(np.int64)
        info = info.astype(np.int64)
        n, length, mask = info >> 16, info >> 8 & 255, info & 255
        short = length <= 4
        rest0, rest1 = (np.uint64(1) << (64 - 16 * np.minimum(length, 4)).astype(np.uint64)) - np.uint64(1), (np.uint64(1) << np.where(short, 0, 128 - 16 * length).astype(np.uint64)) - np.uint64(1)
        rest0, rest1 = np.where(short, rest0, 0).astype(np.uint64), np.where(short, np.uint64(0xFFFFFFFFFFFFFFFF), rest1)
        first = _place(k0, k1, q0 & ~rest0, q1 & ~rest1, False)
        times = _place(k0, k1, q0 | rest0, q1 | rest1, True) - first
        edges = np.stack(_edges(n, threshold))
        picked = np.stack([np.minimum(n, _missing(n, least, threshold) + 1 + SPARE) for least in edges])
        ends = np.cumsum(times)
        for at in range(0, int(ends[-1]), CHUNK):  # piece by piece, whatever the size of an interval
            pair = np.arange(at, min(at + CHUNK, int(ends[-1])))
            w = np.searchsorted(ends, pair, side="right")
            j = first[w] + pair - (ends - times)[w]
            kind = (m[j] < edges[:, w]).sum(0)  # the class of sizes
            ok = (kind <= SIZES) & (mask[w] >> kind & 1 > 0) & (m[j] * threshold <= n[w] + 1e-6) & (t[j] != e[w])
            w, j, kind = w[ok], j[ok], kind[ok]
            if len(w):
                need = picked[kind, w] - _missing(n[w], m[j], threshold)
                yield _blobs([e[w], t[j], place[w] << np.uint64(32) | need.astype(np.uint64)], runs.bucket_of(mix64(e[w] ^ mix64(t[j])), back), 0)


def _covered(batches):
    """Merges the spans of each pair and gives those pairs that share as many windows as they need."""
    import pyarrow as pa

    for ((e, t, info),) in _gather(batches, [3]):
        order = np.lexsort((info, t, e))
        e, t, info = e[order], t[order], info[order]
        new = np.r_[True, (e[1:] != e[:-1]) | (t[1:] != t[:-1])]
        span = new | np.r_[True, info[1:] != info[:-1]]
        first = np.flatnonzero(new)
        enough = np.add.reduceat(span.astype(np.int64), first) >= (info[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        e, t = e[first][enough].astype(np.int64), t[first][enough].astype(np.int64)
        for at in range(0, len(e), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(e[at : at + 50_000]), pa.array(t[at : at + 50_000])], ["e", "t"])


def _similar(batches, threshold: float):
    import pyarrow as pa

    for batch in batches:
        known: dict[str, set] = {}
        keep = []
        for i, (s, t) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            u = known.get(s)
            if u is None:
                u = known[s] = _set(s)
            v = _set(t)
            if min(len(u), len(v)) + 1e-9 < threshold * max(len(u), len(v)):
                continue
            both = len(u & v)
            if both >= threshold * (len(u) + len(v) - both) - 1e-9:
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64())).select([0, 1])


_BLOB = "bucket int, side int, blob binary"


def _candidates(records: DataFrame, threshold: float) -> DataFrame:
    """``(e, t)``: every pair of an evaluation and a training record of at least this similarity, and some more."""
    spark = records.sparkSession
    parts = shuffle_partitions(spark)
    places = int(records.agg(F.sum(F.length("text"))).first()[0] or 0)
    if not places:
        return spark.createDataFrame([], "e bigint, t bigint")
    # A prefix over 1/HOT of all is so in some chunk, and at most HOT of either length are: a bounded list.
    frequent = records.select("text").mapInArrow(_count_frequent, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1000, places // HOT)).toPandas()
    buckets = runs.buckets_for(places, 4, parts)
    bits = min(MAP_BITS, max(16, places.bit_length() + 2))
    hot = _Hot(frequent["key"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.int64), places // buckets + 1)
    collapsed = records.select("rec", "text", "held_out", "in_train").mapInArrow(lambda b: _send_suffixes(b, buckets, hot), _BLOB)
    counted = collapsed.repartitionById(buckets, F.col("bucket")).mapInArrow(lambda b: _intervals(b, parts, hot), _BLOB)
    picks = Stage(counted.repartitionById(parts, F.col("bucket")).mapInArrow(lambda b: _windows(b, threshold), "rec bigint, n bigint, picks binary"), "picks")
    held = Stage(records.where("held_out").select("rec", "text").join(picks.df, "rec").select("rec", "text", "n", "picks"), "windows")
    picks.drop()
    texts = held.df
    cells = texts.mapInArrow(lambda b: _mapped(b, bits), "slice int, bits binary").repartitionById(min(64, parts), F.col("slice")).mapInArrow(_merged_map, "slice int, bits binary")
    wanted = spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in cells.collect()])  # 64 slices, 2 ** MAP_BITS bits together
    windows = texts.mapInArrow(lambda b: _send_windows(b, buckets, hot), _BLOB)
    matching = records.where("in_train").select("rec", "text", "n").mapInArrow(lambda b: _send_matching(b, buckets, hot, wanted, bits), _BLOB)
    spans = matching.unionByName(windows).repartitionById(buckets, F.col("bucket")).mapInArrow(lambda b: _spans(b, threshold, buckets), _BLOB)
    pairs = Stage(spans.repartitionById(buckets, F.col("bucket")).mapInArrow(_covered, "e bigint, t bigint"), "pairs").df
    held.drop()
    return pairs


def overlaps(seq: DataFrame, seen: DataFrame, min_chars: int = 20, threshold: float = 0.7) -> DataFrame:
    """``(seq_id, sig, how)``: held-out rows of ``seq`` and the signatures of training texts that are the same (``same``),
    similar (``near``), or known only by signature (``seen``); one row per pair."""
    rows = Stage(seq.select("id", "split", "sig", "text").where(F.col("split").isin("train", *EVAL)).mapInArrow(lambda b: _fold(b, min_chars), "id bigint, split string, sig string, digest binary, text string"), "folded").df
    grouped = rows.groupBy("digest").agg(F.first("text").alias("text"), F.bool_or(F.col("split") != "train").alias("held_out"), F.bool_or(F.col("split") == "train").alias("in_train"))
    records = Stage(grouped.mapInArrow(_number, "rec bigint, digest binary, text string, held_out boolean, in_train boolean, n bigint"), "records").df
    side = lambda name, of: records.where(of).select(F.col("rec").alias(name), F.col("text").alias(f"text_{name}"))
    both = _candidates(records, threshold).join(side("e", "held_out"), "e").join(side("t", "in_train"), "t").select("e", "t", "text_e", "text_t")
    near = both.mapInArrow(lambda b: _similar(b, threshold), "e bigint, t bigint").withColumn("how", F.lit("near"))
    linked = Stage(near.unionByName(records.where("held_out and in_train").select(F.col("rec").alias("e"), F.col("rec").alias("t"), F.lit("same").alias("how"))), "linked").df
    members = rows.select("id", "split", "sig", "digest").join(records.select("rec", "digest"), "digest")
    held = members.where("split <> 'train'").select(F.col("rec").alias("e"), F.col("id").alias("seq_id")).distinct()
    train = members.where("split = 'train' and sig is not null").select(F.col("rec").alias("t"), "sig").distinct()
    pairs = linked.join(held, "e").join(train, "t").select("seq_id", "sig", "how")
    known = seen.where("split = 'train' and sig is not null").select("sig").distinct()
    by_sig = rows.where("split <> 'train'").select(F.col("id").alias("seq_id"), "sig").distinct().join(known, "sig", "left_semi").select("seq_id", "sig", F.lit("seen").alias("how"))
    return pairs.unionByName(by_sig).groupBy("seq_id", "sig").agg(F.expr("min_by(how, case how when 'same' then 0 when 'near' then 1 else 2 end)").alias("how"))


def overlap_report(seq: DataFrame, seen: DataFrame, min_chars: int = 20, threshold: float = 0.7) -> DataFrame:
    """Rows of each held-out split and source, and how many of them training holds: the same, nearly, or by signature only."""
    hits = overlaps(seq, seen, min_chars, threshold).groupBy("seq_id").agg(F.expr("min_by(how, case how when 'same' then 0 when 'near' then 1 else 2 end)").alias("how"))
    source = F.coalesce(F.lower(F.trim("source")), F.lit("unknown"))
    rows = seq.where(F.col("split").isin(*EVAL)).select(F.col("id").alias("seq_id"), "split", source.alias("source")).distinct()
    return rows.join(hits, "seq_id", "left").groupBy("split", "source").agg(F.count_distinct("seq_id").alias("rows"), *[F.count_if(F.col("how") == h).alias(h) for h in ("same", "near", "seen")])
