"""PartEnum signatures for Jaccard similarity 3/4 of sets of 64-bit hashes.

Sets of a size band share a partition of the hash domain into parts (ranges), each cut into cells. Two sets
of sizes a and b with a Jaccard similarity of 3/4 at least differ in k = (a + b) / 7 elements at most. So of
any k / (``miss`` + 1) + 1 parts, one differs in ``miss`` elements at most, hence in as many of its ``cells``,
and the rest of its cells are equal. A set emits, for each part and each subset of ``cells`` - ``miss`` of its
cells, the hash of what it has there; subsets without elements are left out.

A part is full if no subset of it is empty. A set emits its parts until ``need`` + ``slack`` of them were
full. Of two similar sets, take the one that ends first: of its full parts, at least 1 + ``slack`` share a
subset with the other, which emits it as well. So two similar sets share signatures of 1 + ``slack`` parts
at least; one that has no more than ``slack`` signatures in large buckets has met all its partners in small ones.

A set with too few full parts emits all it has, and again under the next seed; two such sets meet there.
Under the last seed an empty subset is a signature as well, so nothing is lost.

Bands double; a set also emits in the next band if a partner there is possible.

More cells make a signature cover more of a set, but there are more subsets: with three cells and one miss,
1.5 times the signatures for 1.3 times the elements each. Small sets, whose signatures would else be a word
or two, get them (``SHAPES``).

The finest partition has a part for each element. Of a set of size a, at most a / 4 elements are missing
in a similar one, so a set shares one of any a / 4 + 1 of its elements with every similar set.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from reelflow.llm.shingles import mix

SEEDS = 4
#: Bands below the first number have the second's (cells, miss): three cells up to 63 elements, one beyond.
SHAPES = ((6, (3, 1)), (64, (1, 0)))
#: Parts of a band, per part that a set of its largest size needs, beside the slack.
PARTS = 1.15
#: Parts that a set emits beyond those it needs, per part that a set of its band's largest size needs.
SLACK = 0.12
#: Lowest bits of a signature: two of the seed, below five of the band.
TAG = 127
#: Binary logarithm of the cells of a parity at most; fewer cells only weaken its bound.
MOST_CELLS = 17


def band_of(size: np.ndarray) -> np.ndarray:
    """Band b holds sizes 2**b to 2**(b + 1) - 1."""
    return np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1


def differ(size: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Elements in which a set may differ from a similar one that is no larger than ``top``."""
    return (size + np.minimum(top, 4 * size // 3)) // 7


def _top(band):
    return (np.int64(1) << (band + 1)) - 1


def shape_of(band: int) -> tuple[int, int]:
    """(cells, miss) of a band."""
    return next(shape for end, shape in SHAPES if band < end)


def _largest_need(band, miss: int):
    return 2 * _top(band) // 7 // (miss + 1) + 1


def slack_of(band, miss: int):
    """Parts of a band that two similar sets surely share beyond one."""
    return (SLACK * _largest_need(band, miss)).astype(np.int64)


def slacks() -> list[int]:
    """The slack of each band."""
    return [int(slack_of(np.int64(b), shape_of(b)[1])) for b in range(32)]


def configs(sizes: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(sets, 0) for their own band, (sets, 1) for those that may have a partner in the next."""
    crossing = (4 * sizes // 3 > _top(band_of(sizes))) & (sizes > 0)
    return [(np.flatnonzero(sizes > 0), 0), (np.flatnonzero(crossing), 1)]


def _signed(content: np.ndarray, part: np.ndarray, subset: int, band: np.ndarray, seed: int) -> np.ndarray:
    own = (band.astype(np.uint64) << np.uint64(2)) | np.uint64(seed)
    name = (part.astype(np.uint64) << np.uint64(16)) + (np.uint64(subset) << np.uint64(8)) + own
    sig = mix(content ^ mix(name + np.uint64(0x632BE59BD9B4E019)))
    return (sig & ~np.uint64(TAG)) | own


def _emit(h: np.ndarray, sizes: np.ndarray, band: np.ndarray, seed: int, cells: int, miss: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, set of each, sets that had too few full parts)."""
    slack = slack_of(band, miss)
    wanted = differ(sizes, _top(band)) // (miss + 1) + 1 + slack
    parts = np.ceil(PARTS * _largest_need(band, miss)).astype(np.int64) + slack
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if seed:
        h = mix(h * np.uint64(2 * seed + 1))
        h = h[np.lexsort((h, owner))]
    cell = (((h >> np.uint64(32)) * (parts * cells).astype(np.uint64)[owner]) >> np.uint64(32)).astype(np.int64)
    at = _starts(cell, owner)
    sums = np.add.reduceat(h, at) if len(at) else np.empty(0, np.uint64)
    owner, part, place = owner[at], cell[at] // cells, cell[at] % cells
    at = _starts(part, owner)
    filled = np.diff(np.concatenate((at, [len(part)])))
    held = np.zeros((len(at), cells), np.uint64)
    there = np.zeros((len(at), cells), bool)
    row = np.repeat(np.arange(len(at)), filled)
    held[row, place], there[row, place] = sums, True
    owner, part, full = owner[at], part[at], filled > miss
    n_full = np.bincount(owner[full], minlength=len(sizes))
    before = np.cumsum(full) - full - (np.cumsum(n_full) - n_full)[owner]
    used = before < wanted[owner]
    short = np.flatnonzero((n_full < wanted) & (sizes > 0))
    out_sig, out_own = [], []
    gaps = _gaps(owner, part, there, short, parts, cells) if seed == SEEDS - 1 and len(short) else None
    for j, subset in enumerate(combinations(range(cells), cells - miss)):
        some = used & there[:, subset].any(axis=1)
        content = held[some][:, subset].sum(axis=1, dtype=np.uint64)
        out_sig.append(_signed(content, part[some], j, band[owner[some]], seed))
        out_own.append(owner[some])
        if gaps is not None:
            who, gap, has = gaps
            none = ~has[:, subset].any(axis=1)
            out_sig.append(_signed(np.full(int(none.sum()), 0x9FB21C651E98DF25, np.uint64), gap[none], j, band[who[none]], seed))
            out_own.append(who[none])
    return np.concatenate(out_sig), np.concatenate(out_own), short


def _starts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a new pair of neighbours (a, b) begins."""
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.flatnonzero(first)


def _gaps(owner: np.ndarray, part: np.ndarray, there: np.ndarray, short: np.ndarray, parts: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, part, its cells that are not empty) for all parts of the sets ``short``."""
    n = parts[short]
    base = np.cumsum(n) - n
    who, every = np.repeat(short, n), np.arange(n.sum()) - np.repeat(base, n)
    has = np.zeros((len(who), cells), bool)
    first = np.full(len(parts), -1)
    first[short] = base
    mine = first[owner] >= 0
    has[first[owner[mine]] + part[mine]] = there[mine]
    return who, every, has


def select(h: np.ndarray, sizes: np.ndarray, who: np.ndarray) -> np.ndarray:
    """The hashes of the sets ``who`` alone."""
    if len(who) == len(sizes):
        return h
    ends = np.cumsum(sizes)
    return np.concatenate([h[ends[i] - sizes[i] : ends[i]] for i in who]) if len(who) else h[:0]


def signatures(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, number of the set that emits each) of sets that stand one after the other in ``h``, sorted."""
    out_sig, out_own = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    bands = band_of(sizes)
    for every, shift in configs(sizes):
        begin = 0
        for end, (cells, miss) in SHAPES:
            b = bands[every] + shift
            who = every[(b >= begin) & (b < end)]
            begin = end
            for seed in range(SEEDS):
                if not len(who):
                    break
                sig, own, short = _emit(select(h, sizes, who), sizes[who], bands[who] + shift, seed, cells, miss)
                out_sig.append(sig)
                out_own.append(who[own])
                who = who[short]
    return np.concatenate(out_sig), np.concatenate(out_own)


def sketch(h: np.ndarray, size: int) -> bytes:
    """Elements per range of the domain, 255 at most: the sum of differences never exceeds the sets' difference."""
    cells = 1 << max(0, size.bit_length() - 3)
    counts = np.bincount((h >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64) if cells > 1 else np.zeros(size, np.int64), minlength=cells)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def fold(cells: np.ndarray, to: int) -> np.ndarray:
    """A sketch, or rows of them, with ``to`` cells. A saturated cell makes the sum a lower bound only."""
    return cells.reshape(*cells.shape[:-1], to, -1).sum(axis=-1, dtype=np.int32)


def may_match(a: bytes, b: bytes, size_a: int, size_b: int) -> bool:
    """False only if the sets are surely less similar than 3/4."""
    if 4 * min(size_a, size_b) < 3 * max(size_a, size_b):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if x.max() == 255 or y.max() == 255:
        return True
    to = min(len(x), len(y))
    return bool(7 * np.abs(fold(x, to) - fold(y, to)).sum() <= size_a + size_b)


def parity(h: np.ndarray, size: int) -> bytes:
    """One bit per cell, four to eight cells an element: whether the cell holds an odd number of elements.

    Two sets differ in at least as many elements as their parities in bits.
    """
    cells = 1 << min(MOST_CELLS, max(6, size.bit_length() + 2))
    counts = np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def fold_parities(bits: list[bytes], words: int) -> np.ndarray:
    """Parities as rows of ``words`` 64-bit words; halves of longer ones fold upon each other."""
    lengths = np.fromiter(map(len, bits), np.int64, len(bits)) // 8
    out = np.empty((len(bits), words), np.uint64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        x = np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), n)
        while x.shape[1] > words:
            half = x.shape[1] // 2
            x = x[:, :half] ^ x[:, half:]
        out[at] = x
    return out
