"""N-gram Jaccard join: a size-aware heavy-light set similarity join over word shingles, exact at 0.8.

Two sets of sizes s <= t link when 100 |A & B| >= 80 |A | B|. Then |A & B| >= c(s, t) = ceil(4 (s + t) / 9), t <= 1.25 s,
and the sets differ in at most (s + t) / 9 places.

* Light sets (size up to the boundary) enumerate all their subsets of the fixed sizes c(s, t); linked light sets share
  such a subset. A set of size s has E(s) of them.
* Heavy sets are indexed in inverted lists, and lists with several members are scanned. A list is not kept for a single
  shingle, since one in a passage that many documents share has a list as long as the corpus; it is kept for a part:
  the shingles of the set whose hash falls into one of K equal ranges. With at most D differences, D < K filled parts,
  some part is the same in both sets, so they meet in a list (no pair is lost). Sizes are grouped in levels whose
  bounds grow by 1.25; a set enters the lists of its own level and, if it can have larger partners, of the next; light
  sets near the boundary enter the first level too. A set has P(s) parts.
* Before that, a count sieves the sets. All shingles whose hash lies below SAMPLE of the hash range are counted over the
  corpus. A linked set misses at most a fifth of its shingles in its partner, so of its m sampled shingles at least
  m - size / 5 occur in some other set; sets with fewer shared ones are linked with nothing and leave. Only the rest,
  mostly near copies, is indexed. The sieve is a bound, not an estimate: it loses no link.
* The boundary is the largest size for which E(s) <= SCAN * P(s): cost is a sum over sets, so the cheaper side for each
  size is the cheapest in all. A list entry counts SCAN times a subset entry: small sets have one shingle a part, and
  such a list is scanned and its pairs verified, where a shared subset is nearly always a link.
* Empty parts count for nothing. The slack in K is raised, level by level, until every set of the level has more
  filled parts than it can have differences (checked over all sets; with K = infinity each shingle is a part).

Copies: equal sets form one class; only classes are joined, and lists hold a class once per scan task. Lists of up to
SHORT members give all their pairs, longer ones link every member to their smallest; a scan task reduces what it has of
a long list to the smallest member before it sends it on, so no list is gathered whole. After links are verified and
classes joined in components, the members of long lists that lie in several components go through a prefix filter: the
shingles of each are ordered by how many members hold them, and only sets that share one of their rarest fifth (and one
more) meet, list by list, in blocks within tasks. That makes the result exact for any data without a row for each pair.
Entries travel as packed arrays, one row for each bucket and task. Keys that many rows share (a class of copies, a hub
of a component, a common shingle) are joined by common.join_heavy.

Defined results: null or blank text has no shingles and is linked with nothing (its component is itself); a null
doc_id has a null component; repeated rows (same id and text) give equal rows; fewer than five words are one shingle;
an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkline.llm.common import WordHashes, ascii_words, cols_of, drop_stash, free_shuffles, fresh, join_heavy, keyed, lean, lean_group, mix64, shingle_set, slices, small_side, stash

#: Longest list that gives all pairs; entries of a bucket aimed at; entries that a task holds before it sends them.
SHORT, BUCKET_ENTRIES, HOLD = 8, 1_000_000, 1_000_000
#: Cost of a list entry in subset entries.
SCAN = 4
#: Longest list of the prefix filter that gives pairs of ids; sets of a cell in the comparison of longer ones.
BRIEF, CELL = 32, 400
#: A bit filter has so many bits for each id; up to so many ids one is used (32 MB), beyond that a semi join.
FILTER_SHARE, FILTER_IDS = 16, 1 << 24
#: Bytes of text for a shingle, about; entries in the index for a shingle, about.
SHINGLE_BYTES, ENTRY_SHARE = 6, 0.65
#: Share of the hash range whose shingles the sieve counts; documents go to this many groups a bucket for their sums.
SAMPLE = 0.4
_CUT = np.uint64(int(SAMPLE * 2**64))
WHOLE = 1 << 32  # K where every shingle is a part of its own


def need(s: int, t: int) -> int:
    """Shared shingles that link sets of these sizes."""
    return -(-4 * (s + t) // 9)


def subset_sizes(s: int, most: int) -> list[int]:
    """The sizes c(s, t) for partners t up to `most`."""
    return sorted({need(s, t) for t in range(-(-4 * s // 5), min(5 * s // 4, most) + 1) if need(s, t) <= min(s, t)})


def level_bounds(first: int) -> np.ndarray:
    out = [first]
    while out[-1] < 1 << 40:
        out.append(5 * out[-1] // 4 + 1)
    return np.array(out, np.int64)


def ladder(largest: int) -> list[int]:
    """Choices of K for a level, by its largest size: the first ones spare, the last certain."""
    d = 2 * largest // 9 + 1
    spread = isqrt(d // 80 + 1) + 1
    return [d + d // 80 + m * spread for m in (5, 9, 14, 20)] + [WHOLE]


def parts_of(s: int, bounds: np.ndarray) -> int:
    """P(s): index entries of a heavy set of this size, by expectation (parts can't outnumber shingles)."""
    level = int(np.searchsorted(bounds, s, "right")) - 1
    levels = ([level] if level >= 0 else []) + ([level + 1] if 5 * s // 4 >= bounds[level + 1] else [])
    return sum(min(s, ladder(int(bounds[n + 1]) - 1)[0]) for n in levels)


def light_boundary() -> int:
    """The largest size whose subsets cost no more than its list entries."""
    s = 1
    while sum(comb(s + 1, c) for c in subset_sizes(s + 1, s + 1)) <= SCAN * parts_of(s + 1, level_bounds(s + 1)):
        s += 1
    return s


LIGHT = light_boundary()
BOUNDS = level_bounds(LIGHT + 1)


def levels_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own level, level as the smaller partner) of each size; -1 for none."""
    own = np.searchsorted(BOUNDS, sizes, "right") - 1
    up = np.where(5 * sizes // 4 >= BOUNDS[own + 1], own + 1, -1)
    return own, up


def _parts(sets: list[np.ndarray], ks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sets of sorted hashes and their K: (first place of each filled part, its set, its number) in order."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, which = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    k = ks.astype(np.uint64)[which]
    part = np.where(k == np.uint64(WHOLE), flat, (flat >> np.uint64(32)) * k >> np.uint64(32))
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (part[1:] != part[:-1]) | (which[1:] != which[:-1])
    at = np.flatnonzero(fresh)
    return at, which[at], part[at]



def _entries(sets: list[np.ndarray], choice: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For both levels of the sets: (indices of the sets concerned, their levels, and the parts as by _parts)."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    for levels in levels_of(sizes):
        idx = np.flatnonzero(levels >= 0)
        if len(idx):
            ks = np.array([ladder(int(BOUNDS[n + 1]) - 1)[choice.get(int(n), 0)] for n in levels[idx]], np.int64)
            yield idx, levels[idx], *_parts([sets[i] for i in idx], ks)


def misfits(sets: list[np.ndarray], choice: dict[int, int]) -> set[int]:
    """Levels where some set does not have more filled parts than it can have differences from a partner."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    bad: set[int] = set()
    for idx, levels, _, which, _ in _entries(sets, choice):
        most = (sizes[idx] + np.minimum(BOUNDS[levels + 1] - 1, 5 * sizes[idx] // 4)) // 9
        bad |= set(levels[np.bincount(which, minlength=len(idx)) <= most].tolist())
    return bad


def signatures(sets: list[np.ndarray], choice: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) for the parts of heavy sets and the subsets of light ones."""
    sigs, owners = [], []
    for idx, levels, at, which, part in _entries(sets, choice):
        flat = np.concatenate([sets[i] for i in idx])
        sums = np.add.reduceat(mix64(flat), at)
        sigs.append(mix64(sums + mix64(part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + levels[which].astype(np.uint64) + np.uint64(1))))
        owners.append(idx[which])
    for i, s in enumerate(sets):
        if len(s) <= LIGHT:
            mixed = mix64(s).tolist()
            found = [(sum(x) + c * 0x9E3779B97F4A7C15 ^ 0xA5A5A5A5) & 0xFFFFFFFFFFFFFFFF for c in subset_sizes(len(s), LIGHT) for x in combinations(mixed, c)]
            sigs.append(mix64(np.array(found, np.uint64)))
            owners.append(np.full(len(found), i, np.int64))
    if not sigs:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(sigs), np.concatenate(owners)


def _sets(batches: Iterator[pa.RecordBatch], keep=None) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(ids, shingle sets) by slices of (doc_id, text) rows; `keep`: a test on an array of ids."""
    hashes = WordHashes()
    for b in slices(batches, text=1):
        ids = b.column(0).to_numpy(zero_copy_only=False)
        if keep is not None:
            b = b.filter(pa.array(keep(ids)))
            ids = b.column(0).to_numpy(zero_copy_only=False)
        if b.num_rows:
            yield ids, [shingle_set(hashes.of(ascii_words(t))) for t in b.column(1).to_pylist()]


def _set_keys(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix64(s).sum()), int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum())


def _planes(x: np.ndarray, width: int = 8) -> bytes:
    """Whole numbers byte by byte, lowest first: high bytes that are alike vanish in compression."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: list[bytes], width: int = 8) -> np.ndarray:
    parts = []
    for x in data:
        whole = np.zeros((len(x) // width, 8), np.uint8)
        whole[:, :width] = np.frombuffer(x, np.uint8).reshape(width, -1).T
        parts.append(whole.view(np.uint64).ravel())
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _profile(buckets: int):
    """(doc_id, text) -> rows of (kind, key, blobs): kind 0 profiles, kind 1 sampled shingles with their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def rows(kind, keys, a, b, bad):
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.int8()), pa.array(keys, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(bad, pa.list_(pa.int32()))], ["kind", "key", "a", "b", "bad"])

        def flush():
            grams, ids = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.argsort(grams)
            grams, ids = grams[order], ids[order]
            # sampled hashes fill only a share of the range: buckets by their place in it
            where = ((grams >> np.uint64(32)).astype(np.float64) / (SAMPLE * 2**32) * buckets).astype(np.int64)
            cuts = np.flatnonzero(np.diff(where)) + 1
            at = list(zip([0, *cuts], [*cuts, len(grams)], strict=True))
            return rows(1, [int(where[i]) for i, _ in at], [_planes(grams[i:j] >> np.uint64(16), 6) for i, j in at], [_planes(ids[i:j]) for i, j in at], [[]] * len(at))

        for ids, sets in _sets(batches):
            keys = np.array([_set_keys(s) for s in sets], np.uint64)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            sampled = [s[: np.searchsorted(s, _CUT)] for s in sets]
            need_ = np.fromiter(map(len, sampled), np.int64, len(sets)) - sizes // 5
            full = [s for s in sets if len(s)]
            packed = np.stack([ids.astype(np.int64), sizes, need_, keys[:, 0].view(np.int64), keys[:, 1].view(np.int64)])
            yield rows(0, [0], [packed.tobytes()], [b""], [sorted(misfits(full, {})) if full else []])
            new = [i for i, k in enumerate(map(tuple, keys.tolist())) if len(sampled[i]) and not (k in seen or seen.add(k))]
            if len(seen) > 1_000_000:
                seen.clear()
            if new:
                held.append((np.concatenate([sampled[i] for i in new]), np.repeat(ids[new].astype(np.uint64), [len(sampled[i]) for i in new])))
                size += len(held[-1][0])
            if size > HOLD:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed profiles -> rows; the bad levels go with the first document of a pack."""
    for b in batches:
        for a, bad in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            m = np.frombuffer(a, np.int64).reshape(5, -1)
            notes = pa.array([bad] + [[]] * (m.shape[1] - 1), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in m), notes], ["doc_id", "n", "need", "h1", "h2", "bad"])


def _shared(groups: int):
    """The entries of a bucket -> for each group of documents, how many shared shingles each has here."""

    def run(table: pa.Table) -> pa.Table:
        grams, ids = _unplanes(table.column("a").to_pylist(), 6), _unplanes(table.column("b").to_pylist())
        order = np.argsort(grams)
        grams, ids = grams[order], ids[order]
        same = grams[1:] == grams[:-1]
        often = np.zeros(len(grams), bool)
        often[1:] |= same
        often[:-1] |= same
        who, n = np.unique(ids[often], return_counts=True)
        key = (mix64(who) % np.uint64(groups)).astype(np.int32)
        order = np.argsort(key, kind="stable")
        slots = np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []
        parts = [(int(key[x[0]]), _planes(who[x]), n[x].astype(np.int32).tobytes()) for x in slots]
        return pa.table({"key": pa.array([p[0] for p in parts], pa.int32()), "ids": pa.array([p[1] for p in parts], pa.binary()), "counts": pa.array([p[2] for p in parts], pa.binary())})

    return run


def _reduced(groups: int):
    """Profiles pass; entries of a bucket become shared counts (see _shared)."""
    count = _shared(groups)

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == 0:
            return table
        out = count(table)
        n = out.num_rows
        return pa.table({"kind": pa.array([1] * n, pa.int8()), "key": out.column("key"), "a": out.column("ids"), "b": out.column("counts"), "bad": pa.array([[]] * n, pa.list_(pa.int32()))})

    return run


def _sums(table: pa.Table) -> pa.Table:
    ids = _unplanes(table.column("ids").to_pylist())
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("counts").to_pylist()])
    who, inv = np.unique(ids, return_inverse=True)
    return pa.table({"doc_id": pa.array(who.view(np.int64)), "shared": pa.array(np.bincount(inv, counts, len(who)).astype(np.int64))})


def _recheck(choice: dict[int, int], levels: set[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad: set[int] = set()
        for _, sets in _sets(batches):
            full = [s for s in sets if len(s)]
            if full:
                bad |= misfits(full, choice) & levels
        yield pa.RecordBatch.from_arrays([pa.array(sorted(bad), pa.int32())], ["level"])

    return run


def _index(choice: dict[int, int], buckets: int, bits):
    shift = np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            sig, ids = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            sig, ids, groups, a, b, run, member = shorten(sig, ids)
            where = (sig >> shift).astype(np.int64) if shift is not None else np.zeros(len(sig), np.int64)
            cuts = np.flatnonzero(np.diff(where)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(sig)]])
            at = list(zip(starts, ends, strict=True))
            keys, cols = where[starts].tolist(), [[sig[i:j].tobytes() for i, j in at], [_planes(ids[i:j]) for i, j in at], [_planes(groups[i:j]) for i, j in at]]
            if len(member):  # found rows; they go to some place below 0
                keys.append(-1 - int(mix64(member[:1].view(np.uint64))[0] % np.uint64(buckets)))
                for c, x in zip(cols, (np.stack([a, b]), np.stack([run, member]), np.empty(0)), strict=True):
                    c.append(x.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["bucket", "sigs", "ids", "groups"])

        for ids, sets in _sets(batches, _wanted(bits.value) if bits else None):
            new = []
            for i, s in enumerate(sets):
                if len(s):
                    key = _set_keys(s)
                    if key not in seen:
                        seen.add(key)
                        new.append(i)
            if len(seen) > 1_000_000:
                seen.clear()
            if not new:
                continue
            sig, owner = signatures([sets[i] for i in new], choice)
            held.append((sig, ids[new][owner].astype(np.int64)))
            size += len(sig)
            if size > HOLD:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    return run


def shorten(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(signatures, ids, groups) in order, a long list left with its smallest member, whose group numbers all members of
    the list (0 for entries of short lists); and once for each group, as scan_lists gives them, (pairs a, pairs b, run
    numbers, run members)."""
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(sig)))
    group = mix64(np.add.reduceat(mix64(ids.view(np.uint64)), starts) + sizes.astype(np.uint64)) | np.uint64(1)
    long = sizes > SHORT
    told = np.zeros(len(starts), bool)  # the first list of each group speaks for all
    told[np.flatnonzero(long)[np.unique(group[long], return_index=True)[1]]] = True
    head, each, told = np.repeat(ids[starts], sizes), np.repeat(group, sizes).view(np.int64), np.repeat(told, sizes)
    long = np.repeat(long, sizes)
    stay, away = ~long | first, told & (ids != head)
    return sig[stay], ids[stay], np.where(long, each, 0)[stay], head[away], ids[away], each[told], ids[told]


def scan_lists(sig: np.ndarray, ids: np.ndarray, groups: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The candidates of the lists in these entries, without repeats: (pairs a, pairs b, run numbers, run members) and
    for entries that stand for a group of their task (see shorten) (run numbers, groups in them)."""
    groups = np.zeros(len(sig), np.int64) if groups is None else groups
    order = np.lexsort((ids, sig))
    sig, ids, groups = sig[order], ids[order], groups[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(sig)))
    marked = np.logical_or.reduceat(groups != 0, starts) if len(starts) else np.zeros(0, bool)
    left, right, run, member, holder, held = [], [], [], [], [], []
    for n in range(2, SHORT + 1):
        at = starts[(sizes == n) & ~marked]
        if len(at):
            rows = ids[at[:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            left.append(rows[:, i].ravel())
            right.append(rows[:, j].ravel())
    long_seen, long = set(), (sizes > SHORT) | marked & (sizes > 1)
    for at, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True):
        who, inner = np.unique(ids[at : at + n]), np.unique(groups[at : at + n])
        inner = inner[inner != 0]
        both = np.concatenate([who, inner])
        key = (len(who), both.tobytes() if len(both) < 64 else int(mix64(both.view(np.uint64)).sum()))
        if len(who) < 2 or key in long_seen:
            continue
        long_seen.add(key)
        left.append(np.full(len(who) - 1, who[0]))
        right.append(who[1:])
        run.append(np.full(len(who), sig[at].view(np.int64)))
        member.append(who)
        holder.append(np.full(len(inner), sig[at].view(np.int64)))
        held.append(inner)
    none = np.empty(0, np.int64)
    a, b = (np.concatenate(x) if x else none for x in (left, right))
    a, b = a[a != b], b[a != b]
    if len(a):
        pair = np.unique(np.stack([a, b], 1), axis=0)
        a, b = pair[:, 0], pair[:, 1]
    return a, b, *(np.concatenate(x) if x else none for x in (run, member, holder, held))


def _scan(table: pa.Table) -> pa.Table:
    """Entries of a bucket -> rows (kind, x, y): 0 pairs, 1 runs and their members, 2 runs and groups in them."""
    sigs, ids, groups = (table.column(c).to_pylist() for c in ("sigs", "ids", "groups"))
    if table.column("bucket")[0].as_py() < 0:  # found by scan tasks
        pairs, runs = (np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in c], 1) for c in (sigs, ids))
        found = [*pairs, *runs, *np.empty((2, 0), np.int64)]
    else:
        found = scan_lists(np.concatenate([np.frombuffer(x, np.uint64) for x in sigs]), _unplanes(ids).view(np.int64), _unplanes(groups).view(np.int64))
    kind = np.repeat(np.arange(3, dtype=np.int8), [len(x) for x in found[::2]])
    return pa.table({"kind": pa.array(kind), "x": pa.array(np.concatenate(found[::2])), "y": pa.array(np.concatenate(found[1::2]))})


def _wanted(bits: np.ndarray):
    def keep(ids: np.ndarray) -> np.ndarray:
        h = mix64(ids.astype(np.int64).view(np.uint64)) % np.uint64(8 * len(bits))
        return (bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    return keep


def sketch(s: np.ndarray) -> bytes:
    """For each of some equal ranges of the hash, whether the set has an odd number of shingles there: bits, twice as many
    as shingles, a power of two. Two sets' sketches differ in no more places than the sets."""
    width = max(6, (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((mix64(s) >> np.uint64(64 - width)).astype(np.int64), minlength=1 << width).astype(np.uint8) & 1).tobytes()


def apart_at_least(x: bytes, y: bytes) -> int:
    """A lower bound of the places in which two sets differ, from their sketches; the longer is folded to the shorter."""
    short, long = sorted((np.unpackbits(np.frombuffer(z, np.uint8)) for z in (x, y)), key=len)
    while len(long) > len(short):
        long = long[::2] ^ long[1::2]
    return int((short ^ long).sum())


def _set_rows(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, _wanted(bits.value) if bits else None):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(sketch, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "sketch", "shingles"])

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sizes, sketches) -> the pairs (a, b) that their sketches allow to link."""
    for b in slices(batches):
        s, t = (b.column(i).to_numpy() for i in (2, 3))
        far = np.array([apart_at_least(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], np.int64)
        fits = (100 * np.minimum(s, t) >= 80 * np.maximum(s, t)) & (far <= (s + t) // 9)
        yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(fits))


def _filter_words(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """ids -> (word, bits) of the filter, one row for each 64-bit word that a task touches."""
        bits = np.zeros(size // 8, np.uint8)
        for b in batches:
            h = mix64(b.column(0).to_numpy().view(np.uint64)) % np.uint64(size)
            np.bitwise_or.at(bits, h >> np.uint64(3), (np.uint8(1) << (h & np.uint64(7)).astype(np.uint8)))
        words = bits.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at])], ["word", "bits"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        hit = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[at] == small).sum())
            hit.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(hit))


def _picked(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, object]:
    """(rows, filter) such that the rows that pass the filter are those (doc_id, text) whose doc_id is in `ids` (one
    column `id`, distinct), and some others. The filter is a broadcast of bits, sized by the number of ids; for more
    than FILTER_IDS there is none, and a semi join picks the rows."""
    n = ids.count()
    if n > FILTER_IDS:
        return rows.join(ids, F.col("doc_id") == F.col("id"), "left_semi"), None
    size = 1 << max(16, (FILTER_SHARE * n).bit_length())
    words = ids.mapInArrow(lean(_filter_words(size)), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(size // 64, np.int64)
    bits[words["word"].to_numpy(int)] = words["bits"].to_numpy(np.int64)
    return rows, rows.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def _sets_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, sketch, shingles) of the documents in `ids`, and some others: built again in a scan, so texts are not
    shuffled."""
    picked, bits = _picked(rows, ids)
    return stash(picked.mapInArrow(lean(_set_rows(bits)), "id long, n long, sketch binary, shingles binary"))


def linked(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (id, n, sketch, shingles) link; pairs are distinct, and stashed. Sketches go first:
    whole sets are shuffled only for pairs that may link. The side of a pair that may occur most often, the head of a
    long list, is joined by join_heavy."""

    def with_both(pairs: DataFrame, *what: str) -> DataFrame:
        side = lambda x: sets.select(F.col("id").alias(x), *[F.col(c).alias(c + x) for c in what])
        heads = stash(pairs.groupBy("a").agg(F.count("*").alias("w")).join(side("a"), "a"))
        met = pairs.join(side("b"), "b").select("a", "b", *[c + "b" for c in what])
        return join_heavy(met, heads, ["a"], "w").select("a", "b", *[c + x for c in what for x in "ab"])

    near = stash(with_both(pairs, "n", "sketch").mapInArrow(lean(_near), "a long, b long").distinct())
    return stash(with_both(near, "shingles").mapInArrow(lean(_overlaps), "a long, b long").distinct())


def verify(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets link; rows: (doc_id, text)."""
    sets = _sets_of(rows, stash(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    out = linked(sets, pairs)
    drop_stash(sets)
    return out


def block_links(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Linked pairs (smaller id first) of one set in `left` and one in `right` (bool masks), by a prefix filter: as many
    as it takes to connect what links, given that sets of one component are connected already. So a group of near
    copies gives fewer pairs than it has members.

    Shingles are ordered by how many of these sets hold them: a set's rarest fifth, and one more, must hold one that a
    partner has. Shingles of one set alone can't do that, so texts that only share common passages do not meet."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, token, n = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((token, n[token], owner))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    lead = place < np.repeat(sizes - -(-4 * sizes // 5) + 1, sizes)
    token, owner = token[order][lead], owner[order][lead]
    several = n[token] > 1
    token, owner = token[several], owner[several]
    by = np.lexsort((owner, token))
    token, owner = token[by], owner[by]
    starts = np.searchsorted(token, token)
    out, told = [], np.zeros(len(sets), np.int64)
    parent = np.unique(comps, return_index=True)[1][np.unique(comps, return_inverse=True)[1]].tolist()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    back = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[back], np.arange(len(sets) + 1))
    for i in range(len(sets)):
        told[:] = 0
        for at in back[cuts[i] : cuts[i + 1]]:
            told[owner[starts[at] : at]] = 1
        for j in np.flatnonzero(told):
            s, t = sorted((sizes[i], sizes[j]))
            if 100 * s >= 80 * t and (left[i] and right[j] or left[j] and right[i]) and root(i) != root(j):
                x, y = (sets[i], sets[j]) if sizes[i] <= sizes[j] else (sets[j], sets[i])
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= 80 * (s + t - both):
                    parent[root(i)] = root(int(j))
                    out.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
    return out


def _block(table: pa.Table) -> pa.Table:
    ids = table.column("rep").to_numpy()
    ids, first = np.unique(ids, return_index=True)
    table = table.take(pa.array(first))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    low, high = table.column("low").to_numpy(zero_copy_only=False), table.column("high").to_numpy(zero_copy_only=False)
    links = block_links(ids, table.column("comp").to_numpy(), sets, low, high) if len(sets) > 1 else []
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})


def _block_near(table: pa.Table) -> pa.Table:
    """The rows of a block whose sketch allows a link to a set of another component on the block's other side."""
    n, comp = table.column("n").to_numpy(), table.column("comp").to_numpy()
    low, high = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("low", "high"))
    bits = [np.unpackbits(np.frombuffer(x, np.uint8)) for x in table.column("sketch").to_pylist()]
    width = min(map(len, bits))
    folded = np.empty((len(bits), width // 8), np.uint8)
    for i, x in enumerate(bits):
        while len(x) > width:
            x = x[::2] ^ x[1::2]
        folded[i] = np.packbits(x)
    keep = np.zeros(len(n), bool)
    for i in range(len(n)):
        other = (comp != comp[i]) & (low & high[i] | high & low[i]) & (100 * np.minimum(n, n[i]) >= 80 * np.maximum(n, n[i]))
        at = np.flatnonzero(other)
        if len(at):
            keep[i] = (np.bitwise_count(folded[at] ^ folded[i]).sum(1, dtype=np.int64) <= (n[at] + n[i]) // 9).any()
    return table.drop_columns(["n", "sketch"]).filter(pa.array(keep))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, shingles) -> (rep, token), one row for each shingle."""
    for b in slices(batches):
        for rep, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for at in range(0, len(x), 8 << 16):
                token = np.frombuffer(x[at : at + (8 << 16)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), rep)), pa.array(token)], ["rep", "token"])


def meetings(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(token, rep, n, comp, size): the lists of a prefix filter over members (rep, n, comp) that hold several components,
    with their size.

    Shingles are ordered by how many members hold them: a set's rarest fifth, and one more, must hold one that a linked
    set has there too. Shingles of one set alone count as rarest and make no list, so members that only share common
    passages do not meet."""
    own = stash(sets.select("id", "shingles").join(members.select(F.col("rep").alias("id")), "id", "left_semi").mapInArrow(lean(_tokens), "rep long, token long"))
    often = stash(own.groupBy("token").agg(F.count("*").alias("often")).where("often > 1").withColumn("w", F.col("often")))
    ranked = join_heavy(own, often, ["token"], "w").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("t")).join(members, "rep")
    lead = F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1 - (F.col("n") - F.size("t"))  # without the shingles that it has alone
    lists = stash(ranked.where(lead > 0).select("rep", "n", "comp", F.explode(F.slice("t", F.lit(1), lead.cast("int"))).alias("t")).select(F.col("t.token").alias("token"), "rep", "n", "comp"))
    mixed = stash(lists.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("w")).where("lo != hi").select("token", "w", F.col("w").alias("size")))
    drop_stash(own)
    return stash(join_heavy(lists, mixed, ["token"], "w"))


def family_links(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Links among members (rep, n, comp), the sets of long lists that lie in several components: enough links to
    connect what is linked.

    Short lists of the prefix filter give the pairs of ids that may link, each verified once. The others are cut by size
    classes and, within these, by a hash, into cells of about CELL sets; each pair of cells whose sizes can link is one
    task, which compares sketches first, and then joins the sets that are left in memory and gives only the links."""
    sets = _sets_of(rows, members.select(F.col("rep").alias("id")))
    lists = meetings(sets, members)
    brief = lists.where(F.col("size") <= BRIEF)
    left, right = (brief.select("token", F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("comp").alias(f"c{x}")) for x in "ab")
    pairs = left.join(right, "token").where("a < b and ca != cb and 100 * least(na, nb) >= 80 * greatest(na, nb)").select("a", "b").distinct()
    near = linked(sets, stash(pairs))
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.26)))  # sizes within 1.25: same or next class
    lists = lists.where(F.col("size") > BRIEF).drop("size").withColumn("cls", size_class)
    cells = stash(lists.groupBy("token", "cls").agg(F.ceil(F.count("*") / CELL).alias("salts"), F.count("*").alias("w")))
    own = join_heavy(lists, cells, ["token", "cls"], "w").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")))
    spread = own.withColumn("other", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)))
    meets = spread.join(cells.select("token", F.col("cls").alias("other"), F.col("salts").alias("o_salts")), ["token", "other"]).withColumn("o_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_salts") - 1)))
    me_low = (F.col("cls") < F.col("other")) | ((F.col("cls") == F.col("other")) & (F.col("salt") <= F.col("o_salt")))
    me_high = (F.col("cls") > F.col("other")) | ((F.col("cls") == F.col("other")) & (F.col("salt") >= F.col("o_salt")))
    pick = lambda a, b: F.when(me_low, F.col(a)).otherwise(F.col(b))
    work = meets.select("token", pick("cls", "other").alias("c1"), pick("salt", "o_salt").alias("s1"), pick("other", "cls").alias("c2"), pick("o_salt", "salt").alias("s2"), "rep", "comp", me_low.alias("low"), me_high.alias("high"))
    block, kept = ["token", "c1", "s1", "c2", "s2"], "token long, c1 long, s1 long, c2 long, s2 long, rep long, comp long, low boolean, high boolean"
    near_rows = work.join(sets.select(F.col("id").alias("rep"), "n", "sketch"), "rep").select(*block, "rep", "comp", "low", "high", "n", "sketch")
    work = stash(near_rows.groupBy(*block).applyInArrow(lean_group(_block_near), kept))
    work = work.join(sets.select(F.col("id").alias("rep"), "shingles"), "rep")
    found = work.groupBy(*block).applyInArrow(lean_group(_block), "a long, b long")
    out = stash(found.unionByName(near).distinct())
    drop_stash(sets)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b) but the smallest of each component: the smallest node reachable.
    Alternating large and small stars; each round is a few joins over the edges, written down, until nothing changes
    (about as many rounds as the logarithm of the largest component's nodes)."""
    edges = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = stash(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("w")))
        large = stash(join_heavy(both, low, ["u"], "w").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        # here a node has few neighbours: the smallest nodes of its former ones
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), "m").where("u != m").unionByName(low).toDF("u", "v").distinct()
        new = stash(small)
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for x in (edges, both, large):
            drop_stash(x)
        edges = new
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _by_class(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of doc_ids -> distinct pairs a < b of class representatives whose sizes can link."""
    x = classes.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra"), F.col("n").alias("na"))
    y = classes.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb"), F.col("n").alias("nb"))
    x = stash(x.join(pairs.groupBy("a").agg(F.count("*").alias("w")), "a"))  # heads of long lists have many pairs
    met = join_heavy(pairs, x, ["a"], "w").join(y, "b").where("ra != rb and 100 * least(na, nb) >= 80 * greatest(na, nb)")
    return met.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def _apart(found: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """(rep, n, comp) of the members of long lists that lie in several components."""
    runs = found.where("kind = 1").select(F.col("x").alias("run"), F.col("y").alias("doc_id")).join(classes, "doc_id").select("run", "rep", "n").distinct()
    runs = stash(runs.join(comps, F.col("rep") == F.col("node"), "left").select("run", "rep", "n", F.coalesce("component", "rep").alias("comp")))
    held = stash(found.where("kind = 2").select(F.col("x").alias("run"), F.col("y").alias("inner")).distinct())
    span = stash(runs.groupBy("run").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("w")))
    # a run reaches over its own members and those of the groups in it
    wide = held.join(span.select(F.col("run").alias("inner"), "lo", "hi"), "inner").select("run", "lo", "hi").unionByName(span.select("run", "lo", "hi"))
    mixed = stash(wide.groupBy("run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi").select("run"))
    mixed = mixed.unionByName(held.join(mixed, "run").select(F.col("inner").alias("run"))).distinct()
    return join_heavy(runs, stash(span.join(mixed, "run").select("run", "w")), ["run"], "w").select("rep", "n", "comp").distinct()


def join_ngrams(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id with an equal set), n_copies (documents of the class):
    one row per document. The class of a document without words, or without an id, is itself."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = rows.where(F.col("doc_id").isNotNull())
    lost = docs.where(F.col(doc).isNull()).select(F.col(text).cast("string").alias("text"))
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(6, int(SAMPLE * size / SHINGLE_BYTES / BUCKET_ENTRIES).bit_length())
    told = known.mapInArrow(lean(_profile(buckets)), "kind byte, key int, a binary, b binary, bad array<int>")
    # one pass gives both: profiles are spread by their place, entries by their bucket
    spread = F.when(F.col("kind") == 0, -1 - F.pmod(F.hash("a"), F.lit(buckets))).otherwise(F.col("key"))
    counted = stash(told.withColumn("key", spread).groupBy("key").applyInArrow(lean_group(_reduced(buckets)), "kind byte, key int, a binary, b binary, bad array<int>"))
    profile = stash(counted.where("kind = 0").select("a", "bad").mapInArrow(lean(_unpack), "doc_id long, n long, need long, h1 long, h2 long, bad array<int>"))
    sums = counted.where("kind = 1").select("key", F.col("a").alias("ids"), F.col("b").alias("counts")).groupBy("key").applyInArrow(lean_group(_sums), "doc_id long, shared long")
    rest = stash(profile.where("n > 0").join(sums, "doc_id", "left").where("need <= coalesce(shared, 0)").select(F.col("doc_id").alias("id")))
    drop_stash(counted)
    free_shuffles(spark)
    bad = {r[0] for r in profile.select(F.explode("bad")).distinct().collect()}  # levels: a few dozen at most
    choice: dict[int, int] = {}
    while bad:
        choice |= {n: choice.get(n, 0) + 1 for n in bad}
        open_ = {n for n in bad if choice[n] < len(ladder(1)) - 1}
        bad = {r[0] for r in known.mapInArrow(lean(_recheck(choice, open_)), "level int").distinct().collect()} if open_ else set()
    reps = stash(profile.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")).withColumn("w", F.col("n_copies")))
    classes = stash(join_heavy(profile.where("n > 0").select("doc_id", "n", "h1", "h2"), reps, ["h1", "h2", "n"], "w").select("doc_id", "n", "rep", "n_copies"))
    entries = profile.join(rest, F.col("doc_id") == F.col("id"), "left_semi").agg(F.sum("n")).first()[0] or 0
    entries += (profile.agg(F.sum("n")).first()[0] or 0) / FILTER_SHARE  # others that pass the filter
    buckets = 1 << max(6, int(ENTRY_SHARE * entries / BUCKET_ENTRIES).bit_length())
    picked, bits = _picked(known, rest)
    lists = picked.mapInArrow(lean(_index(choice, buckets, bits)), "bucket int, sigs binary, ids binary, groups binary")
    found = stash(lists.groupBy("bucket").applyInArrow(lean_group(_scan), "kind byte, x long, y long"))
    free_shuffles(spark)
    pairs = stash(found.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    links = verify(known, stash(_by_class(pairs, classes)))
    comps = components(links)
    apart = stash(_apart(found, classes, comps))
    if not apart.isEmpty():
        late = family_links(known, apart)
        if not late.isEmpty():
            comps = components(links.unionByName(late))
    out = profile.select("doc_id", F.col("n").alias("n_shingles")).where("n_shingles = 0").withColumns({"class_id": F.col("doc_id"), "n_copies": F.lit(1).cast("long")})
    out = out.unionByName(classes.select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), "n_copies"))
    sizes = classes.where("doc_id = rep").select(F.col("rep").alias("class_id"), "n_copies").distinct()
    found = stash(sizes.join(comps, F.col("class_id") == F.col("node")).select("class_id", "component", F.col("n_copies").alias("w")))
    out = join_heavy(stash(out), found, ["class_id"], "w", "left").select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id", "n_copies")
    return out.unionByName(lost.mapInArrow(lean(_lost), "doc_id long, n_shingles long, component_id long, class_id long, n_copies long"))


def _lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without an id: their set size alone."""
    hashes = WordHashes()
    for b in slices(batches, text=0):
        none = pa.nulls(b.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array([len(shingle_set(hashes.of(ascii_words(t)))) for t in b.column(0).to_pylist()], pa.int64()), none, none, pa.array([1] * b.num_rows, pa.int64())], ["doc_id", "n_shingles", "component_id", "class_id", "n_copies"])


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group of linked rows: that with the smallest id (null ids last, then by place). Rows
    are joined as rows, so those that repeat an id, or have none, are copies or different texts by what they hold."""
    rows, row = keyed(docs)
    own, gone = fresh(rows, "_own"), fresh(rows, "_gone")
    ids = rows.select(F.col(row).alias("key"), F.col(doc).cast("long").alias("id"))
    told = stash(join_ngrams(rows, row, text).select(F.col("doc_id").alias("key"), "component_id").join(ids, "key"))
    first = told.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias(own))
    rest = small_side(told.join(first.select(F.col(own)["key"].alias("key")), "key", "left_anti").select(F.col("key").alias(gone)))
    return rows.join(rest, F.col(row) == F.col(gone), "left_anti").select(*cols_of(docs.columns))
