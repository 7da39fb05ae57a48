"""SimHash near-duplicates: Golay-code fuzzy hashing of fingerprints, joined, verified and linked.

Fingerprint. Words are cut at white space after A-Z is lower-cased; every shingle of four words (repeats
included; fewer words: the whole sequence) is hashed by XXH64 with seed 42; a bit is set if it is set in
over half of the hashes. No words: fingerprint zero, which links like any other.

Keys. The 64 bits are cut into segments of 22, 21 and 21. A segment, padded to 23 bits and completed by its
parity, is decoded by the extended Golay code [24, 12, 8]: the codewords within distance four are its
indices, one or (for six vectors in seven) six. Two segments that differ in two bits at most share an
index: both are of even weight and at most two apart, and the six nearest codewords of one differ from it in
six disjoint tetrads, of which the two bits touch one or two.
Pigeonhole: of three segments with four differing bits in all, either one is equal and another has two at
most (key: the equal segment and an index of the other), or each has one and one of them at most two (key:
an index of each). So fingerprints that differ in four bits at most share a key of 33 or 36 bits.

Join. Distinct fingerprints only, dealt and sorted by key; a bucket is verified bit by bit and gives the
links of a spanning forest, never all pairs. A bucket of more than ``chunk`` fingerprints is cut into chunks
which are then verified two by two, so no task holds a bucket whole.

Defined results: null and empty texts have fingerprint zero; a null id gets a result like any id but is
never a component's name unless the whole component has none (then it is null); repeated rows are rows
of one component; an empty table gives an empty result. Extra columns pass through and lose to the added
names.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, prepare
from .components import connected_components

SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and width
CHUNK = 1 << 16


def fingerprint(text: bytes | None, size: int = 4, seed: int = 42) -> int:
    words = text.lower().split() if text else []  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) > size:
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[size - 1 :], strict=False)]
    else:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], ">u8")
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def golay() -> tuple[np.ndarray, np.ndarray]:
    """Of the extended code: the check bits of each of 4,096 messages, and, for each syndrome, what the six
    (or fewer, then repeated) codewords within distance four change in the message bits."""
    message = np.arange(4096, dtype=np.int64)
    check = message << 11
    for bit in range(22, 10, -1):  # the remainder by x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
        check = np.where(check >> bit & 1, check ^ (0b110001110101 << (bit - 11)), check)
    check = check << 1 | np.bitwise_count(message << 11 | check) & 1  # the parity of all 23
    single = 1 << np.arange(24)
    syndrome = lambda e: check[e >> 12] ^ (e & 4095)
    leaders: dict[int, list[int]] = {0: [0]}
    for i in range(24):
        for j in range(i):
            leaders.setdefault(int(syndrome(single[i] | single[j])), []).append(int(single[i] | single[j]))
    for i in range(24):
        for j in range(i):
            for k in range(j):
                three = single[i] | single[j] | single[k]
                for e in three | single[:k]:
                    s = int(syndrome(e))
                    if s not in leaders or int(leaders[s][0]).bit_count() == 4:
                        leaders.setdefault(s, []).append(int(e))
    table = np.zeros((4096, 6), np.int64)
    for s, found in leaders.items():
        table[s] = ([e >> 12 for e in found] * 6)[:6]
    return check, table


def segment_indices(values: np.ndarray, check: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Six indices of each segment value (below 2^23), as an array of shape (n, 6)."""
    vector = values << 1 | np.bitwise_count(values) & 1
    top = vector >> 12
    return top[:, None] ^ table[check[top] ^ (vector & 4095)]


def keys_of(prints: np.ndarray, check: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of uint64 fingerprints: (key, row) pairs, without repeats."""
    parts = [(prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    indices = [segment_indices(p, check, table) for p in parts]
    row = np.arange(len(prints))
    keys, rows = [], []
    for x in range(3):
        for y in range(3):
            if x != y:
                keys.append(((x * 3 + y) << 36 | parts[x][:, None] << 12 | indices[y]).ravel())
                rows.append(np.repeat(row, 6))
    whole = indices[0][:, :, None, None] << 24 | indices[1][:, None, :, None] << 12 | indices[2][:, None, None, :]
    keys.append((9 << 36 | whole).ravel())
    rows.append(np.repeat(row, 216))
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], row[new]


def forest(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that span the components of distinct fingerprints at ``bits`` differing bits or fewer."""
    links, left = [], prints
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                found = left[near]
                links += [(int(at), int(f)) for f in found]
                frontier += list(found)
                left = left[~near]
    return links


def links_in_buckets(bits: int, chunk: int):
    """Of rows sorted by key and fingerprint: links, and the chunks of too large buckets (key, chunk, prints)."""
    def batch_of(links, large):
        a = np.array([x for x, _ in links] + [0] * len(large), np.uint64).astype(np.int64)
        b = np.array([y for _, y in links] + [0] * len(large), np.uint64).astype(np.int64)
        at = [None] * len(links)
        return pa.RecordBatch.from_pydict({
            "a": a, "b": b, "key": pa.array(at + [k for k, _, _ in large], pa.int64()),
            "part": pa.array(at + [p for _, p, _ in large], pa.int32()),
            "prints": pa.array(at + [v.tobytes() for _, _, v in large], pa.binary())})

    def run(batches):
        key, held, part = None, np.zeros(0, np.uint64), 0
        links: list = []
        large: list = []

        def close():
            nonlocal held, part
            if part:
                large.append((key, part, held))
            elif len(held) > 1:
                links.extend(forest(held, bits))
            held, part = np.zeros(0, np.uint64), 0

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            ends = np.concatenate((starts[1:], [len(keys)]))
            # inner buckets of one fingerprint give nothing, those of two are compared all at once
            inner = (starts > 0) & (ends < len(keys))
            two = starts[inner & (ends - starts == 2)]
            near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= bits]
            links += zip(prints[near].tolist(), prints[near + 1].tolist(), strict=True)
            for s, e in zip(starts[~inner | (ends - starts > 2)].tolist(), ends[~inner | (ends - starts > 2)].tolist(), strict=True):
                if keys[s] != key:
                    close()
                    key = int(keys[s])
                held = np.concatenate((held, prints[s:e]))
                while len(held) > chunk:
                    large.append((key, part, held[:chunk]))
                    held, part = held[chunk:], part + 1
            if links or large:
                yield batch_of(sorted(set(links)), large)
                links, large = [], []
        close()
        if links or large:
            yield batch_of(links, large)
    return run


def links_between_chunks(bits: int):
    def run(batches):
        for batch in batches:
            links: list = []
            for mine, other in zip(batch.column(0), batch.column(1), strict=True):
                a, b = np.frombuffer(mine.as_py(), np.uint64), np.frombuffer(other.as_py(), np.uint64)
                links += forest(np.unique(np.concatenate((a, b))), bits)
            yield pa.RecordBatch.from_pydict({"a": np.array([x for x, _ in links], np.uint64).astype(np.int64),
                                              "b": np.array([y for _, y in links], np.uint64).astype(np.int64)})
    return run


def with_fingerprints(docs: DataFrame, text: str = "text", size: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with ``__print``, the fingerprint as a signed long."""
    prepare(docs.sparkSession)
    rows = docs.withColumn("__text", F.col(text).cast("binary"))

    def compute(batches):
        for batch in batches:
            k = batch.num_columns - 1
            found = np.array([fingerprint(t.as_py(), size, seed) for t in batch.column(k)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(found)], names=[*batch.schema.names[:k], "__print"])

    return rows.mapInArrow(lean(compute), rows.drop("__text").schema.add("__print", "long"))


def links(prints: DataFrame, bits: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Distinct fingerprints (one long column) → ``(a, b)``: links that connect all that differ in ``bits`` or fewer."""
    if not 0 <= bits <= 4:
        raise ValueError("the keys find fingerprints that differ in four bits at most")

    def emit(batches):
        check, table = golay()
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), 1024):
                some = values[at : at + 1024]
                key, row = keys_of(some, check, table)
                yield pa.RecordBatch.from_pydict({"key": key, "print": some[row].view(np.int64)})

    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt evenly first: a checkpoint may have few partitions, and each row makes some hundred keys
    keyed = prints.repartition(parts).mapInArrow(lean(emit), "key long, print long").repartition(parts, "key").sortWithinPartitions("key", "print")
    found = cut(keyed.mapInArrow(links_in_buckets(bits, chunk), "a long, b long, key long, part int, prints binary"))
    large = found.where("key IS NOT NULL").select("key", "part", "prints")
    # every pair of a bucket's chunks meets under a key of its own
    large = large.join(large.groupBy("key").agg(F.max("part").alias("last")), "key")
    one = large.where("part < last").select("key", "part", F.explode(F.expr("sequence(part + 1, last)")).alias("part2"), "prints")
    two = large.where("part > 0").select("key", F.explode(F.expr("sequence(0, part - 1)")).alias("part"), F.col("part").alias("part2"), F.col("prints").alias("prints2"))
    pairs = one.join(two, ["key", "part", "part2"]).select("prints", "prints2")
    more = pairs.mapInArrow(links_between_chunks(bits), "a long, b long")
    return found.where("key IS NULL").select("a", "b").unionByName(more).distinct()


def classes(docs: DataFrame, key: str, text: str, size: int, seed: int, bits: int, chunk: int) -> DataFrame:
    """``(key, __hash, __print, __root, component_id)`` of every row: text hash, fingerprint, a fingerprint that names
    the class, and the class's smallest id."""
    rows = docs.select(F.col(key), F.xxhash64(text).alias("__hash"), F.col(text).alias("__t"))
    rows = cut(with_fingerprints(rows, "__t", size, seed).drop("__t"))
    distinct = cut(rows.groupBy("__print").agg(F.min(key).alias("__first")))
    linked = connected_components(links(distinct.select("__print"), bits, chunk))
    linked = linked.withColumnsRenamed({"node": "__print", "component": "__root"})
    named = distinct.join(linked, "__print", "left").withColumn("__root", F.coalesce("__root", "__print"))
    first = named.groupBy("__root").agg(F.min("__first").alias("component_id"))
    found = named.join(first, "__root").select("__print", "__root", "component_id")
    return rows.join(found, "__print").select(key, "__hash", "__print", "__root", "component_id")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 4, seed: int = 42,
                    bits: int = 4, chunk: int = CHUNK) -> DataFrame:
    """``(key, fingerprint, component_id)`` of every row; component: the smallest id that links lead to."""
    hexed = F.lower(F.lpad(F.hex("__print"), 16, "0")).alias("fingerprint")
    return classes(docs, key, text, size, seed, bits, chunk).select(key, hexed, "component_id")


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 4, seed: int = 42,
                bits: int = 4, chunk: int = CHUNK) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest id (of rows with one id, the smallest row)."""
    found = cut(classes(docs, key, text, size, seed, bits, chunk))
    best = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("__hash").alias("hash")))
    kept = found.groupBy("__root").agg(best.alias("b")).select(F.col("b.id").alias("__id"), F.col("b.hash").alias("__h"))
    times = found.groupBy(F.col(key).alias("__i"), F.col("__hash").alias("__j")).agg(F.count("*").alias("__n"))
    kept = cut(kept.join(times, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__j"))).select("__id", "__h", "__n"))
    rows = docs.join(kept, F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__h")))
    # rows that are repeated with id and text: the smallest, aggregated before the shuffle
    again = rows.where("__n > 1").groupBy("__id", "__h").agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return rows.where("__n = 1").select(*docs.columns).unionByName(again.select("__row.*"))
