"""SimHash near-duplicates: fingerprints meet at anchors, the codewords of a covering code."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import free_name, whole_text
from tidegauge.session import cut, scratch

#: Words in a shingle, seed of the shingles' hash, bits that linked fingerprints may differ in.
SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: First bit and length of a fingerprint's blocks. Links of up to THRESHOLD bits are sought in the first two of them; links of
#: more bits in each pair, as one of the pairs has two thirds of the differing bits at most.
BLOCKS = ((0, 23), (23, 23), (46, 18))
ONE_TABLE, ALL_TABLES = ((0, 1),), ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the perfect code [23, 12] of covering radius 3 (Golay's): x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR, LENGTH, CHECK = 0b110001110101, 23, 11
_CHUNK = 1 << 16
#: The similarity join: least Jaccard similarity of two texts' shingle sets, 64-bit fingerprints of a text (each names an anchor in
#: each pair of blocks), how many of them are compared where texts meet, and rows of an anchor that one task compares.
SIMILARITY, PRINTS, COMPARED, CELL = 0.8, 48, 6, 50_000
#: Fingerprints whose anchors are looked at before the others', so that nodes that they have brought together don't meet again.
EARLY = 6
#: Standard deviations of a distance that the comparison allows for.
ALLOWED = 3.0
#: Buckets of shingle hashes (their first nine bits) whose counts bound how many shingles two texts share.
BUCKETS, BUCKET_SHIFT = 512, 55


def shingle_hashes(text: str, shingle: int = SHINGLE):
    """The XXH64 of the text's shingles in order, some at a time; none without words."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: exactly the six ASCII blanks, and A-Z alone are lowered
    if not words:
        return
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half the hashes of the text's shingles, repeats included; 0 without words."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def wide_fingerprint(hashes: np.ndarray, prints: int) -> np.ndarray:
    """`prints` fingerprints of 64 bits of a set of hashes, each from the hashes mixed anew by its number; zeros of none."""
    keys = np.arange(1, prints + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(64 * prints, np.int64)
    for at in range(0, len(hashes), 255):  # sums of 255 bits fit a byte, so eight of them are added at once
        mixed = (hashes[at : at + 255, None] ^ keys) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits.view(np.uint64), axis=0).view(np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x or "", shingle) for x in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "text"), pa.array(found)], [*(c for c in batch.schema.names if c != "text"), "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long. Null texts count as empty."""
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _syndrome(x: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if x >> bit & 1:
            x ^= GENERATOR << (bit - CHECK)
    return x


def _tables(threshold: int):
    """The pairs of blocks that name anchors, and how many bits links differ in within one of them at most."""
    return (ONE_TABLE, threshold) if threshold <= THRESHOLD else (ALL_TABLES, 2 * threshold // 3)


@lru_cache(None)
def _reach(within: int, length: int):
    """For each syndrome: differences to the codewords nearest to words that differ in `within` of the first `length` bits at most, and how many bits must flip for each; padded with cost 9."""
    patterns = [sum(1 << b for b in c) for w in range(4) for c in combinations(range(LENGTH), w)]
    leader = {}
    for p in patterns:
        leader.setdefault(_syndrome(p), p)
    flips = [sum(1 << b for b in c) for w in range(within + 1) for c in combinations(range(length), w)]
    table = []
    for s in range(1 << CHECK):
        cost: dict[int, int] = {}
        for f in flips:
            e = f ^ leader[s ^ _syndrome(f)]
            cost[e] = min(cost.get(e, 9), f.bit_count())
        table.append(sorted(cost.items(), key=lambda x: x[1]))
    width = max(map(len, table))
    steps = np.array([[e for e, _ in row] + [0] * (width - len(row)) for row in table], np.int64)
    costs = np.array([[c for _, c in row] + [9] * (width - len(row)) for row in table], np.int8)
    bits = np.array([_syndrome(1 << b) for b in range(LENGTH)], np.int64)
    return steps, costs, bits


def _block(fp: np.ndarray, block: int, within: int):
    """Codewords around one block of the fingerprints, and the bits that must flip for each to be the nearest; the first is the nearest of the block itself. Shorter blocks are filled up with zeros."""
    at, length = BLOCKS[block]
    x = (fp >> at) & ((1 << length) - 1)
    steps, costs, bits = _reach(within, length)
    s = np.zeros(len(x), np.int64)
    for b in range(length):
        s ^= np.where(x >> b & 1, bits[b], 0)
    return x[:, None] ^ steps[s], costs[s]


def anchors(fp: np.ndarray, pair: tuple[int, int] = ONE_TABLE[0], within: int = THRESHOLD):
    """Home anchor of each fingerprint; and rows (index of fingerprint, anchor) of all anchors that are home to some fingerprint differing in `within` bits of the pair's blocks at most.

    An anchor is a pair of codewords, one for each block of the pair. It can be home to a fingerprint that differs from x in
    t bits only if its distance from x is within the blocks' covering radii plus t; the table holds just those, so two
    fingerprints within the threshold meet at the home of either.
    """
    x = fp.view(np.int64)
    (a, ca), (b, cb) = (_block(x, block, within) for block in pair)
    key = lambda u, v: (u >> CHECK) << 12 | v >> CHECK  # noqa: E731  the code is systematic: 12 bits name a codeword
    home = key(a[:, 0], b[:, 0])
    near = ca[:, :, None].astype(np.int16) + cb[:, None, :] <= within
    i, j, k = np.nonzero(near)
    return home, i, key(a[i, j], b[i, k])


def _homes(threshold: int):
    pairs, within = _tables(threshold)

    def run(batches):
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 1024):
                part = np.ascontiguousarray(fp[at : at + 1024])
                for table, pair in enumerate(pairs):
                    home, _, _ = anchors(part, pair, within)
                    yield pa.RecordBatch.from_arrays([pa.array(home | table << 24), pa.array(part)], ["anchor", "fp"])

    return run


def _probes(threshold: int):
    pairs, within = _tables(threshold)

    def run(batches):
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 1024):
                part = np.ascontiguousarray(fp[at : at + 1024])
                for table, pair in enumerate(pairs):
                    _, i, anchor = anchors(part, pair, within)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor | table << 24), pa.array(part[i])], ["anchor", "probe"])

    return run


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """a < b: all pairs of the distinct fingerprints fp within `threshold` bits, each once: from the first pair of blocks that must show it."""
    pairs, within = _tables(threshold)
    homes = distinct.select("fp").mapInArrow(_homes(threshold), "anchor long, fp long")
    probes = distinct.select("fp").mapInArrow(_probes(threshold), "anchor long, probe long")
    apart = homes["fp"].bitwiseXOR(probes["probe"])
    near = (homes["anchor"] == probes["anchor"]) & (homes["fp"] < probes["probe"]) & (F.bit_count(apart) <= threshold)
    if len(pairs) > 1:
        first = F.lit(len(pairs))
        for table in reversed(range(len(pairs))):
            mask = sum((1 << length) - 1 << at for at, length in (BLOCKS[b] for b in pairs[table]))
            signed = mask - (1 << 64) if mask >> 63 else mask
            first = F.when(F.bit_count(apart.bitwiseAND(F.lit(signed))) <= within, F.lit(table)).otherwise(first)
        near = near & (F.shiftright(homes["anchor"], 24) == first)
    return homes.join(probes, near).select(F.col("fp").alias("a"), F.col("probe").alias("b"))


def connected(edges: DataFrame) -> DataFrame:
    """node and root, the least node that it reaches, for all nodes of the links a, b.

    Each round takes the least root among a node's neighbours and then that root's own root, so that roots travel further
    each round. Rounds are cut by checkpoint(); only the number of changed rows comes to the driver.
    """
    both = cut(edges.union(edges.select("b", "a")).toDF("node", "next"))
    roots = cut(both.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("root")))
    while True:
        around = both.join(roots.withColumnsRenamed({"node": "next", "root": "seen"}), "next").groupBy("node").agg(F.min("seen").alias("seen"))
        step = roots.join(around, "node").select("node", F.least("root", "seen").alias("root"), F.col("root").alias("old"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
        moved = cut(step.join(jump, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("old")).alias("moved")))
        roots = moved.select("node", "root")
        if moved.filter("moved").isEmpty():
            return roots


def components(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of the documents; fp, n, first_id and component_id of each distinct fingerprint).

    Equal fingerprints are one node, so copies, however many, are counted once before anything is compared.
    component_id is the least doc_id that links reach; null if no row of the component has an id.
    """
    marked = cut(fingerprints(docs, shingle))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = connected(links(distinct, threshold)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked, rooted.join(least, "root").select("fp", "n", "first_id", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, a row for each row of docs; other columns of docs are left out.

    Empty tables give none; rows of equal or null doc_id are each judged by their text; texts of fewer words than a shingle
    are one shingle, texts without words have fingerprint zero and are linked like any other.
    """
    marked, nodes = components(docs, shingle, threshold)
    named = nodes.select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _rows_of(docs: DataFrame, key: str, heads: DataFrame) -> DataFrame:
    """The rows of docs that heads names by doc_id and hash of the text, in the column best; of several one."""
    kept = heads.select(F.col("best.doc_id").alias("kept_id"), F.col("best.key").alias("kept_key"))
    keyed = docs.withColumn(key, F.xxhash64(whole_text()))
    rows = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["kept_id"]) & (keyed[key] == kept["kept_key"]), "left_semi")
    return rows.groupBy("doc_id", key).agg(F.min(F.struct(*docs.columns)).alias("row_")).select("row_.*")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """docs with one row of each component left: that of the least doc_id, null being the largest.

    Of rows that share that doc_id, the one whose text has the least hash stays, and of rows alike in both the least in its
    other columns. Rows are compared in aggregates only, so copies, however many, are reduced before they are shuffled.
    """
    key = free_name(docs, "text_key_")
    marked = cut(docs.select("doc_id", F.xxhash64(whole_text()).alias("key"), whole_text().alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, key long, fp long"))
    distinct = cut(marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")))
    roots = connected(links(distinct, threshold)).withColumnRenamed("node", "fp")
    heads = distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    return _rows_of(docs, key, heads)


def _wide(shingle: int, prints: int):
    """doc_id, key, node and prints: node is a digest of the text's set of shingles, so that only texts of equal sets share one."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x or "", shingle) for x in batch["text"].to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            found = [wide_fingerprint(x, prints).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(nodes), pa.array(found, pa.binary())], ["doc_id", "key", "node", "prints"])

    return run


def apart_at_most(similarity: float, bits: int, more: float = ALLOWED) -> int:
    """How many of `bits` fingerprint bits two texts of this Jaccard similarity and like length differ in, with `more` standard deviations on top."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * share + more * (bits * share * (1 - share)) ** 0.5)


def _at_anchors(part: slice):
    """Rows key, node, family: each node at its home anchor in each pair of blocks of each of its fingerprints in the part. key: the anchor, then 32 bits of the first fingerprint."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = np.frombuffer(b"".join(batch["prints"].to_pylist()), np.int64).reshape(batch.num_rows, -1)
            first = fp[:, 0] & 0xFFFFFFFF
            for number in range(fp.shape[1])[part]:
                for table, pair in enumerate(ALL_TABLES):
                    home, _, _ = anchors(np.ascontiguousarray(fp[:, number]), pair, 0)
                    key = pa.array((home | (number * len(ALL_TABLES) + table) << 24) << 32 | first)
                    yield pa.RecordBatch.from_arrays([key, batch["node"], batch["family"]], ["key", "node", "family"])

    return run


def _shared(most: int):
    """anchor and node: of rows in order of key those that meet one of another family at their anchor whose bits of the first fingerprint differ in `most` places at most, whatever batches cut the order. Family 0: a node by itself."""

    def kept(key, node, family):
        anchor, first = key >> 32, (key & 0xFFFFFFFF).view(np.uint64)
        family = np.where(family == 0, node, family)
        starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
        stops = np.append(starts[1:], len(anchor))[: len(starts)]
        keep = np.zeros(len(anchor), bool)
        two = starts[stops - starts == 2]
        near = two[(np.bitwise_count(first[two] ^ first[two + 1]) <= most) & (family[two] != family[two + 1])]
        keep[near], keep[near + 1] = True, True
        for a, b in zip(starts[stops - starts > 2], stops[stops - starts > 2], strict=True):
            if (family[a:b] == family[a]).all():
                continue
            for i in range(a, b):
                keep[i] = ((np.bitwise_count(first[a:b] ^ first[i]) <= most) & (family[a:b] != family[i])).any()
        return pa.RecordBatch.from_arrays([pa.array(anchor[keep]), pa.array(node[keep])], ["anchor", "node"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            columns = [np.concatenate([h, batch[c].to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("key", "node", "family"), strict=True)]
            key = columns[0]
            whole = int(np.searchsorted(key, key[-1] >> 32 << 32)) if len(key) else 0  # the last anchor may go on in the next batch
            held = [c[whole:] for c in columns]
            yield kept(*(c[:whole] for c in columns))
        yield kept(*held)

    return run


def _met(prints: np.ndarray, most: int):
    """Links (two places) that connect what is within `most` bits among the nodes at one anchor, directly or by others: each node found
    is compared with those not found yet, so a group of near copies costs little more than its size, and links are fewer than nodes.
    """
    open_, found = np.arange(1, len(prints)), []
    queue, at = [0], 0
    while len(open_):
        if at == len(queue):
            queue.append(open_[0])
            open_ = open_[1:]
        me = queue[at]
        at += 1
        if len(open_):
            near = np.bitwise_count(prints[open_] ^ prints[me]).sum(1, dtype=np.int32) <= most
            found.extend((me, x) for x in open_[near])
            queue.extend(open_[near])
            open_ = open_[~near]
    return found


def _may_share(counts: np.ndarray, rest: np.ndarray, sizes: np.ndarray, me: int, others: np.ndarray, similarity: float):
    """Those of the others that may have `similarity` with me, by the sizes of their sets and the counts of their buckets; and the most they may have.

    Never fewer than there are: two sets share no more of a bucket than the lesser count, and of the shingles that counts of
    255 leave out (rest) no more than the lesser number.
    """
    both = np.minimum(counts[others], counts[me]).sum(1, dtype=np.int64) + np.minimum(rest[others], rest[me])
    union = sizes[others] + sizes[me] - both
    may = both >= similarity * union
    return others[may], both[may] / np.maximum(union[may], 1)


def _still_apart(prints: np.ndarray, homes: np.ndarray, roots: np.ndarray, counts: np.ndarray, sizes: np.ndarray, most: int, similarity: float, likeliest: bool):
    """All pairs (two places) of different roots among the nodes of a cell that share a home, are within `most` bits and may be alike, each once.

    likeliest: of each node's pairs only the one that may be most alike, for a first round.
    """
    names, own = np.unique(roots, return_inverse=True)
    largest = own == np.argmax(np.bincount(own, minlength=len(names)))  # it needs no row of its own: the others name its nodes
    rest, found = sizes - counts.sum(1, dtype=np.int64), []
    for me in np.flatnonzero(~largest):
        others = np.flatnonzero((own != own[me]) & (largest | likeliest | (np.arange(len(own)) > me)))
        others = others[np.bitwise_count(prints[others] ^ prints[me]).sum(1, dtype=np.int32) <= most]
        others, share = _may_share(counts, rest, sizes, me, others, similarity)
        meet = (homes[others] == homes[me]).any(1)
        others, share = others[meet], share[meet]
        found.extend((me, x) for x in (others[[np.argmax(share)]] if likeliest and len(others) else others))
    return found


def _matrix(column, kind) -> np.ndarray:
    """A row of numbers for each byte string of the column, all of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _pairs_of_cells(pairs, columns: list[str]):
    """For rows in order of cell: the columns of both rows of each pair that `pairs` finds in a cell's rows, whatever batches cut the cells."""

    def work(table):
        cell = table["cell"].to_numpy()
        cuts = np.flatnonzero(np.diff(cell)) + 1
        places = pairs(table, np.concatenate([[0], cuts]), np.concatenate([cuts, [len(cell)]]))
        found = [table[c].to_numpy()[places[:, side]] for side in (0, 1) for c in columns]
        return pa.RecordBatch.from_arrays(list(map(pa.array, found)), [*columns, *(f"other_{c}" for c in columns)])

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch["cell"][-1]
            if held[0]["cell"][0] == last:
                continue
            table = pa.Table.from_batches(held)
            whole = int(np.searchsorted(table["cell"].to_numpy(), last.as_py()))  # the last cell may go on in the next batch
            yield work(table.slice(0, whole))
            held = table.slice(whole).to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _together(found: list) -> np.ndarray:
    return np.concatenate([np.zeros((0, 2), np.int64), *found])


def _trees(most: int):
    """Links that connect each cell."""

    def pairs(table, starts, stops):
        prints = _matrix(table["prints"], np.uint64)
        two = starts[stops - starts == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]).sum(1, dtype=np.int32) <= most]
        found = [np.stack([two, two + 1], axis=1)]
        for a, b in zip(starts, stops, strict=True):
            if b - a > 2 and (met := _met(prints[a:b], most)):
                found.append(np.array(met) + a)
        return _together(found)

    return _pairs_of_cells(pairs, ["node"])


def _crossing(compared: int, similarity: float, likeliest: bool):
    """Pairs of each cell that meet at an anchor, may be alike and have different roots."""
    most = apart_at_most(similarity, 64 * compared)

    def pairs(table, starts, stops):
        prints, counts = _matrix(table["prints"], np.uint64), _matrix(table["counts"], np.uint8)
        homes = [anchors(np.ascontiguousarray(fp), pair, 0)[0].astype(np.int32) for fp in prints.T for pair in ALL_TABLES]
        homes, prints = np.stack(homes, axis=1), np.ascontiguousarray(prints[:, :compared])
        roots, sizes = table["root"].to_numpy(), table["size"].to_numpy()
        found = []
        for a, b in zip(starts, stops, strict=True):
            if met := _still_apart(prints[a:b], homes[a:b], roots[a:b], counts[a:b], sizes[a:b], most, similarity, likeliest):
                found.append(np.array(met) + a)
        return _together(found)

    return _pairs_of_cells(pairs, ["node"])


def _prints(distinct: DataFrame, compared: int) -> DataFrame:
    return distinct.select("node", F.substring("prints", 1, 8 * compared).alias("prints"))


def _in_order(cells: DataFrame) -> DataFrame:
    return cells.repartition("cell").sortWithinPartitions("cell", "node")


def _parted(rows: DataFrame, cell_rows: int) -> DataFrame:
    """Rows with `anchor` turned into `cell`: an anchor of more than cell_rows rows is cut into parts, and each two of its parts make a
    cell, so that any two of its nodes still meet."""
    counts = rows.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows)
    hot = cut(counts.select("anchor", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts")))
    if hot.isEmpty():
        return rows.withColumnRenamed("anchor", "cell")
    own, parts = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.coalesce("parts", F.lit(1))
    split = rows.join(hot, "anchor", "left").withColumn("parts", parts).withColumn("own", own)
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other")).alias("cell")
    return split.select(cell, *(c for c in rows.columns if c != "anchor"))


def meeting_cells(nodes: DataFrame, part: slice, similarity: float = SIMILARITY, cell_rows: int = CELL) -> DataFrame:
    """cell and node: the nodes at each anchor of the part's fingerprints where two or more of different families meet, other than by
    chance as half of their first fingerprints tells.

    nodes: node, prints and family. Rows of 24 bytes are dealt by anchor; families are 0 for most nodes.
    """
    rows = nodes.select("node", "prints", "family").mapInArrow(_at_anchors(part), "key long, node long, family long")
    rows = rows.repartition(F.shiftright("key", 32)).sortWithinPartitions("key")
    return _parted(cut(rows.mapInArrow(_shared(apart_at_most(similarity, 32)), "anchor long, node long")), cell_rows)


def gathered(edges: DataFrame) -> DataFrame:
    """connected(), once each node's links have been drawn to its least neighbour: the many links of a dense group fall together before the rounds begin."""
    ends = edges.union(edges.select("b", "a")).toDF("node", "next")
    least = cut(ends.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("near")))
    fewer = edges.join(least.toDF("a", "low"), "a").join(least.toDF("b", "high"), "b").filter(F.col("low") != F.col("high"))
    fewer = cut(fewer.select(F.least("low", "high").alias("a"), F.greatest("low", "high").alias("b")).distinct())
    roots = connected(fewer).toDF("near", "root")
    return cut(least.join(roots, "near", "left").select("node", F.coalesce("root", "near").alias("root")))


def meetings(distinct: DataFrame, similarity: float = SIMILARITY, compared: int = COMPARED, cell_rows: int = CELL) -> DataFrame:
    """a < b, each once: links between nodes that share an anchor and whose first `compared` fingerprints are near enough for `similarity`.

    What meets in a cell is compared in one task; only links that connect it come out, so a link may be missing where others
    connect its nodes. The anchors of EARLY fingerprints come first: what their links connect is a family, and at the others' anchors
    only nodes of different families are compared, so that a group of near copies doesn't come again at each of them.
    """

    def found(families: DataFrame, part: slice) -> DataFrame:
        cells = meeting_cells(families, part, similarity, cell_rows)
        rows = cells.join(_prints(distinct, compared), "node").select("cell", "node", "prints")
        links = _in_order(rows).mapInArrow(_trees(apart_at_most(similarity, 64 * compared)), "node long, other_node long")
        return cut(links.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct())

    early = found(distinct.select("node", "prints", F.lit(0).cast("long").alias("family")), slice(EARLY))
    families = distinct.join(gathered(early), "node", "left").withColumn("family", F.coalesce("root", F.lit(0)))
    return early.union(found(families, slice(EARLY, None))).distinct()


def families_apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """anchor and node: the nodes that links of `met` connect, directly or by others, where they have several roots; anchor names them.

    roots: node and root of all nodes of met. Links of one root and families of two nodes, whose only pair is in met, are left out.
    """
    apart = met.join(roots.toDF("a", "root_a"), "a").join(roots.toDF("b", "root_b"), "b").filter(F.col("root_a") != F.col("root_b"))
    joined = gathered(cut(apart.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct()))
    rows = cut(roots.join(joined.toDF("root", "anchor"), "root").select("anchor", "node"))
    return rows.join(rows.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > 2).select("anchor"), "anchor", "left_semi")


def crossings(cells: DataFrame, details: DataFrame, roots: DataFrame, similarity: float, compared: int, likeliest: bool) -> DataFrame:
    """a < b, each once: all pairs of a cell's nodes whose roots differ, that share an anchor, whose first `compared` fingerprints
    are near enough for `similarity` and that may have it, as the sizes of their sets and the counts of their buckets tell.

    details: node, size, counts and prints of all nodes of the cells; roots: node and root. No pair is left out for the number of
    its nodes' others, but with likeliest each node names the one pair that may be most alike.
    """
    rows = cells.join(details.join(roots, "node"), "node")
    found = _in_order(rows).mapInArrow(_crossing(compared, similarity, likeliest), "node long, other_node long")
    return found.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(x or "", shingle) for x in batch["text"].to_pylist()]
            counts = [np.minimum(np.bincount((x >> np.uint64(BUCKET_SHIFT)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes() for x in sets]
            columns = [batch["node"], pa.array(map(len, sets), pa.int64()), pa.array(counts, pa.binary()), pa.array([x.view(np.int64).tolist() for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "size", "counts", "shingles"])

    return run


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose shingle sets have a Jaccard similarity of `similarity` or more."""
    named = sets.select("node", "shingles")
    both = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(named.toDF("a", "sa"), "a").join(named.toDF("b", "sb"), "b").withColumn("both", both)
    return found.filter(F.col("both") >= similarity * (F.size("sa") + F.size("sb") - F.col("both"))).select(*pairs.columns)


def _stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again. A checkpoint() would keep what the optimizer has inferred of df's columns, which
    multiplies with each join and union of the same links: planning took minutes."""
    spark = df.sparkSession
    folder = scratch(spark, "links")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def keep_dissimilar(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, prints: int = PRINTS) -> DataFrame:
    """docs with one row of each group of similar texts left: that of the least doc_id, null being the largest.

    Two texts are linked if their shingle sets have a Jaccard similarity of `similarity` or more and they meet: each text has
    `prints` SimHash fingerprints, each of which is sent to its anchor (the codeword within the covering radius) in each pair of
    blocks. A pair of similarity 0.8 shares one of the 144 anchors in about 9 cases of 10, one of 0.9 nearly always; texts of equal
    shingle sets are one node. Links that connect what meets at the anchors are held against the shingle sets, exactly, before they
    count. Where some of them fail, all pairs that meet among the nodes that links connect, directly or by others, are held against
    the sets too if they are not in one group yet, but for those that the counts of their shingles rule out; the likeliest come
    first, which leaves few. Groups are what verified links connect, and no link found is lost. Texts without words are alike. Of rows that share the kept doc_id the one whose text
    has the least hash stays, of rows alike in both the least in its other columns. An empty table gives an empty one.
    """
    key = free_name(docs, "text_key_")
    keyed = docs.select("doc_id", F.xxhash64(whole_text()).alias("key"), whole_text().alias("text"))
    marked = cut(keyed.mapInArrow(_wide(shingle, prints), "doc_id long, key long, node long, prints binary"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")
    distinct = cut(marked.groupBy("node").agg(F.first("prints").alias("prints"), best))
    met = _stored(meetings(distinct, similarity))
    linked = met.select("a").union(met.select("b")).distinct().toDF("node")
    texts = distinct.join(linked, "node").select("node", F.col("best.doc_id").alias("best_id"), F.col("best.key").alias("best_key"))
    whole = keyed.join(texts, keyed["doc_id"].eqNullSafe(texts["best_id"]) & (keyed["key"] == texts["best_key"])).dropDuplicates(["node"])
    sets = cut(whole.select("node", "text").mapInArrow(_sets(shingle), "node long, size long, counts binary, shingles array<long>"))

    def rooted(links: DataFrame) -> DataFrame:
        return _stored(sets.select("node").join(gathered(links), "node", "left").select("node", F.coalesce("root", "node").alias("root")))

    links = _stored(_alike(met, sets, similarity))
    roots, tried = rooted(links), met
    cells = cut(_parted(families_apart(met, roots), CELL))
    details = cut(sets.select("node", "size", "counts").join(distinct.select("node", "prints"), "node"))
    for likeliest in (True, False):
        across = _stored(crossings(cells, details, roots, similarity, COMPARED, likeliest).join(tried, ["a", "b"], "left_anti"))
        links, tried = _stored(links.union(_alike(across, sets, similarity))), tried.union(across)
        roots = rooted(links)
    heads = distinct.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    return _rows_of(docs, key, heads)


def op6(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
