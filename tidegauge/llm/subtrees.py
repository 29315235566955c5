"""Exact removal of repeated runs of words: suffix trees, partitioned by variable-length prefixes into groups that fit into memory."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

from tidegauge.llm.common import whole_text
from tidegauge.llm.suffixes import BLOCKS_A_TASK, _by_range, _gram_hashes, _range_of, _rank, in_blocks

#: Words of a repeated window, and of the short prefix by which suffixes are grouped first.
WIDTH, PREFIX = 35, 8
SIDE = WIDTH - PREFIX
#: Bytes of text of one block, about; families of suffixes of one short prefix above which its suffixes are grouped by prefixes
#: of all WIDTH words instead.
BLOCK_BYTES, HOT = 2 << 20, 20_000
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of data, from differences of running sums."""
    from tidegauge.llm.suffixes import _powers

    n = len(data)
    up, down = _powers(1 << max(19, n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _least_place(h: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of each run of `span` values, the first of several."""
    at, step = np.arange(len(h)), 1
    pick = lambda a, b: np.where(h[b] < h[a], b, a)
    while 2 * step <= span:
        at = pick(at[:-step], at[step:])
        step *= 2
    return pick(at[: len(at) - (span - step)], at[span - step :]) if span > step else at


class Block:
    """The words of a block's texts, and its families: runs of neighbouring suffixes whose first WIDTH words share one anchor,
    the PREFIX words of least hash among them. The family has one place in the tree, its anchor's, in place of one a suffix."""

    def __init__(self, table: pa.Table):
        self.texts = [(x or "").encode() for x in table["text"].to_pylist()]
        hashes, counts = [np.zeros(0, np.uint64)], []
        for at in range(0, len(self.texts), 64):
            data = np.frombuffer(b" ".join(self.texts[at : at + 64]) + b" ", np.uint8)
            blank = _BLANK[data]
            edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
            starts, ends = edge[::2], edge[1::2]
            hashes.append(_word_hashes(data, starts, ends))
            bounds = np.cumsum([len(x) + 1 for x in self.texts[at : at + 64]])
            counts.append(np.diff(np.concatenate([[0], np.searchsorted(starts, bounds)])))
        self.words = np.concatenate(hashes)
        self.counts = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        self._families()

    def _families(self) -> None:
        """prefix, at (the anchor), back and left: the family's suffixes start back to left words before the anchor, back being the least."""
        n = len(self.words) - WIDTH + 1
        if n < 1:
            self.prefix, self.at, self.back, self.left = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
            return
        h = _gram_hashes(self.words, PREFIX)
        owner = _least_place(h, SIDE + 1)
        inside = np.zeros(len(self.words) + 1, np.int64)
        long = self.counts >= WIDTH
        np.add.at(inside, self.offsets[:-1][long], 1)
        np.add.at(inside, self.offsets[1:][long] - WIDTH + 1, -1)
        starts = np.flatnonzero(np.cumsum(inside)[:n] > 0)
        new = np.ones(len(starts), bool)
        new[1:] = (owner[starts][1:] != owner[starts][:-1]) | (np.diff(starts) > 1)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(starts)]])[: len(first)] - 1
        self.at = owner[starts[first]]
        self.left, self.back = self.at - starts[first], self.at - starts[last]
        even = h[self.at] * np.uint64(0x9FB21C651E98DF25)  # least hashes are small ones: mixed again, they spread evenly
        self.prefix = even ^ (even >> np.uint64(32))

    def contexts(self, keep: np.ndarray):
        """The families keep, alike ones once: for each of keep its context's number; of each context, in order of prefix: prefix, lengths left and right of the anchor, words (zero beyond those lengths), how many families."""
        at, left, right = self.at[keep], self.left[keep], SIDE - self.back[keep]
        padded = np.concatenate([np.zeros(SIDE, np.uint64), self.words, np.zeros(WIDTH, np.uint64)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, PREFIX + 2 * SIDE)[at].copy() if len(at) else np.zeros((0, PREFIX + 2 * SIDE), np.uint64)
        places = np.arange(SIDE)
        rows[:, :SIDE][places < SIDE - left[:, None]] = 0
        rows[:, SIDE + PREFIX :][places >= right[:, None]] = 0
        digest = np.zeros(len(at), np.uint64)
        for c in (*range(PREFIX + 2 * SIDE), left.astype(np.uint64), right.astype(np.uint64)):
            digest = (digest ^ (rows[:, c] if isinstance(c, int) else c)) * np.uint64(0x9E3779B97F4A7C15)
            digest ^= digest >> np.uint64(29)
        prefix = self.prefix[keep]
        order = np.lexsort((digest, prefix))
        new = np.ones(len(at), bool)
        new[1:] = (digest[order][1:] != digest[order][:-1]) | (rows[order][1:] != rows[order][:-1]).any(1)
        group = np.empty(len(at), np.int64)
        group[order] = np.cumsum(new) - 1
        heads = order[new]
        return group, prefix[heads], left[heads], right[heads], rows[heads], np.bincount(group, minlength=len(heads))


def _one(block: int, **columns) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table({"block_": pa.array(np.full(n, block), pa.int64()), **{name: pa.array(x) for name, x in columns.items()}})


def _prefixes(table: pa.Table) -> pa.Table:
    """The block's distinct short prefixes and how many families have each."""
    values, counts = np.unique(Block(table).prefix, return_counts=True)
    return _one(table["block_"][0].as_py() if table.num_rows else 0, prefix=values.view(np.int64), n=counts.astype(np.int64))


class Chosen:
    """A block's families that may have a repeated suffix, worked out alike in both passes that need them: the contexts of
    those with a short prefix (cold), and the suffixes of those with a hot one."""

    def __init__(self, table: pa.Table, groups: pa.Table, ranges: int):
        self.own = own = Block(table)
        known = groups["prefix"].to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, hot = known[order], groups["hot"].to_numpy(zero_copy_only=False)[order]
        place = np.minimum(np.searchsorted(known, own.prefix), max(len(known) - 1, 0))
        there = known[place] == own.prefix if len(known) else np.zeros(len(own.prefix), bool)
        self.cold = np.flatnonzero(there & ~hot[place]) if len(known) else np.zeros(0, np.int64)
        self.group, prefix, self.left, self.right, self.rows, self.n = own.contexts(self.cold)
        part = _range_of(prefix, ranges).astype(np.int64)
        self.sent = np.argsort(part, kind="stable")
        self.part = part[self.sent]
        self._long_prefixes(np.flatnonzero(there & hot[place]) if len(known) else np.zeros(0, np.int64), ranges)

    def _long_prefixes(self, families: np.ndarray, ranges: int) -> None:
        """Suffixes of the families: starts, the number of each one's prefix of WIDTH words; of each prefix two hashes and how many suffixes."""
        own, size = self.own, self.own.left[families] - self.own.back[families] + 1
        self.starts = np.repeat(own.at[families] - own.left[families], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        a, b = np.zeros(len(self.starts), np.uint64), np.zeros(len(self.starts), np.uint64)
        for c in range(WIDTH):
            word = own.words[self.starts + c]
            a = (a ^ word) * np.uint64(0x9E3779B97F4A7C15)
            a ^= a >> np.uint64(32)
            b = (b + word) * np.uint64(0xD6E8FEB86659FD93)
            b ^= b >> np.uint64(31)
        part = ranges + _range_of(a, ranges).astype(np.int64)
        order = np.lexsort((b, a, part))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        self.long = np.empty(len(a), np.int64)
        self.long[order] = np.cumsum(new) - 1
        heads = order[new]
        self.long_a, self.long_b, self.long_part, self.long_n = a[heads], b[heads], part[heads], np.bincount(self.long, minlength=len(heads))


_BLOBS = "part long, block_ long, n long, blob binary"


def _blobs(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "block_", "n", "blob"])


def _send(ranges: int):
    def send(table: pa.Table, groups: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _blobs([])
        block, out, press = table["block_"][0].as_py(), Chosen(table, groups, ranges), zstandard.ZstdCompressor(level=3).compress
        many = lambda n: np.minimum(n, 2).astype(np.uint8).tobytes()
        side = lambda x: x.astype(np.uint8).tobytes()
        rows = []
        for r, s in _by_range(out.part):
            own = out.sent[s]
            rows.append((r, block, len(own), press(many(out.n[own]) + side(out.left[own]) + side(out.right[own]) + out.rows[own].tobytes())))
        for r, s in _by_range(out.long_part):
            rows.append((r, block, s.stop - s.start, many(out.long_n[s]) + out.long_a[s].tobytes() + out.long_b[s].tobytes()))
        return _blobs(rows)

    return send


def deep_nodes(rows: np.ndarray, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits per context: bit k is set if the suffix that starts k words before the anchor lies below an internal node of depth WIDTH.

    The trees of all prefixes of a group grow together, a level a step: nodes are numbered, and a node's children are told
    apart by their next word. First the anchors' words; contexts that are alone below their node, and are one family, leave.
    Then a word a level on either side of the anchor: the node k words to the left and that SIDE - k words to the right fix
    the suffix's WIDTH words. A node of that depth with two leaves or more is an internal node: a repeat, which is maximal
    where the nodes of its neighbouring suffixes aren't.
    """
    out = np.zeros(len(rows), np.uint32)
    live, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    for c in range(PREFIX):
        node = _rank(node, rows[live, SIDE + c])
        alone = np.bincount(node, weights=n[live])[node] < 2
        live, node = live[~alone], node[~alone]
    if not len(live):
        return out
    to_left, to_right = [node], [node]
    for c in range(SIDE):
        to_left.append(_rank(to_left[-1], rows[live, SIDE - 1 - c]))
        to_right.append(_rank(to_right[-1], rows[live, SIDE + PREFIX + c]))
    for k in range(SIDE + 1):
        there = np.flatnonzero((left[live] >= k) & (right[live] >= SIDE - k))
        if len(there):
            deep = _rank(to_left[k][there], to_right[SIDE - k][there])
            leaves = np.bincount(deep, weights=n[live[there]])[deep]
            out[live[there]] |= (leaves >= 2).astype(np.uint32) << np.uint32(k)
    return out


def _judge(ranges: int):
    """One group: contexts are answered with bits, prefixes of all WIDTH words with a byte, 1 for those of two suffixes or more."""

    def judge(table: pa.Table) -> pa.Table:
        part, counts, blocks = table["part"][0].as_py(), table["n"].to_pylist(), table["block_"].to_pylist()
        blobs, cuts = table["blob"].to_pylist(), np.cumsum([0, *counts])
        piece = lambda kind, start, wide=1: np.concatenate([np.frombuffer(x, kind, m * wide, start * m) for x, m in zip(blobs, counts, strict=True)])
        if part < ranges:
            blobs = [zstandard.ZstdDecompressor().decompress(x) for x in blobs]
            wide = PREFIX + 2 * SIDE
            found = deep_nodes(piece(np.uint64, 3, wide).reshape(-1, wide), piece(np.uint8, 1), piece(np.uint8, 2), piece(np.uint8, 0))
        else:
            node = _rank(piece(np.uint64, 1), piece(np.uint64, 9))
            found = (np.bincount(node, weights=piece(np.uint8, 0))[node] >= 2).astype(np.uint8)
        return _blobs([(part, b, m, found[i:j].tobytes()) for b, m, i, j in zip(blocks, counts, cuts, cuts[1:], strict=False)])

    return judge


def _finish(ranges: int, schema: pa.Schema, keep_text: bool):
    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        asked, answers = told.filter(told["blob"].is_null()), told.filter(told["blob"].is_valid())
        out = Chosen(table, asked, ranges)
        own, by = out.own, dict(zip(answers["part"].to_pylist(), answers["blob"].to_pylist(), strict=True))
        flags, long = np.zeros(len(out.rows), np.uint32), np.zeros(len(out.long_a), bool)
        for r, s in _by_range(out.part):
            flags[out.sent[s]] = np.frombuffer(by[r], np.uint32)
        for r, s in _by_range(out.long_part):
            long[s] = np.frombuffer(by[r], np.uint8) > 0
        starts = [out.starts[long[out.long]]]
        for k in range(SIDE + 1):
            starts.append(own.at[out.cold[(flags[out.group] >> np.uint32(k)) & np.uint32(1) > 0]] - k)
        edge = np.zeros(len(own.words) + WIDTH + 1, np.int32)
        at = np.concatenate(starts)  # each suffix belongs to one family, so it comes once
        edge[at] += 1
        np.add.at(edge, at + WIDTH, -1)
        gone = np.cumsum(edge[: len(own.words)]) > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        removed, kept = before[own.offsets[1:]] - before[own.offsets[:-1]], []
        for text, n, a, b in zip(own.texts, removed, own.offsets, own.offsets[1:], strict=False):
            words = text.split()
            kept.append(b" ".join([w for w, x in zip(words, gone[a:b].tolist(), strict=True) if not x] if n else words))
        new = {"n_words": pa.array(own.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept])}
        if keep_text:
            new["kept_text"] = pa.array([x.decode() for x in kept])
        rest = table.drop_columns([c for c in ("block_", *new) if c in table.column_names])
        for name, values in new.items():
            rest = rest.append_column(name, values)
        return rest.select(schema.names).cast(schema)

    return finish


def remove_repeated_words(docs: DataFrame, block_bytes: int = BLOCK_BYTES, keep_text: bool = True, hot: int = HOT) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and kept_text: each word goes that a window of WIDTH words covers whose words also start anywhere else, the same document included.

    Suffixes start at every word. Those that lie next to each other share nearly all their words, so they travel as families
    under one anchor, which any window has at the same place in all its copies. The texts are dealt once to blocks; passes
    over the blocks use that same exchange. (1) Blocks tell their distinct short prefixes, PREFIX words at the anchors, with
    counts. A prefix of one family in all is a leaf and goes no further. One with more than `hot` families is too large for a
    group: its suffixes are grouped by prefixes of WIDTH words, which are counted instead of grown. (2) Families of the other
    prefixes go, by ranges of the prefix, to groups that fit into memory, each distinct context once a block; there the
    subtrees are grown (deep_nodes) and answer with bits. (3) Blocks remove what the deep internal nodes cover.

    A passage that a third of all documents share is sent once by each block, however often it has it. Words are compared by
    64-bit hashes, a window by 35 of them, or by 128 bits where its prefix is hot. Null and empty texts have no words. Rows
    alike in all columns are documents of their own, so all of them go if they are long enough; a null doc_id is a document.
    Very long texts are one block each. An empty table gives an empty one. Columns of docs with our names give way.
    """
    docs = docs.withColumn("text", whole_text()).drop("block_", "n_words", "n_removed", "kept_sha256", "kept_text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    ranges = blocks // 2 + 1
    dealt = in_blocks(docs, blocks).repartition(max(min(blocks, 2000), blocks // BLOCKS_A_TASK), "block_")
    found = dealt.groupBy("block_").applyInArrow(_prefixes, "block_ long, prefix long, n long")
    # A prefix has at most one row a block.
    every = F.sum("n").over(Window.partitionBy("prefix"))
    groups = found.withColumn("all_", every).filter("all_ > 1").select("block_", "prefix", (F.col("all_") > hot).alias("hot"))
    contexts = dealt.groupBy("block_").cogroup(groups.groupBy("block_")).applyInArrow(_send(ranges), _BLOBS)
    answers = contexts.groupBy("part").applyInArrow(_judge(ranges), _BLOBS)
    told = groups.unionByName(answers.select("part", "block_", "blob"), allowMissingColumns=True)
    out = StructType([f for f in dealt.schema if f.name != "block_"])
    out = out.add("n_words", LongType()).add("n_removed", LongType()).add("kept_sha256", StringType())
    out = out.add("kept_text", StringType()) if keep_text else out
    return dealt.groupBy("block_").cogroup(told.groupBy("block_")).applyInArrow(_finish(ranges, to_arrow_schema(out), keep_text), out)


def op13(docs: DataFrame) -> DataFrame:
    return remove_repeated_words(docs.select("doc_id", "text"), keep_text=False).drop("text")


OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS row_, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT row_, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
s AS (SELECT row_, unnest(range(1, len(words) - 33)) AS i, words FROM d WHERE len(words) >= 35),
t AS (SELECT row_, i, count(*) OVER (PARTITION BY list_slice(words, i, i + 34)) > 1 AS again FROM s),
g AS (SELECT row_, i, word, coalesce(bool_or(again) OVER (PARTITION BY row_ ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone FROM w LEFT JOIN t USING (row_, i)),
k AS (SELECT row_, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (row_)"""
