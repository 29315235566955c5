"""Exact removal of repeated byte strings: suffixes are ordered only through the threshold length, by most-significant-digit passes."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import free_name, spread, whole_text

#: Bytes of text that one block holds, about; the number of blocks follows the corpus.
BLOCK_BYTES = 2 << 20
#: Length of the first digit for a threshold of 50. The other digits are single bytes around it.
WIDTH, DIGIT = 50, 32
#: Blocks that a task takes one after the other, once there are more than 2,000; contexts of a first digit above which its
#: windows are compared one by one, each at a place of its own.
BLOCKS_A_TASK, HOT = 64, 20_000
LAST = 2**63 - 1
_BASE = 0x9E3779B97F4A7C15


@lru_cache(1)
def _powers(n: int):
    """Powers of an odd base and of its inverse, modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    return [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, inverse)]


def _gram_hashes(data: np.ndarray, digit: int) -> np.ndarray:
    """A 64-bit hash of each string of `digit` bytes in data, as uint64."""
    n = len(data)
    size = 1 << max(19, n.bit_length())
    up, down = _powers(size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[digit:] - sums[:-digit]) * down[: n - digit + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each run of `width` values."""
    step = 1
    while 2 * step <= width:
        a = best(a[:-step], a[step:])
        step *= 2
    return best(a[: len(a) - (width - step)], a[width - step :]) if width > step else a


def _anchors(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, width: int, digit: int):
    """Sampled positions of data and their hashes: each whole window of `width` bytes has one of them, at the same place in all its copies.

    A position is taken if its first digit has the least hash of some window around it.
    """
    span = width - digit + 1
    if len(data) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _gram_hashes(data, digit)
    least = _sliding(h, span, np.minimum)
    inside = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= width
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - width + 1, -1)
    least[np.cumsum(inside)[: len(least)] == 0] = 0
    most = _sliding(np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)]), span, np.maximum)
    at = np.flatnonzero((most[: len(h)] == h) & (h != 0))
    even = h[at] * np.uint64(0x9FB21C651E98DF25)  # least hashes are small ones: mixed again, they spread evenly over the ranges
    return at, even ^ (even >> np.uint64(32))


class _Block:
    """The texts of a block as one byte array, with the sampled positions of them all."""

    def __init__(self, table: pa.Table, width: int, digit: int):
        text = table["text"].combine_chunks().fill_null("").cast(pa.large_binary()) if table.num_rows else pa.array([], pa.large_binary())
        text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
        offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8) if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8) if len(text) and text.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.data, self.offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        ids = table["doc_id"].to_pylist()
        self.order = np.array([LAST if x is None else x for x in ids], np.int64)
        self.width, self.digit = width, digit
        found, at, n = [], 0, len(ids)
        while at < n:  # a quarter of a MB at a time, about, keeps the arrays small
            to = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + (1 << 18), "right")) - 1)
            a, b = self.offsets[at], self.offsets[to]
            where, h = _anchors(self.data[a:b], self.offsets[at + 1 : to + 1] - a, self.offsets[at:to] - a, width, digit)
            found.append((where + a, h))
            at = to
        self.at = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        self.hash = np.concatenate([h for _, h in found]) if found else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.offsets, self.at, "right") - 1

    def first_digits(self, ranges: int):
        """The block's distinct first digits in order of range and key; for each sampled position its index there; whether two documents of the block have it; how many positions, as a power of two."""
        part, key = _range_of(self.hash, ranges), self.hash & np.uint64(0xFFFFFFFF)
        full = (part << np.uint64(32)) | key
        values, index = np.unique(full, return_inverse=True)
        first, last = np.full(len(values), LAST), np.full(len(values), -1)
        np.minimum.at(first, index, self.doc)
        np.maximum.at(last, index, self.doc)
        return values, index, first != last, np.ceil(np.log2(np.bincount(index, minlength=len(values)))).astype(np.uint8)

    def contexts(self, keep: np.ndarray):
        """For the sampled positions keep: index of the position's context among the block's distinct ones; of each: bytes, lengths left and right, least document, hash, and a place in keep."""
        side = self.width - self.digit
        at, doc = self.at[keep], self.doc[keep]
        padded = np.concatenate([np.zeros(side, np.uint8), self.data, np.zeros(self.width, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, self.digit + 2 * side)
        rows = np.empty((len(at), self.digit + 2 * side + 2), np.uint8)
        rows[:, :-2] = view[at]
        rows[:, -2] = np.minimum(at - self.offsets[doc], side)
        rows[:, -1] = np.minimum(self.offsets[doc + 1] - at - self.digit, side)
        places = np.arange(side)
        rows[:, :side][places < side - rows[:, -2:-1]] = 0
        rows[:, side + self.digit : -2][places >= rows[:, -1:]] = 0
        flat = rows.view(np.dtype((np.void, rows.shape[1]))).ravel()
        # Equal contexts are sent once. Sorting by a hash and comparing neighbours byte by byte is enough: contexts left apart are only sent twice.
        odd = np.random.default_rng(5).integers(1, 2**62, rows.shape[1], dtype=np.int64).astype(np.uint64) | np.uint64(1)
        h = np.zeros(len(at), np.uint64)
        for c in range(rows.shape[1]):
            h = (h ^ rows[:, c]) * odd[c]
            h ^= h >> np.uint64(33)
        order = np.lexsort((h, self.hash[keep]))  # by first digit, so that like contexts are neighbours
        new = np.ones(len(at), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (flat[order][1:] != flat[order][:-1])
        group = np.empty(len(at), np.int64)
        group[order] = np.cumsum(new) - 1
        heads = order[new]
        least = np.full(len(heads), LAST)
        np.minimum.at(least, group, self.order[doc])
        return group, rows[heads], least, self.hash[keep][heads], heads


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _by_range(part: np.ndarray):
    """Slices of equal values of part, which is in order."""
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
        if b > a:
            yield int(part[a]), slice(int(a), int(b))


def _send_digits(ranges: int, width: int, digit: int):
    def send(table: pa.Table) -> pa.Table:
        own = _Block(table, width, digit)
        values, _, _, sizes = own.first_digits(ranges)
        return _blobs([(r, table["block_"][0].as_py(), values[s].astype(np.uint32).tobytes() + sizes[s].tobytes()) for r, s in _by_range(values >> np.uint64(32))])

    return send


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    part, block, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"part": pa.array(part, pa.int64()), "block_": pa.array(block, pa.int64()), "blob": pa.array(blob, pa.binary())})


def _repeated_digits(table: pa.Table) -> pa.Table:
    """First pass, one range: which of the digits that each block sent do other blocks have too, and which are hot; bits in the order sent."""
    sent = table["blob"].to_pylist()
    digits = [np.frombuffer(x, np.uint32, len(x) // 5) for x in sent]
    every, sizes = np.concatenate(digits), np.concatenate([np.frombuffer(x, np.uint8, len(x) // 5, len(x) // 5 * 4) for x in sent])
    order = np.argsort(every, kind="stable")
    known, first, count = np.unique(every[order], return_index=True, return_counts=True)
    contexts = np.add.reduceat(np.exp2(sizes[order].astype(float)), first) if len(first) else np.zeros(0)
    masks = np.stack([count > 1, contexts > HOT])
    rows = [(r, block, np.packbits(masks[:, np.searchsorted(known, own)], axis=1).tobytes()) for r, block, own in zip(table["part"].to_pylist(), table["block_"].to_pylist(), digits, strict=True)]
    return _blobs(rows)


class _Survivors:
    """What a block sends in the second pass, worked out alike again in the third: the contexts of first digits that come twice
    at least. Those of hot digits are taken apart into windows."""

    def __init__(self, table: pa.Table, masks: pa.Table, ranges: int, width: int, digit: int):
        self.own = own = _Block(table, width, digit)
        values, index, twice, _ = own.first_digits(ranges)
        by = dict(zip(masks["part"].to_pylist(), masks["blob"].to_pylist(), strict=True))
        hot = np.zeros(len(values), bool)
        for r, s in _by_range(values >> np.uint64(32)):
            bits = np.unpackbits(np.frombuffer(by[r], np.uint8).reshape(2, -1), axis=1, count=s.stop - s.start).astype(bool)
            twice[s], hot[s] = twice[s] | bits[0], bits[1]
        self.keep = np.flatnonzero(twice[index])
        self.group, self.rows, self.least, h, heads = own.contexts(self.keep)
        is_hot = hot[index[self.keep]][heads]
        cold = np.flatnonzero(~is_hot)
        part = _range_of(h[cold], ranges).astype(np.int64)
        order = np.argsort(part, kind="stable")
        self.cold, self.part = cold[order], part[order]
        self._take_apart(np.flatnonzero(is_hot), ranges, width, digit)

    def _take_apart(self, hot: np.ndarray, ranges: int, width: int, digit: int) -> None:
        """Each distinct window of the hot contexts, with its least document: w_bytes, w_least, w_part (beyond the ranges of
        digits); and which context has it where: w_head, w_back, w_group."""
        side, rows = width - digit, self.rows[hot]
        backs = np.arange(side + 1)
        head, self.w_back = np.nonzero((rows[:, -2:-1] >= backs) & (rows[:, -1:] >= side - backs))
        self.w_head = hot[head]
        found = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(rows[:, :-2], width, axis=1)[head, side - self.w_back]) if len(hot) else np.zeros((0, width), np.uint8)
        flat, h = found.view(np.dtype((np.void, width))).ravel(), np.zeros(len(found), np.uint64)
        for c in range(width):
            h = (h ^ found[:, c]) * np.uint64(_BASE)
            h ^= h >> np.uint64(32)
        part = ranges + _range_of(h, ranges).astype(np.int64)
        order = np.lexsort((h, part))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (flat[order][1:] != flat[order][:-1])
        self.w_group = np.empty(len(h), np.int64)
        self.w_group[order] = np.cumsum(new) - 1
        first = order[new]
        self.w_bytes, self.w_part, self.w_least = found[first], part[first], np.full(len(first), LAST)
        np.minimum.at(self.w_least, self.w_group, self.least[self.w_head])


def _send_contexts(ranges: int, width: int, digit: int):
    def send(table: pa.Table, masks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _blobs([])
        block, out, press = table["block_"][0].as_py(), _Survivors(table, masks, ranges, width, digit), zstandard.ZstdCompressor(level=3).compress
        sent = [(r, block, press(out.least[out.cold[s]].tobytes() + out.rows[out.cold[s]].tobytes())) for r, s in _by_range(out.part)]
        return _blobs(sent + [(r, block, press(out.w_least[s].tobytes() + out.w_bytes[s].tobytes())) for r, s in _by_range(out.w_part)])

    return send


def _rank(*digits: np.ndarray) -> np.ndarray:
    """One pass of the sort: groups of equal digits, numbered in order of the digits, the first being the most significant."""
    n = len(digits[0])
    order = np.lexsort(digits[::-1])
    new = np.zeros(n, bool)
    for d in digits:
        new[1:] |= d[order][1:] != d[order][:-1]
    out = np.empty(n, np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def _least_in_group(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row the least value of its group; groups are numbered from 0."""
    least = np.full(int(group.max()) + 1 if len(group) else 0, LAST)
    np.minimum.at(least, group, values)
    return least[group]


def earlier_windows(rows: np.ndarray, least: np.ndarray, width: int, digit: int) -> np.ndarray:
    """Bits per context: bit l is set if the window that starts l bytes before the first digit is in a document before the context's least.

    Most significant digit first: groups of equal first digits, eight bytes a pass; contexts alone in their group leave.
    Then a byte a pass, to the left and to the right of the first digit; the two ranks for l and width - digit - l bytes
    make up all `width` bytes, so that equal pairs are exactly the repeated windows.
    """
    side = width - digit
    out = np.zeros(len(rows), np.uint32)
    live = np.arange(len(rows))
    group = np.zeros(len(rows), np.int64)
    first = np.ascontiguousarray(rows[:, side : side + digit])
    for c in range(0, digit, 8):
        piece = np.zeros((len(live), 8), np.uint8)
        piece[:, : min(8, digit - c)] = first[live, c : c + 8]
        group = _rank(group, piece.view(">u8").ravel().astype(np.uint64))
        alone = np.bincount(group)[group] < 2
        live, group = live[~alone], group[~alone]
    if not len(live):
        return out
    # Contexts that are alike throughout need one row only: the least document of them stands for all.
    rest = np.concatenate([rows[live][:, :side], rows[live][:, side + digit :]], axis=1)
    whole = group
    for c in range(0, rest.shape[1], 8):
        piece = np.zeros((len(live), 8), np.uint8)
        piece[:, : min(8, rest.shape[1] - c)] = rest[:, c : c + 8]
        whole = _rank(whole, piece.view(">u8").ravel().astype(np.uint64))
    best = _least_in_group(whole, least[live])
    heads = np.unique(whole, return_index=True)[1]
    group, rest, document = group[heads], rest[heads], best[heads]
    left, right = [group], [group]
    for c in range(side):
        left.append(_rank(left[-1], rest[:, side - 1 - c]))
        right.append(_rank(right[-1], rest[:, side + c]))
    n_left, n_right = rows[live][heads][:, -2], rows[live][heads][:, -1]
    for back in range(side + 1):
        there = np.flatnonzero((n_left >= back) & (n_right >= side - back))
        if len(there):
            same = _rank(left[back][there], right[side - back][there])
            known = np.full(len(heads), LAST)
            known[there] = _least_in_group(same, document[there])
            out[live] |= (known[whole] < least[live]).astype(np.uint32) << np.uint32(back)
    return out


def first_windows(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each window the least document that has it: eight bytes a pass, most significant first."""
    group = np.zeros(len(rows), np.int64)
    for c in range(0, rows.shape[1], 8):
        piece = np.zeros((len(rows), 8), np.uint8)
        piece[:, : min(8, rows.shape[1] - c)] = rows[:, c : c + 8]
        group = _rank(group, piece.view(">u8").ravel().astype(np.uint64))
    return _least_in_group(group, least)


def _judge(ranges: int, width: int, digit: int):
    """Second pass, one range: contexts are answered by bits, windows of hot digits by the least document that has them."""

    def judge(table: pa.Table) -> pa.Table:
        windows = table["part"][0].as_py() >= ranges
        size = width if windows else 2 * width - digit + 2
        blobs = [zstandard.ZstdDecompressor().decompress(x) for x in table["blob"].to_pylist()]
        counts = [len(x) // (8 + size) for x in blobs]
        least = np.concatenate([np.frombuffer(x, np.int64, n) for x, n in zip(blobs, counts, strict=True)])
        rows = np.concatenate([np.frombuffer(x, np.uint8, n * size, n * 8).reshape(n, size) for x, n in zip(blobs, counts, strict=True)])
        found = first_windows(rows, least) if windows else earlier_windows(rows, least, width, digit)
        cuts = np.cumsum([0, *counts])
        return _blobs([(r, b, found[i:j].tobytes()) for r, b, i, j in zip(table["part"].to_pylist(), table["block_"].to_pylist(), cuts, cuts[1:], strict=False)])

    return judge


def _removed(table: pa.Table, answers: pa.Table, ranges: int, width: int, digit: int):
    """The block and a mask of its bytes that go."""
    bits = answers.filter(answers["is_bits"])
    out = _Survivors(table, answers.filter(pa.compute.invert(answers["is_bits"])), ranges, width, digit)
    own, keep, group, rows = out.own, out.keep, out.group, out.rows
    by = dict(zip(bits["part"].to_pylist(), bits["blob"].to_pylist(), strict=True))
    flags = np.zeros(len(rows), np.uint32)
    for r, s in _by_range(out.part):
        flags[out.cold[s]] = np.frombuffer(by[r], np.uint32)
    first = np.zeros(len(out.w_part), np.int64)
    for r, s in _by_range(out.w_part):
        first[s] = np.frombuffer(by[r], np.int64)
    earlier = first[out.w_group] < out.least[out.w_head]
    np.bitwise_or.at(flags, out.w_head[earlier], np.uint32(1) << out.w_back[earlier].astype(np.uint32))
    # Of a context's documents in this block, only the least can be the first of all to have a window.
    side = width - digit
    at, doc = own.at[keep], own.order[own.doc[keep]]
    least = np.full(len(rows), LAST)
    np.minimum.at(least, group, doc)
    later = doc > least[group]
    edge = np.zeros(len(own.data) + width + 1, np.int32)
    for back in range(side + 1):
        valid = (rows[group, -2] >= back) & (rows[group, -1] >= side - back)
        go = valid & (later | ((flags[group] >> np.uint32(back)) & np.uint32(1)).astype(bool))
        starts = np.unique(at[go] - back)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + width, -1)
    return own, np.cumsum(edge[: len(own.data)], dtype=np.int32) > 0


def _finish(ranges: int, width: int, digit: int, schema: pa.Schema, keep_text: bool):
    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        own, gone = _removed(table, answers, ranges, width, digit)
        before = np.zeros(len(gone) + 1, np.int32)
        np.cumsum(gone, dtype=np.int32, out=before[1:])
        a, b = own.offsets[:-1], own.offsets[1:]
        n_removed = before[b] - before[a]
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        inner = a[a < b]
        first[inner] = gone[inner]
        runs = np.zeros(len(gone) + 1, np.int32)
        np.cumsum(first, dtype=np.int32, out=runs[1:])
        texts = [own.data[i:j][~gone[i:j]].tobytes() for i, j in zip(a, b, strict=True)]
        out = {"n_bytes": pa.array(b - a, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(runs[b] - runs[a], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts])}
        if keep_text:
            out["kept_text"] = pa.array([x.decode("utf-8", "ignore") for x in texts])
        kept = table.drop_columns([c for c in ("block_", *out) if c in table.column_names])
        for name, values in out.items():
            kept = kept.append_column(name, values)
        return kept.select(schema.names).cast(schema)

    return finish


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """docs with block_; the hash takes in what tells rows alike apart, so that repeated rows spread over the blocks."""
    number = free_name(docs, "number_")
    return spread(docs, number).withColumn("block_", F.pmod(F.xxhash64(*docs.columns, number), F.lit(blocks))).drop(number)


def remove_repeats(docs: DataFrame, width: int = WIDTH, digit: int = DIGIT, block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and kept_text: each byte goes that a string of `width` bytes covers which also starts in a document of smaller doc_id.

    The texts are dealt once to blocks of about block_bytes; three passes over the blocks use that same exchange.
    (1) Each block sends the distinct first digits (`digit` bytes, hashed) at its sampled positions, packed and in order, to
    ranges of the hash; a range tells each block which of them another block has. (2) For those the block sends the bytes
    around, each distinct context once with its least document; a range sorts them digit by digit (earlier_windows) and
    answers with bits. (3) The block removes what the bits cover. A string that a third of all documents share is sent
    once by each block, however often the block has it; a first digit with more than HOT contexts, as in a line that many
    texts share between different neighbours, isn't sorted in one place: its windows are dealt by their own hash, each once a
    block. Every window has a sampled position, at the same place in all copies, and survivors are compared byte by byte, so
    the result is exact.

    Null and empty texts: nothing to remove. A null doc_id counts as larger than any other; rows of one doc_id aren't each
    other's predecessors. kept_text drops bytes of characters that were cut in part. An empty table gives an empty one. Columns of docs with our names give way.
    """
    if not 8 <= digit < width or width - digit > 31:
        raise ValueError("digit must be 8 or more, and less than width by 1 to 31")
    docs = docs.withColumn("text", whole_text()).drop("block_", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    ranges = blocks // 2 + 1
    dealt = in_blocks(docs, blocks).repartition(max(min(blocks, 2000), blocks // BLOCKS_A_TASK), "block_")
    blob = "part long, block_ long, blob binary"
    digits = dealt.groupBy("block_").applyInArrow(_send_digits(ranges, width, digit), blob)
    masks = digits.groupBy("part").applyInArrow(_repeated_digits, blob)
    contexts = dealt.groupBy("block_").cogroup(masks.groupBy("block_")).applyInArrow(_send_contexts(ranges, width, digit), blob)
    bits = contexts.groupBy("part").applyInArrow(_judge(ranges, width, digit), blob)
    answers = masks.withColumn("is_bits", F.lit(False)).union(bits.withColumn("is_bits", F.lit(True)))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructType

    out = StructType([f for f in dealt.schema if f.name != "block_"])
    for name in ("n_bytes", "n_removed", "n_spans"):
        out = out.add(name, LongType())
    out = out.add("kept_sha256", StringType())
    out = out.add("kept_text", StringType()) if keep_text else out
    arrow = to_arrow_schema(out)
    return dealt.groupBy("block_").cogroup(answers.groupBy("block_")).applyInArrow(_finish(ranges, width, digit, arrow, keep_text), out)


def op5(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text"), keep_text=False).drop("text")


#: Strings of 50 bytes of each document against their least document; runs of bytes left are put together again as hex.
OP5_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, array_slice(b, i + 1, i + 50) AS s FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 49)) AS i FROM d WHERE octet_length(b) >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
c AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > first),
g AS (SELECT doc_id, i, coalesce(max(c.i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), -1) >= 0 AS gone
  FROM (SELECT doc_id, unnest(range(0, octet_length(b))) AS i FROM d SEMI JOIN c USING (doc_id)) a LEFT JOIN c USING (doc_id, i)),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens, NOT gone AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), true) AS starts FROM g),
p AS (SELECT doc_id, i, gone, opens, sum(starts::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS piece FROM r),
t AS (SELECT doc_id, piece, min(i) AS a, max(i) AS z FROM p WHERE NOT gone GROUP BY 1, 2),
k AS (SELECT t.doc_id, string_agg(hex(array_slice(b, a + 1, z + 1)), '' ORDER BY a) AS kept FROM t JOIN d USING (doc_id) GROUP BY 1),
n AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans FROM p GROUP BY 1)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n.doc_id IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(kept, ''))) END AS kept_sha256 FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""
