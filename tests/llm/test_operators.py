"""Each operator against a brute-force version, its SQL or an exact round trip, and on odd and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.llm import ann, common, fixity, mixing, pieces, rules, shards, simhash, suffixes, tokens, urls
from tidegauge.llm.queries import ORACLE_SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(same, name):
    same(name)


def _vectors(rows):
    return {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}


def _held_against_brute_force(table, every=20):
    """Recall of all queries of the table; scores, ranks and order are checked on the way."""
    own = _vectors([(r["vec_id"], r["embedding"]) for r in table.collect()])
    ids = np.array(sorted(own))
    matrix, hit, total, got = np.stack([own[i] for i in ids]), 0, 0, defaultdict(list)
    for r in ann.nearest(table, every=every).collect():
        assert r["score"] == pytest.approx(float(own[r["query_id"]] @ own[r["vec_id"]]), rel=1e-12, abs=1e-12)
        got[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
    assert set(got) == {i for i in own if i % every == 0}
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21)) and [x[1:] for x in found] == sorted(x[1:] for x in found)
        scores = matrix @ own[q]
        best = [i for _, i in sorted((-s, i) for s, i in zip(scores, ids, strict=True) if i != q)[:20]]
        hit, total = hit + len(set(best) & {x[2] for x in found}), total + 20
    return hit / total


def test_nearest_recall_and_scores(spark, medium):
    assert _held_against_brute_force(spark.read.parquet(f"{medium}/embeddings.parquet")) >= 0.9


def test_nearest_over_several_blocks(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumn("id", F.lit("x")).withColumn("score", F.lit(1))
    monkeypatch.setattr(ann, "BLOCK", 500)
    monkeypatch.setattr(ann, "QUERIES", 30)
    assert _held_against_brute_force(table) >= 0.9


def _share_and_recall(vectors, k=20):
    """Mean share of a block that is verified for a query, and recall of the k nearest among them."""
    ids, shares, hits = np.arange(len(vectors)), [], []
    index = ann.Index(ids, vectors)
    for i in ids[::20]:
        found = index.search(i, vectors[i], k)[0]
        scores = vectors @ vectors[i]
        scores[i] = -np.inf
        shares.append(index.verified / len(ids))
        hits.append(len(set(np.argsort(-scores, kind="stable")[:k]) & set(found)) / k)
    return np.mean(shares), np.mean(hits)


def test_clusters_are_pruned_and_scattered_vectors_found(spark):
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    centres = rng.standard_normal((60, 64))
    for spread in (0.1, 0.5):
        share, recall = _share_and_recall(unit(centres[rng.integers(0, 60, 4000)] + spread * rng.standard_normal((4000, 64))))
        assert share < 0.05 and recall >= 0.95
    share, recall = _share_and_recall(unit(rng.standard_normal((4000, 6)) @ rng.standard_normal((6, 64))))
    assert share < 0.05 and recall >= 0.95
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    share, recall = _share_and_recall(np.stack(list(_vectors([(r["vec_id"], r["embedding"]) for r in rows]).values())))
    assert share < 0.75 and recall >= 0.9  # next to no structure: nearly all are about as far as the 20th


def test_the_reach_of_a_window():
    """Vectors at the distance that a window is sized for reach the threshold as often as said."""
    rng, half = np.random.default_rng(7), ann.reach_of(0.9)
    hits = (np.abs(rng.standard_normal((20_000, ann.PROJECTIONS))) <= half).sum(1) >= np.ceil(ann.COLLISIONS * ann.PROJECTIONS)
    assert abs(hits.mean() - 0.9) < 0.01 and ann.reach_of(1) == np.inf


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [2.0, 0.0, 0.0]), (None, [1.0, 1.0]), (9, [float("inf"), 1.0]), (20, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(table).orderBy("rank").collect()] == [(0, 1, 5, 1.0), (0, 2, 6, 1.0)]
    assert ann.nearest(table.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e200, 1.0]), (1, [1e200, -1e200]), (2, [-1e200, 0.0]), (3, [1e-200, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(huge).orderBy("rank").collect()] == [(0, 1, 1, float("inf")), (0, 2, 3, 2.0), (0, 3, 2, float("-inf"))]


def test_nearest_of_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(1, 60)]
    query, near = [1.0, 0.5, 0.0, -0.5], [0.9, 0.5, 0.0, -0.5]
    table = lambda more: spark.createDataFrame(rows + more, "vec_id long, embedding array<double>")
    ranked = lambda more: [tuple(r) for r in ann.nearest(table(more), every=100, confidence=1.0).orderBy("query_id", "rank").collect()]
    once = ranked([(0, query)])
    assert len(once) == 20 and ranked([(0, query)] * 20 + rows * 2) == once
    # ids of several vectors: queries 0 and 100, candidate 7 with a thousand vectors about the query
    other = [-1.0, 2.0, 0.0, 0.0]
    more = [(0, query), (0, other), (100, other)] + [(7, [x + 1e-4 * i for x in near]) for i in range(1000)] + [(0, [1.0, 0.5, 0.0, -0.5 + 1e-4 * i]) for i in range(1000)]
    vectors, want = defaultdict(list), []
    for i, v in rows + more:
        vectors[i].append(np.array(v))
    for q in (0, 100):
        scores = {i: float((np.array(vectors[q]) @ np.array(v).T).max()) for i, v in vectors.items() if i != q}
        want += [(q, r, i) for r, (i, _) in enumerate(sorted(scores.items(), key=lambda x: -x[1])[:20], 1)]
    assert [r[:3] for r in ranked(more)] == want


def test_blocks_of_a_hot_id_and_of_many_vectors(spark):
    hot = spark.range(3000).selectExpr("7L AS id", "array(cast(id AS double), 1D) AS v", "2 AS dim")
    sizes = [len(r["ids"]) // 8 for r in ann.dealt(hot, 3).collect()]
    assert len(sizes) == 3 and sum(sizes) == 3000 and max(sizes) < 1500
    n = (1 << 16) + 500
    index = ann.Index(np.arange(n), np.random.default_rng(5).standard_normal((n, 2)))
    centre = np.zeros(ann.PROJECTIONS)
    assert (index.collisions(centre, 1e9) == ann.PROJECTIONS).all()
    brute = sum(((row >= -1) & (row <= 1)).sum() for row in (index.sorted.reshape(ann.PROJECTIONS, -1) - index.shift[:, None]) * index.unit)
    assert index.collisions(centre, 1.0).sum(dtype=int) == brute


def test_cascade_is_exact(spark):
    random.seed(3)
    keys = [f"h{i}.example" for i in range(3000)]
    listed = set(random.sample(keys, 300)) | {"elsewhere.example"}
    table = spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = urls.Cascade(table, spark.createDataFrame([(k,) for k in listed], "key string"))
    assert len(cascade.levels) > 1
    assert {r["key"] for r in table.filter(cascade.holds(F.col("key"))).collect()} == listed & set(keys)


def test_url_rules_on_odd_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.NET/en/x?y"), (4, "http://example.net?en/"), (5, "x://org/fr/"), (6, "x://sub.org/fr"), (7, "http://EXAMPLE.com/de/#a"), (8, "http://m.spam-farm.example.org/"), (9, "http://"), (10, "http://myexample.com/de/")]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("mine"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(table).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.net", "/en/x", "example.net/en/", "allow"), 4: ("example.net", "", None, "allow"), 5: ("org", "/fr/", "org/fr/", "allow"),
        6: ("sub.org", "/fr", None, "allow"), 7: ("example.com", "/de/", "example.com/de/", "block"), 8: ("m.spam-farm.example.org", "/", None, "block"), 9: ("", "", None, "allow"), 10: ("myexample.com", "/de/", None, "allow"),
    }
    assert urls.judge(table.limit(0)).count() == 0


def test_bad_names_are_blocked_under_each_parent(spark, medium):
    names = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    hosts = [f"{sub}{name}.example.{top}" for sub in ("", "www.") for name in names for top in ("com", "net", "org")]
    table = spark.createDataFrame([(i, f"https://{h}/xx/") for i, h in enumerate([*hosts, "my-spam-farm.example.org", "example.org"])], "page_id long, url string")
    assert [r["verdict"] for r in urls.judge(table).orderBy("page_id").collect()] == ["block"] * len(hosts) + ["allow"] * 2
    pages = urls.op2(spark.read.parquet(f"{medium}/pages.parquet")).filter("rule is null").collect()
    bad = {r["page_id"] for r in pages if set(r["host"].split(".")) & set(names)}
    assert {r["page_id"] for r in pages if r["verdict"] == "block"} == bad and bad


def test_a_list_beyond_the_constants_is_joined(spark, medium):
    pages = spark.read.parquet(f"{medium}/pages.parquet").select("page_id", "url")
    pages = pages.union(pages.limit(20)).union(spark.createDataFrame([(-1, None), (-2, "http://")], pages.schema))
    key = lambda rows: Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows.collect())
    want = key(urls.judge(pages))
    assert key(urls.judge(pages, most_listed=5)) == want and {v for *_, v in want} == {"allow", "block"}
    many = spark.range(300_000).selectExpr("concat('h', id, '.example') AS key").union(spark.createDataFrame([(h,) for h in urls.LISTED], "key string"))
    assert key(urls.judge(pages, listed=many)) == want


def test_pieces_decode_and_follow_the_library(spark, documents, odd_documents, no_documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path())
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in pieces.encode(documents, dropout=0.0).collect():
        assert r["pieces"] == library.encode(texts[r["doc_id"]])
    encoded = pieces.op3(documents).cache()
    assert encoded.filter("not lossless").count() == 0
    assert {r["doc_id"]: r["text"] for r in pieces.decode(encoded).collect()} == texts
    variants = {tuple(pieces.pieces(pieces.vocabulary_path()).encode("unbelievable international segmentation", 0.1, v)) for v in range(4)}
    assert len(variants) > 1
    odd = pieces.encode(odd_documents).collect()
    assert len(odd) == odd_documents.count() and all(r["lossless"] for r in odd) and pieces.encode(no_documents).count() == 0


def test_remembered_strings_take_four_bytes_a_piece():
    own = pieces.Pieces(pieces.vocabulary_path())
    for text in ("plain words, and plain words", "漢字 " + "x" * 70 + " 🙂", "a▁b"):
        ids = own.encode(text, pieces.DROPOUT, 1)
        assert own.encode_packed(text, pieces.DROPOUT, 1) == np.array(ids, np.int32).tobytes() and own.decode(ids) == text
    seen = own.seen[pieces.DROPOUT, 1, pieces.SEED]
    assert seen["▁plain"] == own._string("▁plain", (pieces.DROPOUT, 1, pieces.SEED)) and all(isinstance(x, bytes) for x in seen.values())


def test_dropout_equals_a_plain_agenda(documents):
    """Whole texts, uncut: while any neighbouring pair is a piece whose merge type the variant doesn't skip, the best-scored, leftmost one is merged."""
    own = pieces.pieces(pieces.vocabulary_path())

    def plain(text, variant):
        parts = list("▁" + text.replace(" ", "▁"))
        seed = (pieces.SEED + variant * 0x9E3779B97F4A7C15) % 2**64
        open_ = lambda a, b: a + b in own.rank and xxhash.xxh64_intdigest(f"{a} {b}".encode(), seed) >= pieces.DROPOUT * 2**64
        while found := [(own.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if open_(a, b)]:
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [x for p in parts for x in ([own.ids[p]] if p in own.ids else [own.bytes[b] for b in p.encode()])]

    texts = [(r["text"] or "")[:240].replace("▁", "") for r in documents.limit(25).collect()]
    texts += ["internationalisation" * 12, "Ünïcödé 漢字 x\u2003y 🙂", "a  b   c", "x=1;y[2]+=3.14", " "]
    for text in texts:
        for variant in range(pieces.VARIANTS):
            got = own.encode(text, pieces.DROPOUT, variant)
            assert got == plain(text, variant) and own.decode(got) == text, text


def test_short_and_long_agendas_agree(documents):
    own, other = pieces.Pieces(pieces.vocabulary_path()), pieces.Pieces(pieces.vocabulary_path())
    other._merged_short = None
    texts = [r["text"] or "" for r in documents.limit(60).collect()]
    want = [own.encode(t, 0.1, 1) for t in texts]
    short, pieces.SHORT = pieces.SHORT, 0
    try:
        assert [other.encode(t, 0.1, 1) for t in texts] == want
    finally:
        pieces.SHORT = short


def test_fixity_finds_each_kind(spark):
    a = spark.createDataFrame([(i, f"u{i}", "x" * (i % 7)) for i in range(300)] + [(None, None, None)], "page_id long, url string, html string")
    assert fixity.audit(a, a).count() == 0 and fixity.audit(a.limit(0), a.limit(0)).count() == 0
    b = a.filter("page_id is null or page_id <> 17").withColumn("html", F.when(F.col("page_id") == 40, "zz").otherwise(F.col("html"))).unionByName(spark.createDataFrame([(900, "n", "n")], a.schema))
    kinds = {r["page_id"]: r["kind"] for r in fixity.audit(a, b).collect()}
    assert kinds[17] == "missing" and kinds[40] == "changed" and kinds[900] == "extra" and set(kinds) - {17, 40, 900} == {i for i in kinds if i > 17 and kinds[i] == "moved"}


def test_warc_files_round_trip(spark, medium, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}\r\n\r\nü 漢\n" * (i % 4)) for i in range(4090, 4100)] + [(None, "http://x", "y"), (3, None, None), (3, "u", "\r\n\r\n")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    fixity.write_warc(table, f"{tmp_path}/w")
    again = fixity.read_warc(spark, f"{tmp_path}/w")
    assert Counter(map(tuple, again.collect())) == Counter((i, u or "", h or "") for i, u, h in rows)
    files = sorted((tmp_path / "w").glob("file=*/*.txt"))
    assert [f.parent.name for f in files] == ["file=-1", "file=0", "file=1"]
    ends = {r["idx"]: (r["start"], r["end"]) for r in fixity.leaves(table).collect()}
    data = files[1].read_bytes()
    for i in range(4090, 4096):
        a, b = ends[i]
        assert data[a:b].startswith(b"WARC/1.1\r\n") and f"<urn:page:{i}>".encode() in data[a:b] and data[a:b].endswith(b"\r\n\r\n")
    pages = spark.read.parquet(f"{medium}/pages.parquet")
    fixity.write_warc(pages, f"{tmp_path}/a")
    fixity.write_warc(fixity.damaged(pages), f"{tmp_path}/b")
    found = fixity.audit(fixity.read_warc(spark, f"{tmp_path}/a"), fixity.read_warc(spark, f"{tmp_path}/b")).drop("hash_a", "hash_b")
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, fixity.op4(pages).collect()))


def test_warc_bodies_that_quote_records_and_files_with_flipped_bytes(spark, tmp_path):
    quoted = "x\r\n\r\nWARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"http://h/{i}", quoted * (i % 3) + f"page {i}") for i in range(60)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for side in "ab":
        fixity.write_warc(table, f"{tmp_path}/{side}")
    assert sorted(map(tuple, fixity.read_warc(spark, f"{tmp_path}/a").collect())) == rows
    (file,) = (tmp_path / "b").glob("file=*/*.txt")
    data = bytearray(file.read_bytes())
    data[data.index(b"page 41") + 5] ^= 1
    file.write_bytes(bytes(data))
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    sides = [fixity.read_warc(spark, f"{tmp_path}/{side}") for side in "ab"]
    assert [(r["page_id"], r["kind"]) for r in fixity.audit(*sides).collect()] == [(41, "changed")]
    at = data.index(b"Content-Length", data.index(b"urn:page:20>"))
    data[at] ^= 1
    file.write_bytes(bytes(data[: data.index(b"page 59")]))
    found = fixity.read_warc(spark, f"{tmp_path}/b", True).collect()
    assert sum(r["damaged"] for r in found) >= 2 and {r["page_id"] for r in found} - {None} >= set(range(59)) - {20}


def test_planted_damage_is_named_by_its_kind(spark):
    kinds = {r["page_id"]: r["kind"] for r in fixity.op4(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).collect()}
    for i in range(2500):
        want = "missing" if i % 1999 == 1234 else "changed" if i % 97 == 13 or i % 3001 == 2345 else "moved" if 1234 < i else None
        assert kinds.get(i) == want, i


def test_fixity_tells_changed_records_from_moved_ones(spark):
    a = spark.createDataFrame([(i, f"u{i}", f"page {i}") for i in range(300)] + [(50, "again", "x")], "page_id long, url string, html string")
    b = a.filter("page_id <> 17").withColumn("html", F.when(F.col("page_id").isin(40, 50), F.concat(F.lit("#"), F.substring("html", 2, 99))).otherwise(F.col("html")))
    kinds = {r["page_id"]: r["kind"] for r in fixity.audit(a, b).collect()}
    assert kinds == {17: "missing", 40: "changed", 50: "changed"} | {i: "moved" for i in range(18, 300) if i not in (40, 50)}
    pages = spark.range(2400).selectExpr("id AS page_id", "concat('u', id) AS url", "'<p>' AS html")
    rows = fixity.op4(pages).filter("kind = 'changed'").collect()
    assert {r["page_id"] for r in rows} >= {i for i in range(2400) if i % 97 == 13 and i % 1999 != 1234}


def _brute_removed(rows):
    """doc_id, text to (n_bytes, n_removed, n_spans, sha256), by a set of all windows of smaller ids."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out, at = set(), Counter(), 0
    while at < len(order):
        end = at
        while end < len(order) and order[end][0] == order[at][0]:
            end += 1
        fresh = set()
        for doc_id, text in order[at:end]:
            data = (text or "").encode()
            gone = bytearray(len(data))
            for i in range(len(data) - 49):
                w = data[i : i + 50]
                fresh.add(w)
                if w in seen:
                    gone[i : i + 50] = b"\1" * 50
            kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
            out[(doc_id, len(data), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
        seen |= fresh
        at = end
    return out


def test_suffix_dedup_equals_brute_force(documents, odd_documents, no_documents):
    for table in (documents, odd_documents):
        got = Counter(tuple(r) for r in suffixes.op5(table).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
        assert got == _brute_removed([(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()])
    assert suffixes.remove_repeats(no_documents).count() == 0


def _fingerprint(text, k=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(rows, k=3, threshold=2):
    """The root of each fingerprint's component."""
    prints = sorted({_fingerprint(t, k) for _, t in rows})
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= threshold:
                parent[find(a)] = find(b)
    return {p: find(p) for p in prints}


def _heads(rows, k=3, threshold=2):
    """The least doc_id of each component; two components can share it where a doc_id has several texts."""
    roots, least = _roots(rows, k, threshold), {}
    for i, t in rows:
        root = roots[_fingerprint(t, k)]
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    return least


def _components(rows, k=3, threshold=2):
    roots, least = _roots(rows, k, threshold), _heads(rows, k, threshold)
    return Counter((i, f"{_fingerprint(t, k):016x}", least[roots[_fingerprint(t, k)]]) for i, t in rows)


def test_simhash_equals_brute_force(documents, odd_documents, no_documents):
    for table in (documents, odd_documents):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        assert Counter(tuple(r) for r in simhash.op6(table).collect()) == _components(rows)
        assert Counter(tuple(r) for r in simhash.near_duplicates(table, 5, 4).collect()) == _components(rows, 5, 4)
        kept = simhash.keep_first(table)
        assert kept.columns == table.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(_heads(rows).values())
    assert simhash.op6(no_documents).count() == 0 and simhash.keep_first(no_documents).count() == 0


@pytest.mark.parametrize("pair", simhash.ALL_TABLES)
def test_anchors_reach_all_within_two_bits_of_their_blocks(pair):
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63, 300, dtype=np.int64)
    own = np.array([at + b for at, length in (simhash.BLOCKS[p] for p in pair) for b in range(length)], np.uint64)
    flips = (np.uint64(1) << rng.choice(own, (300, 2))).view(np.int64)
    other = x ^ flips[:, 0] ^ flips[:, 1]
    home, _, _ = simhash.anchors(x, pair)
    _, i, anchor = simhash.anchors(other, pair)
    reach = defaultdict(set)
    for k, a in zip(i, anchor, strict=True):
        reach[k].add(a)
    assert all(home[k] in reach[k] for k in range(300))


def test_links_of_any_threshold_come_once(spark):
    rng = np.random.default_rng(2)
    heads = rng.integers(-(2**63), 2**63, 60, dtype=np.int64)
    prints = {int(h) for h in heads}
    for h in heads:
        for n in range(1, 7):
            prints.add(int(h ^ np.bitwise_xor.reduce((np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64)).view(np.int64))))
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    for threshold in (1, 2, 3, 4):
        want = Counter((a, b) for a in prints for b in prints if a < b and apart(a, b) <= threshold)
        assert Counter((r["a"], r["b"]) for r in simhash.links(table, threshold).collect()) == want


def _similar(rows, k=5, least=0.8):
    """doc_id to a name of its group: texts linked where their shingle sets have that Jaccard similarity."""
    sets, owners = {}, defaultdict(list)
    for i, t in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))) if words else frozenset()
        for x in sets[i]:
            owners[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in sets.items():
        shared = Counter(j for x in own for j in owners[x] if j > i)
        for j, n in shared.items():
            if n >= least * (len(own) + len(sets[j]) - n):
                root[find(i)] = find(j)
    return {i: find(i) for i in sets}


def test_meetings_equal_brute_force(spark, medium):
    texts = [r["text"] for r in spark.read.parquet(f"{medium}/documents.parquet").limit(150).collect() if r["text"]]
    rng = random.Random(6)
    for t in texts[:40]:  # near copies of one text and of several
        words = t.split(" ")
        for _ in range(8):
            words = [w if rng.random() > 0.005 else "other" for w in words]
            texts.append(" ".join(words))
    prints = {simhash.wide_fingerprint(simhash.shingle_set(t, 5), 4).tobytes() for t in texts}
    table = spark.createDataFrame([(p,) for p in prints], "prints binary").withColumn("node", F.xxhash64("prints"))
    nodes = {r["node"]: np.frombuffer(r["prints"], np.int64) for r in table.collect()}
    homes = {n: {(i, pair, int(simhash.anchors(p[i : i + 1], pair, 0)[0][0])) for i in range(4) for pair in simhash.ALL_TABLES} for n, p in nodes.items()}
    most = simhash.apart_at_most(0.8, 128)
    names = sorted(nodes)
    near = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if homes[a] & homes[b] and np.bitwise_count((nodes[a] ^ nodes[b])[:2].view(np.uint64)).sum() <= most]
    assert len(near) > 100

    def groups(links):
        root = {n: n for n in names}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        return Counter(frozenset(g) for g in [[n for n in names if find(n) == r] for r in {find(n) for n in names}])

    for cell in (simhash.CELL, 3):
        links = [(r["a"], r["b"]) for r in simhash.meetings(table, 0.8, 2, cell).collect()]
        assert len(links) == len(set(links)) and set(links) <= set(near) and groups(links) == groups(near)


def test_similar_texts_are_found(spark, medium, odd_documents, no_documents):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    group = _similar(rows)
    left = Counter(group[r["doc_id"]] for r in simhash.keep_dissimilar(docs).collect())
    assert set(left) == set(group.values()) and sum(left.values()) <= 1.01 * len(left)
    for table in (odd_documents, no_documents):
        found = simhash.keep_dissimilar(table)
        assert found.columns == table.columns and found.count() == (6 if table is odd_documents else 0)


def _base(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(spark, small, documents, odd_documents, no_documents):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for table in (documents, odd_documents):
        got = Counter((r["doc_id"], *(r[n] for n in names)) for r in rules.op7(table, labels).collect())
        assert got == Counter((r["doc_id"], *_base(r["text"])) for r in table.collect())
    judged = rules.op7(documents, labels).join(labels, "doc_id").filter("not base_failed").collect()
    right = sum(r["kept"] == bool(r["quality"]) for r in judged)
    assert right / len(judged) > 0.9
    assert rules.op7(documents, labels.limit(0)).filter("kept = base_failed").count() == 0
    assert rules.op7(no_documents, labels).count() == 0
    assert rules.accepted(odd_documents, labels).columns == odd_documents.columns


def test_gram_ratios_equal_brute_force(spark, documents, odd_documents):
    buckets = 5000
    hashed = lambda values, kind: {r[0]: r[1] for r in spark.createDataFrame([(v,) for v in values], kind).selectExpr("v", "xxhash64(v.*)" if "struct" in kind else "xxhash64(v)").collect()}
    rows = [(r["doc_id"], WORD.findall(r["text"] or "")) for r in documents.collect()]
    trusted = spark.createDataFrame([(i,) for i, _ in rows[::3]], "labelled_id long")
    one = hashed({w for _, ws in rows for w in ws}, "v string")
    hashes = [(i, [one[w] for w in ws]) for i, ws in rows]
    pairs = {p for _, hs in hashes for p in zip(hs, hs[1:], strict=False)}
    two = {(r["a"], r["b"]): r["h"] for r in spark.createDataFrame(list(pairs), "a long, b long").selectExpr("a", "b", "xxhash64(a, b) AS h").collect()}
    grams = [(i, [h % buckets for h in (*hs, *(two[p] for p in zip(hs, hs[1:], strict=False)))]) for i, hs in hashes]
    raw, target, ids = Counter(), Counter(), {i for i, _ in rows[::3]}
    for i, g in grams:
        raw.update(g)
        target.update(g if i in ids else ())
    chance = lambda c, b: np.log((c[b] + 1.0) / (c.total() + buckets))
    ratios = rules.gram_log_ratios(documents, trusted, buckets)
    got = {r["bucket"]: r["ratio"] for r in ratios.collect()}
    assert set(got) == set(raw) and all(abs(got[b] - (chance(target, b) - chance(raw, b)) * rules.UNIT) <= 0.6 for b in raw)
    held = rules.base_counts(documents.select("doc_id", "text"))
    want = {i: sum(got[b] for b in g) / (len(g) * float(rules.UNIT)) if g else 0.0 for i, g in grams}
    # Sums of whole numbers: the same to the last bit on both paths and in any partitions.
    for literal, rows in ((True, held), (False, held), (False, held.repartition(7)), (True, held.repartition(3))):
        assert {r["doc_id"]: r["gram_llr"] for r in rules.with_llr(rows, ratios, buckets, literal).collect()} == want


def test_threshold_holds_on_labels_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)) == 0
    found = rules.judge(docs.select("doc_id", "text"), labels.filter(seen)).select("doc_id", "base_failed", "kept").collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.filter(~seen).collect()}
    kept = {q: [r["kept"] for r in found if truth.get(r["doc_id"]) == q and not r["base_failed"]] for q in (0, 1)}
    assert np.mean(kept[1]) >= 0.97 and np.mean(kept[0]) <= 0.03


def _targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(3 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        more = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not more:
            return share | {s: 3.0 * sizes[s] for s in full}
        full |= more


def test_mix(documents, odd_documents, no_documents):
    for table in (documents, odd_documents):
        rows = mixing.op8(table).collect()
        assert len(rows) == table.count()
        assert sorted(map(repr, rows)) == sorted(map(repr, mixing.op8(table.repartition(5)).collect()))
        sizes, taken = Counter(), Counter()
        for r in rows:
            assert 0 <= r["taken"] <= 3 * r["size"]
        sources = {r["doc_id"]: r["source"] for r in table.collect()}
        for r in table.collect():
            sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        want = _targets(dict(sizes))
        seen = {(r["source_size"], round(r["target"], 6)) for r in rows}
        assert seen <= {(sizes[s], round(want[s], 6)) for s in sizes}
        if table is documents:
            for r in rows:
                taken[sources[r["doc_id"]]] += r["taken"]
            assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK_WORDS + 0.01 * want[s] for s in sizes)
    mixed = mixing.mix(documents)
    assert mixed.columns == documents.columns and mixed.filter("n_chars <> length(text)").count() == 0
    assert mixing.mix(odd_documents).columns == odd_documents.columns and mixing.op8(no_documents).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_seats_equal_the_highest_quotients(spark, seed):
    """Sainte-Lague seat by seat, caps binding in half of the cases, weights of 0 and ties included."""
    draw = random.Random(seed)
    claims, want = [], {}
    for g in range(12):
        n, seats = draw.randrange(1, 9), draw.randrange(0, 60)
        own = [(g, i, float(draw.choice([0, 1, 1, 2, 3, 50, draw.random() * 9])), draw.randrange(0, 12 if g % 2 else 90), seats) for i in range(n)]
        got = Counter()
        for _ in range(seats):
            open_ = [(-w / (2 * got[i] + 1), i) for _, i, w, most, _ in own if w > 0 and got[i] < most]
            if open_:
                got[min(open_)[1]] += 1
        claims += own
        want |= {(g, i): got[i] for _, i, *_ in own}
    table = spark.createDataFrame(claims, "g int, i int, w double, most long, seats long")
    assert {(r["g"], r["i"]): r["quota"] for r in mixing.apportion(table, ["g"], "seats", "w", "most", [F.col("i")]).collect()} == want
    alone = table.filter("g = 3").drop("g")
    assert {(3, r["i"]): r["quota"] for r in mixing.apportion(alone, [], "seats", "w", "most", [F.col("i")]).collect()} == {k: v for k, v in want.items() if k[0] == 3}


def test_blocks_are_chosen_by_their_hash(spark):
    """Each cell takes its quota of blocks, whole passes first, and the rest isn't one run of neighbours."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(50)), "b" if i % 4 else "a") for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.plan(table, block_words=10).collect()
    assert all(r["taken"] == r["passes_"] * 50 + sum(p["b"] - p["a"] for p in r["picks_"]) for r in out)
    part = [len(r["picks_"]) for r in out if r["source"] == "b"]
    assert 0 < sum(part) < 5 * len(part) and sum(0 < n < 5 for n in part) > 0.5 * len(part)
    for source in "ab":
        took, want = sum(r["taken"] for r in out if r["source"] == source), next(r["target"] for r in out if r["source"] == source)
        assert abs(took - want) <= 0.01 * want


def test_token_counts_equal_the_library(documents, odd_documents, no_documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path())
    for table in (documents, odd_documents):
        rows = [(r["doc_id"], r["text"] or "") for r in table.collect()]
        want = Counter((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in rows)
        assert Counter(tuple(r) for r in tokens.op9(table).collect()) == want
    assert tokens.op9(no_documents).count() == 0


def test_token_counts_of_odd_strings(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path())
    texts = ["a<|endoftext|>b", "<|startoftext|> x", "It's we'LL I'd 's", "e\u0301 É", "a\x1cb\x1f c", "\u2028x\u00a0y\u3000z", "12345 3.14", "ﬁ ǅ İstanbul", "🙂🙂 👩‍👩‍👧", "a\u200bb", "\x00\x01 x"]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.op9(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_whole_tokens_of_any_script():
    """Words with accents, umlauts and other scripts take the shortcut too; what it proves is one token to the library."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path())
    count = tokens.Counter(tokens.vocabulary_path())
    whole, merged = "café España Beyoncé Pokémon é ♥ 🙂 … – —".split(), "Über für año ação München 日本 東京 привет naïve déjà “".split()
    got = {w: count.pre_tokens(w) for w in whole + merged}
    assert None not in got.values() and count.pre_tokens("x<|endoftext|>") is None
    assert [w for w, found in got.items() if len(found) == 1 and found[0] in count.whole] == whole
    for w, found in got.items():
        ids = library.encode(w, add_special_tokens=False).ids
        assert count.string(w) == len(ids) and (not (len(found) == 1 and found[0] in count.whole) or len(ids) == 1), w


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), max_size=8))
@settings(max_examples=300, deadline=None)
def test_any_text_counts_as_the_library_does(parts):
    text = " ".join(parts)
    count = tokens.counter(tokens.vocabulary_path())
    assert count.text(text) == len(count.library.encode(text, add_special_tokens=False).ids)


def test_shards(documents, odd_documents, no_documents):
    for table in (documents, odd_documents):
        rows = shards.op10(table).collect()
        texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in table.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(8))
        counts = [len(slots[s]) for s in range(8)]
        assert max(counts) - min(counts) <= 1
    again = shards.op10(documents.repartition(7)).collect()
    assert sorted(again) == sorted(shards.op10(documents).collect())
    assert shards.op10(no_documents).count() == 0


def test_repeated_rows_spread(spark, monkeypatch):
    rows = [(i, f"text {i}") for i in range(50)] + [(7, "hot")] * 3000 + [(None, "nobody's")] * 1500 + [(None, None)] * 40
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(common, "CHUNK", 1000)
    numbers = Counter((r["doc_id"], r["text"], r["at"]) for r in common.numbered(table, "at").collect())
    alike = Counter(rows)
    assert numbers == Counter((*row, i) for row, n in alike.items() for i in range(n))
    apart = Counter((r["doc_id"], r["text"], r["at"]) for r in common.spread(table, "at").collect())
    assert apart == Counter((*row, i if n > common.FEW else 0) for row, n in alike.items() for i in range(n))
    found = shards.scattered(table, 20).groupBy("bucket_").count().collect()
    assert sum(r["count"] for r in found) == len(rows) and max(r["count"] for r in found) < 2 * len(rows) / 20
    found = suffixes.in_blocks(table, 10).groupBy("block_").count().collect()
    assert sum(r["count"] for r in found) == len(rows) and max(r["count"] for r in found) < 2 * len(rows) / 10
    once = shards.op10(table).collect()
    assert Counter((r["doc_id"], r["text_crc32"]) for r in once) == Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(map(repr, once)) == sorted(map(repr, shards.op10(table.repartition(7)).collect()))


@pytest.mark.parametrize("hot", [0, 30])
def test_suffix_dedup_of_a_hot_line(documents, monkeypatch, hot):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(30))
    line = "one line of fifty bytes or more that a third of all the texts have"
    rows = [(i, f"{word()}{line}{word()}" if i % 3 else word() * 3) for i in range(400)] + [(i, line[: 40 + i % 30] + word()) for i in range(400, 460)] + [(5, line * 2), (None, line)]
    rows += [(r["doc_id"] + 1000, r["text"]) for r in documents.select("doc_id", "text").limit(60).collect()]
    blocks = {i: pa.table({"doc_id": pa.array([r[0] for r in part], pa.int64()), "text": pa.array([r[1] for r in part]), "block_": [i] * len(part)}) for i, part in enumerate((rows[::2], rows[1::2]))}
    monkeypatch.setattr(suffixes, "HOT", hot)  # within this process; the workers keep theirs
    sent = pa.concat_tables([suffixes._send_digits(3, 50, 32)(t) for t in blocks.values()])
    mask = pa.concat_tables([suffixes._repeated_digits(sent.filter(pc.equal(sent["part"], r))) for r in range(3) if pc.any(pc.equal(sent["part"], r)).as_py()])
    own = {i: mask.filter(pc.equal(mask["block_"], i)) for i in blocks}
    contexts = pa.concat_tables([suffixes._send_contexts(3, 50, 32)(blocks[i], own[i]) for i in blocks])
    assert max(contexts["part"].to_pylist()) >= 3 and (hot == 0 or min(contexts["part"].to_pylist()) < 3)
    bits = pa.concat_tables([suffixes._judge(3, 50, 32)(contexts.filter(pc.equal(contexts["part"], r))) for r in sorted(set(contexts["part"].to_pylist()))])
    answers = pa.concat_tables([mask.append_column("is_bits", pa.array([False] * len(mask))), bits.append_column("is_bits", pa.array([True] * len(bits)))])
    got = Counter()
    for i, t in blocks.items():
        block, gone = suffixes._removed(t, answers.filter(pc.equal(answers["block_"], i)), 3, 50, 32)
        for d, a, b in zip(t["doc_id"].to_pylist(), block.offsets[:-1], block.offsets[1:], strict=True):
            got[(d, b - a, gone[a:b].sum(), hashlib.sha256(block.data[a:b][~gone[a:b]].tobytes()).hexdigest())] += 1
    want = _brute_removed(rows)
    assert got == Counter({(d, n, g, h): k for (d, n, g, _, h), k in want.items()})


def test_suffix_dedup_of_rows_repeated_over_blocks(spark):
    line = "a line of more than fifty bytes that stands in several texts, again"
    rows = [(1, line)] * 60 + [(2, f"before {line} after")] * 60 + [(None, line)] * 60 + [(3, "short")] * 5
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in suffixes.remove_repeats(table, block_bytes=2000).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == _brute_removed(rows)


def test_shards_are_written_as_runs_of_slots(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "FILE_ROWS", 10)
    shards.write_shards(documents.select("doc_id", "text"), f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(r["doc_id"] for r in back.collect()) == sorted(r["doc_id"] for r in documents.collect())
    for folder in (tmp_path / "s").glob("shard=*"):
        runs = sorted(folder.glob("run_=*"), key=lambda x: int(x.name[5:]))
        own = [r["slot"] for run in runs for f in sorted(run.glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
        assert len(runs) > 1 and own == list(range(len(own)))
