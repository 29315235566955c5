"""The pipeline's stages, each on what the one before it kept, against brute force."""

import random
from collections import Counter

import corpus_pipeline as p
import pytest

from .test_operators import WORD, _base, _brute_removed, _similar, _targets


@pytest.fixture(scope="module")
def steps(spark, small, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, small).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_stages(steps):
    docs, good, single, fresh, mixed, encoded = steps
    columns = docs.columns
    assert all(x.columns == columns for x in steps[:-1])
    texts = {r["doc_id"]: r for r in docs.collect()}
    kept = good.collect()
    assert kept and all(r == texts[r["doc_id"]] and not _base(r["text"])[-1] for r in kept)
    group = _similar([(r["doc_id"], r["text"]) for r in kept])
    left = Counter(group[r["doc_id"]] for r in single.collect())
    assert set(left) == set(group.values()) and sum(left.values()) <= 1.03 * len(left)  # none lost, and few links not found
    assert all(r == texts[r["doc_id"]] for r in single.collect())
    removed = _brute_removed([(r["doc_id"], r["text"]) for r in single.collect()])
    lengths = {i: n - gone for i, n, gone, _, _ in removed}
    untouched = {i for i, _, gone, _, _ in removed if not gone}
    for r in fresh.collect():
        assert len(r["text"].encode()) <= lengths[r["doc_id"]] and (r["doc_id"] not in untouched or r["text"] == texts[r["doc_id"]]["text"])
    words, sizes, taken = {}, Counter(), Counter()
    for r in fresh.collect():
        words[r["doc_id"]] = (r["source"], WORD.findall(r["text"]))
        sizes[r["source"]] += len(words[r["doc_id"]][1])
    for r in mixed.collect():
        source, own = words[r["doc_id"]]
        part = WORD.findall(r["text"])
        assert r["source"] == source and " ".join(part) in " ".join(own)
        taken[source] += len(part)
    assert all(abs(taken[s] - t) <= 64 * (sum(r == s for r, _ in words.values()) + 8) for s, t in _targets(dict(sizes)).items())
    assert encoded.count() == mixed.count() and encoded.filter("not lossless").count() == 0


def test_run(spark, small, steps):
    assert Counter(map(str, p.run(spark, small).collect())) == Counter(map(str, steps[-1].collect()))


def test_stages_on_odd_and_empty_tables(spark, small, odd_documents, no_documents):
    for table in (odd_documents, no_documents):
        rows = Counter(map(str, table.collect()))
        for name, stage in p.STAGES[:-1]:
            found = stage(spark, table, small)
            assert found.columns == table.columns, name
            got = Counter(map(str, found.collect()))
            if name in ("quality rules", "SimHash near-dedup"):
                assert not got - rows
            if table is no_documents:
                assert not got
        assert p.STAGES[-1][1](spark, table, small).count() == table.count()
    left = [r["text"] for r in p.simhash_near_dedup(spark, odd_documents, small).collect()]
    assert len(left) == len(set(left)) == 6


def _jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_repeats_that_dominate_do_not_merge_texts(spark):
    from tidegauge.llm.simhash import keep_dissimilar

    short = "a b c d e " * 100
    docs = spark.createDataFrame([(1, short), (2, short + " ".join(f"w{i}" for i in range(50)))], "doc_id long, text string")
    assert keep_dissimilar(docs).count() == 2


def test_recall_of_links_just_above_the_threshold(spark):
    """Made pairs of 300 words with a similarity just above 0.8; half of them with a third text that is near both by prints, but not alike."""
    from tidegauge.llm.simhash import keep_dissimilar

    rng, rows, n = random.Random(2), [], 0
    while n < 300:
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        other = list(words)
        for at in rng.sample(range(300), 6):
            other[at] = f"v{rng.randrange(10**6)}"
        a, b = " ".join(words), " ".join(other)
        if not 0.8 <= _jaccard(a, b) <= 0.86:
            continue
        rows += [(3 * n + 1, a), (3 * n + 2, b)]
        if n % 2:
            third = list(words)
            for at in rng.sample(range(300), 9):
                third[at] = f"u{rng.randrange(10**6)}"
            if _jaccard(" ".join(third), a) < 0.8 and _jaccard(" ".join(third), b) < 0.8:
                rows.append((3 * n, " ".join(third)))
        n += 1
    left = {r["doc_id"] for r in keep_dissimilar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(3 * i + 2 not in left for i in range(300)) >= 0.9 * 300
    assert all(3 * i + 1 in left for i in range(300)) and all(i in left for i, _ in rows if i % 3 == 0)


def test_no_link_is_lost_among_many_that_are_near_but_not_alike(spark):
    """300 texts of one stock of words, near each other by prints, some pairs just above 0.8: groups are those of all verified links that meet at an anchor."""
    import numpy as np

    from tidegauge.llm import simhash

    rng = random.Random(4)
    stock = [f"w{rng.randrange(5000)}" for _ in range(300)]

    def changed(words, n):
        words = list(words)
        for at in rng.sample(range(0, 300, 5), n):
            words[at] = f"v{rng.randrange(10**6)}"
        return words

    bases = [changed(stock, 2) for _ in range(150)]
    texts = [" ".join(changed(base, 3)) for base in bases for _ in range(2)]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    prints = np.stack([simhash.wide_fingerprint(s, simhash.PRINTS) for s in sets])
    first = prints[:, 0] & 0xFFFFFFFF
    meet = {}
    for number in range(simhash.PRINTS):
        for pair in simhash.ALL_TABLES:
            for i, home in enumerate(simhash.anchors(np.ascontiguousarray(prints[:, number]), pair, 0)[0]):
                meet.setdefault((number, pair, int(home)), []).append(i)
    near = set()
    for group in meet.values():
        own = [i for i in group if any(np.bitwise_count(first[i] ^ first[j]) <= simhash.apart_at_most(0.8, 32) for j in group if j != i)]
        near |= {(i, j) for i in own for j in own if i < j and np.bitwise_count((prints[i] ^ prints[j])[: simhash.COMPARED].view(np.uint64)).sum() <= simhash.apart_at_most(0.8, 64 * simhash.COMPARED)}
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    alike = 0
    for i, j in near:
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            alike, root[max(find(i), find(j))] = alike + 1, min(find(i), find(j))
    want = {find(i) for i in range(len(texts))}
    left = {r["doc_id"] for r in simhash.keep_dissimilar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(near) > 20 * alike > 1000 and left == want, (len(near), alike, len(want), len(left - want), len(want - left))


def test_a_group_of_near_copies_does_not_meet_again_at_each_anchor(spark, monkeypatch):
    """200 near copies and 40 texts that are near them but not alike: the rows that are dealt to be compared stay few for each of them."""
    from tidegauge.llm import simhash

    rng, dealt, in_order = random.Random(7), [], simhash._in_order

    def counted(rows):
        dealt.append(rows.count())
        return in_order(rows)

    def changed(n):
        words = list(stock)
        for at in rng.sample(range(0, 300, 5), n):
            words[at] = f"v{rng.randrange(10**6)}"
        return " ".join(words)

    monkeypatch.setattr(simhash, "_in_order", counted)
    stock = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = [changed(2) for _ in range(200)] + [changed(10) for _ in range(40)]
    left = {r["doc_id"] for r in simhash.keep_dissimilar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert left == {0, *range(200, 240)}
    assert sum(dealt) < 30 * len(texts), dealt
