"""Filter audit, conversation repair and repeated words against brute force: small tables, odd rows, hot groups."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from tidegauge.llm.interactions import audit, op11, verdicts
from tidegauge.llm.repair import Chart, audits, op12, repaired_turns
from tidegauge.llm.subtrees import op13, remove_repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _failing(docs):
    first = {}
    for doc_id, text, _ in docs:
        place = (doc_id is None, doc_id or 0)
        first[text or ""] = min(first.get(text or "", place), place)
    for doc_id, text, source in docs:
        t, words = text or "", WORD.findall(text or "")
        yield doc_id, source or "", {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": (doc_id is None, doc_id or 0) > first[t],
        }


def _audit(docs, labels):
    rows, out = list(_failing(docs)), []
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    for part in {p for _, p, _ in rows}:
        own, removed = [(i, f) for i, p, f in rows if p == part], Counter()
        for order in permutations("ABCDE"):
            live = own
            for step, x in enumerate(order):
                gone = [(i, f) for i, f in live if f[x]]
                before, live = live, [(i, f) for i, f in live if not f[x]]
                removed[x] += len(gone)
                fails = [(i, f) for i, f in own if f[x]]
                out.append([part, "".join(order), step + 1, x, len(live), len(gone), len(fails) - sum(f[x] for _, f in before), sum(sum(f.values()) == 1 for _, f in fails), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
        for row in out:
            if row[0] == part:
                row.append(removed[row[3]])
    return sorted(map(tuple, out))


def test_filter_audit_equals_brute_force(spark, odd_documents):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (7, 1, 1), (99, 1, 1), (None, 1, 1), (8, None, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = [(r["doc_id"], r["text"], r["source"]) for r in odd_documents.collect()]
    got = sorted(map(tuple, op11(odd_documents, table).select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()))
    assert got == _audit(docs, labels) and len(got) == 600 * len({s or "" for _, _, s in docs})


def test_filter_audit_of_a_hot_text_and_of_nothing(spark, no_documents):
    rows = [(i, "same text " * 30 if i % 3 else f"own words {i}", "hot" if i % 2 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    last = {r["part"]: r for r in op11(docs, labels).filter("filter_order = 'EABCD' and step = 1").collect()}
    assert {k: v["removed"] for k, v in last.items()} == {"hot": 1000 - 1, "": 1000}
    assert op11(no_documents, labels).count() == 0


def test_filter_audit_takes_other_filters(spark):
    judged = spark.createDataFrame([("p", True, False, True, False), ("p", True, True, False, True), ("p", False, False, False, False)], "part string, X boolean, Y boolean, good boolean, toxic boolean")
    found = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in audit(judged, "XY").collect()}
    assert found == {("XY", 1): (1, 2, 0, 3), ("XY", 2): (1, 0, 1, 1), ("YX", 1): (2, 1, 0, 1), ("YX", 2): (1, 1, 1, 3)}


def test_verdicts_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "x", "a"), (1, "x", "a"), (2, "x", "a"), (None, "x", "a")], "doc_id long, text string, source string")
    assert sorted(r["E"] for r in verdicts(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()) == [False, False, True, True]


def _damage(rows):
    plain = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def _cheapest(faults):
    """Least (cost, audit) of a legal result: all edits tried, or state by state where that's too many. faults: (initial, fault)."""
    if len(faults) > 3:
        return _state_by_state(faults)
    best = []

    def go(i, roles, cost, letters, inserts):
        if best and cost > best[0][0]:
            return
        if i == len(faults) and re.fullmatch("(s?(ua)+)?", roles):
            best[:] = [min([*best, (cost, letters)])]
        if inserts < 2:
            for r in "ua":
                go(i, roles + r, cost + 5, letters + "I", inserts + 1)
        if i < len(faults):
            initial, fault = faults[i]
            more = 5 if fault == 3 else 0
            go(i + 1, roles, cost + 2, letters + "D", 0)
            if fault not in (1, 2):
                go(i + 1, roles + (initial or "?"), cost + more, letters + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 1 + more, letters + "R", 0)

    go(0, "", 0, "", 0)
    return best[0]


def _state_by_state(faults):
    """The same with four states: nothing yet, s, u and a last."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(states):
        for _ in range(3):
            for (at, r), to in step.items():
                if at in states and r != "s":
                    states[to] = min(states.get(to, (99999, "")), (states[at][0] + 5, states[at][1] + "I"))
        return states

    states = inserted({"": (0, "")})
    for initial, fault in faults:
        new, more = {at: (c + 2, a + "D") for at, (c, a) in states.items()}, 5 if fault == 3 else 0
        if fault not in (1, 2):
            for (at, r), to in step.items():
                if at in states and (r == initial or r != "s"):
                    c, a = states[at]
                    new[to] = min(new.get(to, (99999, "")), (c + more, a + "K") if r == initial else (c + more + 1, a + "R"))
        states = inserted(new)
    return min(x for at, x in states.items() if at in ("", "a"))


def _faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append((role[:1], 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0))
        seen.add((role, text))
    return out


def _repaired(turns, letters):
    out, at, expects = [], 0, "user"
    for x in letters:
        _, role, text = turns[at] if x != "I" else (None, None, "")
        at += x != "I"
        if x != "D":
            role = role if x == "K" else expects
            expects = "assistant" if role[:1] == "u" else "user"
            out.append(f"{role}:{text}")
    return "\n".join(out)


def _conversations(seed, n):
    rng, rows = np.random.default_rng(seed), []
    for conv in range(n):
        for turn in range(int(rng.integers(1, 6))):
            role = str(rng.choice(["system", "user", "assistant", "assistant", "user", "tool", ""]))
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn + int(rng.integers(0, 2)), None if rng.random() < 0.03 else role, [None, "", "\t ", "Yes.", "Yes.", "No", f"text {turn}!"][int(rng.integers(0, 7))]))
    return rows


def test_conversation_repair_equals_brute_force(spark):
    rows = _conversations(3, 120)
    got = {r["conv_id"]: r for r in op12(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {r[0] for r in rows}
    damaged = list(_damage(rows))
    for conv, r in got.items():
        turns = sorted(((t, role, text) for c, t, role, text in damaged if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        faults, known = _faults(turns), [t for t, _, _ in turns if t is not None]
        cost, letters = _cheapest(faults)
        pairs = [a[0] + b[0] for a, b in zip(faults, faults[1:], strict=False)]
        assert (r["cost"], r["audit"]) == (cost, letters)
        assert [r["blank"], r["duplicate"], r["truncated"]] == [sum(f == k for _, f in faults) for k in (1, 2, 3)]
        assert r["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs) and r["gaps"] == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert r["repaired_sha256"] == hashlib.sha256(_repaired(turns, letters).encode()).hexdigest()


def test_a_long_conversation_equals_a_plain_chart(spark):
    """Thousands of turns of one conversation over several batches: edits settle on the way, and nothing of the result changes."""
    rng = np.random.default_rng(5)
    rows = [(7, t, str(rng.choice(["user", "assistant", "system"], p=[0.48, 0.48, 0.04])), f"t{int(rng.integers(0, 3000))}{rng.choice(['.', ''], p=[0.9, 0.1])}") for t in range(5000)]
    rows += [(8, t, "user", f"t{t}.") for t in range(301)]  # its edits stay open to the end
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in audits(table).collect():
        turns, chart = [x[1:] for x in rows if x[0] == r["conv_id"]], Chart()
        column = chart.start
        for fault in _faults(turns):
            column = chart.advance(column, *fault)
        assert (r["cost"], r["audit"]) == chart.best(column)
        assert r["repaired_sha256"] == hashlib.sha256(_repaired(turns, r["audit"]).encode()).hexdigest()
    told = repaired_turns(table).filter("conv_id = 8").orderBy("place").collect()
    assert [x["role"] for x in told] == ["user", "assistant"] * 150 and told[0]["turn"] == 1 and {x["edit"] for x in told} == {"K", "R"}


def test_no_conversations(spark):
    assert op12(spark.createDataFrame([], "conv_id long, turn long, role string, text string, fault_ int")).count() == 0


def _kept_words(docs, width=35):
    words = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def _passages(seed):
    """Texts of a small vocabulary with shared passages of 30 to 60 words, cut and shifted; copies; a text that repeats itself."""
    rng, docs = np.random.default_rng(seed), []
    pick = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    shared = [pick(int(rng.integers(30, 60))) for _ in range(12)]
    for i in range(150):
        own = pick(int(rng.integers(0, 80)))
        for _ in range(int(rng.integers(0, 3))):
            p = shared[int(rng.integers(0, 12))]
            own += p[int(rng.integers(0, 4)) : len(p) - int(rng.integers(0, 4))] + pick(int(rng.integers(0, 20)))
        docs.append((i, " \n"[i % 2].join(own)))
    docs += [(200, " ".join(pick(20) * 6)), (201, None), (202, ""), (203, " \t"), (None, docs[3][1]), (3, docs[3][1]), (204, "x " * 34), (205, "y " * 36), (206, " ".join(pick(35)))]
    return docs


@pytest.mark.parametrize(("block", "hot"), [(2 << 20, 20_000), (2000, 20_000), (2000, 0), (2000, 3)])
def test_repeated_words_equal_brute_force(spark, block, hot):
    docs = _passages(1)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = remove_repeated_words(table, block, False, hot).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == _kept_words(docs)


def test_repeated_words_of_odd_documents(spark, odd_documents, no_documents):
    docs = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert sorted((tuple(r) for r in op13(odd_documents).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == _kept_words(docs)
    whole = remove_repeated_words(odd_documents)
    assert set(odd_documents.columns) - {"block_"} < set(whole.columns) and whole.count() == len(docs)
    assert op13(no_documents).count() == 0
