"""Repair of conversations: error-correcting Earley parsing of their roles by a weighted grammar with delete, rerole and insert productions."""

from __future__ import annotations

import hashlib
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tidegauge.llm.common import BLANKS

#: Initials of roles that a legal conversation has in order: one system turn at most, then user and assistant in turns. A
#: nonterminal stands only first in a production, so all items of a chart begin at column 0.
GRAMMAR = (("S", ""), ("S", "B"), ("B", "sua"), ("B", "ua"), ("B", "Bua"))
#: Roles that an edit can give, and costs: of edits, and of a truncated turn that stays.
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Faults of a turn, the first that holds.
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
LEGAL = {"su", "ua", "au"}
#: Turns after which audits are looked at for what all items agree on.
SETTLE = 64


class Chart:
    """An error-correcting Earley chart of one left-linear grammar.

    A column maps items (production, dot) to their minimum (cost, audit). What a turn does to an item depends on its role's
    initial and its fault only, so scanning and completing an item is worked out once a kind of turn. Of two audits of equal
    cost in one item neither begins with the other, since what is longer has more inserts, so the lesser prefix stays lesser.
    """

    def __init__(self, productions=GRAMMAR):
        self.productions, self._moves = productions, {}
        #: No item needs more than this to go on as any other does: it inserts up to a production, and deletes a turn.
        self.slack = INSERT * max(len(right) for _, right in productions) + DELETE
        self.start = self._closed({(p, 0): (0, "") for p, (_, right) in enumerate(productions) if not right or not self._left(right[0])})

    def _left(self, symbol: str) -> bool:
        return any(left == symbol for left, _ in self.productions)

    def _closed(self, column: dict) -> dict:
        """column with what inserts and completed productions lead to; completed ones of the start symbol stay."""
        work = list(column)

        def reach(item, found):
            if item not in column or found < column[item]:
                column[item] = found
                work.append(item)

        while work:
            p, dot = work.pop()
            (left, right), (cost, audit) = self.productions[p], column[p, dot]
            if dot == len(right):
                for q, (_, own) in enumerate(self.productions):
                    if own[:1] == left:
                        reach((q, 1), (cost, audit))
            elif right[dot] in NAMES:
                reach((p, dot + 1), (cost + INSERT, audit + "I"))
        return {(p, dot): x for (p, dot), x in column.items() if dot < len(self.productions[p][1]) or self.productions[p][0] == "S"}

    def _scanned(self, item, initial: str, fault: int) -> list:
        (p, dot), found = item, {item: (DELETE, "D")}
        right, surcharge = self.productions[p][1], TRUNCATED if fault == CUT else 0
        if fault not in (BLANK, DUPLICATE) and dot < len(right):
            if right[dot] == initial:
                found[p, dot + 1] = (KEEP + surcharge, "K")
            elif right[dot] in NAMES:
                found[p, dot + 1] = (REROLE + surcharge, "R")
        return [(to, cost, letters) for to, (cost, letters) in self._closed(found).items()]

    def advance(self, column: dict, initial: str, fault: int) -> dict:
        out: dict = {}
        for item, (cost, audit) in column.items():
            key = (item, initial, fault)
            if key not in self._moves:
                self._moves[key] = self._scanned(*key)
            for to, more, letters in self._moves[key]:
                found = (cost + more, audit + letters)
                if to not in out or found < out[to]:
                    out[to] = found
        most = min(x[0] for x in out.values()) + self.slack
        return {item: x for item, x in out.items() if x[0] <= most}

    def best(self, column: dict) -> tuple[int, str]:
        return min(x for (p, dot), x in column.items() if self.productions[p][0] == "S" and dot == len(self.productions[p][1]))


class Repair:
    """One conversation's turns in order, parsed as they come. Turns wait only until all items of the chart agree on their edits."""

    def __init__(self, chart: Chart, keep_turns: bool):
        self.chart, self.column, self.waiting, self.done, self.audit, self.hash = chart, chart.start, [], [], [], hashlib.sha256()
        self.counts, self.illegal, self.before, self.cost, self.kept, self.expects, self.keep_turns = [0, 0, 0, 0], 0, None, 0, 0, "u", keep_turns
        self.least, self.most, self.turns, self.last = None, None, 0, None

    def add(self, turn, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.counts[fault] += 1
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None:
            self.turns += turn != self.last
            self.least, self.most, self.last = turn if self.least is None else self.least, turn, turn
        self.waiting.append((turn, role, text))
        self.column = self.chart.advance(self.column, initial, fault)
        if len(self.waiting) % SETTLE == 0:
            self._settle(commonprefix([audit for _, audit in self.column.values()]))

    def _settle(self, audit: str) -> None:
        at = 0
        for edit in audit:
            turn, role, text = (None, None, "") if edit == "I" else self.waiting[at]
            at += edit != "I"
            if edit == "D":
                continue
            role = role if edit == "K" else NAMES[self.expects]
            self.expects = "a" if role[:1] == "u" else "u"
            self.hash.update((b"\n" if self.kept else b"") + f"{role}:{text}".encode())
            if self.keep_turns:
                self.done.append((self.kept, turn, edit, role, text))
            self.kept += 1
        self.audit.append(audit)
        self.waiting = self.waiting[at:]
        self.column = {item: (cost, own[len(audit) :]) for item, (cost, own) in self.column.items()}

    def finish(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        cost, audit = self.chart.best(self.column)
        self._settle(audit)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return gaps, *self.counts[1:], self.illegal, cost, "".join(self.audit), self.hash.hexdigest()


def marked(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault_, place_ of turns, each conversation in one partition and in order: by turn, nulls first, then role, text."""
    text = F.col("text")
    end = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    same = Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())
    dealt = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").withColumn("place_", F.row_number().over(same))
    fault = F.when(end == "", BLANK).when(F.col("place_") > 1, DUPLICATE).when(~end.isin(*".!?"), CUT).otherwise(NONE)
    return dealt.withColumn("fault_", fault).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "place_")


def _run(turns: DataFrame, fields: StructType, keep_turns: bool) -> DataFrame:
    out = StructType([turns.schema["conv_id"], *fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, chart, own, name, rows = to_arrow_schema(out), Chart(), None, None, []

        def take(finished: bool) -> None:
            if finished:
                summary = own.finish()
                if not keep_turns:
                    rows.append((name, *summary))
            rows.extend((name, *x) for x in own.done)
            own.done = []

        def table():
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return made

        for batch in batches:
            for conv, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault_")), strict=True):
                if own is None or conv != name:
                    if own is not None:
                        take(True)
                    own, name = Repair(chart, keep_turns), conv
                own.add(turn, role, text, fault)
            take(False)
            if rows:
                yield table()
        if own is not None:
            take(True)
            if rows:
                yield table()

    return marked(turns).mapInArrow(run, out)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place, turn, edit (K, R or I), role, text: each conversation's turns after its cheapest repair; inserted ones have no turn and no text.

    See audits() for the faults, the edits and odd input.
    """
    fields = StructType().add("place", LongType()).add(turns.schema["turn"]).add("edit", StringType()).add("role", StringType()).add("text", StringType())
    return _run(turns, fields, True)


def audits(turns: DataFrame) -> DataFrame:
    """A row for each conversation of turns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    turns: conv_id, turn, role, text, without nulls in role and text. Turns are taken in order of turn, nulls first; those of
    one turn in order of role, then text; rows alike throughout follow each other, and all but the first are duplicates.
    The texts are shuffled once, by conversation; duplicates are found by a window inside the same partitions. A conversation
    is parsed as a stream, however many batches it takes: SHA-256 runs over its turns in their order, which ties it to one
    task. Memory holds the chart's column and the turns whose edit is still open, and the audit. A null conv_id is a
    conversation like others; empty texts are blank; an empty table gives no rows.
    """
    fields = StructType()
    for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
        fields = fields.add(name, LongType())
    return _run(turns, fields.add("audit", StringType()).add("repaired_sha256", StringType()), False)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with planted faults by the checksum of conv_id and turn modulo 20: 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes its role user. Nulls count as one space, but for the order of turns."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    own = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return own.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12(conversations: DataFrame) -> DataFrame:
    """The audit of each conversation after damage; one that has no rows left has zeros, an empty audit and the hash of nothing."""
    found = audits(damaged(conversations)).withColumnRenamed("conv_id", "own")
    every = conversations.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    counts = (F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The checksum from its table; then costs and audits of four states (nothing yet, system, user, assistant) row by row.
OP12_SQL = f"""
WITH RECURSIVE bits AS (SELECT i AS b, i::UBIGINT AS c, 0 AS s FROM range(256) t(i) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, s + 1 FROM bits WHERE s < 8),
tab AS (SELECT list(c ORDER BY b) AS tb FROM bits WHERE s = 8),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::UBIGINT)), lambda a, x: xor(a >> 8, tb[CAST(xor(a, x) & 255 AS INTEGER) + 1])), 4294967295::UBIGINT) % 20 AS kind
  FROM conversations CROSS JOIN tab),
dmg AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM src WHERE kind <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, right(rtrim(text, {_BLANKS}), 1) AS last FROM dmg),
own AS (SELECT *, role[:1] AS r, CASE WHEN last = '' THEN 1 WHEN seen > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(role[:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[:1] AS pair FROM num),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM own GROUP BY 1),
dp AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS e, NULL::STRUCT(c BIGINT, a VARCHAR) AS s, {{'c': 5::BIGINT, 'a': 'I'}} AS u, {{'c': 10::BIGINT, 'a': 'II'}} AS a FROM facts
  UNION ALL SELECT conv_id, i, e, s, u1, list_min([a0, {{'c': u1.c + 5, 'a': u1.a || 'I'}}]) FROM (
      SELECT *, list_min([u0, {{'c': e.c + 5, 'a': e.a || 'I'}}, CASE WHEN s IS NOT NULL THEN {{'c': s.c + 5, 'a': s.a || 'I'}} END, {{'c': a0.c + 5, 'a': a0.a || 'I'}}]) AS u1 FROM (
      SELECT conv_id, i, {{'c': e.c + 2, 'a': e.a || 'D'}} AS e, list_min([CASE WHEN s IS NOT NULL THEN {{'c': s.c + 2, 'a': s.a || 'D'}} END, CASE WHEN stays AND r = 's' THEN {{'c': e.c + extra, 'a': e.a || 'K'}} END]) AS s,
        list_min([{{'c': u.c + 2, 'a': u.a || 'D'}}, CASE WHEN stays THEN {{'c': f.c + extra + CASE r WHEN 'u' THEN 0 ELSE 1 END, 'a': f.a || CASE r WHEN 'u' THEN 'K' ELSE 'R' END}} END]) AS u0,
        list_min([{{'c': a.c + 2, 'a': a.a || 'D'}}, CASE WHEN stays THEN {{'c': u.c + extra + CASE r WHEN 'a' THEN 0 ELSE 1 END, 'a': u.a || CASE r WHEN 'a' THEN 'K' ELSE 'R' END}} END]) AS a0
      FROM (SELECT d.* EXCLUDE (i), o.i, o.r, o.fault NOT IN (1, 2) AS stays, CASE o.fault WHEN 3 THEN 5 ELSE 0 END AS extra, list_min([d.e, d.s, d.a]) AS f FROM dp d JOIN own o ON o.conv_id IS NOT DISTINCT FROM d.conv_id AND o.i = d.i + 1)))),
best AS (SELECT d.conv_id, list_min([e, a]) AS b FROM dp d JOIN facts f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = f.n),
letters AS (SELECT conv_id, unnest(range(1, length(b.a) + 1)) AS j, b.a[j] AS edit FROM best),
placed AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i FROM letters),
stay AS (SELECT p.conv_id, j, edit, o.role, o.text, row_number() OVER (PARTITION BY p.conv_id ORDER BY j) AS k, first_value(edit = 'K' AND o.r = 's') OVER (PARTITION BY p.conv_id ORDER BY j) AS system
  FROM placed p LEFT JOIN own o ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND o.i = p.i AND edit <> 'I' WHERE edit <> 'D'),
told AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - system::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t FROM stay GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best x ON x.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN told w ON w.conv_id IS NOT DISTINCT FROM c.conv_id"""
