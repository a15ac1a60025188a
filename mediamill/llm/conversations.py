"""Conversation structure repair: fault flags by windows, then one higher-order fold over each conversation's sorted turns."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpointed

#: Conversations of at most so many rows and bytes of text are folded as arrays; longer ones row by row over sorted partitions.
ROWS, BYTES = 1024, 8 << 20
#: The costs of the edits, and of keeping a text that breaks off.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: More than any edits cost.
NEVER = 1 << 50
_SPACE = " \t\n\x0b\x0c\r"


def damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv, turn, role, text, copies): rows with the faults that their key's checksum gives; copies is 0 for dropped rows, 2 for repeated ones."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), F.lit(" ")))
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def flagged(rows: DataFrame) -> DataFrame:
    """Each row's place, first fault and whether it may not follow the row before it; a conversation of no rows keeps one without a place.

    Rows go by turn (null first), role and text, so that copies stand side by side.
    """
    rows = rows.withColumn("copy", F.explode(F.when(F.col("copies") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("copies")))))
    there = F.col("copies") > 0
    order = Window.partitionBy("conv", "there").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    seen = Window.partitionBy("conv", "there", "role", "text").orderBy("place")
    rows = rows.repartition(F.col("conv")).withColumn("there", there).withColumn("place", F.row_number().over(order))
    initial = F.substring("role", 1, 1)
    rows = rows.withColumn("illegal", ~F.concat(F.substring(F.lag("role").over(order), 1, 1), initial).isin("su", "ua", "au"))
    rest = F.rtrim("text", F.lit(_SPACE))
    fault = F.when(rest == "", "blank").when(F.row_number().over(seen) > 1, "duplicate").when(~F.substring(rest, -1, 1).isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("fault", fault).withColumn("initial", initial)
    return rows.select("conv", "there", "place", "turn", "role", "text", "initial", "fault", F.coalesce("illegal", F.lit(False)).alias("illegal"))


def _add(state: Column, cost: Column | int, edit: str) -> Column:
    return F.struct((state.cost + cost).alias("cost"), F.concat(state.audit, F.lit(edit)).alias("audit"))


def _filled(s: Column) -> tuple[Column, Column]:
    """After a user's and after an assistant's turn, with turns put in where that is cheapest."""
    user = F.least(s.user, _add(s.none, INSERT, "I"), _add(s.system, INSERT, "I"), _add(s.assistant, INSERT, "I"))
    return user, F.least(s.assistant, _add(user, INSERT, "I"))


def _step(s: Column, turn: Column) -> Column:
    """One turn deleted, kept or given another role, from each of the four states to each."""
    user, assistant = _filled(s)
    must_go = F.coalesce(turn.fault.isin("blank", "duplicate"), F.lit(False))
    more = F.when(turn.fault == "truncated", TRUNCATED).otherwise(0)

    def speak(before: Column, initial: str) -> Column:
        kept = F.when(turn.initial == initial, _add(before, more, "K")).otherwise(_add(before, more + REROLE, "R"))
        return F.when(must_go, _add(before, NEVER, "K")).otherwise(kept)

    system = F.when(must_go | (turn.initial != "s"), _add(s.none, NEVER, "K")).otherwise(_add(s.none, more, "K"))
    return F.struct(
        _add(s.none, DELETE, "D").alias("none"),
        F.least(_add(s.system, DELETE, "D"), system).alias("system"),
        F.least(_add(user, DELETE, "D"), speak(F.least(s.none, s.system, assistant), "u")).alias("user"),
        F.least(_add(assistant, DELETE, "D"), speak(user, "a")).alias("assistant"),
    )


def _folded(turns: Column) -> Column:
    """The cheapest edits of a sorted array of turns: (cost, audit)."""
    state = lambda cost: F.struct(F.lit(cost).cast("long").alias("cost"), F.lit("").alias("audit"))
    start = F.struct(state(0).alias("none"), state(NEVER).alias("system"), state(NEVER).alias("user"), state(NEVER).alias("assistant"))
    return F.aggregate(turns, start, _step, lambda s: F.least(s.none, _filled(s)[1]))


def _repaired(turns: Column, audit: Column) -> Column:
    """The lines ``role:text`` that the edits leave, joined by newlines."""
    upto = lambda j, without: F.length(F.translate(F.substring(audit, F.lit(1), j), without, ""))
    once = lambda value, of: F.transform(F.array(value), of)[0]  # noqa: E731  a lambda's variable is computed once, an outer expression at each use

    def line(j: Column, led: Column) -> Column:
        edit = F.substring(audit, j, F.lit(1))
        turn = F.get(turns, upto(j, "I") - 1)
        own = F.when((upto(j, "D") + led) % 2 == 1, "user").otherwise("assistant")
        return F.when(edit == "K", F.concat(turn.role, F.lit(":"), turn.text)).when(edit == "R", F.concat(own, F.lit(":"), turn.text)).when(edit == "I", F.concat(own, F.lit(":")))

    def lines(led: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(audit)), lambda j: line(j, led)), "\n")

    def first(own: Column) -> Column:
        """1 if a system turn is kept: it stands first, so the number of a line tells whose turn it is."""
        return F.exists(F.sequence(F.lit(1), F.size(turns)), lambda j: (F.substring(own, j, F.lit(1)) == "K") & (F.element_at(turns, j).initial == "s")).cast("int")

    return F.when(F.length(audit) == 0, "").otherwise(once(once(F.translate(audit, "I", ""), first), lines))


def _short(rows: DataFrame) -> DataFrame:
    """Conversations as arrays, by native expressions alone."""
    turn = F.when(F.col("there"), F.struct("place", "turn", "role", "text", "initial", "fault", "illegal"))
    convs = rows.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def ended(fold: Column) -> Column:
        return F.struct(fold.cost.alias("cost"), fold.audit.alias("audit"), F.sha2(F.when(F.size("turns") > 0, _repaired(F.col("turns"), fold.audit)).otherwise("").cast("binary"), 256).alias("repaired_sha256"))

    fold = F.when(F.size("turns") > 0, _folded(F.col("turns"))).otherwise(F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")))
    # a lambda's variable is computed once, an outer expression wherever a line asks for it
    convs = convs.withColumn("end", F.transform(F.array(fold), ended)[0])
    times = F.filter(F.transform("turns", lambda t: t.turn), lambda t: t.isNotNull())
    gaps = F.array_max(times) - F.array_min(times) + 1 - F.size(F.array_distinct(times))

    def number(test: Callable[[Column], Column]) -> Column:
        return F.size(F.filter("turns", lambda t: F.coalesce(test(t), F.lit(False)))).cast("long")

    def having(fault: str) -> Column:
        return number(lambda t: t.fault == fault).alias(fault)

    return convs.select(
        "conv",
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        *map(having, ("blank", "duplicate", "truncated")),
        number(lambda t: t.illegal).alias("illegal"),
        "end.*",
    )


class _Run:
    """The fold of one long conversation, row by row: for each state its cost, the edits that it doesn't share with the others yet, and a running hash."""

    def __init__(self) -> None:
        self.states = {"": (0, "", hashlib.sha256(), 0)}
        self.audit: list[str] = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.last = None
        self.times = self.rows = 0

    @staticmethod
    def _next(states: dict, to: str, state: str, cost: int, edit: str, line: tuple[str, str] | None) -> None:
        before, audit, digest, lines = states[state]
        best = states.get("+" + to)
        if best is None or (before + cost, audit + edit) < best[:2]:
            states["+" + to] = (before + cost, audit + edit, (digest, line, lines), None)

    @staticmethod
    def _settled(found: dict) -> dict:
        out = {}
        for to, (cost, audit, (digest, line, lines), _) in found.items():
            if line is not None:
                digest = digest.copy()
                digest.update(("\n" * (lines > 0) + f"{line[0]}:{line[1]}").encode())
                lines += 1
            out[to] = (cost, audit, digest, lines)
        return out

    def _fill(self) -> None:
        for sources, to, role in ((("", "s", "a"), "u", "user"), (("u",), "a", "assistant")):
            found = dict(self.states)
            for state in sources:
                if state in found:
                    self._next(found, to, state, INSERT, "I", (role, ""))
            new = self._settled({k[1:]: v for k, v in found.items() if k.startswith("+")})
            for k, v in new.items():
                if k not in self.states or v[:2] < self.states[k][:2]:
                    self.states[k] = v

    def add(self, turn: int | None, role: str, text: str, initial: str, fault: str | None, illegal: bool) -> None:
        self.rows += 1
        if fault:
            self.counts[fault] += 1
        self.counts["illegal"] += illegal
        if turn is not None:
            self.times += self.first is None or turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        self._fill()
        found = dict(self.states)
        more = TRUNCATED * (fault == "truncated")
        for state in self.states:
            self._next(found, state, state, DELETE, "D", None)
            if fault in ("blank", "duplicate"):
                continue
            if state == "" and initial == "s":
                self._next(found, "s", state, more, "K", (role, text))
            to, other = ("a", "assistant") if state == "u" else ("u", "user")
            if initial == to:
                self._next(found, to, state, more, "K", (role, text))
            else:
                self._next(found, to, state, more + REROLE, "R", (other, text))
        self.states = self._settled({k[1:]: v for k, v in found.items() if k.startswith("+")})
        if self.rows % 256 == 0:  # what all share is settled
            same = os.path.commonprefix([s[1] for s in self.states.values()])
            self.audit.append(same)
            self.states = {k: (c, a[len(same) :], d, n) for k, (c, a, d, n) in self.states.items()}

    def result(self) -> tuple:
        self._fill()
        cost, audit, digest, _ = min((self.states[k] for k in ("", "a") if k in self.states), key=lambda s: s[:2])
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.times
        return gaps, *self.counts.values(), cost, "".join(self.audit) + audit, digest.hexdigest()


def _long(rows: DataFrame) -> DataFrame:
    """Conversations of any length, one row at a time in a task's memory; a key is an order of rows and so one task."""
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        key, fold = None, None

        def out(schema: pa.Schema) -> pa.RecordBatch:
            values = [key, *fold.result()]
            types = [schema.field("conv").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                if fold is None or r["conv"] != key:
                    if fold is not None:
                        yield out(batch.schema)
                    key, fold = r["conv"], _Run()
                if r["there"]:
                    fold.add(r["turn"], r["role"], r["text"], r["initial"], r["fault"], r["illegal"])
            schema = batch.schema
        if fold is not None:
            yield out(schema)

    numbers = ", ".join(f"{n} long" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return rows.repartition(F.col("conv")).sortWithinPartitions("conv", "there", "place").mapInArrow(run, f"conv {kind}, {numbers}, audit string, repaired_sha256 string")


def repair(rows: DataFrame, longest: int = ROWS, largest: int = BYTES) -> DataFrame:
    """One row per conversation of ``rows`` (conv, turn, role, text, copies): faults, and the cheapest edits to ``(s?(ua)+)?``.

    Columns: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows of one turn go by
    role and text. A role without a first letter fits nowhere, like any that isn't s, u or a. Rows that come twice are
    duplicates of each other. A conversation whose rows all have no copies has zeros, no edits and the
    hash of no text; a null id is a conversation of its own; an empty table gives an empty one.
    Other columns don't come along.

    Up to ``longest`` rows and ``largest`` bytes, a conversation is an array and the fold a native
    expression. Longer ones are few (each takes that much of the table); they go row by row over
    sorted partitions with the same four states, so a conversation of any size takes bounded memory but for its audit.
    """
    sizes = rows.groupBy("conv").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"))
    beyond = checkpointed(sizes.where((F.col("n") > longest) | (F.col("bytes") > largest)).select(F.struct("conv").alias("k")))
    if beyond.isEmpty():
        return _short(flagged(rows))
    keyed = rows.withColumn("k", F.struct("conv"))
    short = keyed.join(beyond, "k", "left_anti").drop("k")
    return _short(flagged(short)).unionByName(_long(flagged(keyed.join(beyond, "k", "left_semi").drop("k"))))


#: The same result as DuckDB SQL. The checksum's table and the fold are written out, as there is no such function.
ORACLE = r"""
WITH RECURSIVE bits AS (
    SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT),
            lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
    FROM conversations, bits
), hurt AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM given WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS rest FROM hurt
), marked AS (
    SELECT conv_id, turn, role, text, i, role[1] AS r,
        CASE WHEN rest = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN rest[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au') AS illegal
    FROM placed
), ids AS (
    SELECT DISTINCT conv_id FROM conversations
), fold AS (
    SELECT conv_id, 0 AS i, 0 AS n, 900000 AS s, 900000 AS u, 900000 AS a, '' AS n_, '' AS s_, '' AS u_, '' AS a_, '' AS n_t, '' AS s_t, '' AS u_t, '' AS a_t FROM ids
    UNION ALL
    SELECT conv_id, i, n.c, s.c, u.c, a.c, n.e, s.e, u.e, a.e, n.t, s.t, u.t, a.t FROM (
        SELECT f.conv_id, m.i, {c: f.n + 2, e: n_ || 'D', t: n_t} AS n,
            least({c: f.s + 2, e: s_ || 'D', t: s_t}, {c: CASE WHEN r = 's' AND NOT gone THEN f.n + more ELSE 900000 END, e: n_ || 'K', t: n_t || role || ':' || text || chr(10)}) AS s,
            least({c: fu.c + 2, e: fu.e || 'D', t: fu.t}, {c: CASE WHEN gone THEN 900000 ELSE b.c + more + (r <> 'u')::INT END, e: b.e || CASE r WHEN 'u' THEN 'K' ELSE 'R' END, t: b.t || CASE r WHEN 'u' THEN role ELSE 'user' END || ':' || text || chr(10)}) AS u,
            least({c: fa.c + 2, e: fa.e || 'D', t: fa.t}, {c: CASE WHEN gone THEN 900000 ELSE fu.c + more + (r <> 'a')::INT END, e: fu.e || CASE r WHEN 'a' THEN 'K' ELSE 'R' END, t: fu.t || CASE r WHEN 'a' THEN role ELSE 'assistant' END || ':' || text || chr(10)}) AS a
        FROM (SELECT *, least({c: fold.n, e: n_, t: n_t}, {c: fold.s, e: s_, t: s_t}, fa) AS b FROM (SELECT *, least({c: fold.a, e: a_, t: a_t}, {c: fu.c + 5, e: fu.e || 'I', t: fu.t || 'assistant:' || chr(10)}) AS fa FROM (
            SELECT *, least({c: fold.u, e: u_, t: u_t}, {c: fold.n + 5, e: n_ || 'I', t: n_t || 'user:' || chr(10)}, {c: fold.s + 5, e: s_ || 'I', t: s_t || 'user:' || chr(10)}, {c: fold.a + 5, e: a_ || 'I', t: a_t || 'user:' || chr(10)}) AS fu FROM fold) fold) fold) f
        JOIN (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more FROM marked) m ON m.conv_id IS NOT DISTINCT FROM f.conv_id AND m.i = f.i + 1)
), ended AS (
    SELECT conv_id, unnest(least({c: n, e: n_, t: n_t}, {c: a, e: a_, t: a_t})) FROM fold QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM marked GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    e.c::BIGINT AS cost, e.e AS audit, sha256(CASE WHEN e.t = '' THEN '' ELSE left(e.t, -1) END) AS repaired_sha256
FROM ended e LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM e.conv_id
"""
