"""Repair of the structure of conversations by the cheapest edits.

A conversation's turns should have roles whose initials read ``(s?(ua)+)?``. Each row's first fault
counts: *blank* (nothing but white space), *duplicate* (the role and the text were there before),
*truncated* (the last character that is no white space is none of ``.!?``). Rows are kept (0), given
the role user or assistant (3) or deleted (4; blank and duplicate ones must be); rows without text
can be inserted anywhere, as user or assistant (3); a truncated row that stays costs 3 more. The audit
is the string of the edits' initials, and of the cheapest ones the least in ASCII is taken.

*Method.* A path through the graph of (rows read, last role put out) has one whole number as weight:
its high digits are the cost and the fixed number of low digits the letters of the audit, from the
left, D < I < K < R, with zeros where the audit has ended. Each edit adds its cost and its letter in
the next place, and the least number wins, at every node and at the end. Nothing else decides. Paths
that meet at a node have read the same rows, so none's audit is the beginning of another one's of equal
cost (it would have fewer insertions and the same other letters), and the smaller number stays the
smaller whatever follows. The letters that all nodes' paths begin with are settled and taken out now
and then, so numbers keep the length of a block.

*On Spark.* Faults are found where rows are read; which texts come again in a conversation is an
aggregate over digests, joined back. Then rows are dealt by conversation, sorted by turn on disk if
need be, and stream through a task, which holds four weights and four running hashes and no rows: the
hash of the repaired text is one of its bytes in order, so a conversation of any length passes one
task, in memory that does not grow but for the audit it returns.

Nulls are one space, in ids for the damage too; rows without conversation are one conversation, with a
null id. Turns that are null come first, rows of the same turn go by role and text, so repeated rows are
neighbours. Texts of any length are read whole. Other columns are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigevents.llm.common import stored, tidied

SPACE = r"\x20\x09-\x0D"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = " DIKR"
COSTS = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
TRUNCATED = 3
#: States: nothing put out yet, and the last role put out.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: From which states a row of a role can follow.
BEFORE = {SYSTEM: (EMPTY,), USER: (EMPTY, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
OF_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: What it costs at most to go on from user or assistant as from any other state: an insertion, and the deletion of a system row.
DETOUR = COSTS[INSERT] + COSTS[DELETE]
#: Bits of a letter, and letters between two settlements.
BITS, BLOCK = 3, 256


class Path(NamedTuple):
    weight: int
    letters: int
    text: hashlib._Hash


class Repair:
    """The cheapest paths over the rows of one conversation so far."""

    def __init__(self) -> None:
        self.width = BLOCK
        self.settled: list[str] = []
        self.base = 0  # cost that is taken off all weights
        self.at: list[Path | None] = [Path(0, 0, hashlib.sha256()), None, None, None]

    def _extended(self, path: Path, edit: int, more: int) -> int:
        return path.weight + (COSTS[edit] + more << BITS * self.width) + (edit << BITS * (self.width - 1 - path.letters))

    def _step(self, options: list[tuple[int, int, int, bytes | None, int]]) -> None:
        """Edges (from, to, edit, row, cost besides the edit's) to the next nodes; of those to one node the least weight stays."""
        best: dict[int, tuple[int, int, bytes | None]] = {}
        for begin, end, edit, row, more in options:
            path = self.at[begin]
            if path is not None:
                weight = self._extended(path, edit, more)
                if end not in best or weight < best[end][0]:
                    best[end] = (weight, begin, row)
        self.at = [self._walked(*best[k]) if k in best else None for k in range(4)]

    def _walked(self, weight: int, begin: int, row: bytes | None) -> Path:
        path, text = self.at[begin], self.at[begin].text.copy()
        if row is not None:
            text.update(row if begin == EMPTY else b"\n" + row)
        return Path(weight, path.letters + 1, text)

    def _insertions(self) -> None:
        """A row of each role where it makes the weight less; two at most, since a third only undoes one."""
        for end in (USER, ASSISTANT):
            for begin in BEFORE[end]:
                path = self.at[begin]
                if path is not None:
                    weight = self._extended(path, INSERT, 0)
                    if self.at[end] is None or weight < self.at[end].weight:
                        self.at[end] = self._walked(weight, begin, f"{NAMES[end]}:".encode())

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        self._insertions()
        edges = [(k, k, DELETE, None, 0) for k in range(4)]
        if not must_go:
            more = TRUNCATED if truncated else 0
            own = OF_INITIAL.get(role[:1])
            if own is not None:
                raw = f"{role}:{text}".encode()
                edges += [(k, own, KEEP, raw, more) for k in BEFORE[own]]
            for end in (USER, ASSISTANT):
                raw = f"{NAMES[end]}:{text}".encode()
                edges += [(k, end, REROLE, raw, more) for k in BEFORE[end]]
        self._step(edges)
        if max(p.letters for p in self.at if p) > self.width - 6:
            self._settle()

    def _settle(self) -> None:
        """Take out the letters and the cost that all paths share, and make room for a block more."""
        low = BITS * self.width
        ends = [p.weight >> low for p in self.at[USER:] if p]
        if ends:  # from there any other path's rest costs DETOUR more at most, so dearer ones cannot win
            self.at = [p if p and p.weight >> low <= min(ends) + DETOUR else None for p in self.at]
        live = [p for p in self.at if p]
        letters = [p.weight & (1 << low) - 1 for p in live]
        common = min((low - (min(letters) ^ max(letters)).bit_length()) // BITS, min(p.letters for p in live))
        self.settled.append(self._spelled(letters[0], common))
        least = min(p.weight >> low for p in live)
        self.base += least
        width = self.width - common + BLOCK
        grown = BITS * (width - self.width + common)

        def moved(p: Path) -> Path:
            rest = p.weight & (1 << low - BITS * common) - 1
            return Path((p.weight >> low) - least << BITS * width | rest << grown, p.letters - common, p.text)

        self.at = [moved(p) if p else None for p in self.at]
        self.width = width

    def _spelled(self, letters: int, n: int) -> str:
        return "".join(LETTERS[letters >> BITS * (self.width - 1 - i) & 7] for i in range(n))

    def result(self) -> tuple[int, str, str]:
        """Cost, audit, hash of the repaired text."""
        self._insertions()
        best = min((p for p in (self.at[EMPTY], self.at[ASSISTANT]) if p), key=lambda p: p.weight)
        audit = "".join(self.settled) + self._spelled(best.weight & (1 << BITS * self.width) - 1, best.letters)
        return self.base + (best.weight >> BITS * self.width), audit, best.text.hexdigest()


def _shown(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def plain(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with texts for nulls; ``gone`` is false."""
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), _shown("role").alias("role"), _shown("text").alias("text"), F.lit(False).alias("gone"))


def damaged(turns: DataFrame) -> DataFrame:
    """``plain`` rows with a fault put into some, by CRC-32 of ``conv_id:turn`` modulo 20.

    0: the row is ``gone`` (it stays, so that its conversation is known), 1: no text, 2: no ``.!?``,
    3: the row twice, 4: the role user.
    """
    fault = F.crc32(F.concat(_shown("conv_id"), F.lit(":"), _shown("turn")).cast("binary")) % 20
    rows = plain(turns).withColumn("fault", fault)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), times.alias("_again")).drop("_again")


#: Texts that come again in a conversation up to which their list is broadcast; an entry has about 60 bytes.
BROADCAST_REPEATS = 100_000


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with _c (the conversation, also if null), later (role and text are there in an earlier turn), blank, truncated."""
    rows = rows.withColumn("_c", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    digest = F.when(~F.col("gone"), F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumn("_d", digest)
    at = F.struct(F.col("turn").isNotNull().alias("some"), "turn")  # nulls first
    again = rows.where("not gone").groupBy("_c", "_d").agg(F.count("*").alias("_n"), F.min(at).alias("_first")).where("_n > 1").select("_c", "_d", "_first")
    again = stored(again, "repeats")
    if again.count() <= BROADCAST_REPEATS:
        again = F.broadcast(again)
    rows = rows.join(again, ["_c", "_d"], "left")
    later = F.coalesce(F.col("_first") < at, F.lit(False))
    return rows.select("_c", "conv_id", "turn", "role", "text", "gone", later.alias("later"), (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("truncated"))


STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
LEGAL = {"su", "ua", "au"}


class _Conversation:
    """What is told of one conversation, row after row."""

    def __init__(self) -> None:
        self.repair = Repair()
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.last: tuple | None = None
        self.first_turn = self.last_turn = None
        self.turns = 0

    def row(self, turn: int | None, role: str, text: str, later: bool, blank: bool, truncated: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1
        again = not blank and (later or self.last == (turn, role, text))
        truncated = truncated and not blank and not again
        for name, is_so in (("blank", blank), ("duplicate", again), ("truncated", truncated)):
            self.counts[name] += is_so
        if self.last is not None and self.last[1][:1] + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        self.last = (turn, role, text)
        self.repair.row(role, text, blank or again, truncated)

    def result(self) -> tuple:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return (gaps, *self.counts.values(), *self.repair.result())


def repair(rows: DataFrame) -> DataFrame:
    """conv_id with gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``rows`` as from ``plain`` or ``damaged``. gaps: turns between the first and the last that no row has;
    illegal: neighbours whose roles' initials are none of su, ua, au; the hash is of the repaired rows as
    ``role:text``, joined by line feeds. A conversation all of whose rows are gone has zeros and no edits.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by conversation and turn: one conversation at a time, and nothing of it but its state
        key, now, out = None, None, []
        for batch in batches:
            ids = batch.column("conv_id")
            columns = [batch.column(c).to_pylist() for c in ("_c", "gone", "turn", "role", "text", "later", "blank", "truncated")]
            for i, (c, gone, *row) in enumerate(zip(*columns, strict=True)):
                if c != key:
                    if now is not None:
                        out.append((own, *now.result()))
                    key, now, own = c, _Conversation(), ids[i].as_py()
                if not gone:
                    now.row(*row)
            if out:
                yield packed(out, ids.type)
                out = []
        if now is not None:
            yield packed([(own, *now.result())], ids.type)

    def packed(out: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        kinds = [of, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["conv_id", *STATS])

    order = ("_c", F.asc_nulls_first("turn"), "role", "text")
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _marked(rows).repartition("_c").sortWithinPartitions(*order).mapInArrow(tidied(run), schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (I, K or R), role, text.

    The audit's letters are joined to the rows in their order; roles alternate after a system row.
    """
    c = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    audit = stored(repair(rows), "audits").select(c.alias("_c"), F.posexplode(F.split("audit", "")).alias("_at", "edit")).where("edit <> ''")
    by = Window.partitionBy("_c").orderBy("_at")
    edits = audit.withColumn("_row", F.sum((F.col("edit") != "I").cast("int")).over(by)).where("edit <> 'D'").withColumn("place", F.row_number().over(by) - 1)
    kept = rows.where("not gone").select(c.alias("_c"), "turn", "role", "text")
    kept = kept.withColumn("_row", F.row_number().over(Window.partitionBy("_c").orderBy(F.asc_nulls_first("turn"), "role", "text")))
    met = edits.join(kept.withColumn("_own", F.lit(True)), ["_c", "_row"], "left").withColumn("_own", (F.col("edit") != "I") & F.col("_own"))
    system = F.max(F.when((F.col("place") == 0) & (F.col("edit") == "K") & F.col("role").startswith("s"), 1).otherwise(0)).over(Window.partitionBy("_c"))
    turned = F.when((F.col("place") - system) % 2 == 0, "user").otherwise("assistant")
    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(turned)
    names = rows.select(c.alias("_c"), "conv_id").distinct()
    return met.select("_c", "place", "edit", role.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text")).join(names, "_c").drop("_c").select("conv_id", "place", "edit", "role", "text")


def repair_table(turns: DataFrame) -> DataFrame:
    """``repair`` of the ``damaged`` rows of a table of conversations."""
    return repair(damaged(turns))


def _sql() -> str:
    """The same rows as repair_table(conversations), by a recursive table of the four nodes' (cost, audit, rows)."""
    far = 1_000_000_000

    def edge(v: str, letter: str, cost: str, row: str | None) -> str:
        return f"{{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}', 't': " + (f"list_append({v}.t, {row})" if row else f"{v}.t") + "}"

    def least(options: list[str]) -> str:
        return f"list_min([{', '.join(options)}])"

    def inserted(v: list[str]) -> tuple[str, str]:
        u = least([v[USER], *(edge(v[k], "I", "3", "'user:'") for k in BEFORE[USER])])
        return u, "'assistant:'"

    step = []
    for end in range(4):
        options = [edge(f"x.v{end}", "D", "4", None)]
        for k in BEFORE.get(end, ()):
            from_ = f"x.v{k}"
            options.append(edge(from_, "K", f"(CASE WHEN r.own = {end} AND NOT r.must_go THEN 3 * r.cut ELSE {far} END)", "r.role || ':' || r.text"))
            if end in NAMES:
                options.append(edge(from_, "R", f"(CASE WHEN NOT r.must_go THEN 3 + 3 * r.cut ELSE {far} END)", f"'{NAMES[end]}:' || r.text"))
        step.append(f"{least(options)} AS v{end}")
    u, a = inserted(["p.v0", "p.v1", "p.v2", "p.v3"])
    none = f"{{'c': CAST({far} AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}}"
    return rf"""
WITH RECURSIVE k AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc
), c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations
), f AS (
  SELECT c.*, xor(list_reduce(list_transform(string_split(id, ''), lambda s: CAST(ord(s) AS BIGINT)), lambda h, b: xor(h >> 8, crc[(xor(h, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS fault FROM c, k
), d AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM f, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) WHERE fault <> 0
), m AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d)
), r AS (
  SELECT *, blank OR again AS must_go, CAST(open AND NOT blank AND NOT again AS INTEGER) AS cut, CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 END AS own,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM m
), q AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(cut) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY conv_id
), p AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} AS v0, {none} AS v1, {none} AS v2, {none} AS v3 FROM conversations
  UNION ALL
  SELECT x.conv_id, x.i + 1, {', '.join(step)}
  FROM (SELECT y.conv_id, y.i, y.v0, y.v1, y.v2, {least(["y.v3", edge("y.v2", "I", "3", a)])} AS v3 FROM (SELECT p.conv_id, p.i, p.v0, p.v1, {u} AS v2, p.v3 FROM p) y) x
  JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.i = x.i + 1
), e AS (
  SELECT conv_id, i, v0, {least(["v3", edge("v2", "I", "3", a)])} AS v3 FROM (SELECT p.conv_id, p.i, p.v0, p.v3, {u} AS v2 FROM p)
), z AS (SELECT conv_id, i, {least(["v0", "v3"])} AS v FROM e)
SELECT z.conv_id, CAST(coalesce(q.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(q.blank, 0) AS BIGINT) AS blank, CAST(coalesce(q.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(q.truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(q.illegal, 0) AS BIGINT) AS illegal, CAST(z.v.c AS BIGINT) AS cost, z.v.a AS audit, sha256(array_to_string(z.v.t, chr(10))) AS repaired_sha256
FROM z LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM z.conv_id WHERE z.i = coalesce(q.n, 0)
"""


ORACLE_SQL = _sql()
