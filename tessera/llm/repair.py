"""13. Conversation structure repair: the cheapest edits that give each conversation a legal order of roles.

A conversation's rows by turn are a lattice of nodes (turn index, grammar state); its edges keep, re-role or
delete a row or insert an empty one. Dijkstra's search with the key (cost, audit) runs on the implicit lattice and
stops at the first accepting end node it pops: the least cost and, among the edits of that cost, the audit that is first in ASCII.

No conversation has to fit a task. Equal rows are counted before they are moved; texts stay in one written table, and
only narrow rows are sorted, over range partitions, so that a conversation of any length spreads. It is cut into
blocks of up to 1,024 rows. Each block's exit costs from each entry state are searched apart; a backward pass
over these few numbers gives what every exit still costs; with them the search in each block finds its part of the one
cheapest path. Inserts between two blocks belong to the later one, so no block's audit is a prefix of another's
and ties are decided inside the block. A conversation of one block, as nearly all are, is one search. Only the digest of the
repaired text reads a conversation in one stream, with bounded memory: SHA-256 cannot be split.

Grammar: the initials of the roles are `(s?(ua)+)?`. A role is known by its first letter; an empty one is no legal role.

Defined results: a null role or text is one space, so a null text is blank; a null turn comes first and counts for no
gap; rows of equal turn go by role, then by MD5 of the text; equal rows are rows of their own, the later ones duplicates;
a null conversation id is a conversation; a conversation without rows costs nothing and has an empty audit; ids may be of any
type; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Costs of the edits, and what a truncated row costs unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The grammar's states (nothing yet, after system, user, assistant) and what each role leads to.
NEXT: list[dict[str, int]] = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ACCEPTED = (0.0, math.inf, math.inf, 0.0)
ROLES = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, CUT = 1, 2, 3
_BITS = 10  # rows of a block
_SPACE = " \t\n\x0b\x0c\r"


def _edges(q: int, row: tuple[str, int] | None) -> Iterator[tuple[int, str, int, int]]:
    """(cost, letter, rows consumed, next state) of the edits at a node; after the last row there are only inserts."""
    for role in "ua":
        if role in NEXT[q]:
            yield INSERT, "I", 0, NEXT[q][role]
    if row is None:
        return
    code, fault = row
    yield DELETE, "D", 1, q
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT else 0
    if code in NEXT[q]:
        yield more, "K", 1, NEXT[q][code]
    for role in "ua":
        if role in NEXT[q]:
            yield REROLE + more, "R", 1, NEXT[q][role]


def cheapest(rows: Sequence[tuple[str, int]], start: int = 0, finish: Sequence[float] = ACCEPTED, last: bool = True) -> tuple[float, str, int] | None:
    """(cost, audit, end state) of the cheapest edits of rows (initial, fault); `finish` is what each end state still costs.

    With last=False nothing is inserted after the last row.
    """
    n, done = len(rows), set()
    heap: list[tuple[float, str, int, int]] = [(0, "", 0, start)]
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i > n:
            return cost, audit, q
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n and finish[q] < math.inf:
            heapq.heappush(heap, (cost + finish[q], audit, n + 1, q))
        if i < n or last:
            for more, letter, step, to in _edges(q, rows[i] if i < n else None):
                if (i + step, to) not in done:
                    heapq.heappush(heap, (cost + more, audit + letter, i + step, to))
    return None


def exits(rows: Sequence[tuple[str, int]], start: int) -> list[float]:
    """The least cost from a state before the rows to each state right after the last of them."""
    best = {(0, start): 0.0}
    heap: list[tuple[float, int, int]] = [(0.0, 0, start)]
    out = [math.inf] * len(NEXT)
    while heap:
        cost, i, q = heapq.heappop(heap)
        if cost > best[i, q]:
            continue
        if i == len(rows):
            out[q] = cost
            continue
        for more, _, step, to in _edges(q, rows[i]):
            if cost + more < best.get((i + step, to), math.inf):
                best[i + step, to] = cost + more
                heapq.heappush(heap, (cost + more, i + step, to))
    return out


def edits(rows: Sequence[tuple[str, int]], audit: str, start: int = 0) -> list[tuple[str, str | None, int | None]]:
    """(letter, new role, index of the row) of an audit's edits; the grammar tells the roles of R and I."""
    q, i, out = start, 0, []
    for letter in audit:
        role = rows[i][0] if letter == "K" else None if letter == "D" else next(r for r in "ua" if r in NEXT[q])
        out.append((letter, ROLES[role] if letter in "RI" else None, None if letter == "I" else i))
        q = NEXT[q][role] if role else q
        i += letter != "I"
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by a checksum of conversation and turn, to be repaired."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _key(conv: str) -> Column:
    """A conversation's id as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


class Repair:
    """The repair of a table of conversation rows: `report` a row a conversation, `rows` the repaired rows in order."""

    def __init__(self, rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        given = rows.select(_key(conv).alias("key"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
        counted = given.groupBy("key", "turn", "role", "text").agg(F.count("*").alias("n"))
        end = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
        flags = F.when(end == "", BLANK).when(~end.isin(".", "!", "?"), CUT).otherwise(0)
        self.cells = written(counted.withColumns({"id": F.monotonically_increasing_id(), "h": F.md5("text"), "flag": flags}), "repair-cells")
        self.blocks = written(self._blocks(), "repair-blocks")
        self.summaries = written(self._summaries(), "repair-summaries")
        self.solved = written(self._solved(), "repair-solved")

    def _blocks(self) -> DataFrame:
        """(key, block, items): the rows in order, cut at every 1,024th place of their partition."""
        cells = self.cells.select("key", "turn", "role", "h", "id", "n", "flag")
        first = cells.groupBy("key", "role", "h").agg(F.count("*").alias("cells"), F.min(F.struct("turn")).alias("first")).where("cells > 1").drop("cells")
        seen = cells.join(first, ["key", "role", "h"], "left").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, 16))))
        copies = F.sequence(F.shiftleft("run", 16) + 1, F.least(F.col("n"), F.shiftleft(F.col("run") + 1, 16)))
        seen = seen.withColumn("copy", F.explode(copies))
        again = (F.col("copy") > 1) | F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))
        fault = F.when(F.col("flag") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("flag"))
        order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h"), F.col("copy")]
        placed = seen.select("key", "turn", "role", "h", "copy", "id", fault.alias("fault")).repartitionByRange(*order).sortWithinPartitions(*order)
        # places are stored before they are used: another run of the sort could cut its partitions elsewhere
        placed = written(placed.select("key", "turn", F.left("role", F.lit(1)).alias("code"), "fault", "id", F.monotonically_increasing_id().alias("pos")), "repair-places")
        return placed.groupBy("key", F.shiftright("pos", _BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "code", "fault", "id"))).alias("items"))

    def _summaries(self) -> DataFrame:
        """What a block adds to its conversation, and its exit costs from each entry state."""
        schema = "key string, block long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, costs array<double>"
        arrow = _arrow(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for key, block, items in zip(*(c.to_pylist() for c in batch.columns)):
                    codes, faults = [x["code"] for x in items], [x["fault"] for x in items]
                    turns = {x["turn"] for x in items} - {None}
                    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
                    rows = list(zip(codes, faults))
                    costs = [c for q in range(len(NEXT)) for c in exits(rows, q)]
                    out.append((key, block, len(items), *(faults.count(f) for f in (BLANK, DUPLICATE, CUT)), illegal, codes[0], codes[-1], min(turns, default=None), max(turns, default=None), len(turns), costs))
                yield _batch(out, arrow)

        return self.blocks.mapInArrow(run, schema)

    def _runs(self) -> DataFrame:
        """A conversation's numbers from its blocks', and the searches still to do: one, or one an entry state of later blocks."""
        item = F.struct("block", *(c for c in self.summaries.columns if c not in ("key", "block")))
        gathered = self.summaries.groupBy("key").agg(F.array_sort(F.collect_list(item)).alias("blocks"))  # a row each 1,024 rows
        schema = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, runs array<struct<block:bigint,start:int,finish:array<double>,last:boolean>>"
        arrow = _arrow(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _batch([_whole(key, blocks) for key, blocks in zip(*(c.to_pylist() for c in batch.columns))], arrow)

        return gathered.mapInArrow(run, schema)

    def _solved(self) -> DataFrame:
        """(key, block, start, exit, audit, edits) of every search."""
        self.numbers = written(self._runs(), "repair-numbers")
        todo = self.numbers.select("key", F.inline("runs"))
        schema = "key string, block long, start int, exit int, audit string, edits array<struct<edit:string,role:string,id:bigint>>"
        arrow = _arrow(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for key, block, start, finish, last, items in zip(*(c.to_pylist() for c in batch.columns)):
                    rows = [(x["code"], x["fault"]) for x in items]
                    _, audit, end = cheapest(rows, start, finish, last)
                    made = [{"edit": e, "role": r, "id": None if i is None else items[i]["id"]} for e, r, i in edits(rows, audit, start)]
                    out.append((key, block, start, end, audit, made))
                yield _batch(out, arrow)

        return todo.join(self.blocks, ["key", "block"]).select("key", "block", "start", "finish", "last", "items").mapInArrow(run, schema)

    def _path(self) -> DataFrame:
        """Of the searches, those that follow each other: (key, block, start)."""
        step = F.struct("block", "start", "exit")
        steps = self.solved.groupBy("key").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # up to four a block
        schema = "key string, path array<struct<block:bigint,start:int>>"
        arrow = _arrow(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for key, found in zip(*(c.to_pylist() for c in batch.columns)):
                    state, path = 0, []
                    ends = {(x["block"], x["start"]): x["exit"] for x in found}
                    for block in sorted({x["block"] for x in found}):
                        path.append({"block": block, "start": state})
                        state = ends[block, state]
                    out.append((key, path))
                yield _batch(out, arrow)

        return steps.mapInArrow(run, schema).select("key", F.inline("path"))

    def chosen(self) -> DataFrame:
        return self.solved.join(self._path(), ["key", "block", "start"])

    def rows(self) -> DataFrame:
        """The repaired rows (key, block, place, edit, role, text); inserted ones have an empty text."""
        made = self.chosen().select("key", "block", F.posexplode("edits").alias("place", "e")).where("e.edit <> 'D'")
        made = made.select("key", "block", "place", "e.edit", F.col("e.role").alias("new"), "e.id")
        texts = self.cells.select("id", "role", "text")  # a kept row is the first of its cell, so no id repeats
        out = made.where("id IS NOT NULL").join(texts, "id").select("key", "block", "place", "edit", F.coalesce("new", "role").alias("role"), "text")
        return out.unionByName(made.where("id IS NULL").select("key", "block", "place", "edit", F.col("new").alias("role"), F.lit("").alias("text")))

    def digests(self) -> DataFrame:
        """(key, repaired_sha256), read as a stream of sorted rows."""
        schema = "key string, repaired_sha256 string"
        arrow = _arrow(schema)
        ordered = self.rows().repartition("key").sortWithinPartitions("key", "block", "place").select("key", "role", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, digest = None, None
            for batch in batches:
                out = []
                for k, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if digest is None or k != key:
                        if digest is not None:
                            out.append((key, digest.hexdigest()))
                        key, digest = k, hashlib.sha256()
                    else:
                        digest.update(b"\n")
                    digest.update(f"{role}:{text}".encode())
                yield _batch(out, arrow)
            if digest is not None:
                yield _batch([(key, digest.hexdigest())], arrow)

        return ordered.mapInArrow(run, schema)

    def report(self) -> DataFrame:
        """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation with rows."""
        audits = self.chosen().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "audit"))).alias("parts"))
        audits = audits.select("key", F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"))
        out = self.numbers.drop("runs").join(audits, "key", "left").join(self.digests(), "key", "left")
        return out.withColumns({"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))})


def _whole(key: str, blocks: list[dict]) -> tuple:
    """The numbers of a conversation from those of its blocks in order, and its searches."""
    gaps_low = min((b["low"] for b in blocks if b["low"] is not None), default=None)
    gaps_high = max((b["high"] for b in blocks if b["high"] is not None), default=None)
    turns = illegal = 0
    before = None
    for b in blocks:
        turns += b["turns"]
        if before is not None:
            illegal += before["last"] + b["first"] not in ("su", "ua", "au")
            turns -= b["low"] is not None and before["high"] == b["low"]  # a turn on both sides of the cut
        illegal += b["illegal"]
        before = b
    gaps = 0 if gaps_low is None else gaps_high - gaps_low + 1 - turns
    n = len(NEXT)
    togo = [0.0, 2.0 * INSERT, 1.0 * INSERT, 0.0]  # inserts after the last row
    runs = []
    for k in range(len(blocks) - 1, -1, -1):
        last, costs = k == len(blocks) - 1, blocks[k]["costs"]
        finish = list(ACCEPTED) if last else togo
        togo = [min(costs[q * n + r] + togo[r] for r in range(n)) for q in range(n)]
        runs += [{"block": blocks[k]["block"], "start": q, "finish": finish, "last": last} for q in ((0,) if k == 0 else range(n)) if togo[q] < math.inf]
    return key, gaps, *(sum(b[c] for b in blocks) for c in ("blank", "duplicate", "truncated")), illegal, int(togo[0]), runs


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)


def repair(rows: DataFrame, conversations: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """A report for each id of `conversations` on the repair of `rows`; conversations without rows have zeros."""
    ids = conversations.select(F.col(conv).alias("conv_id"), _key(conv).alias("key")).dropDuplicates(["key"])
    out = ids.join(Repair(rows, conv=conv).report(), "key", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    texts = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}
    return out.withColumns(zero | texts).select("conv_id", *zero, *texts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(conversations), conversations)


def _sql_add(label: str, cost: int, letter: str, piece: str = "''") -> str:
    return f"{{'c': {label}.c + {cost}, 'a': {label}.a || '{letter}', 't': {label}.t || {piece}}}"


def _sql_least(*labels: str) -> str:
    return f"list_min([{', '.join(labels)}])"


def _sql() -> str:
    """The same by dynamic programming: the least label (cost, audit, text) of each state after each row, with inserts closed before the next."""
    far = "{'c': 1000000000, 'a': '', 't': ''}"
    kept, user, assistant = "chr(10) || r.role || ':' || r.text", "chr(10) || 'user:' || r.text", "chr(10) || 'assistant:' || r.text"
    before_u = _sql_least("d.q0", "d.qs", "d.qa")
    allowed = lambda test, label: f"CASE WHEN r.fault NOT IN (1, 2) AND {test} THEN {label} ELSE {far} END"
    more = "(CASE WHEN r.fault = 3 THEN 3 ELSE 0 END)"
    closed_u = _sql_least("qu", *(_sql_add(q, INSERT, "I", "chr(10) || 'user:'") for q in ("q0", "qs", "qa")))
    closed_a = lambda u: _sql_least("qa", _sql_add(u, INSERT, "I", "chr(10) || 'assistant:'"))
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda h, b: list_reduce(range(8), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)), xor(h, b)), 4294967295), 4294967295) % 20 AS kind FROM conversations),
w AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail, left(role, 1) AS code FROM w),
r AS (SELECT *, CASE WHEN tail = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  CASE WHEN i > 1 AND lag(code) OVER (PARTITION BY conv_id ORDER BY i) || code NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS bad FROM n),
e AS (SELECT conv_id, i, q0, qs, u AS qu, {closed_a('u')} AS qa FROM (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 't': ''}} AS q0, {far} AS qs, {far} AS qa, {{'c': 3, 'a': 'I', 't': chr(10) || 'user:'}} AS u FROM (SELECT DISTINCT conv_id FROM r))
UNION ALL
SELECT conv_id, i, q0, qs, u AS qu, {closed_a('u')} AS qa FROM (SELECT *, {closed_u} AS u FROM (
  SELECT r.conv_id, r.i, {_sql_add('d.q0', DELETE, 'D')} AS q0, {_sql_least(_sql_add('d.qs', DELETE, 'D'), allowed("r.code = 's'", f"{{'c': d.q0.c + {more}, 'a': d.q0.a || 'K', 't': d.q0.t || {kept}}}"))} AS qs,
  {_sql_least(_sql_add('d.qu', DELETE, 'D'), allowed("r.code = 'u'", f"{{'c': {before_u}.c + {more}, 'a': {before_u}.a || 'K', 't': {before_u}.t || {kept}}}"), allowed("true", f"{{'c': {before_u}.c + 3 + {more}, 'a': {before_u}.a || 'R', 't': {before_u}.t || {user}}}"))} AS qu,
  {_sql_least(_sql_add('d.qa', DELETE, 'D'), allowed("r.code = 'a'", f"{{'c': d.qu.c + {more}, 'a': d.qu.a || 'K', 't': d.qu.t || {kept}}}"), allowed("true", f"{{'c': d.qu.c + 3 + {more}, 'a': d.qu.a || 'R', 't': d.qu.t || {assistant}}}"))} AS qa
  FROM e AS d JOIN r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1))),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, CAST(sum(bad) AS BIGINT) AS illegal, max(i) AS n FROM r GROUP BY conv_id),
f AS (SELECT s.*, {_sql_least('e.q0', 'e.qa')} AS best FROM s JOIN e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.i = s.n)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL = _sql()
