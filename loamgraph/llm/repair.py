"""Conversation structure repair: A* on the lattice of rows and phases, keyed by (cost + heuristic, audit).

A repaired conversation's role initials are nothing, or an optional s and then
ua once or more. Edits are Keep, Rerole, Delete and Insert. A state is (rows
consumed, phase), the phase being the last initial written. The heuristic is a
suffix sum over the rows that are left: 2 for a blank or duplicate row, whose
deletion is required, and 2 for a truncated one, which costs 2 if deleted and 5
at least if not. Each edit costs at least what it takes off the sum, so the
heuristic is consistent, and as letters are compared after the sum, the first
time a state leaves the queue it does so with its least cost and, among equal
costs, the ASCII-least audit: two audits of one cost that reach the same state
are never prefixes of each other, so what is appended doesn't change their
order.

Texts never meet in one place. A conversation's rows come to one task sorted,
first as codes of a few bytes, from which the edits are found, then with
their texts, which are hashed one after the other.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import release

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Faults of a row.
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: Phases: nothing yet, after s, after u, after a. The initial that each phase takes next besides s at the start.
START, SYSTEM, USER, ASSISTANT = range(4)
WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
REACHED = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}
#: Audits of conversations of more rows are kept as chains of blocks of CHAIN letters.
PLAIN, CHAIN = 1024, 128


class Trail:
    """An audit as a chain of blocks, so that a letter more costs a block's length at most, not the audit's.

    Blocks before the last one are interned by content, so equal audits share
    them and a comparison skips to the first block that differs.
    """

    __slots__ = ("depth", "head", "jump", "last")

    def __init__(self, head: Trail | None = None, last: str = ""):
        self.head, self.last = head, last
        self.depth = 0 if head is None else head.depth + 1
        # jump pointers: an ancestor at a depth that depends on the own depth only
        if head is None or head.jump is None:
            self.jump = head
        else:
            up = head.jump
            self.jump = up.jump if up.jump is not None and head.depth - up.depth == up.depth - up.jump.depth else head

    def plus(self, letter: str, known: dict) -> Trail:
        if len(self.last) < CHAIN:
            out = Trail.__new__(Trail)
            out.head, out.last, out.depth, out.jump = self.head, self.last + letter, self.depth, self.jump
            return out
        full = known.setdefault((id(self.head), self.last), self)  # one object for equal audits of whole blocks
        return Trail(full, letter)

    def up(self, depth: int) -> Trail:
        at = self
        while at.depth > depth:
            at = at.jump if at.jump is not None and at.jump.depth >= depth else at.head
        return at

    def __lt__(self, other: Trail) -> bool:
        a, b = self, other
        if a.head is b.head:
            return a.last < b.last
        if a.depth > b.depth:
            a = a.up(b.depth)
        elif b.depth > a.depth:
            b = b.up(a.depth)
        if a.head is b.head:
            if a.last != b.last:
                return a.last < b.last
            return self.depth < other.depth
        while a.head is not b.head:  # both at one depth: to the first blocks that differ
            if a.jump is not b.jump and a.jump is not None and b.jump is not None and a.jump.depth == b.jump.depth:
                a, b = a.jump, b.jump
            else:
                a, b = a.head, b.head
        return a.last < b.last

    def __str__(self) -> str:
        out, at = [], self
        while at is not None:
            out.append(at.last)
            at = at.head
        return "".join(reversed(out))


def cheapest(initials: str, faults: bytes, chained: bool | None = None) -> tuple[int, str]:
    """(cost, audit): the cheapest edits of rows with these role initials and faults, ties to the ASCII-least audit.

    An initial other than s, u and a can't be kept. Up to PLAIN rows an audit
    is a string, beyond that, or where `chained` says so, a Trail; the search
    holds some hundreds of bytes a row.
    """
    n = len(initials)
    left = [0] * (n + 1)  # mandatory deletions and unavoidable charges of truncation from each row on
    for i in range(n - 1, -1, -1):
        left[i] = left[i + 1] + (DELETE if faults[i] in (BLANK, DUPLICATE) else min(DELETE, TRUNCATED) if faults[i] == CUT else 0)
    known: dict = {}
    if n > PLAIN if chained is None else chained:
        start, longer = Trail(), lambda audit, letter: audit.plus(letter, known)
    else:
        start, longer = "", str.__add__
    queue = [(left[0], start, 0, START)]
    done: set[int] = set()
    while queue:
        f, audit, i, phase = heapq.heappop(queue)
        if i * 4 + phase in done:
            continue
        done.add(i * 4 + phase)
        cost = f - left[i]
        if i == n and phase in (START, ASSISTANT):
            return cost, str(audit)
        want = WANTED[phase]
        steps = [("I", INSERT, i, REACHED[want])]
        if i < n:
            steps.append(("D", DELETE, i + 1, phase))
            if faults[i] in (SOUND, CUT):
                charge, have = TRUNCATED if faults[i] == CUT else 0, initials[i]
                if have == want or (have == "s" and phase == START):
                    steps.append(("K", KEEP + charge, i + 1, REACHED[have]))
                steps.append(("R", REROLE + charge, i + 1, REACHED[want]))
        for letter, price, to, then in steps:
            if to * 4 + then not in done:
                heapq.heappush(queue, (cost + price + left[to], longer(audit, letter), to, then))
    raise AssertionError("every conversation can be emptied")


class _Conversation:
    """What is known of a conversation while its rows pass by: codes first, then texts."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.initials: list[str] = []
        self.faults = bytearray()
        self.illegal = self.turns = 0
        self.least = self.most = None
        self.at, self.audit, self.phase, self.hash, self.empty = 0, None, START, hashlib.sha256(), True

    def code(self, turn, initial: str, fault: int, n: int, first: bool) -> None:
        """n equal rows of one turn; the first of them isn't a duplicate if `first` says so."""
        for _ in range(n):
            if self.initials and self.initials[-1] + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.initials.append(initial)
            self.faults.append(BLANK if fault == BLANK else fault if first else DUPLICATE)
            first = False
        if turn is not None and n:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn

    def solve(self) -> None:
        # an initial may have no character or several under some encodings; anything but one of the three is the same here
        self.cost, self.audit = cheapest("".join(c if c in ("s", "u", "a") else "?" for c in self.initials), bytes(self.faults))

    def _write(self, role: str, text: str) -> None:
        self.hash.update((("" if self.empty else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.empty = False

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            c = WANTED[self.phase]
            self._write(ROLES[c], "")
            self.phase, self.at = REACHED[c], self.at + 1

    def text(self, role: str, text: str, n: int) -> None:
        """n equal rows in turn, under the edits found."""
        if self.audit is None:
            self.solve()
        for _ in range(n):
            self._inserts()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit == "D":
                continue
            c = role[0] if edit == "K" else WANTED[self.phase]
            self._write(role if edit == "K" else ROLES[c], text)
            self.phase = REACHED[c]

    def row(self) -> tuple:
        if self.audit is None:
            self.solve()
        self._inserts()
        count = self.faults.count
        gaps = self.most - self.least + 1 - self.turns if self.most is not None else 0
        return self.conv_id, gaps, count(BLANK), count(DUPLICATE), count(CUT), self.illegal, self.cost, self.audit, self.hash.hexdigest()


def fault_of(text: Column) -> Column:
    """BLANK, CUT or SOUND by a text alone."""
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost long, audit, repaired_sha256 string: one row per conversation.

    rows: conv_id, turn, role, text and copies, how often the row stands (0:
    only its conv_id is known). Rows are taken by turn, nulls first, ties by role
    and the digest of the text; copies are adjacent. A null role or
    text is one space, the rows of a null conv_id are one conversation, an empty
    table gives no row. Other columns are ignored, whatever they are called. A
    role that doesn't begin with s, u or a can't be kept.

    Equal rows of a turn are counted first; whether a row's role and text stood
    in an earlier turn is an aggregate over (conversation, role, digest of the
    text), so that neither a hot text nor a hot conversation meets in a task
    before the edits are found; those need a few bytes a row.
    """
    key = "conv_id"
    plain = rows.select(key, "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies").cast("long").alias("n"))
    none = plain.filter("n = 0").select(key, F.lit(None).cast(plain.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "n")
    counted = materialise(plain.filter("n > 0").unionByName(none).groupBy(key, "turn", "role", "text").agg(F.sum("n").alias("n")), "repair")
    some = counted.filter("n > 0")
    # the first turn of each role and text; grouped by another form of the digest, so that adaptive execution can split the join's hot keys
    digest = F.sha2(F.col("text").cast("binary"), 256)
    turn_key = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = some.groupBy(key, "role", F.reverse(digest).alias("d")).agg(F.min(turn_key).alias("first"))
    first = first.select(F.col(key).alias("c"), F.col("role").alias("r"), F.reverse("d").alias("d"), "first")
    codes = some.select(key, "turn", "role", digest.alias("digest"), fault_of(F.col("text")).alias("fault"), "n")
    codes = codes.join(first, F.col(key).eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    codes = codes.select(key, F.lit(0).alias("part"), "turn", "role", F.lit(None).cast("string").alias("text"), "digest", "fault", "n", (F.col("first") == turn_key).alias("fresh"))
    texts = counted.select(key, F.lit(1).alias("part"), "turn", "role", "text", digest.alias("digest"), F.lit(0).alias("fault"), "n", F.lit(False).alias("fresh"))
    kind = rows.schema[key].dataType.simpleString()
    # ties of a turn go by role and digest in both parts, which must be in the same order
    dealt = codes.unionByName(texts).repartition(key).sortWithinPartitions(F.col(key).isNotNull(), key, "part", F.col("turn").isNotNull(), "turn", "role", "digest")
    schema = f"{key} {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    names = [part.split()[0] for part in schema.split(", ")]
    columns = [key, "part", "turn", "role", "text", "fault", "n", "fresh"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def flush():
            ready = pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=arrow)
            out.clear()
            return ready

        for batch in batches:
            for k, part, turn, role, text, fault, n, fresh in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
                if now is None or (k != now.conv_id if k is not None and now.conv_id is not None else k is not now.conv_id):
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(k)
                if part == 0:
                    now.code(turn, role[:1], fault, n, fresh)
                elif n:
                    now.text(role, text, n)
                if len(out) >= 1000:
                    yield flush()
        if now is not None:
            out.append(now.row())
        if out:
            yield flush()
        release()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return dealt.select(*columns).mapInArrow(run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of conv_id:turn modulo 20: rows with their number of copies (0 for a dropped one); nulls are one space."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = turns.select("conv_id", "turn", "role", "text", kind.alias("kind"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def edits_of(audit: str, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The repaired rows (role, text) that an audit makes of `rows`; for looking at single conversations."""

    def step(state, letter):
        out, left, phase = state
        if letter == "I":
            c = WANTED[phase]
            return [*out, (ROLES[c], "")], left, REACHED[c]
        (role, text), *left = left
        if letter == "D":
            return out, left, phase
        c = role[0] if letter == "K" else WANTED[phase]
        return [*out, (role if letter == "K" else ROLES[c], text)], left, REACHED[c]

    return reduce(step, audit, ([], rows, START))[0]


def op12_repair_conversations(spark, sf_dir: str) -> DataFrame:
    """Damage and repair of all conversations."""
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


#: The same by dynamic programming, a row of all conversations at a time: the best (cost, audit) of each phase.
OP12_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), coded AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))) % 20 AS k FROM keyed
), rows AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM rows
), f AS (
  SELECT *, role[1] AS c, CASE WHEN last = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), moves(phase, mid, ins, price, put) AS (VALUES
  (0, 0, '', 0, []::VARCHAR[]), (0, 2, 'I', 5, ['user:']), (0, 3, 'II', 10, ['user:', 'assistant:']), (1, 1, '', 0, []), (1, 2, 'I', 5, ['user:']), (1, 3, 'II', 10, ['user:', 'assistant:']),
  (2, 2, '', 0, []), (2, 3, 'I', 5, ['assistant:']), (3, 3, '', 0, []), (3, 2, 'I', 5, ['user:'])
), s AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS phase, 0 AS cost, '' AS audit, []::VARCHAR[] AS rep FROM conversations
  UNION ALL
  SELECT conv_id, i, phase, cost, audit, rep FROM (
    SELECT s.conv_id, f.i, CASE e.letter WHEN 'D' THEN m.mid WHEN 'K' THEN CASE f.c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE m.mid WHEN 2 THEN 3 ELSE 2 END END AS phase,
      s.cost + m.price + CASE e.letter WHEN 'D' THEN 2 ELSE CASE f.fault WHEN 3 THEN 5 ELSE 0 END + CASE e.letter WHEN 'R' THEN 1 ELSE 0 END END AS cost, s.audit || m.ins || e.letter AS audit,
      list_concat(list_concat(s.rep, m.put), CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE m.mid WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text] END) AS rep
    FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1 JOIN moves m ON m.phase = s.phase CROSS JOIN (VALUES ('D'), ('K'), ('R')) AS e(letter)
    WHERE e.letter = 'D' OR (f.fault IN (0, 3) AND (e.letter = 'R' OR f.c = CASE m.mid WHEN 2 THEN 'a' ELSE 'u' END OR (f.c = 's' AND m.mid = 0)))
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, phase ORDER BY cost, audit) = 1
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
), best AS (
  SELECT s.conv_id, s.cost + m.price AS cost, s.audit || m.ins AS audit, array_to_string(list_concat(s.rep, m.put), chr(10)) AS text
  FROM s LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM s.conv_id JOIN moves m ON m.phase = s.phase WHERE s.i = coalesce(n.n, 0) AND m.mid IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + m.price, s.audit || m.ins) = 1
)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost::BIGINT AS cost, audit, sha256(text) AS repaired_sha256
FROM best b LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM b.conv_id
"""
