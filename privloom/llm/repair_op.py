"""Conversation structure repair by Knuth's lightest derivations.

A conversation's repair is a derivation over items ``(i, state)``: the first i rows are done and the output so far is in a
state of the pattern ``(s?(ua)+)?``. Edits are rules: an item and a row's edit give the next item, an item and an insertion
give an item of the same i. A derivation weighs (cost, audit), added up and written one behind the other; both parts only
grow and keep the order of what they extend (audits of one item and equal cost differ before either ends, as they have done
the same rows with as many insertions). So Knuth's agenda pops items in order of weight, each once and for good,
until the goal is popped.

Conversations of any length are split: rows are sorted over all partitions, runs of ``CHUNK`` rows are repaired for each
state that they may begin in, and a second agenda joins the chunks' derivations, each an axiom of its own, to the
conversation's. What then still passes in one place is what the result holds anyway, a letter a row; texts stream.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from privloom.llm.common import durable, slices, table

#: Rows that are repaired together, and bytes of their texts unless one row has more.
CHUNK, CHUNK_BYTES = 512, 8_000_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the output: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row of an initial leads from a state.
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ENDS = (START, ASSISTANT)
NEW_ROLES = (("u", "user"), ("a", "assistant"))
GOOD_PAIRS = ("su", "ua", "au")
BLANK, DUPLICATE, CUT, FINE = "bdtf"
Weight = tuple[int, str]


def next_states(state: int, initial: str, fault: str, copies: int) -> Iterable[tuple[int, int, str]]:
    """(state, cost, audit) after each edit of a row; of its ``copies`` all but the first are duplicates, which are always deleted."""
    rest = DELETE * (copies - 1), "D" * (copies - 1)
    yield state, DELETE + rest[0], "D" + rest[1]
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED * (fault == CUT) + rest[0]
    if (state, initial) in STEP:
        yield STEP[state, initial], KEEP + more, "K" + rest[1]
    for to, _ in NEW_ROLES:
        if (state, to) in STEP:
            yield STEP[state, to], REROLE + more, "R" + rest[1]


def lightest(rows: list[tuple[str, str, int]], start: int, goals: Iterable[int] | None = ENDS) -> dict[int, Weight]:
    """The weights of the lightest repairs of ``rows`` (initial, fault, copies) from ``start``: of the first goal that the agenda pops, or of all
    states at the end where ``goals`` is None."""
    done: set[tuple[int, int]] = set()
    found: dict[int, Weight] = {}
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and (goals is None or state in goals):
            found[state] = cost, audit
            if goals is not None or len(found) == 4:
                break
        ahead = [(i + 1, *x) for x in next_states(state, *rows[i])] if i < len(rows) else []
        ahead += [(i, STEP[state, to], INSERT, "I") for to, _ in NEW_ROLES if (state, to) in STEP]
        for j, to, more, letters in ahead:
            if (j, to) not in done:
                heapq.heappush(agenda, (cost + more, audit + letters, j, to))
    return found


def join_chunks(chunks: list[dict[tuple[int, int], Weight]]) -> tuple[int, list[tuple[int, int]]]:
    """Cost of the lightest repair over chunks, each the weights of its derivations by (first state, last state), and the states that it takes."""
    done: set[tuple[int, int]] = set()
    agenda: list[tuple[int, str, int, int, tuple]] = [(0, "", 0, START, ())]
    while True:
        cost, audit, i, state, path = heapq.heappop(agenda)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(chunks) and state in ENDS:
            states = []
            while path:
                path, step = path
                states.append(step)
            return cost, states[::-1]
        if i < len(chunks):
            for (before, after), (more, letters) in chunks[i].items():
                if before == state and (i + 1, after) not in done:
                    heapq.heappush(agenda, (cost + more, audit + letters, i + 1, after, (path, (before, after))))


class Repaired:
    """The hash of repaired rows, fed one after the other."""

    def __init__(self) -> None:
        self.hash, self.state, self.first = hashlib.sha256(), START, True

    def put(self, initial: str, line: str) -> None:
        self.state = STEP[self.state, initial]
        self.hash.update((line if self.first else "\n" + line).encode())
        self.first = False

    def insert(self) -> None:
        self.put(*next((to, f"{role}:") for to, role in NEW_ROLES if (self.state, to) in STEP))

    def row(self, letter: str, role: str, text: str) -> None:
        if letter == "K":
            self.put(role[:1], f"{role}:{text}")
        elif letter == "R":
            self.put(*next((to, f"{new}:{text}") for to, new in NEW_ROLES if (self.state, to) in STEP))

    def rows(self, letters: Iterator[str], role: str, text: str, copies: int) -> None:
        """Takes from ``letters`` what belongs to a row and its copies, with the insertions before it."""
        while (letter := next(letters)) == "I":
            self.insert()
        self.row(letter, role, text)
        for _ in range(copies - 1):
            while next(letters) == "I":
                self.insert()

    def end(self, letters: Iterator[str]) -> str:
        for _ in letters:
            self.insert()
        return self.hash.hexdigest()


def _spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault): the rows after damage, equal ones together, each with its first fault. A row of ``copies`` 0 stays
    for its conv_id."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _spaced(F.col("role")).alias("role"), _spaced(F.col("text")).alias("text"))
    key = F.concat(_spaced(F.col("conv_id")), F.lit(":"), _spaced(F.col("turn")))
    rows = rows.withColumn("hit", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).alias("copies"))
    rows = durable(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("int").alias("copies")), "damaged")
    # texts that a conversation has at several turns, with the first: few, so the texts themselves are not shuffled for it
    rows = rows.withColumn("digest", F.sha2("text", 256))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    often = rows.filter("copies > 0").groupBy(F.col("conv_id").alias("of_conv"), F.col("role").alias("of_role"), F.col("digest").alias("of_text"))
    often = durable(often.agg(F.min(turn).alias("first"), F.max(turn).alias("last")).filter("first <> last").select("of_conv", "of_role", "of_text", F.col("first.turn").alias("first"), F.lit(True).alias("often")), "often")
    rows = rows.join(often, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_text")), "left")
    fault = F.when(~F.rlike(F.col("text"), F.lit(r"[^\x20\x09-\x0D]")), BLANK).when(F.col("often").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first")), DUPLICATE)
    fault = fault.when(~F.rlike(F.col("text"), F.lit(r"[.!?][\x20\x09-\x0D]*\z")), CUT).otherwise(FINE)
    return rows.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


_FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


class Tally:
    """Counts over rows in order of turn; tallies of neighbouring runs add up."""

    def __init__(self) -> None:
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, other: Tally) -> Tally:
        if other.rows:
            if self.rows:
                self.illegal += self.last + other.first not in GOOD_PAIRS
            self.first = other.first if self.first is None else self.first
            self.last = other.last
            if other.turns:
                self.turns += other.turns - (self.turns > 0 and self.high == other.low)
                self.low, self.high = other.low if self.low is None else self.low, other.high
        for name in ("rows", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        return self

    def row(self, turn: int | None, role: str, fault: str, copies: int) -> None:
        one = Tally()
        one.rows, one.first, one.last = copies, role[:1], role[:1]
        one.blank = copies if fault == BLANK else 0
        one.duplicate = 0 if fault == BLANK else copies if fault == DUPLICATE else copies - 1
        one.truncated = int(fault == CUT)
        one.illegal = (copies - 1) * (role[:1] * 2 not in GOOD_PAIRS)
        if turn is not None:
            one.turns, one.low, one.high = 1, turn, turn
        self.add(one)

    @property
    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0

    def figures(self) -> tuple[int, ...]:
        return self.gaps, self.blank, self.duplicate, self.truncated, self.illegal


_CHUNK = f"conv_id long, part int, seq int, whole boolean, {_FIGURES}, tally array<long>, ends array<string>, steps array<string>, costs array<long>"


def _packed(t: Tally) -> tuple[list[int | None], list[str | None]]:
    return [t.rows, t.blank, t.duplicate, t.truncated, t.illegal, t.turns, t.low, t.high], [t.first, t.last]


def _unpacked(numbers: list[int | None], ends: list[str | None]) -> Tally:
    t = Tally()
    t.rows, t.blank, t.duplicate, t.truncated, t.illegal, t.turns, t.low, t.high = numbers
    t.first, t.last = ends
    return t


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to chunks. A conversation that is one chunk inside a partition is repaired whole; one that is longer or touches a partition's
    end, where the next partition may go on with it, gives its chunks' derivations from each state."""
    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    key, seq, rows, size, begins = None, 0, [], 0, True

    def close(ends: bool) -> None:
        """Of the rows at hand; ``ends``: their conversation ends here for sure."""
        nonlocal seq, rows, size
        tally, codes = Tally(), []
        for turn, role, text, copies, fault in rows:
            tally.row(turn, role, fault, copies)
            codes.append((role[:1], fault, copies))
        if ends and seq == 0 and not begins:
            ((cost, audit),) = lightest(codes, START).values()
            repaired, letters = Repaired(), iter(audit)
            for _, role, text, copies, _ in rows:
                repaired.rows(letters, role, text, copies)
            out.append((key, part, seq, True, *tally.figures(), cost, audit, repaired.end(letters), None, None, None, None))
        else:
            steps = {(a, b): w for a in range(4) for b, w in lightest(codes, a, None).items()}
            numbers, marks = _packed(tally)
            out.append((key, part, seq, False, *[None] * 8, numbers, marks, [f"{a}{b}{audit}" for (a, b), (_, audit) in steps.items()], [cost for cost, _ in steps.values()]))
        seq, rows, size = seq + 1, [], 0

    def flush() -> pa.RecordBatch:
        nonlocal out
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=[c.split()[0] for c in _CHUNK.split(", ")])
        out = []
        return made

    for batch in slices(batches, 3):
        for conv, turn, role, text, copies, fault in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if rows or seq:
                if conv != key:
                    if rows:
                        close(True)
                    begins, seq = False, 0
                elif len(rows) == CHUNK or size > CHUNK_BYTES:
                    close(False)
            key = conv
            rows.append((turn, role, text, copies, fault))
            size += len(text)
            if len(out) >= 256:
                yield flush()
    if rows:
        close(False)
    if out:
        yield flush()


_LONG, _TEXT = pa.int64(), pa.string()
_TYPES = [_LONG, pa.int32(), pa.int32(), pa.bool_(), *[_LONG] * 6, _TEXT, _TEXT, pa.list_(_LONG), pa.list_(_TEXT), pa.list_(_TEXT), pa.list_(_LONG)]


def _together(chunks: pa.Table) -> pa.Table:
    """The chunks of one conversation to its audit and figures, all but the hash."""
    chunks = chunks.sort_by([("part", "ascending"), ("seq", "ascending")]).to_pylist()
    tally, weights = Tally(), []
    for c in chunks:
        tally.add(_unpacked(c["tally"], c["ends"]))
        weights.append({(int(s[0]), int(s[1])): (cost, s[2:]) for s, cost in zip(c["steps"], c["costs"], strict=True)})
    cost, states = join_chunks(weights)
    audit = "".join(w[s][1] for w, s in zip(weights, states, strict=True))
    values = (chunks[0]["conv_id"], *tally.figures(), cost, audit)
    return pa.table([pa.array([v], t) for v, t in zip(values, [_LONG] * 7 + [_TEXT], strict=True)], names=["conv_id", *_RESULT[:-1]])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, its audit first, to (conv_id, repaired_sha256); a row at a time."""
    out, repaired, letters, key = [], None, iter(""), None
    for batch in slices(batches, 3):
        for conv, audit, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if audit is not None:
                if repaired:
                    out.append((key, repaired.end(letters)))
                key, repaired, letters = conv, Repaired(), iter(audit)
            else:
                repaired.rows(letters, role, text, copies)
    if repaired:
        out.append((key, repaired.end(letters)))
    yield pa.record_batch([pa.array([x[0] for x in out], _LONG), pa.array([x[1] for x in out], _TEXT)], names=["conv_id", "repaired_sha256"])


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conv_id of ``conversations`` (conv_id, turn, role,
    text) after the damage of ``damaged``.

    A null role or text is one space; rows without conv_id are one conversation; rows without a turn come first; rows of one turn go by role and
    text. Equal rows are one row and its duplicates. Texts and conversations may be of any length; an empty table gives an empty one. Other
    columns are not read.
    """
    rows = damaged(conversations)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    left = rows.filter("copies > 0").select("conv_id", "turn", "role", "text", "copies", "fault")
    chunks = durable(left.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunks, _CHUNK), "chunks")
    whole = chunks.filter("whole").select("conv_id", *_RESULT)
    figures = _FIGURES.removesuffix(", repaired_sha256 string")
    split = durable(chunks.filter("not whole").groupBy("conv_id").applyInArrow(_together, f"conv_id long, {figures}"), "split")
    # a hash can't be split: the rows of a long conversation pass through one task, a row at a time
    own = split.select(F.col("conv_id").alias("own"))
    texts = left.join(own, F.col("conv_id").eqNullSafe(F.col("own")), "left_semi").select("conv_id", F.lit(None).cast("string").alias("audit"), "role", "text", "copies", "turn")
    heads = split.select("conv_id", "audit", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"), F.lit(None).cast("long").alias("turn"))
    stream = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.desc_nulls_last("audit"), *order[1:])
    hashes = stream.select("conv_id", "audit", "role", "text", "copies").mapInArrow(_hashes, "conv_id long, repaired_sha256 string")
    hashes = hashes.withColumnRenamed("conv_id", "of")
    split = split.join(hashes, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", *_RESULT)
    empty = hashlib.sha256().hexdigest()
    none = rows.groupBy("conv_id").agg(F.max("copies").alias("most")).filter("most = 0")
    none = none.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in _RESULT[:6]], F.lit("").alias("audit"), F.lit(empty).alias("repaired_sha256"))
    return whole.unionByName(split).unionByName(none)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))))"""
OP12_SQL = f"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT *, ({_CRC}) % 20 AS hit FROM source),
rows AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS n FROM hit),
placed AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM rows, unnest(range(n)) AS u(copy)),
faulty AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE 'f' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair FROM placed),
counted AS (SELECT c, count(*) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY c),
ins(p, q, letters, lines) AS (VALUES ('', '', '', []::VARCHAR[]), ('s', 's', '', []), ('u', 'u', '', []), ('a', 'a', '', []), ('', 'u', 'I', ['user:']), ('', 'a', 'II', ['user:', 'assistant:']),
  ('s', 'u', 'I', ['user:']), ('s', 'a', 'II', ['user:', 'assistant:']), ('u', 'a', 'I', ['assistant:']), ('a', 'u', 'I', ['user:'])),
walk(c, i, state, cost, audit, lines) AS (
  SELECT c, 0, '', 0::BIGINT, '', []::VARCHAR[] FROM counted
  UNION ALL
  SELECT c, i, state, best.cost, best.audit, best.lines FROM (
    SELECT c, i, state, arg_min({{'cost': cost, 'audit': audit, 'lines': lines}}, lpad(cost::VARCHAR, 12, '0') || audit) AS best FROM (
      SELECT w.c, w.i + 1 AS i, CASE e WHEN 'D' THEN q WHEN 'K' THEN initial ELSE CASE q WHEN 'u' THEN 'a' ELSE 'u' END END AS state,
        w.cost + {INSERT} * len(letters) + CASE e WHEN 'D' THEN {DELETE} WHEN 'R' THEN {REROLE} ELSE 0 END + CASE WHEN e <> 'D' AND fault = 't' THEN {TRUNCATED} ELSE 0 END AS cost, w.audit || letters || e AS audit,
        w.lines || ins.lines || CASE e WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE q WHEN 'u' THEN 'assistant:' ELSE 'user:' END || text] END AS lines
      FROM walk w JOIN faulty f ON f.c = w.c AND f.i = w.i + 1 JOIN ins ON p = state, (VALUES ('D'), ('K'), ('R')) AS edits(e)
      WHERE e = 'D' OR fault NOT IN ('b', 'd') AND (e = 'R' OR q || initial IN ('s', 'u', 'su', 'ua', 'au') AND initial <> '')) AS every
    GROUP BY c, i, state) AS grouped),
ended AS (SELECT c, arg_min({{'cost': cost + {INSERT} * len(letters), 'audit': audit || letters, 'lines': walk.lines || ins.lines}}, lpad((cost + {INSERT} * len(letters))::VARCHAR, 12, '0') || audit || letters) AS best
  FROM walk JOIN counted USING (c) JOIN ins ON p = state WHERE i = size AND q IN ('', 'a') GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM rows) LEFT JOIN counted USING (c) LEFT JOIN ended USING (c)"""
