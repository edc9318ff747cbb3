"""Repair of the structure of conversations by aligning their turns with the strings of a grammar.

A repaired conversation has the role initials `(s?(ua)+)?`. For every feasible length of that alternating string
the turns are aligned with it (Wagner and Fischer): keep a turn, give it the role user or assistant, delete it, or
insert an empty turn. A band around the diagonal (Ukkonen) holds only the cells that can still cost no more than
the best alignment so far, lengths that cannot do so are not tried, and among the cheapest alignments of all
lengths the audits (the initials of the edits, traced back) decide.

Turns are range-partitioned by conversation and turn. A conversation inside one partition is repaired there. One
that crosses partitions, be it a third of all rows, is repaired in pieces: runs of `SEGMENT` turns are aligned
with the alternating strings of each first and last symbol, which gives a table of (cost, audit) by the state of
the grammar before and after, and tables are chained. Two audits of the same turns with the same cost never are
prefixes of each other, so the least audit of a chain is made of least audits. Only the digest of such a
conversation's repaired text, one value, is made by a single task, which streams its rows.

A turn's first fault counts: blank (nothing but white space), duplicate (role and text seen before), truncated
(the last character that is no white space is none of `.!?`).

Defined results: a null role or text is one space; turns with a null number come first; rows of the same
conversation and number are ordered by role and a digest of the text; a conversation without rows has no faults,
an empty audit and the digest of the empty string; null conversation ids are one conversation; roles that begin
with neither s, u nor a can be changed or deleted only; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.session import stage

RELABEL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SEGMENT = 32
KNOWN = 1 << 16
SPACES = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}
START, AFTER_S, AFTER_U, AFTER_A = range(4)
LEGAL = {"su", "ua", "au"}

Turn = tuple[str, bool, bool]  # initial, must be deleted, truncated
Edit = tuple[int, str]  # cost, audit


def _off_diagonal(more: int) -> int:
    """Least cost of `more` symbols than turns, or of fewer."""
    return INSERT * more if more >= 0 else -DELETE * more


def least_cost(turns: tuple[Turn, ...], length: int) -> int:
    forced = sum(t[1] for t in turns)
    return DELETE * forced + _off_diagonal(length - (len(turns) - forced))


def align(turns: tuple[Turn, ...], target: str, budget: int) -> Edit | None:
    """Cheapest edits that give `target` for at most `budget`, the least audit among them."""
    n, m = len(turns), len(target)
    free = [0]
    for _, forced, _ in turns:
        free.append(free[-1] + (not forced))
    fixed, no = DELETE * (n - free[n]), budget + 1
    # cost[i][j]: of what is left after i turns and j symbols; cells outside the band are above the budget.
    cost = [[no] * (m + 2) for _ in range(n + 2)]
    for i in range(n, -1, -1):
        row, below = cost[i], cost[i + 1]
        for j in range(m, -1, -1):
            ahead = j - free[i]
            if fixed + _off_diagonal(ahead) + _off_diagonal(m - j - free[n] + free[i]) > budget:
                continue
            best = 0 if i == n and j == m else no
            wanted = target[j] if j < m else ""
            if wanted and wanted != "s":
                best = min(best, INSERT + row[j + 1])
            if i < n:
                initial, forced, cut = turns[i]
                best = min(best, DELETE + below[j])
                if wanted and not forced:
                    if initial == wanted:
                        best = min(best, TRUNCATED * cut + below[j + 1])
                    elif wanted != "s":
                        best = min(best, RELABEL + TRUNCATED * cut + below[j + 1])
            row[j] = best
    if cost[0][0] > budget:
        return None
    i = j = 0
    audit = []
    while i < n or j < m:
        now, wanted = cost[i][j], target[j] if j < m else ""
        if i < n and now == DELETE + cost[i + 1][j]:
            audit.append("D")
            i += 1
        elif wanted and wanted != "s" and now == INSERT + cost[i][j + 1]:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i][0] == wanted else "R")
            i, j = i + 1, j + 1
    return cost[0][0], "".join(audit)


def _alternating(first: str, length: int) -> str:
    return ("ua" if first == "u" else "au") * (length // 2) + first * (length % 2)


def best(turns: tuple[Turn, ...], system: bool, first: str, lengths: str) -> Edit | None:
    """Cheapest alignment with the alternating strings from `first`, behind an s if `system`, of all lengths that
    are none, even (and not 0) or odd."""
    if system and not any(t[0] == "s" and not t[1] for t in turns):
        return None
    lead, least = ("s" if system else ""), {"none": 0, "even": 2, "odd": 1}[lengths]
    middle = len(turns) - sum(t[1] for t in turns) - len(lead)
    if lengths == "none":
        order = [0]
    else:
        # By distance from the number of turns that may stay, so by cost at least.
        reach = 3 * len(turns) + 2
        order = [k for k in range(least, max(middle, 0) + reach, 2)]
        order.sort(key=lambda k: least_cost(turns, k + len(lead)))
    found: Edit | None = None
    for k in order:
        target, low = lead + _alternating(first, k), least_cost(turns, k + len(lead))
        if found is not None:
            if low > found[0]:
                break
            edit = align(turns, target, found[0])
        else:
            budget = low + 4
            while (edit := align(turns, target, budget)) is None:
                if budget > low + (RELABEL + DELETE + INSERT + TRUNCATED) * (len(turns) + len(target)):
                    break  # no s that could be kept
                budget = low + 2 * (budget - low)
        if edit is not None and (found is None or edit < found):
            found = edit
    return found


def _least(*edits: Edit | None) -> Edit | None:
    known = [e for e in edits if e is not None]
    return min(known) if known else None


def segment_table(turns: tuple[Turn, ...]) -> list[tuple[int, int, Edit]]:
    """(state before, state after, edit) of a run of turns."""
    plain = {(f, k): best(turns, False, f, k) for f in "ua" for k in ("none", "even", "odd")}
    system = {k: best(turns, True, "u", k) for k in ("none", "even", "odd")}
    table = {
        (START, START): plain["u", "none"],
        (START, AFTER_S): system["none"],
        (START, AFTER_U): _least(plain["u", "odd"], system["odd"]),
        (START, AFTER_A): _least(plain["u", "even"], system["even"]),
        (AFTER_S, AFTER_S): plain["u", "none"],
        (AFTER_S, AFTER_U): plain["u", "odd"],
        (AFTER_S, AFTER_A): plain["u", "even"],
        (AFTER_U, AFTER_U): _least(plain["a", "none"], plain["a", "even"]),
        (AFTER_U, AFTER_A): plain["a", "odd"],
        (AFTER_A, AFTER_U): plain["u", "odd"],
        (AFTER_A, AFTER_A): _least(plain["u", "none"], plain["u", "even"]),
    }
    return [(a, b, e) for (a, b), e in table.items() if e is not None]


def chained(left: list, right) -> list:
    """The table of two runs, one after the other."""
    out: dict[tuple[int, int], Edit] = {}
    for a, b, (cost, audit) in left:
        for c, d, (more, rest) in right:
            if b == c:
                edit = (cost + more, audit + rest)
                if (a, d) not in out or edit < out[a, d]:
                    out[a, d] = edit
    return [(a, b, e) for (a, b), e in out.items()]


def run_table(turns: list[Turn]) -> list:
    """The table of any number of turns."""
    tables = [segment_table(tuple(turns[k : k + SEGMENT])) for k in range(0, len(turns), SEGMENT)] or [[]]
    # Neighbours are chained in pairs, so that audits are copied a few times only.
    while len(tables) > 1:
        pairs = [chained(a, b) for a, b in zip(tables[::2], tables[1::2])]
        tables = pairs + tables[len(pairs) * 2 :]
    return tables[0]


def outcome(table: list) -> Edit:
    return min(e for a, b, e in table if a == START and b in (START, AFTER_A))


def repaired_turns(turns: list[Turn], known: dict[tuple, Edit]) -> Edit:
    """The cheapest repair; `known` keeps those of short conversations, of which many are alike."""
    if len(turns) > SEGMENT:
        return outcome(run_table(turns))
    turns = tuple(turns)
    if turns not in known:
        if len(known) >= KNOWN:
            known.clear()
        known[turns] = _least(best(turns, False, "u", "none"), best(turns, False, "u", "even"), best(turns, True, "u", "even"))
    return known[turns]


class Repaired:
    """Digest of a repaired conversation whose rows are given in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.next, self.any, self.sha = audit, 0, "u", False, hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.sha.update(("\n" * self.any + f"{role}:{text}").encode())
        self.any = True

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(NAMES[self.next], "")
            self.next = "a" if self.next == "u" else "u"
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        kept_system = edit == "K" and role[:1] == "s"
        self._line(role if edit == "K" else NAMES[self.next], text)
        if not kept_system:
            self.next = "a" if self.next == "u" else "u"

    def digest(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


class Piece:
    """Turns of one conversation that a partition holds."""

    def __init__(self, conv):
        self.conv, self.turns, self.rows, self.last = conv, [], [], None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def add(self, turn, role: str, text: str, digest: bytes, early: bool) -> None:
        stripped = text.strip(SPACES)
        row = (turn, role, digest)
        duplicate = early or row == self.last
        self.last = row
        fault = "blank" if not stripped else "duplicate" if duplicate else "truncated" if stripped[-1] not in ".!?" else None
        if fault:
            self.counts[fault] += 1
        if self.turns and self.turns[-1][0] + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        self.turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        if self.rows is not None:
            self.rows.append((role, text))

    def whole(self, known: dict) -> tuple:
        cost, audit = repaired_turns(self.turns, known)
        text = Repaired(audit)
        for row in self.rows:
            text.row(*row)
        return (self.conv, *self.counts.values(), cost, audit, text.digest(), None, None)

    def cut(self, part: int) -> tuple:
        ends = self.turns[0][0], self.turns[-1][0]
        return (self.conv, *self.counts.values(), None, None, None, part, json.dumps([ends, run_table(self.turns)]))


HELD = 1000  # rows of a conversation whose text is held, longer ones are read again

_FOUND = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, part int, piece string"


def _pieces(schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, part, out, known = None, True, 0, [], {}

        def done(last: bool) -> None:
            # What touches an end of the partition may go on in the next one.
            whole = not (first or last) and now.rows is not None
            out.append(now.whole(known) if whole else now.cut(part))

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for conv, turn, role, text, digest, early, part in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv:
                    if now is not None:
                        done(False)
                        first = False
                    now = Piece(conv)
                now.add(turn, role, text, digest, early)
                if now.rows is not None and len(now.rows) > HELD:
                    now.rows = None
            if len(out) > 1000:
                yield flushed()
        if now is not None:
            done(True)
        yield flushed()

    return work


def _chain(schema: pa.Schema):
    """Sorted pieces of each conversation as one row."""

    def joined(conv, held: list) -> tuple:
        counts, last, tables = [0] * 4, None, []
        for *more, piece in held:
            (first, end), table = json.loads(piece)
            counts = [a + b for a, b in zip(counts, more)]
            if last is not None and last + first not in LEGAL:
                counts[3] += 1
            last = end
            tables.append([(a, b, tuple(e)) for a, b, e in table])
        while len(tables) > 1:
            pairs = [chained(a, b) for a, b in zip(tables[::2], tables[1::2])]
            tables = pairs + tables[len(pairs) * 2 :]
        return (conv, *counts, *outcome(tables[0]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            for conv, part, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if held and conv != now:
                    out.append(joined(now, held))
                    held = []
                now = conv
                held.append(rest)
        if held:
            out.append(joined(now, held))
        columns = list(zip(*out)) if out else [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return work


def _digests(schema: pa.Schema):
    """An audit and then the rows of each conversation as the digest of its repaired text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, text, out = None, None, []
        for batch in batches:
            for conv, audit, role, body in zip(*(c.to_pylist() for c in batch.columns)):
                if audit is not None:
                    if text is not None:
                        out.append((now, text.digest()))
                    now, text = conv, Repaired(audit)
                else:
                    text.row(role, body)
        if text is not None:
            out.append((now, text.digest()))
        columns = list(zip(*out)) if out else [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return work


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) with faults by a hash of conversation and turn: a row is dropped,
    emptied, loses its `.!?`, comes twice, or becomes the user's."""
    key = F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn"))
    kind = (F.crc32(key) % 20).cast("int")
    text, role = _spaced("text"), _spaced("role")
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
        .withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
        .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("dropped"))
    )


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, and perhaps dropped): conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256. Dropped rows count for conv_id only."""
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    role, text = _spaced("role"), _spaced("text")
    all_ = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), dropped.alias("dropped"))
    turns = F.when(~F.col("dropped"), F.col("turn").cast("decimal(20,0)"))
    gaps = (F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("decimal(38,0)").try_cast("long")
    distinct = all_.select("conv", turns.alias("turn")).distinct()
    known = distinct.groupBy("conv").agg(F.coalesce(gaps, F.lit(0).cast("long")).alias("gaps"))

    left = all_.where(~F.col("dropped")).drop("dropped").withColumn("digest", F.unhex(F.sha2("text", 256)))
    # The lowest turn of what occurs more than once, nulls being the lowest.
    met = left.groupBy("conv", "role", "digest").agg(F.count("*").alias("n"), F.min("turn").alias("low"), F.max(F.col("turn").isNull()).alias("null"))
    met = met.where("n > 1").select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "low", "null")
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    early = F.col("turn").isNotNull() & (F.coalesce("null", F.lit(False)) | F.coalesce(F.col("turn") > F.col("low"), F.lit(False)))
    left = stage(left.join(met, same, "left").select("conv", "turn", "role", "text", "digest", early.alias("early")))

    kind = left.schema["conv"].dataType.simpleString()
    order = ["conv", "turn", "role", "digest"]
    ranged = left.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = f"conv {kind}, {_FOUND}"
    found = stage(ranged.mapInArrow(_pieces(_arrow(spark, schema)), schema))
    whole = found.where("part is null").drop("part", "piece")
    # At most two conversations of each partition.
    parts = found.where("part is not null").select("conv", "part", "blank", "duplicate", "truncated", "illegal", "piece")
    schema = f"conv {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    cut = stage(parts.repartition(partitions, "conv").sortWithinPartitions("conv", "part").mapInArrow(_chain(_arrow(spark, schema)), schema))
    wanted = cut.select(F.col("conv").alias("_conv"))
    again = left.join(wanted, F.col("conv").eqNullSafe(F.col("_conv")), "left_semi").select("conv", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "digest")
    null = lambda kind: F.lit(None).cast(kind)
    again = again.unionByName(cut.select("conv", "audit", null("long").alias("turn"), null("string").alias("role"), null("string").alias("text"), null("binary").alias("digest")))
    streamed = again.repartition(partitions, "conv").sortWithinPartitions("conv", F.col("audit").desc_nulls_last(), "turn", "role", "digest")
    schema = f"of {kind}, repaired_sha256 string"
    digests = streamed.select("conv", "audit", "role", "text").mapInArrow(_digests(_arrow(spark, schema)), schema)
    cut = cut.join(digests, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    fixed = whole.unionByName(cut).withColumnRenamed("conv", "_conv")
    out = known.join(fixed, F.col("conv").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select(
        F.col("conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)
