"""Operator 11, conversation structure repair: shortest paths over a small automaton with Dial's bucket queue.

A conversation's rows are read in order of turn. An edit script keeps, reroles, deletes or inserts rows so that the
initials of the roles give `(s?(ua)+)?`. Its graph has four nodes for each place between rows (nothing yet, after a
system, a user, an assistant row) and arcs of cost 0 to 3, so a queue of buckets by distance needs no heap. Distances to
the end are recorded, then the arcs that are tight under them are walked from the start, the least letter first. From a
node each letter leads to one node only, so the walk gives the cheapest script that is least in ASCII (D, I, K, R).

Work in Spark: damage and all properties of rows are columns; copies of a role and text are told by a minimum for each
of them, which combines before the shuffle, and a join that has the turn in its key. Two passes stream rows sorted by
conversation and turn through workers: the first, over narrow rows, holds a byte a row of the conversation at hand and
finds the script; the second meets the script in front of the texts and feeds the repaired rows to a digest. Dial runs
over BLOCK rows at a time, from the last to the first; of the other blocks only the four distances at their ends are
kept. So a conversation of any length takes about three bytes a row, which its script, one cell of the result, needs.

Defined cases: in the hash that chooses the damage a null conv_id or turn is one space; a null role or text is one space.
Null conv_ids are one conversation. Rows of one turn come in order of role, then of the SHA-256 of their text. A role
with another initial, or none, can't be kept, only reroled or deleted. Repeated rows are damaged alike and stand beside
each other. A conversation without rows after the damage has zeros, no script and the digest of the empty text. Extra
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK = 4_096
#: Codes of rows: role in the low two bits (0: other), then whether it is truncated, then whether it must go.
ROLES, TRUNCATED, MUST_GO = {"s": 1, "u": 2, "a": 3}, 4, 8
BLANKS = r"\x20\x09-\x0D"
#: States: nothing yet, after s, after u, after a. The state that a user or assistant row leads to, from each.
NEXT = (2, 2, 3, 2)
ENDS = (0, None, None, 0)
LETTERS = "DIKR"


def arcs_of(code: int) -> list[list[tuple[str, int, int]]]:
    """For each state the arcs over a row of that code: letter, state led to, cost; in order of the letters. Inserts are the same everywhere."""
    role, cut, must = code & 3, 1 if code & TRUNCATED else 0, code & MUST_GO
    out: list[list[tuple[str, int, int]]] = []
    for q in range(4):
        arcs = [("D", q, 3)]
        if not must and ((role == 1 and q == 0) or (role > 1 and NEXT[q] == role)):
            arcs.append(("K", role, cut))
        if not must:
            arcs.append(("R", NEXT[q], 2 + cut))
        out.append(arcs)
    return out


ARCS = [arcs_of(c) for c in range(16)]
#: The same, backwards: for each code and state the states that lead to it, with the cost.
BACK = [[[(p, w) for p in range(4) for _, to, w in ARCS[c][p] if to == q] for q in range(4)] for c in range(16)]
INSERTED = [[p for p in range(4) if NEXT[p] == q] for q in range(4)]


def dial(codes: bytes, ends: Iterable[int | None]) -> list[int | None]:
    """Distance to the end from every node (4 * place + state), given those from the nodes of the last place (null: not an end)."""
    n = len(codes)
    distance: list[int | None] = [None] * (4 * n + 4)
    buckets: list[list[int]] = []

    def put(node: int, d: int) -> None:
        while len(buckets) <= d:
            buckets.append([])
        buckets[d].append(node)

    for q, d in enumerate(ends):
        if d is not None:
            put(4 * n + q, d)
    d = 0
    while d < len(buckets):
        for node in buckets[d]:  # arcs of cost 0 add to this bucket while it is read
            if distance[node] is not None:
                continue
            distance[node] = d
            place, q = node >> 2, node & 3
            for p in INSERTED[q]:
                if distance[4 * place + p] is None:
                    put(4 * place + p, d + 2)
            if place:
                for p, w in BACK[codes[place - 1]][q]:
                    if distance[node - 4 - q + p] is None:
                        put(node - 4 - q + p, d + w)
        buckets[d] = []
        d += 1
    return distance


def walk(codes: bytes, distance: list[int | None], q: int, last: bool) -> tuple[str, int]:
    """Letters of the tight arcs from state q before the first row on, the least first, and the state they end in."""
    out, place, n = [], 0, len(codes)
    while place < n or (last and ENDS[q] is None):
        now, taken = distance[4 * place + q], None
        for letter, to, w in ARCS[codes[place]][q] if place < n else ():
            if (left := distance[4 * place + 4 + to]) is not None and left + w == now and (taken is None or letter < taken[0]):
                taken = letter, to, 1
        left = distance[4 * place + NEXT[q]]
        if left is not None and left + 2 == now and (taken is None or taken[0] > "I"):
            taken = "I", NEXT[q], 0
        out.append(taken[0])
        q, place = taken[1], place + taken[2]
    return "".join(out), q


def repair(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """Cost and script of the cheapest repair of rows of these codes, the least script of that cost."""
    starts = list(range(0, len(codes), block)) or [0]
    after: list = [ENDS]  # distances at the end of each block, last block first, less what they have in common
    common = 0
    distance: list[int | None] = []
    for at in reversed(starts):
        distance = dial(codes[at : at + block], after[-1])
        least = min(x for x in distance[:4] if x is not None)
        after.append([None if x is None else x - least for x in distance[:4]])
        common += least
    cost = common + after[-1][0]
    script, q = [], 0
    for k, at in enumerate(starts):
        if len(starts) > 1:
            distance = dial(codes[at : at + block], after[len(starts) - 1 - k])
        letters, q = walk(codes[at : at + block], distance, q, k + 1 == len(starts))
        script.append(letters)
    return cost, "".join(script)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0: dropped): each row once, as damaged; copies tells how often it stands there."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    text = F.coalesce("text", blank)
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"),
    )


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def _dealt(df: DataFrame, *order: str | Column) -> DataFrame:
    """Rows of a conversation in one partition, sorted; as many partitions as shuffles have, whatever their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *order)


FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {(1, 2), (2, 3), (3, 2)}


class _Conversation:
    """What the first pass holds of the conversation at hand."""

    def __init__(self) -> None:
        self.codes, self.blank, self.duplicate, self.truncated, self.illegal = bytearray(), 0, 0, 0, 0
        self.low = self.high = None
        self.turns = self.before = 0

    def add(self, turn: int | None, role: int, blank: bool, cut: bool, n: int, first: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.codes:
            self.illegal += (self.before, role) not in LEGAL
        self.illegal += (n - 1) * ((role, role) not in LEGAL)
        self.before = role
        fresh = int(first and not blank)
        self.blank += n * blank
        self.duplicate += 0 if blank else n - fresh
        self.truncated += fresh * cut
        self.codes += bytes([role | TRUNCATED * cut]) * fresh + bytes([role | MUST_GO]) * (n - fresh)

    def found(self) -> tuple:
        cost, script = repair(bytes(self.codes)) if self.codes else (0, "")
        return 0 if self.low is None else self.high - self.low + 1 - self.turns, self.blank, self.duplicate, self.truncated, self.illegal, cost, script


def scripts(rows: DataFrame) -> DataFrame:
    """conv_id and FOUND of every conversation of damaged()."""
    there = F.col("copies") > 0
    initial = F.substring("role", 1, 1)
    role = F.coalesce(*(F.when(initial == x, F.lit(k)) for x, k in ROLES.items()), F.lit(0)).cast("byte")
    only = lambda c: F.when(there, c)  # noqa: E731  rows that were dropped tell of their conversation alone
    narrow = rows.select(
        "conv_id", only(F.col("turn").cast("long")).alias("turn"), only(F.col("role")).alias("role"), only(_digest()).alias("digest"), only(role).alias("initial"),
        only(~F.col("text").rlike(f"[^{BLANKS}]")).alias("blank"), only(F.col("text").rlike(rf"[^.!?{BLANKS}][{BLANKS}]*\z")).alias("cut"), "copies",
    )
    keys = ["conv_id", "turn", "role", "digest"]
    groups = narrow.groupBy(*keys, "initial", "blank", "cut").agg(F.sum("copies").alias("n"))
    first = groups.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("at")).select("conv_id", F.col("at.turn").alias("turn"), "role", "digest")
    first = first.select(*(F.col(c).alias(f"f_{c}") for c in keys))
    on = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in keys]
    told = groups.join(first, on, "left").select("conv_id", "turn", "role", "digest", "initial", "blank", "cut", "n", F.col("f_digest").isNotNull().alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, ids, done = None, None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            ids, done = [], []
            for conv, *row, n, first in zip(*(b.column(k).to_pylist() for k in (0, 1, 4, 5, 6, 7, 8))):
                if now is None or conv != key:
                    if now is not None:
                        ids.append(key)
                        done.append(now.found())
                    key, now = conv, _Conversation()
                if n:
                    now.add(*row, n, first)
            yield _batch(ids, done, b.schema.field(0).type)
        if now is not None:
            yield _batch([key], [now.found()], b.schema.field(0).type)

    return _dealt(told, F.asc_nulls_first("turn"), "role", "digest").mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {FOUND}")


def _batch(ids: list, found: list[tuple], kind: pa.DataType, names: str = FOUND) -> pa.RecordBatch:
    columns = [x.split() for x in names.split(", ")]
    values = list(zip(*found)) or [()] * len(columns)
    return pa.record_batch([pa.array(ids, kind), *(pa.array(v, pa.int64() if t == "long" else pa.string()) for v, (_, t) in zip(values, columns))], names=["conv_id", *(n for n, _ in columns)])


RESULT = f"{FOUND}, repaired_sha256 string"


class _Repaired:
    """The digest of a repaired conversation, fed row by row."""

    def __init__(self, found: tuple):
        self.found, self.script, self.at = found, found[-1], 0
        self.before, self.expected, self.sha = "", "user", hashlib.sha256()

    def put(self, role: str, text: str) -> None:
        self.sha.update(f"{self.before}{role}:{text}".encode())
        self.before, self.expected = "\n", "assistant" if role[:1] == "u" else "user"

    def inserted(self) -> None:
        while self.script[self.at : self.at + 1] == "I":
            self.put(self.expected, "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.script[self.at]
        self.at += 1
        if letter == "K":
            self.put(role, text)
        elif letter == "R":
            self.put(self.expected, text)

    def end(self) -> tuple:
        self.inserted()
        return *self.found, self.sha.hexdigest()


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id and RESULT of every conversation, after the damage that its keys bring about."""
    rows = damaged(conversations)
    found = scripts(rows)
    names = [x.split()[0] for x in FOUND.split(", ")]
    there = rows.where("copies > 0").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", _digest(), "text", "copies")
    both = found.withColumn("script", F.lit(True)).unionByName(there.withColumn("script", F.lit(False)), allowMissingColumns=True)
    both = both.select("conv_id", "script", "turn", "role", "digest", "text", "copies", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for b in batches:
            ids, done = [], []
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                for conv, script, role, text, copies, *found in zip(*(c.to_pylist() for c in part.columns)):
                    if script:
                        if now is not None:
                            ids.append(key)
                            done.append(now.end())
                        key, now = conv, _Repaired(tuple(found))
                    else:
                        for _ in range(copies):
                            now.add(role, text)
            yield _batch(ids, done, b.schema.field(0).type, RESULT)
        if now is not None:
            yield _batch([key], [now.end()], b.schema.field(0).type, RESULT)

    ordered = _dealt(both, F.desc("script"), F.asc_nulls_first("turn"), "role", "digest").drop("turn", "digest")
    return ordered.mapInArrow(run, f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, {RESULT}")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
