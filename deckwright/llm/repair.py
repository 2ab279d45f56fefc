"""Structure repair of conversations: the cheapest edits that make the roles follow ``(s?(ua)+)?``.

A conversation's rows are edited in order: Keep (free), Rerole to user or assistant, Delete, or Insert an empty turn
before, between or after them.  A blank or duplicate row must be deleted; a truncated one that stays costs extra.  Of the
cheapest ways that end in a legal conversation, the one with the least letters (K, R, D, I; compared as ASCII text) holds.

One integer decides both.  A way to finish a conversation weighs ``cost * 8**width + letters``: the low ``width`` digits
hold its letters from the left, one base-8 digit each (the order of ASCII, from 1), and zeros behind the last, so a text
that ends sooner is less.  The graph's nodes are (rows left, the role before), its edges edits; taking an edit in front of
a way adds the edit's cost to the high digits and moves the low ones down by one for its letter.  The least integer from
each node, from the last row back, is all there is; the letters of the winner are read from its digits.

Work for a conversation of n rows is n steps on integers of 3 bits a letter, so it grows with n * n / 64 in words
(10,000 rows a second or two, 400 rows some milliseconds), and memory with n, as only one row's four integers are held.
Conversations are streams of rows in tasks: first without texts, of which only kinds and digests decide, then with them,
hashing what is kept as it passes, so no text of a conversation is ever gathered.

Defined cases: a null role or text is one space; a null turn comes before all others and is written as a space in the
key of the damage; rows of one turn go by the SHA-256 digests of role and text; rows without an id are one
conversation, whose id is null; a role counts by its first letter, and an empty one is no legal role; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common

SPACES = " \t\n\x0b\x0c\r"
#: What edits cost, the surcharge of a truncated row that stays, and the letters in ASCII order (digits 1 to 4).
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LETTERS = "DIKR"
BITS = 3
#: States: nothing yet, after a system, user or assistant turn; and where a turn of a role leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A row's code: its role's letter (upper case: truncated), or one of these.
MUST_GO, OTHER, OTHER_TRUNCATED = "x", "o", "O"


def solve(rows: str) -> tuple[int, str]:
    """Cost and letters of the least way for a conversation given by its rows' codes."""
    # every row deleted, and two turns inserted at most, is a way from any state, so no more turns are inserted than that pays for
    width = len(rows) + DELETE * len(rows) // INSERT + 3
    top = BITS * (width - 1)
    high = BITS * width
    low = (1 << high) - 1
    edge = {x: (cost << high) + (LETTERS.index(x) + 1 << top) for x, cost in (("K", KEEP), ("R", REROLE), ("D", DELETE), ("I", INSERT))}
    surcharge = TRUNCATED << high
    none = (INSERT * len(rows) + DELETE * len(rows) + 1000) << high  # no way from here

    def taken(letter: str, way: int) -> int:
        return none if way >= none else edge[letter] + ((way >> high) << high) + ((way & low) >> BITS)

    def inserted(ways: list[int]) -> list[int]:
        """With turns inserted before what follows; more than two in a row lead to a state passed before."""
        for _ in range(2):
            ways = [min(ways[at], *(taken("I", ways[to]) for role, to in NEXT[at].items() if role != "s")) for at in range(4)]
        return ways

    ways = inserted([0, none, none, 0])
    for code in reversed(rows):
        gone = [taken("D", way) for way in ways]
        if code != MUST_GO:
            extra = surcharge if code.isupper() else 0
            role = code.lower()
            for at in range(4):
                stay = [taken("K" if role == r else "R", ways[to]) for r, to in NEXT[at].items() if role == r or r != "s"]
                gone[at] = min(gone[at], *(min(none, way + extra) for way in stay))
        ways = inserted(gone)
    best = ways[START]
    digits = [(best >> top - BITS * i) & 7 for i in range(width)]
    return best >> high, "".join(LETTERS[d - 1] for d in digits if d)


@functools.lru_cache(65_536)
def solved(rows: str) -> tuple[int, str]:
    return solve(rows)


def repaired(codes: str, audit: str) -> list[tuple[int, str | None]]:
    """The turns that the letters leave: (row's number, None for the role that it has or else the new one), or
    (-1, role) for an inserted one."""
    out: list[tuple[int, str | None]] = []
    at, i = START, 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        role = codes[i].lower() if letter == "K" else next(r for r in NEXT[at] if r != "s")
        at = NEXT[at][role]
        out.append((-1, NAMES[at]) if letter == "I" else (i, None if letter == "K" else NAMES[at]))
        i += letter != "I"
    return out


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, lost): rows with the faults that a hash of conversation and turn deals out.  A row
    that it drops stays as one that is marked ``lost``, so that no conversation vanishes."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", blank(conv), blank(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), fault.alias("fault"))
    changed = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), (F.col("fault") == 0).alias("lost"))


def kinds(rows: DataFrame) -> DataFrame:
    """The rows with ``digest`` of role and text, and ``code``: the role's letter and whether the text is blank or
    ends as no sentence does."""
    ended = F.rtrim(F.col("text"), F.lit(SPACES))
    letter = F.substring("role", 1, 1)
    known = F.when(letter.isin("s", "u", "a"), letter).otherwise(OTHER)
    state = F.when(ended == "", MUST_GO).when(F.right(ended, F.lit(1)).isin(".", "!", "?"), known).otherwise(F.upper(known))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    return rows.withColumn("digest", digest).withColumn("code", F.when(F.col("lost"), "").otherwise(state)).withColumn("initial", F.when(F.col("lost"), "").otherwise(known))


class Plan:
    """One conversation's rows, as far as they have come."""

    def __init__(self, conv: object) -> None:
        self.conv, self.codes, self.initials, self.turns = conv, [], [], 0
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = 0
        self.least = self.most = None

    def add(self, code: str, initial: str, digest: bytes, turn: int | None) -> None:
        if not code:
            return
        if code == MUST_GO:
            self.blank += 1
        elif digest in self.seen:
            self.duplicate += 1
            code = MUST_GO
        elif code.isupper():
            self.truncated += 1
        self.seen.add(digest)
        self.codes.append(code)
        self.initials.append(initial)
        if turn is not None:  # rows come in order of turn
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn

    def row(self) -> dict[str, object]:
        pairs = zip(self.initials, self.initials[1:], strict=False)
        codes = "".join(self.codes)
        cost, audit = solved(codes) if len(codes) <= 64 else solve(codes)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {"conv_id": self.conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": sum(a + b not in ("su", "ua", "au") for a, b in pairs), "cost": cost, "audit": audit, "codes": codes}


PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, codes string"


def plans(rows: DataFrame) -> DataFrame:
    """One row a conversation: the faults counted, the cost, and ``audit``, the letters of the edits."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Plan | None = None
        for batch in batches:
            done = []
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "code", "initial", "digest", "turn")), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = Plan(conv)
                now.add(*row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    schema = to_arrow_schema(StructType.fromDDL(f"conv_id {kind}, {PLAN}"))
    light = rows.select("conv_id", "turn", "digest", "code", "initial")
    dealt = light.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "digest")
    return dealt.mapInArrow(run, f"conv_id {kind}, {PLAN}")


def applied(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` with ``repaired_sha256``: the digest of the repaired conversation, ``role:text`` a line.  Rows and edits
    of a conversation come as one stream, the edits first."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    keep = edits.columns
    head = edits.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.struct(*keep).alias("edits"))
    body = rows.where(~F.col("lost")).select("conv_id", F.lit(1).alias("part"), "turn", "digest", "role", "text", F.lit(None).cast(head.schema["edits"].dataType).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Repaired | None = None
        for batch in common.slices(batches):
            done = []
            part, role, text, edit = (batch.column(c).to_pylist() for c in ("part", "role", "text", "edits"))
            for i in range(len(part)):
                if part[i] == 0:
                    if now is not None:
                        done.append(now.row())
                    now = Repaired(edit[i])
                else:
                    now.add(role[i], text[i])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    out = f"conv_id {kind}, {PLAN}, repaired_sha256 string"
    schema = to_arrow_schema(StructType.fromDDL(out))
    both = head.unionByName(body).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", F.asc_nulls_first("turn"), "digest")
    return both.select("part", "role", "text", "edits").mapInArrow(run, out)


class Repaired:
    """The digest of a repaired conversation, as its rows pass."""

    def __init__(self, edits: dict) -> None:
        self.edits, self.hash, self.row_number, self.lines = edits, hashlib.sha256(), 0, 0
        self.left = iter(repaired(edits["codes"], edits["audit"]))
        self.next = next(self.left, None)

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1
        self.next = next(self.left, None)

    def insert(self) -> None:
        while self.next is not None and self.next[0] < 0:
            self.line(self.next[1], "")

    def add(self, role: str, text: str) -> None:
        self.insert()
        if self.next is not None and self.next[0] == self.row_number:
            self.line(self.next[1] or role, text)
        self.row_number += 1

    def row(self) -> dict[str, object]:
        self.insert()
        return self.edits | {"repaired_sha256": self.hash.hexdigest()}


def repair(rows: DataFrame) -> DataFrame:
    """What :func:`damage` gives, or rows of that shape: one row a conversation."""
    rows = kinds(rows)
    return applied(rows, common.cut(plans(rows))).drop("codes")
