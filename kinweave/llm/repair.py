"""Repair of conversation structure by a rank-convergence parallel Viterbi search.

A conversation should be an optional system turn and then user and assistant turns by turns, or
nothing: its roles' initials match ``(s?(ua)+)?``. A row can be kept, get another role, or be deleted,
and empty turns can be inserted. Blank rows and repeats must be deleted; keeping a truncated row costs
extra. The cheapest edits are a shortest path over four states (nothing yet, after s, after u, after
a), found backwards: from the costs behind a row follow those before it.

A long conversation is cut into chunks of ``CHUNK`` rows. All chunks start at once from a speculative
vector of the costs behind them. Then passes fix them up: where the vector that the next chunk came to
differs from the one a chunk has used by more than a constant, the chunk runs again. A step of the
search mixes four numbers only, so vectors are soon equal but for a constant, and few chunks run more
than twice; passes go on until none does. With all vectors stitched, each chunk traces the edits that
come first in the alphabet, from every state it can be entered in, and the states chunks are entered
in follow from one another, twice as far each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.lineage import cut
from kinweave.llm.common import batch, small_batches
from kinweave.llm.places import name_of, with_places

CHUNK = 1024
#: Code points 0x20 and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The state that keeping an initial leads to.
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state after a turn of the user or the assistant, whichever may come next, and its role.
NEXT, NEXT_ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: Behind the last row: costs, and the inserts that end a conversation.
END, END_EDITS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")


@lru_cache(maxsize=100_000)
def step(initial: str, fault: str, after: tuple) -> tuple[tuple, list[tuple[str, int, int]]]:
    """The costs before a row, less the least of them, and the best move from each state: edits, the
    state they lead to, their own cost. Of equally cheap edits, the first in the alphabet."""
    costs, moves = [], []
    for state in range(4):
        found = []
        inserts, at = "", state
        while len(inserts) < 3:  # a third insert leads where the first did
            spent = INSERT * len(inserts)
            found.append((spent + DELETE + after[at], inserts + "D", at, spent + DELETE))
            if fault not in "bd":
                spent += TRUNCATED if fault == "t" else 0
                found.append((spent + REROLE + after[NEXT[at]], inserts + "R", NEXT[at], spent + REROLE))
                to = KEEP.get((at, initial))
                if to is not None:
                    found.append((spent + after[to], inserts + "K", to, spent))
            inserts, at = inserts + "I", NEXT[at]
        cost, edits, to, own = min(found)
        costs.append(cost)
        moves.append((edits, to, own))
    least = min(costs)
    return tuple(c - least for c in costs), moves


def search_back(initials: str, faults: str, after: tuple) -> tuple[tuple, list]:
    """The cost vector before a chunk, and each row's moves, the last row's first."""
    moves = []
    for initial, fault in zip(reversed(initials), reversed(faults)):
        after, found = step(initial, fault, after)
        moves.append(found)
    return after, moves


@dataclass
class Repair:
    """``audits``: conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; a row per conversation
    that has rows. ``turns``: the repaired turns (conv, conv_id, place, part, role, text) in that order."""

    audits: DataFrame
    turns: DataFrame


def marked_rows(turns: DataFrame) -> DataFrame:
    """The rows with ``conv``, ``place`` in it, the role's ``initial``, and ``fault`` but for repeats."""
    shown = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    rows = (turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
            .withColumns({"conv": name_of(F.col("conv_id")), "digest": F.sha2("text", 256),
                          "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("x"),
                          "fault": F.when(shown == "", "b").when(F.right(shown, F.lit(1)).isin(".", "!", "?"), ".").otherwise("t")}))
    return with_places(rows, "conv", ["turn", "role", "digest"])


def chunk_rows(rows: DataFrame, size: int) -> DataFrame:
    """``conv, chunk, initials, faults``: a letter per row; ``d`` marks repeats of an earlier row."""
    first = rows.groupBy("conv", "role", "digest").agg(F.min("place").alias("place")).select("conv", "place", F.lit(True).alias("first"))
    known = rows.select("conv", "place", "initial", "fault").join(first, ["conv", "place"], "left")
    fault = F.when((F.col("fault") != "b") & F.col("first").isNull(), "d").otherwise(F.col("fault"))
    grouped = (known.select("conv", "place", "initial", fault.alias("fault"), F.floor(F.col("place") / size).alias("chunk"))
               .groupBy("conv", "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "initial", "fault"))).alias("rows")))
    return grouped.select("conv", "chunk", F.array_join("rows.initial", "").alias("initials"), F.array_join("rows.fault", "").alias("faults"))


def search_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with ``used``, the costs behind them, run to ``begun``, the costs before them."""
    schema = "conv string, chunk long, initials string, faults string, used string, begun string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            begun = [" ".join(map(str, search_back(i, f, tuple(map(int, u.split())))[0]))
                     for i, f, u in zip(*(rows[c].to_pylist() for c in ("initials", "faults", "used")))]
            yield batch(schema, begun=begun, **{c: rows[c] for c in ("conv", "chunk", "initials", "faults", "used")})

    return chunks.select("conv", "chunk", "initials", "faults", "used").mapInArrow(work, schema)


def converge(chunks: DataFrame) -> DataFrame:
    """All chunks with the costs behind them right but for a constant, and ``last``."""
    lasts = chunks.groupBy("conv").agg(F.max("chunk").alias("of_conv"))
    marked = cut(search_chunks(chunks.withColumn("used", F.lit(" ".join(map(str, END))))).join(lasts, "conv"))
    alone = marked.filter("of_conv = 0").drop("of_conv")
    several = marked.filter("of_conv > 0").drop("of_conv")
    while True:
        behind = several.select("conv", (F.col("chunk") - 1).alias("chunk"), F.col("begun").alias("heard"))
        stale = cut(several.join(behind, ["conv", "chunk"]).filter("heard <> used")
                    .select("conv", "chunk", "initials", "faults", F.col("heard").alias("used")))
        if stale.isEmpty():
            break
        several = cut(several.join(stale.select("conv", "chunk"), ["conv", "chunk"], "left_anti")
                      .unionByName(search_chunks(stale)))
    return alone.unionByName(several).join(lasts, "conv").withColumn("last", F.col("chunk") == F.col("of_conv"))


TRACED = ("conv string, chunk long, last boolean, initials string, illegal long, blank long, duplicate long, truncated long, "
          "audits array<string>, exits array<int>, costs array<long>")

ARROW_TRACED = pa.schema([
    ("conv", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("initials", pa.string()), ("illegal", pa.int64()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("audits", pa.list_(pa.string())),
    ("exits", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64()))])


def trace_chunks(chunks: DataFrame) -> DataFrame:
    """For each state a chunk can be entered in: its audit, the state it is left in, and the cost."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for row in rows.to_pylist():
                initials, faults = row["initials"], row["faults"]
                moves = search_back(initials, faults, tuple(map(int, row["used"].split())))[1][::-1]
                audits, exits, costs = [], [], []
                for state in range(4 if row["chunk"] else 1):
                    edits, cost = [], 0
                    for move in moves:
                        own, state, spent = move[state]
                        edits.append(own)
                        cost += spent
                    if row["last"]:
                        edits.append(END_EDITS[state])
                        cost += END[state]
                    audits.append("".join(edits))
                    exits.append(state)
                    costs.append(cost)
                pairs = map("".join, zip(initials, initials[1:]))
                out.append({"conv": row["conv"], "chunk": row["chunk"], "last": row["last"], "initials": initials,
                            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "blank": faults.count("b"),
                            "duplicate": faults.count("d"), "truncated": faults.count("t"),
                            "audits": audits, "exits": exits, "costs": costs})
            yield pa.RecordBatch.from_pylist(out, ARROW_TRACED)

    return chunks.mapInArrow(work, TRACED)


def entered(traced: DataFrame) -> DataFrame:
    """``conv, chunk, entry`` of all chunks but the first of a conversation.

    A chunk knows which state it is entered in for each state that another chunk, some way back, is
    entered in. Where that chunk knows its own, or all four lead to the same one, it is found;
    otherwise what both know is put together and the way back doubles.
    """
    later = traced.filter(F.col("chunk") > 0).select("conv", "chunk")
    before = traced.select("conv", (F.col("chunk") + 1).alias("chunk"), "exits")
    known = later.join(before, ["conv", "chunk"]).withColumn("back", F.lit(1).cast("long"))

    def settled(rows: DataFrame) -> DataFrame:
        first = F.col("chunk") == F.col("back")
        same = F.size(F.array_distinct("exits")) == 1
        return rows.withColumn("entry", F.when(first | same, F.col("exits")[0]))

    known = cut(settled(known))
    while not known.filter("entry IS NULL").isEmpty():
        there = known.select("conv", F.col("chunk").alias("other"), F.col("exits").alias("there"),
                             F.col("back").alias("further"), F.col("entry").alias("known"))
        open_ones = known.filter("entry IS NULL").withColumn("other", F.col("chunk") - F.col("back")).join(there, ["conv", "other"])
        linked = F.transform("there", lambda s: F.col("exits")[s])
        moved = open_ones.select(
            "conv", "chunk",
            F.when(F.col("known").isNotNull(), F.array(F.col("exits")[F.col("known")])).otherwise(linked).alias("exits"),
            (F.col("back") + F.col("further")).alias("back"))
        known = cut(known.filter("entry IS NOT NULL").unionByName(settled(moved)))
    return known.select("conv", "chunk", "entry")


def row_edits(chosen: DataFrame, size: int) -> DataFrame:
    """``conv, place, inserted, role``: for each row that stays or has turns put before it, the roles of
    these, and its own role, ``=`` for the one it had, null if it goes or if it is the end."""
    schema = "conv string, place long, inserted array<string>, role string"
    arrow = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("inserted", pa.list_(pa.string())), ("role", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for row in rows.to_pylist():
                state, place, inserted, i = row["entry"], row["chunk"] * size, [], 0
                for letter in row["audit"]:
                    if letter == "I":
                        inserted.append(NEXT_ROLE[state])
                        state = NEXT[state]
                        continue
                    role = {"K": "=", "R": NEXT_ROLE[state], "D": None}[letter]
                    if letter == "K":
                        state = KEEP[state, row["initials"][i]]
                    elif letter == "R":
                        state = NEXT[state]
                    if role or inserted:
                        out.append((row["conv"], place, inserted, role))
                    place, i, inserted = place + 1, i + 1, []
                if inserted:
                    out.append((row["conv"], place, inserted, None))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return chosen.select("conv", "chunk", "initials", "entry", "audit").mapInArrow(work, schema)


def repair_conversations(turns: DataFrame, chunk: int = CHUNK) -> Repair:
    """Repair the conversations of ``conv_id, turn, role, text``.

    Rows are ordered by turn, null first, then role and digest of the text, so ties and repeated rows
    have a fixed order. A null role or text counts as one space; a role is judged by its first letter,
    and one that is empty or begins with another letter than s, u or a cannot be kept. Rows with a null
    ``conv_id`` are one conversation. Long texts are read whole, other columns are not read, an empty
    table gives empty results.
    """
    small_batches(turns.sparkSession)
    rows = marked_rows(turns)
    traced = cut(trace_chunks(converge(cut(chunk_rows(rows, chunk)))))
    entries = entered(traced)
    state = F.coalesce("entry", F.lit(0))
    chosen = cut(traced.join(entries, ["conv", "chunk"], "left").withColumn("entry", state)
                 .withColumns({"audit": F.col("audits")[F.col("entry")], "cost": F.col("costs")[F.col("entry")]}))
    last, first = F.substring("initials", -1, 1), F.substring("initials", 1, 1)
    ends = (chosen.select("conv", (F.col("chunk") + 1).alias("chunk"), last.alias("one"))
            .join(chosen.select("conv", "chunk", first.alias("two")), ["conv", "chunk"])
            .filter(~F.concat("one", "two").isin("su", "ua", "au")).groupBy("conv").agg(F.count("*").alias("between")))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    audits = chosen.groupBy("conv").agg(
        *(F.sum(c).alias(c) for c in counts),
        F.array_join(F.array_sort(F.collect_list(F.struct("chunk", "audit")))["audit"], "").alias("audit"))
    spans = rows.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    audits = (spans.join(audits, "conv").join(ends, "conv", "left")
              .withColumn("illegal", F.col("illegal") + F.coalesce("between", F.lit(0))).drop("between"))
    edits = row_edits(chosen, chunk)
    own = F.when(F.col("e.role").isNotNull(), F.array(F.struct(
        F.when(F.col("e.role") == "=", F.col("r.role")).otherwise(F.col("e.role")).alias("role"), F.col("r.text").alias("text"))))
    inserted = F.transform("inserted", lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    joined = edits.alias("e").join(rows.alias("r"), ["conv", "place"], "left").select(
        "conv", "place", F.posexplode(F.when(own.isNull(), inserted).otherwise(F.concat(inserted, own))).alias("part", "turn"))
    repaired = joined.select("conv", "place", "part", "turn.role", "turn.text")
    return Repair(audits, repaired)


def turn_digests(repaired: DataFrame) -> DataFrame:
    """``conv, repaired_sha256``: the digest of each conversation's ``role:text`` lines, joined by line ends.

    The digest of a conversation takes in its lines one after the other, so they pass through one task,
    a batch at a time; nothing of them is kept.
    """
    schema = "conv string, repaired_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        for rows in batches:
            done = []
            for conv, role, text in zip(*(rows[c].to_pylist() for c in ("conv", "role", "text"))):
                if conv != name:
                    if name is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield batch(schema, conv=[c for c, _ in done], repaired_sha256=[d for _, d in done])
        if name is not None:
            yield batch(schema, conv=[name], repaired_sha256=[digest.hexdigest()])

    ordered = repaired.repartition("conv").sortWithinPartitions("conv", "place", "part")
    return ordered.select("conv", "role", "text").mapInArrow(work, schema)


def damage(turns: DataFrame) -> DataFrame:
    """Damage rows by the crc32 of ``conv_id:turn`` (nulls: one space) modulo 20: 0 drops a row, 1 empties its
    text, 2 takes its stops away, 3 repeats it, 4 makes it the user's."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    kind: Column = F.col("kind")
    return (turns.withColumn("kind", F.crc32(name) % 20).filter(kind != 0)
            .select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
                    F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                    F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy")).drop("copy"))


def repair_digests(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Damage the conversations, repair them, and give a row for each of them, also for those without rows."""
    found = repair_conversations(damage(turns), chunk)
    all_of_them = turns.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", name_of(F.col("conv_id")).alias("conv"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    joined = (all_of_them.join(found.audits.drop("conv_id"), "conv", "left").join(turn_digests(found.turns), "conv", "left"))
    return joined.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
