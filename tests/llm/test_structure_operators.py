"""Merkle manifest, packing and conversation repair against brute force."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinweave.llm import merkle, packing, places, repair

BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, source string, lang string, n_chars long, text string, tree string, place long, chunk long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Merkle manifest


def test_resumed_states_give_sha256():
    draw = random.Random(1)
    digests = [bytes(draw.randrange(256) for _ in range(32)) for _ in range(5)]
    words = merkle.to_words(digests)
    state = np.repeat(merkle.BEGIN, 5, 1)
    for blocks in (1, 2, 3):
        state = merkle.resume(state, merkle.text_block(words))
        found = merkle.hex_digests(merkle.finish(state, np.full(5, blocks)))
        assert found == [sha(d.hex() * blocks) for d in digests]


def brute_manifest(rows, changed):
    """By row number: (leaf, subroot, root, proof, folded root)."""
    def leaf(row, text):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    groups = {}
    for n, row in enumerate(rows):
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row, row[4]), n))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = {}
    for s in order:
        for i, (_, _, own, n) in enumerate(sorted(groups[s])):
            now, siblings = leaf(rows[n], changed(rows[n])), []
            for tree, at in ((trees[s], i), (top, order.index(s))):
                for level in tree[:-1]:
                    run = list(level[at // 3 * 3:at // 3 * 3 + 3])
                    siblings += run[:at % 3] + run[at % 3 + 1:]
                    run[at % 3] = now
                    now, at = sha(*run), at // 3
            out[n] = (own, trees[s][-1][0], top[-1][0], sha(*siblings), now)
    return out


def manifest_rows(spark, rows):
    docs = spark.createDataFrame([(*r, "t", 7, 7) for r in rows], DOC).repartition(3)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0,
                      F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    manifest = merkle.build_manifest(merkle.document_leaves(docs, tampered), "source", ["doc_id"], "leaf")
    found = merkle.fold_replaced(manifest, "leaf", "changed", ["doc_id"]).collect()
    return sorted(tuple(r) for r in found if r.doc_id is not None), [tuple(r) for r in found if r.doc_id is None]


def tampered(row):
    if row[4] is None or row[0] is None or zlib.crc32(str(row[0]).encode()) % 2:
        return row[4]
    return row[4].replace("\n", "")


def test_manifest_matches_brute_force(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i, draw.choice([None, "", "é", "a", "b", "b", "b", "b"]), draw.choice(["en", None]), draw.choice([None, -5, 12]),
             draw.choice([None, "", "one\ntwo", "é\n", "x" * 50_000 + "\n"])) for i in range(400)]
    rows += [(7, "b", "en", 1, "again\n"), (7, "b", "en", 1, "again\n"), (None, "b", None, None, "no id\n"), (500, "alone", "en", 1, "\n")]
    for height in (7, 2):  # one storey, and several
        monkeypatch.setattr(merkle, "HEIGHT", height)
        known, nameless = manifest_rows(spark, rows)
        expected = brute_manifest(rows, tampered)
        assert known == sorted((rows[n][0], *e) for n, e in expected.items() if rows[n][0] is not None)
        assert nameless == [(None, *expected[402])]


def test_manifest_of_few_rows(spark):
    assert manifest_rows(spark, []) == ([], [])
    rows = [(2, "a", "en", 3, "a\nb")]
    known, _ = manifest_rows(spark, rows)
    assert known == [(2, *brute_manifest(rows, tampered)[0])]
    assert known[0][4] == sha("")


def test_places_split_equal_rows(spark):
    rows = [("g" if i % 3 else "h", i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "name string, v int").repartition(5)
    placed = places.with_places(df, "name", ["v"]).collect()
    for name in "gh":
        own = sorted((r.place, r.v) for r in placed if r.name == name)
        assert [p for p, _ in own] == list(range(len(own)))
        assert [v for _, v in own] == sorted(v for _, v in own)


# Packing


def packed_rows(spark, pairs, length=2048):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in pairs], "doc_id long, text string, ids string, start int").repartition(2)
    return packing.piece_digests(packing.pack_documents(docs, BYTES, length)).collect(), packing.pack_documents(docs, BYTES, length).collect()


def test_packing_keeps_every_id(spark):
    draw = random.Random(5)
    pairs = [(i, " ".join(draw.choice(["word", "Étion", "<|endoftext|>", "12", "ab.", "\n\n"]) for _ in range(draw.choice([0, 3, 40, 300, 5000]))))
             for i in range(60)] + [(100, None), (101, ""), (101, ""), (None, "no id")]
    digests, pieces = packed_rows(spark, pairs)
    tool = Tokenizer.from_file(BYTES)
    expected = sorted((-1 if i is None else i, tuple(tool.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in pairs)
    texts, sequences = {}, {}
    for p in pieces:
        assert p.length == len(p.ids) > 0
        texts.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    found = []
    for (doc_id, n), own in texts.items():
        own.sort(key=lambda p: p.start)
        repeats = sum(p.start == 0 for p in own)
        assert sum(p.length for p in own) == n * repeats
        if repeats == 1:
            assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
            found.append((-1 if doc_id is None else doc_id, tuple(i for p in own for i in p.ids)))
    assert sorted(found) == [e for e in expected if e[0] != 101]
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in own])
        assert [p.offset for p in own] == [0, *ends[:-1]] and {p.sequence_tokens for p in own} == {ends[-1]}
        assert ends[-1] <= 2048 and ends[-1] & (ends[-1] - 1) == 0
    crc = {(p.sequence_id, p.offset): zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in pieces}
    assert sorted(crc.values()) == sorted(d.ids_crc32 for d in digests)


def test_packing_of_an_empty_table(spark):
    assert packed_rows(spark, []) == ([], [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40))
def test_assignment_takes_the_cheapest_sequence(lengths):
    pieces = [(i, 0, n) for i, n in enumerate(lengths)]
    count = sum(lengths) // 16
    held, over = packing.assign(pieces, count, 16, 8)
    # The same rule with plain lists.
    cost, room, waiting, expected, rest = [0.0] * count, [16] * count, [(-n, i, 0) for i, n in enumerate(lengths)], [[] for _ in range(count)], []
    heapq.heapify(waiting)
    while waiting:
        n, i, start = heapq.heappop(waiting)
        fits = [s for s in range(count) if room[s] >= -n] or [s for s in range(count) if room[s]]
        if not fits:
            rest.append((i, start, -n))
            continue
        to = min(fits, key=lambda s: (cost[s], s))
        taken = min(-n, room[to])
        expected[to].append((i, start, taken))
        cost[to] += taken + taken * taken / 8
        room[to] -= taken
        if taken < -n:
            heapq.heappush(waiting, (n + taken, i, start + taken))
    assert (held, over) == (expected, rest)
    assert all(sum(n for _, _, n in s) == 16 for s in held) and sum(n for _, _, n in over) < 16
    assert sorted(n for s in packing.powers(over) for _, _, n in s if n) == sorted(n for s in packing.powers(over) for _, _, n in s)


def test_balanced_cost():
    draw = random.Random(2)
    pieces = [(i, 0, draw.randrange(1, 2048)) for i in range(4000)]
    count = sum(n for _, _, n in pieces) // 2048
    held, _ = packing.assign(pieces, count, 2048, packing.EVEN)
    cost = np.array([sum(n + n * n / packing.EVEN for _, _, n in s) for s in held])
    first_fit = np.array([2048 + 2048 * 2048 / packing.EVEN, 2048 + 2048 / packing.EVEN])
    assert cost.max() - cost.min() < (first_fit[0] - first_fit[1]) * 0.95 and cost.std() / cost.mean() < 0.05


# Conversation repair


def brute_repair(rows):
    """Cheapest edits of ``(role, text, fault)`` rows, the first in ASCII order: cost, audit, repaired turns."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    done: set = set()
    queue = [(0, "", 0, "", ())]
    while queue:
        cost, audit, i, last, lines = heapq.heappop(queue)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(lines)
        if (i, last) in done:
            continue
        done.add((i, last))
        for role in ("user", "assistant"):
            if role[0] in follow[last]:
                heapq.heappush(queue, (cost + 5, audit + "I", i, role[0], (*lines, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, last, lines))
            if fault not in ("b", "d"):
                extra = 5 if fault == "t" else 0
                for new in ("user", "assistant"):
                    if new[0] in follow[last]:
                        heapq.heappush(queue, (cost + extra + 1, audit + "R", i + 1, new[0], (*lines, (new, text))))
                if role[:1] and role[0] in follow[last]:
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, role[0], (*lines, (role, text))))
    raise AssertionError("no way")


def expected_repairs(rows):
    conversations = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        conversations.setdefault(conv, []).append((turn is not None, turn or 0, role, sha(text), text))
    out = {}
    for conv, own in conversations.items():
        own.sort()
        seen, marked = set(), []
        for _, _, role, _, text in own:
            shown = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "b" if not shown else "d" if (role, text) in seen else "." if shown[-1] in ".!?" else "t"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for there, t, *_ in own if there]
        faults = [f for *_, f in marked]
        initials = [r[:1] for r, _, _ in marked]
        cost, audit, lines = brute_repair(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, lines)
    return out


CONV = "conv_id long, turn long, role string, text string, place string, part int, conv string"


def found_repairs(spark, rows, chunk):
    turns = spark.createDataFrame([(*r, "p", 1, "c") for r in rows], CONV).repartition(3)
    done = repair.repair_conversations(turns, chunk)
    lines = {}
    for r in sorted(done.turns.collect(), key=lambda r: (r.conv, r.place, r.part)):
        lines.setdefault(r.conv, []).append((r.role, r.text))
    digests = {r.conv: r.repaired_sha256 for r in repair.turn_digests(done.turns).collect()}
    assert digests == {c: sha("\n".join(f"{role}:{text}" for role, text in own)) for c, own in lines.items()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, lines.get(r.conv, []))
            for r in done.audits.collect()}


def test_repairs_match_brute_force(spark):
    draw = random.Random(11)
    texts = ["Yes.", "No!", "Why?", "cut", "", " \n", "Well.  ", None, "x" * 40_000 + "."]
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(draw.choice([1, 2, 5, 9, 25])):
            rows.append((conv, draw.choice([None, *range(30)]), draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
                         draw.choice(texts) if draw.random() < 0.4 else f"{draw.random()}."))
    rows += [(99, i, "user" if i % 2 else "assistant", f"{i}.") for i in range(60)] + [(98, 1, "user", "same.")] * 12
    expected = expected_repairs(rows)
    for chunk in (1024, 4, 1):
        assert found_repairs(spark, rows, chunk) == expected


def test_repair_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_digests(empty).collect() == []


def test_conversation_whose_rows_are_all_dropped(spark):
    rows = [(c, 0, "user", "Hi.") for c in range(60)]
    found = {r.conv_id: r for r in repair.repair_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    gone = [c for c in range(60) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone and len(found) == 60
    for c in gone:
        assert (found[c].cost, found[c].audit, found[c].repaired_sha256) == (0, "", sha(""))
