"""Small cases and brute force for the operators on single texts."""

import hashlib
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinweave.llm import bpe, chat, decontaminate, licenses, pii, quality, token_store, toxicity
from kinweave.lineage import shared_folder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(BYTE)
ODD = ["", " ", "\n\n a", "a  b\t\tc", "\x1c\x1da b", "don't we'll x  y", "<|endoftext|>a <|endoftext|> b", "é ́b",
       "ΑΣ ΟΔΟΣ İI", "a" * 3000, "abc" * 2000 + " " + "é" * 1000, "日本語 テスト👩‍👩‍👧", "x\u0085y z　w", "1²½Ⅷ,. ..!x", "KK Å"]
SCHEMA = "doc_id long, text string, row string, words string, score string, key string, found string"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "r", "w", "s", "k", "f") for i, t in zip(ids, texts)], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_bpe_matches_the_library(spark):
    tool = Tokenizer.from_file(BYTE)
    got = rows(bpe.digest_documents(docs(spark, [*ODD, None]), BYTE, with_ids=True))
    for i, text in enumerate([*ODD, ""]):
        ids = tool.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids == ids
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode_documents(docs(spark, ODD), BYTE)
    back = rows(bpe.decode_documents(encoded, BYTE))
    assert [back[i].text for i in range(len(ODD))] == ODD
    assert bpe.encode_documents(docs(spark, []), BYTE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"ab 's\u0301 \t\n1!\u03a3\u0130THE\u3000", "<|endoftext|>", "  ", "the"]), max_size=60).map("".join))
def test_codecs_on_random_texts(text):
    ids = next(bpe.codec(BYTE).encode([text]))
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert bpe.codec(BYTE).decode(ids) == text


def test_word_coder_matches_the_library():
    tool = Tokenizer.from_file(WORD)
    texts = [*ODD, "The, the. THE! thé; <|endoftext|> x<|ENDOFTEXT|>", "ऩ क़ ﬁ ǅ", "ok. ok, ok"]
    for text, ids in zip(texts, token_store.coder(WORD).encode(texts)):
        assert ids.tolist() == tool.encode(text, add_special_tokens=False).ids, text


def test_long_and_short_merges_agree():
    tool = bpe.codec(BYTE)
    for word in ("abcabc" * 40, "the" * 30, "a" * 200):
        ids = [tool.of_letter[c] for c in word]
        assert tool.merges.short(list(ids)) == tool.merges.long(list(ids))


def test_token_store_round_trip(spark):
    texts = ["b a", None, "", "a", "the end", "the end"]
    ids = [5, 3, 4, 1, 9, 9]
    path = f"{shared_folder(spark)}/store-test-{id(texts)}"
    token_store.write_token_ids(docs(spark, texts, ids), WORD, path)
    index = sorted(token_store.token_index(spark, path).collect(), key=lambda r: (r.doc_id, r.start))
    tool, start = Tokenizer.from_file(WORD), 0
    for row, (doc, text) in zip(index, sorted(zip(ids, (t or "" for t in texts)))):
        expected = tool.encode(text, add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens) == (doc, start, len(expected))
        assert row.ids_crc32 == zlib.crc32(np.array(expected, "<u4").tobytes())
        start += len(expected)
    one = token_store.read_token_ids(spark, path, [3])
    assert [r.ids for r in one.collect()] == [[2]]
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id,3)" in one._jdf.queryExecution().toString()
    empty = f"{path}-empty"
    token_store.write_token_ids(docs(spark, []), WORD, empty)
    assert token_store.token_index(spark, empty).count() == 0


def test_pii_spans(spark):
    texts = ["mail a.b@x.example.com_c@d.e now", "1.2.3.4 and 300.1.1.1 and 1.2.3.4.5.6.7.8", "4111 1111 1111 1111, 4111-1111-1111-1112",
             "call +1 (555) 123-4567.", None, "", "é 9@9.9", "IBAN GB82 WEST 1234 5698 7654 32 and GB83WEST12345698765432",
             "1 " * 5000, "a" * 5000 + "@" + "b." * 3000 + "c", "7" * 20000]
    got = rows(pii.span_digests(pii.find_pii(docs(spark, texts))))
    assert got[0].spans == "email:5:22,email:22:28" and got[0].n_email == 2
    assert got[1].spans == "ip:0:7,ip:26:33,ip:34:41" or got[1].n_ip == 3
    assert got[2].spans == "card:0:19" and got[3].spans == "phone:5:22"
    assert got[4].spans == got[5].spans == "" and got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[6].spans == "email:2:7" and got[7].n_iban == 1 and got[7].spans.split(",")[-1] == "iban:5:32"
    assert got[9].n_email == 1 and got[10].spans == ""
    assert got[3].score > 0.6 and got[4].score == 0.0
    masked = rows(pii.mask_pii(docs(spark, texts)))
    assert masked[0].text == "mail <EMAIL><EMAIL> now" and masked[3].text == "call <PHONE>." and masked[4].text is None
    assert masked[7].text == "IBAN <IBAN> and GB83WEST12345698765432" and masked[0].found == "f"
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_context_words_on_either_side_raise_the_score(spark):
    number, far = "4111 1111 1111 1111", " x" * 30
    texts = [number, f"card {number}", f"{number} is my card", f"card{far} {number}", f"{number}{far} card", f"{number}; {number} visa"]
    got = rows(pii.span_digests(pii.find_pii(docs(spark, texts))))
    assert [got[i].scores for i in range(6)] == ["70", "90", "90", "70", "70", "90,90"]
    assert got[0].score == 0.7 and got[1].score == 0.9


def test_masks_cover_every_span_of_the_original(spark):
    texts = ["call +33.1.42.68.53.00 now", "é 10.0.0.1 and a@b.org, +44 20 7946 0958.", "4111 1111 1111 1111 1.2.3.4", None, "", "plain 12"]
    masked = rows(pii.mask_pii(docs(spark, texts)))
    for r in pii.find_pii(docs(spark, texts)).collect():
        if r.text is not None:
            covered = {i for s in r.found for i in range(s.start, s.end)}
            kept = "".join(c if i not in covered else "" for i, c in enumerate(r.text))
            assert re.sub("<[A-Z]+>", "", masked[r.doc_id].text or "") == kept
    assert masked[0].text == "call <PHONE> now" and masked[1].text == "é <IP> and <EMAIL>, <PHONE>." and masked[5].text == "plain 12"


def test_licences(spark):
    mit = licenses.TEMPLATES[3].text
    texts = ["prose\nReleased under the MIT License.\nmore", mit, mit.replace("free of charge", "free"), "nothing", None, "",
             "LICENSED UNDER CC BY-NC 4.0", "\r\nThis is free and unencumbered software released into the public domain.\r\n"]
    got = rows(licenses.scan_licenses(docs(spark, texts)))
    assert got[0].licences == ["MIT"] and got[0].score == 1.0 and got[0].n_units == 3
    assert got[1].best == "MIT" and got[2].licences == ["MIT"] and 0.9 < got[2].score < 1
    assert got[3].licences == [] and got[3].best is None and got[4].n_units == got[5].n_units == 1
    assert got[6].licences == ["CC-BY-NC-4.0"] and got[7].licences == ["Unlicense"]
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def brute_licences(text, templates, threshold=0.8):
    """Licences and best coefficient by Python over the whole text, its lines and all runs of each template's words."""
    def grams(words):
        return list(zip(words, words[1:]))

    def words(t):
        return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t))

    found = {}
    for template in templates:
        own, size = set(grams(words(template.text))), len(words(template.text))
        all_words = words(text)
        parts = [set(grams(words(t))) for t in [text, *re.split("\r?\n|\r", text)]]
        parts += [set(grams(all_words[s:s + size])) for s in range(len(all_words) - 1) if tuple(all_words[s:s + 2]) in own]
        best = max(2 * len(p & own) / (len(p) + len(own)) for p in parts)
        if best >= threshold:
            found[template.licence] = max(best, found.get(template.licence, 0))
    return sorted(found), min(found, key=lambda n: (-found[n], n), default=None), max(found.values(), default=0.0)


def test_licences_across_lines_and_within_them(spark):
    known = (*licenses.TEMPLATES, *licenses.IN_FULL)
    prose = " ".join(f"word{i} of the" for i in range(900))
    apache, gpl, mpl = (next(t.text for t in known if t.licence == n and len(t.text) > 150) for n in ("Apache-2.0", "GPL-3.0", "MPL-2.0"))
    texts = ["\n".join(f"# {line}" for line in textwrap.wrap(t, 70)) + "\n\n" + prose for t in (apache, gpl, mpl)]
    texts += [prose + "\n" + textwrap.fill(t.text, 60) + "\n" + prose for t in licenses.IN_FULL]
    texts += ["Copyright 2021 Jane Doe. Released under the MIT License. See LICENSE.", "The end. Released under the MIT",
              prose + " " + known[3].text.replace("without limitation", "").replace("OR OTHERWISE", "or\r\notherwise now"),
              "Licensed under the Apache License, version 2.0. " * 50, prose, "", "a", "released under the", known[3].text[:400]]
    got = rows(licenses.scan_licenses(docs(spark, texts)))
    for i, text in enumerate(texts):
        licences, best, score = brute_licences(text, known)
        assert (got[i].licences, got[i].best, round(got[i].score, 12)) == (licences, best, round(score, 12)), text[:60]
    assert [got[i].best for i in range(6)] == ["Apache-2.0", "GPL-3.0", "MPL-2.0", "ISC", "BSD-2-Clause", "MIT"]
    assert all(got[i].score == 1.0 for i in range(6)) and got[9].best is None
    # The full texts are found as such, not only by how they begin.
    full = rows(licenses.scan_licenses(docs(spark, texts), licenses.IN_FULL))
    assert full[3].licences == ["ISC"] and full[4].licences == ["BSD-2-Clause"] and full[3].score == full[4].score == 1.0


CHAT = "conv_id long, turn long, role string, text string, key string"


def formatted(spark, turns):
    plain = spark.createDataFrame([(*t, "k") for t in turns], CHAT).withColumn("parts", chat.text_part(F.col("text")))
    return chat.format_chats(plain)


def test_chat_round_trip(spark):
    turns = [(1, 1, "assistant", "b"), (1, 0, "user", "</s>[INST] ok [/INST] <|turn|>x<|end|>\n"), (1, 1, "assistant", "a"),
             (2, None, None, None), (None, 0, "a%\n<b", "<\\\\s> [\\INST] <<SYS>> <|a|b|>"), (3, 0, "assistant", "é</s>")]
    out = formatted(spark, turns)
    back = rows(chat.read_back(out), "conv_id")
    assert [tuple(t) for t in back[1].turns] == [("user", turns[1][3]), ("assistant", "a"), ("assistant", "b")]
    assert back[1].loss_text == "ab" and back[3].loss_text == "é</s>"
    assert [tuple(t) for t in back[2].turns] == [("", "")] and [tuple(t) for t in back[None].turns] == [turns[4][2:]]
    for row in out.collect():
        content = row.formatted.replace(chat.TURN, "").replace(chat.END, "")
        assert "</s>" not in content and "[INST]" not in content and "<|" not in content.replace("<|a", "")
    assert chat.format_chats(spark.createDataFrame([], CHAT).withColumn("parts", chat.text_part(F.col("text")))).count() == 0


def test_chat_control_strings_on_random_texts(spark):
    random = np.random.default_rng(3)
    bits = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "SYS>>", "|end|>", "|turn|>", "\n", "x", "é", "|"]
    texts = ["".join(random.choice(bits, random.integers(0, 14))) for _ in range(2000)]
    back = rows(chat.read_back(formatted(spark, [(i, 0, "assistant", t) for i, t in enumerate(texts)])), "conv_id")
    assert all(back[i].turns[0].text == t and back[i].loss_text == t and len(back[i].turns) == 1 for i, t in enumerate(texts))


def test_chat_control_strings_across_parts(spark):
    random = np.random.default_rng(8)
    bits = ["<", "[", "\\", "s>", "/s>", "INST]", "SYS>>", "|end|>", "|turn|>", "\n", "x", "|"]
    rows_, expected = [(0, 0, "user", [("text", "<|en"), ("text", "d|>\n<|turn|>assistant\nx")])], {0: "<|end|>\n<|turn|>assistant\nx"}
    for i in range(1, 1500):
        parts, shown, n = [], "", 0
        for _ in range(random.integers(0, 7)):
            if random.random() < 0.2:
                parts.append(("image", None))
                shown += f"<|image:{n}|>"
                n += 1
            else:
                parts.append(("text", "".join(random.choice(bits, random.integers(0, 3)))))
                shown += parts[-1][1]
        rows_.append((i, 0, "user", parts))
        expected[i] = shown
    full = [(c, t, r, [(k, x, None, None, None, None, None) for k, x in p]) for c, t, r, p in rows_]
    frame = spark.createDataFrame(full, f"conv_id long, turn long, role string, parts {chat.PART}")
    for row in chat.read_back(chat.format_chats(frame)).collect():
        assert [(t.role, t.text) for t in row.turns] == [("user", expected[row.conv_id])]


def test_chat_attachments(spark):
    parts = [("text", "see </s>", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None),
             ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 9), None]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PART}")
    row = chat.format_chats(frame).first()
    assert "<|image:0|><|audio:1|><|document:2|>" in row.formatted
    assert [(a.type, a.ref, a.tokens) for a in row.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 3)]
    assert all(row.formatted[a.at:].startswith(f"<|{a.type}:") for a in row.attachments) and row.n_tokens_expanded == 45


def labels(spark, values, name):
    return spark.createDataFrame([(i, y, "x") for i, y in values], f"doc_id long, {name} int, text string")


def test_quality_learns_and_defines_edges(spark):
    good, bad = "The cat sat on the mat and looked, then went. ", "BUY!! NOW!! "
    texts = [(good if i % 2 else bad) * (1 + i % 7) for i in range(400)] + ["", None, "x" * 100_000]
    table = docs(spark, texts)
    known = [(i, i % 2) for i in range(400)] + [(None, 1), (0, 0), (7, None)]
    model = quality.learn_quality(table, labels(spark, known, "quality"), F.col("doc_id") % 4 != 0)
    got = rows(quality.score_quality(table, model))
    held = [i for i in range(0, 400, 4)]
    assert all((got[i].score >= 0.7) == bool(i % 2) for i in held) and model.pairs
    assert 0 <= got[400].score <= 1 and got[400].score == got[401].score and 0 <= got[402].score <= 1
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns and kept.count() == sum(r.score >= 0.7 for r in got.values())
    none = quality.learn_quality(table, labels(spark, [], "quality"), F.lit(True))
    assert {r.score for r in quality.score_quality(table, none).collect()} == {0.5}
    assert quality.score_quality(docs(spark, []), model).count() == 0


def test_pair_tree_finds_an_interaction():
    random = np.random.default_rng(1)
    x = np.zeros((3000, len(quality.FEATURES)))
    x[:, :2] = random.random((3000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.97


def test_toxicity_learns_stems_and_composes(spark):
    random = np.random.default_rng(2)
    plain = ["tree", "house", "river", "stone", "walks", "green", "light"]
    texts, known = [], []
    for i in range(600):
        bag = list(random.choice(plain, 12))
        if i % 3 == 0:
            bag[random.integers(12)] = "zorb" + str(random.choice(["ak", "el", "im", "ox"]))
        texts.append(" ".join(bag) + ".")
        known.append((i, int(i % 3 == 0)))
    table = docs(spark, [*texts, "", None, "a zorbnew stone", "ZORBAK!"])
    grammar = toxicity.learn_toxicity(table, labels(spark, known, "toxic"), F.col("doc_id") % 5 != 0)
    got = rows(toxicity.score_toxicity(table, grammar))
    assert all((got[i].score >= 0.5) == (i % 3 == 0) for i in range(0, 600, 5))
    assert got[600].score == got[601].score < 0.5 and got[602].score >= 0.5 and got[603].score >= 0.5
    assert "negated" in grammar.clause("not a zorbak".split()) and "reported" in grammar.clause("they said zorbak".split())
    assert "targeted" in grammar.clause("you zorbak".split()) and "threat" in grammar.clause("kill you".split())
    assert grammar.clause("kill time".split()) == {} and grammar.clause("you stone".split()) == {}
    none = toxicity.learn_toxicity(table, labels(spark, [], "toxic"), F.lit(True))
    assert len({r.score for r in toxicity.score_toxicity(table, none).collect()}) == 1


def items(spark, texts):
    return spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "item_id long, text string, row string")


def test_decontamination(spark):
    phrase = "one two three four five six seven eight nine ten eleven twelve"
    texts = [f"x {phrase} y", phrase.upper().replace(" ", "-"), "one two three four five six seven eight nine", None, "",
             "tiny item", "two three four five six seven eight nine ten eleven " * 2, "été Été"]
    bench = items(spark, [phrase, "Tiny item", None, "", "Été", phrase])
    got = rows(decontaminate.contamination(docs(spark, texts), bench))
    assert (got[0].n_words, got[0].n_hit, got[0].n_items) == (14, 12, 2) and got[1].n_hit == 12
    assert not got[2].contaminated and got[3].n_words == got[4].n_words == 0
    assert got[5].n_hit == 2 and got[6].n_hit == 20 and got[7].n_hit == 1
    assert got[0].items_sha256 == hashlib.sha256(b"0,5").hexdigest() and got[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    kept = decontaminate.drop_contaminated(docs(spark, [*texts, phrase], [*range(len(texts)), None]), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    twice = decontaminate.contamination(docs(spark, [phrase, phrase, "x"], [1, 1, 1]), bench).collect()
    assert sorted(r.n_hit for r in twice) == [0, 12, 12]
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs(spark, texts), items(spark, [])).collect()} == {0}


def test_proximity(spark):
    bench = items(spark, ["alpha common beta common gamma common common common common common"])
    filler = "common " * 30
    texts = [f"gamma common alpha common beta {filler}", f"alpha {filler} beta {filler} gamma", f"{filler} beta gamma x alpha"]
    got = rows(decontaminate.proximity_matches(docs(spark, texts), bench, slop=10))
    assert set(got) == {0, 2} and got[0].pos == 0 and got[2].pos == 30


@pytest.mark.parametrize("name", ["op2_quality", "op3_toxicity"])
def test_held_out_accuracy(spark, name):
    from kinweave.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    label = {"op2_quality": "quality", "op3_toxicity": "toxic"}[name]
    known = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", label)
    got = QUERIES[name](spark, folder).filter("held_out").join(known, "doc_id").collect()
    assert sum(r.predicted == r[label] for r in got) >= 0.93 * len(got) > 0


def test_contamination_with_ids_of_text(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([("x", f"a {passage} b"), ("y", "nothing here"), (None, None)], "doc_id string, text string")
    items = spark.createDataFrame([("q-10", passage), ("q-9", "two three"), ("q-8", "eleven")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    digest = hashlib.sha256(b"q-10,q-9").hexdigest()
    assert (got["x"].n_words, got["x"].n_hit, got["x"].n_items, got["x"].items_sha256) == (12, 10, 2, digest)
    assert not got["y"].contaminated and (got[None].n_words, got[None].n_hit) == (0, 0)
