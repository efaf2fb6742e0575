"""Readers, sinks and the stream."""

import json

from pyspark.sql import functions as F

from kinweave.operators.review import intake
from kinweave.sources import readers, sinks
from kinweave.streaming.intake import SUBMISSION, read_submissions, start_intake


def test_missing_files_give_empty_tables(spark, tmp_path):
    assert readers.read_entities(spark, str(tmp_path / "none.json")).count() == 0
    assert readers.read_relationships(spark, str(tmp_path / "none.json")).columns[0] == "seq"


def test_relationship_file_keeps_its_order(spark, tmp_path):
    rows = [{"source_name": f"a{i}", "target_name": "b", "relationship": "ALLY_OF"} for i in range(5)]
    (tmp_path / "r.json").write_text(json.dumps({"_comment": "x", "relationships": rows}, indent=1))
    read = readers.read_relationships(spark, str(tmp_path / "r.json")).collect()
    assert [(r["seq"], r["source_name"], r["confidence"]) for r in read] == [(i, f"a{i}", None) for i in range(5)]


def test_sentences(spark, tmp_path):
    line = {"text": "t", "title": "T", "heading": "", "entities": [{"id": "a", "match": "A"}]}
    (tmp_path / "s.jsonl").write_text(json.dumps(line) + "\n" + json.dumps(line) + "\n")
    assert readers.read_sentences(spark, str(tmp_path / "s.jsonl")).select(F.size("entities")).collect() == [(1,), (1,)]


def test_years_with_and_without_sign(spark):
    dates = spark.createDataFrame([("+1853-01-01T00:00:00Z",), ("-0044-03-15T00:00:00Z",), ("1853-01-01",), ("t123",)], "d string")
    assert [r[0] for r in dates.select(readers.signed_year(F.col("d"))).collect()] == [1853, -44, 1853, None]


def test_detail_page(spark):
    html = ("<div class='mw'><p>A long description of a hero.</p><table><tr><th>出典</th><td>希腊</td></tr><tr><th>地域</th><td>罗马</td></tr>"
            "<tr><th>阵营·属性</th><td>善</td></tr><tr><th>属性</th><td>天</td></tr></table></div>")
    [row] = readers.extract_detail_facts(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert tuple(row) == (1, "希腊", "天", "A long description of a hero.")


def test_graphml_escapes_text(spark, tmp_path):
    v = spark.createDataFrame([("c1", 'A & "B" <C>', None, "K")], "id string, name string, mythology string, class_name string")
    e = spark.createDataFrame([(7, "c1", "c1", "ALLY_OF")], "id long, source_id string, target_id string, type string")
    sinks.write_graphml(v, e, str(tmp_path / "g"))
    text = "".join(p.read_text() for p in (tmp_path / "g" / "nodes").glob("part*"))
    assert "A &amp; " in text and "&lt;C" in text and 'key="d_myth"' in text
    text = "".join(p.read_text() for p in (tmp_path / "g" / "edges").glob("part*"))
    assert 'source="c1"' in text and "ALLY_OF" in text


def test_stream_equals_batch_and_survives_a_repeat(spark, tmp_path):
    rows = [("a", "b", "ALLY_OF", "x"), ("b", "a", "ALLY_OF", "y"), ("a", "b", "PARENT_OF", ""), ("b", "a", "PARENT_OF", ""),
            ("k", "m", "STUDENT_OF", ""), ("m", "k", "MENTOR_OF", ""), ("o", "o2", "NONE", ""), ("old", "er", "ALLY_OF", "")]
    folder = tmp_path / "in"
    folder.mkdir()
    for n, row in enumerate(rows + rows[:2]):
        record = dict(zip(("source_id", "target_id", "type", "evidence"), row), contributor="u", submitted_at=f"2024-01-{n + 1:02}T00:00:00Z")
        (folder / f"{n}.json").write_text(json.dumps(record))
    known = spark.createDataFrame([("er", "old", "ALLY_OF")], "source_id string, target_id string, type string")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    start_intake(read_submissions(spark, str(folder), max_files=3), known, out, state, once=True).awaitTermination()
    (folder / "late.json").write_text(json.dumps({"source_id": "b", "target_id": "a", "type": "ALLY_OF", "submitted_at": "2030-01-01T00:00:00Z"}))
    start_intake(read_submissions(spark, str(folder), max_files=3), known, out, state, once=True).awaitTermination()
    columns = ["source_id", "target_id", "type"]
    batch = intake(spark.read.schema(SUBMISSION).json(str(folder)), known)

    def keys(df):
        return sorted((*(sorted(r[:2]) if r["type"] == "ALLY_OF" else r[:2]), r["type"]) for r in df.select(columns).collect())

    taken = spark.read.parquet(out)
    assert keys(taken) == keys(batch) == [("a", "b", "ALLY_OF"), ("a", "b", "PARENT_OF"), ("b", "a", "PARENT_OF"), ("m", "k", "MENTOR_OF")]
    assert taken.filter("status <> 'pending' OR origin <> 'user' OR confidence <> 'medium'").count() == 0


def test_embedded_csv_with_quotes_and_many_columns(spark):
    extra = ",".join(f"x{i}" for i in range(60))
    lines = [f"id,class_link,{extra},avatar", f'7,"Saber, of ""red""",{extra},//img/7.png', f",none,{extra},", f"8,,{extra},http://y/8"]
    text = "\\n".join(lines).replace('"', '\\"')
    html = f'<script>raw_str = "{text}"; override_data = "id=8\\nname_en = Eight\\nname_cn=\\nid=7\\nname_link=Seven\\n";</script>'
    rows = readers.embedded_csv(spark.createDataFrame([(1, html)], "page_id int, html string"), "http://w").collect()
    found = {r["id"]: (r["name"], r["class"], r["detail_url"], r["image_url"]) for r in rows}
    assert found == {"7": ("Seven", 'Saber, of "red"', "http://w/w/Seven", "https://img/7.png"), "8": ("Eight", "", "", "http://y/8")}


def test_relationship_files_are_numbered_over_all_of_them_and_lines_read_back(spark, tmp_path):
    import json

    def relation(a, b):
        return {"source_name": a, "target_name": b, "relationship": "ALLY_OF", "confidence": "high", "evidence": "",
                "origin": "x", "status": "pending"}

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"relationships": [relation("a", "b"), relation("c", "d")]}, indent=1))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"relationships": [relation("e", "f")]}))
    read = readers.read_relationships(spark, str(tmp_path / "in"))
    assert sorted((r.seq, r.source_name) for r in read.collect()) == [(0, "a"), (1, "c"), (2, "e")]
    read.drop("seq").write.json(str(tmp_path / "out"))
    back = readers.read_relationships(spark, str(tmp_path / "out"))
    assert sorted((r.source_name, r.target_name) for r in back.collect()) == [("a", "b"), ("c", "d"), ("e", "f")]
    assert back.select("seq").distinct().count() == 3


def test_the_last_override_of_a_key_wins(spark):
    html = 'raw_str = "id,avatar\\n1,x"; override_data = "id=1\\nname_cn=zz\\nname_cn=aa";'
    assert readers.embedded_csv(spark.createDataFrame([(1, html)], "page_id long, html string")).first().name == "aa"


def test_graphml_files_in_a_row_are_one_document(spark, tmp_path):
    import xml.etree.ElementTree as ElementTree

    vertices = spark.createDataFrame(
        [("a", 'A <&> "q"', None, "x"), ("b\n", "two\nlines\x01", "m", None), ("c", None, "", "y")],
        "id string, name string, mythology string, class_name string")
    edges = spark.createDataFrame([(1, "a", "b\n", "ALLY_OF"), (2, "c", "a", "X<Y")], "id long, source_id string, target_id string, type string")
    space = "{http://graphml.graphdrawing.org/xmlns}"
    for one_file in (False, True):
        out = tmp_path / f"graph-{one_file}"
        sinks.write_graphml_document(vertices, edges, str(out), one_file)
        files = sorted(out.glob("part-*"))
        assert len(files) == 1 or not one_file
        root = ElementTree.fromstring(b"".join(f.read_bytes() for f in files))
        graph = root.find(f"{space}graph")
        assert {k.get("id") for k in root.findall(f"{space}key")} == {"d_name", "d_myth", "d_class", "e_type"}
        assert {n.get("id"): n[0].text for n in graph.findall(f"{space}node")} == {"a": 'A <&> "q"', "b\n": "two\nlines", "c": None}
        assert {(e.get("id"), e.get("source"), e.get("target"), e[0].text) for e in graph.findall(f"{space}edge")} == {
            ("e1", "a", "b\n", "ALLY_OF"), ("e2", "c", "a", "X<Y")}
        assert [c.tag for c in graph] == [f"{space}node"] * 3 + [f"{space}edge"] * 2
    empty = tmp_path / "empty"
    sinks.write_graphml_document(vertices.limit(0), edges.limit(0), str(empty))
    assert len(ElementTree.fromstring(b"".join(f.read_bytes() for f in sorted(empty.glob("part-*")))).find(f"{space}graph")) == 0


def test_graphml_document_of_several_files_is_read_whole(spark, tmp_path):
    vertices = spark.createDataFrame([(f"c{i}", f" <{i}> & \n\"x\" ", "m", "k") for i in range(40)],
                                     "id string, name string, mythology string, class_name string")
    edges = spark.createDataFrame([(i, f"c{i}", f"c{i + 1}", "ALLY_OF") for i in range(30)],
                                  "id long, source_id string, target_id string, type string")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        sinks.write_graphml_document(vertices, edges, str(tmp_path / "g"))
    finally:
        spark.conf.unset(coalesce)
    assert len(list((tmp_path / "g").glob("part-*"))) > 2
    nodes, links = readers.read_graphml_document(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, nodes.collect())) == sorted((r["id"], r["name"]) for r in vertices.collect())
    assert sorted(map(tuple, links.collect())) == sorted((f"e{r['id']}", *r[1:]) for r in edges.collect())
