"""Reading raw records, sentence corpora, landed replies and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.names import guess_prototype
from kinweave.functions.text import strip, visible_text
from kinweave.operators.ranking import first_per_key, with_position

RAW_ENTITY = ("id string, name string, class string, prototype string, detail_url string, region string, "
              "description string, image_url string")
ENRICHED_ENTITY = ("id string, name string, class string, prototype string, detail_url string, region string, "
                   "description string, mythology_background string, image_url string, aliases array<string>, "
                   "metadata struct<alignment: string, gender: string>, extra map<string, string>, enrich_model string")
RAW_EDGE = ("source_name string, target_name string, relationship string, confidence string, evidence string, "
            "origin string, status string")
SENTENCE = "text string, title string, heading string, entities array<struct<id: string, match: string>>"

# --- fixed values: column heads of an index table, keys of a detail table ------------------------
TABLE_HEADS = {
    "id": r"(?i)编号|No\.?|ID|序号",
    "name": "(?i)真名|名称|英灵|从者|角色",
    "class": "(?i)职阶|Class",
    "region": "(?i)地域|出处|出典|原典|神话",
}
REGION_KEYS = "地域|出典|出处|出身|原典|神话"


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON arrays; a missing path gives an empty table of the same schema."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return read_json_records(spark, path, RAW_ENTITY)


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    return read_json_records(spark, path, ENRICHED_ENTITY)


def read_graphml_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name) and edges (id, source_id, target_id, type) of a document that ``write_graphml_document`` wrote.

    Each element is a line of its own. The files are only a document together, one after the other, so
    an XML reader, which takes each for a whole one, would stop after the first element of most of them.
    """
    lines = spark.read.text(path)
    data = "array<struct<_VALUE: string, _key: string>>"
    exact = {"ignoreSurroundingSpaces": "false", "mode": "FAILFAST"}

    def elements(tag: str, fields: dict[str, str], key: str, name: str) -> DataFrame:
        schema = ", ".join([*(f"{a} string" for a in fields), f"data {data}"])
        read = lines.filter(F.startswith("value", F.lit(f"<{tag} "))).select(F.from_xml("value", schema, exact).alias("x"))
        kept = F.get(F.filter("x.data", lambda d: d["_key"] == key), F.lit(0))["_VALUE"]
        return read.select(*(F.col(f"x.{a}").alias(column) for a, column in fields.items()), F.coalesce(kept, F.lit("")).alias(name))

    return (elements("node", {"_id": "id"}, "d_name", "name"),
            elements("edge", {"_id": "id", "_source": "source_id", "_target": "target_id"}, "e_type", "type"))


def read_relationships(spark: SparkSession, path: str) -> DataFrame:
    """Relations of relationship files, numbered (seq) over all files by name and place.

    A file holds one object with an array of relations, or, as the sinks of this library write them,
    a relation per line; the latter have no place and are ordered by their content.
    """
    fields = ", ".join(f.replace(" ", ": ", 1) for f in RAW_EDGE.split(", "))
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"seq long, {RAW_EDGE}")
    found = spark.read.schema(f"relationships array<struct<{fields}>>, {RAW_EDGE}").json(path, multiLine=True)
    lines = spark.read.schema(RAW_EDGE).json(path)
    names = lines.columns
    file = F.col("_metadata.file_path").alias("_file")
    listed = found.select(file, F.posexplode("relationships").alias("_place", "r")).select("_file", "_place", "r.*")
    # A file of lines has no array, and its lines are records of their own.
    by_line = (lines.select(file, *names).filter(F.coalesce("source_name", "target_name").isNotNull())
               .join(listed.select("_file").distinct(), "_file", "left_anti")
               .select("_file", F.lit(0).alias("_place"), *names))
    order = ["_file", "_place", *names]
    return with_position(listed.unionByName(by_line), order, name="seq").select("seq", *names)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """A sentence corpus, one JSON record per line."""
    return spark.read.schema(SENTENCE).json(path)


# --- landed replies ------------------------------------------------------------------------------

BINDING = "struct<value: string, `xml:lang`: string>"


def _bindings(replies: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of query replies (reply_id, body): reply_id, row_no and one struct per variable."""
    row = ", ".join(f"{n}: {BINDING}" for n in names)
    parsed = F.from_json("body", f"results struct<bindings: array<struct<{row}>>>")
    return replies.select("reply_id", F.posexplode(parsed["results"]["bindings"]).alias("row_no", "b")).select(
        "reply_id", "row_no", "b.*")


def _last_part(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def signed_year(date: Column) -> Column:
    """Year of a date text, with or without a sign."""
    return F.regexp_extract(date, r"^([+-]?\d{1,9})-", 1).try_cast("int")


def flatten_claims(replies: DataFrame) -> DataFrame:
    """Claims of landed query replies: qid, p31, p144, p1074, birth_year (the first one given)."""
    rows = _bindings(replies, ["q", "p31", "p144", "p1074", "birth"])
    place = F.struct("reply_id", "row_no")
    values = {c: F.array_sort(F.collect_set(_last_part(F.col(f"{c}.value")))) for c in ("p31", "p144", "p1074")}
    year = signed_year(F.col("birth.value"))
    return rows.groupBy(_last_part(F.col("q.value")).alias("qid")).agg(
        *[v.alias(c) for c, v in values.items()],
        F.min_by(year, F.when(year.isNotNull(), place)).alias("birth_year"))


def flatten_media_characters(replies: DataFrame) -> DataFrame:
    """Characters of landed media replies, one row per medium and character."""
    title = "struct<romaji: string, native: string>"
    name = "struct<full: string, native: string, alternative: array<string>>"
    node = f"struct<id: bigint, name: {name}, description: string>"
    media = f"struct<id: bigint, title: {title}, genres: array<string>, characters: struct<nodes: array<{node}>>>"
    parsed = F.from_json("body", f"data struct<Page: struct<media: array<{media}>>>")
    rows = replies.select(F.explode(parsed["data"]["Page"]["media"]).alias("m")).select(
        "m", F.explode("m.characters.nodes").alias("c"))
    return rows.select(
        F.col("m.id").alias("media_id"), F.coalesce("m.title.native", "m.title.romaji").alias("media_title"),
        F.col("m.genres").alias("media_genres"), F.col("c.id").alias("char_id"), F.col("c.name.full").alias("char_name"),
        F.col("c.name.native").alias("char_native"), F.col("c.name.alternative").alias("char_alt"),
        F.substring(F.coalesce("c.description", F.lit("")), 1, 300).alias("description"))


def flatten_wiki_pages(replies: DataFrame) -> DataFrame:
    """Title and wiki text of the pages of landed wiki replies; pages without text are left out."""
    slot = "struct<main: struct<`*`: string>>"
    page = f"struct<title: string, revisions: array<struct<slots: {slot}>>>"
    parsed = F.from_json("body", f"query struct<pages: map<string, {page}>>")
    pages = replies.select(F.explode(F.map_values(parsed["query"]["pages"])).alias("p"))
    text = F.get(F.col("p.revisions"), F.lit(0))["slots"]["main"]["*"]
    return pages.select(F.col("p.title").alias("title"), text.alias("text")).filter(F.col("text").isNotNull())


def preferred_label(labels: DataFrame, languages: Sequence[str] = ("zh",)) -> DataFrame:
    """One text per qid from (qid, lang, value, position): preferred languages first, then the first given.

    Among several values of the preferred language the last one counts.
    """
    lang = F.coalesce("lang", F.lit(""))
    rank = None
    for place, code in enumerate(languages):
        rank = F.when(lang.startswith(code), place) if rank is None else rank.when(lang.startswith(code), place)
    rank = rank.otherwise(len(languages))
    order = F.when(rank < len(languages), -F.col("position")).otherwise(F.col("position"))
    usable = labels.filter(F.nullif("value", F.lit("")).isNotNull())
    return usable.groupBy("qid").agg(F.min_by("value", F.struct(rank.alias("r"), order.alias("o"), "value")).alias("value"))


# --- pages ---------------------------------------------------------------------------------------

def page_text(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Visible text of each page: page_id, text."""
    return pages.select("page_id", visible_text(F.col("html"), limit).alias("text"))


def _cells(row: Column, tags: str) -> Column:
    return F.regexp_extract_all(row, F.lit(rf"(?is)<(?:{tags})\b[^>]*>(.*?)</(?:{tags})\s*>"))


def _plain(cell: Column) -> Column:
    return strip(F.regexp_replace(cell, r"(?s)<[^>]*>", ""))


def table_rows(pages: DataFrame) -> DataFrame:
    """Rows of all tables of the pages: page_id, table_no, row_no, heads, cells (plain), cells_html."""
    tables = pages.select("page_id", F.posexplode(F.regexp_extract_all(
        "html", F.lit(r"(?is)<table\b[^>]*>(.*?)</table\s*>"))).alias("table_no", "table"))
    listed = tables.withColumn("rows", F.regexp_extract_all("table", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>")))
    first = F.get(F.filter("rows", lambda row: row.rlike(r"(?i)<th\b")), F.lit(0))
    heads = F.transform(F.coalesce(_cells(first, "th"), F.array().cast("array<string>")),
                        lambda h: F.regexp_replace(_plain(h), r"\s+", ""))
    rows = listed.select("page_id", "table_no", heads.alias("heads"), F.posexplode("rows").alias("row_no", "row"))
    html = _cells(F.col("row"), "td|th")
    return rows.select("page_id", "table_no", "row_no", "heads", "row", html.alias("cells_html"),
                       F.transform(html, _plain).alias("cells"))


def extract_index_rows(pages: DataFrame, base_url: str = "") -> DataFrame:
    """Entities of index tables: id, name, class, prototype, detail_url, region, image_url.

    Heads say which column holds what. The first row of an id wins, by page, table and row.
    """
    rows = table_rows(pages).filter((F.col("row_no") > 0) & F.col("row").rlike(r"(?i)<td\b") & (F.size("cells") >= 2))

    def column(key: str) -> Column:
        hits = F.transform("heads", lambda h: h.rlike(TABLE_HEADS[key]))
        return F.get(F.col("cells"), F.array_position(hits, True).cast("int") - 1)

    def place(key: str) -> Column:
        return F.array_position(F.transform("heads", lambda h: h.rlike(TABLE_HEADS[key])), True)

    def cell(key: str) -> Column:
        return F.when(place(key) > 0, column(key))

    number = F.regexp_extract(F.coalesce(cell("id"), F.get("cells", F.lit(0))), r"(\d+)", 1)
    link = r'(?is)<a\b[^>]*?(?:href="([^"]*)")?[^>]*>\s*((?:(?!</a).)*?\S.*?)</a\s*>'
    linked = strip(F.regexp_replace(F.regexp_extract("row", link, 2), r"(?s)<[^>]*>", ""))
    href = F.regexp_extract("row", r'(?is)<a\b[^>]*href="([^"]*)"', 1)
    src = F.regexp_extract("row", r'(?is)<img\b[^>]*src="([^"]+)"', 1)
    name = F.coalesce(F.nullif(linked, F.lit("")), F.get("cells", F.lit(1)))
    found = rows.select(
        number.alias("id"), name.alias("name"), F.coalesce(cell("class"), F.lit("")).alias("class"),
        guess_prototype(name).alias("prototype"),
        F.when((href != "") & ~href.startswith("http") & (linked != ""), F.concat(F.lit(base_url), href)).otherwise("").alias("detail_url"),
        F.coalesce(cell("region"), F.lit("")).alias("region"),
        F.when(src == "", "").when(src.startswith("http"), src).otherwise(F.concat(F.lit(base_url), src)).alias("image_url"),
        "page_id", "table_no", "row_no",
    ).filter((F.col("id") != "") & (F.col("name") != ""))
    return first_per_key(found, ["id"], ["page_id", "table_no", "row_no"]).drop("page_id", "table_no", "row_no")


def extract_detail_facts(pages: DataFrame) -> DataFrame:
    """Region, attribute and description of detail pages: page_id, region, attribute, description."""
    rows = table_rows(pages).filter(F.size("cells") >= 2).select(
        "page_id", "table_no", "row_no", F.get("cells", F.lit(0)).alias("head"), F.get("cells", F.lit(1)).alias("value")
    ).filter(F.col("value") != "")
    at = F.struct("table_no", "row_no")
    is_region = F.col("head").rlike(REGION_KEYS)
    is_attribute = F.contains("head", F.lit("属性")) & ~F.contains("head", F.lit("阵营"))
    facts = rows.groupBy("page_id").agg(
        F.min_by("value", F.when(is_region, at)).alias("region"),
        F.min_by("value", F.when(is_attribute, at)).alias("attribute"))
    # Paragraphs may be left open in HTML, so one ends where the next block starts.
    paragraph = _plain(F.regexp_extract("html", r"(?is)<p\b[^>]*>(.*?)(?=</p|<p\b|</div|<div\b|</article|$)", 1))
    described = pages.select("page_id", F.when(F.length(paragraph) > 10, F.substring(paragraph, 1, 300)).alias("description"))
    return described.join(facts, "page_id", "left").select("page_id", "region", "attribute", "description")


def _csv_fields(line: str) -> Column:
    """Fields of a CSV line; quoted ones lose their quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(raw, lambda f: F.when(
        F.startswith(f, F.lit('"')), F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(f))


def embedded_csv(pages: DataFrame, base_url: str = "") -> DataFrame:
    """Entities of a CSV text that a page script assigns to raw_str, with overrides of override_data."""
    def js_string(key: str) -> Column:
        raw = F.regexp_extract("html", rf'(?s){key}\s*=\s*"(.*?)";', 1)
        for quoted, plain in (("\\n", "\n"), ('\\"', '"'), ("\\\\", "\\")):
            raw = F.replace(raw, F.lit(quoted), F.lit(plain))
        return raw

    texts = pages.select("page_id", js_string("raw_str").alias("csv"), js_string("override_data").alias("over"))
    texts = texts.filter(F.col("csv") != "")
    lines = texts.select("page_id", F.posexplode(F.split("csv", "\n")).alias("line_no", "line"),
                         F.substring_index("csv", "\n", 1).alias("head")).filter((F.col("line_no") > 0) & (F.col("line") != ""))
    fields = F.map_from_arrays(_csv_fields("head"), F.transform(
        _csv_fields("head"), lambda _, i: F.get(_csv_fields("line"), i)))
    rows = lines.select("page_id", "line_no", fields.alias("f")).withColumn("id", F.trim(F.col("f")["id"])).filter(
        F.coalesce("id", F.lit("")) != "")
    # Overrides come as blocks of key=value lines, each opened by its id.
    blocks = texts.select("page_id", F.posexplode(F.split("over", r"(?m)(?=^\s*id\s*=)")).alias("block_no", "block"))
    pairs = F.transform(F.filter(F.split("block", "\n"), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(
        F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("value")))
    over = blocks.select("page_id", "block_no", F.posexplode(pairs).alias("p_no", "p"), F.trim(F.regexp_extract("block", r"(?m)^\s*id\s*=(.*)$", 1)).alias("id"))

    def override(key: str) -> Column:
        given = (F.col("p.key") == key) & (F.col("p.value") != "")
        return F.max_by(F.when(given, F.col("p.value")), F.when(given, F.struct("block_no", "p_no"))).alias(key)

    extra = over.filter(F.col("id") != "").groupBy("page_id", "id").agg(*[override(k) for k in ("name_cn", "name_en", "name_link")])
    named = rows.join(extra, ["page_id", "id"], "left")
    name = F.coalesce("name_cn", "name_en", "name_link", "id")
    avatar = F.coalesce(F.col("f")["avatar"], F.lit(""))
    return named.select(
        "page_id", "line_no", "id", name.alias("name"), F.trim(F.coalesce(F.col("f")["class_link"], F.lit(""))).alias("class"),
        guess_prototype(name).alias("prototype"),
        F.coalesce(F.concat(F.lit(f"{base_url}/w/"), "name_link"), F.lit("")).alias("detail_url"),
        F.when(avatar == "", "").when(avatar.startswith("http"), avatar).otherwise(F.concat(F.lit("https:"), avatar)).alias("image_url"))
