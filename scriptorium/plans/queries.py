"""Queries over the test tables, one or more for each operator, and their SQL counterparts.

Texts with markers, tags or special characters are derived from the tables in
the same way in both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sql
from ..config import API, EVENT_TYPES, LOCAL, Profile
from ..functions import text as tx
from ..operators import asof, chunking, evidence, items, long_texts, open_fields, parsing, phrases, segments, spans, tags, training
from ..shared import shared_path, written
from ..sources import append, pages, readers, sinks
from ..streaming.chunks import stream_chunks
from ..streaming.typed_chunks import rocksdb, stream_chunks_typed
from . import extractors, pipelines

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the SQL side of shared pieces ---

_W = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _norm(x: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def _chunks(source: str, p: Profile, extra: str = "") -> str:
    """CTE body ``chunks(doc_id, chunk_id, chunk_text)`` over source(doc_id, t)."""
    low = p.chunk_size - 250

    def end(pos: str) -> str:
        k = rf"length(regexp_extract(substring(t, {pos} + {low + 1}, 250), '(?s)^(.*[。！？；\n])', 1))"
        return f"CASE WHEN length(t) - ({pos}) >= {p.chunk_size} THEN {pos} + (CASE WHEN {k} > 0 THEN {low} + {k} ELSE {p.chunk_size} END) END"

    return f"""src AS ({source}),
    cuts AS (SELECT doc_id, t, 0 AS pos, {end("0")} AS e FROM src UNION ALL SELECT doc_id, t, e - {p.overlap}, {end(f"(e - {p.overlap})")} FROM cuts WHERE e IS NOT NULL),
    pieces AS (SELECT doc_id, pos, {_strip("CASE WHEN e IS NULL THEN substring(t, pos + 1) ELSE substring(t, pos + 1, e - pos) END")} AS chunk_text FROM cuts),
    chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS chunk_id, chunk_text FROM pieces WHERE chunk_text <> '')"""


def _chunk_query(source: str, p: Profile) -> str:
    return f"WITH RECURSIVE {_chunks(source, p)} SELECT doc_id, chunk_id, chunk_text FROM chunks"


_DOCS = f"SELECT doc_id, {_norm('text')} AS t FROM documents"
_CJK = f"SELECT doc_id, {_norm("replace(text, '. ', '。')")} AS t FROM documents"
_PAGES = f"SELECT conv_id AS doc_id, string_agg(p, chr(10) ORDER BY turn) AS t FROM (SELECT conv_id, turn, {_norm('text')} AS p FROM conversations) WHERE p <> '' GROUP BY conv_id"
_CHUNK_COLUMNS = ("doc_id", "chunk_id", "chunk_text")


# --- text ---


def _messy(c: Column) -> Column:
    return F.concat(F.lit("　 \t"), F.replace(c, F.lit(". "), F.lit(".\t \r\n\r\n\r\n\r")), F.lit(" \r\n"))


@_query(f"SELECT doc_id, {_norm(r"chr(12288) || ' ' || chr(9) || replace(text, '. ', '.' || chr(9) || ' ' || repeat(chr(13) || chr(10), 3) || chr(13)) || chr(160) || chr(13) || chr(10)")} AS text FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(_messy(F.col("text"))).alias("text"))


@_query(
    "SELECT doc_id, replace(regexp_replace("
    + _strip(f"regexp_replace(lower('“' || replace(text, '. ', '”  ‘x’ ') || chr(12288)), '{_W}+', ' ', 'g')")
    + ", '[“”]', '\"', 'g'), '’', '''') AS text FROM documents"
)
def normalize_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.concat(F.lit("“"), F.replace("text", F.lit(". "), F.lit("”  ‘x’ ")), F.lit("　"))
    return _table(spark, sf_dir, "documents").select("doc_id", tx.normalize_evidence(messy).alias("text"))


@_query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("text"))


@_query("SELECT doc_id, 'system' || chr(10) || chr(10) || '【输入文本】:' || chr(10) || text || chr(10) || chr(10) || '【输出 JSON List】:' AS prompt, 2 AS n_messages FROM documents")
def build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.prompt(F.col("text"), "system").alias("prompt"), F.size(tx.chat_prompt(F.col("text"), "system")).alias("n_messages"))


# --- chunks ---


@_query(_chunk_query(_DOCS, LOCAL))
def chunk_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(_table(spark, sf_dir, "documents"), LOCAL).select(*_CHUNK_COLUMNS)


@_query(_chunk_query(_DOCS, API))
def chunk_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(_table(spark, sf_dir, "documents"), API).select(*_CHUNK_COLUMNS)


@_query(_chunk_query(_CJK, LOCAL))
def chunk_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit("。")))
    return chunking.chunk_documents(d, LOCAL).select(*_CHUNK_COLUMNS)


def _conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_no"), "text")


@_query(_chunk_query(_PAGES, LOCAL))
def chunk_multipage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_pages(_conversation_pages(spark, sf_dir), LOCAL).select(*_CHUNK_COLUMNS)


@_query(f"WITH RECURSIVE {_chunks(_DOCS, LOCAL)} SELECT lang, count(*) AS n_chunks, sum(length(chunk_text))::BIGINT AS n_chars, max(chunk_id) AS last_chunk FROM chunks JOIN documents USING (doc_id) GROUP BY lang")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunk_documents(_table(spark, sf_dir, "documents"), LOCAL, keep=("lang",))
    return c.groupBy("lang").agg(F.count("*").alias("n_chunks"), F.sum(F.length("chunk_text")).alias("n_chars"), F.max("chunk_id").alias("last_chunk"))


@_query("SELECT conv_id AS doc_id, turn::INT AS page_no, text FROM conversations WHERE turn >= 1 AND turn < 4 AND text <> ''")
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.page_range(_conversation_pages(spark, sf_dir), 1, 3)


@_query("SELECT conv_id AS doc_id, count(*) AS n_pages, sum(length(coalesce(text, '')))::BIGINT AS n_chars, sum((turn + 1) * length(coalesce(text, '')))::BIGINT AS weighted FROM conversations GROUP BY conv_id")
def page_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = readers.page_store(_conversation_pages(spark, sf_dir))
    total = lambda f: F.aggregate("pages", F.lit(0).cast("long"), lambda a, p: a + f(p))
    return d.select("doc_id", F.size("pages").cast("long").alias("n_pages"), total(lambda p: F.length(p["text"])).alias("n_chars"), total(lambda p: p["page"] * F.length(p["text"])).alias("weighted"))


_MARKED = "replace(text, '. ', '. ○ ')"


@_query(
    f"""WITH t AS (SELECT doc_id, {_norm(_MARKED)} AS t FROM documents),
    l AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '{_W}*○{_W}*', chr(10) || '○', 'g'), chr(10)), lambda x: {_strip("x")}), lambda x: x <> '') AS lines FROM t),
    h AS (SELECT doc_id, t, array_to_string(list_filter(lines, lambda x: NOT starts_with(x, '○')), chr(10)) AS head, list_filter(lines, lambda x: starts_with(x, '○')) AS items FROM l)
    SELECT doc_id, 0 AS chunk_id, 0 AS seg_id, t AS seg_text FROM h WHERE len(items) = 0
    UNION ALL SELECT doc_id, 0, g::INT, {_strip("(CASE WHEN head = '' THEN '' ELSE head || chr(10) END) || array_to_string(items[g * 6 + 1 : g * 6 + 6], chr(10))")}
    FROM (SELECT *, unnest(range(0, (len(items) + 5) // 6)) AS g FROM h WHERE len(items) > 0)"""
)
def marker_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("chunk_id"), F.replace("text", F.lit(". "), F.lit(". ○ ")).alias("chunk_text"))
    return segments.marker_segments(d, enabled=True)


# --- tags and training data ---

_GAP = "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'and ' WHEN 2 THEN 'above' WHEN 3 THEN '</x>' ELSE chr(10) END"
_TAGGED = f"""SELECT o_orderkey, 'on ' || o_orderdate::DATE::VARCHAR || ' <O>' || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END || '</O>' || {_GAP} || '<P id="1">' || c_name || '</P>, <P>' || o_orderstatus || '</P><Place>' || c_mktsegment || '</Place>' AS x
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT o_orderkey, o_orderstatus || ' no tag' FROM orders WHERE o_orderkey % 3 = 0"""
_R = r"(<O>(.*?)</O>)|(<P.*?>(.*?)</P>)"
_TAG_SQL = rf"""tagged AS ({_TAGGED}), parts AS (SELECT o_orderkey, x, regexp_extract_all(x, '{_R}') AS tk, string_split_regex(x, '{_R}') AS gp FROM tagged),
    each AS (SELECT o_orderkey, x, i, tk[i] AS token, CASE WHEN i > 1 THEN tk[i - 1] END AS last, length(gp[i]) AS gap FROM (SELECT *, unnest(range(1, len(tk) + 1)) AS i FROM parts)),
    entities AS (SELECT o_orderkey, x, i, regexp_extract(token, '(?s)^<.*?>(.*)</.>$', 1) AS name, CASE WHEN starts_with(last, '<O>') AND length(last) > 7 AND gap < 5 THEN last[4:length(last) - 4] END AS rank FROM each WHERE NOT starts_with(token, '<O>'))"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    gap = F.when(key % 5 == 0, "").when(key % 5 == 1, "and ").when(key % 5 == 2, "above").when(key % 5 == 3, "</x>").otherwise("\n")
    rank = F.when(key % 7 == 0, "").otherwise(F.col("o_orderpriority"))
    x = F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" <O>"), rank, F.lit("</O>"), gap, F.lit('<P id="1">'), "c_name", F.lit("</P>, <P>"), "o_orderstatus", F.lit("</P><Place>"), "c_mktsegment", F.lit("</Place>"))
    with_tags = o.where(key % 3 != 0).join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", x.alias("text_content"))
    return with_tags.unionByName(o.where(key % 3 == 0).select("o_orderkey", F.concat("o_orderstatus", F.lit(" no tag")).alias("text_content")))


@_query(f"WITH {_TAG_SQL} SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY i) - 1)::INT AS idx, name, rank, 'N/A' AS event_type, 'N/A' AS action FROM entities")
def tag_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tags.entities_of(_tagged(spark, sf_dir)).select("o_orderkey", F.posexplode_outer("entities").alias("idx", "e")).where("e is not null")
    return d.select("o_orderkey", F.col("idx").cast("int").alias("idx"), "e.*")


@_query(f"WITH {_TAG_SQL} SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY i) - 1)::INT AS idx, name, rank FROM entities")
def token_offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as three documents of rows of tokens, each order's at its own place: offices are looked up among the rows."""
    stride = 1000
    d = tags.token_rows(_tagged(spark, sf_dir)).withColumn("doc_id", F.col("o_orderkey") % 3)
    d = d.select("doc_id", *[(F.col("o_orderkey") * stride + F.col(c)).alias(c) for c in ("start", "end")], "kind", "inner")
    found = tags.entities_of_tokens(d).withColumn("o_orderkey", F.floor(F.col("start") / stride))
    w = Window.partitionBy("o_orderkey").orderBy("start")
    return found.select("o_orderkey", (F.row_number().over(w) - 1).alias("idx"), "name", "rank")


_EVENT_ROWS = "SELECT event_id, event_type, epoch_us(ts) // 60000000 AS minute, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id % 5 END AS grp FROM events"


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    return _table(spark, sf_dir, "events").select("event_id", "event_type", minute.alias("minute"), F.when(F.col("event_id") % 11 != 0, F.col("user_id") % 5).alias("grp"))


def _asof_sql(tolerance: int) -> str:
    return f"""WITH e AS ({_EVENT_ROWS}), v AS (SELECT grp, minute, max(event_id) AS seen FROM e WHERE event_type = 'view' AND grp IS NOT NULL GROUP BY grp, minute)
    SELECT e.event_id, e.minute, e.grp, CASE WHEN e.minute - v.minute <= {tolerance} THEN v.seen END AS last_view FROM (SELECT * FROM e WHERE event_type <> 'view') e ASOF LEFT JOIN v ON e.grp = v.grp AND e.minute >= v.minute"""


def _last_view(spark: SparkSession, sf_dir: str, tolerance: int | None) -> DataFrame:
    d = _event_rows(spark, sf_dir)
    others = d.where("event_type <> 'view'").select("event_id", "minute", "grp")
    return asof.asof(others, d.where("event_type = 'view'"), ("grp",), "minute", "minute", {"event_id": "last_view"}, tolerance, block=1440)


@_query(_asof_sql(1 << 40))
def asof_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view in a group of users at or before each other event; five groups hold all events, days are blocks."""
    return _last_view(spark, sf_dir, None)


@_query(_asof_sql(5))
def asof_recent_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where it is at most five minutes old."""
    return _last_view(spark, sf_dir, 5)


_EXAMPLES = f"""{_TAG_SQL}, examples AS (SELECT o_orderkey, '{training.INSTRUCTION}' AS instruction, regexp_replace(any_value(x), '<[^>]+>', '', 'g') AS input,
    '[' || string_agg('{{"name": ' || to_json(name)::VARCHAR || ', ' || coalesce('"rank": ' || to_json(rank)::VARCHAR || ', ', '') || '"event_type": "N/A", "action": "N/A"}}', ', ' ORDER BY i) || ']' AS output FROM entities GROUP BY o_orderkey)"""


@_query(f"WITH {_EXAMPLES} SELECT * FROM examples")
def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.training_examples(_tagged(spark, sf_dir)).drop("text_content")


@_query(f"WITH {_EXAMPLES} SELECT o_orderkey, instruction || chr(10) || chr(10) || input AS text, output AS completion FROM examples")
def prompt_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.prompt_completion(training.training_examples(_tagged(spark, sf_dir)).drop("text_content"))


@_query("SELECT doc_id, place, cut, CASE WHEN place <= cut THEN 'train' ELSE 'valid' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '#42'), doc_id) AS place, (count(*) OVER () * 0.9::DOUBLE)::DOUBLE AS c, floor(c)::BIGINT AS cut FROM documents)")
def train_valid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = training.split_ranks(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return d.select("doc_id", F.col("place").cast("long").alias("place"), "cut", F.when(F.col("place") <= F.col("cut"), "train").otherwise("valid").alias("part"))


@_query("SELECT doc_id, translate(text, 'aeioué', '一二三四五六') AS text FROM documents")
def script_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", training.convert_script(F.col("text"), dict(zip("aeioué", "一二三四五六"))).alias("text"))


@_query("SELECT doc_id, replace(replace(text, 'tion', '字'), 'th', '詞') AS input FROM documents")
def phrase_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.convert_phrases(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("input")), {"tion": "字", "th": "詞"})


@_query(f"WITH {_TAG_SQL} SELECT o_orderkey::VARCHAR AS id, 'src' AS source, x AS text_content FROM tagged WHERE o_orderkey % 4 <> 0 UNION ALL SELECT 'a', 'b', 'first' FROM tagged WHERE o_orderkey % 4 = 1")
def literal_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit("'"), F.replace(F.replace("text_content", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("'"))
    row = F.concat(F.lit("("), F.col("o_orderkey").cast("string"), F.lit(", 'src', "), quoted, F.lit(")"))
    key = F.col("o_orderkey") % 4
    cell = F.when(key == 0, "N/A").when(key == 1, F.concat(F.lit("[('a', 'b', 'first'), "), row, F.lit(", 5, ('c', 'd', 'never')]"))).otherwise(F.concat(F.lit("[('short',), "), row, F.lit("]")))
    return parsing.parse_cells(_tagged(spark, sf_dir).select(cell.alias("Related Texts")))


# --- responses ---

_RAW = (
    """'[{"name":"N' || {0} || '","rank":"r"}]'""",
    """'```json' || chr(10) || '[{"name":"A' || {0} || '"},5,{"name":""}]' || chr(10) || '```'""",
    """'so: {"official_name":"B' || {0} || '","page":3} end'""",
    """'[] '""",
    """'[{"name":"x' || {0} || '"}] tail'""",
    """''""",
    """'{"name":"C","name":"D' || {0} || '"}'""",
    """'[{''name'':''x' || {0} || '''}]'""",
    """'[{"name":"  "},{"name":"E' || {0} || '","time":null},{"name":"[]"}]'""",
    """'no json ' || {0}""",
)
_RAW_SQL = "SELECT doc_id, (doc_id % 7)::INT AS chunk_id, CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN {r.replace('{0}', 'doc_id::VARCHAR')}" for k, r in enumerate(_RAW)) + " END AS raw FROM documents"
_ITEMS_SQL = """SELECT doc_id, (doc_id % 7)::INT AS chunk_id, (u.i)::INT AS item_idx, u.name AS name, u.rank AS rank, u.extra AS extra FROM (SELECT doc_id, unnest(CASE doc_id % 10
    WHEN 0 THEN [{'i': 0, 'name': 'N' || doc_id, 'rank': 'r', 'extra': NULL}] WHEN 1 THEN [{'i': 0, 'name': 'A' || doc_id, 'rank': NULL, 'extra': NULL}]
    WHEN 2 THEN [{'i': 0, 'name': 'B' || doc_id, 'rank': NULL, 'extra': '{"page": 3}'}] WHEN 6 THEN [{'i': 0, 'name': 'D' || doc_id, 'rank': NULL, 'extra': NULL}]
    WHEN 8 THEN [{'i': 0, 'name': '  ', 'rank': NULL, 'extra': NULL}, {'i': 1, 'name': 'E' || doc_id, 'rank': NULL, 'extra': NULL}] ELSE [] END) AS u FROM documents)"""


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    _table(spark, sf_dir, "documents").createOrReplaceTempView("_response_documents")
    raw = " ".join(f"WHEN {k} THEN {r.replace('{0}', 'string(doc_id)').replace(chr(39) * 2 + 'name', chr(92) + chr(39) + 'name').replace(chr(39) * 2 + ':' + chr(39) * 2, chr(92) + chr(39) + ':' + chr(92) + chr(39)).replace(chr(39) * 3 + '}', chr(39) + chr(92) + chr(39) + '}')}" for k, r in enumerate(_RAW))
    return spark.sql(f"SELECT doc_id, int(doc_id % 7) AS chunk_id, CASE doc_id % 10 {raw} END AS raw FROM _response_documents")


@_query(_ITEMS_SQL)
def parse_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parsing.parse_responses(_responses(spark, sf_dir))
    return parsing.explode_items(parsed).select("doc_id", "chunk_id", "item_idx", "name", "rank", "extra")


@_query(f"SELECT * FROM ({_RAW_SQL}) WHERE doc_id % 10 IN (4, 5, 7, 9)")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.dead_letters(parsing.parse_responses(_responses(spark, sf_dir)))


_OPEN = (
    """'[{"name":"a","page":' || {0} || ',"source":{"kind":"roll"}}]'""",
    """'[{"name":"a","page":null,"title":"t' || {0} || '"},{"name":"b","odd key":' || {0} || '.5}]'""",
    """'[{"name":"a","page":"' || {0} || '","title":null,"office":"o"}]'""",
    """'[{"name":"a"}]'""",
    """'[{"name":"a","page":"p' || {0} || '","office":"o' || {0} || '"}]'""",
)
_OPEN_RAW = "CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN {r}" for k, r in enumerate(_OPEN)) + " END"


def _open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(_OPEN_RAW.replace("{0}", "string(doc_id)")).alias("raw")
    parsed = parsing.parse_responses(_table(spark, sf_dir, "documents").select("doc_id", raw))
    return open_fields.open_items(parsing.explode_items(parsed).select("doc_id", "item_idx", "extra"))


_OPEN_SQL = f"items AS (SELECT doc_id, generate_subscripts(js, 1) - 1 AS item_idx, unnest(js) AS j FROM (SELECT doc_id, from_json({_OPEN_RAW.replace('{0}', 'doc_id::VARCHAR')}, '[\"JSON\"]') AS js FROM documents))"


def _state(name: str) -> str:
    return f"CASE coalesce(json_type(j, '$.\"{name}\"'), '') WHEN '' THEN 'absent' WHEN 'NULL' THEN 'null' ELSE 'value' END"


@_query(
    f"""WITH {_OPEN_SQL} SELECT doc_id, item_idx::INT AS item_idx, try_cast(j->>'page' AS BIGINT) AS page, {_state("page")} AS page_state, try_cast(j->>'$."odd key"' AS DOUBLE) AS "odd key", {_state("odd key")} AS "odd key_state",
    CASE WHEN {_state("title")} = 'absent' THEN j->>'office' ELSE j->>'title' END AS title FROM items"""
)
def open_typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields of open items, those that are null told from those that aren't there; ``office`` stands in where there is no ``title``."""
    d = open_fields.typed_fields(_open_items(spark, sf_dir), {"page": "bigint", "odd key": "double"})
    return d.withColumn("title", open_fields.renamed_field(F.col("extra"), "office", "title")).drop("extra")


@_query(
    f"""WITH {_OPEN_SQL}, f AS (SELECT unnest(json_keys(j)) AS field, j FROM items), k AS (SELECT field, json_type(j, '$."' || field || '"') AS t FROM f WHERE field <> 'name')
    SELECT field, count(*) AS n, count(*) FILTER (t = 'NULL') AS n_null, CASE field WHEN 'page' THEN 'VARIANT' WHEN 'source' THEN 'OBJECT<kind: STRING>' WHEN 'odd key' THEN 'DECIMAL' ELSE 'STRING' END AS kind FROM k GROUP BY field"""
)
def open_field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which open fields the items have, how often, how often null, and of what kind over all items."""
    return open_fields.field_profile(_open_items(spark, sf_dir)).withColumn("kind", F.regexp_replace("kind", r"^DECIMAL.*", "DECIMAL"))


_TYPES = {"click": "Appointment", "view": "Military", "purchase": "Death"}
_EVENT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " ELSE event_type END"


@_query(f"SELECT event_id, {_EVENT} AS event_type FROM events WHERE {_EVENT} IN ('Appointment', 'Military', 'Diplomacy', 'Disaster', 'Death', 'Other')")
def event_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _TYPES.items()], F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", kind.alias("event_type")).where(items.valid_event_type(F.col("event_type")))


@_query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN true ELSE false END AS valid, CASE event_type WHEN 'click' THEN 1 ELSE 0 END AS n_items
    FROM events"""
)
def parse_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("event_id").cast("string")
    good = F.concat(F.lit('{"items":[{"name":"'), name, F.lit('","action":"a","event_type":"Death","quote":"q"}]}'))
    bad = F.concat(F.lit('{"items":[{"name":"'), name, F.lit('","action":"a","event_type":"Gift","quote":"q"}]}'))
    kind = F.col("event_type")
    d = _table(spark, sf_dir, "events").select("event_id", F.when(kind == "click", good).when(kind == "view", "[1, 2]").otherwise(bad).alias("raw"))
    from ..config import EVENT_TYPES

    return parsing.parse_responses(d, EVENT_TYPES).select("event_id", F.col("parsed_ok").alias("valid"), F.size("items").alias("n_items"))


# --- items ---

_NAMES = ("' A' || d || ' '", "'甲孙' || d", "'公孙胜'", "''", "'　'", "'甲孙乙孙丙'", "'张皇后'", "'孙传庭'")
_ITEMS = "SELECT doc_id, CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {n}" for k, n in enumerate(_NAMES)) + " END AS name, CASE doc_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '' ELSE ' r' END AS rank, CASE doc_id % 2 WHEN 0 THEN 'null ' ELSE NULL END AS time, substring('  ' || repeat('q', 70), 1, 3 + (doc_id % 66)::INT) AS quote FROM (SELECT *, right('000' || (doc_id % 1000)::VARCHAR, 3) AS d FROM documents)"


@_query(
    f"""WITH i AS (SELECT doc_id, {_strip("name")} AS n, rank, time, quote FROM ({_ITEMS}))
    SELECT doc_id, CASE WHEN regexp_matches(n, '^(.{{1,6}})孙(.{{1,6}})$') THEN {_strip("regexp_extract(n, '^(.{1,6})孙(.{1,6})$', 2)")} ELSE n END AS name,
    CASE WHEN rank IN ('', 'null') THEN NULL ELSE rank END AS rank, CASE WHEN time IN ('', 'null') THEN NULL ELSE time END AS time, quote
    FROM i WHERE n <> '' AND NOT regexp_matches(n, '(皇帝|皇后|太子|皇太子|公主|国王|王爷|王|后|帝)$') AND length({_strip("quote")}) BETWEEN 5 AND 60"""
)
def normalize_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = F.substring(F.concat(F.lit("000"), (i % 1000).cast("string")), -3, 3)
    names = (F.concat(F.lit(" A"), d, F.lit(" ")), F.concat(F.lit("甲孙"), d), F.lit("公孙胜"), F.lit(""), F.lit("　"), F.lit("甲孙乙孙丙"), F.lit("张皇后"), F.lit("孙传庭"))
    name = F.coalesce(*[F.when(i % 8 == k, n) for k, n in enumerate(names)])
    rank = F.when(i % 3 == 0, "null").when(i % 3 == 1, "").otherwise(" r")
    quote = F.substring(F.lit("  " + "q" * 70), F.lit(1), (3 + i % 66).cast("int"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), rank.alias("rank"), F.when(i % 2 == 0, "null ").alias("time"), quote.alias("quote"))
    return items.normalize_items(rows, exclude_title_like=True)


_QUOTE = "CASE doc_id % 3 WHEN 0 THEN substring(t, 11, 20) WHEN 1 THEN substring(t, 11, 20) || 'Q#' ELSE NULL END"


@_query(f"SELECT doc_id, quote FROM (SELECT doc_id, t, {_QUOTE} AS quote FROM ({_DOCS})) WHERE contains(t, quote)")
def ground_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("seg_text"))
    part = F.substring("seg_text", 11, 20)
    key = F.col("doc_id") % 3
    return items.ground(d.withColumn("quote", F.when(key == 0, part).when(key == 1, F.concat(part, F.lit("Q#")))))


_LINE_ITEMS = """SELECT l_orderkey AS doc_id, l_linenumber::INT AS chunk_id, 0 AS seg_id, 0 AS item_idx, CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE '' END || 'P' || (l_partkey % 97)::VARCHAR AS name,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN '' ELSE 'r' END AS rank, l_returnflag || l_linestatus AS action, 'Other' AS event_type, NULL::VARCHAR AS time, l_returnflag AS quote FROM lineitem"""


def _first_items(scope: str) -> str:
    return f"""SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY {scope}{", ".join(_strip(f"coalesce({c}, '')") for c in items.KEY)} ORDER BY doc_id, chunk_id, seg_id, item_idx) AS n
    FROM ({_LINE_ITEMS})) WHERE n = 1"""


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    name = F.concat(F.when(n % 2 == 0, " ").otherwise(""), F.lit("P"), (F.col("l_partkey") % 97).cast("string"))
    rank = F.when(n % 3 == 1, "").when(n % 3 == 2, "r")
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.cast("int").alias("chunk_id"), F.lit(0).alias("seg_id"), F.lit(0).alias("item_idx"), name.alias("name"), rank.alias("rank"), F.concat("l_returnflag", "l_linestatus").alias("action"), F.lit("Other").alias("event_type"), F.lit(None).cast("string").alias("time"), F.col("l_returnflag").alias("quote"))


@_query(_first_items(""))
def dedup_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.dedup(_line_items(spark, sf_dir), scope=())


@_query(_first_items("doc_id, "))
def dedup_items_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.dedup(_line_items(spark, sf_dir))


@_query(f"""SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY {", ".join(items.KEY)} ORDER BY (chunk_id + 1) % 3, doc_id, chunk_id) AS n, (chunk_id + 1)::BIGINT % 3 AS batch FROM ({_LINE_ITEMS})) WHERE n = 1""")
def append_across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items appended in three batches of two runs, the second batch twice: the first of each key stays."""
    d, path = _line_items(spark, sf_dir), shared_path(spark, "append-table")
    table = append.AppendTable(spark, path, items.KEY, ("doc_id", "chunk_id"), bits=1 << 20)
    for run, batch in (("a", 0), ("a", 1), ("a", 1), ("b", 2)):
        table.append(d.where((F.col("chunk_id") + 1) % 3 == batch), run, batch)
    return table.rows(", ".join(f"{n} {t}" for n, t in d.dtypes)).drop("run")


_EVIDENCE = """SELECT conv_id AS doc_id, (turn + CASE WHEN turn % 5 = 4 THEN 100 ELSE 1 END)::INT AS page, CASE turn % 5 WHEN 0 THEN substring(text, 4, 12) WHEN 1 THEN translate(substring(text, 4, 12), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ' ' WHEN 2 THEN '' ELSE 'absent#' END AS evidence,
    CASE turn % 5 WHEN 2 THEN substring(text, 2, 5) ELSE 'unused' END AS text FROM conversations"""


def _ev(x: str) -> str:
    return "replace(regexp_replace(" + _strip(f"regexp_replace(lower({x}), '{_W}+', ' ', 'g')") + ", '[“”]', '\"', 'g'), '’', '''')"


@_query(
    f"""WITH e AS (SELECT *, CASE WHEN evidence <> '' THEN evidence ELSE coalesce(text, '') END AS ev FROM ({_EVIDENCE})),
    j AS (SELECT e.*, p.t AS pt FROM e LEFT JOIN (SELECT conv_id AS doc_id, (turn + 1)::INT AS page, coalesce(text, '') AS t FROM conversations) p USING (doc_id, page)),
    r AS (SELECT *, pt IS NOT NULL AS known, strpos(pt, ev) AS hit, contains({_ev("pt")}, {_ev("ev")}) AS near FROM j)
    SELECT doc_id, page, evidence, text, CASE WHEN known AND (hit > 0 OR near) THEN 'accepted' ELSE 'rejected' END AS status,
    CASE WHEN NOT known THEN 'invalid page' WHEN NOT (hit > 0 OR near) THEN 'not found' END AS reason,
    CASE WHEN known AND hit > 0 THEN (hit - 1)::INT END AS "start", CASE WHEN known AND hit > 0 THEN (hit - 1 + length(ev))::INT END AS "end", CASE WHEN known AND NOT hit > 0 AND near THEN 'normalized' END AS "match" FROM r"""
)
def validate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, turn, text = _table(spark, sf_dir, "conversations"), F.col("turn"), F.col("text")
    part = F.substring(text, 4, 12)
    shown = F.when(turn % 5 == 0, part).when(turn % 5 == 1, F.concat(F.translate(part, ascii_lowercase, ascii_uppercase), F.lit(" "))).when(turn % 5 == 2, "").otherwise("absent#")
    entities = d.select(F.col("conv_id").alias("doc_id"), (turn + F.when(turn % 5 == 4, 100).otherwise(1)).cast("int").alias("page"), shown.alias("evidence"), F.when(turn % 5 == 2, F.substring(text, 2, 5)).otherwise("unused").alias("text"))
    return evidence.validate_evidence(entities, d.select(F.col("conv_id").alias("doc_id"), (turn + 1).cast("int").alias("page_no"), "text"))


_FLAGSHIP = rf"""WITH RECURSIVE {_chunks(_DOCS, LOCAL)}, segs AS (SELECT doc_id, chunk_id, {_norm("chunk_text")} AS seg_text FROM chunks),
    found AS (SELECT doc_id, chunk_id, i, q[i] AS quote FROM (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM (SELECT doc_id, chunk_id, regexp_extract_all(seg_text, '{extractors.CAPITALISED}') AS q FROM segs))),
    named AS (SELECT doc_id, chunk_id, 0 AS seg_id, (i - 1)::INT AS item_idx, regexp_extract(quote, '{extractors.CAPITALISED}', 1) AS name, NULL::VARCHAR AS rank, quote AS action,
        ['Appointment', 'Military', 'Diplomacy', 'Disaster', 'Death', 'Other'][length(quote) % 6 + 1] AS event_type, NULL::VARCHAR AS time, quote FROM found WHERE length(quote) BETWEEN 5 AND 60)
    SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name, action, event_type, quote ORDER BY chunk_id, seg_id, item_idx) AS n FROM named) WHERE n = 1"""


@_query(_FLAGSHIP)
def rule_extract_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.rule_extraction(_table(spark, sf_dir, "documents"))


class _Echo:
    """A fake service: answers with the first capitalised triple of a segment; every seventh length fails."""

    def generate(self, text: str) -> str:
        import json
        import re

        if len(text) % 7 == 0:
            raise TimeoutError("no answer")
        m = re.search(extractors.CAPITALISED, text)
        found = [{"name": m[1], "rank": None, "action": m[0], "event_type": "Other", "time": "null", "quote": m[0]}] if m else []
        return json.dumps({"items": found})


def _api_items(which: str) -> str:
    return rf"""WITH RECURSIVE {_chunks(_PAGES, API)}, segs AS (SELECT doc_id, chunk_id, {_norm("chunk_text")} AS s FROM chunks), found AS (SELECT doc_id, chunk_id, regexp_extract(s, '{extractors.CAPITALISED}', 0) AS quote FROM segs WHERE {which})
    SELECT doc_id, chunk_id, name, quote FROM (SELECT doc_id, chunk_id, regexp_extract(quote, '{extractors.CAPITALISED}', 1) AS name, quote, row_number() OVER (PARTITION BY doc_id, quote ORDER BY chunk_id) AS n FROM found WHERE length(quote) BETWEEN 5 AND 60) WHERE n = 1"""


@_query(_api_items("length(s) % 7 <> 0"))
def api_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.api_extraction(_conversation_pages(spark, sf_dir), _Echo).select("doc_id", "chunk_id", "name", "quote")


class _Flaky:
    """A fake chat service behind retries: its first model never answers, its second one at the second try, but cuts every fifth length off."""

    def __init__(self):
        self.tried: set[str] = set()
        self.retrying = extractors.Retrying(self.call, ("small", "large"), sleep=lambda s: None, accept=lambda answer: parsing.parse_structured(answer, EVENT_TYPES)[0])

    def call(self, model: str, prompt: str) -> str:
        import json

        system, user = json.loads(prompt)
        if model == "small" or system["content"] != "system" or (prompt not in self.tried and not self.tried.add(prompt)):
            raise TimeoutError("no answer")
        text = user["content"].removeprefix("【输入文本】\n").removesuffix("\n")
        return _Echo().generate(text + "." * (len(text) % 7 == 0)) if len(text) % 5 else '{"items": [{"name": "cut'

    def generate(self, text: str) -> str:
        return self.retrying.generate(text)


@_query(_api_items("length(s) % 5 <> 0"))
def api_extraction_with_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.api_extraction(_conversation_pages(spark, sf_dir), _Flaky, system="system").select("doc_id", "chunk_id", "name", "quote")


class _Lenient:
    """A fake local model, given a framed chunk: a list of one item, no JSON at every third length."""

    def generate(self, prompt: str) -> str:
        import json

        text = prompt.removeprefix("system\n\n【输入文本】:\n").removesuffix("\n\n【输出 JSON List】:")
        return "sorry" if len(text) % 3 == 0 else "answer: " + json.dumps([{"official_name": text[:5], "page": len(text)}])


_LOCAL_ANSWERS = f"WITH RECURSIVE {_chunks(_PAGES, LOCAL)}"


@_query(_LOCAL_ANSWERS + """ SELECT doc_id, chunk_id, 0 AS item_idx, substring(chunk_text, 1, 5) AS name, '{"page": ' || length(chunk_text) || '}' AS extra FROM chunks WHERE length(chunk_text) % 3 <> 0""")
def local_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = pipelines.local_extraction(_conversation_pages(spark, sf_dir), _Lenient, system="system")
    return found.select("doc_id", "chunk_id", "item_idx", "name", "extra")


@_query(_LOCAL_ANSWERS + " SELECT doc_id, chunk_id, chunk_text, 'sorry' AS raw FROM chunks WHERE length(chunk_text) % 3 = 0")
def local_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.local_extraction(_conversation_pages(spark, sf_dir), _Lenient, system="system")[1]


@_query(_LOCAL_ANSWERS + " SELECT k.doc_id, k.chunk_id, c.chunk_text FROM (SELECT conv_id AS doc_id, turn::INT AS chunk_id FROM conversations) k LEFT JOIN chunks c USING (doc_id, chunk_id)")
def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _conversation_pages(spark, sf_dir)
    return chunking.chunk_lookup(pages.select("doc_id", F.col("page_no").alias("chunk_id")), chunking.chunk_pages(pages, LOCAL))


@_query(
    f"""WITH RECURSIVE {_chunks(_PAGES, LOCAL)}, places AS (SELECT doc_id, pos, coalesce(e, length(t)) AS stop, {_strip("CASE WHEN e IS NULL THEN substring(t, pos + 1) ELSE substring(t, pos + 1, e - pos) END")} AS c FROM cuts),
    numbered AS (SELECT doc_id, pos, stop, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS chunk_id FROM places WHERE c <> ''),
    p AS (SELECT conv_id AS doc_id, turn, {_norm("text")} AS p FROM conversations),
    offsets AS (SELECT doc_id, turn, p, coalesce(sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS k FROM p WHERE p <> ''),
    s AS (SELECT doc_id, turn, k + strpos(p, q) - 1 AS b, k + strpos(p, q) - 1 + length(q) AS z FROM (SELECT *, substring(p, length(p) // 3 + 1, 200) AS q FROM offsets))
    SELECT doc_id, turn::INT AS page_no, b AS "start", z AS "end", chunk_id, pos <= b AND z <= stop AS whole FROM s JOIN numbered USING (doc_id) WHERE b < stop AND pos < z"""
)
def evidence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk that holds a part of a quote from a page; quotes across a border, or where chunks overlap, get all theirs."""
    pages = _conversation_pages(spark, sf_dir)
    p = spans.page_offsets(pages)
    quotes = p.select("doc_id", "page_no", F.substring("text", F.floor(F.length("text") / 3).cast("int") + 1, F.lit(200)).alias("quote"))
    found = spans.quote_spans(quotes, pages).drop("quote")
    return spans.chunks_of_spans(found, chunking.chunk_pages(pages, LOCAL), bucket=512)


@_query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'a\"b' || chr(10) || 'c, ' || lang END AS cell, source FROM documents")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with quotes, commas and line feeds, written and read as CSV; N/A is null."""
    cell = F.when(F.col("doc_id") % 3 == 0, "N/A").otherwise(F.concat(F.lit('a"b\nc, '), "lang"))
    path = shared_path(spark, "csv")
    _table(spark, sf_dir, "documents").select("doc_id", cell.alias("cell"), "source").write.csv(path, header=True, escape='"', quoteAll=True)
    return readers.tagged_csv(spark, path).withColumn("doc_id", F.col("doc_id").cast("long"))


@_query(f"""WITH {_EXAMPLES}, placed AS (SELECT *, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '#42'), o_orderkey) AS place, floor((count(*) OVER ())::DOUBLE * 0.9::DOUBLE) AS cut FROM examples)
    SELECT part, o_orderkey, instruction || chr(10) || chr(10) || input AS text, output AS completion FROM placed, (SELECT unnest(['train', 'valid', 'test']) AS part) WHERE part = 'train' OR place > cut""")
def split_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, valid and test written as JSON Lines and read again, whole."""
    path = shared_path(spark, "split")
    examples = written(training.prompt_completion(training.training_examples(_tagged(spark, sf_dir)).drop("text_content")), "examples")
    sinks.write_split(*training.split(examples, "o_orderkey"), path)
    parts = [readers.jsonl(spark, f"{path}/{p}.jsonl", "o_orderkey long, text string, completion string").withColumn("part", F.lit(p)) for p in ("train", "valid", "test")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@_query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'é' END AS rank, text AS quote FROM documents")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 != 0, "é").alias("rank"), F.col("text").alias("quote"))
    path = shared_path(spark, "jsonl")
    sinks.write_jsonl(d, path)
    return readers.jsonl(spark, path, "doc_id long, rank string, quote string")


@_query("""SELECT * FROM (SELECT (doc_id % 8)::INT AS bucket, (row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) - 1)::INT AS page_no, translate(text, chr(12), ' ') AS text FROM documents)
    WHERE page_no >= 2 AND text <> ''""")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as the pages of eight files, read back by the page source from the third page on; the bound is pushed down into it.  A page that can't be read back ends the job."""
    path = shared_path(spark, "page-files")
    d = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 8).cast("int").alias("bucket"), "doc_id", F.translate(F.coalesce("text", F.lit("")), "\f", " ").alias("value"))
    d.repartition(8, "bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", "value").write.option("lineSep", "\f").partitionBy("bucket").text(path)
    found = readers.page_range(pages.load(spark, path, slice_bytes=1 << 20, mode="FAILFAST"), 2)
    return found.select(F.nullif(F.regexp_extract("doc_id", r"/bucket=(-?\d*)[^/]*/[^/]*$", 1), F.lit("")).cast("int").alias("bucket"), "page_no", "text")


@_query(_chunk_query(_DOCS, LOCAL))
def chunk_long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts cut in blocks that many tasks share; the same rows as cutting each document in one go."""
    pages = _table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page_no"), "text")
    return long_texts.chunk_long_pages(pages, LOCAL, block=1 << 14).select(*_CHUNK_COLUMNS)


_BAD_LINE = """CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN '{''input'': ''single''}' WHEN 2 THEN '{"input": "x"} tail' WHEN 3 THEN '[{"input": "x"}, {"input": "y"}]'
    WHEN 4 THEN '{"input": NaN}' WHEN 5 THEN '{"input": ' || doc_id || '}' WHEN 6 THEN '{"doc_id": "' || doc_id || '", "input": "x"}' WHEN 7 THEN '{"input": "cut' """


@_query("SELECT doc_id, text AS input, CASE WHEN doc_id % 10 = 8 THEN NULL ELSE lang END AS output FROM documents WHERE doc_id % 10 > 7")
def jsonl_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as JSON Lines, eight of ten lines blank, quoted wrong, with a tail, a list, NaN, of the wrong kind or cut off."""
    d = _table(spark, sf_dir, "documents")
    good = F.to_json(F.struct("doc_id", F.col("text").alias("input"), F.when(F.col("doc_id") % 10 != 8, F.col("lang")).alias("output"), F.lit(1).alias("other")), {"ignoreNullFields": "false"})
    path = shared_path(spark, "bad-lines")
    d.select(F.expr(_BAD_LINE + "END").alias("bad"), good.alias("good")).select(F.coalesce("bad", "good").alias("value")).write.text(path)
    return readers.jsonl(spark, path, "doc_id long, input string, output string")


_ITEM_PHRASES = r"""items AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: regexp_matches(x, '^[A-Za-z]{4,}$'))) AS w FROM benchmark),
    dictionary AS (SELECT w AS phrase, upper(w) AS replacement FROM items UNION SELECT left(w, 4), '<' || left(w, 4) || '>' FROM items WHERE left(w, 4) NOT IN (SELECT w FROM items) UNION SELECT w || ' ', '[' || w || '] ' FROM items)"""


def _phrase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark, their first four letters and themselves with a blank: phrases that begin one another."""
    words = F.filter(F.split("text", r"[ \n]+"), lambda x: x.rlike("^[A-Za-z]{4,}$"))
    w = _table(spark, sf_dir, "benchmark").select(F.explode(words).alias("w")).distinct()
    stems = w.select(F.left("w", F.lit(4)).alias("phrase")).distinct().join(w, F.col("phrase") == F.col("w"), "left_anti")
    out = w.select(F.col("w").alias("phrase"), F.upper("w").alias("replacement"))
    out = out.unionAll(stems.select("phrase", F.concat(F.lit("<"), "phrase", F.lit(">"))))
    return out.unionAll(w.select(F.concat("w", F.lit(" ")), F.concat(F.lit("["), "w", F.lit("] "))))


@_query(rf"""WITH RECURSIVE {_ITEM_PHRASES}, longest AS (SELECT max(length(phrase)) AS n FROM dictionary), stems AS (SELECT DISTINCT left(phrase, 4) AS stem FROM dictionary),
    places AS (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS i FROM (SELECT doc_id, text AS t FROM documents)),
    near AS (SELECT doc_id, i, substring(t, i, (SELECT n FROM longest)) AS s FROM places WHERE substring(t, i, 4) IN (SELECT stem FROM stems)),
    found AS (SELECT doc_id, i, max_by(replacement, length(phrase)) AS r, max(length(phrase)) AS n FROM near JOIN dictionary ON left(phrase, 4) = left(s, 4) AND starts_with(s, phrase) GROUP BY doc_id, i),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM found),
    jumps AS (SELECT a.doc_id, a.k, a.i, a.n, a.r, min(b.k) AS after FROM numbered a LEFT JOIN numbered b ON b.doc_id = a.doc_id AND b.k > a.k AND b.k <= a.k + a.n AND b.i >= a.i + a.n GROUP BY ALL),
    taken AS (SELECT doc_id, k, i, n, r, after FROM jumps WHERE k = 1 UNION ALL SELECT j.doc_id, j.k, j.i, j.n, j.r, j.after FROM taken x JOIN jumps j ON j.doc_id = x.doc_id AND j.k = x.after)
    SELECT doc_id, count(i)::BIGINT AS phrases, coalesce(sum(i * n), 0)::BIGINT AS places, md5(coalesce(string_agg(r, '|' ORDER BY i), '')) AS replaced FROM documents LEFT JOIN taken USING (doc_id) GROUP BY doc_id""")
def phrase_dictionary_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the leftmost longest phrases of a dictionary of thousands stand in whole texts, and what replaces them."""
    d = phrases.find_phrases(_table(spark, sf_dir, "documents").select("doc_id", "text"), _phrase_table(spark, sf_dir), "f")
    total = F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + x["at"] * x["size"] + x["size"])
    return d.select("doc_id", F.size("f").cast("long").alias("phrases"), total.alias("places"), F.md5(F.array_join(F.col("f.replacement"), "|")).alias("replaced"))


def _page_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "conversations")
    last = pages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    stream = spark.readStream.schema(pages.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/conversations.parquet*")
    return stream.join(last, "conv_id").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text", (F.col("turn") == F.col("last")).alias("is_last"))


def _run_stream(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    out = shared_path(spark, "stream")
    chunks.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("doc_id long, chunk_id int, chunk_text string").parquet(out)


@_query(_chunk_query(_PAGES, LOCAL))
def stream_chunks_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming form run to its end over the conversations, in one or more micro-batches."""
    return _run_stream(spark, stream_chunks(_page_stream(spark, sf_dir), LOCAL))


@_query(_chunk_query(_PAGES, LOCAL))
def stream_chunks_typed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by typed state in RocksDB."""
    with rocksdb(spark):
        return _run_stream(spark, stream_chunks_typed(_page_stream(spark, sf_dir), LOCAL))


# --- in SQL ---


@_query(_chunk_query(_PAGES, LOCAL))
def sql_page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of pages by a table function over a partitioned table."""
    sql.register(spark)
    pages = _conversation_pages(spark, sf_dir)
    return spark.sql("SELECT * FROM page_chunks(TABLE(SELECT doc_id, page_no, normalized_text(text) AS text FROM {pages}), 900, 120)", pages=pages)


@_query(f"WITH RECURSIVE {_chunks(_DOCS, API)} SELECT doc_id, chunk_id, 0 AS seg_id, {_norm('chunk_text')} AS seg_text FROM chunks")
def sql_lateral_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and their segments by lateral calls."""
    sql.register(spark)
    return spark.sql(
        "WITH d AS (SELECT doc_id, normalized_text(text) AS t FROM {d}), c AS (SELECT d.doc_id, c.chunk_id, c.chunk_text FROM d, LATERAL text_chunks(d.t, 1200, 80) c), "
        "n AS (SELECT doc_id, chunk_id, normalized_text(chunk_text) AS t FROM c) SELECT n.doc_id, n.chunk_id, s.seg_id, s.seg_text FROM n, LATERAL text_segments(n.t, 6) s",
        d=_table(spark, sf_dir, "documents"),
    )


@_query(_ITEMS_SQL)
def sql_answer_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    return spark.sql("SELECT d.doc_id, d.chunk_id, i.item_idx, i.name, i.rank, i.extra FROM {d} d, LATERAL answer_items(d.raw, 'lenient') i WHERE i.parsed_ok", d=_responses(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
