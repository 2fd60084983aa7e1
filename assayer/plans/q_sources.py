"""Registered queries of extraction, snapshots and uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.plans.adapters import entity, oracle, stage, table
from assayer.session import shared_folder
from assayer.sources import extraction as E
from assayer.sources import snapshots as S
from assayer.sources import uploads as U

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def pipe(column):
    return F.array_join(column, "|")


# --- table rows -----------------------------------------------------------------------------------


def table_rows(spark, d):
    """Every text line is a table row; its length decides whether it shows a reference."""
    lines = table(spark, d, "documents").select(
        F.col("source").alias("source_document"), F.col("lang").alias("section"), F.col("doc_id").alias("source_page"),
        F.posexplode(F.split("text", "\n")).alias("row_index", "line"),
    )
    n = F.length("line")
    reference = F.when(n > 120, F.concat(F.lit("A"), n.cast("string"), F.lit("\nsee"))).when(n > 90, "see above").otherwise("")
    return lines.select("source_document", "section", "source_page", "row_index", F.array(reference, F.col("line")).alias("cells"))


_ROWS = """l AS (SELECT source, lang, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
    r AS (SELECT source AS source_document, lang AS section, doc_id AS source_page, CAST(i AS INT) AS row_index, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line,
            CASE WHEN length(line) > 120 THEN 'A' || length(line) WHEN length(line) > 90 THEN 'see above' ELSE '' END AS ref FROM l),
    k AS (SELECT *, starts_with(ref, 'A') AS opens FROM r WHERE ref || line <> ''),
    s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY source_document, section ORDER BY source_page, row_index) AS island FROM k)"""


@register(
    "stitch_continuation_rows",
    f"""WITH {_ROWS} SELECT source_document, section, source_page, row_index,
          CASE WHEN island = 0 THEN 'unassigned' WHEN opens THEN 'opening' ELSE 'continuation' END AS kind,
          CASE WHEN island > 0 THEN first_value(ref) OVER (PARTITION BY source_document, section, island ORDER BY source_page, row_index) END AS reference_number,
          CASE WHEN island > 0 AND NOT opens AND ref <> '' THEN 'nonstandard_reference_fragment:' || ref END AS flag FROM s""",
)
def _(spark, d):
    return E.stitch_continuation_rows(table_rows(spark, d)).select(
        "source_document", "section", "source_page", "row_index", "kind", "reference_number", "flag"
    )


@register(
    "finalize_raw_record",
    f"""WITH {_ROWS}, g AS (SELECT source_document, section, island, min_by(ref, (source_page, row_index)) AS reference_number, min((source_page, row_index)) AS pos_,
            md5(regexp_replace(string_agg(line, chr(10) ORDER BY source_page, row_index) FILTER (WHERE line <> ''), '^\\s+|\\s+$', '', 'g')) AS text_md5,
            array_to_string(list_sort(list(DISTINCT source_page)), '|') AS source_pages, count(*) AS fragments,
            bool_or(NOT opens AND ref <> '') AS odd, count(DISTINCT source_page) > 1 AS spans,
            array_to_string(list_sort(list(DISTINCT source_page % 13) FILTER (row_index % 3 = 1)), '|') AS footnote_references
          FROM s WHERE island > 0 GROUP BY source_document, section, island)
        SELECT 'raw-' || source_document || '-' || lower(section) || '-' || lower(reference_number) AS raw_record_id, pos_[1] AS island_page, text_md5, source_pages, fragments,
          concat_ws('|', CASE WHEN spans THEN 'entry_spans_multiple_pages' END, CASE WHEN odd THEN 'nonstandard_reference_fragment:see above' END) AS extraction_flags, coalesce(footnote_references, '') AS footnote_references FROM g""",
)
def _(spark, d):
    rows = table_rows(spark, d)
    stitched = E.stitch_continuation_rows(rows)
    references = rows.filter("row_index % 3 = 1").select(
        "source_document", "section", "source_page", "row_index", (F.col("source_page") % 13).cast("string").alias("footnote_number")
    )
    df = E.finalize_raw_record(stitched, ["reference_raw", "text"], references)
    return df.select(
        "raw_record_id", "island_page", F.md5("text").alias("text_md5"), pipe("source_pages").alias("source_pages"), "fragments",
        pipe("extraction_flags").alias("extraction_flags"), pipe("footnote_references").alias("footnote_references"),
    )


@register(
    "jurisdiction_notes",
    oracle(
        "records",
        """l AS (SELECT raw_record_id, unnest(string_split(source_text, chr(10))) AS line FROM records)
           SELECT DISTINCT raw_record_id, trim(line) AS note FROM l WHERE regexp_matches(lower(line), 'singapore|indonesia|malaysia|thailand|lao pdr')""",
    ),
)
def _(spark, d):
    return E.jurisdiction_notes(entity(spark, d, "records"))


def characters(spark, d):
    text = F.when(F.col("event_type") == "view", "(").when(F.col("event_type") == "click", "1").when(
        F.col("event_type") == "error", "2").when(F.col("event_type") == "purchase", ")").otherwise("x")
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, d, "events").select(
        F.col("user_id").alias("page"), F.col("event_id").alias("seq"), text.alias("text"),
        (F.col("value") % 50).alias("x"), second.cast("double").alias("y"), F.col("value").alias("size"),
    )


@register(
    "superscript_footnote_refs",
    """WITH c AS (SELECT user_id AS page, event_id AS seq, CASE event_type WHEN 'view' THEN '(' WHEN 'click' THEN '1' WHEN 'error' THEN '2' WHEN 'purchase' THEN ')' ELSE 'x' END AS text,
          value % 50 AS x, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS y, value AS size FROM events),
        b AS (SELECT DISTINCT page, CAST(floor(y / 7200) AS BIGINT) AS row_id FROM c),
        p AS (SELECT c.*, b.row_id FROM c JOIN b ON b.page = c.page AND c.y BETWEEN b.row_id * 7200 AND b.row_id * 7200 + 7000 AND c.x BETWEEN 0 AND 45),
        m AS (SELECT page, row_id, median(size) AS md FROM p GROUP BY ALL),
        w AS (SELECT *, lead(text, 1) OVER o AS t1, lead(text, 2) OVER o AS t2, lead(text, 3) OVER o AS t3, lead(size, 1) OVER o AS s1, lead(size, 2) OVER o AS s2, lead(size, 3) OVER o AS s3
              FROM p WINDOW o AS (PARTITION BY page, row_id ORDER BY seq)),
        h AS (SELECT page, row_id, CASE WHEN t2 = ')' THEN t1 ELSE t1 || t2 END AS footnote_number, CASE WHEN t2 = ')' THEN greatest(size, s1, s2) ELSE greatest(size, s1, s2, s3) END AS big
              FROM w WHERE text = '(' AND t1 IN ('1', '2') AND (t2 = ')' OR (t2 IN ('1', '2') AND t3 = ')')))
        SELECT DISTINCT h.page, h.row_id, footnote_number FROM h JOIN m ON m.page = h.page AND m.row_id = h.row_id WHERE big <= md * 0.8""",
)
def _(spark, d):
    chars = characters(spark, d)
    boxes = chars.select("page", F.floor(F.col("y") / 7200).cast("bigint").alias("row_id")).distinct().select(
        "page", "row_id", F.lit(0.0).alias("x0"), F.lit(45.0).alias("x1"),
        (F.col("row_id") * 7200).cast("double").alias("top"), (F.col("row_id") * 7200 + 7000).cast("double").alias("bottom"),
    )
    return E.superscript_footnote_refs(chars, boxes)


@register(
    "extract_footnotes",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
       SELECT doc_id, CASE WHEN i = 0 THEN '1' ELSE '12' END AS footnote_number, count(*) AS notes,
              min(md5(regexp_replace(CASE WHEN i = 0 THEN '(1) ' ELSE '(12) ' END || line, '^\\s+|\\s+$', '', 'g'))) AS first_md5 FROM l GROUP BY ALL""",
)
def _(spark, d):
    marked = F.concat(F.lit("(1) "), F.replace("text", F.lit("\n"), F.lit("\n(12) ")))
    notes = E.extract_footnotes(table(spark, d, "documents").select("doc_id", marked.alias("text")))
    return notes.groupBy("doc_id", "footnote_number").agg(F.count("*").alias("notes"), F.min(F.md5("source_text")).alias("first_md5"))


@register(
    "extract_bare_footnotes",
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations)
       SELECT conv_id, turn, CASE WHEN i = 0 THEN '1' ELSE '7' END AS footnote_number, count(*) AS notes,
              min(md5(regexp_replace(CASE WHEN i = 0 THEN '1 Thesesubstances ' ELSE '7 ' END || line, '^\\s+|\\s+$', '', 'g'))) AS first_md5 FROM l GROUP BY ALL""",
)
def _(spark, d):
    marked = F.concat(F.lit("Heading\n1 Thesesubstances "), F.replace("text", F.lit("\n"), F.lit("\n7 ")), F.lit("\nPART III\n8 other"))
    notes = E.extract_footnotes(table(spark, d, "conversations").select("conv_id", "turn", marked.alias("text")), "bare")
    return notes.groupBy("conv_id", "turn", "footnote_number").agg(F.count("*").alias("notes"), F.min(F.md5("source_text")).alias("first_md5"))


@register(
    "category_hierarchy",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
        k AS (SELECT *, regexp_matches(line, '^[A-M]') AS cat, regexp_matches(line, '^[N-Z]') AS sub FROM l),
        g AS (SELECT *, sum(CASE WHEN cat THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM k)
        SELECT doc_id, 'category-' || CASE WHEN n < 10 THEN '0' ELSE '' END || CAST(n AS VARCHAR) AS category_id,
               min(md5(regexp_replace(line, '^\\s+|\\s+$', '', 'g'))) FILTER (WHERE cat) AS name_md5, CAST(count(*) FILTER (WHERE sub) AS INT) AS subcategories FROM g WHERE n > 0 GROUP BY doc_id, n""",
)
def _(spark, d):
    marked = F.regexp_replace(F.regexp_replace("text", "(?dm)^([A-M])", "• $1"), "(?dm)^([N-Z])", "o $1")
    df = E.category_hierarchy(table(spark, d, "documents").select("doc_id", marked.alias("text")))
    return df.select("doc_id", "category_id", F.md5("original_text").alias("name_md5"), F.size("subcategories").alias("subcategories"))


@register(
    "category_exclusions",
    "SELECT p_partkey, p_brand AS excluded_product_text FROM part WHERE p_size > 25",
)
def _(spark, d):
    text = F.concat("p_name", F.when(F.col("p_size") > 25, F.concat(F.lit(" (With the exception of "), "p_brand", F.lit(" )"))).otherwise(""))
    return E.category_exclusions(table(spark, d, "part").select("p_partkey", text.alias("original_text"))).select(
        "p_partkey", "excluded_product_text"
    )


_TURN = """CASE role WHEN 'user' THEN 'Contents of cosmetic products' || chr(10) || 'x 6. (1) ' || text || chr(10) || '(2) second'
    WHEN 'assistant' THEN text || chr(10) || '(3) third' || chr(10) || 'Labelling of cosmetic products' ELSE text END"""


@register(
    "extract_provisions",
    f"""WITH t AS (SELECT conv_id, string_agg({_TURN}, chr(10) ORDER BY turn) AS full_text FROM conversations GROUP BY 1),
        s AS (SELECT conv_id, substr(full_text, strpos(full_text, 'Contents of cosmetic products')) AS rest, strpos(full_text, 'Contents of cosmetic products') AS pos_ FROM t),
        r AS (SELECT conv_id, CASE WHEN pos_ > 0 AND strpos(rest, 'Labelling of cosmetic products') > 0 THEN substr(rest, 1, strpos(rest, 'Labelling of cosmetic products') - 1) END AS body FROM s),
        p AS (SELECT conv_id, 'p-1' AS provision_id, regexp_extract(body, '(?s)(6\\.\\W*\\(1\\).*?)\\n\\(2\\)', 1) AS x FROM r
              UNION ALL SELECT conv_id, 'p-2', regexp_extract(body, '(?s)\\n(\\(2\\).*?)\\n\\(3\\)', 1) FROM r
              UNION ALL SELECT conv_id, 'p-7', regexp_extract(body, '(?s)\\n(\\(3\\).*)', 1) FROM r)
        SELECT conv_id AS source_document, provision_id, CASE WHEN x <> '' THEN md5(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) END AS text_md5 FROM p""",
)
def _(spark, d):
    c = table(spark, d, "conversations")
    text = F.when(
        F.col("role") == "user", F.concat(F.lit("Contents of cosmetic products\nx 6. (1) "), "text", F.lit("\n(2) second"))
    ).when(F.col("role") == "assistant", F.concat("text", F.lit("\n(3) third\nLabelling of cosmetic products"))).otherwise(F.col("text"))
    pages = c.select(F.col("conv_id").alias("source_document"), F.col("turn").alias("source_page"), text.alias("text"))
    clauses = [("p-1", r"6\.\W*\(1\)", r"^\(2\)"), ("p-2", r"^\(2\)", r"^\(3\)"), ("p-7", r"^\(3\)", None)]
    df = E.extract_provisions(
        pages, "Contents of cosmetic products", "Labelling of cosmetic products", clauses,
        page_header="^Statutes Online Current version.*$",
    )
    return df.select("source_document", "provision_id", F.md5("source_text").alias("text_md5"))


def words(spark, d):
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    marker = F.col("event_type") == "signup"
    return table(spark, d, "events").select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("page"),
        F.when(marker, 50.0).otherwise(F.col("value") + 120).alias("x0"),
        (second.cast("double") / 125 + 100.5).alias("top"),
        F.when(marker, F.col("event_id").cast("string")).otherwise(F.col("event_type")).alias("text"),
    )


_WORDS = """w AS (SELECT user_id * 100 + day(ts) AS page, CASE WHEN event_type = 'signup' THEN 50.0 ELSE value + 120 END AS x0,
      CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) / 125 + 100.5 AS top, CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) ELSE event_type END AS text FROM events),
    m AS (SELECT page, CAST(text AS BIGINT) AS entry_number, top AS marker_top, coalesce(lead(top) OVER (PARTITION BY page ORDER BY top), 800.0) AS next_top
          FROM w WHERE x0 < 110 AND top > 100 AND top < 800),
    p AS (SELECT m.*, w.x0, w.top, w.text FROM m JOIN w ON w.page = m.page AND w.x0 >= 120 AND w.top >= m.marker_top - 2 AND w.top < m.next_top - 1 AND w.top < 800)"""


@register(
    "words_to_glossary_rows",
    f"""WITH {_WORDS} SELECT page, entry_number, string_agg(text, ' ' ORDER BY round(top, 1), x0, text) AS canonical_name FROM p GROUP BY ALL""",
)
def _(spark, d):
    return E.entry_lines(E.words_to_glossary_rows(words(spark, d))).select("page", "entry_number", "canonical_name")


@register(
    "page_diagnostics",
    f"""WITH {_WORDS}, e AS (SELECT DISTINCT page, entry_number, marker_top FROM p)
        SELECT page, count(*) AS record_count, min_by(entry_number, marker_top) AS first_entry, max_by(entry_number, marker_top) AS last_entry FROM e GROUP BY 1""",
)
def _(spark, d):
    return E.page_diagnostics(E.words_to_glossary_rows(words(spark, d)).select("page", "entry_number", "marker_top").distinct())


@register(
    "table_diagnostics",
    """SELECT l_orderkey AS source_document, l_linenumber % 3 AS source_page, count(*) FILTER (l_suppkey % 4 = 2) AS table_count,
              array_to_string(list(l_suppkey % 4 ORDER BY l_linenumber, l_partkey, l_suppkey % 4), ',') AS column_counts FROM lineitem GROUP BY ALL""",
)
def _(spark, d):
    tables = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("source_document"), (F.col("l_linenumber") % 3).alias("source_page"), F.struct("l_linenumber", "l_partkey").alias("table_index"),
        (F.col("l_suppkey") % 4).alias("column_count"),
    )
    found = E.table_diagnostics(tables, 2)
    return found.withColumn("column_counts", F.array_join(F.col("column_counts").cast("array<string>"), ","))


# --- snapshots ------------------------------------------------------------------------------------


# Raw documents: up to 1,000 consecutive orders each, a JSON object per file in a folder named by the document.
_RAW_DOCUMENTS = """r AS (SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) AS k, o_orderkey, o_orderpriority, o_orderstatus FROM orders),
    t AS (SELECT 'doc-' || k AS doc, '{"dataset_version":"v1","source_document":"doc-' || k || '","section":"Part ' || k % 3 || '","records":['
        || string_agg('{"raw_record_id":"' || o_orderkey || '","reference_number":"' || o_orderpriority || '","source_text":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']}' || chr(10) AS content
      FROM r GROUP BY k)"""


def raw_documents(spark, d):
    """Folder of raw documents, written from the orders; a document holds the orders of one range of keys."""

    def build():
        folder = shared_folder(spark, "raw-documents")
        k = F.floor(F.col("o_orderkey") / 1000).cast("bigint")
        text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
        record = text('{"raw_record_id":"', F.col("o_orderkey"), '","reference_number":"', F.col("o_orderpriority"), '","source_text":"', F.col("o_orderstatus"), '"}')
        grouped = table(spark, d, "orders").groupBy(k.alias("k")).agg(
            F.array_sort(F.collect_list(F.struct("o_orderkey", record.alias("record")))).alias("records")  # 1,000 at most
        )
        head = text('{"dataset_version":"v1","source_document":"doc-', F.col("k"), '","section":"Part ', F.col("k") % 3, '","records":[')
        body = F.array_join(F.transform("records", lambda r: r["record"]), ",")
        grouped.select(text("doc-", F.col("k")).alias("document"), F.concat(head, body, F.lit("]}")).alias("value")).write.partitionBy("document").text(folder)
        return folder

    return stage(spark, d, "raw-documents", build)


@register(
    "source_manifest",
    f"""WITH {_RAW_DOCUMENTS}, p AS (SELECT 'doc-' || CAST(floor(o_orderkey / 1000) AS BIGINT) AS doc, count(DISTINCT o_custkey % 50) AS pages FROM orders GROUP BY 1)
        SELECT doc AS source_document, sha256(content) AS sha256, CAST(octet_length(encode(content)) AS BIGINT) AS content_bytes, pages AS page_count, 'authority of ' || doc AS authority,
          'rev-1' AS document_revision, 'en' AS language FROM t JOIN p USING (doc)""",
)
def _(spark, d):
    files = S.read_source_files(spark, f"{raw_documents(spark, d)}/*/*", "document=([^/]+)/")
    document = F.concat(F.lit("doc-"), F.floor(F.col("o_orderkey") / 1000).cast("string"))
    orders = table(spark, d, "orders").select(document.alias("source_document"), (F.col("o_custkey") % 50).alias("source_page"))
    definitions = files.select(
        "source_document", F.concat(F.lit("authority of "), "source_document").alias("authority"), F.lit("rev-1").alias("document_revision"), F.lit("en").alias("language")
    )
    manifest = S.source_manifest(files, definitions, orders)
    return manifest.select("*", F.element_at("metadata", "language").alias("language")).drop("metadata")


@register(
    "load_raw_records",
    """SELECT CAST(o_orderkey AS VARCHAR) AS raw_record_id, 'v1' AS dataset_version, 'doc-' || CAST(floor(o_orderkey / 1000) AS BIGINT) AS source_document,
              'Part ' || CAST(floor(o_orderkey / 1000) AS BIGINT) % 3 AS section, o_orderpriority AS reference_number, o_orderstatus AS source_text, 'rev-1' AS document_revision FROM orders""",
)
def _(spark, d):
    folder = raw_documents(spark, d)
    files = S.read_source_files(spark, f"{folder}/*/*", "document=([^/]+)/")
    manifest = files.select("source_document", F.lit("rev-1").alias("document_revision"))
    records = S.load_raw_records(spark, f"{folder}/*/*", manifest)
    return records.select("raw_record_id", "dataset_version", "source_document", "section", "reference_number", "source_text", "document_revision")


@register(
    "snapshot_sink",
    oracle("rules", "SELECT 'v2' AS dataset_version, regulatory_section, count(*) AS rules, min(rule_id) AS first_rule FROM rules GROUP BY ALL"),
)
def _(spark, d):
    def write():
        path = shared_folder(spark, "snapshot")
        S.snapshot_sink(entity(spark, d, "rules"), path, "v2", ["rule_id"])
        return path

    written = spark.read.parquet(stage(spark, d, "snapshot-path", write))
    return written.groupBy("dataset_version", "regulatory_section").agg(F.count("*").alias("rules"), F.min("rule_id").alias("first_rule"))


def _digests(text: str, where: str = "true") -> str:
    """SQL of the fingerprints of documents by source."""
    columns = ("doc_id", "lang", "n_chars", "source", text)
    shown = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)
    parts = " || '-' || ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {at}, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR)" for at in (1, 17, 33, 49))
    return f"SELECT source AS item, count(*) AS row_count, {parts} AS fingerprint FROM (SELECT source, sha256({shown}) AS h FROM documents WHERE {where}) GROUP BY 1"


@register(
    "content_fingerprint",
    f"""WITH c AS ({_digests('text')}), a AS (SELECT * FROM ({_digests("CASE WHEN lang = 'de' THEN translate(text, 'en', 'ne') ELSE text END", "source <> 'src3'")}) UNION ALL SELECT 'retired', 0, '0-0-0-0')
       SELECT coalesce(a.item, c.item) AS item, CASE WHEN c.fingerprint IS NULL THEN 'missing' WHEN a.fingerprint IS NULL THEN 'extra' WHEN c.fingerprint <> a.fingerprint THEN 'changed' ELSE 'same' END AS status
       FROM a FULL OUTER JOIN c ON a.item = c.item""",
)
def _(spark, d):
    """The accepted side has some texts changed without a change of length."""
    docs = table(spark, d, "documents")
    older = docs.filter("source <> 'src3'").withColumn("text", F.when(F.col("lang") == "de", F.translate("text", "en", "ne")).otherwise(F.col("text")))
    prints = lambda df: S.row_fingerprint(df, ["source"]).select(F.col("source").alias("item"), "fingerprint")
    retired = spark.range(1).select(F.lit("retired").alias("item"), F.lit("0-0-0-0").alias("fingerprint"))
    return S.content_fingerprint(prints(docs), prints(older).unionByName(retired))


@register("row_fingerprint", _digests("text"))
def _(spark, d):
    return S.row_fingerprint(table(spark, d, "documents"), ["source"]).withColumnRenamed("source", "item")


@register(
    "version_consistency",
    "SELECT source AS source_table, lang AS dataset_version, count(*) AS row_count FROM documents WHERE lang <> 'en' GROUP BY ALL",
)
def _(spark, d):
    versions = table(spark, d, "documents").select(F.col("source").alias("source_table"), F.col("lang").alias("dataset_version"))
    return S.version_consistency(versions, "en")


# --- uploads --------------------------------------------------------------------------------------


def uploads(spark, d):
    orders = table(spark, d, "orders")
    key, price = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    lines = lambda sep: F.concat(
        F.lit(f"Ingredient{sep}Amount\n"), F.lit("GLYCERIN"), F.lit(sep), price, F.lit("\n"), F.lit("AQUA"), F.lit(sep), key, F.lit("\n")
    )
    content = (
        F.when(F.col("o_orderstatus") == "F", lines(";"))
        .when(F.col("o_orderstatus") == "P", lines("\t"))
        .otherwise(F.concat(F.lit('{"rows": [["Ingredient", "Amount"], ["GLYCERIN", '), price, F.lit('], ["AQUA", true], [null]]}')))
    )
    suffix = F.when(F.col("o_orderstatus") == "F", ".csv").when(F.col("o_orderstatus") == "P", ".TSV").otherwise(".json")
    return orders.select("o_orderkey", F.col("o_orderkey").alias("file_id"), F.concat(F.lit("formula"), suffix).alias("filename"), U.content_of(content).alias("content"))


@register(
    "upload_cells",
    """WITH g AS (SELECT o_orderkey AS file_id, o_orderstatus AS s, [['Ingredient', 'Amount'], ['GLYCERIN', CAST(o_custkey AS VARCHAR)],
           CASE WHEN o_orderstatus = 'O' THEN ['AQUA', 'TRUE'] ELSE ['AQUA', CAST(o_orderkey AS VARCHAR)] END] || CASE WHEN o_orderstatus = 'O' THEN [['']] ELSE [] END AS grid FROM orders),
        r AS (SELECT file_id, unnest(grid) AS cells, unnest(range(len(grid))) + 1 AS source_row FROM g)
        SELECT file_id, CAST(source_row AS INT) AS source_row, CAST(unnest(range(len(cells))) AS INT) AS source_column_index, unnest(cells) AS source_value FROM r""",
)
def _(spark, d):
    return U.upload_cells(uploads(spark, d))


@register(
    "grid_bounds_check",
    """SELECT c_custkey AS file_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'agent_csv_type_unsupported' WHEN 'AUTOMOBILE' THEN 'agent_csv_empty' WHEN 'FURNITURE' THEN 'agent_csv_too_many_rows'
              WHEN 'HOUSEHOLD' THEN 'agent_csv_too_many_columns' ELSE 'agent_csv_cell_too_large' END AS code FROM customer WHERE c_mktsegment <> 'MACHINERY' OR c_acctbal < 0""",
)
def _(spark, d):
    segment = F.col("c_mktsegment")
    content = (
        F.when(segment == "AUTOMOBILE", "")
        .when(segment == "FURNITURE", F.repeat(F.lit("a,b\n"), F.lit(501)))
        .when(segment == "HOUSEHOLD", F.repeat(F.lit("a,"), F.lit(50)))
        .when((segment == "MACHINERY") & (F.col("c_acctbal") < 0), F.concat(F.lit("a,b\nc,"), F.repeat(F.lit("x"), F.lit(8193))))
        .otherwise("a,b\n1,2\n")
    )
    files = table(spark, d, "customer").select(
        F.col("c_custkey").alias("file_id"), F.when(segment == "BUILDING", "f.docx").otherwise("f.csv").alias("filename"),
        U.content_of(content).alias("content"),
    )
    return U.grid_bounds_check(files)
