"""Text and number functions over documents, chunks, cells and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog import Catalog
from docloom.functions import numeric as N
from docloom.functions import text as X

query = Catalog()

ABBREV = "[" + ", ".join(f"'{a}'" for a in X.ABBREVIATIONS) + "]"
ABBREV_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in X.ABBREVIATIONS.items()) + "}"
ENTITY_SQL = (
    "list_sort(list_distinct(list_concat(regexp_extract_all(lower(coalesce({c}, '')), '" + X.ENTITY + "'), "
    "list_transform(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '" + X.ENTITY + "'), lambda t: list_contains(" + ABBREV + ", t)), lambda t: " + ABBREV_MAP + "[t]))))"
)


def entity_sql(c: str) -> str:
    return ENTITY_SQL.replace("{c}", c)


WORDS_SQL = "list_filter(regexp_split_to_array(coalesce({c}, ''), '[ \\t\\n\\r\\f]+'), lambda t: t <> '')"


@query(f"SELECT doc_id, len(toks)::BIGINT AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM (SELECT doc_id, {entity_sql('text')} AS toks FROM documents)")
def tok_entity(t):
    return t("documents").select("doc_id", X.entity_tokens("text").alias("k")).select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.md5(F.array_join("k", " ")).alias("tokens_md5"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::BIGINT AS n_distinct FROM documents")
def tok_alnum(t):
    return t("documents").select("doc_id", X.alnum_tokens("text").alias("k")).select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.size(F.array_distinct("k")).cast("long").alias("n_distinct"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))::BIGINT AS n_words FROM documents")
def tok_unicode(t):
    return t("documents").select("doc_id", F.size(X.word_tokens("text")).cast("long").alias("n_words"))


@query(f"SELECT doc_id, len(p)::BIGINT AS n_parts, array_to_string(p, ' ') AS parts FROM (SELECT doc_id, list_filter({entity_sql('text')}, lambda x: regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-z_.-]')) AS p FROM documents)")
def part_numbers(t):
    return t("documents").select("doc_id", X.part_numbers("text").alias("p")).select("doc_id", F.size("p").cast("long").alias("n_parts"), F.array_join("p", " ").alias("parts"))


@query("SELECT doc_id, len(s)::BIGINT AS n_sentences, list_max(list_transform(s, lambda x: length(x)))::BIGINT AS longest FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents)")
def sentences(t):
    return t("documents").select("doc_id", X.split_sentences("text").alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


@query("SELECT doc_id, md5(regexp_replace(text, '([A-Za-z0-9_]+)-[ \\t\\n\\r\\f]+([A-Za-z0-9_]+)', '\\1\\2', 'g')) AS repaired_md5, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')) AS collapsed_md5 FROM documents")
def hyphen_repair(t):
    return t("documents").select("doc_id", F.md5(X.repair_hyphens("text")).alias("repaired_md5"), F.md5(X.collapse_space("text")).alias("collapsed_md5"))


@query("SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(lower(doc_stem), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), 1, 50) || '_' || substr(sha256(text), 1, 8) AS slug FROM documents")
def slug_ids(t):
    return t("documents").select("doc_id", X.document_slug("doc_stem", "text").alias("slug"))


@query("SELECT doc_id, sha256(text) AS content_hash, md5(coalesce(lang, '') || ':' || text) AS cache_key FROM documents")
def doc_sha256(t):
    """F48."""
    return t("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.md5(F.concat(F.coalesce("lang", F.lit("")), F.lit(":"), F.col("text"))).alias("cache_key"))


_SCALE = "MAP {" + ", ".join(f"'{k}': {v!r}::DOUBLE" for k, v in N.UNIT_SCALE.items()) + "}"
_CATEGORY = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in N.UNIT_CATEGORY.items()) + "}"


@query(f"""WITH p AS (SELECT cell_id, extracted_at, regexp_extract(trim(raw_value, ' '), '^([+-]?[0-9]+(?:\\.[0-9]+)?)[ \\t]*([a-zA-Z°μµ%]+)?$', 1) AS v, lower(regexp_extract(trim(raw_value, ' '), '^([+-]?[0-9]+(?:\\.[0-9]+)?)[ \\t]*([a-zA-Z°μµ%]+)?$', 2)) AS u FROM table_cells WHERE raw_value IS NOT NULL)
SELECT cell_id, round(CASE WHEN v <> '' THEN v::DOUBLE * coalesce({_SCALE}[u], 1.0) END, 9) AS base_value, CASE WHEN v <> '' THEN CASE WHEN u = '' THEN 'dimensionless' ELSE coalesce({_CATEGORY}[u], u) END END AS category FROM p""")
def unit_parse(t):
    return t("table_cells").where("raw_value is not null").select("cell_id", N.unit_value("raw_value").alias("u")).select("cell_id", F.round("u.base_value", 9).alias("base_value"), F.col("u.category").alias("category"))


@query("""WITH p AS (SELECT cell_id, trim(raw_value, ' ') AS s, regexp_extract(trim(raw_value, ' '), '\\(([0-9,.]+)\\)', 1) AS i FROM table_cells),
q AS (SELECT cell_id, i <> '' OR s LIKE '-%' AS neg, regexp_replace(CASE WHEN i <> '' THEN i WHEN s LIKE '-%' THEN substr(s, 2) ELSE s END, '[$,% \\t\\n]', '', 'g') AS b FROM p)
SELECT cell_id, CASE WHEN regexp_matches(b, '^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?$') THEN CASE WHEN neg THEN -try_cast(b AS DOUBLE) ELSE try_cast(b AS DOUBLE) END END AS amount FROM q""")
def money_parse(t):
    return t("table_cells").select("cell_id", N.money("raw_value").alias("amount"))


@query("SELECT query_id, len(n)::BIGINT AS n_numbers, round(list_sum(n), 4) AS total FROM (SELECT query_id, list_filter(list_transform(regexp_extract_all(coalesce(e2e_prediction, ''), '\\b[0-9](?:[0-9,.]*[0-9])?\\b'), lambda x: try_cast(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL) AS n FROM (SELECT DISTINCT query_id, e2e_prediction FROM predictions WHERE e2e_prediction NOT LIKE '%(%' AND e2e_prediction NOT LIKE '%)%')) WHERE len(n) > 0")
def numbers_in_text(t):
    p = t("predictions").select("query_id", "e2e_prediction").where("not contains(e2e_prediction, '(') and not contains(e2e_prediction, ')')").dropDuplicates()
    n = N.numbers("e2e_prediction")
    return p.select("query_id", n.alias("n")).where("size(n) > 0").select("query_id", F.size("n").cast("long").alias("n_numbers"), F.round(F.aggregate("n", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


_DERIVATION = "CASE l_linenumber % 6 WHEN 0 THEN '(' || a || ' - ' || b || ') / ' || b WHEN 1 THEN a || ' + ' || b WHEN 2 THEN a || ' - ' || b WHEN 3 THEN '(' || a || ' + ' || b || ') / 2' WHEN 4 THEN a || ' / ' || b ELSE '' END"


@query(f"""WITH d AS (SELECT {_DERIVATION} AS d FROM (SELECT l_linenumber, l_quantity::BIGINT::VARCHAR AS a, (l_linenumber + 1)::VARCHAR AS b FROM lineitem)),
c AS (SELECT CASE WHEN d = '' THEN 'UNKNOWN' WHEN (contains(d, '+') OR contains(d, '-')) AND contains(d, '/') AND contains(d, '(') THEN CASE WHEN regexp_matches(d, '/ *[0-9]+\\b') THEN 'AVERAGE' WHEN contains(d, '-') THEN 'PERCENTAGE_CHANGE' ELSE 'MULTI_STEP' END WHEN contains(d, '+') THEN 'SUM' WHEN contains(d, '-') THEN 'DIFFERENCE' WHEN contains(d, '/') THEN 'RATIO' ELSE 'OTHER' END AS op FROM d)
SELECT coalesce(op, 'ALL') AS op, count(*) AS n FROM c GROUP BY ROLLUP (op)""")
def derivation_class(t):
    a, b = F.col("l_quantity").cast("long").cast("string"), (F.col("l_linenumber") + 1).cast("string")
    k = F.col("l_linenumber") % 6
    d = (
        F.when(k == 0, F.concat(F.lit("("), a, F.lit(" - "), b, F.lit(") / "), b)).when(k == 1, F.concat(a, F.lit(" + "), b)).when(k == 2, F.concat(a, F.lit(" - "), b))
        .when(k == 3, F.concat(F.lit("("), a, F.lit(" + "), b, F.lit(") / 2"))).when(k == 4, F.concat(a, F.lit(" / "), b)).otherwise("")
    )
    return t("lineitem").select(N.operation(d).alias("op")).rollup("op").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("op", F.lit("ALL")).alias("op"), "n")


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS line, round(CASE l_linenumber % 5 WHEN 0 THEN a + b WHEN 1 THEN (a + b) / 2 WHEN 2 THEN a - b WHEN 3 THEN a / nullif(b, 0) ELSE (a - b) / nullif(b, 0) * 100 END, 6) AS result FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_discount AS b FROM lineitem)""")
def derivation_exec(t):
    k = F.col("l_linenumber") % 5
    op = F.when(k == 0, "SUM").when(k == 1, "AVERAGE").when(k == 2, "DIFFERENCE").when(k == 3, "RATIO").otherwise("PERCENTAGE_CHANGE")
    return t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.round(N.derive(F.array("l_extendedprice", "l_discount"), op), 6).alias("result"))


@query()
def expression_eval(t):
    """F44 through the expression grammar; not expressible in SQL."""
    text = F.concat(F.lit("("), F.col("l_extendedprice").cast("string"), F.lit(" - "), F.col("l_quantity").cast("string"), F.lit(") / ["), (F.col("l_linenumber") - 1).cast("string"), F.lit("]"))
    return t("lineitem").select("l_orderkey", "l_linenumber", N.evaluate_expression(text).alias("result"))


@query("""SELECT count(*) AS n, sum((abs(p - g) <= 0.01 OR abs(p - g) / greatest(abs(g), 1.0) <= 0.001 OR abs(p * 100 - g) <= 0.01 OR abs(p * 100 - g) / greatest(abs(g), 1.0) <= 0.001 OR abs(p / 100 - g) <= 0.01 OR abs(p / 100 - g) / greatest(abs(g), 1.0) <= 0.001)::BIGINT)::BIGINT AS n_match FROM (SELECT l_extendedprice AS p, l_extendedprice * (1 + l_tax / 100) AS g FROM lineitem)""")
def numeric_match(t):
    p = F.col("l_extendedprice")
    return t("lineitem").select(N.numeric_match(p, p * (1 + F.col("l_tax") / 100)).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("m").cast("long")).alias("n_match"))


@query("SELECT doc_id, contains(text, chr(65533)) AS bad_char, regexp_matches(text, 'aaaa|bbbb|cccc|dddd|eeee|ffff|gggg|hhhh|iiii|jjjj|kkkk|llll|mmmm|nnnn|oooo|pppp|qqqq|rrrr|ssss|tttt|uuuu|vvvv|wwww|xxxx|yyyy|zzzz|AAAA|BBBB|CCCC|DDDD|EEEE|FFFF|GGGG|HHHH|IIII|JJJJ|KKKK|LLLL|MMMM|NNNN|OOOO|PPPP|QQQQ|RRRR|SSSS|TTTT|UUUU|VVVV|WWWW|XXXX|YYYY|ZZZZ') AS repeated, regexp_matches(text, '[a-z]- [a-z]') AS open_hyphen, regexp_matches(text, '[ﬀ-ﬄ]') AS ligature FROM documents")
def text_quality_flags(t):
    return t("documents").select("doc_id", *[c.alias(n) for n, c in X.quality_flags("text").items()])


@query(f"""WITH w AS (SELECT doc_id, {WORDS_SQL.replace('{c}', 'lower(text)')} AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 10),
c AS (SELECT doc_id, max(n) AS most FROM (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id) SELECT documents.doc_id, coalesce(most >= 4, false) AS repeats FROM documents LEFT JOIN c USING (doc_id)""")
def trigram_degeneration(t):
    """F66."""
    found = X.repeated_trigrams(t("documents"), "doc_id", "text").withColumn("repeats", F.lit(True))
    return t("documents").select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("repeats", F.lit(False)).alias("repeats"))


@query("SELECT id, md5(lower(trim(regexp_replace(gt_text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' '))) AS ocr_md5, translate(lower(zone_class), '-_ ', '') AS class_key FROM (SELECT DISTINCT id, gt_text, zone_class FROM medcore_text_gt_flat)")
def ocr_normalize(t):
    return t("medcore_text_gt_flat").select("id", "gt_text", "zone_class").dropDuplicates().select("id", F.md5(X.normalize_ocr("gt_text")).alias("ocr_md5"), X.normalize_key("zone_class").alias("class_key"))


_INTENT = f"""CASE WHEN contains(q, 'table') OR contains(q, 'column') OR contains(q, 'row label') OR contains(q, 'cell value') OR contains(q, 'grid') OR contains(q, 'row 0') THEN 'table' WHEN list_has_any({entity_sql('q')}, [{', '.join(repr(w) for w in X.PROSE_SIGNALS)}]) OR len({WORDS_SQL.replace('{c}', 'q')}) > 5 THEN 'prose' ELSE 'table' END"""


@query(f"SELECT query_id, {_INTENT} AS intent, regexp_matches(query, '\\b[A-Za-z]{{1,4}}-?[0-9]{{3,}}') OR regexp_matches(query, '[0-9]{{5,}}') AS is_spec FROM (SELECT DISTINCT query_id, query, lower(trim(query, ' ')) AS q FROM predictions)")
def query_intent(t):
    return t("predictions").select("query_id", "query").dropDuplicates().select("query_id", X.query_intent("query").alias("intent"), X.is_spec_query("query").alias("is_spec"))


@query(f"""WITH p AS (SELECT DISTINCT chunk_id, regexp_extract(text, '([><]=?|=)[ \\t\\n]*([0-9]+(?:\\.[0-9]+)?)[ \\t\\n]*([a-zA-Z°μµ%]+)?', 1) AS op, regexp_extract(text, '([><]=?|=)[ \\t\\n]*([0-9]+(?:\\.[0-9]+)?)[ \\t\\n]*([a-zA-Z°μµ%]+)?', 2) AS v, lower(regexp_extract(text, '([><]=?|=)[ \\t\\n]*([0-9]+(?:\\.[0-9]+)?)[ \\t\\n]*([a-zA-Z°μµ%]+)?', 3)) AS u FROM chunks)
SELECT chunk_id, op, round(v::DOUBLE * coalesce({_SCALE}[u], 1.0), 9) AS target, {_CATEGORY}[u] AS category FROM p WHERE op <> ''""")
def predicate_parse(t):
    p = t("chunks").select("chunk_id", N.predicate("text").alias("p")).where("p.op is not null")
    return p.select("chunk_id", F.col("p.op").alias("op"), F.round("p.target", 9).alias("target"), F.col("p.category").alias("category")).distinct()


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(lower(text), '\\b(?:figure|fig\\.)[ \\t\\n]*([0-9]+)', 1), lambda n: 'figure:' || n), list_transform(regexp_extract_all(lower(text), '\\b(?:table|tab\\.)[ \\t\\n]*([0-9]+)', 1), lambda n: 'table:' || n)))), ' ') AS cited FROM documents")
def citations(t):
    return t("documents").select("doc_id", F.array_join(X.citations("text"), " ").alias("cited"))


@query("SELECT DISTINCT chunk_id, CASE WHEN n = '' THEN 0 ELSE len(string_split(n, '.')) END::BIGINT AS level, s AS section_slug FROM (SELECT chunk_id, regexp_extract(text, '^[ ]*([0-9]+(?:\\.[0-9]+)*)', 1) AS n, CASE WHEN z = '' THEN 'sec' ELSE z END AS s FROM (SELECT *, regexp_replace(lower(regexp_replace(substr(coalesce(parent_section, ''), 1, 30), '[^a-zA-Z0-9]', '_', 'g')), '^_+|_+$', '', 'g') AS z FROM chunks))")
def heading_levels(t):
    return t("chunks").select("chunk_id", X.heading_level("text").cast("long").alias("level"), X.section_slug("parent_section").alias("section_slug")).distinct()


@query("""WITH l AS (SELECT chunk_id, unnest(list_filter(string_split(text, chr(10)), lambda s: trim(s, ' ') LIKE '|%' AND NOT regexp_matches(s, '^[ |:\\-]+$'))) AS s FROM (SELECT DISTINCT chunk_id, text FROM chunks)) SELECT chunk_id, count(*) AS n_rows, max(len(string_split(regexp_replace(trim(s, ' '), '^\\||\\|$', '', 'g'), '|')))::BIGINT AS n_columns FROM l GROUP BY chunk_id""")
def markdown_tables(t):
    rows = t("chunks").select("chunk_id", "text").dropDuplicates().select("chunk_id", F.explode(X.markdown_rows("text")).alias("r"))
    return rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("r")).cast("long").alias("n_columns"))


_PLAIN = r"regexp_replace(text, '[ªµºÀ-ÖØ-öø-žʼ\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Devanagari}ー]', '_', 'g')"


@query(f"WITH k AS (SELECT doc_id, list_filter(regexp_extract_all({_PLAIN}, '\\b[A-Z][a-zA-Z0-9\\-]{{2,}}\\b|\\b[0-9]+[.0-9]*[ \\t\\n\\r\\f]*[a-zA-Z]+\\b'), lambda x: length(x) > 3) AS l FROM documents), d AS (SELECT doc_id, l, list_transform(l, lambda x: lower(x)) AS low FROM k) SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(low, lower(x)) = i)[1:15], ',') AS terms FROM d WHERE len(l) > 0")
def key_terms(t):
    """F22, U6."""
    return t("documents").select("doc_id", X.key_terms("text").alias("k")).where("size(k) > 0").select("doc_id", F.array_join("k", ",").alias("terms"))


_ANY = lambda c, words: "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), '{w}')" for w in words) + ")"
_DOMAIN = "CASE " + " ".join(f"WHEN {_ANY('doc_stem', p)} OR {_ANY('text', w)} THEN '{n}'" for n, (p, w) in X.DOMAINS.items()) + " ELSE 'general' END"


@query(f"SELECT {_DOMAIN} AS domain, count(*) AS n FROM documents GROUP BY 1")
def domain_class(t):
    return t("documents").select(X.document_domain(F.col("doc_stem"), F.col("text")).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT chunk_id, page AS first_page, (page + len(source_element_indices) % 4)::INTEGER AS last_page, (1 + len(source_element_indices) % 4)::BIGINT AS n_pages FROM chunks WHERE page IS NOT NULL AND source_element_indices IS NOT NULL")
def page_ranges(t):
    c = t("chunks").where("page is not null and source_element_indices is not null")
    pages = X.gold_pages(F.concat(F.lit("see p."), F.col("page").cast("string"), F.lit("-"), (F.col("page") + F.size("source_element_indices") % 4).cast("string")))
    return c.select("chunk_id", pages.alias("p")).select("chunk_id", F.array_min("p").alias("first_page"), F.array_max("p").alias("last_page"), F.size("p").cast("long").alias("n_pages")).distinct()


@query("""WITH l AS (SELECT doc_id, unnest(s[1:30]) AS x, generate_subscripts(s[1:30], 1) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda z: trim(z, ' ') <> '') AS s FROM documents))
SELECT doc_id, count(*) AS n_lines, sum((x LIKE '%:%')::BIGINT)::BIGINT AS n_keyed, md5(string_agg(CASE WHEN x LIKE '%:%' THEN trim(split_part(x, ':', 1), ' ') ELSE 'line_' || i END, '|' ORDER BY i)) AS keys_md5 FROM l GROUP BY doc_id""")
def lines_to_kv(t):
    """P22."""
    lines = F.slice(F.filter(F.split("text", "\n"), lambda z: F.trim(z) != ""), 1, 30)
    keyed = t("documents").select("doc_id", lines.alias("s")).where("size(s) > 0")
    keys = F.transform("s", lambda x, i: F.when(x.contains(":"), F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).otherwise(F.concat(F.lit("line_"), (i + 1).cast("string"))))
    return keyed.select("doc_id", F.size("s").cast("long").alias("n_lines"), F.size(F.filter("s", lambda x: x.contains(":"))).cast("long").alias("n_keyed"), F.md5(F.array_join(keys, "|")).alias("keys_md5"))


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def json_props(t):
    """F65."""
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_id, ('{\"k\": ' || (json_extract(props, '$.k')) || '}') AS answer FROM events")
def json_from_answer(t):
    text = F.concat(F.lit("<think>so { }</think> ```json\n"), F.col("props"), F.lit("\n```"))
    return t("events").select("event_id", X.fenced_json(text).alias("answer"))


@query("SELECT query_id, round(0.1 + 0.9 * coalesce(len(list_intersect(g, c))::DOUBLE / nullif(len(g), 0), 0.0), 6) AS grounded FROM (SELECT DISTINCT query_id, list_distinct(regexp_extract_all(lower(coalesce(ground_truth, '')), '[a-z0-9]+')) AS g, list_distinct(regexp_extract_all(lower(coalesce(array_to_string(retrieval_context, ' '), '')), '[a-z0-9]+')) AS c, ground_truth, retrieval_context FROM predictions)")
def groundedness(t):
    p = t("predictions").select("query_id", "ground_truth", "retrieval_context").dropDuplicates()
    return p.select("query_id", F.round(X.groundedness(F.array_join("retrieval_context", " "), F.col("ground_truth")), 6).alias("grounded"))


@query(f"SELECT doc_id, len(w)::BIGINT AS n_tokens, md5(CASE WHEN len(w) > 50 THEN array_to_string(w[1:50], ' ') ELSE text END) AS cut_md5 FROM (SELECT doc_id, text, {WORDS_SQL.replace('{c}', 'text')} AS w FROM documents)")
def truncate_tokens(t):
    return t("documents").select("doc_id", X.token_count("text").cast("long").alias("n_tokens"), F.md5(X.truncate_tokens("text", 50)).alias("cut_md5"))


@query()
def point_ids(t):
    """version 5 UUIDs of chunk ids in the DNS namespace; SQL has no such function."""
    return t("chunks").select("chunk_id").distinct().select("chunk_id", X.uuid5("6ba7b8109dad11d180b400c04fd430c8", "chunk_id").alias("point_id"))


@query("SELECT doc_id, coalesce(tag, 'default') AS access FROM (SELECT doc_id, CASE WHEN contains(doc_stem, 'catalogue') THEN 'public' WHEN contains(doc_stem, 'contract') THEN 'legal' WHEN contains(doc_stem, 'invoice') THEN 'finance' END AS tag FROM documents)")
def access_tags(t):
    """P3."""
    rules = [("catalogue", "public"), ("contract", "legal"), ("invoice", "finance")]
    out = None
    for part, tag in rules:
        hit = F.col("doc_stem").contains(part)
        out = F.when(hit, tag) if out is None else out.when(hit, tag)
    return t("documents").select("doc_id", F.coalesce(out, F.lit("default")).alias("access"))
