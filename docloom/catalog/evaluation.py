"""Answer metrics, ledgers, leaderboards, relational and window queries, boxes and events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.catalog import Catalog
from docloom.functions import geometry as G
from docloom.operators import answers as A
from docloom.operators import elements as E
from docloom.operators import matching as M
from docloom.operators import relational as R
from docloom.operators import sequences as S
from docloom.streaming import events as V

query = Catalog()

_PAIR = "pr AS (SELECT DISTINCT query_id, query, e2e_prediction AS p, ground_truth AS g FROM predictions)"
_PLAIN = "trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_ \\t\\n\\r\\f]', '', 'g'), ' ')"
_NF = "CASE WHEN p IS NULL OR g IS NULL OR p = '' OR g = '' THEN 0.0 WHEN upper(trim(p, ' ')) = 'NOT_FOUND' OR upper(trim(g, ' ')) = 'NOT_FOUND' THEN (upper(trim(p, ' ')) = upper(trim(g, ' ')))::INT::DOUBLE ELSE coalesce({s}, 0.0) END"
_W = "list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_ \\t\\n\\r\\f]', '', 'g'), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"
_COMMON = f"len(list_intersect({_W.format(c='p')}, {_W.format(c='g')}))::DOUBLE"
_F1 = _NF.format(s=f"2 * ({_COMMON} / nullif(len({_W.format(c='p')}), 0)) * ({_COMMON} / nullif(len({_W.format(c='g')}), 0)) / nullif({_COMMON} / nullif(len({_W.format(c='p')}), 0) + {_COMMON} / nullif(len({_W.format(c='g')}), 0), 0)")
_EM = _NF.format(s=f"({_PLAIN.format(c='p')} = {_PLAIN.format(c='g')})::INT::DOUBLE")
_PARTS = "list_distinct(list_transform(list_filter(regexp_split_to_array(lower({c}), '[,;\\n•|]|\\band\\b'), lambda x: trim(x, ' ') <> ''), lambda x: trim(regexp_replace(x, '[^\\p{{L}}\\p{{N}}_ \\t\\n\\r\\f]', '', 'g'), ' ')))"
_SET = _NF.format(s=f"(len({_PARTS.format(c='p')}) > 0 AND list_sort({_PARTS.format(c='p')}) = list_sort({_PARTS.format(c='g')}))::INT::DOUBLE")
_NUMS = "list_transform(regexp_extract_all(regexp_replace({c}, '[,$€£]', '', 'g'), '[-+]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)'), lambda x: try_cast(x AS DOUBLE))"
_NUM = f"CASE WHEN p IS NULL OR g IS NULL OR p = '' OR g = '' THEN 0.0 WHEN len({_NUMS.format(c='g')}) = 0 THEN {_SET} ELSE len(list_filter({_NUMS.format(c='g')}, lambda n: len(list_filter({_NUMS.format(c='p')}, lambda m: abs(m - n) / greatest(abs(n), 1e-6) <= 0.01 OR abs(m - n) <= 1e-4)) > 0))::DOUBLE / len({_NUMS.format(c='g')}) END"
_CONT = f"CASE WHEN p IS NULL OR g IS NULL OR {_PLAIN.format(c='p')} = '' OR {_PLAIN.format(c='g')} = '' THEN 0.0 ELSE (contains({_PLAIN.format(c='p')}, {_PLAIN.format(c='g')}) OR contains({_PLAIN.format(c='g')}, {_PLAIN.format(c='p')}))::INT::DOUBLE END"
_SIM = "CASE WHEN greatest(length(trim(coalesce(p, ''), ' ')), length(trim(coalesce(g, ''), ' '))) = 0 THEN 1.0 WHEN trim(coalesce(p, ''), ' ') = '' OR trim(coalesce(g, ''), ' ') = '' THEN 0.0 ELSE 1.0 - levenshtein(lower(trim(p, ' ')), lower(trim(g, ' ')))::DOUBLE / greatest(length(trim(p, ' ')), length(trim(g, ' '))) END"


def _pairs(t):
    return t("predictions").select("query_id", "query", F.col("e2e_prediction").alias("p"), F.col("ground_truth").alias("g")).dropDuplicates()


def _one(name, column):
    def build(t):
        return _pairs(t).select("query_id", F.round(column(F.col("p"), F.col("g")), 6).alias(name))

    return build


@query(f"WITH {_PAIR} SELECT query_id, round({_SET}, 6) AS set_em, round({_EM}, 6) AS exact_match FROM pr")
def set_em(t):
    """U3."""
    return _pairs(t).select("query_id", F.round(A.set_exact_match(F.col("p"), F.col("g")), 6).alias("set_em"), F.round(A.exact_match(F.col("p"), F.col("g")), 6).alias("exact_match"))


@query(f"WITH {_PAIR} SELECT query_id, round({_F1}, 6) AS token_f1 FROM pr")
def token_f1_set(t):
    return _pairs(t).select("query_id", F.round(A.token_scores(F.col("p"), F.col("g"))["f1"], 6).alias("token_f1"))


@query(f"WITH {_PAIR} SELECT query_id, round({_NUM}, 6) AS numeric_em FROM pr")
def numeric_em(t):
    return _one("numeric_em", A.numeric_match)(t)


@query(f"WITH {_PAIR} SELECT query_id, {_CONT} AS containment FROM pr")
def containment(t):
    return _one("containment", A.containment)(t)


@query()
def char_similarity(t):
    """E5; the edit distance of the SQL engine counts bytes, so there is no SQL for these texts."""
    return _one("char_similarity", A.char_similarity)(t)


@query()
def rouge_l(t):
    return _pairs(t).select("query_id", A.rouge_l("p", "g").alias("rouge_l"))


@query(f"WITH {_PAIR}, s AS (SELECT query_id, {_CONT} AS c, {_NUM} AS n, {_F1} AS f FROM pr) SELECT query_id, round(0.40 * f + 0.25 * c + 0.25 * n + 0.10 * f, 6) AS headline FROM s")
def headline_score(t):
    """E9 with the token F1 in place of a judge that is not there."""
    s = A.scored(_pairs(t), "p", "g")
    return s.select("query_id", F.round(A.headline({"llm_judge": F.col("token_f1"), "containment": F.col("containment"), "numeric_em": F.col("numeric_em"), "token_f1": F.col("token_f1")}), 6).alias("headline"))


@query(f"WITH pr AS (SELECT DISTINCT query_id, coalesce(query_type, 'none') AS query_type, retrieval_success, e2e_prediction AS p, ground_truth AS g FROM predictions), s AS (SELECT query_type, retrieval_success, {_CONT} AS c, {_NUM} AS n FROM pr) SELECT coalesce(query_type, 'ALL') AS query_type, count(*) AS n, round(avg(c), 6) AS containment, round(avg(n), 6) AS numeric_em, round(sum(CASE WHEN retrieval_success THEN c END) / nullif(sum(retrieval_success::INT), 0), 6) AS reader_success, sum((c = 1 AND NOT retrieval_success)::INT)::BIGINT AS false_positive FROM s GROUP BY ROLLUP (query_type)")
def evaluate_batch(t):
    """Means by query type and overall, success given retrieval, hits without retrieval."""
    p = t("predictions").select("query_id", F.coalesce("query_type", F.lit("none")).alias("query_type"), "retrieval_success", F.col("e2e_prediction").alias("p"), F.col("ground_truth").alias("g")).dropDuplicates()
    s = A.scored(p, "p", "g")
    hit = F.col("retrieval_success")
    out = s.rollup("query_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("containment"), 6).alias("containment"), F.round(F.avg("numeric_em"), 6).alias("numeric_em"),
        F.round(F.sum(F.when(hit, F.col("containment"))) / F.nullif(F.sum(hit.cast("int")), F.lit(0)), 6).alias("reader_success"), F.sum(((F.col("containment") == 1) & ~hit).cast("int")).alias("false_positive"),
    )
    return out.withColumn("query_type", F.coalesce("query_type", F.lit("ALL")))


@query("SELECT coalesce(o_orderpriority, 'ALL') AS model_key, round(coalesce(sum(o_totalprice), 0), 2) AS cost FROM orders WHERE o_orderstatus = 'F' GROUP BY ROLLUP (o_orderpriority)")
def cost_ledger_summary(t):
    """A3, A4: cost by model and in total for one run."""
    return t("orders").where("o_orderstatus = 'F'").rollup("o_orderpriority").agg(F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("cost")).select(F.coalesce("o_orderpriority", F.lit("ALL")).alias("model_key"), "cost")


@query("WITH m AS (SELECT p_brand AS model, round(avg(l_quantity), 4) AS score, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, n DESC, model) AS place FROM m) SELECT model, score, n, place, round(score - lead(score) OVER (ORDER BY place), 4) AS ahead FROM r")
def leaderboard_sorted(t):
    """Models by mean score with ties by name, and the lead over the next; the models are few by their nature."""
    m = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("model")).agg(F.round(F.avg("l_quantity"), 4).alias("score"), F.count(F.lit(1)).alias("n"))
    w = W.orderBy(F.desc("score"), F.desc("n"), "model")
    return m.select("model", "score", "n", F.row_number().over(w).cast("long").alias("place"), F.round(F.col("score") - F.lead("score").over(w), 4).alias("ahead"))


@query("SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, event_type FROM events GROUP BY event_type")
def latency_percentiles(t):
    """A18."""
    p = lambda q: F.expr(f"percentile(value, {q})")
    return t("events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@query("SELECT zone_class, count(*) FILTER (WHERE gt_text_status = 'checked') AS checked, count(*) FILTER (WHERE gt_text_status = 'second_reading') AS second_reading, count(*) FILTER (WHERE gt_text_status = 'no_text') AS no_text, count(*) FILTER (WHERE gt_text_status IS NULL OR gt_text_status NOT IN ('checked', 'second_reading', 'no_text')) AS other FROM medcore_text_gt_flat GROUP BY zone_class")
def pivot_class_model(t):
    """Counts by class, a column for each status."""
    known = ["checked", "second_reading", "no_text"]
    z = t("medcore_text_gt_flat").withColumn("_s", F.when(F.col("gt_text_status").isin(known), F.col("gt_text_status")).otherwise("other"))
    p = z.groupBy("zone_class").pivot("_s", [*known, "other"]).count()
    return p.select("zone_class", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*known, "other")])


@query("SELECT coalesce(zone_class, 'ALL') AS zone_class, round(sum(e) / sum(n), 6) AS micro, round(avg(e / n), 6) AS macro FROM (SELECT coalesce(zone_class, 'none') AS zone_class, abs(char_len - length(gt_text))::DOUBLE AS e, length(gt_text)::DOUBLE AS n FROM medcore_text_gt_flat WHERE length(gt_text) > 0 AND char_len IS NOT NULL) GROUP BY ROLLUP (zone_class)")
def ocr_micro_macro(t):
    """Pooled and mean error rates, here of the recorded lengths."""
    z = t("medcore_text_gt_flat").where("length(gt_text) > 0 and char_len is not null").select(F.coalesce("zone_class", F.lit("none")).alias("zone_class"), F.abs(F.col("char_len") - F.length("gt_text")).cast("double").alias("e"), F.length("gt_text").cast("double").alias("n"))
    out = z.rollup("zone_class").agg(F.round(F.sum("e") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("e") / F.col("n")), 6).alias("macro"))
    return out.withColumn("zone_class", F.coalesce("zone_class", F.lit("ALL")))


@query("SELECT chunk_id, arg_max(strategy, (ingested_at, coalesce(token_count, -1))) AS strategy, max(ingested_at)::VARCHAR AS ingested_at FROM chunks WHERE ingested_at IS NOT NULL GROUP BY chunk_id")
def latest_upsert(t):
    c = t("chunks").where("ingested_at is not null").select("chunk_id", "strategy", "ingested_at", F.coalesce("token_count", F.lit(-1)).alias("tc"))
    return R.latest(c, ["chunk_id"], ["ingested_at", "tc"]).select("chunk_id", "strategy", F.regexp_replace(F.col("ingested_at").cast("string"), "^$", "").alias("ingested_at"))


@query("SELECT doc_id FROM documents d WHERE source = 'forum' AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.source <> 'forum' AND sha256(o.text) = sha256(d.text))")
def manifest_antijoin(t):
    d = t("documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return R.known(d.where("source = 'forum'"), d.where("source <> 'forum'"), "h").select("doc_id")


@query("SELECT h AS cache_key, count(*) AS n, bool_or(hit) AS cached FROM (SELECT md5(e2e_prediction) AS h, md5(e2e_prediction) IN (SELECT md5(ground_truth) FROM predictions WHERE ground_truth IS NOT NULL) AS hit FROM predictions WHERE e2e_prediction IS NOT NULL) GROUP BY h")
def cache_miss_antijoin(t):
    """F49."""
    p = t("predictions")
    seen = p.where("ground_truth is not null").select(F.md5("ground_truth").alias("cache_key")).distinct().withColumn("hit", F.lit(True))
    asked = p.where("e2e_prediction is not null").groupBy(F.md5("e2e_prediction").alias("cache_key")).agg(F.count(F.lit(1)).alias("n"))
    return asked.join(seen, "cache_key", "left").select("cache_key", "n", F.coalesce("hit", F.lit(False)).alias("cached"))


@query("SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0) AS n_manual, coalesce(b.n, 0) AS n_forum FROM (SELECT lang, count(*) AS n FROM documents WHERE source = 'manual' AND lang IS NOT NULL GROUP BY lang) a FULL JOIN (SELECT lang, count(*) AS n FROM documents WHERE source = 'forum' AND lang IS NOT NULL GROUP BY lang) b ON a.lang = b.lang")
def class_union_fill(t):
    d = t("documents").where("lang is not null")
    return R.counts_with_fill(d.where("source = 'manual'"), d.where("source = 'forum'"), "lang", ("n_manual", "n_forum"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 5")
def worst_five(t):
    return R.head(t("events"), ["user_id"], [F.desc("value"), F.asc("event_id")], 5).select("user_id", "event_id", "value")


@query("SELECT event_id, lag(event_id) OVER w AS prev_id, lead(event_id) OVER w AS next_id, row_number() OVER w - 1 AS sequence_in_group, count(*) OVER (PARTITION BY user_id) AS total_in_group FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def chunk_pointers(t):
    return S.neighbours(t("events"), ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "prev_id", "next_id", F.col("sequence_in_group").cast("long").alias("sequence_in_group"), "total_in_group")


@query("SELECT user_id, run, min(event_id) AS first_id, count(*) AS n, any_value(event_type) AS event_type FROM (SELECT *, sum(s)OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS s FROM events)) GROUP BY user_id, run")
def label_runs(t):
    e = t("events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("_start", ~F.col("event_type").eqNullSafe(F.lag("event_type").over(w)))
    runs = S.islands(e, ["user_id"], ["ts", "event_id"], F.col("_start"), "run")
    return runs.groupBy("user_id", "run").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("event_type").alias("event_type"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_error FROM events")
def header_carry(t):
    e = t("events").withColumn("_h", F.when(F.col("event_type") == "error", F.col("event_id")))
    return S.carry_forward(e, ["user_id"], ["ts", "event_id"], "_h", "last_error").select("event_id", "last_error")


@query("SELECT user_id, cluster, count(*) AS n, round(min(value), 4) AS low, round(max(value), 4) AS high FROM (SELECT *, sum((value - prev > 1.0)::INT) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS c0, coalesce(sum((value - prev > 1.0)::INT) OVER (PARTITION BY user_id ORDER BY value RANGE UNBOUNDED PRECEDING), 0)::BIGINT AS cluster FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS prev FROM events)) GROUP BY user_id, cluster")
def gap_clusters(t):
    c = S.gap_clusters(t("events"), ["user_id"], "value", F.lit(1.0))
    return c.groupBy("user_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"))


@query("SELECT user_id, event_id FROM (SELECT *, sum(value) OVER w AS run, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE run <= 500 OR n = 1")
def context_trim(t):
    return S.trim_to_budget(t("events"), ["user_id"], ["ts", "event_id"], "value", 500).select("user_id", "event_id")


@query("SELECT doc_id, (CASE WHEN n = 0 THEN 0 WHEN n <= 60 THEN 1 ELSE ceil((n - 60) / 50.0) + 1 END)::BIGINT AS n_windows, n::BIGINT AS n_tokens FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM documents)")
def sliding_windows(t):
    from docloom.functions import text as X

    d = t("documents").select("doc_id", X.alnum_tokens("text").alias("k"))
    return d.select("doc_id", F.size(S.token_windows(F.col("k"), 60, 10)).cast("long").alias("n_windows"), F.size("k").cast("long").alias("n_tokens"))


@query()
def token_packing(t):
    """Greedy packs of sentences under a budget; the fold depends on what came before."""
    from docloom.functions import text as X

    d = t("documents").select("doc_id", F.transform(X.split_sentences("text"), lambda s: F.size(F.split(s, " ")).cast("long")).alias("sizes"))
    return d.select("doc_id", F.size("sizes").alias("n_sentences"), (F.array_max(S.pack(F.col("sizes"), 120)) + 1).alias("n_packs"))


_BOXES = "bx AS (SELECT DISTINCT ON (chunk_id) chunk_id, doc_filename, page, bbox_union.x0 AS x0, bbox_union.y0 AS y0, bbox_union.x1 AS x1, bbox_union.y1 AS y1 FROM chunks WHERE bbox_union IS NOT NULL AND page IS NOT NULL AND doc_filename IS NOT NULL ORDER BY chunk_id, bbox_union.x0, bbox_union.y0, bbox_union.x1, bbox_union.y1, page, doc_filename)"
_PAIRS = f"{_BOXES}, pp AS (SELECT a.chunk_id AS a_id, b.chunk_id AS b_id, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM bx a JOIN bx b USING (doc_filename, page) WHERE a.chunk_id <> b.chunk_id), g AS (SELECT *, sqrt(greatest(0, ax0 - bx1, bx0 - ax1) ** 2 + greatest(0, ay0 - by1, by0 - ay1) ** 2) AS gap, greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(ay1, by1) - greatest(ay0, by0)) AS inter FROM pp)"


def _boxes(t):
    c = t("chunks").where("bbox_union is not null and page is not null and doc_filename is not null")
    first = c.groupBy("chunk_id").agg(F.min(F.struct("bbox_union.x0", "bbox_union.y0", "bbox_union.x1", "bbox_union.y1", "page", "doc_filename")).alias("f"))
    return first.select("chunk_id", "f.doc_filename", "f.page", F.struct("f.x0", "f.y0", "f.x1", "f.y1").alias("bbox"))


@query(f"WITH {_PAIRS} SELECT a_id, b_id, round(coalesce(inter / nullif((ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - inter, 0), 0), 6) AS iou, round(gap, 4) AS gap FROM g WHERE a_id < b_id")
def iou_pairs(t):
    p = E.page_pairs(_boxes(t), ["doc_filename", "page"]).where("a_id < b_id")
    return p.select("a_id", "b_id", F.round(G.iou(F.col("a"), F.col("b")), 6).alias("iou"), F.round(G.gap(F.col("a"), F.col("b")), 4).alias("gap"))


@query(f"WITH {_PAIRS} SELECT a_id, arg_min(b_id, (round(gap, 9), b_id)) AS b_id, round(min(gap), 4) AS gap FROM g GROUP BY a_id")
def nearest_box(t):
    b = _boxes(t)
    p = E.page_pairs(b, ["doc_filename", "page"]).withColumn("gap", F.round(G.gap(F.col("a"), F.col("b")), 9))
    return p.groupBy("a_id").agg(F.min_by("b_id", F.struct("gap", "b_id")).alias("b_id"), F.round(F.min("gap"), 4).alias("gap"))


@query(f"WITH {_PAIRS} SELECT a_id, b_id FROM g WHERE gap <= 60 AND coalesce(greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) / nullif(least(ax1 - ax0, bx1 - bx0), 0), 0) >= 0.3 QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY gap, b_id) <= 3")
def spatial_neighbours(t):
    return E.spatial_neighbours(_boxes(t), ["doc_filename", "page"]).select("a_id", "b_id")


@query(f"WITH {_BOXES} SELECT doc_filename, count(*) AS n, round(min(x0), 4) AS x0, round(min(y0), 4) AS y0, round(max(x1), 4) AS x1, round(max(y1), 4) AS y1 FROM bx GROUP BY doc_filename")
def union_bbox(t):
    b = _boxes(t)
    return b.groupBy("doc_filename").agg(F.count(F.lit(1)).alias("n"), *[F.round(f(f"bbox.{c}"), 4).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))])


@query(f"WITH {_BOXES} SELECT a.chunk_id, count(b.chunk_id) AS n_refs, coalesce(string_agg(b.chunk_id, ' ' ORDER BY b.chunk_id), '') AS refs FROM bx a LEFT JOIN bx b ON a.doc_filename = b.doc_filename AND a.page = b.page AND a.chunk_id <> b.chunk_id GROUP BY a.chunk_id")
def copage_xref(t):
    """J18."""
    b = _boxes(t)
    pairs = E.page_pairs(b, ["doc_filename", "page"]).groupBy("a_id").agg(F.array_sort(F.collect_set("b_id")).alias("r"))
    return b.join(pairs, b["chunk_id"] == pairs["a_id"], "left").select("chunk_id", F.coalesce(F.size("r"), F.lit(0)).cast("long").alias("n_refs"), F.coalesce(F.array_join("r", " "), F.lit("")).alias("refs"))


@query(f"WITH {_PAIRS}, seeds AS (SELECT chunk_id AS query_id, chunk_id AS item_id FROM bx), e AS (SELECT query_id, item_id, 0 AS hop FROM seeds UNION ALL SELECT query_id, b_id, 1 FROM seeds JOIN g ON a_id = item_id), f AS (SELECT query_id, item_id, min(hop) AS hop FROM e GROUP BY ALL) SELECT query_id, item_id, hop::BIGINT AS hop, row_number() OVER (PARTITION BY query_id ORDER BY hop, item_id) AS place FROM f QUALIFY place <= 4")
def expand_context(t):
    b = _boxes(t)
    seeds = b.select(F.col("chunk_id").alias("query_id"), F.col("chunk_id").alias("item_id"), F.lit(1).alias("rank"))
    edges = E.page_pairs(b, ["doc_filename", "page"]).select(F.col("a_id").alias("src_id"), F.col("b_id").alias("dst_id"))
    return E.expand_context(seeds, edges, 4).select("query_id", "item_id", F.col("hop").cast("long").alias("hop"), F.col("place").cast("long").alias("place"))


@query()
def citation_edges(t):
    c = t("chunks").select("chunk_id", "doc_filename", "page", "text", "element_types").dropDuplicates(["chunk_id", "page"])
    return E.citation_edges(c, c.where("array_contains(element_types, 'table')"))


@query("WITH o AS (SELECT doc_filename, e, count(DISTINCT chunk_id) AS n FROM (SELECT doc_filename, chunk_id, unnest(source_element_indices) AS e FROM chunks) GROUP BY ALL) SELECT doc_filename, count(*) AS covered, sum((n > 1)::INT)::BIGINT AS duplicated, (max(e) - min(e) + 1 - count(*))::BIGINT AS missing FROM o GROUP BY doc_filename")
def element_coverage(t):
    return E.coverage(t("chunks"))


@query("SELECT DISTINCT chunk_id, check_name FROM (SELECT chunk_id, unnest([CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'empty_text' END, CASE WHEN coalesce(token_count, 0) <= 0 THEN 'no_tokens' END, CASE WHEN coalesce(len(source_element_indices), 0) <= 0 THEN 'no_elements' END, CASE WHEN NOT coalesce(bbox_union.x1 > bbox_union.x0 AND bbox_union.y1 > bbox_union.y0, false) THEN 'bad_box' END, CASE WHEN NOT coalesce(list_contains(page_span, page), false) THEN 'page_span' END, CASE WHEN coalesce(contains(text, chr(65533)), false) THEN 'bad_char' END]) AS check_name FROM chunks) WHERE check_name IS NOT NULL")
def corpus_checks(t):
    return E.checks(t("chunks"))


@query(f"WITH {_BOXES}, c AS (SELECT *, CASE WHEN x1 - x0 >= 350 THEN 0 WHEN (x0 + x1) / 2 < 295 THEN 1 ELSE 2 END AS column_no FROM bx), s AS (SELECT *, sum((column_no = 0)::INT) OVER (PARTITION BY doc_filename, page ORDER BY y0, x0, chunk_id ROWS UNBOUNDED PRECEDING)::BIGINT AS slice_no FROM c) SELECT chunk_id, slice_no, column_no, row_number() OVER (PARTITION BY doc_filename, page ORDER BY slice_no, column_no, y0, x0, chunk_id)::INT AS reading_order FROM s")
def reading_order_columns(t):
    """W7, W8 on the boxes of chunks."""
    return S.column_order(_boxes(t), ["doc_filename", "page"], key="chunk_id").select("chunk_id", "slice_no", "column_no", "reading_order")


def _flat(t):
    return _boxes(t).select("doc_filename", "page", F.col("chunk_id").alias("box_id"), F.col("bbox.x0").alias("x0"), F.col("bbox.y0").alias("y0"), F.col("bbox.x1").alias("x1"), F.col("bbox.y1").alias("y1"), F.lit("text").alias("label"))


@query()
def greedy_match(t):
    """Chunks against the same boxes moved by a tenth of their size."""
    a = _flat(t)
    b = a.withColumns({"x0": F.col("x0") + (F.col("x1") - F.col("x0")) * 0.1, "x1": F.col("x1") + (F.col("x1") - F.col("x0")) * 0.1})
    return M.match_pages(a, b, ["doc_filename", "page"], 0.5, "greedy")


@query()
def optimal_match(t):
    a = _flat(t)
    b = a.withColumns({"y0": F.col("y0") + 1.0, "y1": F.col("y1") + 1.0})
    return M.match_pages(a, b, ["doc_filename", "page"], 0.5, "optimal")


@query()
def reading_bands(t):
    return M.reading_bands(_flat(t), ["doc_filename", "page"]).select("box_id", "line_no", "reading_order")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start FROM events GROUP BY event_type, start")
def events_tumbling(t):
    w = t("events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select("event_type", "n", "total", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"))


@query("SELECT strftime(b - INTERVAL (k) HOUR, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS b, unnest([0, 1]) AS k FROM events) GROUP BY start")
def events_sliding(t):
    w = t("events").groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL)::INT AS s FROM events)) GROUP BY user_id, g")
def events_session(t):
    s = t("events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))
    return s.select("user_id", "n", "first_id")


def _folder(df):
    """The folder that holds events.parquet."""
    return df.inputFiles()[0].rsplit("/events.parquet", 1)[0]


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_events FROM events GROUP BY user_id")
def stream_job_state(t):
    """R3 as a stream that is run to its end; the SQL is the batch equivalent."""
    return V.run_available(V.latest_state(_stream(t)), "complete").select("user_id", "state", "n_events")


@query("SELECT event_id, event_type FROM events")
def stream_dedup(t):
    """The stream joined with itself delivers each event twice; the result has each once. Keys are held for a day of event time."""
    one = _stream(t)
    twice = one.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return V.run_available(V.once(twice, late="1 day")).select("event_id", "event_type")


def _stream(t):
    e = t("events")
    return V.read_events(e.sparkSession, _folder(e))


@query("WITH f AS (SELECT user_id, min((ts, event_id)) AS first FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type = 'purchase' AS closed FROM events LEFT JOIN f USING (user_id) WHERE first IS NULL OR (ts, event_id) <= first")
def stream_progress(t):
    """Progress of each job up to its first terminal event, with a state that ends by itself."""
    return V.run_available(V.job_progress(_stream(t), ["purchase"])).select("user_id", "event_id", "step", "closed")


@query("SELECT status, count(*) AS n, coalesce(sum(event_id), 0)::BIGINT AS ids FROM (SELECT event_id, CASE WHEN event_type = 'error' OR user_id = 13 THEN 'failed' ELSE 'done' END AS status FROM events) GROUP BY status")
def stream_failures(t):
    """Errors and all events of one job go to the dead letters."""
    done, dead = V.run_split(V.with_failures(_stream(t), F.when((F.col("event_type") != "error") & (F.col("user_id") != 13), F.col("value"))))
    both = done.select("status", "event_id").unionByName(dead.select("status", "event_id"))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def progress_list(t):
    """R9."""
    return V.progress_list(t("events"), 3).select("user_id", "event_id")


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def expired_jobs(t):
    """Older than a week at the time of the last event."""
    e = t("events")
    now = e.agg(F.max("ts")).first()[0]
    return V.expired(e, F.lit(now).cast("timestamp_ntz")).select("event_id")


@query("SELECT event_type, strftime(start, '%Y-%m-%d %H:%M') AS start, n, total FROM (SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_tumbling(t):
    """Windows that the watermark, a day behind the last event, has closed."""
    w = V.run_available(V.tumbling(_stream(t)))
    return w.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("total", 2).alias("total"))


@query("SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, n FROM (SELECT b - INTERVAL (k) HOUR AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS b, unnest([0, 1]) AS k FROM events) GROUP BY start) WHERE start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_sliding(t):
    w = V.run_available(V.sliding(_stream(t)))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("SELECT user_id, n FROM (SELECT user_id, count(*) AS n, max(ts) + INTERVAL 30 MINUTE AS until FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL)::INT AS s FROM events)) GROUP BY user_id, g) WHERE until <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_sessions(t):
    return V.run_available(V.sessions(_stream(t))).select("user_id", "n")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_events FROM events GROUP BY user_id")
def stream_state_updates(t):
    """As above in update mode, merged by job."""
    return V.run_available(V.latest_state(_stream(t)), "update", ["user_id"]).select("user_id", "state", "n_events")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(t):
    li = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, c_mktsegment, count(DISTINCT o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, c_mktsegment)")
def order_cube(t):
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.cube("n_name", "c_mktsegment").agg(F.count_distinct("o_orderkey").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
