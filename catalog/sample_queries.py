"""Sampling and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

import catalog.label_queries  # noqa: F401
from catalog.ctes import with_ctes
from catalog.label_queries import u_sql
from catalog.registry import query
from catalog.source_queries import payload
from catalog.views import Views
from verstext.operators import evaluate, labels, sampling


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("sample_entries", with_ctes("entryversion", f"""
    SELECT id, entry_id, version FROM entryversion WHERE entry_id IN
      (SELECT entry_id FROM (SELECT DISTINCT entry_id FROM entryversion) ORDER BY {u_sql("CAST(entry_id AS VARCHAR)")}, entry_id LIMIT 100)"""))
def sample_entries(v: Views):
    return sampling.sample_entries(v.entryversion, 100).select("id", "entry_id", "version")


@query("bernoulli_by_source", with_ctes("sentences", f"""
    SELECT entry_id, version, sent_idx FROM (SELECT *, 500.0::DOUBLE / count(*) OVER (PARTITION BY source) AS rate FROM sentences)
    WHERE {u_sql("entry_id || '-' || version || '-' || sent_idx")} < rate"""))
def bernoulli_by_source(v: Views):
    keys = ["entry_id", "version", "sent_idx"]
    return sampling.bernoulli_by_source(v.sentences, keys, 500).select(*keys)


def _draw_sql(key: str, weight: str) -> str:
    return f"round(-ln({u_sql(key)} + pow(2, -33)) / ({weight}), 6)"


@query("inverse_frequency_sample", f"""
    WITH t AS (SELECT doc_id, lang, source, 1.0 / count(*) OVER (PARTITION BY lang) / count(*) OVER (PARTITION BY source) AS w FROM documents)
    SELECT doc_id, lang, source, {_draw_sql('CAST(doc_id AS VARCHAR)', 'w')} AS draw FROM t ORDER BY draw, doc_id LIMIT 200""")
def inverse_frequency_sample(v: Views):
    rows = v.documents.select("doc_id", "lang", "source")
    return sampling.inverse_frequency_sample(rows, ["doc_id"], ["lang", "source"], 200)


@query("balanced_eval_sample", f"""
    WITH f AS (SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
    a AS (SELECT doc_id, lang, source FROM (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY lang) AS w FROM f)
          ORDER BY {_draw_sql('CAST(doc_id AS VARCHAR)', 'w')}, doc_id LIMIT 200)
    SELECT doc_id, lang, source, {_draw_sql('CAST(doc_id AS VARCHAR)', 'w')} AS draw
    FROM (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY source) AS w FROM a) ORDER BY draw, doc_id LIMIT 100""")
def balanced_eval_sample(v: Views):
    rows = v.documents.select("doc_id", "lang", "source")
    return sampling.balanced_eval_sample(rows, v.labels_table, ["doc_id"], "lang", 200, 100)


@query("sample_rows", with_ctes("sentences", f"""
    SELECT entry_id, version, sent_idx, {u_sql("entry_id || '-' || version || '-' || sent_idx")} AS u FROM sentences
    ORDER BY u, entry_id, version, sent_idx LIMIT 500"""))
def sample_rows(v: Views):
    return sampling.sample_rows(v.sentences, ["entry_id", "version", "sent_idx"], 500).select("entry_id", "version", "sent_idx", "u")


@query("cutoff_sweep", with_ctes("matched", """
    , p AS (SELECT entry_id, version_x, version_y, sent_idx_x, sent_idx_y, least(avg_sentence_distance_x, avg_sentence_distance_y) AS d,
                   avg_sentence_distance_x IS NOT NULL AND avg_sentence_distance_y IS NOT NULL AS t FROM matched
            WHERE sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL),
    c AS (SELECT round(k * 0.02, 2) AS cutoff, k FROM (SELECT unnest(range(0, 31)) AS k)),
    s AS (SELECT cutoff, count(d) AS n, count(*) FILTER (t) AS hits FROM c LEFT JOIN p ON floor(round(d / 0.02, 6)) < k GROUP BY cutoff),
    q AS (SELECT cutoff::DOUBLE AS cutoff, hits / nullif(n, 0) AS p, hits / (SELECT count(*) FROM p WHERE t) AS r FROM s),
    f AS (SELECT *, 2 * p * r / nullif(p + r, 0) AS f FROM q)
    SELECT cutoff, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
           f IS NOT NULL AND row_number() OVER (ORDER BY f DESC NULLS LAST, cutoff) = 1 AS best FROM f"""))
def cutoff_sweep(v: Views):
    arcs = v.matched.where("sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL").withColumn("distance", F.least("avg_sentence_distance_x", "avg_sentence_distance_y"))
    truth = arcs.where("avg_sentence_distance_x IS NOT NULL AND avg_sentence_distance_y IS NOT NULL")
    return _rounded(evaluate.cutoff_sweep(arcs, truth), "precision", "recall", "f1")


# Truth and prediction on the test tables: the quality flag and the flag "not toxic".
LABELLED_SQL = """
    WITH t AS (SELECT l.doc_id, quality AS y, 1 - toxic AS p, lang, n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def _scored(v: Views):
    return v.labels_table.join(v.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        "doc_id", F.col("quality").alias("y"), (1 - F.col("toxic")).alias("p"), "lang", "n_chars")


def class_sql(by: str = "", truth: str = "y", pred: str = "p", source: str = "t") -> str:
    g = f"{by}, " if by else ""
    return f"""(SELECT {g}class, CAST(sum(a) AS BIGINT) AS support, CAST(sum(s) AS BIGINT) AS predicted, CAST(sum(h) AS BIGINT) AS hits,
         coalesce(sum(h) / nullif(sum(s), 0), 0.0) AS precision, coalesce(sum(h) / nullif(sum(a), 0), 0.0) AS recall,
         coalesce(2 * sum(h) / nullif(sum(a) + sum(s), 0), 0.0) AS f1
       FROM (SELECT {g}{truth} AS class, 1 AS a, 0 AS s, CAST({truth} = {pred} AS INTEGER) AS h FROM {source}
             UNION ALL SELECT {g}{pred}, 0, 1, 0 FROM {source}) GROUP BY {g}class)"""


OVERALL = """round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
    round(sum(hits) / sum(support), 6) AS micro_f1"""
OVERALL_COLS = ("macro_f1", "weighted_f1", "micro_f1")


@query("class_f1", LABELLED_SQL + """
    SELECT class, support, predicted, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM """ + class_sql())
def class_f1(v: Views):
    return _rounded(evaluate.class_f1(_scored(v), "y", "p"), "precision", "recall", "f1")


@query("overall_f1", LABELLED_SQL + f" SELECT {OVERALL} FROM " + class_sql())
def overall_f1(v: Views):
    return _rounded(evaluate.overall_f1(evaluate.class_f1(_scored(v), "y", "p")), *OVERALL_COLS)


@query("conditional_f1", LABELLED_SQL + f", u AS (SELECT *, y AS target FROM t) SELECT target, {OVERALL} FROM " + class_sql("target", source="u") + " GROUP BY target")
def conditional_f1(v: Views):
    return _rounded(evaluate.conditional_f1(_scored(v), "y", "p"), *OVERALL_COLS)


@query("mse", LABELLED_SQL + " SELECT lang, round(avg(pow(p - y, 2)), 6) AS mse FROM t GROUP BY lang")
def mse(v: Views):
    return _rounded(evaluate.mse(_scored(v), "y", "p", ["lang"]), "mse")


@query("baseline_scores", LABELLED_SQL + f""", m AS (SELECT *, (SELECT y FROM t GROUP BY y ORDER BY count(*) DESC, y LIMIT 1) AS majority,
       CAST(floor({u_sql('CAST(doc_id AS VARCHAR)')} * 2) AS INTEGER) AS guess FROM t)
    SELECT 'majority' AS baseline, {OVERALL} FROM """ + class_sql(pred="majority", source="m")
    + f" UNION ALL SELECT 'guess', {OVERALL} FROM " + class_sql(pred="guess", source="m"))
def baseline_scores(v: Views):
    return _rounded(evaluate.baseline_scores(_scored(v), "y", "doc_id", 2), *OVERALL_COLS)


# Tasks of crowd workers on the test tables: a worker answers with a number, the truth is another.
TASK_SQL = """
    WITH t AS (SELECT user_id, event_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
    a AS (SELECT *, (CAST(floor(value / 10) = floor(k / 10) AS INTEGER) + CAST(floor(value / 25) = floor(k / 25) AS INTEGER)
                   + CAST(floor(value / 50) = floor(k / 50) AS INTEGER) + CAST(floor(value / 100) = floor(k / 100) AS INTEGER)) / 4 AS accuracy FROM t)"""
WIDTHS = (10, 25, 50, 100)


def _tasks(v: Views):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = v.events.select("user_id", "event_id", "value", k.alias("k"))
    for w in WIDTHS:
        rows = rows.withColumn(f"said_{w}", F.floor(F.col("value") / w)).withColumn(f"true_{w}", F.floor(F.col("k") / w))
    return evaluate.worker_accuracy(rows, [(f"said_{w}", f"true_{w}") for w in WIDTHS])


@query("worker_accuracy", TASK_SQL + """
    SELECT user_id, round(avg(accuracy), 6) AS mean_accuracy, count(*) AS tasks FROM a GROUP BY user_id""")
def worker_accuracy(v: Views):
    return _rounded(evaluate.worker_means(_tasks(v), "user_id"), "mean_accuracy")


@query("rolling_mean", TASK_SQL + """
    SELECT user_id, event_id, row_number() OVER w - 1 AS position,
           round(CASE WHEN count(*) OVER r = 10 THEN avg(accuracy) OVER r END, 6) AS rolling_accuracy FROM a
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id), r AS (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING)""")
def rolling_mean(v: Views):
    out = evaluate.worker_trend(_tasks(v), "user_id", "event_id").select("user_id", "event_id", "position", "rolling_accuracy")
    return _rounded(out, "rolling_accuracy")


@query("worker_effort", """
    SELECT user_id, count(*) AS tasks, round(sum(value), 4) AS total_seconds FROM events GROUP BY user_id""")
def worker_effort(v: Views):
    return evaluate.worker_effort(v.events, "user_id", "value").withColumn("total_seconds", F.round("total_seconds", 4))


@query("minutes_histogram", "SELECT CAST(floor(value / 60) AS BIGINT) AS minutes, count(*) AS n FROM events GROUP BY 1")
def minutes_histogram(v: Views):
    return evaluate.minutes_histogram(v.events, "value")


@query("annotation_totals", with_ctes("matched sentences", """
    , s AS (SELECT entry_id, version, count(*) AS n FROM sentences GROUP BY ALL),
    p AS (SELECT x.n AS nx, y.n AS ny FROM s x JOIN s y ON x.entry_id = y.entry_id AND y.version = x.version + 1)
    SELECT (SELECT count(*) FROM matched WHERE sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL) AS connections,
           CAST(sum(nx + ny) AS BIGINT) AS nodes, CAST(sum(nx * ny) AS BIGINT) AS possible_connections FROM p"""))
def annotation_totals(v: Views):
    return evaluate.annotation_totals(payload.payload_nodes_arcs(v.matched, v.sentences))


@query("bin_accuracy", LABELLED_SQL + """
    , g AS (SELECT lang, avg(CAST(y = p AS INTEGER)) AS accuracy, count(*) AS n FROM t GROUP BY lang),
    f AS (SELECT lang, avg(f1) AS macro_f1 FROM """ + class_sql("lang") + """ GROUP BY lang)
    SELECT lang, round(accuracy, 6) AS accuracy, n, round(macro_f1, 6) AS macro_f1 FROM g JOIN f USING (lang)""")
def bin_accuracy(v: Views):
    return _rounded(evaluate.bin_accuracy(_scored(v), "y", "p", "lang"), "accuracy", "macro_f1")


@query("parse_logs", """
    SELECT upper(event_type) AS level, event_id AS step, event_type AS metric, value AS score FROM events""")
def parse_logs(v: Views):
    path = v.scratch("logs")
    body = F.to_json(F.struct(F.col("event_type").alias("metric"), F.col("value").alias("score")))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.upper("event_type"), F.lit("] step="),
                    F.col("event_id").cast("string"), F.lit(" "), body)
    noise = F.concat(F.lit("starting task "), F.col("event_id").cast("string"))
    v.events.select(F.explode(F.array(line, noise)).alias("value")).write.text(path)
    return evaluate.parse_logs(v.spark.read.text(path))


@query("parse_evaluations", """
    SELECT CAST(event_id AS DOUBLE) AS step, value AS eval_loss, event_type = 'view' AS no_f1 FROM events""")
def parse_evaluations(v: Views):
    path = v.scratch("evaluations")
    f1 = F.when(F.col("event_type") == "view", "nan").otherwise("0.5")
    line = F.concat(F.lit("INFO done {'eval_loss': "), F.col("value").cast("string"), F.lit(", 'f1': "), f1, F.lit(", 'step': "),
                    F.col("event_id").cast("string"), F.lit("}"))
    v.events.select(F.explode(F.array(line, F.lit("INFO {'loss': 1}"))).alias("value")).write.text(path)
    rows = evaluate.parse_evaluations(v.spark.read.text(path))
    return rows.select("scores.step", "scores.eval_loss", F.col("scores.f1").isNull().alias("no_f1"))


@query("parse_parameters", """
    SELECT doc_id, lang, CAST(n_chars AS VARCHAR) AS n_chars, doc_id % 2 = 0 AS has_block
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS n_chars FROM documents)""")
def parse_parameters(v: Views):
    block = F.concat(F.lit("MODEL PARAMS: \n{\n  "), F.expr("substring(to_json(struct(lang, n_chars)), 2)"))
    block = F.concat(F.regexp_replace(block, r"\}$", "\n}"), F.lit("\nepoch 1 {}\n"))
    logs = v.documents.select("doc_id", F.concat(F.lit("start\n"), F.when(F.col("doc_id") % 2 == 0, block).otherwise("no block\n")).alias("value"))
    rows = evaluate.parse_parameters(logs, ["doc_id"])
    return rows.select("doc_id", "params.lang", "params.n_chars", F.col("params").isNotNull().alias("has_block"))


@query("parse_predictions", """
    SELECT quality AS pred, doc_id || ', 0' AS doc_id, toxic AS y_true FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def parse_predictions(v: Views):
    line = F.concat(F.lit("["), F.col("quality").cast("string"), F.lit("] ("), F.col("doc_id").cast("string"), F.lit(", 0) {'y':"),
                    F.col("toxic").cast("string"), F.lit("}"))
    return evaluate.parse_predictions(v.labels_table.select(F.explode(F.array(line, F.lit("epoch [1]"))).alias("value")).where("value IS NOT NULL"))


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("results_pivot", "SELECT user_id, " + ", ".join(f"max(value) FILTER (event_type = '{k}') AS \"{k}\"" for k in KINDS)
       + " FROM events GROUP BY user_id")
def results_pivot(v: Views):
    return evaluate.results_pivot(v.events, "user_id", "event_type", "value", KINDS)


@query("best_results", """
    SELECT event_type, max(value) AS best, arg_min(user_id, {'v': -value, 'u': user_id}) AS trial FROM events GROUP BY event_type""")
def best_results(v: Views):
    return evaluate.best_results(v.events, "user_id", "event_type", "value")


@query("threshold_from_hist", with_ctes("near_vectors", """
    SELECT CAST(floor(round(distance, 6) * 50) AS BIGINT) AS bin, count(*) AS n FROM near_vectors GROUP BY 1"""))
def threshold_from_hist(v: Views):
    return evaluate.distance_histogram(v.near.withColumn("distance", F.round("distance", 6)), "distance", 50)
