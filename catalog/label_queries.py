"""Moves and edit-action labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.ctes import part, with_ctes
from catalog.registry import query
from catalog.views import Views
from verstext.operators import labels, moves

part("edges", ("matched",), """
    SELECT entry_id, version_x, version_y, sent_idx_x, sent_idx_y,
           dense_rank() OVER (PARTITION BY entry_id, version_x ORDER BY sent_idx_x) AS x,
           dense_rank() OVER (PARTITION BY entry_id, version_x ORDER BY sent_idx_y) AS y
    FROM matched WHERE sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL""")
part("crossed", ("edges",), """
    SELECT a.entry_id, a.version_x, a.version_y, a.sent_idx_x, a.sent_idx_y, a.x, a.y, count(b.x) AS crossings
    FROM edges a LEFT JOIN edges b ON a.entry_id = b.entry_id AND a.version_x = b.version_x AND (a.x - b.x) * (a.y - b.y) < 0
    GROUP BY ALL""")
# one edge is removed per step and pair of versions, as the rule says
part("removal", ("crossed",), """
    SELECT * FROM (WITH RECURSIVE r AS (
      SELECT 0 AS step, entry_id, version_x, sent_idx_x, sent_idx_y, x, y, crossings,
             row_number() OVER (PARTITION BY entry_id, version_x
               ORDER BY crossings DESC, abs(y - x) DESC, CAST(y >= x AS INTEGER), x, y) AS rn
      FROM crossed WHERE crossings > 0
      UNION ALL
      SELECT step + 1, entry_id, version_x, sent_idx_x, sent_idx_y, x, y, c,
             row_number() OVER (PARTITION BY entry_id, version_x
               ORDER BY c DESC, abs(y - x) DESC, CAST(y >= x AS INTEGER), x, y)
      FROM (SELECT k.step, k.entry_id, k.version_x, k.sent_idx_x, k.sent_idx_y, k.x, k.y,
                   k.crossings - CAST((k.x - g.x) * (k.y - g.y) < 0 AS INTEGER) AS c
            FROM r k JOIN r g ON g.entry_id = k.entry_id AND g.version_x = k.version_x AND g.rn = 1
            WHERE k.rn > 1)
      WHERE c > 0)
    SELECT * FROM r)""")
part("moved", ("removal",), "SELECT entry_id, version_x, sent_idx_x, sent_idx_y FROM removal WHERE rn = 1")


@query("crossing_edges", with_ctes("crossed", """
    SELECT entry_id, version_x, version_y, sent_idx_x, sent_idx_y, crossings FROM crossed"""))
def crossing_edges(v: Views):
    return moves.crossing_edges(v.matched)


@query("moved_edges", with_ctes("moved", "SELECT entry_id, version_x, sent_idx_x, sent_idx_y FROM moved"))
def moved_edges(v: Views):
    return moves.moved_edges(v.matched).drop("version_y")


@query("num_moves", with_ctes("matched moved", """
    SELECT p.entry_id, p.version_x, p.version_y, count(m.sent_idx_x) AS num_moves
    FROM (SELECT DISTINCT entry_id, version_x, version_y FROM matched) p
    LEFT JOIN moved m ON m.entry_id = p.entry_id AND m.version_x = p.version_x GROUP BY ALL"""))
def num_moves(v: Views):
    return moves.num_moves(v.matched, v.moved)


part("old_sents", ("sentences",), """
    SELECT source, entry_id, version, sent_idx, sentence FROM sentences s
    WHERE EXISTS (SELECT 1 FROM sentences o WHERE o.entry_id = s.entry_id AND o.version = s.version + 1)""")
part("l_deleted", ("old_sents", "matched"), """
    SELECT entry_id, version AS version_x, sent_idx AS sent_idx_x FROM old_sents s
    WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.entry_id = s.entry_id AND m.version_x = s.version AND m.sent_idx_x = s.sent_idx)
    UNION SELECT entry_id, version_x, sent_idx_x FROM matched WHERE sent_idx_y IS NULL""")
part("new_order", ("matched",), """
    SELECT entry_id, version_x, sent_idx_y, kept, row_number() OVER (PARTITION BY entry_id, version_x ORDER BY sent_idx_y) AS p
    FROM (SELECT entry_id, version_x, sent_idx_y, max(CAST(sent_idx_x IS NOT NULL AS INTEGER)) AS kept
          FROM matched WHERE sent_idx_y IS NOT NULL GROUP BY ALL)""")
part("l_additions", ("new_order", "matched"), """
    SELECT entry_id, version_x, sent_idx_x, max(nullif(p - prev - 1, 0)) AS add_above_label, max(nullif(nxt - p - 1, 0)) AS add_below_label
    FROM (SELECT k.entry_id, k.version_x, k.sent_idx_y, k.p,
                 coalesce(lag(k.p) OVER w, 0) AS prev, coalesce(lead(k.p) OVER w, n + 1) AS nxt
          FROM (SELECT *, count(*) OVER (PARTITION BY entry_id, version_x) AS n FROM new_order) k WHERE kept = 1
          WINDOW w AS (PARTITION BY k.entry_id, k.version_x ORDER BY k.p)) z
    JOIN matched m USING (entry_id, version_x, sent_idx_y)
    WHERE m.sent_idx_x IS NOT NULL AND (p - prev > 1 OR nxt - p > 1) GROUP BY ALL""")
part("l_edges", ("matched",), """
    SELECT entry_id, version_x, sent_idx_x, coalesce(avg_sentence_distance_x, avg_sentence_distance_y) AS d
    FROM matched WHERE sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL""")
part("labelled", ("old_sents", "l_deleted", "l_additions", "l_edges", "moved"), """
    SELECT s.source, s.entry_id, s.version, s.sent_idx, s.sentence,
           CAST(coalesce(max(deleted_label), 0) AS INTEGER) AS deleted_label, CAST(coalesce(max(add_above_label), 0) AS INTEGER) AS add_above_label,
           CAST(coalesce(max(add_below_label), 0) AS INTEGER) AS add_below_label, CAST(coalesce(max(edited_label), 0) AS INTEGER) AS edited_label,
           CAST(coalesce(max(unchanged_label), 0) AS INTEGER) AS unchanged_label, CAST(coalesce(min(move), 0) AS INTEGER) AS refactored_label
    FROM old_sents s LEFT JOIN (
      SELECT entry_id, version_x, sent_idx_x, 1 AS deleted_label, NULL AS add_above_label, NULL AS add_below_label, NULL AS edited_label, NULL AS unchanged_label, 0 AS move FROM l_deleted
      UNION ALL SELECT entry_id, version_x, sent_idx_x, NULL, add_above_label, add_below_label, NULL, NULL, 0 FROM l_additions
      UNION ALL SELECT entry_id, version_x, sent_idx_x, NULL, NULL, NULL, CAST(d > 0.01 AS INTEGER), CAST(d <= 0.01 AS INTEGER), 0 FROM l_edges
      UNION ALL SELECT entry_id, version_x, sent_idx_x, NULL, NULL, NULL, NULL, NULL, sent_idx_y - sent_idx_x FROM moved) l
    ON l.entry_id = s.entry_id AND l.version_x = s.version AND l.sent_idx_x = s.sent_idx
    GROUP BY s.source, s.entry_id, s.version, s.sent_idx, s.sentence""")
part("doc_labels", ("labelled",), """
    SELECT source, entry_id, version, CAST(sum(deleted_label) AS BIGINT) AS num_deleted, CAST(sum(add_above_label) AS BIGINT) AS num_added,
           CAST(sum(edited_label) AS BIGINT) AS num_edited, count(*) FILTER (refactored_label <> 0) AS num_refactored,
           string_agg(sentence, '<SENT>' ORDER BY sent_idx) AS sentences FROM labelled GROUP BY source, entry_id, version""")
part("stats", ("matched", "moved"), """
    SELECT s.*, coalesce(n, 0) AS num_moved FROM
      (SELECT entry_id, version_x, version_y, avg(avg_sentence_distance_x) AS mean_distance_x, avg(avg_sentence_distance_y) AS mean_distance_y,
              count(*) FILTER (sent_idx_x IS NULL) AS num_added, count(*) FILTER (sent_idx_y IS NULL) AS num_deleted FROM matched GROUP BY ALL) s
    LEFT JOIN (SELECT entry_id, version_x, count(*) AS n FROM moved GROUP BY ALL) m ON m.entry_id = s.entry_id AND m.version_x = s.version_x""")

OLD = ["entry_id", "version_x", "sent_idx_x"]


@query("label_deleted", with_ctes("l_deleted", "SELECT entry_id, version_x, sent_idx_x, 1 AS deleted_label FROM l_deleted"))
def label_deleted(v: Views):
    return labels.label_deleted(v.matched, v.sentences)


@query("label_additions", with_ctes("l_additions", """
    SELECT entry_id, version_x, sent_idx_x, CAST(add_above_label AS INTEGER) AS add_above_label,
           CAST(add_below_label AS INTEGER) AS add_below_label FROM l_additions"""))
def label_additions(v: Views):
    return labels.label_additions(v.matched)


@query("label_edited", with_ctes("l_edges", "SELECT DISTINCT entry_id, version_x, sent_idx_x, 1 AS edited_label FROM l_edges WHERE d > 0.01"))
def label_edited(v: Views):
    return labels.label_edited(v.matched)


@query("label_unchanged", with_ctes("l_edges", "SELECT DISTINCT entry_id, version_x, sent_idx_x, 1 AS unchanged_label FROM l_edges WHERE d <= 0.01"))
def label_unchanged(v: Views):
    return labels.label_unchanged(v.matched)


@query("label_edited_strict", with_ctes("matched", """
    SELECT DISTINCT entry_id, version_x, sent_idx_x, 1 AS edited_label FROM matched
    WHERE sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL AND avg_sentence_distance_x > 0.01"""))
def label_edited_strict(v: Views):
    return labels.label_edited(v.matched, strict=True)


@query("label_moved", with_ctes("moved", """
    SELECT entry_id, version_x, sent_idx_x, CAST(sent_idx_y - sent_idx_x AS INTEGER) AS refactored_label FROM moved"""))
def label_moved(v: Views):
    return labels.label_moved(v.matched, v.moved)


@query("sentence_labels", with_ctes("labelled", "SELECT * FROM labelled"))
def sentence_labels(v: Views):
    return v.make_labels()


@query("label_all_sentences", with_ctes("labelled", "SELECT * FROM labelled"))
def label_all_sentences(v: Views):
    """From the rows that have any label at all; the others must come back with zeros."""
    some = F.array_contains(F.array(*[F.col(c) != 0 for c in labels.LABELS]), True)
    found = v.sentence_labels.where(some).select(
        "entry_id", F.col("version").alias("version_x"), F.col("sent_idx").alias("sent_idx_x"), *labels.LABELS)
    return labels.label_all_sentences(found, v.sentences)


@query("doc_labels", with_ctes("doc_labels", "SELECT * FROM doc_labels"))
def doc_labels(v: Views):
    return v.doc_labels


@query("num_added_total", with_ctes("new_order", """
    SELECT entry_id, version_x, CAST(sum(1 - kept) AS BIGINT) AS num_added_total FROM new_order GROUP BY ALL"""))
def num_added_total(v: Views):
    return labels.num_added_total(v.matched)


@query("label_invariant", with_ctes("labelled", """
    SELECT entry_id, version, sent_idx, edited_label + unchanged_label + deleted_label AS num_classes FROM labelled
    WHERE edited_label + unchanged_label + deleted_label <> 1"""))
def label_invariant(v: Views):
    return labels.label_invariant(v.sentence_labels).select("entry_id", "version", "sent_idx", "num_classes")


STAT_COLS = "round(mean_distance_x, 6) AS mean_distance_x, round(mean_distance_y, 6) AS mean_distance_y, num_added, num_deleted, num_moved"


def _stats(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean_distance_x", "mean_distance_y")})


@query("pair_stats", with_ctes("stats", f"SELECT entry_id, version_x, version_y, {STAT_COLS} FROM stats"))
def pair_stats(v: Views):
    return _stats(labels.pair_stats(v.matched, v.moved))


@query("changed_pairs", with_ctes("stats", f"""
    SELECT entry_id, version_x, version_y, {STAT_COLS} FROM stats
    WHERE (mean_distance_x + mean_distance_y) / 2 > 0.01 OR num_added > 0 OR num_deleted > 0 OR num_moved > 0"""))
def changed_pairs(v: Views):
    return _stats(labels.changed_pairs(labels.pair_stats(v.matched, v.moved)))


@query("labels_from_annotation", with_ctes("matched", """
    SELECT entry_id, version_x, version_y, sent_idx_x, sent_idx_y,
           CASE WHEN sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL
                THEN CAST(coalesce(avg_sentence_distance_x, avg_sentence_distance_y) > 0.01 AS INTEGER)::DOUBLE END AS avg_sentence_distance_x,
           CASE WHEN sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL
                THEN CAST(coalesce(avg_sentence_distance_x, avg_sentence_distance_y) > 0.01 AS INTEGER)::DOUBLE END AS avg_sentence_distance_y
    FROM matched"""))
def labels_from_annotation(v: Views):
    entry = F.struct(
        F.coalesce("sent_idx_x", F.lit(-1)).alias("sent_idx_x"), F.coalesce("sent_idx_y", F.lit(-1)).alias("sent_idx_y"),
        F.coalesce(labels.match_distance() > 0.01, F.lit(False)).alias("edited"),
    )
    answers = v.matched.groupBy("entry_id", "version_x", "version_y").agg(F.to_json(F.collect_list(entry)).alias("annotated"))
    return labels.matches_from_annotation(answers)


@query("doc_section_grid", with_ctes("labelled", """
    , z AS (SELECT *, CAST(least(floor(sent_idx / greatest(floor(n / 3), 1)), 2) AS INTEGER) AS sec
            FROM (SELECT *, count(*) OVER (PARTITION BY source, entry_id, version) AS n FROM labelled))
    SELECT source, entry_id, version, """ + ", ".join(
    f"CAST(sum(CASE WHEN sec = {k} THEN {expr} ELSE 0 END) AS BIGINT) AS {name}_{k + 1}_3"
    for name, expr in {
        "deleted": "deleted_label", "edited": "edited_label", "add_above": "add_above_label", "add_below": "add_below_label",
        "move_up": "CAST(refactored_label < 0 AS INTEGER)", "move_none": "CAST(refactored_label = 0 AS INTEGER)",
        "move_down": "CAST(refactored_label > 0 AS INTEGER)"}.items() for k in range(3)
) + " FROM z GROUP BY source, entry_id, version"))
def doc_section_grid(v: Views):
    return labels.doc_section_grid(v.sentence_labels, 3)


@query("doc_label_sums", with_ctes("labelled", "SELECT source, entry_id, version, " + ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {c}" for c in labels.LABELS) + " FROM labelled GROUP BY source, entry_id, version"))
def doc_label_sums(v: Views):
    return labels.doc_label_sums(v.sentence_labels)


OPERATION_SQL = """CASE WHEN deleted_label >= edited_label AND deleted_label >= unchanged_label THEN 'deleted'
    WHEN edited_label >= unchanged_label THEN 'edited' ELSE 'unchanged' END"""
MOVE_SQL = "CASE WHEN refactored_label < 0 THEN 'up' WHEN refactored_label > 0 THEN 'down' ELSE 'unchanged' END"
ADDITION_SQL = """CASE WHEN add_above_label > 0 THEN 'add_above' WHEN add_below_label > 0 THEN 'add_below' ELSE 'unchanged' END"""
SENT = ["entry_id", "version", "sent_idx"]


@query("operation_class", with_ctes("labelled", f"SELECT entry_id, version, sent_idx, {OPERATION_SQL} AS operation FROM labelled"))
def operation_class(v: Views):
    return v.sentence_labels.select(*SENT, labels.operation_class().alias("operation"))


@query("move_class", with_ctes("labelled", f"SELECT entry_id, version, sent_idx, {MOVE_SQL} AS move FROM labelled"))
def move_class(v: Views):
    return v.sentence_labels.select(*SENT, labels.move_class().alias("move"))


@query("addition_class", with_ctes("labelled", f"SELECT entry_id, version, sent_idx, {ADDITION_SQL} AS addition FROM labelled"))
def addition_class(v: Views):
    return v.sentence_labels.select(*SENT, labels.addition_class().alias("addition"))


@query("multitask_label", with_ctes("labelled", f"""
    SELECT entry_id, version, sent_idx, ({OPERATION_SQL}) || '|||' || ({MOVE_SQL}) || '|||' || ({ADDITION_SQL}) AS label FROM labelled"""))
def multitask_label(v: Views):
    return v.sentence_labels.select(*SENT, labels.multitask_label().alias("label"))


@query("doc_label_bins", with_ctes("doc_labels", """
    SELECT source, entry_id, version,
      CASE WHEN num_deleted >= 0 AND num_deleted < 1 THEN 0 WHEN num_deleted >= 1 AND num_deleted < 3 THEN 1 WHEN num_deleted >= 3  THEN 2 END AS num_deleted_bin,
      CASE WHEN num_edited >= 0 AND num_edited < 1 THEN 0 WHEN num_edited >= 1 AND num_edited < 3 THEN 1 WHEN num_edited >= 3  THEN 2 END AS num_edited_bin,
      CASE WHEN num_added >= 0 AND num_added < 1 THEN 0 WHEN num_added >= 1 AND num_added < 5 THEN 1 WHEN num_added >= 5  THEN 2 END AS num_added_bin,
      CASE WHEN -num_refactored <= -1 THEN 0 WHEN -num_refactored > -1 AND -num_refactored <= 0 THEN 1 END AS num_refactored_bin
    FROM doc_labels"""))
def doc_label_bins(v: Views):
    return labels.doc_label_bins(v.doc_labels)


@query("binarise", with_ctes("doc_labels", """
    SELECT source, entry_id, version, CAST(num_deleted <> 0 AS INTEGER) AS num_deleted, CAST(num_added <> 0 AS INTEGER) AS num_added,
           CAST(num_edited <> 0 AS INTEGER) AS num_edited, CAST(num_refactored <> 0 AS INTEGER) AS num_refactored FROM doc_labels"""))
def binarise(v: Views):
    return labels.binarise(v.doc_labels.drop("sentences"), ["num_deleted", "num_added", "num_edited", "num_refactored"])


@query("last_version_label", with_ctes("entryversion", """
    SELECT id, CAST(version = num_versions - 1 AS INTEGER) AS is_last FROM entryversion"""))
def last_version_label(v: Views):
    return labels.last_version_label(v.entryversion).select("id", "is_last")


@query("clean_training_docs", with_ctes("labelled", """
    SELECT entry_id, version, sent_idx, sentence FROM labelled l WHERE EXISTS (
      SELECT 1 FROM (SELECT entry_id, version FROM labelled GROUP BY ALL HAVING count(*) > 5 AND count(*) < 15
        AND count(*) FILTER (sentence IS NULL OR trim(sentence) = '') = 0) g WHERE g.entry_id = l.entry_id AND g.version = l.version)"""))
def clean_training_docs(v: Views):
    return labels.clean_training_docs(v.sentence_labels).select("entry_id", "version", "sent_idx", "sentence")


def u_sql(key: str) -> str:
    return f"(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query("train_test_split", with_ctes("entryversion", f"""
    SELECT id, CASE WHEN {u_sql("entry_id || '-' || version")} < 0.95 THEN 'train' ELSE 'test' END AS part FROM entryversion"""))
def train_test_split(v: Views):
    return labels.train_test_split(v.entryversion, ["entry_id", "version"]).select("id", "part")


@query("relabel", """
    SELECT doc_id, label, CAST(label = 'romance' AS INTEGER) AS is_romance, CAST(label = 'germanic' AS INTEGER) AS is_germanic
    FROM (SELECT doc_id, CASE split_part(lang || '_' || source, '_', 1) WHEN 'fr' THEN 'romance' WHEN 'es' THEN 'romance' WHEN 'en' THEN 'germanic' END AS label FROM documents)
    WHERE label IS NOT NULL""")
def relabel(v: Views):
    rows = v.documents.select("doc_id", F.concat_ws("_", "lang", "source").alias("tag"))
    return labels.relabel(rows, "tag", {"fr": "romance", "es": "romance", "en": "germanic"}).drop("tag")


@query("added_deleted_table", with_ctes("matched", """
    SELECT entry_id, version_y AS version, sent_idx_y AS sent_idx, 1 AS is_added, 0 AS is_deleted FROM matched WHERE sent_idx_x IS NULL
    UNION ALL SELECT entry_id, version_x, sent_idx_x, 0, 1 FROM matched WHERE sent_idx_y IS NULL"""))
def added_deleted_table(v: Views):
    return labels.added_deleted_table(v.matched)


@query("unedited_control", with_ctes("matched sentences", f"""
    , k AS (SELECT entry_id, version_x AS version, sent_idx_x AS sent_idx FROM matched WHERE avg_sentence_distance_x <= 0.01 AND avg_sentence_distance_y <= 0.01
            UNION SELECT entry_id, version_y, sent_idx_y FROM matched WHERE avg_sentence_distance_x <= 0.01 AND avg_sentence_distance_y <= 0.01),
    s AS (SELECT s.source, s.entry_id, s.version, s.sent_idx, {u_sql("s.entry_id || '-' || s.version || '-' || s.sent_idx")} AS u
          FROM sentences s JOIN k USING (entry_id, version, sent_idx))
    SELECT source, entry_id, version, sent_idx, u, CAST(rank AS INTEGER) AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY source ORDER BY u, entry_id, version, sent_idx) AS rank FROM s) WHERE rank <= 100"""))
def unedited_control(v: Views):
    return labels.unedited_control(v.matched, v.sentences, 100)


@query("document_key_rows", with_ctes("doc_labels", r"""
    SELECT source || '-' || entry_id || '-' || version AS doc_key, 0 AS sent_pos, sentences AS text FROM doc_labels
    WHERE len(string_split_regex(sentences, '\s+')) < 300"""))
def document_key_rows(v: Views):
    return labels.document_key_rows(v.doc_labels, "sentences", 300)
