"""The derived tables of ``views.py`` stated in SQL for the checking engine."""

from __future__ import annotations

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: tuple[str, ...], sql: str) -> None:
    PARTS[name] = (needs, sql)


def with_ctes(names: str, body: str) -> str:
    """``body`` preceded by the named tables and whatever they need."""
    done: list[str] = []

    def visit(n: str) -> None:
        if n in done:
            return
        for dep in PARTS[n][0]:
            visit(dep)
        done.append(n)

    for n in names.split():
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS (\n{PARTS[n][1]}\n)" for n in done) + "\n" + body


part(
    "pieces", (),
    r"""
    SELECT doc_id AS entry_id, source, lead, n_versions, unnest(arr) AS piece,
           unnest(range(len(arr))) AS i, len(arr) AS n
    FROM (SELECT doc_id, source, doc_id % 4 + 2 AS n_versions,
                 array_to_string(string_split_regex(text, '\s+')[1:6], ' ') AS lead,
                 string_split_regex(text, '[.!?]\s+') AS arr
          FROM documents)
    """,
)
part(
    "sentences", ("pieces",),
    """
    SELECT source, entry_id, CAST(version AS INTEGER) AS version,
           CAST(row_number() OVER (PARTITION BY entry_id, version ORDER BY pos) - 1 AS INTEGER) AS sent_idx,
           sentence, lead, n_versions
    FROM (
      SELECT source, entry_id, version, lead, n_versions,
             CASE WHEN version % 2 = 1 AND i = 1 THEN n ELSE i END AS pos,
             CASE WHEN (i + 2 * version + entry_id) % 11 = 0
                  THEN piece || ' updated ' || version ELSE piece END AS sentence
      FROM (SELECT *, unnest(range(n_versions)) AS version FROM pieces)
      WHERE (i + entry_id + version) % 7 <> 0 AND trim(piece) <> '')
    """,
)
part(
    "entryversion", ("sentences",),
    """
    SELECT entry_id * 10 + version AS id, any_value(source) AS source, entry_id, version,
           CAST(any_value(n_versions) AS INTEGER) AS num_versions,
           any_value(lead) || ' v' || (version // 2) AS title,
           string_agg(sentence, '</p><p>' ORDER BY sent_idx) AS summary,
           TIMESTAMP '2024-01-01 00:00:00'
             + to_hours(CAST(entry_id + version * (entry_id % 5 + 1) AS INTEGER)) AS created,
           'https://www.' || any_value(source) || '.example.com/a/diff/' || entry_id || '/' || version AS url,
           CASE WHEN (entry_id + version) % 5 <> 0
                THEN 'https://archive.example.org/' || entry_id || '-' || version END AS archive_url
    FROM sentences GROUP BY entry_id, version
    """,
)
part(
    "words", ("sentences",),
    r"""
    SELECT source, entry_id, version, sent_idx, CAST(word_idx AS INTEGER) AS word_idx, token,
           count(*) OVER (PARTITION BY entry_id, version, sent_idx) AS num_words
    FROM (SELECT source, entry_id, version, sent_idx, unnest(t) AS token, unnest(range(len(t))) AS word_idx
          FROM (SELECT *, list_filter(string_split_regex(lower(sentence), '\s+'), lambda x: x <> '') AS t
                FROM sentences))
    """,
)


def match_parts(prefix: str, sentences: str, words: str, near: str | None, cutoff: float, limit: float, norm_y: str = "ly"):
    """Brute-force statement of the bidirectional match: every word pair, no pruning.

    ``words`` must have a ``word`` column; ``near`` lists (word_a, word_b, distance) with
    every word next to itself. Without it only equal words are near. ``norm_y`` names the side
    whose word count divides the distance of a newer sentence.
    """
    part(f"{prefix}bag", (words,),
         f"SELECT entry_id, version, sent_idx, word, count(*) AS c FROM {words} GROUP BY ALL")
    part(f"{prefix}len", (f"{prefix}bag",),
         f"SELECT entry_id, version, sent_idx, sum(c) AS n FROM {prefix}bag GROUP BY ALL")
    if near is None:
        part(f"{prefix}hits", (f"{prefix}bag",), f"""
            SELECT x.entry_id, x.version AS vx, x.sent_idx AS sx, y.sent_idx AS sy,
                   0.0 AS sum_x, 0.0 AS sum_y, sum(x.c) AS m_x, sum(y.c) AS m_y
            FROM {prefix}bag x JOIN {prefix}bag y ON y.entry_id = x.entry_id
             AND y.version = x.version + 1 AND y.word = x.word
            GROUP BY ALL""")
    else:
        for side in "xy":
            part(f"{prefix}hits_{side}", (f"{prefix}bag", near), f"""
                SELECT entry_id, vx, sx, sy, sum(d * c) AS sum_{side}, sum(c) AS m_{side}
                FROM (SELECT x.entry_id, x.version AS vx, x.sent_idx AS sx, y.sent_idx AS sy,
                             {side}.word AS w, any_value({side}.c) AS c, min(nv.distance) AS d
                      FROM {prefix}bag x JOIN {near} nv ON nv.word_a = x.word
                      JOIN {prefix}bag y ON y.entry_id = x.entry_id AND y.version = x.version + 1
                                        AND y.word = nv.word_b
                      GROUP BY ALL)
                GROUP BY ALL""")
        part(f"{prefix}hits", (f"{prefix}hits_x", f"{prefix}hits_y"),
             f"SELECT * FROM {prefix}hits_x JOIN {prefix}hits_y USING (entry_id, vx, sx, sy)")
    part(
        f"{prefix}scored", (f"{prefix}hits", f"{prefix}len", sentences),
        f"""
        SELECT h.entry_id, vx, sx, sy,
               round((sum_x + {cutoff} * (lx.n - m_x)) / lx.n, 9) AS dist_x,
               round((sum_y + {cutoff} * ({norm_y}.n - m_y)) / {norm_y}.n, 9) AS dist_y, 0 AS exact
        FROM {prefix}hits h
        JOIN {prefix}len lx ON lx.entry_id = h.entry_id AND lx.version = vx AND lx.sent_idx = sx
        JOIN {prefix}len ly ON ly.entry_id = h.entry_id AND ly.version = vx + 1 AND ly.sent_idx = sy
        UNION ALL
        SELECT x.entry_id, x.version, x.sent_idx, y.sent_idx, 0.0, 0.0, 1
        FROM {sentences} x JOIN {sentences} y ON x.entry_id = y.entry_id
         AND y.version = x.version + 1 AND x.sentence = y.sentence
        """,
    )
    for side, other, shift in (("x", "y", 0), ("y", "x", 1)):
        neighbour = "+ 1" if side == "x" else "- 1"
        part(
            f"{prefix}pass_{side}", (f"{prefix}scored",),
            f"""
            SELECT k.entry_id, k.version - {shift} AS vx, k.sent_idx AS s{side},
                   b.o AS s{other}, b.dist
            FROM {sentences} k
            SEMI JOIN (SELECT DISTINCT entry_id, version FROM {sentences}) v
              ON v.entry_id = k.entry_id AND v.version = k.version {neighbour}
            LEFT JOIN (
              SELECT entry_id, vx, s{side}, best.o AS o, best.dist AS dist
              FROM (SELECT entry_id, vx, s{side},
                           min({{'dist': dist_{side}, 'inexact': 1 - exact, 'gap': abs(sx - sy), 'o': s{other}}}) AS best
                    FROM {prefix}scored WHERE dist_{side} < {limit} GROUP BY ALL)) b
              ON b.entry_id = k.entry_id AND b.vx = k.version - {shift} AND b.s{side} = k.sent_idx
            """,
        )
    part(
        f"{prefix}matched", (f"{prefix}pass_x", f"{prefix}pass_y"),
        f"""
        SELECT entry_id, CAST(vx AS INTEGER) AS version_x, CAST(vx + 1 AS INTEGER) AS version_y,
               sx AS sent_idx_x, sy AS sent_idx_y,
               max(dx) AS avg_sentence_distance_x, max(dy) AS avg_sentence_distance_y
        FROM (SELECT entry_id, vx, sx, sy, dist AS dx, NULL::DOUBLE AS dy FROM {prefix}pass_x
              UNION ALL
              SELECT entry_id, vx, sx, sy, NULL, dist FROM {prefix}pass_y)
        GROUP BY entry_id, vx, sx, sy
        """,
    )


part("doc_words", ("words",), "SELECT entry_id, version, sent_idx, token AS word FROM words")
match_parts("", "sentences", "doc_words", None, 0.5, 0.44)

part(
    "turns", (),
    r"""
    SELECT 'chat' AS source, conv_id AS entry_id, CAST(turn AS INTEGER) AS version,
           CAST(unnest(range(len(t))) AS INTEGER) AS sent_idx, unnest(t) AS sentence
    FROM (SELECT *, list_filter(string_split_regex(text, '[.!?]\s+'), lambda s: trim(s) <> '') AS t
          FROM conversations)
    """,
)
part(
    "turn_words", ("turns",),
    r"""
    SELECT source, entry_id, version, sent_idx, CAST(word_idx AS INTEGER) AS word_idx, token,
           count(*) OVER (PARTITION BY entry_id, version, sent_idx) AS num_words,
           CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings) AS word
    FROM (SELECT source, entry_id, version, sent_idx, unnest(t) AS token, unnest(range(len(t))) AS word_idx
          FROM (SELECT *, list_filter(string_split_regex(lower(sentence), '\s+'), lambda x: x <> '') AS t
                FROM turns))
    """,
)
part(
    "vectors", (),
    """
    SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS vector
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    """,
)
part(
    "near_vectors", ("vectors",),
    """
    SELECT * FROM (SELECT a.vec_id AS word_a, b.vec_id AS word_b,
           CASE WHEN a.vec_id = b.vec_id THEN 0.0::DOUBLE
                ELSE round(list_distance(a.vector, b.vector), 9) END AS distance
    FROM vectors a, vectors b) WHERE distance < 1.2
    """,
)
match_parts("t_", "turns", "turn_words", "near_vectors", 1.2, 0.9)
match_parts("nx_", "turns", "turn_words", "near_vectors", 1.2, 0.9, "lx")
part("production_near", ("near_vectors",), "SELECT * FROM near_vectors WHERE distance < 0.5")
match_parts("prod_", "turns", "turn_words", "production_near", 0.5, 0.44)

# places on four lines made of hashes of (7, table, dimension); buckets of length 1, probes half a bucket away
part(
    "projections", ("vectors",),
    """
    SELECT vec_id, t, sum(v * g) AS place
    FROM (SELECT vec_id, unnest(vector) AS v, unnest(range(len(vector))) AS d FROM vectors)
    JOIN (SELECT t, d, sqrt(-2 * ln((u + 1) / 4294967297.0)) * cos(2 * pi() * w / 4294967296.0) AS g
          FROM (SELECT t, d, CAST('0x' || substr(md5('7-' || t || '-' || d || '-a'), 1, 8) AS BIGINT) AS u,
                       CAST('0x' || substr(md5('7-' || t || '-' || d || '-b'), 1, 8) AS BIGINT) AS w
                FROM range(4) a(t), range((SELECT max(len(vector)) FROM vectors)) b(d))) USING (d)
    GROUP BY ALL
    """,
)
part(
    "lsh_near", ("near_vectors", "projections"),
    """
    SELECT DISTINCT n.* FROM near_vectors n JOIN projections a ON a.vec_id = n.word_a
    JOIN projections b ON b.vec_id = n.word_b AND b.t = a.t
    WHERE floor(a.place) BETWEEN floor(b.place - 0.5) AND floor(b.place + 0.5)
       OR floor(b.place) BETWEEN floor(a.place - 0.5) AND floor(a.place + 0.5)
    """,
)
