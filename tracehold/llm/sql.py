"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

TOPK_SEARCH = f"""WITH bag AS (SELECT doc_id, {_LOWER.format('text')} AS ws FROM documents WHERE doc_id IS NOT NULL),
tf AS (SELECT doc_id, w, count(*) AS n FROM bag, unnest(ws) AS t(w) GROUP BY ALL), stats AS (SELECT count(*) AS docs, avg(len(ws)) AS mean FROM bag), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
asked AS (SELECT DISTINCT item_id AS query_id, w FROM benchmark, unnest({_LOWER.format('text')}) AS t(w) WHERE item_id % 20 = 0),
scored AS (SELECT query_id, tf.doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / mean))), 6) AS score FROM asked JOIN tf USING (w) JOIN df USING (w) JOIN bag ON bag.doc_id = tf.doc_id, stats GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 20"""

SOURCE_MIXING = f"""WITH sizes AS (SELECT doc_id, source, CAST(len({_WORDS.format('text')}) AS BIGINT) AS size FROM documents),
ranked AS (SELECT source, source_size, list_extract([3, 1, 2], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS weight, source_size * 2 AS ceiling FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY 1)),
leveled AS (SELECT *, ceiling / weight AS ratio, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(ceiling) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM ranked WINDOW w AS (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shares AS (SELECT *, CASE WHEN open_level IS NULL OR level > ratio THEN CAST(ceiling AS DOUBLE) ELSE least(open_level * weight, CAST(ceiling AS DOUBLE)) END AS target FROM (SELECT *, (SELECT arg_min(level, (ratio, source IS NULL, source)) FROM leveled WHERE level <= ratio) AS open_level FROM leveled)),
queued AS (SELECT d.doc_id, d.size, s.source_size, s.target, e, md5(concat_ws(':', coalesce(CAST(d.doc_id AS VARCHAR), ''), e)) AS tie, d.source FROM sizes d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source, (VALUES (0), (1)) AS epochs(e)),
timed AS (SELECT *, CASE WHEN size > 0 AND target > 0 THEN (source_size * e + sum(size) OVER (PARTITION BY source, e ORDER BY tie, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / target END AS finish FROM queued),
sent AS (SELECT *, sum(size) OVER (ORDER BY finish, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sent FROM timed WHERE finish < 2),
refused AS (SELECT min((finish, tie)) AS first FROM sent WHERE sent > (SELECT sum(target) FROM shares))
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, CAST(any_value(size) * count_if(finish IS NOT NULL AND (first IS NULL OR (finish, tie) < first)) AS BIGINT) AS taken FROM timed, refused GROUP BY doc_id"""

SUBSTRING_DEDUP = f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM w, unnest(range(1, len(ws) - 33)) AS t(i)),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM win SEMI JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) r USING (h), unnest(range(0, 35)) AS u(k)),
each AS (SELECT doc_id, pos, ws[pos] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(pos)),
kept AS (SELECT each.doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY each.pos) FILTER (gone.pos IS NULL) AS kept FROM each LEFT JOIN gone ON each.doc_id = gone.doc_id AND each.pos = gone.pos GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def _centroids(k: int = 40, rounds: int = 5) -> str:
    """Each round as two tables: the nearest centroid of each vector, and the floored means with the empty ones as before."""
    gap = "CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT)"
    parts = ["""kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c FROM kept ORDER BY sha256('2:' || vec_id) LIMIT {k})"]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT n, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT n, vec_id, v, cluster, {gap} AS d FROM kept, c{r}) GROUP BY n)")
        if r < rounds:
            means = "SELECT cluster, list(m ORDER BY i) AS m FROM (SELECT cluster, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{0}, range(1, 65) AS t(i) GROUP BY ALL) GROUP BY 1"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{r} LEFT JOIN ({means.format(r)}) USING (cluster))")
    last = f"SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"
    return "WITH " + ", ".join(parts) + " " + last


CENTROIDS = _centroids()
