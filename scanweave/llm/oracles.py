"""DuckDB SQL of the queries that SQL can express, over views of the tables."""

from __future__ import annotations

from scanweave.llm.centroids import CLUSTERS, DIM, ROUNDS, SCALE, SEED
from scanweave.llm.decontam import WINDOW
from scanweave.llm.licenses import CLAUSES, COPYRIGHT_LINE, COPYRIGHT_PARAGRAPH, DIGESTS, GAPS, PARAGRAPHS, SPELLINGS, variants
from scanweave.llm.secrets import BASE, RULES


def _secrets() -> str:
    parts = []
    for no, rule in enumerate(RULES):
        p = rule.pattern.replace("'", "''")
        parts.append(f"""
        SELECT doc_id, {no} AS kind_no, '{rule.kind}' AS kind, unnest(range(1, len(f) + 1)) AS i, f, g, s, {rule.least} AS least
        FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS f, regexp_extract_all(t, '{p}', {rule.group}) AS g,
                     string_split_regex(t, '{p}') AS s FROM docs) WHERE len(f) > 0""")
    counts = ", ".join(f"coalesce(sum((kind = '{k}')::INT), 0)::BIGINT AS n_{k}" for k in BASE)
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    hits AS ({" UNION ALL ".join(parts)}),
    placed AS (SELECT doc_id, kind_no, kind, length(f[i]) AS n, length(g[i]) >= least AS ok,
                      sum(length(s[i]) + length(f[i])) OVER (PARTITION BY doc_id, kind_no ORDER BY i) AS e FROM hits),
    spans AS (SELECT doc_id, kind_no, kind, (e - n)::BIGINT AS st, concat_ws(':', kind, (e - n)::BIGINT, e::BIGINT) AS w FROM placed WHERE ok),
    per AS (SELECT doc_id, {counts},
                   coalesce(string_agg(w, ',' ORDER BY st, kind_no) FILTER (kind IN ({base})), '') AS b,
                   string_agg(w, ',' ORDER BY st, kind_no) AS spans FROM spans GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)},
           sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs d LEFT JOIN per USING (doc_id)"""


OP2 = _secrets()


def _canonical(text: str) -> str:
    t = f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', ' ', 'g'), '{COPYRIGHT_PARAGRAPH}', chr(10) || chr(10), 'g')"
    for spelling, same in SPELLINGS:
        t = f"replace({t}, '{spelling}', '{same}')"
    return f"trim(regexp_replace({t}, '{GAPS}', ' ', 'g'))"


def _licenses() -> str:
    known = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in variants())
    return f"""
    WITH texts AS (SELECT sha256({_canonical("t")}) AS digest, license FROM (VALUES {known}) AS v(license, t) UNION ALL FROM (VALUES {", ".join(f"('{d}', '{n}')" for n, d in DIGESTS)})),
    known AS (SELECT digest, min(license) AS license FROM texts GROUP BY 1),
    parts AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10)) || string_split_regex(text, '{PARAGRAPHS}') || string_split_regex(text, '{CLAUSES}')) AS part FROM documents),
    named AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
              FROM (SELECT doc_id, sha256({_canonical("part")}) AS digest FROM parts WHERE part != '') JOIN known USING (digest) GROUP BY 1)
    SELECT d.doc_id, sha256({_canonical("text")}) AS digest, k.license, coalesce(n.notices, '') AS notices
    FROM documents d LEFT JOIN known k ON k.digest = sha256({_canonical("text")}) LEFT JOIN named n ON n.doc_id = d.doc_id"""


OP9 = _licenses()

OP10 = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id != q.vec_id AND len(q.v) = len(c.v))
    SELECT query_id, rank::INT AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

OP11 = f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS no, doc_id, {_TERMS} AS w FROM documents),
    b AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
    win AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS s
            FROM b, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS r(i) WHERE len(w) > 0),
    own AS (SELECT no, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM win) AS l, unnest(range(1, len(w) - n + 2)) AS r(i)),
    occ AS MATERIALIZED (SELECT DISTINCT no, i, n, item_id FROM own JOIN win USING (n, s)),
    hit AS (SELECT no, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + n)) AS r(p) GROUP BY no),
    named AS (SELECT no, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM occ GROUP BY no)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (no) LEFT JOIN named USING (no)"""

OP12 = f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS no, doc_id, {_TERMS} AS w FROM documents),
    b AS (SELECT DISTINCT item, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS w FROM benchmark)),
    size AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM d),
    tf AS MATERIALIZED (SELECT no, doc_id, n, term, count(*) AS tf FROM (SELECT no, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
    weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size),
    share AS (SELECT no, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)) AS s FROM tf, size),
    scored AS (SELECT item, item_id, no, doc_id, sum(w * s)::BIGINT AS score FROM b JOIN weight USING (term) JOIN share USING (term) GROUP BY ALL)
    SELECT item_id, rank::INT AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""


def _centroids() -> str:
    steps = [f"""
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS no, vec_id, embedding, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), embedding) - 1 AS cluster, v AS c FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('{SEED}:' || vec_id), embedding LIMIT {CLUSTERS})"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
    a{r} AS MATERIALIZED (SELECT no, min(struct_pack(d := list_sum(list_transform(range(1, {DIM} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT, cluster := cluster)) AS best FROM v, c{r} GROUP BY no)""")
        if r < ROUNDS:
            steps.append(f"""
    s{r} AS (SELECT best.cluster AS cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (no), unnest(range(1, {DIM} + 1)) AS r(i) GROUP BY ALL),
    c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY cluster) AS m USING (cluster))""")
    return ",".join(steps) + f"""
    SELECT v.vec_id, best.cluster::INT AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.cluster)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{ROUNDS} JOIN v USING (no) JOIN c{ROUNDS} ON c{ROUNDS}.cluster = best.cluster"""


OP13 = _centroids()
