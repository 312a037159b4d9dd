"""DuckDB's SQL for the operators that SQL can express, written over whole tables."""

from __future__ import annotations

from . import sharding


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def _bits(*parts: str) -> str:
    """52 bits of the MD5 digest of the parts joined by a vertical bar."""
    joined = ", ".join(f"coalesce(({p})::VARCHAR, 'null')" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {joined})), 1, 13))::BIGINT"


def _tree_steps(tree, source: str, out: str) -> list[str]:
    """CTEs that descend the tree level by level."""
    ctes, at, below = [], "''", source
    for depth, level in enumerate(sharding.levels(tree)):
        arms = []
        for parent, children in level.items():
            draws = [f"{{'d': -ln(({_bits('doc_id', f"'{c}'")} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / {w}::DOUBLE, 'n': '{c}'}}" for c, w in children.items()]
            arms.append(f"WHEN {at} = '{parent}' THEN list_sort([{', '.join(draws)}])[1].n")
        ctes.append(f"{out}{depth} AS (SELECT * EXCLUDE ({out}_at), CASE {' '.join(arms)} END AS {out}_at FROM {below})" if depth else f"{out}{depth} AS (SELECT *, CASE {' '.join(arms)} END AS {out}_at FROM {below})")
        at, below = f"{out}_at", f"{out}{depth}"
    return ctes


def shards_sql(shards: int) -> str:
    tree = sharding.even_tree(shards)
    ctes = [
        f"t AS (SELECT {_crc_table()}::BIGINT[] AS t)",
        f"n AS (SELECT greatest({sharding.LEAST_LANES}, count(*) // {sharding.LANE_ROWS}) AS lanes FROM documents)",
        "b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)",
        "c AS (SELECT doc_id, length(h) // 2 + 1 AS size, xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT), "
        "lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM b, t)",
        *_tree_steps(tree, "c", "now"),
        *_tree_steps(sharding.grown(tree), "now2", "later"),
        "p AS (SELECT *, string_split(now_at, '/')[-1]::INT AS shard, string_split(later_at, '/')[-1]::INT AS grown_shard FROM later2)",
    ]
    lane = _bits("doc_id", "text_crc32", "size") + " % lanes"
    slot = f"row_number() OVER (PARTITION BY shard ORDER BY {lane}, doc_id NULLS FIRST, text_crc32, size) - 1"
    return f"WITH {', '.join(ctes)} SELECT doc_id, size, text_crc32, 'key' AS law, shard, {slot} AS slot, grown_shard FROM p, n"


_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def top_k_sql(k: int, scale: int, every: int) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {_USABLE}),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= {k}"""


def classes_sql(threshold: float) -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
r AS (SELECT vec_id, vec_id AS reached FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""


def mix_sql(weights: tuple[float, ...], most: int, seed: int = 7) -> str:
    """Targets by water-filling over sources, then over classes of size, then the prefix of the Pareto ranking, row by row."""
    return f"""WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, {_bits('doc_id', str(seed), 'text')} AS bits FROM documents),
d AS (SELECT *, length(bin(size)) AS class FROM s),
w AS (SELECT source, sum(size)::BIGINT AS source_size, ({list(weights)}::DOUBLE[])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(weights)} + 1] AS w, row_number() OVER (ORDER BY source IS NULL, source) AS rn FROM d GROUP BY source),
f AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, coalesce(sum(source_size * {most}) OVER (ORDER BY (source_size * {most})::DOUBLE / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS full_words,
sum(w) OVER (ORDER BY (source_size * {most})::DOUBLE / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM w),
g AS (SELECT *, (total - full_words) / left_w AS level, (source_size * {most})::DOUBLE AS cap FROM f),
h AS (SELECT *, first_value(CASE WHEN level * w <= cap THEN level END IGNORE NULLS) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS common FROM g),
tg AS (SELECT source, source_size, CASE WHEN common IS NULL THEN cap ELSE least(cap, common * w) END AS target FROM h),
k AS (SELECT d.source, class, source_size, target, sum(size)::BIGINT AS words FROM d JOIN tg ON d.source IS NOT DISTINCT FROM tg.source GROUP BY ALL),
k1 AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * {most} AS full_words,
(sum(class * words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS left_words FROM k),
k2 AS (SELECT *, CASE WHEN left_words > 0 THEN (target - full_words) / left_words END AS level FROM k1),
k3 AS (SELECT *, first_value(CASE WHEN level * class <= {most} THEN level END IGNORE NULLS) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS share FROM k2),
k4 AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN share IS NULL THEN {most}::DOUBLE ELSE least({most}::DOUBLE, share * class) END AS due FROM k3),
k5 AS (SELECT *, floor(due)::BIGINT AS whole, due - floor(due) AS pi, target - (sum(floor(due)::BIGINT * words) OVER (PARTITION BY source))::BIGINT AS need FROM k4),
r AS (SELECT d.doc_id, d.source, d.size, source_size, target, whole, need, CASE WHEN pi > 0 THEN (((bits + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / (1 - (bits + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)) / (pi / (1 - pi)) END AS rank
FROM d JOIN k5 ON d.source IS NOT DISTINCT FROM k5.source AND d.class = k5.class),
b AS (SELECT *, need - coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lack FROM r WHERE rank IS NOT NULL),
e AS (SELECT *, bool_and(CASE WHEN size = 0 THEN lack > 0 ELSE lack / size > 0.5 END) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS taken FROM b)
SELECT doc_id, size, source_size, target, (whole + taken::INT) * size AS taken, whole + taken::INT AS copies FROM e
UNION ALL SELECT doc_id, size, source_size, target, whole * size, whole FROM r WHERE rank IS NULL"""
