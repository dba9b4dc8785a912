"""DuckDB SQL for the rows of corpus queries, where SQL can express them."""

from __future__ import annotations


def mix_sql(weights: list[float], share: float, cap: float, rounds: int, seed: int = 42, docs: str = "documents") -> str:
    """The mix of ``source_mixing.mix`` by plain windows over whole sources, with at most ``rounds`` rounds of filling."""
    listed = ", ".join(f"{float(w)}::DOUBLE" for w in weights)
    parts = [
        f"""rows AS MATERIALIZED (
  SELECT *, greatest(floor(sqrt(size::DOUBLE) * 16), 1)::BIGINT AS x FROM (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
      (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
    FROM {docs}))""",
        f"""sources AS (
  SELECT source, source_size, list_extract([{listed}], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1)::INTEGER) AS weight,
    source_size::DOUBLE * {float(cap)}::DOUBLE AS most
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source))""",
        f"""levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * {float(share)}::DOUBLE - coalesce(sum(most) OVER before, 0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0::DOUBLE)) AS level
  FROM sources WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        """targets AS (
  SELECT source, source_size, least(most, coalesce(max(CASE WHEN level * weight <= most THEN level END) OVER () * weight, most)) AS target
  FROM levels)""",
        """allotted AS MATERIALIZED (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM targets)""",
        "wanted AS (SELECT source, floor(target - copies * source_size)::BIGINT AS gap FROM allotted)",
        """steps AS (
  SELECT g.source, x, gap - coalesce(sum(words) OVER (PARTITION BY g.source ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
    (sum(x::HUGEINT * words) OVER (PARTITION BY g.source ORDER BY x DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weighted
  FROM (SELECT source, x, sum(size)::BIGINT AS words FROM rows WHERE size > 0 GROUP BY source, x) g JOIN wanted w ON g.source IS NOT DISTINCT FROM w.source WHERE gap > 0)""",
        """odds AS MATERIALIZED (
  SELECT source, max(x) AS above, arg_max(rest, x) AS rest, arg_max(rest / weighted, x) AS scale FROM steps WHERE rest >= 0 AND rest / weighted * x < 1 GROUP BY source)""",
        "sure AS MATERIALIZED (SELECT rid FROM rows r JOIN odds o ON r.source IS NOT DISTINCT FROM o.source WHERE size > 0 AND x > above)",
        "gap0 AS MATERIALIZED (SELECT source, rest AS gap FROM odds)",
        """ranked AS MATERIALIZED (
  SELECT rid, r.source, size, (u / (1 - u)) / (scale * x / (1 - scale * x)) AS rank
  FROM rows r JOIN odds o ON r.source IS NOT DISTINCT FROM o.source WHERE size > 0 AND rest > 0 AND x <= above)""",
    ]
    for k in range(rounds):
        earlier = "".join(f" AND rid NOT IN (SELECT rid FROM picked{j})" for j in range(k))
        parts += [
            f"""picked{k} AS MATERIALIZED (
  SELECT rid, source, size FROM (
    SELECT rid, r.source, size, gap, sum(size) OVER (PARTITION BY r.source ORDER BY rank) AS reach
    FROM ranked r JOIN gap{k} g ON r.source IS NOT DISTINCT FROM g.source WHERE size <= gap{earlier})
  WHERE reach <= gap)""",
            f"""gap{k + 1} AS MATERIALIZED (
  SELECT g.source, gap - coalesce(used, 0)::BIGINT AS gap
  FROM gap{k} g LEFT JOIN (SELECT source, sum(size) AS used FROM picked{k} GROUP BY source) p ON g.source IS NOT DISTINCT FROM p.source)""",
        ]
    chosen = " UNION ALL ".join(["SELECT rid FROM sure", *(f"SELECT rid FROM picked{k}" for k in range(rounds))])
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT doc_id, r.source, size, source_size, target, size * (copies + (CASE WHEN c.rid IS NULL THEN 0 ELSE 1 END)) AS taken
FROM rows r JOIN allotted a ON r.source IS NOT DISTINCT FROM a.source LEFT JOIN ({chosen}) c ON r.rid = c.rid"""
    )


def topk_sql(k: int, scale: int, every: int, rows: str = "embeddings") -> str:
    """Exact top-k inner products of every ``every``-th vector with all others."""
    return f"""WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM {rows}
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""


def codes_sql(parts: int, entries: int, rounds: int, scale: int, rows: str = "embeddings") -> str:
    """Product codes by plain Lloyd rounds: every part meets every entry of its codebook in each round."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM {rows}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"""parts AS MATERIALIZED (
  SELECT rid, p::INTEGER AS part, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM kept, range({parts}) r(p))""",
        f"""book0 AS MATERIALIZED (
  SELECT part, place AS entry, v FROM parts JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS place FROM kept) USING (rid) WHERE place < {entries})""",
    ]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT rid, part, entry, distance FROM (
    SELECT rid, p.part, entry, distance, row_number() OVER (PARTITION BY rid, p.part ORDER BY distance, entry) AS place FROM (
      SELECT rid, p.part, entry, list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, b.v) + list_dot_product(b.v, b.v) AS distance FROM parts p JOIN book{k} b ON p.part = b.part) p)
  WHERE place = 1)""")
        if k < rounds:
            steps.append(f"""mean{k} AS (
  SELECT part, entry, list(value ORDER BY i) AS v FROM (
    SELECT n.part, entry, i, floor(sum(x) / count(*)) AS value FROM near{k} n JOIN (SELECT rid, part, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM parts) USING (rid, part) GROUP BY n.part, entry, i)
  GROUP BY part, entry)""")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON b.part = m.part AND b.entry = m.entry)")
    return (
        "WITH "
        + ",\n".join(steps)
        + f""",
digest AS (SELECT sha256(string_agg(list_aggregate(list_transform(v, lambda x: x::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}),
coded AS (SELECT rid, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM near{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (rid), digest"""
    )
