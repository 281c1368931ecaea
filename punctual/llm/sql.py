"""The result of a query as SQL, where SQL can express it."""

from __future__ import annotations

from punctual.llm.curriculum import BUCKETS, SCHEDULES, WEIGHTS

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWERED)} AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS grams
  FROM w
),
e AS (SELECT doc_id, unnest(grams) AS gram FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM p JOIN s sx ON sx.doc_id = x JOIN s sy ON sy.doc_id = y
  WHERE 100 * k >= 90 * (len(sx.grams) + len(sy.grams) - k)
),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = other)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, r.component_id
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id
"""

WINDOWS = f"""
WITH w AS (SELECT doc_id, {WORDS.format("text")} AS words FROM documents),
v AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 18, 1))) AS pos FROM w),
k AS (SELECT v.doc_id, v.pos, array_to_string(words[v.pos:v.pos + 19], ' ') AS key FROM v JOIN w ON w.doc_id = v.doc_id),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS nr FROM k) WHERE nr > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS place FROM r),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w),
o AS (
  SELECT p.doc_id, count(*) AS n_words, count(c.place) AS n_removed, string_agg(CASE WHEN c.place IS NULL THEN p.word END, ' ' ORDER BY p.place) AS kept
  FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.place = p.place GROUP BY p.doc_id
)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN o ON o.doc_id = w.doc_id
"""


def _time(share: str, knots: tuple[float, ...]) -> str:
    step = 1.0 / (len(knots) - 1)
    areas = [step * (a + b) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    done, cases = 0.0, []
    for k, (a, b, area) in enumerate(zip(knots, knots[1:], areas, strict=False)):
        left = f"greatest(0.0::DOUBLE, {share} * {sum(areas)}::DOUBLE - {done}::DOUBLE)"
        root = f"2.0::DOUBLE * {left} / ({a}::DOUBLE + sqrt(greatest(0.0::DOUBLE, {a * a}::DOUBLE + {2.0 * (b - a) / step}::DOUBLE * {left})))"
        done += area
        cases.append(f"WHEN {share} * {sum(areas)}::DOUBLE <= {done}::DOUBLE OR {k == len(areas) - 1} THEN {k * step}::DOUBLE + least({step}::DOUBLE, {root})")
    return f"CASE {' '.join(cases)} END"


def _position(reading: int) -> str:
    share = f"((before + {reading} * source_size)::DOUBLE / target)"
    times = " ".join(f"WHEN class = {i} THEN {_time(share, knots)}" for i, knots in enumerate(SCHEDULES))
    return f"round(CASE WHEN taken > 0 AND {share} < 1 THEN CASE {times} END END, 9)"


MIX = f"""
WITH d AS (
  SELECT doc_id, source, len({WORDS.format("text")})::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents
),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS class FROM d GROUP BY source),
u AS (SELECT *, CASE class {" ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))} END AS weight FROM s),
o AS (
  SELECT *, (3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (2 * sum(weight) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM u WINDOW q AS (ORDER BY source_size / weight, source)
),
t AS (
  SELECT source, class, source_size, least(2.0::DOUBLE * source_size, weight * coalesce((SELECT arg_min(level, source_size / weight) FROM o WHERE level * weight <= 2 * source_size), 'inf'::DOUBLE)) AS target
  FROM o
),
b AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.class, d.h,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(d.h, 1, 8))::BIGINT % {BUCKETS}, d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS rounds FROM b),
k AS (SELECT *, (rounds * size + greatest(0, least(size, floor(target)::BIGINT - rounds * source_size - before)))::BIGINT AS taken FROM r)
SELECT doc_id, size, source_size, target, taken, {_position(0)} AS position, {_position(1)} AS position_2 FROM k
"""

NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, list_dot_product(a.v, v.v)::BIGINT AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER q)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW q AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER q <= 3
"""

PHRASES = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM t),
i AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT lang, i, words, unnest(range(1, least(5, len(words) - i + 1) + 1)) AS k FROM i),
f AS (SELECT lang, words[i:i + k - 1] AS p, k, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
o AS (
  SELECT lang, p[i:j] AS p, max(a) AS over FROM (SELECT lang, p, a, k, i, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM f)) WHERE j - i + 1 < k GROUP BY ALL
),
c AS (SELECT f.* FROM f LEFT JOIN o ON o.lang = f.lang AND o.p = f.p WHERE f.k > 1 AND (over IS NULL OR 100 * over < 100 * f.a)),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT u.lang, array_to_string(u.p, ' ') AS phrase, u.a, x.a AS l, y.a AS r, n.n, ((1000::HUGEINT * u.a * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM u JOIN f x ON x.lang = u.lang AND x.p = u.p[1:u.cut] JOIN f y ON y.lang = u.lang AND y.p = u.p[u.cut + 1:] JOIN n ON n.lang = u.lang
  QUALIFY row_number() OVER (PARTITION BY u.lang, u.p ORDER BY (1000::HUGEINT * u.a * n.n) // (x.a::HUGEINT * y.a), u.cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

SQL: dict[str, str] = {
    "op1_jaccard_partenum": JACCARD,
    "op2_repeated_windows": WINDOWS,
    "op8_curriculum": MIX,
    "op12_angular_negatives": NEGATIVES,
    "op13_setm_phrases": PHRASES,
}
