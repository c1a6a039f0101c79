"""SQL of query results that SQL can express."""

from __future__ import annotations

from aqspark.llm import mixing as mx
from aqspark.llm import quality as ql

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

REPEATS = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
origin AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM win JOIN origin USING (s) CROSS JOIN range(0, 50) r(k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS pos FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

PLAIN_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {PLAIN_WORDS} AS ws FROM documents),
b AS (SELECT item_id, ws, least(len(ws), 10) AS n FROM (SELECT item_id, {PLAIN_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
item AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM b)),
own AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS s
        FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM item))),
hit AS (SELECT r, n, i, s FROM own SEMI JOIN item USING (n, s)),
place AS (SELECT r, count(DISTINCT i + k) AS c FROM hit, range(0, 10) t(k) WHERE k < n GROUP BY r),
named AS (SELECT r, count(*) AS c, string_agg(x, ',' ORDER BY x) AS l
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit JOIN item USING (n, s) WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(place.c, 0)::BIGINT AS n_hit, coalesce(named.c, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(place.c, 0) > 0 AS contaminated
FROM d LEFT JOIN place USING (r) LEFT JOIN named USING (r)
"""

SPELLING = r"""
WITH RECURSIVE step(i, c, k) AS (SELECT i::BIGINT, i::BIGINT, 0 FROM range(0, 256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
run AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents),
own AS (SELECT id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c FROM run GROUP BY ALL),
coded AS (SELECT w, c, hex(encode(id || ':' || w)) AS x FROM own),
hashed AS (SELECT w, c, xor(4294967295, list_reduce(list_transform(range(0, length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT),
    lambda s, b: xor(s >> 8, tab[xor(s & 255, b) + 1]), 4294967295::BIGINT)) AS h FROM coded CROSS JOIN crc),
word AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, sum(c)::BIGINT AS n
         FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5),
cut AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM word)),
link AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN word b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN word b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS m FROM link GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -m[1] >= 5 * n THEN m[2] END AS form, CASE WHEN -m[1] >= 5 * n THEN -m[1] END::BIGINT AS form_n
  FROM word LEFT JOIN best USING (word)),
path(word, at_) AS (SELECT word, word FROM formed UNION ALL SELECT path.word, form FROM path JOIN formed ON at_ = formed.word WHERE form IS NOT NULL)
SELECT path.word, f.form, at_ AS root, f.n, f.n_near, f.form_n FROM path JOIN formed l ON at_ = l.word JOIN formed f ON path.word = f.word WHERE l.form IS NULL
"""


def _distance(prefix: str, n: int) -> str:
    """Jensen-Shannon distance of counts p.<prefix>k from shares r.<prefix>k."""
    total = " + ".join(f"p.{prefix}{k}" for k in range(n))
    terms = []
    for k in range(n):
        p, q = f"(p.{prefix}{k} / ({total}))", f"r.{prefix}{k}"
        terms += [f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END" for x in (p, q)]
    return f"CASE WHEN {total} > 0 THEN sqrt(greatest(({' + '.join(terms)}) / 2, 0)) ELSE 0 END"


def quality_twin() -> str:
    n_common = len(ql.COMMON_WORDS["en"]) + 1
    columns = [f"c{k}" for k in range(ql.CLASSES)] + [f"k{k}" for k in range(n_common)]
    count = lambda w: f"(length(runs) - length(replace(runs, ' {w} ', ''))) / {len(w) + 2}.0"
    common = ", ".join(
        "CASE lang " + " ".join(f"WHEN '{c}' THEN {count(words[k])}" for c, words in ql.COMMON_WORDS.items()) + f" END AS k{k}" for k in range(n_common - 1)
    )
    known = ", ".join(f"'{c}'" for c in ql.COMMON_WORDS)
    group = lambda prefix, n, e: f"sum({e}) / greatest({' + '.join(f'sum({prefix}{k})' for k in range(n))}, 1)"
    shares = ", ".join([f"{group('c', ql.CLASSES, f'c{k}')} AS c{k}" for k in range(ql.CLASSES)] + [f"{group('k', n_common, f'k{k}')} AS k{k}" for k in range(n_common)])
    judged = lambda ref: f"""SELECT p.*, CASE WHEN r.lang IS NOT NULL AND {' + '.join(f'p.c{k}' for k in range(ql.CLASSES))} >= {ql.MIN_CHARS} THEN {_distance('c', ql.CLASSES)} END AS dc,
    CASE WHEN r.lang IS NOT NULL AND n_runs >= {ql.MIN_LETTER_WORDS} THEN {_distance('k', n_common)} END AS dk FROM p LEFT JOIN {ref} r ON p.lang = r.lang"""  # noqa: E731
    return rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep CROSS JOIN range(0, 3) r(k) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
s AS (SELECT * EXCLUDE (ls), (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_words < {ql.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  regexp_replace(t, '\p{{Ll}}+', '', 'g') AS s1, trim(regexp_replace(lower(t), '[^\p{{L}}]+', '  ', 'g'), ' ') AS inner_runs FROM b),
s2 AS (SELECT *, regexp_replace(s1, '\s+', '', 'g') AS s2, ' ' || inner_runs || ' ' AS runs FROM s),
s3 AS (SELECT *, regexp_replace(s2, '\p{{Lu}}+', '', 'g') AS s3 FROM s2),
s4 AS (SELECT *, regexp_replace(s3, '\p{{Nd}}+', '', 'g') AS s4 FROM s3),
s5 AS (SELECT *, regexp_replace(s4, '[.,;:!?''"()-]+', '', 'g') AS s5 FROM s4),
f AS (SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (length(t) - length(s1))::DOUBLE AS c0, (length(s1) - length(s2))::DOUBLE AS c1, (length(s2) - length(s3))::DOUBLE AS c2,
  (length(s3) - length(s4))::DOUBLE AS c3, (length(s4) - length(s5))::DOUBLE AS c4, length(s5)::DOUBLE AS c5, {common},
  CASE WHEN inner_runs = '' THEN 0 ELSE length(runs) - length(replace(runs, '  ', ' ')) + 1 END::DOUBLE AS n_runs FROM s5),
p AS (SELECT *, greatest(n_runs - ({' + '.join(f'k{k}' for k in range(n_common - 1))}), 0) AS k{n_common - 1} FROM f),
r1 AS (SELECT lang, {shares} FROM p WHERE NOT base_failed AND lang IN ({known}) GROUP BY lang),
j1 AS ({judged('r1')}),
r2 AS (SELECT lang, {shares} FROM j1 WHERE coalesce(dc, 0) <= {ql.NEAR_DISTANCE} AND NOT base_failed AND lang IN ({known}) GROUP BY lang),
rf AS (SELECT * FROM r2 UNION ALL SELECT * FROM r1 WHERE lang NOT IN (SELECT lang FROM r2)),
j2 AS ({judged('rf')})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(dc, 0) > {ql.MAX_CLASS_DISTANCE} OR coalesce(dk, 0) > {ql.MAX_WORD_DISTANCE}
    OR (coalesce(dc, 0) > {ql.MAX_BOTH[0]} AND coalesce(dk, 0) > {ql.MAX_BOTH[1]})) AS kept,
  round(dc, 6) AS class_distance, round(dk, 6) AS word_distance
FROM j2
"""


def mixing_twin() -> str:
    """The slots of a source are known from its target, so no draw is needed for what is taken in all."""
    number = lambda text: f"('0x' || substr(md5({text}), 1, 15))::BIGINT"
    order = number("doc_id::VARCHAR")
    x = "x0"
    for r in range(mx.ROUNDS):
        key, salt = (number(f"'{mx.SEED}:' || at_ || ':' || turn || ':{2 * r + k}'") for k in (0, 1))
        previous = "k0" if r == 0 else f"x{r}"
        x += f"""
, p{r} AS (SELECT *, (({key} % n - x) % n + n) % n AS other, {salt} % {mx.PRIME} AS salt FROM {previous})
, s{r} AS (SELECT *, (greatest(x, other) + salt) % {mx.PRIME} AS seen FROM p{r})
, x{r + 1} AS (SELECT at_, n, turn, CASE WHEN (seen * seen % {mx.PRIME}) % 2 = 1 THEN other ELSE x END AS x FROM s{r})"""
    steps = x.removeprefix("x0")
    return f"""
WITH w AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, {order} AS key FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM w GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS at_ FROM src),
wt AS (SELECT *, {list(mx.WEIGHTS)}[at_ % {len(mx.WEIGHTS)} + 1] AS weight FROM n),
cap AS (SELECT *, {mx.MAX_REPEATS} * source_size AS cap, row_number() OVER (ORDER BY {mx.MAX_REPEATS} * source_size / weight, at_) AS place FROM wt),
lft AS (SELECT *, {mx.BUDGET!r}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS open_words,
  sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight FROM cap WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT min(place) AS place FROM lft WHERE open_words * weight <= cap * open_weight),
tgt AS (SELECT l.*, CASE WHEN l.place < cut.place THEN l.cap::DOUBLE ELSE c.open_words * l.weight / c.open_weight END AS target,
  (l.source_size + {mx.BLOCK - 1}) // {mx.BLOCK} AS blocks FROM lft l, cut JOIN lft c ON c.place = cut.place),
slots AS (SELECT *, CASE WHEN blocks = 0 THEN 0 ELSE least({mx.MAX_REPEATS} * blocks, floor(target / (source_size::DOUBLE / blocks) + 0.5)::BIGINT) END AS slots FROM tgt),
k0 AS (SELECT at_, blocks AS n, k // blocks AS turn, k % blocks AS x FROM (SELECT at_, blocks, unnest(range(slots)) AS k FROM slots)){steps},
times AS (SELECT at_, x AS block, count(*) AS times FROM x{mx.ROUNDS} GROUP BY 1, 2),
placed AS (SELECT w.*, s.at_, s.source_size, s.target, coalesce(sum(size) OVER (PARTITION BY s.at_ ORDER BY key, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ FROM w JOIN slots s ON w.source IS NOT DISTINCT FROM s.source),
piece AS (SELECT doc_id, at_, start_, size, unnest(range(start_ // {mx.BLOCK}, (start_ + size - 1) // {mx.BLOCK} + 1)) AS block FROM placed WHERE size > 0),
taken AS (SELECT doc_id, sum((least((block + 1) * {mx.BLOCK}, start_ + size) - greatest(block * {mx.BLOCK}, start_)) * times) AS taken
  FROM piece JOIN times USING (at_, block) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN taken USING (doc_id)
"""
