"""Pieces of the SQL that the queries are checked against.

Each function returns named subqueries; :func:`with_parts` puts them in front of a select.
"""

from __future__ import annotations

from reviewloom.functions.fixed_values import PUNCTUATION, STOP_WORDS
from reviewloom.functions.text import WORD_PATTERN

MIN_DF = 1
SIZE = 64


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STOP_LIST = ", ".join(quoted(word) for word in STOP_WORDS)


def cleaned(text: str) -> str:
    return f"translate(lower({text}), {quoted(PUNCTUATION)}, {quoted(' ' * len(PUNCTUATION))})"


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {quoted(WORD_PATTERN)})"


def r6(number: str) -> str:
    return f"round({number}, 6) + 0.0"


def spread_hash(number: str, salt: str) -> str:
    return f"('0x' || substr(md5({number} || ':{salt}'), 1, 12))::bigint"


def with_parts(parts: dict[str, str], select: str) -> str:
    listed = ",\n".join(f"{name} AS ({body})" for name, body in parts.items())
    return f"WITH {listed}\n{select}"


REVIEWS_TEXT = """
SELECT d.doc_id AS review_id,
       CASE WHEN d.doc_id % 10 = 0 THEN 1000000 + d.doc_id
            ELSE (d.doc_id * 7919) % 61 END AS user_id,
       CASE WHEN d.doc_id % 20 = 0 THEN concat('solo', CAST(d.doc_id AS VARCHAR))
            ELSE d.source END AS business_id,
       CASE WHEN l.quality IS NULL THEN NULL
            ELSE 1 + 3 * l.quality + (1 - l.toxic) END AS rating,
       d.text AS review_text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

REVIEWS_BULK = """
SELECT o.o_custkey AS user_id, l.l_suppkey AS business_id,
       CAST(l.l_quantity AS INT) AS rating,
       concat(p.p_name, ' ', lower(p.p_type)) AS review_text,
       l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                JOIN part   p ON l.l_partkey  = p.p_partkey"""

RECIPES = """
SELECT p_partkey AS recipe_id, p_name AS name,
       concat('[''', replace(p_name, ' ', ''', '''), ''', ''', lower(p_type), ''']') AS ingredients,
       concat('[''', lower(p_brand), ''', ''', lower(p_type), ''']') AS tags
FROM part"""


def vocabulary(min_df: int = MIN_DF) -> dict[str, str]:
    return {
        "vocab": f"""
SELECT word, df, row_number() OVER (ORDER BY word) - 1 AS idx
FROM (SELECT word, count(DISTINCT doc_id) AS df
      FROM (SELECT doc_id, unnest({tokens('text')}) AS word FROM documents)
      WHERE word NOT IN ({STOP_LIST}) GROUP BY word)
WHERE df >= {min_df}"""
    }


def vectors() -> dict[str, str]:
    """``vec``: one row per word and component."""
    return {
        "vec": f"""
SELECT v.word, unnest(range({SIZE})) AS dim, unnest(e.embedding)::double AS x
FROM vocab v JOIN embeddings e
  ON e.vec_id = v.idx % (SELECT count(*) FROM embeddings)"""
    }


def vector_ends() -> dict[str, str]:
    """``ends``: the first and the last component of each word's vector."""
    return {
        "ends": f"""
SELECT v.word, e.embedding[1]::double AS first, e.embedding[{SIZE}]::double AS last
FROM vocab v JOIN embeddings e
  ON e.vec_id = v.idx % (SELECT count(*) FROM embeddings)"""
    }


def occurrences() -> dict[str, str]:
    """``counts0``: usable words per review before the clean-up."""
    return vocabulary() | {
        "reviews": REVIEWS_TEXT,
        "occ": f"""
SELECT user_id, business_id, review_id, word
FROM (SELECT user_id, business_id, review_id,
             unnest(string_split({cleaned('review_text')}, ' ')) AS word FROM reviews)
WHERE word IN (SELECT word FROM vocab) AND word <> '' AND word NOT IN ({STOP_LIST})""",
        "counts0": """
SELECT user_id, business_id, review_id, word, count(*) AS n
FROM occ GROUP BY ALL""",
    }


def kept() -> dict[str, str]:
    """``ids`` and ``counts`` after both clean-up steps."""
    return occurrences() | {
        "ids0": """
SELECT *, count(*) OVER (PARTITION BY user_id) AS cu,
       count(*) OVER (PARTITION BY business_id) AS cb
FROM (SELECT DISTINCT user_id, business_id, review_id FROM counts0)""",
        "ids": "SELECT user_id, business_id, review_id FROM ids0 WHERE NOT (cu = 1 AND cb = 1)",
        "counts": "SELECT c.* FROM counts0 c SEMI JOIN ids i ON c.review_id = i.review_id",
    }


def weights(name: str, key: str, tf: str, documents: str) -> dict[str, str]:
    """``name``: key, word, tf, df, weight, from the subquery ``tf``."""
    return {
        f"{name}_df": f"SELECT word, count(*) AS df FROM {tf} GROUP BY word",
        f"{name}_n": f"SELECT count(*) AS n FROM {documents}",
        f"{name}_r": f"""
SELECT t.{key}, t.word, t.tf, d.df,
       t.tf * (ln((1.0 + n.n) / (1.0 + d.df)) + 1.0) AS r
FROM {tf} t JOIN {name}_df d ON t.word = d.word CROSS JOIN {name}_n n""",
        name: f"""
SELECT {key}, word, tf, df, r / sqrt(sum(r * r) OVER (PARTITION BY {key})) AS weight
FROM {name}_r""",
    }


def entity_weights(entity: str) -> dict[str, str]:
    key = f"{entity}_id"
    return {
        f"{entity}_tf": f"SELECT {key}, word, sum(n)::bigint AS tf FROM counts GROUP BY ALL",
        f"{entity}_docs": f"SELECT DISTINCT {key} FROM counts",
    } | weights(f"{entity}_w", key, f"{entity}_tf", f"{entity}_docs")


def review_sums(mode: str) -> dict[str, str]:
    """``rv``: per review and component the sums for both sides.

    ``mode`` is ``plain`` (every word counts 1), ``tfidf`` (plain vectors over the sum of
    the weights) or ``weighted`` (weighted vectors over the sum of the weights).
    """
    if mode == "plain":
        parts, user, business = {}, "1.0", "1.0"
        joins = ""
    else:
        parts = entity_weights("user") | entity_weights("business")
        user, business = "u.weight", "b.weight"
        joins = """
JOIN user_w u ON c.user_id = u.user_id AND c.word = u.word
JOIN business_w b ON c.business_id = b.business_id AND c.word = b.word"""
    times_user = f"{user} * " if mode == "weighted" else ""
    times_business = f"{business} * " if mode == "weighted" else ""
    return (
        kept()
        | vectors()
        | parts
        | {
            "rv": f"""
SELECT c.user_id, c.business_id, c.review_id, v.dim,
       sum({times_user}c.n * v.x) AS user_v, sum({user} * c.n)::double AS user_wt,
       sum({times_business}c.n * v.x) AS business_v,
       sum({business} * c.n)::double AS business_wt
FROM counts c JOIN vec v ON c.word = v.word {joins}
GROUP BY ALL""",
        }
    )


def entity_means(entity: str) -> dict[str, str]:
    key = f"{entity}_id"
    return {
        f"{entity}_mean": f"""
SELECT {key}, dim, sum({entity}_v) / sum({entity}_wt) AS value FROM rv GROUP BY ALL"""
    }


def leave_one_out() -> dict[str, str]:
    """``loo``: per review and component both vectors without the review itself."""

    def others(entity: str) -> str:
        window = f"OVER (PARTITION BY {entity}_id, dim)"
        return f"""
count(*) {window} AS {entity}_c,
sum({entity}_v) {window} - {entity}_v AS {entity}_dv,
sum({entity}_wt) {window} - {entity}_wt AS {entity}_dw"""

    return {
        "rest": f"""
SELECT user_id, business_id, review_id, dim, {others('user')}, {others('business')}
FROM rv""",
        "loo": """
SELECT user_id, business_id, review_id, dim,
       user_dv / user_dw AS user_value, business_dv / business_dw AS business_value
FROM rest WHERE user_c > 1 AND business_c > 1""",
    }


def unseen(seen: str) -> dict[str, str]:
    """``unseen``: as many unseen pairs as there are rows with both ids.

    A candidate is a point on the line that the gaps of all users make; see the operator.
    """
    return {
        "pair_n": f"""
SELECT user_id, business_id, count(*) AS n FROM {seen}
WHERE user_id IS NOT NULL AND business_id IS NOT NULL GROUP BY user_id, business_id""",
        "user_n": "SELECT user_id, sum(n)::hugeint AS user_n FROM pair_n GROUP BY user_id",
        "business_line": """
SELECT business_id, sum(n) OVER (ORDER BY business_id)::hugeint AS upto, upto - n AS first
FROM (SELECT business_id, sum(n)::hugeint AS n FROM pair_n GROUP BY business_id)""",
        "gaps": """
SELECT user_id, first, coalesce(lag(upto) OVER (PARTITION BY user_id ORDER BY first), 0) AS free_from
FROM (SELECT user_id, first, upto FROM pair_n JOIN business_line USING (business_id)
      UNION ALL SELECT user_id, t, t FROM user_n, (SELECT sum(n)::hugeint AS t FROM pair_n))""",
        "gap_line": """
SELECT user_id, user_n, free_from, weight,
       sum(weight) OVER (ORDER BY user_id, free_from)::hugeint - weight AS start
FROM (SELECT *, (first - free_from) * user_n AS weight
      FROM gaps JOIN user_n USING (user_id) WHERE free_from < first)""",
        "points": f"""
SELECT candidate, ({spread_hash('candidate', 'u')}::hugeint * 281474976710656
                   + {spread_hash('candidate', 'b')}) % whole AS point
FROM (SELECT unnest(range(sum(n)::bigint)) AS candidate FROM pair_n),
     (SELECT sum(weight)::hugeint AS whole FROM gap_line)""",
        "places": """
SELECT candidate, user_id, free_from + (point - start) // user_n AS place
FROM points ASOF JOIN gap_line ON point >= start""",
        "unseen": """
SELECT candidate, user_id, business_id FROM places ASOF JOIN business_line ON place >= first""",
    }


def lloyd(name: str, points: str, k: int, steps: int = 10) -> dict[str, str]:
    """``name``: id, grp of the subquery ``points`` (id, dim, x), by unrolled steps."""
    parts = {
        f"{name}_p": f"""
SELECT * FROM {points} WHERE id NOT IN (
  SELECT id FROM {points} WHERE x IS NULL OR isnan(x))""",
        f"{name}_first": f"""
SELECT id, row_number() OVER (ORDER BY {spread_hash('id', 'seed')}, id) - 1 AS grp
FROM (SELECT DISTINCT id FROM {name}_p) QUALIFY grp < {k}""",
        f"{name}_c0": f"SELECT f.grp, p.dim, p.x AS c FROM {name}_first f JOIN {name}_p p USING (id)",
    }
    for step in range(steps + 1):
        last = name if step == steps else f"{name}_g{step}"
        parts[last] = f"""
SELECT id, arg_min(grp, (distance, grp)) AS grp
FROM (SELECT p.id, m.grp, round(sum((p.x - m.c) * (p.x - m.c)), 9) AS distance
      FROM {name}_p p JOIN {name}_c{step} m USING (dim) GROUP BY ALL) GROUP BY id"""
        if step < steps:
            parts[f"{name}_c{step + 1}"] = f"""
SELECT o.grp, o.dim, coalesce(n.c, o.c) AS c FROM {name}_c{step} o LEFT JOIN (
  SELECT g.grp, p.dim, avg(p.x) AS c FROM {name}_p p JOIN {last} g USING (id) GROUP BY ALL) n
USING (grp, dim)"""
    return parts
