"""DuckDB SQL for the rows of the mixing query."""

from __future__ import annotations

from .mixing import LEAST_SHARE, LEVELS, LONG_WORD, MET, SWEEPS, TOPICS, TRIMMED, WIDEST, Targets


def _goal(k: int, shares) -> str:
    """Target shares of the classes that have tokens; the corpus's own shares to a power where a number is given."""
    if isinstance(shares, int | float):
        share = "(SELECT coalesce(sum(t) FILTER (WHERE c{k} = '*'), 0) / sum(t) FROM cells)".format(k=k)
        raw = f"SELECT c{k}, sum(t) AS own, CASE WHEN c{k} = '*' THEN NULL ELSE pow(sum(t), {shares}) END AS p FROM cells GROUP BY c{k}"
        return f"SELECT c{k}, own, CASE WHEN c{k} = '*' THEN {share} ELSE p / sum(p) OVER () * (1 - {share}) END AS g{k} FROM ({raw})"
    listed = ", ".join(f"('{v}', {x!r}::DOUBLE)" for v, x in shares.items())
    raw = f"SELECT c{k}, own, coalesce(g, 0) AS g FROM (SELECT c{k}, sum(t) AS own FROM cells GROUP BY c{k}) LEFT JOIN (VALUES {listed}) AS v(c{k}, g) USING (c{k})"
    return f"SELECT c{k}, own, g / sum(g) OVER () AS g{k} FROM ({raw})"


def sql(targets: Targets) -> str:
    dims = range(len(targets))
    keys = ", ".join(f"c{k}" for k in dims)
    plain = "lower(coalesce(text, ''))"
    for c in (9, 13, 10, 11, 12):
        plain = f"replace({plain}, chr({c}), ' ')"

    def value(name: str, shares) -> str:
        return f"coalesce({name}, '*')" if isinstance(shares, int | float) else f"CASE WHEN {name} IN ({', '.join(repr(v) for v in shares if v != '*')}) THEN {name} ELSE '*' END"

    def of(k: int, shares) -> str:
        return f"CASE WHEN v{k} IN (SELECT v{k} FROM valued GROUP BY v{k} HAVING sum(tokens) >= {LEAST_SHARE} * (SELECT sum(tokens) FROM valued)) THEN v{k} ELSE '*' END" if isinstance(shares, int | float) else f"v{k}"

    values = ", ".join(f"{value(n, s)} AS v{k}" for k, (n, s) in enumerate(targets.items()))
    classes = ", ".join(f"{of(k, s)} AS c{k}" for k, s in enumerate(targets.values()))
    goals = ", ".join(f"goal{k} AS ({_goal(k, s)})" for k, s in enumerate(targets.values()))
    steps = " ".join(f"WHEN {k} THEN least(w * amount * g{k} / sum(w) OVER (PARTITION BY level, c{k}), coalesce(most * t, 'infinity'::DOUBLE))" for k in dims)
    gs = ", ".join(f"g{k}" for k in dims)
    room = ", ".join(f"(SELECT min(own / g{k}) FROM goal{k} WHERE g{k} > 0)" for k in dims)
    levels = ", ".join([f"({n}, {x!r}::DOUBLE, 1::DOUBLE)" for n, x in enumerate(LEVELS)] + [f"({len(LEVELS)}, {LEVELS[-1]!r}::DOUBLE, NULL)"])
    far = " UNION ALL ".join(f"SELECT level, abs(sum(w) / any_value(amount) - any_value(g{k})) AS d FROM ended GROUP BY level, c{k}" for k in dims)
    return f"""
WITH RECURSIVE split AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, source, lang, list_filter(string_split({plain}, ' '), lambda w: w <> '') AS words FROM documents),
worded AS MATERIALIZED (SELECT row, doc_id, source, lang, len(words)::BIGINT AS tokens, list_filter(list_transform(words, lambda w: trim(w, '{TRIMMED}')), lambda w: length(w) >= {LONG_WORD}) AS long FROM split),
spread AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(long)) AS word FROM worded) GROUP BY word HAVING count(*) <= {WIDEST} * (SELECT count(*) FROM documents)),
named AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS place FROM spread ORDER BY n DESC, word LIMIT {TOPICS}),
used AS (SELECT row, word, place, count(*) AS n FROM (SELECT row, unnest(long) AS word FROM worded) JOIN named USING (word) GROUP BY ALL),
topics AS (SELECT row, arg_max(word, n * 1000 - place) AS topic FROM used GROUP BY row),
placed AS (SELECT doc_id, source, lang, tokens, coalesce(topic, 'none') AS topic FROM worded LEFT JOIN topics USING (row)),
valued AS MATERIALIZED (SELECT *, {values} FROM placed),
docs AS MATERIALIZED (SELECT *, {classes} FROM valued),
cells AS MATERIALIZED (SELECT {keys}, sum(tokens)::DOUBLE AS t FROM docs GROUP BY {keys} HAVING sum(tokens) > 0),
{goals},
levels AS (SELECT level, part * least((SELECT sum(t) FROM cells), {room}) AS amount, most FROM (VALUES {levels}) AS v(level, part, most)),
raked AS (
    SELECT 0 AS n, level, amount, most, {keys}, t, t AS w, {gs} FROM cells {' '.join(f'JOIN goal{k} USING (c{k})' for k in dims)} CROSS JOIN levels
    UNION ALL
    SELECT n + 1, level, amount, most, {keys}, t, CASE n % {len(targets)} {steps} END, {gs} FROM raked WHERE n < {SWEEPS * len(targets)}
),
ended AS MATERIALIZED (SELECT * FROM raked WHERE n = {SWEEPS * len(targets)}),
best AS (SELECT min(level) AS level FROM (SELECT level, max(d) AS d FROM ({far}) GROUP BY level) WHERE d <= {MET} OR level = {len(LEVELS)}),
chosen AS MATERIALIZED (SELECT {keys}, t, w FROM ended WHERE level = (SELECT level FROM best)),
rates AS (SELECT {keys}, w / (SELECT sum(w) FROM chosen) AS w, round(w / t * least(1, 1 / (SELECT max(w / t) FROM chosen)), 9) AS rate FROM chosen),
final AS (SELECT *, CASE WHEN tokens > 0 THEN coalesce(rate, 0) ELSE 1 END AS p FROM docs LEFT JOIN rates USING ({keys}))
SELECT doc_id, source, lang, topic, tokens, round(CASE WHEN tokens > 0 THEN coalesce(w, 0) ELSE 0 END, 6) AS weight, round(p, 6) AS probability,
    floor(p) = 1 OR CAST('0x' || substr(md5('mix|' || doc_id::VARCHAR), 1, 8) AS BIGINT) / 4294967296.0 < p AS sampled
FROM final
"""
