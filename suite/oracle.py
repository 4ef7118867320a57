"""The queries of ``suite.queries`` in SQL for DuckDB, written from the meaning of each operator."""

from __future__ import annotations

import re

from funclab import config
from funclab.functions.text import PYTHON_SPACE
from suite.views import MARK, NESTED, SIGNS

CONFIGURATION = "data_with_comments_single_before_change"
SPACE = "concat(" + ", ".join(f"chr({ord(c)})" for c in PYTHON_SPACE) + ")"
NL = "chr(10)"
TICK = "chr(96)"
QUOTE = "chr(34)"


def key(*parts):
    return f"md5(concat_ws(':', {', '.join(parts)}))"


def h(*parts):
    return f"('0x' || substr({key(*parts)}, 1, 15))::BIGINT"


def text(value):
    return "'" + value.replace("'", "''") + "'"


def strip(x):
    return f"trim({x}, {SPACE})"


def filled(template, **columns):
    """A template as an SQL concatenation."""
    pieces = re.split(r"\{(\w+)\}", template)
    return " || ".join(columns[p] if i % 2 else text(p) for i, p in enumerate(pieces) if i % 2 or p)


def loc(x):
    return f"(length({x}) - length(replace({x}, {NL}, '')) + 1)"


VERDICT = "CASE WHEN {t} = 1 THEN 'Vulnerable' ELSE 'Non-Vulnerable' END"


def verdict(t):
    return VERDICT.format(t=t)


# --- views -----------------------------------------------------------------------------------

CTES = {}

CTES["v_raw"] = f"""
SELECT d.doc_id AS row_id,
       CASE d.lang WHEN 'en' THEN 'rust' WHEN 'fr' THEN 'kotlin' WHEN 'de' THEN 'swift' ELSE 'cpp' END AS language,
       d.source AS repo_url, d.text AS code, l.toxic AS label,
       CASE WHEN {h("'before'", "d.doc_id")} % 10 = 0 THEN 'False' ELSE 'True' END AS before_change,
       CASE WHEN {h("'added'", "d.doc_id")} % 8 = 0 THEN 'true' ELSE 'False' END AS added_only,
       CASE WHEN l.toxic = 1 THEN coalesce(nullif(array_to_string(list_transform(
            list_filter(range(0, {loc("d.text")}), lambda i: {h("'mod'", "d.doc_id", "i")} % 3 = 0),
            lambda i: i::VARCHAR), ','), ''), '0') END AS mod_lines
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

CTES["v_clean"] = f"""
SELECT row_id, language, code AS processed_func, label AS target, mod_lines AS flaw_line_index,
       CASE WHEN label = 1 THEN array_to_string(list_transform(string_split(mod_lines, ','),
            lambda x: string_split(code, {NL})[x::INT + 1]), '/~/') ELSE '' END AS flaw_line,
       '{CONFIGURATION}' AS configuration
FROM v_raw
WHERE lower(before_change) = 'true' AND NOT (label = 1 AND lower(added_only) = 'true')
"""

CTES["v_code"] = f"""
SELECT row_id, language, array_to_string(list_transform(string_split(code, {NL}), lambda line, i: line ||
       CASE {h("'code'", "row_id", "i - 1")} % 6 WHEN 0 THEN ' // note' WHEN 1 THEN ' /* a' || {NL} || ' b */'
            WHEN 2 THEN ' "h//t"' WHEN 3 THEN ' /* x // y */ z' ELSE '' END), {NL}) AS processed_func
FROM v_raw
"""

CTES["v_order"] = f"""
SELECT *, list_transform(list_sort(list_transform(
              list_filter(range(0, {loc("processed_func")}), lambda i: {h("'pick'", "row_id", "i")} % 4 = 0),
              lambda i: {{'h': {h("'pick'", "row_id", "i")}, 'i': i}})), lambda s: s.i) AS picked
FROM v_clean
"""

CTES["v_shown"] = f"""
SELECT *, list_transform(picked, lambda i: 'Line number ' || i || ': ' || CASE WHEN i % 2 = 0
              THEN {TICK} || string_split(processed_func, {NL})[i + 1] || {TICK}
              ELSE string_split(processed_func, {NL})[i + 1] END) AS shown
FROM v_order
"""

MODELS = ", ".join(f"('{m}')" for m in config.MODELS)

CTES["v_results"] = f"""
WITH runs AS (
  SELECT s.*, e.experiment, m.model, {h("m.model", "e.experiment", "s.row_id").replace("concat_ws(':', ", "concat_ws(':', 'flip', ")} % 5 = 0 AS wrong,
         {h("'say'", "m.model", "e.experiment", "s.row_id")} % 6 AS say,
         ({h("'start'", "m.model", "e.experiment", "s.row_id")} % 3 + 1)::INT AS start
  FROM v_shown s CROSS JOIN (SELECT unnest(range(10))::INT AS experiment) e CROSS JOIN (VALUES {MODELS}) m(model)
), said AS (
  SELECT *, CASE WHEN wrong THEN 1 - target ELSE target END AS prediction, model NOT LIKE 'linevul%' AS answers FROM runs
), spoken AS (
  SELECT *, {verdict("prediction")} AS word FROM said
)
SELECT language, configuration, experiment, model, row_id, processed_func, target, prediction, flaw_line_index,
  CASE WHEN answers THEN CASE say WHEN 0 THEN '1. Analysis: ' || word WHEN 1 THEN lower('1. analysis: ' || word)
    WHEN 2 THEN '1. Analysis: ' || word || {NL} || 'The code reads input.' WHEN 3 THEN '1. Analysis: ' || word || '.'
    WHEN 4 THEN word ELSE 'Sure. ANALYSIS:  ' || word || ' ' END END AS func_response,
  CASE WHEN answers AND prediction = 1 THEN array_to_string(shown[start:], {NL}) WHEN answers THEN '' END AS line_response,
  CASE WHEN NOT answers THEN picked[start:] END AS line_ranking,
  CASE WHEN NOT answers THEN {loc("processed_func")}::INT END AS num_lines,
  CASE WHEN NOT answers THEN CASE WHEN target = 1 THEN len(string_split(flaw_line_index, ','))::INT ELSE 0 END END AS num_flaw_lines
FROM spoken
"""

CTES["v_skips"] = f"""
SELECT language, configuration, experiment
FROM (SELECT DISTINCT language, configuration FROM v_clean) CROSS JOIN (SELECT unnest(range(10))::INT AS experiment)
WHERE {h("'skip'", "language", "experiment")} % 3 = 0
"""

CTES["v_chats"] = f"""
SELECT row_id, language,
       {filled(config.SYSTEM_TEXT, language="language")} AS system,
       {filled(config.TASK_TEXT, language="language", new_source_code="processed_func")} AS "user",
       {filled(config.ANSWER_TEXT, analysis=verdict("target"))} AS assistant
FROM v_clean
"""

CTES["v_chat_lines"] = f"""
WITH parts AS (
  SELECT row_id, {h("'bad'", "row_id")} % 9 AS bad, "user" AS u,
         json_object('role', 'system', 'content', system)::VARCHAR AS m0,
         json_object('role', 'user', 'content', "user")::VARCHAR AS m1,
         json_object('role', 'assistant', 'content', assistant)::VARCHAR AS m2
  FROM v_chats
)
SELECT row_id, CASE bad
  WHEN 0 THEN '[1, 2]' WHEN 1 THEN '{{"messages": []}}' WHEN 7 THEN '{{"note": "x"}}'
  ELSE '{{"messages": [' || m0 || ', ' || CASE bad
    WHEN 2 THEN m1 || ', {{"role": "assistant"}}'
    WHEN 3 THEN json_object('role', 'user', 'content', u, 'weight', 1)::VARCHAR || ', ' || m2
    WHEN 4 THEN m1 || ', {{"role": "bot", "content": "yes"}}'
    WHEN 5 THEN '{{"role": "user", "content": ""}}, ' || m2
    WHEN 6 THEN m1
    ELSE m1 || ', {{"role": "assistant", "content": 5}}' END || ']}}' END AS value
FROM parts
"""

CTES["v_named"] = f"""
WITH parts AS (
  SELECT *, {h("'named'", "row_id")} % 6 AS pick, CASE WHEN {h("'named'", "row_id")} % 6 IN (1, 2) THEN 'user_' || row_id % 5 END AS uname,
         CASE WHEN {h("'named'", "row_id")} % 6 = 2 THEN 'bot one' END AS aname, {h("'named'", "row_id")} % 6 < 3 AS fine
  FROM v_chats
)
SELECT *, CASE WHEN pick = 3 THEN '[1]'
  WHEN pick = 4 THEN '{{"messages": [1, ' || json_object('role', 'user', 'content', "user")::VARCHAR || ']}}'
  ELSE '{{"messages": [' || json_object('role', 'system', 'content', system)::VARCHAR END AS line
FROM parts
"""

# Comment tokens. DuckDB's matcher needs no guard against deep recursion.
STR = r'"(?:[^"\\]|\\(?s:.))*"'
CHR = r"'(?:[^'\\\n]|\\[^\n][^'\n]*)'"
TOKENS = {
    "rust": r'"[^"\\]*(?:\\(?s:.)[^"\\]*)*"|' + CHR + r'|//[^\n]*|/\*(?s:.*?)\*/|[^"\'/]+|(?s:.)',
    "kotlin": r'"""(?s:.*?)""""*|' + STR + "|" + CHR + r'|//[^\n]*|/\*(?s:.*?)\*/|[^"\'/]+|(?s:.)',
    "swift": r'"""(?s:.*?)"""|' + STR + r'|//[^\n]*|/\*(?s:.*?)\*/|[^"/]+|(?s:.)',
    "cpp": STR + "|" + CHR + r'|//[^\n]*|/\*(?s:.*?)\*/|[^"\'/]+|(?s:.)',
}

_cut = " ".join(f"WHEN '{lang}' THEN regexp_extract_all(processed_func, {text(p)})" for lang, p in TOKENS.items())
CTES["v_tokens"] = f"SELECT row_id, language, processed_func, CASE language {_cut} END AS tokens FROM v_code"

IS_COMMENT = "(starts_with(t, '//') OR (starts_with(t, '/*') AND length(t) > 1 AND language <> 'kotlin'))"


def drop_last_break(x):
    return f"regexp_replace({x}, '\\n\\z', '')"


def lines_of(x):
    return f"CASE WHEN {x} = '' THEN [] ELSE string_split({drop_last_break(x)}, {NL}) END"


CTES["v_stripped"] = f"""
SELECT row_id, language, {drop_last_break(f'''array_to_string(list_transform(tokens, lambda t: CASE WHEN {IS_COMMENT}
       THEN regexp_replace(t, '[^\\n]+', '', 'g') ELSE t END), '')''')} AS processed_func
FROM v_tokens
"""

CTES["v_noisy"] = f"""
WITH marked AS (
  SELECT row_id, processed_func, array_to_string(list_transform(tokens, lambda t: CASE WHEN {IS_COMMENT}
         THEN chr(1) || replace(regexp_replace(t, '[^\\n]+', '', 'g'), {NL}, {NL} || chr(1)) ELSE t END), '') AS m
  FROM v_tokens
), split AS (SELECT row_id, processed_func, {lines_of("m")} AS ml FROM marked)
SELECT row_id, processed_func, list_filter(range(0, len(ml)), lambda i:
       contains(ml[i + 1], chr(1)) OR {strip("ml[i + 1]")} = '') AS ids
FROM split
"""



def _ends(k):
    """The ends of lines of the nested view, of a kind, by language."""
    shown = {lang: ", ".join(text(p[k]).replace(MARK, "' || chr(1) || '") for p in list_) for lang, list_ in NESTED.items()}
    return "CASE language " + " ".join(f"WHEN '{lang}' THEN [{x}]" for lang, x in shown.items()) + " END"


def _nested(k):
    line = f"translate(line, {text(SIGNS)}, '{'_' * len(SIGNS)}')"
    end = f"coalesce(({_ends(k)})[({h(chr(39) + 'nest' + chr(39), 'row_id', 'i - 1')} % 8)::INT + 1], '')"
    return f"array_to_string(list_transform(string_split(code, {NL}), lambda line, i: {line} || {end}), {NL})"


# What is left without comments, and the lines that hold some, are known here without reading the text.
CTES["v_nested"] = f"""
SELECT row_id, language, {_nested(0)} AS dirty, {drop_last_break(_nested(1))} AS clean, {_nested(2)} AS marked FROM v_raw
"""
CTES["v_nested_noisy"] = f"""
WITH split AS (SELECT row_id, dirty, {lines_of("marked")} AS ml FROM v_nested)
SELECT row_id, dirty, list_filter(range(0, len(ml)), lambda i: contains(ml[i + 1], chr(1)) OR {strip("ml[i + 1]")} = '') AS ids FROM split
"""

# --- splits ----------------------------------------------------------------------------------


def shares(size, part, total, group, cls):
    """Whole part of the share, plus one for the largest fractions, the lower class first."""
    exact = f"({part}::DOUBLE / nullif({total}, 0)::DOUBLE * {size})"
    return exact


def split_ctes(by, seeds, cls="target"):
    """Exact split of ``v_clean``: each row once per seed, with its split."""
    g = ", ".join(by)
    c = cls or "0"
    return f"""
WITH counts AS (
  SELECT {g}, {c} AS cls, count(*) AS n_class FROM v_clean GROUP BY ALL
), sizes AS (
  SELECT *, sum(n_class) OVER (PARTITION BY {g}) AS n FROM counts
), rests AS (
  SELECT *, ceil(0.4::DOUBLE * n::DOUBLE)::BIGINT AS n_rest FROM sizes
), e1 AS (
  SELECT *, n - n_rest AS s_train, n_rest - ceil(n_rest::DOUBLE * 0.5::DOUBLE)::BIGINT AS s_val,
         n_class::DOUBLE / n::DOUBLE * (n - n_rest) AS x FROM rests
), q1 AS (
  SELECT *, floor(x)::BIGINT + CASE WHEN row_number() OVER (PARTITION BY {g} ORDER BY x - floor(x) DESC, cls)
         <= s_train - sum(floor(x)::BIGINT) OVER (PARTITION BY {g}) THEN 1 ELSE 0 END AS n_train FROM e1
), e2 AS (
  SELECT * EXCLUDE (x), coalesce((n_class - n_train)::DOUBLE / nullif(n_rest, 0)::DOUBLE * s_val, 0) AS x FROM q1
), q2 AS (
  SELECT *, floor(x)::BIGINT + CASE WHEN row_number() OVER (PARTITION BY {g} ORDER BY x - floor(x) DESC, cls)
         <= s_val - sum(floor(x)::BIGINT) OVER (PARTITION BY {g}) THEN 1 ELSE 0 END AS n_val FROM e2
), ranked AS (
  SELECT v.*, r.experiment, row_number() OVER (PARTITION BY {", ".join("v." + b for b in by)}, {"v." + cls if cls else "0"}, r.experiment
         ORDER BY {key("'split'", "r.seed", "v.row_id")}) AS rk
  FROM v_clean v CROSS JOIN (VALUES {seeds}) r(experiment, seed)
)
SELECT ranked.*, CASE WHEN rk <= n_train THEN 'train' WHEN rk <= n_train + n_val THEN 'val' ELSE 'test' END AS split
FROM ranked JOIN q2 ON {" AND ".join(f"ranked.{b} = q2.{b}" for b in by)} {"AND ranked." + cls + " = q2.cls" if cls else ""}
"""


ALL_SEEDS = ", ".join(f"({e}, {s})" for e, s in config.EXPERIMENTS)
CTES["v_split"] = split_ctes(["language", "configuration"], ALL_SEEDS)


def resample_ctes(source, by):
    """Under- and oversampled rows of ``source``."""
    g = ", ".join(by)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in by)
    return f"""
WITH sizes AS (
  SELECT {g}, count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1 FROM {source} GROUP BY ALL
), roles AS (
  SELECT *, least(n0, n1) AS n_minor, CASE WHEN n1 < n0 THEN 1 ELSE 0 END AS redrawn FROM sizes
), marked AS (
  SELECT s.*, n_minor, redrawn,
         row_number() OVER (PARTITION BY {", ".join("s." + b for b in by)}, target ORDER BY {key("'under'", "42", "s.row_id")}) AS u,
         row_number() OVER (PARTITION BY {", ".join("s." + b for b in by)}, target ORDER BY {key("'rank'", "42", "s.row_id")}) AS rnk
  FROM {source} s JOIN roles r ON {on("s", "r")}
), draws AS (
  SELECT {g}, {h("'over'", "42", "row_id")} % n_minor + 1 AS rnk, count(*) AS n
  FROM marked WHERE target <> redrawn AND n_minor > 0 GROUP BY ALL
)
SELECT marked.* EXCLUDE (n_minor, redrawn, u, rnk), 'under' AS kind, 0::BIGINT AS copy FROM marked WHERE u <= n_minor
UNION ALL BY NAME
SELECT marked.* EXCLUDE (n_minor, redrawn, u, rnk), 'over' AS kind, 0::BIGINT AS copy FROM marked WHERE target <> redrawn OR n_minor = 0
UNION ALL BY NAME
SELECT marked.* EXCLUDE (n_minor, redrawn, u, rnk), 'over' AS kind, unnest(range(0, d.n)) AS copy
FROM marked JOIN draws d ON {on("marked", "d")} AND marked.rnk = d.rnk WHERE target = redrawn
"""


CTES["v_fit"] = "SELECT * EXCLUDE (rk) FROM v_split WHERE split <> 'test'"
CTES["v_resampled"] = resample_ctes("v_fit", ["language", "configuration", "experiment", "split"])
CTES["v_lang_resampled"] = resample_ctes("v_clean", ["language"])
CTES["v_experiments"] = """
SELECT * EXCLUDE (split, rk), split AS variant, 0::BIGINT AS copy FROM v_split
UNION ALL BY NAME
SELECT * EXCLUDE (split, kind), split || '_' || kind || 'sampling' AS variant FROM v_resampled
"""

# --- answers and line scores -----------------------------------------------------------------

_piece = (
    f"CASE WHEN contains(l, {TICK}) THEN {strip(f'string_split(l, {TICK})[2]')} "
    f"WHEN contains(l, ': ') THEN {strip('''substr(l, strpos(l, ': ') + 2)''')} END"
)
CTES["v_located"] = f"""
WITH p AS (
  SELECT language, configuration, experiment, model, row_id,
         list_filter(list_transform(string_split({strip("line_response")}, {NL}), lambda l: {_piece}), lambda x: x IS NOT NULL) AS pieces,
         list_transform(string_split(processed_func, {NL}), lambda s: {strip("s")}) AS src
  FROM v_results WHERE target = 1 AND prediction = 1 AND model NOT LIKE 'linevul%'
)
SELECT language, configuration, experiment, model, row_id,
  list_reduce(pieces, lambda taken, x: taken || coalesce((list_filter(range(0, len(src)), lambda i:
      NOT contains(taken, '|' || i || '|') AND (contains(src[i + 1], x) OR starts_with(x, src[i + 1]))))[1]::VARCHAR || '|', ''), '|') AS taken
FROM p
"""

CTES["v_totals"] = """
SELECT language, configuration, experiment, sum(num_lines)::BIGINT AS total_lines, sum(num_flaw_lines)::BIGINT AS total_flaw_lines
FROM v_results WHERE model = 'linevul_undersampling' GROUP BY ALL
"""

RUN = "language, configuration, experiment, model"


def overlap_sql():
    names = ", ".join(f"'{m}'" for m in config.OVERLAP_MODELS)
    return f"""
SELECT language, configuration, experiment, sha256(processed_func) AS func_key
FROM v_results WHERE target = 1 AND prediction = 1 AND model IN ({names})
GROUP BY ALL HAVING count(DISTINCT model) = {len(config.OVERLAP_MODELS)}
"""


CTES["v_overlap"] = overlap_sql()

CTES["v_facts"] = f"""
WITH hits AS (
  SELECT r.*, CASE WHEN r.model LIKE 'linevul%' THEN r.line_ranking
      ELSE list_transform(list_filter(string_split(l.taken, '|'), lambda x: x <> ''), lambda x: x::BIGINT) END AS said,
    list_transform(string_split(r.flaw_line_index, ','), lambda x: x::DOUBLE::BIGINT) AS truth
  FROM v_results r LEFT JOIN v_located l USING (language, configuration, experiment, model, row_id)
  WHERE r.target = 1 AND r.prediction = 1
)
SELECT {", ".join("h." + c.strip() for c in RUN.split(","))}, h.row_id, sha256(h.processed_func) AS func_key, said, truth, {loc("processed_func")} AS loc,
  list_filter(list_transform(range(1, len(said) + 1), lambda i: CASE WHEN list_contains(truth, said[i]) THEN i END), lambda i: i IS NOT NULL) AS hit_at,
  total_lines, total_flaw_lines,
  len(list_distinct(list_filter(said[1:(total_lines * 0.01::DOUBLE)::DOUBLE.floor()::INT], lambda x: list_contains(truth, x)))) AS n_in_cut
FROM hits h JOIN v_totals t USING (language, configuration, experiment)
""".replace("(total_lines * 0.01::DOUBLE)::DOUBLE.floor()::INT", "floor(total_lines * 0.01::DOUBLE)::INT")


def line_scores(facts, runs):
    return f"""
WITH steps AS (
  SELECT {RUN}, row_id, total_flaw_lines, i AS nr, list_contains(hit_at, i) AS hit
  FROM (SELECT *, unnest(range(1, len(said) + 1)) AS i FROM {facts})
), counted AS (
  SELECT *, coalesce(sum(hit::INT) OVER (PARTITION BY {RUN} ORDER BY row_id, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM steps
), effort AS (
  SELECT {RUN}, count(*) FILTER (before < floor(total_flaw_lines * 0.2::DOUBLE)) AS effort_lines FROM counted GROUP BY ALL
), means AS (
  SELECT {RUN}, count(*) AS n_true_positives,
    avg((coalesce(hit_at[1] <= 1, false))::INT) AS top_1_accuracy, avg((coalesce(hit_at[1] <= 3, false))::INT) AS top_3_accuracy,
    avg((coalesce(hit_at[1] <= 5, false))::INT) AS top_5_accuracy, avg((coalesce(hit_at[1] <= 10, false))::INT) AS top_10_accuracy,
    avg(coalesce(hit_at[1] - 1, CASE WHEN len(said) > 0 THEN len(said) ELSE loc END)) AS ifa, sum(n_in_cut) AS in_cut
  FROM {facts} GROUP BY ALL
)
SELECT {", ".join("r." + c.strip() for c in RUN.split(","))}, coalesce(n_true_positives, 0) AS n_true_positives,
  coalesce(top_1_accuracy, 0) AS top_1_accuracy, coalesce(top_3_accuracy, 0) AS top_3_accuracy,
  coalesce(top_5_accuracy, 0) AS top_5_accuracy, coalesce(top_10_accuracy, 0) AS top_10_accuracy, coalesce(ifa, 100) AS ifa,
  coalesce(effort_lines::DOUBLE / nullif(total_lines, 0), 0) AS effort_at_20_recall,
  coalesce(in_cut::DOUBLE / nullif(total_flaw_lines, 0), 0) AS recall_at_1_loc
FROM (SELECT DISTINCT {RUN} FROM {runs}) r
LEFT JOIN means USING ({RUN}) LEFT JOIN effort USING ({RUN}) LEFT JOIN v_totals USING (language, configuration, experiment)
"""


CTES["v_line_scores"] = line_scores("v_facts", "v_results")
CTES["v_facts_overlap"] = "SELECT * FROM v_facts SEMI JOIN v_overlap USING (language, configuration, experiment, func_key)"
CTES["v_line_scores_overlap"] = line_scores("v_facts_overlap", "v_results")

CTES["v_func_scores"] = f"""
WITH c AS (
  SELECT {RUN}, count(*) FILTER (target = 1 AND prediction = 1) AS tp, count(*) FILTER (target <> 1 AND prediction = 1) AS fp,
         count(*) FILTER (target = 1 AND prediction <> 1) AS fn, count(*) FILTER (target <> 1 AND prediction <> 1) AS tn
  FROM v_results GROUP BY ALL
)
SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy,
  coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc
FROM c
"""

CTES["v_answers"] = "SELECT * FROM v_results WHERE func_response IS NOT NULL"

CTES["v_turns"] = r"""
WITH c AS (
  SELECT conv_id, role, len(regexp_extract_all(role, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f\v]')) AS r,
         len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f\v]')) AS c
  FROM conversations
)
SELECT conv_id, count(*) AS n_messages, sum(r + c + 3)::BIGINT + 3 AS n_tokens,
       coalesce(sum(c) FILTER (role = 'assistant'), 0)::BIGINT AS n_assistant_tokens,
       bool_or(role = 'system') AS has_system, bool_or(role = 'user') AS has_user
FROM c GROUP BY conv_id
"""


def sql(body):
    """Put the views a query needs in front of it, in the order they were defined."""
    needed, queue = set(), [body]
    while queue:
        for name in set(re.findall(r"\bv_\w+", queue.pop())) & CTES.keys():
            if name not in needed:
                needed.add(name)
                queue.append(CTES[name])
    views = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in CTES if name in needed)
    if not views:
        return body
    return f"WITH {views},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {views}\n{body}"


EXP = "language, configuration, experiment"
r9 = lambda *names: ", ".join(f"round({n}, 9) AS {n}" for n in names)
FUNC = r9("precision", "recall", "f1", "accuracy", "mcc")
LINE = r9(
    "top_1_accuracy", "top_3_accuracy", "top_5_accuracy", "top_10_accuracy", "ifa", "effort_at_20_recall", "recall_at_1_loc"
)


def mean(*names):
    return ", ".join(f"round(avg({n}), 9) AS {n}" for n in names)


MEAN_FUNC = mean("precision", "recall", "f1", "accuracy", "mcc")
MEAN_LINE = mean(
    "top_1_accuracy", "top_3_accuracy", "top_5_accuracy", "top_10_accuracy", "ifa", "effort_at_20_recall", "recall_at_1_loc"
)
IDS = "array_to_string(list_sort(list(experiment)), ',')"
ANALYSIS = strip(f"string_split(substr({{x}}, strpos(lower({{x}}), 'analysis:') + 9), {NL})[1]")


def analysis(x):
    return ANALYSIS.replace("{x}", x)


COUNT_MOD = "len(list_filter(string_split(coalesce(mod_lines, ''), ','), lambda x: x <> ''))"
TEXT_SHA = "sha256(coalesce(processed_func, '')) AS text_sha"

# The seeded order of the rows of a frame.
SEEDS = f"(VALUES {ALL_SEEDS}) s(experiment, seed)"


def frame_key(variant, seed, copy):
    return key("'frame'", variant, seed, "experiment", "row_id", copy)


_FEW = f"""
SELECT *, row_number() OVER (PARTITION BY language, configuration, experiment ORDER BY target DESC, nr) AS example FROM (
  SELECT *, row_number() OVER (PARTITION BY language, configuration, experiment, target ORDER BY {frame_key("'train'", "seed", "0")}) AS nr
  FROM v_split JOIN {SEEDS} USING (experiment) WHERE split = 'train')
WHERE nr <= CASE WHEN target = 1 THEN 9 ELSE 1 END
"""

_DEMO = filled(config.DEMONSTRATION_TEXT, i="example", func_before="processed_func", analysis=verdict("target"))
_FEW_PROMPT = filled(
    config.FEW_SHOT_TEXT, language="t.language", code_demonstrations="coalesce(block, '')", new_source_code="processed_func"
)

_MSG = """
SELECT * FROM (WITH r AS (SELECT value::JSON AS j FROM v_chat_lines), o AS (SELECT j, json_type(j) = 'OBJECT' AS ok FROM r),
m AS (SELECT j, ok, CASE WHEN ok AND json_type(j->'messages') = 'ARRAY' THEN (j->'messages')::JSON[] ELSE [] END AS ms FROM o),
e AS (SELECT unnest(ms) AS msg FROM m WHERE ok),
c AS (SELECT json_keys(msg) AS k, coalesce(msg->>'role', '') AS role, json_type(msg->'content') AS ct, msg->>'content' AS content FROM e)
SELECT 'data_type' AS error, count(*) FILTER (NOT ok) AS n_errors FROM m
UNION ALL SELECT 'missing_messages_list', count(*) FILTER (ok AND len(ms) = 0) FROM m
UNION ALL SELECT 'message_missing_key', count(*) FILTER (NOT list_contains(k, 'role') OR NOT list_contains(k, 'content')) FROM c
UNION ALL SELECT 'message_unrecognized_key', count(*) FILTER (len(list_filter(k, lambda x: x NOT IN ('role', 'content', 'name'))) > 0) FROM c
UNION ALL SELECT 'unrecognized_role', count(*) FILTER (role NOT IN ('system', 'user', 'assistant')) FROM c
UNION ALL SELECT 'missing_content', count(*) FILTER (ct IS NULL OR ct <> 'VARCHAR' OR content = '') FROM c
UNION ALL SELECT 'example_missing_assistant_message', count(*) FILTER (ok AND len(ms) > 0
  AND NOT list_contains(list_transform(ms, lambda x: x->>'role'), 'assistant')) FROM m)
"""

_P = r"'[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f\v]'"
_tok = lambda x: f"len(regexp_extract_all({x}, {_P}))"
_PROMPT_LEN = f"length({filled(config.TASK_TEXT, language='language', new_source_code='processed_func')})"

_FEW_ASKED = f"""SELECT t.language, t.configuration, t.experiment, t.row_id, t.target, {_FEW_PROMPT} AS prompt
    FROM v_split t LEFT JOIN (SELECT {EXP}, string_agg({_DEMO} || {NL}, '' ORDER BY example) AS block FROM ({_FEW}) GROUP BY ALL) b
    USING ({EXP}) WHERE t.split = 'test'"""
_ASKED = f"SELECT *, {filled(config.TASK_TEXT, language='language', new_source_code='processed_func')} AS prompt"


def told(source, also=""):
    """What the stub says about the prompts of ``source``."""
    return f"""SELECT * EXCLUDE (prompt, n, label), CASE WHEN n % 11 = 0 THEN 'Limit token exceeded' ELSE '1. Analysis: ' || label END AS func_response,
        CASE WHEN n % 11 <> 0 AND n % 2 = 1 THEN 'Line number 0: ' || {TICK} || string_split(prompt, {NL})[1] || {TICK} ELSE '' END AS line_response,
        CASE WHEN n % 11 = 0 OR n % 2 = 1 THEN 1 ELSE 0 END AS prediction {also}
        FROM (SELECT *, CASE WHEN n % 2 = 1 THEN 'Vulnerable' ELSE 'Non-Vulnerable' END AS label FROM (SELECT *, length(prompt) AS n FROM ({source})))"""


_ERROR = ", CASE WHEN n % 11 = 0 THEN 'ValueError: too long' END AS error"

BODIES = {
    "scan_raw_parquet": f"SELECT doc_id AS row_id, source AS repo_url, {loc('text')}::INT AS n_lines FROM documents",
    "scan_raw_csv": "SELECT row_id, language, repo_url, code, label, before_change, added_only, mod_lines FROM v_raw",
    "write_clean": "SELECT row_id, language, processed_func, target, flaw_line_index, flaw_line FROM v_clean",
    "write_experiments": f"SELECT {EXP}, variant, row_id, target, {TEXT_SHA} FROM v_experiments",
    "scan_experiments": f"""SELECT {EXP}, variant, count(*) FILTER (target = 0) AS non_vulnerable, count(*) FILTER (target = 1) AS vulnerable
        FROM v_experiments GROUP BY ALL""",
    "write_chat_jsonl": 'SELECT system, "user", assistant FROM v_chats',
    "scan_chat_jsonl": """SELECT sha256(value) AS line_sha,
        CASE WHEN json_type(value, '$.messages') = 'ARRAY' THEN json_array_length(value, '$.messages')::INT END AS n_messages,
        json_extract_string(value, '$.messages[0].role') AS first_role FROM v_chat_lines""",
    "scan_chat_records": """SELECT CASE WHEN fine THEN
          CASE WHEN pick < 2 THEN 'system|' || sha256(system) || '|-;' ELSE '' END || 'user|' || sha256("user") || '|' || coalesce(uname, '-')
          || ';assistant|' || sha256(assistant) || '|' || coalesce(aname, '-') END AS messages,
        CASE WHEN NOT fine THEN sha256(line) END AS bad_line_sha FROM v_named""",
    "chat_report": f"""SELECT sha256("user") AS asked_sha, uname AS asked_by, CASE WHEN pick < 2 THEN 3 ELSE 2 END AS n_messages,
        CASE WHEN pick < 2 THEN {_tok("system")} + 3 + 1 ELSE 0 END + {_tok('"user"')} + {_tok("assistant")} + 6 + 2 + 3
          + coalesce({_tok("uname")} + 1, 0) + coalesce({_tok("aname")} + 1, 0) AS n_tokens,
        {_tok("assistant")} AS n_assistant_tokens, pick < 2 AS has_system, true AS has_user, true AS has_assistant
        FROM v_named WHERE fine""",
    "scan_experiment_tree": f"""SELECT {EXP}, variant, target, flaw_line_index, sha256(coalesce(flaw_line, '')) AS flaw_line_sha, {TEXT_SHA}
        FROM (SELECT * FROM v_experiments UNION ALL SELECT * REPLACE ('data_original' AS configuration, NULL AS flaw_line_index, NULL AS flaw_line) FROM v_experiments)
        WHERE experiment = 3""",
    "scan_result_tree": f"""SELECT {RUN}, row_id, target, prediction, flaw_line_index, num_lines, num_flaw_lines, array_to_string(line_ranking, ',') AS line_ranking,
        sha256(coalesce(func_response, '')) AS func_sha, sha256(coalesce(line_response, '')) AS line_sha FROM v_results""",
    "write_results": f"""SELECT {RUN}, row_id, target, prediction, {TEXT_SHA},
        CASE WHEN line_ranking IS NOT NULL THEN '[' || array_to_string(line_ranking, ',') || ']' END AS line_ranking FROM v_results""",
    "normalise_results": f"""SELECT {RUN}, row_id, target, prediction, flaw_line_index, func_response, line_response, num_lines,
        num_flaw_lines, array_to_string(line_ranking, ',') AS line_ranking FROM v_results""",
    "scan_results": f"SELECT {RUN}, tp, fp, fn, tn FROM v_func_scores",
    "run_name": """SELECT model, experiment, CASE WHEN model = 'gpt_few_shot' THEN 'gpt_few_shot_' || (experiment + 1)
        WHEN model LIKE '%fine_tune%' THEN 'gpt_fine_tuning' ELSE 'gpt_default' END AS run_name,
        CASE experiment % 3 WHEN 0 THEN '_no_balancing' WHEN 1 THEN '_undersampling' ELSE '_oversampling' END AS suffix
        FROM v_results GROUP BY model, experiment""",
    "preprocess": "SELECT row_id, language, processed_func, target, flaw_line_index, flaw_line FROM v_clean",
    "class_filter": "SELECT row_id, language, flaw_line_index FROM v_clean WHERE target = 1",
    "class_distribution": "SELECT language, target, count(*) AS n_rows FROM v_clean GROUP BY ALL",
    "split_distribution": f"""SELECT {EXP}, variant, count(*) FILTER (target = 0) AS non_vulnerable, count(*) FILTER (target = 1) AS vulnerable
        FROM v_experiments GROUP BY ALL""",
    "dataset_stats": f"""SELECT language, count(DISTINCT repo_url) AS n_projects, sum({loc("code")})::BIGINT AS n_lines,
        sum({COUNT_MOD})::BIGINT AS n_vul_lines, (sum({loc("code")}) - sum({COUNT_MOD}))::BIGINT AS n_non_vul_lines FROM v_raw GROUP BY ALL""",
    "merged_sketches": f"""SELECT count(*) AS n_records, sum({loc("code")})::BIGINT AS n_lines, sum({COUNT_MOD})::BIGINT AS n_vul_lines,
        true AS projects_near, true AS quantile_0_near, true AS quantile_1_near, true AS quantile_2_near FROM v_raw""",
    "loc_summary": f"""SELECT language, count(*) AS n_records, count(*) FILTER (label = 1) AS n_vul_records,
        count(*) FILTER (label <> 1) AS n_non_vul_records,
        sum(CASE WHEN mod_lines IS NULL THEN 0 ELSE len(string_split(mod_lines, ',')) END)::BIGINT AS n_vul_lines,
        round(avg({loc("code")}), 9) AS mean_loc FROM v_raw GROUP BY ALL""",
    "norm_lang": """SELECT doc_id, CASE lang WHEN 'es' THEN 'cpp' ELSE lang END AS language,
        upper(substr(lang, 1, 1)) || substr(lang, 2) || '_data.parquet' AS file_name FROM documents""",
    "flaw_lines": f"""SELECT row_id, CASE WHEN mod_lines IS NULL THEN '' ELSE array_to_string(list_transform(string_split(mod_lines, ','),
        lambda x: string_split(code, {NL})[x::INT + 1]), '/~/') END AS flaw_line FROM v_raw""",
    "parse_line_list": """SELECT row_id, coalesce(replace(mod_lines, ',', '|'), '') AS ids,
        CASE WHEN mod_lines IS NULL THEN 0 ELSE len(string_split(mod_lines, ','))::INT END AS n FROM v_raw""",
    "parse_ranking": f"""SELECT {RUN}, row_id, len(line_ranking)::INT AS n, line_ranking[1]::INT AS first_line
        FROM v_results WHERE model LIKE 'linevul%'""",
    "strip_comments": "SELECT row_id, language, processed_func FROM v_stripped",
    "strip_comments_stream": "SELECT row_id, language, processed_func FROM v_stripped",
    "noisy_lines": "SELECT row_id, array_to_string(ids, ',') AS noisy FROM v_noisy",
    "noisy_annotate": f"""SELECT row_id, array_to_string(list_transform({lines_of("processed_func")},
        lambda l, i: CASE WHEN list_contains(ids, i - 1) THEN '# ' || l ELSE l END), {NL}) AS annotated FROM v_noisy""",
    "blank_lines": f"""SELECT row_id, processed_func AS clean_code, array_to_string(list_filter(list_transform({lines_of("processed_func")},
        lambda l, i: CASE WHEN {strip("l")} = '' THEN i - 1 END), lambda x: x IS NOT NULL), ',') AS blank FROM v_stripped""",
    "strip_comments_nested": "SELECT row_id, language, clean AS processed_func FROM v_nested",
    "noisy_lines_nested": "SELECT row_id, array_to_string(ids, ',') AS noisy FROM v_nested_noisy",
    "noisy_annotate_nested": f"""SELECT row_id, array_to_string(list_transform({lines_of("dirty")},
        lambda l, i: CASE WHEN list_contains(ids, i - 1) THEN '# ' || l ELSE l END), {NL}) AS annotated FROM v_nested_noisy""",
    "blank_lines_nested": f"""SELECT row_id, clean AS clean_code, array_to_string(list_filter(list_transform({lines_of("clean")},
        lambda l, i: CASE WHEN {strip("l")} = '' THEN i - 1 END), lambda x: x IS NOT NULL), ',') AS blank FROM v_nested""",
    "stratified_split": "SELECT language, experiment, row_id, target, split FROM v_split",
    "plain_split": f"SELECT language, row_id, split, split <> 'test' AS big_train FROM ({split_ctes(['language'], '(0, 0)', None)})",
    "undersample": "SELECT language, row_id, target, processed_func FROM v_lang_resampled WHERE kind = 'under'",
    "oversample": f"SELECT language, row_id, target, copy, {TEXT_SHA} FROM v_lang_resampled WHERE kind = 'over'",
    "experiment_variants": f"SELECT {EXP}, variant, row_id, target, copy, {TEXT_SHA} FROM v_experiments WHERE experiment = 3",
    "experiments": f"SELECT {EXP}, variant, row_id, target, copy, {TEXT_SHA} FROM v_experiments",
    "frame_order": f"""SELECT {EXP}, variant, row_id, copy,
        {frame_key("variant", "CASE WHEN variant IN ('train', 'val', 'test') THEN seed ELSE 42 END", "copy")} AS order_key
        FROM v_experiments JOIN {SEEDS} USING (experiment)""",
    "shuffled": f"""SELECT language, row_id, {key("'order'", "42", "row_id")} AS shuffle_key,
        row_number() OVER (PARTITION BY language ORDER BY {key("'order'", "42", "row_id")}) AS position FROM v_clean""",
    "few_shot_examples": f"SELECT {EXP}, example::INT AS example, row_id, target, processed_func FROM ({_FEW})",
    "few_shot_prompts": f"""SELECT t.language, t.configuration, t.experiment, t.row_id, {_FEW_PROMPT} AS prompt
        FROM v_split t LEFT JOIN (SELECT {EXP}, string_agg({_DEMO} || {NL}, '' ORDER BY example) AS block FROM ({_FEW}) GROUP BY ALL) b
        USING ({EXP}) WHERE t.split = 'test'""",
    "zero_shot_prompts": f"SELECT row_id, {filled(config.TASK_TEXT, language='language', new_source_code='processed_func')} AS prompt FROM v_clean",
    "fine_tuning_chats": 'SELECT row_id, system, "user", assistant FROM v_chats',
    "chat_format_errors": _MSG,
    "chat_tokens": f"""SELECT 'record' AS origin, row_id, 3 AS n_messages, {_tok("system")} + {_tok('"user"')} + {_tok("assistant")} + 3 + 9 + 3 AS n_tokens,
        {_tok("assistant")} AS n_assistant_tokens FROM v_chats
        UNION ALL SELECT 'turns', conv_id, n_messages::INT, n_tokens, n_assistant_tokens FROM v_turns""",
    "chat_missing_roles": "SELECT count(*) FILTER (NOT has_system) AS n_missing_system, count(*) FILTER (NOT has_user) AS n_missing_user FROM v_turns",
    "chat_length_stats": """SELECT measure, min(v) AS min, max(v) AS max, round(avg(v), 9) AS mean, round(quantile_cont(v, 0.5), 9) AS median,
        round(quantile_cont(v, 0.1), 9) AS p10, round(quantile_cont(v, 0.9), 9) AS p90 FROM (
        SELECT 'num_messages_per_example' AS measure, n_messages::BIGINT AS v FROM v_turns
        UNION ALL SELECT 'num_total_tokens_per_example', n_tokens FROM v_turns
        UNION ALL SELECT 'num_assistant_tokens_per_example', n_assistant_tokens FROM v_turns) GROUP BY measure""",
    "fine_tune_cost": """SELECT *, n_epochs * n_billing_tokens AS n_charged_tokens FROM (
        SELECT count(*) AS n_examples, count(*) FILTER (n_tokens > 4096) AS n_too_long,
        sum(least(4096, n_tokens))::BIGINT AS n_billing_tokens,
        (CASE WHEN count(*) * 3 < 100 THEN least(25, 100 // count(*)) WHEN count(*) * 3 > 25000 THEN greatest(1, 25000 // count(*))
         ELSE 3 END)::INT AS n_epochs FROM v_turns)""",
    "chat_overview": 'SELECT language, count(*) AS n_examples, arg_min("user", row_id) AS first_user FROM v_chats GROUP BY language',
    "extract_analysis": f"SELECT {RUN}, row_id, {analysis('func_response')} AS analysis FROM v_answers",
    "response_label": f"""SELECT {RUN}, row_id, CASE WHEN contains({analysis(strip("lower(func_response)"))}, 'non-vulnerable')
        THEN 0 ELSE 1 END AS label FROM v_answers""",
    "line_question_gate": f"SELECT {RUN}, row_id, lower({analysis(strip('func_response'))}) = 'vulnerable' AS needs_line_level FROM v_answers",
    "locate_lines": f"SELECT {RUN}, row_id, rtrim(ltrim(replace(taken, '|', ','), ','), ',') AS lines FROM v_located",
    "batch_predict": f"""SELECT row_id,
        CASE WHEN n % 11 = 0 THEN 'Limit token exceeded' WHEN n % 2 = 1 THEN '1. Analysis: Vulnerable' ELSE '1. Analysis: Non-Vulnerable' END AS func_response,
        CASE WHEN n % 11 <> 0 AND n % 2 = 1 THEN 'Line number 0: ' || {TICK} || string_split(processed_func, {NL})[1] || {TICK} ELSE '' END AS line_response,
        CASE WHEN n % 11 = 0 OR n % 2 = 1 THEN 1 ELSE 0 END AS prediction, (CASE WHEN n % 11 = 0 THEN 0 ELSE n END)::INT AS n_prompt
        FROM (SELECT *, {_PROMPT_LEN} AS n FROM v_clean)""",
    "retried_predict": told(_ASKED.replace("*", "row_id") + " FROM v_clean", _ERROR),
    "resumed_run": told(f"SELECT *, 'base' AS model FROM ({_FEW_ASKED}) WHERE experiment = 3", _ERROR + ", 1 AS attempt"),
    "fine_tuned_run": told(_ASKED.replace("*", f"{EXP}, row_id, target, 'ft:1' AS model") + " FROM v_split WHERE experiment = 3 AND split = 'test'"),
    "attach_predictions": """SELECT c.language, r.experiment, r.model, c.row_id, c.target, r.prediction
        FROM v_clean c JOIN v_results r ON c.row_id = r.row_id""",
    "true_positives": f"SELECT DISTINCT {RUN}, sha256(processed_func) AS func_key FROM v_results WHERE target = 1 AND prediction = 1",
    "model_overlap": overlap_sql(),
    "overlap_semi_join": f"""WITH keyed AS MATERIALIZED (SELECT {RUN}, row_id, target, prediction, sha256(processed_func) AS func_key FROM v_results),
        hits AS (SELECT DISTINCT {RUN}, func_key FROM keyed WHERE target = 1 AND prediction = 1
          AND model IN ({", ".join(f"'{m}'" for m in config.OVERLAP_MODELS)})),
        shared AS (SELECT {EXP}, func_key FROM hits GROUP BY ALL HAVING count(*) = {len(config.OVERLAP_MODELS)})
        SELECT {RUN}, row_id, prediction FROM keyed JOIN shared USING ({EXP}, func_key)""",
    "include_experiments": f"""SELECT language, configuration, {IDS} AS skip_experiments,
        array_to_string(list_filter(range(10), lambda i: NOT list_contains(list(experiment), i)), ',') AS include_experiments
        FROM v_skips GROUP BY ALL""",
    "experiment_totals": f"SELECT {EXP}, total_lines, total_flaw_lines FROM v_totals",
    "func_metrics": f"SELECT {RUN}, tp, fp, fn, tn, {FUNC} FROM v_func_scores",
    "topk_accuracy": f"SELECT {RUN}, {r9('top_1_accuracy', 'top_3_accuracy', 'top_5_accuracy', 'top_10_accuracy')} FROM v_line_scores WHERE n_true_positives > 0",
    "ifa": f"SELECT {RUN}, {r9('ifa')} FROM v_line_scores WHERE n_true_positives > 0",
    # Formatting a double rounds its exact binary value, halves to even.
    "ifa_rounded": f"SELECT {RUN}, format('{{:.2f}}', ifa)::DOUBLE AS ifa FROM v_line_scores WHERE n_true_positives > 0",
    "effort_at_recall": f"SELECT {RUN}, {r9('effort_at_20_recall')} FROM v_line_scores WHERE n_true_positives > 0",
    "recall_at_loc": f"SELECT {RUN}, {r9('recall_at_1_loc')} FROM v_line_scores WHERE n_true_positives > 0",
    "line_metrics": f"SELECT {RUN}, n_true_positives, {LINE} FROM v_line_scores",
    "avg_func_metrics": f"""SELECT language, configuration, model, {IDS} AS include_experiments, {MEAN_FUNC},
        coalesce(array_to_string(list_sort(list(experiment) FILTER (f1 = 0)), ','), '') AS zero_f1_experiments
        FROM v_func_scores ANTI JOIN v_skips USING ({EXP}) GROUP BY ALL""".replace(" GROUP BY ALL", " GROUP BY language, configuration, model"),
    "avg_line_metrics": f"""SELECT language, configuration, model, {IDS} AS include_experiments, {MEAN_LINE}
        FROM v_line_scores_overlap ANTI JOIN v_skips USING ({EXP}) GROUP BY language, configuration, model""",
    "score_matrix": f"""SELECT * FROM (SELECT language, configuration, model, {IDS} AS func_experiments, {MEAN_FUNC},
        coalesce(array_to_string(list_sort(list(experiment) FILTER (f1 = 0)), ','), '') AS zero_f1_experiments
        FROM v_func_scores GROUP BY language, configuration, model) f LEFT JOIN
        (SELECT language, configuration, model, {IDS} AS line_experiments, {MEAN_LINE}
        FROM v_line_scores ANTI JOIN v_skips USING ({EXP}) GROUP BY language, configuration, model) l USING (language, configuration, model)""",
}

ORACLE = {name: sql(body) for name, body in BODIES.items()}
