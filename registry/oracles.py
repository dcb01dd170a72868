"""The registered queries as SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from counterfact import fixed
from counterfact.functions.text import SPACE_CLASS
from counterfact.operators.dictionary import TermDictionary
from counterfact.plans.grid import Grid
from registry.settings import (
    ALL_TERMS,
    ALPHA,
    BLOCK,
    CHECKPOINT_EVERY,
    FREQUENT,
    FULL,
    LOG_RUNS_EPOCH,
    ONE_CELL,
    P,
    RANKS,
    SEED,
    SMALL,
)

ORACLES: dict[str, str] = {}
A, B, POOLED = fixed.ENV_A, fixed.ENV_B, fixed.POOLED_ENV
WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SPACES = _text(fixed.WHITESPACE)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _raw(name: str, table: str, key: str, extra: str = "") -> str:
    return f"""{name} AS (
  SELECT {key}, CAST(i AS INTEGER) AS line_no, parts[i + 1] AS line {extra}
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM {table}) t, unnest(range(len(parts))) u(i))"""


def _clean(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT * REPLACE (trim(line, {SPACES}) AS line) FROM {source} WHERE trim(line, {SPACES}) <> '')"""


def _lines(name: str, table: str, key: str) -> str:
    return _raw(f"{name}_raw", table, key) + ",\n" + _clean(name, f"{name}_raw")


DOCS = _lines("docs", "documents", "doc_id")
TEST = _lines("test", "conversations", "concat_ws(':', conv_id, turn) AS doc_id")
VAL = _lines("val", "benchmark", "item_id AS doc_id")


def _hex(digest: str, part: int = 0) -> str:
    return f"(CAST('0x' || substr({digest}, {8 * part + 1}, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def _draw(*parts: object) -> str:
    return _hex(f"md5(concat_ws('|', {', '.join(str(p) for p in parts)}))")


def _map(dictionary: TermDictionary) -> str:
    pairs = ", ".join(f"{_text(k)}: {_text(v)}" for k, v in dictionary.opposites.items())
    return "MAP {" + pairs + "}"


def _in(dictionary: TermDictionary) -> str:
    return "(" + ", ".join(_text(t) for t in dictionary.terms) + ")"


def _swap(line: str, dictionary: TermDictionary) -> str:
    found = f"{_map(dictionary)}[lower(t)]"
    return f"""array_to_string(list_transform(string_split_regex({line}, {_text(SPACE_CLASS + '+')}), lambda t:
    CASE WHEN lower(t) NOT IN {_in(dictionary)} THEN t
         WHEN regexp_matches(substr(t, 1, 1), '^\\p{{Lu}}') THEN upper(substr({found}, 1, 1)) || substr({found}, 2)
         ELSE {found} END), ' ')"""


def _words(line: str) -> str:
    return f"regexp_extract_all(lower({line}), '{WORD}')"


def _env(name: str, dictionary: TermDictionary = FREQUENT) -> str:
    draw = _draw(SEED, "doc_id", "line_no")
    return f"""{name} AS (
  SELECT CASE WHEN {draw} < {P}::DOUBLE THEN '{A}' ELSE '{B}' END AS env, doc_id, line_no,
         CASE WHEN {draw} < {P}::DOUBLE THEN line ELSE {_swap('line', dictionary)} END AS line
  FROM docs)"""


ENV = _env("env_lines")


def _hits(source: str, dictionary: TermDictionary) -> str:
    return f"""hit_words AS (
  SELECT doc_id, line_no, line, {_words('line')} AS w FROM {source}),
hits AS (
  SELECT *, f[1] AS target, {_map(dictionary)}[f[1]] AS opposite, list_position(w, f[1]) AS tpos
  FROM (SELECT *, list_filter(w, lambda x: x IN {_in(dictionary)}) AS f FROM hit_words) WHERE len(f) = 1)"""


def _pairs(name: str, source: str, keys: str) -> str:
    return f"""{name} AS (
  SELECT {keys}, CAST(i AS INTEGER) - 1 AS pos, CASE WHEN i = 1 THEN '{fixed.LINE_START}' ELSE w[i - 1] END AS ctx, w[i] AS word
  FROM (SELECT *, {_words('line')} AS w FROM {source}) t, unnest(range(1, len(w) + 1)) u(i))"""


TEST_ITEMS = _hits("test", FREQUENT) + f""",
items AS (SELECT doc_id, line_no, target, opposite,
                 CASE WHEN tpos = 1 THEN '{fixed.LINE_START}' ELSE w[tpos - 1] END AS ctx FROM hits)"""

EVENTS = f"""log AS (
  SELECT user_id AS run, CAST(event_id // {LOG_RUNS_EPOCH} AS BIGINT) AS epoch, CAST(event_id // 5 AS BIGINT) AS round,
         event_id AS step, event_type AS env, ln(1 + value) AS loss FROM events)"""


def _grid_model(which: Grid) -> str:
    """Counts of every cell, by assigning every line in every cell."""
    cells = ", ".join(f"({s}, {p}::DOUBLE)" for s, p in which.cells)
    alphas = ", ".join(f"({a}::DOUBLE)" for a in which.alphas)
    draws = "CASE seed " + " ".join(f"WHEN {s} THEN {_draw(s, 'doc_id', 'line_no')}" for s in which.seeds) + " END"
    return f"""cells(seed, p) AS (VALUES {cells}), alphas(alpha) AS (VALUES {alphas}),
swapped AS (SELECT doc_id, line_no, line, {_swap('line', FREQUENT)} AS other FROM docs),
cell_lines AS (
  SELECT seed, p, CASE WHEN {draws} < p THEN '{A}' ELSE '{B}' END AS env, CASE WHEN {draws} < p THEN line ELSE other END AS line
  FROM swapped CROSS JOIN cells),
{_pairs('cell_pairs', 'cell_lines', 'seed, p, env')},
cnt AS MATERIALIZED (SELECT seed, p, env, ctx, word, count(*) AS n FROM cell_pairs GROUP BY ALL),
tot AS (SELECT seed, p, env, ctx, sum(n) AS n_ctx FROM cnt GROUP BY ALL),
vocab AS (SELECT seed, p, count(DISTINCT word) FILTER (word NOT IN {_in(FREQUENT)}) + {len(FREQUENT) + 1} AS v FROM cnt GROUP BY ALL)"""


def _lang_model() -> str:
    """Counts with the language of a document as environment, in a single cell."""
    return f"""cells(seed, p) AS (VALUES (0, 0.0::DOUBLE)), alphas(alpha) AS (VALUES ({ALPHA}::DOUBLE)),
cell_lines AS (SELECT 0 AS seed, 0.0::DOUBLE AS p, lang AS env, line FROM docs JOIN documents USING (doc_id) WHERE lang IS NOT NULL),
{_pairs('cell_pairs', 'cell_lines', 'seed, p, env')},
cnt AS (SELECT seed, p, env, ctx, word, count(*) AS n FROM cell_pairs GROUP BY ALL),
tot AS (SELECT seed, p, env, ctx, sum(n) AS n_ctx FROM cnt GROUP BY ALL),
vocab AS (SELECT seed, p, count(DISTINCT word) FILTER (word NOT IN {_in(FREQUENT)}) + {len(FREQUENT) + 1} AS v FROM cnt GROUP BY ALL)"""


def _scored(requests: str, envs: str = f"VALUES ('{A}'), ('{B}')") -> str:
    """Probability of every requested (ctx, word), by logits and an explicit normaliser."""
    return f"""envs(env) AS ({envs}),
req AS (SELECT DISTINCT ctx, word FROM {requests}),
rctx AS (SELECT DISTINCT ctx FROM req),
seen AS (SELECT DISTINCT seed, p, ctx, word FROM cnt WHERE ctx IN (SELECT ctx FROM rctx)),
wanted AS (SELECT seed, p, ctx, word FROM seen UNION SELECT seed, p, ctx, word FROM cells CROSS JOIN req),
logits AS MATERIALIZED (
  SELECT w.seed, w.p, a.alpha, w.ctx, w.word,
         avg(ln(coalesce(c.n, 0) + a.alpha) - ln(coalesce(t.n_ctx, 0) + a.alpha * v.v)) AS logit,
         ln(coalesce(sum(c.n), 0) + a.alpha) - ln(coalesce(sum(t.n_ctx), 0) + a.alpha * any_value(v.v)) AS pooled,
         avg(ln(a.alpha) - ln(coalesce(t.n_ctx, 0) + a.alpha * v.v)) AS unseen,
         any_value(v.v) AS v, coalesce(sum(c.n), 0) > 0 AS is_seen
  FROM wanted w CROSS JOIN envs e CROSS JOIN alphas a
  JOIN vocab v ON v.seed = w.seed AND v.p = w.p
  LEFT JOIN cnt c ON c.seed = w.seed AND c.p = w.p AND c.env = e.env AND c.ctx = w.ctx AND c.word = w.word
  LEFT JOIN tot t ON t.seed = w.seed AND t.p = w.p AND t.env = e.env AND t.ctx = w.ctx
  GROUP BY w.seed, w.p, a.alpha, w.ctx, w.word),
z AS (
  SELECT seed, p, alpha, ctx,
         coalesce(sum(exp(logit)) FILTER (is_seen), 0) + (any_value(v) - count(*) FILTER (is_seen)) * exp(any_value(unseen)) AS z
  FROM logits GROUP BY ALL),
probs AS (
  SELECT seed, p, alpha, 'iLM' AS method, ctx, word, exp(logit) / z AS prob FROM logits JOIN z USING (seed, p, alpha, ctx)
  UNION ALL SELECT seed, p, alpha, 'eLM', ctx, word, exp(pooled) FROM logits)"""


_H = "CASE WHEN q IN (0, 1) THEN 0 ELSE -(q * log2(q) + (1 - q) * log2(1 - q)) END"


_BIASES = f"""ratios AS MATERIALIZED (
  SELECT i.*, t.seed, t.p, t.alpha, t.method, t.prob / (t.prob + o.prob) AS q
  FROM (SELECT DISTINCT ctx, target, opposite FROM items) i JOIN probs t ON t.ctx = i.ctx AND t.word = i.target
  JOIN probs o ON o.ctx = i.ctx AND o.word = i.opposite AND o.seed = t.seed AND o.p = t.p AND o.alpha = t.alpha AND o.method = t.method
  WHERE t.prob + o.prob >= 1e-8),
scores AS (SELECT *, 1 - {_H} AS bias FROM items JOIN ratios USING (ctx, target, opposite))"""


def _line_bias(which: Grid) -> str:
    return _with(DOCS, TEST, _grid_model(which), TEST_ITEMS, _scored(
        "(SELECT ctx, target AS word FROM items UNION ALL SELECT ctx, opposite FROM items)"
    ), _BIASES)


def _summary(which: Grid, rate: str = "alpha") -> str:
    return _line_bias(which) + f"""SELECT p AS p_env_a, alpha AS {rate}, method, count(*) AS n_scored,
  round(avg(bias), 6) AS mean_bias, round(stddev_samp(bias), 6) AS std_bias FROM scores GROUP BY ALL"""


ORACLES["bias_cell"] = _summary(ONE_CELL)
ORACLES["bias_grid"] = _summary(FULL)

# --- scans, sources, sinks ------------------------------------------------------------------------

ORACLES["lines_scan"] = _with(_raw("docs", "documents", "doc_id")) + "SELECT * FROM docs"
ORACLES["env_folder_scan"] = _with(DOCS, ENV) + "SELECT env, line FROM env_lines"
ORACLES["single_file_env"] = _with(DOCS, ENV) + f"SELECT '{POOLED}' AS env, line FROM env_lines"
ORACLES["nonempty_eval_scan"] = _with(VAL, TEST) + """
SELECT 'val_ind' AS split, count(*) AS n_lines, 'read' AS status FROM val
UNION ALL SELECT 'test', count(*), 'read' FROM test
UNION ALL SELECT 'val_ood', 0, 'empty' UNION ALL SELECT 'val_extra', 0, 'missing'"""
ORACLES["eval_split_select"] = _with(VAL) + """
SELECT 'val_ind' AS split, CAST(doc_id AS VARCHAR) AS doc_id, line_no, line FROM val"""
ORACLES["test_lines_scan"] = _with(
    _raw("turns", "conversations", "conv_id, turn"), _clean("clean", "turns")
) + "SELECT * FROM clean"
_RUNS = "seed, p AS p_env_a, alpha AS lr, method"
ORACLES["scores_scan"] = _line_bias(SMALL) + f"""
SELECT {_RUNS}, count(*) AS n_scored, round(avg(bias), 6) AS mean_bias FROM scores GROUP BY ALL"""
ORACLES["union_scores"] = _line_bias(SMALL) + f"SELECT {_RUNS}, round(bias, 6) AS bias FROM scores"
ORACLES["text_column_pick"] = """
SELECT 'content' AS picked, text FROM documents UNION ALL SELECT 'first', text FROM benchmark"""
_SPLIT_ROWS = "\nUNION ALL ".join(
    f"""SELECT {s} AS seed, {p}::DOUBLE AS p_env_a, CASE WHEN {_draw(s, 'doc_id', 'line_no')} < {p}::DOUBLE THEN '{A}' ELSE '{B}' END AS env,
  CASE WHEN {_draw(s, 'doc_id', 'line_no')} < {p}::DOUBLE THEN line ELSE other END AS line FROM two_forms"""
    for s, p in FULL.cells
)
ORACLES["write_splits"] = _with(
    DOCS, f"two_forms AS MATERIALIZED (SELECT doc_id, line_no, line, {_swap('line', FREQUENT)} AS other FROM docs)"
) + f"""SELECT seed, p_env_a, env, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars
FROM ({_SPLIT_ROWS}) GROUP BY ALL"""
_CELL_ROWS = "\nUNION ALL ".join(
    f"""SELECT {s} AS seed, {p}::DOUBLE AS p_env_a, CASE WHEN {_draw(s, 'doc_id', 'line_no')} < {p}::DOUBLE THEN '{A}' ELSE '{B}' END AS env,
  CASE WHEN {_draw(s, 'doc_id', 'line_no')} < {p}::DOUBLE THEN line ELSE other END AS line FROM two_forms"""
    for s, p in SMALL.cells
)
_SMALL_CELLS = "(VALUES " + ", ".join(f"({s}, {p}::DOUBLE)" for s, p in SMALL.cells) + ") c(seed, p_env_a)"
ORACLES["export_splits"] = _with(
    DOCS, VAL, TEST,
    f"two_forms AS MATERIALIZED (SELECT doc_id, line_no, line, {_swap('line', FREQUENT)} AS other FROM docs)",
    f"cell_rows AS ({_CELL_ROWS})",
) + f"""SELECT seed, p_env_a, file, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM (
  SELECT seed, p_env_a, env AS file, line FROM cell_rows UNION ALL SELECT seed, p_env_a, '{POOLED}', line FROM cell_rows
  UNION ALL SELECT seed, p_env_a, 'val_ind', line FROM val CROSS JOIN {_SMALL_CELLS}
  UNION ALL SELECT seed, p_env_a, 'test', line FROM test CROSS JOIN {_SMALL_CELLS}) GROUP BY ALL"""
ORACLES["write_scores"] = _line_bias(SMALL) + """
SELECT seed, p AS p_env_a, alpha, method, doc_id, line_no, round(bias, 6) AS bias FROM scores"""
_RUNNING = "avg(loss) OVER (PARTITION BY run, epoch ORDER BY step ROWS UNBOUNDED PRECEDING)"
ORACLES["write_training_log"] = _with(EVENTS) + f"""
SELECT run, epoch + 1 AS epoch, step AS global_step, round(train_loss, 4) AS train_loss, round(loss, 4) AS val_loss,
  round(exp(loss), 4) AS perplexity
FROM (SELECT *, {_RUNNING} AS train_loss FROM log) WHERE step % {fixed.LOG_INTERVAL} = 0"""
ORACLES["write_round_log"] = _with(EVENTS) + """
SELECT CAST(0 AS BIGINT) AS run, r.epoch + 1 AS epoch, r.last + 1 AS global_step, round(r.m, 4) AS train_loss, round(loss, 4) AS val_loss,
  round(exp(loss), 4) AS perplexity
FROM (SELECT epoch, round, max(step) AS last, avg(loss) AS m FROM log GROUP BY ALL) r JOIN log ON step = last WHERE (last + 1) % 10 = 0"""
ORACLES["write_loss_history"] = _with(EVENTS) + "SELECT epoch + 1 AS \"Epoch\", " + ", ".join(
    f"round(avg(loss) FILTER (env = '{e}'), 6) AS {e}" for e in ("click", "error", "purchase", "signup", "view")
) + " FROM log GROUP BY epoch"
ORACLES["write_eval_results"] = _with(EVENTS, """
result AS (SELECT avg(m) AS l FROM (SELECT epoch, avg(loss) AS m FROM log GROUP BY epoch))""") + """
SELECT 'eval_loss' AS key, round(l, 6) AS value FROM result
UNION ALL SELECT 'perplexity', round(CASE WHEN l < 100 THEN exp(l) ELSE 'inf'::DOUBLE END, 6) FROM result"""

# --- projections, filters, scalar functions -------------------------------------------------------

ORACLES["clean_lines"] = _with(DOCS) + "SELECT * FROM docs"
_TOKENS = f"tokens AS (SELECT unnest({_words('line')}) AS token FROM docs)"
_ALL_PAIRS = "pairs(term, opposite) AS (VALUES " + ", ".join(
    f"({_text(k)}, {_text(v)})" for k, v in ALL_TERMS.opposites.items()
) + ")"
ORACLES["pair_dictionary"] = _with(DOCS, _TOKENS, _ALL_PAIRS) + """
SELECT term, opposite, count(token) AS n FROM pairs LEFT JOIN tokens ON token = term GROUP BY ALL"""
ORACLES["swap_terms"] = _with(DOCS) + f"SELECT doc_id, line_no, {_swap('line', ALL_TERMS)} AS line FROM docs"
ORACLES["swap_rate"] = _with(DOCS, _ALL_PAIRS, f"""
blank AS (SELECT lower(unnest(string_split_regex(line, {_text(SPACE_CLASS + '+')}))) AS term FROM docs
  WHERE {_draw(SEED, 'doc_id', 'line_no')} >= {P}::DOUBLE)""") + f"""
SELECT '{B}' AS env, term, opposite, count(*) AS n FROM blank JOIN pairs USING (term) GROUP BY ALL"""
ORACLES["env_assign"] = _with(DOCS, _env("assigned", ALL_TERMS)) + "SELECT env, doc_id, line_no, line FROM assigned"
ORACLES["word_extract"] = _with(DOCS) + f"""
SELECT doc_id, line_no, array_to_string({_words('line')}, ' ') AS words FROM docs"""
_DOC_HITS = _with(DOCS, _hits("docs", ALL_TERMS))
ORACLES["single_hit_filter"] = _DOC_HITS + "SELECT doc_id, line_no, target, opposite FROM hits"
_MASKED = f"regexp_replace(line, '(?i)(^|{NOT_WORD})' || target || '($|{NOT_WORD})', '\\1{fixed.MASK}\\2', 'g')"
ORACLES["mask_target"] = _DOC_HITS + f"SELECT doc_id, line_no, {_MASKED} AS masked FROM hits"
ORACLES["first_mask_pos"] = _DOC_HITS + "SELECT doc_id, line_no, CAST(tpos AS BIGINT) AS mask_pos FROM hits"
_SHARES = _with(DOCS, _hits("docs", ALL_TERMS), _TOKENS, """
shares AS (SELECT token, count(*) / (SELECT count(*) FROM tokens)::DOUBLE AS share FROM tokens GROUP BY token)""", """
ratios AS (
  SELECT doc_id, line_no, target, coalesce(t.share, 0) AS p1, coalesce(o.share, 0) AS p2, p1 / (p1 + p2) AS q
  FROM hits LEFT JOIN shares t ON t.token = target LEFT JOIN shares o ON o.token = opposite
  WHERE coalesce(t.share, 0) + coalesce(o.share, 0) >= 1e-8)""")
ORACLES["pair_probability"] = _SHARES + "SELECT doc_id, line_no, target, round(q, 6) AS p FROM ratios"
ORACLES["entropy_bias"] = _SHARES + f"SELECT doc_id, line_no, target, round(1 - {_H}, 6) AS bias FROM ratios"

_SIZES = _with(DOCS, "sizes AS (" + "\nUNION ALL ".join(
    f"""SELECT {s} AS seed, '{p}' AS p_text, {p}::DOUBLE AS p_env_a, count(*) FILTER (u < {p}::DOUBLE) AS n_a, count(*) FILTER (u >= {p}::DOUBLE) AS n_b
  FROM (SELECT {_draw(s, 'doc_id', 'line_no')} AS u FROM docs)""" for s, p in FULL.cells) + ")",
    "alphas(alpha_text, alpha) AS (VALUES " + ", ".join(f"('{a}', {a}::DOUBLE)" for a in FULL.alphas) + ")",
    "methods(method) AS (VALUES " + ", ".join(f"('{m}')" for m in FULL.methods) + ")",
)
_GRID_ROWS = "FROM sizes CROSS JOIN alphas CROSS JOIN methods"
ORACLES["run_tag"] = _SIZES + f"""
SELECT 'split' || seed || '_p' || replace(p_text, '.', '') AS split_tag,
  'split' || seed || '_p' || replace(p_text, '.', '') || '_lr' || replace(alpha_text, '.', '') || '_' || method || '.csv' AS score_file,
  n_a, n_b {_GRID_ROWS}"""
ORACLES["experiment_grid"] = _SIZES + f"SELECT seed, p_env_a, alpha, method, n_a, n_b {_GRID_ROWS}"
_RE_RATE = r"^split(\d+)_p(\d+)_lr(\d+)[eE]?(-?\d*)_(eLM|iLM)\.csv"
_RE_PLAIN = r"^split(\d+)_p(\d+)_(eLM|iLM)\.csv"
_DOT = "CASE WHEN length({0}) > 1 THEN substr({0}, 1, 1) || '.' || substr({0}, 2) ELSE {0} END"
ORACLES["parse_run_tag"] = f"""WITH named AS (
  SELECT 'split' || l_linenumber || '_p' || replace(CAST(l_discount AS VARCHAR), '.', '') ||
    CASE WHEN l_linestatus = 'O' THEN '' ELSE '_lr' || replace(CASE WHEN l_tax = 0 THEN '1e-05' WHEN l_tax = 0.01 THEN '1.5e-05'
      ELSE CAST(l_tax AS VARCHAR) END, '.', '') END ||
    CASE l_returnflag WHEN 'A' THEN '_eLM' WHEN 'R' THEN '_iLM' ELSE '_none' END || '.csv' AS name FROM lineitem),
names AS (SELECT name, count(*) AS n, regexp_matches(name, '{_RE_RATE}') AS rated FROM named GROUP BY ALL),
parts AS (
  SELECT name, n, rated,
    CASE WHEN rated THEN regexp_extract(name, '{_RE_RATE}', 1) ELSE regexp_extract(name, '{_RE_PLAIN}', 1) END AS s,
    CASE WHEN rated THEN regexp_extract(name, '{_RE_RATE}', 2) ELSE regexp_extract(name, '{_RE_PLAIN}', 2) END AS pd,
    regexp_extract(name, '{_RE_RATE}', 3) AS base, regexp_extract(name, '{_RE_RATE}', 4) AS ex,
    CASE WHEN rated THEN regexp_extract(name, '{_RE_RATE}', 5) ELSE regexp_extract(name, '{_RE_PLAIN}', 3) END AS method
  FROM names WHERE rated OR regexp_matches(name, '{_RE_PLAIN}'))
SELECT name, n, CAST(s AS INTEGER) AS seed, CAST({_DOT.format('pd')} AS DOUBLE) AS p_env_a,
  CASE WHEN NOT rated THEN 1e-5::DOUBLE ELSE CAST({_DOT.format('base')} || CASE WHEN ex = '' THEN '' ELSE 'e' || ex END AS DOUBLE) END AS lr,
  method, CAST('0.' || pd AS DOUBLE) AS compat_p,
  CASE WHEN NOT rated THEN 1e-5::DOUBLE ELSE CAST(base || CASE WHEN ex = '' THEN '' ELSE 'e' || ex END AS DOUBLE) END AS compat_lr
FROM parts"""
ORACLES["perplexity"] = _with(EVENTS) + "SELECT step, round(exp(loss), 6) AS perplexity, loss * 20 >= 100 AS guarded FROM log"
ORACLES["round4"] = _with(EVENTS) + "SELECT step, round(loss, 4) AS rounded, printf('%.4f', loss) AS shown FROM log"
ORACLES["seq_len_cap"] = """
SELECT doc_id, CAST(CASE WHEN lang = 'en' THEN least(n_chars, 1000000) WHEN lang = 'fr' THEN 512 ELSE 1024 END AS BIGINT) AS block_length
FROM documents"""
_ENV_SIZES = _with(DOCS, ENV, "sizes AS (SELECT env, count(*) AS n FROM env_lines GROUP BY env)")
ORACLES["run_config_check"] = _ENV_SIZES + "SELECT env, n FROM sizes"

# --- joins ----------------------------------------------------------------------------------------

ORACLES["dict_lookup"] = _with(DOCS, _TOKENS, _ALL_PAIRS) + """
SELECT token, opposite, count(*) AS n FROM tokens LEFT JOIN pairs ON term = token GROUP BY ALL"""
_CELL = _with(DOCS, TEST, _grid_model(ONE_CELL), TEST_ITEMS)
ORACLES["candidate_scores"] = _CELL + f""",
wanted AS (
  SELECT DISTINCT env, ctx, target, opposite, word FROM (VALUES ('{A}'), ('{B}')) e(env),
    (SELECT ctx, target, opposite, target AS word FROM items UNION ALL SELECT ctx, target, opposite, opposite FROM items))
SELECT env, ctx, target, opposite, word, coalesce(cnt.n, 0) AS n, CAST(coalesce(tot.n_ctx, 0) AS BIGINT) AS n_ctx,
  round(ln(coalesce(cnt.n, 0) + {ALPHA}::DOUBLE) - ln(coalesce(tot.n_ctx, 0) + {ALPHA}::DOUBLE * (SELECT v FROM vocab)), 6) AS logit
FROM wanted LEFT JOIN cnt USING (env, ctx, word) LEFT JOIN tot USING (env, ctx)"""
_KEYS = _with(EVENTS, """
grid AS (SELECT run, epoch, env FROM (SELECT DISTINCT run, epoch FROM log) CROSS JOIN (SELECT DISTINCT env FROM log))""")
ORACLES["missing_cells"] = _KEYS + "SELECT * FROM grid EXCEPT SELECT run, epoch, env FROM log"

_DONE = _line_bias(SMALL) + "SELECT DISTINCT seed, p AS p_env_a, alpha AS lr, method FROM scores"
ORACLES["pending_runs"] = f"""SELECT seed, p_env_a, lr, method, n_a
FROM (SELECT seed, p_env_a, alpha AS lr, method, n_a FROM ({ORACLES['experiment_grid']})) ANTI JOIN ({_DONE}) USING (seed, p_env_a, lr, method)"""

# --- aggregations and estimators ------------------------------------------------------------------

ORACLES["bias_summary"] = _summary(SMALL, "lr")
ORACLES["ordered_summary"] = _summary(SMALL, "lr") + " ORDER BY p_env_a, lr, method"
ORACLES["plot_series"] = _line_bias(SMALL) + """
SELECT lr, method, string_agg(CAST(p AS VARCHAR) || ':' || printf('%.4f', m) || ':' || printf('%.4f', s), ' ' ORDER BY p) AS series
FROM (SELECT alpha AS lr, method, p, avg(bias) AS m, stddev_samp(bias) AS s FROM scores GROUP BY ALL) GROUP BY ALL"""
ORACLES["scored_count"] = _line_bias(SMALL) + """
SELECT seed, p AS p_env_a, alpha, method, count(*) AS n_scored FROM scores GROUP BY ALL"""
ORACLES["env_sizes"] = _ENV_SIZES + "SELECT env, n FROM sizes"
ORACLES["size_summary"] = _ENV_SIZES + """
SELECT min(n) AS min_size, count(*) AS n_env, CAST(sum(n) AS BIGINT) AS n_examples FROM sizes"""
_STEPS = fixed.STEPS_PER_RUN
_PER_ROUND = fixed.BATCH_SIZE * fixed.ACCUMULATION
_PLAN = _ENV_SIZES.rstrip() + f""",
ilm AS (SELECT CAST(min(n) // {_PER_ROUND} AS BIGINT) AS rounds, CAST(min(n) // {_PER_ROUND} * count(*) AS BIGINT) AS spe, count(*) AS n_env FROM sizes),
elm AS (SELECT CAST(ceil(sum(n) / {fixed.BATCH_SIZE}) AS BIGINT) AS rounds, CAST(ceil(sum(n) / {fixed.BATCH_SIZE}) AS BIGINT) // {fixed.ACCUMULATION} AS spe FROM sizes)"""
ORACLES["round_plan"] = _PLAN + "\nUNION ALL ".join(
    f"""
SELECT '{m}' AS method, rounds, spe AS steps_per_epoch, CAST(greatest(1, ceil({_STEPS} / spe)) AS BIGINT) AS epochs, CAST({_STEPS} AS BIGINT) AS max_steps FROM {t}"""
    for m, t in (("iLM", "ilm"), ("eLM", "elm"))
)
ORACLES["examples_seen"] = _PLAN + f"""
SELECT spe * 3 AS max_steps, spe * 3 * {_PER_ROUND} AS examples_seen FROM ilm"""
ORACLES["epoch_env_loss"] = _with(EVENTS) + """
SELECT e AS epoch, env, round(avg(loss), 6) AS avg_loss, count(loss) AS n_updates
FROM (SELECT DISTINCT CAST(step // 10 AS BIGINT) AS e FROM log) CROSS JOIN (SELECT DISTINCT env FROM log)
LEFT JOIN (SELECT step // 10 AS e, env, loss FROM log) USING (e, env) GROUP BY ALL"""
ORACLES["round_loss"] = _with(EVENTS) + """
SELECT epoch, round, round(coalesce(avg(loss) FILTER (env = 'view'), 0), 6) AS avg_loss FROM log GROUP BY ALL"""
ORACLES["batch_mean_loss"] = _with(EVENTS) + """
SELECT round(avg(m), 6) AS eval_loss, round((SELECT avg(loss) FROM log), 6) AS token_loss, count(*) AS n_batches
FROM (SELECT run, avg(loss) AS m FROM log GROUP BY run)"""
_EVAL = _with(DOCS, VAL, _grid_model(ONE_CELL), f"""
numbered AS (SELECT *, (row_number() OVER (ORDER BY doc_id, line_no) - 1) // {fixed.EVAL_BATCH_SIZE} AS batch FROM val)""",
    _pairs("all_positions", "numbered", "batch, doc_id, line_no"),
    f"positions AS (SELECT * FROM all_positions WHERE {_draw(SEED, 'doc_id', 'line_no', 'pos')} < {fixed.MASK_SHARE}::DOUBLE)",
    _scored("positions"),
    "losses AS (SELECT batch, method, -ln(prob) AS loss FROM positions JOIN probs USING (ctx, word))",
)
ORACLES["masked_cross_entropy"] = _EVAL + """
SELECT method, count(*) AS n_positions, round(avg(loss), 6) AS loss FROM losses GROUP BY method"""
ORACLES["model_eval"] = _EVAL + """
SELECT method, round(avg(m), 6) AS eval_loss, round(sum(s) / sum(c), 6) AS token_loss, count(*) AS n_batches, round(exp(avg(m)), 3) AS perplexity
FROM (SELECT method, batch, avg(loss) AS m, sum(loss) AS s, count(*) AS c FROM losses GROUP BY ALL) GROUP BY method"""
_RUN_LOSS = f"SELECT run, epoch, step, round({_RUNNING}, 6) AS running_loss FROM log"
ORACLES["running_epoch_loss"] = _with(EVENTS) + _RUN_LOSS
ORACLES["loss_by_step_interval"] = _with(EVENTS) + f"SELECT * FROM ({_RUN_LOSS}) WHERE step % {fixed.LOG_INTERVAL} = 0"
ORACLES["best_checkpoint"] = _with(EVENTS, """
better AS (SELECT * FROM (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
  FROM log) WHERE earlier IS NULL OR loss < earlier)""") + """
SELECT run, step, round(loss, 6) AS loss, step = max(step) OVER (PARTITION BY run) AS is_best FROM better"""
_SPECIAL = ", ".join(f"({_text(t)}, 0, {i})" for i, t in enumerate(fixed.SPECIAL_TOKENS))
_N_SPECIAL = len(fixed.SPECIAL_TOKENS)
ORACLES["build_vocab"] = _with(DOCS, _TOKENS) + f"""
SELECT token, CAST(n AS BIGINT) AS n, CAST(id AS BIGINT) AS token_id FROM (VALUES {_SPECIAL}) s(token, n, id)
UNION ALL SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + {_N_SPECIAL - 1}
FROM (SELECT token, count(*) AS n FROM tokens GROUP BY token)"""
_ENCODED = f"""ids AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) + {_N_SPECIAL - 1} AS id
  FROM (SELECT unnest({_words('line')}) AS token, count(*) AS n FROM env_lines GROUP BY token)),
env_words AS (
  SELECT env, doc_id, line_no, i, w[i] AS token
  FROM (SELECT *, {_words('line')} AS w FROM env_lines) t, unnest(range(1, len(w) + 1)) u(i)),
encoded AS (
  SELECT l.env, l.doc_id, l.line_no,
    list_concat([2], coalesce(list(coalesce(id, 1) ORDER BY i) FILTER (i IS NOT NULL), []), [3]) AS ids
  FROM env_lines l LEFT JOIN env_words USING (env, doc_id, line_no) LEFT JOIN ids USING (token) GROUP BY ALL)"""
ORACLES["encode_tokens"] = _with(DOCS, ENV, _ENCODED) + """
SELECT env, doc_id, line_no, array_to_string(ids, ' ') AS ids FROM encoded"""
_ENV_PAIRS = _with(DOCS, ENV, _pairs("pairs", "env_lines", "env"))
ORACLES["fit_pooled"] = _ENV_PAIRS + "SELECT ctx, word, count(*) AS n FROM pairs GROUP BY ALL"
ORACLES["fit_per_env"] = _ENV_PAIRS + "SELECT env, ctx, word, count(*) AS n FROM pairs GROUP BY ALL"
ORACLES["env_head_score"] = _CELL + f""",
one AS (
  SELECT DISTINCT i.ctx, target, opposite,
    (coalesce(t.n, 0) + {ALPHA}::DOUBLE) / (coalesce(tot.n_ctx, 0) + {ALPHA}::DOUBLE * (SELECT v FROM vocab)) AS p1,
    (coalesce(o.n, 0) + {ALPHA}::DOUBLE) / (coalesce(tot.n_ctx, 0) + {ALPHA}::DOUBLE * (SELECT v FROM vocab)) AS p2
  FROM items i LEFT JOIN cnt t ON t.env = '{A}' AND t.ctx = i.ctx AND t.word = target
  LEFT JOIN cnt o ON o.env = '{A}' AND o.ctx = i.ctx AND o.word = opposite
  LEFT JOIN tot ON tot.env = '{A}' AND tot.ctx = i.ctx)
SELECT ctx, target, opposite, round(p1, 6) AS p1, round(p2, 6) AS p2, round(1 - {_H}, 6) AS bias
FROM (SELECT *, p1 / (p1 + p2) AS q FROM one WHERE p1 + p2 >= 1e-8)"""
ORACLES["mean_head_score"] = _with(DOCS, TEST, _grid_model(ONE_CELL), TEST_ITEMS, _scored(
    "(SELECT ctx, target AS word FROM items UNION ALL SELECT ctx, opposite FROM items)"
)) + """
SELECT DISTINCT i.ctx, target, opposite, word, round(ln(prob), 6) AS logit
FROM (SELECT ctx, target, opposite, target AS word FROM items UNION ALL SELECT ctx, target, opposite, opposite FROM items) i
JOIN probs USING (ctx, word) WHERE method = 'iLM'"""
_LANGS = "SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL"
ORACLES["env_line_bias"] = _with(DOCS, TEST, _lang_model(), TEST_ITEMS, _scored(
    "(SELECT ctx, target AS word FROM items UNION ALL SELECT ctx, opposite FROM items)", _LANGS
) + f""",
single AS (
  SELECT DISTINCT i.ctx, target, opposite,
    (coalesce(t.n, 0) + {ALPHA}::DOUBLE) / (coalesce(tot.n_ctx, 0) + {ALPHA}::DOUBLE * (SELECT v FROM vocab)) AS p1,
    (coalesce(o.n, 0) + {ALPHA}::DOUBLE) / (coalesce(tot.n_ctx, 0) + {ALPHA}::DOUBLE * (SELECT v FROM vocab)) AS p2
  FROM items i LEFT JOIN cnt t ON t.env = 'en' AND t.ctx = i.ctx AND t.word = target
  LEFT JOIN cnt o ON o.env = 'en' AND o.ctx = i.ctx AND o.word = opposite LEFT JOIN tot ON tot.env = 'en' AND tot.ctx = i.ctx),
one AS (SELECT ctx, target, opposite, p1 / (p1 + p2) AS q FROM single WHERE p1 + p2 >= 1e-8)""", _BIASES) + f"""
SELECT doc_id, line_no, method, target, opposite, round(bias, 6) AS bias FROM scores
UNION ALL SELECT doc_id, line_no, 'en', target, opposite, round(1 - {_H}, 6) FROM items JOIN one USING (ctx, target, opposite)"""
ORACLES["env_model_eval"] = _with(DOCS, TEST, _lang_model(), f"""
numbered AS (SELECT *, (row_number() OVER (ORDER BY doc_id, line_no) - 1) // {fixed.EVAL_BATCH_SIZE} AS batch FROM test)""",
    _pairs("all_positions", "numbered", "batch, doc_id, line_no"),
    f"positions AS (SELECT * FROM all_positions WHERE {_draw(SEED, 'doc_id', 'line_no', 'pos')} < {fixed.MASK_SHARE}::DOUBLE)",
    _scored("positions", _LANGS),
    "losses AS (SELECT batch, method, -ln(prob) AS loss FROM positions JOIN probs USING (ctx, word))",
) + """
SELECT method, round(avg(m), 6) AS eval_loss, round(sum(s) / sum(c), 6) AS token_loss, count(*) AS n_batches, round(exp(avg(m)), 3) AS perplexity
FROM (SELECT method, batch, avg(loss) AS m, sum(loss) AS s, count(*) AS c FROM losses GROUP BY ALL) GROUP BY method"""
ORACLES["line_bias"] = _line_bias(ONE_CELL) + """
SELECT doc_id, line_no, method, target, opposite, round(bias, 6) AS bias FROM scores"""

# --- ordered work ---------------------------------------------------------------------------------

_PACKED = _with(DOCS, ENV, _ENCODED, f"""
numbered AS (SELECT *, (row_number() OVER (PARTITION BY env ORDER BY doc_id, line_no) - 1) // {fixed.MAP_BATCH_ROWS} AS batch_id FROM encoded),
batches AS (
  SELECT env, CAST(batch_id AS BIGINT) AS batch_id, flatten(list(ids ORDER BY doc_id, line_no)) AS ids FROM numbered GROUP BY ALL),
blocks AS (
  SELECT env, batch_id, CAST(b AS INTEGER) AS block_id, ids[b * {BLOCK} + 1 : (b + 1) * {BLOCK}] AS ids
  FROM batches, unnest(range(len(ids) // {BLOCK})) u(b))""")
ORACLES["pack_blocks"] = _PACKED + "SELECT env, batch_id, block_id, array_to_string(ids, ' ') AS input_ids FROM blocks"
ORACLES["packing_report"] = _PACKED + f"""
SELECT env, batch_id, CAST(len(ids) // {BLOCK} AS BIGINT) AS n_blocks, CAST(len(ids) % {BLOCK} AS BIGINT) AS n_dropped FROM batches"""
ORACLES["mlm_mask"] = _PACKED.rstrip() + f""",
drawn AS (
  SELECT env, batch_id, block_id, i, ids[i + 1] AS id, md5(concat_ws('|', '{SEED}', env, batch_id, block_id, i)) AS h
  FROM blocks, unnest(range({BLOCK})) u(i)),
chosen AS (SELECT *, id >= {_N_SPECIAL} AND {_hex('h')} < {fixed.MASK_SHARE}::DOUBLE AS c, {_hex('h', 1)} AS kind, {_hex('h', 2)} AS pick FROM drawn)
SELECT env, batch_id, block_id,
  string_agg(CAST(CASE WHEN NOT c THEN id WHEN kind < 0.8::DOUBLE THEN {fixed.SPECIAL_TOKENS.index(fixed.MASK)}
    WHEN kind < 0.9::DOUBLE THEN CAST(floor(pick * (SELECT count(*) + {_N_SPECIAL} FROM ids)) AS BIGINT) ELSE id END AS VARCHAR), ' ' ORDER BY i) AS input_ids,
  string_agg(CAST(CASE WHEN c THEN id ELSE {fixed.IGNORED_LABEL} END AS VARCHAR), ' ' ORDER BY i) AS labels
FROM chosen GROUP BY ALL"""


def _shuffled(name: str, source: str, epochs: str) -> str:
    return f"""{name} AS (
  SELECT epoch, env, doc_id, line_no,
    row_number() OVER (PARTITION BY epoch, env ORDER BY md5(concat_ws('|', '{SEED}', epoch, env, doc_id, line_no)), doc_id, line_no) - 1 AS idx,
    CAST(idx // {fixed.BATCH_SIZE} AS BIGINT) AS batch_no
  FROM {source} CROSS JOIN (SELECT CAST(unnest(range({epochs})) AS INTEGER) AS epoch))"""


_ONE_EPOCH = _with(DOCS, ENV, _shuffled("shuffled", "env_lines", "1"))
ORACLES["shuffled_batches"] = _ONE_EPOCH + "SELECT epoch, env, doc_id, line_no, idx, batch_no FROM shuffled"
ORACLES["rank_shards"] = _ONE_EPOCH + f"""
SELECT env, doc_id, line_no, idx, CAST(idx % {RANKS} AS INTEGER) AS rank FROM shuffled"""
_ROBIN = _PLAN + ",\n" + _shuffled(
    "shuffled", "env_lines", f"(SELECT CAST(greatest(1, ceil({_STEPS} / spe)) AS BIGINT) FROM ilm)"
) + f""",
schedule AS (
  SELECT epoch, batch_no AS round, env, batch_no,
    CAST((epoch * rounds + batch_no) * n_env + CASE env WHEN '{A}' THEN 1 ELSE 2 END AS BIGINT) AS step, doc_id, line_no
  FROM shuffled CROSS JOIN ilm WHERE batch_no < rounds)"""
ORACLES["round_robin_schedule"] = _ROBIN + f" SELECT * FROM schedule WHERE step <= {_STEPS}"
_PASSES = _PLAN + ", pooled AS (SELECT '" + POOLED + "' AS env, doc_id, line_no FROM env_lines),\n" + _shuffled(
    "passes", "pooled", f"(SELECT CAST(ceil({_STEPS} / rounds) AS BIGINT) FROM elm)"
) + """,
pooled_steps AS (SELECT epoch, batch_no, CAST(epoch * rounds + batch_no + 1 AS BIGINT) AS step, doc_id, line_no FROM passes CROSS JOIN elm)"""
ORACLES["pooled_schedule"] = _PASSES + f" SELECT * FROM pooled_steps WHERE step <= {_STEPS}"
_THREE = _with(
    DOCS, "env_lines AS (SELECT lang AS env, doc_id, line_no FROM docs JOIN documents USING (doc_id) WHERE lang IS NOT NULL)",
    "sizes AS (SELECT env, count(*) AS n, row_number() OVER (ORDER BY env) AS turn FROM env_lines GROUP BY env)",
    f"plan3 AS (SELECT min(n) // {fixed.BATCH_SIZE} AS rounds, count(*) AS n_env FROM sizes)",
    "bound AS (SELECT rounds * n_env + n_env // 2 AS most FROM plan3)",
    _shuffled("shuffled", "env_lines", "2"),
    """steps AS (
  SELECT epoch, batch_no AS round, env, batch_no, CAST((epoch * rounds + batch_no) * n_env + turn AS BIGINT) AS step, doc_id, line_no
  FROM shuffled JOIN sizes USING (env) CROSS JOIN plan3 WHERE batch_no < rounds)""",
)
ORACLES["round_robin_three"] = _THREE + """
SELECT epoch, round, env, batch_no, step, doc_id, line_no FROM steps CROSS JOIN bound WHERE step <= most"""
ORACLES["log_steps_three"] = _THREE + """
SELECT DISTINCT epoch, step FROM steps CROSS JOIN plan3 CROSS JOIN bound
WHERE step <= most AND step % 2 = 0 AND (step % n_env = 0 OR step = most)"""
ORACLES["log_steps"] = f"""
SELECT 'iLM' AS method, epoch, step FROM ({ORACLES['round_robin_schedule']}) WHERE step % {fixed.LOG_INTERVAL} = 0 AND (step % 2 = 0 OR step = {_STEPS}) GROUP BY ALL
UNION ALL SELECT 'eLM', epoch, step FROM ({ORACLES['pooled_schedule']}) WHERE step % {fixed.LOG_INTERVAL} = 0 GROUP BY ALL"""
ORACLES["checkpoint_steps"] = f"""
SELECT DISTINCT epoch, step FROM ({ORACLES['round_robin_schedule']}) WHERE step % {CHECKPOINT_EVERY} = 0"""
ORACLES["step_limit"] = _with(EVENTS) + f"SELECT run, step, env, round(loss, 6) AS loss FROM log WHERE step <= {_STEPS}"

# --- sets -----------------------------------------------------------------------------------------

ORACLES["pooled_train"] = _with(DOCS, ENV) + f"SELECT '{POOLED}' AS env, env AS part, doc_id, line_no, line FROM env_lines"
ORACLES["env_list"] = _with(DOCS, ENV) + f"""
SELECT DISTINCT 'iLM' AS method, env FROM env_lines UNION ALL SELECT DISTINCT 'eLM', env FROM env_lines UNION ALL SELECT 'eLM', '{POOLED}'"""

# --- user functions -------------------------------------------------------------------------------

ORACLES["map_batches"] = _with(DOCS) + f"SELECT doc_id, line_no, CAST(len({_words('line')}) AS BIGINT) AS n_words FROM docs"
ORACLES["masked_scorer"] = _with(DOCS, TEST, _hits("test", FREQUENT), f"""
places AS (SELECT w[i] AS token, i = 1 AS first FROM (SELECT {_words('line')} AS w FROM docs) t, unnest(range(1, len(w) + 1)) u(i)),
term_counts AS (SELECT token, first, count(*) AS n FROM places WHERE token IN {_in(FREQUENT)} GROUP BY ALL),
total AS (SELECT f AS first, coalesce(sum(n), 0) + {ALPHA}::DOUBLE * {len(FREQUENT)} AS t FROM (VALUES (true), (false)) v(f)
  LEFT JOIN term_counts ON first = f GROUP BY f),
ratios AS (
  SELECT doc_id, line_no, target, (coalesce(a.n, 0) + {ALPHA}::DOUBLE) / t AS p1, (coalesce(b.n, 0) + {ALPHA}::DOUBLE) / t AS p2, p1 / (p1 + p2) AS q
  FROM (SELECT *, tpos = 1 AS first FROM hits) JOIN total USING (first)
  LEFT JOIN term_counts a ON a.token = target AND a.first = total.first LEFT JOIN term_counts b ON b.token = opposite AND b.first = total.first)""") + f"""
SELECT doc_id, line_no, target, round(p1, 6) AS p1, round(p2, 6) AS p2, round(1 - {_H}, 6) AS bias FROM ratios"""
ORACLES["model_scorer"] = _line_bias(ONE_CELL) + """
SELECT doc_id, line_no, target, opposite, round(bias, 6) AS bias FROM scores WHERE method = 'iLM'"""
