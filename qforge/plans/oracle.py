"""DuckDB SQL oracles, one per registered query (same column names).

Row numbers stay 1-based inside the SQL and are shifted only in the
outermost projection; every double is rounded to 6 digits on both sides.
"""

QA_CTE = """qa AS (
  SELECT doc_id AS id, source AS title, d.text AS context,
    concat(CASE doc_id % 5 WHEN 0 THEN 'what' WHEN 1 THEN 'who' WHEN 2 THEN 'when'
                           WHEN 3 THEN 'where' ELSE 'how' END, ' ',
           array_to_string(list_filter(d.w, lambda x, i: x <> '' AND (i = 1 OR d.w[i - 1] <> x)), ' '), '?') AS question,
    CASE WHEN doc_id % 7 <> 0 THEN CAST(length(d.text) // 3 AS BIGINT) END AS s,
    CASE WHEN doc_id % 7 <> 0 THEN
      regexp_extract(substring(d.text, CAST(length(d.text) // 3 AS BIGINT) + 1), '(?s)^.[^ \\t\\n\\x0B\\f\\r]*') END AS answer
  FROM (SELECT *, string_split_regex(regexp_extract(text, '[^\\n.?!]*'), '[ \\t\\x0B\\f\\r]+') AS w FROM documents) d)"""

HL = ("concat(substring(context, 1, s), ' {hl} ', substring(context, s + 1, length(answer)), "
      "' {hl} ', substring(context, s + length(answer) + 1))")


def hl(marker="<hl>"):
    return HL.format(hl=marker)


SQL = {}

SQL["q01_prompt_answer_aware"] = f"""
WITH {QA_CTE}
SELECT id, title,
  concat('generate question: <answer> ', answer, ' <answer> <context> ', {hl()}, ' <context>') AS inputs,
  concat('<question> ', question, ' <question>') AS target
FROM qa WHERE s IS NOT NULL"""

SQL["q02_prompt_no_highlight"] = f"""
WITH {QA_CTE}
SELECT id, title,
  concat('generate question: <answer> ', answer, ' <answer> <context> ', context, ' <context>') AS inputs,
  concat('<question> ', question, ' <question>') AS target
FROM qa WHERE s IS NOT NULL"""

SQL["q03_prompt_zero_shot"] = f"""
WITH {QA_CTE}
SELECT id, title,
  concat('generate question: <context> ', {hl()}, ' <context>') AS inputs,
  concat('<question> ', question, ' <question>') AS target
FROM qa WHERE s IS NOT NULL"""

SQL["q04_prompt_rl"] = f"""
WITH {QA_CTE}
SELECT id, title, question,
  concat('generate question: <answer> ', answer, ' <answer> <context> ', {hl()}, ' <context>') AS query,
  concat('<question> ', question, ' <question>') AS target,
  answer
FROM qa WHERE s IS NOT NULL"""

CAUSAL_SYSTEM = ('You are a question generation system. Generate questions for the '
                 'given answer <answer>, matching the context. Each question starts '
                 'after <question> and starts with a question word like '
                 '"who, what, where, when"')

SQL["q05_prompt_causal_train"] = f"""
WITH {QA_CTE}
SELECT id, title,
  concat('<s>[INST] <<SYS>> {CAUSAL_SYSTEM} <<SYS>> ', {hl('')}, ' ### Answer: ', answer,
         ' ### Answer: [/INST] ### Question: ', question, '  </s>') AS text
FROM qa WHERE s IS NOT NULL"""

SQL["q06_prompt_causal_eval"] = f"""
WITH {QA_CTE}
SELECT id, title, question,
  concat('<s> ', {hl('')}, ' ### Answer: ', answer, '  ### Question:') AS text
FROM qa WHERE s IS NOT NULL"""

SQL["q07_prompt_qa"] = """
SELECT conv_id, turn,
  concat('### Question: ', text, ' ### Answer: ') AS prompt,
  left(text, 128) AS preview,
  concat('### Question: ', lower(text), ' ### Answer: ') AS prompt_lower
FROM conversations WHERE role = 'user'"""

SQL["q07b_prompt_report"] = f"""
WITH {QA_CTE}
SELECT id, concat('<ctx> ', {hl()}, ' <ctx> <ans> ', answer) AS inputs
FROM qa WHERE s IS NOT NULL"""

SQL["q08_span_check"] = f"""
WITH {QA_CTE}
SELECT id, s AS answer_start,
  substring(context, s + 1, length(answer)) = answer AS slice_ok,
  (instr(context, answer) - 1) = s AS first_occurrence,
  CAST(instr(context, answer) - 1 AS BIGINT) AS first_pos
FROM qa WHERE s IS NOT NULL"""

SQL["q09_position_slice"] = f"""
WITH {QA_CTE},
r AS (SELECT id, title, row_number() OVER (ORDER BY id) AS rn FROM qa WHERE s IS NOT NULL)
SELECT id, title, rn - 1 AS row_idx FROM r WHERE rn > 100 AND rn <= 600"""

SQL["q09b_row_at"] = """
WITH r AS (SELECT doc_id AS id, source AS title, row_number() OVER (ORDER BY doc_id) AS rn FROM documents WHERE doc_id % 7 <> 0)
SELECT id, title, rn - 1 AS row_idx FROM r WHERE rn = 124"""

SQL["q10_seeded_sample"] = f"""
WITH {QA_CTE}
SELECT id, title, question FROM qa WHERE s IS NOT NULL
ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id LIMIT 100"""

SPLITS_CTE = """r AS (
  SELECT doc_id, source, text,
         row_number() OVER (ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id) AS rn
  FROM documents),
sp AS (
  SELECT doc_id, source, text, rn - 1 AS row_idx,
    CASE WHEN rn <= 300 THEN 'finetune' WHEN rn <= 600 THEN 'reward'
         WHEN rn <= 900 THEN 'rl' ELSE 'evaluation' END AS split
  FROM r)"""

SQL["q11_named_splits"] = f"""
WITH {SPLITS_CTE}
SELECT doc_id, split, row_idx FROM sp"""

SQL["q12_holdout_fraction"] = """
WITH r AS (
  SELECT doc_id,
         row_number() OVER (ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id) AS rn,
         count(*) OVER () AS n
  FROM documents)
SELECT doc_id, rn - 1 AS row_idx,
  CASE WHEN rn <= ceil(0.05 * n) THEN 'test' ELSE 'train' END AS holdout,
  CAST(('0x' || substr(md5(concat('42:', CAST(doc_id AS VARCHAR))), 1, 7))::BIGINT % 10 AS BIGINT) AS bucket,
  CASE WHEN ('0x' || substr(md5(concat('42:', CAST(doc_id AS VARCHAR))), 1, 7))::BIGINT % 10 < 8 THEN 'train'
       WHEN ('0x' || substr(md5(concat('42:', CAST(doc_id AS VARCHAR))), 1, 7))::BIGINT % 10 < 9 THEN 'validation'
       ELSE 'test' END AS hash_split
FROM r"""

SQL["q13_batches"] = f"""
WITH {QA_CTE},
r AS (SELECT id, row_number() OVER (ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id) AS rn,
             count(*) OVER () AS n
      FROM qa WHERE s IS NOT NULL)
SELECT id, rn - 1 AS row_idx, CAST((rn - 1) // 16 AS BIGINT) AS batch_id
FROM r WHERE (rn - 1) // 16 < n // 16"""

SAMPLE_CTE = f"""{QA_CTE},
smp AS (SELECT id FROM qa WHERE s IS NOT NULL
        ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id LIMIT 100)"""

MODELS_CTE = """preds AS (
  SELECT id, 'echo' AS model, concat('question> ', question, ' question>') AS prediction FROM qa WHERE s IS NOT NULL
  UNION ALL SELECT id, 'drop_first', substring(question, instr(question, ' ') + 1) FROM qa WHERE s IS NOT NULL
  UNION ALL SELECT id, 'leak', concat(question, ' ', answer) FROM qa WHERE s IS NOT NULL
  UNION ALL SELECT id, 'empty', '' FROM qa WHERE s IS NOT NULL)"""

SQL["q14_fixed_sample_semi"] = f"""
WITH {SAMPLE_CTE}, {MODELS_CTE}
SELECT id, model, prediction FROM preds WHERE id IN (SELECT id FROM smp)"""

SQL["q15_overlap_anti"] = """
WITH ids AS (SELECT doc_id AS id, source AS title FROM documents WHERE doc_id % 7 <> 0),
smp AS (SELECT id FROM ids ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id LIMIT 100)
SELECT id, title FROM ids ANTI JOIN smp USING (id)"""

PAIR_COLUMNS = """x.qid, x.pos AS pos_i, y.pos AS pos_j,
    CASE WHEN x.pm_score > y.pm_score THEN x.text ELSE y.text END AS response_j,
    CASE WHEN x.pm_score > y.pm_score THEN y.text ELSE x.text END AS response_k,
    CAST(greatest(x.pm_score, y.pm_score) AS BIGINT) AS score_j,
    CAST(least(x.pm_score, y.pm_score) AS BIGINT) AS score_k,
    CASE WHEN x.pm_score > y.pm_score THEN x.pos ELSE y.pos END AS pos_hi,
    CASE WHEN x.pm_score > y.pm_score THEN y.pos ELSE x.pos END AS pos_lo"""

PREF_CTE = f"""pb AS (
  SELECT source AS qid, doc_id, text, length(text) % 5 AS pm_score,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos
  FROM documents),
pairs AS (
  SELECT {PAIR_COLUMNS}
  FROM pb x JOIN pb y ON x.qid = y.qid AND x.pos < y.pos AND x.pm_score <> y.pm_score)"""

FORUM_CTE = f"""pb AS (SELECT conv_id AS qid, turn + 1 AS pos, text, length(text) % 5 AS pm_score FROM conversations),
pairs AS (
  SELECT {PAIR_COLUMNS}
  FROM pb x JOIN pb y ON x.qid = y.qid AND x.pos < y.pos AND x.pm_score <> y.pm_score)"""

SQL["q16_pref_pairs"] = f"""
WITH {FORUM_CTE}
SELECT * EXCLUDE (pos_hi, pos_lo) FROM pairs"""

DRAW_CTE = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score_j, pos_hi, score_k, pos_lo) - 1 AS r,
         count(*) OVER (PARTITION BY qid) AS n FROM pairs),
draws AS (
  SELECT qid, ('0x' || substr(md5(concat('42:', CAST(qid AS VARCHAR), ':', CAST(t AS VARCHAR))), 1, 13))::BIGINT % n AS r, min(t) AS t
  FROM (SELECT DISTINCT qid, n FROM ranked WHERE n > 1000), unnest(range(0, 100)) u(t) GROUP BY ALL),
capped AS (
  SELECT qid, pos_i, pos_j, response_j, response_k, score_j, score_k,
         row_number() OVER (PARTITION BY qid ORDER BY md5(concat('42:', CAST(qid AS VARCHAR), ':', CAST(r AS VARCHAR)))) AS pair_rank
  FROM ranked WHERE n <= 1000
  UNION ALL
  SELECT k.qid, pos_i, pos_j, response_j, response_k, score_j, score_k, row_number() OVER (PARTITION BY k.qid ORDER BY t) AS pair_rank
  FROM ranked k JOIN draws d ON k.qid = d.qid AND k.r = d.r)"""

SQL["q17_pref_pairs_capped"] = f"""
WITH {PREF_CTE}, {DRAW_CTE}
SELECT * FROM capped WHERE pair_rank <= 10"""

SQL["q17b_pref_pipeline"] = f"""
WITH {FORUM_CTE}, {DRAW_CTE},
sp AS (SELECT qid, row_number() OVER (ORDER BY md5(concat('42:', CAST(qid AS VARCHAR))), qid) AS rn FROM (SELECT DISTINCT qid FROM pb))
SELECT qid, concat('conversation ', CAST(qid AS VARCHAR)) AS question, CAST(NULL AS VARCHAR) AS date, 0 AS n_metadata,
  CASE WHEN rn <= 30 THEN 'finetune' WHEN rn <= 60 THEN 'reward' WHEN rn <= 90 THEN 'rl' ELSE 'evaluation' END AS split,
  pos_i, pos_j, response_j, response_k, score_j, score_k
FROM capped JOIN sp USING (qid) WHERE pair_rank <= 10"""

SQL["q18_best_worst"] = f"""
WITH {PREF_CTE},
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pm_score DESC, pos ASC) AS rb,
               row_number() OVER (PARTITION BY qid ORDER BY pm_score ASC, pos DESC) AS rw FROM pb)
SELECT x.qid, x.pos AS best_pos, y.pos AS worst_pos, x.text AS response_j, y.text AS response_k,
       CAST(x.pm_score AS BIGINT) AS score_j, CAST(y.pm_score AS BIGINT) AS score_k
FROM b x JOIN b y ON x.qid = y.qid AND x.rb = 1 AND y.rw = 1"""

SQL["q19_pair_stats"] = f"""
WITH {PREF_CTE},
na AS (SELECT qid, count(*) AS n FROM pb GROUP BY qid),
np AS (SELECT qid, count(*) AS n_pairs FROM pairs GROUP BY qid)
SELECT na.qid, na.n AS n_answers, na.n * na.n / 2.0 AS half_sq,
       coalesce(np.n_pairs, 0) AS n_pairs, least(coalesce(np.n_pairs, 0), 10) AS n_capped
FROM na LEFT JOIN np ON na.qid = np.qid"""

SQL["q20_shard_plan"] = f"""
WITH {SPLITS_CTE},
b AS (SELECT split, count(*) AS n,
             sum(8 + strlen(source) + strlen(text)) AS nbytes FROM sp GROUP BY split),
k AS (SELECT split, n, CAST(floor(nbytes / {1 << 18}) AS BIGINT) + 1 AS ns FROM b),
pos AS (SELECT sp.split, sp.row_idx, k.n, k.ns,
               row_number() OVER (PARTITION BY sp.split ORDER BY sp.row_idx) - 1 AS lp
        FROM sp JOIN k ON sp.split = k.split),
sh AS (SELECT split, row_idx, ns,
         CASE WHEN n // ns = 0 THEN lp
              WHEN lp < (n // ns + 1) * (n % ns) THEN lp // (n // ns + 1)
              ELSE (n % ns) + (lp - (n // ns + 1) * (n % ns)) // (n // ns) END AS shard
       FROM pos)
SELECT split, CAST(shard AS BIGINT) AS shard, CAST(ns AS BIGINT) AS num_shards,
       printf('train-%05d-of-%05d.parquet', shard, ns) AS file_name,
       count(*) AS n_rows, min(row_idx) AS first_row, max(row_idx) AS last_row
FROM sh GROUP BY split, shard, ns"""

SQL["q20b_named_shards"] = SQL["q20_shard_plan"].split("SELECT split, CAST(shard")[0] + """
SELECT sh.split, printf('train-%05d-of-%05d.parquet', shard, ns) AS file_name, count(*) AS n_rows,
       min(sh.row_idx) AS first_row, max(sh.row_idx) AS last_row, CAST(sum(length(sp.text)) AS BIGINT) AS n_chars
FROM sh JOIN sp ON sh.split = sp.split AND sh.row_idx = sp.row_idx GROUP BY sh.split, shard, ns"""

# ---------------------------------------------------------------- evaluation frame
X6 = "replace(replace(replace({x}, 'question>', ''), '<question>', ''), '<hl>', '')"
X7 = "replace({x}, '<question>', '')"
TRIM_WS = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
X8 = TRIM_WS.format(x="replace(replace(replace(replace(replace(replace({x}, '<pad>', ''), '<unk>', ''), "
                      "'</s>', ''), 'question>', ''), '<question>', ''), '<', '')")
TOK = "regexp_extract_all(lower({x}), '[a-z0-9]+', 0)"


def eval_ctes(cleanup="eval"):
    if cleanup == "eval":
        pc, rc = X6.format(x="prediction"), X7.format(x="target")
    else:
        pc, rc = X8.format(x="prediction"), X8.format(x="target")
    return f"""{QA_CTE}, {MODELS_CTE},
ev0 AS (SELECT p.id, p.model, p.prediction, concat('<question> ', qa.question, ' <question>') AS target,
               qa.answer
        FROM preds p JOIN qa ON p.id = qa.id WHERE qa.s IS NOT NULL),
ev AS (SELECT id, model, {pc} AS prediction, {rc} AS reference, answer FROM ev0),
tk AS (SELECT id, model, prediction, reference, answer,
              {TOK.format(x='prediction')} AS pt, {TOK.format(x='reference')} AS rt FROM ev)"""


def ngram_expr(t, n):
    return f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n} - 1], ' '))"


def skip_expr(t):
    return (f"flatten(list_transform(range(1, len({t})), lambda i: "
            f"list_transform(range(i + 1, len({t}) + 1), lambda j: {t}[i] || ' ' || {t}[j])))")


def _rnd(rounded):
    return (lambda e: f"round({e}, 6)") if rounded else (lambda e: e)


def overlap_ctes(name, gp, gr, prefix, rounded=True, keys=("id", "model"), src="tk"):
    """ROUGE-N style scores by unnest + group + join (a different method from
    the per-row Spark plan)."""
    k = ", ".join(keys)
    on = " AND ".join(f"g.{c} = ov.{c}" for c in keys)
    gk = ", ".join(f"g.{c}" for c in keys)
    return f"""{name}_g AS (SELECT {k}, {gp} AS gp, {gr} AS gr FROM {src}),
{name}_pc AS (SELECT {k}, gram, count(*) AS c FROM (SELECT {k}, unnest(gp) AS gram FROM {name}_g)
              GROUP BY {k}, gram),
{name}_rc AS (SELECT {k}, gram, count(*) AS c FROM (SELECT {k}, unnest(gr) AS gram FROM {name}_g)
              GROUP BY {k}, gram),
{name}_ov AS (SELECT {k}, sum(least(a.c, b.c)) AS o FROM {name}_pc a JOIN {name}_rc b USING ({k}, gram)
              GROUP BY {k}),
{name}_s AS (SELECT {gk}, coalesce(ov.o, 0) / greatest(len(g.gp), 1) AS p,
                    coalesce(ov.o, 0) / greatest(len(g.gr), 1) AS r
             FROM {name}_g g LEFT JOIN {name}_ov ov ON {on}),
{name} AS (SELECT {k}, {_rnd(rounded)('p')} AS {prefix}_p, {_rnd(rounded)('r')} AS {prefix}_r,
                  {_rnd(rounded)('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END')} AS {prefix}_f
           FROM {name}_s)"""


def rouge_l_ctes(name="rl", prefix="rougeL", rounded=True):
    dp = ("list_reduce(rt, lambda prev, c: list_reduce(range(1, len(pt) + 1), lambda row, j: "
          "list_append(row, CASE WHEN pt[j] = c THEN prev[j] + 1 ELSE greatest(prev[j + 1], row[j]) END), [0]), "
          "list_transform(range(0, len(pt) + 1), lambda x: 0))")
    return f"""{name}_d AS (SELECT id, model, len(pt) AS np, len(rt) AS nr, {dp} AS dp FROM tk),
{name}_s AS (SELECT id, model,
               CASE WHEN np = 0 OR nr = 0 THEN 0.0 ELSE dp[-1] / np END AS p,
               CASE WHEN np = 0 OR nr = 0 THEN 0.0 ELSE dp[-1] / nr END AS r FROM {name}_d),
{name} AS (SELECT id, model, {_rnd(rounded)('p')} AS {prefix}_p, {_rnd(rounded)('r')} AS {prefix}_r,
                  {_rnd(rounded)('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END')} AS {prefix}_f
           FROM {name}_s)"""


def bert_ctes(name="bs", prefix="bert", rounded=True):
    bucket = "('0x' || substr(md5(tok), 1, 7))::BIGINT % (SELECT count(*) FROM embeddings)"
    rnd = (lambda e: f"round({e}, 6)") if rounded else (lambda e: e)
    return f"""{name}_v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
{name}_tp AS (SELECT id, model, unnest(pt) AS tok, generate_subscripts(pt, 1) AS pos FROM tk),
{name}_tr AS (SELECT id, model, unnest(rt) AS tok, generate_subscripts(rt, 1) AS pos FROM tk),
{name}_pv AS (SELECT t.id, t.model, t.pos, v.v FROM {name}_tp t JOIN {name}_v v ON v.vec_id = {bucket}),
{name}_rv AS (SELECT t.id, t.model, t.pos, v.v FROM {name}_tr t JOIN {name}_v v ON v.vec_id = {bucket}),
{name}_sim AS (SELECT a.id, a.model, a.pos AS pp, b.pos AS rp, list_cosine_similarity(a.v, b.v) AS s
               FROM {name}_pv a JOIN {name}_rv b ON a.id = b.id AND a.model = b.model),
{name}_p AS (SELECT id, model, avg(m) AS p FROM (SELECT id, model, pp, max(s) AS m FROM {name}_sim
             GROUP BY id, model, pp) GROUP BY id, model),
{name}_r AS (SELECT id, model, avg(m) AS r FROM (SELECT id, model, rp, max(s) AS m FROM {name}_sim
             GROUP BY id, model, rp) GROUP BY id, model),
{name}_s AS (SELECT tk.id, tk.model, coalesce(a.p, 0.0) AS p, coalesce(b.r, 0.0) AS r
             FROM tk LEFT JOIN {name}_p a ON tk.id = a.id AND tk.model = a.model
                     LEFT JOIN {name}_r b ON tk.id = b.id AND tk.model = b.model),
{name} AS (SELECT id, model, {rnd('p')} AS {prefix}_p, {rnd('r')} AS {prefix}_r,
                  {rnd('CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0.0 END')} AS {prefix}_f
           FROM {name}_s)"""


SQL["q21_clean_eval"] = f"""
WITH {eval_ctes('eval')}
SELECT id, model, prediction AS prediction_clean, reference AS target_clean FROM ev"""

SQL["q22_clean_reward"] = f"""
WITH {eval_ctes('reward')}
SELECT id, model, prediction AS prediction_clean, reference AS target_clean FROM ev"""

SQL["q23_extract_completion"] = f"""
WITH {QA_CTE},
c AS (SELECT id, concat('<s> ', {hl('')}, ' ### Answer: ', answer, '  ### Question:', ' ', question, ' Yes? ok') AS t
      FROM qa WHERE s IS NOT NULL)
SELECT id, concat(split_part(string_split(t, '### Question:')[2], '?', 1), '?') AS prediction FROM c"""

SQL["q24_extract_answer"] = """
WITH c AS (SELECT conv_id, turn,
  concat('[''### Question: q ### Answer: ', replace(replace(text, chr(10), '\\n'), '"', '\\"'), ''']') AS rep
  FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn,
  replace(replace(replace(string_split(rep, '### Answer:')[2], '\\n', ' '), '\\t', ' '), '\\"', '') AS answer_text
FROM c"""

SQL["q25_rouge1"] = f"""
WITH {eval_ctes()}, {overlap_ctes('r1', ngram_expr('pt', 1), ngram_expr('rt', 1), 'rouge1')}
SELECT * FROM r1"""

SQL["q26_rouge2"] = f"""
WITH {eval_ctes()}, {overlap_ctes('r2', ngram_expr('pt', 2), ngram_expr('rt', 2), 'rouge2')}
SELECT * FROM r2"""

SQL["q27_rougeL"] = f"""
WITH {eval_ctes()}, {rouge_l_ctes()}
SELECT * FROM rl"""

SQL["q29_rougeS"] = f"""
WITH {eval_ctes()}, {overlap_ctes('rs', skip_expr('pt'), skip_expr('rt'), 'rougeS')}
SELECT * FROM rs"""

ALL_SCORES = f"""{eval_ctes()},
{overlap_ctes('r1', ngram_expr('pt', 1), ngram_expr('rt', 1), 'rouge1', False)},
{overlap_ctes('r2', ngram_expr('pt', 2), ngram_expr('rt', 2), 'rouge2', False)},
{overlap_ctes('rs', skip_expr('pt'), skip_expr('rt'), 'rougeS', False)},
{rouge_l_ctes(rounded=False)}, {bert_ctes(rounded=False)},
sc AS (SELECT * FROM r1 JOIN r2 USING (id, model) JOIN rs USING (id, model) JOIN rl USING (id, model)
       JOIN bs USING (id, model))"""

SQL["q30_rouge_summary"] = f"""
WITH {ALL_SCORES},
a AS (SELECT model, count(*) AS n, round(avg(rouge1_f), 6) AS rouge1_f, round(avg(rouge2_f), 6) AS rouge2_f,
             round(avg(rougeL_f), 6) AS rougeL_f, round(avg(rougeS_f), 6) AS rougeS_f,
             round(avg(bert_f), 6) AS bert_f
      FROM sc GROUP BY model)
SELECT *, rank() OVER (ORDER BY rouge1_f DESC) AS rank FROM a"""


def _poisson_case(u):
    import math
    cdf, term, parts = 0.0, math.exp(-1.0), []
    while cdf <= 1 - 2.0 ** -48:                         # up to the largest draw
        cdf += term
        parts.append(f"WHEN {u} < {cdf!r} THEN {len(parts)}")
        term = term / len(parts)
    return "CASE " + " ".join(parts) + " END"


SQL["q31_rouge_bootstrap"] = f"""
WITH {eval_ctes()}, {overlap_ctes('r1', ngram_expr('pt', 1), ngram_expr('rt', 1), 'rouge1', False)},
reps AS (SELECT model, id, rouge1_f, unnest(range(1, 1001)) AS rep FROM r1),
u AS (SELECT model, rep, rouge1_f,
        ('0x' || substr(md5(concat('42:', CAST(rep AS VARCHAR), ':', CAST(id AS VARCHAR))), 1, 12))::BIGINT
          / 281474976710656.0 AS u FROM reps),
w AS (SELECT model, rep, rouge1_f, {_poisson_case('u')} AS w FROM u),
m AS (SELECT model, rep, sum(w * rouge1_f) / nullif(sum(w), 0) AS m FROM w GROUP BY model, rep),
q AS (SELECT model, quantile_cont(m, [0.025, 0.5, 0.975]) AS q FROM m WHERE m IS NOT NULL GROUP BY model)
SELECT model, round(q[1], 6) AS low, round(q[2], 6) AS mid, round(q[3], 6) AS high FROM q"""

SQL["q32_running_mean"] = f"""
WITH {eval_ctes()}, {overlap_ctes('r1', ngram_expr('pt', 1), ngram_expr('rt', 1), 'rouge1', False)}
SELECT id, model, round(avg(rouge1_f) OVER (PARTITION BY model ORDER BY id
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_mean
FROM r1"""

SQL["q33_bertscore"] = f"""
WITH {eval_ctes()}, {bert_ctes()}
SELECT * FROM bs"""

WORDS = ("CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE string_split_regex({t}, '\\s+') END")


def reward_ctes(leak_pen, leak_ok, max_words):
    wp = WORDS.format(t=TRIM_WS.format(x="tk.prediction"))
    wt = WORDS.format(t=TRIM_WS.format(x="tk.reference"))
    return f"""{eval_ctes('reward')}, {bert_ctes(rounded=False)},
rw0 AS (SELECT tk.id, tk.model, tk.prediction, tk.reference, tk.answer, bs.bert_f,
               {wp} AS wp, {wt} AS wt
        FROM tk JOIN bs ON tk.id = bs.id AND tk.model = bs.model),
rw1 AS (SELECT *, contains(lower(prediction), lower(answer)) AS leak,
               CASE WHEN contains(lower(prediction), lower(answer)) THEN {leak_pen} ELSE {leak_ok} END AS t_leak,
               CASE WHEN lower(wt[1]) <> lower(wp[1]) THEN -0.5 ELSE 0.5 END AS t_word,
               CASE WHEN len(wt) > {max_words} THEN -0.5 ELSE 0.5 END AS t_len
        FROM rw0),
rwu AS (SELECT id, model, bert_f, leak, t_word > 0 AS word_match, t_len < 0 AS long_text,
              CASE WHEN answer IS NOT NULL AND len(wp) > 0 AND len(wt) > 0
                   THEN 1.0 / (1.0 + exp(-(bert_f + t_leak + t_word + t_len))) ELSE 0.0 END AS reward
       FROM rw1),
rw AS (SELECT id, model, round(bert_f, 6) AS bert_f, leak, word_match, long_text, round(reward, 6) AS reward
       FROM rwu)"""


SQL["q34_reward_code"] = f"""
WITH {reward_ctes(-5.0, 1.0, 20)}
SELECT * FROM rw"""

SQL["q35_reward_paper"] = f"""
WITH {reward_ctes(-1.0, 1.0, 32)}
SELECT * FROM rw"""

SQL["q36_reward_by_batch"] = f"""
WITH {reward_ctes(-5.0, 1.0, 20)},
br AS (SELECT id, row_number() OVER (ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id) AS rn,
              count(*) OVER () AS n FROM qa WHERE s IS NOT NULL),
bt AS (SELECT id, CAST((rn - 1) // 16 AS BIGINT) AS batch_id FROM br WHERE (rn - 1) // 16 < n // 16)
SELECT model, batch_id, round(avg(reward), 6) AS mean_reward, count(*) AS n
FROM rwu JOIN bt USING (id) GROUP BY model, batch_id"""

SQL["q37_term_rates"] = f"""
WITH {reward_ctes(-5.0, 1.0, 20)}
SELECT model, round(avg(leak::INT), 6) AS leak_rate, round(avg(word_match::INT), 6) AS word_match_rate,
       round(avg(long_text::INT), 6) AS long_rate, round(avg(reward), 6) AS mean_reward, count(*) AS n
FROM rwu GROUP BY model"""

# ---------------------------------------------------------------- vocabulary, encoding
PROMPTS_CTE = f"""{QA_CTE},
p AS (SELECT id, title,
        concat('generate question: <answer> ', answer, ' <answer> <context> ', {hl()}, ' <context>') AS inputs,
        concat('<question> ', question, ' <question>') AS target
      FROM qa WHERE s IS NOT NULL)"""
WT = "regexp_extract_all({x}, '\\S+', 0)"

VOCAB_CTE = f"""{PROMPTS_CTE},
vt AS (SELECT unnest({WT.format(x='inputs')}) AS token FROM p
       UNION ALL SELECT unnest({WT.format(x='target')}) AS token FROM p),
vc AS (SELECT token, count(*) AS count FROM vt GROUP BY token),
vr AS (SELECT token, count, row_number() OVER (ORDER BY count DESC, token) AS rn FROM vc),
v AS (SELECT token, rn + 2 AS tid, count FROM vr)"""

SQL["q39_vocab"] = f"""
WITH {VOCAB_CTE}
SELECT token, tid, count FROM v"""


def _enc(name, col, n):
    return f"""{name}_t AS (SELECT id, ({WT.format(x=col)})[1:{n - 1}] AS toks FROM p),
{name}_e AS (SELECT id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM {name}_t),
{name}_l AS (SELECT e.id, list(coalesce(v.tid, 2) ORDER BY e.pos) AS ids
             FROM {name}_e e LEFT JOIN v ON e.token = v.token GROUP BY e.id),
{name}_s AS (SELECT p.id, list_concat(coalesce(l.ids, []), [1]) AS seq FROM p LEFT JOIN {name}_l l ON p.id = l.id),
{name} AS (SELECT id, list_concat(seq, list_transform(range({n} - len(seq)), lambda x: 0)) AS ids,
                  len(seq) AS n FROM {name}_s)"""


SQL["q40_encode"] = f"""
WITH {VOCAB_CTE}, {_enc('ei', 'inputs', 512)}, {_enc('el', 'target', 32)}
SELECT ei.id, array_to_string(ei.ids, ' ') AS input_ids, array_to_string(el.ids, ' ') AS labels,
       ei.n AS n_input_tokens
FROM ei JOIN el ON ei.id = el.id"""

SQL["q40b_pad_longest"] = f"""
WITH {VOCAB_CTE}, {_enc('ei', 'inputs', 512)},
br AS (SELECT id, row_number() OVER (ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id) AS rn, count(*) OVER () AS n FROM p),
b AS (SELECT id, CAST((rn - 1) // 16 AS BIGINT) AS batch_id FROM br WHERE (rn - 1) // 16 < n // 16),
w AS (SELECT b.id, b.batch_id, s.seq, max(len(s.seq)) OVER (PARTITION BY b.batch_id) AS width FROM b JOIN ei_s s ON s.id = b.id)
SELECT id, batch_id, width, len(seq) AS n_tokens,
       array_to_string(list_concat(seq, list_transform(range(width - len(seq)), lambda x: 0)), ' ') AS input_ids
FROM w"""

SQL["q41_token_budget"] = f"""
WITH {PROMPTS_CTE},
n AS (SELECT len({WT.format(x='inputs')}) AS ni, len({WT.format(x='target')}) AS nt FROM p)
SELECT count(*) AS n_rows,
  round(avg((ni > 511)::INT), 6) AS inputs_truncated_share, max(ni) AS inputs_max_tokens,
  round(quantile_cont(ni, 0.5), 6) AS inputs_median_tokens,
  round(avg((nt > 31)::INT), 6) AS target_truncated_share, max(nt) AS target_max_tokens,
  round(quantile_cont(nt, 0.5), 6) AS target_median_tokens
FROM n"""

# ---------------------------------------------------------------- comparison
SQL["q42_align_predictions"] = f"""
WITH {QA_CTE}
SELECT coalesce(p.id, q.id) AS id, p.prediction, q.question, p.prediction IS NOT NULL AS has_prediction
FROM (SELECT id, concat('question> ', question, ' question>') AS prediction FROM qa WHERE s IS NOT NULL) p
FULL OUTER JOIN (SELECT id, question FROM qa) q ON p.id = q.id"""

SQL["q43_wide_models"] = f"""
WITH {QA_CTE}, {MODELS_CTE}
SELECT id, max(CASE WHEN model = 'echo' THEN prediction END) AS echo,
  max(CASE WHEN model = 'drop_first' THEN prediction END) AS drop_first,
  max(CASE WHEN model = 'leak' THEN prediction END) AS leak,
  max(CASE WHEN model = 'empty' THEN prediction END) AS empty
FROM preds GROUP BY id"""

SQL["q44_long_models"] = f"""
WITH {QA_CTE}, {MODELS_CTE}
SELECT id, model, prediction FROM preds"""

SMP_ONLY = """smp AS (SELECT id FROM qa WHERE s IS NOT NULL
        ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id LIMIT 100)"""

ASSIGN_CTE = f"""{QA_CTE}, {SMP_ONLY},
mdl AS (SELECT unnest(['echo', 'drop_first', 'leak', 'empty']) AS model),
ar AS (SELECT smp.id, mdl.model FROM smp CROSS JOIN mdl),
lab AS (SELECT id, model,
          'Q' || CAST(row_number() OVER (PARTITION BY id ORDER BY
                 md5(concat('42:', CAST(id AS VARCHAR), ':', model))) AS VARCHAR) AS label FROM ar),
rev AS (SELECT id, ntile(5) OVER (ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id) AS reviewer FROM smp),
asg AS (SELECT lab.id, lab.model, lab.label, CAST(rev.reviewer AS BIGINT) AS reviewer
        FROM lab JOIN rev ON lab.id = rev.id)"""

SQL["q45_blind_assignment"] = f"""
WITH {ASSIGN_CTE}
SELECT * FROM asg"""

SQL["q46_human_scores"] = f"""
WITH {ASSIGN_CTE},
sc AS (SELECT a.id, a.label, a.reviewer,
         least(5, 1 + 2 * l.quality + (1 - l.toxic)
                  + ('0x' || substr(md5(concat('42:', CAST(a.id AS VARCHAR), ':', a.label)), 1, 7))::BIGINT % 2)
           AS score
       FROM asg a JOIN labels l ON l.doc_id = a.id)
SELECT a.model, round(avg(sc.score), 6) AS avg_score, count(*) AS n
FROM sc JOIN asg a ON sc.id = a.id AND sc.label = a.label GROUP BY a.model"""

WORD_LIST = ("CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE string_split_regex({t}, '\\s+') END")


def word_list(x):
    return WORD_LIST.format(t=TRIM_WS.format(x=x))


SQL["q47_question_words"] = f"""
WITH {QA_CTE},
w AS (SELECT lower(({word_list('question')})[1]) AS word FROM qa WHERE s IS NOT NULL),
c AS (SELECT word, count(*) AS n FROM w GROUP BY word)
SELECT word, n, round(n / sum(n) OVER (), 6) AS share FROM c"""

SQL["q48_length_profile"] = f"""
WITH {QA_CTE}, {MODELS_CTE},
b AS (SELECT p.id, qa.title, p.model, p.prediction FROM preds p JOIN qa ON p.id = qa.id
      UNION ALL SELECT id, title, 'reference', question FROM qa WHERE s IS NOT NULL)
SELECT model, count(*) AS n, round(avg(len({word_list('prediction')})), 6) AS avg_words,
       count(DISTINCT title) AS n_titles
FROM b GROUP BY model"""

SQL["q49_vocab_richness"] = f"""
WITH {eval_ctes()},
g1 AS (SELECT model, unnest({ngram_expr('pt', 1)}) AS g FROM tk),
g2 AS (SELECT model, unnest({ngram_expr('pt', 2)}) AS g FROM tk),
a1 AS (SELECT model, count(DISTINCT g) AS d, count(*) AS n FROM g1 GROUP BY model),
a2 AS (SELECT model, count(DISTINCT g) AS d, count(*) AS n FROM g2 GROUP BY model),
mm AS (SELECT DISTINCT model FROM tk)
SELECT mm.model, coalesce(a1.n, 0) AS n_grams1, round(a1.d / a1.n, 6) AS distinct1,
       coalesce(a2.n, 0) AS n_grams2, round(a2.d / a2.n, 6) AS distinct2
FROM mm LEFT JOIN a1 ON mm.model = a1.model LEFT JOIN a2 ON mm.model = a2.model"""

SQL["q50_best_model_per_item"] = f"""
WITH {eval_ctes()}, {overlap_ctes('r1', ngram_expr('pt', 1), ngram_expr('rt', 1), 'rouge1', False)},
w AS (SELECT id, model, rouge1_f,
             row_number() OVER (PARTITION BY id ORDER BY rouge1_f DESC, model ASC) AS rn FROM r1)
SELECT id, model AS winner, round(rouge1_f, 6) AS score FROM w WHERE rn = 1"""

SQL["q51_stream_scores"] = f"""
WITH {eval_ctes()}, {overlap_ctes('r1', ngram_expr('pt', 1), ngram_expr('rt', 1), 'rouge1', False)}
SELECT model, count(*) AS n, round(avg(rouge1_f), 6) AS rouge1_mean FROM r1 GROUP BY model"""

SQL["q52_apply_model"] = f"""
WITH {PROMPTS_CTE}
SELECT id, concat('question> ', {TRIM_WS.format(x="string_split(inputs, '<answer>')[2]")}, ' question>') AS prediction
FROM p"""

SQL["q53_json_roundtrip"] = f"""
WITH {QA_CTE}, {MODELS_CTE}
SELECT id, model, prediction FROM preds"""

SQL["q53b_parallel_arrays"] = f"""
WITH {eval_ctes()}, {SMP_ONLY}
SELECT row_number() OVER (ORDER BY id) - 1 AS row_idx, id, prediction, reference AS target
FROM ev WHERE model = 'echo' AND id IN (SELECT id FROM smp)"""

SQL["q53c_json_array"] = f"""
WITH {QA_CTE}, {MODELS_CTE}, {SMP_ONLY}
SELECT p.id, q.context, q.answer,
  max(CASE WHEN model = 'echo' THEN prediction END) AS echo,
  max(CASE WHEN model = 'drop_first' THEN prediction END) AS drop_first,
  max(CASE WHEN model = 'leak' THEN prediction END) AS leak,
  max(CASE WHEN model = 'empty' THEN prediction END) AS empty
FROM preds p JOIN qa q ON p.id = q.id
WHERE p.id IN (SELECT id FROM smp)
GROUP BY p.id, q.context, q.answer"""

SQL["q53d_metrics_doc"] = f"""
WITH {eval_ctes()},
{overlap_ctes('r1', ngram_expr('pt', 1), ngram_expr('rt', 1), 'rouge1', False)},
{overlap_ctes('r2', ngram_expr('pt', 2), ngram_expr('rt', 2), 'rouge2', False)},
a AS (SELECT model, count(*) AS n, round(avg(rouge1_f), 6) AS rouge1_f, round(avg(rouge2_f), 6) AS rouge2_f
      FROM r1 JOIN r2 USING (id, model) GROUP BY model)
SELECT *, rank() OVER (ORDER BY rouge1_f DESC) AS rank FROM a"""

_PK = ("qid", "pos_i", "pos_j")
SQL["q32b_rouge_long_answers"] = f"""
WITH {FORUM_CTE},
lt AS (SELECT qid, pos_i, pos_j, {TOK.format(x='response_k')} AS pt, {TOK.format(x='response_j')} AS rt FROM pairs),
{overlap_ctes('l1', ngram_expr('pt', 1), ngram_expr('rt', 1), 'rouge1', True, _PK, 'lt')},
{overlap_ctes('l2', ngram_expr('pt', 2), ngram_expr('rt', 2), 'rouge2', True, _PK, 'lt')}
SELECT * FROM l1 JOIN l2 USING (qid, pos_i, pos_j)"""

# ---------------------------------------------------------------- records by split, instruction prompt, pair estimate
SQL["q01b_prompt_split"] = SQL["q01_prompt_answer_aware"] + """
  AND ('0x' || substr(md5(concat('42:', CAST(id AS VARCHAR))), 1, 7))::BIGINT % 10 = 8"""

SQL["q07c_prompt_instruction"] = f"""
WITH {QA_CTE}
SELECT id, title,
  concat('<s>' || chr(10) || '[INST] ' || chr(10), '{CAUSAL_SYSTEM}', '. [\\INST]<ctx> ', {hl()}, ' <ctx> <ans> ', answer,
         ' <ans> <question> ', question, ' <question> ' || chr(10) || '<\\s>') AS text
FROM qa WHERE s IS NOT NULL"""

SQL["q19b_expected_pairs"] = f"""
WITH {FORUM_CTE},
na AS (SELECT qid, count(*) AS n, row_number() OVER (ORDER BY md5(concat('42:', CAST(qid AS VARCHAR))), qid) AS rn FROM pb GROUP BY qid),
np AS (SELECT qid, count(*) AS n_pairs FROM pairs GROUP BY qid),
st AS (SELECT CASE WHEN rn <= 30 THEN 'finetune' WHEN rn <= 60 THEN 'reward' WHEN rn <= 90 THEN 'rl' ELSE 'evaluation' END AS split,
              n * n / 2.0 AS half_sq, coalesce(n_pairs, 0) AS n_pairs FROM na LEFT JOIN np USING (qid))
SELECT split, count(*) AS n_questions, round(avg(half_sq), 6) AS mean_half_sq, round(avg(n_pairs), 6) AS mean_pairs,
       CAST(sum(n_pairs) AS BIGINT) AS n_pairs, CAST(sum(least(n_pairs, 10)) AS BIGINT) AS n_capped
FROM st GROUP BY split"""

# ---------------------------------------------------------------- ranks, wins, stored scores
_R12 = f"""{eval_ctes()},
{overlap_ctes('r1', ngram_expr('pt', 1), ngram_expr('rt', 1), 'rouge1', False)},
{overlap_ctes('r2', ngram_expr('pt', 2), ngram_expr('rt', 2), 'rouge2', False)}"""

SQL["q30b_metric_ranks"] = f"""
WITH {_R12},
a AS (SELECT model, count(*) AS n, round(avg(rouge1_p), 6) AS rouge1_p, round(avg(rouge1_r), 6) AS rouge1_r,
             round(avg(rouge1_f), 6) AS rouge1_f, round(avg(rouge2_f), 6) AS rouge2_f FROM r1 JOIN r2 USING (id, model) GROUP BY model)
SELECT *, rank() OVER (ORDER BY rouge1_p DESC) AS rouge1_p_rank, rank() OVER (ORDER BY rouge1_r DESC) AS rouge1_r_rank,
       rank() OVER (ORDER BY rouge1_f DESC) AS rouge1_f_rank, rank() OVER (ORDER BY rouge2_f DESC) AS rouge2_f_rank FROM a"""

SQL["q50b_win_counts"] = f"""
WITH {eval_ctes()}, {overlap_ctes('r1', ngram_expr('pt', 1), ngram_expr('rt', 1), 'rouge1', True)},
b AS (SELECT id, max(rouge1_f) AS best FROM r1 GROUP BY id),
t AS (SELECT r1.id, count(*) AS k FROM r1 JOIN b ON r1.id = b.id AND r1.rouge1_f = b.best GROUP BY r1.id)
SELECT model, count(*) AS n_items, count(*) FILTER (rouge1_f = best AND k = 1) AS wins, count(*) FILTER (rouge1_f = best AND k > 1) AS ties,
       round(avg(CASE WHEN rouge1_f = best THEN 1.0::DOUBLE / k ELSE 0.0 END), 6) AS win_share
FROM r1 JOIN b USING (id) JOIN t USING (id) GROUP BY model"""

SQL["q53e_scores_doc"] = f"""
WITH {_R12}
SELECT id, model, ev.prediction, ev.reference AS target, round(rouge1_f, 6) AS rouge1_f, round(rouge2_f, 6) AS rouge2_f
FROM r1 JOIN r2 USING (id, model) JOIN ev USING (id, model) WHERE model IN ('drop_first', 'leak')"""

# ---------------------------------------------------------------- text rules, turns, records
SQL["q38b_code_languages"] = """
WITH c AS (SELECT page_id, regexp_extract_all(html, '<[A-Za-z][^<>]*?\\sclass="([^"<>]*)"', 1) AS cs FROM pages),
e AS (SELECT page_id, unnest(range(0, len(cs))) AS pos, cs FROM c),
f AS (SELECT page_id, pos, cs[pos + 1] AS class, regexp_extract(cs[pos + 1], '[^ \\t\\n\\f\\r]+') AS first FROM e)
SELECT page_id, pos, class, CASE WHEN first <> '' THEN string_split(first, '-')[-1] END AS language FROM f"""

_SPACE = "[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
SQL["q38c_blank_lines"] = f"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '\\n{_SPACE}*\\n', chr(10) || chr(10), 'g'),
                               '^{_SPACE}+|{_SPACE}+$', '', 'g') AS text FROM pages"""

SQL["q47b_turn_words"] = f"""
WITH w AS (SELECT lower(({word_list('text')})[1]) AS word FROM conversations WHERE role = 'user'),
c AS (SELECT word, count(*) AS n FROM w GROUP BY word)
SELECT word, n, round(n / sum(n) OVER (), 6) AS share FROM c"""

SQL["q53f_json_records"] = f"""
WITH {QA_CTE}
SELECT id, context, question, answer, s AS answer_start FROM qa"""

SQL["q53g_review_sample"] = f"""
WITH {QA_CTE}, {SMP_ONLY}
SELECT id, context, question, answer, s AS answer_start FROM qa WHERE id IN (SELECT id FROM smp)"""
