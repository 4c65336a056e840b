"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each reads the driver tables (or data Spark derives from them) whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from qforge.operators import prompts as P
from qforge.sources import fixtures as FX
from qforge.sources.tables import read_table

REGISTRY = {}


def query(name):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _qa(spark, sf):
    return FX.qa_from_documents(read_table(spark, sf, "documents"))


def _qa_ids(spark, sf):
    """Answerable records whose callers read ids and titles only."""
    return _answerable(FX.qa_from_documents(read_table(spark, sf, "documents")))


@query("q01_prompt_answer_aware")
def q01(spark, sf):
    return P.qa_prompts(_qa(spark, sf))


@query("q01b_prompt_split")
def q01b(spark, sf):
    """Records stored by split; prompts of the validation split's answerable ones."""
    from qforge.operators.index import hash_split
    from qforge.session import scratch_path
    from qforge.sources.tables import read_qa, write_qa
    path = scratch_path(spark, "qa")
    write_qa(hash_split(_qa(spark, sf), "id", 42), path)
    return P.qa_prompts(read_qa(spark, path, split="validation", unanswerable=False))


def _answerable(df):
    return df.where(F.size("answers.answer_start") > 0)


# ------------------------------------------------------------------ prompts
@query("q02_prompt_no_highlight")
def q02(spark, sf):
    return P.qa_prompts(_qa(spark, sf), use_highlight=False)


@query("q03_prompt_zero_shot")
def q03(spark, sf):
    return P.qa_prompts(_qa(spark, sf), zero_shot=True)


@query("q04_prompt_rl")
def q04(spark, sf):
    return P.rl_prompts(_qa(spark, sf))


@query("q05_prompt_causal_train")
def q05(spark, sf):
    return P.causal_train_prompts(_qa(spark, sf))


@query("q06_prompt_causal_eval")
def q06(spark, sf):
    return P.causal_eval_prompts(_qa(spark, sf))


@query("q07_prompt_qa")
def q07(spark, sf):
    conv = read_table(spark, sf, "conversations").where(F.col("role") == "user")
    out = P.plain_qa_prompts(conv, "text", add_lower=True)
    return out.select("conv_id", "turn", "prompt", "preview", "prompt_lower")


@query("q07b_prompt_report")
def q07b(spark, sf):
    return P.report_prompts(_qa(spark, sf))


@query("q07c_prompt_instruction")
def q07c(spark, sf):
    return P.instruction_prompts(_qa(spark, sf))


@query("q08_span_check")
def q08(spark, sf):
    return P.span_check(_qa(spark, sf))


# ------------------------------------------------------------------ positions, samples, splits
@query("q09_position_slice")
def q09(spark, sf):
    from qforge.operators.index import position_slice
    qa = _qa_ids(spark, sf).select("id", "title")
    return position_slice(qa, ["id"], 100, 600)


@query("q09b_row_at")
def q09b(spark, sf):
    from qforge.operators.index import row_at
    return row_at(_qa_ids(spark, sf).select("id", "title"), ["id"], 123)


@query("q10_seeded_sample")
def q10(spark, sf):
    from qforge.operators.index import seeded_sample
    qa = _answerable(_qa(spark, sf)).select("id", "title", "question")
    return seeded_sample(qa, "id", 100, seed=42)


SPLIT_CUTS = [("finetune", 300), ("reward", 300), ("rl", 300), ("evaluation", None)]


def _doc_splits(spark, sf, cols=("doc_id", "source", "text")):
    from qforge.operators.index import named_splits, seeded_order
    docs = read_table(spark, sf, "documents").select(*cols)
    return named_splits(docs, seeded_order("doc_id", 42), SPLIT_CUTS, seed_key="doc_id", seed=42)


@query("q11_named_splits")
def q11(spark, sf):
    return _doc_splits(spark, sf, ("doc_id",)).select("doc_id", "split", "row_idx")


@query("q12_holdout_fraction")
def q12(spark, sf):
    from qforge.operators.index import hash_split, holdout_split
    docs = read_table(spark, sf, "documents").select("doc_id")
    h = holdout_split(docs, "doc_id", 0.05, 42).withColumnRenamed("split", "holdout")
    return hash_split(h, "doc_id", 42).withColumnRenamed("split", "hash_split")


@query("q13_batches")
def q13(spark, sf):
    from qforge.operators.index import batches, seeded_order
    qa = _qa_ids(spark, sf).select("id")
    return batches(qa, seeded_order("id", 42), 16, seed_key="id", seed=42)


def _fixed_sample_ids(spark, sf, k=100):
    from qforge.operators.index import seeded_sample
    qa = _qa_ids(spark, sf).select("id")
    return seeded_sample(qa, "id", k, seed=42)


@query("q14_fixed_sample_semi")
def q14(spark, sf):
    preds = FX.stub_predictions(_qa(spark, sf))
    # the sample is bounded by k (100 ids): broadcasting it is safe at any scale
    return preds.join(F.broadcast(_fixed_sample_ids(spark, sf)), "id", "left_semi")


@query("q15_overlap_anti")
def q15(spark, sf):
    train = _qa_ids(spark, sf).select("id", "title")
    return train.join(F.broadcast(_fixed_sample_ids(spark, sf)), "id", "left_anti")


# ------------------------------------------------------------------ preference pairs
def _pref_answers(spark, sf):
    return FX.preference_answers(read_table(spark, sf, "documents"))


def _forum_answers(spark, sf):
    return FX.conversation_answers(read_table(spark, sf, "conversations"))


@query("q16_pref_pairs")
def q16(spark, sf):
    from qforge.operators.prefs import pairs
    return pairs(_forum_answers(spark, sf))


@query("q17_pref_pairs_capped")
def q17(spark, sf):
    from qforge.operators.prefs import capped_pairs
    return capped_pairs(_pref_answers(spark, sf), 10, 42)


@query("q17b_pref_pipeline")
def q17b(spark, sf):
    """The forum pipeline end to end: nested records -> named splits of the
    questions -> ordered pairs -> seeded cap of 10; every input column except
    ``answers`` is kept."""
    from qforge.operators.index import named_splits, seeded_order
    from qforge.operators.prefs import pairs_from_records
    rec = FX.preference_records(read_table(spark, sf, "conversations"))
    cuts = [("finetune", 30), ("reward", 30), ("rl", 30), ("evaluation", None)]
    rec = named_splits(rec, seeded_order("qid", 42), cuts, seed_key="qid", seed=42).drop("row_idx")
    out = pairs_from_records(rec, max_pairs=10, seed=42)
    return out.select("qid", "question", "date", F.size("metadata").alias("n_metadata"), "split", "pos_i", "pos_j",
                      "response_j", "response_k", "score_j", "score_k")


@query("q18_best_worst")
def q18(spark, sf):
    from qforge.operators.prefs import best_worst
    return best_worst(_pref_answers(spark, sf))


@query("q19_pair_stats")
def q19(spark, sf):
    from qforge.operators.prefs import pair_stats
    return pair_stats(_pref_answers(spark, sf), 10)


@query("q19b_expected_pairs")
def q19b(spark, sf):
    """Expected against exact pairs a question, per split of the questions."""
    from qforge.operators.index import named_splits, seeded_order
    from qforge.operators.prefs import expected_pairs, pair_stats
    stats = pair_stats(_forum_answers(spark, sf), 10)
    cuts = [("finetune", 30), ("reward", 30), ("rl", 30), ("evaluation", None)]
    return expected_pairs(named_splits(stats, seeded_order("qid", 42), cuts, seed_key="qid", seed=42), "split")


@query("q20_shard_plan")
def q20(spark, sf):
    from qforge.sources.sinks import shard_plan
    from qforge.operators.index import named_splits, seeded_order
    from qforge.sources.sinks import estimated_bytes
    docs = read_table(spark, sf, "documents")
    # bytes are taken in the scan: no text crosses the split's shuffle
    sized = docs.select("doc_id", estimated_bytes(docs, ["doc_id", "source", "text"]).alias("_bytes"))
    split = named_splits(sized, seeded_order("doc_id", 42), SPLIT_CUTS, seed_key="doc_id", seed=42)
    planned = shard_plan(split, ["row_idx"], "split", shard_bytes=1 << 18, position_col="row_idx")
    return (planned.groupBy("split", "shard", "num_shards", "file_name")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_idx").alias("first_row"),
                 F.max("row_idx").alias("last_row")))


@query("q20b_named_shards")
def q20b(spark, sf):
    """Shards written under their names and read back by the manifest."""
    from qforge.operators.index import named_splits, seeded_order
    from qforge.session import scratch_path
    from qforge.sources.sinks import estimated_bytes, read_shards, shard_plan, write_shards
    docs = read_table(spark, sf, "documents").select("doc_id", "source", "text")
    sized = docs.select("doc_id", estimated_bytes(docs, docs.columns).alias("_bytes"))
    split = named_splits(sized, seeded_order("doc_id", 42), SPLIT_CUTS, seed_key="doc_id", seed=42)
    planned = shard_plan(split, ["row_idx"], "split", shard_bytes=1 << 18, position_col="row_idx")
    path = scratch_path(spark, "shards")
    write_shards(planned.join(docs, "doc_id"), path)
    return (read_shards(spark, path).groupBy("split", "file_name")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"),
                 F.sum(F.length("text")).alias("n_chars")))


# ------------------------------------------------------------------ evaluation: cleanup, extraction
def _preds(spark, sf):
    return FX.stub_predictions(_qa(spark, sf))


def _eval(spark, sf, cleanup="eval"):
    from qforge.operators.evaluate import eval_frame
    qa = _qa(spark, sf)
    return eval_frame(FX.stub_predictions(qa), P.rl_prompts(qa), cleanup)


@query("q21_clean_eval")
def q21(spark, sf):
    return _eval(spark, sf, "eval").select("id", "model", F.col("prediction").alias("prediction_clean"),
                                           F.col("reference").alias("target_clean"))


@query("q22_clean_reward")
def q22(spark, sf):
    return _eval(spark, sf, "reward").select("id", "model", F.col("prediction").alias("prediction_clean"),
                                             F.col("reference").alias("target_clean"))


@query("q23_extract_completion")
def q23(spark, sf):
    from qforge.functions.text import extract_completion
    ev = P.causal_eval_prompts(_qa(spark, sf))
    completion = F.concat(F.col("text"), F.lit(" "), F.col("question"), F.lit(" Yes? ok"))
    return ev.select("id", extract_completion(completion).alias("prediction"))


@query("q24_extract_answer")
def q24(spark, sf):
    from qforge.functions.text import extract_answer
    conv = read_table(spark, sf, "conversations").where(F.col("role") == "assistant")
    rep = F.concat(F.lit("['### Question: q ### Answer: "),
                   F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"')),
                   F.lit("']"))
    return conv.select("conv_id", "turn", extract_answer(rep).alias("answer_text"))


# ------------------------------------------------------------------ ROUGE
def _scored(spark, sf, cleanup="eval"):
    """The evaluation frame, ready for scores of each row."""
    from qforge.operators.evaluate import spread
    return spread(_eval(spark, sf, cleanup), "id", "model")


def _stored(spark, sf, cleanup="eval"):
    """The evaluation frame written once for the several passes over it, dealt by
    question: the models' texts share most tokens."""
    from qforge.operators.evaluate import spread
    from qforge.session import scratch_path
    frame, path = _eval(spark, sf, cleanup), scratch_path(spark, "eval")
    frame.write.parquet(path)
    return spread(spark.read.schema(frame.schema).parquet(path), "id")


def _rouge(spark, sf, metrics, ndigits=6):
    from qforge.operators.rouge import rouge_scores
    return rouge_scores(_scored(spark, sf), ["id", "model"], metrics=metrics, ndigits=ndigits)


@query("q25_rouge1")
def q25(spark, sf):
    return _rouge(spark, sf, ("rouge1",))


@query("q26_rouge2")
def q26(spark, sf):
    return _rouge(spark, sf, ("rouge2",))


@query("q27_rougeL")
def q27(spark, sf):
    return _rouge(spark, sf, ("rougeL",))


@query("q28_rougeLsum")
def q28(spark, sf):
    return _rouge(spark, sf, ("rougeLsum",))


@query("q29_rougeS")
def q29(spark, sf):
    return _rouge(spark, sf, ("rougeS",))


def _vectors(spark, sf, rows):
    """The token-vector table of the tokens in ``rows``, stored as a caller's would be."""
    from qforge.session import scratch_path
    tokens = rows.select(F.explode(F.array_union("pred_tokens", "ref_tokens")).alias("token"))
    table = FX.token_vectors(read_table(spark, sf, "embeddings"), tokens)
    path = scratch_path(spark, "token-vectors")
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def _all_scores(spark, sf):
    """Per (id, model): ROUGE-1/2/L/S and the embedding score, one frame."""
    from qforge.operators.bertscore import bertscore
    from qforge.operators.rouge import rouge_scores, with_tokens
    ev = _stored(spark, sf)
    mets = ("rouge1", "rouge2", "rougeL", "rougeS")
    r = rouge_scores(ev, ["id", "model"], metrics=mets, ndigits=None, keep=("pred_tokens", "ref_tokens"))
    # one pass: the embedding score is a per-row column over the same frame
    return bertscore(r, ["id", "model"], _vectors(spark, sf, with_tokens(ev)), ndigits=None,
                     passthrough=[f"{m}_f" for m in mets], near=["id"])


@query("q30_rouge_summary")
def q30(spark, sf):
    from qforge.operators.summary import leaderboard
    return leaderboard(_all_scores(spark, sf), "model",
                       ["rouge1_f", "rouge2_f", "rougeL_f", "rougeS_f", "bert_f"], rank_by="rouge1_f")


@query("q30b_metric_ranks")
def q30b(spark, sf):
    from qforge.operators.summary import leaderboard, metric_ranks
    mets = ["rouge1_p", "rouge1_r", "rouge1_f", "rouge2_f"]
    board = leaderboard(_rouge(spark, sf, ("rouge1", "rouge2"), ndigits=None), "model", mets, rank_by="rouge1_f")
    return metric_ranks(board.drop("rank"), mets)


@query("q31_rouge_bootstrap")
def q31(spark, sf):
    from qforge.operators.summary import bootstrap_rows
    s = _rouge(spark, sf, ("rouge1",), ndigits=None)
    return bootstrap_rows(s, "model", "id", "rouge1_f", n_samples=1000, seed=42)


@query("q32_running_mean")
def q32(spark, sf):
    from qforge.operators.index import running_mean
    s = _rouge(spark, sf, ("rouge1",), ndigits=None)
    out = running_mean(s, "rouge1_f", "model", "id", "running_mean")
    return out.select("id", "model", F.round("running_mean", 6).alias("running_mean"))


@query("q32b_rouge_long_answers")
def q32b(spark, sf):
    """ROUGE-1/2 of a long generated answer against the preferred answer
    (whole texts; the worse answer of each pair stands in for a model
    answer), by the exploded, linear-time method."""
    from qforge.operators.prefs import pairs
    from qforge.operators.rouge import rouge_scores
    p = pairs(_forum_answers(spark, sf)).select(
        "qid", "pos_i", "pos_j", F.col("response_k").alias("prediction"), F.col("response_j").alias("reference"))
    return rouge_scores(p, ["qid", "pos_i", "pos_j"], metrics=("rouge1", "rouge2"), method="exploded")


@query("q33_bertscore")
def q33(spark, sf):
    from qforge.operators.bertscore import bertscore
    from qforge.operators.rouge import with_tokens
    ev = with_tokens(_stored(spark, sf))
    return bertscore(ev, ["id", "model"], _vectors(spark, sf, ev), near=["id"])


# ------------------------------------------------------------------ reward
def _reward_rows(spark, sf, cfg_name="code", ndigits=6):
    from qforge.operators import reward as RW
    from qforge.operators.bertscore import bertscore
    from qforge.operators.rouge import with_tokens
    cfg = RW.CODE if cfg_name == "code" else RW.PAPER
    ev = with_tokens(_stored(spark, sf, "reward"))
    j = bertscore(ev, ["id", "model"], _vectors(spark, sf, ev), ndigits=None,
                  passthrough=["prediction", "reference", "answer"], near=["id"])
    t = RW.reward_terms("prediction", "reference", "answer", cfg)
    return j.select("id", "model", F.round("bert_f", 6).alias("bert_f"),
                    RW.leaked("prediction", "answer").alias("leak"),
                    (t["word"] > 0).alias("word_match"),
                    (t["length"] < 0).alias("long_text"),
                    (F.round(RW.reward("bert_f", "prediction", "reference", "answer", cfg), ndigits)
                     if ndigits is not None else
                     RW.reward("bert_f", "prediction", "reference", "answer", cfg)).alias("reward"))


@query("q34_reward_code")
def q34(spark, sf):
    return _reward_rows(spark, sf, "code")


@query("q35_reward_paper")
def q35(spark, sf):
    return _reward_rows(spark, sf, "paper")


@query("q36_reward_by_batch")
def q36(spark, sf):
    from qforge.operators.index import batches, seeded_order
    b = batches(_qa_ids(spark, sf).select("id"), seeded_order("id", 42), 16, seed_key="id", seed=42)
    r = _reward_rows(spark, sf, "code", ndigits=None)
    return (r.join(b, "id").groupBy("model", "batch_id")
            .agg(F.round(F.avg("reward"), 6).alias("mean_reward"), F.count(F.lit(1)).alias("n")))


@query("q37_term_rates")
def q37(spark, sf):
    r = _reward_rows(spark, sf, "code", ndigits=None)
    return r.groupBy("model").agg(
        F.round(F.avg(F.col("leak").cast("int")), 6).alias("leak_rate"),
        F.round(F.avg(F.col("word_match").cast("int")), 6).alias("word_match_rate"),
        F.round(F.avg(F.col("long_text").cast("int")), 6).alias("long_rate"),
        F.round(F.avg("reward"), 6).alias("mean_reward"),
        F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ HTML to Markdown
@query("q38_html_markdown")
def q38(spark, sf):
    from qforge.functions.markdown import html_to_markdown
    pages = read_table(spark, sf, "pages")
    md = pages.select("page_id", "url", html_to_markdown("html").alias("markdown"))
    return md.select("page_id", "url", "markdown", F.length("markdown").cast("bigint").alias("md_chars"))


@query("q38b_code_languages")
def q38b(spark, sf):
    """The class attributes of each page in order, and the language each names."""
    from qforge.functions.text import class_attributes, code_language
    pages = read_table(spark, sf, "pages")
    each = pages.select("page_id", F.posexplode(class_attributes("html")).alias("pos", "class"))
    return each.select("page_id", F.col("pos").cast("bigint").alias("pos"), "class", code_language("class").alias("language"))


@query("q38c_blank_lines")
def q38c(spark, sf):
    """Pages with a line break for each tag, runs of blank lines collapsed,
    characters that cannot be encoded replaced."""
    from qforge.functions.text import collapse_blank_lines, make_valid
    lines = F.regexp_replace("html", "<[^>]*>", "\n")
    return read_table(spark, sf, "pages").select("page_id", make_valid(collapse_blank_lines(lines)).alias("text"))


# ------------------------------------------------------------------ vocabulary and encoding
def _prompts(spark, sf):
    return P.qa_prompts(_qa(spark, sf))


def _vocab(spark, sf):
    from qforge.operators.encode import build_vocab
    return build_vocab(_prompts(spark, sf), ["inputs", "target"])


@query("q39_vocab")
def q39(spark, sf):
    return _vocab(spark, sf)


@query("q40_encode")
def q40(spark, sf):
    from qforge.operators.encode import encode_columns
    pr = _prompts(spark, sf)
    enc = encode_columns(pr, "id", {"inputs": (512, "input_ids"), "target": (32, "labels")}, _vocab(spark, sf))
    return enc.select(
        "id", F.array_join("input_ids", " ").alias("input_ids"), F.array_join("labels", " ").alias("labels"),
        F.aggregate("input_ids_mask", F.lit(0).cast("bigint"), lambda a, m: a + m).alias("n_input_tokens"))


@query("q40b_pad_longest")
def q40b(spark, sf):
    """Batches of 16 in the seeded order, each padded to its longest row."""
    from qforge.operators.encode import encode_columns, pad_to_longest, ragged
    from qforge.operators.index import batches, seeded_order
    pr = _prompts(spark, sf)
    enc = encode_columns(pr, "id", {"inputs": (512, "input_ids")}, _vocab(spark, sf)) \
        .select("id", ragged("input_ids", "input_ids_mask").alias("input_ids"))
    ids = batches(_qa_ids(spark, sf).select("id"), seeded_order("id", 42), 16, seed_key="id", seed=42).select("id", "batch_id")
    rows = enc.join(ids, "id").withColumn("n_tokens", F.size("input_ids").cast("bigint"))
    return pad_to_longest(rows, "batch_id", "input_ids").select(
        "id", "batch_id", "width", "n_tokens", F.array_join("input_ids", " ").alias("input_ids"))


@query("q41_token_budget")
def q41(spark, sf):
    from qforge.operators.encode import token_budget
    return token_budget(_prompts(spark, sf), {"inputs": 512, "target": 32})


# ------------------------------------------------------------------ comparison
@query("q42_align_predictions")
def q42(spark, sf):
    from qforge.operators.evaluate import align
    qa = _qa(spark, sf)
    preds = FX.stub_predictions(qa, ("echo",)).select("id", "prediction")
    refs = qa.select("id", "question")
    return align(preds, refs, "id", "full_outer").select(
        "id", "prediction", "question", F.col("prediction").isNotNull().alias("has_prediction"))


@query("q43_wide_models")
def q43(spark, sf):
    from qforge.operators.compare import wide_models
    return wide_models(_preds(spark, sf), FX.MODELS)


@query("q44_long_models")
def q44(spark, sf):
    from qforge.operators.compare import long_models, read_models, wide_models, write_models
    from qforge.session import scratch_path
    path = scratch_path(spark, "models")
    write_models(_preds(spark, sf), path)
    stacked = read_models(spark, path, "id bigint, prediction string")
    return long_models(wide_models(stacked, FX.MODELS), FX.MODELS)


def _assignment(spark, sf):
    from qforge.operators.compare import blind_assignment
    return blind_assignment(_fixed_sample_ids(spark, sf), FX.MODELS, 5, 42)


@query("q45_blind_assignment")
def q45(spark, sf):
    return _assignment(spark, sf)


@query("q46_human_scores")
def q46(spark, sf):
    from qforge.operators.compare import human_scores, model_scores
    a = _assignment(spark, sf)
    s = human_scores(a, read_table(spark, sf, "labels"), 42)
    return model_scores(a, s)


@query("q47_question_words")
def q47(spark, sf):
    from qforge.operators.compare import question_words
    return question_words(_answerable(_qa(spark, sf)))


@query("q47b_turn_words")
def q47b(spark, sf):
    """The same distribution over what users of the given conversations ask."""
    from qforge.operators.compare import question_words
    return question_words(read_table(spark, sf, "conversations").where(F.col("role") == "user"), "text")


@query("q48_length_profile")
def q48(spark, sf):
    from qforge.operators.compare import length_profile
    qa = _answerable(_qa(spark, sf))
    preds = FX.stub_predictions(qa, keep=("title",))
    refs = qa.select("id", "title", F.lit("reference").alias("model"), F.col("question").alias("prediction"))
    both = preds.select("id", "title", "model", "prediction").unionByName(refs)
    return length_profile(both, "model", "prediction", "title")


@query("q49_vocab_richness")
def q49(spark, sf):
    from qforge.operators.compare import distinct_n
    return distinct_n(_eval(spark, sf), "model", "prediction")


@query("q50_best_model_per_item")
def q50(spark, sf):
    from qforge.operators.compare import best_model_per_item
    return best_model_per_item(_rouge(spark, sf, ("rouge1",), ndigits=None), "rouge1_f")


@query("q50b_win_counts")
def q50b(spark, sf):
    from qforge.operators.compare import win_counts
    return win_counts(_rouge(spark, sf, ("rouge1",)), "rouge1_f")


# ------------------------------------------------------------------ streaming, model application, JSON
@query("q51_stream_scores")
def q51(spark, sf):
    from qforge.session import scratch_path
    from qforge.streaming.scores import running_model_means
    qa = _qa(spark, sf)
    preds = FX.stub_predictions(qa)
    pred_dir = scratch_path(spark, "stream-in")
    preds.repartition(8, "id").write.mode("overwrite").parquet(pred_dir)       # files as they might arrive
    refs = P.qa_prompts(qa).select("id", "target")
    return running_model_means(spark, pred_dir, preds.schema, refs, scratch_path(spark, "stream-ckpt"), scratch_path(spark, "stream-out"))


@query("q52_apply_model")
def q52(spark, sf):
    from qforge.operators.infer import apply_model, echo_answer_model
    pr = _prompts(spark, sf).select("id", "inputs")
    return apply_model(pr, "inputs", echo_answer_model, "prediction", 64).select("id", "prediction")


@query("q53_json_roundtrip")
def q53(spark, sf):
    from qforge.session import scratch_path
    from qforge.sources.json_io import read_trailing_comma_lines, write_trailing_comma_lines
    path = scratch_path(spark, "json-lines")
    preds = _preds(spark, sf)
    write_trailing_comma_lines(preds, path)
    return read_trailing_comma_lines(spark, path, preds.schema)


@query("q53b_parallel_arrays")
def q53b(spark, sf):
    from qforge.session import scratch_path
    from qforge.sources.json_io import read_parallel_arrays, write_parallel_arrays
    path = scratch_path(spark, "json-doc")
    ev = _eval(spark, sf).where(F.col("model") == "echo")
    sample = ev.join(F.broadcast(_fixed_sample_ids(spark, sf)), "id", "left_semi")
    doc = sample.select("id", F.col("prediction").alias("predictions"), F.col("reference").alias("targets"))
    write_parallel_arrays(doc, "id", ["id", "predictions", "targets"], path)
    back = read_parallel_arrays(spark, path, ["id", "predictions", "targets"])
    return back.select("row_idx", "id", F.col("predictions").alias("prediction"),
                       F.col("targets").alias("target"))


@query("q53c_json_array")
def q53c(spark, sf):
    from qforge.operators.compare import wide_models
    from qforge.session import scratch_path
    from qforge.sources.json_io import read_json_array, write_json_array
    qa = _answerable(_qa(spark, sf))
    smp = _fixed_sample_ids(spark, sf)
    wide = wide_models(_preds(spark, sf).join(F.broadcast(smp), "id", "left_semi"), FX.MODELS)
    doc = wide.join(qa.select("id", "context", F.get(F.col("answers.text"), 0).alias("answer")), "id")
    path = scratch_path(spark, "json-array")
    write_json_array(doc, path)
    return read_json_array(spark, path, doc.schema)


def _metrics_doc(spark, sf):
    """Scores with their texts and the summary, stored; (path, schema of the scores, summary)."""
    from qforge.operators.rouge import rouge_scores
    from qforge.operators.summary import leaderboard
    from qforge.session import scratch_path
    from qforge.sources.sinks import write_scores
    scores = rouge_scores(_scored(spark, sf), ["id", "model"], metrics=("rouge1", "rouge2"), ndigits=None,
                          keep=("prediction", "reference"))
    path = scratch_path(spark, "metrics")
    summary = write_scores(scores, lambda s: leaderboard(s, "model", ["rouge1_f", "rouge2_f"], rank_by="rouge1_f"), path)
    return path, scores.schema, summary


@query("q53d_metrics_doc")
def q53d(spark, sf):
    return _metrics_doc(spark, sf)[2]


@query("q53e_scores_doc")
def q53e(spark, sf):
    """The stored scores of two of the models, with predictions and targets."""
    from qforge.sources.sinks import read_scores
    path, schema, _ = _metrics_doc(spark, sf)
    back = read_scores(spark, path, schema, models=["drop_first", "leak"])
    return back.select("id", "model", "prediction", F.col("reference").alias("target"),
                       F.round("rouge1_f", 6).alias("rouge1_f"), F.round("rouge2_f", 6).alias("rouge2_f"))


def _record_columns(records):
    return records.select("id", "context", "question", F.get("answers.text", 0).alias("answer"),
                          F.get("answers.answer_start", 0).cast("bigint").alias("answer_start"))


@query("q53f_json_records")
def q53f(spark, sf):
    """All records exported as JSON objects, one a line, and read back."""
    from qforge.session import scratch_path
    from qforge.sources.sinks import read_json_records, write_json_records
    records = _qa(spark, sf).select("id", "context", "question", "answers")
    path = scratch_path(spark, "json-records")
    write_json_records(records, path)
    return _record_columns(read_json_records(spark, path, records.schema))


@query("q53g_review_sample")
def q53g(spark, sf):
    """A seeded sample of 100 answerable records for review, read back."""
    from qforge.session import scratch_path
    from qforge.sources.sinks import read_json_records, review_sample
    qa = _answerable(_qa(spark, sf))
    path = scratch_path(spark, "review")
    review_sample(qa, path, 100, seed=42)
    return _record_columns(read_json_records(spark, path, qa.select("id", "context", "question", "answers").schema))
