"""Record types of the reference derived, by fixed rules, from the driver
tables (see FIXTURES.md section 3).  Every rule is row-local or a bounded
top-k per group, so the derived tables grow with the inputs.

FIXED VALUES of the derivation (shared with the DuckDB oracle):
  question word by doc_id % 5: 0 what, 1 who, 2 when, 3 where, 4 how
  question text: word + " " + the words of the document's first sentence + "?";
                 the sentence ends before the first . ? ! or newline, and a
                 word that repeats the one before it is left out
  unanswerable: doc_id % 7 = 0 (a null id is unanswerable, its question word how)
  answer_start = n_chars div 3; answer = the character there and the rest of
                 its run of characters that are not white space
  preferences: question = source, answers = its documents by doc_id,
               pm_score = n_chars % 5
  forum records: question = conversation, answers = its turns in order,
               pm_score = length(text) % 5
  stub models: echo = "question> " + q + " question>",
               drop_first = q without its first word,
               leak = q + " " + answer, empty = ""
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUESTION_WORDS = ("what", "who", "when", "where", "how")
MODELS = ("echo", "drop_first", "leak", "empty")


def _start():
    return F.floor(F.col("n_chars") / 3).cast("int")


def _answerable():
    return F.pmod(F.col("doc_id"), F.lit(7)) != 0


def _first_sentence():
    """Words of the first sentence, those that repeat their predecessor left out."""
    words = F.split(F.regexp_extract(F.coalesce("text", F.lit("")), r"[^\n.?!]*", 0), r"[ \t\x0B\f\r]+")
    fresh = F.zip_with(words, F.concat(F.array(F.lit("")), words), lambda w, before: F.when(w != before, w))
    return F.array_join(F.filter(fresh, lambda w: w != ""), " ")


def qa_from_documents(documents: DataFrame) -> DataFrame:
    """QA records ``id, title, context, question, answers{text, answer_start}``,
    one per document, each made of that document alone.

    Every field of ``answers`` has its own condition, so a caller that needs
    ids or starts reads no text."""
    start = _start()
    ans = F.regexp_extract(F.substr(F.col("text"), start + 1), r"(?s)^.[^ \t\n\x0B\f\r]*", 0)
    answers = F.struct(
        F.when(_answerable(), F.array(ans)).otherwise(F.array().cast("array<string>")).alias("text"),
        F.when(_answerable(), F.array(start)).otherwise(F.array().cast("array<int>")).alias("answer_start"))
    word = F.element_at(F.array(*[F.lit(w) for w in QUESTION_WORDS]),
                        (F.coalesce(F.pmod(F.col("doc_id"), F.lit(5)), F.lit(4)) + 1).cast("int"))
    return documents.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("context"),
                            F.concat(word, F.lit(" "), _first_sentence(), F.lit("?")).alias("question"), answers.alias("answers"))


def preference_answers(documents: DataFrame) -> DataFrame:
    """Flat preference answers ``qid, pos, doc_id, text, pm_score``: all
    documents of a source by doc_id.

    Positions are a dense index within the source, built from the index over
    (source, doc_id) and each source's first position, so a source that holds a
    third of all rows is no single task's work; texts stay out of it."""
    from qforge.operators.index import with_row_index
    keys = documents.select("source", "doc_id")
    idx = with_row_index(keys, ["source", "doc_id"], "_i")
    first = idx.groupBy(F.col("source").alias("_s")).agg(F.min("_i").alias("_first"))
    pos = idx.join(first, F.col("source").eqNullSafe(F.col("_s"))) \
        .select(F.col("source").alias("qid"), "doc_id", (F.col("_i") - F.col("_first") + 1).cast("bigint").alias("pos"))
    facts = documents.select("doc_id", "text", F.pmod("n_chars", F.lit(5)).cast("int").alias("pm_score"))
    return pos.join(facts, "doc_id").select("qid", "pos", "doc_id", "text", "pm_score")


def conversation_answers(conversations: DataFrame) -> DataFrame:
    """Flat forum answers ``qid, pos, text, pm_score``: the turns of a conversation."""
    return conversations.select(F.col("conv_id").alias("qid"), (F.col("turn") + 1).cast("bigint").alias("pos"), "text",
                                F.pmod(F.length("text"), F.lit(5)).cast("int").alias("pm_score"))


def preference_records(conversations: DataFrame) -> DataFrame:
    """Nested forum records ``qid, question, date, metadata, answers`` in the
    shape of the reference's corpus (answers kept in position order)."""
    return (conversation_answers(conversations).groupBy("qid")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "text", "pm_score"))).alias("a"))
            .select("qid", F.concat(F.lit("conversation "), F.col("qid")).alias("question"), F.lit(None).cast("string").alias("date"),
                    F.array().cast("array<string>").alias("metadata"),
                    F.transform("a", lambda x: F.struct(x["text"].alias("text"),
                                                        x["pm_score"].alias("pm_score"))).alias("answers")))


def stub_predictions(qa: DataFrame, models=MODELS, keep=()) -> DataFrame:
    """Long predictions ``id, model, prediction`` from deterministic stub
    models over the answerable QA rows (stand-ins for generated text); ``keep``
    names columns of ``qa`` that each row carries along."""
    q = F.col("question")
    a = F.get(F.col("answers.text"), 0)
    exprs = {
        "echo": F.concat(F.lit("question> "), q, F.lit(" question>")),
        "drop_first": F.substr(q, F.instr(q, " ") + 1, F.greatest(F.length(q), F.lit(1))),
        "leak": F.concat(q, F.lit(" "), a),
        "empty": F.lit(""),
    }
    arr = F.array(*[F.struct(F.lit(m).alias("model"), exprs[m].alias("prediction")) for m in models])
    return (qa.where(F.size("answers.answer_start") > 0)
            .select("id", *keep, F.inline(arr)))


def token_vectors(embeddings: DataFrame, tokens: DataFrame) -> DataFrame:
    """``token, vec ARRAY<DOUBLE>``: the caller's token-vector table.  Stands in
    for an encoder: each distinct token of ``tokens`` has the embedding whose
    ``vec_id`` is 28 bits of its md5 modulo the number of embeddings."""
    n = max(1, embeddings.count())
    bucket = F.pmod(F.conv(F.substr(F.md5("token"), F.lit(1), F.lit(7)), 16, 10).cast("bigint"), F.lit(n))
    return (tokens.select("token").distinct().withColumn("vec_id", bucket).join(embeddings.select("vec_id", "embedding"), "vec_id")
            .select("token", F.col("embedding").cast("array<double>").alias("vec")))
