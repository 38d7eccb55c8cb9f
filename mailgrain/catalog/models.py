"""Queries of sources, sinks, streaming and fitted models."""

from dataclasses import replace
from functools import partial, reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import headers as hd
from ..functions.policy import platt
from ..functions.privacy import redact
from ..functions.text import source_from_file_name
from ..models.rule_transformer import RuleFeatures
from ..models import text_model as tm
from ..operators import curves as cv
from ..operators import similarity as sim
from ..operators import splits as sp
from ..session import durable
from ..sources import archives as ar
from ..sources import corpora as co
from ..sources.folders import shared_folder
from ..streaming import scoring as st
from .registry import query
from .rules_sql import rules_sql
from .views import with_views

# ---------------------------------------------------------------- archives and corpora, written from the tables first
RAW = """concat('From ', source, '@example.org Mon Jan  6 09:00:00 2025\n', header_block, 'Subject: Weekly ', CAST(doc_id AS STRING),
 '\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n', regexp_replace(text, '(^|\n)From ', '$1>From '), '\n')"""
CLEAN_SQL = r"regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r\f\v]+', ' ', 'g'), '\n[\s\v]*\n+', chr(10) || chr(10), 'g'), '^[\s\v]+|[\s\v]+$', '', 'g')"
# archive writers quote body lines that start like an envelope line
QUOTED_SQL = CLEAN_SQL.replace("text,", r"regexp_replace(text, '(^|\n)From ', '\1>From ', 'g'),", 1)
MESSAGE_SQL = f"('Subject: Weekly ' || doc_id || chr(10) || chr(10) || {QUOTED_SQL})"


def _messages(t):
    return t.documents.join(t.mail_headers, "doc_id")


# archives as they come: nothing quoted, and every third mail has a body line that looks like an envelope
OPEN_TEXT = "CASE WHEN doc_id % 3 = 0 THEN concat(text, '\n\nFrom here on plain text\nand no header') ELSE text END"
OPEN_RAW = f"""concat('From ', source, '@example.org Mon Jan  6 09:00:00 2025\n', header_block, 'Subject: Weekly ', CAST(doc_id AS STRING),
 '\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n', {OPEN_TEXT})"""
OPEN_MESSAGE_SQL = "('Subject: Weekly ' || doc_id || chr(10) || chr(10) || " + CLEAN_SQL.replace(
    "text,", OPEN_TEXT.replace("'\n\nFrom here on plain text\nand no header'", "chr(10) || chr(10) || 'From here on plain text' || chr(10) || 'and no header'") + ",", 1) + ")"


def _archives(t, name, places):
    """Archives written from the tables, one per source; `places` maps a source to its file below the folder."""
    made, out = shared_folder(t.spark, name), shared_folder(t.spark, name)
    _messages(t).select("source", F.expr(OPEN_RAW).alias("value")).repartition("source").write.partitionBy("source").text(made)
    jvm = t.spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(made).getFileSystem(t.spark._jsc.hadoopConfiguration())
    found = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(made).select("path").collect()
    for (path,) in found:  # one file per source
        target = jvm.org.apache.hadoop.fs.Path(f"{out}/{places(path.split('/source=')[1].split('/')[0])}")
        fs.mkdirs(target.getParent())
        fs.rename(jvm.org.apache.hadoop.fs.Path(path), target)
    return out


@query("s4_mbox_scan", f"SELECT 1 AS label, 'archive' AS source, digest, count(*) AS mails FROM (SELECT md5({OPEN_MESSAGE_SQL}) AS digest FROM documents WHERE length({OPEN_MESSAGE_SQL}) >= 40) q GROUP BY digest")
def mbox_scan(t):
    """Archives written from the tables, split, decoded and cleaned again; body lines that start with From stay."""
    out = shared_folder(t.spark, "mbox")
    _messages(t).select(F.expr(OPEN_RAW).alias("value")).write.text(out)
    mails = ar.read_mbox(t.spark, out, 1, "archive")
    return mails.groupBy("label", "source", F.md5("text").alias("digest")).agg(F.count("*").alias("mails"))


@query("s6_mbox_folder", f"SELECT 'list_' || source AS source, CAST(sum(length({OPEN_MESSAGE_SQL})) AS BIGINT) AS chars, count(*) AS mails FROM documents WHERE length({OPEN_MESSAGE_SQL}) >= 40 GROUP BY source")
def mbox_folder(t):
    """A folder of archives, one per source; the source name comes from the file name."""
    out = _archives(t, "lists", lambda source: f"{source}-2024-03.mbox")
    return ar.read_mbox_folder(t.spark, out, 0, "list_").groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("mails"))


@query("s9_mail_export", f"SELECT 'export' AS source, CAST(sum(length({OPEN_MESSAGE_SQL})) AS BIGINT) AS chars, count(*) AS mails FROM documents WHERE source <> 'src3' AND length({OPEN_MESSAGE_SQL}) >= 40")
def mail_export(t):
    """An export folder: plain archives, package folders, and one that is not finished and stays out."""
    shapes = {"src2": "src2.mbox/mbox", "src3": "src3.partial.mbox"}
    out = _archives(t, "export", lambda source: shapes.get(source, f"{source}.mbox"))
    return ar.read_export(t.spark, out, 0, "export").groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("mails"))


@query("t1_message_text", f"SELECT doc_id, md5({MESSAGE_SQL}) AS digest FROM documents")
def message_text(t):
    """Raw bytes to model text without touching a file."""
    raw = _messages(t).select("doc_id", F.encode(F.regexp_replace(F.expr(RAW), r"^[^\n]*\n", ""), "UTF-8").alias("content"))
    return ar.model_text(ar.decode_messages(raw)).select("doc_id", F.md5("text").alias("digest"))


@query("t4_encoded_subjects", "SELECT doc_id, 'Subject: ' || source || ' é ' || doc_id AS first_line FROM documents")
def encoded_subjects(t):
    subject = F.concat(F.lit("=?utf-8?B?"), F.base64(F.encode(F.expr("concat(source, ' é ', CAST(doc_id AS STRING))"), "UTF-8")), F.lit("?="))
    raw = t.documents.select("doc_id", F.encode(F.concat(F.lit("From: a@b.example\nSubject: "), subject, F.lit("\n\n"), "text"), "UTF-8").alias("content"))
    return ar.model_text(ar.decode_messages(raw)).select("doc_id", F.substring_index("text", "\n", 1).alias("first_line"))


@query("t6_routed_text", f"""SELECT doc_id, doc_id % 2 = 0 AS is_mail, md5(CASE WHEN doc_id % 2 = 0 THEN {MESSAGE_SQL} ELSE {CLEAN_SQL} END) AS digest FROM documents""")
def routed_text(t):
    """Raw mail is decoded, anything else is only cleaned and cut."""
    rows = _messages(t).withColumn("raw", F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(F.expr(RAW), r"^[^\n]*\n", "")).otherwise(F.col("text")))
    decoded = ar.decode_messages(rows.select("doc_id", F.encode("raw", "UTF-8").alias("content"), F.col("raw")))
    return ar.model_text(decoded, F.col("raw")).select("doc_id", "is_mail", F.md5("text").alias("digest"))


@query("u2_ingestion_hook", f"SELECT from_freemail, count(*) AS mails FROM (SELECT doc_id % 4 = 1 AS from_freemail FROM documents WHERE length({MESSAGE_SQL}) >= 40) q GROUP BY from_freemail")
def ingestion_hook(t):
    """A user function joins the archive scan and adds header signals per message."""
    out = shared_folder(t.spark, "hook")
    _messages(t).select(F.expr(RAW).alias("value")).write.text(out)
    mails = ar.read_mbox(t.spark, out, 1, "archive", hooks=[hd.with_header_signals])
    return mails.groupBy("from_freemail").agg(F.count("*").alias("mails"))


@query("s1_labelled_csv", with_views(["mail"], "SELECT label, source, count(*) AS mails, CAST(sum(length(text)) AS BIGINT) AS chars FROM mail WHERE label IS NOT NULL GROUP BY label, source"))
def labelled_csv(t):
    out = shared_folder(t.spark, "csv")
    spelled = F.when(F.col("label") == 1, " Phishing ").otherwise("HAM")
    t.mail.where("label IS NOT NULL").select("text", spelled.alias("label"), "source").write.option(
        "header", "true").option("escape", '"').csv(out)
    rows = co.load_csv(t.spark, out)
    return rows.groupBy("label", "source").agg(F.count("*").alias("mails"), F.sum(F.length("text")).alias("chars"))


@query("s2_public_csv", r"""SELECT CAST(doc_id % 2 AS INTEGER) AS label, count(*) AS mails FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20 AND doc_id % 5 <> 0 GROUP BY ALL""")
def public_csv(t):
    """Placeholder texts and unknown labels are dropped while scanning."""
    out = shared_folder(t.spark, "public")
    kind = F.when(F.col("doc_id") % 2 == 1, "Phishing Email").otherwise("Safe Email")
    t.documents.select(F.col("doc_id").alias("index"), F.when(F.col("doc_id") % 5 == 0, "empty").otherwise(F.col("text")).alias("Email Text"), kind.alias("Email Type")).write.option(
        "header", "true").option("escape", '"').csv(out)
    return co.load_public_csv(t.spark, out).groupBy("label").agg(F.count("*").alias("mails"))


@query("s3_integer_label_csv", "SELECT CAST(doc_id % 2 AS INTEGER) AS label, count(*) AS mails FROM documents GROUP BY ALL")
def integer_csv(t):
    out = shared_folder(t.spark, "integers")
    t.documents.select("text", (F.col("doc_id") % 2).alias("labels")).write.option("header", "true").option("escape", '"').csv(out)
    return co.load_integer_csv(t.spark, out).groupBy("label").agg(F.count("*").alias("mails"))


@query("s7_ragged_csv", r"""SELECT label, count(*) AS mails, CAST(sum(length(body)) AS BIGINT) AS chars FROM (SELECT CAST(doc_id % 2 AS VARCHAR) AS label, trim(replace(replace(text, chr(10), ' '), chr(13), ' ')) AS body FROM documents) q
WHERE length(body) >= 40 GROUP BY label""")
def ragged_csv(t):
    out = shared_folder(t.spark, "ragged")
    line = F.concat(F.translate("text", "\n\r", "  "), F.lit(","), (F.col("doc_id") % 2).cast("string"))
    t.documents.select(line.alias("value")).write.text(out)
    return co.load_ragged_csv(t.spark, out).groupBy("label").agg(F.count("*").alias("mails"), F.sum(F.length("body")).alias("chars"))


@query("s8_generated_csv", rf"""SELECT generator, theme, count(*) AS mails, CAST(sum(length('Subject: about ' || source || chr(10) || chr(10) || {CLEAN_SQL})) AS BIGINT) AS chars
FROM (SELECT lang AS generator, 't' || (doc_id % 3) AS theme, source, text FROM documents) q GROUP BY generator, theme""")
def generated_csv(t):
    out = shared_folder(t.spark, "generated")
    t.documents.select(F.concat(F.lit(" about "), "source").alias("subject"), F.col("text").alias("body"), F.col("lang").alias("model"),
                       F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")).alias("category")).write.option("header", "true").option("escape", '"').csv(out)
    return co.load_generated_csv(t.spark, out).groupBy("generator", "theme").agg(F.count("*").alias("mails"), F.sum(F.length("text")).alias("chars"))


@query("s5_message_files", f"SELECT lang AS source, count(*) AS mails FROM documents WHERE length({MESSAGE_SQL}) >= 40 GROUP BY lang")
def message_files(t):
    """One file per message, in a folder per language, read by the folder reader."""
    out = shared_folder(t.spark, "messages")
    raw = F.concat(F.regexp_replace(F.expr(RAW), r"^[^\n]*\n", ""), F.lit("\n"))
    folder = F.coalesce(F.concat(F.lit("lang="), F.url_encode("lang")), F.lit("none"))
    ar.write_message_files(_messages(t).select(F.concat(folder, F.lit("/"), "doc_id", F.lit(".eml")).alias("place"), F.encode(raw, "UTF-8").alias("content")), out)
    lang = F.when(F.col("file_path").contains("/lang="), F.url_decode(F.regexp_extract("file_path", "/lang=([^/]*)/", 1)))
    mails = ar.read_message_files(t.spark, f"{out}/*", 0, lang)
    return mails.groupBy("source").agg(F.count("*").alias("mails"))


@query("s11_corpus_sink", with_views(["mail"], "SELECT source, count(*) AS mails, CAST(sum(label) AS BIGINT) AS positive FROM mail WHERE label IS NOT NULL GROUP BY source"))
def corpus_sink(t):
    out = shared_folder(t.spark, "corpus")
    co.write_corpus(t.mail.where("label IS NOT NULL").select("text", "label", "source"), out)
    return t.spark.read.parquet(out).groupBy("source").agg(F.count("*").alias("mails"), F.sum("label").alias("positive"))


@query("s12_report_sink", with_views(["scored"], "SELECT lang, round(avg(score_a), 6) AS mean FROM scored GROUP BY lang"))
def report_sink(t):
    out = shared_folder(t.spark, "report")
    metrics = t.scored.groupBy("lang").agg(F.avg("score_a").alias("mean"), F.count("*").alias("_private"))
    co.write_report(metrics, out)
    return co.read_report(t.spark, out, "lang string, mean double")


@query("s10_term_list", r"""SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\p{L}\p{N}_])(?i:de|en|es|fr)($|[^\p{L}\p{N}_])')""")
def term_list(t):
    """A redaction list written from the language codes and loaded again; mails it changes."""
    out = shared_folder(t.spark, "terms")
    t.documents.select(F.col("lang").alias("value")).distinct().write.text(out)
    changed = redact(F.col("text"), co.term_array(co.load_terms(t.spark, out)))
    return t.documents.where(changed != F.col("text")).select("doc_id")


# ---------------------------------------------------------------- streaming
@query("x1_stream_scoring", rules_sql("SELECT doc_id, source, score, risk FROM mail_rules"))
def stream_scoring(t):
    """The stream's sink holds exactly the batch result."""
    arrived, out = shared_folder(t.spark, "arrived"), shared_folder(t.spark, "scored")
    mails = t.mail.select("doc_id", "source", "text")
    mails.write.parquet(arrived)
    st.run_available(st.scored_stream(st.mail_stream(t.spark, arrived, mails.schema)), out, shared_folder(t.spark, "progress"))
    return t.spark.read.parquet(out)


@query("x2_first_seen", "SELECT count(DISTINCT user_id || ' ' || event_type) AS kept FROM events")
def stream_first_seen(t):
    arrived, out = shared_folder(t.spark, "events"), shared_folder(t.spark, "first")
    events = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(" ", "user_id", "event_type").alias("text"))
    events.write.parquet(arrived)
    st.run_available(st.first_seen(st.mail_stream(t.spark, arrived, events.schema), "ts", "text"), out, shared_folder(t.spark, "progress"))
    return t.spark.read.parquet(out).agg(F.count("*").alias("kept"))


@query("x2_first_rows", "SELECT k AS content_key, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM (SELECT *, user_id || ' ' || event_type AS k FROM events) q GROUP BY k")
def stream_first_rows(t):
    """First event per user and kind by event time, over micro-batches that bring the latest events first."""
    arrived, out = shared_folder(t.spark, "events"), shared_folder(t.spark, "first")
    text = F.concat_ws(" ", "user_id", "event_type")
    events = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), text.alias("text"))
    events.repartitionByRange(4, F.desc("ts")).write.parquet(arrived)
    stream = st.mail_stream(t.spark, arrived, events.schema, files_per_trigger=1)
    st.run_available(st.first_so_far(stream, "ts", "event_id", "text"), out, shared_folder(t.spark, "progress"))
    first = st.settled(t.spark.read.parquet(out), "ts", "event_id")
    return first.join(events, "event_id").select(F.col("text").alias("content_key"), "event_id")


# ---------------------------------------------------------------- fitted models
@query("u3_rule_transformer", None)
def rule_transformer(t):
    out = RuleFeatures(version=4).transform(t.mail.select("doc_id", "text"))
    return out.select("doc_id", F.size(vector_to_array("rule_features")).alias("n"), F.round(F.aggregate(vector_to_array("rule_features"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


WHOLE = tm.ModelOptions(feature_version=3)  # words, characters and rules


def _labelled(t):
    return t.mail.where("label IS NOT NULL").select("doc_id", "source", "lang", "label", "text")


def _split(t):
    rows = durable(sp.stratified_split(_labelled(t), "doc_id", "label"))
    return rows.where("part < 2"), rows.where("part = 2")


def _fit_and_score(t, options):
    train, test = _split(t)
    prepared = tm.prepare(train.unionByName(test), options)
    model = tm.TextModel(options).fit(prepared, train)
    return model, prepared, model.raw_scores(prepared, test).join(test.select("doc_id", "label", "lang"), "doc_id"), train, test


def _auc(scored):
    return cv.curve_summary(cv.score_curve(scored)).select(F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


@query("m3_block_ablation", None)
def block_ablation(t):
    """Every block alone and together, on the same split."""
    train, test = _split(t)
    prepared = tm.prepare(train.unionByName(test), WHOLE)
    held = test.select("doc_id", "label")
    blocks = {"rules": dict(use_text=False), "words": dict(use_char=False, use_rules=False), "words and characters": dict(use_rules=False),
              "words and rules": dict(use_char=False), "words, characters and rules": {}}

    def judged(name):
        model = tm.TextModel(replace(WHOLE, **blocks[name])).fit(prepared, train)
        return _auc(durable(model.raw_scores(prepared, held).join(held, "doc_id"))).withColumn("model", F.lit(name))

    return reduce(DataFrame.unionByName, tm.side_by_side([partial(judged, name) for name in blocks]))


@query("m5_logistic_regression", None)
def logistic_regression(t):
    """Word, character and rule blocks, balanced classes."""
    return _fit_and_score(t, tm.ModelOptions(feature_version=3))[2].select("doc_id", "label", F.round("score", 6).alias("score"))


@query("m6_linear_svm", None)
def linear_svm(t):
    return _fit_and_score(t, tm.ModelOptions(classifier="svm", feature_version=3))[2].select("doc_id", "label", F.round("score", 6).alias("margin"))


@query("m7_complement_nb_fit", None)
def complement_nb_fit(t):
    return _fit_and_score(t, tm.ModelOptions(classifier="nb", use_char=False, use_rules=False))[2].select("doc_id", "label", F.round("score", 6).alias("score"))


@query("m8_scores_and_verdicts", None)
def scores_and_verdicts(t):
    model, prepared, scored, _, test = _fit_and_score(t, WHOLE)
    return scored.select("doc_id", F.round("score", 6).alias("score"), (F.col("score") >= model.threshold).alias("is_phishing"))


def _grouped(t):
    """Labelled mails with their near-copy group."""
    mails = durable(_labelled(t))
    return durable(mails.join(sim.near_copy_groups(mails, "doc_id"), "doc_id"))


def _out_of_fold(mails, prepared):
    folded = durable(sp.grouped_folds(mails.select("doc_id", "grp", "label"), "grp", "label", 5).select("doc_id", "label", "fold"))
    return tm.oof_scores(prepared, folded, WHOLE, 5)


@query("m9_out_of_fold_scores", None)
def out_of_fold(t):
    mails = _grouped(t)
    return _out_of_fold(mails, tm.prepare(mails, WHOLE)).select("doc_id", "label", "fold", F.round("score", 6).alias("score"))


@query("m10_platt_fit", None)
def platt_fit(t):
    slope, intercept = tm.fit_platt(t.scored.select(F.col("score_a").alias("score"), "label"))
    return t.scored.select("doc_id", F.round(platt(F.col("score_a"), slope, intercept), 6).alias("probability"))


@query("m11_cv_threshold", None)
def cv_threshold(t):
    """Grouped folds, calibration, plateau threshold, refit; then the model scores its own mails."""
    model, prepared, _ = tm.fit_with_cv_threshold(_grouped(t), WHOLE, "grp")
    return model.scores(prepared, prepared.rows).select("doc_id", F.round("score", 6).alias("score"), F.lit(model.threshold).alias("threshold"))


@query("m12_fit_methods", None)
def fit_methods(t):
    """Threshold by a fit on one slice judged on another, by the peak of the fold curves and by the plateau.

    Every method refits on all mails; `flagged` counts the mails that its final model flags.
    """
    mails = _grouped(t)
    prepared = tm.prepare(mails, WHOLE)
    parts = durable(sp.group_split(mails.select("doc_id", "grp", "label"), "grp"))
    oof, held = _out_of_fold(mails, prepared), parts.where("part = 1").select("doc_id", "label")
    judged = tm.TextModel(WHOLE).fit(prepared, parts.where("part = 0")).raw_scores(prepared, held).join(held, "doc_id")
    curve = durable(cv.f1_grid_curve(oof, "score"))
    val = cv.curve_summary(cv.score_curve(judged)).select(F.lit("val").alias("method"), F.col("best_f1_threshold").alias("threshold"))
    chosen = reduce(DataFrame.unionByName, [cv.plateau_threshold(curve, rule=r).select(F.lit(r).alias("method"), "threshold") for r in ("max", "plateau")], val)
    final = durable(tm.TextModel(WHOLE).fit(prepared, mails).raw_scores(prepared, mails))
    counts = [final.agg(F.count_if(F.col("score") >= r.threshold).alias("flagged")).select(
        F.lit(r.method).alias("method"), F.lit(r.threshold).alias("threshold"), "flagged") for r in chosen.collect()]  # three rows
    return reduce(DataFrame.unionByName, counts)


@query("s13_model_round_trip", None)
def model_round_trip(t):
    """A saved and loaded model gives the same scores; another feature schema is refused."""
    model, prepared, scored, _, test = _fit_and_score(t, WHOLE)
    path = shared_folder(t.spark, "model")
    model.save(path)
    again = tm.TextModel.load(t.spark, path).raw_scores(prepared, test)
    return scored.join(again.withColumnRenamed("score", "loaded"), "doc_id").select("doc_id", F.round(F.abs(F.col("score") - F.col("loaded")), 9).alias("difference"))


@query("w16_model_explanations", None)
def model_explanations(t):
    model, prepared, _, _, _ = _fit_and_score(t, WHOLE)
    return model.explain(prepared).select("doc_id", "rank", "term", F.round("contribution", 6).alias("contribution"))
