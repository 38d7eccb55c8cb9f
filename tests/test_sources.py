"""Archives, corpora, sinks, streaming and model persistence on real files."""

import mailbox
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from mailgrain.models import text_model as tm
from mailgrain.models.rule_transformer import RuleFeatures
from mailgrain.sources import archives as ar
from mailgrain.sources import corpora as co
from mailgrain.streaming import scoring as st
from mailgrain.functions.rules import with_rules


def message(subject, body, html=None, charset="utf-8"):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = "a@x.example", "b@y.example", subject
    m.set_content(body, charset=charset)
    if html:
        m.add_alternative(html, subtype="html")
    return m


LONG = "This body is certainly long enough to be kept by the scan."


def test_mbox_scan_matches_the_standard_library(spark, tmp_path):
    path = tmp_path / "lists-2024-01.mbox"
    box = mailbox.mbox(str(path))
    subjects = ["plain", "çağrı ünlü", "third"]
    for i, s in enumerate(subjects):
        box.add(message(s, f"{LONG} {i}\n\n\nend ü", charset="utf-8" if i != 1 else "iso-8859-9"))
    box.flush()
    rows = ar.read_mbox_folder(spark, str(tmp_path), 1, "p_").collect()
    assert sorted(r.text.split("\n")[0] for r in rows) == sorted(f"Subject: {s}" for s in subjects)
    assert {r.source for r in rows} == {"p_lists"} and all(r.text.endswith("end ü") for r in rows)


def test_message_files_html_fallback_and_attachment(spark, tmp_path):
    m = EmailMessage()
    m["Subject"], m["From"] = "s", "a@b.example"
    m.set_content(f"<p>{LONG}</p><a href='http://x.example/1'>go</a>", subtype="html")
    m.add_attachment(b"secret attachment text", maintype="text", subtype="plain", filename="a.txt")
    (tmp_path / "1.eml").write_bytes(m.as_bytes())
    (tmp_path / "cmds").write_text("skip me")
    (r,) = ar.read_message_files(spark, str(tmp_path), 0, "pot").collect()
    assert "http://x.example/1" in r.text and "secret" not in r.text and r.text.startswith("Subject: s\n\n")


def test_many_message_files_are_written_side_by_side_and_read_in_few_tasks(spark, tmp_path):
    """Before, every mail had a folder of its own and every few files a task of their own."""
    data = [(f"{'ab'[i % 2]}/{i}.eml", f"From: a@b.example\nSubject: s{i}\n\n{LONG}\n".encode()) for i in range(600)]
    out = f"file://{tmp_path}/out"
    assert ar.write_message_files(spark.createDataFrame(data, "place string, content binary").repartition(5), out) == 600
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "b"]
    assert (tmp_path / "out/b/7.eml").read_bytes() == data[7][1]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a file a task
    try:
        mails = ar.read_message_files(spark, f"{out}/*", 0, "pot")
        assert mails.rdd.getNumPartitions() <= ar.TASKS_PER_SLOT * spark.sparkContext.defaultParallelism
        assert {r.subject for r in mails.collect()} == {f"s{i}" for i in range(600)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_message_files_keep_any_language(spark, tmp_path):
    from mailgrain.catalog.registry import QUERIES
    spark.createDataFrame([(1, LONG, "a/b", "s"), (2, LONG, None, "s"), (3, LONG, "", "s"), (4, LONG, "a/b", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.source: r.mails for r in QUERIES["s5_message_files"](spark, str(tmp_path)).collect()} == {"a/b": 2, None: 1, "": 1}


def test_export_skips_partial_archives(spark, tmp_path):
    for name in ("a.mbox", "b.partial.mbox"):
        box = mailbox.mbox(str(tmp_path / name))
        box.add(message(name, LONG))
        box.flush()
    (tmp_path / "c.mbox").mkdir()
    box = mailbox.mbox(str(tmp_path / "c.mbox" / "mbox"))
    box.add(message("c", LONG))
    box.flush()
    rows = ar.read_export(spark, str(tmp_path), 0, "own").collect()
    assert {r.subject for r in rows} == {"a.mbox", "c"}


def test_labelled_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('text,label,source\n"two\nlines, ""quoted""",Phishing Email,a\nok,HAM,\n,1,a\nx,unknown,a\n', encoding="utf-8")
    rows = {r.text: (r.label, r.source) for r in co.load_csv(spark, str(path)).collect()}
    assert rows == {'two\nlines, "quoted"': (1, "a"), "ok": (0, "")}


def test_ragged_csv_and_terms(spark, tmp_path):
    (tmp_path / "r.csv").write_text("text,label\n" + "hello, this is, a text with commas inside it ok,1\nshort,0\n")
    (r,) = co.load_ragged_csv(spark, str(tmp_path / "r.csv")).collect()
    assert r.label == "1" and r.body.endswith("inside it ok")
    (tmp_path / "t.txt").write_text("Efe\nx\n  ab \n")
    assert spark.range(1).select(co.term_array(co.load_terms(spark, str(tmp_path / "t.txt")))).first()[0] == ["Efe", "ab"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "s"), ("b", 0, "s")], "text string, label int, source string")
    assert co.write_corpus(df, str(tmp_path / "c")) == {"rows": 2, "positive": 1}
    report = spark.createDataFrame([("m", 0.123456789, float("nan"), 1.0)], "name string, v double, bad double, _x double")
    co.write_report(report, str(tmp_path / "r"))
    r = co.read_report(spark, str(tmp_path / "r"), "name string, v double, bad double, _x double").first()
    assert (r.v, r.bad, r._x) == (0.123457, None, None)


def test_routing_of_pasted_text(spark):
    raw = spark.createDataFrame([(1, b"From: a@b.example\nSubject: hi\n\nbody  text"), (2, b"just   pasted\n\n\n\ntext")], "id int, content binary")
    decoded = ar.decode_messages(raw.withColumn("raw", F.decode("content", "UTF-8")))
    got = {r.id: (r.is_mail, r.text) for r in ar.model_text(decoded, F.col("raw")).collect()}
    assert got == {1: (True, "Subject: hi\n\nbody text"), 2: (False, "just pasted\n\ntext")}


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, "s", f"click http://10.0.0.{i}/ now") for i in range(20)], "doc_id long, source string, text string")
    df.write.parquet(str(tmp_path / "in"))
    st.run_available(st.scored_stream(st.mail_stream(spark, str(tmp_path / "in"), df.schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = with_rules(df).select("doc_id", "source", "score", "risk")
    stream = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(stream.collect()) == sorted(batch.collect())


def test_first_seen_within_the_watermark(spark, tmp_path):
    rows = [(i, f"2025-01-01 00:00:{i:02d}", "A b" if i % 2 else "a  B") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    st.run_available(st.first_seen(st.mail_stream(spark, str(tmp_path / "in"), df.schema), "ts", "text"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_model_learns_saves_and_refuses_other_schemas(spark, tmp_path):
    data = [(i, i % 2, f"please verify your password number{i} now" if i % 2 else f"meeting notes from monday number{i}") for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, label int, text string")
    options = tm.ModelOptions(use_char=False, feature_version=2, max_iter=30)
    prepared = tm.prepare(df, options)
    model = tm.TextModel(options).fit(prepared, df)
    scores = {r.doc_id: r.score for r in model.scores(prepared, df).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)
    top = model.explain(prepared, 2).where("doc_id = 1").collect()
    assert top and all(r.contribution > 0 for r in top)
    fresh = model.score_mails(df)
    assert "Exchange" not in fresh._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.score for r in fresh.collect()} == pytest.approx(scores)
    model.save(str(tmp_path / "m"))
    again = {r.doc_id: r.score for r in tm.TextModel.load(spark, str(tmp_path / "m")).scores(prepared, df).collect()}
    assert again == pytest.approx(scores)
    meta = spark.read.parquet(str(tmp_path / "m/metadata")).withColumn("feature_schema", F.lit(1)).toPandas()
    spark.createDataFrame(meta, tm.METADATA).write.mode("overwrite").parquet(str(tmp_path / "m/metadata"))
    with pytest.raises(ValueError, match="schema"):
        tm.TextModel.load(spark, str(tmp_path / "m"))


def test_invalid_options_are_refused():
    for bad in (dict(use_text=False, use_rules=False), dict(classifier="nb"), dict(classifier="x"), dict(clean=("y",))):
        with pytest.raises(ValueError):
            tm.ModelOptions(**bad)


def test_platt_is_monotone(spark):
    df = spark.createDataFrame([(i / 100, int(i > 60 or i % 7 == 0)) for i in range(1, 100)], "score double, label int")
    slope, _ = tm.fit_platt(df)
    assert slope > 0


def test_rule_transformer_round_trip(spark, tmp_path):
    stage = RuleFeatures(version=3)
    stage.write().overwrite().save(str(tmp_path / "stage"))
    again = RuleFeatures.load(str(tmp_path / "stage"))
    df = spark.createDataFrame([("verify http://1.2.3.4/",)], "text string")
    assert again.transform(df).first().rule_features == stage.transform(df).first().rule_features


@pytest.mark.parametrize("range_bytes", ["64", "150", "128m"])
def test_mbox_messages_across_byte_ranges(spark, tmp_path, range_bytes):
    """Whatever the byte ranges: body lines that start with From stay, long messages are whole, bytes are untouched."""
    bodies = [b"plain text of the first mail", b"a line\n\nFrom here on it is body\nand ends", b"\xe4\xf6\xfc latin bytes " + b"x" * 500,
              b"From \nFrom the start\nFrom twice", b"short"]
    mbox = b"".join(b"From a@b.example Mon Jan  6 09:00:00 2025\nSubject: mail %d\n\n%s\n\n" % (i, b) for i, b in enumerate(bodies))
    (tmp_path / "one.mbox").write_bytes(mbox)
    (tmp_path / "two.mbox").write_bytes(mbox.replace(b"mail", b"post"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
    try:
        rows = ar._scan_mbox(spark, str(tmp_path / "*.mbox")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = sorted(("one.mbox" if kind == b"mail" else "two.mbox", b"Subject: %s %d\n\n%s" % (kind, i, b.replace(b"mail", kind)))
                  for kind in (b"mail", b"post") for i, b in enumerate(bodies))
    assert sorted((r.file_name, bytes(r.content).rstrip(b"\n")) for r in rows) == want


@pytest.mark.parametrize("range_bytes", ["40", "97", "128m"])
def test_quoted_csv_across_byte_ranges(spark, tmp_path, range_bytes):
    """Equal to the reader that takes whole files, whatever the byte ranges."""
    import csv
    texts = ["plain", 'say "hi", then\ngo', "line\nbreak\n\nand " + "long " * 60, '""', "", "comma, only", "ends with quote\"", "\"\n\"", "\u00e4\u00f6 \u4e2d", "last\n"]
    for name, shift in (("a.csv", 0), ("b.csv", 3)):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_ALL if shift else csv.QUOTE_MINIMAL)
            out.writerow(["text", "label"])
            out.writerows([t, str(i)] for i, t in enumerate(texts[shift:] + texts[:shift]))
    whole = spark.read.schema("text string, label string").option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').csv(str(tmp_path))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
    try:
        scan = co.scan_csv(spark, str(tmp_path), ("text", "label"))
        got = sorted(((r.text or "", r.label) for r in scan.collect()))
        ranges = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((r.text or "", r.label) for r in whole.collect()) and len(got) == 20
    assert ranges > 5 or range_bytes == "128m"


def test_mail_headers_equal_the_library_without_its_grammar():
    from email import message_from_bytes, policy
    names = ["From", "To", "Subject", "X-A", "Reply-To", "Date", "Message-ID", "Content-Type", "Received", "Content-Disposition", "Resent-From"]
    values = ["a@b.example", "Shop <a@b.c>", "Shop  A <a@b>", '"Q, x" <a@b.c>', "a@b.c, d@e.f", "a@b>", "Shop <a@b", "x y@z.com", "=?utf-8?Q?h=C3=A4?= x", "fold\n  more text",
              "t\tab", "trail  ", "café", "", "text/html; charset=x", "Mon, 6 Jan 2025 09:00:00 +0000", "a?="]
    for name in names:
        for value in values:
            raw = f"{name}: {value}\n\nbody".encode()
            assert ar.take_apart(raw)[0] == [{"name": n, "value": str(v)} for n, v in message_from_bytes(raw, policy=policy.default).items()]
    values = ar._Headers()
    assert type(values("Received", "from a by b")) is str and type(values("From", "Shop <a@b.c>")) is str  # no grammar ran


def test_mails_are_taken_apart_in_bounded_slices():
    import pyarrow as pa
    sizes = [3_000_000, 500_000, 9_000_000, 10, 10, None]
    batch = pa.RecordBatch.from_pydict({"content": pa.array([None if n is None else b"x" * n for n in sizes], pa.binary())})
    assert [s.num_rows for s in ar._bounded(batch, "content")] == [2, 1, 3]


def test_the_length_filter_does_not_compute_the_text_again(spark):
    raw = spark.createDataFrame([(bytearray(b"Subject: a\n\n" + b"long enough " * 5),), (bytearray(b"Subject: a\n\nno"),)], "content binary")
    rows = ar._finish(ar.decode_messages(raw), 1, F.lit("x"), None, ()).select("text")
    assert [r.text[:10] for r in rows.collect()] == ["Subject: a"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(Subject: ") == 1
