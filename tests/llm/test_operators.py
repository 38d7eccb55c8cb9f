"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import collections
import hashlib
import html
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailgrain.llm import decontamination, divergence, encoding, html_density, language, packing, secrets, simhash, token_edits, token_files, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, h long, id string, spans string, piece int, key string"
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def docs(spark, pairs):
    """Documents with extra columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", None, None, 1, 2, "x", "y", 3, "k") for i, t in pairs], DOCS)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    stems = [a + b for a in ("al", "be", "cor", "dun", "é", "fi") for b in ("ra", "sten", "to", "vu", "ß")]
    words = lambda n: " ".join(rnd.choice(stems) for _ in range(n))
    base = [words(rnd.choice([3, 12, 13, 40, 120])) for _ in range(40)]
    return [*base, None, "", " \n\t ", base[0], base[0], base[1].upper(), base[2].replace(" ", "  "), words(6000), "Σ ΑΣ 日本語 İstanbul", base[3] + "\n" + base[3], "x" * 5000]


@pytest.fixture(scope="module")
def table(spark, texts):
    return docs(spark, [*enumerate(texts), (7, texts[7]), (8, "another text under a used id"), (None, texts[9])])


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ---------------------------------------------------------------- ids
ODD = ["a  b", " lead", "trail ", "x\n y", "it's  they're\t\tok", "İstanbul ΣΑΣ", "ﬁ", "<|endoftext|> hi", "don't 'll 're|x", "a\xa0b", "²³ ½", "\n\n\na", "a \n\nb", "\x1c\x00"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_ids_equal_the_library(texts, name):
    enc = encoding.Encoder(encoding.vocabulary(name), most_kept=50)
    for t in [*(x or "" for x in texts), *ODD]:
        assert enc.ids(t) == enc.whole(t), t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_plain_piece_is_kept_once(name):
    """Before, every word behind a blank was kept twice, by piece and by pre-token."""
    enc = encoding.Encoder(encoding.vocabulary(name))
    text = "First größe then words größe"
    assert enc.ids(text) == enc.whole(text) == enc.ids(text)
    assert {"größe", "then", "words"} <= set(enc.kept) and {w.strip() for w in enc.words} <= {"First"}


# ---------------------------------------------------------------- 1
def test_edited_counts(spark, table):
    rnd = random.Random(3)
    enc = encoding.Encoder(encoding.vocabulary("byte_bpe_50k.json"))
    alphabet = " \n'abrevt1,é日s"
    for _ in range(300):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 5, 60, 400, 1500])))
        tree = token_edits.TokenTree(enc, text)
        tree = token_edits.TokenTree(enc, text, tree.chars, tree.tokens)
        edits, at, want = [], 0, text
        while at <= len(text):
            s, n = at + rnd.randrange(0, 200), rnd.choice([0, 1, 3, 40])
            if s + n <= len(text):
                edits.append((s, n, "".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 2, 30])))))
            at = s + n + 1
        tree.apply(edits)
        for s, n, new in reversed(edits):
            want = want[:s] + new + want[s + n:]
        assert tree.text == want and 4 * tree.tokens[1] == len(enc.whole(want))
        assert sum(tree.chars[tree.size:]) == tree.chars[1] == len(want)
    with pytest.raises(ValueError):
        token_edits.TokenTree(enc, "some words here").apply([(0, 5, "a"), (3, 2, "b")])
    trees = token_edits.with_trees(table)
    got = token_edits.edited(trees, texts=True).collect()
    assert len(got) == table.count()
    assert all(4 * r.n_tokens_after == len(enc.whole(r.text)) for r in got)
    own = trees.withColumn("edits", F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("length"), F.lit("Q").alias("text"))))
    assert all(r.n_edits == (1 if r.n_tokens else r.n_edits) for r in token_edits.edited(own, edits_col="edits").collect())
    assert rows_of(token_edits.edited(token_edits.with_trees(table.limit(0)))) == []


# ---------------------------------------------------------------- 2
def brute_contamination(documents, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    runs = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOW))
        for s in range(max(1, len(w) - window + 1) if w else 0):
            runs.setdefault(tuple(w[s:s + window]), set()).add("null" if i is None else str(i))
    out = []
    for d, t in documents:
        w = word.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(r) for r in runs}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in runs:
                    hit |= set(range(s, s + n))
                    found |= runs[tuple(w[s:s + n])]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("short", [False, True])
def test_contamination(spark, texts, table, short):
    words = " ".join(t for t in texts if t).split()
    items = [(1, " ".join(words[:20])), (2, " ".join(words[5:18])), (10, (texts[4] or "").upper()), (3, None), (4, "..."), (5, " ".join(words[100:140])), (5, "a " * 20), (None, " ".join(words[60:75]))]
    if short:
        items += [(20, " ".join(words[30:34])), (21, words[50] + ", " + words[51]), (22, words[2])]
    frame = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id long, text string, source string")
    table = table.union(docs(spark, [(500, "x y " + " ".join(words[:20]) * 2), (501, "a " * 50), (502, "-- " + " ".join(words[100:140]).title())]))
    got = sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontamination.contamination(table, frame).collect()], key=str)
    assert got == brute_contamination([(r.doc_id, r.text) for r in table.collect()], items)
    clean = decontamination.contamination(table, frame.limit(0)).collect()
    assert len(clean) == table.count() and not any(r.n_hit for r in clean)
    assert rows_of(decontamination.contamination(table.limit(0), frame)) == []


def test_winnowing_keeps_every_shared_span(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.choice([12, 13, 30, 90])))) for i in range(60)]
    items = [(i, t[:2 * 13 - 1] if i % 3 else t) for i, t in rows[:9] if len(t) > 25]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontamination.contamination(docs(spark, rows), frame).collect()], key=str)
    assert got == brute_contamination(rows, items)


# ---------------------------------------------------------------- 3
def test_quality_measures_and_verdict(spark, table):
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def brute(t):
        w = word.findall(t)
        c = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        hit = {p for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
        seen, lines = set(), 0
        for x in t.split("\n"):
            if word.search(x):
                lines += x in seen
                seen.add(x)
        return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), lines, len(hit)

    noise = docs(spark, [(900, "al###ra be***sten cor$$$to " * 3 + " ".join(f"w{i}%%%" for i in range(300)))])
    full = table.union(noise)
    got = sorted(divergence.judged(full).collect(), key=lambda r: str(tuple(r)))
    want = collections.Counter(brute(r.text or "") for r in full.collect())
    assert collections.Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    by = {r.doc_id: r for r in got}
    assert not by[900].kept and not by[900].base_failed and by[0].n_words > 0
    p, q = np.array([0.5, 0.5, 0]), np.array([0, 0.5, 0.5])
    assert abs(divergence.distance(p, q) - 0.5 ** 0.5) < 1e-12 and divergence.distance(p, p) == 0
    assert all(r.kept != r.base_failed for r in divergence.judged(table.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert rows_of(divergence.judged(table.limit(0))) == []


def test_a_small_language_beside_a_large_one_has_a_reference(spark):
    rnd = random.Random(4)
    own = lambda c, n=200: " ".join(f"{c}{rnd.choice('aeiou')}{rnd.randrange(20)}" for _ in range(n))
    large = spark.range(101).select(F.col("id").alias("doc_id"), F.repeat(F.lit(own("b", 1000) + " "), 100).alias("text"), F.lit("bb").alias("lang"))  # 10.1 million words
    small = spark.createDataFrame([(1000 + i, own("s"), "ss") for i in range(50)] + [(2000, own("t"), "tt"), (2001, own("b"), "tt"), (3000, own("t"), None), (3001, own("s"), None)], "doc_id long, text string, lang string")
    refs = divergence.references(large.union(small))
    assert set(refs) == {"bb", "ss"}
    got = {r.doc_id: r for r in divergence.judged(small, refs).collect()}
    assert all(got[i].kept and got[i].word_distance < 0.5 for i in (*range(1000, 1050), 3001)) and not got[3000].kept
    assert all(got[i].kept and math.isnan(got[i].word_distance) and math.isnan(got[i].class_distance) for i in (2000, 2001))


# ---------------------------------------------------------------- 4
def test_packing(spark, table):
    enc = encoding.Encoder(encoding.vocabulary("word_bpe_49k.json"))
    got = packing.packed(table, capacity=256).collect()
    want = collections.Counter()
    for r in table.collect():
        ids = enc.whole(r.text or "") + np.array([1], "<u4").tobytes()
        for k, at in enumerate(range(0, len(ids), 1024)):
            want[r.doc_id, k, at // 4, len(ids[at:at + 1024]) // 4, zlib.crc32(ids[at:at + 1024])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert rows_of(packing.packed(table.limit(0))) == []


def test_plan_uses_every_piece_and_few_sequences():
    rnd = random.Random(2)
    for _ in range(30):
        counts = {rnd.randrange(1, 101): rnd.randrange(1, 400) for _ in range(rnd.choice([1, 3, 20, 80]))}
        used, sequences = collections.Counter(), 0
        for lengths, times in packing.plan(counts, 100):
            assert sum(k * n for k, n in lengths.items()) <= 100
            sequences += times
            for k, n in lengths.items():
                used[k] += n * times
        assert used == counts
        gaps = []  # first fit decreasing
        for k in sorted(counts, reverse=True):
            for _ in range(counts[k]):
                i = next((i for i, g in enumerate(gaps) if g >= k), None)
                if i is None:
                    gaps.append(100)
                    i = len(gaps) - 1
                gaps[i] -= k
        assert sequences <= 1.02 * len(gaps) + 1


# ---------------------------------------------------------------- 5
@pytest.mark.parametrize("kind", ["dictionary", "delta"])
def test_token_files(spark, table, kind, tmp_path):
    enc = encoding.Encoder(encoding.vocabulary("byte_bpe_50k.json"))
    got = sorted(token_files.token_index(table, encoding=kind).collect(), key=lambda r: r.start)
    want = collections.Counter()
    for r in table.collect():
        ids = enc.whole(r.text or "") + np.array([0], "<u4").tobytes()
        want[r.doc_id, len(ids) // 4, zlib.crc32(ids)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x))
    path = str(tmp_path / "tokens")
    token_files.write_tokens(table, path, encoding=kind)
    assert sorted(r.doc_id for r in token_files.read_tokens(spark, path, 3, 5, ["doc_id", "n_tokens"]).collect()) == [3, 4, 5]
    assert rows_of(token_files.token_index(table.limit(0))) == []


# ---------------------------------------------------------------- 6
def brute_spans(t):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, table):
    rnd = random.Random(1)
    pools = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789ABCDEF", string.ascii_uppercase + "234567"]
    random_keys = ["see é key " + "".join(rnd.choice(pools[i % 4]) for _ in range(rnd.choice([24, 32, 40, 64]))) + " end" for i in range(60)]
    plain = ["internationalizationofeverything isgoodforyouandeveryone", "https://example.com/some/long/path-of-words/and-more", "getElementsByTagNameAndSomeOtherThing",
             "123e4567-e89b-12d3-a456-426614174000", string.ascii_uppercase, "-" * 30, "0" * 22, "A" * 5000]
    based = ["PASSWORD : 'abc.def' token=secret=abcdefgh password=token:abcdefgh api_key=\"x\" apikey=longenough", "é AKIA" + "Q" * 16 + "x AKIAAKIA" + "2" * 9 + " " + "0a" * 12,
             "token=1234567", "token = \nabcdefgh", "ſecret=abcdefgh"]
    cases = [*random_keys, *plain, *based]
    full = docs(spark, enumerate(cases, 1000)).union(table)
    got = secrets.secrets(full).withColumn("b", secrets.listed(F.col("base"))).withColumn("s", secrets.listed(F.col("spans"))).collect()
    assert len(got) == full.count()
    spans = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 1000}
    for i, t in enumerate(cases, 1000):
        assert spans[i].b == ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute_spans(t)), t
        assert set(spans[i].b.split(",")) <= set(spans[i].s.split(",")) | {""}
    assert sum(not spans[i].s for i in range(1000, 1060)) <= 6
    assert all(spans[1060 + i].s == spans[1060 + i].b for i in range(len(plain)))
    span = "array<struct<start:int,rank:int,end:int,kind:string>>"
    frame = spark.createDataFrame([("é0123456789", [(2, 0, 4, "a"), (3, 0, 6, "b"), (9, 0, 11, "c")]), ("abc", [])], f"text string, spans {span}")
    assert [r.m for r in frame.select(secrets.masked(F.col("text"), F.col("spans")).alias("m")).collect()] == ["é0[secret]567[secret]", "abc"]
    assert rows_of(secrets.secrets(table.limit(0))) == []


# ---------------------------------------------------------------- 7
def test_language(spark):
    rnd = random.Random(4)
    made = {"aa": ["zor", "kel", "vat", "mira"], "bb": ["shu", "ñol", "épi", "qua"], "cc": ["дом", "река", "лес"]}
    text = lambda x, n: " ".join(rnd.choice(made[x]) + rnd.choice(made[x]) for _ in range(n))
    rows = [(i, text(x, rnd.choice([3, 30, 200])), x) for i, x in enumerate(x for x in made for _ in range(120))]
    more = [(5000, None, "aa"), (5001, "", "aa"), (5002, "123 ### !!", "bb"), (5003, "Z", None), (None, text("bb", 30), "bb"), (5004, "wxyjq " * 200, None), (5005, "日本語 " * 9, None), (5006, text("aa", 300_000), None)]
    frame = spark.createDataFrame([(i, t, x, 1.0, "s") for i, t, x in rows + more], "doc_id long, text string, lang string, score double, rejected string")
    model = language.train(frame)
    probability = np.exp(model.logs(np.arange(64, dtype=np.uint32) + np.uint32(9 << 12)))
    assert np.allclose(probability.sum(axis=0), 1, atol=1e-4)
    got = {r.doc_id: r for r in language.languages(frame, model).collect()}
    for i, _, x in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    judged = [(got[i].lang_pred == x, got[i].rejected) for i, _, x in rows if got[i].held_out]
    assert len(judged) > 50 and sum(ok for ok, _ in judged) >= 0.98 * len(judged) and not any(r for _, r in judged)
    for i in (5000, 5001, 5002):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[5003].lang_pred in made and not got[None].held_out and got[5004].rejected and got[5006].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language.train(frame.limit(0))
    assert {r.lang_pred for r in language.languages(frame, nothing).collect()} == {"und"}
    assert rows_of(language.languages(frame.limit(0), model)) == []


# ---------------------------------------------------------------- 8
PAGE = ('<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><main><article><header><h2>Title &amp; co</h2></header>'
        '<p>One <b>two</b>th three four five six seven.<p>Second&nbsp;paragraph  here is\nlong enough.<ul><li>a<li>b</ul><aside>side</aside><form><input>Name</form></article>'
        '<div class="comments"><p>Reader comment that is rather long and talks a lot about things in general, more than the article does</p></div></main>'
        '<div id="sidebar-right"><p>bar</p></div><div class="cookie-notice">We use cookies</div><footer>f</footer><script>var x="<p>";</script><!-- c --></body>')


def test_pages(spark):
    plain = "<body><div><a href=a>m</a><a href=b>n</a></div><div>" + "<p>Long words make a dense paragraph here, " * 20 + "</div></body>"
    cases = [PAGE, plain, None, "", "just text", "<p>a<p>b", "<b>" * 3000 + "deep", "<script>x", "<nav><a>only menu</a></nav>", PAGE]
    frame = spark.createDataFrame([(i, "u", t, "q") for i, t in enumerate(cases)], "page_id long, url string, html string, text string")
    got = [r.text for r in html_density.extracted(frame).orderBy("page_id").collect()]
    assert got[0] == got[9] == "Title & co One twoth three four five six seven. Second paragraph here is long enough. a b"
    assert got[1] == " ".join(["Long words make a dense paragraph here,"] * 20)
    assert got[2:6] == ["", "", "just text", "a b"] and got[6] == "deep" and got[7] == got[8] == ""
    assert rows_of(html_density.extracted(frame.limit(0))) == []
    assert html.unescape("&amp;") == "&"


def test_blocks_inside_dropped_ones_are_not_the_centre():
    story = [f"Story {i} " + "long line of the article " * 16 for i in range(3)]
    article = "<article>" + "".join(f"<p>{t}</p>" for t in story) + "</article>"
    comments = "<div class='comments'><ol>" + "".join(f"<li><p>Reader {i} " + "says this and that " * 5 + "</p></li>" for i in range(40)) + "</ol></div>"
    want = " ".join(" ".join(story).split())
    assert html_density.main_text(f"<body>{article}{comments}</body>") == want
    assert html_density.main_text(f"<body><div>{article[9:-10]}</div>{comments}</body>") == want
    assert html_density.main_text(f"<body>{article}{comments.replace('<li>', '<li><article>').replace('</li>', '</article></li>')}</body>") == want
    assert html_density.main_text(f"<body><div class='with-sidebar'>{article}</div><div>Small text</div></body>") == want
    assert html_density.main_text(f"<body><form><div>{article[9:-10]}</div></form><p>Skip</p></body>") == want
    assert html_density.main_text(f"<body style='display:none'><div>{article[9:-10]}</div>{comments}</body>") == want
    assert html_density.main_text(f"<body><div class='modal'><div>{article[9:-10]}</div></div></body>") == want


def test_sections_that_reach_the_threshold_are_kept():
    first = "".join("<p>" + "word " * 99 + f"end{i}.</p>" for i in range(10))
    second = "".join("<p>" + "text " * 59 + f"fin{i}.</p>" for i in range(6))
    words = lambda *parts: " ".join(" ".join(re.sub("<.*?>", " ", p) for p in parts).split())
    pages = {
        "nested": f"<body><div><div>{first}</div><div>{second}</div></div></body>",
        "menu": f"<body><div><div><a href=a>m</a> <a href=b>n</a></div><div>{first}</div><div>{second}</div><div class='footer'>f</div></div></body>",
        "swapped": f"<body><div><div>{second}</div><div>{first}</div></div></body>",
        "direct": f"<body><div>{first}</div><div>{first}</div><div><a href=a>m</a><a href=b>n</a></div></body>",
        "modal": f"<body><div class='modal'><div><div>{first}</div><div>{second}</div></div></div></body>",
    }
    want = {"nested": words(first, second), "menu": words(first, second), "swapped": words(second, first), "direct": words(first, first), "modal": words(first, second)}
    assert {k: html_density.main_text(p) for k, p in pages.items()} == want


# ---------------------------------------------------------------- 9
def components(fps, distance=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= distance):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash(spark, table):
    import xxhash
    seeds = spark.sql("SELECT xxhash64('the quick brown') AS h").first().h
    assert seeds & (2 ** 64 - 1) == xxhash.xxh64_intdigest("the quick brown", 42)
    got = simhash.near_duplicates(table).collect()
    assert len(got) == table.count()
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def brute(t):
        w = word.findall((t or "").translate(LOW))
        if not w:
            return 0
        shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    want = collections.Counter((r.doc_id, f"{brute(r.text):016x}") for r in table.collect())
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == want
    fps = np.array([int(r.fingerprint, 16) for r in got], np.uint64)
    named = components(fps)
    smallest = {}
    for r, c in zip(got, named):
        if r.doc_id is not None:
            smallest[c] = min(smallest.get(c, r.doc_id), r.doc_id)
    assert all(r.component_id == smallest.get(c) for r, c in zip(got, named))
    assert rows_of(simhash.near_duplicates(table.limit(0))) == []


def test_links_of_dense_and_loose_families(spark):
    rnd = random.Random(0)
    family, loose = [rnd.getrandbits(64)], [rnd.getrandbits(64) for _ in range(300)]
    for source, n, flips in ((family, 700, (1, 2, 3)), (loose, 300, (2, 3, 4, 5))):
        for _ in range(n):
            x = rnd.choice(source)
            for b in rnd.sample(range(64), rnd.choice(flips)):
                x ^= 1 << b
            source.append(x)
    fps = np.unique(np.array(family + loose, np.uint64))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = simhash.links(frame, dense=16, chunk=100).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for e in edges:
        assert bin((e.a ^ e.b) & (2 ** 64 - 1)).count("1") <= 3
        a, b = root(at[e.a]), root(at[e.b])
        parent[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(fps))] == components(fps)
    assert len(edges) < 40 * len(fps)


# ---------------------------------------------------------------- 10
def test_archives(spark, tmp_path):
    rows = [(1, "u", "a"), (1, "v", "a"), (3, None, "a"), (None, "w", "a"), (None, "w", "b"), (None, "w", "b"), (5, "é x\r\ny", None), (4, "", ""), (7, "z", "é\r\n\r\n\0"), (8, "long", "ab" * 300_000), (2, "t", "ab" * 300_000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, sha string")
    got = warc.archived(pages).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == collections.Counter((i, len((t or "").encode()), digest(t)) for i, _, t in rows)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == sorted([
        (0, "response", 0), (0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "revisit", 1), (2, "response", 0), (3, "revisit", 1), (4, "response", 0), (5, "revisit", 4), (7, "response", 0), (8, "revisit", 2)])
    folder = str(tmp_path / "warc")
    index = warc.write_archives(pages, folder, file_bytes=2000, least=2)
    assert index.where("record_type = 'revisit'").select("id").collect() == [(8,)]
    some = warc.read_archives(index.where("id IN (2, 7, 8)"), folder, payloads=True).collect()
    assert sorted((r.id, None if r.payload is None else len(r.payload)) for r in some) == [(2, 600_000), (7, 7), (8, None)]
    row = index.where("id = 7").first()
    with open(f"{folder}/{row.file}", "rb") as f:
        f.seek(row.offset)
        whole = zlib.decompress(f.read(row.length), 31)
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and whole.endswith("é\r\n\r\n\0\r\n\r\n".encode())
    with pytest.raises(ValueError):
        warc.parse_record(whole.replace(b"\0\r\n\r\n", b"\1\r\n\r\n"))
    assert rows_of(warc.archived(pages.limit(0))) == []


def test_spread_join_equals_a_plain_join(spark):
    from mailgrain.llm.common import spread_join
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN id ELSE id % 50 END AS k")
    table = spark.range(0, 2900).selectExpr("id AS k", "id * 2 AS v")
    for part in (rows, rows.where("false")):
        counts = part.groupBy("k").agg(F.count("*").alias("n"))
        got = spread_join(part, table, "k", counts, "id").select("id", "k", "v")
        want = part.join(table, "k").select("id", "k", "v")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
