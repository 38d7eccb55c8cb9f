"""The operators for training text as registered queries, with the SQL they are checked against where SQL can express them."""

from pyspark.sql import functions as F

from ..session import ship_package
from . import conversation_repair, decontamination, divergence, html_density, language, lexical_search, lsh_forest, packing, secrets, simhash, token_edits, token_files, warc
from .common import table

QUERIES = {}
ORACLES = {}


def query(name, oracle=None):
    def register(fn):
        def run(spark, sf_dir):
            return fn(ship_package(spark), sf_dir)

        run.__doc__, run.__name__ = fn.__doc__, name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_edit_token_counts")
def edit_token_counts(spark, sf_dir):
    """Token counts of every document before and after a cleaning pass, updated in its tree."""
    return token_edits.edited(token_edits.with_trees(table(spark, sf_dir, "documents")))


CONTAMINATION_SQL = r"""
WITH it AS (SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, list_slice(w, s, s + 12) AS win FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM it WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM iw),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
pos AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n),
hit AS (SELECT DISTINCT doc_id, s, n, item FROM pos JOIN iw ON iw.win = list_slice(w, s, s + n - 1)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op2_winnowed_contamination", CONTAMINATION_SQL)
def winnowed_contamination(spark, sf_dir):
    """Benchmark passages in every document."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        decontamination.contaminated().alias("contaminated"))


@query("op3_divergence_quality")
def divergence_quality(spark, sf_dir):
    """Base measures and the divergence verdict of every document."""
    return divergence.judged(table(spark, sf_dir, "documents"))


@query("op4_best_two_fit_packing")
def best_two_fit_packing(spark, sf_dir):
    """All documents packed into sequences of 4096 tokens."""
    made = packing.packed(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op5_token_files")
def token_file_index(spark, sf_dir):
    """Token ids written to Parquet lists and read back."""
    return token_files.token_index(table(spark, sf_dir, "documents"))


@query("op6_random_secrets")
def random_secrets(spark, sf_dir):
    """Secrets by base rules and randomness tests in every document."""
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[secrets.of_kind(F.col("base"), k).alias(f"n_{k}") for k in secrets.KINDS],
                        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


@query("op7_kneser_ney_language")
def kneser_ney_language(spark, sf_dir):
    """Language of every document by Kneser-Ney character models."""
    docs = table(spark, sf_dir, "documents")
    return language.languages(docs, language.train(docs))


@query("op8_text_density")
def text_density(spark, sf_dir):
    """Main text of every page by composite text density."""
    return html_density.extracted(table(spark, sf_dir, "pages"))


@query("op9_simhash_blocks")
def simhash_blocks(spark, sf_dir):
    """SimHash fingerprints and near-duplicate components of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_warc_archive")
def warc_archive(spark, sf_dir):
    """Every page written to WARC archives and read back through the index."""
    return warc.archived(table(spark, sf_dir, "pages"))


def _repair_sql():
    """The dynamic programme as a fold over each conversation's rows; a state is (cost, edits, repaired text)."""
    step = []
    for target in range(4):
        ways = []
        for source in range(4):
            for k in range(3):
                middle, roles = conversation_repair._inserted(source, k)
                old = f"acc[{source + 1}]"
                lines = lambda more: " || ".join([f"{old}.t", *[f"'{r}:' || chr(10)" for r in roles], *more])
                add = lambda cost, letter, more, when: ways.append(
                    f"CASE WHEN {when} THEN {{'c': {old}.c + {cost + 5 * k}, 'a': {old}.a || '{'I' * k}{letter}', 't': {lines(more)}}} END")
                if middle == target:
                    add(2, "D", [], "true")
                for initial in "sua":
                    if conversation_repair._emitted(middle, initial) == target:
                        add(0, "K", ["x.role || ':' || x.text || chr(10)"], f"x.i = '{initial}' AND x.fault = 0")
                        add(5, "K", ["x.role || ':' || x.text || chr(10)"], f"x.i = '{initial}' AND x.fault = 3")
                role, after = ("assistant", 3) if middle == 2 else ("user", 2)
                if after == target:
                    add(1, "R", [f"'{role}:' || x.text || chr(10)"], "x.fault = 0")
                    add(6, "R", [f"'{role}:' || x.text || chr(10)"], "x.fault = 3")
        step.append(f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))")
    none = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
    init = f"[{{'c': 0::BIGINT, 'a': '', 't': ''}}, {none}, {none}, {none}]"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"  # plain ASCII
    crc = f"""xor(list_reduce(list_transform(string_split({key}, ''), lambda c: ascii(c)::BIGINT), lambda r, b: list_reduce(range(8), lambda v, j: CASE WHEN v & 1 = 1
  THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, xor(r, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""
    return rf"""
WITH raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS hit FROM conversations),
kept AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
  CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE hit <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM kept),
marked AS (SELECT *, substr(role, 1, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS prev FROM num),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (prev IS NOT NULL AND (prev || i) NOT IN ('su', 'ua', 'au')) AS illegal,
  list({{'i': i, 'role': role, 'text': text, 'fault': fault}} ORDER BY p) AS l FROM marked GROUP BY conv_id),
folded AS (SELECT *, list_reduce(l, lambda acc, x: [{', '.join(step)}], {init}) AS s FROM facts),
done AS (SELECT *, list_min([{{'c': s[1].c, 'a': s[1].a, 't': s[1].t}}, {{'c': s[2].c + 10, 'a': s[2].a || 'II', 't': s[2].t || 'user:' || chr(10) || 'assistant:' || chr(10)}},
  {{'c': s[3].c + 5, 'a': s[3].a || 'I', 't': s[3].t || 'assistant:' || chr(10)}}, {{'c': s[4].c, 'a': s[4].a, 't': s[4].t}}]) AS b FROM folded)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.t, 1, length(b.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query("op13_conversation_repair", _repair_sql())
def conversation_repairs(spark, sf_dir):
    """The cheapest repair of every damaged conversation."""
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


SEARCH_SQL = r"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
len AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM len),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, CAST(floor(1000 * ln((2 * (SELECT docs FROM total) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term),
impact AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))) AS part FROM tf JOIN len USING (doc_id) JOIN df USING (term), total),
score AS (SELECT item_id, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM q JOIN impact USING (term) GROUP BY ALL HAVING sum(times * part) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score) WHERE rank <= 10"""


@query("op12_max_sketch_search", SEARCH_SQL)
def max_sketch_search(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


FOREST_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a AS id, a AS other FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
part AS (SELECT id, min(other) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) IS NOT DISTINCT FROM d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN part ON part.id = d.doc_id"""


@query("op11_lsh_forest", FOREST_SQL)
def lsh_forest_duplicates(spark, sf_dir):
    """Near-duplicate components of every document, found by an LSH forest and confirmed on full sets."""
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))
