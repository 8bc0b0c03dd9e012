"""Queries over whole runs, corpora, readers and sinks, each with its SQL where SQL can say it."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.functions import text as T
from fathom.operators.chunkers import chunk_texts
from fathom.operators.classify import Rule
from fathom.operators.corpus import chunk_corpus
from fathom.operators.metrics import integrity_metrics
from fathom.operators.retrieve import ask, suggest_gold
from fathom.plans import experiments, runs
from fathom.plans.ledger import Ledger
from fathom.queries import ANSWERED, SENTENCES, WORDS, _bm25_sql, _queries, norm_sql, query, table
from fathom.runtime import new_path
from fathom.sources import readers, writers

# ---- settings, query sets and reports


@query("SELECT DISTINCT event_type || '_' || (user_id % 4) AS setting, (starts_with(event_type, 'click') OR starts_with(event_type, 'view')) AS allowed FROM events")
def allowed_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "events").select(F.concat_ws("_", "event_type", (F.col("user_id") % 4).cast("string")).alias("setting")).distinct()
    return names.select("setting", runs.allowed_mode(F.col("setting"), ["click", "view"]).alias("allowed"))


@query("SELECT 'first' AS cut, qid FROM (SELECT item_id AS qid FROM benchmark ORDER BY item_id LIMIT 7) UNION ALL SELECT 'all', item_id FROM benchmark")
def max_queries(spark, sf_dir):
    asked = _queries(spark, sf_dir).select("qid")
    return runs.first_queries(asked, 7, "qid").select(F.lit("first").alias("cut"), "qid").unionByName(runs.first_queries(asked, 0, "qid").select(F.lit("all").alias("cut"), "qid"))


@query(
    """SELECT count(*) FILTER (doc_id % 9 = 0) AS errors, count(*) FILTER (doc_id % 9 <> 0) AS valid, count(*) FILTER (doc_id % 9 <> 0 AND doc_id % 5 = 0) AS missing_gold,
    count(*) FILTER (doc_id % 9 <> 0 AND lang = 'en') AS en, count(*) FILTER (doc_id % 9 <> 0 AND lang = 'de') AS de, count(*) FILTER (doc_id % 9 <> 0 AND lang NOT IN ('en', 'de')) AS other FROM documents"""
)
def query_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_type"), F.when(F.col("doc_id") % 5 != 0, F.array("source")).alias("gold_sources"), F.when(F.col("doc_id") % 9 == 0, "line").alias("_error"))
    found = runs.audit(rows, ("en", "de"))
    return found.select("errors", "valid", "missing_gold", F.col("types")["en"].alias("en"), F.col("types")["de"].alias("de"), F.col("types")["UNKNOWN"].alias("other"))


@query(
    """SELECT event_type AS method, CAST(user_id % 4 AS VARCHAR) AS size, printf('%.4f', round(avg(value), 6)) AS hit_rate_at_1, printf('%.4f', coalesce(round(avg(value) FILTER (value < 0), 6), 0)) AS hit_rate_at_k,
    printf('%.4f', round(max(value), 6)) AS mrr, '0.0000' AS ndcg_at_k FROM events GROUP BY event_type, user_id % 4"""
)
def retrieval_summary_table(spark, sf_dir):
    """Reports of files named <method>_<size>; two metrics are missing in some or all."""
    file = F.concat(F.lit("out/eval_"), "event_type", F.lit("_"), (F.col("user_id") % 4).cast("string"), F.lit(".json"))
    below = F.round(F.avg(F.when(F.col("value") < 0, F.col("value"))), 6)
    reports = table(spark, sf_dir, "events").groupBy(file.alias("file")).agg(F.round(F.avg("value"), 6).alias("hit_rate_at_1"), below.alias("hit_rate_at_k"), F.round(F.max("value"), 6).alias("mrr"))
    return runs.retrieval_summary(reports)


@query("SELECT CAST(128 * (1 + doc_id % 3) AS INTEGER) AS chunk_size, count(*) AS chunks, round(avg((toxic = 1)::INT), 6) AS fallback_rate FROM labels GROUP BY 1")
def fallback_rate(spark, sf_dir):
    flags = table(spark, sf_dir, "labels").select((128 * (1 + F.col("doc_id") % 3)).cast("int").alias("chunk_size"), F.when(F.col("toxic") == 1, True).alias("fallback_chunked"))
    return runs.fallback_rates(flags)


@query(
    """SELECT lang, count(*) AS total, sum(bad)::BIGINT AS broken, round(100 - round(100 * avg(bad), 4), 4) AS executable_pct
    FROM (SELECT lang, CAST(doc_id % 7 = 0 OR (doc_id % 7 = 1 AND regexp_matches(coalesce(text, ''), '^[^a-zA-Z]*[a-z]')) AS INTEGER) AS bad FROM documents) GROUP BY lang"""
)
def executable_rate(spark, sf_dir):
    """Every text as a comment above code. In a seventh a bracket stays open; in another the first letter
    of the text, if it is a small one of ASCII, is an operator that lacks its operand."""
    said = F.concat(F.lit("# "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\R|[^ -~]", " "))
    small = F.regexp(F.coalesce("text", F.lit("")), F.lit("^[^a-zA-Z]*[a-z]"))
    code = F.when(F.col("doc_id") % 7 == 0, "x = (1\n").when((F.col("doc_id") % 7 == 1) & small, "x = 1 +\n").otherwise("x = (1)\n")
    made = table(spark, sf_dir, "documents").select("lang", F.concat(said, F.lit("\n"), code).alias("text"), F.lit(False).alias("is_orphan"))
    return runs.executable_rates(integrity_metrics(made, ["lang"])).select("lang", "total", F.col("syntax_error_count").alias("broken"), "executable_pct")


@query(
    f"""WITH {_bm25_sql()}, r AS (SELECT qid, doc, rank FROM best WHERE rank <= 5), want AS (SELECT DISTINCT item_id AS qid, source AS s FROM benchmark JOIN documents ON doc_id = item_id)
    SELECT r.qid, r.doc, r.rank, want.s IS NOT NULL AS relevant FROM r JOIN documents d ON d.doc_id = r.doc LEFT JOIN want ON want.qid = r.qid AND want.s = d.source"""
)
def qrels_judged(spark, sf_dir):
    from fathom.queries import _text_arm

    docs = table(spark, sf_dir, "documents")
    ranked = _text_arm(spark, sf_dir, 5).join(docs.select(F.col("doc_id").alias("doc"), F.col("source").alias("source_file")), "doc")
    qrels = _queries(spark, sf_dir).join(docs, F.col("doc_id") == F.col("qid")).select("qid", F.col("source").alias("source_file"))
    return runs.judged(ranked, qrels).select("qid", "doc", "rank", "relevant")


KEYS = f"""p AS (SELECT conv_id * 1000 + turn AS id, * FROM ({ANSWERED})),
k AS (SELECT {norm_sql('question')} AS key, max(id) AS query_id FROM p GROUP BY 1),
e AS (SELECT CAST(id AS INTEGER) AS id, conv_id, string_split(answer, ' ')[1] AS short, [trim(x) FOR x IN string_split(question, ',') IF trim(x) <> ''] AS keys FROM p WHERE id % 4 <> 0)"""


@query(
    f"""WITH {KEYS}, r AS (SELECT 's' || (p.conv_id % 2) AS setting, CAST(k.query_id AS INTEGER) AS query_id, p.question AS query, p.answer, coalesce(e.short, '') AS short, coalesce(e.keys, []) AS keys,
      CASE WHEN k.query_id % 3 = 0 THEN 'FACT' ELSE '' END AS kind FROM p JOIN k ON k.key = {norm_sql('p.question')} LEFT JOIN e ON e.id = k.query_id WHERE p.question <> '')
    SELECT setting, query_id, kind AS query_type, query, short AS short_answer, left(answer, 300) AS answer_preview,
      CASE WHEN short = '' THEN 0 ELSE contains({norm_sql('answer')}, {norm_sql('short')})::INT END AS exact_match,
      round(coalesce(len([x FOR x IN keys IF contains({norm_sql('answer')}, {norm_sql('x')})]) / nullif(len(keys), 0), 0), 6) AS entity_recall FROM r"""
)
def answer_correctness(spark, sf_dir):
    """User turns as queries and the answers to them, found again by their normalised text; one query in
    four has no keys, and two in three no type."""
    from fathom.queries import _answered

    held = _answered(spark, sf_dir).withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn"))
    asked = held.select("query_id", F.col("question").alias("query"), F.when(F.col("query_id") % 3 == 0, "FACT").alias("query_type"))
    keys = held.where("query_id % 4 <> 0").select("query_id", F.element_at(F.split("answer", " "), 1).alias("short_answer"), F.replace(F.replace("question", F.lit(";"), F.lit("\x01")), F.lit(","), F.lit(";")).alias("key_entities"))
    answers = held.select(F.concat(F.lit("s"), (F.col("conv_id") % 2).cast("string")).alias("setting"), F.col("question").alias("query"), F.col("answer").alias("answer_full"), F.lit("").alias("answer_preview"))
    truths = held.select("query_id", F.lit("").alias("ground_truth_answer"))
    return runs.in_order(runs.answer_correctness(answers, asked, truths, keys)).drop("semantic_similarity")


SUGGEST = _bm25_sql(low=True).replace("AS term FROM benchmark)", "AS term FROM (SELECT item_id, trim(text || ' ' || left(text, 24)) AS text FROM benchmark))")


@query(
    f"""WITH {SUGGEST} SELECT qid, CASE WHEN qid % 2 = 0 THEN 1 ELSE 0 END AS n_gold, CAST(rank AS INTEGER) AS rank, doc AS doc_id, round(score, 4) AS score, left(text, 160) AS preview
    FROM best JOIN documents ON doc_id = doc WHERE rank <= 3"""
)
def gold_suggest_expected(spark, sf_dir):
    items = _queries(spark, sf_dir).select("qid", "query", F.left("query", F.lit(24)).alias("expected"), F.when(F.col("qid") % 2 == 0, F.array(F.lit("p"))).alias("gold_paragraph_ids"))
    found = suggest_gold(table(spark, sf_dir, "documents"), items, doc="doc_id")
    return found.select("qid", F.size("gold_paragraph_ids").alias("n_gold"), F.explode("suggested_gold_paragraphs").alias("s")).select("qid", "n_gold", "s.rank", F.col("s.id").alias("doc_id"), F.round("s.score", 4).alias("score"), "s.preview")


# ---- from questions to answers


def _asked_sql(where: str = "TRUE") -> str:
    return f"""WITH {_bm25_sql(where=where)}, top AS (SELECT * FROM best WHERE rank <= 3),
    s AS (SELECT qid, rank, unnest({SENTENCES}) AS x, generate_subscripts({SENTENCES}, 1) AS i FROM top JOIN documents ON doc_id = doc),
    a AS (SELECT qid, string_agg(x, ' ' ORDER BY rank, i) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, i) AS n FROM s) WHERE n <= 3 GROUP BY qid)
    SELECT t.qid, string_agg(t.doc, ',' ORDER BY t.rank) AS sources, coalesce(any_value(a.answer), '') AS answer FROM top t LEFT JOIN a USING (qid) GROUP BY t.qid"""


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", "lang", "source")


def _answers(rows):
    return rows.select("qid", F.array_join("sources", ",").alias("sources"), "answer")


@query(_asked_sql())
def ask_extractive(spark, sf_dir):
    return _answers(ask(_chunks(spark, sf_dir), _queries(spark, sf_dir), method="bm25"))


@query(f"SELECT 'de' AS setting, * FROM ({_asked_sql('lang = ' + chr(39) + 'de' + chr(39))}) UNION ALL SELECT 'fr', * FROM ({_asked_sql('lang = ' + chr(39) + 'fr' + chr(39))})")
def answer_sweep(spark, sf_dir):
    chunks = _chunks(spark, sf_dir).withColumn("setting", F.col("lang"))
    return experiments.answer_sweep(chunks, _queries(spark, sf_dir), ["de", "fr"], method="bm25").select("setting", "qid", F.array_join("sources", ",").alias("sources"), "answer")


HEADED = _bm25_sql().replace("FROM documents WHERE", "FROM (SELECT doc_id, '[source: ' || source || ']' || chr(10) || text AS text FROM documents) WHERE")


@query(f"SELECT 'plain' AS arm, * FROM (WITH {_bm25_sql()} SELECT qid, doc, rank FROM best WHERE rank <= 5) UNION ALL SELECT 'header', * FROM (WITH {HEADED} SELECT qid, doc, rank FROM best WHERE rank <= 5)")
def metadata_ablation(spark, sf_dir):
    chunks = _chunks(spark, sf_dir).drop("lang")
    return experiments.metadata_ablation(chunks, _queries(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


# ---- corpora of two kinds of files

_WINDOW = f"""SELECT name, unnest(generate_series(0, CAST(ceil(greatest(len(w) - 128, 0) / 108.0) * 108 AS BIGINT), 108)) AS i, w, kind, label FROM
(SELECT lang || '_' || doc_id AS name, {WORDS} AS w, CASE WHEN lang = 'en' THEN 'code' ELSE NULL END AS kind, CASE WHEN lang = 'de' THEN 'german' WHEN lang <> 'en' THEN 'other' END AS label FROM documents) WHERE len(w) > 0"""


@query(
    f"""SELECT name || CASE WHEN kind = 'code' THEN '.py' ELSE '.txt' END AS source_file, CAST(i // 108 AS VARCHAR) AS chunk_id, kind AS source, label AS topic, 'token' AS chunk_mode, 128 AS chunk_size, 20 AS chunk_overlap,
    md5(array_to_string(w[i + 1 : i + 128], ' ')) AS digest FROM ({_WINDOW})"""
)
def corpus_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    named = lambda kind: docs.select(F.concat("lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(kind)).alias("source_file"), "text", "lang")
    rules = [Rule({"topic": "german"}, name="^de_"), Rule({"topic": "other"})]
    made = chunk_corpus(named(".txt").where("lang <> 'en'").drop("lang"), named(".py").where("lang = 'en'").drop("lang"), "token", 128, 20, rules)
    return made.select("source_file", "chunk_id", "source", "topic", "chunk_mode", "chunk_size", "chunk_overlap", F.md5("text").alias("digest"))


GRID = [("token", 64), ("token", 128), ("token", 256)]


@query(
    f"""SELECT 'token_' || s AS setting, CAST(sum(CASE WHEN n = 0 THEN 0 ELSE 1 + ceil(greatest(n - s, 0) / (s - 50.0)) END) AS BIGINT) AS chunks, 1::BIGINT AS times_done
    FROM (SELECT len({WORDS}) AS n FROM documents), (SELECT unnest([64, 128, 256]) AS s) GROUP BY s"""
)
def resumed_settings(spark, sf_dir):
    """A grid that is stopped after its first setting and in the middle of the second, and run again."""
    docs, folder = table(spark, sf_dir, "documents"), new_path(spark, "grid")
    done = []

    def stopping(name):
        if done:
            raise InterruptedError
        done.append(name)
        return chunk_texts(docs, "token", int(name.split("_")[1]), 50)

    ledger = Ledger(spark, folder)
    with contextlib.suppress(InterruptedError):
        ledger.run([f"{m}_{s}" for m, s in GRID], stopping)
    left = Ledger(spark, folder).run([f"{m}_{s}" for m, s in GRID], lambda name: chunk_texts(docs, "token", int(name.split("_")[1]), 50))
    times = spark.createDataFrame([(x,) for x in [*done, *left]], "name string").groupBy("name").agg(F.count("*").alias("times_done"))
    found = ledger.results("doc_id long, pos int, text string").groupBy("setting").agg(F.count("*").alias("chunks"))
    return found.join(F.broadcast(times), F.col("setting") == F.col("name")).select("setting", "chunks", "times_done")


_EXAMPLES = [("de", "SELECT 0 AS qid, 'de' AS lang"), ("en", "SELECT 1, 'en'"), ("fr", "SELECT 2, 'fr'"), ("es", "SELECT 3, 'es'"), (None, "SELECT 4, NULL")]
FIRST_WORDS = f"SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS n, array_to_string({WORDS}[1:6], ' ') AS text FROM benchmark QUALIFY n < 5"


@query(
    f"""WITH {_bm25_sql().replace("AS term FROM benchmark)", f"AS term FROM (SELECT n AS item_id, text FROM ({FIRST_WORDS})))").replace("FROM benchmark CROSS JOIN", f"FROM (SELECT n AS item_id FROM ({FIRST_WORDS})) CROSS JOIN")},
    want AS ({" UNION ALL ".join(x for _, x in _EXAMPLES)}), r AS (SELECT b.qid, b.doc, b.rank, d.text FROM best b JOIN want USING (qid) JOIN documents d ON d.doc_id = b.doc WHERE b.rank <= 1000 AND (want.lang IS NULL OR d.lang = want.lang)),
    t AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place, left(replace(text, chr(10), ' '), 200) AS preview FROM r QUALIFY place <= 3)
    SELECT qid::BIGINT AS qid, doc, place AS rank, preview, NULL::VARCHAR AS error FROM t UNION ALL SELECT 5, NULL, NULL, NULL, 'ValueError: no question'"""
)
def filtered_examples(spark, sf_dir):
    """Five questions, four of them with a filter, and one that fails, in a batch."""
    from fathom.cli import search_batch

    words = F.array_join(F.slice(T.tokens(F.col("text")), 1, 6), " ")
    first = [r[0] for r in table(spark, sf_dir, "benchmark").orderBy("item_id").limit(5).select(words).collect()]
    asked = [(q, '{"lang": "%s"}' % lang if lang else None) for q, (lang, _) in zip(first, _EXAMPLES, strict=False)]
    return search_batch(_chunks(spark, sf_dir), [*asked, ("", None)], k=3, method="bm25").select("qid", "doc", F.col("rank").cast("long").alias("rank"), "preview", "error")


# ---- sinks and readers: what is written comes back

_PLAIN = "SELECT doc_id, text, lang, source FROM documents"


def _sent(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@query(_PLAIN)
def round_trip_json_lines(spark, sf_dir):
    path = new_path(spark, "json")
    writers.write_json(_sent(spark, sf_dir), path)
    return readers.json_lines(spark, path, "doc_id long, text string, lang string, source string")


@query(_PLAIN)
def round_trip_json_array(spark, sf_dir):
    """All documents, in lists of a bounded size."""
    path = new_path(spark, "list")
    writers.write_json_lists(_sent(spark, sf_dir), path)
    return readers.json_array(spark, path, "doc_id long, text string, lang string, source string")


@query("SELECT lang, CAST(count(*) AS VARCHAR) AS documents, CAST(min(doc_id) AS VARCHAR) AS first_doc FROM documents GROUP BY lang")
def round_trip_csv(spark, sf_dir):
    path = new_path(spark, "csv")
    report = _sent(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))
    writers.write_csv(report, path, ["lang", "documents", "first_doc"])
    return readers.csv_table(spark, path)


@query("SELECT * FROM embeddings")
def round_trip_vectors(spark, sf_dir):
    path = new_path(spark, "vectors")
    writers.write_vectors(table(spark, sf_dir, "embeddings"), path)
    return readers.vectors(spark, path)


@query(
    """SELECT 'details' AS part, CAST(doc_id AS VARCHAR) AS key, CAST(quality AS DOUBLE) AS value FROM labels
    UNION ALL SELECT 'metrics', 'coverage', round(avg(quality), 6) FROM labels"""
)
def round_trip_metrics(spark, sf_dir):
    path, labels = new_path(spark, "metrics"), table(spark, sf_dir, "labels")
    writers.write_metrics(labels.agg(F.round(F.avg("quality"), 6).alias("coverage")), labels.select("doc_id", "quality"), path)
    details = readers.json_lines(spark, f"{path}/details", "doc_id long, quality int").select(F.lit("details").alias("part"), F.col("doc_id").cast("string").alias("key"), F.col("quality").cast("double").alias("value"))
    return details.unionByName(readers.json_lines(spark, f"{path}/metrics", "coverage double").select(F.lit("metrics").alias("part"), F.lit("coverage").alias("key"), F.col("coverage").alias("value")))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE 'ok' END AS kind, count(*) AS n, CAST(coalesce(sum(doc_id) FILTER (doc_id % 3 <> 0), 0) AS BIGINT) AS ids FROM documents GROUP BY 1")
def lines_with_errors(spark, sf_dir):
    """Every third line is cut off; it is a row with an error, not a failed read."""
    path = new_path(spark, "lines")
    whole = F.to_json(F.struct("doc_id", F.col("lang").alias("query_type")))
    _sent(spark, sf_dir).select(F.when(F.col("doc_id") % 3 == 0, F.left(whole, F.lit(6))).otherwise(whole).alias("value")).write.text(path)
    rows = readers.json_lines_with_errors(spark, path, "doc_id long, query_type string")
    kind = F.when(F.col("_error").isNotNull(), "error").otherwise("ok")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("_error").isNull(), F.col("doc_id"))), F.lit(0)).alias("ids"))


@query("SELECT event_type AS setting, user_id % 4 AS part, count(*) AS n FROM events GROUP BY 1, 2")
def files_by_setting(spark, sf_dir):
    """A report for each type of event, one list in one file; the setting is read from the path."""
    path, events = new_path(spark, "settings"), table(spark, sf_dir, "events")
    report = events.groupBy("event_type", (F.col("user_id") % 4).alias("part")).agg(F.count("*").alias("n"))
    for r in report.select("event_type").distinct().toLocalIterator():
        writers.write_json_array(report.where(F.col("event_type") == r[0]).select("part", "n"), f"{path}/{r[0]}.json")
    return readers.by_setting(spark, f"{path}/*.json", "part long, n long", r"/([^/]+)\.json/[^/]*$").select("setting", "part", "n")


@query("SELECT source, string_agg('=== ' || lang || ' ===' || chr(10) || n || ' texts', chr(10) || chr(10) ORDER BY lang) AS text FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def titled_pages(spark, sf_dir):
    """A page for each language of a source under its title; one text a source."""
    pages = _sent(spark, sf_dir).groupBy("source", "lang").agg(F.concat(F.count("*").cast("string"), F.lit(" texts")).alias("text"))
    return runs.titled(pages, "lang", title="lang", by=["source"])


@query("SELECT m AS chunk_mode, CAST(s AS INTEGER) AS chunk_size, m || '_' || s AS setting FROM (SELECT unnest(['click', 'view', 'none']) AS m), (SELECT unnest([0, 1, 2, 7]) AS s) WHERE m || '_' || s NOT IN (SELECT event_type || '_' || (user_id % 4) FROM events)")
def settings_left(spark, sf_dir):
    done = table(spark, sf_dir, "events").select(F.concat_ws("_", "event_type", (F.col("user_id") % 4).cast("string")).alias("setting")).distinct()
    return runs.open_settings(spark, ["click", "view", "none"], [0, 1, 2, 7], done)
