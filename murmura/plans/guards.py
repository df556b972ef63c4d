"""Queries that judge recognised text: rate, script, repetition, echo, in one chain of guards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from murmura.functions import guards as G
from murmura.functions import text as T
from murmura.sources import adapters as src

#: The first half of the alphabet: an allowed script that leaves much of the test data foreign.
HALF = "[A-Ma-m]"
#: Languages that a session admits.
LANGUAGES = ("en", "de", "fr")


def documents(spark, sf_dir):
    """Recognised texts with the seconds of sound that they stand for."""
    seconds = F.col("n_chars") / 15.0 * (1 + F.col("doc_id") % 3) / 2
    return src.read(spark, sf_dir, "documents").select("doc_id", "text", "lang", seconds.alias("duration"))


def asr_rate_guard(spark, sf_dir):
    """More than 8 words or 28 characters a second can't be speech."""
    words, chars = T.word_count(F.col("text")), T.dense_chars(F.col("text"))
    fast = (F.col("duration") > 0.4) & ((words / F.col("duration") > 8) | (chars / F.col("duration") > 28))
    return documents(spark, sf_dir).select("doc_id", words.cast("long").alias("n_words"), chars.cast("long").alias("n_chars"), fast.alias("dropped"))


def script_profile(spark, sf_dir):
    inside, outside = T.script_profile(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", inside.cast("long").alias("allowed"), outside.cast("long").alias("foreign_letters"), F.bround(T.foreign_share(F.col("text")), 6).alias("share"))


def dominant_language(spark, sf_dir):
    scripts = {"ext": T.OTHER, "late": "[N-Zn-z]", "early": HALF}
    return documents(spark, sf_dir).select("doc_id", T.dominant_language(F.col("text"), scripts, "early").alias("language"))


def strip_foreign_tokens(spark, sf_dir):
    kept = T.strip_foreign(F.col("text"), HALF)
    return documents(spark, sf_dir).select("doc_id", kept.alias("kept"), F.bround(T.foreign_share(F.col("text"), HALF), 6).alias("share"))


def token_run_longest(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.longest_run(T.tokens(F.col("text"))).alias("longest_run"))


def repetition_guard(spark, sf_dir):
    found = G.guarded(documents(spark, sf_dir).select("doc_id", "text"), "text", strip=False)
    return found.select("doc_id", F.bround("unique_ratio", 6).alias("unique_ratio"), F.col("top_trigram").cast("int").alias("top_trigram"), "degenerate")


def with_context(df, last=1200, rows=500):
    """The end of the document before as context, within the same language.

    A language may hold most of the table, so neighbours meet in ranges of doc_id of about ``rows``
    documents; a range's first document gets its context from the range before, of which one row is left.
    """
    low, high, n = df.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    width = 1 if low is None else (high - low) // (n // rows + 1) + 1
    df = df.withColumns(
        {
            "_lang": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")),
            "_range": F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / width), F.lit(-1)),
            "_end": F.right("text", F.lit(last)),
        }
    )
    order = F.struct(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)))
    ends = df.groupBy("_lang", "_range").agg(F.max_by("_end", order).alias("_before"))
    # A language has a range for each ``rows`` documents: they are put in order in groups, of which again one row each is left.
    ends = ends.withColumn("_group", F.floor(F.col("_range") / 1000))
    carried = ends.groupBy("_lang", "_group").agg(F.max_by("_before", "_range").alias("_carried"))
    carried = carried.withColumn("_carried", F.lag("_carried").over(Window.partitionBy("_lang").orderBy("_group")))
    group = Window.partitionBy("_lang", "_group").orderBy("_range")
    ends = ends.withColumns({"_first": F.row_number().over(group) == 1, "_lag": F.lag("_before").over(group)}).join(carried, ["_lang", "_group"])
    ends = ends.select("_lang", "_range", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag")).alias("_before"))
    w = Window.partitionBy("_lang", "_range").orderBy("doc_id")
    df = df.withColumns({"_n": F.row_number().over(w), "_lag": F.lag("_end").over(w)}).join(ends, ["_lang", "_range"], "left")
    context = F.coalesce(F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_lag")), F.lit(""))
    return df.withColumn("context", context).drop("_lang", "_range", "_end", "_n", "_lag", "_before")


def context_echo(spark, sf_dir):
    df = with_context(documents(spark, sf_dir).select("doc_id", "text", "lang")).withColumn("context", F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.col("context")))
    return G.echoed(df.select("doc_id", "text", "context"), "text", "context").select("doc_id", F.bround("echo_share", 6).alias("share"), "echo")


def clean_transcript_reasons(spark, sf_dir):
    """The guards in order, the language at the end; the first that fires names the reason and the text is dropped."""
    text, allowed = F.col("text"), "[A-Ta-t]"
    df = with_context(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    df = df.withColumns({"context": F.when(F.col("doc_id") % 5 == 0, text).otherwise(F.col("context")), "share": T.foreign_share(text, allowed), "blank": F.trim(F.coalesce(text, F.lit(""))) == ""})
    df = G.guarded(df, "text", "context", G.Guard(allowed=allowed))
    reason = (
        F.when(F.col("blank"), "blank")
        .when(F.col("kept") == "", "foreign script")
        .when((F.col("share") >= 0.3) & (F.col("n_tokens") < 3), "remnant too short")
        .when(F.col("degenerate"), "repetition loop")
        .when(F.col("echo"), "echo of the context")
        .when(~F.coalesce(F.col("lang").isin(*LANGUAGES), F.lit(False)), "language")
    )
    return df.select("doc_id", reason.alias("reason"), F.when(reason.isNull(), F.char_length("kept")).otherwise(0).cast("long").alias("kept_chars"))


TOK = r"list_filter(string_split_regex(coalesce({0}, ''), '\s+'), lambda x: x <> '')"


def _tok(c: str) -> str:
    return TOK.format(c)


def _n(c: str, cls: str) -> str:
    return f"len(regexp_extract_all(coalesce({c}, ''), '{cls}'))"


def _share(c: str, cls: str) -> str:
    return rf"CASE WHEN {_n(c, chr(92) + 'p{L}')} = 0 THEN 0e0 ELSE ({_n(c, chr(92) + 'p{L}')} - {_n(c, cls)}) / {_n(c, chr(92) + 'p{L}')} END"


def _strip(c: str, cls: str) -> str:
    return rf"coalesce(array_to_string(list_filter({_tok(c)}, lambda t: {_n('t', chr(92) + 'p{L}')} - {_n('t', cls)} <= 0.5e0 * {_n('t', chr(92) + 'p{L}')}), ' '), '')"


def _runs(source: str) -> str:
    """Common table expressions: run(doc_id, longest_run) of source(doc_id, text)."""
    return rf"""
tk AS (SELECT doc_id, unnest({_tok('text')}) AS token, generate_subscripts({_tok('text')}, 1) AS n FROM {source}),
ky AS (SELECT doc_id, n, replace(lower(trim(token, '.,!?…:;')), 'ß', 'ss') AS k FROM tk),
br AS (SELECT *, CASE WHEN k = lag(k) OVER (PARTITION BY doc_id ORDER BY n) THEN 0 ELSE 1 END AS b FROM ky),
ru AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS r FROM br),
rl AS (SELECT doc_id, r, count(*) AS m FROM ru WHERE k <> '' GROUP BY doc_id, r),
run AS (SELECT s.doc_id, coalesce(max(m), 0)::INT AS longest_run FROM {source} s LEFT JOIN rl USING (doc_id) GROUP BY s.doc_id)"""


def _grams(source: str, name: str = "g") -> str:
    """Common table expressions: tops(doc_id, n_tokens, n_unique, top) of source(doc_id, text)."""
    return rf"""
ft AS (SELECT doc_id, list_transform({_tok('text')}, lambda x: replace(lower(x), 'ß', 'ss')) AS t FROM {source}),
gr AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS gram FROM ft WHERE len(t) >= 3),
gc AS (SELECT doc_id, max(c) AS top FROM (SELECT doc_id, gram, count(*) AS c FROM gr GROUP BY ALL) GROUP BY doc_id),
tops AS (SELECT ft.doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_unique, coalesce(top, 0)::INT AS top FROM ft LEFT JOIN gc USING (doc_id))"""


_DEGENERATE = "(longest_run >= 4 OR n_tokens >= 12 AND (n_unique / n_tokens < 0.45e0 OR top >= 3))"

QUERIES = {f.__name__: f for f in (asr_rate_guard, script_profile, dominant_language, strip_foreign_tokens, token_run_longest, repetition_guard, context_echo, clean_transcript_reasons)}

SQL = {
    "asr_rate_guard": rf"""
WITH d AS (SELECT doc_id, len({_tok('text')}) AS n_words, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS n, n_chars / 15e0 * (1 + doc_id % 3) / 2 AS duration FROM documents)
SELECT doc_id, n_words, n AS n_chars, duration > 0.4e0 AND (n_words / duration > 8 OR n / duration > 28) AS dropped FROM d""",
    "script_profile": rf"SELECT doc_id, {_n('text', '[A-Za-z]')} AS allowed, {_n('text', chr(92) + 'p{L}')} - {_n('text', '[A-Za-z]')} AS foreign_letters, round_even({_share('text', '[A-Za-z]')}, 6) AS share FROM documents",
    "dominant_language": rf"""
WITH c AS (SELECT doc_id, {_n('text', '[À-ÖØ-öø-ɏ]')} AS x, {_n('text', '[N-Zn-z]')} AS l, {_n('text', '[A-Ma-m]')} AS e FROM documents)
SELECT doc_id, CASE WHEN x + l + e = 0 THEN NULL WHEN x > 0 AND x >= e THEN 'ext' WHEN l > 0 AND l >= e THEN 'late' ELSE 'early' END AS language FROM c""",
    "strip_foreign_tokens": rf"SELECT doc_id, {_strip('text', HALF)} AS kept, round_even({_share('text', HALF)}, 6) AS share FROM documents",
    "token_run_longest": f"WITH {_runs('documents')} SELECT * FROM run",
    "repetition_guard": f"""WITH {_runs('documents')}, {_grams('documents')}
SELECT doc_id, round_even(CASE WHEN n_tokens = 0 THEN 1e0 ELSE n_unique / n_tokens END, 6) AS unique_ratio, top AS top_trigram, {_DEGENERATE} AS degenerate FROM tops JOIN run USING (doc_id)""",
    "context_echo": rf"""
WITH p AS (SELECT doc_id, text, coalesce(right(lag(text) OVER (PARTITION BY lang ORDER BY doc_id), 1200), '') AS context FROM documents),
d AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN text ELSE context END AS context FROM p),
t AS (SELECT doc_id, list_transform({_tok('text')}, lambda x: replace(lower(x), 'ß', 'ss')) AS t, list_transform({_tok('context')}, lambda x: replace(lower(x), 'ß', 'ss')) AS c FROM d),
g AS (SELECT doc_id, len(t) AS nt, len(c) AS nc, list_transform(range(1, greatest(1, len(t) - 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS own,
             list_transform(range(1, greatest(1, len(c) - 1)), lambda i: c[i] || ' ' || c[i + 1] || ' ' || c[i + 2]) AS given FROM t),
s AS (SELECT doc_id, nt, nc, CASE WHEN len(own) = 0 THEN 0e0 ELSE len(list_filter(own, lambda x: list_contains(given, x))) / len(own) END AS share FROM g)
SELECT doc_id, round_even(share, 6) AS share, nt >= 5 AND nc >= 3 AND share >= 0.8e0 AS echo FROM s""",
    "clean_transcript_reasons": rf"""
WITH k AS (SELECT doc_id, lang, text AS source, {_strip('text', '[A-Ta-t]')} AS text, {_share('text', '[A-Ta-t]')} AS share FROM documents), {_runs('k')}, {_grams('k')},
c AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text ELSE coalesce(right(lag(text) OVER (PARTITION BY lang ORDER BY doc_id), 1200), '') END AS context FROM documents),
h AS (SELECT doc_id, list_transform({_tok('context')}, lambda x: replace(lower(x), 'ß', 'ss')) AS c FROM c),
e AS (SELECT h.doc_id, t, list_transform(range(1, greatest(1, len(t) - 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS own, list_transform(range(1, greatest(1, len(c) - 1)), lambda i: c[i] || ' ' || c[i + 1] || ' ' || c[i + 2]) AS given FROM h JOIN ft USING (doc_id)),
m AS (SELECT doc_id, len(t) >= 5 AND len(given) > 0 AND len(list_filter(own, lambda x: list_contains(given, x))) / greatest(1, len(own)) >= 0.8e0 AS echo FROM e),
r AS (
  SELECT k.doc_id, text, CASE WHEN trim(coalesce(source, '')) = '' THEN 'blank' WHEN text = '' THEN 'foreign script' WHEN share >= 0.3e0 AND n_tokens < 3 THEN 'remnant too short' WHEN {_DEGENERATE} THEN 'repetition loop'
    WHEN echo THEN 'echo of the context' WHEN lang NOT IN ('en', 'de', 'fr') OR lang IS NULL THEN 'language' END AS reason
  FROM k JOIN run USING (doc_id) JOIN tops USING (doc_id) JOIN m USING (doc_id)
)
SELECT doc_id, reason, CASE WHEN reason IS NULL THEN length(text) ELSE 0 END::BIGINT AS kept_chars FROM r""",
}
