"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the DuckDB SQL of each.

Documents stand for responses: ``source`` is a configuration's label, ``labels.quality`` splits corpora, a conversation is a trial and
its turns are the prompt steps. Sampler parameters are not in the tables; reports that need some derive them from the id
(temperature = 0.1 * (doc_id % 5), min_p = 0.05 * (doc_id % 3), adaptive_target = 0.25 * (doc_id % 2)). Scores are those of all
families with the standard patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.functions import lazy as Z
from proseline.functions import lint as L
from proseline.functions import metrics as M
from proseline.functions import text as T
from proseline.functions.score import score
from proseline.operators import reports as R
from proseline.operators import sweep as S
from proseline.operators.schedule import ledger
from proseline.operators.suggest import suggest
from proseline.sources.scratch import saved

from . import oracle as O
from .seeds import seeded, seeded_sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: Bytes of documents, as they lie in files, that a task scores.
TASK_BYTES = 4 << 20
#: Literals that do occur in the tables.
FREQUENT = Z.PatternSet(("tion", "the", "ei", "que", "the"), (r"!{3,}",))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(struct: str, schema: dict) -> list:
    return [F.round(F.col(f"{struct}.{k}"), 6).alias(k) if t == "d" else F.col(f"{struct}.{k}").cast("long").alias(k) for k, t in schema.items()]


# --- metrics ---------------------------------------------------------------------------------------------------------
@query("coherence_by_source", O.COHERENCE_BY_SOURCE)
def coherence_by_source(spark, sf_dir):
    rows = docs(spark, sf_dir).select("source", M.coherence(F.col("text"))["coherence_score"].alias("c"))
    return rows.groupBy("source").agg(F.round(F.avg("c"), 6).alias("avg_coherence"), F.count("*").alias("n"))


@query("sentence_stats", O.SENTENCE_STATS)
def sentence_stats(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", M.coherence(F.col("text")).alias("m")).select("doc_id", *_rounded("m", {"sentence_count": "i", "avg_sentence_length": "d", "sentence_length_variation": "d", "coherence_score": "d"}))


REPETITION_KEYS = ["token_repetition_rate", "bigram_repetition_rate", "trigram_repetition_rate", "consecutive_repetition_score", "sentence_duplicate_ratio", "sequence_repetition_score", "repetition_penalty"]


@query("repetition", O.REPETITION_Q)
def repetition(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", M.repetition(F.col("text")).alias("m")).select("doc_id", *_rounded("m", dict.fromkeys(REPETITION_KEYS, "d")))


@query("readability", O.READABILITY_Q)
def readability(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", M.readability(F.col("text")).alias("m")).select("doc_id", *_rounded("m", {"word_count": "i", "avg_word_length": "d", "lexical_diversity": "d", "readability_score": "d"}))


@query("prose_metrics", O.PROSE_Q)
def prose_metrics(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", M.prose(F.col("text")).alias("m")).select("doc_id", *_rounded("m", dict.fromkeys([*M.E_WEIGHTS, "prose_penalty"], "d")))


def _lazy(spark, sf_dir, patterns):
    rows = docs(spark, sf_dir).select("doc_id", Z.lazy(F.col("text"), patterns).alias("m"))
    return rows.select("doc_id", F.round("m.lazy_score", 6).alias("lazy_score"), "m.has_lazy_text", "m.lazy_pattern_count")


@query("lazy_score", O.lazy(Z.STANDARD.literals, Z.STANDARD.regexes))
def lazy_score(spark, sf_dir):
    return _lazy(spark, sf_dir, Z.STANDARD)


@query("lazy_fallback", O.lazy(Z.FALLBACK_LITERALS, Z.FALLBACK_REGEXES))
def lazy_fallback(spark, sf_dir):
    """The patterns that are scanned for when a pattern file can't be used."""
    return _lazy(spark, sf_dir, Z.PatternSet())


@query("lazy_literals", O.lazy(FREQUENT.literals, FREQUENT.regexes))
def lazy_literals(spark, sf_dir):
    """Literals that do occur, one of them listed twice."""
    return _lazy(spark, sf_dir, FREQUENT)


@query("lazy_standard")
def lazy_standard(spark, sf_dir):
    """With the list of hits, which SQL has no order for; tests hold it against plain Python."""
    return docs(spark, sf_dir).select("doc_id", Z.lazy(F.col("text")).alias("m")).select("doc_id", "m.*")


@query("lint_counts", O.LINT_COUNTS)
def lint_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", L.lint_counts(F.col("text")).alias("m")).select("doc_id", "m.counts.*")


@query("lint_score", O.LINT_SCORE)
def lint_score(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", L.lint_counts(F.col("text")).alias("m")).select("doc_id", "m.score", "m.band", "m.word_count", "m.weighted_sum")


@query("phrase_reuse", O.REUSE_Q)
def phrase_reuse(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", L.repeated_ngrams(F.coalesce("text", F.lit(""))).alias("g"))
    return rows.select("doc_id", F.size("g").cast("long").alias("n_phrases"), F.coalesce(F.get("g", F.lit(0))["phrase"], F.lit("")).alias("top_phrase"))


@query("lint_counts_seeded", seeded_sql(O.LINT_COUNTS))
def lint_counts_seeded(spark, sf_dir):
    """Over documents in which every rule has something to find."""
    return seeded(docs(spark, sf_dir)).select("doc_id", L.lint_counts(F.col("text")).alias("m")).select("doc_id", "m.counts.*")


@query("lint_score_seeded", seeded_sql(O.LINT_SCORE))
def lint_score_seeded(spark, sf_dir):
    return seeded(docs(spark, sf_dir)).select("doc_id", L.lint_counts(F.col("text")).alias("m")).select("doc_id", "m.score", "m.band", "m.word_count", "m.weighted_sum")


@query("lazy_hits_seeded", seeded_sql(O.lazy_hits(Z.STANDARD.literals, Z.STANDARD.regexes)))
def lazy_hits_seeded(spark, sf_dir):
    """The list of hits as text (pattern=n, in the patterns' order) besides the score."""
    rows = seeded(docs(spark, sf_dir)).select("doc_id", Z.lazy(F.col("text")).alias("m"))
    return rows.select("doc_id", F.round("m.lazy_score", 6).alias("lazy_score"), "m.lazy_pattern_count", F.array_join(F.transform("m.lazy_patterns_found", lambda x: F.concat(x["pattern"], F.lit("="), x["n"].cast("string"))), ";").alias("hits"))


@query("lint_violations")
def lint_violations(spark, sf_dir):
    """A row for each violation, with its context."""
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(L.violations(F.coalesce("text", F.lit("")))).alias("pos", "v"))
    return rows.select("doc_id", "pos", "v.*", L.violation_json(F.col("v")).alias("payload"))


@query("quality_score", f"{O.FULL} SELECT doc_id, round(quality_score, 6) AS quality_score FROM scored")
def quality_score(spark, sf_dir):
    return score(docs(spark, sf_dir)).select("doc_id", F.round("quality_score", 6).alias("quality_score"))


SCORES = [*REPETITION_KEYS, *M.E_WEIGHTS, "prose_penalty", "coherence_score", "readability_score", "lazy_score", "lint_score", "quality_score"]
_SQL_NAMES = dict(zip(REPETITION_KEYS[:-1], ("tok", "bi", "tri", "run", "dup", "seq"), strict=True))


@query("full_score", f"{O.FULL} SELECT doc_id, {', '.join(f'round({_SQL_NAMES.get(k, k)}, 6) AS {k}' for k in SCORES)}, CAST(sentence_count AS BIGINT) AS sentence_count, CAST(lazy_pattern_count AS BIGINT) AS lazy_pattern_count, CAST(lint_violations AS BIGINT) AS lint_violations FROM scored")
def full_score(spark, sf_dir):
    """Every metric with the standard patterns."""
    return rounded(score(docs(spark, sf_dir)).select("doc_id", *SCORES, "sentence_count", "lazy_pattern_count", "lint_violations"))


# --- text cleaning ---------------------------------------------------------------------------------------------------
@query("token_counts", f"""WITH {O.DOCS} SELECT doc_id, CAST(len({O.words('t')}) AS BIGINT) AS words, CAST(len(regexp_extract_all(lower(t), '{O._W}')) AS BIGINT) AS lower_words,
  CAST({O.n('t', '[a-zA-Z]+')} AS BIGINT) AS alpha_words, CAST(len({O.sentences('t')}) AS BIGINT) AS sentences, CAST(len({O.lines('t')}) AS BIGINT) AS lines FROM d""")  # fmt: skip
def token_counts(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    found = {"words": T.words(t), "lower_words": T.lower_words(t), "alpha_words": T.alpha_words(t), "sentences": T.sentences(t), "lines": T.lines(t)}
    return docs(spark, sf_dir).select("doc_id", *[F.size(c).cast("long").alias(k) for k, c in found.items()])


@query("preprocess", f"""WITH {O.DOCS} SELECT doc_id, md5({O.strip("regexp_replace(regexp_replace(lower(t), '[!-/:-@\\[-`{-~]', '', 'g'), '" + O.SP + "+', ' ', 'g')")}) AS digest FROM d""")
def preprocess(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.preprocess(F.coalesce("text", F.lit("")))).alias("digest"))


@query("excerpt", f"""WITH {O.DOCS}, p AS (SELECT *, {O.words('t')} AS w FROM d)
  SELECT doc_id, md5(CASE WHEN len(w) > 600 THEN array_to_string(w[len(w) // 4 + 1 : len(w) // 4 + 500], ' ') ELSE t END) AS digest FROM p""")  # fmt: skip
def excerpt(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.excerpt(F.coalesce("text", F.lit("")))).alias("digest"))


@query("strip_thinking", f"""WITH m AS (SELECT conv_id, turn, '<think>' || role || '</think> ' || coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN ' [THINK] open' ELSE '' END AS t FROM conversations),
  a AS (SELECT *, {O.strip("regexp_replace(t, '(?s)<think>.*?</think>\\s*', '', 'g')")} AS u FROM m)
  SELECT conv_id, turn, md5({O.strip("regexp_replace(u, '(?s)\\[THINK\\].*', '', 'g')")}) AS digest, count(*) AS n FROM a GROUP BY ALL""")
def strip_thinking(spark, sf_dir):
    """Turns with a thinking block put before them, every second one with an unclosed block after it."""
    t = F.concat(F.lit("<think>"), "role", F.lit("</think> "), F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, " [THINK] open").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.strip_thinking(t)).alias("digest")).groupBy("conv_id", "turn", "digest").agg(F.count("*").alias("n"))


@query("valid_responses", f"SELECT role, count(*) AS n, count(*) FILTER (WHERE len({O.strip('text')}) >= 20) AS valid FROM conversations GROUP BY role")
def valid_responses(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(T.valid_response(F.col("text"))).alias("valid"))


# --- reports ---------------------------------------------------------------------------------------------------------
_SCORED: dict[tuple, DataFrame] = {}


def scored(spark, sf_dir) -> DataFrame:
    """Documents with all metrics but without their texts, written once for all reports of a session. A table whose files (name, size or
    time) have changed is scored anew."""
    found = docs(spark, sf_dir)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = [jvm.org.apache.hadoop.fs.Path(f) for f in sorted(found.inputFiles())]
    states = [p.getFileSystem(conf).getFileStatus(p) for p in files]
    key = (spark.sparkContext.applicationId, sf_dir, *((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in states))
    if key not in _SCORED:
        # dealt out by size: a file's row groups can be few and large, and each is one task
        n = max(spark.sparkContext.defaultParallelism, -(-sum(s.getLen() for s in states) // TASK_BYTES))
        rows = score(found.select("doc_id", "source", "lang", "text").repartition(n)).withColumn("response_length", F.coalesce(F.length("text"), F.lit(0)))
        _SCORED[key] = saved(rows.drop("text"))
    return _SCORED[key]


def responses(spark, sf_dir) -> DataFrame:
    """Documents scored by all families, with derived parameters."""
    i = F.col("doc_id")
    return scored(spark, sf_dir).withColumns({"temperature": 0.1 * (i % 5), "min_p": 0.05 * (i % 3), "adaptive_target": 0.25 * (i % 2), "success": i % 10 != 0})


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


COMBO = "avg(quality_score) * 0.4 + (1 - avg(repetition_penalty)) * 0.3 + avg(coherence_score) * 0.2 + avg(readability_score) * 0.1"
MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("quality_score", "repetition_penalty", "coherence_score", "readability_score", "response_length"))


@query("best_configs", f"""{O.FULL}, b AS (SELECT round(temperature, 6) AS temperature, round(min_p, 6) AS min_p, round(adaptive_target, 6) AS adaptive_target, {MEANS}, count(*) AS n, {COMBO} AS o FROM scored GROUP BY temperature, min_p, adaptive_target)
  SELECT * EXCLUDE o, round(o, 6) AS overall_score, row_number() OVER (ORDER BY o DESC) AS rank FROM b ORDER BY o DESC LIMIT 10""")  # fmt: skip
def best_configs(spark, sf_dir):
    return rounded(R.best_configs(responses(spark, sf_dir), R.CONFIG_KEYS))


@query("chat_configs", f"""{O.FULL}, b AS (SELECT source, {MEANS}, count(*) AS n, avg(quality_score * 0.4 + (1 - repetition_penalty) * 0.3 + coherence_score * 0.2 + readability_score * 0.1) AS o FROM scored WHERE source IS NOT NULL GROUP BY source)
  SELECT * EXCLUDE o, round(o, 6) AS overall_score FROM b ORDER BY o DESC LIMIT 5""")
def chat_configs(spark, sf_dir):
    return rounded(R.chat_configs(responses(spark, sf_dir), ["source"]))


@query("summary_stats", f"""{O.FULL} SELECT count(*) AS total_requests, round(avg(CAST(success AS INT)), 6) AS success_rate, round(avg(response_length), 6) AS avg_response_length, round(median(response_length), 6) AS median_response_length,
  min(response_length) AS min_response_length, max(response_length) AS max_response_length, round(avg(quality_score), 6) AS avg_quality_score, round(avg(repetition_penalty), 6) AS avg_repetition_penalty, round(avg(coherence_score), 6) AS avg_coherence_score,
  round(avg(readability_score), 6) AS avg_readability_score, round(avg(quality_score), 6) AS avg_overall_quality, round(max(quality_score), 6) AS best_quality_score, round(min(quality_score), 6) AS worst_quality_score FROM scored""")
def summary_stats(spark, sf_dir):
    out = R.summary(responses(spark, sf_dir))
    return rounded(out.drop(*[c for c in out.columns if c.endswith("_range")]))


CORRELATED = ["quality_score", "repetition_penalty", "coherence_score", "readability_score", "response_length"]


@query("correlations", O.FULL + " SELECT a, b, round(r, 6) AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM scored" for a in CORRELATED for b in CORRELATED) + ")")
def correlations(spark, sf_dir):
    return rounded(R.correlations(responses(spark, sf_dir), CORRELATED))


def _tall(metrics) -> str:
    return "sl AS MATERIALIZED (SELECT * FROM scored JOIN labels USING (doc_id)), t AS (" + " UNION ALL ".join(f"SELECT quality AS corpus, '{m}' AS metric, coalesce({m}, 0) AS value FROM sl" for m in metrics) + ")"


def labelled(spark, sf_dir) -> DataFrame:
    return responses(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("corpus")), "doc_id")


@query("calibration", f"{O.FULL}, {_tall(R.CALIBRATION_METRICS)} SELECT corpus, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) AS n FROM t GROUP BY corpus, metric")
def calibration(spark, sf_dir):
    return rounded(R.calibration(labelled(spark, sf_dir), "corpus")).withColumn("corpus", F.col("corpus").cast("int"))


@query("calibration_pivot", f"{O.FULL}, {_tall(R.COMPARED_METRICS)}, m AS (SELECT metric, avg(value) FILTER (WHERE corpus = 0) AS low, avg(value) FILTER (WHERE corpus = 1) AS high FROM t GROUP BY metric) SELECT metric, round(low, 6) AS low, round(high, 6) AS high, round(high - low, 6) AS gap FROM m")
def calibration_pivot(spark, sf_dir):
    out = R.corpus_comparison(labelled(spark, sf_dir), "corpus", [0, 1], 1, 0)
    return rounded(out.select("metric", F.col("`0`").alias("low"), F.col("`1`").alias("high"), "gap"))


_BANDED = "CASE WHEN quality_score >= 0.8 THEN 'clean' WHEN quality_score >= 0.7 THEN 'light' WHEN quality_score >= 0.5 THEN 'moderate' WHEN quality_score >= 0.3 THEN 'heavy' ELSE 'saturated' END"


@query("worst_band", f"""{O.FULL}, b AS (SELECT source, doc_id, {_BANDED} AS band FROM scored), rk AS (SELECT *, CASE band WHEN 'clean' THEN 0 WHEN 'light' THEN 1 WHEN 'heavy' THEN 3 ELSE 2 END AS k, CASE band WHEN 'clean' THEN 0 WHEN 'light' THEN 1 WHEN 'heavy' THEN 3 WHEN 'saturated' THEN 4 ELSE 2 END AS f FROM b)
  SELECT source, first(band ORDER BY k DESC, doc_id) AS worst_band, first(band ORDER BY f DESC, doc_id) AS worst_band_fixed FROM rk GROUP BY source""")
def worst_band(spark, sf_dir):
    """Bands cut from the quality score, so that all of them occur."""
    return R.worst_band(responses(spark, sf_dir).withColumn("band", F.expr(_BANDED)), "source", "band", "doc_id")


def _turns(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select(F.col("conv_id").alias("trial"), F.col("turn").alias("step"), F.size(T.words(F.coalesce("text", F.lit("")))).cast("long").alias("n_words"), (F.size(T.words(F.coalesce("text", F.lit("")))) / 100.0).alias("quality_score"))


_TURNS = f"turns AS (SELECT conv_id AS trial, turn AS step, len({O.words("coalesce(text, '')")}) AS n_words, len({O.words("coalesce(text, '')")}) / 100.0 AS quality_score FROM conversations WHERE role = 'assistant')"


@query("running_mean", f"WITH {_TURNS} SELECT trial, step, round(quality_score, 6) AS quality_score, round(avg(quality_score) OVER (PARTITION BY trial ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_mean FROM turns")
def running_mean(spark, sf_dir):
    return rounded(R.running_mean(_turns(spark, sf_dir), "trial", "step", "quality_score"))


_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in [*R.AVERAGED_METRICS, "response_length"])


@query("average_by_trial", f"""{O.FULL}, bd AS (SELECT source, doc_id, CASE WHEN response_length > 0 THEN {O.BAND} ELSE 'unknown' END AS band FROM scored),
  wb AS (SELECT source, first(band ORDER BY CASE band WHEN 'clean' THEN 0 WHEN 'light' THEN 1 WHEN 'heavy' THEN 3 ELSE 2 END DESC, doc_id, band) AS lint_band FROM bd GROUP BY source),
  en AS ({O.lazy_entries(Z.STANDARD.literals, Z.STANDARD.regexes)}), ec AS (SELECT source, pattern, n, count(*) AS times FROM en GROUP BY source, pattern, n),
  li AS (SELECT source, string_agg(pattern || '=' || CAST(n AS VARCHAR) || 'x' || CAST(times AS VARCHAR), ';' ORDER BY pattern, n) AS found FROM ec GROUP BY source),
  av AS (SELECT source, {_MEANS}, CAST(sum(lazy_pattern_count) AS BIGINT) AS lazy_pattern_count, round(avg(quality_score), 6) AS mean_score,
  round(CASE WHEN count(*) > 1 THEN var_pop(quality_score) ELSE 0 END, 6) AS score_variance, round(min(quality_score), 6) AS score_min FROM scored GROUP BY source)
  SELECT av.source AS trial, av.* EXCLUDE (source), lint_band, coalesce(found, '') AS lazy_patterns_found FROM av JOIN wb ON av.source IS NOT DISTINCT FROM wb.source LEFT JOIN li ON av.source IS NOT DISTINCT FROM li.source""")
def average_by_trial(spark, sf_dir):
    """Sources as trials. The list of hits is text (pattern=n x how often, in order)."""
    out = rounded(R.average_by_trial(responses(spark, sf_dir).withColumnRenamed("source", "trial"), order="doc_id"))
    text = F.transform("lazy_patterns_found", lambda x: F.concat(x["pattern"], F.lit("="), x["n"].cast("string"), F.lit("x"), x["times"].cast("string")))
    return out.withColumn("lazy_patterns_found", F.array_join(text, ";"))


_PATS = " UNION ALL ".join(f"SELECT source AS trial, doc_id, {O.q(p)} AS pattern, (len(lower(t)) - len(replace(lower(t), {O.q(p)}, ''))) // {len(p)} AS n FROM d" for p in FREQUENT.literals)


@query("pattern_frequency", f"""WITH {O.DOCS}, h AS ({_PATS} UNION ALL SELECT source, doc_id, '!{{3,}}', {O.n('t', '!{3,}')} FROM d)
  SELECT pattern, CAST(sum(n) AS BIGINT) AS hits, count(DISTINCT trial) AS trials, round(count(DISTINCT trial) * 100.0 / (SELECT count(DISTINCT source) FROM d), 6) AS percent FROM h WHERE n > 0 GROUP BY pattern ORDER BY hits DESC, pattern LIMIT 30""")
def pattern_frequency(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("source").alias("trial"), Z.lazy(F.col("text"), FREQUENT)["lazy_patterns_found"].alias("lazy_patterns_found"))
    return rounded(R.pattern_frequency(rows))


@query("histogram", f"""{O.FULL}, e AS (SELECT min(quality_score) AS lo, max(quality_score) AS hi FROM scored), b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(19, CAST(floor((quality_score - lo) / ((hi - lo) / 20)) AS BIGINT)) END AS bin FROM scored, e)
  SELECT CAST(k AS BIGINT) AS bin, round(lo + k * (hi - lo) / 20, 6) AS low, round(lo + (k + 1) * (hi - lo) / 20, 6) AS high, (SELECT count(*) FROM b WHERE bin = k) AS n FROM e, (SELECT unnest(range(20)) AS k)""")
def histogram(spark, sf_dir):
    return rounded(R.histogram(responses(spark, sf_dir), "quality_score", 20))


@query("box_stats", f"""{O.FULL}, b AS (SELECT round(temperature, 6) AS temperature, quantile_cont(CAST(response_length AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(response_length AS DOUBLE), 0.5) AS median, quantile_cont(CAST(response_length AS DOUBLE), 0.75) AS q3 FROM scored GROUP BY 1)
  SELECT b.temperature, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(response_length) FILTER (WHERE response_length BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low,
    max(response_length) FILTER (WHERE response_length BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (WHERE NOT response_length BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS n
  FROM scored JOIN b ON round(scored.temperature, 6) = b.temperature GROUP BY b.temperature, q1, median, q3""")
def box_stats(spark, sf_dir):
    return rounded(R.box_stats(responses(spark, sf_dir).withColumn("temperature", F.round("temperature", 6)), "temperature", "response_length"))


@query("parameter_density", """WITH v AS (SELECT 'temperature' AS parameter, CAST(0.1 * (doc_id % 5) AS DOUBLE) AS v FROM documents UNION ALL SELECT 'min_p', CAST(0.05 * (doc_id % 3) AS DOUBLE) FROM documents UNION ALL SELECT 'adaptive_target', CAST(0.25 * (doc_id % 2) AS DOUBLE) FROM documents),
  s AS (SELECT parameter, min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h FROM v GROUP BY parameter), x AS (SELECT *, lo + point * (hi - lo) / 100 AS x FROM (SELECT *, unnest(range(101)) AS point FROM s))
  SELECT parameter, CAST(point AS BIGINT) AS point, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - v) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 6) AS density FROM x JOIN v USING (parameter) GROUP BY parameter, point, x""")
def parameter_density(spark, sf_dir):
    """Density curves of the sampler parameters; all their values lie on nodes of the grid, so they are the kernel sums themselves."""
    i = F.col("doc_id")
    rows = docs(spark, sf_dir).select((0.1 * (i % 5)).alias("temperature"), (0.05 * (i % 3)).alias("min_p"), (0.25 * (i % 2)).alias("adaptive_target"))
    return rounded(R.density(rows, R.CONFIG_KEYS, points=101))


@query("flatten_parameters", "SELECT doc_id, round(0.1 * (doc_id % 5), 6) AS temperature, round(CASE WHEN doc_id % 2 = 0 THEN 2.0 ELSE 1.0 END, 6) AS top_nsigma FROM documents")
def flatten_parameters(spark, sf_dir):
    i = F.col("doc_id")
    nested = docs(spark, sf_dir).select("doc_id", F.struct((0.1 * (i % 5)).alias("temperature"), F.when(i % 2 == 0, 2.0).alias("top_nsigma")).alias("parameters"))
    return rounded(R.flatten_parameters(nested)).withColumn("doc_id", F.col("doc_id"))


@query("interpretation", f"""{O.FULL}, m AS (SELECT source, avg(repetition_penalty) AS r, avg(coherence_score) AS c FROM scored GROUP BY source)
  SELECT source, CASE WHEN r < 0.3 THEN 'low' WHEN r < 0.5 THEN 'moderate' ELSE 'high' END AS repetition, CASE WHEN c > 0.7 THEN 'high' WHEN c > 0.5 THEN 'moderate' ELSE 'low' END AS coherence FROM m""")
def interpretation(spark, sf_dir):
    means = R.group_means(responses(spark, sf_dir), ["source"], ["repetition_penalty", "coherence_score"])
    return means.select("source", R.interpretation(F.lit(1.0), F.col("repetition_penalty"), F.col("coherence_score")).alias("i")).select("source", "i.repetition", "i.coherence")


@query("seeded_sample", "SELECT doc_id, source FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 40")
def seeded_sample(spark, sf_dir):
    return R.seeded_sample(docs(spark, sf_dir).select("doc_id", "source"), "doc_id", 40)


# --- experiment control ----------------------------------------------------------------------------------------------
_TRIALS = "trials AS (SELECT o_orderkey AS trial, CASE WHEN o_orderkey % 4 = 3 THEN 'PRUNED' ELSE 'COMPLETE' END AS state, o_totalprice / 1e6 AS value FROM orders)"


def _trials(spark, sf_dir) -> DataFrame:
    """Orders as trials: every fourth one pruned, the price as the value."""
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("trial"), F.when(F.col("o_orderkey") % 4 == 3, "PRUNED").otherwise("COMPLETE").alias("state"), (F.col("o_totalprice") / 1e6).alias("value"))


@query("trial_summary", f"""{O.FULL}, t AS (SELECT doc_id AS trial, quality_score AS value, (0.2 * coherence_score + 0.2 * readability_score + 0.3 * (1 - lazy_score) + 0.3 * lint_score / 100) * (1 - repetition_penalty) * (1 - prose_penalty) AS o FROM scored WHERE success),
  k AS (SELECT *, round(o, 12) AS ok FROM t)
  SELECT count(*) AS completed_trials, round(max(value), 6) AS best_quality_score, round(avg(value), 6) AS avg_quality_score, round(max(ok), 6) AS best_overall_score, round(avg(ok), 6) AS avg_overall_score, first(trial ORDER BY ok DESC, trial) AS best_trial,
  round(avg(1 + trial % 3), 6) AS avg_prompts_per_trial, round(avg(value / 100), 6) AS avg_score_variance, round(avg(value / 2), 6) AS avg_score_min FROM k""")
def trial_summary(spark, sf_dir):
    """Documents as trials, with their metrics; a tenth of them failed."""
    rows = responses(spark, sf_dir).withColumns({"state": F.when(F.col("success"), "COMPLETE").otherwise("FAIL"), "num_prompts_evaluated": 1 + F.col("doc_id") % 3, "score_variance": F.col("quality_score") / 100, "score_min": F.col("quality_score") / 2})
    frame = S.trials_frame(rows.withColumnsRenamed({"doc_id": "trial", "quality_score": "value"}))
    return rounded(S.trial_summary(frame.withColumn("overall_score", F.round("overall_score", 12))))


@query("revalidation", f"WITH {_TRIALS} SELECT trial, round(value, 6) AS value FROM trials WHERE state = 'COMPLETE' AND trial < 12 ORDER BY value DESC, trial LIMIT 3")
def revalidation(spark, sf_dir):
    rows = _trials(spark, sf_dir).withColumn("num_prompts_evaluated", F.lit(1))
    return rounded(S.revalidation(rows, 12, 3).select("trial", "value"))


@query("schedule", f"""WITH {_TRIALS}, r AS (SELECT *, row_number() OVER (ORDER BY trial) AS place FROM trials),
  q AS (SELECT trial AS original_trial, value AS original_value, 12 + row_number() OVER (ORDER BY value DESC, trial) AS queued FROM (SELECT * FROM r WHERE place <= 12 AND state = 'COMPLETE' ORDER BY value DESC, trial LIMIT 3))
  SELECT trial, place, CASE WHEN place <= 12 THEN 'startup' WHEN queued IS NOT NULL THEN 'revalidation' WHEN place <= 103 THEN 'search' ELSE 'over' END AS phase, original_trial, round(original_value, 6) AS original_value,
    round(CASE WHEN state = 'COMPLETE' THEN value - original_value END, 6) AS change, greatest(0, 103 - place) AS "left" FROM r LEFT JOIN q ON place = queued""")
def schedule(spark, sf_dir):
    """The two-phase ledger of a budget of 100 trials, 12 of them for the start, over all recorded ones."""
    return rounded(ledger(_trials(spark, sf_dir), 100, 12, 5))


_SPACE = "p AS (SELECT trial, value, state, 0.1 * (trial % 5) AS temperature, 0.05 * (trial % 3) AS min_p FROM trials)"


@query("suggestion", f"""WITH {_TRIALS}, {_SPACE}, t AS (SELECT *, row_number() OVER (ORDER BY value DESC, trial) AS place FROM p WHERE state = 'COMPLETE' AND value IS NOT NULL), k AS (SELECT least(25, ceil(0.1 * count(*))) AS good FROM t),
  v AS (SELECT 'temperature' AS parameter, CAST(temperature AS DOUBLE) AS v, place <= good AS good FROM t, k UNION ALL SELECT 'min_p', CAST(min_p AS DOUBLE), place <= good FROM t, k), r AS (SELECT parameter, min(v) AS lo, max(v) AS hi FROM v GROUP BY parameter),
  s AS (SELECT parameter, good, lo, hi, count(*) AS n, greatest(coalesce(stddev_samp(v), 0) * pow(count(*), -0.2), (hi - lo) / 100) AS h FROM v JOIN r USING (parameter) GROUP BY parameter, good, lo, hi),
  c AS (SELECT a.v AS temperature, b.v AS min_p FROM (SELECT DISTINCT v FROM v WHERE parameter = 'temperature') a, (SELECT DISTINCT v FROM v WHERE parameter = 'min_p') b),
  x AS (SELECT DISTINCT parameter, v AS x FROM v), d AS (SELECT parameter, good, x, ln((any_value(1 / (hi - lo)) + sum(exp(-0.5 * pow((x - v) / h, 2)) / (h * sqrt(2 * pi())))) / (any_value(n) + 1)) AS l FROM x JOIN v USING (parameter) JOIN s USING (parameter, good) GROUP BY parameter, good, x),
  g AS (SELECT parameter, x, sum(CASE WHEN good THEN l ELSE -l END) AS gain FROM d GROUP BY parameter, x)
  SELECT round(c.temperature, 6) AS temperature, round(c.min_p, 6) AS min_p, round(a.gain + b.gain, 6) AS gain FROM c JOIN g a ON a.parameter = 'temperature' AND a.x = c.temperature JOIN g b ON b.parameter = 'min_p' AND b.x = c.min_p""")
def suggestion(spark, sf_dir):
    """How promising each combination of two parameters is, by all recorded trials."""
    trials = _trials(spark, sf_dir).withColumns({"temperature": 0.1 * (F.col("trial") % 5), "min_p": 0.05 * (F.col("trial") % 3)})
    return rounded(suggest(trials, trials.select("temperature", "min_p").distinct(), ["temperature", "min_p"]))


@query("progress", f"""WITH {_TRIALS}, r AS (SELECT trial, max(CASE WHEN state = 'COMPLETE' THEN value END) OVER w AS best, CAST(sum(CASE WHEN state = 'PRUNED' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS pruned,
  row_number() OVER (ORDER BY trial) AS n FROM trials WINDOW w AS (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT trial, round(best, 6) AS best, pruned FROM r WHERE n % 5 = 0""")
def progress(spark, sf_dir):
    return rounded(S.progress(_trials(spark, sf_dir)))


@query("convergence", f"""WITH RECURSIVE {_TRIALS}, f AS (SELECT *, row_number() OVER (ORDER BY trial) AS i FROM trials),
  fold(i, seen, best, done, total, stop) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 0, 0, CAST(NULL AS BIGINT)
    UNION ALL SELECT i, seen, CASE WHEN better THEN seen ELSE best END, d, t, CASE WHEN d >= 25 OR t >= 50 THEN trial END FROM (
      SELECT *, CASE WHEN better THEN 0 ELSE done + c END AS d, CASE WHEN better THEN 0 ELSE total + 1 END AS t FROM (
        SELECT *, c = 1 AND (best IS NULL OR seen > best + 0.005) AS better FROM (
          SELECT f.i, f.trial, CASE WHEN state = 'COMPLETE' THEN 1 ELSE 0 END AS c, CASE WHEN state = 'COMPLETE' THEN greatest(coalesce(fold.seen, value), value) ELSE fold.seen END AS seen, best, done, total FROM fold JOIN f ON f.i = fold.i + 1 WHERE fold.stop IS NULL))))
  SELECT stop AS stop_trial, round(best, 6) AS best FROM fold ORDER BY i DESC LIMIT 1""")
def convergence(spark, sf_dir):
    return rounded(S.convergence(_trials(spark, sf_dir), 25, 0.005))


@query("median_prune", f"""WITH {_TURNS}, r AS (SELECT trial, step, avg(quality_score) OVER w AS value FROM turns WINDOW w AS (PARTITION BY trial ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  b AS (SELECT *, max(value) OVER (PARTITION BY trial ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM r),
  h AS (SELECT b.trial, b.step, b.best, median(o.value) AS median, count(*) AS n FROM b JOIN b o ON o.step = b.step AND o.trial < b.trial WHERE b.step >= 1 GROUP BY ALL)
  SELECT trial, step, round(best, 6) AS best, round(median, 6) AS median, best < median AS prune FROM h WHERE n >= 10""")
def median_prune(spark, sf_dir):
    """Conversations as trials, their assistant turns as steps."""
    steps = R.running_mean(_turns(spark, sf_dir), "trial", "step", "quality_score").select("trial", "step", F.col("running_mean").alias("value"), F.lit("COMPLETE").alias("state"))
    return rounded(S.median_prune(steps))


@query("failures", f"""SELECT conv_id AS trial, count(*) AS prompts, count(*) FILTER (WHERE len({O.strip('text')}) < 120) AS failed_prompts, count(*) FILTER (WHERE len({O.strip('text')}) >= 120) = 0 AS all_failed FROM conversations GROUP BY conv_id""")
def failures(spark, sf_dir):
    return S.failures(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "trial"), T.valid_response(F.col("text"), 120))


_TURN_DOCS = f"""WITH documents AS MATERIALIZED (SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS doc_id, text, CAST(conv_id AS VARCHAR) AS source,
  CASE WHEN len({O.strip('text')}) >= 20 THEN 'valid' ELSE 'failed' END AS lang FROM conversations), qa AS"""


@query("objective", f"""{O.unicode_classes(O.FULL.replace('WITH qa AS', _TURN_DOCS, 1))}, o AS (SELECT CAST(source AS BIGINT) AS trial, count(*) AS prompts, count(*) FILTER (WHERE lang = 'failed') AS failed_prompts, avg(quality_score) FILTER (WHERE lang = 'valid') AS m,
  coalesce(var_pop(quality_score) FILTER (WHERE lang = 'valid'), 0) AS v, min(quality_score) FILTER (WHERE lang = 'valid') AS score_min FROM scored GROUP BY source)
  SELECT trial, prompts, failed_prompts, round(m, 6) AS mean_score, round(v, 6) AS score_variance, round(score_min, 6) AS score_min, CASE WHEN m >= 0.1 THEN 'COMPLETE' ELSE 'PRUNED' END AS state FROM o""")
def objective(spark, sf_dir):
    """Conversations as trials, their turns as responses."""
    return rounded(S.objective(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trial"), "text")))


@query("eval_summary", f"""WITH e AS (SELECT len({O.words("coalesce(text, '')")}) / 100.0 AS s, len({O.strip('text')}) >= 10 AS ok FROM conversations)
  SELECT count(*) AS prompts, count(*) FILTER (WHERE ok) AS evaluated, round(avg(s) FILTER (WHERE ok), 6) AS mean_score, round(min(s) FILTER (WHERE ok), 6) AS min_score, round(max(s) FILTER (WHERE ok), 6) AS max_score FROM e""")
def eval_summary(spark, sf_dir):
    """Turns as prompts, with a word count for a score."""
    rows = table(spark, sf_dir, "conversations").select("text", (F.size(T.words(F.coalesce("text", F.lit("")))) / 100.0).alias("score"))
    return rounded(R.eval_summary(rows, "score", T.valid_response(F.col("text"), 10)))


@query("select_prompts", f"""WITH {_TRIALS}, p AS (SELECT 'p' || CAST(k AS VARCHAR) AS prompt, CAST(k AS INT) AS pos FROM (SELECT unnest(range(8)) AS k)),
  r AS (SELECT trial, prompt, pos, row_number() OVER (PARTITION BY trial ORDER BY md5('study:' || CAST(trial AS VARCHAR) || ':' || prompt), pos) AS rank FROM trials, p)
  SELECT trial, prompt, pos FROM r WHERE rank <= CASE WHEN trial < 12 THEN 1 ELSE 3 END""")
def select_prompts(spark, sf_dir):
    known = {f"p{i}": {"text": f"prompt {i}", "category": "Test"} for i in range(8)}
    prompts, mode, k = S.prompt_pool(spark, {}, known)
    return S.select_prompts(_trials(spark, sf_dir), prompts, mode, k, "study", startup=12)


# --- extension -------------------------------------------------------------------------------------------------------
@query("quality_rollup", f"{O.FULL} SELECT source, lang, round(avg(quality_score), 6) AS avg_quality, count(*) AS n FROM scored GROUP BY ROLLUP (source, lang)")
def quality_rollup(spark, sf_dir):
    """EXTENSION: means by source and language, by source, and overall."""
    return rounded(responses(spark, sf_dir).rollup("source", "lang").agg(F.avg("quality_score").alias("avg_quality"), F.count("*").alias("n")))
